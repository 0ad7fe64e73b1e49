"""Licence notices in their real wording."""

from helpers import docs

from molmill.llm.license import license_scan

FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
REAL = [
    (FREE.format("", "3"), "gpl-3"), (FREE.format("", "2"), "gpl-2"), (FREE.format("Lesser ", "2.1"), "lgpl"), (FREE.format("Lesser ", "3"), "lgpl"), (FREE.format("Library ", "2"), "lgpl"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl-2"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.", "gpl-3"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy", "gpl-3"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.", "gpl-2"),
    ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "gpl-3"),
    ("By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure", "gpl-2"),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "mpl-2"), ("Mozilla Public License Version 1.1", ""),
    ('1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.', "mpl-2"),
    ("MIT License\n\nCopyright (c) 2020 A. Person", "mit"), ("The MIT License (MIT)", "mit"), ("BSD 3-Clause License", "bsd"), ("BSD 2-Clause License", "bsd"), ("ISC License\n\nCopyright (c) 2020", "isc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"), ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"), ("Creative Commons Attribution-NoDerivatives 4.0 International", "cc-by-nd"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"), ("Creative Commons Attribution-NonCommercial-NoDerivatives 2.5 Generic", "cc-by-nc-nd"),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "cc0"), ("Copyright 2019 A. Person. All rights reserved.", "all-rights-reserved"),
    (FREE.format("Affero ", "3"), "agpl-3"), ("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007", "agpl-3"), ("Licensed under GPLv3.", "gpl-3"), ("licensed under the GPL v2", "gpl-2"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2"), ("Eclipse Public License - v 2.0", "epl-2"), ("terms of the Eclipse Public License v1.0", "epl-1"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "boost"), ("The zlib/libpng License (Zlib)", "zlib"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License (the License).", "cddl"), ("under the terms of the Artistic License", "artistic"), ("The Artistic License 2.0", "artistic-2"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "mit"),
    ("Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License", "cc-by-nc-nd"), ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("SPDX-License-Identifier: AGPL-3.0-only", "agpl-3"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc,cc-by-nc-sa"), ("SPDX-License-Identifier: Unknown-1.0", ""),
    ("It is not licensed under the GNU GPL v3, nor under another one.", ""), ("This work is not licensed under the GNU General Public License, version 3", ""), ("never licensed under GPLv3", ""),
    ("all human rights are reserved", ""), ("a general public and creative commons attribution of the license", ""), ("version 3 of the license of the general public", ""),
]


def test_real_wording(spark):
    before = "Some words that come first.\n"
    given = [(i, before * (i % 3) + text + "\nand more after it") for i, (text, _) in enumerate(REAL)] + [(1000 + i, "plain words of the text and all of it") for i in range(60)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(docs(spark, given)).collect()}
    assert {REAL[i][0]: got[i][0] for i in range(len(REAL))} == dict(REAL)
    assert all((s > 0) == bool(x) for x, s in got.values()) and not any(got[1000 + i][0] for i in range(60))
