"""License scans by a positional index of rare licence words.

Each licence notice is a short template. Document frequencies of the templates' words,
counted over all texts, give their IDF; a template's anchors are its words of highest
IDF. The index maps an anchor to its templates and places in them. For a text's words
that are anchors, place minus place in the template is where the template would start;
starts on which enough IDF of one template's anchors agree are compared word by word, and
count if enough words agree and a mandatory key phrase stands there whole.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import letter_words, summed

# Phrases that give a label wherever their words stand in a row.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Common notices (label, words, mandatory key phrase or phrases), as licences recommend them or projects write them.
NOTICES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights under cc0 1 0", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)

# The licences' own headers, titles and opening passages; several key phrases are all mandatory.
_HEADER = "terms of the gnu {}general public license as published by the free software foundation either version {} of the license"
NOTICES += (
    *((f"gpl-{v}", _HEADER.format("", v), ("gnu general public license", f"version {v} of the license")) for v in "23"),
    *((f"gpl-{v}", f"terms of the gnu general public license version {v} as published by the free software foundation", f"gnu general public license version {v}") for v in "23"),
    *(("lgpl", _HEADER.format(f"{kind} ", v), (f"gnu {kind} general public license", f"version {v} of the license")) for kind, v in (("library", "2"), ("lesser", "2 1"), ("lesser", "3"))),
    ("gpl-3", "gnu general public license version 3 29 june 2007", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2 june 1991", "gnu general public license version 2"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", "gnu general public license is a free copyleft license"),
    ("gpl-2", "the gnu general public license is intended to guarantee your freedom to share and change free software", "gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("mpl-2", "means each individual or legal entity that creates contributes to the creation of or owns covered software", "contributes to the creation of or owns covered software"),
    ("mit", "mit license copyright c", "mit license"),
    ("mit", "the mit license mit", "the mit license mit"),
    ("bsd", "bsd 2 clause license", "bsd 2 clause"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause"),
    ("isc", "isc license copyright c", "isc license"),
    *(("agpl-3", words, key) for words, key in (
        (_HEADER.format("affero ", "3"), ("gnu affero general public license", "version 3 of the license")),
        ("licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
        ("gnu affero general public license version 3 19 november 2007", "gnu affero general public license version 3"),
    )),
    *((f"gpl-{v}", f"licensed under gplv{v}", f"under gplv{v}") for v in "23"), *((f"gpl-{v}", f"licensed under the gpl v{v}", f"under the gpl v{v}") for v in "23"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"), ("epl-2", "eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0", "eclipse public license v1 0"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license version 1 0"), ("boost", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the zlib libpng license zlib", "zlib libpng license"), ("zlib", "the zlib license", "zlib license"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"), ("cddl", "common development and distribution license cddl version 1 0", "common development and distribution license"),
    ("artistic-2", "the artistic license 2 0", "artistic license 2 0"), ("artistic", "under the terms of the artistic license", "terms of the artistic license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("the software is provided as is without warranty of any kind", "and noninfringement")),
    *((f"cc-by{part}", f"creative commons attribution {name}{v}", f"creative commons attribution {name}{v[:3]}") for part, name in (
        ("", ""), ("-sa", "sharealike "), ("-nc", "noncommercial "), ("-nd", "noderivatives "), ("-nc-sa", "noncommercial sharealike "), ("-nc-nd", "noncommercial noderivatives "),
        ("-nd", "noderivs "), ("-nc-nd", "noncommercial noderivs "),
    ) for v in ("4 0 international", "3 0 unported", "2 5 generic", "2 0 generic")),
    ("cc0", "creative commons legal code cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    # No licence, but a notice of the terms: none are granted.
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)

# Identifiers of one line, as the words that they make, and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 0": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2", "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd", "isc": "isc", "epl 1 0": "epl-1", "epl 2 0": "epl-2", "bsl 1 0": "boost", "zlib": "zlib", "cddl 1 0": "cddl", "cddl 1 1": "cddl", "artistic 2 0": "artistic-2", "cc0 1 0": "cc0", "unlicense": "unlicense",
    "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 4 0": "cc-by-nc-nd",
}
NOTICES += tuple((label, f"spdx license identifier {words}", f"spdx license identifier {words}") for words, label in IDENTIFIERS.items())
NEGATIONS = frozenset((b"not", b"never"))


class Index:
    """Templates' words and the postings of their anchors; whole phrases, each with one anchor, are found by the same look-up."""

    def __init__(self, notices, idf: dict[bytes, float], anchors: int, phrases: tuple[str, ...] = ()):
        keys = lambda key: [k.encode().split() for k in ((key,) if isinstance(key, str) else key)]
        self.templates = [(label, words.encode().split(), keys(key)) for label, words, key in notices]
        self.postings, self.mass = defaultdict(list), []
        for t, (_, words, _) in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-idf[w], w))[:anchors]
            self.mass.append(sum(idf[w] for w in rare))
            for w in rare:
                self.postings[w].extend((t, i, idf[w] / words.count(w)) for i, x in enumerate(words) if x == w)
        self.postings = dict(self.postings)
        self.phrases, self.exact = [p.encode().split() for p in phrases], defaultdict(list)
        for k, words in enumerate(self.phrases):
            i = max(range(len(words)), key=lambda i: idf[words[i]])
            self.exact[words[i]].append((k, i))
        self.anchors = self.postings.keys() | self.exact.keys()

    def places(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Where the anchors stand: one pass over the words for each anchor that is there."""
        out = {}
        for w in self.anchors & set(words):
            at, out[w] = -1, []
            for _ in range(words.count(w)):
                at = words.index(w, at + 1)
                out[w].append(at)
        return out

    def whole(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(number, first word) of all places of whole phrases."""
        return [
            (k, at - i) for w in self.exact.keys() & places.keys() for at in places[w] for k, i in self.exact[w]
            if at >= i and words[at - i : at - i + len(self.phrases[k])] == self.phrases[k]
        ]

    def find(self, words: list[bytes], places: dict[bytes, list[int]], least_mass: float, least_share: float) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the template's words that agree)."""
        votes = defaultdict(float)
        for w in self.postings.keys() & places.keys():
            for at in places[w]:
                for t, i, weight in self.postings[w]:
                    votes[t, at - i] += weight
        out = []
        for (t, start), mass in votes.items():
            if mass < least_mass * self.mass[t] - 1e-9:
                continue
            label, template, keys = self.templates[t]
            agree = [i for i, w in enumerate(template) if 0 <= start + i < len(words) and words[start + i] == w]
            share = len(agree) / len(template)
            near = words[max(0, start) : start + len(template)]
            whole = all(any(near[i : i + len(key)] == key for i in range(len(near) - len(key) + 1)) for key in keys)
            if share >= least_share and whole:
                out.append((label, start + agree[0], start + agree[-1] + 1, share))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def word_idf(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, float]:
    """IDF over all rows of docs(text) of the words given."""
    place = {w: i for i, w in enumerate(vocabulary)}

    def count(batches):
        n = np.zeros(len(place) + 1)
        for b in batches:
            for x in b.column(0):
                for w in place.keys() & set(letter_words(x.as_py())):
                    n[place[w]] += 1
                n[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()])], names=["payload"])

    n = summed(docs.select("text").mapInArrow(count, "payload binary"))
    n = np.zeros(len(place) + 1) if n is None else n
    return {w: float(np.log((n[-1] + 1) / (n[i] + 0.5))) for w, i in place.items()}


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, anchors: int = 5, least_mass: float = 0.5, least_share: float = 0.6) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of all phrases, overlapping ones too; first_word and last_word
    are their least and greatest start, null if there is none. labels holds base_labels and
    those of the notices found; both are sorted, distinct and joined by commas, empty if
    there are none. score is 1 with a base label, else the best share of a notice's words
    that agree, 0 without any. A notice with not or never as one of the two words before it is none ('not
    licensed under …'); base phrases stay. spans: label, first, last (the word after it) and share of
    each notice found. Null and empty texts have no words. Repeated rows are rows of their
    own; other columns are ignored. Texts count whole, however long; the work grows with
    their length. No rows give no rows.
    """
    vocabulary = sorted({w for text in (*phrases, *(n[1] for n in notices)) for w in text.encode().split()})
    index = Index(notices, word_idf(docs, vocabulary), anchors, tuple(phrases))
    label_of = list(phrases.values())
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1):
                words = letter_words(x.as_py())
                at = index.places(words)
                hits = index.whole(words, at)
                base, places = {label_of[k] for k, _ in hits}, [first for _, first in hits]
                found = [f for f in index.find(words, at, least_mass, least_share) if not NEGATIONS & set(words[max(0, f[1] - 2) : f[1]])]
                labels = base | {f[0] for f in found}
                score = 1.0 if base else max((f[3] for f in found), default=0.0)
                spans = [dict(zip(("label", "first", "last", "share"), f, strict=True)) for f in found]
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True))], names=names)

    rest = T.StructType.fromDDL("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, share: double>>")
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *rest]))
