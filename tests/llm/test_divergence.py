import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import AWKWARD, docs

from molmill.llm import divergence
from molmill.llm.divergence import _shares, divergence_audit

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain(given, least_docs=3, ranks=200):
    """As the contract says it, in whole numbers, over every term."""
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in given:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least_docs) for lang, c in df.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in groups.items():
        whole[lang].update(c)

    def shares(c, terms):
        total = sum(c[t] for t in terms)
        return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(terms)) for t in terms}

    out = []
    for (lang, source), c in groups.items():
        terms = kept[lang]
        p, q = shares(c, terms), shares(whole[lang], terms)
        f = lambda a, b: (a - b) * (a - b) // b
        pairs = [(sum(f(p[t], o[t]) for t in terms), other) for (x, other), d in groups.items() if x == lang and other != source for o in [shares(d, terms)]]
        best = [(f(p[t], q[t]), t) for t in terms if c[t] and p[t] > q[t]]
        for part, rows in (("pair", pairs), ("term", best)):
            rows.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(rows) if part == "pair" or i < ranks]
    return sorted(out)


def frame(spark, given):
    return spark.createDataFrame([(t, lang, s, 1, 2) for t, lang, s in given], "text string, lang string, source string, n long, term long")


def got(spark, given, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in divergence_audit(frame(spark, given), **kw).collect())


def test_divergence_against_plain_loops(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "The", "of", "é", "É", "ß1x", "zz-top", "日本", "\U0001f600", *(f"w{c}" for c in "abcdefghijkl")]
    given = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3", None])) for _ in range(150)]
    given += [(t, "en", None) for _, t in AWKWARD[:12]] + [("only here", None, None), (None, None, "x"), ("", "fr", "a"), ("1 2", "fr", "b"), ("a a a", "it", "z")]
    want = plain(given)
    assert got(spark, given) == want
    assert {r[2] for r in want} == {"pair", "term"} and ("", "x", "pair", "", 0, 1) in want
    # Smaller blocks, and partial counts that are put out early, change nothing; nor do few ranks, where ties end inside a cell.
    for name, value in (("BLOCK", 3), ("CELLS", 8), ("FLUSH", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert got(spark, given, ranks=4) == plain(given, ranks=4)
    assert got(spark, []) == []


def test_divergence_over_whole_documents(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.text, r.lang, r.source) for r in data.collect()], ranks=30)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in divergence_audit(data, ranks=30).collect()) == want


def test_shares_are_exact_for_counts_beyond_floats():
    n = [0, 1, 10**14 - 1, 3 * 10**15, 7]
    total = [1, 10**15, 10**14, 8 * 10**15, 9]
    assert _shares(np.array(n), np.array(total)).tolist() == [1 + 1_000_000_000 * (a + 1) // b for a, b in zip(n, total, strict=True)]
