import math
import random
import re
import time

from helpers import AWKWARD, docs, rows
from pyspark.sql import functions as F

from molmill.llm.chat import preference_pairs
from molmill.llm.license import NOTICES, PHRASES, Index, license_scan, word_idf
from molmill.llm.tokens import encode_whole, encoded_lengths, length_histogram, length_quantile, token_count, token_histogram, truncated_totals


def letter_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(given):
    out = []
    for i, text in given:
        w = letter_words(text)
        at = [(j, label) for p, label in PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        out.append((i, len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=repr)


LICENSED = [
    (20, "Released under the MIT License."), (21, "x Licensed under the Apache License, Version 2.0. y"), (22, "CC BY-NC cc by nc CC by nc"), (23, "under the MIT licensed"),
    (24, "z " * 50 + "This work is licensed under the GNU General Public License, version 3. Under the MIT License"), (25, "Licensed under CC BY-SA 4.0."), (26, "the license of the work under version 3"),
    (27, "license " * 400), (28, "gnu general public version license 3 this under"), (29, "This work is\nlicensed  under the GNU General Public License, version 3."),
]


def test_license_base_and_notices(spark):
    given = AWKWARD + LICENSED + [(100 + i, "plain words of no licence") for i in range(50)]
    got = license_scan(docs(spark, given).selectExpr("*", "1 as score", "'x' as labels"))
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == plain_base(given)
    labels = {r.doc_id: (r.labels, r.score) for r in got.collect()}
    assert {i: labels[i][0] for i in range(20, 30)} == {20: "mit", 21: "apache-2", 22: "cc-by-nc", 23: "", 24: "gpl-3,mit", 25: "cc-by-sa", 26: "", 27: "", 28: "", 29: "gpl-3"}
    assert all(0 <= s <= 1 and (s > 0) == bool(x) for x, s in labels.values())
    span = got.where("doc_id = 24").head().spans[0]
    assert (span.label, span["first"], span["last"], span.share) == ("gpl-3", 50, 62, 1.0)
    assert license_scan(docs(spark, [])).count() == 0


def plain_notices(words, idf, anchors=5, least_mass=0.5, least_share=0.6):
    """Every notice at every place, without an index."""
    out = []
    for label, text, key in NOTICES:
        v, keys = text.split(), [k.split() for k in ((key,) if isinstance(key, str) else key)]
        rare = sorted(set(v), key=lambda w: (-idf[w.encode()], w))[:anchors]
        for start in range(-len(v) + 1, len(words)):
            agree = [i for i in range(len(v)) if 0 <= start + i < len(words) and words[start + i] == v[i]]
            mass = sum(idf[v[i].encode()] / v.count(v[i]) for i in agree if v[i] in rare)
            near = words[max(0, start) : start + len(v)]
            whole = all(any(near[i : i + len(k)] == k for i in range(len(near) - len(k) + 1)) for k in keys)
            if mass >= least_mass * sum(idf[w.encode()] for w in rare) - 1e-9 and len(agree) / len(v) >= least_share and whole:
                out.append((label, start + agree[0], start + agree[-1] + 1, round(len(agree) / len(v), 9)))
    return sorted(out)


def test_labels_and_scores_agree_with_brute_force(spark):
    r = random.Random(9)
    some = [w for _, text, _ in NOTICES for w in text.split()]
    given = []
    for i in range(150):
        words = []
        for _ in range(r.randrange(1, 5)):
            text = r.choice(NOTICES)[1].split()
            for _ in range(r.randrange(3)):
                text[r.randrange(len(text))] = r.choice(some)
            words += text[r.randrange(2) :] + [r.choice(some) for _ in range(r.randrange(4))]
        given.append((i, " ".join(words)))
    given += [(500 + i, "plain words that say nothing") for i in range(100)] + AWKWARD
    vocabulary = sorted({w.encode() for text in (*PHRASES, *(n[1] for n in NOTICES)) for w in text.split()})
    d = docs(spark, given)
    idf = word_idf(d, vocabulary)
    texts = dict(given)
    for x in license_scan(d).where("doc_id < 500 and doc_id > 10").collect():
        want = plain_notices(letter_words(texts[x.doc_id]), idf)
        assert sorted((s.label, s["first"], s["last"], round(s.share, 9)) for s in x.spans) == want
        base = set(filter(None, x.base_labels.split(",")))
        assert x.labels == ",".join(sorted(base | {w[0] for w in want}))
        assert math.isclose(x.score, 1.0 if base else max((w[3] for w in want), default=0.0), abs_tol=1e-8)


def test_long_text_of_phrases():
    """Work grows with the length: a megabyte of a phrase takes seconds, not minutes."""
    words = b"cc by nc ".split() * 120_000
    index = Index(NOTICES, dict.fromkeys({w.encode() for text in (*PHRASES, *(n[1] for n in NOTICES)) for w in text.split()}, 1.0), 5, tuple(PHRASES))
    began = time.perf_counter()
    at = index.places(words)
    assert len(index.whole(words, at)) == 120_000 and not index.find(words, at, 0.5, 0.6)
    assert time.perf_counter() - began < 60


def test_token_histogram(spark):
    given = AWKWARD + [(100 + i, "Some text, " * (i * i % 97)) for i in range(200)]
    n = [r.n_tokens for r in encoded_lengths(docs(spark, given)).collect()]
    assert len(n) == len(given)
    want = sorted((x, n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(min(x, y) for y in n)) for x in set(n))
    hist = token_histogram(docs(spark, given).selectExpr("*", "1 as n_tokens", "2 as block")).cache()
    assert sorted(tuple(r) for r in hist.collect()) == want
    assert rows(truncated_totals(hist, [0, 5, 10**6]), "context_limit", "tokens", "texts_cut") == sorted(((k, sum(min(k, y) for y in n), sum(y > k for y in n)) for k in (0, 5, 10**6)), key=repr)
    ordered = sorted(n)
    assert [length_quantile(hist, q) for q in (0, 0.5, 1)] == [ordered[0], ordered[(len(n) + 1) // 2 - 1], ordered[-1]]
    empty = length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert empty.count() == 0 and length_quantile(empty, 0.5) is None


def own_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_white_space(spark):
    encoding = own_encoding()
    r = random.Random(8)
    for _ in range(2000):
        text = "".join(r.choice(["a", "é", "'s", "7", "!", *" \n\t\u2003\x1f\xa0" * 3]) for _ in range(r.randrange(40)))
        assert token_count(encoding, text, 3) == len(encoding.encode_ordinary(text)), repr(text)
    given = [(1, " " * 1_000_000), (2, "a" + " " * 1_000_000 + "b"), (3, "word " * 300_000), (4, "x" * 1_000_000), (5, "\n" * 1_000_000 + "end")]
    got = dict(rows(encoded_lengths(docs(spark, given)), "doc_id", "n_tokens"))
    assert got[1] == 1_000_000 and got[2] == 1 + 999_999 + 1 and got[3] > 300_000 and got[4] > 0 and got[5] == len(encoding._encode_single_piece("\n" * 999_999)) + 2


def plain_pairs(turns):
    out = []
    for p in sorted({c // 2 for c, *_ in turns if c is not None}):
        side = [sorted(((t is not None, t, r or "", x or "") for c, t, r, x in turns if c == 2 * p + s), key=lambda v: (v[0], v[1] or 0, v[2], v[3])) for s in (0, 1)]
        n = 0
        while n < min(map(len, side)) and side[0][n][2:] == side[1][n][2:]:
            n += 1
        show = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for *_, r, x in ts)
        row = [p, n, show(side[0][:n])]
        for s in side:
            at, spans = 0, []
            for *_, r, x in s[n:]:
                first, at = at + len(f"<|{r}|>\n"), at + len(f"<|{r}|>\n{x}<|end|>\n")
                spans += [(first, at)] * (r == "assistant")
            row += [show(s[n:]) if s else None, spans if s else None]
        out.append(tuple(row))
    return out


def test_preference_pairs(spark):
    r = random.Random(3)
    turns = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "é" * 3])) for c in range(60) for t in range(r.randrange(1, 6))]
    turns += [(c, t, "user", "same opening") for c in range(100, 140) for t in range(2)] + [(c, 2, "assistant", f"x{c}" * 3000) for c in range(100, 140)]
    turns += [(None, 0, "user", "lost"), (200, None, "user", "only one"), (202, 1, "user", "tie"), (202, 1, "user", "tie"), (203, 1, "user", "tie")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as c", "2 as n", "3 as side")
    got = preference_pairs(table, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 1)
    have = [(x.pair_id, x.n_prefix, x.prompt, x.chosen, None if x.chosen is None else [tuple(s) for s in x.chosen_spans], x.rejected, None if x.rejected is None else [tuple(s) for s in x.rejected_spans]) for x in got.collect()]
    assert sorted(have) == sorted(plain_pairs(turns))
    assert preference_pairs(table.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_runs_of_white_space_just_below_any_length_take_little_time():
    """Text of 10 MB in runs of white space, and the counts of the encoder's own pattern on shorter ones."""
    encoding = own_encoding()
    for n in (998, 999, 1000, 1001, 2500):
        for text in (f"a{' ' * n}b", f"{' ' * n}", f"x{chr(10) * n}", f"{' ' * n}{chr(10)}y {chr(0x3000) * n}z"):
            assert encode_whole(encoding, text) == encoding.encode_ordinary(text)
    for run in (99_999, 999, 600):
        text = ("x" + " " * run) * (10_000_000 // run)
        began = time.perf_counter()
        assert token_count(encoding, text) > 9_000_000
        assert time.perf_counter() - began < 30
