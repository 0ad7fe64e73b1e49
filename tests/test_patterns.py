"""Pattern screens against plain search."""

import random
import time

import numpy as np
from molmill.operators.patterns import NONE, PIECE, Automaton, pattern_hits, with_first_hit


def scan(automaton, texts):
    data = [t.encode() for t in texts]
    length = np.array([len(t) for t in data], dtype=np.int64)
    return automaton.first_hits(np.frombuffer(b"".join(data), np.uint8), np.cumsum(length) - length, length).tolist()


def plain(patterns, texts):
    return [next((i for i, p in enumerate(patterns) if p in t), NONE) for t in texts]


def test_first_hits_against_plain_search():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randint(1, n)))
    for _ in range(150):
        patterns = [word(8) for _ in range(rng.randint(1, 12))] + ["ab" * rng.randint(1, 40)]
        rng.shuffle(patterns)
        texts = [word(30) for _ in range(20)] + ["", "x", "ab" * 700, "x" * (PIECE - 3) + patterns[0] + "x" * 900, "".join(rng.choice("ab") for _ in range(3000))]
        assert scan(Automaton([p.encode() for p in patterns]), texts) == plain(patterns, texts)
    assert scan(Automaton([b"q", b""]), ["", "a", "q"]) == [1, 1, 0]
    # A pattern on every place of two pieces' bounds.
    for at in range(PIECE - 12, PIECE + 12):
        assert scan(Automaton([b"0123456789"]), ["." * at + "0123456789" + "." * 600]) == [0]


def test_screen_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("CNO()=1") for _ in range(rng.randint(1, n)))
    catalog = [(k, f"r{k}", word(9)) for k in range(60)] + [(3, "r3b", "CC"), (70, "none", None), (None, "nowhere", "C"), (71, "r71", "é")]
    texts = [(i, word(25)) for i in range(300)] + [(300, None), (301, ""), (302, "xéx"), (1, "again"), (303, "z" * 200_000 + catalog[0][2])]
    frame = spark.createDataFrame(texts, "k long, t string").selectExpr("*", "1 as pattern", "'x' as text")
    cat = spark.createDataFrame(catalog, "ord long, reg_id string, pattern string")
    order = sorted((o, r, p) for o, r, p in catalog if o is not None and p is not None)
    want = [(k, t, *next(((o, r) for o, r, p in order if t is not None and p in t), (None, None))) for k, t in texts]
    monkeypatch.setattr("molmill.operators.patterns.STEPS", 2)
    for size in (80, 60_000):
        got = with_first_hit(frame, cat, "t", "o", "r", size)
        assert sorted(((x.k, x.t, x.o, x.r) for x in got.collect()), key=repr) == sorted(want, key=repr) and got.columns == [*frame.columns, "o", "r"]
    assert "Exchange" not in with_first_hit(frame, cat, "t", "o", "r")._jdf.queryExecution().executedPlan().toString()
    by_key = {}
    for k, _, o, r in want:
        if o is not None:
            by_key[k] = min(by_key.get(k, (o, r)), (o, r))
    assert {x.k: x.reg_id for x in pattern_hits(frame, cat, "k", "t").collect()} == {k: r for k, (_, r) in by_key.items()}
    assert pattern_hits(frame, cat.limit(0), "k", "t").count() == 0 and with_first_hit(frame.limit(0), cat, "t", "o", "r").count() == 0


def test_time_does_not_follow_the_catalog():
    rng = random.Random(3)
    texts = ["".join(rng.choice("CNOcnos()=12") for _ in range(80)) for _ in range(20_000)]
    took = []
    for n in (10, 2_000):
        automaton = Automaton([("Z" + "".join(rng.choice("CNOcnos()=12") for _ in range(25))).encode() for _ in range(n)])
        scan(automaton, texts[:100])
        began = time.perf_counter()
        scan(automaton, texts)
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.5
    began = time.perf_counter()
    scan(automaton, ["x" * 20_000_000])
    assert time.perf_counter() - began < 20
