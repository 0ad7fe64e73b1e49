import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import AWKWARD, docs, rows
from pyspark.sql import functions as F

from molmill.llm.common import summed
from molmill.llm.lm import CLASSES, GROUPS, OWN_WORDS, SHARD_TOKENS, SINGLES, WORD_NOISE, Model, Vocabulary, groups_of, lm_scores, schedule, word_counts, words_with_vectors

DATA = "/root/testdata/sf0.01"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(given):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(t for i, x in given if not out(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(t := tokens(x)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for i, x in given), key=repr)


def counted(df):
    return sorted(((*r[:5], round(r[5], 4)) for r in rows(df, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")), key=repr)


def test_counts_and_base_agree_with_brute_force(spark):
    given = AWKWARD + [(i, f"w{i % 7} common Common x{i} {'y ' * (i % 5)}") for i in range(20, 120)]
    for head in (100_000, 3):
        got = lm_scores(docs(spark, given).selectExpr("*", "1 as row", "2 as n", "'x' as word", "0.5 as score"), head_words=head)
        assert counted(got) == plain(given)


def test_better_than_the_base_on_held_out_texts(spark):
    got = lm_scores(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    assert len(got) == 1000 and np.isfinite(got.score).all() and (got.score <= 0).all()
    out = got[got.held_out]
    gain = (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum()
    print("gain in log10 per token", gain)
    assert gain > 0.05


def small_model(seed=1):
    r = np.random.default_rng(seed)
    first = SINGLES + np.array([5 * g for g in range(GROUPS + 1)])
    return Model(first, r.integers(1, 100, int(first[-1]) + CLASSES).astype(float)), r


def test_the_model_is_normalised():
    m, _ = small_model()
    every = np.arange(m.codes)
    for near, far in ((0, 0), (3, 200), (m.codes - 1, 7)):
        p = 10.0 ** m.log_probabilities(every, np.full(m.codes, near), np.full(m.codes, far))
        assert np.isclose(p.sum(), 1, atol=1e-5)


def test_long_vectors_are_normalised_too():
    m, r = small_model()
    m.part["target"] *= 300
    m.part["word"] *= 300
    every = np.arange(m.codes)
    got = m.log_probabilities(every, np.full(m.codes, 3), np.full(m.codes, 200))
    assert np.isfinite(got).all() and np.isclose((10.0**got).sum(), 1, atol=1e-4)


def test_sums_in_steps_of_any_number(spark):
    for parts in (1, 5, 40, 1100):
        given = spark.range(parts).select(F.lit(np.array([1, 2.5], dtype=np.float32).tobytes()).alias("payload"))
        assert summed(given, parts, np.float32, fan_in=8).tolist() == [parts, 2.5 * parts]
    assert summed(given.where("false"), 5, np.float32) is None


def test_the_gradient_agrees_with_differences():
    m, r = small_model()
    m.part = {k: p.astype(np.float64) for k, p in m.part.items()}
    token, near, far = r.integers(0, m.codes, (3, 60))
    noise = m.drawn(token, r)
    _, gradient = m.gradient(token, near, far, *noise)
    for name, g in gradient.items():
        p = m.part[name]
        dense = np.zeros_like(p)
        if isinstance(g, tuple):
            np.add.at(dense, g[0], g[1])
        else:
            dense += g
        for at in [tuple(r.integers(0, k) for k in p.shape) for _ in range(20)] + [np.unravel_index(np.abs(dense).argmax(), p.shape)]:
            old = p[at]
            p[at] = old + 1e-5
            high = m.gradient(token, near, far, *noise, objective=True)[0]
            p[at] = old - 1e-5
            low = m.gradient(token, near, far, *noise, objective=True)[0]
            p[at] = old
            assert np.isclose((high - low) / 2e-5, dense[at], rtol=1e-4, atol=1e-5), name


def test_noise_follows_the_counts():
    m, r = small_model()
    token = np.repeat(np.arange(SINGLES, SINGLES + 10), 4000)  # two groups' words
    _, words = m.drawn(token, r)
    assert ((words // 5) == ((token - SINGLES) // 5)[:, None]).all()
    share = np.exp(m.log_word_noise[:5].astype(float)) / WORD_NOISE
    got = np.bincount(words[: 5 * 4000].ravel(), minlength=5)[:5]
    assert np.allclose(got / got.sum(), share, atol=0.01)


def test_partitions_do_not_change_scores(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
    got = [dict(rows(lm_scores(d.repartition(n), shard_tokens=30_000), "doc_id", "score")) for n in (1, 4, 50)]
    assert len(got[0]) == d.count()
    for other in got[1:]:
        assert all(abs(other[i] - x) < 1e-4 * abs(x) for i, x in got[0].items())


def test_more_words_with_vectors_score_better(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    gain = {}
    for own in (192, 4_096):
        out = lm_scores(d, own_words=own, least_count=10).where("held_out").toPandas()
        gain[own] = (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum()
    v = [Vocabulary(word_counts(d), own_words=own, least_count=10).coverage for own in gain]
    print("gain in log10 per token", gain, "coverage", v)
    assert gain[4_096] > gain[192] and v[1] > v[0]


def test_more_shards_do_not_flatten_the_model(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    gain = {}
    for shard_tokens in (4_000_000, 15_000):
        out = lm_scores(d, shard_tokens=shard_tokens).where("held_out").toPandas()
        gain[shard_tokens] = (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum()
    print("gain in log10 per token", gain)
    assert gain[15_000] > 0.75 * gain[4_000_000]  # 10 rounds of 4 shards of 8,000 tokens; a shard by itself learns next to nothing


def test_rounds_shards_words_and_groups_grow_with_the_tokens():
    assert schedule(0) == schedule(SHARD_TOKENS) == (2, 1)
    got = [schedule(SHARD_TOKENS * 4**k) for k in range(12)]
    assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(got, got[1:]))
    assert all(0.7 < r * s / (2 * 4**k) < 1.5 for k, (r, s) in enumerate(got))
    assert words_with_vectors(100) == OWN_WORDS and words_with_vectors(8 * SHARD_TOKENS) == 2 * OWN_WORDS
    assert groups_of(100) == groups_of(OWN_WORDS) == GROUPS and groups_of(4 * OWN_WORDS) == 2 * GROUPS


def test_codes_beyond_two_bytes(spark):
    given = [(i, " ".join(f"w{(i * 40 + j) % 70_000}" for j in range(40))) for i in range(3_600)]
    got = lm_scores(docs(spark, given), own_words=70_000, least_count=1).toPandas()
    assert len(got) == len(given) and np.isfinite(got.score).all() and (got.score < 0).all()
    v = Vocabulary(word_counts(docs(spark, given)), own_words=70_000, least_count=1)
    assert v.codes > 1 << 16 and v.kind == "<u4"


def test_empty_table_and_all_held_out(spark):
    assert lm_scores(docs(spark, [])).count() == 0
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    assert counted(lm_scores(docs(spark, [(i, "a b") for i in alone]))) == plain([(i, "a b") for i in alone])
