import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from helpers import AWKWARD, docs, rows
from pyspark.sql import functions as F

from molmill.llm.mix import mix_documents, mix_sizes
from molmill.llm.shard import feistel_plan, permuted, shard_documents, shard_rows


def plain_targets(sizes, weights=(5, 2, 1)):
    """sizes: source to words. Excess over twice the size is reshared again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        share, left = left / sum(w[s] for s in open_), 0.0
        for s in open_:
            target[s] += share * w[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def position(i, t):
    return int(hashlib.md5(f"mix:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_agrees_with_brute_force(spark, seed):
    given = [(i, t, "awkward") for i, t in AWKWARD] + [(100 + i, "w " * (i * 7 * seed % 50), ["a", "b", "B", "é", None, "hot", "hot", "hot"][i % 8]) for i in range(600)] + [(9000, "", "nothing")]
    given += [(None, f"null id {'w ' * (i % 9)}", "ids") for i in range(200)] + [(7, "the same row " * 5, "repeats")] * 100 + [(i, "once more" * (i % 2), "z") for i in range(9100, 9140)]
    d = docs(spark, given).selectExpr("*", "1 as size", "2 as position", "3 as prefix", "4 as weight", "5 as below")
    d = d.withColumn("source", F.when(d.source.isNotNull(), d.source))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in given:
        total[s] += size(t)
    target = plain_targets(total)
    want = []
    for s in total:
        mine = sorted(((position(i, t), size(t), i) for i, t, x in given if x == s), key=lambda m: (m[0], repr(m)))
        whole = int(target[s] / total[s] + 1e-12) if total[s] else 0
        budget, taken = target[s] - whole * total[s], 0
        more = budget > 1e-6
        for p, n, i in mine:  # one after the other, until the next would end farther from the budget
            more = more and not taken + n - budget >= budget - taken if n else more
            taken += n * more
            want.append((i, n, total[s], round(target[s], 6), n * (whole + more)))
        assert abs(taken - budget) <= max(m[1] for m in mine) / 2 + 1e-6
    got = [(a, b, c, round(t, 6), x) for a, b, c, t, x in rows(mix_sizes(d), "doc_id", "size", "source_size", "target", "taken")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    copies = Counter()
    for r in mix_sizes(d).collect():
        copies[r.doc_id] += r.copies
    mixed = mix_documents(d)
    assert mixed.columns == d.columns and Counter(r.doc_id for r in mixed.collect()) == +copies


def test_no_copies_beyond_the_cap(spark):
    """A source at its cap has no budget left: empty documents are taken as often as the others."""
    given = [(i, "w " * (i % 2 * 3), "z") for i in range(40)] + [(100 + i, "w " * 400, "a") for i in range(20)]
    assert {(r.size > 0, r.copies) for r in mix_sizes(docs(spark, given)).collect() if r.source_size == 60} == {(True, 2), (False, 2)}


def test_mix_of_nothing(spark):
    assert mix_sizes(docs(spark, [])).count() == 0 and mix_documents(docs(spark, [])).count() == 0
    assert rows(mix_sizes(docs(spark, [(1, None), (2, "")])), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def plain_permuted(x, plan):
    a, b, n = plan["a"], plan["b"], plan["n"]
    while True:
        left, right = divmod(x, b)
        for i, (k, c) in enumerate(plan["keys"]):
            t = (right + k) * 1_103_515_245 % 2_147_483_647
            left, right = right, (left + (t * t + c) % 2_147_483_647) % (b if i % 2 else a)
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 23, 24, 97, 1000, 10007])
def test_permutation(spark, n):
    plan = feistel_plan(n, "s")
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), plan)).collect()]
    assert got == [plain_permuted(x, plan) for x in range(n)] and sorted(got) == list(range(n))


def test_shards(spark):
    given = AWKWARD + [(100 + i, f"text {i}") for i in range(500)] + [(77, "copy")] * 300
    d = docs(spark, given).selectExpr("*", "1 as shard", "2 as slot", "3 as law")
    got = shard_documents(d).collect()
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    plan = feistel_plan(len(given), "shard")
    want = []
    for x, (i, t) in enumerate(order):
        p = plain_permuted(x, plan)
        want.append((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", p % 24, p // 24, None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    again = shard_documents(d.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert shard_documents(docs(spark, [])).count() == 0
    wide = shard_rows(d, 5, ["doc_id"])
    assert wide.columns == [c for c in d.columns if c not in ("shard", "slot")] + ["shard", "slot"] and math.isclose(wide.count(), len(given))
