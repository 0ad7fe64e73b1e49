"""Pairing and pruning in rounds of joins are what the loops give."""

import random
from math import dist

from molmill.operators.geometry import greedy_pairs, pruned

POINTS = "mol_id long, idx long, fixed boolean, x double, y double, z double"


def drawn(seed, n):
    rng = random.Random(seed)
    at = lambda: (float(rng.randint(0, 9)), rng.choice([0.0, 0.5, rng.uniform(0, 4)]), 0.0)
    return [(rng.choice([0, 0, 0, 1]), i, rng.random() < 0.15, *at()) for i in range(n)]


def plain_pairs(a, b, radius):
    out = []
    for k in {r[0] for r in a + b}:
        x, y = ({r[1]: r[3:] for r in rows if r[0] == k} for rows in (a, b))
        used_i, used_j = set(), set()
        for d, i, j in sorted((dist(p, q), i, j) for i, p in x.items() for j, q in y.items()):
            if d <= radius and i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                out.append((k, i, j))
        out += [(k, i, None) for i in x if i not in used_i] + [(k, None, j) for j in y if j not in used_j]
    return sorted(out, key=repr)


def plain_pruned(points, radius):
    stay = []
    for r in sorted(points, key=lambda r: r[1]):
        if r[2] or all(s[0] != r[0] or dist(s[3:], r[3:]) >= radius for s in stay):
            stay.append(r)
    return sorted(r[:2] for r in stay)


def test_pairs_and_pruning_in_rounds(spark):
    for seed in (1,):
        a, b = drawn(seed, 70), drawn(seed + 10, 60)
        one, two = spark.createDataFrame(a, POINTS), spark.createDataFrame(b, POINTS)
        for at_once in (0, 60, 500_000):
            got = greedy_pairs(one.drop("fixed"), two.drop("fixed"), radius=1.5, at_once=at_once).collect()
            assert sorted(((r.mol_id, r.i, r.j) for r in got), key=repr) == plain_pairs(a, b, 1.5)
            assert all((r.d is None) == (r.i is None or r.j is None) for r in got)
            left = pruned(one, 1.2, at_once=at_once)
            assert sorted((r.mol_id, r.idx) for r in left.collect()) == plain_pruned(a, 1.2) and left.columns == one.columns
    assert pruned(one.limit(0), 1.2, at_once=0).count() == 0 == greedy_pairs(one.limit(0).drop("fixed"), two.limit(0).drop("fixed"), at_once=0).count()
