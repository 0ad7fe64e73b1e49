"""Near pairs of keys of few points go by key, those of keys of many by cells; both against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from molmill.operators import geometry as G

ROW = "mol_id long, idx long, fixed boolean, x double, y double, z double"


def frame(spark, seed):
    rng = random.Random(seed)
    rows = [(k, i, rng.random() < 0.3, *(rng.uniform(0, 6) for _ in "xyz")) for k, n in ((0, 3), (1, 9), (2, 40), (3, 1)) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (1, 90, False, None, 0.0, 0.0), (1, 91, False, float("nan"), 0.0, 0.0), (None, 92, False, 0.0, 0.0, 0.0)], ROW)


def near(rows, radius):
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[3:], b[3:], strict=True)) ** 0.5
    return {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and gap(a, b) <= radius}


@pytest.mark.parametrize("few", [0, 10, 256])
def test_parts_are_all_near_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(G, "FEW", few)
    rows, points = frame(spark, 3)
    parts = G._near_parts(points, points, "mol_id", 1.5)
    assert [f for _, f in parts] == ([True] if few == 256 else [True, False])
    assert sorted((r.mol_id, r.idx, r.r_idx) for p, _ in parts for r in p.collect()) == sorted(near(rows, 1.5))


def test_results_do_not_follow_the_way(spark, monkeypatch):
    _, points = frame(spark, 4)
    a, b = points.where("not fixed"), points.where("fixed")
    got = []
    for few in (0, 10, 256):
        monkeypatch.setattr(G, "FEW", few)
        of = lambda df: sorted(map(tuple, df.fillna(-1).collect()))
        got.append([of(G.greedy_pairs(a, b)), of(G.pruned(points, 1.5).select("mol_id", "idx")), of(G.nearest_point(a, b.select("mol_id", F.col("idx").alias("p"), "x", "y", "z")))])
    assert got[0] == got[1] == got[2] and all(got[0])


def test_few_points_are_not_sent_to_cells(spark):
    _, points = frame(spark, 5)
    plan = G.pruned(points, 1.5)._jdf.queryExecution().toString()
    assert "cell_x" not in plan
