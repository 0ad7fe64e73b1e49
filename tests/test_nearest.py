"""Nearest points against plain search: near, far, tied and dense ones."""

import random

import numpy as np
import pytest
from molmill.operators.geometry import nearest_point
from pyspark.sql import functions as F

C, P = "mol_id long, idx long, x double, y double, z double", "mol_id long, p long, x double, y double, z double"


def plain(candidates, points):
    by_key = {}
    for k, p, *at in points:
        if all(v is not None and v == v for v in at):
            by_key.setdefault(k, []).append((p, np.array(at)))
    out = {}
    for k, i, *at in candidates:
        if k in by_key and all(v is not None and v == v for v in at):
            d, p = min((float(np.sqrt(((np.array(at) - x) ** 2).sum())), p) for p, x in by_key[k])
            if (k, i) not in out or (d, p) < (out[k, i][1], out[k, i][0]):
                out[k, i] = (p, d)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_points(spark, seed):
    rng = random.Random(seed)
    at = lambda w: [rng.choice([rng.uniform(-w, w), float(rng.randint(-3, 3))]) for _ in range(3)]
    points = [(rng.randrange(4), p, *at(rng.choice([3, 60, 5000]))) for p in range(150)]
    points += [(0, 1000 + p, 700.0 + rng.random(), 700.0, 700.0) for p in range(300)]  # many far points in one place
    points += [(5, 2000 + p, s * 40.0, 0.0, 0.0) for p, s in enumerate((1, -1, 1))] + [(1, 3000, None, 0.0, 0.0), (1, 3001, float("nan"), 0.0, 0.0), (8, 3002, 1.0, 1.0, 1.0)]
    candidates = [(rng.randrange(6), i, *at(rng.choice([3, 100, 9000]))) for i in range(80)] + [(5, 900, 0.0, 0.0, 0.0), (0, 901, None, 1.0, 1.0), (0, 902, 650.0, 650.0, 650.0), (9, 903, 0.0, 0.0, 0.0)]
    candidates += [(0, 902, 650.0, 650.0, 650.0), (5, 904, 38.0, 0.0, 0.0)]
    frame, other = spark.createDataFrame(candidates, C), spark.createDataFrame(points, P).withColumn("d", F.lit(1))
    want = plain(candidates, points)
    for radius in (2.0, 0.3, 50.0):
        got = {(r.mol_id, r.idx): (r.p, r.d) for r in nearest_point(frame, other, radius=radius).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12, abs=1e-12) for k in want), radius
    assert want[5, 900] == (2000, 40.0)
    assert nearest_point(frame.limit(0), other).count() == 0 == nearest_point(frame, other.limit(0)).count()


def test_a_grid_of_far_points(spark):
    """Candidates far from all points of a grid, each nearest to another one of it."""
    points = spark.range(1000).select(F.lit(1).cast("long").alias("mol_id"), F.col("id").alias("p"), (F.col("id") % 100 * 5.0).alias("x"), (F.floor(F.col("id") / 100) * 5.0).alias("y"), F.lit(0.0).alias("z"))
    candidates = spark.range(50).select(F.lit(1).cast("long").alias("mol_id"), F.col("id").alias("idx"), (F.col("id") * 10.0 + 1).alias("x"), F.lit(-300.0).alias("y"), F.lit(0.5).alias("z"))
    got = {r.idx: r.p for r in nearest_point(candidates, points).collect()}
    assert got == {i: min(range(1000), key=lambda p, i=i: ((p % 100 * 5.0 - i * 10.0 - 1) ** 2 + (p // 100 * 5.0 + 300) ** 2, p)) for i in range(50)}
