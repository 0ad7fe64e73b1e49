"""Bricks of voxels against voxels as rows, and against a plain dense grid."""

import random

import numpy as np
import pytest
from molmill.operators import bricks as B
from molmill.operators import voxels as V
from pyspark.sql import functions as F

POINTS = "mol_id string, channel int, x double, y double, z double"


def drawn(n=300):
    rng = random.Random(9)
    at = lambda: rng.choice([rng.uniform(-1, 21), float(rng.randrange(20)), rng.randrange(20) + 0.5, 7.999999, 8.0, 15.5])
    rows = [(rng.choice(["a", "b", "c"]), rng.randrange(2), at(), at(), at()) for _ in range(n)]
    return rows + [("hot", 0, 7.6, 7.6, 7.6)] * 400 + [("none", 0, 99.0, 1.0, 1.0), ("none", 0, None, 5.0, 5.0), ("none", 0, float("nan"), 5.0, 5.0), (None, 1, 9.0, 9.0, 9.0), ("null", None, 9.25, 9.0, 9.0)]


def plain(rows, side, kernel):
    """Dense grids of whole molecules."""
    out = {}
    for m, c, *at in rows:
        if any(v is None or v != v for v in at) or not all(1 <= v < side - 2 for v in at):
            continue
        grid = out.setdefault((m, c), np.zeros((side, side, side)))
        lo = [int(np.rint(v)) for v in at]
        for i in range(-1, 2):
            for j in range(-1, 2):
                for k in range(-1, 2):
                    p = (lo[0] + i, lo[1] + j, lo[2] + k)
                    w = np.prod([max(0.0, 1 - abs(a - b)) for a, b in zip(p, at, strict=True)])
                    if w > 0:
                        grid[p] += w
    if kernel:
        for key, grid in out.items():
            blurred = np.zeros_like(grid)
            for x, y, z in np.argwhere(grid):
                for a, b, c, w in kernel:
                    if all(0 <= v < side for v in (x + a, y + b, z + c)):
                        blurred[x + a, y + b, z + c] += grid[x, y, z] * w
            out[key] = blurred
    return {(*key, *map(int, p)): grid[tuple(p)] for key, grid in out.items() for p in np.argwhere(grid)}


def of(rows):
    return {(r.mol_id, r.channel, r.ix, r.iy, r.iz): r.v for r in rows.collect()}


@pytest.mark.parametrize("side, kernel", [(20, None), (20, V.gaussian_kernel(0.5, 1.5, 1.0)), (19, V.gaussian_kernel())])
def test_bricks_are_the_plain_grid(spark, monkeypatch, side, kernel):
    rows = drawn(300 if len(kernel or ()) < 100 else 40)
    frame = spark.createDataFrame(rows, POINTS).selectExpr("*", "1 as bx", "2 as v")
    want = plain(rows, side, kernel)
    made = B.bricks(frame, side, kernel=kernel)
    got = of(B.voxels(made))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    half = {}
    for (m, c, x, y, z), v in want.items():
        half[m, c, x // 2, y // 2, z // 2] = half.get((m, c, x // 2, y // 2, z // 2), 0) + v / 8
    got = of(B.half_voxels(made))
    assert got.keys() == half.keys() and all(got[k] == pytest.approx(half[k], rel=1e-9) for k in half)
    # Few cells and rows at a time change nothing: bricks that go over batches' bounds stay whole.
    monkeypatch.setattr(B, "TOGETHER", 3 * 20**3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = of(B.voxels(B.bricks(frame, side, kernel=kernel)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again.keys() == want.keys() and all(again[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert B.voxels(B.bricks(frame.limit(0), side, kernel=kernel)).count() == 0


def test_one_exchange(spark):
    frame = spark.createDataFrame(drawn(5), POINTS)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    kernel = V.gaussian_kernel()
    assert plan(B.half_voxels(B.bricks(frame, kernel=kernel))) == 1
    assert plan(V.half_resolution(V.density(V.soft_encoded(frame), kernel))) == 3


def test_rows_and_bricks_agree(spark):
    frame = spark.createDataFrame(drawn(), POINTS).where("x is not null and not isnan(x)")
    one, two = of(V.soft_encoded(frame, 20)), of(B.voxels(B.bricks(frame, 20)))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    assert B.bricks(frame, 20).agg(F.max(F.length("cells"))).head()[0] <= 8 * B.CELLS
