"""Quantiles by counting against percentile and numpy."""

import math
import random

import numpy as np
import pytest
from molmill.operators.quantiles import exact_quantiles
from pyspark.sql import functions as F

QS = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]


def drawn():
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1e-3)) for _ in range(2000)] + [("tied", rng.choice([1.5, 1.5, 1.5, -2.0])) for _ in range(600)] + [("one", -7.25)] + [("two", 3.0), ("two", -3.0)]
    rows += [("wide", s * 10.0**e) for e in range(-300, 300, 7) for s in (1, -1)] + [("near", float(np.nextafter(1.0, 2)) if i % 2 else 1.0) for i in range(7)] + [("zero", x) for x in (0.0, -0.0, 0.0, -1.0)]
    rows += [("inf", x) for x in (math.inf, 1.0, 2.0, -math.inf, 5.0)] + [("miss", None), ("miss", math.nan), ("some", None), ("some", math.nan), ("some", 4.0), (None, 1.0), (None, 2.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("at_once", [0, 100, 10**9])
def test_quantiles_are_those_of_percentile(spark, at_once):
    frame = spark.createDataFrame(drawn(), "g string, v double").selectExpr("*", "1 as n", "2 as grp")
    got = {r.g: r.quantiles for r in exact_quantiles(frame, QS, "v", "g", at_once).collect()}
    want = {r.g: r.p for r in frame.groupBy("g").agg(F.percentile(F.when(~F.isnan("v"), F.col("v") + 0.0), F.lit(QS)).alias("p")).collect()}
    same = lambda a, b: a is b or (a is not None and b is not None and all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True)))
    assert got.keys() == want.keys() and all(same(got[g], want[g]) for g in want), [(g, got[g], want[g]) for g in want if not same(got[g], want[g])]
    values = [v for g, v in drawn() if g == "hot"]
    assert np.allclose(got["hot"], np.quantile(values, QS), rtol=1e-12, atol=0)
    assert exact_quantiles(frame.limit(0), [0.5], "v", "g", at_once).count() == 0


def test_quantile_bounds(spark):
    for qs in ([], [1.1], [-0.1]):
        with pytest.raises(ValueError):
            exact_quantiles(spark.range(1).selectExpr("id as g", "1.0 as v"), qs, "v", "g")

