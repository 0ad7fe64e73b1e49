"""A user's own aggregate over hot groups, and tables in buckets."""

import math
import random

import pandas as pd
import pyarrow.compute as pc
from molmill.operators.aggregates import aggregated
from molmill.sources import writers as W


def moments():
    class Moments:
        """Count, mean and spread of v, and the different words."""

        def start(self):
            return 0, 0.0, 0.0, set()

        def add(self, state, rows):
            v = [x for x in rows["v"].to_pylist() if x is not None]
            return self.merge(state, (len(v), sum(v), sum(x * x for x in v), set(pc.unique(rows["w"]).to_pylist()) - {None}))

        def merge(self, a, b):
            return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] | b[3]

        def finish(self, s):
            return s[0], s[1] / s[0] if s[0] else None, sorted(s[3])

    return Moments()


def test_own_aggregate_equals_pandas(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.randrange(2), rng.choice([None, rng.random()]), rng.choice(["x", "y", None])) for _ in range(3000)] + [("solo", 1, None, None)]
    frame = spark.createDataFrame(rows, "g string, h int, v double, w string").selectExpr("*", "1 as state", "2 as share").repartition(9)
    pdf = pd.DataFrame(rows, columns=["g", "h", "v", "w"])
    want = {(None if g != g else g, h): (int(x.v.count()), x.v.mean(), sorted(set(x.w.dropna()))) for (g, h), x in pdf.groupby(["g", "h"], dropna=False)}
    for held in (1, 10_000):
        got = {(r.g, r.h): (r.n, r.mean, r.words) for r in aggregated(frame, ["g", "h"], moments(), "n long, mean double, words array<string>", shares=4, held=held).collect()}
        assert got.keys() == want.keys()
        for k, (n, mean, words) in want.items():
            assert got[k][0] == n and got[k][2] == words and (math.isclose(got[k][1], mean) if n else got[k][1] is None)
    assert aggregated(frame.limit(0), ["g"], moments(), "n long, mean double, words array<string>").count() == 0


def test_bucketed_halves_join_without_an_exchange(spark):
    half = lambda n: spark.range(n).selectExpr("id AS pdb_id", "array(array(cast(id AS float))) AS coords", "array(array(cast(1 AS smallint))) AS types")
    lig, prot = W.write_bucketed(half(50), "pdb_id", 8), W.write_bucketed(half(40), "pdb_id", 8)
    both = W.complex_rows(lig, prot)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(r.pdb_id for r in both.collect()) == list(range(40)) and both.columns == ["pdb_id", "lig_coords", "lig_types", "prot_coords", "prot_types"]
