"""Butina clusters of large groups and copies against a plain loop; groups of complex rows."""

import random

import pytest
from pyspark.sql import functions as F

from molmill.operators import similarity as L
from molmill.operators.scores import diverse_top
from molmill.plans.queries import QUERIES

R = random.Random(5)
WORDS = {m: [R.getrandbits(14)] for m in range(150)}
WORDS |= {m: WORDS[R.randrange(150)] for m in range(150, 220)} | {m: [0] for m in range(220, 224)}


def plain(mols, cutoff):
    alike = lambda a, b: (a | b) and (a & b).bit_count() / (a | b).bit_count() >= 1 - cutoff - 1e-12
    near = {i: {j for j in mols if j != i and alike(WORDS[i][0], WORDS[j][0])} for i in mols}
    out, number = {}, 0
    while left := [i for i in mols if i not in out]:
        leader = max(left, key=lambda i: (len(near[i] - out.keys()), i))
        out.update(dict.fromkeys({leader} | near[leader] - out.keys(), number))
        number += 1
    return out


@pytest.mark.parametrize(("at_once", "cutoff"), [(0, 0.4), (1500, 0.6), (500_000, 0.6)])
def test_butina_in_rounds(spark, at_once, cutoff):
    """Nine in ten molecules are in one group, a third are copies; rounds of joins and one task agree with the sequential loop."""
    group = {m: None if m % 37 == 36 else int(m % 10 == 9) for m in WORDS}
    fps = spark.createDataFrame([(m, group[m], w) for m, w in WORDS.items()], "mol_id long, grp long, words array<long>")
    got = L.butina(fps, cutoff, at_once=at_once).collect()
    assert len(got) == len(WORDS)
    for g in (0, 1):
        assert {x.mol_id: x.cluster for x in got if x.grp == g} == plain([m for m in WORDS if group[m] == g], cutoff)
    assert sorted(x.mol_id for x in got if x.grp is None) == [m for m in WORDS if group[m] is None]


def test_butina_refuses_no_size(spark):
    """200,100 copies of a fingerprint are one cluster, without links."""
    fps = spark.range(200_100).select(F.col("id").alias("mol_id"), F.lit("x").alias("grp"), F.array(F.lit(7).cast("long")).alias("words"))
    assert [tuple(x) for x in L.butina(fps).groupBy("cluster").count().collect()] == [(0, 200_100)]


def test_complex_rows_do_not_grow(spark):
    """Ten times the table makes more rows of complexes, not larger ones."""
    small, large = ([x["count"] for x in QUERIES["k3_complex_rows"](spark, f"/root/testdata/{sf}").groupBy("pdb_id").count().collect()] for sf in ("sf0.001", "sf0.01"))
    assert len(large) > 5 * len(small) and max(large) < 2 * max(small)


@pytest.mark.parametrize("cutoff", [0.4, 0.6, 1.0])
def test_dense_groups_make_no_links(spark, cutoff, monkeypatch):
    """With every group counted as dense, the clusters are the sequential loop's, and no pair of fingerprints becomes a row."""
    group = {m: None if m % 37 == 36 else int(m % 10 == 9) for m in WORDS}
    fps = spark.createDataFrame([(m, group[m], w) for m, w in WORDS.items()], "mol_id long, grp long, words array<long>")
    written = {}
    kept = L.scratch
    monkeypatch.setattr(L, "scratch", lambda df, name: written.setdefault(name, []).append(kept(df, name)) or written[name][-1])
    got = L.butina(fps, cutoff, at_once=0, dense=0).collect()
    for g in (0, 1):
        assert {x.mol_id: x.cluster for x in got if x.grp == g} == plain([m for m in WORDS if group[m] == g], cutoff)
    assert sorted(x.mol_id for x in got if x.grp is None) == [m for m in WORDS if group[m] is None]
    assert all(x.isEmpty() for x in written["links"])


def test_diverse_selection_of_dense_groups(spark):
    """The best of each cluster are the same with and without links."""
    fps = spark.createDataFrame([(m, m % 3, w) for m, w in WORDS.items()], "mol_id long, grp long, words array<long>")
    pick = lambda rows: sorted(map(tuple, diverse_top(rows.withColumn("affinity", -(F.col("mol_id") * 37 % 101).cast("double")), 5, "affinity", by=("grp",), tie="mol_id").select("grp", "mol_id", "cluster").collect()))
    got, want = pick(L.butina(fps, 0.6, at_once=0, dense=0)), pick(L.butina(fps, 0.6))
    assert got == want and len(got) == 15
