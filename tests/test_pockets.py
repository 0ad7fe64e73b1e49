"""The registered pocket query against a plain loop over every complex of a small table."""

import math
import random

from molmill.plans.queries import QUERIES


def test_every_complex_has_its_pocket(spark, tmp_path):
    r = random.Random(11)
    mols = [m for k in range(60) for m in (970 * k, 970 * k + 1, 970 * k + 52, 970 * k + 97 * 6, 970 * k + 969)]
    lines = [(m, n, r.randrange(1, 99), r.randrange(1, 99), r.uniform(1, 50), r.uniform(0, 0.1), r.uniform(0, 0.08), r.choice("ANR")) for m in mols for n in range(3)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    table = spark.createDataFrame(lines, columns).selectExpr("*", "l_quantity AS l_extendedprice", "DATE'2020-01-01' AS l_shipdate", "'O' AS l_linestatus")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    atoms = [(m, n, chain, (q / 5 * 5, d * 100 * 5, t * 100 * 5)) for m, n, _, _, q, d, t, chain in lines]
    ligands = [(m // 970, p) for m, _, _, p in atoms if m % 97 == 0]
    near = {(m, chain) for m, _, chain, p in atoms if any(k == m // 970 and math.dist(p, q) <= 8 for k, q in ligands)}
    want = {(m, n) for m, n, chain, _ in atoms if (m, chain) in near}
    got = [tuple(x) for x in QUERIES["j5_pocket_residues"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {m // 970 for m, _ in got} == set(range(60)) and len(want) < len(atoms)
