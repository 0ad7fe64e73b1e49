"""Queries of the filters."""

from math import sqrt

from pyspark.sql import functions as F

from ..functions.expr import feature_types
from ..functions.vocab import CHANNELS, channel_table
from ..operators import filters as O
from ..operators.patterns import pattern_hits
from .registry import query, view


@query("SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY atom_idx) - 1 AS atom_idx, atomic_num, x, y, z FROM v_atoms WHERE atomic_num <> 1")
def q1_drop_hydrogens(spark, d):
    return O.drop_hydrogens(view(spark, d, "v_atoms")).select("mol_id", F.col("atom_idx").cast("long").alias("atom_idx"), "atomic_num", "x", "y", "z")


@query("SELECT mol_id, atom_idx, res_name FROM v_atoms WHERE record = 'ATOM'")
def q2_drop_hetero(spark, d):
    return O.clean_receptor(view(spark, d, "v_atoms"), remove_hetero=True).select("mol_id", "atom_idx", "res_name")


@query("SELECT mol_id, atom_idx, record FROM v_atoms WHERE res_name <> 'HOH'")
def q3_drop_waters(spark, d):
    return O.clean_receptor(view(spark, d, "v_atoms")).select("mol_id", "atom_idx", "record")


@query("SELECT mol_idx FROM v_stats WHERE num_atoms BETWEEN 10 AND 40 AND mol_width <= 20 AND mw BETWEEN 200 AND 500 AND alogp BETWEEN -1 AND 5 AND hba <= 10 AND hbd >= 1 AND rotb <= 12")
def q4_property_ranges(spark, d):
    f = O.MolFilter(natoms_min=10, natoms_max=40, width_max=20, weight_min=200, weight_max=500, logp_min=-1, logp_max=5, hba_max=10, hbd_min=1, rotb_max=12)
    return f.keep(view(spark, d, "v_stats")).select("mol_idx")


@query("SELECT mol_id, bool_and(atomic_num IN (1, 6, 7, 8, 9)) AS allowed FROM v_atoms GROUP BY mol_id")
def q5_allowed_elements(spark, d):
    return O.molecules_of_elements(view(spark, d, "v_atoms"), (6, 7, 8, 9))


@query("SELECT mol_id, max(abs(x)) > 0 AND max(abs(y)) > 0 AND max(abs(z)) > 0 AS is_3d FROM v_atoms GROUP BY mol_id")
def q6_real_3d(spark, d):
    return O.is_3d(view(spark, d, "v_atoms"))


@query("SELECT mol_idx FROM v_stats WHERE ring_sizes IN ('', '5', '6', '5,6')")
def q7_ring_sizes(spark, d):
    sizes = F.expr("if(ring_sizes = '', array(), transform(split(ring_sizes, ','), s -> int(s)))")
    return O.MolFilter(ring_sizes=(5, 6)).keep(view(spark, d, "v_stats").withColumn("ring_sizes", sizes)).select("mol_idx")


@query("""
SELECT DISTINCT mol_id FROM v_atoms WHERE mol_id NOT IN (
  SELECT mol_id FROM (SELECT mol_id, i AS a FROM v_bonds WHERE bond_order = 2 UNION ALL SELECT mol_id, j FROM v_bonds WHERE bond_order = 2) t GROUP BY mol_id, a HAVING count(*) > 1)""")
def q9_double_bond_pairs(spark, d):
    return O.double_bond_limit(view(spark, d, "v_bonds"), view(spark, d, "v_atoms").select("mol_id").distinct())


@query("SELECT mol_idx, coalesce(mw BETWEEN 200 AND 500 AND mol_width <= 20 AND alogp <= 5 AND num_atoms >= 12 AND ring_sizes NOT IN ('3,6', '6,6,7'), false) AS pass FROM v_stats")
def q10_composite_flag(spark, d):
    sizes = F.expr("if(ring_sizes = '', array(), transform(split(ring_sizes, ','), s -> int(s)))")
    f = O.MolFilter(weight_min=200, weight_max=500, width_max=20, logp_max=5, natoms_min=12, ring_sizes=(5, 6))
    return f.check(view(spark, d, "v_stats").withColumn("ring_sizes", sizes)).select("mol_idx", "pass")


@query("""
SELECT mol_idx, 'drug_like' AS preset FROM v_stats WHERE mw BETWEEN 200 AND 500 AND num_atoms <= 50 AND hbd <= 10 AND hba <= 5 AND rotb <= 12 AND alogp BETWEEN -1 AND 5
UNION ALL SELECT mol_idx, 'default' FROM v_stats WHERE mw BETWEEN 200 AND 500 AND num_atoms <= 50 AND hbd <= 10 AND hba <= 5 AND rotb <= 12 AND alogp BETWEEN -1 AND 5 AND mol_width <= 20
UNION ALL SELECT mol_idx, 'library' FROM v_stats WHERE mw BETWEEN 200 AND 500 AND mol_width <= 20 AND alogp <= 5""")
def q11_presets(spark, d):
    mols = view(spark, d, "v_stats").withColumns({"atomic_nums": F.array(F.lit(6), F.lit(1)), "is_3d": F.lit(True)})
    some = [O.preset(p).keep(mols).select("mol_idx", F.lit(p).alias("preset")) for p in ("drug_like", "default", "library")]
    return some[0].unionByName(some[1]).unionByName(some[2])


_CATALOG = "SELECT p_partkey AS ord, concat('reg', CAST(p_partkey AS VARCHAR)) AS reg_id, concat(CAST(p_partkey % 90 + 10 AS VARCHAR), '7') AS pattern FROM part"


@query(f"""
WITH every AS ({_CATALOG}), cat AS (SELECT min(ord) AS ord, arg_min(reg_id, ord) AS reg_id, pattern FROM every GROUP BY pattern)
SELECT o_orderkey, arg_min(reg_id, ord) AS reg_id FROM orders JOIN cat ON contains(CAST(o_totalprice AS VARCHAR), pattern) GROUP BY o_orderkey""")
def q12_pattern_first_hit(spark, d):
    cat = view(spark, d, "part").selectExpr("p_partkey AS ord", "concat('reg', p_partkey) AS reg_id", "concat(p_partkey % 90 + 10, '7') AS pattern")
    rows = view(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("text"))
    return pattern_hits(rows, cat, "o_orderkey", "text", block_bytes=100)  # blocks so small that the test catalog makes several


@query("""
SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages JOIN (SELECT unnest(['***', '&amp;', 'idiot']) AS pattern) c ON contains(html, pattern))""")
def q12_pattern_screen(spark, d):
    rows = view(spark, d, "pages").select("page_id", "html")
    cat = spark.createDataFrame([(0, "a", "***"), (1, "b", "&amp;"), (2, "c", "idiot")], "ord int, reg_id string, pattern string")
    return O.without_hits(rows.select("page_id"), pattern_hits(rows, cat, "page_id", "html"), "page_id")


@query("""
SELECT pdb_id FROM (SELECT concat('p', CAST(o_custkey AS VARCHAR), '_', CAST(o_orderkey % 3 AS VARCHAR)) AS pdb_id, o_orderstatus AS kind FROM orders) t GROUP BY pdb_id
HAVING count(*) FILTER (WHERE kind = 'F') = 1 AND count(*) FILTER (WHERE kind = 'O') = 1 AND count(*) FILTER (WHERE kind = 'P') = 1""")
def q13_complete_records(spark, d):
    files = view(spark, d, "orders").select(F.concat(F.lit("p"), "o_custkey", F.lit("_"), F.col("o_orderkey") % 3).alias("pdb_id"), F.col("o_orderstatus").alias("kind"))
    return O.complete_records(files, ("F", "O", "P"))


@query("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%red%' AND p_name NOT LIKE '%ring%' AND p_type IN (SELECT p_type FROM part WHERE p_partkey < 3)")
def q14_excluded_names(spark, d):
    part = view(spark, d, "part")
    allow = part.where("p_partkey < 3").select(F.col("p_type").alias("name"))
    return O.excluded_names(O.excluded_names(part, "p_name", ("red", "ring")), "p_type", ("\0",), allow).select("p_partkey")


@query("""
WITH c AS (SELECT mol_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v_atoms GROUP BY mol_id)
SELECT a.mol_id, a.atom_idx FROM v_atoms a JOIN c ON a.mol_id = c.mol_id WHERE sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) < 4.5""")
def q15_radius_cut(spark, d):
    atoms = view(spark, d, "v_atoms")
    assert abs(sqrt(2) * (24 / 2 + 5) - 24.04) < 0.01  # the radius that a training set of 24 Å grids takes; the stand-in is smaller
    return O.within_radius(atoms, O.centres(atoms), "mol_id", 4.5).select("mol_id", "atom_idx")


@query("""
SELECT file, count(*) FILTER (WHERE file LIKE '%1%') AS n_ref, count(*) FILTER (WHERE file LIKE '%2%') AS n_gen FROM v_scores WHERE dock_success GROUP BY file HAVING file LIKE '%1%' OR file LIKE '%2%'""")
def q16_success_ref_gen(spark, d):
    rows = view(spark, d, "v_scores").where("dock_success").withColumn("name", F.concat("file", F.when(F.contains("file", F.lit("1")), "_ref").otherwise(""), F.when(F.contains("file", F.lit("2")), "_gen").otherwise("")))
    ref, gen = O.reference_and_generated(rows, "name")
    count = lambda df, n: df.groupBy("file").agg(F.count(F.lit(1)).alias(n))
    return count(ref, "n_ref").join(count(gen, "n_gen"), "file", "full").select("file", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_ref", "n_gen")))


@query("""
SELECT mol_id, n_heavy, n_heavy >= 2 AS dock_success, CASE WHEN n_heavy < 2 THEN 'MOL_NONE' END AS dock_reason
FROM (SELECT mol_id, count(*) FILTER (WHERE atomic_num <> 1) AS n_heavy FROM v_atoms GROUP BY mol_id) t""")
def q17_size_gate(spark, d):
    return O.size_gate(view(spark, d, "v_atoms").groupBy("mol_id").agg(F.count_if(F.col("atomic_num") != 1).alias("n_heavy")))


@query("SELECT mol_id, atom_idx, x >= 1 AND x < 8 AND y >= 1 AND y < 8 AND z >= 1 AND z < 8 AS in_bounds FROM v_atoms")
def q18_in_bounds(spark, d):
    return O.bounds_flag(view(spark, d, "v_atoms"), pad=1, side=10).select("mol_id", "atom_idx", "in_bounds")


@query("SELECT mol_id, atom_idx, x >= 1 AND x < 8 AND y >= 1 AND y < 8 AND z >= 1 AND z < 8 AND (atomic_num = 6 OR is_hbd) AS valid FROM v_atoms")
def q19_valid_encoding(spark, d):
    types = feature_types(F.col("atomic_num"), F.col("is_hbd"), F.col("is_hba"), F.col("is_aromatic"), F.col("charge"))
    atoms = view(spark, d, "v_atoms").withColumn("types", types)
    return O.valid_encoding(atoms, channel_table(spark, [CHANNELS[0], ["HBD"]]), side=10).select("mol_id", "atom_idx", "valid")


