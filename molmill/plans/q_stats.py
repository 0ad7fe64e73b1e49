"""Queries of counts and per-molecule properties."""

from pyspark.sql import functions as F

from ..functions.expr import feature_types
from ..functions.vocab import CHANNELS, LIBRARY_ELEMENTS, WEIGHT, channel_table
from ..operators import stats as S
from .registry import query, rounded, view

_TYPES = lambda: feature_types(F.col("atomic_num"), F.col("is_hbd"), F.col("is_hba"), F.col("is_aromatic"), F.col("charge"))
_MASS = "CASE atomic_num " + " ".join(f"WHEN {n} THEN {w}" for n, w in WEIGHT.items()) + " END"


@query("SELECT file, count(*) AS n FROM v_scores GROUP BY ROLLUP (file)")
def a1_counts_by_file(spark, d):
    return S.counts_by_file(view(spark, d, "v_scores"))


@query("""
SELECT count(*) AS files, CAST(coalesce(sum(floor(n * 0.3)), 0) AS BIGINT) AS remaining
FROM (SELECT file, count(*) AS n FROM v_scores GROUP BY file) t WHERE file NOT LIKE 'f1%'""")
def a1_remaining(spark, d):
    scores = view(spark, d, "v_scores")
    return S.remaining(S.counts_by_file(scores), scores.where("file like 'f1%'"), 0.3)


@query("SELECT file, count(*) AS n, count(*) FILTER (WHERE dock_success) AS valid, count(*) FILTER (WHERE dock_success AND U[[s, event_id]] < 0.2) AS sampled FROM v_scores GROUP BY ROLLUP (file)")
def a2_processed_valid_sampled(spark, d):
    from ..functions.expr import uniform

    rows = view(spark, d, "v_scores").withColumn("u", uniform("s", F.col("event_id")))
    return S.counts_by_file(rows, ("valid", "dock_success"), ("sampled", "dock_success and u < 0.2"))


@query("""
SELECT mol_id, R6[[avg(x)]] AS cx, R6[[avg(y)]] AS cy, R6[[avg(z)]] AS cz, R6[[(max(x) + min(x)) / 2]] AS mx, R6[[(max(y) + min(y)) / 2]] AS my, R6[[(max(z) + min(z)) / 2]] AS mz
FROM v_atoms GROUP BY mol_id""")
def a3_centres(spark, d):
    return rounded(S.centres(view(spark, d, "v_atoms")), "cx", "cy", "cz", "mx", "my", "mz")


@query("SELECT mol_id, atom_idx, R6[[x - avg(x) OVER m + 12]] AS x, R6[[y - avg(y) OVER m + 12]] AS y, R6[[z - avg(z) OVER m + 12]] AS z FROM v_atoms WINDOW m AS (PARTITION BY mol_id)")
def a4_recentred(spark, d):
    return rounded(S.recentred(view(spark, d, "v_atoms"), (12.0, 12.0, 12.0)).select("mol_id", "atom_idx", "x", "y", "z"), "x", "y", "z")


@query("""
WITH c AS (SELECT mol_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v_atoms WHERE record = 'HETATM' GROUP BY mol_id)
SELECT a.mol_id, atom_idx, R6[[x - coalesce(cx, 0)]] AS x, R6[[y - coalesce(cy, 0)]] AS y, R6[[z - coalesce(cz, 0)]] AS z FROM v_atoms a LEFT JOIN c ON a.mol_id = c.mol_id""")
def a4_recentred_by_ligand(spark, d):
    atoms = view(spark, d, "v_atoms")
    return rounded(S.recentred_by(atoms, atoms.where("record = 'HETATM'")).select("mol_id", "atom_idx", "x", "y", "z"), "x", "y", "z")


@query("SELECT mol_id, " + ", ".join(f"count(*) FILTER (WHERE atomic_num = {n}) AS e{n}" for n in LIBRARY_ELEMENTS) + " FROM v_atoms GROUP BY mol_id")
def a5_element_counts(spark, d):
    return S.element_counts(view(spark, d, "v_atoms"))


@query(f"""
WITH e AS (SELECT mol_id, i AS a, j AS b FROM v_bonds UNION ALL SELECT mol_id, j, i FROM v_bonds),
h AS (
  SELECT e.mol_id, count(*) AS hbd FROM e JOIN v_atoms p ON e.mol_id = p.mol_id AND e.a = p.atom_idx AND p.atomic_num IN (7, 8)
  JOIN v_atoms q ON e.mol_id = q.mol_id AND e.b = q.atom_idx AND q.atomic_num = 1 GROUP BY e.mol_id),
s AS (
  SELECT mol_id, count(*) FILTER (WHERE atomic_num <> 1) AS num_atoms, count(*) FILTER (WHERE atomic_num NOT IN (1, 6)) AS num_het_atoms, R6[[sum({_MASS})]] AS mw,
         count(*) FILTER (WHERE atomic_num IN (7, 8)) AS hba_lipinski FROM v_atoms GROUP BY mol_id)
SELECT s.*, coalesce(hbd, 0) AS hbd_lipinski FROM s LEFT JOIN h ON s.mol_id = h.mol_id""")
def a6_composition(spark, d):
    return rounded(S.composition(view(spark, d, "v_atoms"), view(spark, d, "v_bonds")), "mw")


@query("""
SELECT a.mol_id, R6[[max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)))]] AS mol_width
FROM v_atoms a JOIN v_atoms b ON a.mol_id = b.mol_id GROUP BY a.mol_id""")
def a7_width(spark, d):
    return rounded(S.width(view(spark, d, "v_atoms")), "mol_width")


@query()
def a8_shape_ratios(spark, d):
    return rounded(S.shape_ratios(view(spark, d, "v_atoms")), "npr1", "npr2")


@query("""
SELECT max(n) AS natoms_max, CAST(max(t) AS BIGINT) AS types_max
FROM (SELECT mol_id, count(*) AS n, max(2 + is_hbd::INT + is_hba::INT + is_aromatic::INT) AS t FROM v_atoms GROUP BY mol_id) s""")
def a13_true_widths(spark, d):
    from ..functions.expr import padded

    atoms = view(spark, d, "v_atoms").withColumn("types", padded(_TYPES(), 10, F.lit(-1)))
    packed = atoms.groupBy("mol_id").agg(F.collect_list("types").alias("t")).select("mol_id", padded(F.col("t"), 80, F.array_repeat(F.lit(-1), 10)).alias("atom_types"))
    return S.true_widths(packed).select(*(F.col(c).cast("long").alias(c) for c in ("natoms_max", "types_max")))


@query("""
SELECT mol_id, ch, count(*) AS n FROM (
  SELECT mol_id, atom_idx, unnest(list_filter([CASE WHEN atomic_num = 6 THEN 0 WHEN atomic_num = 7 THEN 1 WHEN atomic_num = 8 THEN 2 WHEN atomic_num IN (9, 17, 35, 53) THEN 3 WHEN atomic_num IN (15, 16) THEN 4 END,
    CASE WHEN is_hbd THEN 5 END, CASE WHEN is_hba THEN 6 END, CASE WHEN is_aromatic THEN 7 END, CASE WHEN charge <> 0 THEN 8 END], lambda v: v IS NOT NULL)) AS ch FROM v_atoms) t GROUP BY mol_id, ch""")
def a17_atoms_per_channel(spark, d):
    return S.atoms_per_channel(view(spark, d, "v_atoms").withColumn("types", _TYPES()), channel_table(spark, CHANNELS))


@query("""
WITH p AS (
  SELECT a.mol_id, sum(greatest(2.5 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 0) ** 2) AS s
  FROM v_atoms a JOIN v_atoms b ON a.mol_id = b.mol_id AND a.atom_idx < b.atom_idx GROUP BY a.mol_id)
SELECT m.mol_id, R6[[coalesce(s, 0)]] AS penalty FROM (SELECT DISTINCT mol_id FROM v_atoms) m LEFT JOIN p ON m.mol_id = p.mol_id""")
def a24_contact_penalty(spark, d):
    return rounded(S.contact_penalty(view(spark, d, "v_atoms"), 2.5), "penalty")
