"""Queries of score tables."""

from pyspark.sql import functions as F

from ..operators import scores as S
from ..operators.quantiles import exact_quantiles
from . import jobs
from .registry import query, rounded, view

_TOP = """
WITH ok AS (SELECT * FROM v_scores WHERE dock_success),
q AS (SELECT pdb_id, quantile_cont(affinity, 0.75) AS threshold FROM ok WHERE model = 'initial' GROUP BY pdb_id),
g AS (SELECT *, CASE WHEN regexp_matches(model, '_opt[0-9]+$') THEN CAST(regexp_extract(model, '_opt([0-9]+)$', 1) AS INT) ELSE 0 END AS optnum FROM ok),
l AS (SELECT g.* FROM g WHERE optnum = (SELECT max(optnum) FROM g)),
s AS (SELECT l.*, threshold FROM l JOIN q ON l.pdb_id = q.pdb_id WHERE affinity < threshold),
r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY affinity NULLS LAST, mol_idx) AS pick FROM s)
"""


def selection(spark, d, n=5, q=0.75):
    return jobs.selection([view(spark, d, "v_scores")], q, n)


@query(_TOP + "SELECT pdb_id, mol_idx, optnum, R6[[affinity]] AS affinity, R6[[threshold]] AS threshold, pick FROM r WHERE pick <= 5")
def df3_core_selection(spark, d):
    return rounded(selection(spark, d).select("pdb_id", "mol_idx", F.col("optnum").cast("int").alias("optnum"), "affinity", "threshold", F.col("pick").cast("long").alias("pick")), "affinity", "threshold")


@query("""
SELECT s.event_id AS mol_idx, s.file, s.affinity, e.user_id AS num_atoms, o.o_totalprice AS energy_final, coalesce(o.o_custkey % 2 = 0, false) AS ffopt_success
FROM v_scores s JOIN events e ON s.event_id = e.event_id JOIN orders o ON s.event_id = o.o_orderkey""")
def j1_joined_tables(spark, d):
    scores = view(spark, d, "v_scores").select("mol_idx", "file", "affinity", F.lit(-1).alias("num_atoms"))
    stats = view(spark, d, "events").select(F.col("event_id").alias("mol_idx"), F.concat(F.lit("f"), F.col("user_id") % 50).alias("file"), F.col("user_id").alias("num_atoms"))
    ff = view(spark, d, "orders").select(F.col("o_orderkey").alias("mol_idx"), F.col("o_totalprice").alias("energy_final"), (F.col("o_custkey") % 2 == 0).alias("ffopt_success"))
    ff = ff.join(scores.select("mol_idx", "file"), "mol_idx")
    return S.joined_tables(scores, stats, ff)


@query("""
WITH f AS (SELECT concat('p', CAST(s_suppkey % 17 AS VARCHAR)) AS pdb_id, s_nationkey % 3 AS dir_rank, CASE s_suppkey % 2 WHEN 0 THEN 'protein' ELSE 'pocket' END AS kind, s_name AS path FROM supplier),
b AS (SELECT pdb_id, path FROM (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY dir_rank, CASE kind WHEN 'pocket' THEN 0 ELSE 1 END, path) AS rn FROM f) t WHERE rn = 1)
SELECT s.pdb_id, mol_idx, path, CASE WHEN path IS NULL THEN 'no receptor' END AS warning FROM v_scores s LEFT JOIN b ON s.pdb_id = b.pdb_id""")
def j2_receptors(spark, d):
    files = view(spark, d, "supplier").selectExpr("concat('p', s_suppkey % 17) as pdb_id", "s_nationkey % 3 as dir_rank", "if(s_suppkey % 2 = 0, 'protein', 'pocket') as kind", "s_name as path")
    return S.receptors(view(spark, d, "v_scores").select("pdb_id", "mol_idx"), files)


@query("""
WITH m AS (SELECT file, max(mol_idx) AS n FROM v_scores WHERE mol_idx < 4000 GROUP BY file)
SELECT s.file, mol_idx FROM v_scores s LEFT JOIN m ON s.file = m.file WHERE mol_idx >= coalesce(n, 0) AND s.file NOT IN ('f1', 'f2')""")
def j3_resume(spark, d):
    scores = view(spark, d, "v_scores").select("file", "mol_idx")
    left = S.unfinished(scores, scores.where("file in ('f1', 'f2')"))
    return S.resumed(left, scores.where("mol_idx < 4000").groupBy("file").agg(F.max("mol_idx").alias("n")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j4_listed(spark, d):
    names = view(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.listed(view(spark, d, "orders"), names, "o_custkey").select("o_orderkey")


@query("WITH q AS (SELECT pdb_id, quantile_cont(affinity, 0.1) AS t FROM v_scores WHERE model = 'initial' GROUP BY pdb_id) SELECT s.pdb_id, mol_idx FROM v_scores s JOIN q ON s.pdb_id = q.pdb_id WHERE affinity < t")
def j9_threshold_join(spark, d):
    scores = view(spark, d, "v_scores")
    return S.better_than_threshold(scores, S.quantiles(scores, 0.1)).select("pdb_id", "mol_idx")


@query("SELECT pdb_id, R6[[quantile_cont(affinity, 0.25)]] AS threshold FROM v_scores WHERE model = 'initial' GROUP BY pdb_id")
def a9_quantiles(spark, d):
    return rounded(S.quantiles(view(spark, d, "v_scores"), 0.25, at_once=0), "threshold")


@query("""
SELECT source, R6[[quantile_cont(x, 0.0)]] AS least, R6[[quantile_cont(x, 0.1)]] AS tenth, R6[[quantile_cont(x, 0.5)]] AS middle, R6[[quantile_cont(x, 0.999)]] AS far, R6[[quantile_cont(x, 1.0)]] AS most
FROM (SELECT source, (n_chars % 5000) / 7.0::DOUBLE - 300 AS x FROM documents) t GROUP BY source""")
def a9_quantiles_of_sources(spark, d):
    """Several quantiles at once, of groups of which one may hold a third of all rows."""
    rows = view(spark, d, "documents").select("source", (F.col("n_chars") % 5000 / 7.0 - 300).alias("x"))
    got = exact_quantiles(rows, [0, 0.1, 0.5, 0.999, 1], "x", "source", at_once=0)
    return rounded(got.select("source", *(F.col("quantiles")[i].alias(c) for i, c in enumerate(("least", "tenth", "middle", "far", "most")))), "least", "tenth", "middle", "far", "most")


@query("SELECT mol_idx, 3 AS optnum FROM v_scores WHERE model = 'run_opt3'")
def a10_latest_generation(spark, d):
    return S.latest_generation(view(spark, d, "v_scores")).select("mol_idx", "optnum")


@query("""
WITH t AS (SELECT l_orderkey AS mol_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS try,
                  l_extendedprice AS energy, l_returnflag <> 'N' AS success, l_returnflag || CAST(l_suppkey % 3 AS VARCHAR) AS reason FROM lineitem)
SELECT mol_idx, arg_min(energy, (energy, try)) FILTER (WHERE success) AS energy, arg_min(try, (energy, try)) FILTER (WHERE success) AS try, bool_or(success) AS success,
       CASE WHEN NOT bool_or(success) THEN arg_max(reason, try) END AS reason FROM t GROUP BY mol_idx""")
def a11_best_attempt(spark, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    tries = view(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("mol_idx"), F.row_number().over(order).cast("long").alias("try"), F.col("l_extendedprice").alias("energy"), (F.col("l_returnflag") != "N").alias("success"),
        F.concat("l_returnflag", F.col("l_suppkey") % 3).alias("reason"),
    )
    return S.best_attempt(tries)


@query("SELECT dock_reason, count(*) AS n_failed, R6[[100.0 * count(*) / (SELECT count(*) FROM v_scores)]] AS percent FROM v_scores WHERE NOT dock_success GROUP BY dock_reason")
def a12_failures(spark, d):
    return rounded(S.failures(view(spark, d, "v_scores")), "percent")


def clustered(spark, d):
    return view(spark, d, "v_scores").withColumn("cluster", F.col("mol_idx") * 7 % 5)


@query("SELECT model, pdb_id, mol_idx * 7 % 5 AS cluster, count(*) AS n FROM v_scores GROUP BY ALL")
def a21_cluster_sizes(spark, d):
    return S.cluster_sizes(clustered(spark, d))


@query("SELECT mol_idx, mol_idx * 7 % 5 AS cluster, row_number() OVER (PARTITION BY model, pdb_id, mol_idx * 7 % 5 ORDER BY affinity NULLS LAST, mol_idx) - 1 AS cluster_idx FROM v_scores")
def w1_cluster_ranks(spark, d):
    return S.cluster_ranks(clustered(spark, d), "affinity").select("mol_idx", "cluster", F.col("cluster_idx").cast("long").alias("cluster_idx"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY model, pdb_id, mol_idx * 7 % 5 ORDER BY affinity NULLS LAST, mol_idx) AS k FROM v_scores),
p AS (SELECT *, row_number() OVER (PARTITION BY model, pdb_id ORDER BY k, affinity NULLS LAST, mol_idx) AS pick FROM r)
SELECT model, pdb_id, mol_idx, pick FROM p WHERE pick <= 12""")
def w2_diverse_topn(spark, d):
    return S.diverse_top(clustered(spark, d), 12, "affinity").select("model", "pdb_id", "mol_idx", F.col("pick").cast("long").alias("pick"))


@query("SELECT pdb_id, mol_idx, pick FROM (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY affinity DESC NULLS LAST, mol_idx) AS pick FROM v_scores) t WHERE pick <= 4")
def w3_topn(spark, d):
    return S.top(view(spark, d, "v_scores"), 4, "affinity", increase=True).select("pdb_id", "mol_idx", F.col("pick").cast("long").alias("pick"))


@query("SELECT file, n, CAST(sum(n) OVER (ORDER BY file ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first FROM (SELECT file, count(*) AS n FROM v_scores GROUP BY file) t")
def w5_running_offsets(spark, d):
    return S.running_offsets(view(spark, d, "v_scores").groupBy("file").agg(F.count(F.lit(1)).alias("n")))


@query(_TOP + "SELECT pdb_id, mol_idx, concat(pdb_id, '_mol_best_', CAST(pick - 1 AS VARCHAR)) AS name FROM r WHERE pick <= 5")
def w7_output_names(spark, d):
    return S.output_names(selection(spark, d)).select("pdb_id", "mol_idx", "name")


@query("SELECT mol_idx, row_number() OVER (ORDER BY affinity DESC NULLS LAST, mol_idx) AS place FROM v_scores")
def o7_global_order(spark, d):
    return S.global_order(view(spark, d, "v_scores").select("mol_idx", "affinity"), S.ordered("affinity", True), F.col("mol_idx").asc()).select("mol_idx", "place")


@query("""
SELECT m.file, m.mol_idx, CASE WHEN coalesce(s.dock_success, false) THEN s.affinity END AS affinity, coalesce(s.dock_success, false) AS dock_success,
       CASE WHEN NOT coalesce(s.dock_success, false) THEN coalesce(s.dock_reason, 'NOT_DOCKED') END AS dock_reason
FROM (SELECT file, mol_idx FROM v_scores) m LEFT JOIN (SELECT * FROM v_scores WHERE mol_idx % 10 <> 0) s ON m.file = s.file AND m.mol_idx = s.mol_idx""")
def p15_status_rows(spark, d):
    scores = view(spark, d, "v_scores")
    return S.status_rows(scores, scores.where("mol_idx % 10 <> 0").select("file", "mol_idx", "affinity", "dock_success", "dock_reason"), ["affinity"])
