"""Queries of histograms, samples and mixtures."""

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators.filters import MolFilter
from ..operators.scores import unfinished
from .registry import query, rounded, view

EDGES = {"num_atoms": [8, 12, 16, 20, 28, 36, 44, 50], "mol_width": [3, 6, 9, 12, 15, 18, 21, 24, 27], "alogp": [-2, -1, 0, 1, 2, 3, 4, 5, 6, 7]}


def _bin(c, e):
    return f"CASE WHEN {c} > {e[0]} AND {c} <= {e[-1]} THEN len(list_filter({e}::DOUBLE[], lambda v: v < {c})) - 1 END"


_HIST = "WITH b AS (SELECT *, " + ", ".join(f"{_bin(c, e)} AS b{i}" for i, (c, e) in enumerate(EDGES.items(), 1)) + " FROM v_stats), h AS (SELECT b1, b2, b3, count(*) AS n FROM b WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL GROUP BY ALL) "
_FILTER = MolFilter(natoms_min=16, natoms_max=30, width_max=20, logp_min=-1, logp_max=5)


@query("SELECT mol_idx, " + _bin("mol_width", EDGES["mol_width"]) + " AS bin FROM v_stats")
def f9_bin_index(spark, d):
    from ..functions.expr import bin_index

    return view(spark, d, "v_stats").select("mol_idx", bin_index(F.col("mol_width"), EDGES["mol_width"]).cast("long").alias("bin"))


def _hist(spark, d):
    return S.histogram(view(spark, d, "v_stats"), EDGES)


def _long(df):
    return df.withColumns({b: F.col(b).cast("long") for b in ("b1", "b2", "b3")})


@query(_HIST + "SELECT * FROM h")
def a14_histogram(spark, d):
    return _long(_hist(spark, d))


@query(_HIST + "SELECT b1 - 2 AS b1, b2, b3 - 1 AS b3, n FROM h WHERE b1 BETWEEN 2 AND 4 AND b2 BETWEEN 0 AND 5 AND b3 BETWEEN 1 AND 7")
def a15_trimmed_histogram(spark, d):
    return _long(S.trimmed_histogram(_hist(spark, d), EDGES, _FILTER))


@query(_HIST + "SELECT R6[[sum(n) * (2000.0::DOUBLE / 15000) / count(*)]] AS n_per_bin FROM h")
def a16_sample_per_bin(spark, d):
    return rounded(S.sample_per_bin(_hist(spark, d), 2000, 15000), "n_per_bin")


@query(_HIST + "SELECT b1, b2, b3, n, R6[[1.0 / n]] AS p FROM h")
def a16_bin_probabilities(spark, d):
    return rounded(_long(S.bin_probabilities(_hist(spark, d))), "p")


@query(_HIST + """, p AS (SELECT sum(n) * (2000.0::DOUBLE / 15000) / count(*) AS per FROM h)
SELECT file, mol_idx FROM b JOIN h USING (b1, b2, b3), p WHERE U[[strata, mol_idx]] < per / n""")
def o6_stratified_sample(spark, d):
    return S.stratified(view(spark, d, "v_stats"), EDGES, 2000, 15000, "strata", F.col("mol_idx")).select("file", "mol_idx")


@query("SELECT mol_id, atom_idx, row_number() OVER (PARTITION BY mol_id ORDER BY x, y, z, atom_idx) - 1 AS place FROM v_atoms")
def o1_coordinate_sort(spark, d):
    sorted_ = view(spark, d, "v_atoms").groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("x", "y", "z", "atom_idx"))).alias("a"))
    return sorted_.select("mol_id", F.posexplode("a").alias("place", "a")).select("mol_id", "a.atom_idx", F.col("place").cast("long").alias("place"))


@query("""
WITH f AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS nth FROM (SELECT DISTINCT file FROM v_scores) t)
SELECT file, nth, ntile(4) OVER (ORDER BY file) AS batch FROM f WHERE nth >= 5 AND nth < 40""")
def o2_file_batches(spark, d):
    got = S.batches(view(spark, d, "v_scores").select("file").distinct(), 5, 40, 4)
    return got.select("file", F.col("nth").cast("long").alias("nth"), F.col("batch").cast("long").alias("batch"))


@query("SELECT mol_id, atom_idx FROM v_atoms WHERE atom_idx >= 2 AND atom_idx < 5")
def o3_read_range(spark, d):
    return S.read_range(view(spark, d, "v_atoms").withColumnRenamed("atom_idx", "mol_idx"), 2, 3).select("mol_id", F.col("mol_idx").alias("atom_idx"))


@query("""
WITH c AS (SELECT o_custkey % 7 AS f, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT o_custkey % 7 AS f, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS mol_idx FROM orders)
SELECT f AS file, mol_idx FROM m JOIN c USING (f) WHERE mol_idx % greatest(CAST(floor(n / greatest(floor(n * 0.03), 1)) AS BIGINT), 1) = 0""")
def o4_every_nth(spark, d):
    from pyspark.sql.window import Window

    file = F.col("o_custkey") % 7
    mols = view(spark, d, "orders").select(file.alias("file"), (F.row_number().over(Window.partitionBy(file).orderBy("o_orderkey")) - 1).cast("long").alias("mol_idx"))
    return S.every_nth(mols, mols.groupBy("file").agg(F.count(F.lit(1)).alias("n")), 0.03).select("file", "mol_idx")


@query("SELECT mol_idx FROM v_scores WHERE U[[keep, mol_idx]] < 0.15")
def o5_bernoulli(spark, d):
    return S.bernoulli(view(spark, d, "v_scores"), 0.15, "keep", F.col("mol_idx")).select("mol_idx")


@query("""
WITH n AS (SELECT count(*) AS n FROM part), r AS (SELECT i AS draw, CAST(floor(U[[draw, i]] * n) AS BIGINT) AS idx FROM n, (SELECT unnest(range((SELECT n FROM n))) AS i) t)
SELECT draw, idx, p_name FROM r JOIN part ON idx = p_partkey""")
def o9_with_replacement(spark, d):
    part = view(spark, d, "part")
    n = part.count()
    return S.with_replacement(part.select(F.col("p_partkey").alias("idx"), "p_name"), n, n, "draw").select("draw", "idx", "p_name")


@query("SELECT DISTINCT file FROM v_scores")
def u3_distinct_directories(spark, d):
    return view(spark, d, "v_scores").select("file").distinct()


@query("SELECT DISTINCT file FROM v_stats WHERE file NOT IN ('lib1', 'lib3') ORDER BY file")
def u4_not_in_manifest(spark, d):
    files = view(spark, d, "v_stats").select("file").distinct()
    return unfinished(files, spark.createDataFrame([("lib1",), ("lib3",), ("gone",)], "file string"))


@query("""
WITH n AS (SELECT CAST(floor(0.75 * (SELECT count(*) FROM customer)) AS BIGINT) AS n, (SELECT count(*) FROM part) AS m),
w AS (SELECT p_partkey AS idx, p_name AS name, (((p_partkey - 2 * n) % m) + m) % m AS place, n FROM part, n)
SELECT idx, name, place, 'library' AS origin FROM w WHERE place < n UNION ALL SELECT c_custkey, c_name, NULL, 'complex' FROM customer""")
def u7_mixture(spark, d):
    complexes = view(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"))
    library = view(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"))
    alpha = S.alpha_at(epoch=2, start=0.25, rate=0.25, low=0.0, high=1.0)
    return S.mixture(complexes, library, alpha, 2, complexes.count(), library.count()).select("idx", "name", "place", "origin")


@query("""
WITH v AS (SELECT c_custkey AS i, c_nationkey % 4 AS visits FROM customer), n AS (SELECT count(*) AS n FROM v),
e AS (SELECT (i + j * n) % 100 AS i FROM (SELECT i, n, unnest(range(visits)) AS j FROM v, n) t)
SELECT r.i, count(e.i) AS visits FROM (SELECT unnest(range(100)) AS i) r LEFT JOIN e ON r.i = e.i GROUP BY r.i""")
def u8_rebucketed_visits(spark, d):
    visits = view(spark, d, "customer").selectExpr("c_custkey AS i", "c_nationkey % 4 AS visits")
    return S.rebucketed_visits(visits, visits.count(), 100)


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '_3' WHEN 1 THEN '_1_2' ELSE '_5_1-4' END AS tag FROM orders")
def f15_compact_tag(spark, d):
    lists = F.when(F.col("o_custkey") % 3 == 0, F.array(*map(F.lit, [0.3, 0.3, 0.3]))).when(F.col("o_custkey") % 3 == 1, F.array(*map(F.lit, [0.1, 0.2]))).otherwise(F.array(*map(F.lit, [0.5, 0.5, 0.1, 0.4])))
    return view(spark, d, "orders").select("o_orderkey", S.compact_tag(lists, 2, 2).alias("tag"))


@query("SELECT o_orderkey, c AS cycle, CASE c WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.7 ELSE 0.9 END AS temp, 20 AS n FROM orders, (SELECT unnest(range(3)) AS c) t WHERE o_orderkey % 3 = c")
def f16_per_cycle(spark, d):
    cycles = S.per_cycle(spark, "temp", [0.5, 0.7, 0.9], 3).join(S.per_cycle(spark, "n", 20, 3), "cycle")
    return view(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("cycle")).join(F.broadcast(cycles), "cycle").select("o_orderkey", F.col("cycle").cast("long").alias("cycle"), "temp", "n")


