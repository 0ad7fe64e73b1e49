"""Queries of whole workloads, unions, extension points and incremental jobs."""

import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import vocab
from ..operators import scores
from ..operators.aggregates import aggregated
from ..operators.filters import MolFilter, preset
from ..operators.voxels import union_in_order
from ..sources import parse as P
from ..sources import readers as R
from ..sources import writers as W
from ..storage import fresh_dir
from ..streaming import ingest as T
from ..streaming.blocks import text_blocks
from . import jobs
from .q_sampling import EDGES, _bin
from .q_text import _CELLS, blocks, cells, packed
from .registry import query, r6, rounded, view


@query("""
WITH m AS (
  SELECT mol_id, count(*) FILTER (WHERE atomic_num <> 1) AS heavy, max(abs(x)) > 0 AND max(abs(y)) > 0 AND max(abs(z)) > 0 AS is_3d, bool_and(atomic_num IN (1, 6, 7, 8, 9, 15, 16, 17, 35, 53)) AS ok FROM v_atoms GROUP BY mol_id),
w AS (SELECT a.mol_id, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS width FROM v_atoms a JOIN v_atoms b ON a.mol_id = b.mol_id GROUP BY a.mol_id),
h AS (SELECT mol_id, avg(x) AS cx FROM v_atoms WHERE atomic_num <> 1 GROUP BY mol_id)
SELECT concat('ZINC', CAST(m.mol_id AS VARCHAR)) AS name, heavy AS n, round(s, 3) AS spread FROM m JOIN w ON m.mol_id = w.mol_id
JOIN (SELECT a.mol_id, sum(abs(x - cx)) AS s FROM v_atoms a JOIN h ON a.mol_id = h.mol_id WHERE atomic_num <> 1 GROUP BY a.mol_id) t ON t.mol_id = m.mol_id
WHERE heavy BETWEEN 3 AND 8 AND width <= 9.05 AND is_3d AND ok""")
def df1_library_build(spark, d):
    keep = MolFilter(natoms_min=3, width_max=9.05, check_3d=True, atomic_nums=(6, 7, 8, 9, 15, 16, 17, 35, 53))
    mols = blocks(spark, d).withColumn("name", P.molecule_name(F.col("block")))
    got = jobs.library_build(mols, keep, natoms_max=8)
    spread = F.aggregate("atom_coords", F.lit(0.0), lambda s, c: s + F.abs(c[0]).cast("double"))
    return got.select("name", F.size("atom_types").cast("long").alias("n"), F.round(spread, 3).alias("spread"))


@query("WITH b AS (SELECT *, " + ", ".join(f"{_bin(c, e)} AS b{i}" for i, (c, e) in enumerate(EDGES.items(), 1)) + """ FROM v_stats WHERE mw BETWEEN 200 AND 500 AND rotb <= 10),
h AS (SELECT b1, b2, b3, count(*) AS n FROM b WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL GROUP BY ALL), p AS (SELECT sum(n) * (1500.0::DOUBLE / 15000) / count(*) AS per FROM h)
SELECT file, mol_idx FROM b JOIN h USING (b1, b2, b3), p WHERE U[[df2, mol_idx]] < per / n""")
def df2_library_sample(spark, d):
    return jobs.library_sample(view(spark, d, "v_stats"), MolFilter(weight_min=200, weight_max=500, rotb_max=10), EDGES, 1500, 15000, "df2", F.col("mol_idx")).select("file", "mol_idx")


@query("""
WITH l AS (SELECT mol_id % 50 AS pdb_id, x, y, z FROM v_atoms WHERE mol_id % 97 = 0 AND atomic_num <> 1), c AS (SELECT pdb_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM l GROUP BY pdb_id),
r AS (SELECT mol_id % 50 AS pdb_id, x, y, z FROM v_atoms WHERE mol_id % 97 <> 0 AND atomic_num <> 1),
b AS (SELECT pdb_id, x, y, z, 'ligand' AS part FROM l UNION ALL SELECT r.pdb_id, x, y, z, 'receptor' FROM r JOIN c ON r.pdb_id = c.pdb_id WHERE sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) < 4)
SELECT b.pdb_id, part, count(*) AS n, round(sum(x - cx), 4) AS sx, round(sum(abs(y - cy)), 4) AS sy FROM b JOIN c ON b.pdb_id = c.pdb_id GROUP BY ALL""")
def df4_complexes(spark, d):
    a = view(spark, d, "v_atoms").withColumn("pdb_id", F.col("mol_id") % 50)
    got = jobs.complexes(a.where("mol_id % 97 = 0"), a.where("mol_id % 97 <> 0"), 4.0)
    return got.groupBy("pdb_id", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum(F.abs("y")), 4).alias("sy"))


@query("SELECT c_custkey, c_name, true AS refined FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, c_name, false FROM customer WHERE c_acctbal <= 5000")
def u1_dataset_union(spark, d):
    c = view(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 5000).alias("refined"))
    refined = c.where("refined")
    return refined.unionByName(c.join(refined, "c_custkey", "left_anti"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS acctbal, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def u2_concat_differing_columns(spark, d):
    s = view(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS acctbal")
    c = view(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT s.event_id AS mol_idx, e.value AS affinity, s.pdb_id FROM v_scores s JOIN events e ON s.event_id = e.event_id")
def u5_overlapping_columns(spark, d):
    left = view(spark, d, "v_scores").select("mol_idx", "affinity", "pdb_id")
    right = view(spark, d, "events").select(F.col("event_id").alias("mol_idx"), F.col("value").alias("affinity"))
    return scores.joined_tables(left, right, keys=("mol_idx",))


@query("SELECT o_orderkey, CASE o_custkey % 2 WHEN 0 THEN 'e6,e7,HBD,e8' ELSE 'e7,e6,HBD' END AS channels, CASE o_custkey % 2 WHEN 0 THEN 3 ELSE 3 END AS place FROM orders")
def u6_union_in_order(spark, d):
    a = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("e6"), F.lit("e7"))).otherwise(F.array(F.lit("e7"), F.lit("e6")))
    b = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("e7"), F.lit("HBD"), F.lit("e8"))).otherwise(F.array(F.lit("HBD"), F.lit("e7")))
    u = union_in_order(a, b)
    return view(spark, d, "orders").select("o_orderkey", F.array_join(u, ",").alias("channels"), F.array_position(u, "HBD").cast("int").alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM orders WHERE o_custkey % 10 <> 9")
def o8_split_membership(spark, d):
    o = view(spark, d, "orders")
    lists = {"validation": o.where("o_custkey % 5 = 0"), "train": o.where("o_custkey % 5 <> 0 and o_custkey % 10 <> 9")}
    some = [scores.listed(o, names.select("o_custkey"), "o_custkey").select("o_orderkey", F.lit(k).alias("split")) for k, names in lists.items()]
    return some[0].unionByName(some[1])


@query(_CELLS + "SELECT name, nth, types, x, y, z FROM c WHERE mol_id % 3 = 0 AND n <= 40")
def s9_packed_with_index(spark, d):
    """Written as a packed table, read again, and restricted to the names of an index."""
    at = fresh_dir(spark, "packed")
    packed(spark, d, natoms_max=40, pad=False).write.parquet(at)
    index = view(spark, d, "v_atoms").where("mol_id % 3 = 0").select(F.col("mol_id").cast("string").alias("name"))
    return cells(R.read_packed(spark, at, index), "name")


@query("SELECT trim(p_name) AS name FROM part WHERE p_partkey % 7 <> 0")
def s10_names(spark, d):
    text = view(spark, d, "part").select(F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("value"))
    return text.select(F.trim("value").alias("name")).where("name <> ''")


@query("""
WITH b AS (SELECT pdb_id, mol_idx, row_number() OVER (PARTITION BY pdb_id ORDER BY affinity NULLS LAST, mol_idx) AS pick FROM v_scores)
SELECT b.pdb_id, s_name AS recpath, concat('next/', b.pdb_id, '/', b.pdb_id, '_mol_best_', CAST(pick - 1 AS VARCHAR), '.sdf') AS molpath FROM b JOIN supplier ON b.pdb_id = concat('p', CAST(s_suppkey AS VARCHAR)) WHERE pick <= 3""")
def k7_next_inputs(spark, d):
    best = scores.output_names(scores.top(view(spark, d, "v_scores"), 3, "affinity"))
    receptors = view(spark, d, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("pdb_id"), F.col("s_name").alias("path"))
    return W.next_inputs(best, receptors, "next")


@query("""
SELECT mol_id // 10 AS file, string_agg(concat('MODEL ', CAST(nth AS VARCHAR), chr(10), CASE WHEN mol_id % 4 = 0 THEN 'ATOM      1  C   UNK A   1       0.000   0.000   0.000  1.00  0.00     0.000 C' ELSE concat('ATOM ', CAST(mol_id AS VARCHAR)) END, chr(10), 'ENDMDL', chr(10)), '' ORDER BY mol_id) AS text
FROM (SELECT mol_id, row_number() OVER (PARTITION BY mol_id // 10 ORDER BY mol_id) AS nth FROM (SELECT DISTINCT mol_id FROM v_atoms) m) t GROUP BY 1""")
def k9_model_texts(spark, d):
    rows = view(spark, d, "v_atoms").select("mol_id").distinct()
    block = F.when(F.col("mol_id") % 4 != 0, F.concat(F.lit("ATOM "), "mol_id"))
    return W.model_texts(rows.select(F.floor(F.col("mol_id") / 10).alias("file"), F.col("mol_id").alias("mol_idx"), block.alias("block")))


@query("""
WITH a AS (SELECT *, CAST(floor(mol_id / 100) AS BIGINT) AS pdb_id FROM v_atoms),
r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id, record ORDER BY mol_id, atom_idx) - 1 AS nth, count(*) FILTER (WHERE record = 'ATOM') OVER (PARTITION BY pdb_id) AS p, count(*) FILTER (WHERE record = 'HETATM') OVER (PARTITION BY pdb_id) AS l FROM a)
SELECT pdb_id, CASE record WHEN 'ATOM' THEN 'prot' ELSE 'lig' END AS side, nth, atomic_num AS type, R6[[CAST(CAST(x AS FLOAT) AS DOUBLE)]] AS x, R6[[CAST(CAST(y AS FLOAT) AS DOUBLE)]] AS y, R6[[CAST(CAST(z AS FLOAT) AS DOUBLE)]] AS z
FROM r WHERE p > 0 AND l > 0""")
def k3_complex_rows(spark, d):
    a = view(spark, d, "v_atoms").withColumn("pdb_id", F.floor(F.col("mol_id") / 100))  # a hundred molecules a complex, however large the table
    place = F.sort_array(F.collect_list(F.struct("mol_id", "atom_idx", F.array(*(F.col(c).cast("float") for c in "xyz")).alias("p"), F.array(F.col("atomic_num").cast("smallint")).alias("t"))))
    half = lambda w: a.where(w).groupBy("pdb_id").agg(place.alias("a")).select("pdb_id", F.col("a.p").alias("coords"), F.col("a.t").alias("types"))
    lig, prot = (W.write_bucketed(half(f"record = '{r}'"), "pdb_id") for r in ("HETATM", "ATOM"))
    rows = W.complex_rows(lig, prot)
    at = fresh_dir(spark, "complexes")
    W.write_complexes(rows, at)
    rows = spark.read.parquet(at)
    each = [rows.select("pdb_id", F.lit(n).alias("side"), F.posexplode(F.arrays_zip(F.col(f"{n}_coords").alias("c"), F.col(f"{n}_types").alias("t"))).alias("nth", "a")) for n in ("lig", "prot")]
    got = each[0].unionByName(each[1]).where(~F.isnan(F.col("a.c")[0]))
    return got.select("pdb_id", "side", F.col("nth").cast("long").alias("nth"), F.col("a.t")[0].cast("long").alias("type"), *(r6(F.col("a.c")[i].cast("double")).alias(c) for i, c in enumerate("xyz")))


@query("SELECT CAST(mol_id % 7 AS INT) AS file, mol_id AS id FROM (SELECT DISTINCT mol_id FROM v_atoms) t")
def k8_blocks_by_file(spark, d):
    at = fresh_dir(spark)
    W.write_blocks_by_file(view(spark, d, "v_atoms").select("mol_id").distinct().select((F.col("mol_id") % 7).alias("file"), F.concat(F.lit("block "), "mol_id").alias("block")), at)
    return spark.read.text(at, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), "file=([0-9]+)", 1).cast("int").alias("file"), F.substring_index("value", " ", -1).cast("long").alias("id"))


@query("SELECT mol_id, atom_idx, atomic_num AS num, 118 + atomic_num AS bto, CASE atomic_num WHEN 6 THEN 'C' WHEN 7 THEN 'N' WHEN 8 THEN 'O' WHEN 1 THEN 'H' WHEN 16 THEN 'S' WHEN 17 THEN 'Cl' WHEN 9 THEN 'F' WHEN 15 THEN 'P' WHEN 35 THEN 'Br' END AS symbol FROM v_atoms")
def f4_vocabulary(spark, d):
    name = F.concat(F.lit("e"), "atomic_num")
    return view(spark, d, "v_atoms").select("mol_id", "atom_idx", E.type_number(name).alias("num"), E.type_number(F.concat(F.lit("bto"), "atomic_num")).alias("bto"), E.symbol_of(F.col("atomic_num")).alias("symbol"))


@query("SELECT mol_id, i, j, CASE bond_order WHEN 1.0 THEN 'bond1' WHEN 2.0 THEN 'bond2' ELSE 'bondar' END AS bond FROM v_bonds")
def f4_bond_types(spark, d):
    return view(spark, d, "v_bonds").select("mol_id", "i", "j", E.bond_type(F.col("bond_order")).alias("bond"))


@query("SELECT mol_idx, floor((10 - sa) / 9 * 100 + 0.5) / 100 AS sa FROM v_stats")
def f11_rescaled_sa(spark, d):
    return view(spark, d, "v_stats").select("mol_idx", E.rescaled_sa(F.col("sa")).alias("sa"))


# What a user can ask for by name; a cell that cannot be had is null.
PROPERTIES = {
    "num_atoms": lambda: F.col("num_atoms"), "half_width": lambda: F.col("mol_width") / 2, "sa": lambda: E.rescaled_sa(F.col("sa")), "logp_root": lambda: F.when(F.col("alogp") >= 0, F.sqrt("alogp")),
    "per_hba": lambda: F.try_divide("mw", "hba"), "code": lambda: F.regexp_extract("murcko", "([0-9]+)", 1).try_cast("int"),
}


def properties(mols, keys=None, exclude=(), more=None):
    """mol_idx and the properties chosen from the register, with a user's own in more."""
    known = PROPERTIES | (more or {})
    chosen = [k for k in (keys or known) if k not in exclude]
    if unknown := set(chosen) - known.keys():
        raise ValueError(f"no such property: {sorted(unknown)}")
    return mols.select("mol_idx", *(known[k]().alias(k) for k in chosen))


@query("SELECT mol_idx, R6[[mol_width / 2]] AS half_width, CASE WHEN alogp >= 0 THEN R6[[sqrt(alogp)]] END AS logp_root, CASE WHEN hba <> 0 THEN R6[[mw / hba]] END AS per_hba, TRY_CAST(regexp_extract(murcko, '([0-9]+)', 1) AS INT) AS code, hba + hbd AS polar FROM v_stats")
def x1_property_registry(spark, d):
    got = properties(view(spark, d, "v_stats"), exclude=("num_atoms", "sa"), more={"polar": lambda: F.col("hba") + F.col("hbd")})
    return rounded(got, "half_width", "logp_root", "per_hba")


@query("SELECT atomic_num, CASE WHEN atomic_num IN (9, 17, 35) THEN 900 END AS num, count(*) AS n FROM v_atoms GROUP BY ALL")
def x2_custom_vocabulary(spark, d):
    own = vocab.type_vocab(spark, {"halogen": (900, "own")}).where("grp = 'own'").select("num")
    halogens = F.col("atomic_num").isin(9, 17, 35)
    named = view(spark, d, "v_atoms").join(F.broadcast(own), halogens, "left")
    return named.groupBy("atomic_num", "num").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT mol_idx FROM v_stats WHERE mw BETWEEN 300 AND 500 AND num_atoms <= 50 AND hbd <= 3 AND hba <= 5 AND rotb <= 12 AND alogp BETWEEN -1 AND 5")
def x3_custom_thresholds(spark, d):
    f = preset("drug_like", weight_min=300, hbd_max=3, atomic_nums=None)
    return f.keep(view(spark, d, "v_stats")).select("mol_idx")


@query("SELECT page_id, generate_subscripts(p, 1) - 1 AS mol_idx, unnest(p) AS block FROM (SELECT page_id, list_filter(string_split(html, '</p>'), lambda b: contains(b, '<p>')) AS p FROM pages) t")
def x4_custom_delimiter(spark, d):
    got = R.split_blocks(view(spark, d, "pages").select("page_id", F.col("html").alias("text")), "</p>", "page_id", keep=lambda b: F.contains(b, F.lit("<p>")))
    return got.withColumn("mol_idx", F.col("mol_idx").cast("long"))


@query("SELECT pdb_id, count(*) AS n, R6[[max(affinity) - min(affinity)]] AS span FROM v_scores GROUP BY pdb_id")
def x5_grouped_apply(spark, d):
    class Span:
        """How many values, the least and the greatest; missing ones count, but have no part in the span."""

        def start(self):
            return 0, None, None

        def add(self, state, rows):
            found = pc.min_max(rows["affinity"])
            return self.merge(state, (len(rows), found["min"].as_py(), found["max"].as_py()))

        def merge(self, a, b):
            some = lambda f, x: f(v for v in x if v is not None) if any(v is not None for v in x) else None
            return a[0] + b[0], some(min, (a[1], b[1])), some(max, (a[2], b[2]))

        def finish(self, state):
            return state[0], None if state[1] is None else state[2] - state[1]

    return rounded(aggregated(view(spark, d, "v_scores").select("pdb_id", "affinity"), ["pdb_id"], Span(), "n long, span double"), "span")


@query("SELECT concat('ZINC', CAST(mol_id AS VARCHAR)) AS name, count(*) FILTER (WHERE atomic_num <> 1) AS num_atoms FROM v_atoms GROUP BY mol_id HAVING count(*) FILTER (WHERE atomic_num <> 1) BETWEEN 4 AND 10")
def t1_incremental_ingest(spark, d):
    """Blocks are written as SDF files in two parts; each run takes up only blocks that the ones before it have not, and the first stops in the middle of a file."""
    at = fresh_dir(spark)
    mols = blocks(spark, d).withColumnRenamed("mol_id", "mol_idx")
    keep = lambda df: MolFilter(natoms_min=4, natoms_max=10).keep(jobs.molecule_rows(named(df))).select("name", "num_atoms")
    named = lambda df: df.select(F.trim(F.get(P.lines(F.col("block")), 0)).alias("name"), "block")
    stream = lambda most: T.ingest_blocks(text_blocks(spark, f"{at}/in", f"{at}/bookmark", ends=".txt", max_bytes=most, split_bytes=1 << 22), keep, f"{at}/out", f"{at}/state", once=most < 1 << 20)
    W.write_sdf(mols.where(F.col("mol_idx") % 2 == 0), f"{at}/in", append=True)
    stream(10_000).awaitTermination()
    W.write_sdf(mols.where(F.col("mol_idx") % 2 == 1), f"{at}/in", append=True)
    T.drain(stream(1 << 24))
    return spark.read.parquet(f"{at}/out").select("name", F.col("num_atoms").cast("long").alias("num_atoms"))


@query("SELECT file, count(*) AS processed, count(*) FILTER (WHERE dock_success) AS valid, count(*) FILTER (WHERE dock_success AND affinity < -50) AS sampled FROM v_scores GROUP BY file")
def t2_running_totals(spark, d):
    at = fresh_dir(spark)
    rows = view(spark, d, "v_scores").select("file", "dock_success", "affinity")
    for part in (0, 1):
        rows.where(F.pmod(F.xxhash64("file", "affinity"), F.lit(2)) == part).write.mode("append").parquet(f"{at}/in")
        T.running_totals(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/state", "dock_success", "affinity < -50").awaitTermination()
    return T.latest_totals(spark, f"{at}/out")


_TAKEN = "SELECT pdb_id, mol_idx, affinity FROM (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY affinity NULLS LAST, mol_idx) AS pick FROM {}) t WHERE pick <= 4"


@query(f"""
WITH r AS (SELECT concat('p', CAST(s_suppkey AS VARCHAR)) AS pdb_id FROM supplier),
g0 AS (SELECT s.pdb_id, mol_idx, affinity FROM v_scores s JOIN r ON s.pdb_id = r.pdb_id WHERE model = 'run_opt3'),
c1 AS ({_TAKEN.format('g0')}), g1 AS (SELECT pdb_id, mol_idx * 10 + k AS mol_idx, affinity - 0.5 * k AS affinity FROM c1, (SELECT unnest([1, 2]) AS k) x),
c2 AS ({_TAKEN.format('g1')}), g2 AS (SELECT pdb_id, mol_idx * 10 + k AS mol_idx, affinity - 0.5 * k AS affinity FROM c2, (SELECT unnest([1, 2]) AS k) x),
c3 AS ({_TAKEN.format('g2')})
SELECT 1 AS cycle, pdb_id, mol_idx, R6[[affinity]] AS affinity FROM c1 UNION ALL SELECT 2, pdb_id, mol_idx, R6[[affinity]] FROM c2 UNION ALL SELECT 3, pdb_id, mol_idx, R6[[affinity]] FROM c3""")
def t3_generation_cycles(spark, d):
    """Each cycle's results are two children of every molecule that the cycle before chose, better by a half and by one."""
    at = fresh_dir(spark)
    receptors = view(spark, d, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("pdb_id"), F.replace("s_name", F.lit("#"), F.lit("")).alias("path"))
    first = scores.latest_generation(view(spark, d, "v_scores").join(receptors.select("pdb_id"), "pdb_id", "left_semi"))
    chosen = lambda cycle: spark.read.parquet(f"{at}/chosen_{cycle}")

    def results(cycle):
        if cycle == 0:
            return first.select("pdb_id", "mol_idx", "affinity", "model")
        child = F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
        rows = chosen(cycle).select("pdb_id", "mol_idx", "affinity", child)
        return rows.select("pdb_id", (F.col("mol_idx") * 10 + F.col("k")).alias("mol_idx"), (F.col("affinity") - 0.5 * F.col("k")).alias("affinity"), F.concat(F.lit("run_opt"), F.lit(3 + cycle)).alias("model"))

    def select(rows, cycle):
        taken = scores.top(rows, 4, "affinity")
        taken.select("pdb_id", "mol_idx", "affinity").write.mode("overwrite").parquet(f"{at}/chosen_{cycle + 1}")
        return scores.output_names(taken)

    T.generations(results, select, receptors, at, 2)
    written = T.generations(results, select, receptors, at, 3)
    assert [w.rsplit("_", 1)[1] for w in written] == ["3"]  # the first two were there
    every = [chosen(c).select(F.lit(c).alias("cycle"), "pdb_id", "mol_idx", r6("affinity").alias("affinity")) for c in (1, 2, 3)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("SELECT conv_id, turn, generate_subscripts(p, 1) - 1 AS nth, unnest(p) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations) t")
def x6_block_to_rows(spark, d):
    each = view(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return each.withColumn("nth", F.col("nth").cast("long"))
