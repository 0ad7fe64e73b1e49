"""Queries of readers, parsers and writers, over texts made of the tables."""

from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources import parse as P
from ..sources import readers as R
from ..sources import writers as W
from ..storage import fresh_dir
from .registry import query, rounded, view

_SYMBOL = "CASE atomic_num WHEN 1 THEN 'H' WHEN 6 THEN 'C' WHEN 7 THEN 'N' WHEN 8 THEN 'O' WHEN 9 THEN 'F' WHEN 15 THEN 'P' WHEN 16 THEN 'S' WHEN 17 THEN 'Cl' WHEN 35 THEN 'Br' END"
_BLOCKS = f"""
WITH a AS (SELECT mol_id, count(*) AS n, string_agg(printf('%10.4f%10.4f%10.4f %-3s 0  0', x, y, z, {_SYMBOL}), chr(10) ORDER BY atom_idx) AS t FROM v_atoms GROUP BY mol_id),
b AS (SELECT mol_id, count(*) AS n, string_agg(printf('%3d%3d%3d  0', i + 1, j + 1, CASE bond_order WHEN 1.5 THEN 4 ELSE bond_order::INT END), chr(10) ORDER BY i, j) AS t FROM v_bonds GROUP BY mol_id),
k AS (
  SELECT a.mol_id, concat('ZINC', CAST(a.mol_id AS VARCHAR), chr(10), '  table          3D', chr(10), chr(10), printf('%3d%3d  0  0  0  0  0  0  0  0999 V2000', a.n, coalesce(b.n, 0)), chr(10), a.t, chr(10),
                          CASE WHEN b.t IS NULL THEN '' ELSE concat(b.t, chr(10)) END, 'M  END', chr(10)) AS block
  FROM a LEFT JOIN b ON a.mol_id = b.mol_id) """


def blocks(spark, d):
    return W.sdf_blocks(view(spark, d, "v_atoms"), view(spark, d, "v_bonds"), F.concat(F.lit("ZINC"), "mol_id"))


def texts(spark, d):
    """Ten molecules a file."""
    rows = blocks(spark, d).withColumn("file", F.floor(F.col("mol_id") / 10))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mol_id", "block"))), lambda s: F.concat(s["block"], F.lit("$$$$\n"))), "").alias("text"))


@query(_BLOCKS + "SELECT mol_id // 10 AS file, row_number() OVER (PARTITION BY mol_id // 10 ORDER BY mol_id) - 1 AS mol_idx, concat('ZINC', CAST(mol_id AS VARCHAR)) AS name, block FROM k")
def s1_sdf_blocks(spark, d):
    got = R.split_blocks(texts(spark, d), r"\$\$\$\$\r?\n?", "file")
    return got.select("file", F.col("mol_idx").cast("long").alias("mol_idx"), P.molecule_name(F.col("block")).alias("name"), "block")


def written(spark, texts):
    """texts(file, text) as one file each; what reads them finds its number in the path."""
    at = fresh_dir(spark, "texts")
    texts.select("file", F.col("text").alias("value")).repartition("file").write.partitionBy("file").text(at)
    return at


def by_number(rows):
    return rows.withColumn("file", F.regexp_extract("file", r"file=(\d+)", 1).cast("long")).withColumn("mol_idx", F.col("mol_idx").cast("long"))


def many(rows, block="block", end=""):
    """A thousand molecules a file, in order."""
    each = rows.withColumn("file", F.floor(F.col("mol_id") / 1000)).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("mol_id", F.col(block).alias("block")))).alias("all"))
    return each.select("file", F.array_join(F.transform("all", lambda s: F.concat(s["block"], F.lit(end))), "").alias("text"))


@query(_BLOCKS + "SELECT mol_id // 1000 AS file, row_number() OVER (PARTITION BY mol_id // 1000 ORDER BY mol_id) - 1 AS mol_idx, concat('ZINC', CAST(mol_id AS VARCHAR)) AS name, block FROM k")
def s1_sdf_files(spark, d):
    """Written as SDF files and read again."""
    return by_number(R.read_sdf(spark, written(spark, many(blocks(spark, d), end="$$$$\n"))))


def mol2(spark, d):
    atom = F.format_string("%7d A%d %10.4f %10.4f %10.4f %s.3", F.col("atom_idx") + 1, "atom_idx", "x", "y", "z", E.symbol_of(F.col("atomic_num")))
    a = view(spark, d, "v_atoms").groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("atom_idx", atom.alias("line")))).alias("a"))
    bond = F.format_string("%6d %4d %4d %s", F.col("i") + 1, F.col("j") + 1, F.col("i") + 1, F.when(F.col("bond_order") == 1.5, "ar").otherwise(F.col("bond_order").cast("int").cast("string")))
    b = view(spark, d, "v_bonds").groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", bond.alias("line")))).alias("b"))
    block = F.concat(F.lit("@<TRIPOS>MOLECULE\nZINC"), "mol_id", F.lit("\n@<TRIPOS>ATOM\n"), F.array_join("a.line", "\n"), F.lit("\n@<TRIPOS>BOND\n"), F.coalesce(F.array_join("b.line", "\n"), F.lit("")))
    return a.join(b, "mol_id", "left").select("mol_id", block.alias("text"))


@query("SELECT mol_id, 0::BIGINT AS mol_idx, concat('ZINC', CAST(mol_id AS VARCHAR)) AS name FROM v_atoms GROUP BY mol_id")
def s2_mol2_blocks(spark, d):
    got = R.split_blocks(mol2(spark, d), "@<TRIPOS>MOLECULE", "mol_id", skip_first=True)
    return got.select("mol_id", F.col("mol_idx").cast("long").alias("mol_idx"), P.molecule_name(F.col("block")).alias("name"))


@query("SELECT mol_id // 1000 AS file, row_number() OVER (PARTITION BY mol_id // 1000 ORDER BY mol_id) - 1 AS mol_idx, concat('ZINC', CAST(mol_id AS VARCHAR)) AS name FROM (SELECT DISTINCT mol_id FROM v_atoms) t")
def s2_mol2_files(spark, d):
    """Written as MOL2 files and read again."""
    return by_number(R.read_mol2(spark, written(spark, many(mol2(spark, d), "text", "\n")))).select("file", "mol_idx", "name")


def pdb_lines(spark, d):
    line = F.format_string("%-6s%5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00    %6.3f %-2s", "record", F.col("atom_idx") + 1, E.symbol_of(F.col("atomic_num")), "res_name", "chain", "res_num", "x", "y", "z", F.lit(0.25), E.symbol_of(F.col("atomic_num")))
    return view(spark, d, "v_atoms").select("mol_id", line.alias("line"))


@query("SELECT mol_id, atom_idx + 1 AS serial, record, res_name, chain, res_num, R6[[x]] AS x, R6[[y]] AS y, R6[[z]] AS z, 0.25::DOUBLE AS partial_charge FROM v_atoms")
def s3_pdb_atoms(spark, d):
    got = P.pdb_atoms(pdb_lines(spark, d), "mol_id").withColumns({c: F.col(c).cast("long") for c in ("serial", "res_num")})
    return rounded(got.select("mol_id", "serial", "record", "res_name", "chain", "res_num", "x", "y", "z", "partial_charge"), "x", "y", "z")


@query("SELECT mol_id // 10 AS file, row_number() OVER (PARTITION BY mol_id // 10 ORDER BY mol_id) - 1 AS mol_idx, count(*) AS n_atoms FROM v_atoms GROUP BY mol_id")
def s4_pdbqt_models(spark, d):
    one = pdb_lines(spark, d).groupBy("mol_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("block"))
    files = W.model_texts(one.select(F.floor(F.col("mol_id") / 10).alias("file"), F.col("mol_id").alias("mol_idx"), "block"))
    got = files.select("file", F.posexplode(P.models(F.col("text"))).alias("mol_idx", "block"))
    return got.select("file", F.col("mol_idx").cast("long").alias("mol_idx"), P.model_atoms(F.col("block")).cast("long").alias("n_atoms"))


@query("SELECT mol_id // 1000 AS file, row_number() OVER (PARTITION BY mol_id // 1000 ORDER BY mol_id) - 1 AS mol_idx, count(*) AS n_atoms FROM v_atoms GROUP BY mol_id")
def s4_pdbqt_files(spark, d):
    """Written as files of many models and read again."""
    one = pdb_lines(spark, d).groupBy("mol_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("block"))
    files = W.model_texts(one.select(F.floor(F.col("mol_id") / 1000).alias("file"), F.col("mol_id").alias("mol_idx"), "block"))
    return by_number(R.read_pdbqt_models(spark, written(spark, files))).select("file", "mol_idx", F.col("n_atoms").cast("long").alias("n_atoms"))


@query("SELECT page_id, url FROM pages WHERE NOT contains(url, '/fr/') AND NOT contains(url, 'ref=x')")
def s5_discovered_files(spark, d):
    return R.without_parts(view(spark, d, "pages").select("page_id", "url"), ("/fr/", "ref=x"), "url")


@query("SELECT event_id, value AS energy_final, event_type <> 'error' AS ffopt_success FROM events")
def s6_score_csv(spark, d):
    line = F.concat_ws(",", F.col("value").cast("string"), (F.col("event_type") != "error").cast("string"))
    got = view(spark, d, "events").select("event_id", F.from_csv(line, "energy_final double, success boolean").alias("r"))
    return got.select("event_id", "r.*").withColumnRenamed("success", "ffopt_success")


@query("SELECT s_name AS recpath, concat('lig', CAST(s_suppkey AS VARCHAR)) AS ligpath FROM supplier")
def s7_pair_list(spark, d):
    line = F.concat(F.replace("s_name", F.lit(" "), F.lit("_")), F.lit(" lig"), "s_suppkey")
    return view(spark, d, "supplier").select(F.from_csv(line, "recpath string, ligpath string", {"sep": " "}).alias("r")).select("r.*")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, concat(p_brand, '(', CAST(p_partkey AS VARCHAR), ')') AS reg_id, p_type AS pattern FROM part WHERE p_partkey % 5 <> 0")
def s8_catalog(spark, d):
    text = F.when(F.col("p_partkey") % 10 == 0, "# note").when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit("FRAGMENT\tregId="), "p_brand", F.lit("("), "p_partkey", F.lit(")\t"), "p_type", F.lit("\t0\t0")))
    got = P.catalog_rows(view(spark, d, "part").select("p_partkey", text.alias("value")), order="p_partkey")
    return got.withColumn("ord", F.col("ord").cast("long"))


@query("SELECT CASE WHEN page_id % 4 = 0 THEN 'sdf' WHEN page_id % 4 = 1 THEN 'mol2' WHEN page_id % 4 = 2 THEN 'pdbqt' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def s11_route_by_extension(spark, d):
    end = F.when(F.col("page_id") % 4 == 0, ".SDF.gz").when(F.col("page_id") % 4 == 1, ".mol2").when(F.col("page_id") % 4 == 2, ".pdbqt").otherwise(".txt")
    return view(spark, d, "pages").groupBy(P.extension(F.concat("url", end)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT mol_id, atom_idx, atomic_num, R6[[x]] AS x, R6[[y]] AS y, R6[[z]] AS z FROM v_atoms")
def p1_sdf_atoms(spark, d):
    got = P.sdf_atoms(blocks(spark, d), "mol_id").drop("symbol")
    return rounded(got.withColumn("atom_idx", F.col("atom_idx").cast("long")), "x", "y", "z")


@query("SELECT mol_id, i, j, bond_order FROM v_bonds")
def p2_sdf_bonds(spark, d):
    return P.sdf_bonds(blocks(spark, d), "mol_id").withColumns({c: F.col(c).cast("long") for c in "ij"})


@query("SELECT a.mol_id, count(DISTINCT atom_idx) AS n_atoms, R6[[any_value(s)]] AS sum_x, any_value(coalesce(nb, 0)) AS n_bonds, any_value(coalesce(o, 0)) AS orders FROM v_atoms a JOIN (SELECT mol_id, sum(x) AS s FROM v_atoms GROUP BY mol_id) t ON a.mol_id = t.mol_id LEFT JOIN (SELECT mol_id, count(*) AS nb, sum(bond_order) AS o FROM v_bonds GROUP BY mol_id) b ON a.mol_id = b.mol_id GROUP BY a.mol_id")
def p3_mol2_sections(spark, d):
    text = mol2(spark, d)
    a = P.mol2_atoms(text, "mol_id", block="text").groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.sum("x").alias("sum_x"))
    b = P.mol2_bonds(text, "mol_id", block="text").groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_bonds"), F.sum("bond_order").alias("orders"))
    return rounded(a.join(b, "mol_id", "left").fillna(0, ["n_bonds", "orders"]), "sum_x")


@query("SELECT mol_id, concat('ZINC', CAST(mol_id AS VARCHAR)) AS name, mol_id AS zinc_id FROM v_atoms GROUP BY mol_id")
def p4_names(spark, d):
    name = P.molecule_name(F.col("block"))
    return blocks(spark, d).select("mol_id", name.alias("name"), P.numeric_id(name).alias("zinc_id"))


@query("SELECT page_id, list_extract(p, -1) AS fname, list_extract(p, -2) AS pdb_id, list_extract(p, -3) AS experiment, list_extract(p, -4) AS model FROM (SELECT page_id, string_split(url, '/') AS p FROM pages) t")
def p5_path_keys(spark, d):
    return P.path_keys(view(spark, d, "pages"), "url").select("page_id", "fname", "pdb_id", "experiment", "model")


@query("""
WITH e AS (SELECT page_id, unnest(string_split(url, '/')) AS part, generate_subscripts(string_split(url, '/'), 1) AS nth FROM pages),
k AS (SELECT page_id, arg_max(part, nth) AS pdb_id FROM e WHERE part IN ('fr', 'de', 'en', 'es') GROUP BY page_id) SELECT p.url AS path, k.pdb_id FROM pages p LEFT JOIN k ON p.page_id = k.page_id""")
def p6_nearest_known_folder(spark, d):
    known = spark.createDataFrame([("fr",), ("de",), ("en",), ("es",)], "pdb_id string")
    return P.nearest_known_folder(view(spark, d, "pages").select(F.col("url").alias("path")), known)


@query("""
SELECT event_id, concat('m', CAST(user_id AS VARCHAR), CASE WHEN event_type IN ('view', 'click') THEN concat(' e_', event_type, ' pt a_opt1 (opt) (opt)') WHEN event_type = 'signup' THEN ' e_' ELSE concat(' faj ', event_type, '') END) AS run_name FROM events""")
def p7_run_name(spark, d):
    e = view(spark, d, "events")
    kind = F.col("event_type")
    opt = kind.isin("view", "click")
    experiment = F.when(opt, F.concat(F.lit("e_"), kind, F.lit(" posterior"))).when(kind == "signup", F.lit("e_prior")).otherwise("fullatom_joint")
    fname = F.when(opt, "a_opt1_qvina.csv").when(kind == "signup", "b_mols_gen").otherwise(kind)
    return e.select("event_id", P.run_name(F.concat(F.lit("m"), "user_id"), experiment, fname).alias("run_name"))


@query("SELECT mol_idx, CASE WHEN murcko = '' THEN concat('xx', smiles) ELSE murcko END AS murcko FROM v_stats")
def p8_scaffold(spark, d):
    return view(spark, d, "v_stats").select("mol_idx", P.scaffold(F.col("murcko"), F.col("smiles")).alias("murcko"))


@query("SELECT model, CASE model WHEN 'run_opt1' THEN 1 WHEN 'run_opt2' THEN 2 WHEN 'run_opt3' THEN 3 ELSE 0 END AS generation, count(*) AS n FROM v_scores GROUP BY ALL")
def p9_generation(spark, d):
    from ..operators.scores import generation

    return view(spark, d, "v_scores").groupBy("model", generation(F.col("model")).alias("generation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT mol_id, mol_id % 2 = 0 AS is_3d FROM v_atoms GROUP BY mol_id")
def p10_dimension_flag(spark, d):
    flat = F.when(F.col("mol_id") % 2 == 0, F.col("block")).otherwise(F.replace("block", F.lit("3D"), F.lit("2D")))
    return blocks(spark, d).select("mol_id", P.dimension_3d(flat).alias("is_3d"))


@query("SELECT event_id, R6[[-value]] AS affinity_qvina, CASE WHEN event_id % 7 = 0 THEN NULL ELSE R6[[value / 4]] END AS intra_e, R6[[value * 2]] AS gauss_1, CASE WHEN user_id % 2 = 0 THEN 1.5::DOUBLE END AS hbond FROM events")
def p11_score_log(spark, d):
    num = lambda c: F.format_string("%.7f", c)
    log = F.concat(
        F.lit("Affinity: "), num(-F.col("value")), F.lit(" (kcal/mol)\nIntramolecular energy: "), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(num(F.col("value") / 4)), F.lit("\n   gauss 1     : "),
        num(F.col("value") * 2), F.when(F.col("user_id") % 2 == 0, "\n    Hydrogen    : 1.5\n").otherwise("\n"),
    )
    m = P.score_metrics(log)
    return rounded(view(spark, d, "events").select("event_id", *(m[k].alias(k) for k in ("affinity_qvina", "intra_e", "gauss_1", "hbond"))), "affinity_qvina", "intra_e", "gauss_1")


@query("SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN R6[[-value]] END AS affinity FROM events")
def p12_docking_log(spark, d):
    row = F.when(F.col("event_id") % 11 == 0, "Writing output").otherwise(F.format_string("   1    %12.7f      0.000      0.000", -F.col("value")))
    log = F.concat(F.lit(f"mode |\n{P.DOCKED_BELOW}\n"), row, F.lit("\n   2  1.0 2.0 3.0\nWriting output ... done."))
    got = view(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, P.docked_affinity(log)).alias("affinity"))
    return rounded(got, "affinity")


@query("SELECT mol_id // 10 AS file, count(*) AS n_atoms FROM v_atoms WHERE mol_id IN (SELECT min(mol_id) FROM v_atoms GROUP BY mol_id // 10) GROUP BY mol_id")
def p13_first_model(spark, d):
    one = pdb_lines(spark, d).groupBy("mol_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("block"))
    files = W.model_texts(one.select(F.floor(F.col("mol_id") / 10).alias("file"), F.col("mol_id").alias("mol_idx"), "block"))
    return files.select("file", P.model_atoms(P.first_model(F.col("text"))).cast("long").alias("n_atoms"))


@query("SELECT mol_id, printf('%.2f', floor(avg(x) * 100 + 0.5000001) / 100) AS center_x, printf('%.2f', floor(avg(y) * 100 + 0.5000001) / 100) AS center_y, printf('%.2f', floor(avg(z) * 100 + 0.5000001) / 100) AS center_z, '20.00' AS size_x, '20.00' AS size_y, '20.00' AS size_z FROM v_atoms GROUP BY mol_id")
def p14_docking_box(spark, d):
    return P.docking_box(view(spark, d, "v_atoms"))


@query(_BLOCKS + "SELECT mol_id, block FROM k")
def k4_sdf_text(spark, d):
    return W.with_dummies(blocks(spark, d))


@query("SELECT file, count(*) AS n FROM v_scores WHERE dock_success GROUP BY ROLLUP (file)")
def k6_manifest(spark, d):
    return W.manifest(view(spark, d, "v_scores").where("dock_success"))


@query("SELECT CAST(mol_idx AS INT) AS zinc_id, CAST(num_atoms AS SMALLINT) AS num_atoms, CAST(hba AS SMALLINT) AS hba, R6[[CAST(CAST(mw AS FLOAT) AS DOUBLE)]] AS mw FROM v_stats")
def k5_downcast(spark, d):
    rows = view(spark, d, "v_stats").select(F.col("mol_idx").cast("int").alias("zinc_id"), "num_atoms", "hba", "mw")
    return rounded(W.downcast(rows).withColumn("mw", F.col("mw").cast("double")), "mw")


def packed(spark, d, **kw):
    types = E.feature_types(F.col("atomic_num"), F.col("is_hbd"), F.col("is_hba"), F.col("is_aromatic"), F.col("charge"))
    return W.packed(view(spark, d, "v_atoms").withColumn("types", types), **kw)


def cells(rows, *keep):
    """One row per atom of packed rows: nth, types (sorted, without padding) and centred coordinates to four places."""
    each = rows.select(*keep, F.posexplode(F.arrays_zip("atom_types", "atom_coords")).alias("nth", "a")).where(~F.isnan(F.col("a.atom_coords")[0]))
    place = {c: F.floor(F.col("a.atom_coords")[i].cast("double") * 10000 + 0.501) / 10000 for i, c in enumerate("xyz")}
    types = F.array_join(F.sort_array(F.filter("a.atom_types", lambda t: t != -1)), ",")
    return each.select(*keep, F.col("nth").cast("long").alias("nth"), types.alias("types"), *(v.alias(c) for c, v in place.items()))


_TYPES = "[atomic_num, CASE WHEN is_hbd THEN 301 END, CASE WHEN is_hba THEN 302 END, CASE WHEN is_aromatic THEN 303 END, CASE WHEN charge > 0 THEN 304 WHEN charge < 0 THEN 306 ELSE 305 END]"
_CELLS = f"""
WITH a AS (SELECT *, avg(x) OVER m AS cx, avg(y) OVER m AS cy, avg(z) OVER m AS cz, count(*) OVER m AS n FROM v_atoms WINDOW m AS (PARTITION BY mol_id)),
c AS (
  SELECT mol_id, CAST(mol_id AS VARCHAR) AS name, n, atom_idx AS nth, array_to_string(list_sort(list_filter({_TYPES}, lambda v: v IS NOT NULL)), ',') AS types,
         floor(CAST(CAST(x - cx AS FLOAT) AS DOUBLE) * 10000 + 0.501) / 10000 AS x, floor(CAST(CAST(y - cy AS FLOAT) AS DOUBLE) * 10000 + 0.501) / 10000 AS y,
         floor(CAST(CAST(z - cz AS FLOAT) AS DOUBLE) * 10000 + 0.501) / 10000 AS z
  FROM a) """


@query(_CELLS + "SELECT name, 8::BIGINT AS width, 10::BIGINT AS slots, nth, types, x, y, z FROM c WHERE n <= 8")
def k1_packed(spark, d):
    rows = packed(spark, d, natoms_max=8).withColumns({"width": F.size("atom_coords").cast("long"), "slots": F.size(F.get("atom_types", 0)).cast("long")})
    return cells(rows, "name", "width", "slots")


@query(_CELLS + ", m AS (SELECT max(n) AS width, max(len(string_split(types, ','))) AS slots FROM c WHERE n <= 8) SELECT name, CAST(width AS BIGINT) AS width, CAST(slots AS BIGINT) AS slots, nth, types, x, y, z FROM c, m WHERE n <= 8")
def k2_combined(spark, d):
    one = packed(spark, d, natoms_max=8)
    never = one.limit(1).select("name", F.transform("atom_types", lambda t: F.transform(t, lambda v: F.lit(-1).cast("smallint"))).alias("atom_types"), "atom_coords")
    got = W.combined([one.where("name % 2 = 0"), one.where("name % 2 = 1"), never])
    return cells(got.withColumns({"width": F.size("atom_types").cast("long"), "slots": F.size(F.get("atom_types", 0)).cast("long")}), "name", "width", "slots")


@query("SELECT mol_id, atom_idx, list_sort(list_filter([atomic_num, CASE WHEN is_hbd THEN 301 END, CASE WHEN is_hba THEN 302 END, CASE WHEN is_aromatic THEN 303 END, CASE WHEN charge > 0 THEN 304 WHEN charge < 0 THEN 306 ELSE 305 END], lambda v: v IS NOT NULL)) AS types FROM v_atoms")
def f10_feature_types(spark, d):
    types = E.feature_types(F.col("atomic_num"), F.col("is_hbd"), F.col("is_hba"), F.col("is_aromatic"), F.col("charge"))
    return view(spark, d, "v_atoms").select("mol_id", "atom_idx", F.sort_array(types).alias("types"))


@query("SELECT mol_id, list_sort(list(DISTINCT atomic_num)) AS nums, count(DISTINCT atomic_num) AS n_hot FROM v_atoms GROUP BY mol_id")
def f6_multi_hot(spark, d):
    nums = view(spark, d, "v_atoms").groupBy("mol_id").agg(F.collect_set("atomic_num").alias("n"))
    hot = nums.withColumn("v", E.multi_hot(F.array_append("n", -1), 64))
    return hot.select("mol_id", F.sort_array(E.from_multi_hot(F.col("v"))).alias("nums"), F.aggregate("v", F.lit(0), lambda s, x: s + x).cast("long").alias("n_hot"))


@query("SELECT mol_id, list_sort(list(atomic_num)) AS nums, 20::BIGINT AS width FROM v_atoms GROUP BY mol_id")
def f5_pad_unpad(spark, d):
    nums = view(spark, d, "v_atoms").groupBy("mol_id").agg(F.sort_array(F.collect_list("atomic_num")).alias("n")).withColumn("p", E.padded(F.col("n"), 20, F.lit(-1)))
    return nums.select("mol_id", E.unpadded(F.col("p"), -1).alias("nums"), F.size("p").cast("long").alias("width"))

