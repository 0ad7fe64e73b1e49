"""Tables to files, and the texts that are written."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import padded, symbol_of
from ..storage import fresh_dir

DUMMY = "dummy\n  none\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 C   0  0\nM  END\n"
DUMMY_MODEL = "ATOM      1  C   UNK A   1       0.000   0.000   0.000  1.00  0.00     0.000 C"


def sdf_blocks(atoms: DataFrame, bonds: DataFrame, name: Column | None = None, key: str = "mol_id") -> DataFrame:
    """key and the V2000 block of atoms(key, atom_idx, atomic_num, x, y, z) and bonds(key, i, j, bond_order)."""
    line = F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", "x", "y", "z", symbol_of(F.col("atomic_num")))
    a = atoms.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("atom_idx", line.alias("line")))).alias("a"))
    order = F.when(F.col("bond_order") == 1.5, 4).otherwise(F.col("bond_order").cast("int"))
    bond = F.format_string("%3d%3d%3d  0", F.col("i") + 1, F.col("j") + 1, order)
    b = bonds.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "j", bond.alias("line")))).alias("b"))
    both = a.join(b, key, "left")
    n_bonds = F.coalesce(F.size("b"), F.lit(0))
    n_bonds = F.when(F.col("b").isNull(), 0).otherwise(n_bonds)
    head = F.concat(name if name is not None else F.col(key).cast("string"), F.lit("\n  table          3D\n\n"), F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size("a"), n_bonds))
    return both.select(key, F.concat(F.array_join(F.flatten(F.array(F.array(head), F.col("a.line"), F.coalesce(F.col("b.line"), F.array().cast("array<string>")), F.array(F.lit("M  END")))), "\n"), F.lit("\n")).alias("block"))


def with_dummies(mols: DataFrame, block: str = "block") -> DataFrame:
    """Molecules without a block get that of one carbon atom, so that rows stay aligned."""
    return mols.withColumn(block, F.coalesce(block, F.lit(DUMMY)))


def write_sdf(mols: DataFrame, path: str, append: bool = False) -> None:
    """mols(mol_idx, block), one file per partition of the order, blocks ended by $$$$."""
    rows = with_dummies(mols).repartitionByRange("mol_idx").sortWithinPartitions("mol_idx")
    rows.select(F.concat("block", F.lit("$$$$"))).write.mode("append" if append else "errorifexists").text(path)


def packed(atoms: DataFrame, natoms_max: int = 80, key: str = "mol_id", name: Column | None = None, n_types: int = 10, centre: bool = True, pad: bool = True) -> DataFrame:
    """name, atom_types (padded by -1) and atom_coords (padded by NaN) of atoms(key, atom_idx, x, y, z, types) of at most natoms_max atoms."""
    rows = atoms.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("atom_idx", "x", "y", "z", "types"))).alias("a"))
    rows = rows.where(F.size("a") <= natoms_max)
    shift = {c: F.aggregate(F.col(f"a.{c}"), F.lit(0.0), lambda s, v: s + v) / F.size("a") if centre else F.lit(0.0) for c in "xyz"}
    coords = F.transform("a", lambda v: F.array(*((v[c] - shift[c]).cast("float") for c in "xyz")))
    types = F.transform("a", lambda v: v["types"].cast("array<smallint>"))
    if pad:
        none = F.lit(-1).cast("smallint")
        types = padded(F.transform(types, lambda t: padded(t, n_types, none)), natoms_max, F.array_repeat(none, n_types))
        coords = padded(coords, natoms_max, F.array_repeat(F.lit(float("nan")).cast("float"), 3))
    return rows.select((name if name is not None else F.col(key).cast("string")).alias("name"), types.alias("atom_types"), coords.alias("atom_coords"))


def combined(parts: list[DataFrame]) -> DataFrame:
    """Packed parts in one, without rows never filled, and with no more padding than the largest molecule and the atom of most types need."""
    from ..operators.stats import true_widths

    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.col("atom_types")[0][0] != -1)
    w = true_widths(rows).head()
    if w.natoms_max is None:
        return rows
    return rows.select(
        "name", F.transform(F.slice("atom_types", 1, w.natoms_max), lambda t: F.slice(t, 1, w.types_max)).alias("atom_types"), F.slice("atom_coords", 1, w.natoms_max).alias("atom_coords")
    )


def write_packed(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def write_bucketed(rows: DataFrame, key: str, buckets: int = 32, name: str = "half") -> DataFrame:
    """rows written as a table in buckets of the key, in its order, and read back: joins of such tables with as many buckets move no row.

    The table lies in the shared folder; its name, new each time, is known to this session's catalog.
    """
    spark, at = rows.sparkSession, fresh_dir(rows.sparkSession, name)
    table = at.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", at).saveAsTable(table)
    return spark.table(table)


def complex_rows(ligand: DataFrame, pocket: DataFrame, key: str = "pdb_id") -> DataFrame:
    """key, lig_coords, lig_types, prot_coords, prot_types of two tables(key, coords, types), of keys that are in both."""
    of = lambda rows, n: rows.select(key, F.col("coords").alias(f"{n}_coords"), F.col("types").alias(f"{n}_types"))
    return of(ligand, "lig").hint("merge").join(of(pocket, "prot"), key)


def write_complexes(rows: DataFrame, path: str) -> None:
    """rows(pdb_id, lig_coords, lig_types, prot_coords, prot_types)"""
    rows.repartitionByRange("pdb_id").sortWithinPartitions("pdb_id").write.parquet(path)


def downcast(rows: DataFrame, keep: tuple[str, ...] = ("zinc_id",)) -> DataFrame:
    """Whole numbers to smallint, floats to float, but for the columns kept."""
    small = {"int": "smallint", "bigint": "smallint", "double": "float", "decimal": "float"}
    return rows.select(*(F.col(c).cast(small[t]).alias(c) if c not in keep and t in small else F.col(c) for c, t in rows.dtypes))


def write_stats(rows: DataFrame, path: str) -> None:
    downcast(rows).write.option("header", "true").option("compression", "gzip").csv(path)


def manifest(mols: DataFrame) -> DataFrame:
    """n by file, for files with any, and in all (file null)."""
    return mols.rollup("file").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


def write_manifest(mols: DataFrame, path: str) -> None:
    manifest(mols).select(F.concat_ws(" ", F.coalesce("file", F.lit("total")), "n")).write.text(path)


def next_inputs(best: DataFrame, receptors: DataFrame, folder: str) -> DataFrame:
    """recpath and molpath of the best(pdb_id, name) molecules, with receptors(pdb_id, path)."""
    return best.join(receptors.select("pdb_id", "path"), "pdb_id").select("pdb_id", F.col("path").alias("recpath"), F.concat(F.lit(f"{folder}/"), "pdb_id", F.lit("/"), "name", F.lit(".sdf")).alias("molpath"))


def write_next_inputs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.concat_ws(" ", "recpath", "molpath")).write.text(path)


def write_blocks_by_file(mols: DataFrame, path: str) -> None:
    """mols(file, block) untouched, a folder per source file, gz."""
    mols.select("file", F.col("block").alias("value")).hint("rebalance", "file").write.partitionBy("file").option("compression", "gzip").text(path)


def model_texts(results: DataFrame, key: str = "file") -> DataFrame:
    """key and the multi-model text of results(key, mol_idx, block); where block is null a dummy. A file's models are one text."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("mol_idx"))
    model = F.concat(F.lit("MODEL "), nth, F.lit("\n"), F.coalesce("block", F.lit(DUMMY_MODEL)), F.lit("\nENDMDL\n"))
    rows = results.withColumn("model", model)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mol_idx", "model"))), lambda s: s["model"]), "").alias("text"))
