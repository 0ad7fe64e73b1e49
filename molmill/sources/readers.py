"""Files to tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import parse as P

STATS = "mol_idx int, num_atoms smallint, mw float, alogp float, hba smallint, hbd smallint, rotb smallint"
FFOPT = "mol_idx int, energy_init double, energy_final double, success boolean, reason string"


def find_files(spark: SparkSession, root: str, include: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """file of all files below root that match the glob and have none of the excluded parts in their path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root).select(F.col("path").alias("file"))
    return without_parts(files, exclude)


def without_parts(files: DataFrame, exclude: tuple[str, ...], path: str = "file") -> DataFrame:
    return reduce(lambda df, p: df.where(~F.contains(F.col(path), F.lit(p))), exclude, files)


def _texts(spark, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def split_blocks(texts: DataFrame, separator: str, *keys: str, skip_first: bool = False, keep=None) -> DataFrame:
    """texts(…, text) to mol_idx and block: pieces between separators (a regular expression), without one-line pieces.

    mol_idx is the place among the kept pieces. skip_first drops what stands before the first separator.
    """
    pieces = F.split("text", separator)
    if skip_first:
        pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    kept = F.filter(pieces, keep or (lambda b: F.contains(F.rtrim(b), F.lit("\n"))))
    return texts.select(*keys, F.posexplode(kept).alias("mol_idx", "block"))


def _sdf_name(mark: str) -> Column:
    return F.coalesce(P.molecule_name(F.col("block"), mark), F.trim(F.get(P.lines(F.col("block")), 0)))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(file, split, …) as they were read, with mol_idx, a row's place in its file.

    A row's place is its number in its split, and the rows of the splits before it, which one
    row a split counts; no row is shuffled.
    """
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "split").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    placed = rows.join(splits.select("file", "split", (before - F.col("first")).alias("shift")), ["file", "split"])
    return placed.withColumn("mol_idx", (F.col("number") + F.col("shift")).cast("int")).drop("number", "shift", "split")


def _records(spark: SparkSession, paths, separator: str) -> DataFrame:
    """(file, split, block): what stands between separators; plain files are split between tasks."""
    rows = spark.read.option("lineSep", separator).text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("block"))


def read_sdf(spark: SparkSession, paths, separator: str = "$$$$\n", mark: str = "ZINC") -> DataFrame:
    """(file, mol_idx, name, block), plain or gz. Blocks end with the separator; mol_idx is a block's place in its file."""
    rows = _records(spark, paths, separator).withColumn("block", F.regexp_replace("block", r"\$\$\$\$\s*$", ""))
    return _numbered(rows.where(F.contains(F.rtrim("block"), F.lit("\n")) & F.rlike("block", F.lit(r"\S")))).select("file", "mol_idx", _sdf_name(mark).alias("name"), "block")


def read_sdf_whole(spark: SparkSession, paths, separator: str = r"\$\$\$\$\r?\n?", mark: str = "ZINC") -> DataFrame:
    """The same for separators that differ, as a regular expression; a file is one task's work and has less than 2 GB."""
    return split_blocks(_texts(spark, paths), separator, "file").select("file", "mol_idx", _sdf_name(mark).alias("name"), "block")


def read_mol2(spark: SparkSession, paths, separator: str = "@<TRIPOS>MOLECULE", mark: str = "ZINC") -> DataFrame:
    """(file, mol_idx, name, block), plain or gz. Blocks begin after the separator; what stands before the first is none, and a separator with nothing after it counts in mol_idx, but has no row."""
    rows = _numbered(_records(spark, paths, separator)).where("mol_idx > 0").withColumn("mol_idx", F.col("mol_idx") - 1)
    return rows.where(F.contains(F.rtrim("block"), F.lit("\n"))).select("file", "mol_idx", P.molecule_name(F.col("block"), mark).alias("name"), "block")


def read_pdb(spark: SparkSession, paths) -> DataFrame:
    """(file, …) one row per atom line."""
    return P.pdb_atoms(spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")), "file")


def read_pdbqt_models(spark: SparkSession, paths) -> DataFrame:
    """(file, mol_idx, block, n_atoms), plain or gz: models end with ENDMDL; empty ones are left out."""
    rows = _records(spark, paths, "ENDMDL").withColumn("block", P.first_model(F.col("block"))).where("block is not null")
    return _numbered(rows).select("file", "mol_idx", "block", P.model_atoms(F.col("block")).alias("n_atoms"))


READERS = {"sdf": read_sdf, "mol2": read_mol2, "pdb": read_pdb, "pdbqt": read_pdbqt_models}


def read_by_extension(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """A table per kind of file; an unknown kind is an error."""
    kinds: dict[str, list[str]] = {}
    for path in paths:
        kind = next((k for k in ("sdf", "mol2", "pdbqt", "pdb") if path.lower().removesuffix(".gz").endswith(f".{k}")), None)
        if kind is None:
            raise ValueError(f"no reader for {path}")
        kinds.setdefault(kind, []).append(path)
    return {k: READERS[k](spark, p) for k, p in kinds.items()}


def read_scores(spark: SparkSession, paths, schema: str | T.StructType) -> DataFrame:
    """CSV with a header, by column name; empty files have no rows, success becomes ffopt_success."""
    rows = spark.read.csv(paths, header=True, schema=schema, enforceSchema=True).withColumn("file", F.col("_metadata.file_path"))
    return rows.withColumnRenamed("success", "ffopt_success")


def read_pairs(spark: SparkSession, paths) -> DataFrame:
    return spark.read.csv(paths, sep=" ", schema="recpath string, ligpath string")


def read_catalog(spark: SparkSession, paths) -> DataFrame:
    return P.catalog_rows(spark.read.text(paths))


def read_packed(spark: SparkSession, path: str, index: DataFrame | None = None, key: str = "name") -> DataFrame:
    """A packed table, restricted to the names in index if there is one."""
    rows = spark.read.parquet(path)
    return rows if index is None else rows.join(index.select(key).distinct(), key, "left_semi")


def read_names(spark: SparkSession, paths) -> DataFrame:
    rows = spark.read.text(paths).select(F.trim("value").alias("name"))
    return rows.where("name <> ''")
