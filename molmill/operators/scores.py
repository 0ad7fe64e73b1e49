"""Score tables: joins, thresholds, generations, selection of the best and most diverse."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import scratch
from .quantiles import exact_quantiles

_INDEX_BITS = 33  # monotonically_increasing_id keeps the index in a partition in its low 33 bits

def ordered(c: str, increase: bool = False) -> Column:
    """Best first, missing values last: ascending unless the score is to be increased."""
    return F.col(c).desc_nulls_last() if increase else F.col(c).asc_nulls_last()


def joined_tables(first: DataFrame, *others: DataFrame, keys=("file", "mol_idx"), last_inner: bool = True) -> DataFrame:
    """Row-aligned tables side by side. Of a column in two tables the later one is kept; rows stay unless the last join lacks them."""
    out = first
    for i, t in enumerate(others):
        out = out.drop(*((set(out.columns) & set(t.columns)) - set(keys))).join(t, list(keys), "inner" if last_inner and i == len(others) - 1 else "left")
    return out


def receptors(ligands: DataFrame, files: DataFrame) -> DataFrame:
    """ligands(pdb_id) with path and warning from files(pdb_id, dir_rank, kind, path): the first directory, there pocket before protein."""
    order = Window.partitionBy("pdb_id").orderBy("dir_rank", F.when(F.col("kind") == "pocket", 0).otherwise(1), "path")
    best = files.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("pdb_id", "path")
    return ligands.join(best, "pdb_id", "left").withColumn("warning", F.when(F.col("path").isNull(), "no receptor"))


def unfinished(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select("file").distinct(), "file", "left_anti")


def resumed(mols: DataFrame, manifest: DataFrame) -> DataFrame:
    """mols(file, mol_idx) from where manifest(file, n) says that each file was left."""
    done = manifest.groupBy("file").agg(F.max("n").alias("done"))
    return mols.join(done, "file", "left").where("mol_idx >= coalesce(done, 0)").drop("done")


def listed(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names.select(key).distinct(), key, "left_semi")


def quantiles(scores: DataFrame, q: float, value: str = "affinity", by: str = "pdb_id", exact: bool = True, at_once: int = 100_000) -> DataFrame:
    """Per target the q-quantile, interpolated, of its rows of the model 'initial'; NaN counts as missing.

    exact: targets of more than at_once rows by counting, so that no task holds a target's
    values; otherwise a sketch of bounded size, off by 1 / 10,000 of the rank.
    """
    initial = scores.where("model = 'initial'")
    if exact:
        return exact_quantiles(initial, [q], value, by, at_once).select(by, F.col("quantiles")[0].alias("threshold"))
    return initial.groupBy(by).agg(F.percentile_approx(F.when(~F.isnan(value), F.col(value)), q, 10_000).alias("threshold"))


def better_than_threshold(scores: DataFrame, thresholds: DataFrame, value: str = "affinity", by: str = "pdb_id") -> DataFrame:
    return scores.join(thresholds, by).where(F.col(value) < F.col("threshold"))


def generation(name: Column) -> Column:
    """Number after the last _opt at the end; 0 without."""
    return F.coalesce(F.regexp_extract(name, r"_opt(\d+)$", 1).try_cast("int"), F.lit(0))


def latest_generation(scores: DataFrame, name: str = "model") -> DataFrame:
    """Rows of the greatest generation number, with it as optnum; with no generation all rows, optnum 0."""
    rows = scores.withColumn("optnum", generation(F.col(name)))
    last = rows.agg(F.max("optnum").alias("last"))  # one row
    return rows.join(F.broadcast(last), F.col("optnum") == F.col("last")).drop("last")


def best_attempt(tries: DataFrame, key: str = "mol_idx") -> DataFrame:
    """Of tries(key, try, energy, success, reason) per key the least energy that succeeded; else null and the last reason."""
    return tries.groupBy(key).agg(
        F.min_by(F.when(F.col("success"), F.col("energy")), F.when(F.col("success"), F.struct("energy", "try"))).alias("energy"),
        F.min_by(F.when(F.col("success"), F.col("try")), F.when(F.col("success"), F.struct("energy", "try"))).alias("try"),
        F.bool_or("success").alias("success"), F.when(~F.bool_or("success"), F.max_by("reason", "try")).alias("reason"),
    )


def failures(rows: DataFrame, success: str = "dock_success", reason: str = "dock_reason") -> DataFrame:
    """By reason: failed rows, and their share of all rows in percent."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rows.where(~F.col(success)).groupBy(reason).agg(F.count(F.lit(1)).alias("n_failed")).crossJoin(F.broadcast(total)).withColumn("percent", 100 * F.col("n_failed") / F.col("total")).drop("total")


def status_rows(mols: DataFrame, scores: DataFrame, metrics: list[str], scored: bool = True, keys=("file", "mol_idx")) -> DataFrame:
    """One row per molecule: metrics (null after failure), success and reason; without scoring asked, no metrics."""
    got = mols.select(*keys).join(scores, list(keys), "left").withColumn("dock_success", F.coalesce("dock_success", F.lit(False)))
    got = got.withColumn("dock_reason", F.when(~F.col("dock_success"), F.coalesce("dock_reason", F.lit("NOT_DOCKED"))))
    return got.select(*keys, *((F.when(F.col("dock_success"), F.col(m)).alias(m) for m in metrics) if scored else ()), "dock_success", "dock_reason")


def cluster_ranks(rows: DataFrame, value: str, by=("model", "pdb_id"), cluster: str = "cluster", tie: str = "mol_idx", increase: bool = False) -> DataFrame:
    """cluster_idx: place in the cluster, best first, from 0."""
    return rows.withColumn("cluster_idx", F.row_number().over(Window.partitionBy(*by, cluster).orderBy(ordered(value, increase), tie)) - 1)


def diverse_top(rows: DataFrame, n: int, value: str, by=("model", "pdb_id"), cluster: str = "cluster", tie: str = "mol_idx", increase: bool = False) -> DataFrame:
    """Up to n rows a group: the best of every cluster first, then the second of every cluster, and so on."""
    ranked = cluster_ranks(rows, value, by, cluster, tie, increase)
    order = Window.partitionBy(*by).orderBy("cluster_idx", ordered(value, increase), tie)
    return ranked.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def top(rows: DataFrame, n: int, value: str, by=("pdb_id",), tie: str = "mol_idx", increase: bool = False) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(ordered(value, increase), tie)
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def running_offsets(parts: DataFrame) -> DataFrame:
    """parts(file, n) with the row at which each file starts when they are laid end to end in order of name. One row per file."""
    return parts.withColumn("first", F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))


def output_names(best: DataFrame, value: str = "affinity", tie: str = "mol_idx") -> DataFrame:
    """name {pdb_id}_mol_best_{i} of each target's rows, i from 0 in order of value."""
    i = F.row_number().over(Window.partitionBy("pdb_id").orderBy(ordered(value), tie)) - 1
    return best.withColumn("name", F.concat(F.col("pdb_id"), F.lit("_mol_best_"), i))


def cluster_sizes(rows: DataFrame, by=("model", "pdb_id", "cluster")) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def global_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with place, from 1, in the order of all rows; ties in a free order.

    A range shuffle sorts the rows into partitions; a row's place is its index there and the
    rows of the partitions before, which one row a partition counts. Nothing is sorted in one task.
    """
    cut = scratch(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", _INDEX_BITS)
    sizes = cut.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + 1).alias("start"))
    placed = cut.join(F.broadcast(starts), part == F.col("part"))  # one row per partition of the range shuffle
    return placed.withColumn("place", F.col("start") + F.col("place").bitwiseAND((1 << _INDEX_BITS) - 1)).drop("part", "start")
