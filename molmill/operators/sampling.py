"""Histograms of properties, stratified and other reproducible samples, mixtures of two sources."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import bin_index, uniform
from .filters import COLUMNS, MolFilter

LIBRARY_SIZE = 505_000_000  # molecules that a sampler takes a library to have, if not told


def binned(stats: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """stats with b1..bk, the bins of the properties in edges; rows outside the edges go."""
    names = [f"b{i}" for i in range(1, len(edges) + 1)]
    out = stats.withColumns({b: bin_index(F.col(k).cast("double"), e) for b, (k, e) in zip(names, edges.items(), strict=True)})
    return out.dropna(subset=names)


def histogram(stats: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """n by bin tuple b1..bk; only tuples with rows."""
    return binned(stats, edges).groupBy(*(f"b{i}" for i in range(1, len(edges) + 1))).agg(F.count(F.lit(1)).alias("n"))


def trimmed_edges(edges: dict[str, list[float]], f: MolFilter) -> dict[str, tuple[int, list[float]]]:
    """Per property the first kept edge's index and the kept edges: from the last at or below the filter's least to the first above its most."""
    bounds = {c: (getattr(f, f"{k}_min"), getattr(f, f"{k}_max")) for k, c in COLUMNS.items()}
    out = {}
    for key, e in edges.items():
        low, high = bounds.get(key, (None, None))
        first = max((i for i, v in enumerate(e) if low is not None and v <= low), default=0)
        last = min((i for i, v in enumerate(e) if high is not None and v > high), default=len(e) - 1)
        out[key] = first, e[first : last + 1]
    return out


def trimmed_histogram(hist: DataFrame, edges: dict[str, list[float]], f: MolFilter) -> DataFrame:
    """Bins inside the filter's bounds, numbered by the trimmed edges."""
    for i, (first, kept) in enumerate(trimmed_edges(edges, f).values(), 1):
        b = F.col(f"b{i}")
        hist = hist.where((b >= first) & (b < first + len(kept) - 1)).withColumn(f"b{i}", b - first)
    return hist


def sample_per_bin(hist: DataFrame, n_sample: float, n_total: float = LIBRARY_SIZE) -> DataFrame:
    """One row: n_per_bin = sum of n times n_sample / n_total over the number of bins with rows."""
    return hist.where("n > 0").agg((F.sum("n") * (n_sample / n_total) / F.count(F.lit(1))).alias("n_per_bin"))


def bin_probabilities(hist: DataFrame) -> DataFrame:
    return hist.where("n > 0").withColumn("p", 1 / F.col("n"))


def stratified(stats: DataFrame, edges: dict[str, list[float]], n_sample: float, n_total: float, seed: str, *keys: Column) -> DataFrame:
    """Rows whose seeded uniform number lies below their bin's n_per_bin / n, so that all bins give about as many."""
    rows = binned(stats, edges)
    names = [f"b{i}" for i in range(1, len(edges) + 1)]
    hist = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    per_bin = sample_per_bin(hist, n_sample, n_total)  # one row
    p = hist.crossJoin(F.broadcast(per_bin)).select(*names, (F.col("n_per_bin") / F.col("n")).alias("p"))
    return rows.join(p, names).where(uniform(seed, *keys) < F.col("p")).drop("p", *names)


def bernoulli(rows: DataFrame, p: float, seed: str, *keys: Column) -> DataFrame:
    return rows.where(uniform(seed, *keys) < p)


def every_nth(mols: DataFrame, counts: DataFrame, proportion: float) -> DataFrame:
    """mols(file, mol_idx from 0): each k-th of a file, k = n div int(n * proportion); all of a file if that is nothing."""
    step = F.greatest(F.floor(F.col("n") / F.greatest(F.floor(F.col("n") * proportion), F.lit(1))), F.lit(1))
    return mols.join(counts.select("file", step.alias("step")), "file").where("mol_idx % step = 0").drop("step")


def batches(files: DataFrame, first: int, last: int, n_batches: int) -> DataFrame:
    """Files first to last - 1 in order of name, with their batch. One row per file."""
    order = Window.orderBy("file")
    some = files.withColumn("nth", F.row_number().over(order) - 1).where((F.col("nth") >= first) & (F.col("nth") < last))
    return some.withColumn("batch", F.ntile(n_batches).over(order))


def read_range(mols: DataFrame, start: int, count: int | None) -> DataFrame:
    """Of each file rows from start, count of them at most; None is all."""
    out = mols.where(F.col("mol_idx") >= start)
    return out if count is None else out.where(F.col("mol_idx") < start + count)


def with_replacement(rows: DataFrame, n: int, total: int, seed: str, index: str = "idx") -> DataFrame:
    """n draws of rows numbered 0 to total - 1 in index, each by its own seeded number."""
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, F.col("id")) * total).alias(index))
    return draws.join(rows, index)


def alpha_at(epoch: int, start: float, rate: float, low: float, high: float) -> float:
    return min(max(start + rate * epoch, low), high)


def mixture(complexes: DataFrame, library: DataFrame, alpha: float, epoch: int, n_complex: int, n_library: int) -> DataFrame:
    """All complexes, and int(alpha * n_complex) library rows (numbered in idx, from 0 or 1 on) from where this epoch's window starts, past the end from the start.

    The window is a range of idx, or two, which the scan of the library can be cut to. Columns that one side lacks are null, arrays empty.
    """
    n = int(alpha * n_complex)
    if n and n_library:
        place = F.pmod(F.col("idx") - epoch * n, F.lit(n_library))
        if n < n_library:
            start = epoch * n % n_library
            library = library.where(reduce(or_, ((F.col("idx") >= start + k) & (F.col("idx") < start + k + n) for k in (-n_library, 0, n_library) if start + k <= n_library and start + k + n > 0)))
        rounds = F.expr(f"explode(sequence(0, {-(-n // n_library) - 1}))")
        window = library.withColumn("_round", rounds).withColumn("place", place + F.col("_round") * n_library).where(F.col("place") < n).drop("_round")
    else:
        window = library.limit(0).withColumn("place", F.lit(0))
    out = complexes.withColumn("origin", F.lit("complex")).unionByName(window.withColumn("origin", F.lit("library")), allowMissingColumns=True)
    arrays = [c for c, t in out.dtypes if t.startswith("array")]
    return out.withColumns({c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c])) for c in arrays}) if arrays else out


def rebucketed_visits(visits: DataFrame, length: int, new_length: int) -> DataFrame:
    """visits(i, visits) of an epoch of length rows, counted anew by index modulo new_length; every index has a row."""
    each = visits.where("visits > 0").select(F.explode(F.sequence(F.lit(0), (F.col("visits") - 1).cast("long"))).alias("j"), "i").select(F.pmod(F.col("i") + F.col("j") * length, F.lit(new_length)).alias("i"))
    counts = each.groupBy("i").agg(F.count(F.lit(1)).alias("visits"))
    return visits.sparkSession.range(new_length).withColumnRenamed("id", "i").join(counts, "i", "left").fillna(0, ["visits"])


def compact_tag(values: Column, levels: int, groups: int) -> Column:
    """_3 if all values are alike; a part per level; or groups of a level joined by dashes, one value where they are alike. Values count in tenths."""
    tenth = lambda v: F.floor(v * 10 + 1e-9).cast("string")
    same = lambda a: F.size(F.array_distinct(a)) == 1
    part = lambda a: F.when(same(a), tenth(F.get(a, 0))).otherwise(F.array_join(F.transform(a, tenth), "-"))
    by_level = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: part(F.slice(values, i * groups + 1, groups)))
    return (
        F.when(same(values), F.concat(F.lit("_"), tenth(F.get(values, 0))))
        .when(F.size(values) == levels, F.concat(F.lit("_"), F.array_join(F.transform(values, tenth), "_")))
        .when(F.size(values) == levels * groups, F.concat(F.lit("_"), F.array_join(by_level, "_")))
    )


def per_cycle(spark, name: str, value, n_cycles: int) -> DataFrame:
    """(cycle, name): a scalar for every cycle, or a list of the right length."""
    values = list(value) if isinstance(value, (list, tuple)) else [value] * n_cycles
    if len(values) != n_cycles:
        raise ValueError(f"{name} has {len(values)} values for {n_cycles} cycles")
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("cycle", name))
