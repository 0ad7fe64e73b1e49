"""Exact quantiles of groups of any size, by counting instead of sorting.

A number's bits, read as a whole number and turned round below zero, are in its order. Rows are
counted by group and the leading bits of that key; the bucket that holds the wanted rank
is the only one whose rows are counted again, by the next bits, until it holds one value.
Counts are added up before the shuffle, so neither a hot group nor ties gather rows.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import scratch

BITS = 16  # a level tells apart 65,536 buckets of a group


def _keyed(rows: DataFrame) -> DataFrame:
    """grp, value, key of rows(grp, value) whose value is neither null nor NaN."""

    def run(batches):
        for b in batches:
            value = b.column(1).to_numpy(zero_copy_only=False) + 0.0  # one zero instead of two
            bits = value.view(np.int64)
            key = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array(key)], names=["grp", "value", "key"])

    some = rows.where("value is not null and not isnan(value)")
    return some.mapInArrow(run, T.StructType([rows.schema["grp"], T.StructField("value", T.DoubleType()), T.StructField("key", T.LongType())]))


def _same(a: str, b: str, *names: str):
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))


def _ranked(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """grp, nth, value of wanted(grp, nth, rank): the value that has the rank, from 0, among the group's in keyed."""
    open_, found = wanted.withColumn("prefix", F.lit(0).cast("long")), []
    for shift in range(64 - BITS, -1, -BITS):
        first = shift == 64 - BITS
        prefix = F.lit(0).cast("long") if first else F.shiftright("key", shift + BITS)
        counts = keyed.groupBy("grp", prefix.alias("prefix"), F.shiftright("key", shift).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        upto = F.sum("n").over(Window.partitionBy("grp", "prefix").orderBy("bucket"))
        counts = counts.withColumn("end", upto).withColumn("start", F.col("end") - F.col("n"))
        holds = _same("o", "c", "grp", "prefix") & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end"))
        state = open_.alias("o").join(counts.alias("c"), holds).select("o.grp", "nth", (F.col("rank") - F.col("start")).alias("rank"), F.col("bucket").alias("prefix"), "low", "high")
        state = scratch(state, "ranks")
        found.append(state.where("low = high").select("grp", "nth", F.col("low").alias("value")))
        open_ = state.where("low < high").select("grp", "nth", "rank", "prefix")
        if shift == 0 or open_.isEmpty():
            break
        buckets = open_.select("grp", "prefix").distinct()
        inside = keyed.withColumn("prefix", F.shiftright("key", shift)).alias("k").join(buckets.alias("b"), _same("k", "b", "grp", "prefix"), "left_semi")
        keyed = scratch(inside.select("grp", "value", "key"), "inside")  # a bucket's rows
    return reduce(DataFrame.unionByName, found)


def exact_quantiles(rows: DataFrame, qs: list[float], value: str, by: str, at_once: int = 100_000) -> DataFrame:
    """by and quantiles (array, one for each of qs, interpolated) of each group of rows; null for groups without values.

    Null and NaN values are missing. Groups of at most at_once values are aggregated as
    they are, in a buffer of that size; larger ones by counting. Both give the same: what
    percentile gives. A null group is a group.
    """
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    v = F.col(value).cast("double")
    plain = rows.select(F.col(by).alias("grp"), F.when(~F.isnan(v), v).alias("value"))
    sizes = scratch(plain.groupBy("grp").agg(F.count("value").alias("n")), "sizes")
    large = sizes.where(F.col("n") > at_once)
    both = F.percentile("value", F.lit(list(map(float, qs)))).alias("quantiles")
    if large.isEmpty():
        return plain.groupBy("grp").agg(both).withColumnRenamed("grp", by)
    of = lambda part, how: plain.alias("p").join(part.select("grp").alias("s"), _same("p", "s", "grp"), how).select("p.grp", "value")
    small = of(large, "left_anti").groupBy("grp").agg(both)
    keyed = _keyed(of(large, "left_semi"))
    places = F.array(*(F.struct(F.lit(i).alias("nth"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(qs)))
    wanted = scratch(large.select("grp", F.explode(places).alias("p")).select("grp", (2 * F.col("p.nth")).alias("nth"), F.col("p.at").alias("at")), "wanted")
    ends = F.array(F.struct("nth", F.floor("at").alias("rank")), F.struct((F.col("nth") + 1).alias("nth"), F.ceil("at").alias("rank")))
    ranked = _ranked(keyed, wanted.select("grp", F.inline(ends))).withColumn("side", F.col("nth") % 2).withColumn("nth", F.col("nth") - F.col("nth") % 2)
    sides = ranked.groupBy("grp", "nth").agg(*(F.max(F.when(F.col("side") == i, F.col("value"))).alias(c) for i, c in enumerate(("low", "high"))))
    low, high, at = F.col("low"), F.col("high"), F.col("at")
    between = F.when((low == high) | (F.floor(at) == at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    each = wanted.alias("w").join(sides.alias("s"), _same("w", "s", "grp", "nth")).select("w.grp", "w.nth", between.alias("value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]).alias("quantiles")
    return small.unionByName(each.groupBy("grp").agg(listed)).withColumnRenamed("grp", by)
