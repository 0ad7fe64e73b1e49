"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of their keys, without a single-task sort: a range
shuffle, the index inside each partition, and the sums of the partitions' row counts.
A Feistel network over the pair (number div b, number mod b), with modular sums in place
of exclusive-or, permutes [0, a*b); numbers that land beyond the last row walk on along
their cycle. Place p of the shuffled order is shard p mod S, slot p div S: both can be
computed from a row number alone, and inverted.
"""

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, scratch

ROUNDS = 6  # even, so that the halves end where they began
_PRIME, _FACTOR = 2_147_483_647, 1_103_515_245
_INDEX_BITS = 33  # monotonically_increasing_id keeps the index in a partition in its low 33 bits


def feistel_plan(n: int, seed: str) -> dict:
    """Sides a, b >= 1 of the smallest nearly square grid found with a*b >= n, and the rounds' keys."""
    root = max(1, math.isqrt(max(n - 1, 0)) + 1)
    a = min(range(root, root + 1 + min(root, 4096)), key=lambda x: (-n % x, x))
    b = max(1, -(-n // a))
    keys = [[int.from_bytes(hashlib.sha256(f"{seed}:{i}:{j}".encode()).digest()[:4], "big") % _PRIME for j in range(2)] for i in range(ROUNDS)]
    return {"n": n, "a": a, "b": b, "keys": keys}


def permuted(x: Column, plan: dict) -> Column:
    """The place of row number x in the shuffled order of plan['n'] rows.

    At most a*b - n numbers lie outside, so that many steps bring any walk back inside.
    """
    a, b, n = plan["a"], plan["b"], plan["n"]
    rounds = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c"), F.lit(b if i % 2 else a).cast("long").alias("m")) for i, (k, c) in enumerate(plan["keys"])))

    def scrambled(v, key):
        t = ((v + key["k"]) * _FACTOR) % _PRIME
        return (t * t + key["c"]) % _PRIME

    def step(s, key):
        return F.struct(s["r"].alias("l"), ((s["l"] + scrambled(s["r"], key)) % key["m"]).alias("r"))

    def once(v):
        pair = F.struct(((v - v % b) / b).cast("long").alias("l"), (v % b).alias("r"))
        return F.aggregate(rounds, pair, step, lambda s: s["l"] * b + s["r"])

    place = once(x)
    outside = a * b - n
    return F.aggregate(F.sequence(F.lit(1), F.lit(outside)), place, lambda p, _: F.when(p < n, p).otherwise(once(p))) if outside else place


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: str = "shard") -> DataFrame:
    """df with shard (0 to shards - 1) and slot (from 0, without gaps in a shard).

    Shards' counts differ by one at most. order names the columns that fix the row
    numbers; rows that agree in all of them are told apart by their place in the input,
    which changes nothing but which of them comes first. Nulls come first. Columns of df
    that are called shard or slot are replaced. An empty df stays empty.
    """
    df = df.drop("shard", "slot")
    tie, row, part_of, first_of, place_of = free_names(df, "shard tie", "shard row", "shard part", "shard first", "shard place")
    number = F.monotonically_increasing_id()
    # The second number counts sorted rows: partition in the high bits, index in the low ones.
    dealt = df.withColumn(tie, number).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    dealt = scratch(dealt.drop(tie).withColumn(row, number), "shard-rows")
    part = F.shiftright(row, _INDEX_BITS)
    counts = dealt.groupBy(part.alias(part_of)).agg(F.count(F.lit(1)).alias("n"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    first = counts.select(part_of, (F.sum("n").over(Window.orderBy(part_of)) - F.col("n")).alias(first_of))
    place = permuted(F.col(first_of) + F.col(row).bitwiseAND((1 << _INDEX_BITS) - 1), feistel_plan(n, seed))
    # One row per partition of the range shuffle: small whatever the data's size.
    return (
        dealt.join(F.broadcast(first), part == F.col(part_of)).withColumn(place_of, place)
        .select(*(dealt[f"`{c}`"] for c in df.columns), (F.col(place_of) % shards).cast("int").alias("shard"), ((F.col(place_of) - F.col(place_of) % shards) / shards).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: str = "shard") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, and 8), text_crc32, law 'rows', shard, slot, grown_shard (null: only the law of keys has it).

    A null text has no bytes, so size 8 and the checksum of nothing, 0. Null and repeated
    ids are rows like others. Extra columns are ignored. Copies of a text are spread as
    other rows are, as counts at most one apart demand.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shard_rows(rows, shards, ["doc_id", "text_crc32", "size"], seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
