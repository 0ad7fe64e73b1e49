"""Preference formatting of chat data.

A pair is a chosen and a rejected conversation. The turns on which both agree from the
start are rendered once, as the prompt; the rest of each is its completion, with the
spans of characters on which a model is to be trained: what the assistant says, up to and
with the end mark.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SHUT))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _spans(turns: Column, role: str) -> Column:
    """Start and end, in characters from 0, of the trained part of each turn of the role."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def add(s, t):
        first = s["at"] + F.length(_head(t))
        last = first + F.length(t["text"]) + len(END)
        spans = F.when(t["role"] == role, F.concat(s["spans"], F.array(F.struct(first.alias("first"), last.alias("last"))))).otherwise(s["spans"])
        return F.struct(last.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, add, lambda s: s["spans"])


def preference_pairs(conversations: DataFrame, pair: Column, rejected: Column, trained_role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, n_prefix (turns), prompt, chosen, rejected, chosen_spans, rejected_spans, differs.

    conversations needs turn, role and text, and what pair and rejected are made of: pair
    says to which pair a row belongs, rejected on which side it is. Turns are in order of
    turn, nulls first, ties by role and text. Null roles and texts count as empty, repeated
    rows as turns. Rows whose pair or side is null belong to no pair. A pair that lacks a
    side has no common prefix, and null for that side's completion and spans. differs tells
    pairs that state a preference, with two completions that are not the same; the others keep
    their row. A pair is one training example, so one task holds it, however long its texts. No rows give no rows.
    """
    rows = conversations.select(
        pair.alias("pair_id"), rejected.alias("side"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said")
    ).where("pair_id is not null and side is not null")
    both = rows.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(s, F.col("said")))).alias(n) for n, s in (("c", ~F.col("side")), ("r", F.col("side")))))
    shared = F.least(F.size("c"), F.size("r"))
    n = F.when(shared == 0, 0).otherwise(F.aggregate(
        F.sequence(F.lit(0), shared - 1), F.lit(0),
        lambda k, i: F.when((k == i) & (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"]), k + 1).otherwise(k),
    ))
    both = both.withColumn("n", n)
    rest = {s: F.slice(F.col(s), F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in "cr"}
    there = lambda s, x: F.when(F.size(s) > 0, x)
    made = both.select(
        "pair_id", F.col("n").cast("long").alias("n_prefix"), _rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        there("c", _rendered(rest["c"])).alias("chosen"), there("r", _rendered(rest["r"])).alias("rejected"),
        there("c", _spans(rest["c"], trained_role)).alias("chosen_spans"), there("r", _spans(rest["r"], trained_role)).alias("rejected_spans"),
    )
    return made.withColumn("differs", F.coalesce(F.col("chosen") != F.col("rejected"), F.lit(False)))
