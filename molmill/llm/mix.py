"""Mixing sources to target weights by nested hash-threshold histograms.

Every document has a 60-bit position, the hash of its id and text. A source's mix takes
each of its documents a whole number of times, and once more those whose position lies
below the source's threshold. The threshold is found without sorting: sums of sizes by
source and leading bits of the position show in which bucket the budget ends; only that
bucket is split again, by the next bits, until it holds one position. Equal rows have one
position; where the budget ends among them, their row numbers are split likewise.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, scratch, size_in_words

BITS, ROW_BITS, LEVEL_BITS = 60, 63, 12
WEIGHTS = (5, 2, 1)


def _position(doc_id, text, seed: str):
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of sizes(source, size): source_size and target.

    Weights repeat over the sources in code-point order, null last. The level at which
    water poured by weight stands, when no source holds more than most times its size,
    is where the sources that are full end, in order of size by weight. The two windows
    run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(list(map(float, weights)))
    src = (
        sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(w, F.col("nth") % len(weights)))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    upto = Window.orderBy("full_at", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    src = (
        src.withColumn("rest", budget * F.sum("source_size").over(everything) - (F.sum("cap").over(upto) - F.col("cap")))
        .withColumn("level", F.col("rest") / (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "nth", "level"))).over(everything)["level"])
    )
    return src.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def _ends(rows: DataFrame, budgets: DataFrame, key: str, amount: Column, bits: int) -> DataFrame:
    """Per source of budgets(source, budget): where the sum of amount over rows(source, key), in order of key, passes the budget.

    at is that key (null: the sum stays within the budget), below the sum before it, inside
    and n the sum and number of the rows that have it.
    """
    zero = {"at": None, "prefix": 0, "below": 0, "inside": 0, "n": 0, "apart": True}
    ends = budgets.select("source", "budget", *(F.lit(v).cast("boolean" if c == "apart" else "long").alias(c) for c, v in zero.items()))
    by_source = Window.partitionBy("source")
    upto = by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = bits
    for left in (*range(bits - LEVEL_BITS, 0, -LEVEL_BITS), 0):
        # Only rows of the bucket in which a source's budget ends.
        same = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright(key, before) == F.col("prefix"))
        hist = rows.withColumn("amount", amount).alias("r").join(ends.alias("e"), same).groupBy("e.source", F.shiftright(key, left).alias("bucket")).agg(
            F.sum("amount").alias("inside"), F.count(F.lit(1)).alias("n"), F.min(key).alias("at"), F.max(key).alias("to"), F.first("budget").alias("budget"), F.first("below").alias("base")
        )
        over = hist.withColumn("below", F.col("base") + F.sum("inside").over(upto) - F.col("inside")).where(F.col("below") + F.col("inside") > F.col("budget"))
        first = over.withColumn("nth", F.row_number().over(by_source.orderBy("bucket"))).where("nth = 1")
        found = first.select("source", "at", F.col("bucket").alias("prefix"), "below", "inside", "n", (F.col("at") != F.col("to")).alias("apart"))
        # A source without such a bucket stays within its budget: its prefix becomes one that no row has.
        ends = scratch(
            ends.select("source", "budget").alias("a").join(found.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
            .select("a.*", "b.at", *(F.coalesce(f"b.{c}", F.lit(v)).alias(c) for c, v in (("prefix", -1), ("below", 0), ("inside", 0), ("n", 0), ("apart", False)))),
            "mix-ends",
        )
        before = left
        if ends.where("apart").isEmpty():
            break
    return ends


def source_thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of rows(source, size, position, row): whole (how often all its documents are taken), at and last.

    Once more are taken those with position below at, and those with position at and row
    below last. Of the two ends around the budget's end the nearer is taken. last is null
    where all or none of the rows at that position are taken: then at says it alone.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = scratch(targets.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    ends = _ends(rows, budgets.where("budget > 0"), "position", F.col("size"), BITS)
    wanted = F.ceil((F.col("budget") - F.col("below")) / (F.col("inside") / F.col("n")) - 0.5)
    ends = ends.where("at is not null").select("source", F.when(wanted < F.col("n"), F.col("at")).otherwise(F.col("at") + 1).alias("at"), wanted.alias("wanted"), "n")
    tied = ends.where("wanted > 0 and wanted < n").select("source", "at", F.col("wanted").alias("budget"))
    last = None
    if not tied.isEmpty():
        equal = rows.alias("r").join(F.broadcast(tied.alias("t")), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("position") == F.col("at")), "left_semi")
        last = _ends(scratch(equal.select("source", "row"), "mix-ties"), tied, "row", F.lit(1), ROW_BITS).select(F.col("source").alias("tied"), F.col("at").alias("last"))
    out = budgets.alias("b").join(ends.alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")), "left").select("b.source", "source_size", "target", "whole", "e.at")
    return out.withColumn("last", F.lit(None).cast("long")) if last is None else out.join(last, F.col("source").eqNullSafe(F.col("tied")) & F.col("at").isNotNull(), "left").drop("tied")


def mix_plan(rows: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of rows(source, size, position, row): source_size, target, whole, at, last."""
    return scratch(source_thresholds(rows, source_targets(rows, weights, budget, most)), "mix-plan")


def _copies(plan: str, position: Column, row: Column) -> Column:
    at, last = F.col(f"{plan}.at"), F.col(f"{plan}.last")
    return F.col(f"{plan}.whole") + F.coalesce((position < at) | ((position == at) & (row < last)), F.lit(False)).cast("long")


def _sized(docs: DataFrame, seed: str, row: Column | None = None) -> DataFrame:
    position = _position(F.col("doc_id"), F.col("text"), seed)
    return docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"), position.alias("position"), (F.monotonically_increasing_id() if row is None else row).alias("row"))


def mix_sizes(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and how often it is taken (copies).

    docs needs doc_id, source and text; other columns, whatever their names, are ignored.
    A null text has size 0 and counts as taken 0 words. A null source is a source of its
    own, the last. A null id counts as the empty text. Rows that agree in id and text are
    shared out one by one, and which of them is taken does not show. So each source's taken
    words miss its target by half a document at most. Texts count whole, however long. No
    rows give no rows. A result's order is not defined; reruns agree, whatever the
    partitions.
    """
    rows = scratch(_sized(docs, seed), "mix-sizes")
    plan = mix_plan(rows, weights, budget, most)
    copies = _copies("p", F.col("position"), F.col("row"))
    return (
        rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row of docs as often as the mix takes it, with its own columns. Same rules as mix_sizes."""
    names, row = docs.columns, F.monotonically_increasing_id()
    planned, numbered, copy = free_names(docs, "mix plan", "mix row", "mix copy")
    plan = mix_plan(scratch(_sized(docs, seed), "mix-sizes"), weights, budget, most)
    if not plan.where("last is not null").isEmpty():
        # Rows that tie are told apart by numbers, which must not change between plan and use: the numbered rows are written.
        docs = scratch(docs.withColumn(numbered, row), "mix-rows")
        row = docs[numbered]
        plan = mix_plan(scratch(_sized(docs, seed, row), "mix-sizes"), weights, budget, most)
    plan = plan.select(F.struct("source", "whole", "at", "last").alias(planned))
    copies = _copies(f"`{planned}`", _position(docs["doc_id"], docs["text"], seed), row)
    return (
        docs.join(plan, docs["source"].eqNullSafe(F.col(f"`{planned}`.source")))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(True), copies.cast("int"))))
        .select(*(docs[f"`{c}`"] for c in names))
    )
