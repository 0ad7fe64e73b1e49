"""Benchmark decontamination by winnowing.

A text's fingerprints are the least hashes of 5-word grams in every window of 9 grams in
a row. A span of 13 words shared by two texts holds such a window, so both texts keep the
same gram at the same place in it. Joined fingerprints are extended word by word, and
count only if the words around agree over 13 words at least. An item of fewer words is
one gram of its own length, and every gram of that length in a text is looked up.

One pass over the texts keeps, for each document, the fingerprints that fall in a bitmap
of fixed size over the items' fingerprints, with the words around them. These few rows
are joined with the items' own.
"""

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, free_names, letter_words, scratch

BITMAP_BITS = 22
_CANDIDATE = pa.struct([("gram_hash", pa.int64()), ("gram", pa.int32()), ("lead", pa.int32()), ("at", pa.int64()), ("around", pa.binary())])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, from the words' hashes; it depends on n."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the last of equals, in each window of grams; none if there is no whole window."""
    if len(grams) < window:
        return np.empty(0, dtype=np.int64)
    seen = sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(window - 1, len(grams)) - seen.argmin(axis=1))


def _around(words: list[bytes], at: int, gram: int, span: int) -> tuple[int, bytes]:
    first = max(0, at - (span - gram))
    return at - first, b" ".join(words[first : at + span])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def item_fingerprints(items: DataFrame, span: int = 13, gram: int = 5) -> DataFrame:
    """gram_hash, gram, lead, around, items_key and items: the distinct fingerprints of items(item_id, text) and who has each."""

    def run(batches):
        for ids, texts in arrow_rows(batches, "item", "text"):
            out = []
            for item, text in zip(ids, texts, strict=True):
                words = letter_words(text)
                n = len(words)
                size = gram if n >= span else n
                grams = gram_hashes(_word_hashes(words), size) if n else ()
                for at in winnowed(grams, span - gram + 1).tolist() if n >= span else range(min(n, 1)):
                    lead, around = _around(words, at, size, span if n >= span else n)
                    out.append((int(grams[at].view(np.int64)), size, lead, around, item))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)],
                    names=["gram_hash", "gram", "lead", "around", "item"],
                )

    # Ids are marked, so that items without one are told from them.
    rows = items.select(F.coalesce(F.concat(F.lit("i"), F.col("item_id").cast("string")), F.lit("n")).alias("item"), "text")
    rows = rows.mapInArrow(run, "gram_hash long, gram int, lead int, around binary, item string")
    sets = rows.groupBy("gram_hash", "gram", "lead", "around").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return sets.withColumn("items_key", F.sha2(F.concat_ws(",", "items"), 256))


def candidates(docs: DataFrame, marks: np.ndarray, short: list[int], span: int = 13, gram: int = 5) -> DataFrame:
    """doc_id, text_hash, row, n_words and, as found, the fingerprints whose bit in marks is set.

    short: the lengths of items of fewer than span words; for each, all grams are looked up.
    """
    kind = docs.schema["doc_id"].dataType
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(marks, bitorder="little"))  # of fixed size

    def run(batches):
        bitmap = bits.value
        for b in batches:
            counts, found = [], []
            for x in b.column(3):
                words = letter_words(x.as_py())
                counts.append(len(words))
                hashes = _word_hashes(words)
                kept = []
                for size in {gram, *short}:
                    grams = gram_hashes(hashes, size)
                    at = np.arange(len(grams)) if size in short else winnowed(grams, span - gram + 1)
                    if len(at):
                        slot = grams[at] & np.uint64((1 << BITMAP_BITS) - 1)
                        hit = at[(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                        for p in hit.tolist():
                            lead, around = _around(words, p, size, span)
                            kept.append({"gram_hash": int(grams[p].view(np.int64)), "gram": size, "lead": lead, "at": p, "around": around})
                found.append(kept)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, type=pa.int64()), pa.array(found, type=pa.list_(_CANDIDATE))], names=["doc_id", "text_hash", "row", "n_words", "found"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("text_hash", "row", "n_words"))])
    found = T.StructType.fromDDL("found array<struct<gram_hash: long, gram: int, lead: int, at: long, around: binary>>")
    return rows.mapInArrow(run, T.StructType([*out, *found]))


def _extended(batches, span: int):
    """Joined fingerprints with the run of equal words around each: how many words before and from its place on; only runs long enough stay."""
    names = ["gram_hash", "gram", "lead", "around", "items_key"]
    for batch in batches:
        kept, left_of, right_of = [], [], []
        each = next(arrow_rows([batch], "gram", "lead", "around", "item_lead", "item_around"))
        for row, (g, a, x, b, y) in enumerate(zip(*each, strict=True)):
            x, y = x.split(b" "), y.split(b" ")
            if x[a : a + g] != y[b : b + g]:
                continue
            left, right = 0, g
            # An item that is one gram ends where its gram ends, so nothing is gained beyond it.
            while left < min(a, b) and x[a - left - 1] == y[b - left - 1]:
                left += 1
            while a + right < len(x) and b + right < len(y) and x[a + right] == y[b + right]:
                right += 1
            if left + right >= min(span, len(y)):
                kept.append(row)
                left_of.append(left)
                right_of.append(right)
        if kept:
            some = batch.select(names).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(left_of, type=pa.int64()), pa.array(right_of, type=pa.int64())], names=[*names, "left", "right"])


def _ids(items: Column) -> Column:
    return F.transform(F.filter(items, lambda i: F.startswith(i, F.lit("i"))), lambda i: F.substring(i, 2, 1 << 30))


def _verdicts(docs: DataFrame, items: DataFrame, span: int, gram: int, share: int) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    marks_of = scratch(item_fingerprints(items, span, gram), "items")
    slots = marks_of.select(F.col("gram_hash").bitwiseAND((1 << BITMAP_BITS) - 1).alias("slot")).distinct().toPandas()["slot"].to_numpy()  # 2^22 at most
    marks = np.zeros(1 << BITMAP_BITS, dtype=bool)
    marks[slots.astype(np.int64)] = True
    short = sorted(r[0] for r in marks_of.where(F.col("lead") == 0).select("gram", F.size(F.split(F.col("around").cast("string"), " ")).alias("n")).where(f"gram = n and n < {span}").select("gram").distinct().collect())
    base = scratch(candidates(docs, marks, short, span, gram), "candidates")
    each = base.where(F.size("found") > 0).select("row", F.inline("found"))
    ours = marks_of.select("gram_hash", "gram", F.col("lead").alias("item_lead"), F.col("around").alias("item_around"), "items_key")
    # Each different fingerprint with its words around is extended once, however many documents share it.
    keys = ["gram_hash", "gram", "lead", "around"]
    found = each.select(*keys).distinct().join(ours, ["gram_hash", "gram"]).mapInArrow(
        lambda batches: _extended(batches, span), "gram_hash long, gram int, lead int, around binary, items_key string, left long, right long"
    )
    hits = each.join(scratch(found, "extended"), keys).select("row", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right")).alias("end"), "items_key")
    hits = scratch(hits.distinct(), "hits")
    words = hits.select("row", F.explode(F.sequence("first", F.col("end") - 1)).alias("word")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    sets = marks_of.select("items_key", "items").dropDuplicates(["items_key"])
    named = (
        hits.select("row", "items_key").distinct().join(sets, "items_key").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("row", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", _ids(F.col("items"))), 256).alias("items_sha256"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        base.select("doc_id", "text_hash", "row", "n_words").join(words, "row", "left").join(named, "row", "left")
        .select(
            "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, gram: int = 5, share: int = 20) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any run of span words that an item of items(item_id, text) has too
    (inside the whole item, if that is shorter); a document is contaminated if it has a hit
    and one word in share or more is hit. Null and empty texts have no words and hit
    nothing; items without words match nothing. Items without an id hit words like others;
    together they count as one item in n_items, and have no part in items_sha256. Repeated
    ids, of documents or items, keep their rows apart, and an id counts once. Texts count
    whole, however long. Without documents there are no rows, without items no hits. Other
    columns are ignored.
    """
    return _verdicts(docs, items, span, gram, share).drop("text_hash")


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = 13, gram: int = 5, share: int = 20) -> DataFrame:
    """docs without the contaminated rows."""
    bad = _verdicts(docs, items, span, gram, share).where("contaminated").select("doc_id", "text_hash").distinct()
    (hit,) = free_names(docs, "hit row")
    bad = scratch(bad.select(F.struct("doc_id", "text_hash").alias(hit)), "contaminated")
    match = docs["doc_id"].eqNullSafe(F.col(f"`{hit}`.doc_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f"`{hit}`.text_hash"))
    return docs.join(bad, match, "left_anti")
