"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Distinct fingerprints go to cells by the population counts of their four 16-bit parts.
Two fingerprints within the radius have counts that differ by no more than it in sum, so
a cell meets only the cells that near; all other tile pairs are skipped. A cell of many
fingerprints is cut into tiles of bounded size. Tile pairs are compared in numpy by
exclusive or and bit counts.
"""

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, scratch, spaced_words
from .components import components

PARTS = 4
_SIDE = 64 // PARTS + 1  # values of a part's population count


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """64 bits: bit i is set if more than half of the shingles' XXH64 (seed 42) have it; repeats count."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(text, 42)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    h = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((h(text[i:j], 42) for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), dtype="<u8", count=n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 16320):  # whole runs of 255 rows, whose sums fit a byte
        bits = np.unpackbits(hashes[at : at + 16320].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash (null text as empty) and fp, a signed 64-bit integer, of every row."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            texts = b.column(2)
            got = np.array([fingerprint(spaced_words(x.as_py()), shingle) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())]))


def spanning_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links (indexes into a, then b, both unsigned) that connect all that pairs within the radius connect; fewer than there are fingerprints.

    same: b is a. Rows of a are compared in blocks, so that memory is bounded, and a link is
    put out only if it joins two groups.
    """
    base = 0 if same else len(a)
    label = np.arange(len(a) if same else len(a) + len(b))
    out = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        close = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        if same:
            close &= np.arange(len(b))[None, :] > np.arange(at, at + len(close))[:, None]
        for r in np.flatnonzero(close.any(axis=1)).tolist():
            groups = np.unique(np.append(label[np.flatnonzero(close[r]) + base], label[at + r]))
            if len(groups) > 1:
                out.extend((int(groups[0]), int(x)) for x in groups[1:])
                label[np.isin(label, groups[1:])] = groups[0]
    return out


def near_links(fps: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """Links (u, v) between distinct fingerprints fps(fp) at radius or fewer differing bits, enough to connect all that such pairs connect."""
    width = 64 // PARTS
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1)) for i in range(PARTS)]
    cell = sum((c * _SIDE**i for i, c in enumerate(counts)), F.lit(0))
    celled = fps.select("fp", cell.alias("cell"))
    # 17^4 cells at most, whatever the number of fingerprints.
    cells = scratch(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("pieces")), "cells")
    tiles = scratch(
        celled.join(F.broadcast(cells), "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), "pieces").alias("piece")).agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles"
    )
    near = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]
    part = [F.floor(F.col("cell") / _SIDE**i).cast("int") % _SIDE for i in range(PARTS)]
    to = F.filter(F.array(*(F.when(
        F.forall(F.array(*(p + x for p, x in zip(part, d, strict=True))), lambda v: v.between(0, _SIDE - 1)), F.col("cell") + sum(x * _SIDE**i for i, x in enumerate(d))
    ) for d in near)), lambda v: v.isNotNull())
    # A pair of tiles, not of cells, is what is dealt out: a cell of many fingerprints spreads over tasks.
    left = tiles.select(F.col("cell").alias("a_cell"), F.col("piece").alias("a_piece"), F.col("fps").alias("a"), F.explode(to).alias("cell")).join(F.broadcast(cells), "cell")
    left = left.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1)).alias("piece")).where("a_cell <> cell or a_piece <= piece")
    pairs = left.join(tiles.withColumn("piece", F.col("piece").cast("long")).withColumnRenamed("fps", "b"), ["cell", "piece"])
    pairs = pairs.select("a", "b", F.expr("a_cell = cell and a_piece = piece").alias("same"))

    def compare(batches):
        for batch in batches:
            a, b, same = (batch.column(i) for i in range(3))
            flat = [(x.values.to_numpy(zero_copy_only=False).view(np.uint64), x.offsets.to_pylist()) for x in (a, b)]
            u, v = [], []
            for i, s in enumerate(same.to_pylist()):
                x, y = (values[at[i] : at[i + 1]] for values, at in flat)
                both = x if s else np.concatenate([x, y])
                for p, q in spanning_links(x, y, s, radius):
                    u.append(both[p])
                    v.append(both[q])
            if u:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.array(w, dtype=np.uint64).view(np.int64)) for w in (u, v))], names=["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def simhash_classes(rows: DataFrame, radius: int = 3) -> DataFrame:
    """rows(doc_id, text_hash, fp) with component_id, the smallest id reachable, and first_hash, the smallest text hash among that id's rows."""
    nodes = scratch(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")), "nodes")
    found = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    classes = named.join(least, "component").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
    return rows.join(classes, "fp")


def simhash_documents(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have
    fingerprint zero and are linked like any other; a text of fewer words than a shingle
    is one shingle. Texts count whole, however long. Repeated ids are rows of their own. A
    null id is never the smallest of a component unless all its ids are null. No rows give
    no rows.
    """
    got = simhash_classes(scratch(fingerprints(docs, shingle), "fingerprints"), radius)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs with one document of each component: the one of the smallest id (then the smallest text hash), one row of it."""
    names = docs.columns
    listed, copy_key = free_names(docs, "listed copy", "copy key")
    got = scratch(simhash_classes(scratch(fingerprints(docs, shingle), "fingerprints"), radius), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    keys = got.groupBy("doc_id", "text_hash").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
    keys = scratch(keys.where("not stays or rows > 1").select(F.struct("doc_id", "text_hash", "stays").alias(listed)), "copies")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    match = docs["doc_id"].eqNullSafe(F.col(f"`{listed}`.doc_id")) & (key == F.col(f"`{listed}`.text_hash"))
    if keys.where(F.col(f"`{listed}`.stays")).isEmpty():
        return docs.join(keys, match, "left_anti")
    once = docs.join(keys.where(F.col(f"`{listed}`.stays")), match).select(*(docs[f"`{c}`"] for c in names)).withColumn(copy_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return docs.join(keys, match, "left_anti").unionByName(once.dropDuplicates(["doc_id", copy_key]).drop(copy_key))
