"""Quality classifier: naive Bayes log-count ratios as features of a linear support vector machine.

A text's features are indicators of n-grams: of byte classes (letters by case, digits,
each sign and kind of white space, bytes beyond ASCII), of words, and of whether words
repeat the word before; all are hashed to a fixed number of slots. Each indicator is
scaled by the log ratio of its smoothed counts in the two classes, each text to equal
length, and a hinge-loss model is fitted by dual coordinate descent.

The fit runs in one task over at most about max_fit_rows labelled rows, chosen by a hash
of their ids; the model is one array of fixed size. Every row is scored, whole.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, scratch

SLOT_BITS = 18
MAX_FIT_ROWS = 10_000
_CLASS = np.array([1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 5 + c % 59 for c in range(256)], dtype=np.uint32)


def _slots(codes: np.ndarray, kind: int) -> np.ndarray:
    """Hashed slots of integer codes; kind tells n-grams of different sorts apart."""
    mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xC2B2AE3D27D4EB4F % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def feature_slots(text: str | None) -> np.ndarray:
    """The slots of all n-grams of the text, with repeats."""
    data = (text or "").encode()
    found = []
    codes = _CLASS[np.frombuffer(data, dtype=np.uint8)]
    grams = codes
    for n in range(2, 5):
        if len(codes) < n:
            break
        grams = (grams[:-1] << np.uint32(6)) | codes[n - 1 :]
        found.append(_slots(grams, n))
    words = data.lower().split()
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    found.append(_slots(hashes, 11))
    if len(words) > 1:
        found.append(_slots(hashes[:-1] * np.uint64(0x100000001B3) ^ hashes[1:], 12))
        again = (hashes[1:] == hashes[:-1]).astype(np.uint64)
        found.extend(_slots(sum((again[i : len(again) - n + 1 + i] << np.uint64(i) for i in range(n)), np.uint64(0)), 20 + n) for n in range(1, 5) if len(again) >= n)
    return np.concatenate(found)


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log of the slots' smoothed shares of the indicators of the good rows over those of the others."""
    counts = np.ones((2, 1 << SLOT_BITS))
    for x, y in zip(rows, good, strict=True):
        counts[int(y), x] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, the last one the constant's, of the hinge-loss model with an L2 penalty; the rows' dual variables and their upper bounds.

    Rows of the rarer class weigh as much in all as those of the other, up to fourfold each.
    """
    y = np.where(good, 1.0, -1.0)
    share = good.mean()
    upper = c * np.where(good, min(4.0, max(1.0, (1 - share) / max(share, 1e-9))), min(4.0, max(1.0, share / max(1 - share, 1e-9))))
    w = np.zeros((1 << SLOT_BITS) + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, alpha, upper


def fit_weights(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Per slot its weight times its ratio, and the constant; all zero if only one class is there."""
    if not len(rows) or good.all() or not good.any():
        return np.zeros((1 << SLOT_BITS) + 1, dtype=np.float32)
    ratios = log_count_ratios(rows, good)
    w, *_ = dual_coordinate_descent(rows, [ratios[x] / np.sqrt(len(x) or 1) for x in rows], good)
    w[:-1] *= ratios
    return w.astype(np.float32)


class Scorer:
    """Scores texts with one scratch array of indicators."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.constant, self.seen = weights[:-1], float(weights[-1]), np.zeros(len(weights) - 1, dtype=bool)

    def score(self, text: str | None) -> float:
        slots = feature_slots(text)
        self.seen[slots] = True
        found = np.unique(slots) if len(slots) < 200 else np.flatnonzero(self.seen)
        self.seen[slots] = False
        margin = float(self.weights[found].sum()) / max(len(found), 1) ** 0.5 + self.constant
        return 1.0 / (1.0 + float(np.exp(-2.0 * margin)))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 3) == 1


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> np.ndarray:
    """Weights learnt from labels(doc_id, quality) of rows that are not held out.

    Labels of one id are averaged, half and more counting as good; null labels and ids
    are ignored. All labelled ids count up to max_fit_rows; beyond, those whose hash lies
    below the share that leaves about so many. Rows that agree in id and text count once; if
    ids have so many different texts that there are twice max_fit_rows rows, those are cut likewise.
    """
    ids = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    n = ids.count()
    if n > max_fit_rows:
        ids = ids.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40)) < int((1 << 40) * max_fit_rows / n))
    # About max_fit_rows ids at most, so small.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = scratch(rows.select("text", "good", F.xxhash64("doc_id", "text", F.lit("fit")).alias("place")), "fit-rows")
    n = rows.count()
    if n > 2 * max_fit_rows:
        rows = rows.where(F.pmod("place", F.lit(1 << 40)) < int((1 << 40) * max_fit_rows / n))
    rows = rows.select("text", "good")

    def features(batches):
        for b in batches:
            found = [np.unique(feature_slots(x.as_py())).astype(np.int32) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.list_(pa.int32())), b.column(1)], names=["slots", "good"])

    def train(batches):
        rows, good = [], []
        for b in batches:
            slots = b.column(0)
            flat, at = slots.values.to_numpy(), slots.offsets.to_pylist()
            rows.extend(flat[i:j].copy() for i, j in zip(at, at[1:]))
            good.extend(b.column(1).to_pylist())
        # One order whatever the tasks' order, for equal models.
        order = sorted(range(len(rows)), key=lambda i: (good[i], len(rows[i]), rows[i].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([fit_weights([rows[i] for i in order], np.array([good[i] for i in order], dtype=bool)).tobytes()])], names=["weights"])

    model = rows.mapInArrow(features, "slots array<int>, good boolean").repartition(1).mapInArrow(train, "weights binary").collect()
    return np.frombuffer(model[0][0], dtype=np.float32) if model else np.zeros((1 << SLOT_BITS) + 1, dtype=np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score (0 to 1, higher: quality 1 is likelier), predicted.

    Only the text decides a score; null counts as the empty text. Repeated ids and texts
    get equal scores. A null id is not held out, as it never has a label. Without labels of
    both classes every score is 0.5. Texts count whole, however long. No rows give no rows.
    Other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_fit_rows))  # of fixed size
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        scorer = Scorer(weights.value)
        for b in batches:
            scores = np.array([scorer.score(x.as_py()) for x in b.column(2)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")) & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("held_out boolean, score double, predicted int")]))


def drop_low_quality(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of docs that are predicted to be of quality 1, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_fit_rows))  # of fixed size

    def run(batches):
        scorer = Scorer(weights.value)
        for b in batches:
            texts = b.column(b.schema.names.index("text"))
            yield b.filter(pa.array([scorer.score(x.as_py()) >= 0.5 for x in texts], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
