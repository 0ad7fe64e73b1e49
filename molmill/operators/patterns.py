"""Screens of texts by catalogs of patterns, all patterns in one pass.

The patterns of a block of the catalog become one automaton (Aho and Corasick's): a table
of next states by state and byte, in which failure links are already followed, and for
each state the first pattern, in catalog order, that ends there. Texts are cut into
overlapping pieces, and many pieces step through the table together in numpy, so a text
costs its length, whatever the number of patterns.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import scratch

BLOCK_BYTES = 60_000  # of patterns in an automaton, whose table then has 62 MB at most
PIECE, TOGETHER = 512, 16_384
STEPS = 16  # blocks of a catalog that look at the rows before these are written
NONE = np.iinfo(np.int32).max


class Automaton:
    """The patterns, in order; numbers of patterns stand for them."""

    def __init__(self, patterns: list[bytes]):
        used = sorted(set(b"".join(patterns)))
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)  # 0 stands for every byte that no pattern has
        self.width, self.longest = len(used) + 1, max(map(len, patterns), default=0)
        children: list[dict[int, int]] = [{}]
        first = [NONE]
        for number, pattern in enumerate(patterns):
            at = 0
            for s in self.symbol[list(pattern)].tolist():
                if s not in children[at]:
                    children[at][s] = len(children)
                    children.append({})
                    first.append(NONE)
                at = children[at][s]
            first[at] = min(first[at], number)
        self.next = np.zeros((len(children), self.width), dtype=np.int32)
        self.first = np.array(first, dtype=np.int32)
        fail = np.zeros(len(children), dtype=np.int64)
        level = [0]
        while level:
            below = []
            for at in level:
                if at:
                    self.next[at] = self.next[fail[at]]
                    self.first[at] = min(self.first[at], self.first[fail[at]])
                for s, child in children[at].items():
                    fail[child] = self.next[at, s] if at else 0
                    self.next[at, s] = child
                    below.append(child)
            level = below
        self.flat = self.next.ravel()

    def first_hits(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each text (bytes of data from start) the number of the first pattern, in order, that it contains; NONE without."""
        best = np.full(len(start), self.first[0], dtype=np.int32)
        overlap = max(0, self.longest - 1)
        pieces = np.maximum(1, -(-np.maximum(length - overlap, 0) // PIECE))
        text = np.repeat(np.arange(len(start)), pieces)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        begin, size = start[text] + offset, np.minimum(PIECE + overlap, length[text] - offset)
        for at in range(0, len(text), TOGETHER):
            part = slice(at, at + TOGETHER)
            by = np.argsort(-size[part], kind="stable")
            b, n = begin[part][by], size[part][by]
            state, found = np.zeros(len(b), dtype=np.int64), np.full(len(b), NONE, dtype=np.int32)
            active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right") if len(n) else []
            for k, m in enumerate(active):
                state[:m] = self.flat[state[:m] * self.width + self.symbol[data[b[:m] + k]]]
                np.minimum(found[:m], self.first[state[:m]], out=found[:m])
            np.minimum.at(best, text[part][by], found)
        return best


def catalog_blocks(catalog: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[bytes], list, list]]:
    """(patterns, ord, reg_id) of catalog(ord, reg_id, pattern) by ord, then reg_id, then pattern, a block of about block_bytes at a time on the driver."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    first = catalog.where("pattern is not null and ord is not null").groupBy("pattern").agg(F.min(F.struct("ord", "reg_id")).alias("first"))  # of equal patterns only the first can hit first
    for ord_, reg_id, pattern in first.select("first.ord", "first.reg_id", "pattern").orderBy("ord", "reg_id", "pattern").toLocalIterator():
        pattern = pattern.encode()
        if held[0] and size + len(pattern) > block_bytes:
            yield held
            held, size = ([], [], []), 0
        for x, v in zip(held, (pattern, ord_, reg_id), strict=True):
            x.append(v)
        size += len(pattern)
    if held[0]:
        yield held


def with_first_hit(rows: DataFrame, catalog: DataFrame, text: str, hit_ord: str = "ord", hit_id: str = "reg_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with hit_ord and hit_id of the first pattern of catalog(ord, reg_id, pattern), in order, that text contains; null without one.

    There is no join and no exchange of rows. A catalog goes through the driver in blocks, each of which is sent to the
    tasks as one automaton; since blocks come in order, a later one looks only at rows without a
    hit. After every STEPS blocks the rows are written, so that no plan grows with the catalog. Null texts, and patterns that are null or have a null ord, hit nothing; an empty pattern is in every text.
    """
    kinds = {f.name: f.dataType for f in catalog.schema}
    schema = T.StructType([*rows.schema.fields, T.StructField(hit_ord, kinds["ord"]), T.StructField(hit_id, kinds["reg_id"])])
    out = rows.withColumns({hit_ord: F.lit(None).cast(kinds["ord"]), hit_id: F.lit(None).cast(kinds["reg_id"])})
    column, sent = rows.columns.index(text), rows.sparkSession.sparkContext.broadcast

    def step(shared):
        def run(batches):
            automaton, ords, ids = shared.value
            for b in batches:
                texts = b.column(column)
                if pa.types.is_large_string(texts.type):
                    texts = texts.cast(pa.string())
                hits = b.columns[-2:]
                look = np.flatnonzero(pc.and_(texts.is_valid(), hits[0].is_null()).to_numpy(zero_copy_only=False))
                _, offsets, data = texts.buffers()
                offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
                hit = automaton.first_hits(data, offsets[look], np.diff(offsets)[look])
                new = np.full(len(texts), len(ords))
                new[look[hit != NONE]] = hit[hit != NONE]
                place = pa.array(new, mask=new == len(ords))
                merged = [pc.coalesce(had, pa.array(x, type=had.type).take(place)) for x, had in ((ords, hits[0]), (ids, hits[1]))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *merged], schema=b.schema)

        return run

    for n, (patterns, ords, ids) in enumerate(catalog_blocks(catalog, block_bytes), 1):
        out = out.mapInArrow(step(sent((Automaton(patterns), ords, ids))), schema)
        if n % STEPS == 0:
            out = scratch(out, "hits")
    return out


def pattern_hits(rows: DataFrame, catalog: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key and the first pattern of catalog(ord, reg_id, pattern), in its order, that a text of the key contains."""
    hits = with_first_hit(rows.select(F.col(key), F.col(text).alias("text")), catalog, "text", "ord", "reg_id", block_bytes)
    return hits.where("ord is not null").groupBy(key).agg(F.min_by("reg_id", "ord").alias("reg_id"))
