"""Alignment of two tokenizers' tokens of the same texts.

Both split the same bytes. A place where a token of either ends is a shared cut. The cuts
are found by divide and conquer: every open interval looks for a common end near its
middle, by bisecting the other side's ends, and is split there; an interval without one
is a group. All intervals of many texts are worked on together, level by level.

How often a pair of ids is linked in the corpus needs all texts, so texts are encoded
once, in packs: a pack is a row with the results of its texts, its different id pairs, and
which of them each text has how often. Pairs' counts are summed over the packs, and each
pack gets those of its own pairs back; no task holds the pairs of the corpus.
"""

import json
import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch
from .tokens import _pattern, encode_whole

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
BATCH = 1 << 20  # characters of texts that are aligned together
PACK = 12 << 20  # characters of texts in a pack; a longer text is a pack of its own
KNOWN = 400_000  # words whose pieces a task remembers
SPACE = "▁"


def read_byte_vocabulary(path: str) -> dict[bytes, int]:
    """Bytes to id of a byte-level BPE whose ids follow its merges; special tokens are left out.

    In the file a byte stands as itself if it is a printing character of Latin-1, and else
    as one of the characters from 256 on, in order.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    special = {t["content"] for t in data["added_tokens"]}
    vocabulary, merges = data["model"]["vocab"], data["model"]["merges"]
    pairs = ("".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges)
    if any(vocabulary[pair] != 256 + i for i, pair in enumerate(pairs)):
        raise ValueError("the ids of the vocabulary do not follow its merges")
    return {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in special}


class Pieces:
    """The second tokenizer. Words between spaces are encoded once while they are remembered.

    No piece of the vocabulary holds a space after another character, so no merge
    crosses a word's beginning; if one does, texts are encoded whole.
    """

    def __init__(self, model: bytes, known: int = KNOWN):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.split = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in pieces)
        self.most, self.known = known, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.split:
            return self.model.encode(texts, num_threads=1)
        words = [re.findall(" +[^ ]*", f" {t}") if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        new = list({w for one in words for w in one if w not in self.known})
        # The model adds a space of its own, but not to nothing.
        self.known.update(zip(new, self.model.encode([w[1:] for w in new], num_threads=1), strict=True))
        self.known[" "] = [self.model.piece_to_id(SPACE)]
        out = [list(chain.from_iterable(map(self.known.__getitem__, one))) for one in words]
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return out


def _ragged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of start, start + 1, ... of the given lengths, and which of them each belongs to."""
    length = np.maximum(length, 0)
    owner = np.repeat(np.arange(len(start)), length)
    return start[owner] + np.arange(len(owner)) - (np.cumsum(length) - length)[owner], owner


def _is_end(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether at is among the sorted ends; at never exceeds the last."""
    return ends[np.searchsorted(ends, at)] == at


def _near_middle(a_ends: np.ndarray, b_ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval of tokens low to high (exclusive) one whose end is shared, the nearest to the middle by doubling rings; -1 without any."""
    middle = (low + high) // 2
    found = np.where(_is_end(b_ends, a_ends[middle]), middle, -1)
    inner, outer = 0, 1
    left = np.flatnonzero((found < 0) & (high - low > 1))
    while len(left):
        lo, hi, mid = low[left], high[left], middle[left]
        before, after = np.maximum(lo, mid - outer), np.maximum(mid + inner + 1, lo)
        at, owner = _ragged(np.concatenate([before, after]), np.concatenate([mid - inner - before, np.minimum(hi, mid + outer + 1) - after]))
        hit = _is_end(b_ends, a_ends[at])
        at, owner = at[hit], owner[hit] % len(left)
        order = np.lexsort((np.abs(at - mid[owner]), owner))
        owner, first = np.unique(owner[order], return_index=True)
        found[left[owner]] = at[order][first]
        inner, outer = outer, 2 * outer
        left = left[(found[left] < 0) & ((mid - inner > lo) | (mid + inner + 1 < hi))]
    return found


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tokens of the first side, in order, at whose ends the second side has an end too.

    first and last: the first side's tokens at which texts begin and after which they end; a text's end is shared.
    """
    low, high = first, last
    cuts = [last - 1]
    while len(low):
        several = high - low > 1
        low, high = low[several], high[several]
        cut = _near_middle(a_ends, b_ends, low, high - 1) if len(low) else low
        low, high, cut = low[cut >= 0], high[cut >= 0], cut[cut >= 0]
        cuts.append(cut)
        low, high = np.stack([low, cut + 1], 1).ravel(), np.stack([cut + 1, high], 1).ravel()
    return np.sort(np.concatenate(cuts))


class Aligner:
    """Both tokenizers, and what they make of a batch of texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        import tiktoken

        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = Pieces(model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.a_bytes[i] = word
        self.a_size, self.b_size = len(self.a_bytes), self.b.size
        if self.a_size * self.b_size >= 1 << 32:
            raise ValueError("pairs of these vocabularies do not fit 32 bits")
        self.a_length, self.b_length = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b.bytes))
        # For the written form: every id with the mark that stands before it.
        self.marked = np.array([f"{mark}{i}" for mark, n in ((",", self.a_size), (";", self.a_size), (",", self.b_size), ("|", self.b_size)) for i in range(n)], dtype=object)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where a text is null or empty, or where a side's bytes are not a space and the text."""
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts]), strict=True):
            a = encode_whole(self.a, f" {text}") if text else []
            whole = f" {text}".encode()
            same = bool(text) and b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b.bytes.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out

    def align(self, encoded: list[tuple[list[int], list[int]]]) -> "Alignment":
        return Alignment(self, encoded)


class Alignment:
    """The tokens of a batch of texts, one after the other, and their groups."""

    def __init__(self, aligner: Aligner, encoded):
        self.aligner = aligner
        self.n_a, self.n_b = (np.array([len(x[side]) for x in encoded], dtype=np.int64) for side in (0, 1))
        self.a, self.b = (np.fromiter(chain.from_iterable(x[side] for x in encoded), np.int64, int(n.sum())) for side, n in ((0, self.n_a), (1, self.n_b)))
        self.a_stop, self.b_stop = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.a_ends, self.b_ends = np.cumsum(aligner.a_length[self.a]), np.cumsum(aligner.b_length[self.b])
        some = self.n_a > 0
        last = self.a_stop[some]
        self.a_cut = shared_cuts(self.a_ends, self.b_ends, last - self.n_a[some], last) if len(last) else last
        self.b_cut = np.searchsorted(self.b_ends, self.a_ends[self.a_cut]) if len(last) else last
        self.n_groups = np.diff(np.searchsorted(self.a_cut, self.a_stop), prepend=0)
        self.n_links = self.n_a + self.n_b - self.n_groups

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, pair) of every link; a pair is the first side's id times the second's number of ids, plus the second's id.

        Tokens that overlap do so in one stretch between two ends of either side, and every
        such stretch is a link: one ends with each token of the first side, and with each of
        the second that does not end a group.
        """
        if not len(self.a):
            return self.a, self.a
        over_a = np.searchsorted(self.b_ends, self.a_ends)
        rest = np.ones(len(self.b), dtype=bool)
        rest[self.b_cut] = False
        rest = np.flatnonzero(rest)
        under_b = np.searchsorted(self.a_ends, self.b_ends[rest])
        text = np.arange(len(self.n_a))
        pairs = np.concatenate([self.a * self.aligner.b_size + self.b[over_a], self.a[under_b] * self.aligner.b_size + self.b[rest]])
        return np.concatenate([np.repeat(text, self.n_a), np.searchsorted(self.b_stop, rest, side="right")]), pairs

    def written(self) -> list[str]:
        """Each text's groups: ids joined by commas, a bar between the sides, a semicolon between groups."""
        a_size = np.diff(self.a_cut, prepend=-1)
        b_size = np.diff(self.b_cut, prepend=-1)
        a_code, b_code = self.a.copy(), self.b + 2 * self.aligner.a_size
        a_code[self.a_cut - a_size + 1] += self.aligner.a_size
        b_code[self.b_cut - b_size + 1] += self.aligner.b_size
        line = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        line[np.arange(len(self.a)) + np.repeat(self.b_cut - b_size + 1, a_size)] = a_code
        line[np.arange(len(self.b)) + np.repeat(self.a_cut + 1, b_size)] = b_code
        stop = self.a_stop + self.b_stop
        return ["".join(self.aligner.marked[line[s - n : s]].tolist())[1:] for s, n in zip(stop, self.n_a + self.n_b, strict=True)]


def _shared_aligner(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, pattern: str | None):
    """A function that makes the aligner in a task; what it needs has the vocabularies' size."""
    with open(tokenizer_b, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((read_byte_vocabulary(tokenizer_a), pattern or _pattern(), f.read()))
    return lambda: Aligner(*shared.value)


def _in_batches(batches, size: int):
    """(ids as an Arrow array, texts) of at most size characters, or of one longer text."""
    for b in batches:
        texts = b.column(1).to_pylist()
        at, held = 0, 0
        for i, t in enumerate(texts):
            n = len(t or "")
            if i > at and held + n > size:
                yield b.column(0).slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += n
        if at < len(texts):
            yield b.column(0).slice(at), texts[at:]


def aligned_tokens(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, pattern: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, a_ids, b_ids, a_cuts, b_cuts.

    A cut is the number of a side's tokens up to the end of a group; the n-th cuts of both
    sides belong together. Texts that are null or empty, or of which a tokenizer's tokens do
    not give back a space and the text, have no tokens. Texts are encoded whole, however
    long: a task holds about a hundred bytes for a byte of the longest. Repeated rows are
    rows of their own; other columns are ignored; no rows give no rows.
    """
    make = _shared_aligner(docs, tokenizer_a, tokenizer_b, pattern)
    names = ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"]

    def run(batches):
        aligner = make()
        lists = lambda values, stop: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(values, pa.int64()))
        for ids, texts in _in_batches(batches, BATCH):
            got = aligner.align(aligner.encode(texts))
            group_stop = np.cumsum(got.n_groups)
            cut = lambda cuts, stop, n: cuts + 1 - np.repeat(stop - n, got.n_groups)  # noqa: B023, E731
            sides = [lists(got.a, got.a_stop), lists(got.b, got.b_stop), lists(cut(got.a_cut, got.a_stop, got.n_a), group_stop), lists(cut(got.b_cut, got.b_stop, got.n_b), group_stop)]
            yield pa.RecordBatch.from_arrays([ids, *sides], names=names)

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.ArrayType(T.LongType())) for n in names[1:])]))


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte in planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unsqueezed(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Pack:
    """What is held of texts until they fill a row."""

    def __init__(self):
        self.ids, self.rows, self.text, self.pair, self.times, self.n, self.size = [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, got: Alignment, size: int) -> None:
        self.ids.append(ids)
        written = [sha256(w.encode()).hexdigest() if w else "" for w in got.written()]
        self.rows.append((got.n_a, got.n_b, got.n_groups, got.n_links, written))
        text, pair = got.links()
        key, times = np.unique((text + self.n) << 32 | pair, return_counts=True)
        self.text.append(key >> 32)
        self.pair.append(key & 0xFFFFFFFF)
        self.times.append(times)
        self.n, self.size = self.n + len(got.n_a), self.size + size

    def row(self, number: int) -> list[pa.Array]:
        text, pair, times = (np.concatenate(x) for x in (self.text, self.pair, self.times))
        pairs = np.unique(pair)
        at = np.searchsorted(pairs, pair)
        linked = np.bincount(at, times, len(pairs)).astype(np.int64)
        step = np.diff(at, prepend=0)
        begins = np.flatnonzero(np.diff(text, prepend=-1))
        step[begins] = at[begins]  # each text's pairs ascend
        held = [np.bincount(text, minlength=self.n), step, times]
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        ids = pa.concat_arrays(self.ids)
        counts = [one(np.concatenate([r[i] for r in self.rows]), pa.int64()) for i in range(4)]
        return [
            pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *counts, one(list(chain.from_iterable(r[4] for r in self.rows)), pa.string()),
            *(pa.array([_squeezed(x)], pa.binary()) for x in held), pa.array([_squeezed(np.diff(pairs, prepend=0))], pa.binary()), pa.array([_squeezed(linked)], pa.binary()),
        ]


def _packs(docs: DataFrame, make) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    longs = ("n_a", "n_b", "n_groups", "n_links")
    fields = [("pack", T.LongType()), ("doc_id", T.ArrayType(kind)), *((c, T.ArrayType(T.LongType())) for c in longs), ("groups", T.ArrayType(T.StringType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in [*fields, *((c, T.BinaryType()) for c in ("sizes", "steps", "times", "pairs", "linked"))]])

    def run(batches):
        aligner, pack, number = make(), _Pack(), TaskContext.get().partitionId() << 32
        for ids, texts in _in_batches(batches, BATCH):
            size = sum(len(t or "") for t in texts)
            if pack.n and pack.size + size > PACK:
                yield pa.RecordBatch.from_arrays(pack.row(number), names=schema.names)
                pack, number = _Pack(), number + 1
            pack.add(ids, aligner.align(aligner.encode(texts)), size)
        if pack.n:
            yield pa.RecordBatch.from_arrays(pack.row(number), names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pack_pairs(packs: DataFrame) -> DataFrame:
    """pack, at (place among the pack's pairs), pair, n (links) of every pack."""

    def run(batches):
        for b in batches:
            for number, pairs, linked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pairs, linked = np.cumsum(_unsqueezed(pairs)), _unsqueezed(linked)
                for i in range(0, len(pairs), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    n = len(pairs[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(i, i + n), pa.int32()), pa.array(pairs[part]), pa.array(linked[part])], names=["pack", "at", "pair", "n"])

    return packs.select("pack", "pairs", "linked").mapInArrow(run, "pack long, at int, pair long, n long")


def alignment_digest(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, pattern: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs(doc_id, text).

    A link is a pair of tokens of a text whose bytes overlap; a pair of ids counts as often
    as it is linked in all of docs, repeated rows each time. n_best: links whose pair counts
    most among those of its second id, ties included; count_sum: the sum of the links'
    counts; groups_sha256: of the groups as written, the empty string for texts without
    tokens, which have zeros. Which texts these are, and what else holds, is as for
    aligned_tokens. A task holds a pack: PACK characters, or one longer text.
    """
    make = _shared_aligner(docs, tokenizer_a, tokenizer_b, pattern)
    packs = scratch(_packs(docs, make), "packs")
    with open(tokenizer_b, "rb") as f:
        b_size = Pieces(f.read()).size
    counts = scratch(_pack_pairs(packs).groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    best = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("best"))  # a row for an id of the second vocabulary
    counts = counts.join(F.broadcast(best), F.col("pair") % b_size == F.col("b")).select("pair", "count", (F.col("count") == F.col("best")).alias("best"))
    own = _pack_pairs(packs).join(counts, "pair").select("pack", "at", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = T.StructType([T.StructField(n, docs.schema["doc_id"].dataType if n == "doc_id" else T.StringType() if n == "groups_sha256" else T.LongType()) for n in names])

    def finish(pack: pa.Table, own: pa.Table) -> pa.Table:
        sizes, steps, times = (_unsqueezed(pack[c][0].as_py()) for c in ("sizes", "steps", "times"))
        count, most = np.zeros(own.num_rows, dtype=np.int64), np.zeros(own.num_rows, dtype=np.int64)
        at = own["at"].to_numpy()
        count[at], most[at] = own["count"].to_numpy(), own["best"].to_numpy()
        stop = np.cumsum(sizes)
        begin = stop - sizes
        run = np.cumsum(steps)
        at = run - np.repeat((run - steps)[np.minimum(begin, max(0, len(run) - 1))] if len(run) else begin, sizes)  # steps begin anew with each text
        sums = []
        for value in (most, count):
            upto = np.concatenate([[0], np.cumsum(times * value[at])])
            sums.append(pa.array(upto[stop] - upto[begin], pa.int64()))
        flat = [pack[c].combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")]
        return pa.Table.from_arrays([*flat[:5], *sums, flat[5]], names=names)

    return packs.select("pack", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "sizes", "steps", "times").groupBy("pack").cogroup(own.groupBy("pack")).applyInArrow(finish, schema)
