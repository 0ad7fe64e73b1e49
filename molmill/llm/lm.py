"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

A token is modelled in two steps, both from the vectors of the two words before it. First
its symbol: the end of a text or one of the most frequent words by itself, a group of
other frequent words, or a class of rarer words by their last two bytes. Then the word
within its group, for which it has a vector of its own; inside a class of rare words, a
word's probability is its smoothed share of the class's training tokens. All steps are
normalised, so scores are log probabilities. The words with vectors are those seen often
enough; how many at most grows with the cube root of the training tokens. Groups are runs
of them in the order of their endings, and their number grows with the square root of the
words', so that a token's cost does too.

Word counts cover all training rows. Texts are then written once as codes. Training goes
over each of them once: a hash of a row's id and text deals it to one of the rounds, whose
number grows with the logarithm of the number of tokens, and to one of the round's shards. In
a round each shard's task takes noise-contrastive steps through its texts in the order of
their hashes, with noise drawn from the counts. Each parameter moves by the mean of its
shards' moves, weighted by the squared gradients that it had in them: a word that few shards
saw keeps what it learnt there. The next round goes on from there, step sizes included. So
more tokens make a model better and not flatter, and a model does not depend on how the rows
are partitioned.
"""

import zlib
from collections import Counter
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import remainder, scratch, spaced_words, summed

END = b"\n"  # no word holds white space
SINGLES, GROUPS, CLASSES = 48, 48, 64  # the end is among the singles; so many groups for up to OWN_WORDS words
WIDTH = 16
NOISE, WORD_NOISE = 24, 2  # noise symbols a block of tokens, noise words a token
HEAD_WORDS = 100_000
OWN_WORDS, LEAST_COUNT = 4_096, 50  # words with vectors for up to SHARD_TOKENS training tokens
SHARD_TOKENS = 4_000_000
STEP, SCORED = 1024, 512  # tokens a step trains on, and tokens whose scores of all symbols are held at once
_FLUSH = 200_000


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over texts(text), with an end for each text. Tasks count before they send."""

    def count(batches):
        seen = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], names=["word", "n"])

        for b in batches:
            for x in b.column(0):
                seen.update(spaced_words(x.as_py()))
                seen[END] += 1
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def words_with_vectors(tokens: int, own_words: int = OWN_WORDS) -> int:
    return round(own_words * max(1.0, tokens / SHARD_TOKENS) ** (1 / 3))


def groups_of(own_words: int) -> int:
    return max(GROUPS, round(GROUPS * (own_words / OWN_WORDS) ** 0.5))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


class Vocabulary:
    """What is known of the most frequent words, and of all words in sums: of bounded size.

    A word's code is its place among the words with vectors (the end first, then the other
    singles, then the groups' words group by group), or beyond them its class.
    """

    def __init__(self, counts: DataFrame, head_words: int = HEAD_WORDS, own_words: int = OWN_WORDS, least_count: int = LEAST_COUNT):
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
        self.tokens, self.distinct = int(total[0]), int(total[1])
        # The least count that no more than head_words words reach. There are far fewer different counts than words.
        upto = F.sum("words").over(Window.orderBy(F.desc("n")))
        reached = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("upto", upto).where(F.col("upto") <= head_words)
        least = reached.agg(F.min("n")).head()[0]
        frequent = (F.col("n") >= least) if least is not None else F.lit(False)
        head = sorted(counts.where(frequent | (F.col("word") == F.lit(END))).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
        words = [bytes(r[0]) for r in head]
        n = np.array([r[1] for r in head], dtype=np.float64)
        self.place = dict(zip(words, range(len(words)), strict=True))
        often = [w for w, k in zip(words, n.tolist(), strict=True) if w != END and k >= least_count][: max(words_with_vectors(self.tokens, own_words) - 1, 0)]
        singles, others = [END, *often[: SINGLES - 1]], sorted(often[SINGLES - 1 :], key=lambda w: w[::-1])
        groups = groups_of(len(others))
        self.first = SINGLES + np.array([len(others) * g // groups for g in range(groups + 1)])  # codes at which the groups begin
        self.codes = int(self.first[-1]) + CLASSES
        self.kind = "<u2" if self.codes <= 1 << 16 else "<u4"  # how a code is written
        code = dict(zip(singles, range(len(singles)), strict=True)) | dict(zip(others, range(SINGLES, SINGLES + len(others)), strict=True))
        tail = int(self.first[-1])
        self.code = np.array([code.get(w, -1) for w in words], dtype=np.int64)
        inside = self.code >= 0
        kind = np.array([tail_class(w) for w in words], dtype=np.int64)
        self.code[~inside] = tail + kind[~inside]
        by_class = counts.groupBy((F.crc32(F.substring("word", -2, 2)) % CLASSES).alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
        size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in by_class:
            size[r["class"]], kinds[r["class"]] = r["n"], r["words"]
        np.subtract.at(size, kind[inside], n[inside])
        np.subtract.at(kinds, kind[inside], 1)
        self.code_counts = np.zeros(self.codes)
        self.code_counts[self.code[inside]] = n[inside]
        self.code_counts[tail:] = size
        self.coverage = float(n[inside].sum() / max(self.tokens, 1))
        self.log_count = np.log10(n + 0.5)
        self.log_base = np.log10(self.tokens + 0.5 * (self.distinct + 1))
        # What a rare word's share of its class is divided by.
        self.log_class = np.log10(size + 0.5 * (kinds + 1))
        self.log_share = np.where(inside, 0.0, self.log_count - self.log_class[kind])

    @property
    def model(self) -> tuple[np.ndarray, np.ndarray]:
        return self.first, self.code_counts


def as_codes(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: row, doc_id, held_out, n_tokens, n_known, base_score, share (both but for the words of tail), codes, tail."""
    kind = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # HEAD_WORDS words at most
    tail_type = pa.struct([("word", pa.binary()), ("k", pa.int32())])

    def run(batches):
        v = SimpleNamespace(**shared.value)
        get = v.place.get
        end = get(END, -1)
        beyond = v.codes - CLASSES
        for b in batches:
            n_tokens, known, base, share, codes = [], [], [], [], []
            tails, times, ends = [], [], [0]
            for x in b.column(3):
                words = spaced_words(x.as_py())
                n = len(words) + 1
                at = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=n - 1)
                unknown = np.flatnonzero(at < 0).tolist()
                places = at[at >= 0] if unknown else at
                code = np.zeros(n, dtype=np.int64)  # the last is the end
                code[:-1][at >= 0] = v.code[places]
                rest = Counter(words[i] for i in unknown)
                classes = {w: tail_class(w) for w in rest}
                code[unknown] = [beyond + classes[words[i]] for i in unknown]
                k = np.fromiter(rest.values(), dtype=np.int32, count=len(rest))
                n_tokens.append(n)
                known.append(len(places) + (end >= 0))
                base.append(float(v.log_count[places].sum()) + (float(v.log_count[end]) if end >= 0 else float(np.log10(0.5))) - n * float(v.log_base))
                share.append(float(v.log_share[places].sum()) - float(k @ v.log_class[list(classes.values())]) if rest else float(v.log_share[places].sum()))
                codes.append(code.astype(v.kind).tobytes())
                tails.extend(rest)
                times.append(k)
                ends.append(ends[-1] + len(rest))
            tail = pa.StructArray.from_arrays([pa.array(tails, type=pa.binary()), pa.array(np.concatenate(times) if times else [], type=pa.int32())], fields=list(tail_type))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *(pa.array(c, type=t) for c, t in ((n_tokens, pa.int64()), (known, pa.int64()), (base, pa.float64()), (share, pa.float64()), (codes, pa.binary()))), pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), tail)],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "share", "codes", "tail"],
            )

    held = remainder(F.col("doc_id"), 5) == 1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(held & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"), "text")
    rest = T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, share double, codes binary, tail array<struct<word: binary, k: int>>")
    return rows.mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), *rest]))


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0, -x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def flattened(part: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in part.values()]).astype(np.float64)


def shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([p.size for p in like.values()])
    return {k: x.reshape(p.shape).astype(np.float32) for (k, p), x in zip(like.items(), np.split(flat, ends[:-1]), strict=True)}


class Model:
    """Log-bilinear: a context's vector is the sum of its two words' vectors, each times the matrix of its place."""

    def __init__(self, first: np.ndarray, code_counts: np.ndarray, seed: int = 0):
        """first: codes at which the groups begin; code_counts: training tokens by code."""
        r = np.random.default_rng(seed)
        self.first, self.codes = first, len(code_counts)
        self.groups, grouped = len(first) - 1, self.codes - SINGLES - CLASSES
        symbols = SINGLES + self.groups + CLASSES
        self.symbol = np.concatenate([np.arange(SINGLES), np.repeat(np.arange(SINGLES, SINGLES + self.groups), np.diff(first)), np.arange(SINGLES + self.groups, symbols)])
        share = np.bincount(self.symbol, weights=code_counts, minlength=symbols) + 0.5
        self.share = share / share.sum()
        words = code_counts[SINGLES : SINGLES + grouped] + 0.5
        self.upto = np.concatenate([[0.0], np.cumsum(words)])
        self.group_upto = self.upto[first - SINGLES]
        of = self.symbol[SINGLES : SINGLES + grouped] - SINGLES
        word_share = words / np.diff(self.group_upto)[of]
        self.log_noise, self.log_word_noise = np.log(NOISE * self.share).astype(np.float32), np.log(WORD_NOISE * word_share).astype(np.float32)
        small = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        self.part = {
            "near": np.eye(WIDTH, dtype=np.float32), "far": 0.5 * np.eye(WIDTH, dtype=np.float32), "context": small(self.codes, WIDTH),
            "target": small(symbols, WIDTH), "bias": np.log(self.share).astype(np.float32), "word": small(grouped, WIDTH), "word_bias": np.log(word_share).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return flattened(self.part)

    def load(self, flat: np.ndarray) -> "Model":
        self.part = shaped(flat, self.part)
        return self

    def vectors(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        p = self.part
        return p["context"].take(near, axis=0) @ p["near"] + p["context"].take(far, axis=0) @ p["far"]

    def drawn(self, token: np.ndarray, order: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Noise: NOISE symbols for all tokens, and WORD_NOISE words of its own group for each token that has one."""
        noise = np.searchsorted(np.cumsum(self.share)[:-1], order.random(NOISE), side="right")
        group = self.symbol[token] - SINGLES
        group = group[(group >= 0) & (group < self.groups)]
        low, high = self.group_upto[group, None], self.group_upto[group + 1, None]
        words = np.searchsorted(self.upto, low + order.random((len(group), WORD_NOISE)) * (high - low), side="right") - 1
        return noise, np.clip(words, (self.first[group] - SINGLES)[:, None], (self.first[group + 1] - SINGLES - 1)[:, None])

    def gradient(self, token: np.ndarray, near: np.ndarray, far: np.ndarray, noise: np.ndarray, words: np.ndarray, objective: bool = False) -> tuple[float | None, dict]:
        """The noise-contrastive objective of tokens after contexts, if asked for, and its gradient: rows and their values for tables, arrays for the matrices."""
        p = self.part
        one, two = p["context"].take(near, axis=0), p["context"].take(far, axis=0)
        q = one @ p["near"] + two @ p["far"]
        s = self.symbol.take(token)
        own, noise_target, offset = p["target"].take(s, axis=0), p["target"].take(noise, axis=0), p["bias"] - self.log_noise
        true, fake = np.einsum("bd,bd->b", q, own) + offset.take(s), q @ noise_target.T + offset.take(noise)
        up, down = _sigmoid(-true), -_sigmoid(fake)
        dq = up[:, None] * own + down @ noise_target
        at = np.flatnonzero((s >= SINGLES) & (s < SINGLES + self.groups))
        w, q2 = token.take(at) - SINGLES, q.take(at, axis=0)
        own_words, far_words, offset = p["word"].take(w, axis=0), p["word"].take(words, axis=0), p["word_bias"] - self.log_word_noise
        true2, fake2 = np.einsum("bd,bd->b", q2, own_words) + offset.take(w), np.einsum("bkd,bd->bk", far_words, q2) + offset.take(words)
        up2, down2 = _sigmoid(-true2), -_sigmoid(fake2)
        dq[at] += up2[:, None] * own_words + np.einsum("bk,bkd->bd", down2, far_words)
        symbol_rows, word_rows = np.concatenate([s, noise]), np.concatenate([w, words.ravel()])
        # A token's nearest word is the next token's second one, but where a text begins: the word's row moves once by the sum.
        d_near, d_far = dq @ p["near"].T, dq @ p["far"].T
        shared = np.zeros(len(token), dtype=bool)
        shared[1:] = far[1:] == near[:-1]
        alone = np.flatnonzero(~shared)
        d_near[:-1] += d_far[1:] * shared[1:, None]
        value = sum(float(_log_sigmoid(x.astype(np.float64)).sum()) for x in (true, -fake, true2, -fake2)) if objective else None
        return value, {
            "near": one.T @ dq, "far": two.T @ dq,
            "context": (np.concatenate([near, far.take(alone)]), np.concatenate([d_near, d_far.take(alone, axis=0)])),
            "target": (symbol_rows, np.concatenate([up[:, None] * q, down.T @ q])), "bias": (symbol_rows, np.concatenate([up, down.sum(axis=0)])),
            "word": (word_rows, np.concatenate([up2[:, None] * q2, (down2[:, :, None] * q2[:, None, :]).reshape(-1, WIDTH)])), "word_bias": (word_rows, np.concatenate([up2, down2.ravel()])),
        }

    def log_probabilities(self, token: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """log10 probability of each token after its context, in batched products; that of a class for the words of one."""
        p, out = self.part, np.empty(len(token))
        for at in range(0, len(token), 1 << 17):
            t = token[at : at + (1 << 17)]
            q, s = self.vectors(near[at : at + len(t)], far[at : at + len(t)]), self.symbol.take(t)
            got = np.concatenate([_picked(q[i : i + SCORED], p["target"], p["bias"], s[i : i + SCORED]) for i in range(0, len(t), SCORED)])
            s = s.astype(np.uint16 if len(p["bias"]) <= 1 << 16 else np.uint32)  # numbers below 2^16 sort in two passes
            by = np.argsort(s, kind="stable")
            ends = np.searchsorted(s.take(by), np.arange(SINGLES, SINGLES + self.groups + 1))
            for g in range(self.groups):
                some = by[ends[g] : ends[g + 1]]
                low, high = self.first[g] - SINGLES, self.first[g + 1] - SINGLES
                if len(some):
                    got[some] += _picked(q.take(some, axis=0), p["word"][low:high], p["word_bias"][low:high], t.take(some) - self.first[g])
            out[at : at + len(t)] = got
        return out / np.log(10)


def _picked(q: np.ndarray, target: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of the normalised probability of one target a row."""
    scores = q @ target.T
    own, factor = scores.ravel().take(np.arange(len(q)) * len(bias) + which).astype(np.float64) + bias[which], np.exp(bias)
    # No product is beyond those of the longest vectors; few are so long that exponentials need the largest one taken off.
    if np.sqrt(np.einsum("bd,bd->b", q, q).max() * np.einsum("bd,bd->b", target, target).max()) > 40 or np.abs(bias).max() > 40:
        scores += bias
        largest, factor = scores.max(axis=1, keepdims=True), np.ones_like(bias)
        own -= largest[:, 0]
        scores -= largest
    return own - np.log((np.exp(scores, out=scores) @ factor).astype(np.float64))


class Adagrad:
    """Steps up the gradient, of rows of tables only where they have one."""

    def __init__(self, model: Model, rate: float, so_far: np.ndarray):
        """so_far: the squared gradients of earlier steps, flat."""
        self.model, self.rate = model, rate
        self.sum = shaped(so_far, model.part)

    def step(self, gradient: dict) -> None:
        last, rows = None, None
        for k, g in gradient.items():
            p, total = self.model.part[k], self.sum[k]
            if isinstance(g, tuple):
                if not len(g[0]):
                    continue
                if g[0] is not last:  # a table and its biases have the same rows
                    last, rows = g[0], _Rows(g[0], len(p))
                g = rows.added(g[1])
                now = total.take(rows.rows, axis=0)
                now += g * g
                total[rows.rows] = now
                g *= self.rate
                g /= np.sqrt(now, out=now)
                g += p.take(rows.rows, axis=0)
                p[rows.rows] = g
            else:
                total += g * g
                p += self.rate * g / np.sqrt(total)


class _Rows:
    """The different rows among those of a gradient, and sums by them."""

    def __init__(self, rows: np.ndarray, size: int):
        rows = rows.astype(np.uint16 if size <= 1 << 16 else np.uint32)  # numbers below 2^16 sort in two passes
        self.by = np.argsort(rows, kind="stable")
        rows = rows.take(self.by)
        self.start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        self.rows, times = rows.take(self.start).astype(np.intp), np.diff(self.start, append=len(rows))
        # Most rows are there once and need no sum.
        self.first, self.often = self.by.take(self.start), np.flatnonzero(times > 1)
        self.repeats, some = self.by[np.repeat(times > 1, times)], times.take(self.often)
        self.begin = np.cumsum(some) - some

    def added(self, values: np.ndarray) -> np.ndarray:
        if values.ndim == 1:
            return np.add.reduceat(values.take(self.by), self.start)
        out = values.take(self.first, axis=0)
        if len(self.often):
            out[self.often] = np.add.reduceat(values.take(self.repeats, axis=0), self.begin, axis=0)
        return out


def contexts(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each one, and the one before that, in texts laid end to end; a text starts after two ends (code 0)."""
    near, far = np.zeros_like(codes), np.zeros_like(codes)
    near[1:], far[2:] = codes[:-1], codes[:-2]  # the last token of a text is the end
    far[ends[:-1]] = 0
    return near, far


def _laid_out(texts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=kind).astype(np.int64), np.cumsum([0, *(len(x) // int(kind[-1]) for x in texts)])


def schedule(tokens: int, shard_tokens: int = SHARD_TOKENS) -> tuple[int, int]:
    """Rounds, and shards a round: a shard has half of shard_tokens tokens in a round."""
    units = max(1.0, tokens / shard_tokens)
    rounds = 2 * (1 + round(np.log2(units)))
    return rounds, max(1, round(2 * units / rounds))


def dealt(rows: DataFrame, rounds: int, shards: int) -> DataFrame:
    """rows(doc_id, codes, ...) with round, shard and place, and in the order of the rounds, so that a round's pages can be read alone."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "codes")
    return rows.select("*", key.alias("place"), F.pmod(key, F.lit(shards)).alias("shard"), F.pmod(F.xxhash64(key), F.lit(rounds)).cast("int").alias("round")).sortWithinPartitions("round")


def train(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], rounds: int, shards: int, kind: str = "<u2", rate: float = 0.15) -> np.ndarray:
    """Flat parameters after all rows(codes, place, shard, round) were gone through once: a part of them in each round."""
    flat = Model(*model).flat()
    so_far = np.full(len(flat), 1e-6)
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((flat, so_far, model))  # of a stated size

        def run(key, table, *, shared=shared, turn=turn):
            at, so_far, plan = shared.value
            model = Model(*plan).load(at)
            steps, order = Adagrad(model, rate, so_far), np.random.default_rng([turn, key[0].as_py()])
            before = flattened(steps.sum)
            texts = [x for _, x in sorted(zip(table.column("place").to_pylist(), table.column("codes").to_pylist(), strict=True))]
            codes, ends = _laid_out(texts, kind)
            near, far = contexts(codes, ends)
            for i in range(0, len(codes), STEP):
                block = (codes[i : i + STEP], near[i : i + STEP], far[i : i + STEP])
                steps.step(model.gradient(*block, *model.drawn(block[0], order))[1])
            weight = flattened(steps.sum) - before
            return pa.table({"payload": pa.array([np.concatenate([(model.flat() - at) * weight, weight, [1.0]]).astype(np.float32).tobytes()], type=pa.binary())})

        total = summed(rows.where(F.col("round") == turn).select("shard", "place", "codes").groupBy("shard").applyInArrow(run, "payload binary"), shards, np.float32)
        shared.unpersist()
        if total is None:
            continue
        moves, weight = total[: len(flat)], total[len(flat) : -1]
        flat = (flat + moves / np.maximum(weight, 1e-30)).astype(np.float32).astype(np.float64)
        so_far = so_far + weight / total[-1]
    return flat


def lm_scores(docs: DataFrame, head_words: int = HEAD_WORDS, own_words: int = OWN_WORDS, least_count: int = LEAST_COUNT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out (crc32 of the id as text modulo 5 is 1: held
    out; a null id never is). own_words: how many words have vectors at most with up to
    SHARD_TOKENS training tokens, of those seen least_count times or more; with more tokens,
    times the cube root of their number over that, up to head_words, the words whose counts
    every task holds. Null texts are empty: one token, the end. Texts count whole, however
    long; a long one stays within its shard, as do rows equal in id and text. Without
    training rows every count is 0. Repeated rows count as often as they are there. No rows
    give no rows. Other columns are ignored. Partitions do not change the model; the order
    in which shards' parameters are summed may change scores by rounding.
    """
    held = F.coalesce((remainder(F.col("doc_id"), 5) == 1) & F.col("doc_id").isNotNull(), F.lit(False))
    counts = scratch(word_counts(docs.where(~held)), "word-counts")
    v = Vocabulary(counts, head_words, own_words, least_count)
    rounds, shards = schedule(v.tokens, shard_tokens)
    base = scratch(dealt(as_codes(docs, v), rounds, shards), "codes")
    code_kind = v.kind
    flat = train(base.where("not held_out"), v.model, rounds, shards, code_kind)
    shared = docs.sparkSession.sparkContext.broadcast((flat, v.model))  # of a stated size
    kind = docs.schema["doc_id"].dataType
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "share"]

    def run(batches):
        at, plan = shared.value
        model = Model(*plan).load(at)
        for b in batches:
            codes, ends = _laid_out([x.as_py() for x in b.column(len(names))], code_kind)
            each = model.log_probabilities(codes, *contexts(codes, ends))
            sums = np.add.reduceat(each, ends[:-1]) if len(each) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], pa.array(sums + b.column(len(names) - 1).to_numpy())], names=[*names[:-1], "score"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, score double")])
    first = base.select(*names, "codes").mapInArrow(run, schema)
    # The words beyond the most frequent ones meet their counts in a join.
    tail = base.where(F.size("tail") > 0).select("row", F.inline("tail")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("seen"))
    rest, seen = F.coalesce("rest", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return first.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + rest).alias("base_score"), (F.col("score") + rest).alias("score")
    )
