"""Source divergence audit: how far the words of each source stray from those of others of its language.

Texts are counted inside tasks, so only a term's counts by task are shuffled. A term is
kept if enough documents of its language hold it; a kept term is one row with its counts
in all sources. Smoothed shares p and divergences f = floor((p-q)^2 / q) are exact
integers. Terms of a group that agree in their count there and in the language have one
f, so f is evaluated per cell of (group count, language count). Cells of equal value are
merged and ranked by what they hold together; only the cells that reach into the report
are expanded to terms, in UTF-8 order. Pairs of sources are compared over blocks of
terms, and the blocks' sums added.
"""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch

SHARE = 1_000_000_000  # shares are counted in billionths
FLUSH = 400_000  # terms that a task holds before it puts its counts out
BLOCK = 16_384  # terms of a language that one task compares at once
CELLS = 1 << 21  # numbers in a matrix of sources and terms

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of all beyond ASCII, A-Z lowered, as UTF-8; None has none."""
    return text.encode().translate(_LETTERS).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents with it) over docs(text, lang, source); a row with a null term for every group."""

    def run(batches):
        held: dict = defaultdict(lambda: (Counter(), Counter()))

        def out():
            for (lang, source), (n, df) in held.items():
                words = list(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(words) + 1), pa.string()), pa.array([source] * (len(words) + 1), pa.string()), pa.array([None, *(w.decode() for w in words)], pa.string()),
                        pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[w] for w in words)], pa.int64()),
                    ], names=["lang", "source", "term", "n", "df"],
                )
            held.clear()

        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, df = held[lang or "", source or ""]
                words = terms_of(text)
                n.update(words)
                df.update(set(words))
            if sum(len(n) for n, _ in held.values()) > FLUSH:
                yield from out()
        yield from out()

    counts = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term, n_lang, sources (array of source and n) of the terms that least_docs documents of a language hold."""
    by_term = counts.where("term is not null").groupBy("lang", "term")
    return by_term.agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("sources")).where(F.col("df") >= least_docs).drop("df")


def group_sizes(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), n_lang, v (kept terms of the language) for every group, also one without terms."""
    each = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("n_lang"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term is null").select("lang", "source").join(each, ["lang", "source"], "left").join(langs, "lang", "left")
    return groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "n_lang", "v")))


def share(n: str, total: str, v: str):
    """1 + floor(billion * (n + 1) / (total + v)); in decimals, so that no count is too large."""
    return F.expr(f"1 + (cast({SHARE} as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0))) div cast({total} + {v} as decimal(19, 0))")


def top_terms(kept: DataFrame, groups: DataFrame, ranks: int = 200) -> DataFrame:
    """lang, source, item, value, rank: the terms whose share in a group exceeds that in its language, by value and then in UTF-8 order.

    No more than ranks rows of a group are sorted together: cells of equal value are merged
    first, and of the terms of the cells that reach into the report every task hands on at
    most ranks.
    """
    each = kept.select("lang", "term", "n_lang", F.explode("sources").alias("s")).select("lang", "s.source", "s.n", "n_lang", "term")
    sizes = groups.select("lang", "source", "total", F.col("n_lang").alias("lang_total"), "v")
    cells = each.groupBy("lang", "source", "n", "n_lang").agg(F.count(F.lit(1)).alias("terms")).join(sizes, ["lang", "source"])
    cells = cells.withColumn("p", share("n", "total", "v")).withColumn("q", share("n_lang", "lang_total", "v")).where("p > q")
    cells = scratch(cells.select("lang", "source", "n", "n_lang", "terms", F.expr("((p - q) * (p - q)) div q").alias("value")), "cells")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("nth", F.row_number().over(by_value)).where(F.col("nth") <= ranks)
    above = F.coalesce(F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = values.withColumn("above", above).where(F.col("above") < ranks).select("lang", "source", "value")
    shown = cells.join(reach, ["lang", "source", "value"]).select("lang", "source", "n", "n_lang", "value")
    rows = each.join(shown, ["lang", "source", "n", "n_lang"]).select("lang", "source", F.col("term").alias("item"), "value")
    return rows.withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(billion * (n + 1) / total) by long division in three steps, so that nothing overflows below 9e15."""
    rest, out = n + 1, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def pair_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value (f summed over all kept terms).

    A task gets a block of a language's terms and the sources' sizes. A language of S
    sources and V terms takes S * S * V steps; its result has S * (S - 1) rows.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int")
    per_lang = groups.groupBy("lang").agg(F.first("v").alias("v")).select("lang", blocks.alias("blocks"))
    dealt = kept.join(per_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "sources")
    sizes = groups.select("lang", "source", "total", "v", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))

    def compare(key, terms: pa.Table, sizes: pa.Table) -> pa.Table:
        names = sizes["source"].to_pylist()
        place = {s: i for i, s in enumerate(names)}
        total = (sizes["total"].to_numpy() + sizes["v"].to_numpy())[:, None]
        sums = np.zeros((len(names), len(names)), dtype=np.int64)
        step = max(1, CELLS // max(1, len(names)))
        for at in range(0, terms.num_rows, step):
            lists = terms["sources"].slice(at, step).combine_chunks()
            column = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            n = np.zeros((len(names), len(lists)), dtype=np.int64)
            n[[place[s] for s in flat.field("source").to_pylist()], column] = flat.field("n").to_numpy()
            q = _shares(n, total)
            for i in range(len(names)):
                apart = q[i] - q
                sums[i] += (apart * apart // q).sum(axis=1)
        one, other = np.nonzero(~np.eye(len(names), dtype=bool))
        lang = key[0].as_py()
        return pa.table({
            "lang": pa.array([lang] * len(one), pa.string()), "source": pa.array([names[i] for i in one], pa.string()), "item": pa.array([names[j] for j in other], pa.string()),
            "value": pa.array(sums[one, other], pa.int64()),
        })

    parts = dealt.groupBy("lang", "block").cogroup(sizes.groupBy("lang", "block")).applyInArrow(compare, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of docs(text, lang, source).

    Null text, lang and source count as empty. A group is a (lang, source) that occurs,
    even without terms. Part pair: every other source of the language, by the sum of f over
    all the language's kept terms (0 without any), all ranks. Part term: terms of the
    group whose share exceeds the language's, to the given rank. Ranks start at 1 per group
    and part; ties are in UTF-8 order. Repeated rows count as often as they occur; texts
    count whole, however long (a task holds the different terms of one text at a time, and
    FLUSH more); other columns are ignored; no rows give no rows.
    """
    counts = scratch(term_counts(docs), "term-counts")
    kept = scratch(kept_terms(counts, least_docs), "kept-terms")
    groups = scratch(group_sizes(counts, kept), "groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(kept, groups).withColumn("rank", F.row_number().over(by_value))
    terms = top_terms(kept, groups, ranks)
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).union(terms.select(*columns("term")))
