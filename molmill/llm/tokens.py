"""Token counts from an exact histogram of encoded lengths.

Texts are encoded once, and only their lengths counted. Suffix sums over the histogram
then answer, for every context limit, how many documents and tokens there are at or
above it and how many tokens are left if every text is cut to it.
"""

import base64
import re
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024  # lengths whose suffix sums one task adds up
LONG_SPACE = 1_000
# The characters of Unicode's White_Space, which is what the tokenizers' patterns mean by it.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_whole(encoding, text: str, long_space: int = LONG_SPACE) -> list[int]:
    """Ids of the whole text. A run of white space too long for the encoder's pattern is taken out as the piece that the pattern makes of it.

    That is all of the run, or all but its last character if a word follows. Runs are
    tried from their first character only, so that many of nearly that length cost no more.
    """
    out, at = [], 0
    for run in re.finditer(f"[{_SPACES}](?<![{_SPACES}][{_SPACES}])[{_SPACES}]{{{long_space - 1},}}", text) if len(text) >= long_space else ():
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    rest = encoding.encode_ordinary(text[at:])
    return out + rest if out else rest


def token_count(encoding, text: str, long_space: int = LONG_SPACE) -> int:
    return len(encode_whole(encoding, text, long_space))


def encoded_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """n_tokens (null text: 0) of every row of docs(text), with doc_id."""
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern or _pattern()))  # of the vocabulary's size
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        import tiktoken

        ranks, pattern = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [token_count(encoding, x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType())]))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct n_tokens: n_docs, docs_at_least, tokens_at_least, truncated_tokens.

    docs_at_least and tokens_at_least are sums over this and all greater lengths;
    truncated_tokens is what all texts have together if cut to this length. Sums are taken
    within blocks of lengths, then over the blocks, so no task holds all lengths.
    """
    hist = scratch(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")  # written, as it is read twice
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("sum"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nil = F.lit(0)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(w), nil).alias(n) for c, w, n in (("docs", above, "docs_above"), ("sum", above, "tokens_above"), ("sum", below, "tokens_below"))))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    under = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    docs = F.col("docs_above") + F.sum("n_docs").over(inside)
    return hist.join(blocks, "block").select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), (F.col("tokens_above") + F.sum("tokens").over(inside)).alias("tokens_at_least"),
        (F.col("tokens_below") + F.coalesce(F.sum("tokens").over(under), nil) + F.col("n_tokens") * docs).alias("truncated_tokens"),
    )


def token_histogram(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """length_histogram of docs(doc_id, text). 

    Null and empty texts have length 0; texts are encoded whole, however long, long runs of
    white space too; no rows give no rows; repeats count; other columns are ignored.
    """
    return length_histogram(encoded_lengths(docs, tokenizer, pattern))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, tokens (all texts cut to the limit) and texts_cut, for any limits, from a histogram."""
    sums = []
    for limit in limits:
        sums += [F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")).alias(f"t{limit}"), F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias(f"c{limit}")]
    one = hist.agg(*sums)
    each = F.array(*(F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(f"t{x}", F.lit(0)).alias("tokens"), F.coalesce(f"c{x}", F.lit(0)).alias("texts_cut")) for x in limits))
    return one.select(F.inline(each))


def length_quantile(hist: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents does not exceed; None without documents."""
    n = hist.agg(F.max("docs_at_least")).head()[0]
    if not n:
        return None
    return hist.where(F.lit(n) - F.col("docs_at_least") + F.col("n_docs") >= max(1, ceil(q * n))).agg(F.min("n_tokens")).head()[0]
