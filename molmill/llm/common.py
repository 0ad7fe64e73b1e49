"""What the text operators share: tables, text rules, sums of arrays."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch  # noqa: F401

SPACED = r"[^\x20\x09-\x0D]+"  # a run of anything but ASCII white space

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def size_in_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED)).cast("long")


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, as UTF-8; None has none."""
    return text.encode().lower().split() if text else []


def letter_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all beyond ASCII, A-Z lowered, as UTF-8; None has none."""
    return text.encode().translate(_LETTERS).split() if text else []


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as Python lists."""
    for b in batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


def summed(df: DataFrame, parts: int | None = None, dtype: type = np.float64, fan_in: int = 32) -> np.ndarray | None:
    """The sum over all rows of df(payload binary: array of dtype), every array as long as the others.

    parts: how many rows there are at most, if known: then each step leaves one row of about
    fan_in. Otherwise the first step leaves at most fan_in rows, the second one. So the driver
    gets a single array whatever the number of partitions. Tasks add in double precision.
    None if df is empty.
    """
    steps = [fan_in, 1] if parts is None else [-(-parts // fan_in)]
    while steps[-1] > 1:
        steps.append(-(-steps[-1] // fan_in))

    def add(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_buffer(), dtype=dtype)
                total = v.astype(np.float64) if total is None else np.add(total, v, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(dtype).tobytes()], type=pa.binary())], names=["payload"])

    one = df.select("payload")
    for n in steps:
        one = one.repartition(n).mapInArrow(add, "payload binary")
    rows = one.collect()
    return np.frombuffer(rows[0][0], dtype=dtype).astype(np.float64) if rows else None


