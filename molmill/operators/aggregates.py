"""A user's own aggregate over groups of any size.

The aggregate is an object with start, add, merge and finish. Tasks fold their rows into
states, one for each group that they meet; states are merged in two steps, first over
shares of a group and then over what they left, so that neither rows nor states of a hot group meet in one task.
"""

import pickle
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class Aggregate(Protocol):
    """States are anything that can be pickled; merge may be called in any order."""

    def start(self) -> Any: ...

    def add(self, state: Any, rows: pa.Table) -> Any:
        """The state with rows of the group's added: some at a time, all columns."""

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> tuple:
        """The values of the result's columns."""


def aggregated(rows: DataFrame, by: list[str], aggregate: Aggregate, schema: str, shares: int = 64, held: int = 10_000) -> DataFrame:
    """by and the columns of schema, which aggregate.finish gives, for each group of rows; null keys are groups.

    A task holds the states of up to held groups, then puts them out. A group's states
    are dealt over shares, and merged one by one as they come in order. No rows give no rows.
    """
    keys = T.StructType([rows.schema[c] for c in by])
    names, result = keys.names, T.StructType.fromDDL(schema)

    def out(states: dict) -> pa.RecordBatch:
        columns = list(zip(*states, strict=True)) or [[]] * len(names)
        arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, keys.fields, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*names, "state"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            places: dict = {}
            for i, k in enumerate(zip(*(t.column(c).to_pylist() for c in names), strict=True)):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                states[k] = aggregate.add(states[k] if k in states else aggregate.start(), t.take(at))
            if len(states) > held:
                yield out(states)
                states = {}
        yield out(states)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each group's key and its merged state; the states of a group come one after the other."""
        flat = ((tuple(r[:-1]), r[-1]) for b in batches for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in [*names, "state"]), strict=True))
        for k, found in groupby(flat, itemgetter(0)):
            state = None
            for n, (_, s) in enumerate(found):
                state = pickle.loads(s) if n == 0 else aggregate.merge(state, pickle.loads(s))
            yield k, state

    def merge(batches):
        for k, state in in_order(batches):
            yield out({k: state})

    def finish(batches):
        for k, state in in_order(batches):
            values = [*k, *aggregate.finish(state)]
            yield pa.RecordBatch.from_arrays([pa.array([v], to_arrow_type(f.dataType)) for v, f in zip(values, [*keys.fields, *result.fields], strict=True)], names=[*names, *result.names])

    state = T.StructType([*keys.fields, T.StructField("state", T.BinaryType())])
    parts = rows.mapInArrow(fold, state).withColumn("share", F.pmod(F.xxhash64("state", F.monotonically_increasing_id()), F.lit(shares)))
    order = [*(F.col(c) for c in names), F.col("share")]
    merged = parts.repartition(*order).sortWithinPartitions(*order).mapInArrow(merge, state)
    last = merged.repartition(*order[:-1]).sortWithinPartitions(*order[:-1])
    return last.mapInArrow(finish, T.StructType([*keys.fields, *result.fields]))
