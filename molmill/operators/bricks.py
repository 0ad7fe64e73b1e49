"""Voxel grids as bricks: blocks of 8 voxels a side of one molecule and channel, of which only those that are not empty are rows.

A brick is mol_id, channel, bx, by, bz and its cells: a mask of 512 bits and the values that
are not zero, as 64-bit floats. A point is sent to every brick that its density reaches,
so a brick is complete after one exchange: its cells, and a rim as wide as the kernel,
are filled and convolved in numpy, many bricks at a time. Reducing bricks by two needs no exchange.
"""

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import in_bounds

EDGE = 8
CELLS = EDGE**3
TOGETHER = 1 << 21  # cells that are worked on at once
XYZ = ("x", "y", "z")
PLACE = ("bx", "by", "bz")
_NEAR = np.array(list(product((-1, 0, 1), repeat=3)))


def _schema(points: DataFrame) -> T.StructType:
    fields = [points.schema["mol_id"], points.schema["channel"], *(T.StructField(b, T.IntegerType()) for b in PLACE), T.StructField("mask", T.BinaryType()), T.StructField("cells", T.BinaryType())]
    return T.StructType(fields)


def _dealt(points: DataFrame, reach: int, side: int) -> DataFrame:
    """Points with each brick that voxels up to reach from their rounded place lie in, a brick's together and in order in one task."""
    out = points
    last = (side - 1) // EDGE
    for b, c in zip(PLACE, XYZ, strict=True):
        low, high = (F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.rint(c) + o) / EDGE).cast("int"))) for o in (-reach, reach))
        out = out.withColumn(b, F.explode(F.sequence(low, high)))
    key = ["mol_id", "channel", *PLACE]
    return out.repartition(*key).sortWithinPartitions(*key)


def _whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with equal keys, and the row at which each group begins."""
    held: list[pa.RecordBatch] = []

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for c in t.columns[:n_keys]:
            codes = c.combine_chunks().dictionary_encode()
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        at = begins(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at[:-1]
        held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, begins(t)


def _packed(dense: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Masks and values of bricks(n, 512)."""
    some = dense != 0
    stop = np.cumsum(some.sum(axis=1)) * 8
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    mask = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CELLS // 8), len(dense), [None, pa.py_buffer(np.packbits(some, axis=1).tobytes())]).cast(pa.binary())
    return mask, pa.Array.from_buffers(pa.binary(), len(dense), [None, pa.py_buffer(offsets), pa.py_buffer(dense[some].tobytes())])


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    """Bricks(n, 512) of a batch's masks and values."""
    mask, cells = (batch.column(batch.schema.get_field_index(c)) for c in ("mask", "cells"))
    out = np.zeros((batch.num_rows, CELLS))
    some = np.unpackbits(np.frombuffer(b"".join(mask.to_pylist()), np.uint8).reshape(-1, CELLS // 8), axis=1).astype(bool)
    out[some] = np.frombuffer(b"".join(cells.to_pylist()), np.float64)
    return out


def _filled(group: np.ndarray, n: int, at: np.ndarray, origin: np.ndarray, rim: int) -> np.ndarray:
    """Soft encoding of points at(x, y, z) in n bricks with a rim, flat."""
    edge = EDGE + 2 * rim
    nearest = np.rint(at)
    place = nearest[:, None, :] + _NEAR
    weight = np.maximum(0.0, 1 - np.abs(place - at[:, None, :])).prod(axis=2)
    local = place.astype(np.int64) - origin[group][:, None, :] + rim
    good = (weight > 0) & (local >= 0).all(axis=2) & (local < edge).all(axis=2)
    flat = ((group[:, None] * edge + local[..., 0]) * edge + local[..., 1]) * edge + local[..., 2]
    return np.bincount(flat[good], weight[good], n * edge**3)


def _convolved(grid: np.ndarray, n: int, kernel: np.ndarray, rim: int) -> np.ndarray:
    """Bricks(n * 512) of grids with a rim: every value that is not zero is spread by the kernel(dx, dy, dz, weight)."""
    edge = EDGE + 2 * rim
    some = np.flatnonzero(grid)
    value, out = grid[some], np.zeros(n * CELLS)
    local = np.stack([some // edge**2 % edge, some // edge % edge, some % edge], axis=1) - rim
    group = some // edge**3
    for step in range(0, len(some), 1 << 15):
        part = slice(step, step + (1 << 15))
        to = local[part][:, None, :] + kernel[:, :3].astype(np.int64)
        good = ((to >= 0) & (to < EDGE)).all(axis=2)
        flat = ((group[part][:, None] * EDGE + to[..., 0]) * EDGE + to[..., 1]) * EDGE + to[..., 2]
        np.add.at(out, flat[good], (value[part][:, None] * kernel[:, 3])[good])
    return out


def bricks(points: DataFrame, side: int = 48, margin: float = 1, kernel: list[tuple[int, int, int, float]] | None = None) -> DataFrame:
    """Bricks of points(mol_id, channel, x, y, z): each adds 1 in all, shared by volume among the voxels that its cube meets, then convolved with the kernel, if any.

    Points out of bounds add nothing, and nothing lies beyond the grid's borders. One
    exchange, by molecule, channel and brick; a task holds the points that reach a brick, and
    no more than TOGETHER cells of others with it. Coordinates that are null or NaN are out of bounds.
    """
    rim = max((abs(int(v)) for k in kernel for v in k[:3]), default=0) if kernel else 0
    weights = np.array(kernel, dtype=float).reshape(-1, 4) if kernel else None
    step = max(1, TOGETHER // (EDGE + 2 * rim) ** 3)

    def fill(batches):
        for t, begin in _whole_groups(batches, 5):
            column = lambda c: t.column(c).to_numpy()  # noqa: B023, E731
            at, place = np.stack([column(c) for c in XYZ], axis=1), np.stack([column(b)[begin] for b in PLACE], axis=1)
            stop = np.append(begin[1:], t.num_rows)
            for k in range(0, len(begin), step):
                b, e = begin[k : k + step], stop[k : k + step]
                n, rows = len(b), slice(b[0], e[-1])
                group = np.repeat(np.arange(n), e - b)
                origin = place[k : k + step] * EDGE
                out = _filled(group, n, at[rows], origin, rim)
                if weights is not None:
                    out = _convolved(out, n, weights, rim)
                out = out.reshape(n, EDGE, EDGE, EDGE)
                for axis in range(3):
                    beyond = origin[:, axis, None] + np.arange(EDGE) >= side
                    if beyond.any():
                        np.moveaxis(out, axis + 1, 1)[beyond] = 0
                out = out.reshape(n, CELLS)
                some = np.flatnonzero(out.any(axis=1))
                keys = [t.column(c).combine_chunks().take(pa.array(b[some])) for c in ("mol_id", "channel")]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(place[k : k + step][some, i], pa.int32()) for i in range(3)), *_packed(out[some])], names=["mol_id", "channel", *PLACE, "mask", "cells"])

    inside = points.select("mol_id", "channel", *(F.col(c).cast("double").alias(c) for c in XYZ)).where(in_bounds(tuple(map(F.col, XYZ)), side, margin) & F.expr("x + y + z is not null and not isnan(x + y + z)"))
    dealt = _dealt(inside, rim + 1, side).select("mol_id", "channel", *PLACE, *XYZ)
    return dealt.mapInArrow(fill, _schema(points))


def _rows(batch: pa.RecordBatch, dense: np.ndarray, edge: int) -> pa.RecordBatch:
    brick, cell = np.nonzero(dense)
    take = pa.array(brick)
    local = (cell // edge**2, cell // edge % edge, cell % edge)
    place = [pa.array(batch.column(2 + i).to_numpy()[brick] * edge + c, pa.int32()) for i, c in enumerate(local)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *place, pa.array(dense[brick, cell])], names=["mol_id", "channel", "ix", "iy", "iz", "v"])


def _unpacked(made: DataFrame, edge: int, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                yield _rows(part, of(_dense(part)), edge)

    kinds = [made.schema["mol_id"], made.schema["channel"], *(T.StructField(i, T.IntegerType()) for i in ("ix", "iy", "iz")), T.StructField("v", T.DoubleType())]
    return made.select("mol_id", "channel", *PLACE, "mask", "cells").mapInArrow(run, T.StructType(kinds))


def voxels(made: DataFrame) -> DataFrame:
    """voxels(mol_id, channel, ix, iy, iz, v) of bricks, those that are not zero."""
    return _unpacked(made, EDGE, lambda dense: dense)


def half_voxels(made: DataFrame) -> DataFrame:
    """Means of blocks of two voxels a side, as rows; a block lies in one brick, so there is no exchange."""
    half = EDGE // 2
    return _unpacked(made, half, lambda dense: dense.reshape(-1, half, 2, half, 2, half, 2).sum(axis=(2, 4, 6)).reshape(-1, half**3) / 8)
