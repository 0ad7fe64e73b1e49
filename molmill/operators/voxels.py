"""Atoms to sparse voxel grids and back. Only voxels that are not zero are rows."""

from functools import reduce
from itertools import product
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import distance, in_bounds, to_voxel, uniform
from ..storage import scratch

XYZ = ("x", "y", "z")
VOXEL = ("ix", "iy", "iz")
OFFSETS = [o for o in product((-1, 0, 1), repeat=3)]
BORDER = [o for o in OFFSETS if o != (0, 0, 0)]


def offset_table(spark: SparkSession, offsets=OFFSETS) -> DataFrame:
    return spark.createDataFrame([tuple(map(int, o)) for o in offsets], "ox int, oy int, oz int")


def in_voxels(atoms: DataFrame, centre=(0.0, 0.0, 0.0), size: float = 24.0, resolution: float = 0.5) -> DataFrame:
    """Atoms with coordinates in voxels of the grid about centre."""
    return atoms.withColumns({c: to_voxel(F.col(c), m, size, resolution) for c, m in zip(XYZ, centre, strict=True)})


def channelled(atoms: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per atom(mol_id, atom_idx, x, y, z, types) and channel of it."""
    each = atoms.select("mol_id", "atom_idx", *XYZ, F.explode("types").alias("type_num")).join(F.broadcast(channels), "type_num")  # channels: 1024 types at most
    return each.select("mol_id", "atom_idx", F.col("ch").alias("channel"), *XYZ).distinct()


def _around(points: DataFrame, offsets=OFFSETS) -> DataFrame:
    """Each point's voxels around its rounded place, with w, the product over the axes of 1 - |distance|, 0 beyond 1."""
    o = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(x, ("ox", "oy", "oz"), strict=True))) for x in offsets)))
    each = points.withColumn("o", o)
    place = {i: F.rint(c).cast("int") + F.col(f"o.o{c}") for i, c in zip(VOXEL, XYZ, strict=True)}
    each = each.withColumns(place).drop("o")
    w = F.lit(1.0)
    for i, c in zip(VOXEL, XYZ, strict=True):
        w = w * F.greatest(F.lit(0.0), 1 - F.abs(F.col(i) - F.col(c)))
    return each.withColumn("w", w)


def soft_encoded(points: DataFrame, side: int = 48, margin: float = 1) -> DataFrame:
    """voxels(mol_id, channel, ix, iy, iz, v) of points(mol_id, channel, x, y, z): each adds 1 in all, shared by volume among the voxels that its cube meets.

    Points out of bounds add nothing.
    """
    inside = points.where(in_bounds(tuple(map(F.col, XYZ)), side, margin))
    return _around(inside).where("w > 0").groupBy("mol_id", "channel", *VOXEL).agg(F.sum("w").alias("v"))


def hard_encoded(points: DataFrame, side: int = 48) -> DataFrame:
    """Counts of points by the voxel nearest to them."""
    inside = points.where(in_bounds(tuple(map(F.col, XYZ)), side, 0))
    return inside.groupBy("mol_id", "channel", *(F.rint(c).cast("int").alias(i) for i, c in zip(VOXEL, XYZ, strict=True))).agg(F.count(F.lit(1)).cast("double").alias("v"))


def gaussian_kernel(var: float = 0.15, trunc: float = 1.5, resolution: float = 0.5, fine: int = 7) -> list[tuple[int, int, int, float]]:
    """Offsets and weights of a Gaussian cut at trunc, averaged over fine^3 points a voxel; the greatest weight is 1."""
    side = int(2 * trunc // resolution)
    side += side % 2 == 0
    n = side * fine
    axis = np.arange(n) - n // 2
    d2 = axis[:, None, None] ** 2 + axis[None, :, None] ** 2 + axis[None, None, :] ** 2
    dense = np.exp(-d2 / (2 * var / resolution**2 * fine**2)) * (d2 <= (trunc / resolution * fine) ** 2)
    mean = dense.reshape(side, fine, side, fine, side, fine).mean(axis=(1, 3, 5))
    mean /= mean.max()
    half = side // 2
    return [(int(a) - half, int(b) - half, int(c) - half, float(mean[a, b, c])) for a, b, c in np.argwhere(mean > 0)]


def density(voxels: DataFrame, kernel: list[tuple[int, int, int, float]], side: int = 48) -> DataFrame:
    """The grid convolved with a kernel, nothing beyond its borders. The kernel, k^3 weights (343 at most by default), is a literal array."""
    k = F.array(*(F.struct(*(F.lit(v).alias(f"o{c}") for c, v in zip(XYZ, at, strict=True)), F.lit(w).alias("kw")) for *at, w in kernel))
    spread = voxels.select("mol_id", "channel", *VOXEL, "v", F.inline(k))
    spread = spread.select("mol_id", "channel", *((F.col(i) + F.col(f"o{c}")).alias(i) for i, c in zip(VOXEL, XYZ, strict=True)), (F.col("v") * F.col("kw")).alias("v"))
    inside = spread.where(" and ".join(f"{i} between 0 and {side - 1}" for i in VOXEL))
    return inside.groupBy("mol_id", "channel", *VOXEL).agg(F.sum("v").alias("v"))


def half_resolution(voxels: DataFrame) -> DataFrame:
    """Means of blocks of two voxels a side."""
    return voxels.groupBy("mol_id", "channel", *(F.floor(F.col(i) / 2).cast("int").alias(i) for i in VOXEL)).agg((F.sum("v") / 8).alias("v"))


def total_density(voxels: DataFrame, channels: list[int]) -> DataFrame:
    return voxels.where(F.col("channel").isin(channels)).groupBy("mol_id", *VOXEL).agg(F.sum("v").alias("v"))


def decoded(points: DataFrame, voxels: DataFrame, tight: bool = False) -> DataFrame:
    """points(mol_id, atom_idx, channel, x, y, z) with place decoded from the grid: rounded place plus the weighted mean of the offsets around it.

    tight: only the eight voxels that border the point. A point without weight around it stays null.
    """
    each = _around(points.withColumns({f"p{c}": F.col(c) for c in XYZ})).where("w > 0") if tight else _around(points.withColumns({f"p{c}": F.col(c) for c in XYZ}))
    got = each.join(voxels.select("mol_id", "channel", *VOXEL, "v"), ["mol_id", "channel", *VOXEL])
    return got.groupBy("mol_id", "atom_idx", "channel").agg(*((F.sum(F.col("v") * F.col(i)) / F.sum("v")).alias(c) for i, c in zip(VOXEL, XYZ, strict=True)))


def values_at(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """points with v of their rounded place and channel, 0 where there is none."""
    at = points.withColumns({i: F.rint(c).cast("int") for i, c in zip(VOXEL, XYZ, strict=True)})
    return at.join(voxels, ["mol_id", "channel", *VOXEL], "left").fillna(0.0, ["v"]).drop(*VOXEL)


def steric_overlap(ligand: DataFrame, protein: DataFrame) -> DataFrame:
    """Per molecule the sum over voxels of the protein's greatest channel times (v clamped to [-1, 1]) / 2 + 1/2 of the ligand's channels."""
    most = protein.groupBy("mol_id", *VOXEL).agg(F.max("v").alias("most"))
    both = ligand.join(most, ["mol_id", *VOXEL])
    part = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v"))) / 2 + 0.5
    return both.groupBy("mol_id").agg(F.sum(F.col("most") * part).alias("overlap"))


def _empty_border(points: DataFrame, voxels: DataFrame, side: int, edge: int = 8) -> DataFrame:
    """points(mol_id, atom_idx, channel, n, ix, iy, iz) with empty, the border voxels (ix, iy, iz) of each that are in the grid and not among voxels.

    Voxels meet points as blocks of edge a side, of which a point borders eight at most and
    mostly one or two, and not as one row for each of its 26 border voxels.
    """
    block = [f"b{c}" for c in XYZ]
    key = ["mol_id", "channel"]
    code = lambda v: (v[0] % edge * edge + v[1] % edge) * edge + v[2] % edge
    full = voxels.select(*key, *(F.floor(F.col(i) / edge).cast("int").alias(b) for i, b in zip(VOXEL, block, strict=True)), code([F.col(i) for i in VOXEL]).alias("code"))
    full = full.groupBy(*key, *block).agg(F.collect_set("code").alias("full"))
    met = points.where(" and ".join(f"{i} between -1 and {side}" for i in VOXEL))
    for i, b in zip(VOXEL, block, strict=True):
        low, high = (F.floor(v / edge).cast("int") for v in (F.greatest(F.col(i) - 1, F.lit(0)), F.least(F.col(i) + 1, F.lit(side - 1))))
        met = met.withColumn(b, F.explode(F.sequence(low, high)))
    border = F.array(*(F.struct(*((F.col(i) + v).alias(i) for i, v in zip(VOXEL, o, strict=True))) for o in BORDER))
    here = lambda o: reduce(and_, ((o[i] >= F.greatest(F.lit(0), F.col(b) * edge)) & (o[i] < F.least(F.lit(side), F.col(b) * edge + edge)) for i, b in zip(VOXEL, block, strict=True)))
    empty = F.filter(border, lambda o: here(o) & (F.col("full").isNull() | ~F.array_contains("full", code([o[i] for i in VOXEL]))))
    each = met.join(full, [*key, *block], "left").select(*points.columns, empty.alias("empty"))
    return each.groupBy(*points.columns).agg(F.flatten(F.collect_list("empty")).alias("empty"))


def with_encoding_noise(voxels: DataFrame, points: DataFrame, p: float, seed: str, side: int = 48) -> DataFrame:
    """The grid with noise: at a share p of the points, one to four empty border voxels of the point's box get a uniform share of the grid's greatest value.

    n border voxels are filled with a probability in proportion to 10^-n. The grid is made once and read from the shared folder.
    """
    voxels = scratch(voxels.select("mol_id", "channel", *VOXEL, "v"), "voxels")
    most = voxels.groupBy("mol_id").agg(F.max("v").alias("most"))
    u = lambda name, *more: uniform(f"{seed}{name}", F.col("mol_id"), F.col("atom_idx"), F.col("channel"), *more)
    steps = np.cumsum([10.0**-n for n in range(1, 5)]) / sum(10.0**-n for n in range(1, 5))
    n = F.lit(4)
    for k in (3, 2, 1):
        n = F.when(u("n") < float(steps[k - 1]), k).otherwise(n)
    some = points.where(u("point") < p).select("mol_id", "atom_idx", "channel", n.alias("n"), *(F.rint(c).cast("int").alias(i) for i, c in zip(VOXEL, XYZ, strict=True)))
    empty = _empty_border(some, voxels, side)
    at = {i: (lambda o, i=i: o[i]) for i in VOXEL}
    ordered = F.array_sort(F.transform("empty", lambda o: F.struct(u("order", *(f(o) for f in at.values())).alias("u"), *(f(o).alias(i) for i, f in at.items()))))
    chosen = empty.select("mol_id", "atom_idx", "channel", F.explode(F.slice(ordered, F.lit(1), F.col("n"))).alias("o"))
    chosen = chosen.select("mol_id", "atom_idx", "channel", *(F.col(f"o.{i}").alias(i) for i in VOXEL)).join(most, "mol_id")
    ident = tuple(map(F.col, VOXEL))
    noise = chosen.select("mol_id", "channel", *VOXEL, (u("value", *ident) * F.col("most")).alias("v")).groupBy("mol_id", "channel", *VOXEL).agg(F.max("v").alias("v"))
    return voxels.select("mol_id", "channel", *VOXEL, "v").unionByName(noise)


def noise_atoms(atoms: DataFrame, elements: list[int], seed: str, tries: int = 20, least: float = 2.0, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Per molecule one more atom, of a random element, at the first of some random places that is least or farther from all others; none if no place is."""
    u = lambda name: uniform(f"{seed}{name}", F.col("mol_id"), F.col("attempt"))
    places = atoms.groupBy("mol_id").agg((F.max("atom_idx") + 1).alias("atom_idx")).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    places = places.select("mol_id", "atom_idx", "attempt", *((low + u(c) * (high - low)).alias(c) for c in XYZ), F.element_at(F.array(*map(F.lit, elements)), (F.floor(u("element") * len(elements)) + 1).cast("int")).alias("atomic_num"))
    near = places.join(atoms.select("mol_id", *(F.col(c).alias(f"o{c}") for c in XYZ)), "mol_id").groupBy("mol_id", "attempt").agg(F.min(distance(tuple(map(F.col, XYZ)), tuple(F.col(f"o{c}") for c in XYZ))).alias("gap"))
    first = near.where(F.col("gap") >= least).groupBy("mol_id").agg(F.min("attempt").alias("attempt"))
    return places.join(first, ["mol_id", "attempt"]).drop("attempt")


def assigned_types(points: DataFrame, voxels: DataFrame, elements: list[int], start: DataFrame | None = None, least: float = 0.15, side: int = 48, inherit: float = 0.5) -> DataFrame:
    """mol_id, atom_idx, channels of points from the density around them: channels whose weighted sum is least or more, of elements only the strongest.

    A point within inherit of a start(mol_id, x, y, z, channels) point has its channels.
    Molecules with a point out of bounds have no rows.
    """
    out = points.where(~in_bounds(tuple(map(F.col, XYZ)), side, 0)).select("mol_id").distinct()
    kept = points.select("mol_id", "atom_idx", *XYZ).join(out, "mol_id", "left_anti")
    sums = _around(kept).where("w > 0").join(voxels.select("mol_id", "channel", *VOXEL, "v"), ["mol_id", *VOXEL]).groupBy("mol_id", "atom_idx", "channel").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    is_element = F.col("channel").isin(elements)
    strong = sums.where(F.col("s") >= least).groupBy("mol_id", "atom_idx").agg(F.max(F.when(is_element, F.struct("s", -F.col("channel")))).alias("best"), F.collect_set(F.when(~is_element, F.col("channel"))).alias("others"))
    best = F.when(F.col("best").isNotNull(), F.array(-F.col("best").getField("col2"))).otherwise(F.array().cast("array<int>"))
    got = kept.select("mol_id", "atom_idx", *XYZ).join(strong.select("mol_id", "atom_idx", F.sort_array(F.concat(best, "others")).alias("channels")), ["mol_id", "atom_idx"], "left")
    got = got.withColumn("channels", F.coalesce("channels", F.array().cast("array<int>")))
    if start is not None:
        known = start.select("mol_id", *(F.col(c).alias(f"s{c}") for c in XYZ), F.col("channels").alias("known"))
        gap = distance(tuple(map(F.col, XYZ)), tuple(F.col(f"s{c}") for c in XYZ))
        near = got.select("mol_id", "atom_idx", *XYZ).join(known, "mol_id").withColumn("gap", gap).where(F.col("gap") <= inherit)
        near = near.groupBy("mol_id", "atom_idx").agg(F.min(F.struct("gap", "known")).alias("n")).select("mol_id", "atom_idx", F.col("n.known").alias("known"))
        got = got.join(near, ["mol_id", "atom_idx"], "left").withColumn("channels", F.coalesce("known", "channels")).drop("known")
    return got.drop(*XYZ)


def channels_of(vocab: DataFrame, channels: DataFrame, low: int, high: int) -> DataFrame:
    """Channels with a type number in [low, high], with their kind: element, feature or bond."""
    return channels.join(vocab, channels.type_num == vocab.num).where(F.col("num").between(low, high)).groupBy("ch").agg(F.min("grp").alias("kind"), F.sort_array(F.collect_set("name")).alias("names"))


def union_in_order(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))
