"""Column expressions: geometry, units, bins, padding, seeded uniform numbers."""

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import BOND_OF_ORDER, BONDS, FEATURES, NUMBER, N_TYPES, SYMBOLS, literal_map


def uniform(seed: str, *keys: Column) -> Column:
    """In [0, 1), the same for equal seed and keys whatever the plan: the leading 32 bits of a hash."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def distance(a: tuple, b: tuple) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: tuple, b: tuple) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def rotation(angles: tuple[Column, Column, Column], degrees: bool = False) -> list[list[Column]]:
    """Matrix of turning about the fixed axes z, y and x, in this order, by three angles."""
    (a, b, c) = (F.radians(v) if degrees else v for v in angles)
    (ca, sa), (cb, sb), (cc, sc) = ((F.cos(v), F.sin(v)) for v in (a, b, c))
    # x-turn times y-turn times z-turn
    return [
        [cb * ca, -cb * sa, sb],
        [sc * sb * ca + cc * sa, -sc * sb * sa + cc * ca, -sc * cb],
        [-cc * sb * ca + sc * sa, cc * sb * sa + sc * ca, cc * cb],
    ]


def transformed(m: list[list], v: tuple, inverse: bool = False) -> tuple[Column, ...]:
    """Matrix times vector; the inverse of a rotation is its transpose."""
    return tuple(sum((v[j] * (m[j][i] if inverse else m[i][j]) for j in range(3)), F.lit(0.0)) for i in range(3))


def translated(v: tuple, by: tuple, inverse: bool = False) -> tuple[Column, ...]:
    return tuple(p - q if inverse else p + q for p, q in zip(v, by, strict=True))


def to_voxel(c: Column, centre: Column | float, size: float = 24.0, resolution: float = 0.5) -> Column:
    return c / resolution + (int(size / resolution) / 2 - 0.5) - centre / resolution


def from_voxel(v: Column, centre: Column | float, size: float = 24.0, resolution: float = 0.5) -> Column:
    return (v - (int(size / resolution) / 2 - 0.5) + centre / resolution) * resolution


def in_bounds(v: tuple, side: int = 48, pad: float = 0) -> Column:
    """All in [pad, side - pad - 1); missing coordinates count as inside."""
    inside = F.lit(True)
    for c in v:
        inside = inside & (c >= pad) & (c < side - pad - 1)
    return F.coalesce(inside, F.lit(True))


def bin_index(v: Column, edges: list[float]) -> Column:
    """i with edges[i] < v <= edges[i + 1]; null outside."""
    i = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < v)) - 1
    return F.when((v > edges[0]) & (v <= edges[-1]), i)


def padded(a: Column, n: int, fill: Column) -> Column:
    return F.concat(a, F.array_repeat(fill, F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def unpadded(a: Column, fill) -> Column:
    return F.filter(a, lambda v: ~v.eqNullSafe(F.lit(fill)))


def multi_hot(nums: Column, n: int = N_TYPES) -> Column:
    """Vector of n zeros and ones; number 0 and less are ignored."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i > 0) & F.array_contains(nums, i), 1).otherwise(0))


def from_multi_hot(v: Column) -> Column:
    return F.filter(F.transform(v, lambda x, i: F.when((x == 1) & (i > 0), i)), lambda i: i.isNotNull())


def type_number(name: Column) -> Column:
    return F.coalesce(
        *(F.when(name.rlike(f"^{p}[0-9]+$"), F.regexp_extract(name, "[0-9]+", 0).cast("int") + base) for p, base in (("e", 0), ("bto", 118))), literal_map(FEATURES | BONDS)[name]
    )


def bond_type(order: Column) -> Column:
    return literal_map(BOND_OF_ORDER)[order.cast("double")]


def atomic_number(symbol: Column) -> Column:
    """Of an element's symbol in any case; null if there is none."""
    return literal_map({s.upper(): n for s, n in NUMBER.items()})[F.upper(F.trim(symbol))]


def symbol_of(number: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in SYMBOLS)), (number - 1).cast("int"))


def feature_types(number: Column, hbd: Column, hba: Column, aromatic: Column, charge: Column) -> Column:
    """Type numbers of an atom: its element, its flags, the sign of its charge."""
    flag = lambda c, name: F.when(c, FEATURES[name])
    sign = F.when(charge > 0, FEATURES["FChargePos"]).when(charge < 0, FEATURES["FChargeNeg"]).otherwise(FEATURES["FChargeNeut"])
    return F.array_compact(F.array(number.cast("int"), flag(hbd, "HBD"), flag(hba, "HBA"), flag(aromatic, "Aromatic"), sign))


def rescaled_sa(sa: Column) -> Column:
    return F.floor((10 - sa) / 9 * 100 + 0.5) / 100


def lennard_jones(r: Column, r_min: float, depth: float, p1: int = 12, p2: int = 6) -> Column:
    """depth times ((s / r)^p1 - (s / r)^p2), with s such that the least value is at r_min."""
    s = r_min * (p1 / p2) ** (1 / (p2 - p1))
    return depth * (F.pow(s / r, F.lit(p1)) - F.pow(s / r, F.lit(p2)))


def soft_clamp(x: Column, limit: float = 5.0) -> Column:
    return F.tanh(x / limit) * limit


def gaussian(d2: Column, var: float) -> Column:
    return F.exp(-d2 / (2 * var))


def angle(a: tuple, at: tuple, b: tuple) -> Column:
    """Degrees between the directions from at to a and b; null if one of them is nil."""
    u, v = translated(a, at, True), translated(b, at, True)
    dot = sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))
    norm = F.sqrt(sum((p * p for p in u), F.lit(0.0))) * F.sqrt(sum((p * p for p in v), F.lit(0.0)))
    return F.when(norm > 0, F.acos(F.greatest(F.least(dot / norm, F.lit(1.0)), F.lit(-1.0))) * (180 / pi))
