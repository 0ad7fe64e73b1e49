"""Distances, range joins, transforms and bond geometry."""

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import angle, distance, lennard_jones, rotation, squared_distance, transformed, translated, uniform
from ..functions.vocab import RADIUS, VALENCE, literal_map
from ..storage import scratch

XYZ = ("x", "y", "z")


def _at(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in XYZ)


def _cell(edge: float) -> list[Column]:
    return [F.floor(F.col(c) / edge).alias(f"cell_{c}") for c in XYZ]


def _each(groups: DataFrame, solve, schema: str) -> DataFrame:
    """Rows that solve makes of each row of groups, in Arrow batches of many small groups."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [out for row in pdf.itertuples(index=False) for out in solve(*row)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pd.DataFrame({n: pd.array(c, dtype="Float64" if k.endswith("double") else "Int64") for n, k, c in zip(names, schema.split(", "), map(list, columns), strict=True)})

    return groups.mapInPandas(run, schema)


def near_pairs(left: DataFrame, right: DataFrame, key: str, radius: float) -> DataFrame:
    """Rows of left beside rows of right (columns r_…) of their key at radius or less, with d.

    Cells of the radius' edge turn the range into an equi-join: left rows go to the 27
    cells around theirs.
    """
    spread = left.select("*", *_cell(radius))
    for c in XYZ:
        spread = spread.withColumn(f"cell_{c}", F.explode(F.array(*(F.col(f"cell_{c}") + s for s in (-1, 0, 1)))))
    r = right.select(F.col(key), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key), *_cell(radius))
    cells = [f"cell_{c}" for c in XYZ]
    return spread.join(r, [key, *cells]).withColumn("d", distance(_at(), _at("r_"))).where(F.col("d") <= radius).drop(*cells)


FEW = 256  # points of a key up to which all pairs of it cost less than sending points to 27 cells


def _few_and_many(left: DataFrame, right: DataFrame, key: str) -> list[tuple[DataFrame, DataFrame, bool]]:
    """left and right in parts, and whether the keys of a part have no more than FEW points on either side."""
    sides = [left] if left is right else [left, right]
    over = (rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select(key) for rows in sides)
    many = scratch(reduce(DataFrame.union, over).distinct(), "many")
    if many.isEmpty():
        return [(left, right, True)]
    return [(*(side.join(many, key, kind) for side in (left, right)), kind == "left_anti") for kind in ("left_anti", "left_semi")]


def _near_parts(left: DataFrame, right: DataFrame, key: str, radius: float) -> list[tuple[DataFrame, bool]]:
    """near_pairs in parts: keys of few points, which meet by their key alone, and the others, which go to cells."""

    def by_key(a, b):
        r = b.select(F.col(key), *(F.col(c).alias(f"r_{c}") for c in b.columns if c != key))
        return a.join(r, key).withColumn("d", distance(_at(), _at("r_"))).where(F.col("d") <= radius)

    return [((by_key if few else lambda a, b: near_pairs(a, b, key, radius))(a, b), few) for a, b, few in _few_and_many(left, right, key)]


def pocket(receptor: DataFrame, ligand: DataFrame, radius: float = 8.0, key: str = "pdb_id") -> DataFrame:
    """Receptor atoms of every residue that has an atom within radius of a ligand atom; radius 0 or less is the whole receptor."""
    if radius <= 0:
        return receptor
    residue = [key, "chain", "res_num"]
    # The ligand has fewer atoms, so it is the side that goes to the cells around.
    near = near_pairs(ligand.select(key, *XYZ), receptor.select(*residue, *XYZ), key, radius)
    return receptor.join(near.select(key, *(F.col(f"r_{c}").alias(c) for c in residue[1:])).distinct(), residue, "left_semi")


def self_pairs(atoms: DataFrame, condition: Column) -> DataFrame:
    """mol_id, i, j, d of atom pairs i < j of a molecule for which the condition on d holds."""
    a = atoms.select("mol_id", F.col("atom_idx").alias("i"), *(F.col(c).alias(f"a{c}") for c in XYZ))
    b = atoms.select("mol_id", F.col("atom_idx").alias("j"), *(F.col(c).alias(f"b{c}") for c in XYZ))
    return a.join(b, "mol_id").where("i < j").withColumn("d", distance(_at("a"), _at("b"))).where(condition).select("mol_id", "i", "j", "d")


def candidate_bonds(atoms: DataFrame, bonds: DataFrame, radius: float = 3.5) -> DataFrame:
    """Pairs nearer than radius that are not bonded."""
    return self_pairs(atoms, F.col("d") < radius).join(bonds.select("mol_id", "i", "j"), ["mol_id", "i", "j"], "left_anti")


def fragment_candidates(atoms: DataFrame, frags: DataFrame, radius: float = 3.0) -> DataFrame:
    """Pairs of atoms of different fragments nearer than radius, with nth, their rank by distance in the molecule."""
    f = frags.select("mol_id", "atom_idx", "fragment")
    pairs = self_pairs(atoms, F.col("d") < radius)
    pairs = pairs.join(f.withColumnsRenamed({"atom_idx": "i", "fragment": "fi"}), ["mol_id", "i"]).join(f.withColumnsRenamed({"atom_idx": "j", "fragment": "fj"}), ["mol_id", "j"]).where("fi <> fj")
    order = Window.partitionBy("mol_id").orderBy("d", "i", "j")
    return pairs.select("mol_id", "i", "j", "fi", "fj", "d", F.row_number().over(order).alias("nth"))


def free_valences(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_id, atom_idx, valence (whole part of the sum of bond orders) and cap; sulphur with two oxygens or more about it may have 6."""
    ends = bonds.select("mol_id", F.col("i").alias("atom_idx"), F.col("j").alias("other"), "bond_order").union(bonds.select("mol_id", "j", "i", "bond_order"))
    oxygen = atoms.where("atomic_num = 8").select("mol_id", F.col("atom_idx").alias("other"), F.lit(1).alias("o"))
    used = ends.join(oxygen, ["mol_id", "other"], "left").groupBy("mol_id", "atom_idx").agg(F.sum("bond_order").alias("s"), F.count("o").alias("oxygens"))
    cap = F.when((F.col("atomic_num") == 16) & (F.coalesce("oxygens", F.lit(0)) >= 2), 6).otherwise(literal_map(VALENCE)[F.col("atomic_num")])
    return atoms.join(used, ["mol_id", "atom_idx"], "left").select("mol_id", "atom_idx", F.floor(F.coalesce("s", F.lit(0.0))).cast("int").alias("valence"), cap.alias("cap"))


def connected_fragments(atoms: DataFrame, bonds: DataFrame, frags: DataFrame, radius: float = 3.0, check_valence: bool = True) -> DataFrame:
    """New bonds (mol_id, i, j, d): the closest pair of two fragments whose atoms have a free valence, again and again until none is left."""
    free = free_valences(atoms, bonds).select("mol_id", F.col("atom_idx").alias("i"), (F.col("cap") - F.col("valence")).alias("free"))
    pairs = fragment_candidates(atoms, frags, radius).join(free.withColumnRenamed("free", "free_i"), ["mol_id", "i"]).join(free.withColumnsRenamed({"i": "j", "free": "free_j"}), ["mol_id", "j"])

    def join(mol_id, found):
        up: dict = {}
        left: dict = {}

        def root(a):
            while up.get(a, a) != a:
                a = up[a]
            return a

        for r in found:
            i, j = r["i"], r["j"]
            left.setdefault(i, r["free_i"])
            left.setdefault(j, r["free_j"])
            a, b = root(r["fi"]), root(r["fj"])
            if a != b and (not check_valence or (left[i] >= 1 and left[j] >= 1)):
                up[b] = a
                left[i] -= 1
                left[j] -= 1
                yield mol_id, i, j, r["d"]

    groups = pairs.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("nth", "i", "j", "fi", "fj", "d", "free_i", "free_j"))).alias("found"))
    return _each(groups, join, "mol_id long, i long, j long, d double")


def _sizes(parts: list[tuple[DataFrame, bool]], key: str, at_once: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of keys with at most at_once of them, and the others; None without any. Keys of few points are not counted."""
    few = [pairs for pairs, few in parts if few and FEW * FEW <= at_once]
    rest = [pairs for pairs, few in parts if not few or FEW * FEW > at_once]
    if not rest:
        return few[0], None
    pairs = reduce(DataFrame.unionByName, rest)
    large = scratch(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > at_once).select(key), "large")
    if large.isEmpty():
        return reduce(DataFrame.unionByName, [*few, pairs]), None
    return reduce(DataFrame.unionByName, [*few, pairs.join(large, key, "left_anti")]), scratch(pairs.join(large, key, "left_semi"), "pairs")


def _matched(near: DataFrame, key: str) -> DataFrame:
    """key, i, j, d: what pairing the closest of near(key, i, j, d) again and again gives, in rounds.

    A round takes all pairs that are the closest both of their i and of their j: nothing
    that is taken earlier in the sequence could be in their way.
    """
    found, order = [], F.struct("d", "i", "j")
    while not near.isEmpty():
        least = {c: near.groupBy(key, c).agg(F.min(order).alias(f"least_{c}")) for c in "ij"}
        both = near.join(least["i"], [key, "i"]).join(least["j"], [key, "j"]).where((F.col("least_i") == order) & (F.col("least_j") == order))
        taken = scratch(both.select(key, "i", "j", "d"), "taken")
        found.append(taken)
        near = scratch(near.join(taken.select(key, "i"), [key, "i"], "left_anti").join(taken.select(key, "j"), [key, "j"], "left_anti").select(key, "i", "j", "d"), "pairs")
    return reduce(DataFrame.unionByName, found)


def greedy_pairs(a: DataFrame, b: DataFrame, key: str = "mol_id", radius: float = 3.0, at_once: int = 500_000) -> DataFrame:
    """key, i, j, d: the closest points of a and b (key, idx, x, y, z), then the closest of the rest, up to radius; j null: not paired, and i for b's.

    Of equal distances the lower i, then j, comes first. A key with more than at_once near
    pairs is paired by joins, in rounds; the others are each one task's work.
    """
    near = _near_parts(a.select(key, "idx", *XYZ), b.select(key, "idx", *XYZ), key, radius)
    small, large = _sizes([(rows.select(key, F.col("idx").alias("i"), F.col("r_idx").alias("j"), "d"), few) for rows, few in near], key, at_once)
    listed = small.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("d", "i", "j"))).alias("near"))

    def pair(k, found):
        used_i, used_j = set(), set()
        for r in found:
            if r["i"] not in used_i and r["j"] not in used_j:
                used_i.add(r["i"])
                used_j.add(r["j"])
                yield k, r["i"], r["j"], r["d"]

    pairs = _each(listed, pair, f"{key} long, i long, j long, d double")
    if large is not None:
        pairs = pairs.unionByName(_matched(large, key))
    pairs = scratch(pairs, "matched")
    none = {c: F.lit(None).cast(k) for c, k in (("i", "long"), ("j", "long"), ("d", "double"))}
    alone = lambda rows, mine, other: (
        rows.select(key, F.col("idx").cast("long").alias(mine)).join(pairs.select(key, mine), [key, mine], "left_anti").withColumns({c: none[c] for c in (other, "d")})
    )
    return pairs.unionByName(alone(a, "i", "j")).unionByName(alone(b, "j", "i"))


def _boxes(points: DataFrame, key: str, edge: float) -> DataFrame:
    """key, cell_x, cell_y, cell_z and the least and greatest coordinates (lx, hx, ...) of the points in each cell that is not empty."""
    sides = [f(c).alias(p + c) for c in XYZ for f, p in ((F.min, "l"), (F.max, "h"))]
    return points.select(key, *XYZ, *_cell(edge)).groupBy(key, *_CELLS).agg(*sides)


_CELLS = [f"cell_{c}" for c in XYZ]


def _wider(boxes: DataFrame, key: str, level: int) -> DataFrame:
    """Boxes of cells 2^level times as wide, with their own parents' numbers (up_x, ...)."""
    at = [F.shiftright(c, level).alias(c) for c in _CELLS]
    sides = [f(p + c).alias(p + c) for c in XYZ for f, p in ((F.min, "l"), (F.max, "h"))]
    grouped = boxes.select(key, *at, *(p + c for c in XYZ for p in "lh")).groupBy(key, *_CELLS).agg(*sides) if level else boxes
    return grouped.select("*", *(F.shiftright(c, 1).alias(f"up_{c[-1]}") for c in _CELLS))


def nearest_point(candidates: DataFrame, points: DataFrame, key: str = "mol_id", radius: float = 2.0) -> DataFrame:
    """Per candidate(key, idx) the nearest of the points(key, p) of its key, and how far it is; of equals the first.

    Keys of FEW candidates and points at most meet whole. In the others, candidates with a point within radius are settled by a join of cells. The others go
    down a tree of cells, each half as wide as the one above: of a candidate's open cells those stay whose nearest
    corner is no further than the furthest of the best one's, so that in the end it meets
    the points of a few cells only, however far they are and however many lie together. Candidates and points
    without a coordinate, and keys without points, have no row.
    """
    whole = lambda rows, *c: rows.where(reduce(and_, (F.col(v).isNotNull() & ~F.isnan(v) for v in XYZ))).select(key, *c, *(F.col(v).cast("double").alias(v) for v in XYZ))
    c, p = whole(candidates, "idx"), whole(points, "p")
    best = lambda rows, of: rows.groupBy(key, "idx").agg(F.min(F.struct("d", of)).alias("b")).select(key, "idx", F.col(f"b.{of}").alias("p"), F.col("b.d").alias("d"))
    parts = _few_and_many(c, p, key)
    all_of = lambda a, b: best(a.join(b.select(key, F.col("p").alias("r_p"), *(F.col(v).alias(f"r_{v}") for v in XYZ)), key).withColumn("d", distance(_at(), _at("r_"))), "r_p")
    settled = [all_of(a, b) for a, b, few in parts if few]
    if len(parts) == 1:
        return settled[0]
    c, p = parts[1][:2]
    near = scratch(best(near_pairs(c, p, key, radius), "r_p"), "near")
    left = scratch(c.join(near.select(key, "idx"), [key, "idx"], "left_anti").join(p.select(key).distinct(), key, "left_semi"), "far")
    near = near.unionByName(settled[0])
    if left.isEmpty():
        return near
    boxes = scratch(_boxes(p, key, radius), "boxes")
    most = boxes.agg(*(F.max(F.abs(v)) for v in _CELLS)).head()
    top = int(max(most)).bit_length()  # there every cell is 0 or -1 on each axis
    low = reduce(lambda a, b: a + b, (F.greatest(F.lit(0.0), F.col(f"l{v}") - F.col(v), F.col(v) - F.col(f"h{v}")) ** 2 for v in XYZ))
    high = reduce(lambda a, b: a + b, (F.greatest(F.abs(F.col(f"l{v}") - F.col(v)), F.abs(F.col(f"h{v}") - F.col(v))) ** 2 for v in XYZ))
    open_ = None
    for level in range(top, -1, -1):
        cells = _wider(boxes, key, level)
        if open_ is None:
            met = left.join(cells, key)  # eight cells a key at most
        else:
            met = open_.withColumnsRenamed({v: f"up_{v[-1]}" for v in _CELLS}).join(cells, [key, *(f"up_{v}" for v in XYZ)])
        met = met.select(key, "idx", *XYZ, *_CELLS, low.alias("low"), high.alias("high"))
        reach = F.min("high").over(Window.partitionBy(key, "idx"))
        open_ = met.withColumn("reach", reach).where(F.col("low") <= F.col("reach") * (1 + 1e-9) + 1e-12).select(key, "idx", *XYZ, *_CELLS)
        if level % 4 == 0:
            open_ = scratch(open_, "open")  # plans do not grow with the tree
    r = p.select(key, "p", *(F.col(v).alias(f"r_{v}") for v in XYZ), *_cell(radius))
    far = open_.join(r, [key, *_CELLS]).withColumn("d", distance(_at(), _at("r_")))
    return near.unionByName(best(far, "p"))


def squared_distances(a: DataFrame, b: DataFrame, key: str = "mol_id") -> DataFrame:
    """key, i, j, d2 of every point of a with every point of b of the same key."""
    left = a.select(key, F.col("idx").alias("i"), *(F.col(c).alias(f"a{c}") for c in XYZ))
    right = b.select(key, F.col("idx").alias("j"), *(F.col(c).alias(f"b{c}") for c in XYZ))
    return left.join(right, key).select(key, "i", "j", squared_distance(_at("a"), _at("b")).alias("d2"))


def rotated(atoms: DataFrame, angles, inverse: bool = False, degrees: bool = False) -> DataFrame:
    m = rotation(angles, degrees)
    v = transformed(m, _at(), inverse)
    return atoms.withColumns(dict(zip(XYZ, v, strict=True)))


def moved(atoms: DataFrame, by, inverse: bool = False) -> DataFrame:
    return atoms.withColumns(dict(zip(XYZ, translated(_at(), by, inverse), strict=True)))


def random_pose(atoms: DataFrame, seed: str, max_shift: float, tries: int = 8, side: float = 24.0, key: str = "mol_id", others: DataFrame | None = None) -> DataFrame:
    """Each key's atoms turned and moved at random, by the first of some tries after which all lie in the box about 0; else as they were.

    Angles are uniform in [0, 2 pi), shifts (u - 0.5) times max_shift. attempt is the try
    taken, null for none. Rows of others (the receptor) are moved as their key is, and
    returned in its place.
    """
    u = lambda name: uniform(seed, F.lit(name), F.col(key), F.col("attempt"))
    tried = atoms.select(key, *XYZ, F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))

    def posed(rows):
        turned = transformed(rotation(tuple(u(f"angle{c}") * (2 * np.pi) for c in XYZ)), _at())
        return rows.withColumns({f"n{c}": v + (u(f"shift{c}") - 0.5) * max_shift for c, v in zip(XYZ, turned, strict=True)})

    inside = reduce(and_, ((F.col(f"n{c}") >= -side / 2) & (F.col(f"n{c}") < side / 2) for c in XYZ))
    good = posed(tried).groupBy(key, "attempt").agg(F.bool_and(inside).alias("ok")).where("ok").groupBy(key).agg(F.min("attempt").alias("attempt"))
    rows = (atoms if others is None else others).join(good, key, "left")
    return posed(rows).withColumns({c: F.when(F.col("attempt").isNotNull(), F.col(f"n{c}")).otherwise(F.col(c)) for c in XYZ}).drop(*(f"n{c}" for c in XYZ))


def bond_lengths(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """bonds with length, stretch (over the sum of covalent radii) and log_stretch (|log2 stretch|).

    Radii are added as decimals and rounded once, so that equal sums are equal and ties of stretches stay ties.
    """
    end = lambda k: atoms.select("mol_id", F.col("atom_idx").alias(k), *(F.col(c).alias(f"{k}{c}") for c in XYZ), literal_map(RADIUS)[F.col("atomic_num")].cast("decimal(9,4)").alias(f"{k}r"))
    both = bonds.join(end("i"), ["mol_id", "i"]).join(end("j"), ["mol_id", "j"])
    length = distance(_at("i"), _at("j"))
    stretch = length / (F.col("ir") + F.col("jr")).cast("double")
    return both.select("mol_id", "i", "j", "bond_order", length.alias("length"), stretch.alias("stretch"), F.abs(F.log2(stretch)).alias("log_stretch"))


def bond_angles(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_id, atom, a < b (its neighbours), degrees."""
    ends = bonds.select("mol_id", F.col("i").alias("atom"), F.col("j").alias("n")).union(bonds.select("mol_id", "j", "i"))
    where = lambda k, p: atoms.select("mol_id", F.col("atom_idx").alias(k), *(F.col(c).alias(f"{p}{c}") for c in XYZ))
    pairs = ends.withColumnRenamed("n", "a").join(ends.withColumnRenamed("n", "b"), ["mol_id", "atom"]).where("a < b")
    each = pairs.join(where("atom", "o"), ["mol_id", "atom"]).join(where("a", "a"), ["mol_id", "a"]).join(where("b", "b"), ["mol_id", "b"])
    return each.select("mol_id", "atom", "a", "b", angle(_at("a"), _at("o"), _at("b")).alias("degrees"))


def geometry_report(atoms: DataFrame, bonds: DataFrame, stretch: float = 1.8, sharp: float = 50.0) -> DataFrame:
    """Per molecule with any: how many bonds are longer than stretch times usual, how many angles are sharper than sharp degrees."""
    long_ = bond_lengths(atoms, bonds).where(F.col("stretch") > stretch).groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_stretched"))
    tight = bond_angles(atoms, bonds).where(F.col("degrees") < sharp).groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_sharp"))
    return long_.join(tight, "mol_id", "full").fillna(0, ["n_stretched", "n_sharp"])


def excess_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """An atom's bonds by stretch, the most stretched first (nth), and whether they are beyond what its valence allows (excess)."""
    s = bond_lengths(atoms, bonds).select("mol_id", "i", "j", "stretch")
    ends = s.select("mol_id", F.col("i").alias("atom_idx"), "i", "j", "stretch").union(s.select("mol_id", "j", "i", "j", "stretch"))
    order = Window.partitionBy("mol_id", "atom_idx").orderBy(F.desc("stretch"), "i", "j")
    ranked = ends.withColumn("nth", F.row_number().over(order)).join(free_valences(atoms, bonds), ["mol_id", "atom_idx"])
    return ranked.select("mol_id", "atom_idx", "i", "j", "stretch", "nth", (F.col("nth") <= F.col("valence") - F.col("cap")).alias("excess"))


def pair_potential(atoms: DataFrame, r_min: float = 3.0, depth: float = 1.0, least: float = 0.0) -> DataFrame:
    """Half the sum over ordered atom pairs, so the sum over pairs, of the pair potential; pairs at least or nearer are left out."""
    p = self_pairs(atoms, F.col("d") > least).groupBy("mol_id").agg(F.sum(lennard_jones(F.col("d"), r_min, depth)).alias("potential"))
    return atoms.select("mol_id").distinct().join(p, "mol_id", "left").fillna(0.0, ["potential"])


def bond_midpoints(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    end = lambda k: atoms.select("mol_id", F.col("atom_idx").alias(k), *(F.col(c).alias(f"{k}{c}") for c in XYZ))
    both = bonds.join(end("i"), ["mol_id", "i"]).join(end("j"), ["mol_id", "j"])
    return both.select("mol_id", "i", "j", "bond_order", *(((F.col(f"i{c}") + F.col(f"j{c}")) / 2).alias(c) for c in XYZ))


def _outlived(near: DataFrame, key: str) -> DataFrame:
    """key, j that go, of near(key, i, j), i before j: those near an earlier one that stays, in rounds.

    A round settles every point without an earlier one that is still open: it stays, and what is near it goes.
    """
    found = []
    while not near.isEmpty():
        stays = near.select(key, "i").distinct().join(near.select(key, F.col("j").alias("i")), [key, "i"], "left_anti")
        gone = scratch(near.join(stays, [key, "i"], "left_semi").select(key, "j").distinct(), "gone")
        found.append(gone)
        near = scratch(near.join(gone, [key, "j"], "left_anti").join(gone.withColumnRenamed("j", "i"), [key, "i"], "left_anti"), "near")
    return reduce(DataFrame.unionByName, found)


def pruned(points: DataFrame, radius: float = 0.9, key: str = "mol_id", at_once: int = 500_000) -> DataFrame:
    """points(key, idx, fixed, x, y, z) without those nearer than radius to an earlier one that stays; fixed ones stay.

    A key with more than at_once near pairs is settled by joins, in rounds; the others are each one task's work.
    """
    rows = points.select(key, "idx", "fixed", *XYZ)
    close = lambda both: both.where("idx < r_idx and not r_fixed").where(F.col("d") < radius).select(key, F.col("idx").alias("i"), F.col("r_idx").alias("j"))
    small, large = _sizes([(close(both), few) for both, few in _near_parts(rows, rows, key, radius)], key, at_once)

    def drop(k, found):
        gone: set = set()
        for r in found:  # in order of j, so what is before a point is settled
            if r["i"] not in gone and r["j"] not in gone:
                gone.add(r["j"])
                yield k, r["j"]

    gone = _each(small.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("j", "i"))).alias("found")), drop, f"{key} long, idx long")
    if large is not None:
        gone = gone.unionByName(_outlived(large, key).withColumnRenamed("j", "idx"))
    return points.join(gone.distinct(), [key, "idx"], "left_anti")
