"""Fragments, rings and ring systems of many small graphs.

A molecule's graph is small, so one task solves it whole; what Spark deals out are
molecules. Graphs reach the helpers in Arrow batches, not one call a group.
"""

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import plain_unions
from .rings import blocks, core


def _graphs(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_id, atoms (sorted array), i and j of the bonds."""
    plain_unions(bonds.sparkSession)
    a = atoms.groupBy("mol_id").agg(F.sort_array(F.collect_set("atom_idx")).alias("atoms"))
    b = bonds.groupBy("mol_id").agg(F.sort_array(F.collect_set(F.struct("i", "j"))).alias("b"))
    none = F.array().cast("array<long>")
    return a.join(b, "mol_id", "left").select("mol_id", F.col("atoms").cast("array<long>").alias("atoms"), *(F.coalesce(F.col(f"b.{c}").cast("array<long>"), none).alias(c) for c in "ij"))


def _solved(graphs: DataFrame, solve: Callable, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, *r) for m, *graph in zip(pdf.mol_id, pdf.atoms, pdf.i, pdf.j, strict=True) for r in solve(*(list(map(int, g)) for g in graph))]
            yield pd.DataFrame(rows, columns=names)

    return graphs.mapInPandas(run, schema)


def components(atoms: list[int], i: list[int], j: list[int]) -> dict[int, int]:
    """Least atom of each atom's fragment."""
    up = {a: a for a in atoms}

    def root(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in zip(i, j, strict=True):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {a: root(a) for a in atoms}


def fragments(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_id, atom_idx, fragment: the least atom connected with it."""
    return _solved(_graphs(atoms, bonds), lambda a, i, j: sorted(components(a, i, j).items()), "mol_id long, atom_idx long, fragment long")


def fragments_by_joins(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """The same for graphs of any size: labels spread along bonds, and jump to their label's label, until none changes."""
    ends = bonds.select("mol_id", F.col("i").alias("a"), F.col("j").alias("b")).union(bonds.select("mol_id", "j", "i"))
    now = atoms.select("mol_id", F.col("atom_idx").alias("a"), F.col("atom_idx").alias("label")).distinct()
    while True:
        near = ends.join(now.select("mol_id", F.col("a").alias("b"), "label"), ["mol_id", "b"]).groupBy("mol_id", "a").agg(F.min("label").alias("least"))
        step = now.join(near, ["mol_id", "a"], "left").select("mol_id", "a", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        jump = step.select("mol_id", F.col("a").alias("label"), F.col("label").alias("up"))
        step = step.join(jump, ["mol_id", "label"], "left").select("mol_id", "a", F.coalesce("up", "label").alias("label"), "was").checkpoint()
        if step.where("label <> was").isEmpty():
            return step.select("mol_id", F.col("a").alias("atom_idx"), F.col("label").alias("fragment"))
        now = step.drop("was")


def largest_fragment(frags: DataFrame) -> DataFrame:
    """frags with is_largest: the fragment of most atoms, of equals the one with the least atom; the others are the remainder."""
    size = frags.groupBy("mol_id", "fragment").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("mol_id").agg(F.max_by("fragment", F.struct("n", -F.col("fragment"))).alias("largest"))
    return frags.join(best, "mol_id").select("mol_id", "atom_idx", "fragment", (F.col("fragment") == F.col("largest")).alias("is_largest"))


def ring_counts(atoms: DataFrame, bonds: DataFrame, frags: DataFrame) -> DataFrame:
    """Bonds less atoms plus fragments: the number of independent rings."""
    a = atoms.groupBy("mol_id").agg(F.countDistinct("atom_idx").alias("a"))
    b = bonds.select("mol_id", "i", "j").distinct().groupBy("mol_id").agg(F.count(F.lit(1)).alias("b"))
    c = frags.groupBy("mol_id").agg(F.countDistinct("fragment").alias("c"))
    return a.join(b, "mol_id", "left").join(c, "mol_id").select("mol_id", (F.coalesce("b", F.lit(0)) - F.col("a") + F.col("c")).alias("n_rings"))


def _block_rings(bonds: list[tuple[int, int]]) -> list[list[int]]:
    """A smallest set of independent rings of one biconnected block, as sorted lists of atoms, in order of size.

    Candidates are, for each atom and bond, the shortest paths from the atom to the bond's
    ends, closed by it; they are taken from the shortest up as long as they are independent.
    """
    bonds = sorted(bonds)
    number = {b: k for k, b in enumerate(bonds)}
    near: dict[int, list[int]] = {}
    for a, b in bonds:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    wanted, found = len(bonds) - len(near) + 1, set()
    if wanted == 1:
        return [sorted(near)]
    for start in near:
        before, queue = {start: None}, deque([start])
        while queue:
            a = queue.popleft()
            for b in sorted(near[a]):
                if b not in before:
                    before[b] = a
                    queue.append(b)

        def path(a, before=before):
            out = [a]
            while before[out[-1]] is not None:
                out.append(before[out[-1]])
            return out

        for a, b in bonds:
            p, q = path(a), path(b)
            if set(p) & set(q) == {start} and len(p) + len(q) > 3:
                ring = [*p, *reversed(q[:-1])]
                edges = frozenset(number[min(x, y), max(x, y)] for x, y in zip(ring, [*ring[1:], ring[0]], strict=True))
                found.add((len(edges), tuple(sorted(ring)), edges))
    chosen, rows = [], {}
    for _, ring, edges in sorted(found, key=lambda f: (f[0], f[1], sorted(f[2]))):
        bits = sum(1 << e for e in edges)
        while bits and bits.bit_length() in rows:
            bits ^= rows[bits.bit_length()]
        if bits:
            rows[bits.bit_length()] = bits
            chosen.append(list(ring))
            if len(chosen) == wanted:
                break
    return chosen


def ring_blocks(mol: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, list[list[tuple[int, int]]]]]:
    """(molecule, its blocks of bonds) of the bonds of many molecules; those without a ring are told by their bonds' numbers alone and left out.

    Atoms with one bond are stripped again and again, which leaves the 2-core, and only that is searched.
    """
    if not len(mol):
        return
    names, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    low, high = (mol * len(names) + p for p in np.split(place, 2))
    nodes, at = np.unique(np.concatenate([low, high]), return_inverse=True)
    low, high = np.split(at, 2)
    low, high = np.minimum(low, high), np.maximum(low, high)
    once = np.unique((low * len(nodes) + high)[low != high])
    low, high = once // len(nodes), once % len(nodes)
    left = core(len(nodes), low, high)
    low, high = low[left], high[left]
    of = blocks(low, high)
    of_mol, name = nodes // len(names), names[nodes % len(names)].tolist()
    by_block: dict[int, list[tuple[int, int]]] = {}
    for b, x, y in zip(of.tolist(), low.tolist(), high.tolist(), strict=True):
        if b >= 0:
            by_block.setdefault(b, []).append((x, y))
    by_mol: dict[int, list] = {}
    for found in by_block.values():
        by_mol.setdefault(int(of_mol[found[0][0]]), []).append([(min(name[x], name[y]), max(name[x], name[y])) for x, y in found])
    yield from sorted(by_mol.items())


def _merged_rings(found: list[list[tuple[int, int]]]) -> list[list[int]]:
    """Rings of all blocks of a molecule: the sets of different blocks are independent of each other."""
    return sorted((r for block in found for r in _block_rings(block)), key=lambda r: (len(r), r))


def ring_basis(atoms: list[int], i: list[int], j: list[int]) -> list[list[int]]:
    """A smallest set of independent rings of one graph, as sorted lists of atoms, in order of size."""
    pairs = np.array([i, j], dtype=np.int64).reshape(2, -1)
    return [r for _, found in ring_blocks(np.zeros(pairs.shape[1], dtype=np.int64), *pairs) for r in _merged_rings(found)]


def _ringed(graphs: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """Rows that solve makes of the rings of each molecule that has any. Molecules stay rows: there is no exchange."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, i, j = b.columns
            mol = np.repeat(np.arange(b.num_rows), i.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            rows = [(m, *r) for m, found in ring_blocks(mol, i.flatten().to_numpy(zero_copy_only=False), j.flatten().to_numpy(zero_copy_only=False)) for r in solve(_merged_rings(found))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64(), *(_KINDS[c.split()[1]] for c in schema.split(", ")[1:])]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(arrays[0]).cast(pa.int64()), *arrays[1:]], names=names)

    return graphs.select("mol_id", "i", "j").mapInArrow(run, schema)


_KINDS = {"int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def rings(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_id, ring, size, members of a smallest set of independent rings."""
    return _ringed(_graphs(atoms, bonds), lambda found: [(k, len(r), r) for k, r in enumerate(found)], "mol_id long, ring int, size int, members array<long>")


def systems(found: list[list[int]], share: int) -> list[list[int]]:
    """Numbers of the rings that hang together by share atoms or more."""
    pairs = [(a, b) for a in range(len(found)) for b in range(a) if len(set(found[a]) & set(found[b])) >= share]
    of = components(list(range(len(found))), [a for a, _ in pairs], [b for _, b in pairs])
    return [[r for r in of if of[r] == s] for s in sorted(set(of.values()))]


def ring_systems(atoms: DataFrame, bonds: DataFrame, by_bond: bool = False) -> DataFrame:
    """mol_id, system, n_rings, members, loop: rings that share an atom (or a bond) together.

    loop: the system's rings close around a hole, so that there are more neighbouring pairs of them than a tree has.
    """

    def solve(found):
        out = []
        for k, numbers in enumerate(systems(found, 2 if by_bond else 1)):
            pairs = sum(1 for a in numbers for b in numbers if a < b and set(found[a]) & set(found[b]))
            shared = any(sum(x in found[r] for r in numbers) > 2 for r in numbers for x in found[r])
            out.append((k, len(numbers), sorted({a for r in numbers for a in found[r]}), pairs >= len(numbers) > 2 and not shared))
        return out

    return _ringed(_graphs(atoms, bonds), solve, "mol_id long, system int, n_rings int, members array<long>, loop boolean")


def ring_system_limits(found: DataFrame) -> DataFrame:
    """Per molecule the most rings of a system and the number of loops, for the filter's caps."""
    return found.groupBy("mol_id").agg(F.max("n_rings").alias("ring_system_size"), F.count_if("loop").cast("int").alias("ring_loops"))
