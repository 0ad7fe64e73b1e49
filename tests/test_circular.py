"""Circular fingerprints and ring membership against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from molmill.operators.circular import Molecules, circular_fingerprints, molecule_rows
from molmill.operators.rings import blocks, core, in_rings
from molmill.plans.queries import QUERIES
from molmill.plans.registry import view

SF, MASK = "/root/testdata/sf0.001", 2**64 - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def fold(h, *values):
    for v in values:
        h = mix(h ^ (v & MASK))
    return h


def on_a_ring(bonds, atom):
    """Whether an atom can be left by one bond and reached again by another."""
    for b in bonds:
        if atom in b:
            start = next(iter(b - {atom}))
            seen, todo = {start}, [start]
            while todo:
                at = todo.pop()
                for c in bonds:
                    if at in c and c != b:
                        to = next(iter(c - {at}))
                        if to not in seen:
                            seen.add(to)
                            todo.append(to)
            if atom in seen:
                return True
    return False


def plain(atoms, bonds, radius=2, heavy=True):
    """Identifiers of one molecule: atoms {idx: (number, charge)}, bonds [(i, j, order)]; bond sets as sets."""
    order = {}
    for i, j, o in bonds:
        if i in atoms and j in atoms and i != j:
            order[frozenset((i, j))] = min(o, order.get(frozenset((i, j)), o))
    near = lambda a: [(b, next(iter(b - {a}))) for b in order if a in b]
    hydrogens = dict.fromkeys(atoms, 0)
    if heavy:
        gone = [a for a in atoms if atoms[a][0] == 1 and len(near(a)) == 1 and atoms[near(a)[0][1]][0] != 1]
        for a in gone:
            hydrogens[near(a)[0][1]] += 1
        order = {b: o for b, o in order.items() if not b & set(gone)}
        atoms = {a: v for a, v in atoms.items() if a not in gone}
    ids = {a: fold(0, len(near(a)), sum(round(2 * order[b]) for b, _ in near(a)), *atoms[a], hydrogens[a], on_a_ring(set(order), a)) for a in atoms}
    found, covered, kept = list(ids.values()), {a: frozenset() for a in atoms}, {}
    for r in range(1, radius + 1):
        now, grown = {}, {}
        for a in atoms:
            h = fold(ids[a], r)
            for twice, other in sorted((round(2 * order[b]), ids[x]) for b, x in near(a)):
                h = fold(h, twice, other)
            now[a] = h
            grown[a] = covered[a].union(*(covered[x] | {b} for b, x in near(a))) if near(a) else covered[a]
        ids, covered = now, grown
        for a in atoms:
            if covered[a]:
                kept.setdefault(covered[a], []).append((r, ids[a]))
    return found + [min(v)[1] for v in kept.values()]


def table(spark, molecules):
    atoms = spark.createDataFrame([(m, i, n, c) for m, (a, _) in molecules.items() for i, (n, c) in a.items()], "mol_id long, atom_idx long, atomic_num int, charge int")
    bonds = spark.createDataFrame([(m, i, j, o) for m, (_, b) in molecules.items() for i, j, o in b], "mol_id long, i long, j long, bond_order double")
    return molecule_rows(atoms, bonds)


def drawn(rng, n):
    atoms = {i * 7 + 3: (rng.choice([1, 6, 6, 6, 7, 8]), rng.choice([0, 0, 0, 1, -1])) for i in range(n)}
    idx = list(atoms)
    bonds = [(idx[rng.randrange(k)], idx[k], rng.choice([1.0, 1.5, 2.0])) for k in range(1, n) if rng.random() < 0.9]
    bonds += [(*rng.sample(idx, 2), 1.0) for _ in range(rng.randrange(4))] if n > 1 else []
    return atoms, bonds + ([(idx[0], idx[0], 1.0), (idx[0], 9999, 1.0)] if rng.random() < 0.2 else [])


def test_fingerprints_against_plain_loops(spark):
    rng = random.Random(6)
    molecules = {k: drawn(rng, rng.choice([1, 2, 3, 5, 8, 12, 20, 90])) for k in range(60)}
    for heavy in (True, False):
        for radius, n_bits in ((0, 64), (2, 2048), (3, 1024)):
            got = {r.mol_id: r for r in circular_fingerprints(table(spark, molecules), radius, n_bits, heavy).collect()}
            for k, (atoms, bonds) in molecules.items():
                want = sorted({h % n_bits for h in plain(atoms, bonds, radius, heavy)})
                assert got[k].on_bits == want
                assert sum((w & MASK) << (64 * i) for i, w in enumerate(got[k].words)) == sum(1 << b for b in want) and len(got[k].words) == n_bits // 64


def test_whole_table(spark):
    atoms, bonds = {}, {}
    for r in view(spark, SF, "v_atoms").collect():
        atoms.setdefault(r.mol_id, {})[r.atom_idx] = (r.atomic_num, r.charge)
    for r in view(spark, SF, "v_bonds").collect():
        bonds.setdefault(r.mol_id, []).append((r.i, r.j, r.bond_order))
    got = {r.mol_id: r.on_bits for r in QUERIES["l4_circular_fingerprints"](spark, SF).collect()}
    assert got == {m: sorted({h % 2048 for h in plain(a, bonds.get(m, []))}) for m, a in atoms.items()}


def identifiers(numbers, bonds, radius=2):
    x = np.array(bonds, dtype=float).reshape(-1, 3)
    zero = np.zeros(len(numbers), dtype=np.int64)
    m = Molecules(1, zero, np.arange(len(numbers)), np.array(numbers), zero, np.zeros(len(x), dtype=np.int64), x[:, 0].astype(int), x[:, 1].astype(int), x[:, 2])
    return sorted(m.features(radius)[1].tolist())


def test_equal_bond_sets_stay_once():
    # Ethane: two atoms of one identifier, one bond; the second atom's and the second round's identifiers cover that same bond.
    ethane = identifiers([6, 6], [(0, 1, 1.0)])
    assert len(ethane) == 3 and len(set(ethane)) == 2
    # Propane: each end covers its bond in the first round; the middle in the first covers both, which the ends' second round would repeat.
    propane = identifiers([6, 6, 6], [(0, 1, 1.0), (1, 2, 1.0)])
    assert len(propane) == 3 + 3
    # A ring of three: first round, three different pairs of bonds; second round, all three bonds once.
    assert len(identifiers([6] * 3, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0)])) == 3 + 3 + 1
    # Explicit hydrogens count on their carbon: other identifiers than a bare one, and no atoms of their own.
    methane = identifiers([6, 1, 1, 1, 1], [(0, k, 1.0) for k in range(1, 5)])
    assert len(methane) == 1 and methane != identifiers([6], [])
    assert len(identifiers([1, 1], [(0, 1, 1.0)])) == 3


def test_numbering_and_awkward_rows_change_nothing(spark):
    rng = random.Random(8)
    molecules = {k: drawn(rng, 9) for k in range(10)}
    turned = {k: ({500 - i: v for i, v in reversed(list(a.items()))}, [(500 - j, 500 - i, o) for i, j, o in reversed(b)]) for k, (a, b) in molecules.items()}
    bits = lambda t: {r.mol_id: r.on_bits for r in circular_fingerprints(t).collect()}
    assert bits(table(spark, molecules)) == bits(table(spark, turned))
    odd = spark.createDataFrame(
        [(1, None, None), (2, [], []), (None, [(5, 6, 0)], None), (3, [(0, 6, 0), (1, 6, 0)], [(0, 1, 1.0), (1, 0, 1.0), (0, 1, 2.0)]), (4, [(0, 6, 0), (1, 6, 0)], [(0, 1, 1.0)]), (4, [(0, 6, 0), (1, 6, 0)], [(0, 1, 1.0)])],
        "mol_id long, atoms array<struct<idx: long, number: long, charge: long>>, bonds array<struct<i: long, j: long, bond_order: double>>",
    ).withColumn("on_bits", F.lit(1))
    got = [(r.mol_id, r.on_bits) for r in circular_fingerprints(odd).collect()]
    assert len(got) == 6 and dict(got)[1] == dict(got)[2] == [] and len(dict(got)[None]) == 1 and dict(got)[3] == dict(got)[4] and got.count((4, dict(got)[4])) == 2
    assert circular_fingerprints(odd.limit(0)).count() == 0


def test_no_exchange_after_molecules_are_rows(spark):
    at = spark.createDataFrame(table(spark, {1: drawn(random.Random(1), 5)}).collect(), table(spark, {}).schema)
    assert "Exchange" not in circular_fingerprints(at)._jdf.queryExecution().executedPlan().toString()


def test_rings_of_drawn_graphs():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 14)
        bonds = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 18))}) if n > 1 else []
        low, high = (np.array([b[k] for b in bonds], dtype=np.int64) for k in (0, 1))
        sets = {frozenset(b) for b in bonds}
        assert in_rings(n, low, high).tolist() == [on_a_ring(sets, a) for a in range(n)]
        # Two bonds are in one block if they lie on one simple loop: neither single atom's removal parts them.
        of = blocks(low, high)
        for x in range(len(bonds)):
            bridge = not _joined(sets - {frozenset(bonds[x])}, *bonds[x])
            assert (of[x] < 0) == bridge
        assert not (of[~core(n, low, high)] >= 0).any()
    # Two triangles that share an atom are two blocks; a long chain between rings is in the core, but in no ring.
    assert len(set(blocks(np.array([0, 1, 0, 2, 3, 2]), np.array([1, 2, 2, 3, 4, 4])).tolist())) == 2
    chain = in_rings(10, np.array([0, 1, 0, 2, 3, 4, 5, 6, 5]), np.array([1, 2, 2, 3, 4, 5, 6, 7, 7]))
    assert chain.tolist() == [True, True, True, False, False, True, True, True, False, False]


def _joined(sets, a, b):
    seen, todo = {a}, [a]
    while todo:
        at = todo.pop()
        for s in sets:
            if at in s:
                todo += [x for x in s - {at} if x not in seen]
                seen |= s
    return b in seen


def test_rings_by_blocks(spark):
    """Rings of drawn graphs: as many as there are independent ones, each a loop, independent, and as short as any set can be."""
    from molmill.operators.graphs import ring_basis, rings

    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(2, 11)
        bonds = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 15))})
        got = ring_basis(list(range(n)), [b[0] for b in bonds], [b[1] for b in bonds])
        number = {b: k for k, b in enumerate(bonds)}
        loops = set()

        def walk(path, bonds=bonds, loops=loops):
            for a, b in bonds:
                if path[-1] in (a, b):
                    to = b if path[-1] == a else a
                    if to == path[0] and len(path) > 2:
                        loops.add(frozenset(tuple(sorted(x)) for x in zip(path, [*path[1:], path[0]], strict=True)))
                    elif to > path[0] and to not in path:
                        walk([*path, to])

        for start in range(n):
            walk([start])
        sizes, rows = [], {}
        for loop in sorted(loops, key=len):  # the shortest set: loops from the shortest up, as long as they are independent
            bits = sum(1 << number[b] for b in loop)
            while bits and bits.bit_length() in rows:
                bits ^= rows[bits.bit_length()]
            if bits:
                rows[bits.bit_length()] = bits
                sizes.append(len(loop))
        assert [len(r) for r in got] == sizes
        atom_sets = {frozenset(a for b in loop for a in b) for loop in loops}
        assert all(frozenset(r) in atom_sets for r in got)
    atoms = spark.createDataFrame([(m, a) for m in range(3) for a in range(6)], "mol_id long, atom_idx long")
    bonds = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 3), (1, 3, 4)], "mol_id long, i long, j long")
    found = rings(atoms, bonds)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2  # those that make molecules rows
    assert sorted((r.mol_id, r.ring, r.members) for r in found.collect()) == [(1, 0, [0, 1, 2]), (1, 1, [3, 4, 5])]
