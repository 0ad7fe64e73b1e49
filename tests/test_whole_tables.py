"""Queries without SQL against plain loops over the whole of the smallest tables."""

from collections import defaultdict
from itertools import combinations
from math import floor, isclose

import numpy as np
import pytest

from molmill.plans.queries import QUERIES
from molmill.plans.registry import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mols(spark):
    out = defaultdict(list)
    for r in view(spark, SF, "v_atoms").orderBy("mol_id", "atom_idx").collect():
        out[r.mol_id].append(r)
    return out


def bonds_of(spark, name):
    out = defaultdict(set)
    for r in view(spark, SF, name).select("mol_id", "i", "j").collect():
        out[r.mol_id].add((min(r.i, r.j), max(r.i, r.j)))
    return out


def got(spark, name):
    return QUERIES[name](spark, SF).collect()


def at(r):
    return r.x, r.y, r.z


def gap(a, b):
    return sum((p - q) ** 2 for p, q in zip(at(a), at(b), strict=True)) ** 0.5


def groups(atoms, pairs):
    """Label of each atom: the least one reachable."""
    label = {a: a for a in atoms}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_j10_greedy_pairs(spark, mols):
    want = []
    for m, rows in mols.items():
        a, b = ([r for r in rows if r.record == k] for k in ("ATOM", "HETATM"))
        left, right = {r.atom_idx for r in a}, {r.atom_idx for r in b}
        for d, i, j in sorted((gap(p, q), p.atom_idx, q.atom_idx) for p in a for q in b if gap(p, q) <= 3):
            if i in left and j in right:
                want.append((m, i, j, floor(d * 1e6 + 0.5) / 1e6))
                left.remove(i)
                right.remove(j)
        want += [(m, i, None, None) for i in left] + [(m, None, j, None) for j in right]
    have = [(r.mol_id, r.i, r.j, r.d) for r in got(spark, "j10_greedy_pairs")]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_v10_pruned(spark, mols):
    want = set()
    for m, rows in mols.items():
        stays = []
        for r in rows:
            if r.record == "ATOM" or all(gap(r, s) >= 2 for s in stays):
                stays.append(r)
        want |= {(m, r.atom_idx) for r in stays}
    assert {(r.mol_id, r.idx) for r in got(spark, "v10_pruned")} == want


def test_j7_connected_fragments(spark, mols):
    from molmill.functions.vocab import VALENCE

    orders = defaultdict(list)
    for r in view(spark, SF, "v_bonds").collect():
        orders[r.mol_id].append((r.i, r.j, r.bond_order))
    want = []
    for m, rows in mols.items():
        free = {}
        for r in rows:
            mine = [(o, b if a == r.atom_idx else a) for a, b, o in orders[m] if r.atom_idx in (a, b)]
            limit = 6 if r.atomic_num == 16 and sum(rows[k].atomic_num == 8 for _, k in mine) >= 2 else VALENCE[r.atomic_num]
            free[r.atom_idx] = limit - int(sum(o for o, _ in mine))
        label = groups(free, [(a, b) for a, b, _ in orders[m]])
        pairs = sorted((gap(p, q), p.atom_idx, q.atom_idx) for p, q in combinations(rows, 2) if gap(p, q) < 3 and label[p.atom_idx] != label[q.atom_idx])
        for d, i, j in pairs:
            if label[i] != label[j] and free[i] >= 1 and free[j] >= 1:
                old, new = label[j], label[i]
                label = {a: new if x == old else x for a, x in label.items()}
                free[i] -= 1
                free[j] -= 1
                want.append((m, i, j, floor(d * 1e6 + 0.5) / 1e6))
    have = [(r.mol_id, r.i, r.j, r.d) for r in got(spark, "j7_connected_fragments")]
    assert sorted(have) == sorted(want)


def cycles(atoms, pairs):
    """All simple cycles as sets of edges, with their atoms."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    found = {}

    def walk(path):
        for b in near[path[-1]]:
            if b == path[0] and len(path) > 2:
                edges = frozenset((min(x, y), max(x, y)) for x, y in zip(path, [*path[1:], path[0]], strict=True))
                found[edges] = sorted(path)
            elif b > path[0] and b not in path:
                walk([*path, b])

    for a in atoms:
        walk([a])
    return found


def basis_sizes(found, pairs):
    """Sizes of a smallest set of independent cycles, of all simple cycles."""
    number = {p: k for k, p in enumerate(sorted(pairs))}
    sizes, rows = [], {}
    for edges in sorted(found, key=len):
        bits = sum(1 << number[e] for e in edges)
        while bits and bits.bit_length() in rows:
            bits ^= rows[bits.bit_length()]
        if bits:
            rows[bits.bit_length()] = bits
            sizes.append(len(edges))
    return sizes


def test_g2_rings_g3_ring_systems_and_q8_caps(spark, mols):
    fused = bonds_of(spark, "v_fused")
    rings, systems = defaultdict(list), defaultdict(list)
    for r in got(spark, "g2_rings"):
        rings[r.mol_id].append(list(r.members))
        assert r.size == len(r.members)
    for r in got(spark, "g3_ring_systems"):
        systems[r.mol_id].append((r.n_rings, list(r.members), r.loop))
    kept = set()
    for m, rows in mols.items():
        found = cycles([r.atom_idx for r in rows], fused[m])
        assert sorted(map(len, rings[m])) == sorted(basis_sizes(found, fused[m])) and all(r in found.values() for r in rings[m])
        touching = [(a, b) for a, b in combinations(range(len(rings[m])), 2) if set(rings[m][a]) & set(rings[m][b])]
        label = groups(range(len(rings[m])), touching)
        want = [[k for k in label if label[k] == s] for s in sorted(set(label.values()))]
        assert sorted((n, x) for n, x, _ in systems[m]) == sorted((len(k), sorted({a for r in k for a in rings[m][r]})) for k in want)
        loops = 0
        for k in want:
            pairs = sum(a in k for a, _ in touching)
            most = max(sum(a in rings[m][r] for r in k) for r in k for a in rings[m][r])
            loops += pairs >= len(k) > 2 and most <= 2
        assert loops == sum(x for *_, x in systems[m])
        if max(map(len, want), default=0) <= 2 and not loops:
            kept.add(m)
    assert {r.mol_id for r in got(spark, "q8_ring_system_caps")} == kept


def test_a8_shape_ratios(spark, mols):
    have = {r.mol_id: (r.npr1, r.npr2) for r in got(spark, "a8_shape_ratios")}
    from molmill.functions.vocab import WEIGHT

    checked = 0
    for m, rows in mols.items():
        if m in have and have[m][0] is not None:
            w, p = np.array([WEIGHT[r.atomic_num] for r in rows]), np.array([at(r) for r in rows])
            p = p - (w[:, None] * p).sum(axis=0) / w.sum()
            inertia = sum(k * (v @ v * np.eye(3) - np.outer(v, v)) for k, v in zip(w, p, strict=True))
            e = np.linalg.eigvalsh(inertia)
            if e[2] > 1e-9:
                checked += 1
                assert isclose(have[m][0], e[0] / e[2], abs_tol=2e-4) and isclose(have[m][1], e[1] / e[2], abs_tol=2e-4), m
    assert checked > 500


def test_l3_butina_clusters(spark):
    by_group = defaultdict(list)
    for r in view(spark, SF, "embeddings").select("vec_id", "label", "embedding").collect():
        by_group[r.label].append((r.vec_id, sum(1 << k for k, v in enumerate(r.embedding) if v > 0)))
    want = {}
    for rows in by_group.values():
        near = {a: {b for b, y in rows if a != b and (x | y) and (x & y).bit_count() / (x | y).bit_count() >= 0.4 - 1e-12} for a, x in rows}
        left, number = set(near), 0
        while left:
            leader = max(left, key=lambda a: (len(near[a] & left), a))
            members = {leader} | (near[leader] & left)
            want.update(dict.fromkeys(members, number))
            left -= members
            number += 1
    assert {r.mol_id: r.cluster for r in got(spark, "l3_butina_clusters")} == want


def test_circular_neighbours_and_clusters(spark):
    bits, by_group = {}, defaultdict(list)
    for r in got(spark, "l4_circular_fingerprints"):
        bits[r.mol_id] = sum(1 << b for b in r.on_bits)
        by_group[r.mol_id // 970].append(r.mol_id)
    likeness = lambda a, b: (bits[a] & bits[b]).bit_count() / (bits[a] | bits[b]).bit_count()
    pairs, want = {}, {}
    for ids in by_group.values():
        near = {a: set() for a in ids}
        for a, b in combinations(sorted(ids), 2):
            t = likeness(a, b)
            if t >= 0.5 - 1e-12:
                pairs[a, b] = floor(t * 1e6 + 0.5) / 1e6
                near[a].add(b)
                near[b].add(a)
        left, number = set(ids), 0
        while left:
            leader = max(left, key=lambda a: (len(near[a] & left), a))
            members = {leader} | (near[leader] & left)
            want.update(dict.fromkeys(members, number))
            left -= members
            number += 1
    assert pairs and {(r.a, r.b): r.similarity for r in got(spark, "l2_circular_neighbours")} == pairs
    assert {r.mol_id: r.cluster for r in got(spark, "l3_circular_clusters")} == want


def test_df3_diverse_selection_takes_every_clusters_best_first(spark):
    cluster = {r.mol_id: r.cluster for r in got(spark, "l3_butina_clusters")}
    picked = defaultdict(list)
    for r in got(spark, "df3_diverse_selection"):
        picked[r.grp].append(r.mol_id)
    members = defaultdict(list)
    for r in view(spark, SF, "embeddings").select("vec_id", "label").collect():
        members[r.label].append(r.vec_id)
    for g, ids in members.items():
        score = lambda i: (-(i * 37 % 101), i)
        rank = {}
        for c in {cluster[i] for i in ids}:
            for k, i in enumerate(sorted((i for i in ids if cluster[i] == c), key=score)):
                rank[i] = k
        want = sorted(ids, key=lambda i: (rank[i], score(i)))[:5]
        assert sorted(picked[g]) == sorted(want)


def test_df3_selection(spark):
    rows = [r for r in view(spark, SF, "v_scores").collect() if r.dock_success]
    first = defaultdict(list)
    for r in rows:
        if r.model == "initial" and r.affinity is not None:
            first[r.pdb_id].append(r.affinity)
    low = {p: float(np.quantile(v, 0.75)) for p, v in first.items()}
    last = [r for r in rows if r.model == "run_opt3" and r.pdb_id in low and r.affinity is not None and r.affinity < low[r.pdb_id]]
    bits = {r.vec_id: sum(1 << k for k, v in enumerate(r.embedding) if v > 0) for r in view(spark, SF, "embeddings").select("vec_id", "embedding").collect()}
    want = set()
    for p in {r.pdb_id for r in last}:
        mine = {r.mol_idx: r.affinity for r in last if r.pdb_id == p and r.mol_idx in bits}
        near = {a: {b for b in mine if a != b and (bits[a] & bits[b]).bit_count() / (bits[a] | bits[b]).bit_count() >= 0.4 - 1e-12} for a in mine}
        left, rank, number, cluster = set(mine), {}, 0, {}
        while left:
            leader = max(left, key=lambda a: (len(near[a] & left), a))
            for k, i in enumerate(sorted({leader} | (near[leader] & left), key=lambda i: (mine[i], i))):
                rank[i], cluster[i] = k, number
            left -= {leader} | near[leader]
            number += 1
        for k, i in enumerate(sorted(mine, key=lambda i: (rank[i], mine[i], i))[:5]):
            want.add((p, i, cluster[i], k + 1))
    assert want and {tuple(r) for r in got(spark, "df3_selection")} == want


def test_a_sketch_of_quantiles_is_near_the_exact_ones(spark):
    from molmill.operators.scores import quantiles

    s = view(spark, SF, "v_scores")
    exact, near = ({r.pdb_id: r.threshold for r in quantiles(s, 0.5, exact=e).collect()} for e in (True, False))
    assert exact.keys() == near.keys() and all(abs(exact[k] - near[k]) < 15 for k in exact)


def test_complex_voxels_keep_mass(spark):
    from molmill.functions.vocab import CHANNELS, channel_table
    from molmill.plans.jobs import complex_voxels
    from pyspark.sql import functions as F

    atoms = view(spark, SF, "v_atoms").where("mol_id < 200").select("mol_id", "atom_idx", *((F.col(c) - 5).alias(c) for c in "xyz"), F.array(F.col("atomic_num")).alias("types"))
    made = {k: v.cache() for k, v in complex_voxels(atoms, channel_table(spark, CHANNELS)).items()}
    known = channel_table(spark, CHANNELS).select(F.col("type_num").alias("n")).distinct()
    n = atoms.join(known, F.col("types")[0] == F.col("n")).count()
    total = {k: v.agg(F.sum("v")).head()[0] for k, v in made.items()}
    assert n and isclose(total["grid"], n, rel_tol=1e-6) and isclose(total["half"] * 8, total["density"], rel_tol=1e-6) and total["density"] > total["grid"]
