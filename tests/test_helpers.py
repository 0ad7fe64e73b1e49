"""Helpers against plain loops, round trips, invariants, files."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from molmill.functions import expr as E
from molmill.functions import vocab as V
from molmill.operators import filters as O
from molmill.operators import geometry as G
from molmill.operators import graphs
from molmill.operators import sampling as S
from molmill.operators import scores
from molmill.operators import similarity as L
from molmill.operators import voxels as X
from molmill.sources import parse as P
from molmill.sources import readers as R
from molmill.sources import writers as W
from molmill.streaming import ingest as T

ATOMS = "mol_id long, atom_idx long, atomic_num int, x double, y double, z double, charge int, types array<int>"
BONDS = "mol_id long, i long, j long, bond_order double"


def made(spark, n_mols=20, seed=1):
    r = random.Random(seed)
    atoms, bonds = [], []
    for m in range(n_mols):
        n = r.randrange(1, 14)
        atoms += [(m, a, r.choice([1, 6, 6, 7, 8, 16]), *(round(r.uniform(-5, 5), 3) for _ in "xyz"), r.choice([-1, 0, 1]), [6, 301]) for a in range(n)]
        pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(n + 2)} if n > 1 else set()
        bonds += [(m, i, j, r.choice([1.0, 1.5, 2.0])) for i, j in sorted(pairs)]
    return spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)


def test_ring_basis_has_the_right_rank_and_smallest_rings():
    square = [0, 1, 2, 3], [0, 1, 2, 0], [1, 2, 3, 3]
    assert graphs.ring_basis(*square) == [[0, 1, 2, 3]]
    fused = list(range(6)), [0, 1, 2, 3, 4, 0, 1], [1, 2, 3, 4, 5, 5, 4]
    assert sorted(map(len, graphs.ring_basis(*fused))) == [4, 4]
    cube = list(range(8)), [0, 0, 0, 1, 1, 2, 2, 3, 4, 4, 5, 6], [1, 2, 4, 3, 5, 3, 6, 7, 5, 6, 7, 7]
    assert [len(r) for r in graphs.ring_basis(*cube)] == [4] * 5
    assert graphs.ring_basis([0, 1], [0], [1]) == [] == graphs.ring_basis([], [], [])


def test_fragments_two_ways_and_ring_counts(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    atoms, bonds = made(spark)
    one, two = graphs.fragments(atoms, bonds), graphs.fragments_by_joins(atoms, bonds)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    counts = {r.mol_id: r.n_rings for r in graphs.ring_counts(atoms, bonds, one).collect()}
    found = {}
    for r in graphs.rings(atoms, bonds).collect():
        found[r.mol_id] = found.get(r.mol_id, 0) + 1
        assert r.size == len(set(r.members)) > 2
    assert found == {m: n for m, n in counts.items() if n}
    big = graphs.largest_fragment(one).collect()
    assert {r.mol_id for r in big if r.is_largest} == {r.mol_id for r in big}


def plain_clusters(ids, edges):
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in ids}
    out, number = {}, 0
    while len(out) < len(ids):
        left = [i for i in ids if i not in out]
        leader = max(left, key=lambda i: (len([x for x in near[i] if x not in out]), ids.index(i)))
        for x in [leader, *(x for x in near[leader] if x not in out)]:
            out[x] = number
        number += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_leader_clusters(seed):
    r = random.Random(seed)
    ids = list(range(40))
    edges = sorted({tuple(sorted(r.sample(ids, 2))) for _ in range(70)})
    assert L.leader_clusters(ids, edges) == plain_clusters(ids, edges)


def test_butina_and_its_limit(spark):
    r = random.Random(7)
    fps = spark.createDataFrame([(i, i % 2, [r.getrandbits(20)]) for i in range(60)], "mol_id long, grp long, words array<long>")
    got = L.butina(fps, 0.7).collect()
    assert sorted(x.mol_id for x in got) == list(range(60))
    with pytest.raises(ValueError):
        L.butina(fps, 0.7, limit=10)


def test_greedy_pairs_and_pruning_against_loops(spark):
    r = random.Random(3)
    a = [(m, i, *(r.uniform(0, 5) for _ in "xyz")) for m in range(5) for i in range(8)]
    b = [(m, i, *(r.uniform(0, 5) for _ in "xyz")) for m in range(5) for i in range(6)]
    kind = "mol_id long, idx long, x double, y double, z double"
    want = []
    for m in range(5):
        p, q = ([v for v in s if v[0] == m] for s in (a, b))
        pairs = sorted((math.dist(u[2:], v[2:]), u[1], v[1]) for u in p for v in q)
        i_left, j_left = {u[1] for u in p}, {v[1] for v in q}
        for d, i, j in pairs:
            if d <= 3 and i in i_left and j in j_left:
                want.append((m, i, j))
                i_left.discard(i)
                j_left.discard(j)
        want += [(m, i, None) for i in i_left] + [(m, None, j) for j in j_left]
    got = [(x.mol_id, x.i, x.j) for x in G.greedy_pairs(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    points = [(m, i, i % 4 == 0, x, y, z) for m, i, x, y, z in a]
    keep = []
    for m in range(5):
        stay = []
        for p in sorted(v for v in points if v[0] == m):
            if p[2] or all(math.dist(p[3:], s[3:]) >= 1.5 for s in stay):
                stay.append(p)
        keep += [(p[0], p[1]) for p in stay]
    rows = G.pruned(spark.createDataFrame(points, "mol_id long, idx long, fixed boolean, x double, y double, z double"), 1.5)
    assert sorted((x.mol_id, x.idx) for x in rows.collect()) == sorted(keep)


def test_connecting_fragments_leaves_one_where_it_can(spark):
    atoms, bonds = made(spark, 15, 5)
    new = G.connected_fragments(atoms, bonds, graphs.fragments(atoms, bonds), radius=100.0, check_valence=False)
    joined = bonds.unionByName(new.select("mol_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(1.0).alias("bond_order")))
    assert graphs.fragments(atoms, joined).groupBy("mol_id").agg(F.countDistinct("fragment").alias("n")).where("n > 1").count() == 0


def test_soft_encoding_keeps_mass_and_decodes_lone_atoms(spark):
    points = spark.createDataFrame([(0, 0, 0, 10.3, 11.6, 12.0), (0, 1, 0, 30.5, 30.25, 30.75), (1, 0, 1, 2.49, 2.51, 40.0), (1, 1, 1, 0.2, 5.0, 5.0)], "mol_id long, atom_idx long, channel int, x double, y double, z double")
    grid = X.soft_encoded(points)
    assert math.isclose(grid.agg(F.sum("v")).head()[0], 3.0)  # the last point is out of bounds
    half = X.half_resolution(grid).agg(F.sum("v")).head()[0]
    assert math.isclose(half, 3.0 / 8)
    back = {(r.mol_id, r.atom_idx): (r.x, r.y, r.z) for r in X.decoded(points.where("x >= 1"), grid).collect()}
    assert all(math.isclose(p, q, abs_tol=1e-9) for r in points.where("x >= 1").collect() for p, q in zip(back[r.mol_id, r.atom_idx], (r.x, r.y, r.z)))
    kernel = X.gaussian_kernel()
    weights = {k[:3]: k[3] for k in kernel}
    assert max(weights.values()) == 1.0 and weights[1, 0, 0] == pytest.approx(weights[-1, 0, 0]) and len(kernel) <= 343


def test_sdf_round_trip_through_files(spark, tmp_path):
    atoms, bonds = made(spark, 6)
    blocks = W.sdf_blocks(atoms, bonds, F.concat(F.lit("ZINC00"), "mol_id"))
    mols = blocks.select(F.col("mol_id").alias("mol_idx"), "block").unionByName(spark.createDataFrame([(99, None)], "mol_idx long, block string"))
    W.write_sdf(mols.coalesce(1), str(tmp_path / "sdf"))
    back = R.read_sdf(spark, str(tmp_path / "sdf"))
    assert back.count() == 7 and back.where("name = 'dummy'").count() == 1
    got = P.sdf_atoms(back.where("name <> 'dummy'"), "name").select("name", "atom_idx", "atomic_num", "x", "y", "z")
    want = atoms.select(F.concat(F.lit("ZINC00"), "mol_id").alias("name"), "atom_idx", "atomic_num", "x", "y", "z")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    text = "".join(r.block + "$$$$\n" for r in blocks.orderBy("mol_id").collect())
    (tmp_path / "a.sdf").write_text(text)
    with gzip.open(tmp_path / "b.sdf.gz", "wt") as f:
        f.write(text)
    both = R.read_by_extension(spark, [str(tmp_path / "a.sdf"), str(tmp_path / "b.sdf.gz")])["sdf"]
    assert both.groupBy("name").count().where("count = 2").count() == 6
    with pytest.raises(ValueError):
        R.read_by_extension(spark, ["x.txt"])
    found = R.find_files(spark, str(tmp_path), "*.sdf*", ("b.sdf",))
    assert [r.file.rsplit("/", 1)[1] for r in found.collect()] == ["a.sdf"]


def test_pdbqt_mol2_and_small_tables(spark, tmp_path):
    line = "ATOM      1  CA  ALA A  12      11.104   6.134  -6.504  1.00  0.00     0.123 C "
    (tmp_path / "m.pdbqt").write_text(f"MODEL 1\n{line}\n\nENDMDL\nMODEL 2\n{line}\n{line}\nENDMDL\n")
    got = R.read_pdbqt_models(spark, str(tmp_path / "m.pdbqt")).orderBy("mol_idx").collect()
    assert [(r.mol_idx, r.n_atoms) for r in got] == [(0, 1), (1, 2)]
    (tmp_path / "m.pdb").write_text(f"HEADER x\n{line}\nHETATM{line[6:]}\nEND\n")
    a = R.read_pdb(spark, str(tmp_path / "m.pdb")).orderBy("record").collect()
    assert [(r.record, r.res_name, r.chain, r.res_num, r.x, r.z) for r in a] == [("ATOM", "ALA", "A", 12, 11.104, -6.504), ("HETATM", "ALA", "A", 12, 11.104, -6.504)]
    (tmp_path / "m.mol2").write_text("# head\n@<TRIPOS>MOLECULE\nZINC7\n 2 1\n@<TRIPOS>ATOM\n1 C1 0.5 1.5 2.5 C.ar 1 A\n2 CL 1 2 3 Cl 1 A\n@<TRIPOS>BOND\n1 2 1 ar\n")
    m = R.read_mol2(spark, str(tmp_path / "m.mol2"))
    assert [(r.mol_idx, r.name) for r in m.collect()] == [(0, "ZINC7")]
    assert [(r.atomic_num, r.x) for r in P.mol2_atoms(m, "name").orderBy("atom_idx").collect()] == [(6, 0.5), (17, 1.0)]
    assert [tuple(r)[1:] for r in P.mol2_bonds(m, "name").collect()] == [(0, 1, 1.5)]
    (tmp_path / "s.csv").write_text("energy_init,energy_final,success\n1.5,0.5,true\n")
    (tmp_path / "empty.csv").write_text("")
    s = R.read_scores(spark, [str(tmp_path / "s.csv"), str(tmp_path / "empty.csv")], "energy_init double, energy_final double, success boolean")
    assert [(r.energy_final, r.ffopt_success) for r in s.collect()] == [(0.5, True)]
    (tmp_path / "pairs").write_text("a.pdb b.sdf\nc.pdb d.sdf\n")
    assert R.read_pairs(spark, str(tmp_path / "pairs")).count() == 2
    (tmp_path / "cat").write_text("# c\n\nFRAGMENT\tregId=one(3)\tabc\t0\t0\nFRAGMENT\tregId=two\td[e]\t0\t0\n")
    assert [tuple(r) for r in R.read_catalog(spark, str(tmp_path / "cat")).orderBy("ord").collect()] == [(0, "one(3)", "abc"), (1, "two", "d[e]")]
    (tmp_path / "names").write_text("a\n\n b \n")
    assert sorted(r.name for r in R.read_names(spark, str(tmp_path / "names")).collect()) == ["a", "b"]


def test_packed_round_trip(spark, tmp_path):
    atoms, bonds = made(spark, 8)
    rows = W.packed(atoms, 14)
    W.write_packed(rows, str(tmp_path / "p"))
    index = spark.createDataFrame([("1",), ("3",), ("99",)], "name string")
    back = R.read_packed(spark, str(tmp_path / "p"), index)
    assert sorted(r.name for r in back.collect()) == ["1", "3"]
    r = W.combined([R.read_packed(spark, str(tmp_path / "p"))])
    most = atoms.groupBy("mol_id").count().agg(F.max("count")).head()[0]
    assert {len(x.atom_types) for x in r.collect()} == {most} and {len(x.atom_types[0]) for x in r.collect()} == {2}
    W.write_stats(spark.createDataFrame([(5, 70000, 1.5)], "n int, zinc_id int, mw double").withColumn("n", F.col("n")), str(tmp_path / "stats"))
    assert spark.read.csv(str(tmp_path / "stats"), header=True).count() == 1
    W.write_manifest(spark.createDataFrame([("a",), ("a",), ("b",)], "file string"), str(tmp_path / "manifest"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "manifest")).collect()) == ["a 2", "b 1", "total 3"]
    W.write_complexes(spark.createDataFrame([("p1", [[1.0]], [[6]])], "pdb_id string, lig_coords array<array<float>>, lig_types array<array<smallint>>"), str(tmp_path / "cx"))
    assert spark.read.parquet(str(tmp_path / "cx")).count() == 1


def test_rotation_is_undone_and_random_pose_stays_inside(spark):
    atoms, _ = made(spark)
    angles = tuple(map(F.lit, (1.0, 2.0, 3.0)))
    back = G.rotated(G.rotated(atoms, angles), angles, inverse=True)
    far = back.join(atoms.select("mol_id", "atom_idx", *(F.col(c).alias(f"o{c}") for c in "xyz")), ["mol_id", "atom_idx"]).agg(F.max(sum((F.abs(F.col(c) - F.col(f"o{c}")) for c in "xyz"), F.lit(0.0)))).head()[0]
    assert far < 1e-9
    posed = G.random_pose(atoms, "s", 4.0).where("attempt is not null")
    assert posed.where("abs(x) > 12 or abs(y) > 12 or abs(z) > 12").count() == 0 and posed.count()


def test_sampling_and_presets(spark):
    stats = spark.createDataFrame([(i, float(i % 10) + 0.5) for i in range(1000)], "mol_idx long, mol_width double")
    edges = {"mol_width": [0, 2, 4, 6, 8, 10]}
    hist = S.histogram(stats, edges)
    assert hist.agg(F.sum("n")).head()[0] == 1000 and len(edges["mol_width"]) == hist.count() + 1
    some = S.stratified(stats, edges, 200, 1000, "s", F.col("mol_idx"))
    assert 150 < some.count() < 250
    assert S.trimmed_edges(edges, O.MolFilter(width_min=3, width_max=6))["mol_width"] == (1, [2, 4, 6, 8])
    assert O.preset("default").width_max == 20 and O.preset("gen_opt", ring_sizes=(6,)).ring_sizes == (6,)
    with pytest.raises(ValueError):
        O.preset("drug_like", nonsense=1)
    with pytest.raises(ValueError):
        S.per_cycle(spark, "t", [1, 2], 3)
    with pytest.raises(ValueError):
        V.type_vocab(spark, {"mine": (6, "x")})


def test_diverse_top_returns_what_there_is(spark):
    rows = spark.createDataFrame([(i, "m", "p", i % 3, float(i)) for i in range(7)] + [(9, "m", "q", 0, None)], "mol_idx long, model string, pdb_id string, cluster int, affinity double")
    got = scores.diverse_top(rows, 5, "affinity").orderBy("pdb_id", "pick").collect()
    assert [(r.pdb_id, r.mol_idx) for r in got] == [("p", 0), ("p", 1), ("p", 2), ("p", 3), ("p", 4), ("q", 9)]


def test_running_totals_go_on_after_a_stop(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "file string, ok boolean")
    one = spark.createDataFrame([("b", False), ("c", True)], "file string, ok boolean")
    at = lambda name: str(tmp_path / name)
    for part in (rows, one):
        part.write.mode("append").parquet(at("in"))
        T.running_totals(spark.readStream.schema(rows.schema).parquet(at("in")), at("out"), at("state"), "ok", "file <> 'a'").awaitTermination()
    # The second version has only what it changed; nothing new makes no version.
    T.running_totals(spark.readStream.schema(rows.schema).parquet(at("in")), at("out"), at("state"), "ok", "file <> 'a'").awaitTermination()
    assert sorted((r.version, r.file) for r in spark.read.parquet(at("out")).collect()) == [(0, "a"), (0, "b"), (1, "b"), (1, "c")]
    assert sorted(tuple(r) for r in T.latest_totals(spark, at("out")).collect()) == [("a", 2, 1, 0), ("b", 2, 1, 1), ("c", 1, 1, 1)]
    # A batch whose end was not recorded is run again, and its version is written anew.
    (tmp_path / "state" / "commits" / "1").unlink()
    for crc in (tmp_path / "state" / "commits").glob(".1.crc"):
        crc.unlink()
    T.running_totals(spark.readStream.schema(rows.schema).parquet(at("in")), at("out"), at("state"), "ok", "file <> 'a'").awaitTermination()
    assert sorted(tuple(r) for r in T.latest_totals(spark, at("out")).collect()) == [("a", 2, 1, 0), ("b", 2, 1, 1), ("c", 1, 1, 1)]
    assert T.last_generation(spark.createDataFrame([("x_opt3",), ("y",)], "model string")) == 3


def test_pattern_screen_in_blocks_and_null_handling(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "xyz")], "k long, t string")
    cat = spark.createDataFrame([(0, "r0", "zz"), (1, "r1", "bc"), (2, "r2", "a")], "ord int, reg_id string, pattern string")
    from molmill.operators.patterns import pattern_hits

    for limit in (1, 100):
        assert [tuple(r) for r in pattern_hits(rows, cat, "k", "t", limit).collect()] == [(1, "r1")]
    assert pattern_hits(rows, cat.limit(0), "k", "t").count() == 0
    assert [r[0] for r in spark.createDataFrame([(None,), (1.0,)], "v double").select(O.in_range(F.col("v"), 0, 2)).collect()] == [False, True]
    assert spark.range(1).select(E.in_bounds((F.lit(None).cast("double"), F.lit(5.0), F.lit(5.0)))).head()[0] is True


def test_shape_ratios_of_a_rod_a_disc_and_a_ball(spark):
    from molmill.operators.stats import shape_ratios

    rod = [(0, float(i), 0.0, 0.0) for i in range(5)]
    disc = [(1, math.cos(a * math.pi / 4), math.sin(a * math.pi / 4), 0.0) for a in range(8)]
    ball = [(2, *(s if c == k else 0.0 for c in range(3))) for k in range(3) for s in (1.0, -1.0)]
    point = [(3, 1.0, 1.0, 1.0)]
    rows = [(m, i, 6, x, y, z, 0, [6]) for i, (m, x, y, z) in enumerate(rod + disc + ball + point)]
    got = {r.mol_id: (r.npr1, r.npr2) for r in shape_ratios(spark.createDataFrame(rows, ATOMS)).collect()}
    assert got[0] == pytest.approx((0, 1)) and got[1] == pytest.approx((0.5, 0.5)) and got[2] == pytest.approx((1, 1)) and got[3] == (None, None)


def test_ring_systems_and_loops():
    fused = [[0, 1, 2, 3], [2, 3, 4, 5], [8, 9, 10]]
    assert graphs.systems(fused, 1) == [[0, 1], [2]] == graphs.systems(fused, 2)
    touching = [[0, 1, 2], [2, 3, 4]]
    assert graphs.systems(touching, 1) == [[0, 1]] and graphs.systems(touching, 2) == [[0], [1]]
