"""Queries of geometry and voxel jobs."""

from math import pi

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.vocab import CHANNELS, RADIUS, VALENCE, channel_table, type_vocab
from ..operators import geometry as G
from ..operators import graphs, stats
from ..operators import bricks as B
from ..operators import voxels as V
from .registry import VIEWS, query, rounded, view

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_PAIRS = f"pairs AS (SELECT a.mol_id, a.atom_idx AS i, b.atom_idx AS j, {_D} AS d FROM v_atoms a JOIN v_atoms b ON a.mol_id = b.mol_id AND a.atom_idx < b.atom_idx)"

# A complex is a run of 970 molecules, ten of them ligands, so that the number of complexes grows with the table.
_COMPLEX = "CAST(floor(mol_id / 970) AS BIGINT) AS pdb_id"
VIEWS["v_ligand"] = f"SELECT {_COMPLEX}, atom_idx, x * 5 AS x, y * 5 AS y, z * 5 AS z FROM v_atoms WHERE mol_id % 97 = 0"
VIEWS["v_receptor"] = f"SELECT {_COMPLEX}, mol_id, atom_idx, chain, CAST(mol_id AS BIGINT) AS res_num, x * 5 AS x, y * 5 AS y, z * 5 AS z FROM v_atoms"


def atoms(spark, d):
    return view(spark, d, "v_atoms")


def bonds(spark, d):
    return view(spark, d, "v_bonds")


@query("""
SELECT r.mol_id, r.atom_idx FROM v_receptor r WHERE EXISTS (
  SELECT 1 FROM v_receptor q JOIN v_ligand l ON q.pdb_id = l.pdb_id WHERE q.pdb_id = r.pdb_id AND q.chain = r.chain AND q.res_num = r.res_num
  AND sqrt((q.x - l.x) * (q.x - l.x) + (q.y - l.y) * (q.y - l.y) + (q.z - l.z) * (q.z - l.z)) <= 8)""")
def j5_pocket_residues(spark, d):
    return G.pocket(view(spark, d, "v_receptor"), view(spark, d, "v_ligand")).select("mol_id", "atom_idx")


@query(f"WITH {_PAIRS} SELECT p.mol_id, p.i, p.j, R6[[d]] AS d FROM pairs p LEFT JOIN v_bonds b ON p.mol_id = b.mol_id AND p.i = b.i AND p.j = b.j WHERE d < 3.5 AND b.mol_id IS NULL")
def j6_candidate_bonds(spark, d):
    return rounded(G.candidate_bonds(atoms(spark, d), bonds(spark, d)), "d")


@query()
def j7_connected_fragments(spark, d):
    a, b = atoms(spark, d), bonds(spark, d)
    return rounded(G.connected_fragments(a, b, graphs.fragments(a, b)), "d")


_FRAGS = """
e AS (SELECT mol_id, i AS a, j AS b FROM v_bonds UNION ALL SELECT mol_id, j, i FROM v_bonds),
reach AS (SELECT mol_id, atom_idx, atom_idx AS other FROM v_atoms UNION SELECT r.mol_id, r.atom_idx, e.b FROM reach r JOIN e ON r.mol_id = e.mol_id AND r.other = e.a),
f AS (SELECT mol_id, atom_idx, min(other) AS fragment FROM reach GROUP BY mol_id, atom_idx)"""


@query(f"""
WITH RECURSIVE {_FRAGS}, {_PAIRS}
SELECT p.mol_id, i, j, row_number() OVER (PARTITION BY p.mol_id ORDER BY d, i, j) AS nth FROM pairs p JOIN f a ON p.mol_id = a.mol_id AND p.i = a.atom_idx JOIN f b ON p.mol_id = b.mol_id AND p.j = b.atom_idx
WHERE d < 3 AND a.fragment <> b.fragment""")
def j7_fragment_candidates(spark, d):
    a, b = atoms(spark, d), bonds(spark, d)
    return G.fragment_candidates(a, graphs.fragments(a, b)).select("mol_id", "i", "j", F.col("nth").cast("long").alias("nth"))


def halves(spark, d):
    a = atoms(spark, d).withColumnRenamed("atom_idx", "idx")
    return a.where("record = 'ATOM'"), a.where("record = 'HETATM'")


@query()
def j10_greedy_pairs(spark, d):
    return rounded(G.greedy_pairs(*halves(spark, d)), "d")


@query(f"SELECT a.mol_id, a.atom_idx AS i, b.atom_idx AS j, R6[[{_D} * {_D}]] AS d2 FROM v_atoms a JOIN v_atoms b ON a.mol_id = b.mol_id WHERE a.record = 'ATOM' AND b.record = 'HETATM'")
def f19_squared_distances(spark, d):
    return rounded(G.squared_distances(*halves(spark, d)), "d2")


@query(f"""
WITH n AS (SELECT a.mol_id, a.atom_idx AS idx, b.atom_idx AS p, {_D} AS d FROM v_atoms a JOIN v_atoms b ON a.mol_id = b.mol_id WHERE a.record = 'ATOM' AND b.record = 'HETATM')
SELECT mol_id, idx, arg_min(p, (d, p)) AS p, R6[[min(d)]] AS d FROM n GROUP BY mol_id, idx""")
def w4_nearest_point(spark, d):
    a, b = halves(spark, d)
    return rounded(G.nearest_point(a, b.withColumnRenamed("idx", "p")), "d")


_ANGLES = (0.3, 1.1, -0.7)
_ROT = """
SELECT mol_id, atom_idx, R6[[x1]] AS x, R6[[y2 * cos(c) - z2 * sin(c)]] AS y, R6[[y2 * sin(c) + z2 * cos(c)]] AS z FROM (
  SELECT *, xa * cos(b) + z * sin(b) AS x1, ya AS y2, z * cos(b) - xa * sin(b) AS z2 FROM (
    SELECT *, x * cos(a) - y * sin(a) AS xa, x * sin(a) + y * cos(a) AS ya FROM (SELECT *, 0.3::DOUBLE AS a, 1.1::DOUBLE AS b, -0.7::DOUBLE AS c FROM v_atoms) t) u) v"""


@query(_ROT)
def f1_rotated(spark, d):
    got = G.rotated(atoms(spark, d), tuple(map(F.lit, _ANGLES)))
    return rounded(got.select("mol_id", "atom_idx", "x", "y", "z"), "x", "y", "z")


@query("SELECT mol_id, atom_idx, R6[[x]] AS x, R6[[y]] AS y, R6[[z]] AS z FROM v_atoms")
def f1_rotated_back(spark, d):
    angles = tuple(F.lit(a * 180 / pi) for a in _ANGLES)
    there = G.rotated(atoms(spark, d), angles, degrees=True)
    return rounded(G.rotated(there, angles, inverse=True, degrees=True).select("mol_id", "atom_idx", "x", "y", "z"), "x", "y", "z")


@query("SELECT mol_id, atom_idx, R6[[x + 1.5 - 12]] AS x, R6[[y - 2]] AS y, R6[[z]] AS z FROM v_atoms")
def f2_translated(spark, d):
    got = G.moved(G.moved(atoms(spark, d), (F.lit(1.5), F.lit(-2.0), F.lit(3.0))), (F.lit(12.0), F.lit(0.0), F.lit(3.0)), inverse=True)
    return rounded(got.select("mol_id", "atom_idx", "x", "y", "z"), "x", "y", "z")


def _u(name, salt="pose"):
    return f"(CAST(concat('0x', substr(md5(concat('{salt}:{name}:', CAST(mol_id AS VARCHAR), ':', CAST(attempt AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""
WITH t AS (SELECT mol_id, atom_idx, x, y, z, unnest(range(6)) AS attempt FROM v_atoms),
u AS (SELECT *, {_u('anglex')} * 2 * pi() AS a, {_u('angley')} * 2 * pi() AS b, {_u('anglez')} * 2 * pi() AS c FROM t),
v AS (SELECT *, x * cos(a) - y * sin(a) AS xa, x * sin(a) + y * cos(a) AS ya FROM u),
w AS (SELECT *, xa * cos(b) + z * sin(b) AS x1, z * cos(b) - xa * sin(b) AS z2 FROM v),
n AS (SELECT *, x1 + ({_u('shiftx')} - 0.5) * 6 AS nx, ya * cos(c) - z2 * sin(c) + ({_u('shifty')} - 0.5) * 6 AS ny, ya * sin(c) + z2 * cos(c) + ({_u('shiftz')} - 0.5) * 6 AS nz FROM w),
g AS (SELECT mol_id, min(attempt) AS attempt FROM (SELECT mol_id, attempt, bool_and(nx >= -9 AND nx < 9 AND ny >= -9 AND ny < 9 AND nz >= -9 AND nz < 9) AS ok FROM n GROUP BY ALL) t WHERE ok GROUP BY mol_id)
SELECT a.mol_id, a.atom_idx, CAST(g.attempt AS INT) AS attempt, R6[[coalesce(nx, a.x)]] AS x, R6[[coalesce(ny, a.y)]] AS y, R6[[coalesce(nz, a.z)]] AS z
FROM v_atoms a LEFT JOIN g ON a.mol_id = g.mol_id LEFT JOIN n ON n.mol_id = a.mol_id AND n.atom_idx = a.atom_idx AND n.attempt = g.attempt""")
def f3_random_pose(spark, d):
    got = G.random_pose(atoms(spark, d), "pose", 6.0, tries=6, side=18.0)
    return rounded(got.select("mol_id", "atom_idx", "attempt", "x", "y", "z"), "x", "y", "z")


_R = "CASE {}.atomic_num " + " ".join(f"WHEN {n} THEN {r}" for n, r in RADIUS.items()) + " END"
_LEN = f"len AS (SELECT k.mol_id, k.i, k.j, k.bond_order, {_D} AS length, {_D} / ({_R.format('a')} + {_R.format('b')}) AS stretch FROM v_bonds k JOIN v_atoms a ON k.mol_id = a.mol_id AND k.i = a.atom_idx JOIN v_atoms b ON k.mol_id = b.mol_id AND k.j = b.atom_idx)"


@query(f"WITH {_LEN} SELECT mol_id, i, j, R6[[length]] AS length, R6[[stretch]] AS stretch, CASE WHEN stretch > 0 THEN R6[[abs(log2(stretch))]] END AS log_stretch FROM len")
def f13_bond_lengths(spark, d):
    return rounded(G.bond_lengths(atoms(spark, d), bonds(spark, d)).drop("bond_order"), "length", "stretch", "log_stretch")


_ANG = f"""ends AS (SELECT mol_id, i AS o, j AS n FROM v_bonds UNION ALL SELECT mol_id, j, i FROM v_bonds),
ang AS (
  SELECT p.mol_id, p.o AS atom, p.n AS a, q.n AS b,
         (a.x - o.x) * (b.x - o.x) + (a.y - o.y) * (b.y - o.y) + (a.z - o.z) * (b.z - o.z) AS dot,
         sqrt((a.x - o.x) ** 2 + (a.y - o.y) ** 2 + (a.z - o.z) ** 2) * sqrt((b.x - o.x) ** 2 + (b.y - o.y) ** 2 + (b.z - o.z) ** 2) AS norm
  FROM ends p JOIN ends q ON p.mol_id = q.mol_id AND p.o = q.o AND p.n < q.n JOIN v_atoms o ON o.mol_id = p.mol_id AND o.atom_idx = p.o
  JOIN v_atoms a ON a.mol_id = p.mol_id AND a.atom_idx = p.n JOIN v_atoms b ON b.mol_id = p.mol_id AND b.atom_idx = q.n),
deg AS (SELECT mol_id, atom, a, b, CASE WHEN norm > 0 THEN acos(greatest(least(dot / norm, 1.0), -1.0)) * 180 / pi() END AS degrees FROM ang)"""


@query(f"WITH {_ANG} SELECT mol_id, atom, a, b, round(degrees, 4) AS degrees FROM deg")
def f13_bond_angles(spark, d):
    return G.bond_angles(atoms(spark, d), bonds(spark, d)).withColumn("degrees", F.round("degrees", 4))


@query(f"""
WITH {_LEN}, {_ANG}, s AS (SELECT mol_id, count(*) AS n FROM len WHERE stretch > 1.8 GROUP BY mol_id), t AS (SELECT mol_id, count(*) AS n FROM deg WHERE degrees < 50 GROUP BY mol_id)
SELECT coalesce(s.mol_id, t.mol_id) AS mol_id, coalesce(s.n, 0) AS n_stretched, coalesce(t.n, 0) AS n_sharp FROM s FULL JOIN t ON s.mol_id = t.mol_id""")
def f14_geometry_report(spark, d):
    return G.geometry_report(atoms(spark, d), bonds(spark, d))


_VAL = f"""
vends AS (SELECT mol_id, i AS atom_idx, j AS other, bond_order FROM v_bonds UNION ALL SELECT mol_id, j, i, bond_order FROM v_bonds),
used AS (SELECT e.mol_id, e.atom_idx, sum(bond_order) AS s, count(*) FILTER (WHERE o.atomic_num = 8) AS oxy FROM vends e JOIN v_atoms o ON e.mol_id = o.mol_id AND e.other = o.atom_idx GROUP BY ALL),
val AS (SELECT a.mol_id, a.atom_idx, CAST(floor(coalesce(s, 0)) AS INT) AS valence, CASE WHEN atomic_num = 16 AND coalesce(oxy, 0) >= 2 THEN 6 ELSE CASE atomic_num {" ".join(f"WHEN {n} THEN {v}" for n, v in VALENCE.items())} END END AS cap
        FROM v_atoms a LEFT JOIN used u ON a.mol_id = u.mol_id AND a.atom_idx = u.atom_idx)"""


@query(f"WITH {_VAL} SELECT * FROM val")
def f18_valence_caps(spark, d):
    return G.free_valences(atoms(spark, d), bonds(spark, d))


@query(f"""
WITH {_LEN}, {_VAL}, b AS (SELECT mol_id, i AS atom_idx, i, j, stretch FROM len UNION ALL SELECT mol_id, j, i, j, stretch FROM len),
r AS (SELECT *, row_number() OVER (PARTITION BY mol_id, atom_idx ORDER BY stretch DESC, i, j) AS nth FROM b)
SELECT r.mol_id, r.atom_idx, i, j, nth, nth <= valence - cap AS excess FROM r JOIN val v ON r.mol_id = v.mol_id AND r.atom_idx = v.atom_idx""")
def w6_excess_bonds(spark, d):
    return G.excess_bonds(atoms(spark, d), bonds(spark, d)).drop("stretch").withColumn("nth", F.col("nth").cast("long"))


@query(f"""
WITH {_PAIRS}, s AS (SELECT mol_id, sum(pow(3.0 * pow(2.0, -1.0 / 6) / d, 12) - pow(3.0 * pow(2.0, -1.0 / 6) / d, 6)) AS p FROM pairs WHERE d > 1 GROUP BY mol_id)
SELECT m.mol_id, round(coalesce(p, 0), 4) AS potential FROM (SELECT DISTINCT mol_id FROM v_atoms) m LEFT JOIN s ON m.mol_id = s.mol_id""")
def f12_pair_potential(spark, d):
    return G.pair_potential(atoms(spark, d), least=1.0).withColumn("potential", F.round("potential", 4))


@query("SELECT event_id, R6[[tanh(value / 5) * 5]] AS clamped, R6[[exp(-((value / 100) * (value / 100)) / (2 * 0.15::DOUBLE))]] AS gauss FROM events")
def f12_clamp_gaussian(spark, d):
    v = F.col("value")
    return rounded(view(spark, d, "events").select("event_id", E.soft_clamp(v).alias("clamped"), E.gaussian((v / 100) * (v / 100), 0.15).alias("gauss")), "clamped", "gauss")


_MID = "mid AS (SELECT k.mol_id, k.i, k.j, k.bond_order, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z FROM v_bonds k JOIN v_atoms a ON k.mol_id = a.mol_id AND k.i = a.atom_idx JOIN v_atoms b ON k.mol_id = b.mol_id AND k.j = b.atom_idx)"


@query(f"WITH {_MID} SELECT mol_id, i, j, R6[[x]] AS x, R6[[y]] AS y, R6[[z]] AS z FROM mid")
def f17_bond_midpoints(spark, d):
    return rounded(G.bond_midpoints(atoms(spark, d), bonds(spark, d)).drop("bond_order"), "x", "y", "z")


@query()
def v10_pruned(spark, d):
    p = atoms(spark, d).select("mol_id", F.col("atom_idx").alias("idx"), (F.col("record") == "ATOM").alias("fixed"), "x", "y", "z")
    return G.pruned(p, 2.0).select("mol_id", "idx")


@query("SELECT mol_id, atom_idx, R6[[x / 0.5 + 23.5 - 5 / 0.5]] AS vx, R6[[x]] AS x FROM v_atoms")
def f8_voxel_units(spark, d):
    v = E.to_voxel(F.col("x"), 5.0)
    return rounded(atoms(spark, d).select("mol_id", "atom_idx", v.alias("vx"), E.from_voxel(v, 5.0).alias("x")), "vx", "x")


@query("SELECT mol_id, atom_idx, atomic_num = 6 OR is_hbd AS member FROM v_atoms")
def f7_channel_member(spark, d):
    types = E.feature_types(F.col("atomic_num"), F.col("is_hbd"), F.col("is_hba"), F.col("is_aromatic"), F.col("charge"))
    return atoms(spark, d).select("mol_id", "atom_idx", F.arrays_overlap(types, F.array(F.lit(6), F.lit(301))).alias("member"))


# Voxel jobs: one unit a voxel, a side of 12.
SIDE = 12
VIEWS["v_points"] = "SELECT mol_id, atom_idx, CASE atomic_num WHEN 6 THEN 0 WHEN 7 THEN 1 WHEN 8 THEN 2 ELSE 3 END AS channel, x, y, z FROM v_atoms"
_O = "o AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS ox) a, (SELECT unnest([-1, 0, 1]) AS oy) b, (SELECT unnest([-1, 0, 1]) AS oz) c)"


def _cube(source):
    return f"""cube_{source} AS (SELECT *, greatest(0, 1 - abs(ix - x)) * greatest(0, 1 - abs(iy - y)) * greatest(0, 1 - abs(iz - z)) AS w FROM (
  SELECT p.*, CAST(round_even(x, 0) AS INT) + ox AS ix, CAST(round_even(y, 0) AS INT) + oy AS iy, CAST(round_even(z, 0) AS INT) + oz AS iz FROM {source} p, o) t)"""


_IN = "x >= 1 AND x < 10 AND y >= 1 AND y < 10 AND z >= 1 AND z < 10"
_ENC = f"{_O}, pin AS (SELECT * FROM v_points WHERE {_IN}), {_cube('pin')}, vox AS (SELECT mol_id, channel, ix, iy, iz, sum(w) AS v FROM cube_pin WHERE w > 0 GROUP BY ALL)"
_KEY = "t.mol_id = p.mol_id AND t.channel = p.channel AND t.ix = p.ix AND t.iy = p.iy AND t.iz = p.iz"


def points(spark, d):
    return view(spark, d, "v_points")


def grid(spark, d):
    return V.soft_encoded(points(spark, d), SIDE)


@query(f"WITH {_ENC} SELECT mol_id, channel, ix, iy, iz, R6[[v]] AS v FROM vox")
def v1_soft_encoded(spark, d):
    return rounded(B.voxels(B.bricks(points(spark, d), SIDE)), "v")


@query("SELECT mol_id, channel, CAST(round_even(x, 0) AS INT) AS ix, CAST(round_even(y, 0) AS INT) AS iy, CAST(round_even(z, 0) AS INT) AS iz, CAST(count(*) AS DOUBLE) AS v FROM v_points WHERE x < 11 AND y < 11 AND z < 11 GROUP BY ALL")
def v2_hard_encoded(spark, d):
    return V.hard_encoded(points(spark, d), SIDE)


KERNEL = V.gaussian_kernel(0.5, 1.5, 1.0)
_K = "kern AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c}, {w!r}::DOUBLE)" for a, b, c, w in KERNEL) + ") k(ox, oy, oz, kw))"
_DEN = f"{_ENC}, {_K}, den AS (SELECT mol_id, channel, ix + ox AS ix, iy + oy AS iy, iz + oz AS iz, sum(v * kw) AS v FROM vox, kern k(ox, oy, oz, kw) WHERE ix + ox BETWEEN 0 AND 11 AND iy + oy BETWEEN 0 AND 11 AND iz + oz BETWEEN 0 AND 11 GROUP BY ALL)"


@query(f"WITH {_DEN} SELECT mol_id, channel, count(*) AS n, round(sum(v), 4) AS total, round(max(v), 5) AS most, round(sum(v * (ix + 13 * iy + 169 * iz)), 2) AS place FROM den GROUP BY ALL")
def v3_density(spark, d):
    place = F.col("v") * (F.col("ix") + 13 * F.col("iy") + 169 * F.col("iz"))
    each = B.voxels(B.bricks(points(spark, d), SIDE, kernel=KERNEL)).groupBy("mol_id", "channel")
    return each.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.max("v"), 5).alias("most"), F.round(F.sum(place), 2).alias("place"))


@query(f"WITH {_ENC} SELECT mol_id, channel, ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz, R6[[sum(v) / 8]] AS v FROM vox GROUP BY ALL")
def v4_half_resolution(spark, d):
    return rounded(B.half_voxels(B.bricks(points(spark, d), SIDE)), "v")


@query(f"WITH {_ENC} SELECT mol_id, ix, iy, iz, R6[[sum(v)]] AS v FROM vox WHERE channel IN (0, 1, 2) GROUP BY ALL")
def v5_total_density(spark, d):
    return rounded(V.total_density(grid(spark, d), [0, 1, 2]), "v")


@query(f"""
WITH {_ENC} SELECT c.mol_id, c.atom_idx, c.channel, R6[[sum(t.v * c.ix) / sum(t.v)]] AS x, R6[[sum(t.v * c.iy) / sum(t.v)]] AS y, R6[[sum(t.v * c.iz) / sum(t.v)]] AS z
FROM cube_pin c JOIN vox t ON t.mol_id = c.mol_id AND t.channel = c.channel AND t.ix = c.ix AND t.iy = c.iy AND t.iz = c.iz WHERE c.w > 0 GROUP BY c.mol_id, c.atom_idx, c.channel""")
def v6_decoded(spark, d):
    inside = points(spark, d).where(E.in_bounds(tuple(map(F.col, "xyz")), SIDE, 1))
    return rounded(V.decoded(inside, grid(spark, d), tight=True), "x", "y", "z")


@query(f"""
WITH {_ENC} SELECT p.mol_id, p.atom_idx, p.channel, R6[[coalesce(t.v, 0)]] AS v FROM v_points p LEFT JOIN vox t ON t.mol_id = p.mol_id AND t.channel = p.channel
AND t.ix = CAST(round_even(x, 0) AS INT) AND t.iy = CAST(round_even(y, 0) AS INT) AND t.iz = CAST(round_even(z, 0) AS INT)""")
def v7_values_at_atoms(spark, d):
    return rounded(V.values_at(points(spark, d), grid(spark, d)).select("mol_id", "atom_idx", "channel", "v"), "v")


def _un(name, *more):
    keys = ", ':', ".join(f"CAST({k} AS VARCHAR)" for k in ("mol_id", "atom_idx", "channel", *more))
    return f"(CAST(concat('0x', substr(md5(concat('noise{name}:', {keys})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""
WITH {_ENC}, most AS (SELECT mol_id, max(v) AS most FROM vox GROUP BY mol_id),
chosen AS (SELECT *, CASE WHEN {_un('n')} < {0.1 / 0.1111!r} THEN 1 WHEN {_un('n')} < {0.11 / 0.1111!r} THEN 2 WHEN {_un('n')} < {0.111 / 0.1111!r} THEN 3 ELSE 4 END AS n FROM v_points WHERE {_un('point')} < 0.3),
bord AS (SELECT s.*, CAST(round_even(x, 0) AS INT) + ox AS ix, CAST(round_even(y, 0) AS INT) + oy AS iy, CAST(round_even(z, 0) AS INT) + oz AS iz FROM chosen s, o WHERE NOT (ox = 0 AND oy = 0 AND oz = 0)),
emp AS (SELECT p.* FROM bord p LEFT JOIN vox t ON {_KEY} WHERE t.v IS NULL AND p.ix BETWEEN 0 AND 11 AND p.iy BETWEEN 0 AND 11 AND p.iz BETWEEN 0 AND 11),
rk AS (SELECT *, row_number() OVER (PARTITION BY mol_id, atom_idx, channel ORDER BY {_un('order', 'ix', 'iy', 'iz')}, ix, iy, iz) AS nth FROM emp),
noise AS (SELECT r.mol_id, channel, ix, iy, iz, max({_un('value', 'ix', 'iy', 'iz').replace('CAST(mol_id', 'CAST(r.mol_id')} * most) AS v FROM rk r JOIN most m ON r.mol_id = m.mol_id WHERE nth <= n GROUP BY ALL)
SELECT mol_id, channel, ix, iy, iz, R6[[v]] AS v FROM (SELECT * FROM vox UNION ALL SELECT * FROM noise) t""")
def v8_encoding_noise(spark, d):
    return rounded(V.with_encoding_noise(grid(spark, d), points(spark, d), 0.3, "noise", SIDE), "v")


def _ua(name):
    return f"(CAST(concat('0x', substr(md5(concat('extra{name}:', CAST(mol_id AS VARCHAR), ':', CAST(attempt AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""
WITH t AS (SELECT mol_id, max(atom_idx) + 1 AS atom_idx, unnest(range(8)) AS attempt FROM v_atoms GROUP BY mol_id),
a AS (SELECT *, {_ua('x')} * 10 AS x, {_ua('y')} * 10 AS y, {_ua('z')} * 10 AS z, list_extract([6, 7, 8], CAST(floor({_ua('element')} * 3) AS INT) + 1) AS atomic_num FROM t),
g AS (SELECT mol_id, attempt, min({_D}) AS gap FROM a JOIN v_atoms b USING (mol_id) GROUP BY ALL),
f AS (SELECT mol_id, min(attempt) AS attempt FROM g WHERE gap >= 2 GROUP BY mol_id)
SELECT mol_id, a.atom_idx, R6[[a.x]] AS x, R6[[a.y]] AS y, R6[[a.z]] AS z, a.atomic_num FROM a JOIN f USING (mol_id, attempt)""")
def v9_noise_atoms(spark, d):
    return rounded(V.noise_atoms(atoms(spark, d), [6, 7, 8], "extra", tries=8), "x", "y", "z")


@query(f"""
WITH {_MID}, {_O}, bp AS (SELECT mol_id, CASE bond_order WHEN 1.0 THEN 0 WHEN 2.0 THEN 1 ELSE 2 END AS channel, x, y, z FROM mid WHERE {_IN}), {_cube('bp')}
SELECT mol_id, channel, ix, iy, iz, R6[[sum(w)]] AS v FROM cube_bp WHERE w > 0 GROUP BY ALL""")
def v11_bond_encoded(spark, d):
    mid = G.bond_midpoints(atoms(spark, d), bonds(spark, d))
    channel = F.when(F.col("bond_order") == 1, 0).when(F.col("bond_order") == 2, 1).otherwise(2)
    return rounded(V.soft_encoded(mid.withColumn("channel", channel), SIDE), "v")


@query(f"""
WITH {_ENC}, bad AS (SELECT DISTINCT mol_id FROM v_points WHERE NOT (x >= 0 AND x < 11 AND y >= 0 AND y < 11 AND z >= 0 AND z < 11)),
kept AS (SELECT mol_id, atom_idx, x, y, z FROM v_points WHERE mol_id NOT IN (SELECT mol_id FROM bad)), {_cube('kept')},
s AS (SELECT c.mol_id, c.atom_idx, t.channel, sum(c.w * t.v) AS s FROM cube_kept c JOIN vox t ON c.mol_id = t.mol_id AND c.ix = t.ix AND c.iy = t.iy AND c.iz = t.iz WHERE c.w > 0 GROUP BY ALL),
b AS (SELECT mol_id, atom_idx, arg_max(channel, (s, -channel)) FILTER (WHERE channel < 3) AS best, bool_or(channel = 3) AS other FROM s WHERE s >= 0.15 GROUP BY ALL)
SELECT k.mol_id, k.atom_idx, concat_ws(',', CAST(best AS VARCHAR), CASE WHEN other THEN '3' END) AS channels FROM kept k LEFT JOIN b ON k.mol_id = b.mol_id AND k.atom_idx = b.atom_idx""")
def v12_assigned_types(spark, d):
    got = V.assigned_types(points(spark, d), grid(spark, d), [0, 1, 2], side=SIDE)
    return got.select("mol_id", "atom_idx", F.array_join("channels", ",").alias("channels"))


# The prediction: the truth's grid of molecules' atoms moved a little.
VIEWS["v_moved"] = "SELECT mol_id, atom_idx, CASE WHEN mol_id % 9 = 0 THEN (channel + 1) % 4 ELSE channel END AS channel, x + 0.25 AS x, y, z - 0.125 AS z FROM v_points"
_BOTH = f"{_ENC}, pmv AS (SELECT * FROM v_moved WHERE {_IN}), {_cube('pmv')}, prd AS (SELECT mol_id, channel, ix, iy, iz, sum(w) AS v FROM cube_pmv WHERE w > 0 GROUP BY ALL), pair AS (SELECT coalesce(t.channel, p.channel) AS channel, coalesce(t.mol_id, p.mol_id) AS mol_id, coalesce(t.v, 0) AS t, coalesce(p.v, 0) AS p FROM vox t FULL JOIN prd p ON {_KEY})"


def predicted(spark, d):
    return V.soft_encoded(view(spark, d, "v_moved"), SIDE)


@query(f"WITH {_BOTH} SELECT channel, round(corr(t, p), 6) AS r FROM pair GROUP BY channel")
def a18_channel_correlation(spark, d):
    return stats.channel_correlation(grid(spark, d), predicted(spark, d)).withColumn("r", F.round("r", 6))


@query(f"WITH {_BOTH} SELECT round(avg(r), 6) AS r FROM (SELECT corr(t, p) AS r FROM pair GROUP BY channel) c")
def a18_mean_correlation(spark, d):
    return stats.mean_correlation(grid(spark, d), predicted(spark, d)).select(F.round("r", 6).alias("r"))


@query(f"""
WITH {_BOTH}, tt AS (SELECT * FROM vox WHERE v > 0.01), pp AS (SELECT * FROM prd WHERE v > 0.01), tot AS (SELECT channel AS a, count(*) AS total FROM tt GROUP BY 1),
n AS (SELECT t.channel AS a, p.channel AS b, count(*) AS n FROM tt t JOIN pp p ON t.mol_id = p.mol_id AND t.ix = p.ix AND t.iy = p.iy AND t.iz = p.iz
      LEFT JOIN vox q ON q.mol_id = t.mol_id AND q.ix = t.ix AND q.iy = t.iy AND q.iz = t.iz AND q.channel = p.channel AND q.v <> 0 WHERE t.channel = p.channel OR q.v IS NULL GROUP BY ALL)
SELECT n.a, b, n, R6[[n / (total + 1)::DOUBLE]] AS share FROM n JOIN tot ON n.a = tot.a""")
def a19_channel_confusion(spark, d):
    return rounded(stats.channel_confusion(grid(spark, d), predicted(spark, d)), "share")


@query(f"""
WITH {_BOTH} SELECT channel, round(sum(abs(t - p)) / ((SELECT count(DISTINCT mol_id) FROM (SELECT mol_id FROM vox UNION SELECT mol_id FROM prd) m) * 1728.0::DOUBLE), 9) AS mae,
round(avg(abs(t - p)) FILTER (WHERE t > 0.01), 6) AS mae_filled FROM pair GROUP BY channel""")
def a23_mean_absolute_error(spark, d):
    got = stats.mean_absolute_error(grid(spark, d), predicted(spark, d), SIDE**3)
    return got.select("channel", F.round("mae", 9).alias("mae"), F.round("mae_filled", 6).alias("mae_filled"))


@query(f"""
WITH {_BOTH}, f AS (SELECT DISTINCT mol_id, ix, iy, iz FROM vox WHERE v <> 0)
SELECT p.mol_id, floor(sum(p.v * CASE WHEN f.mol_id IS NULL THEN 0.25 ELSE 1.0 END) * 10000 + 0.501) / 10000 AS total FROM prd p LEFT JOIN f ON p.mol_id = f.mol_id AND p.ix = f.ix AND p.iy = f.iy AND p.iz = f.iz GROUP BY p.mol_id""")
def a22_masked_total(spark, d):
    return stats.masked_total(predicted(spark, d), grid(spark, d), 0.25).withColumn("total", F.floor(F.col("total") * 10000 + 0.501) / 10000)


@query(f"""
WITH {_BOTH}, most AS (SELECT mol_id, ix, iy, iz, max(v) AS most FROM prd GROUP BY ALL)
SELECT t.mol_id, R6[[sum(most * (greatest(-1, least(1, v)) / 2 + 0.5))]] AS overlap FROM vox t JOIN most m ON t.mol_id = m.mol_id AND t.ix = m.ix AND t.iy = m.iy AND t.iz = m.iz GROUP BY t.mol_id""")
def j8_steric_overlap(spark, d):
    return rounded(V.steric_overlap(grid(spark, d), predicted(spark, d)), "overlap")


@query("""
WITH t AS (SELECT mol_id, unnest([CASE WHEN is_hbd THEN 5 END, CASE WHEN is_hba THEN 6 END, CASE WHEN is_aromatic THEN 7 END]) AS ch FROM v_atoms)
SELECT ch, 'feature' AS kind, count(DISTINCT mol_id) AS n FROM t WHERE ch IS NOT NULL GROUP BY ch""")
def f20_channel_lookup(spark, d):
    chosen = V.channels_of(type_vocab(spark), channel_table(spark, CHANNELS), 301, 303)
    types = E.feature_types(F.col("atomic_num"), F.col("is_hbd"), F.col("is_hba"), F.col("is_aromatic"), F.col("charge"))
    n = stats.atoms_per_channel(atoms(spark, d).withColumn("types", types), channel_table(spark, CHANNELS)).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(chosen), "ch").select("ch", "kind", "n")


