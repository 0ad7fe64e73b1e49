"""Whole workloads: library build, library profile and sample, selection, complexes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import distance
from ..functions.vocab import WEIGHT, literal_map
from ..operators import sampling, scores
from ..operators.bricks import bricks, half_voxels, voxels
from ..operators.filters import MolFilter, drop_hydrogens, within_radius
from ..operators.geometry import pocket
from ..operators.similarity import butina
from ..operators.voxels import channelled, gaussian_kernel, in_voxels
from ..sources import parse as P
from ..storage import scratch


def molecule_rows(blocks: DataFrame) -> DataFrame:
    """One row per block with its atoms as arrays and the properties that follow from them: nothing is exploded or shuffled."""
    lines = P.lines(F.col("block"))
    n, _ = P.sdf_counts(F.col("block"))
    atom = F.transform(
        F.slice(lines, 5, F.coalesce(n, F.lit(0))),
        lambda s: F.struct(*(P.field(s, i, i + 9).try_cast("double").alias(a) for a, i in (("x", 1), ("y", 11), ("z", 21))), P.atomic_number(P.field(s, 32, 34)).alias("n")),
    )
    # As a generator's output the atoms are parsed once; else every use of the column, in filters too, would parse them again.
    rows = blocks.select("*", F.inline(F.array(F.struct(F.filter(atom, lambda a: a["n"].isNotNull()).alias("atoms")))))
    xyz = lambda a: tuple(a[c] for c in "xyz")
    far = F.array_max(F.transform("atoms", lambda a: F.array_max(F.transform("atoms", lambda b: distance(xyz(a), xyz(b))))))
    flat = lambda c: F.forall(F.col(f"atoms.{c}"), lambda v: F.abs(v) == 0)
    weights = literal_map(WEIGHT)
    return rows.withColumns({
        "num_atoms": F.size(F.filter("atoms", lambda a: a["n"] != 1)), "atomic_nums": F.array_distinct(F.col("atoms.n")), "is_3d": ~(flat("x") | flat("y") | flat("z")),
        "mw": F.aggregate("atoms", F.lit(0.0), lambda s, a: s + F.coalesce(weights[a["n"]], F.lit(0.0))), "mol_width": far,
    })


def library_build(blocks: DataFrame, keep: MolFilter, natoms_max: int = 40, hydrogens: bool = False) -> DataFrame:
    """name, atom_types, atom_coords of the blocks that the filter keeps, centred, without padding: one pass, no shuffle."""
    rows = keep.keep(molecule_rows(blocks))
    rows = rows if hydrogens else rows.withColumn("atoms", F.filter("atoms", lambda a: a["n"] != 1))
    rows = rows.where((F.size("atoms") > 0) & (F.size("atoms") <= natoms_max))
    mean = {c: F.aggregate(F.col(f"atoms.{c}"), F.lit(0.0), lambda s, v: s + v) / F.size("atoms") for c in "xyz"}
    return rows.select(
        "name", F.transform("atoms", lambda a: F.array(a["n"].cast("smallint"))).alias("atom_types"), F.transform("atoms", lambda a: F.array(*((a[c] - mean[c]).cast("float") for c in "xyz"))).alias("atom_coords")
    )


def library_sample(stats: DataFrame, keep: MolFilter, edges: dict[str, list[float]], n_sample: float, n_total: float, seed: str, *keys) -> DataFrame:
    """Rows that the filter keeps, sampled so that all bins of their properties give about as many."""
    return sampling.stratified(keep.keep(stats), edges, n_sample, n_total, seed, *keys)


def selection(tables: list[DataFrame], q: float, n: int, value: str = "affinity", fps: DataFrame | None = None, cutoff: float = 0.7, use_threshold: bool = True) -> DataFrame:
    """The n best rows per target of the latest generation, below the target's threshold; with fingerprints the most diverse of them."""
    rows = scores.joined_tables(*tables).where("dock_success")
    last = scores.latest_generation(rows)
    if use_threshold:
        last = scores.better_than_threshold(last, scores.quantiles(rows, q, value), value)
    if fps is None:
        return scores.top(last, n, value)
    grouped = fps.join(last.select("mol_idx", F.concat_ws("/", "model", "pdb_id").alias("grp")), fps.mol_id == F.col("mol_idx")).select("mol_id", "grp", "words")
    clusters = butina(grouped, cutoff).select(F.col("mol_id").alias("mol_idx"), "cluster")
    return scores.diverse_top(last.join(clusters, "mol_idx"), n, value)


def complexes(ligand: DataFrame, receptor: DataFrame, radius: float, key: str = "pdb_id", residues: bool = False) -> DataFrame:
    """Ligand and receptor atoms about the ligand's centre, hydrogens dropped, the receptor cut to the radius; part tells them apart."""
    lig = drop_hydrogens(ligand.withColumn("mol_id", F.col(key)))
    centre = lig.groupBy(key).agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))
    rec = receptor.where("atomic_num <> 1")
    rec = pocket(rec, lig, 8.0, key) if residues else within_radius(rec, centre, key, radius)
    both = lig.select(key, "atomic_num", *"xyz", F.lit("ligand").alias("part")).unionByName(rec.select(key, "atomic_num", *"xyz", F.lit("receptor").alias("part")))
    return both.join(centre, key).withColumns({c: F.col(c) - F.col(f"c{c}") for c in "xyz"}).drop("cx", "cy", "cz")


def complex_voxels(atoms: DataFrame, channels: DataFrame, size: float = 24.0, resolution: float = 0.5) -> dict[str, DataFrame]:
    """Soft encoding of atoms(mol_id, atom_idx, x, y, z, types) about 0, its density, and that at half resolution; the density's bricks are written once."""
    side = int(size / resolution)
    points = channelled(in_voxels(atoms, size=size, resolution=resolution), channels)
    blurred = scratch(bricks(points, side, kernel=gaussian_kernel(resolution=resolution)), "bricks")
    return {"grid": voxels(bricks(points, side)), "density": voxels(blurred), "half": half_voxels(blurred)}
