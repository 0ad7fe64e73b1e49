"""Filters of atoms, molecules and files."""

from dataclasses import dataclass, fields, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import distance, in_bounds
from ..functions.vocab import LIBRARY_ELEMENTS

AXES = ("x", "y", "z")


def drop_hydrogens(atoms: DataFrame) -> DataFrame:
    """Atoms but hydrogens, numbered anew from 0 in each molecule."""
    by = Window.partitionBy("mol_id").orderBy("atom_idx")
    return atoms.where("atomic_num <> 1").withColumn("atom_idx", F.row_number().over(by) - 1)


def drop_hetero(atoms: DataFrame) -> DataFrame:
    return atoms.where("record = 'ATOM'")


def drop_waters(atoms: DataFrame) -> DataFrame:
    return atoms.where("res_name <> 'HOH'")


def clean_receptor(atoms: DataFrame, remove_hetero: bool = False, remove_waters: bool = True) -> DataFrame:
    """Hetero atoms go if asked; else waters do. Waters are hetero atoms."""
    return drop_hetero(atoms) if remove_hetero else drop_waters(atoms) if remove_waters else atoms


def in_range(c: Column, low=None, high=None) -> Column:
    """Inclusive at both ends; no bound, no test; a missing value fails a test."""
    tests = [t for t in (c >= low if low is not None else None, c <= high if high is not None else None) if t is not None]
    return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)


def allowed_elements(numbers: Column, allowed=LIBRARY_ELEMENTS) -> Column:
    """Whether an array of atomic numbers has only allowed elements and hydrogen."""
    return F.forall(numbers, lambda n: n.isin(1, *allowed))


def rings_allowed(sizes: Column, allowed) -> Column:
    """Whether all ring sizes are allowed; without rings they are."""
    return F.forall(sizes, lambda s: s.isin(*allowed))


def molecules_of_elements(atoms: DataFrame, allowed=LIBRARY_ELEMENTS) -> DataFrame:
    """mol_id and whether only allowed elements and hydrogen are in it."""
    return atoms.groupBy("mol_id").agg(F.bool_and(F.col("atomic_num").isin(1, *allowed)).alias("allowed"))


def is_3d(atoms: DataFrame) -> DataFrame:
    """mol_id and is_3d: no axis on which every coordinate is zero."""
    return atoms.groupBy("mol_id").agg(reduce(and_, (F.coalesce(F.max(F.abs(a)), F.lit(0)) > 0 for a in AXES)).alias("is_3d"))


def double_bond_limit(bonds: DataFrame, mol_ids: DataFrame, allow_pairs: bool | None = False) -> DataFrame:
    """mol_ids without molecules that have an atom with two double bonds; allow_pairs True or None lets them pass."""
    if allow_pairs is not False:
        return mol_ids
    ends = bonds.where("bond_order = 2").select("mol_id", F.explode(F.array("i", "j")).alias("atom"))
    return mol_ids.join(ends.groupBy("mol_id", "atom").count().where("count > 1").select("mol_id").distinct(), "mol_id", "left_anti")


@dataclass(frozen=True)
class MolFilter:
    """Thresholds; None is no test. ring_system_max and ring_loops_max test even at 0."""

    natoms_min: float | None = None
    natoms_max: float | None = None
    width_min: float | None = None
    width_max: float | None = None
    weight_min: float | None = None
    weight_max: float | None = None
    logp_min: float | None = None
    logp_max: float | None = None
    hba_min: float | None = None
    hba_max: float | None = None
    hbd_min: float | None = None
    hbd_max: float | None = None
    rotb_min: float | None = None
    rotb_max: float | None = None
    ring_sizes: tuple | None = None
    ring_system_max: int | None = None
    ring_loops_max: int | None = None
    double_bond_pairs: bool | None = None
    check_3d: bool = False
    atomic_nums: tuple | None = None
    exclude_pains: bool = False

    def condition(self) -> Column:
        """All tests on one row per molecule; only the columns of tests in use are needed."""
        cheap = [in_range(F.col(c), getattr(self, f"{k}_min"), getattr(self, f"{k}_max")) for k, c in COLUMNS.items() if k != "width" and (getattr(self, f"{k}_min"), getattr(self, f"{k}_max")) != (None, None)]
        if self.atomic_nums is not None:
            cheap.append(allowed_elements(F.col("atomic_nums"), self.atomic_nums))
        if self.check_3d:
            cheap.append(F.col("is_3d"))
        if self.ring_sizes is not None:
            cheap.append(rings_allowed(F.col("ring_sizes"), self.ring_sizes))
        for limit, c in ((self.ring_system_max, "ring_system_size"), (self.ring_loops_max, "ring_loops")):
            if limit is not None:
                cheap.append(F.coalesce(F.col(c) <= limit, F.lit(True)))
        if self.double_bond_pairs is False:
            cheap.append(~F.col("double_bond_pair"))
        if self.exclude_pains:
            cheap.append(F.col("pains").isNull())
        if (self.width_min, self.width_max) != (None, None):  # the dearest property last
            cheap.append(in_range(F.col(COLUMNS["width"]), self.width_min, self.width_max))
        return reduce(and_, cheap) if cheap else F.lit(True)

    def check(self, mols: DataFrame) -> DataFrame:
        return mols.withColumn("pass", self.condition())

    def keep(self, mols: DataFrame) -> DataFrame:
        return mols.where(self.condition())


COLUMNS = {"natoms": "num_atoms", "weight": "mw", "logp": "alogp", "hba": "hba", "hbd": "hbd", "rotb": "rotb", "width": "mol_width"}

# The presets' thresholds. The caps on acceptors and donors are as the tool that they come from has them.
_DRUG_LIKE = MolFilter(weight_min=200, weight_max=500, natoms_min=0, natoms_max=50, hbd_max=10, hba_max=5, rotb_max=12, logp_min=-1, logp_max=5, atomic_nums=LIBRARY_ELEMENTS)
_GEN_OPT = MolFilter(ring_sizes=(5, 6), ring_system_max=3, ring_loops_max=0, double_bond_pairs=False)
_LIBRARY = MolFilter(weight_min=200, weight_max=500, width_max=20, check_3d=True, logp_max=5, atomic_nums=LIBRARY_ELEMENTS)
PRESETS = {"drug_like": _DRUG_LIKE, "gen_opt": _GEN_OPT, "default": replace(_DRUG_LIKE, width_max=20), "library": _LIBRARY}


def preset(name: str, **changes) -> MolFilter:
    unknown = changes.keys() - {f.name for f in fields(MolFilter)}
    if unknown:
        raise ValueError(f"no such threshold: {sorted(unknown)}")
    return replace(PRESETS[name], **changes)


def without_hits(rows: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return rows.join(hits.select(key).distinct(), key, "left_anti")


def complete_records(files: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """pdb_id of which files(pdb_id, kind) has each kind exactly once."""
    counts = files.groupBy("pdb_id").pivot("kind", list(kinds)).count()
    return counts.where(reduce(and_, (F.coalesce(F.col(k) == 1, F.lit(False)) for k in kinds))).select("pdb_id")


def excluded_names(rows: DataFrame, name: str, parts=("readme", "index", ".txt"), allow: DataFrame | None = None) -> DataFrame:
    """Rows whose name has none of the parts and, with an allow list(name), is in it."""
    rows = rows.where(~reduce(lambda a, b: a | b, (F.contains(F.col(name), F.lit(p)) for p in parts)))
    return rows if allow is None else rows.join(allow.select(F.col("name").alias(name)).distinct(), name, "left_semi")


def centres(atoms: DataFrame, key: str = "mol_id") -> DataFrame:
    """key, cx, cy, cz: the mean place of a key's atoms, added up in the order of atom_idx, so that the last digit does not follow how rows are dealt."""
    order = Window.partitionBy(key).orderBy("atom_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"c{a}" for a in AXES]
    running = atoms.select(key, "atom_idx", *(F.avg(a).over(order).alias(n) for a, n in zip(AXES, names, strict=True)))
    return running.groupBy(key).agg(*(F.max_by(n, "atom_idx").alias(n) for n in names))


def within_radius(atoms: DataFrame, centres: DataFrame, key: str, radius: float) -> DataFrame:
    """Atoms nearer than radius to the centre(key, cx, cy, cz) of their key."""
    return atoms.join(centres, key).where(distance(tuple(map(F.col, AXES)), tuple(F.col(f"c{a}") for a in AXES)) < radius).drop("cx", "cy", "cz")


def reference_and_generated(rows: DataFrame, name: str = "file") -> tuple[DataFrame, DataFrame]:
    return tuple(rows.where(F.contains(F.col(name), F.lit(p))) for p in ("_ref", "_gen"))


def size_gate(mols: DataFrame, atoms: str = "n_heavy", least: int = 2) -> DataFrame:
    """With dock_success and dock_reason: molecules that are missing or too small fail."""
    bad = F.col(atoms).isNull() | (F.col(atoms) < least)
    return mols.withColumn("dock_success", ~bad).withColumn("dock_reason", F.when(bad, "MOL_NONE"))


def bounds_flag(atoms: DataFrame, pad: float = 0, side: int = 48) -> DataFrame:
    return atoms.withColumn("in_bounds", in_bounds(tuple(map(F.col, AXES)), side, pad))


def valid_encoding(atoms: DataFrame, channels: DataFrame, side: int = 48, margin: float = 1) -> DataFrame:
    """Atoms(…, types) with valid: inside, no coordinate missing, in one channel at least."""
    nums = [r[0] for r in channels.select("type_num").distinct().collect()]  # 1024 at most
    there = reduce(and_, (F.col(a).isNotNull() & ~F.isnan(a) for a in AXES))
    return atoms.withColumn("valid", in_bounds(tuple(map(F.col, AXES)), side, margin) & there & F.arrays_overlap("types", F.array(*map(F.lit, nums))))
