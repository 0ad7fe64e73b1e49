"""Counts, per-molecule properties, comparisons of voxel grids."""


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import distance
from ..functions.vocab import LIBRARY_ELEMENTS, WEIGHT, literal_map

XYZ = ("x", "y", "z")
VOXEL = ("ix", "iy", "iz")


def counts_by_file(mols: DataFrame, *conditions: tuple[str, str]) -> DataFrame:
    """Rows per file, and in all (file null), with one more count for each (name, condition)."""
    return mols.rollup("file").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(c)).alias(name) for name, c in conditions))


def remaining(counts: DataFrame, finished: DataFrame, proportion: float) -> DataFrame:
    """What is still to be read of files(file, n) that are not in finished(file)."""
    left = counts.where("file is not null").join(finished.select("file").distinct(), "file", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.floor(F.col("n") * proportion)), F.lit(0)).alias("remaining"))


def centres(atoms: DataFrame) -> DataFrame:
    """Per molecule the mean (cx…) and the middle of the range (mx…) of its coordinates."""
    return atoms.groupBy("mol_id").agg(*(F.avg(a).alias(f"c{a}") for a in XYZ), *(((F.max(a) + F.min(a)) / 2).alias(f"m{a}") for a in XYZ))


def recentred(atoms: DataFrame, to: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Each molecule moved so that its mean is at to."""
    by = Window.partitionBy("mol_id")
    return atoms.withColumns({a: F.col(a) - F.avg(a).over(by) + t for a, t in zip(XYZ, to, strict=True)})


def recentred_by(atoms: DataFrame, reference: DataFrame, key: str = "mol_id") -> DataFrame:
    """Atoms less the mean of the reference's atoms of their key; what has no reference stays."""
    mean = reference.groupBy(key).agg(*(F.avg(a).alias(f"c{a}") for a in XYZ))
    return atoms.join(mean, key, "left").withColumns({a: F.col(a) - F.coalesce(f"c{a}", F.lit(0.0)) for a in XYZ}).drop(*(f"c{a}" for a in XYZ))


def element_counts(atoms: DataFrame, elements=LIBRARY_ELEMENTS) -> DataFrame:
    return atoms.groupBy("mol_id").agg(*(F.count_if(F.col("atomic_num") == n).alias(f"e{n}") for n in elements))


def composition(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per molecule: heavy and hetero atoms, weight, and acceptors (N, O) and donors (H on N or O) as Lipinski counts them."""
    own = atoms.groupBy("mol_id").agg(
        F.count_if(F.col("atomic_num") != 1).alias("num_atoms"), F.count_if(~F.col("atomic_num").isin(1, 6)).alias("num_het_atoms"),
        F.sum(literal_map(WEIGHT)[F.col("atomic_num")]).alias("mw"), F.count_if(F.col("atomic_num").isin(7, 8)).alias("hba_lipinski"),
    )
    ends = bonds.select("mol_id", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e")).select("mol_id", "e.*")
    polar = atoms.where("atomic_num in (7, 8)").select("mol_id", F.col("atom_idx").alias("a"))
    hydrogens = atoms.where("atomic_num = 1").select("mol_id", F.col("atom_idx").alias("b"))
    donors = ends.join(polar, ["mol_id", "a"]).join(hydrogens, ["mol_id", "b"]).groupBy("mol_id").agg(F.count(F.lit(1)).alias("hbd_lipinski"))
    return own.join(donors, "mol_id", "left").fillna(0, ["hbd_lipinski"])


def width(atoms: DataFrame) -> DataFrame:
    """Greatest distance between two atoms of a molecule, over arrays: no join. 0 for one atom."""
    packed = atoms.groupBy("mol_id").agg(F.collect_list(F.struct(*XYZ)).alias("p"))
    far = F.array_max(F.transform("p", lambda a: F.array_max(F.transform("p", lambda b: distance(tuple(a[c] for c in XYZ), tuple(b[c] for c in XYZ))))))
    return packed.select("mol_id", far.alias("mol_width"))


def inertia(atoms: DataFrame) -> DataFrame:
    """Per molecule mass-weighted second moments about the centre of mass: xx, yy, zz, xy, xz, yz."""
    m = literal_map(WEIGHT)[F.col("atomic_num")]
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    sums = atoms.withColumn("m", m).groupBy("mol_id").agg(
        F.sum("m").alias("m"), *(F.sum(F.col("m") * F.col(a)).alias(a) for a in XYZ), *(F.sum(F.col("m") * F.col(a) * F.col(b)).alias(a + b) for a, b in pairs)
    )
    return sums.select("mol_id", *((F.col(a + b) - F.col(a) * F.col(b) / F.col("m")).alias(a + b) for a, b in pairs))


def _shape(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.DataFrame:
    s = np.stack([np.stack(r, axis=1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=1).astype(float)
    tensor = np.trace(s, axis1=1, axis2=2)[:, None, None] * np.eye(3) - s
    i = np.linalg.eigvalsh(tensor)
    ratio = i[:, :2] / np.where(i[:, 2:] > 1e-9, i[:, 2:], np.nan)
    return pd.DataFrame({"npr1": ratio[:, 0], "npr2": ratio[:, 1]})


def shape_ratios(atoms: DataFrame) -> DataFrame:
    """npr1, npr2: the two smaller principal moments of inertia over the greatest; null for one place."""
    shape = F.pandas_udf(_shape, "struct<npr1: double, npr2: double>")
    got = inertia(atoms).select("mol_id", shape("xx", "yy", "zz", "xy", "xz", "yz").alias("s"))
    return got.select("mol_id", *(F.when(~F.isnan(f"s.{c}"), F.col(f"s.{c}")).alias(c) for c in ("npr1", "npr2")))


def true_widths(packed: DataFrame) -> DataFrame:
    """Most atoms of a molecule and most types of an atom in packed(atom_types array of arrays), without padding."""
    return packed.agg(
        F.max(F.size(F.filter("atom_types", lambda t: F.exists(t, lambda v: v != -1)))).alias("natoms_max"),
        F.max(F.array_max(F.transform("atom_types", lambda t: F.size(F.filter(t, lambda v: v != -1))))).alias("types_max"),
    )


def atoms_per_channel(atoms: DataFrame, channels: DataFrame) -> DataFrame:
    """n of atoms(mol_id, atom_idx, types) by molecule and channel; an atom of several channels counts in each."""
    typed = atoms.select("mol_id", "atom_idx", F.explode("types").alias("type_num"))
    return typed.join(F.broadcast(channels), "type_num").select("mol_id", "ch", "atom_idx").distinct().groupBy("mol_id", "ch").agg(F.count(F.lit(1)).alias("n"))


def _paired(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Voxels of both grids, by key; where one has no row its value is 0."""
    key = ["mol_id", "channel", *VOXEL]
    return true.select(*key, F.col("v").alias("t")).join(pred.select(*key, F.col("v").alias("p")), key, "full").fillna(0.0, ["t", "p"])


def channel_correlation(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Pearson r by channel over voxels that either grid has; null where one of them does not vary."""
    r = _paired(true, pred).groupBy("channel").agg(F.corr("t", "p").alias("r"))
    return r.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def mean_correlation(true: DataFrame, pred: DataFrame) -> DataFrame:
    return channel_correlation(true, pred).agg(F.avg("r").alias("r"))


def channel_confusion(true: DataFrame, pred: DataFrame, least: float = 0.01) -> DataFrame:
    """For channels a of the truth and b of the prediction: voxels with both above least, over one more than the truth's in a.

    Off the diagonal a voxel counts only if the truth has nothing in b there.
    """
    key = ["mol_id", *VOXEL]
    t = true.where(F.col("v") > least).select(*key, F.col("channel").alias("a"))
    p = pred.where(F.col("v") > least).select(*key, F.col("channel").alias("b"))
    inside = true.where("v <> 0").select(*key, F.col("channel").alias("b"), F.lit(True).alias("also"))
    both = t.join(p, key).join(inside, [*key, "b"], "left").where("a = b or also is null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy("a").agg(F.count(F.lit(1)).alias("total"))
    return both.join(total, "a").select("a", "b", "n", (F.col("n") / (F.col("total") + 1)).alias("share"))


def mean_absolute_error(true: DataFrame, pred: DataFrame, cells: int, least: float = 0.01) -> DataFrame:
    """By channel: mean over all cells of a channel's grids (absent voxels are 0), and over voxels whose truth is above least."""
    off = F.abs(F.col("t") - F.col("p"))
    mols = true.select("mol_id").union(pred.select("mol_id")).distinct().agg(F.count(F.lit(1)).alias("mols"))
    by = _paired(true, pred).groupBy("channel").agg(F.sum(off).alias("off"), F.avg(F.when(F.col("t") > least, off)).alias("mae_filled"))
    return by.crossJoin(F.broadcast(mols)).select("channel", (F.col("off") / (F.col("mols") * cells)).alias("mae"), "mae_filled")  # mols is one row


def masked_total(values: DataFrame, true: DataFrame, zero_alpha: float) -> DataFrame:
    """Sum by molecule of values(mol_id, ix, iy, iz, v); voxels that are empty in the truth weigh zero_alpha."""
    key = ["mol_id", *VOXEL]
    filled = true.where("v <> 0").select(*key).distinct().withColumn("filled", F.lit(True))
    return values.join(filled, key, "left").groupBy("mol_id").agg(F.sum(F.col("v") * F.when(F.col("filled"), 1.0).otherwise(zero_alpha)).alias("total"))


def contact_penalty(atoms: DataFrame, least: float = 1.3) -> DataFrame:
    """Per molecule the sum over atom pairs nearer than least of (least - distance)^2."""
    a, b = atoms.alias("a"), atoms.alias("b")
    d = distance(tuple(F.col(f"a.{c}") for c in XYZ), tuple(F.col(f"b.{c}") for c in XYZ))
    pairs = a.join(b, (F.col("a.mol_id") == F.col("b.mol_id")) & (F.col("a.atom_idx") < F.col("b.atom_idx")))
    some = pairs.groupBy("a.mol_id").agg(F.sum(F.pow(F.greatest(least - d, F.lit(0.0)), F.lit(2))).alias("penalty"))
    return atoms.select("mol_id").distinct().join(some, "mol_id", "left").fillna(0.0, ["penalty"])


