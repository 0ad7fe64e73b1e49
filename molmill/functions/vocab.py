"""Literal tables: elements, type numbers, default channels."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbols of the elements in order of atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i for i, s in enumerate(SYMBOLS, 1)}

# Standard weight, covalent radius in angstrom, default valence.
WEIGHT = {1: 1.008, 6: 12.011, 7: 14.007, 8: 15.999, 9: 18.998, 15: 30.974, 16: 32.06, 17: 35.45, 35: 79.904, 53: 126.904}
RADIUS = {1: 0.31, 6: 0.76, 7: 0.71, 8: 0.66, 9: 0.57, 15: 1.07, 16: 1.05, 17: 1.02, 35: 1.2, 53: 1.39}
VALENCE = {1: 1, 6: 4, 7: 3, 8: 2, 9: 1, 15: 3, 16: 2, 17: 1, 35: 1, 53: 1}

# The type vocabulary's numbers. Elements are e1..e118, bonds to an element bto1..bto118.
N_TYPES = 1024
DEFAULT_TYPE = 1023
FEATURES = {"HBD": 301, "HBA": 302, "Aromatic": 303, "FChargePos": 304, "FChargeNeut": 305, "FChargeNeg": 306}
BONDS = {"bond1": 801, "bond2": 802, "bond3": 803, "bond4": 804, "bondar": 805, "bondh": 806, "bondi": 807, "bondring": 820}
TYPES = {f"e{i}": (i, "element") for i in range(1, 119)} | {f"bto{i}": (118 + i, "bond_to") for i in range(1, 119)} | {k: (v, "feature") for k, v in FEATURES.items()} | {k: (v, "bond") for k, v in BONDS.items()}
BOND_OF_ORDER = {1.0: "bond1", 2.0: "bond2", 3.0: "bond3", 4.0: "bond4", 1.5: "bondar"}

LIBRARY_ELEMENTS = (6, 7, 8, 9, 15, 16, 17, 35, 53)
CHANNELS = [["e6"], ["e7"], ["e8"], ["e9", "e17", "e35", "e53"], ["e15", "e16"], ["HBD"], ["HBA"], ["Aromatic"], ["FChargePos", "FChargeNeg"]]


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def type_vocab(spark: SparkSession, more: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """(name, num, grp); more adds a user's own types, whose numbers may not be taken."""
    taken = {n for n, _ in TYPES.values()}
    for name, (num, _) in (more or {}).items():
        if name in TYPES or num in taken or not 0 < num < N_TYPES:
            raise ValueError(f"type {name} = {num} is taken or out of range")
    rows = [(name, num, grp) for name, (num, grp) in (TYPES | (more or {})).items()]
    return spark.createDataFrame(rows, "name string, num int, grp string")


def channel_table(spark: SparkSession, channels: list[list[str]] = CHANNELS, vocab: dict[str, tuple[int, str]] = TYPES) -> DataFrame:
    """(ch, type_num): a channel lists type names, or names of whole groups."""
    rows = [(ch, num) for ch, names in enumerate(channels) for name in names for num in ([vocab[name][0]] if name in vocab else [n for n, g in vocab.values() if g == name])]
    return spark.createDataFrame(rows, "ch int, type_num int")
