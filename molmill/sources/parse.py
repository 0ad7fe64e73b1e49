"""Molecule, receptor and log texts to columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import atomic_number

# What a scoring log's lines start with, and the metrics they give.
METRICS = {
    "affinity_qvina": "Affinity:", "affinity_qvina_initial": "Initial Affinity:", "intra_e": "Intramolecular energy:", "gauss_1": "gauss 1", "gauss_2": "gauss 2",
    "repulsion": "repulsion", "hydrophobic": "hydrophobic", "hbond": "Hydrogen",
}
DOCKED_BELOW = "-----+------------+----------+----------"


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def field(line: Column, first: int, last: int) -> Column:
    """Trimmed characters first to last, from 1, both counted."""
    return F.trim(F.substring(line, first, last - first + 1))


def molecule_name(block: Column, mark: str = "ZINC") -> Column:
    """The last line with the mark; null without."""
    return F.trim(F.try_element_at(F.filter(lines(block), lambda x: F.contains(x, F.lit(mark))), F.lit(-1)))


def numeric_id(name: Column, mark: str = "ZINC") -> Column:
    return F.regexp_replace(name, mark, "").try_cast("bigint")


def dimension_3d(block: Column) -> Column:
    """Whether the header says that coordinates are three-dimensional."""
    return F.regexp_extract(F.get(lines(block), 1), r"\b([23]D)\b", 1) == "3D"


def sdf_counts(block: Column) -> tuple[Column, Column]:
    line = F.get(lines(block), 3)
    return field(line, 1, 3).try_cast("int"), field(line, 4, 6).try_cast("int")


def sdf_atoms(blocks: DataFrame, *keys: str, block: str = "block") -> DataFrame:
    """One row per atom of an SDF block: atom_idx, symbol, atomic_num, x, y, z."""
    n, _ = sdf_counts(F.col(block))
    each = blocks.select(*keys, F.posexplode(F.slice(lines(F.col(block)), 5, F.coalesce(n, F.lit(0)))).alias("atom_idx", "line"))
    line = F.col("line")
    xyz = [field(line, i, i + 9).try_cast("double").alias(a) for a, i in (("x", 1), ("y", 11), ("z", 21))]
    return each.select(*keys, "atom_idx", field(line, 32, 34).alias("symbol"), atomic_number(field(line, 32, 34)).alias("atomic_num"), *xyz)


def sdf_bonds(blocks: DataFrame, *keys: str, block: str = "block") -> DataFrame:
    """One row per bond: i < j from 0, bond_order (4, aromatic, is 1.5)."""
    n, m = sdf_counts(F.col(block))
    each = blocks.select(*keys, F.explode(F.slice(lines(F.col(block)), F.coalesce(n, F.lit(0)) + 5, F.coalesce(m, F.lit(0)))).alias("line"))
    a, b, order = (field(F.col("line"), i, i + 2).try_cast("int") for i in (1, 4, 7))
    return each.select(*keys, (F.least(a, b) - 1).alias("i"), (F.greatest(a, b) - 1).alias("j"), F.when(order == 4, 1.5).otherwise(order.cast("double")).alias("bond_order"))


def mol2_section(block: Column, name: str) -> Column:
    """Lines of a section of a MOL2 block."""
    part = F.regexp_extract(block, rf"(?s)@<TRIPOS>{name}\r?\n(.*?)(?=@<TRIPOS>|\z)", 1)
    return F.filter(lines(part), lambda x: F.trim(x) != "")


def mol2_atoms(blocks: DataFrame, *keys: str, block: str = "block") -> DataFrame:
    each = blocks.select(*keys, F.posexplode(mol2_section(F.col(block), "ATOM")).alias("atom_idx", "line"))
    f = F.split(F.trim("line"), r"\s+")
    symbol = F.split(F.get(f, 5), r"\.")[0]
    return each.select(*keys, "atom_idx", symbol.alias("symbol"), atomic_number(symbol).alias("atomic_num"), *(F.get(f, i).try_cast("double").alias(a) for i, a in enumerate("xyz", 2)))


def mol2_bonds(blocks: DataFrame, *keys: str, block: str = "block") -> DataFrame:
    each = blocks.select(*keys, F.explode(mol2_section(F.col(block), "BOND")).alias("line"))
    f = F.split(F.trim("line"), r"\s+")
    a, b = (F.get(f, i).try_cast("int") for i in (1, 2))
    return each.select(*keys, (F.least(a, b) - 1).alias("i"), (F.greatest(a, b) - 1).alias("j"), F.when(F.get(f, 3) == "ar", 1.5).otherwise(F.get(f, 3).try_cast("double")).alias("bond_order"))


def pdb_atoms(rows: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """One row per ATOM or HETATM line of fixed columns; PDBQT lines too, with charge and type."""
    v = F.col(line)
    number = lambda i, j, t: field(v, i, j).try_cast(t)
    return rows.where(field(v, 1, 6).isin("ATOM", "HETATM")).select(
        *keys, field(v, 1, 6).alias("record"), number(7, 11, "int").alias("serial"), field(v, 13, 16).alias("atom_name"), field(v, 18, 20).alias("res_name"), field(v, 22, 22).alias("chain"),
        number(23, 26, "int").alias("res_num"), number(31, 38, "double").alias("x"), number(39, 46, "double").alias("y"), number(47, 54, "double").alias("z"), field(v, 77, 78).alias("element"),
        number(71, 76, "double").alias("partial_charge"), field(v, 78, 79).alias("atom_type"),
    )


def models(text: Column) -> Column:
    """Models of a multi-model text, without MODEL and blank lines; empty ones are left out."""
    clean = lambda m: F.array_join(F.filter(lines(m), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("MODEL"))), "\n")
    return F.filter(F.transform(F.split(text, "ENDMDL"), clean), lambda m: m != "")


def first_model(text: Column) -> Column:
    return F.get(models(text), 0)


def model_atoms(model: Column) -> Column:
    return F.size(F.filter(lines(model), lambda x: F.startswith(x, F.lit("ATOM")) | F.startswith(x, F.lit("HETATM"))))


def score_metrics(log: Column) -> dict[str, Column]:
    """Per metric what stands after the colon of its line, up to a bracket; null if it is no number. Later lines win."""
    trimmed = F.transform(lines(log), lambda x: F.trim(x))

    def metric(start):
        line = F.try_element_at(F.filter(trimmed, lambda x: F.startswith(x, F.lit(start))), F.lit(-1))
        return F.trim(F.get(F.split(F.get(F.split(line, ":"), 1), r"\("), 0)).try_cast("double")

    return {name: metric(start) for name, start in METRICS.items()}


def docked_affinity(log: Column) -> Column:
    """Second field of the line below the table's rule."""
    return F.regexp_extract(log, r"-----\+------------\+----------\+----------\r?\n\s*\S+\s+(\S+)", 1).try_cast("double")


def path_part(path: Column, k: int) -> Column:
    """k-th part from the end, the file name being 1."""
    return F.try_element_at(F.split(path, "/"), F.lit(-k))


def path_keys(rows: DataFrame, path: str = "path") -> DataFrame:
    return rows.withColumns({n: path_part(F.col(path), k) for k, n in enumerate(("fname", "pdb_id", "experiment", "model"), 1)})


def extension(path: Column) -> Column:
    """sdf, mol2, pdb or pdbqt, with or without .gz; null for any other."""
    found = F.regexp_extract(F.lower(path), r"\.(sdf|mol2|pdbqt|pdb)(\.gz)?$", 1)
    return F.when(found != "", found)


def nearest_known_folder(paths: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """path and the last of its parts that is a known(pdb_id); null without."""
    parts = paths.select(path, F.posexplode(F.split(path, "/")).alias("at", "pdb_id")).join(known.select("pdb_id").distinct(), "pdb_id", "left_semi")
    return paths.join(parts.groupBy(path).agg(F.max_by("pdb_id", "at").alias("pdb_id")), path, "left")


def run_name(model: Column, experiment: Column, fname: Column) -> Column:
    opt = F.contains(fname, F.lit("_opt"))
    name = F.concat(model, F.lit(" "), experiment, F.lit(" "), fname, F.when(opt, " (opt)").otherwise(""))
    for old, new in (("_qvina.csv", ""), ("_res2_v2", ""), ("posterior", "pt"), ("prior", "pr"), ("mols_gen", "")):  # fixed values
        name = F.replace(name, F.lit(old), F.lit(new))
    name = F.concat(F.split(name, "pr ")[0], F.when(opt, " (opt)").otherwise(""))
    return F.replace(F.trim(name), F.lit("fullatom_joint"), F.lit("faj"))


def scaffold(murcko: Column, smiles: Column) -> Column:
    return F.when(murcko == "", F.concat(F.lit("xx"), smiles)).otherwise(murcko)


def docking_box(atoms: DataFrame, key: str = "mol_id", edge: float = 20.0) -> DataFrame:
    """Centre of each molecule's atoms and the box's edge, as text of two decimals."""
    return atoms.groupBy(key).agg(*(F.format_string("%.2f", F.floor(F.avg(a) * 100 + 0.5000001) / 100).alias(f"center_{a}") for a in "xyz")).withColumns({f"size_{a}": F.format_string("%.2f", F.lit(edge)) for a in "xyz"})


def catalog_rows(rows: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """ord, reg_id, pattern of lines FRAGMENT, regId=…, pattern; comments and blank lines go. order numbers the lines."""
    kept = rows.where(~F.startswith(line, F.lit("#")) & (F.trim(line) != ""))
    f = F.split(F.trim(F.col(line)), r"\s+")
    nth = F.row_number().over(Window.orderBy(order or F.monotonically_increasing_id())) - 1  # a catalog is a few hundred lines
    return kept.select(nth.alias("ord"), F.replace(F.get(f, 1), F.lit("regId="), F.lit("")).alias("reg_id"), F.get(f, 2).alias("pattern"))


