"""Test-table views, written once for both engines, and the register of queries."""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import plain_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

# Each view stands in for a table of molecules, atoms, scores or text; SQL that both engines read alike.
VIEWS = {
    "v_atoms": """
SELECT l_orderkey AS mol_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS atom_idx,
       CASE l_partkey % 11 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN 16 WHEN 5 THEN 17 WHEN 6 THEN 9 WHEN 7 THEN 15 WHEN 8 THEN 35 ELSE 6 END AS atomic_num,
       l_quantity / 5 AS x, l_discount * 100 AS y, l_tax * 100 AS z,
       CASE l_suppkey % 10 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS charge,
       l_suppkey % 3 = 0 AS is_hbd, l_suppkey % 4 = 0 AS is_hba, l_partkey % 2 = 0 AS is_aromatic,
       CASE l_linestatus WHEN 'O' THEN 'ATOM' ELSE 'HETATM' END AS record,
       CASE l_suppkey % 9 WHEN 0 THEN 'HOH' WHEN 1 THEN 'GLY' ELSE 'ALA' END AS res_name, l_returnflag AS chain, l_suppkey % 7 AS res_num
FROM lineitem""",
    "v_bonds": """
SELECT mol_id, i, j, CASE (mol_id + i * 3) % 5 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 1.0 END * CAST(1 AS DOUBLE) AS bond_order
FROM (SELECT a.mol_id, a.atom_idx AS i, a.atom_idx + 1 AS j FROM v_atoms a JOIN (SELECT mol_id, count(*) AS n FROM v_atoms GROUP BY mol_id) c ON a.mol_id = c.mol_id WHERE a.atom_idx + 1 < c.n
      UNION ALL SELECT mol_id, CAST(0 AS BIGINT) AS i, count(*) - 1 AS j FROM v_atoms GROUP BY mol_id HAVING count(*) >= 4) t
WHERE (mol_id + i * 5 + j) % 7 <> 0""",
    "v_stats": """
SELECT concat('lib', CAST(o_custkey % 7 AS VARCHAR(9))) AS file, o_orderkey AS mol_idx,
       8 + o_orderkey % 43 AS num_atoms, 100 + o_totalprice - floor(o_totalprice / 500) * 500 AS mw, 3 + CAST(o_custkey % 230 AS DOUBLE) / 10 AS mol_width,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE -2 + CAST(o_orderkey * 7 % 90 AS DOUBLE) / 10 END AS alogp,
       o_custkey % 13 AS hba, o_orderkey * 3 % 9 AS hbd, (o_orderkey + o_custkey) % 14 AS rotb, 1 + CAST(o_custkey * 13 % 90 AS DOUBLE) / 10 AS sa,
       CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '5' WHEN 2 THEN '6' WHEN 3 THEN '5,6' WHEN 4 THEN '3,6' ELSE '6,6,7' END AS ring_sizes,
       CASE o_orderkey % 5 WHEN 0 THEN '' ELSE concat('c', CAST(o_custkey % 50 AS VARCHAR(9))) END AS murcko, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS smiles
FROM orders""",
    "v_scores": """
SELECT event_id, concat('p', CAST(user_id % 20 AS VARCHAR(9))) AS pdb_id, concat('f', CAST(user_id % 50 AS VARCHAR(9))) AS file, event_id AS mol_idx,
       CASE event_type WHEN 'signup' THEN 'initial' WHEN 'view' THEN 'run_opt1' WHEN 'click' THEN 'run_opt2' WHEN 'purchase' THEN 'run_opt3' ELSE 'failed' END AS model,
       -value AS affinity, event_type <> 'error' AS dock_success, CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'DOCK_FAIL' WHEN 1 THEN 'MOL_NONE' ELSE 'TIMEOUT' END END AS dock_reason
FROM events""",
}


def _needed(text: str) -> list[str]:
    """Names of the views that a text uses, themselves after those they use."""
    out: list[str] = []
    for name, body in VIEWS.items():
        if re.search(rf"\b{name}\b", text):
            out += [n for n in [*_needed(body), name] if n not in out]
    return out


def _with(text: str, kept: str = "") -> str:
    views = ", ".join(f"{n} AS {kept}({VIEWS[n]})" for n in _needed(text))
    if not views:
        return text
    return re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", lambda m: f"WITH {m[1] or ''}{views}, ", text) if re.match(r"\s*WITH\b", text) else f"WITH {views} {text}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table, of the tables in sf_dir."""
    plain_unions(spark)
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _with(f"SELECT * FROM {name}")
    used = set(re.findall(rf"(?:FROM|JOIN) ({BASE.replace(' ', '|')})\b", text))
    text = re.sub(rf"(FROM|JOIN) ({BASE.replace(' ', '|')})\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL. In it R6[[x]] is x rounded to six places, U[[seed, key]] a uniform number."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = re.sub(r"U\[\[(\w+), (.*?)\]\]", r"(CAST(concat('0x', substr(md5(concat('\1:', CAST(\2 AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)", sql)
            text = re.sub(r"R6\[\[(.*?)\]\]", r"(floor((\1) * 1000000 + 0.5) / 1000000)", text, flags=re.S)
            ORACLE_SQL[f.__name__] = _with(text, "MATERIALIZED ")  # each view is computed once, however often it is used
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000000 + 0.5) / 1000000


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})
