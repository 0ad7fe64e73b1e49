"""Readers of files that are split between tasks: every block once, with its place."""

import random

import pytest
from molmill.sources import readers as R


@pytest.fixture
def small_splits(spark):
    for k, v in {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}.items():
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(k)


def test_blocks_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(1)
    body = lambda k: "".join(f"line {k} é {rng.random()}\n" for _ in range(rng.randint(1, 25)))
    sdf, mol2, models = {}, {}, {}
    for f in "abc":
        sdf[f] = [f"name {f}{i}\n" + body(i) for i in range(rng.randint(1, 30))]
        (tmp_path / f"{f}.sdf").write_text("".join(b + "$$$$\n" for b in sdf[f]))
        mol2[f] = [f"\nZINC{i}\n" + body(i) for i in range(rng.randint(1, 30))]
        (tmp_path / f"{f}.mol2").write_text({"a": "", "b": "# a comment\n# of two lines\n", "c": "\n\n"}[f] + "".join("@<TRIPOS>MOLECULE" + b for b in mol2[f]))
        models[f] = ["".join(f"ATOM {i} {k}\n" for k in range(rng.randint(1, 20))) for i in range(rng.randint(1, 30))]
        (tmp_path / f"{f}.pdbqt").write_text("".join(f"MODEL {i}\n{m}ENDMDL\n" for i, m in enumerate(models[f])))
    (tmp_path / "one.pdbqt").write_text("ATOM 1\nHETATM 2\n")
    stem = lambda r: r.file.rsplit("/", 1)[1].split(".")[0]
    paths = lambda kind: [str(p) for p in sorted(tmp_path.glob(f"*.{kind}"))]
    assert spark.read.text(paths("sdf")).rdd.getNumPartitions() > 6
    got = {(stem(r), r.mol_idx): r.block for r in R.read_sdf(spark, paths("sdf")).collect()}
    assert got == {(f, i): b for f, bs in sdf.items() for i, b in enumerate(bs)}
    got = {(stem(r), r.mol_idx): (r.name, r.block) for r in R.read_mol2(spark, paths("mol2")).collect()}
    assert got == {(f, i): (f"ZINC{i}", b) for f, bs in mol2.items() for i, b in enumerate(bs)}
    got = {(stem(r), r.mol_idx): (r.block, r.n_atoms) for r in R.read_pdbqt_models(spark, paths("pdbqt")).collect()}
    assert got == {(f, i): (m.rstrip("\n"), m.count("\n")) for f, ms in models.items() for i, m in enumerate(ms)} | {("one", 0): ("ATOM 1\nHETATM 2", 2)}
