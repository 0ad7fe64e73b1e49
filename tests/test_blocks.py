"""The stream of text blocks: every block once, whatever the ranges and wherever it stops."""

import gzip
import random

import pytest
from molmill.streaming import ingest as T
from molmill.streaming.blocks import BlockReader, blocks_of, text_blocks


def plain(text: bytes, mark: bytes, leads: bool):
    out, at = [], 0
    if leads:
        bounds = []
        while (p := text.find(mark, at)) >= 0:
            bounds.append(p)
            at = p + len(mark)
        return [(a, text[a:b]) for a, b in zip(bounds, [*bounds[1:], len(text)], strict=False)]
    while at < len(text):
        p = text.find(mark, at)
        p = len(text) if p < 0 else p
        out.append((at, text[at:p]))
        at = p + len(mark)
    return out


@pytest.mark.parametrize("mark, leads", [(b"$$$$\n", False), (b"@<M>", True), (b"aa", False), (b"aa", True)])
@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_any_ranges_give_each_block_once(monkeypatch, mark, leads, chunk):
    monkeypatch.setattr("molmill.streaming.blocks.CHUNK", chunk)
    rng = random.Random(1)
    for _ in range(150):
        text = b"".join(rng.choice([mark, b"x", b"$", b"@<", b"\n", b"molecule"]) for _ in range(rng.randint(0, 25)))
        if mark == b"aa":
            text = text.replace(b"aaa", b"aa")
        if b"aaa" in text:
            continue  # where marks overlap, a range cannot tell which of them a search from the start takes
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))})
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in blocks_of(lambda at, n: text[at : at + n], a, b, mark, leads)]
        assert got == plain(text, mark, leads), (text, cuts)


def written(folder, seed=1, files=4):
    rng = random.Random(seed)
    folder.mkdir(exist_ok=True)
    want = set()
    for k in range(files):
        blocks = [f"mol {seed}-{k}-{i}\n" + "line é\n" * rng.randint(0, 30) for i in range(rng.randint(1, 40))]
        text = "".join(b + "$$$$\n" for b in blocks)
        (folder / f"f{seed}{k}.sdf").write_bytes(text.encode())
        want |= {(f"f{seed}{k}.sdf", at, block.decode()) for at, block in plain(text.encode(), b"$$$$\n", False)}
    return want


def test_stops_in_mid_file_and_goes_on(spark, tmp_path):
    want = written(tmp_path / "in", 1)
    (tmp_path / "in" / "readme.txt").write_text("no blocks here\n")
    at = lambda name: str(tmp_path / name)
    run = lambda most, once: T.ingest_blocks(text_blocks(spark, at("in"), at("bookmark"), max_bytes=most, split_bytes=700), lambda df: df, at("out"), at("state"), once)
    got = lambda: [(r.file, r.start, r.block) for r in spark.read.parquet(at("out")).collect()]
    for n in (1, 2):
        run(1500, True).awaitTermination()
        part = got()
        assert len(part) == len(set(part)) and set(part) < want
        assert len(list((tmp_path / "bookmark").glob("plan-*.json"))) == n
    # More files come, one of them with a name before all others, and one in gzip.
    want |= written(tmp_path / "in", 0, 2)
    blocks = [f"zipped {i}\nx\n" for i in range(50)]
    (tmp_path / "in" / "z.sdf.gz").write_bytes(gzip.compress("".join(b + "$$$$\n" for b in blocks).encode()))
    want |= {("z.sdf.gz", p, b.decode()) for p, b in plain("".join(b + "$$$$\n" for b in blocks).encode(), b"$$$$\n", False)}
    T.drain(run(1_000_000, False))
    assert sorted(got()) == sorted(want)
    T.drain(run(1_000_000, False))
    assert sorted(got()) == sorted(want)
    # A file that grows goes on where it ended.
    with (tmp_path / "in" / "f10.sdf").open("ab") as f:
        f.write(b"late\nx\n$$$$\n")
    run(1_000_000, True).awaitTermination()
    assert len(got()) == len(want) + 1 and len(set(got())) == len(want) + 1


def test_a_step_that_did_not_end_is_run_again_as_it_was(spark, tmp_path):
    want = written(tmp_path / "in", 3)
    at = lambda name: str(tmp_path / name)
    stream = lambda most: text_blocks(spark, at("in"), at("bookmark"), max_bytes=most, split_bytes=500)

    def fail(df, n):
        df.write.mode("overwrite").parquet(at(f"out/batch={n}"))
        if fail.on:
            raise RuntimeError("stopped")

    start = lambda most: stream(most).writeStream.foreachBatch(fail).option("checkpointLocation", at("state")).trigger(availableNow=True).start()
    fail.on = True
    with pytest.raises(Exception, match="stopped"):
        start(900).awaitTermination()
    fail.on = False
    for _ in range(2):
        start(10**9).awaitTermination()
    rows = [(r.file, r.start, r.block) for r in spark.read.parquet(at("out")).collect()]
    assert sorted(rows) == sorted(want)


def test_plans_survive_a_lost_offset(tmp_path):
    """A plan that was written, but never handed to Spark, is the next step of a new reader."""
    written(tmp_path / "in", 2)
    options = {"path": str(tmp_path / "in"), "bookmark": str(tmp_path / "b"), "max_bytes": "800", "split_bytes": "300"}
    first = BlockReader(options)
    assert first.latestOffset() == first.latestOffset() == {"step": 1}
    second = BlockReader(options)
    assert second.latestOffset() == {"step": 1}
    ranges = [r for p in second.partitions({"step": 0}, {"step": 1}) for r in p.ranges]
    assert sum(b - a for _, a, b in ranges) == 800 and BlockReader(options).latestOffset() == {"step": 2}


def test_own_marks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "# head\n" + "".join(f"@<TRIPOS>MOLECULE\nZINC{i}\n1 0\n" for i in range(30))
    (tmp_path / "in" / "a.mol2").write_text(text)
    at = lambda name: str(tmp_path / name)
    T.drain(T.ingest_blocks(text_blocks(spark, at("in"), at("b"), "@<TRIPOS>MOLECULE", True, ".mol2", 200, 64), lambda df: df.selectExpr("split(block, '\\n')[1] AS name"), at("out"), at("state")))
    assert sorted(r.name for r in spark.read.parquet(at("out")).collect()) == sorted(f"ZINC{i}" for i in range(30))
