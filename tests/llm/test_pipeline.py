from collections import Counter

import corpus_pipeline
from test_decontam import plain as plain_contamination
from test_simhash import plain_classes

from molmill.llm.mix import mix_sizes
from molmill.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    good = stages[0](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted == 1}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = stages[1](spark, good, SF)
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in plain_classes(rows)}
    clean = stages[2](spark, one, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in one.collect()]
    want = {r[0] for r in plain_contamination(left, items) if not r[-1]}
    assert {r.doc_id for r in clean.collect()} == want and len(want) < len(left)
    mixed = stages[3](spark, clean, SF)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mix_sizes(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    dealt = stages[4](spark, mixed, SF).toPandas()
    assert list(dealt.columns) == [*docs.columns, "shard", "slot"] and len(dealt) == mixed.count()
    assert {tuple(x) for x in dealt[["doc_id", "text"]].itertuples(index=False)} == {(r.doc_id, r.text) for r in mixed.collect()}
    counts = dealt.groupby("shard").slot.apply(sorted)
    assert all(v == list(range(len(v))) for v in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_run_and_empty_input(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_awkward_rows_and_clashing_names_go_through_every_stage(spark):
    """Nulls in any column, repeated rows, long texts, and columns named like the stages' helpers."""
    from helpers import AWKWARD, docs

    given = AWKWARD + [(7, "a b c d e f g h")] * 30 + [(100 + i, f"plain text number {i} of a source " * 3, [None, "a", "b"][i % 3]) for i in range(60)] + [(None, "null id " * i) for i in range(40)]
    clash = ["mix plan", "mix copy", "mix row", "shard tie", "shard row", "shard part", "shard place", "listed copy", "copy key", "hit row"]
    d = docs(spark, given).selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(clash)))
    d = d.selectExpr("doc_id", "text", "if(doc_id % 4 = 0, null, lang) as lang", "source", "if(doc_id % 5 = 0, null, n_chars) as n_chars", *(f"`{c}`" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        assert out.count() > 0, name
        if name != "quality classifier":  # its judgement of such rows is not at stake; the others get all of them
            d = out
    dealt = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert dealt.columns == [*d.columns, "shard", "slot"] and dealt.count() == d.count()
