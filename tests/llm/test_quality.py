import zlib

import numpy as np
from helpers import AWKWARD, docs, rows

from molmill.llm.quality import drop_low_quality, dual_coordinate_descent, feature_slots, log_count_ratios, quality_scores

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.held_out == (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1)).all()
    assert len(got) > 100 and (got.predicted == got.quality).mean() > 0.97
    assert got[got.quality == 1].predicted.mean() > 0.99  # clean documents stay
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (4, None, None), (None, 1, 0), (8, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as good")
    given = docs(spark, AWKWARD).selectExpr("*", "1 as score", "true as held_out", "0 as good", "array(1) as slots")
    got = rows(quality_scores(given, labels), "doc_id", "predicted")
    assert len(got) == len(AWKWARD)
    assert drop_low_quality(given, labels).columns == given.columns
    assert quality_scores(given.limit(0), labels).count() == 0
    assert rows(quality_scores(given, labels.limit(0)), "score") == [(0.5,)] * len(AWKWARD)


def test_descent_reaches_the_optimum(spark):
    """The gap between the primal and the dual objective bounds the distance from the least loss there is."""
    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    given = d.join(labels, "doc_id").orderBy("doc_id").select("text", "quality").collect()
    rows = [np.unique(feature_slots(r.text)).astype(np.int32) for r in given]
    good = np.array([r.quality == 1 for r in given])
    ratios = log_count_ratios(rows, good)
    values = [ratios[x] / np.sqrt(len(x) or 1) for x in rows]
    y = np.where(good, 1.0, -1.0)
    gaps = []
    for epochs in (1, 20, 200):
        w, alpha, upper = dual_coordinate_descent(rows, values, good, epochs=epochs)
        margin = y * np.array([w[x] @ v + w[-1] for x, v in zip(rows, values, strict=True)])
        primal = 0.5 * w @ w + upper @ np.maximum(0, 1 - margin)
        gaps.append((primal - (alpha.sum() - 0.5 * w @ w)) / primal)
        assert (alpha >= 0).all() and (alpha <= upper).all()
    assert all(g > -1e-9 for g in gaps) and gaps[1] < 0.05 and gaps[2] < 0.01


def test_repeated_rows_count_once_in_the_fit(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = [(i, ("good calm words " if i % 2 else "BUY NOW!!! $$$ ") * 5 + str(i)) for i in range(40)]
    one, many = (dict(rows(quality_scores(docs(spark, g), labels), "doc_id", "score")) for g in (once, once + once[:7] * 50))
    assert one == many
