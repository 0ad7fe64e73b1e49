"""The mixture's window is cut out of the library by ranges of its numbers."""

import pytest
from molmill.operators.sampling import mixture


@pytest.mark.parametrize("first", [0, 1])
def test_windows_are_ranges_of_the_number(spark, tmp_path, first):
    m = 20
    spark.range(first, first + m).withColumnRenamed("id", "idx").write.parquet(str(tmp_path / "library"))
    library, complexes = spark.read.parquet(str(tmp_path / "library")), spark.createDataFrame([(-1,)], "idx long")
    for epoch in range(7):
        for n in (1, 3, 7, 19, 20, 45):
            got = mixture(complexes, library, 1.0, epoch, n, m).where("origin = 'library'")
            want = [(i, place) for i in range(first, first + m) for place in range((i - epoch * n) % m, n, m)]
            assert sorted((r.idx, r.place) for r in got.collect()) == sorted(want), (epoch, n)
    plan = mixture(complexes, library, 1.0, 2, 3, m)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(idx,6)" in plan and "LessThan(idx,9)" in plan
