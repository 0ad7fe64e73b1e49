from molmill.llm.queries import op2_preference_pairs


def test_most_pairs_share_turns_and_differ(spark):
    got = op2_preference_pairs(spark, "/root/testdata/sf0.001").collect()
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert len(got) == turns.select("conv_id").distinct().count()
    assert sum(r.n_prefix > 0 for r in got) > 0.9 * len(got) and sum(r.chosen != r.rejected for r in got) > 0.7 * len(got)
    assert all(r.prompt for r in got if r.n_prefix)
