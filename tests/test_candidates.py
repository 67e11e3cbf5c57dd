from corpusloom.operators import duplication as dup


def test_candidates_by_loss_with_fixed_copies(spark):
    """By loss, whatever their share and frequency; none without loss."""
    losses = spark.createDataFrame([(0, 5, 10_000), (1, 0, 50), (2, 9, 10), (3, 5, 10)], "u long, loss long, directed long")
    assert [r.token_id for r in dup.select_candidates(losses, 2).collect()] == [2, 0]
    chosen = dup.fixed_k(dup.select_candidates(losses, 10), 3)
    assert sorted(tuple(r) for r in chosen.collect())[:3] == [(0, 3, 0, 166667), (0, 3, 1, 500000), (0, 3, 2, 833333)]
    plan = sorted((r.old_index, r.new_index) for r in dup.kway_plan(chosen).collect())
    assert plan == [(0, 0), (0, 1), (0, 2), (2, 4), (2, 5), (2, 6), (3, 7), (3, 8), (3, 9)]
