"""Registered queries work on all of their input, not on a leading part of it."""

from corpusloom.operators import ordering
from corpusloom.operators import vocabulary as vo
from corpusloom.plans import corpus
from corpusloom.plans.catalog import QUERIES


def test_vocabulary_learns_from_late_documents(spark, tmp_path):
    """Beyond two million characters and a thousand tokens."""
    early = [(i, " word" * 2000) for i in range(220)]
    late = [(1000 + i, f" zebracrossing{'abcdefghij'[i % 10]}" * 50) for i in range(20)]
    root = str(tmp_path)
    spark.createDataFrame(early + late, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    tokens = {r.token for r in QUERIES["bpe_vocabulary"](spark, root).collect()}
    assert " word" in tokens and " zebracrossinga" in tokens


def test_vocabulary_size(spark, sf_dir):
    assert QUERIES["bpe_vocabulary"](spark, sf_dir).count() > 1024


def test_order_has_the_whole_lookup(spark, sf_dir):
    rows = sorted(QUERIES["order_optimizer"](spark, sf_dir).collect(), key=lambda r: r.new_pos)
    start = sorted(r.id for r in vo.lookup(corpus.vocab(spark, sf_dir), corpus.MIN).collect())
    assert [r.new_pos for r in rows] == start and sorted(r.token_id for r in rows) == start and len(start) > 300
    edges = [tuple(r) for r in corpus.pairs(spark, sf_dir).select("u", "v", "w").collect()]
    assert ordering.ascending([r.token_id for r in rows], edges) >= ordering.ascending(start, edges)
