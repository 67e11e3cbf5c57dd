"""Id streams are made in slices that don't depend on batches or on a document's length."""

import duckdb
import pyarrow as pa

from corpusloom.operators import chains as ch
from corpusloom.operators import duplication as dup
from corpusloom.operators import records as rec
from corpusloom.operators import streams as st
from corpusloom.operators import vocabulary as vo
from corpusloom.plans import sql
from corpusloom.plans.catalog import ORACLES, QUERIES


def long_documents(spark, n):
    rows = [(d, list(range(i, i + 7)), [i // 7] * 7) for d, i in ((0, 0), (1, 5))]
    rows.append((2, [(i * 7919) % 101 for i in range(n)], [i // 9 for i in range(n)]))
    return spark.createDataFrame(rows, "doc_id long, ids array<long>, clauses array<long>")


def test_batches_are_cut(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"ids": [[1] * 5, None, [], [1] * 30, [1, 2], [3]]})
    assert [b.num_rows for b in st._slices(batch, "ids", 10)] == [3, 1, 2]
    assert [b.num_rows for b in st._slices(batch, "ids", 1)] == [1] * 6


def test_no_row_carries_its_document(spark):
    """Rows of chains, clauses, windows, steps and contexts come without an explode over a column of whole documents."""
    documents = long_documents(spark, 50)
    made = [st.chain_rows(documents), st.clause_rows(documents, before=1), ch.window_bags(documents, 4), ch.sequence_examples(documents, 4), rec.context_steps(documents, 4, 2), vo.sparse_records(documents)]
    assert not any("Generate" in df._jdf.queryExecution().executedPlan().toString() for df in made)


def test_long_documents(spark, monkeypatch):
    """In one slice, and in slices of a row and blocks of a few places."""
    documents = long_documents(spark, 3000).withColumn("split", st.F.expr("size(ids) div 2"))
    makers = {
        "tokens": st.token_rows, "chains": st.chain_rows, "clauses": lambda d: st.clause_rows(d, before=2), "windows": lambda d: ch.window_bags(d, 16),
        "examples": lambda d: ch.sequence_examples(d, 8), "contexts": lambda d: rec.context_steps(d, 4, 2), "hybrid": lambda d: rec.hybrid_steps(d, 3), "records": vo.sparse_records, "canonical": st.canonical_rows,
    }
    whole = {n: sorted(map(repr, f(documents).collect())) for n, f in makers.items()}
    monkeypatch.setattr(st, "SLICE", 10)
    assert whole == {n: sorted(map(repr, f(documents).collect())) for n, f in makers.items()}
    ctx = {r.pos: r.ctx for r in rec.context_steps(documents.where("doc_id = 0"), 2, 2).collect()}
    assert ctx == {1: "0", 2: "0|1", 3: "0|1|2", 4: "0 1|2|3", 5: "0 1 2|3|4", 6: "0 1 2 3|4|5"}


def test_letters_of_later_unicode(spark, tmp_path):
    """Letters that Java 17 doesn't know make words, as they do in SQL."""
    rows = [(i, "aࡰb ṍ0 x_y can't “no” Éé _") for i in range(6)] + [(9, None), (10, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("vocab_index", "vocab_lookup_unk"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES[name]).fetchall())
    assert sql.MIN_COUNT == 5


def test_words_with_one_hash_are_parted():
    table = st.word_table(pa.array(["b", "a", "b", "cc"]), st.np.array([1, 0, 7, 2]))
    assert st.find_words(table, pa.array(["cc", "x", "a", "b", ""])).tolist() == [2, -1, 0, 1, -1]
    assert st.find_words(st.word_table(pa.array([], pa.string()), st.np.array([], int)), pa.array(["a"])).tolist() == [-1]


def test_plans_without_a_join(spark):
    """Rows get new ids by flat arrays of the plan: no join, whatever the vocabulary."""
    rows = spark.createDataFrame([(0, 0, 5, None), (0, 1, 2, 5), (0, 2, None, 2), (0, 3, 9, 2)], "doc_id long, pos long, id long, before long").withColumn("after", st.F.lit(None).cast("long"))
    plan = spark.createDataFrame([(2, 2, 3, 9)], "old_index long, early_new long, late_new long, loss long")
    made = dup.apply_duplicates(rows, plan, 6)
    assert sorted(map(tuple, made.collect())) == [(0, 0, 6), (0, 1, 3)]
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
