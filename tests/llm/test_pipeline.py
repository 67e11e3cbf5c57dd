import corpus_pipeline
import numpy as np
from helpers import documents, sentence
from test_packing import ids_of

from corpusloom.llm.common import new_path


def test_planted_cases(spark):
    """Small tables: what must go goes, the rest comes through whole."""
    base = [(i, "\n".join(sentence(i * 10 + k, 30) for k in range(4))) for i in range(120)]
    toxic = [(i, t + " zorgish zorgan") if i % 6 == 0 else (i, t) for i, t in base]
    passage = "\n".join(sentence(9000 + k, 20) for k in range(4))
    item = sentence(7777, 25)
    extra = [(500, "own words here\n" + passage), (501, "and others there\n" + passage), (502, toxic[1][1]), (503, "before " + item + " after"), (504, None), (505, "")]
    root = new_path(spark, "tables")
    documents(spark, toxic + extra).drop("d").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, root).collect()
    kept = {r.doc_id for r in rows}
    assert kept == {i for i in range(120) if i % 6} | {500, 501, 504}
    texts = {**dict(toxic), **dict(extra), 501: "and others there"}
    for i in kept:
        pieces = [r for r in rows if r.doc_id == i]
        wanted = ids_of(texts[i])
        assert sum(r.length for r in pieces) == len(wanted) == pieces[0].doc_tokens
    assert len(np.unique([r.sequence_id for r in rows])) >= 1


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_awkward_rows_and_clashing_names(spark):
    texts = [(1, None), (2, ""), (3, sentence(1, 80)), (3, sentence(1, 80)), (3, sentence(2, 70)), (None, sentence(3, 60)), (None, None), (4, sentence(3, 60)), (5, sentence(9, 9000))]
    docs = documents(spark, texts)
    for c in ("fp", "component", "component_id", "runs", "th", "keep_id", "keep_fp", "own_fp", "turn", "contamination", "deleted_lines", "without", "K", "y"):
        docs = docs.withColumn(c, docs.doc_id)
    root = new_path(spark, "tables")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns
        kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    every = sorted(texts, key=repr)
    assert kept["toxicity"] == kept["benchmark_decontamination"] == every
    assert (4, sentence(3, 60)) not in kept["line_dedup"] and (None, sentence(3, 60)) in kept["line_dedup"]
    assert len(kept["line_dedup"]) == len(texts) - 1
    assert kept["simhash_near_dedup"] == sorted([(1, None), (3, sentence(1, 80)), (3, sentence(2, 70)), (4, sentence(3, 60)), (5, sentence(9, 9000))], key=repr)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    assert sum(r.length for r in pieces) == sum(len(ids_of(t)) for _, t in texts)
