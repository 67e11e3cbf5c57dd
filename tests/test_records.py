import pytest
from pyspark.sql import functions as F
from test_operators import docs

from corpusloom.functions import tasks
from corpusloom.operators import records as rec
from corpusloom.operators import vocabulary as vo


def test_phrase_pairs_and_legacy_records(spark):
    pair = rec.phrase_pairs(docs(spark, [(0, 0), (0, 1), (1, 2)])).first()
    assert (pair.single, pair.packed, pair.target) == (1, [0, 1], 2)
    legacy = spark.createDataFrame([(0, None, [0, 1], None), (1, None, [2], None), (2, None, [3, 3], None), (3, "single", [7], 0)], "phrase_id long, record_type string, indices array<long>, token_pos long")
    found = sorted((r.phrase_id, r.record_type, r.indices) for r in rec.normalized(legacy).collect())
    assert found == [(0, "packed", [0, 1]), (0, "single", [0]), (0, "single", [1]), (1, "single", [2]), (2, "single", [3]), (2, "single", [3]), (3, "single", [7])]


def test_first_record_wins(spark):
    rows = [("single", 0, 1, 0, [3], 1), ("single", 0, 0, 0, [4], 2), ("single", 0, 1, 0, [9], 3), ("packed", 0, 0, 0, [1, 2], 4), ("subject", 0, 0, 0, [8], 0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "story_id long, record_type string, start long, token_pos long, phrase_id long, indices array<long>, line_no long")
    found = vo.canonical_stream(df, ["story_id"]).orderBy("abs_pos").collect()
    assert [(r.abs_pos, r.id) for r in found] == [(0, 4), (1, 3)]


def test_context_steps(spark):
    found = {r.pos: r.ctx for r in rec.context_steps(docs(spark, [(0, i) for i in (1, 3, 2, 4, 0, 5)]), 2, 2).collect()}
    assert found == {1: "1", 2: "1|3", 3: "1|3|2", 4: "1 3|2|4", 5: "1 3|2|4|0"}


def test_hybrid_split(spark):
    one = docs(spark, [(0, i) for i in range(12)])
    found = rec.hybrid_steps(one.withColumn("split", F.lit(10)), 9).orderBy("step").collect()
    assert [(r.input, r.target) for r in found] == [([0, 1, 2, 3, 4], 5), ([5, 6, 7, 8, 9], 10), ([10], 11)]
    points = rec.split_points(docs(spark, [(0, 1), (0, 2), (1, 3)]), 7).first()
    assert points.split in (0, 2, 3)


def test_quotes_in_records(spark):
    rows = [(0, 1, [0], [9]), (0, 2, [1], [4]), (0, 3, [2], [9]), (0, 4, [0, 1, 2], [9, 4, 9]), (1, 1, [5], [9])]
    df = spark.createDataFrame(rows, "story_id long, line_no long, places array<long>, indices array<long>")
    found = {(r.story_id, r.line_no): r.indices for r in rec.with_closing_quotes(df, 9, 10, ["story_id"]).collect()}
    assert found == {(0, 1): [9], (0, 2): [4], (0, 3): [10], (0, 4): [9, 4, 10], (1, 1): [9]}


def test_layouts_and_remapping(spark):
    df = spark.createDataFrame([(0, [[1, 2], [3]]), (1, [[4]])], "k long, lists array<array<long>>")
    assert sorted(map(tuple, rec.nested_layout(rec.flat_layout(df, "k", "lists"), "k").collect())) == [(0, [[1, 2], [3]]), (1, [[4]])]
    m = F.create_map(*[F.lit(x).cast("long") for x in (0, 7, 1, 7, 2, 3)])
    row = spark.createDataFrame([([0, 1, 2],)], "i array<long>").select(vo.remapped(F.col("i"), m, dedup=True), vo.remapped(F.col("i"), m)).first()
    assert tuple(row) == ([3, 7], [3, 7, 7])


def test_extended_vocabulary(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("b~dup", 2)], "token string, idx long")
    copies = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (1, 2, 1), (2, 3, 0)], "old_index long, new_index long, copy int")
    assert {r.idx: r.token for r in rec.extended_vocabulary(vocab, copies).collect()} == {0: "a", 1: "b", 2: "b~dup~", 3: "b~dup"}


def test_tasks(spark):
    row = spark.createDataFrame([("1+1?", "so <<1+1=2>>2 #### 2")], "question string, answer string")
    made = tasks.conversations_of("worked_answers", row).first().messages
    assert [(p.type, p.text) for p in made[1].parts] == [("text", "so "), ("python", "1+1"), ("python_output", "2"), ("text", "2 #### 2")]
    with pytest.raises(ValueError):
        tasks.conversations_of("none", row)
    judged = spark.createDataFrame([("#### 1,0", "x #### 10"), ("a", "b"), ("#### 1", "b")], "a string, b string").select(tasks.same_answer(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in judged] == [True, True, False]
    code = spark.createDataFrame([("import math\ndef f(x):", "```python\ndef f(x):\n    return math.sqrt(x)\n```", "def check(g):\n    assert g(4) == 2", "f"), ("def f(x):", "def f(x): return 1", "def check(g):\n    assert g(4) == 2", "f")], "p string, r string, t string, e string")
    ran = code.select(tasks.executed(tasks.runnable(F.col("p"), F.col("r"), F.col("t"), F.col("e")))).collect()
    assert [r[0] for r in ran] == [True, False]
    assert [r[0] for r in spark.createDataFrame([("while True: pass",)], "c string").select(tasks.executed(F.col("c"), seconds=1.0)).collect()] == [False]


def test_spans(spark):
    from corpusloom.functions import text as tx

    row = spark.createDataFrame([([[1, 2, 3], [1, 2, 4, 5]],)], "o array<array<int>>")
    found = row.select(tx.option_spans(F.col("o")).alias("a"), tx.context_spans(F.col("o")).alias("b")).first()
    assert [tuple(x) for x in found.a] == [(2, 3), (2, 4)] and [tuple(x) for x in found.b] == [(3, 3), (4, 4)]
    crop = spark.createDataFrame([([1, 2, 3, 4, 5], 3, 5)], "i array<int>, a int, b int").select(tx.cropped(F.col("i"), F.col("a"), F.col("b"), 3)).first()[0]
    assert (crop.ids, crop["first"], crop["last"]) == ([3, 4, 5], 1, 3)


def test_modes_and_checks(spark):
    one = docs(spark, [(0, 1), (0, 3), (1, 2), (1, 4)])
    assert rec.steps(one, "token").count() == 3 and rec.steps(one, "cross_phrase").count() == 1
    with pytest.raises(ValueError):
        rec.steps(one, "none")
    assert rec.sweep(one, [1, 2], [1]).count() == 6
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, idx long")
    plan = spark.createDataFrame([(0, "a"), (1, "x")], "old_index long, token string")
    assert [r.token for r in rec.mismatched(plan, vocab).collect()] == ["x"]


def test_fits_and_sampling(spark):
    from corpusloom.operators import evaluation as ev
    from corpusloom.operators import sampling as sm

    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i - 3.0 * (i % 3) + 1) for i in range(20)], "a double, b double, y double")
    fit = ev.ridge(rows, ["a", "b"], "y")
    assert [round(fit[k], 6) for k in ("a", "b", "intercept", "r2")] == [2, -3, 1, 1]
    assert abs(ev.ridge(rows, ["a", "b"], "y", 100.0)["a"]) < 2
    import random

    shots = sm.mersenne_shots(spark.range(5).withColumnRenamed("id", "i"), "i", 5, 2).orderBy("i").collect()
    assert [r.shots for r in shots] == [random.Random(1234 + i).sample([j for j in range(5) if j != i], 2) for i in range(5)]
    assert ev.gate(spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.9)], "k string, f double"), "f", "k", 0.8) == {"best": {"k": "b", "f": 0.9}, "passed": True}


def test_archives_and_logs(spark, tmp_path):
    import zipfile

    from corpusloom.sources import tables

    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("train.csv", 'text\n"one, and\ntwo"\n""\nthree\n')
    found = tables.archive_stories(spark, str(tmp_path / "s.zip")).orderBy("story_id").collect()
    assert [(r.story_id, r.text) for r in found] == [(0, "one, and\ntwo"), (2, "three")]
    assert tables.archive_stories(spark, str(tmp_path / "s.zip"), limit=2).count() == 1
    log = spark.createDataFrame([(0, "loss: 3.5"), (1, "other"), (2, "loss: 2.5 x"), (3, "end")], "n long, line string")
    assert tuple(tables.last_matches(log, "line", "n", {"loss": r"loss: ([0-9.]+)", "none": r"zz(z)"}).first()) == ("2.5", None)
