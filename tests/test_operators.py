import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chains as ch
from corpusloom.operators import duplication as dup
from corpusloom.operators import evaluation as ev
from corpusloom.operators import ordering
from corpusloom.operators import packing as pk
from corpusloom.operators import sampling as sm
from corpusloom.operators import streams as st
from corpusloom.operators import vocabulary as vo


def ids(spark, *docs):
    """docs: lists of (clause, id)."""
    rows = []
    for d, items in enumerate(docs):
        sizes, seen = {}, {}
        for c, _ in items:
            sizes[c] = sizes.get(c, 0) + 1
        for pos, (c, i) in enumerate(items):
            rows.append((d, pos, c, seen.get(c, 0), sizes[c], i))
            seen[c] = seen.get(c, 0) + 1
    return spark.createDataFrame(rows, "doc_id long, pos long, clause long, cpos long, clen long, id long")


def docs(spark, *items):
    return st.packed(ids(spark, *items))


def hist(df):
    return {r.len: r.n for r in df.collect()}


def test_census(spark):
    docs = spark.createDataFrame([(0, "a cat. a cat runs."), (1, "a dog!")], "doc_id long, text string")
    stream = vo.clause_stream(docs)
    counted = vo.census(stream)
    report = vo.census_report(stream, counted, [1, 2], [3]).first()
    assert (report.tokens, report.v1, report.v2, report.top3) == (10, 6, 3, 7)


def test_chains(spark):
    one = [(0, 1), (0, 3), (1, 5), (1, 2), (1, 4)]
    assert hist(ch.chain_histogram(st.chain_rows(docs(spark, one), reset_on_clause=True))) == {2: 2, 1: 1}
    assert hist(ch.chain_histogram(st.chain_rows(docs(spark, one)))) == {3: 1, 2: 1}
    assert hist(ch.chain_histogram(st.chain_rows(docs(spark, [(0, 7), (0, 7), (0, 9)])))) == {1: 1, 2: 1}


@pytest.mark.parametrize(("length", "parts"), [(10, [5, 5]), (15, [8, 7]), (19, [7, 6, 6])])
def test_balanced_cap(spark, length, parts):
    chained = st.chain_rows(docs(spark, [(0, i) for i in range(length)], [(0, i) for i in range(length)]), cap=9)
    sizes = chained.select("doc_id", "chain", F.size("ids").alias("n")).orderBy("doc_id", "chain").collect()
    assert [r.n for r in sizes] == parts * 2


def test_bags_and_probes(spark):
    one = docs(spark, [(0, 1), (0, 3), (1, 5), (1, 2), (1, 4)])
    assert sorted(r.ids_str for r in ch.chain_bags(st.chain_rows(one)).collect()) == ["1 3 5", "2 4"]
    assert sorted(r.ids_str for r in ch.window_bags(one, 4).collect()) == ["1 2 3 5", "4"]
    found = {r.pos: r.is_opener for r in ch.probes(ids(spark, [(0, 1), (0, 3), (0, 2), (1, 4), (1, 5)])).collect()}
    assert found == {1: False, 2: False, 3: True, 4: False}


def test_pairs_and_conflicts(spark):
    found = {(r.u, r.v): r.w for r in ch.pair_counts(ids(spark, [(0, 1), (0, 1), (0, 2), (1, 1)])).collect()}
    assert found == {(1, 2): 1}
    pairs = spark.createDataFrame([(0, 1, 5), (1, 0, 3), (2, 3, 7)], "u long, v long, w long")
    assert {r.u: (r.loss, r.directed) for r in dup.conflict_losses(pairs).collect()} == {0: (3, 8), 1: (3, 8), 2: (0, 7), 3: (0, 7)}
    assert {(r.u, r.v): r.net for r in ch.net_edges(pairs).collect()} == {(0, 1): 2, (2, 3): 7}
    ceiling = ch.ordering_ceiling(pairs).first()
    assert (ceiling.total, ceiling.irreducible, ceiling.active) == (15, 3, 4)
    empty = pairs.limit(0)
    assert tuple(ch.ordering_ceiling(empty).first()) == (0, 0, 0)


def test_duplicates(spark):
    plan = dup.duplicate_plan(spark.createDataFrame([(2, 9)], "u long, loss long"))
    assert tuple(plan.first()) == (2, 2, 3, 9)
    rows = dup.apply_duplicates(ids(spark, [(0, 5), (0, 2), (0, 1), (0, 2)]), plan, 6).orderBy("pos").collect()
    assert [r.new_id for r in rows] == [6, 3, 1, 2]
    parents = spark.createDataFrame([(1, 1), (3, 1)], "id long, extra long")
    assert [r.new_id for r in dup.renumbering(6, parents).orderBy("id").collect()] == [0, 1, 3, 4, 6, 7]


def test_kway(spark):
    h = dup.position_histogram(ids(spark, [(0, 5), (0, 5), (0, 9)]), 4)
    assert {(r.token_id, r.bin): r.n for r in h.collect()} == {(5, 0): 1, (5, 2): 1, (9, 3): 1}
    bins = [(0, b, 10) for b in range(20)] + [(1, 1, 50), (1, 18, 50)] + [(2, 9, 100)]
    chosen = dup.select_k(spark.createDataFrame(bins, "token_id long, bin long, n long"), 20)
    assert {r.token_id: r.k for r in chosen.collect()} == {0: 6, 1: 2, 2: 1}
    plan = spark.createDataFrame([(0, i, i, t) for i, t in enumerate((166667, 500000, 833333))], "old_index long, new_index long, copy long, target_scaled long")
    rows = ids(spark, [(0, 0), (0, 0), (0, 0)]).withColumn("place", F.expr("1000000L * cpos div greatest(clen - 1, 1L)"))
    assert [r.new_id for r in dup.apply_kway(rows, plan, "place", 1).orderBy("pos").collect()] == [0, 1, 2]


def test_vocabulary(spark):
    vocab = spark.createDataFrame([("a", 0, 2), ("b", 1, 100), ("c", 2, 50), ("d", 3, 1)], "token string, idx long, cnt long")
    assert [r.new_id for r in vo.top_k_remap(vocab, 2).orderBy("old_id").collect()] == [2, 0, 1, 2]
    kept = {r.token: r.id for r in vo.lookup(vocab, 25).collect()}
    assert kept == {"b": 0, "c": 1, "<unk>": 2}
    assert vo.contiguous(vocab).first().ok and not vo.contiguous(vocab.where("idx <> 1")).first().ok
    packed = vo.sparse_records(docs(spark, [(0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (2, 0)]))
    assert [r.indices_str for r in packed.where("record_type = 'packed'").collect()] == ["0 1"]


def test_ordering(spark):
    rng = random.Random(2)
    edges = [(i, j, rng.randrange(1, 9)) for i in range(14) for j in range(14) if i != j and rng.random() < 0.4]
    nodes = list(range(14))
    groups = ordering.components(nodes, [(0, 1, 1), (1, 0, 1), (1, 2, 1), (3, 4, 1)])
    assert sorted(map(tuple, groups))[0] == (0, 1) and len(groups) == 13
    assert ordering.condensed_order([2, 1, 0], [(0, 1, 1), (1, 2, 1)]) == [0, 1, 2]
    start = nodes[::-1]
    assert ordering.ascending(ordering.improved(start, edges), edges) >= ordering.ascending(start, edges)
    order, best, before = ordering.optimized(spark.createDataFrame(edges, "u long, v long, w long"), start, restarts=4)
    assert sorted(order) == nodes and best >= before


def test_packing(spark):
    rows = list(pk.BestFit(10, 100, crop=True).rows([("a", 6), ("b", 4), ("c", 7), ("d", 5)]))
    assert rows == [(0, 0, "c", 7, 7), (0, 1, "b", 3, 4), (1, 0, "a", 6, 6), (1, 1, "d", 4, 5)]
    rows = list(pk.BestFit(10, 100, crop=False).rows([("a", 6), ("b", 4), ("c", 12), ("d", 5), ("e", 0)]))
    assert rows == [(0, 0, "a", 6, 6), (0, 1, "b", 4, 4), (1, 0, "d", 5, 5), (2, 0, "c", 10, 12)]
    items = spark.createDataFrame([(k, i, 1 + (i * 7) % 30) for k in ("x", "y") for i in range(50)], "k string, i long, n long")
    out = pk.pack(items, "k", "i", "n", "i", 32, 10, crop=True).collect()
    assert len(out) == 100 and all(r.used <= r.length for r in out)
    used = {}
    for r in out:
        used[r.k, r.row] = used.get((r.k, r.row), 0) + r.used
    assert max(used.values()) == 32


def test_sampling(spark):
    rows = spark.range(10).withColumnRenamed("id", "o")
    assert [r.o for r in sm.sliced(rows, "o", 5).collect()] == [5, 6, 7, 8, 9]
    assert [(r.o, r.idx) for r in sm.sliced(rows, "o", step=3).collect()] == [(0, 0), (3, 1), (6, 2), (9, 3)]
    a, b = (spark.range(n).withColumnRenamed("id", "local_idx") for n in (3, 5))
    mixed = sm.mixture([a, b]).orderBy("ord").collect()
    assert sorted((r.task, r.local_idx) for r in mixed) == [(0, i) for i in range(3)] + [(1, i) for i in range(5)]
    assert [tuple(r) for r in mixed] == [tuple(r) for r in sm.mixture([a, b]).orderBy("ord").collect()]
    split = sm.split_train_val(rows, "o", 20, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 8, "val": 2}
    shots = sm.few_shot(rows, "o", 3, 1).groupBy("o").agg(F.collect_set("example").alias("x")).collect()
    assert all(len(r.x) == 3 and r.o not in r.x for r in shots)
    assert [r.place for r in sm.permutation(spark, 4, 42).orderBy("ordinal").collect()] != []


def test_evaluation(spark):
    rows = spark.createDataFrame([(3, 1, 0, 1.0), (3, 0, 1, 2.0), (5, 1, 0, 1.5)], "length int, a int, b int, ce double")
    deltas = {r.bucket: (r.n, r.d) for r in ev.paired_deltas(rows, "length", {"d": ("a", "b")}).collect()}
    assert deltas["3"] == (2, 0.0) and deltas["5"] == (1, -1.0) and deltas["all"][0] == 3
    wins = ev.win_rates(rows.limit(0), "a", "b").first()
    assert tuple(wins) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    buckets = [r[0] for r in spark.createDataFrame([(1,), (9,), (10,), (15,)], "n int").select(ev.length_bucket(F.col("n"))).collect()]
    assert buckets == ["1", "9", "10+", "10+"]
    runs = spark.createDataFrame([("x", i, v) for i, v in enumerate([5.0, 4.9, 3.0, 3.5, 3.4, 3.3, 1.0])], "k string, i int, v double")
    stopped = ev.early_stopping(runs, "k", "i", "v", 3, 0.5).first()
    assert (stopped.best, stopped.best_step, stopped.stopped_at) == (3.0, 2, 5)
    line = spark.createDataFrame([("g", float(x), 3.0 * x**2) for x in range(1, 9)], "g string, x double, y double")
    fit = ev.power_law(line, ["g"], F.col("x"), F.col("y")).first()
    assert abs(fit.slope - 2) < 1e-9
    bowl = spark.createDataFrame([("g", float(x), (x - 4.0) ** 2 + 1) for x in range(9)] + [("h", float(x), -(x * 1.0) ** 2) for x in range(4)], "g string, x double, y double")
    assert {r.g: round(r.vertex_x, 6) for r in ev.parabola_vertex(bowl, ["g"], "x", "y").collect()} == {"g": 4.0, "h": 3.0}
    middle = spark.createDataFrame([(v,) for v in (4.0, 1.0, 3.0, 2.0)], "v double").agg(ev.upper_median("v")).first()[0]
    assert middle == 3.0


def test_streams(spark):
    """Looked up as arrays or by a join, with and without an unknown token; null and empty texts; repeated keys."""
    rows = spark.createDataFrame([(0, "b a. c a b!"), (1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    table = spark.createDataFrame([("a", 0), ("b", 1), ("<unk>", 2)], "token string, id long")
    a, b = (sorted(map(tuple, st.token_rows(st.id_documents(rows, table, most_bytes=n)).collect())) for n in (1 << 20, 0))
    assert a == b and [r[5] for r in a] == [1, 0, 2, 2, 0, 1, 2, 0, 1, 2]
    assert a[0] == (0, 0, 0, 0, 3, 1, None, 0) and a[2] == (0, 2, 0, 2, 3, 2, 0, 2) and a[-1] == (3, 2, 0, 2, 3, 2, 1, None)
    known = table.where("id < 2")
    a, b = (sorted(map(tuple, st.id_documents(rows, known, unknown=False, most_bytes=n).collect())) for n in (1 << 20, 0))
    assert a == b and [r[1] for r in a] == [[1, 0, None, None, 0, 1, None], [], [], [0, 1, None]]
    twice = st.chain_rows(st.id_documents(rows.union(rows), table))
    assert twice.count() == 2 * st.chain_rows(st.id_documents(rows, table)).count()
    windowed = st.with_neighbours(ids(spark, [(0, 4), (0, 5), (1, 6)])).orderBy("pos").collect()
    assert [(r.before, r.after) for r in windowed] == [(None, 5), (4, 6), (5, None)]
    empty = st.id_documents(rows.limit(0), table)
    assert st.token_rows(empty).count() == st.chain_rows(empty).count() == st.clause_rows(empty).count() == 0


def test_chains_against_a_loop(spark):
    rng = random.Random(3)
    items = [[(rng.randrange(3) + j // 4, rng.randrange(6)) for j in range(rng.randrange(40))] for _ in range(30)]
    items = [sorted(x, key=lambda t: t[0]) for x in items if x]
    for reset in (False, True):
        for cap in (None, 1, 2, 3):
            want = []
            for d, x in enumerate(items):
                chains = []
                for j, (c, i) in enumerate(x):
                    if not j or i <= x[j - 1][1] or (reset and c != x[j - 1][0]):
                        chains.append([])
                    chains[-1].append(i)
                if cap:
                    cut = []
                    for one in chains:
                        n = -(-len(one) // cap)
                        sizes = [len(one) // n + (k < len(one) % n) for k in range(n)]
                        cut += [one[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(n)]
                    chains = cut
                want += [(d, k, one, chains[k + 1][0] if k + 1 < len(chains) else None) for k, one in enumerate(chains)]
            assert sorted(map(tuple, st.chain_rows(docs(spark, *items), reset_on_clause=reset, cap=cap).collect())) == want
    examples = ch.sequence_examples(docs(spark, [(0, i) for i in (1, 3, 2, 4, 0, 5, 5)]), 2).orderBy("chunk").collect()
    assert [(r.inputs, r.targets) for r in examples] == [([[1, 3], [2, 4]], [2, 0]), ([[0, 5]], [5])]
    averages = ch.chain_averages(ch.chain_summary(ch.chain_histogram(st.chain_rows(docs(spark, [(0, 1), (0, 2), (0, 1)]))))).first()
    assert (averages.avg_len, averages.len1_fraction) == (1.5, 0.5)


def test_training_rows(spark):
    """Filled ends and what the mask leaves out are -1; an item that is cut keeps its first ids."""
    items = spark.createDataFrame([("a", [1, 2, 3], [0, 1, 1]), ("b", [4, 5], [0, 1]), ("c", [6, 7, 8, 9, 10, 11, 12], [1] * 7)], "item string, ids array<int>, mask array<int>")
    sizes = items.select(F.lit("k").alias("k"), "item", F.size("ids").alias("n"))
    placed = pk.pack(sizes, "k", "item", "n", "item", 6, 10, crop=False)
    found = pk.training_rows(placed, items, "k", "item", 6, 0).orderBy("row").collect()
    assert [(r.inputs, r.targets) for r in found] == [([1, 2, 3, 4, 5], [2, 3, -1, 5, -1]), ([6, 7, 8, 9, 10], [7, 8, 9, 10, 11])]


def test_files_and_components(spark):
    files = spark.createDataFrame([(f"b{i:02}",) for i in range(10)], "name string")
    names = sorted(f"b{i:02}" for i in range(10))
    for fraction, n in ((0.25, 2), (0.35, 4), (0.01, 1)):  # 2.5 and 3.5 round to even
        assert sorted(r.name for r in sm.sample_files(files, "name", fraction, 3).collect()) == sorted(random.Random(3).sample(names, n))
    assert sm.sample_files(files.limit(0), "name", 0.5, 3).count() == 0
    pairs = spark.createDataFrame([(0, 1, 5), (1, 0, 3), (1, 2, 4), (2, 0, 4), (3, 4, 1), (4, 3, 1), (5, 6, 2)], "u long, v long, w long")
    assert ordering.component_stats(pairs) == {"net_edges": 4, "components": 3, "largest": 3, "largest_share": 0.6, "active": 5}
    assert ordering.component_stats(pairs.limit(0))["largest"] == 0


def test_conversations_that_are_malformed(spark):
    from corpusloom.functions import bpe, chat

    model = bpe.Bpe([])
    kind = "m array<struct<role: string, parts: array<struct<type: string, text: string>>>>"
    turn = lambda role, t="text": (role, [(t, "ab")])
    rows = [([turn("user"), turn("assistant")],), ([turn("assistant")],), ([turn("user", "picture")],), (None,), ([],)]
    found = [r[0] for r in spark.createDataFrame(rows, kind).select(chat.conversation_ids(F.col("m"), model)).collect()]
    assert found[0] is not None and found[1:4] == [None] * 3 and len(found[4].ids) == 1
    done = [r[0] for r in spark.createDataFrame(rows, kind).select(chat.conversation_ids(F.col("m"), model, for_completion=True)).collect()]
    assert done[0] is not None and done[1:] == [None] * 4


def test_remapping_fronts_and_inverses(spark):
    rows = spark.createDataFrame([(0, [[1, 2], [], [3, -1]]), (1, []), (2, None)], "k long, x array<array<long>>")
    table = spark.createDataFrame([(1, 7), (3, 0)], "id long, new_id long")
    assert sorted(map(tuple, st.remapped_lists(rows, "x", table, 9).collect())) == [(0, [[7, 9], [], [0, -1]]), (1, []), (2, [])]
    fronts = st.with_front(docs(spark, [(0, 4), (0, 5)]), lambda ids: [sum(ids), len(ids)]).first()
    assert fronts.front == [9, 2]
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "id long, pos long")
    assert sorted(map(tuple, ch.inverse(order).collect())) == [(0, 1), (1, 2), (2, 0)]
    assert ch.inverse(ch.inverse(order)).exceptAll(order).count() == 0


def test_permutations_and_mixtures(spark):
    import numpy as np

    found = [r.ordinal for r in sm.hub_permutation(spark, 9, 5).orderBy("place").collect()]
    assert found == np.random.default_rng(5).permutation(9).tolist()
    a, b = (spark.range(n).withColumnRenamed("id", "local_idx") for n in (3, 2))
    assert sm.oversampled([(a, 2), (b, 1)]).count() == 8


def test_generations(spark):
    rng = random.Random(5)
    edges = [(i, j, rng.randrange(1, 9)) for i in range(16) for j in range(16) if i != j and rng.random() < 0.4]
    pairs = spark.createDataFrame(edges, "u long, v long, w long")
    one, two = (ordering.optimized(pairs, list(range(16)), restarts=3, generations=n) for n in (1, 2))
    assert two[1] >= one[1] >= one[2] and sorted(two[0]) == list(range(16))
    assert sorted(ordering.shaken(list(range(30)), 0.3, rng)) == list(range(30))


def test_core_files(spark, tmp_path):
    from corpusloom.sources import tables

    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "t1.jsonl").write_text('{"q": "a"}\n\n{"q": "b"}\n')
    (tmp_path / "eval_meta_data.csv").write_text("task,baseline\nt1,25\n")
    items, baselines = tables.core_inputs(spark, str(tmp_path), "q string")
    assert sorted(map(tuple, items.collect())) == [("t1", "a"), ("t1", "b")] and [tuple(r) for r in baselines.collect()] == [("t1", 25)]
    tables.write_results(baselines, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1


def test_shared_folders(spark, tmp_path):
    from corpusloom.sources import shared

    spark.range(3).write.parquet(str(tmp_path / "x"))
    shared.remove(spark, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists() and shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
