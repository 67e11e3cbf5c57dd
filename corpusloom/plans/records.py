"""Queries over phrase records, contexts, layouts, remapping and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import tasks
from corpusloom.operators import chains as ch
from corpusloom.operators import duplication as dup
from corpusloom.operators import records as rec
from corpusloom.operators import streams as st
from corpusloom.operators import vocabulary as vo
from corpusloom.plans import sql
from corpusloom.plans.catalog import query
from corpusloom.plans.corpus import documents, lookup, vocab
from corpusloom.sources.shared import written
from corpusloom.sources.tables import table


@query(
    "phrase_pairs",
    sql.with_(
        sql.IDS + ", g AS MATERIALIZED (SELECT doc_id, clause, list(id ORDER BY pos) AS l FROM x GROUP BY doc_id, clause)",
        "SELECT g.doc_id, g.clause, g.l[len(g.l)] AS single, array_to_string(g.l, ' ') AS packed, n.l[1] AS target FROM g JOIN g n ON n.doc_id = g.doc_id AND n.clause = g.clause + 1",
    ),
)
def phrase_pairs(spark, sf):
    return rec.phrase_pairs(documents(spark, sf)).withColumn("packed", F.array_join(F.col("packed").cast("array<string>"), " "))


@query(
    "example_targets",
    sql.with_(
        sql.IDS + ", g AS MATERIALIZED (SELECT doc_id, clause, list(id ORDER BY pos) AS l FROM x GROUP BY doc_id, clause), p AS (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY clause) AS b FROM g)",
        "SELECT doc_id, clause, array_to_string(b, ' ') AS input, unnest(l) AS target FROM p WHERE b IS NOT NULL",
    ),
)
def example_targets(spark, sf):
    packed = st.clause_rows(documents(spark, sf), before=1).where(F.size("earlier") == 1)
    return packed.select("doc_id", "clause", ch.as_text(F.get("earlier", F.lit(0))["ids"]).alias("input"), F.explode("ids").alias("target"))


@query("flat_layout", sql.with_(sql.IDS, "SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY clause) - 1 AS slot, cpos AS at, id AS value FROM x"))
def flat_layout(spark, sf):
    return rec.flat_layout(st.with_clause_lists(documents(spark, sf)), "doc_id", "lists")


_CONTEXT = (
    sql.chains()
    + """,
pr AS (SELECT *, array_to_string(list(id) OVER (PARTITION BY doc_id, chain ORDER BY pos ROWS UNBOUNDED PRECEDING), ' ') AS prefix FROM ch),
fr AS (SELECT pr.*, cl.ids AS before FROM pr LEFT JOIN cl ON cl.doc_id = pr.doc_id AND cl.chain = pr.chain - 1),
ct AS (SELECT doc_id, pos, id, lag(CASE WHEN before IS NULL THEN prefix ELSE before || '|' || prefix END, 5) OVER w AS front,
       array_to_string(list(id) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '|') AS tail FROM fr WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
)


@query("context_steps", sql.with_(_CONTEXT, "SELECT doc_id, pos, CASE WHEN front IS NULL THEN tail ELSE front || '|' || tail END AS ctx, id AS target FROM ct WHERE pos > 0"))
def context_steps(spark, sf):
    """Four recent tokens and two chains before each place."""
    return rec.context_steps(documents(spark, sf), 4, 2)


@query("hybrid_steps")
def hybrid_steps(spark, sf):
    steps = rec.hybrid_steps(rec.split_points(documents(spark, sf), 7), 9)
    return steps.select("doc_id", F.col("step").cast("long").alias("step"), F.array_join(F.col("input").cast("array<string>"), " ").alias("input_str"), "target")


@query(
    "hybrid_steps_half",
    sql.with_(
        sql.IDS
        + """,
n AS (SELECT doc_id, count(*) // 2 AS sp FROM x GROUP BY doc_id),
f AS (SELECT x.*, CASE WHEN lag(id) OVER w IS NULL OR id <= lag(id) OVER w THEN 1 ELSE 0 END AS nb FROM x JOIN n USING (doc_id) WHERE pos < sp WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
fc AS (SELECT *, sum(nb) OVER (PARTITION BY doc_id ORDER BY pos) AS ch FROM f),
hs AS (SELECT doc_id, min(pos) AS start, array_to_string(list(id ORDER BY pos), ' ') AS input_str, min(id) AS first_id FROM fc GROUP BY doc_id, ch
  UNION ALL SELECT doc_id, pos, CAST(id AS VARCHAR), id FROM x JOIN n USING (doc_id) WHERE pos >= sp)""",
        "SELECT * FROM (SELECT doc_id, row_number() OVER w - 1 AS step, input_str, lead(first_id) OVER w AS target FROM hs WINDOW w AS (PARTITION BY doc_id ORDER BY start)) WHERE target IS NOT NULL",
    ),
)
def hybrid_steps_half(spark, sf):
    """Chains in the first half of a document, single ids in the second."""
    halves = documents(spark, sf).withColumn("split", F.expr("size(ids) div 2"))
    return rec.hybrid_steps(halves).select("doc_id", F.col("step").cast("long").alias("step"), ch.as_text("input").alias("input_str"), "target")


_REMAP = """, r AS (SELECT idx, row_number() OVER (ORDER BY cnt DESC, idx) AS rk FROM v WHERE cnt >= 5),
n AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS id, CASE WHEN rk <= 1000 THEN sum(CASE WHEN rk <= 1000 THEN 1 ELSE 0 END) OVER (ORDER BY idx) - 1 ELSE 1000 END AS new_id FROM r)"""


def _top_remap(spark, sf):
    """id and new_id of the 1000 most frequent tokens of the lookup."""
    kept = lookup(spark, sf).where(F.col("token") != vo.UNKNOWN)
    counted = kept.join(vocab(spark, sf).select("token", "cnt"), "token").select("token", F.col("id").alias("idx"), "cnt")
    return vo.top_k_remap(counted, 1000).withColumnRenamed("old_id", "id")


@query("remapped_bags", sql.with_(sql.IDS + _REMAP, "SELECT doc_id, pos // 16 AS bag, array_to_string(list_sort(list(DISTINCT CAST(coalesce(new_id, 1000) AS BIGINT))), ' ') AS ids_str FROM x LEFT JOIN n USING (id) GROUP BY doc_id, pos // 16"))
def remapped_bags(spark, sf):
    return ch.window_bags(st.remapped(documents(spark, sf), _top_remap(spark, sf), 1000), 16)


@query(
    "remapped_examples",
    sql.with_(
        sql.chains()
        + _REMAP
        + """, m AS (SELECT doc_id, CAST(chain AS BIGINT) AS chain, string_agg(CAST(coalesce(new_id, 1000) AS BIGINT)::VARCHAR, ' ' ORDER BY pos) AS ids, arg_min(CAST(coalesce(new_id, 1000) AS BIGINT), pos) AS first_id FROM ch LEFT JOIN n USING (id) GROUP BY ALL),
        ms AS (SELECT * FROM (SELECT doc_id, chain, ids, lead(first_id) OVER (PARTITION BY doc_id ORDER BY chain) AS target FROM m) WHERE target IS NOT NULL)""",
        "SELECT doc_id, chain // 64 AS chunk, string_agg(ids, '|' ORDER BY chain) AS inputs, string_agg(CAST(target AS VARCHAR), ' ' ORDER BY chain) AS targets FROM ms GROUP BY ALL",
    ),
)
def remapped_examples(spark, sf):
    """Sequence examples under a vocabulary of the 1000 most frequent tokens; all others share the last id."""
    rows = ch.sequence_examples(documents(spark, sf), 64).withColumn("targets", F.array("targets"))
    remap = _top_remap(spark, sf)
    for c in ("inputs", "targets"):
        rows = st.remapped_lists(rows, c, remap, 1000)
    return rows.select("doc_id", "chunk", F.array_join(F.transform("inputs", ch.as_text), "|").alias("inputs"), ch.as_text(F.get("targets", F.lit(0))).alias("targets"))


@query("reordered_vocab", sql.with_(sql.VOCAB, "SELECT token, idx AS old_idx, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS idx, cnt FROM v"))
def reordered_vocab(spark, sf):
    words = vocab(spark, sf)
    order = vo.dense_index(words, [F.desc("cnt"), "token"], "place").select("idx", "place")
    return rec.reordered(words, order)


@query(
    "extended_vocab",
    sql.with_(
        sql.PLAN + ", e AS (SELECT lk.token, lk.id, pl.early_new, lk.id + (SELECT count(*) FROM pl q WHERE q.old_index < lk.id) AS idx FROM lk LEFT JOIN pl ON pl.old_index = lk.id WHERE lk.token <> '<unk>')",
        "SELECT token, idx FROM e UNION ALL SELECT token || '~dup', idx + 1 FROM e WHERE early_new IS NOT NULL",
    ),
)
def extended_vocab(spark, sf):
    all_ids = lookup(spark, sf)
    known = all_ids.where(F.col("token") != vo.UNKNOWN)
    rows = st.token_rows(documents(spark, sf, all_ids))
    plan = dup.duplicate_plan(dup.select_parents(dup.conflict_losses(ch.pair_counts(rows)), 100))
    parents = written(plan.select(F.col("old_index").alias("id"), F.lit(1).alias("extra")))
    base = known.select("id").join(dup.renumbering(all_ids.count(), parents), "id").join(parents, "id", "left").withColumnRenamed("new_id", "new_index")
    copies = F.when(F.col("extra").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = base.select(F.col("id").alias("old_index"), "new_index", F.explode(copies).alias("copy")).withColumn("new_index", F.col("new_index") + F.col("copy"))
    return rec.extended_vocabulary(known.withColumnRenamed("id", "idx"), spread)


@query(
    "top_latents",
    """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM x)
    SELECT vec_id, string_agg(CAST(i + 100 AS VARCHAR), ' ' ORDER BY i) AS ids FROM r WHERE rk <= 8 GROUP BY vec_id""",
)
def top_latents(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(rec.top_latents(F.col("embedding"), 8, 100).cast("array<string>"), " ").alias("ids"))


@query(
    "sampled_tokens",
    """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    r AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM x),
    s AS (SELECT vec_id, i, CAST(v AS DOUBLE) / 0.8 - ln(-ln((CAST(CAST('0x' || left(md5('3:' || vec_id || ':' || i), 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0)) AS s FROM r WHERE rk <= 10)
    SELECT vec_id, arg_min(i, (-s, i)) AS token FROM s GROUP BY vec_id""",
)
def sampled_tokens(spark, sf):
    return rec.sampled(table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), "vec_id", "embedding", 10, 0.8, 3)


@query(
    "chain_summary_by_order",
    sql.with_(
        sql.IDS
        + """, f AS (SELECT id, count(*) AS n FROM x GROUP BY id),
        o AS (SELECT 'position' AS name, id, id AS place FROM f UNION ALL SELECT 'frequency', id, row_number() OVER (ORDER BY n DESC, id) - 1 FROM f),
        y AS (SELECT name, doc_id, pos, place FROM x JOIN o USING (id)),
        z AS (SELECT *, CASE WHEN lag(place) OVER w IS NULL OR place <= lag(place) OVER w THEN 1 ELSE 0 END AS nb FROM y WINDOW w AS (PARTITION BY name, doc_id ORDER BY pos)),
        kk AS (SELECT *, sum(nb) OVER (PARTITION BY name, doc_id ORDER BY pos) AS chain FROM z),
        l AS (SELECT name, count(*) AS len FROM kk GROUP BY name, doc_id, chain)""",
        "SELECT name, count(*) AS chains, CAST(sum(len) AS BIGINT) AS tokens, count(*) FILTER (WHERE len = 1) AS len1, max(len) AS max_len FROM l GROUP BY name",
    ),
)
def chain_summary_by_order(spark, sf):
    docs = documents(spark, sf)
    counted = written(docs.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")))
    frequency = vo.dense_index(counted, [F.desc("n"), "id"], "new_id").select("id", "new_id")
    return rec.summaries_by_order(docs, {"position": None, "frequency": frequency})


@query(
    "task_conversations",
    """SELECT item_id, 'Multiple Choice question: ' || text || chr(10) || '- a=A' || chr(10) || '- b=B' || chr(10) || '- c=C' || chr(10) || '- d=D' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt,
    substr('ABCD', CAST(item_id % 4 AS INT) + 1, 1) AS answer FROM benchmark""",
)
def task_conversations(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", "text", F.array(*map(F.lit, "abcd")).alias("choices"), (F.col("item_id") % 4).cast("int").alias("answer"))
    made = tasks.conversations_of("four_choices", rows, question="text")
    text = lambda i: F.element_at(F.element_at("messages", i)["parts"], 1)["text"]
    return made.select("item_id", text(1).alias("prompt"), text(2).alias("answer"))


@query("worked_answer_judged", "SELECT doc_id, n_chars % 2 = 0 AS ok FROM documents")
def worked_answer_judged(spark, sf):
    answer = lambda n: F.concat(F.lit("so <<1+1=2>>2 #### "), n.cast("string"))
    reference, response = answer(F.col("n_chars")), answer(F.col("n_chars") + F.col("n_chars") % 2)
    return table(spark, sf, "documents").select("doc_id", tasks.same_answer(reference, response).alias("ok"))
