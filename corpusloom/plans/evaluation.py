"""Queries over documents, pages, conversations, benchmark, labels, embeddings, events and orders:
splits, tokenizers, packing, conversations, tasks and evaluation aggregates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpusloom.functions import bpe, chat, code
from corpusloom.functions import text as tx
from corpusloom.functions.calculator import calculated
from corpusloom.operators import chains as ch
from corpusloom.operators import evaluation as ev
from corpusloom.operators import packing as pk
from corpusloom.operators import sampling as sm
from corpusloom.operators import vocabulary as vo
from corpusloom.plans.catalog import query
from corpusloom.sources.tables import spread, strided, table

# ---------------------------------------------------------------- splits, samples, tasks


@query(
    "train_val_split",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN rk < greatest(1, n * 10 // 100) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def train_val_split(spark, sf):
    return sm.split_train_val(table(spark, sf, "documents").select("doc_id"), "doc_id", 10, 42)


@query("every_nth", "SELECT doc_id, lang FROM documents WHERE doc_id % 7 = 0")
def every_nth(spark, sf):
    return sm.every_nth(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 7)


@query("strided_reader", "SELECT doc_id FROM documents WHERE doc_id >= 3 AND (doc_id - 3) % 8 = 0")
def strided_reader(spark, sf):
    return strided(table(spark, sf, "documents").select("doc_id"), "doc_id", 3, 8)


@query("task_slice", "SELECT item_id, (item_id - 5) // 3 AS idx FROM benchmark WHERE item_id >= 5 AND item_id < 35 AND (item_id - 5) % 3 = 0")
def task_slice(spark, sf):
    return sm.sliced(table(spark, sf, "benchmark").select("item_id"), "item_id", 5, 35, 3)


_TASKS = """
a AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS local_idx FROM benchmark),
b AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS local_idx FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _tasks(spark, sf):
    items = sm.hash_rank(table(spark, sf, "benchmark").select("item_id"), "item_id", 1, "local_idx")
    convs = sm.hash_rank(table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id", 1, "local_idx")
    return items, convs


@query("task_sequence", f"WITH {_TASKS} SELECT 0 AS task, local_idx, local_idx AS ord FROM a UNION ALL SELECT 1, local_idx, local_idx + (SELECT count(*) FROM a) FROM b")
def task_sequence(spark, sf):
    return sm.sequence(list(_tasks(spark, sf)))


@query(
    "task_mixture",
    f"""WITH {_TASKS}, m AS (SELECT 0 AS task, local_idx FROM a UNION ALL SELECT 1, local_idx FROM b UNION ALL SELECT 2, local_idx FROM a)
    SELECT task, local_idx, row_number() OVER (ORDER BY md5('42:' || task || '/' || local_idx), task || '/' || local_idx) - 1 AS ord FROM m""",
)
def task_mixture(spark, sf):
    """The first task twice: oversampling."""
    items, convs = _tasks(spark, sf)
    return sm.mixture([items, convs, items])


@query(
    "fewshot_examples",
    """WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws(':', '1234', CAST(item_id AS VARCHAR))), item_id) - 1 AS rk, count(*) OVER () AS n FROM benchmark),
    a AS (SELECT item_id, rk, n, unnest(range(1, 4)) AS shot FROM r)
    SELECT a.item_id, a.shot, r.item_id AS example FROM a JOIN r ON r.rk = (a.rk + a.shot) % a.n""",
)
def fewshot_examples(spark, sf):
    return sm.few_shot(table(spark, sf, "benchmark"), "item_id", 3, 1234)


@query(
    "fewshot_prompt",
    """WITH r AS (SELECT item_id, text, row_number() OVER (ORDER BY md5(concat_ws(':', '1234', CAST(item_id AS VARCHAR))), item_id) - 1 AS rk, count(*) OVER () AS n FROM benchmark),
    a AS (SELECT item_id, text, rk, n, unnest(range(1, 4)) AS shot FROM r),
    e AS (SELECT a.item_id, string_agg(r.text, chr(10) || chr(10) ORDER BY a.shot) AS ex FROM a JOIN r ON r.rk = (a.rk + a.shot) % a.n GROUP BY a.item_id)
    SELECT item_id, ex || chr(10) || chr(10) || trim(text) AS prompt FROM e JOIN benchmark USING (item_id)""",
)
def fewshot_prompt(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", "text")
    shots = sm.few_shot(items, "item_id", 3, 1234).join(items.select(F.col("item_id").alias("example"), F.col("text").alias("shown")), "example")
    examples = shots.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shot", "shown"))), lambda x: x["shown"]).alias("ex"))
    return examples.join(items, "item_id").select("item_id", tx.few_shot(F.col("ex"), F.trim("text")).alias("prompt"))


@query(
    "render_mc",
    """SELECT item_id, 'Multiple Choice question: ' || text || chr(10) || '- ' || left(text, 10) || '=A' || chr(10) || '- ' || right(text, 10) || '=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM benchmark""",
)
def render_mc(spark, sf):
    choices = F.array(F.left("text", F.lit(10)), F.right("text", F.lit(10)))
    return table(spark, sf, "benchmark").select("item_id", tx.multiple_choice(F.col("text"), F.array(F.lit("A"), F.lit("B")), choices).alias("prompt"))


@query("answer_extract", r"SELECT doc_id, replace(regexp_extract('Total #### ' || n_chars || ',5 end', '#### (\-?[0-9\.\,]+)', 1), ',', '') AS answer FROM documents")
def answer_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.answer(F.concat(F.lit("Total #### "), F.col("n_chars"), F.lit(",5 end"))).alias("answer"))


@query("calculator", "SELECT doc_id, CAST(n_chars * 3 + 1 AS VARCHAR) AS value FROM documents")
def calculator(spark, sf):
    parts = tx.calculation_parts(F.concat(F.lit("so <<"), F.col("n_chars"), F.lit("*3+1=?>> it is")))
    expression = F.element_at(F.filter(parts, lambda p: p["kind"] == "python"), 1)["value"]
    return table(spark, sf, "documents").select("doc_id", calculated(expression).alias("value"))


# ---------------------------------------------------------------- code, tokenizers, packing

_LINES = r"string_split_regex(x, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]')"


@query(
    "minified_filter",
    f"""WITH a AS (SELECT 'page' AS kind, page_id AS id, coalesce(html, '') AS x FROM pages UNION ALL SELECT 'doc', doc_id, coalesce(text, '') FROM documents),
    l AS (SELECT kind, id, {_LINES} AS l FROM a),
    n AS (SELECT kind, id, l, list_filter(l, lambda y: regexp_matches(y, '\\S')) AS f FROM l)
    SELECT kind, id, CAST(list_max(list_transform(l, lambda y: length(y))) AS BIGINT) AS max_len,
    len(f) > 0 AND (list_max(list_transform(f, lambda y: length(y))) > 1000 OR list_sum(list_transform(f, lambda y: length(y))) > 100 * len(f)) AS is_minified FROM n""",
)
def minified_filter(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    return pages.unionByName(docs).select("kind", "id", tx.longest_line(F.col("x")).alias("max_len"), tx.is_minified(F.col("x")).alias("is_minified"))


def page_scripts(spark, sf):
    """page_id, script (its number in the page) and code of the pages' script elements."""
    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script"), F.lit(1))
    return pages.select("page_id", F.posexplode(scripts).alias("script", "code"))


@query("code_tokens")
def code_tokens(spark, sf):
    """Clause tokens of the scripts in pages."""
    rows = page_scripts(spark, sf).select("page_id", "script", F.posexplode(code.code_tokens(F.col("code"))).alias("pos", "t"))
    return rows.select("page_id", F.col("script").cast("long").alias("script"), F.col("pos").cast("long").alias("pos"), "t.clause", "t.tok")


@query("code_census")
def code_census(spark, sf):
    """The census of code tokens, names cut into words; scripts that look minified are left out."""
    rows = page_scripts(spark, sf).where(~tx.is_minified(F.col("code")))
    return vo.census(rows.select(F.explode(code.code_tokens(F.col("code"), split_names=True)).alias("t")).select("t.*"))


@query(
    "doc_cap_prefix",
    """WITH k AS (SELECT doc_id, least(length(coalesce(text, '')), 1000) AS n FROM documents),
    r AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k)
    SELECT doc_id, CAST(n AS BIGINT) AS kept_chars FROM r WHERE run <= 500000""",
)
def doc_cap_prefix(spark, sf):
    kept = bpe.training_texts(table(spark, sf, "documents"), "doc_id", "text", 1000, 500_000)
    return kept.select("doc_id", F.length("kept").cast("long").alias("kept_chars"))


@query("bpe_pieces")
def bpe_pieces(spark, sf):
    return bpe.piece_counts(spread(table(spark, sf, "documents").select("text")))


#: Characters of a document and of all that the vocabulary is learned from, and its size: the reference's defaults.
DOC_CAP, MAX_CHARS, VOCAB_SIZE = 10_000, 2_000_000_000, 32_768


def _bpe(spark, sf):
    return bpe.train(spread(bpe.training_texts(table(spark, sf, "documents"), "doc_id", "text", DOC_CAP, MAX_CHARS)), VOCAB_SIZE, "kept")


@query("bpe_encode_len")
def bpe_encode_len(spark, sf):
    encoded = bpe.encoded(bpe.pieces(F.col("text")), _bpe(spark, sf))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.size(encoded).cast("long").alias("n_tokens"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("bpe_vocabulary")
def bpe_vocabulary(spark, sf):
    return bpe.vocabulary_table(spark, _bpe(spark, sf))


@query("bpe_round_trip", "SELECT count(*) AS n, count(*) AS same FROM documents WHERE text IS NOT NULL")
def bpe_round_trip(spark, sf):
    model = _bpe(spark, sf)
    rows = spread(table(spark, sf, "documents").select("text").where("text is not null")).select("text", bpe.decoded(bpe.encoded(bpe.pieces(F.col("text")), model), model).alias("back"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("back")).alias("same"))


@query("compression_ratio")
def compression_ratio(spark, sf):
    rows = spread(table(spark, sf, "documents").select("lang", "text")).select("lang", "text", F.size(bpe.encoded(bpe.pieces(F.col("text")), _bpe(spark, sf))).alias("n"))
    return bpe.compression(rows, ["lang"], "text", "n").withColumn("ratio", F.round("ratio", 6))


@query("pack_bestfit_crop")
def pack_bestfit_crop(spark, sf):
    """Documents in blocks of 1024 ids, so tasks grow with the corpus."""
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 1024).alias("block"), "doc_id", F.length("text").alias("n"))
    return pk.pack(docs, "block", "doc_id", "n", "doc_id", 2049, 1000, crop=True)


def _packed_conversations(spark, sf):
    convs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return pk.pack(convs.withColumn("block", F.floor(F.col("conv_id") / 256)), "block", "conv_id", "n", "conv_id", 2049, 100, crop=False)


@query("pack_bestfit_pad")
def pack_bestfit_pad(spark, sf):
    return _packed_conversations(spark, sf)


@query("training_rows")
def training_rows(spark, sf):
    """Packed conversations as inputs and targets: ids are characters, and the assistant's are learned."""
    turn = F.struct("turn", F.transform(F.split(F.coalesce("text", F.lit("")), ""), lambda c: F.ascii(c)).alias("i"), (F.col("role") == "assistant").cast("int").alias("k"))
    convs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    ids = F.flatten(F.transform("t", lambda x: F.filter(x["i"], lambda c: c > 0)))
    mask = F.flatten(F.transform("t", lambda x: F.transform(F.filter(x["i"], lambda c: c > 0), lambda _: x["k"])))
    rows = pk.training_rows(_packed_conversations(spark, sf), convs.select("conv_id", ids.alias("ids"), mask.alias("mask")), "block", "conv_id", 2049, 0)
    return rows.select("block", "row", F.size("inputs").alias("n_inputs"), F.size(F.filter("targets", lambda x: x >= 0)).alias("n_learned"))


@query(
    "schema_prompts",
    """SELECT item_id, 'so' || ': ' || 'it' || chr(10) || chr(10) || left(text, 12) || ': ' || right(text, 9) AS first, 'so' || ': ' || 'it' || chr(10) || chr(10) || left(text, 20) || ': ' || right(text, 9) AS second FROM benchmark""",
)
def schema_prompts(spark, sf):
    """Two contexts of an item with one continuation, after an example."""
    example = F.array(F.struct(F.array(F.lit("no"), F.lit("so")).alias("contexts"), F.lit(1).alias("gold"), F.lit("it").alias("continuation")))
    contexts = F.array(F.left("text", F.lit(12)), F.left("text", F.lit(20)))
    made = table(spark, sf, "benchmark").select("item_id", tx.schema_prompts(contexts, F.right("text", F.lit(9)), F.lit(": "), example).alias("p"))
    return made.select("item_id", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


# ---------------------------------------------------------------- conversations

_MERGED = """
m0 AS (SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT conv_id, turn, role, CASE WHEN rn = 2 AND pr = 'system' THEN pt || chr(10) || chr(10) || text ELSE text END AS text FROM m0 WHERE NOT (rn = 1 AND role = 'system')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM m)"""


@query("render_conversation", f"WITH {_MERGED} SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS supervised_chars FROM n")
def render_conversation(spark, sf):
    rows = chat.merged_turns(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("long").alias("supervised_chars"))


@query("rendered_text", f"WITH {_MERGED} SELECT conv_id, '<|bos|>' || string_agg('<|' || role || '_start|>' || text || '<|' || role || '_end|>', '' ORDER BY turn) AS rendered FROM n GROUP BY conv_id")
def rendered_text(spark, sf):
    return chat.conversations(table(spark, sf, "conversations")).select("conv_id", chat.rendered(F.col("messages")).alias("rendered"))


@query(
    "render_completion",
    f"""WITH {_MERGED}, l AS (SELECT conv_id, arg_max(role, turn) AS lr FROM n GROUP BY conv_id)
    SELECT conv_id, '<|bos|>' || string_agg('<|' || role || '_start|>' || text || '<|' || role || '_end|>', '' ORDER BY turn) || '<|assistant_start|>' AS prompt
    FROM n JOIN l USING (conv_id) WHERE lr = 'assistant' AND i < n.n - 1 GROUP BY conv_id""",
)
def render_completion(spark, sf):
    rows = chat.conversations(table(spark, sf, "conversations")).select("conv_id", chat.completion_prompt(F.col("messages")).alias("prompt"), F.size("messages").alias("n"))
    return rows.where("prompt is not null and n > 1").drop("n")


@query(
    "conversation_validation",
    f"WITH {_MERGED} SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok FROM n GROUP BY conv_id",
)
def conversation_validation(spark, sf):
    return chat.conversations(table(spark, sf, "conversations")).select("conv_id", chat.is_valid(F.col("messages")).alias("ok"))


@query("loss_mask")
def loss_mask(spark, sf):
    """Ids and learned ids of each valid conversation under the vocabulary learned from the documents."""
    convs = chat.conversations(table(spark, sf, "conversations")).where(chat.is_valid(F.col("messages")))
    parts = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("parts")))
    rows = convs.select("conv_id", chat.conversation_ids(parts, _bpe(spark, sf)).alias("r"))
    return rows.select("conv_id", F.size("r.ids").cast("long").alias("n_ids"), F.aggregate("r.mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_learned"))


# ---------------------------------------------------------------- evaluation


@query(
    "centered_accuracy",
    """SELECT lang AS task, count(*) AS n, round(avg(quality), 9) AS acc, round((avg(quality) - 0.25) / 0.75, 9) AS centered FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
)
def centered_accuracy(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("task")), "doc_id")
    baselines = rows.select("task").distinct().withColumn("baseline", F.lit(0.25))
    return ev.accuracy_by_task(rows, "task", "quality", baselines).select("task", "n", F.round("acc", 9).alias("acc"), F.round("centered", 9).alias("centered"))


@query(
    "win_rates",
    """SELECT count(*) AS n, round(avg(quality), 9) AS acc_a, round(avg(toxic), 9) AS acc_b, round(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 9) AS same,
    round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END), 9) AS a_wins, round(avg(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END), 9) AS b_wins FROM labels""",
)
def win_rates(spark, sf):
    rows = ev.win_rates(table(spark, sf, "labels"), "quality", "toxic")
    return rows.select("n", *[F.round(c, 9).alias(c) for c in ("acc_a", "acc_b", "same", "a_wins", "b_wins")])


@query(
    "paired_deltas",
    """WITH r AS (SELECT CASE WHEN n_chars // 500 < 10 THEN CAST(n_chars // 500 AS VARCHAR) ELSE '10+' END AS bucket, quality, toxic FROM labels JOIN documents USING (doc_id))
    SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, round(avg(toxic - quality), 9) AS delta FROM r GROUP BY GROUPING SETS ((bucket), ())""",
)
def paired_deltas(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", ev.length_bucket(F.floor(F.col("n_chars") / 500)).alias("len"))
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    return ev.paired_deltas(rows, "len", {"delta": ("quality", "toxic")}).withColumn("delta", F.round("delta", 9))


def _scores(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("label") % 64).alias("target"), F.transform("embedding", lambda x: x.cast("double")).alias("s"))


@query(
    "topk_hits_ce",
    """WITH e AS (SELECT vec_id, label % 64 AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings),
    x AS (SELECT vec_id, t, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS i, s[t + 1] AS own FROM e),
    p AS (SELECT vec_id, sum(CASE WHEN v > own OR (v = own AND i < t) THEN 1 ELSE 0 END) AS above, ln(sum(exp(v))) - any_value(own) AS ce FROM x GROUP BY vec_id),
    g AS (SELECT unnest(['all', CASE WHEN vec_id % 2 = 0 THEN 'opener' ELSE 'interior' END]) AS grp, above, ce FROM p)
    SELECT grp, count(*) AS n, round(avg(CASE WHEN above < 1 THEN 1 ELSE 0 END), 9) AS top1, round(avg(CASE WHEN above < 5 THEN 1 ELSE 0 END), 9) AS top5, round(avg(CASE WHEN above < 10 THEN 1 ELSE 0 END), 9) AS top10, round(exp(avg(ce)), 6) AS ppl FROM g GROUP BY grp""",
)
def topk_hits_ce(spark, sf):
    rows = _scores(spark, sf)
    found = ev.hits_and_loss(F.col("s"), F.col("target"), [1, 5, 10])
    rows = rows.select((F.col("vec_id") % 2 == 0).alias("opener"), *[c.alias(n) for n, c in found.items()])
    out = ev.in_groups(rows, "opener", list(found))
    return out.select("grp", "n", *[F.round(f"top{k}", 9).alias(f"top{k}") for k in (1, 5, 10)], F.round(F.exp("ce"), 6).alias("ppl"))


@query(
    "set_recovery",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s, 1 + vec_id % 5 AS m FROM embeddings),
    x AS (SELECT vec_id, m, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS i FROM e),
    r AS (SELECT vec_id, m, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM x),
    h AS (SELECT vec_id, m, sum(CASE WHEN rk <= m AND i < m THEN 1 ELSE 0 END) AS tp FROM r GROUP BY vec_id, m)
    SELECT m, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(CASE WHEN tp = m THEN 1 ELSE 0 END) AS BIGINT) AS exact_n FROM h GROUP BY m""",
)
def set_recovery(spark, sf):
    """The members of vector n are the first 1 + n mod 5 places."""
    rows = _scores(spark, sf)
    found = ev.set_recovery(F.col("s"), F.sequence(F.lit(0), (F.col("vec_id") % 5).cast("int")))
    rows = rows.select(*[c.alias(n) for n, c in found.items()])
    return rows.groupBy(F.col("m").cast("long").alias("m")).agg(F.count("*").alias("n"), F.sum("tp").cast("long").alias("tp"), F.sum("exact").cast("long").alias("exact_n"))


@query(
    "bits_per_byte",
    "SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(length(text) * 0.75) / (ln(2) * sum(strlen(text))), 9) AS bpb FROM documents GROUP BY lang",
)
def bits_per_byte(spark, sf):
    """Three quarters of a nat a character stand in for a model's losses."""
    rows = table(spark, sf, "documents").select("lang", (F.length("text") * 0.75).alias("nats"), F.octet_length("text").alias("b"))
    return ev.bits_per_byte(rows, ["lang"], "nats", "b").withColumn("bpb", F.round("bpb", 9))


_TRIES = "t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_id FROM events)"


def _attempts(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", "value", F.row_number().over(w).alias("attempt"))


@query(
    "pass_at_k",
    f"""WITH {_TRIES}, f AS (SELECT user_id, min(attempt) FILTER (WHERE value > 100) AS f FROM t GROUP BY user_id), k AS (SELECT unnest([1, 2, 4, 8]) AS k)
    SELECT k, count(*) FILTER (WHERE f <= k) AS passed, count(*) AS n, round(count(*) FILTER (WHERE f <= k) / count(*), 9) AS rate FROM f, k GROUP BY k""",
)
def pass_at_k(spark, sf):
    tries = _attempts(spark, sf).withColumn("ok", F.col("value") > 100)
    return ev.pass_at_k(tries, "user_id", "attempt", "ok", [1, 2, 4, 8]).withColumn("rate", F.round("rate", 9))


@query("advantages", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) + 0.0 AS advantage FROM events")
def advantages(spark, sf):
    rows = ev.advantages(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return rows.select("event_id", (F.round("advantage", 9) + F.lit(0.0)).alias("advantage"))


@query(
    "early_stopping",
    f"""WITH RECURSIVE {_TRIES}, s AS (
      SELECT user_id, CAST(0 AS BIGINT) AS step, value AS best, CAST(0 AS BIGINT) AS best_step, CAST(0 AS BIGINT) AS since, CAST(NULL AS BIGINT) AS stopped FROM t WHERE attempt = 1
      UNION ALL
      SELECT s.user_id, s.step + 1, CASE WHEN t.value < s.best - 1.0 THEN t.value ELSE s.best END, CASE WHEN t.value < s.best - 1.0 THEN s.step + 1 ELSE s.best_step END,
             CASE WHEN t.value < s.best - 1.0 THEN 0 ELSE s.since + 1 END, CASE WHEN t.value < s.best - 1.0 THEN NULL WHEN s.since + 1 >= 5 THEN s.step + 1 END
      FROM s JOIN t ON t.user_id = s.user_id AND t.attempt = s.step + 2 WHERE s.stopped IS NULL)
    SELECT user_id, arg_max(best, step) AS best, arg_max(best_step, step) AS best_step, max(stopped) AS stopped_at FROM s GROUP BY user_id""",
)
def early_stopping(spark, sf):
    return ev.early_stopping(_attempts(spark, sf), "user_id", "attempt", "value", 5, 1.0)


@query(
    "ema_debiased",
    f"""WITH {_TRIES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM t)
    SELECT user_id, any_value(n) AS n, round(sum(0.1 * value * pow(0.9, n - attempt)) / (1 - pow(0.9, any_value(n))), 6) AS ema FROM n GROUP BY user_id""",
)
def ema_debiased(spark, sf):
    return ev.debiased_ema(_attempts(spark, sf), "user_id", "attempt", "value", 0.9).withColumn("ema", F.round("ema", 6))


@query(
    "bootstrap_ci",
    """WITH v AS (SELECT label AS grp, CAST(embedding[1] AS DOUBLE) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    d AS (SELECT grp, n, i, unnest(range(0, 100)) AS resample FROM v),
    j AS (SELECT grp, resample, CAST('0x' || left(md5('7:' || resample || ':' || i), 8) AS BIGINT) % n AS i FROM d),
    m AS (SELECT grp, resample, avg(x) AS mean_value FROM j JOIN v USING (grp, i) GROUP BY ALL)
    SELECT grp, round(quantile_cont(mean_value, 0.025), 6) AS lo, round(quantile_cont(mean_value, 0.975), 6) AS hi FROM m GROUP BY grp""",
)
def bootstrap_ci(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.element_at("embedding", 1).cast("double").alias("x"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    means = sm.bootstrap(rows, "grp", "i", "x", 100, 7)
    return means.groupBy("grp").agg(F.round(F.percentile("mean_value", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("mean_value", F.lit(0.975)), 6).alias("hi"))


@query(
    "power_law_fit",
    "SELECT o_orderpriority AS grp, count(*) AS n, round(regr_slope(ln(o_totalprice), ln(o_orderkey)), 9) AS slope, round(regr_intercept(ln(o_totalprice), ln(o_orderkey)), 6) AS intercept FROM orders WHERE o_orderkey > 0 AND o_totalprice > 0 GROUP BY 1",
)
def power_law_fit(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), "o_orderkey", "o_totalprice")
    fits = ev.power_law(rows, ["grp"], F.col("o_orderkey"), F.col("o_totalprice"))
    return fits.select("grp", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    "quadratic_vertex",
    """WITH r AS (SELECT l_returnflag AS grp, l_quantity AS x, avg((l_quantity - 20) * (l_quantity - 20) + l_discount) AS y FROM lineitem GROUP BY 1, 2)
    SELECT grp, round(arg_min(x, y), 0) AS vertex FROM r GROUP BY grp""",
)
def quadratic_vertex(spark, sf):
    """The lowest point of a planted parabola, fitted by its sums."""
    y = F.avg((F.col("l_quantity") - 20) * (F.col("l_quantity") - 20) + F.col("l_discount")).alias("y")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x")).agg(y)
    return ev.parabola_vertex(rows, ["grp"], "x", "y").select("grp", F.round("vertex_x", 0).alias("vertex"))


@query(
    "lr_schedule",
    f"""WITH r AS (SELECT unnest(range(0, 1000)) AS it)
    SELECT it, round(CASE WHEN it < 40 THEN (it + 1) / 40 WHEN it <= 500 THEN 1.0 ELSE (1000 - it) / 500 + (1 - (1000 - it) / 500) * 0.05 END, 9) AS mult,
    round(CASE WHEN it < 400 THEN (1 - it / 400) * 0.85 + it / 400 * 0.97 WHEN it >= 500 THEN 0.97 * (1 - (it - 500) / 500) + 0.9 * ((it - 500) / 500) ELSE 0.97 END, 9) AS momentum,
    round(0.5 * (1 + cos({math.pi!r} * it / 1000)), 9) AS decay FROM r""",
)
def lr_schedule(spark, sf):
    it = F.col("id")
    return spark.range(1000).select(it.alias("it"), F.round(ev.lr_multiplier(it, 40, 500, 1000, 0.05), 9).alias("mult"), F.round(ev.momentum(it, 500, 1000), 9).alias("momentum"), F.round(ev.cosine_decay(it, 1000), 9).alias("decay"))


@query(
    "inference_report",
    """WITH r AS (SELECT l_returnflag AS grp, list_sort(list(l_extendedprice / l_quantity)) AS l FROM lineitem GROUP BY 1)
    SELECT grp, round(l[len(l) // 2 + 1], 9) AS tpot, round(1 / l[len(l) // 2 + 1], 9) AS tok_s FROM r""",
)
def inference_report(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "grp")
    out = ev.inference_report(rows, ["grp"], "l_extendedprice", "l_quantity", 1e9, 1e12, 1e12, 1e15)
    return out.select("grp", F.round("tpot", 9).alias("tpot"), F.round("tok_s", 9).alias("tok_s"))


@query("mc_argmin", "WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, arg_min(i, (v, i)) AS predicted FROM x GROUP BY vec_id")
def mc_argmin(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "loss"))
    return ev.multiple_choice_answer(rows.withColumn("i", F.col("i").cast("long")), ["vec_id"], "i", "loss")


@query(
    "common_prefix",
    """WITH w AS (SELECT item_id, string_split(text, ' ') AS a FROM benchmark), p AS (SELECT x.item_id, x.a, y.a AS b FROM w x JOIN w y ON y.item_id = x.item_id + 1)
    SELECT item_id, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM p""",
)
def common_prefix(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("a"))
    rows = w.join(w.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return rows.select("item_id", tx.common_prefix(F.col("a"), F.col("b")).cast("long").alias("n"))


@query("last_in_log", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_in_log(spark, sf):
    return ev.last_by(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", "value")


@query("first_best", "SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def first_best(spark, sf):
    return ev.first_best(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query("weighted_metric", "SELECT l_linestatus AS grp, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS metric FROM lineitem GROUP BY 1")
def weighted_metric(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("grp")).agg(ev.weighted_mean("l_discount", "l_quantity").alias("metric"))
    return rows.withColumn("metric", F.round("metric", 9))


@query("batch_size_law", "SELECT o_orderkey, pow(2.0, round_even(log2(524288.0 * pow(o_totalprice * 1000000 / 10000000000.0, 0.383)), 0)) AS batch FROM orders")
def batch_size_law(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ev.batch_size(F.col("o_totalprice") * 1_000_000, 10_000_000_000.0, 524_288.0).alias("batch"))


@query("padded_windows", "SELECT vec_id, array_to_string(list_concat([1, 2, 3][1 : 1 + vec_id % 3], list_transform(range(0, 4 - vec_id % 3), lambda x: -1)), ' ') AS ids FROM embeddings")
def padded_windows(spark, sf):
    items = F.slice(F.array(*map(F.lit, (1, 2, 3))), F.lit(1), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(ch.padded(items, 5).cast("array<string>"), " ").alias("ids"))
