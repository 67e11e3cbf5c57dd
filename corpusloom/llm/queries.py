"""The operators' queries over the tables of a folder, with SQL where SQL can express them."""

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, htmltext, licenses, linededup, packing, quality, simhash, tokencounts, toxicity, warc
from corpusloom.llm.common import new_path, table
from corpusloom.sources.tables import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; the lexicon is learned from labels outside the held-out fold."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lexicon = toxicity.learned_from(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity(lexicon, F.col("text")).alias("t"))
    return scored.select("doc_id", "held_out", "t.score", (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.array_join("t.terms", " ").alias("matched"))


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items that the windows belong to."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    marked = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"), "c")
    return marked.select(
        "doc_id",
        "c.n_words",
        "c.n_hit",
        F.size("c.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.item_ids", ","), 256).alias("items_sha256"),
        (F.col("c.n_hit") > 0).alias("contaminated"),
    )


ORACLES["op5_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
       FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 ids."""
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.grouped(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines of later copies of repeated runs."""
    left = linededup.dedup_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return left.select("doc_id", "deleted_lines", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    return tokencounts.with_suffix_sums(tokencounts.length_histogram(spread(table(spark, sf_dir, "documents").select("text"))))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; the field is trained on a bounded sample of labelled ones."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    field = quality.trained(docs, table(spark, sf_dir, "labels"))
    judged = docs.select("doc_id", quality.quality(field, F.col("text")).alias("q"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", "n_lines", "content_lines")
    return judged.select("doc_id", *[f"q.{n}" for n in names])


@query
def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2's plain rules count, without the field's verdict."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = docs.select("doc_id", quality.quality(quality.Field(), F.col("text")).alias("q"))
    return judged.select("doc_id", *[f"q.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])


ORACLES["quality_base_counts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) > 2),
twice AS (SELECT doc_id, unnest(i) AS i FROM (SELECT doc_id, g, list(i) AS i FROM g GROUP BY doc_id, g HAVING count(*) > 1)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


@query
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every document."""
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", licenses.license_paragraphs(F.col("text"), licenses.trained()).alias("p"))
    sure = F.filter("p", lambda x: (x["family"] != licenses.UNKNOWN) & x["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    return found.select(
        "doc_id",
        F.size("p").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(families, ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: x["n"].cast("string")), ",").alias("lines"),
        F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record came back from archives written to the shared folder."""
    pages = spread(table(spark, sf_dir, "pages"))
    path = new_path(spark, "warc")
    warc.write_pages(pages, path)
    records = warc.read_records(spark, path)
    kind = pages.schema["page_id"].dataType
    return records.select(
        warc.page_of(F.col("page"), kind).alias("page_id"),
        "payload_bytes",
        F.when(F.col("intact"), F.col("payload_digest")).alias("payload_digest"),  # of responses, read_records has compared it with the payload
        "record_type",
        warc.page_of(F.col("refers_to_page"), kind).alias("refers_to"),
    )


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m USING (d)
"""


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmltext.extract(spread(table(spark, sf_dir, "pages")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLES["op8_line_dedup"] = r"""
WITH i AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM i WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT b.doc_id AS d, b.n, a.doc_id AS ad, a.n AS an, b.nw FROM l a JOIN l b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.n < b.n))),
g AS (SELECT *, n - row_number() OVER (PARTITION BY d, ad, n - an ORDER BY n) AS island FROM m),
r AS (SELECT d, min(n) AS s, max(n) AS e FROM g GROUP BY d, ad, n - an, island HAVING sum(nw) >= 50),
gone AS (SELECT DISTINCT d AS doc_id, unnest(range(s, e + 1)) AS n FROM r),
left_over AS (SELECT i.doc_id, string_agg(i.line, chr(10) ORDER BY i.i) FILTER (WHERE gone.n IS NULL) AS t, count(gone.n) AS deleted
  FROM i LEFT JOIN l USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.n = l.n GROUP BY i.doc_id)
SELECT d.doc_id, coalesce(deleted, 0) AS deleted_lines, CASE WHEN d.text IS NOT NULL THEN length(coalesce(t, '')) END AS n_chars, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(t, '')) END AS text_md5
FROM documents d LEFT JOIN left_over USING (doc_id)
"""
