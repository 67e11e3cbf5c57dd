"""Token streams, census and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import clause_tokens
from corpusloom.operators.streams import census_rows, record_rows

#: Relative positions are summed as whole numbers of this, so that sums don't depend on the order of rows.
SCALE = 1_000_000_000
UNKNOWN = "<unk>"


def clause_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, clause, cpos, clen, tok: one row a token. A projection: nothing is shuffled."""
    rows = docs.select(key, F.posexplode(clause_tokens(F.col(text))).alias("pos", "t"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), *[F.col(f"t.{c}").cast("long").alias(c) for c in ("clause", "cpos", "clen")], F.col("t.tok").alias("tok"))


def text_census(docs: DataFrame, text: str = "text") -> DataFrame:
    """What ``census`` says of ``clause_stream``; tokens are summed as they are cut."""
    return census_rows(docs, SCALE, text).groupBy("tok").agg(F.sum("cnt").alias("cnt"), F.sum("pos_sum").alias("pos_sum"))


def census(stream: DataFrame, tok: str = "tok") -> DataFrame:
    """tok, cnt and pos_sum (relative positions in their clauses, scaled to whole numbers)."""
    return stream.groupBy(tok).agg(F.count("*").alias("cnt"), F.sum(F.expr(f"cpos * {SCALE}L div greatest(clen - 1, 1L)")).alias("pos_sum"))


def census_report(stream: DataFrame, counted: DataFrame, thresholds: list[int], caps: list[int], key: str = "doc_id") -> DataFrame:
    """One row: documents with tokens, tokens, clauses, types by least count, and tokens covered by the most frequent types."""
    whole = stream.agg(F.count("*").alias("tokens"), F.count_if(F.col("cpos") == 0).alias("clauses"))
    types = counted.agg(*[F.count_if(F.col("cnt") >= t).alias(f"v{t}") for t in thresholds])
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "tok"))
    top = counted.select("cnt", "tok").orderBy(F.desc("cnt"), "tok").limit(max(caps)).withColumn("rank", rank)
    covered = top.agg(*[F.sum(F.when(F.col("rank") <= k, F.col("cnt")).otherwise(0)).alias(f"top{k}") for k in caps])
    one = F.lit(1)
    rows = [x.withColumn("_one", one) for x in (whole, types, covered)]  # three single rows
    return rows[0].join(rows[1], "_one").join(rows[2], "_one").drop("_one")


def dense_index(rows: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Adds the rows' place in an order, from 0. One task numbers them: for vocabularies, whose size is that of the types."""
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def vocabulary(counted: DataFrame, min_count: int = 1) -> DataFrame:
    """token, idx, cnt: types in the order of mean relative position, then frequency, then spelling."""
    kept = counted.where(F.col("cnt") >= min_count).select(F.col("tok").alias("token"), "cnt", F.expr("pos_sum div cnt").alias("_avg"))
    return dense_index(kept, ["_avg", F.desc("cnt"), "token"]).select("token", "idx", "cnt")


def lookup(vocab: DataFrame, min_count: int) -> DataFrame:
    """token, id: frequent types in vocabulary order, numbered anew, and the unknown token last."""
    kept = vocab.where(F.col("cnt") >= min_count)
    numbered = dense_index(kept, ["idx"], "id").select("token", "id")
    last = kept.agg(F.count("*").alias("id")).select(F.lit(UNKNOWN).alias("token"), "id")
    return numbered.unionByName(last)


def top_k_remap(vocab: DataFrame, k: int) -> DataFrame:
    """old_id, new_id: the k most frequent types keep their order and are numbered anew, all others get k."""
    ranked = vocab.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "idx")))
    within = F.sum(F.when(F.col("_rank") <= k, 1).otherwise(0)).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return ranked.select(F.col("idx").alias("old_id"), F.when(F.col("_rank") <= k, within).otherwise(F.lit(k)).cast("long").alias("new_id"))


def contiguous(vocab: DataFrame) -> DataFrame:
    """One row: whether the indices are 0 to n - 1, each once."""
    return vocab.agg(((F.min("idx") == 0) & (F.max("idx") == F.count("*") - 1) & (F.countDistinct("idx") == F.count("*"))).alias("ok"))


def union_census(stream: DataFrame, domain: str) -> DataFrame:
    """tok, cnt, n_domains over streams that are tagged by domain."""
    return stream.groupBy("tok").agg(F.count("*").alias("cnt"), F.countDistinct(domain).alias("n_domains"))


def sparse_records(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A ``single`` record for each token with an id, and a ``packed`` one for each clause whose ids, two at least, ascend."""
    return record_rows(documents, key)


def build_metadata(records: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """record_type, n_records, n_documents and n_types of a build."""
    counted = records.groupBy("record_type").agg(F.count("*").alias("n_records"), F.countDistinct(key).alias("n_documents"))
    return counted.withColumn("n_types", F.lit(vocab.count()))


def canonical_stream(records: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """abs_pos and index of single and punctuation records: of those at one place the first by ``order`` wins."""
    rows = records.where(F.col("record_type").isin("single", "punctuation") & (F.size("indices") > 0)).withColumn("abs_pos", F.col("start") + F.col("token_pos"))
    return rows.groupBy(*keys, "abs_pos").agg(F.min_by(F.struct(F.col("phrase_id"), F.element_at("indices", 1).alias("id")), order).alias("r")).select(*keys, "abs_pos", "r.phrase_id", "r.id")


def remapped(indices: Column, mapping: Column, dedup: bool = False) -> Column:
    """Indices through a map; lists of several are sorted, and with ``dedup`` repeated ones go."""
    new = F.transform(indices, lambda i: F.try_element_at(mapping, i))
    return F.array_sort(F.array_distinct(new)) if dedup else F.when(F.size(new) > 1, F.array_sort(new)).otherwise(new)
