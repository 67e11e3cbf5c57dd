"""A corpus from raw documents to packed sequences, in five stages; each is written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents, and any further columns that docs has.

Defined results: a null or empty text is never toxic, has no lines to lose, no benchmark passage, and one of
all such documents stays at the near duplicates; the end id alone is its packing. Rows that repeat an id with
the same text are one document for line dedup and near duplicates, where one of them stays; rows that repeat
an id with other texts are documents of their own. Null ids come first at line dedup and give way to any id
at near duplicates. Columns may have any names. Empty tables give empty results; without labels nothing is
toxic, without benchmark nothing is contaminated.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, linededup, nearcopies, packing, toxicity
from corpusloom.llm.common import free_name, new_path, table
from corpusloom.sources.shared import remove
from corpusloom.sources.tables import spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones among them, doesn't score 0.5 or more."""
    lexicon = toxicity.learned_from(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(lexicon, F.col("text"))["score"] < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later copies; one that loses all its words goes. n_chars follows the text."""
    lost = free_name(docs, "deleted_lines")
    left = linededup.dedup_lines(docs, deleted=lost)
    left = left.where((F.col(lost) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(lost)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return nearcopies.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL for run(): it can't express the tokenizer, the learned lexicon or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. A stage's folder is deleted once the next one is written; the last one stays."""
    docs, before = spread(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spread(spark.read.parquet(path)), path
    return docs
