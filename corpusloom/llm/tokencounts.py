"""Token counts: an exact length histogram with suffix sums, which answer for every context limit.

Documents are counted by encoded length; tasks sum before the shuffle, so a row per distinct length and task
is all that moves. Suffix sums run over blocks of 64 lengths and then over the blocks' totals: no window
holds more than a block, and the one over blocks has a row per 64 tokens of the longest document.

Defined results: a null or empty text has no token and counts as a document of length 0; repeated rows count
each; other columns play no part; an empty table gives no row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed, row_udf
from corpusloom.llm.tokens import encoder

BLOCK = 64


def n_tokens(text: Column, tokenizer: str | None = None) -> Column:
    """The number of ids of each whole text."""

    def make():
        encode = encoder(tokenizer)
        return lambda t: len(encode(t)) // 4

    return row_udf(make, T.LongType())(text)


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """n_tokens and n_docs."""
    return docs.select(n_tokens(F.col(text), tokenizer).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds, for each length n: docs_at_least and tokens_at_least (documents of n tokens or more), docs_at_most,
    and truncated_tokens: what is left in all if every document is cut after n tokens."""
    histogram = checkpointed(histogram)  # used twice; a row a length
    block = F.floor(F.col("n_tokens") / BLOCK)
    sums = [F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t")]
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = histogram.groupBy(block.alias("block")).agg(*sums).select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"), F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumn("block", block).join(blocks, "block")
    at_least = F.col("docs_after") + F.sum("n_docs").over(inside)
    tokens_at_least = F.col("tokens_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)
    rows = rows.select("n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), "docs", "tokens")
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def at_limits(summed: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents, tokens, documents over the limit, and tokens left if all are cut there."""
    row = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
    found = summed.agg(F.min(row).alias("all"), *[F.min(F.when(F.col("n_tokens") > n, row)).alias(f"over{i}") for i, n in enumerate(limits)])
    zero = F.lit(0).cast("long")
    rows = []
    for i, n in enumerate(limits):
        over, beyond = F.coalesce(F.col(f"over{i}.docs_at_least"), zero), F.coalesce(F.col(f"over{i}.tokens_at_least"), zero)
        docs, tokens = F.coalesce(F.col("all.docs_at_least"), zero), F.coalesce(F.col("all.tokens_at_least"), zero)
        rows.append(F.struct(F.lit(n).cast("long").alias("context_limit"), docs.alias("docs"), tokens.alias("tokens"), over.alias("docs_over"), (tokens - beyond + over * n).alias("tokens_left")))
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quantiles(summed: DataFrame, shares: list[float]) -> DataFrame:
    """For each share of the documents: the least length that so many don't exceed."""
    docs = summed.agg(F.max("docs_at_least")).first()[0] or 0  # one number
    reached = [F.min(F.when(F.col("docs_at_most") >= F.ceil(F.lit(s) * F.lit(docs)), F.col("n_tokens"))) for s in shares]
    found = summed.agg(F.array(*reached).alias("n"))
    return found.select(F.posexplode("n").alias("i", "n_tokens")).select(F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1).alias("share"), "n_tokens")
