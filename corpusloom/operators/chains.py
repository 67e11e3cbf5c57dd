"""Ascending chains, windows, steps, adjacent pairs and probes over id streams (see ``streams``).

What needs order takes packed documents or rows that know their neighbours; nothing is shuffled before counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.streams import chain_chunks, clause_rows, window_rows, with_neighbours


def chain_histogram(chains: DataFrame) -> DataFrame:
    """len, n."""
    return chains.groupBy(F.size("ids").cast("long").alias("len")).agg(F.count("*").alias("n"))


def chain_summary(histogram: DataFrame) -> DataFrame:
    """One row: chains, tokens, chains of length 1, the longest."""
    return histogram.agg(F.sum("n").alias("chains"), F.sum(F.col("n") * F.col("len")).alias("tokens"), F.sum(F.when(F.col("len") == 1, F.col("n")).otherwise(0)).alias("len1"), F.max("len").alias("max_len"))


def chain_averages(summary: DataFrame) -> DataFrame:
    """The summary with avg_len, to three places, and the fraction of chains of length 1, to four; null without chains."""
    chains = F.nullif(F.col("chains"), F.lit(0))
    return summary.select("*", F.round(F.col("tokens") / chains, 3).alias("avg_len"), F.round(F.col("len1") / chains, 4).alias("len1_fraction"))


def as_text(ids: Column | str) -> Column:
    return F.array_join((F.col(ids) if isinstance(ids, str) else ids).cast("array<string>"), " ")


def window_bags(documents: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """bag, ids_str: distinct ids of each run of ``size`` places, ascending, as text."""
    return window_rows(documents, size, key).select(key, "bag", as_text("ids").alias("ids_str"))


def chain_bags(chains: DataFrame, key: str = "doc_id") -> DataFrame:
    """bag, ids_str: each chain, whose ids are distinct and ascend as they are."""
    return chains.select(key, F.col("chain").alias("bag"), as_text("ids").alias("ids_str"))


def next_token_steps(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """step, input_str, target: each id and the one after it."""
    return with_neighbours(rows, key).where("after is not null").select(key, F.col("pos").alias("step"), F.col("id").cast("string").alias("input_str"), F.col("after").alias("target"))


def chain_steps(chains: DataFrame, key: str = "doc_id") -> DataFrame:
    """step, input_str, target: each chain and the first id of the next one."""
    return chains.where("next_first is not null").select(key, F.col("chain").alias("step"), as_text("ids").alias("input_str"), F.col("next_first").alias("target"))


def sequence_examples(documents: DataFrame, size: int, key: str = "doc_id", reset_on_clause: bool = False, cap: int | None = None) -> DataFrame:
    """chunk, inputs (array of id lists) and targets: a document's chain steps in runs of ``size``; the last may be short."""
    return chain_chunks(documents, size, key, reset_on_clause, cap)


def clause_boundaries(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The places where a clause begins, and the end."""
    found = F.concat(F.when(F.col("cpos") == 0, F.array("pos")).otherwise(F.array().cast("array<long>")), F.when(F.col("after").isNull(), F.array(F.col("pos") + 1)).otherwise(F.array().cast("array<long>")))
    return with_neighbours(rows, key).select(key, F.explode(found).alias("boundary"))


def probes(rows: DataFrame, min_history: int = 1, key: str = "doc_id") -> DataFrame:
    """A probe for each place with enough before it, and whether a clause opens there."""
    return rows.select(key, "pos", (F.col("cpos") == 0).alias("is_opener")).where(F.col("pos") >= max(1, min_history))


def clause_contexts(documents: DataFrame, clauses: int, key: str = "doc_id") -> DataFrame:
    """last_clause, ctx, target: ids of so many consecutive clauses, and the first id of the clause after them."""
    rows = clause_rows(documents, key, clauses - 1).where(F.col("next_clause") == F.col("clause") + 1)
    if clauses > 1:
        rows = rows.where((F.size("earlier") == clauses - 1) & (F.get("earlier", F.lit(0))["clause"] == F.col("clause") - (clauses - 1)))
    return rows.select(key, F.col("clause").alias("last_clause"), as_text(F.concat(F.flatten("earlier.ids"), "ids")).alias("ctx"), F.col("next_first").alias("target"))


def split_last(items: Column) -> tuple[Column, Column]:
    """Both halves of an array; the first gets the odd one."""
    half = F.ceil(F.size(items) / 2).cast("int")
    return F.slice(items, F.lit(1), half), F.slice(items, half + 1, F.size(items))


def padded(items: Column, size: int, value: int = -1) -> Column:
    """An array cut or filled to ``size``."""
    return F.slice(F.concat(items, F.array_repeat(F.lit(value), size)), 1, size)


def pair_counts(rows: DataFrame, key: str = "doc_id", cross_clause: bool = False) -> DataFrame:
    """u, v, w: how often v follows u. Equal neighbours make no pair but still part their neighbours.

    Rows know what follows them, so the only shuffle is that of the counts.
    """
    follows = F.col("after").isNotNull() & (F.col("after") != F.col("id")) & (F.lit(cross_clause) | (F.col("cpos") < F.col("clen") - 1))
    return with_neighbours(rows, key).where(follows).groupBy(F.col("id").alias("u"), F.col("after").alias("v")).agg(F.count("*").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """a, b, up, down: each two ids that make a pair, the lower first, how often b follows a and how often a follows b.

    One shuffle of the pairs, which are read once; nothing is joined.
    """
    rises = F.col("u") < F.col("v")
    ways = [F.sum(F.when(way, F.col("w")).otherwise(0)).alias(n) for way, n in ((rises, "up"), (~rises, "down"))]
    return pairs.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(*ways)


def ascending_fraction(pairs: DataFrame, position: DataFrame | None = None) -> DataFrame:
    """One row: weight of pairs whose first has the lower position (its id if none are given), and all weight."""
    rows = pairs
    if position is not None:
        for c in ("u", "v"):
            rows = rows.join(position.select(F.col("id").alias(c), F.col("pos").alias(f"_{c}")), c)
    a, b = ("u", "v") if position is None else ("_u", "_v")
    zero = F.lit(0).cast("long")
    return rows.agg(F.coalesce(F.sum(F.when(F.col(a) < F.col(b), F.col("w")).otherwise(0)), zero).alias("asc_w"), F.coalesce(F.sum("w"), zero).alias("total_w"))


def net_edges(pairs: DataFrame) -> DataFrame:
    """u, v, net: the direction that prevails; ties vanish."""
    rises = F.col("up") > F.col("down")
    ends = [F.when(rises, x).otherwise(y) for x, y in ((F.col("a"), F.col("b")), (F.col("b"), F.col("a")))]
    return both_ways(pairs).where("up <> down").select(ends[0].alias("u"), ends[1].alias("v"), F.abs(F.col("up") - F.col("down")).alias("net"))


def inverse(order: DataFrame) -> DataFrame:
    """id and pos of an order (id, pos), the other way round: which id stands at a place."""
    return order.select(F.col("pos").alias("id"), F.col("id").alias("pos"))


def ordering_ceiling(pairs: DataFrame) -> DataFrame:
    """One row: all weight, the weight no order can make ascend, and the ids that occur in pairs."""
    zero = F.lit(0).cast("long")
    ends = both_ways(pairs).select(F.explode(F.array(F.struct(F.col("a").alias("u"), (F.col("up") + F.col("down")).alias("w"), F.least("up", "down").alias("lost")), F.struct(F.col("b").alias("u"), zero.alias("w"), zero.alias("lost")))).alias("e")).select("e.*")
    nodes = ends.groupBy("u").agg(F.sum("w").alias("w"), F.sum("lost").alias("lost"))
    return nodes.agg(F.coalesce(F.sum("w"), zero).alias("total"), F.coalesce(F.sum("lost"), zero).alias("irreducible"), F.count("*").alias("active"))
