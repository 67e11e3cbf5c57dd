"""Phrase records and training steps: joins of neighbouring phrases, contexts, layouts, remapping, hybrid histories."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.chains import chain_histogram, chain_steps, chain_summary, next_token_steps
from corpusloom.operators.streams import chain_rows, clause_rows, computed, context_rows, remapped, token_rows


def normalized(records: DataFrame) -> DataFrame:
    """Records with a type; one without becomes a single record per index and, if its indices ascend, a packed one."""
    typed = records.where("record_type is not null")
    legacy = records.where("record_type is null")
    single = F.transform("indices", lambda i, k: F.struct(F.lit("single").alias("record_type"), F.array(i).alias("indices"), k.cast("long").alias("token_pos")))
    ascending = F.forall(F.sequence(F.lit(1), F.size("indices") - 1), lambda k: F.element_at("indices", k) < F.element_at("indices", k + 1))
    packed = F.when(F.when(F.size("indices") > 1, ascending).otherwise(F.lit(False)), F.array(F.struct(F.lit("packed").alias("record_type"), F.col("indices"), F.lit(None).cast("long").alias("token_pos")))).otherwise(F.array().cast("array<struct<record_type:string,indices:array<bigint>,token_pos:bigint>>"))
    new = legacy.withColumn("_r", F.explode(F.concat(single, packed))).drop("record_type", "indices", "token_pos").select("*", "_r.*").drop("_r")
    return typed.unionByName(new)


def phrase_pairs(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each clause and the next one of its document: its last id (single), all its ids (packed) and the next one's first id."""
    rows = clause_rows(documents, key).where(F.col("next_clause") == F.col("clause") + 1)
    return rows.select(key, "clause", F.element_at("ids", -1).alias("single"), F.col("ids").alias("packed"), F.col("next_first").alias("target"))


def example_targets(bags: DataFrame, key: str, order: str, indices: str) -> DataFrame:
    """input and target: the record before, and each index of the record."""
    before = F.lag(indices).over(Window.partitionBy(key).orderBy(order))
    rows = bags.withColumn("input", before).where("input is not null")
    return rows.select(key, order, "input", F.explode(indices).alias("target"))


def flat_layout(rows: DataFrame, key: str, lists: str) -> DataFrame:
    """A list of lists as flat values with their list's number and their place in it."""
    outer = rows.select(key, F.posexplode(lists).alias("slot", "_l"))
    return outer.select(key, F.col("slot").cast("long").alias("slot"), F.posexplode("_l").alias("at", "value")).withColumn("at", F.col("at").cast("long"))


def nested_layout(flat: DataFrame, key: str) -> DataFrame:
    """The lists back from their flat form."""
    inner = flat.groupBy(key, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("_l"))
    return inner.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "_l"))), lambda x: x["_l"]).alias("lists"))


def context_steps(documents: DataFrame, recent: int, depth: int, key: str = "doc_id") -> DataFrame:
    """pos, ctx, target for each place but the first: the ``recent`` ids before it one by one, and before those the
    last ``depth`` chains, the last of them up to where the recent ids begin. Steps are parted by ``|``, ids in a
    step by a space.
    """
    return context_rows(documents, recent, depth, key)


def split_points(documents: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """The documents with ``split``: a clause boundary (0 and the end among them) that a Mersenne Twister seeded by the key picks."""

    def run(keys: pa.Array, clauses: pa.Array) -> pa.Array:
        out = []
        for k, places in zip(keys.to_pylist(), clauses.to_pylist(), strict=True):
            ends = [0, *itertools.accumulate(len(list(g)) for _, g in itertools.groupby(places or []))]
            out.append(random.Random(seed * 1_000_003 + (k or 0)).choice(ends))
        return pa.array(out, pa.int64())

    return computed(documents, "split", T.LongType(), run, key, "clauses")


def hybrid_steps(documents: DataFrame, cap: int | None = None, key: str = "doc_id") -> DataFrame:
    """step, input and target: chains before the document's ``split`` place, single ids from it on."""
    rows = chain_rows(documents, key, cap=cap, split="split")
    return rows.select(key, F.col("chain").alias("step"), F.col("ids").alias("input"), F.col("next_first").alias("target")).where("target is not null")


def with_closing_quotes(records: DataFrame, quote: int, closing: int, keys: list[str]) -> DataFrame:
    """Records whose every second quote of a story, by place, is the closing one, in every record that covers the place.

    Records have ``places``, the absolute place of each index.
    """
    cells = records.withColumn("_rid", F.xxhash64(*keys, "line_no")).select(*keys, "line_no", F.explode(F.arrays_zip("places", "indices")).alias("c")).where(F.col("c.indices") == quote)
    spots = cells.select(*keys, F.col("c.places").alias("place")).distinct()
    second = spots.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where("_n % 2 = 0")
    shut = second.groupBy(*keys).agg(F.collect_set("place").alias("_shut"))  # as many as a story's quotes
    rows = records.join(shut, keys, "left")
    new = F.zip_with("indices", "places", lambda i, p: F.when((i == quote) & F.coalesce(F.array_contains(F.col("_shut"), p), F.lit(False)), F.lit(closing).cast("long")).otherwise(i))
    return rows.withColumn("indices", new).drop("_shut")


def reordered(vocab: DataFrame, order: DataFrame) -> DataFrame:
    """The vocabulary with the places of an order (idx, place) as its indices: token, old_idx, idx, cnt."""
    return vocab.join(order, "idx").select("token", F.col("idx").alias("old_idx"), F.col("place").alias("idx"), "cnt")


def extended_vocabulary(vocab: DataFrame, copies: DataFrame, suffix: str = "~dup") -> DataFrame:
    """token and idx after a plan (old_index, new_index, copy): copies beyond the first get a suffix, longer while it's taken."""
    named = vocab.join(copies.withColumnRenamed("old_index", "idx"), "idx").select("token", F.col("new_index").alias("idx"), "copy")
    extra = named.where("copy > 0").withColumn("_base", F.concat("token", F.lit(suffix), F.when(F.col("copy") > 1, F.col("copy").cast("string")).otherwise("")))
    longest = F.lit(8)
    tries = extra.withColumn("_k", F.explode(F.sequence(F.lit(0), longest))).withColumn("_t", F.concat("_base", F.repeat(F.lit("~"), F.col("_k"))))
    free = tries.join(vocab.select(F.col("token").alias("_t")), "_t", "left_anti").groupBy("idx").agg(F.min_by("_t", "_k").alias("token"))
    return named.where("copy = 0").select("token", "idx").unionByName(free.select("token", "idx"))


def top_latents(scores: Column, k: int, offset: int = 0) -> Column:
    """Places of the k highest scores (equal ones by place), ascending, moved up by ``offset``."""
    ranked = F.transform(F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), lambda r: r["i"])
    return F.transform(F.array_sort(F.slice(ranked, 1, k)), lambda i: i + offset)


def sampled(rows: DataFrame, key: str, logits: str, k: int, temperature: float, seed: int) -> DataFrame:
    """key and token: one of the k highest logits, drawn by softmax (the highest logit plus Gumbel noise from a seeded hash)."""
    flat = rows.select(key, F.posexplode(logits).alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("x"), "i"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
    noise = -F.log(-F.log((h + 0.5) / 4294967296.0))
    top = flat.withColumn("_r", rank).where(F.col("_r") <= k).withColumn("_s", F.col("x") / temperature + noise)
    return top.groupBy(key).agg(F.min_by("i", F.struct(-F.col("_s"), "i")).alias("token"))


def summaries_by_order(documents: DataFrame, orders: dict[str, DataFrame | None]) -> DataFrame:
    """name, chains, tokens, len1, max_len of the chains under each named order (id, new_id; None: the ids themselves).

    Orders are few and given by the caller; documents go through each of them as arrays.
    """
    out = None
    for name, order in orders.items():
        chains = chain_rows(documents if order is None else remapped(documents, order, -1))
        part = chain_summary(chain_histogram(chains)).select(F.lit(name).alias("name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def mismatched(plan: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows of a plan (old_index, token) that the vocabulary (idx, token) doesn't have: none, if both belong together."""
    return plan.join(vocab.select(F.col("idx").alias("old_index"), "token"), ["old_index", "token"], "left_anti")


#: Ways to make steps of packed documents, by name. Callers may add their own.
CHAIN_MODES = {
    "token": lambda documents, **_: next_token_steps(token_rows(documents)),
    "phrase": lambda documents, cap=None, **_: chain_steps(chain_rows(documents, reset_on_clause=True, cap=cap)),
    "cross_phrase": lambda documents, cap=None, **_: chain_steps(chain_rows(documents, cap=cap)),
    "hybrid": lambda documents, cap=None, seed=0, **_: hybrid_steps(split_points(documents, seed), cap),
}


def steps(documents: DataFrame, mode: str, **options) -> DataFrame:
    if mode not in CHAIN_MODES:
        raise ValueError(f"no mode {mode}; known: {', '.join(sorted(CHAIN_MODES))}")
    return CHAIN_MODES[mode](documents, **options)


def sweep(documents: DataFrame, recents: list[int], depths: list[int], key: str = "doc_id") -> DataFrame:
    """The contexts of every place for every pair of settings, tagged with recent and depth."""
    out = None
    for x in recents:
        for d in depths:
            part = context_steps(documents, x, d, key).withColumn("recent", F.lit(x)).withColumn("depth", F.lit(d))
            out = part if out is None else out.unionByName(part)
    return out
