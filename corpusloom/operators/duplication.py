"""Giving tokens several places in an order: conflict masses, plans, and the rewriting of id streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.chains import both_ways
from corpusloom.operators.streams import with_neighbours
from corpusloom.sources.shared import written

SCALE = 1_000_000


def conflict_losses(pairs: DataFrame) -> DataFrame:
    """u, loss (weight lost whichever order is chosen) and directed (weight of all its pairs)."""
    lost, all_of = F.least("up", "down").alias("loss"), (F.col("up") + F.col("down")).alias("directed")
    ends = both_ways(pairs).select(F.explode(F.array("a", "b")).alias("u"), lost, all_of)
    return ends.groupBy("u").agg(F.sum("loss").alias("loss"), F.sum("directed").alias("directed"))


def select_parents(losses: DataFrame, n: int, min_share_percent: int = 5) -> DataFrame:
    """The n ids of most loss whose share of their weight is enough; ties go to the lower id."""
    enough = losses.where((F.col("loss") > 0) & (F.col("loss") * 100 >= F.greatest("directed", F.lit(1)) * min_share_percent))
    return enough.orderBy(F.desc("loss"), "u").limit(n)


def duplicate_plan(parents: DataFrame) -> DataFrame:
    """old_index, early_new, late_new, loss: each parent takes two neighbouring places; ids above move up."""
    below = F.row_number().over(Window.orderBy("u")) - 1  # as many rows as parents
    rows = parents.select("u", "loss", (F.col("u") + below).alias("early_new"))
    return rows.select(F.col("u").alias("old_index"), "early_new", (F.col("early_new") + 1).alias("late_new"), "loss")


def renumbering(size: int, parents: DataFrame) -> DataFrame:
    """id and new_id for the ids below ``size``: each moves up by the extra places of the parents (id, extra) below it.

    One row an id of the vocabulary; the running sum is taken by one task, as the vocabulary's own numbering is.
    """
    extra = parents.select(F.col("id").cast("long").alias("id"), F.col("extra").cast("long").alias("extra"))
    below = F.coalesce(F.sum("extra").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parents.sparkSession.range(size).join(extra, "id", "left").select("id", (F.col("id") + below).alias("new_id"))


def _parents(plan: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parents of a plan in order, where their copies begin, and the copies' new ids and targets: flat arrays of its size."""
    columns = [c for c in ("old_index", "new_index", "target_scaled") if c in plan.columns]
    found = plan.select(*columns).toArrow()
    old, new, target = (found.column(c if c in columns else "old_index").to_numpy().astype(np.int64) for c in ("old_index", "new_index", "target_scaled"))
    order = np.lexsort((new, old))
    parents, starts = np.unique(old[order], return_index=True)
    return parents, np.append(starts, len(order)), new[order], target[order]


def _renumbered(rows: DataFrame, key: str, size: int, new_ids: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], more: str) -> DataFrame:
    """key, pos, new_id of the rows with an id below ``size``, by a function of ids, of column ``more`` and of where that is null."""
    schema = T.StructType([rows.schema[key], T.StructField("pos", T.LongType()), T.StructField("new_id", T.LongType())])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.and_(pc.greater_equal(batch.column("id"), 0), pc.less(batch.column("id"), size)))
            ids, other = (pc.fill_null(batch.column(c), -1).to_numpy(zero_copy_only=False) for c in ("id", "more"))
            new = new_ids(ids, other, batch.column("more").is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("pos"), pa.array(new, pa.int64())], names=schema.names)

    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"), F.col(more).cast("long").alias("more")).mapInArrow(run, schema)


def apply_duplicates(rows: DataFrame, plan: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """key, pos, new_id: a parent takes its late place where the token before it stands above it in the order.

    The plan's parents, vocabulary's ``size`` at most, go to the executors as a flat array; rows aren't shuffled.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_parents(plan.select("old_index"))[0])

    def run(ids: np.ndarray, before: np.ndarray, none: np.ndarray) -> np.ndarray:
        parents = sent.value
        below = np.searchsorted(parents, ids)
        own = np.append(parents, -1)[below] == ids
        return ids + below + (own & ~none & (before > ids))

    return _renumbered(with_neighbours(rows, key), key, size, run, "before")


def position_histogram(ids: DataFrame, bins: int) -> DataFrame:
    """token_id, bin, n: places in clauses, from 0 to 1, in equal bins; the last holds 1."""
    place = F.expr(f"least({bins}L * cpos div greatest(clen - 1, 1L), {bins - 1}L)")
    return ids.groupBy(F.col("id").alias("token_id"), place.alias("bin")).agg(F.count("*").alias("n"))


def predecessor_histogram(ids: DataFrame, bins: int, size: int, key: str = "doc_id") -> DataFrame:
    """token_id, bin, n: ranks of the tokens before, across clauses, in equal bins of the order."""
    before = with_neighbours(ids, key).where("before is not null").select("id", F.col("before").alias("_before"))
    rank = F.expr(f"least({bins}L * _before div {max(size - 1, 1)}L, {bins - 1}L)")
    return before.groupBy(F.col("id").alias("token_id"), rank.alias("bin")).agg(F.count("*").alias("n"))


def select_k(histogram: DataFrame, bins: int, k_max: int = 6, mass_percent: int = 15) -> DataFrame:
    """token_id, k, copy, target_scaled: the most copies such that each equal part of the range holds enough mass.

    Targets are the parts' centres of mass, as whole millionths. Tokens without such k >= 2 have one copy.
    """
    rows, histogram = [], written(histogram)  # of vocabulary size, and read twice
    for k in range(1, k_max + 1):
        edges = [bins * i // k for i in range(k + 1)]
        part = F.lit(0)
        for i in range(1, k):
            part = part + F.when(F.col("bin") >= edges[i], 1).otherwise(0)
        rows.append(F.struct(F.lit(k).alias("k"), part.alias("copy")))
    by_part = histogram.select("token_id", "bin", "n", F.explode(F.array(*rows)).alias("p")).groupBy("token_id", "p.k", "p.copy").agg(F.sum("n").alias("mass"), F.sum(F.expr("(2 * bin + 1) * n")).alias("moment"))
    totals = by_part.groupBy("token_id", "k").agg(F.sum("mass").alias("total"), F.min("mass").alias("least"), F.count("*").alias("parts"))
    good = totals.where((F.col("k") == 1) | ((F.col("parts") == F.col("k")) & (F.col("least") * 100 >= F.col("total") * mass_percent)))
    best = good.groupBy("token_id").agg(F.max("k").alias("k"))
    target = F.expr(f"(moment * {SCALE}L) div (mass * {2 * bins}L)").alias("target_scaled")
    return by_part.join(best, ["token_id", "k"]).select("token_id", F.col("k").cast("long").alias("k"), F.col("copy").cast("long").alias("copy"), target)


def select_candidates(losses: DataFrame, n: int) -> DataFrame:
    """token_id of the n ids of most loss, if they have any; ties go to the lower id."""
    return select_parents(losses, n, 0).select(F.col("u").alias("token_id"))


def fixed_k(tokens: DataFrame, k: int) -> DataFrame:
    """token_id, k, copy, target_scaled: k copies of each token, aimed at the middles of k equal parts."""
    targets = F.array(*[F.lit(round(round((i + 0.5) / k, 6) * SCALE)).cast("long") for i in range(k)])
    rows = tokens.select("token_id", F.lit(k).cast("long").alias("k"), F.posexplode(targets).alias("copy", "target_scaled"))
    return rows.withColumn("copy", F.col("copy").cast("long"))


def kway_plan(chosen: DataFrame) -> DataFrame:
    """old_index, new_index, copy, target_scaled for tokens of two copies or more; ids above move up by the extra places."""
    kept = written(chosen.where("k >= 2"))  # of vocabulary size, and read twice
    parents = kept.select("token_id", "k").distinct()
    extra = F.coalesce(F.sum(F.col("k") - 1).over(Window.orderBy("token_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parents.select("token_id", (F.col("token_id") + extra).alias("base"))  # as many rows as parents
    return kept.join(bases, "token_id").select(F.col("token_id").alias("old_index"), (F.col("base") + F.col("copy")).alias("new_index"), "copy", "target_scaled")


def apply_kway(rows: DataFrame, plan: DataFrame, place: str, size: int, key: str = "doc_id") -> DataFrame:
    """key, pos, new_id: a token with copies takes that whose target is nearest to ``place``, a column of millionths.

    Ties go to the lower copy; without a place (the first token, where predecessors decide) it's the first copy.
    The plan, a few times the vocabulary's ``size``, goes to the executors as flat arrays; rows aren't shuffled.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_parents(plan))

    def run(ids: np.ndarray, places: np.ndarray, none: np.ndarray) -> np.ndarray:
        parents, starts, new, target = sent.value
        below = np.searchsorted(parents, ids)
        out = ids + starts[below] - below  # each parent below takes one place less than it has copies
        at = np.flatnonzero(np.append(parents, -1)[below] == ids)
        first, end = starts[below[at]], starts[below[at] + 1] if len(at) else starts[below[at]]
        chosen, least = first.copy(), np.abs(target[first] - places[at]) if len(at) else first
        for k in range(1, int((end - first).max(initial=0))):
            nearer = np.flatnonzero((first + k < end) & ~none[at])
            distance = np.abs(target[first[nearer] + k] - places[at[nearer]])
            better = distance < least[nearer]
            nearer = nearer[better]
            least[nearer], chosen[nearer] = distance[better], first[nearer] + k
        out[at] = new[chosen] if len(at) else out[at]
        return out

    return _renumbered(rows, key, size, run, place)
