"""Splits, samples, slices and mixtures of examples.

Random choices go by a seeded hash of the example's id, so they don't depend on partitions and can be
repeated anywhere; permutations of the library's own random generators are given as ordinal tables.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hash_rank(rows: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """Adds the rows' place in a seeded order (md5 of seed and key), from 0.

    Rows are numbered within 65,536 ranges of the hash and moved up by the ranges before theirs.
    """
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).withColumn("_range", F.left("_h", F.lit(4)))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    return rows.join(before, "_range").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_h", "_range", "_before")


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """ordinal, place: a Mersenne Twister shuffle of 0 to n - 1."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return spark.createDataFrame([(o, i) for i, o in enumerate(order)], "ordinal long, place long")


def hub_permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """ordinal, place: the permutation of 0 to n - 1 that NumPy's default generator (PCG64) gives for the seed."""
    import numpy as np

    order = np.random.default_rng(seed).permutation(n)
    return spark.createDataFrame([(int(o), i) for i, o in enumerate(order)], "ordinal long, place long")


def sample_files(files: DataFrame, name: str, fraction: float, seed: int) -> DataFrame:
    """At least one file, and about so large a fraction of them (half a file rounds to even), as a Mersenne Twister draws
    them from the sorted names. A row a file goes to the driver."""
    names = sorted(r[0] for r in files.select(name).collect())
    chosen = random.Random(seed).sample(names, max(1, round(len(names) * fraction))) if names else []
    return files.join(F.broadcast(files.sparkSession.createDataFrame([(n,) for n in chosen], f"{name} string")), name, "left_semi")


def split_train_val(rows: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    """Adds ``split``: the first max(1, n * percent / 100) rows of the seeded order are val."""
    cut = max(1, rows.count() * percent // 100)
    return hash_rank(rows, key, seed, "_rank").withColumn("split", F.when(F.col("_rank") < cut, "val").otherwise("train")).drop("_rank")


def hash_split(key: str, percent: int, seed: int) -> Column:
    """A split that needs no count: ``val`` for about so many percent of the keys."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(100)) < percent, "val").otherwise("train")


def every_nth(rows: DataFrame, ordinal: str, n: int) -> DataFrame:
    return rows.where(F.col(ordinal) % n == 0)


def sliced(rows: DataFrame, ordinal: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... below stop, numbered from 0 by ``idx``."""
    rows = rows.where((F.col(ordinal) >= start) & ((F.col(ordinal) - start) % step == 0))
    rows = rows if stop is None else rows.where(F.col(ordinal) < stop)
    return rows.withColumn("idx", F.expr(f"({ordinal} - {start}) div {step}"))


def sequence(tasks: list[DataFrame], ordinal: str = "local_idx") -> DataFrame:
    """task, local_idx and ord: the tasks one after the other. Only their sizes go to the driver."""
    out, before = None, 0
    for i, rows in enumerate(tasks):
        part = rows.select(F.lit(i).cast("long").alias("task"), F.col(ordinal).cast("long").alias("local_idx"))
        part = part.withColumn("ord", F.col("local_idx") + before)
        before += rows.count()
        out = part if out is None else out.unionByName(part)
    return out


def mixture(tasks: list[DataFrame], seed: int = 42, ordinal: str = "local_idx") -> DataFrame:
    """task, local_idx and ord: all rows of all tasks in a seeded order; a task given twice is taken twice."""
    rows = sequence(tasks, ordinal).withColumn("_k", F.concat_ws("/", F.col("task").cast("string"), F.col("local_idx").cast("string")))
    return hash_rank(rows.drop("ord"), "_k", seed, "ord").drop("_k")


def batches(rows: DataFrame, ordinal: str, size: int) -> DataFrame:
    """Adds ``batch``: runs of ``size`` rows by their ordinal."""
    return rows.withColumn("batch", F.floor(F.col(ordinal) / size))


def few_shot(pool: DataFrame, key: str, shots: int, seed: int) -> DataFrame:
    """key, shot, example: for each item ``shots`` others, those of the next places in a seeded circle.

    Each item meets ``shots`` rows by an equality join; no item is compared with all others.
    """
    ranked = hash_rank(pool.select(key), key, seed, "_r")
    n = pool.count()
    if n <= shots:
        raise ValueError("more shots than other items")
    asked = ranked.select(F.col(key), F.explode(F.sequence(F.lit(1), F.lit(shots))).alias("shot"), "_r").withColumn("_r", (F.col("_r") + F.col("shot")) % n)
    return asked.join(ranked.select(F.col(key).alias("example"), "_r"), "_r").select(key, F.col("shot").cast("long").alias("shot"), "example")


def mersenne_shots(rows: DataFrame, ordinal: str, n: int, shots: int, seed: int = 1234) -> DataFrame:
    """Adds ``shots``: ordinals of others that a Mersenne Twister seeded by seed + ordinal samples from 0 to n - 1."""
    import pyarrow as pa

    def run(x: pa.Array) -> pa.Array:
        return pa.array([random.Random(seed + i).sample([j for j in range(n) if j != i], shots) for i in x.to_pylist()], pa.list_(pa.int64()))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return rows.withColumn("shots", F.arrow_udf(run, "array<long>")(F.col(ordinal)))


def bootstrap(values: DataFrame, group: str, ordinal: str, value: str, resamples: int, seed: int) -> DataFrame:
    """group, resample, mean_value: each resample draws as many ordinals (0 to n - 1 in the group) as there are, by hash."""
    sizes = values.groupBy(group).agg(F.count("*").alias("_n"))
    draws = values.select(group, F.col(ordinal).alias("_i")).join(sizes, group).select(group, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col("_i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = draws.select(group, "resample", (h % F.col("_n")).alias(ordinal))
    return drawn.join(values.select(group, ordinal, value), [group, ordinal]).groupBy(group, "resample").agg(F.avg(value).alias("mean_value"))


def oversampled(parts: list[tuple[DataFrame, int]], **options) -> DataFrame:
    """The mixture of tasks of which each comes in so many copies; copies of a task are tasks of their own."""
    return mixture([rows for rows, times in parts for _ in range(times)], **options)
