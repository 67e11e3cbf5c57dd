"""Evaluation aggregates: losses, accuracies, intervals, ablations, schedules and fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bits_per_byte(rows: DataFrame, group: list[str], nats: str, n_bytes: str) -> DataFrame:
    """Nats of tokens that have bytes, over their bytes, in bits; null where a group has no bytes."""
    kept = F.col(n_bytes) > 0
    sums = rows.groupBy(*group).agg(F.sum(F.when(kept, F.col(nats))).alias("_nats"), F.sum(F.when(kept, F.col(n_bytes)).otherwise(0)).cast("long").alias("bytes"))
    return sums.select(*group, "bytes", F.when(F.col("bytes") > 0, F.col("_nats") / (math.log(2) * F.col("bytes"))).alias("bpb"))


def centered(accuracy: Column, baseline: Column) -> Column:
    """Accuracy above chance: 0 at the baseline, 1 at perfect; both as fractions."""
    return (accuracy - baseline) / (1 - baseline)


def accuracy_by_task(rows: DataFrame, task: str, correct: str, baselines: DataFrame) -> DataFrame:
    """task, n, acc, centered; baselines: task and baseline, one row a task."""
    own = rows.groupBy(task).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return own.join(baselines, task).select(task, "n", "acc", centered(F.col("acc"), F.col("baseline")).alias("centered"))


def multiple_choice_answer(rows: DataFrame, item: list[str], choice: str, mean_loss: str) -> DataFrame:
    """The choice of least mean loss, the first of equals."""
    return rows.groupBy(*item).agg(F.min_by(choice, F.struct(mean_loss, choice)).alias("predicted"))


def pass_at_k(outcomes: DataFrame, item: str, attempt: str, correct: str, ks: list[int]) -> DataFrame:
    """k, passed, n, rate: items with a success among their first k attempts (attempt counts from 1)."""
    first = outcomes.where(F.col(correct)).groupBy(item).agg(F.min(attempt).alias("_first"))
    items = outcomes.select(item).distinct().join(first, item, "left")
    sums = items.agg(F.count("*").alias("n"), *[F.count_if(F.col("_first") <= k).alias(f"k{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("passed")) for k in ks]))
    return sums.select("n", rows.alias("r")).select("r.k", "r.passed", "n", (F.col("r.passed") / F.col("n")).alias("rate"))


def advantages(rewards: DataFrame, prompt: str, reward: str) -> DataFrame:
    """The reward less its mean over the prompt; the means are joined back, so one prompt may hold any share of rows."""
    means = rewards.groupBy(prompt).agg(F.avg(reward).alias("_mean"))
    return rewards.join(means, prompt).withColumn("advantage", F.col(reward) - F.col("_mean")).drop("_mean")


def hits_and_loss(scores: Column, target: Column, ks: list[int]) -> dict[str, Column]:
    """Whether the target's score is among the k highest (equal scores rank by place), and its cross entropy."""
    own = F.element_at(scores, target + 1)
    above = F.size(F.filter(scores, lambda x: x > own)) + F.size(F.filter(F.transform(scores, lambda x, i: (x == own) & (i < target)), lambda b: b))
    top = F.array_max(scores)
    log_sum = top + F.log(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return {**{f"top{k}": (above < k).cast("int") for k in ks}, "ce": log_sum - own}


def in_groups(rows: DataFrame, opener: str, metrics: list[str]) -> DataFrame:
    """grp (all, opener, interior), n and the metrics' means."""
    groups = F.explode(F.array(F.lit("all"), F.when(F.col(opener), "opener").otherwise("interior")))
    return rows.withColumn("grp", groups).groupBy("grp").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def length_bucket(length: Column, cap: int = 10) -> Column:
    return F.when(length < cap, length.cast("string")).otherwise(f"{cap}+")


def paired_deltas(rows: DataFrame, bucket: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """bucket (and ``all``), n, and the mean of variant less intact for each named pair (intact, variant)."""
    both = rows.withColumn("bucket", F.explode(F.array(F.lit("all"), F.col(bucket).cast("string"))))
    return both.groupBy("bucket").agg(F.count("*").alias("n"), *[F.avg(F.col(b) - F.col(a)).alias(name) for name, (a, b) in pairs.items()])


def win_rates(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean of each, share of equal, a alone right, b alone right; zeros for no rows."""
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    x, y = F.col(a) == 1, F.col(b) == 1
    return rows.agg(F.count("*").alias("n"), rate(x).alias("acc_a"), rate(y).alias("acc_b"), rate(x == y).alias("same"), rate(x & ~y).alias("a_wins"), rate(~x & y).alias("b_wins"))


def set_recovery(scores: Column, members: Column) -> dict[str, Column]:
    """m (distinct members), tp (members among the m highest scores; equal scores rank by place) and exact."""
    wanted = F.array_distinct(members)
    ranked = F.transform(F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), lambda r: r["i"])
    tp = F.size(F.array_intersect(F.slice(ranked, F.lit(1), F.size(wanted)), wanted))
    return {"m": F.size(wanted), "tp": tp, "exact": (tp == F.size(wanted)).cast("int")}


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def early_stopping(rows: DataFrame, key: str, order: str, loss: str, patience: int, min_delta: float) -> DataFrame:
    """One row per key: best loss and its step, steps seen, and the step at which patience ran out (null: never).

    min_delta makes the best depend on the path, so each key's losses are folded in order; a key is one run.
    """
    runs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(loss).alias("x")))).alias("xs"))
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(-1).alias("best_step"), F.lit(0).alias("since"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("stopped"))

    def fold(s: Column, r: Column) -> Column:
        x = r["x"]
        usable = x.isNotNull() & ~F.isnan(x)
        better = usable & (s["best"].isNull() | (x < s["best"] - min_delta))
        step = s["step"] + 1
        since = F.when(better, 0).when(usable, s["since"] + 1).otherwise(s["since"])
        moved = F.struct(F.when(better, x).otherwise(s["best"]).alias("best"), F.when(better, step).otherwise(s["best_step"]).alias("best_step"), since.alias("since"), step.alias("step"), F.when(since >= patience, step).alias("stopped"))
        return F.when(s["stopped"].isNotNull(), s).otherwise(moved)

    return runs.select(key, F.aggregate("xs", zero, fold).alias("s")).select(key, F.col("s.best").alias("best"), F.col("s.best_step").cast("long").alias("best_step"), F.col("s.stopped").cast("long").alias("stopped_at"))


def debiased_ema(rows: DataFrame, key: str, order: str, value: str, beta: float) -> DataFrame:
    """The exponential mean of each key's values in order, divided by the weight seen so far; the last one."""
    runs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x")))).alias("xs"))
    total = F.aggregate("xs", F.lit(0.0), lambda a, r: F.lit(beta) * a + F.lit(1 - beta) * r["x"])
    return runs.select(key, F.size("xs").cast("long").alias("n"), (total / (1 - F.pow(F.lit(beta), F.size("xs")))).alias("ema"))


def lr_multiplier(it: Column, warmup: int, warmdown: int, total: int, final: float) -> Column:
    """Linear warm-up, flat, linear warm-down to ``final``."""
    left = (F.lit(total) - it) / max(warmdown, 1)
    return F.when(it < warmup, (it + 1) / max(warmup, 1)).when(it <= total - warmdown, F.lit(1.0)).otherwise(left + (1 - left) * final)


def momentum(it: Column, warmdown: int, total: int, first: float = 0.85, top: float = 0.97, last: float = 0.90, warmup: int = 400) -> Column:
    start = total - warmdown
    done = (it - start) / max(warmdown, 1)
    return F.when(it < warmup, (1 - it / warmup) * first + it / warmup * top).when(it >= start, top * (1 - done) + last * done).otherwise(F.lit(top))


def cosine_decay(it: Column, total: int, scale: float = 1.0) -> Column:
    return F.lit(scale * 0.5) * (1 + F.cos(F.lit(math.pi) * it / total))


def batch_size(tokens: Column, tokens_ref: float, batch_ref: float, power: float = 0.383) -> Column:
    """The power of two nearest to the batch size that grows as a power of the training tokens."""
    return F.pow(F.lit(2.0), F.bround(F.log2(F.lit(batch_ref) * F.pow(tokens / tokens_ref, F.lit(power)))))


def power_law(rows: DataFrame, group: list[str], x: Column, y: Column) -> DataFrame:
    """slope and intercept of log y over log x, and n, of rows where both are positive."""
    kept = rows.where((x > 0) & (y > 0)).select(*group, F.log(x).alias("_x"), F.log(y).alias("_y"))
    return kept.groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))


def parabola_vertex(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Least squares of a parabola by its sums: vertex_x; where it doesn't open upward, the x of least y."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = {f"x{k}": F.sum(F.pow(a, F.lit(k))) for k in range(5)} | {f"y{k}": F.sum(F.pow(a, F.lit(k)) * b) for k in range(3)}
    sums = rows.groupBy(*group).agg(*[c.alias(n) for n, c in s.items()], F.min_by(a, F.struct(b, a)).alias("least"))
    c = F.col

    def det(m: list[list[str]]) -> Column:
        (p, q, r), (t, u, v), (w, z, k) = [[c(e) for e in row] for row in m]
        return p * (u * k - v * z) - q * (t * k - v * w) + r * (t * z - u * w)

    rows3 = [["x0", "x1", "x2"], ["x1", "x2", "x3"], ["x2", "x3", "x4"]]
    replaced = lambda i: [[f"y{k}" if j == i else e for j, e in enumerate(row)] for k, row in enumerate(rows3)]
    d, linear, square = det(rows3), det(replaced(1)), det(replaced(2))
    opens = (d != 0) & (square / d > 0)
    return sums.select(*group, F.when(opens, -linear / (2 * square)).otherwise(c("least")).alias("vertex_x"))


def upper_median(values: str) -> Column:
    """The middle value, the upper one of two."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def inference_report(rows: DataFrame, group: list[str], seconds: str, tokens: str, n_bytes: float, flops: float, peak_bytes: float, peak_flops: float) -> DataFrame:
    """Median seconds a token, tokens a second, and shares of the machine's bandwidth and arithmetic that they use."""
    per_token = rows.select(*group, (F.col(seconds) / F.col(tokens)).alias("_t"))
    out = per_token.groupBy(*group).agg(upper_median("_t").alias("tpot"))
    return out.select(*group, "tpot", (1 / F.col("tpot")).alias("tok_s"), (F.lit(n_bytes / peak_bytes) / F.col("tpot")).alias("mbu"), (F.lit(flops / peak_flops) / F.col("tpot")).alias("mfu"))


def last_by(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The last value of each group: what remains of a log."""
    return rows.groupBy(*group).agg(F.max_by(value, order).alias(value))


def first_best(rows: DataFrame, group: list[str], choice: str, score: str) -> DataFrame:
    """The choice of the highest score, the first of equals."""
    return rows.groupBy(*group).agg(F.min_by(choice, F.struct(-F.col(score), choice)).alias(choice), F.max(score).alias(score))


def moving_rate(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    return rows.withColumn("rate", F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - width, 0)))


def flops_per_token(parameters: Column, embedding: Column, layers: Column, heads: Column, head_dim: Column, length: Column) -> Column:
    """Training arithmetic of a transformer: six for each weight in a product, and attention over the length."""
    return 6 * (parameters - embedding) + 12 * layers * heads * head_dim * length


def cache_bytes(layers: Column, kv_heads: Column, head_dim: Column, length: Column, width: int = 2) -> Column:
    """Bytes of keys and values of one sequence."""
    return 2 * layers * kv_heads * head_dim * length * width


def training_rates(rows: DataFrame, seconds: str, tokens: str, flops: str, peak_flops: float, step: str, last_step: int) -> DataFrame:
    """Adds tok_s, the share of the machine's arithmetic, and the seconds left."""
    rate = F.col(tokens) / F.col(seconds)
    return rows.withColumn("tok_s", rate).withColumn("mfu", F.col(flops) * rate / peak_flops).withColumn("eta", (F.lit(last_step) - F.col(step)) * F.col(seconds))


def ridge(rows: DataFrame, xs: list[str], y: str, strength: float = 0.0) -> dict[str, float]:
    """Coefficients, intercept and r2 of a least-squares fit with a penalty on the coefficients.

    One pass sums the products; only these sums, as many as pairs of columns, go to the driver.
    """
    import numpy as np

    names = [*xs, y]
    cols = [F.col(c).cast("double") for c in names]
    n, *sums = rows.dropna(subset=names).agg(F.count("*"), *[F.sum(c) for c in cols], *[F.sum(a * b) for a in cols for b in cols]).first()
    mean = np.array(sums[: len(cols)], float) / n
    products = np.array(sums[len(cols) :], float).reshape(len(cols), -1) / n - np.outer(mean, mean)
    k = len(xs)
    weights = np.linalg.solve(products[:k, :k] + strength / n * np.eye(k), products[:k, k])
    left = products[k, k] - 2 * weights @ products[:k, k] + weights @ products[:k, :k] @ weights
    return {**dict(zip(xs, weights.tolist(), strict=True)), "intercept": float(mean[k] - weights @ mean[:k]), "r2": float(1 - left / products[k, k]) if products[k, k] else 0.0}


def gate(rows: DataFrame, score: str, order: str, least: float) -> dict:
    """The best row by score, the first of equals, and whether it passes."""
    best = rows.orderBy(F.desc(score), order).first()
    return {"best": best.asDict() if best else None, "passed": bool(best and best[score] >= least)}
