"""Counters, ratios and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAIT_STEPS = (50, 100, 500, 1000)


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def ratio_null(a: Column, b: Column) -> Column:
    """a / b, null where b is not positive."""
    return F.when(b > 0, a / b)


def stream_metrics(batches: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Batches, sizes, costs and padding ratio of ``(size, padded, unpadded)`` rows."""
    padded, unpadded, size, n = F.sum("padded"), F.sum("unpadded"), F.sum("size"), F.count(F.lit(1))
    made = (
        n.alias("batches"), size.alias("samples"), padded.alias("padded_cost"), unpadded.alias("unpadded_cost"),
        F.when(F.coalesce(padded, F.lit(0)) == 0, 0.0).otherwise(1 - unpadded / padded).alias("padding_ratio"),
        ratio0(size, n).alias("mean_size"), ratio0(padded, n).alias("mean_cost"), F.max("size").alias("max_size"),
    )
    return batches.groupBy(*groups).agg(*made) if groups else batches.agg(*made)


def wait_histogram(rows: DataFrame, wait: str, groups: list[str]) -> DataFrame:
    """Number of waits, those that reach each step, the mean and the largest; NaN and null waits do not count."""
    x = F.when(~F.isnan(wait), F.col(wait))
    steps = [F.count_if(x >= s).alias(f"over_{s}") for s in WAIT_STEPS]
    return rows.groupBy(*groups).agg(F.count(x).alias("waits"), *steps, F.avg(x).alias("mean_wait"), F.max(x).alias("max_wait"))


def weighted_mean(rows: DataFrame, value: str, weight: str, groups: list[str]) -> DataFrame:
    """Ratio of sums over rows with finite values, null without weight; with the number of rows used and seen."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    used = F.when(ok, F.col(weight))
    return rows.groupBy(*groups).agg(
        ratio_null(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(used)).alias("mean"), F.count(used).alias("finite"), F.count(F.lit(1)).alias("seen")
    )


def weighted_loss(value: Column, weight: Column, eps: float = 1e-8) -> Column:
    """Aggregate: weighted mean with the weights' sum held above ``eps``."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(eps))


def task_losses(rows: DataFrame, task: str, component: str, value: str) -> DataFrame:
    """Sum, count and mean by task and component; the task total is the sum of its component means."""
    parts = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(task, component).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    parts = parts.withColumn("mean", F.col("total") / F.col("n"))
    return parts.withColumn("task_total", F.sum("mean").over(Window.partitionBy(task)))


def normalized_losses(rows: DataFrame, step: str, loss: str, count: str, world: str) -> DataFrame:
    """Adds normalized = loss * world / tokens of the step."""
    tokens = F.sum(count).over(Window.partitionBy(step))
    return rows.withColumn("normalized", F.col(loss) * F.col(world) / F.nullif(tokens, F.lit(0)))


def rejected_steps(rows: DataFrame, step: str, loss: str, most: float = 6.0, after: int = 30_000) -> DataFrame:
    """Rows of the steps that stay: none of their losses is missing or not finite, nor over ``most`` after step ``after``.

    The bad steps are found by an aggregate, so a step with many ranks needs no window.
    """
    bad = F.col(loss).isNull() | F.isnan(loss) | (F.abs(F.col(loss)) == float("inf")) | ((F.col(step) > after) & (F.col(loss) > most))
    out = rows.where(bad).select(step).distinct()
    return rows.join(out, step, "left_anti")


def running_total(rows: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    return rows.withColumn("total", F.sum(value).over(Window.partitionBy(*groups).orderBy(order)))


def error_rollup(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("errors"), F.count(F.when(F.col("member").isNotNull(), 1)).alias("with_member"), F.max(F.length("detail")).alias("longest_detail")
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; new values win, also where they are null; old rows without a new one stay."""
    o = old.select(F.col(key), F.struct("*").alias("__old"))
    n = new.select(F.col(key), F.struct("*").alias("__new"))
    both = o.join(n, key, "full")
    return both.select(key, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in new.columns if c != key])


def key_diff(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """missing, unexpected and mismatched keys of two tables."""
    both = expected.select(key, F.col(value).alias("__e"), F.lit(1).alias("__a")).join(found.select(key, F.col(value).alias("__f"), F.lit(1).alias("__b")), key, "full")
    kind = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(~F.col("__e").eqNullSafe(F.col("__f")), "mismatch")
    return both.select(key, kind.alias("kind")).where("kind is not null")
