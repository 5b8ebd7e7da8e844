"""Positions in a total order without a single-task window.

Spark's ``row_number() over (order by ...)`` moves everything into one task.  Here rows are range-partitioned by the sort
key, numbered locally, and shifted by the number of rows in earlier partitions: one range exchange, every task bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import cut_lineage


def seeded(key: Column, seed: int | str = 0) -> Column:
    """A fraction in [0, 1) from sha-256 of ``seed:key``; the same in any SQL engine with sha-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_position(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the 0-based position of every row in ``order`` (make it total; ties fall as they come)."""
    spread = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    # one row per partition
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return spread.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def with_group_position(rows: DataFrame, groups: list[str], *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the 0-based position of every row within its group; a group may span any number of tasks.

    Null group keys form one group.
    """
    placed = with_position(rows, *groups, *order, name="__global")
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    first = placed.groupBy(*keys).agg(F.min("__global").alias("__first"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    joined = placed.join(first, on=same, how="inner")
    return joined.withColumn(name, F.col("__global") - F.col("__first")).drop("__global", "__first", *[f"__g{i}" for i in range(len(groups))])
