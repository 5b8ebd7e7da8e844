"""Batches: length buckets, cost-bounded folds, packing offsets, padding.

A fold over a sequence is sequential by nature, so it runs inside pools of bounded size.  A pool is a hash bucket of its
group; the number of buckets follows the group's size, so a group that holds a third of all rows becomes many pools.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from voxloom.functions.lengths import LENGTH_FIELDS
from voxloom.operators.ranking import seeded, with_group_position
from voxloom.plans.config import BatchLimits

POOL_ROWS = 2048


def with_pool(rows: DataFrame, group: str, key: str, pool_rows: int = POOL_ROWS, seed: int = 0) -> DataFrame:
    """Adds pool: rows of a group fall by hash into ceil(n / pool_rows) pools; a null group is a group."""
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.ceil(F.count(F.lit(1)) / pool_rows).cast("int").alias("__pools"))
    joined = rows.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn("pool", F.floor(seeded(F.col(key), seed) * F.col("__pools")).cast("int")).drop("__g", "__pools")


def length_buckets(rows: DataFrame, group: str, key: str, total: str, chunk: int, pool_rows: int = POOL_ROWS, seed: int = 0) -> DataFrame:
    """Adds pool, chunk and place: pools sorted by length, cut into chunks of similar length, chunks in seeded order."""
    pooled = with_pool(rows, group, key, pool_rows, seed)
    number = F.row_number().over(Window.partitionBy(group, "pool").orderBy(total, key)) - 1
    pooled = pooled.withColumn("chunk", F.floor(number / chunk).cast("int"))
    place = F.row_number().over(Window.partitionBy(group, "pool", "chunk").orderBy(seeded(F.col(key), seed + 1), F.col(key))) - 1
    return pooled.withColumn("place", place)


class GreedyFold:
    """Batch number of one row after the other; None for a dropped oversized row.

    The cost of a batch is its rows times the sum of the largest value of each field.  The state is one open batch.
    """

    def __init__(self, limits: BatchLimits):
        self.limits, self.number, self.held, self.widest = limits, 0, 0, None

    def place(self, cost: tuple[int, ...]) -> int | None:
        limits = self.limits
        if limits.max_cost is not None and sum(cost) > limits.max_cost:
            if limits.oversized_sample == "drop":
                return None
            alone = self.number + (self.held > 0)
            self.number, self.held, self.widest = alone + 1, 0, None
            return alone
        grown = tuple(map(max, self.widest, cost)) if self.widest else cost
        over = limits.max_cost is not None and (self.held + 1) * sum(grown) > limits.max_cost
        if self.held and (over or (limits.max_samples is not None and self.held + 1 > limits.max_samples)):
            self.number, self.held, grown = self.number + 1, 0, cost
        self.held, self.widest = self.held + 1, grown
        return self.number


class BudgetFold:
    """Batch numbers under an additive budget: a batch closes on overflow or size, but not below a fifth of max_rows."""

    def __init__(self, max_tokens: int, max_rows: int):
        self.max_tokens, self.max_rows, self.number, self.held, self.total = max_tokens, max_rows, 0, 0, 0

    def place(self, cost: tuple[int]) -> int:
        n = cost[0]
        full = self.total + n > self.max_tokens or self.held >= self.max_rows
        if self.held and full and self.held >= self.max_rows // 5:
            self.number, self.held, self.total = self.number + 1, 0, 0
        self.held, self.total = self.held + 1, self.total + n
        return self.number


def fold_greedy(costs: list[tuple[int, ...]], limits: BatchLimits) -> list[int | None]:
    fold = GreedyFold(limits)
    return [fold.place(cost) for cost in costs]


def fold_budget(tokens: list[int], max_tokens: int, max_rows: int) -> list[int]:
    fold = BudgetFold(max_tokens, max_rows)
    return [fold.place((n,)) for n in tokens]


def fold_rows(rows: DataFrame, groups: list[str], order: list[str], fields: list[str], start: Callable[[], GreedyFold | BudgetFold]) -> DataFrame:
    """Adds batch by a fold over each group in order; rows without a batch leave.

    Groups lie sorted in their partitions and stream through the fold, so neither a large group nor millions of small ones
    are ever held: the state is that of one open batch.
    """
    schema = rows.select("*").schema.add("batch", IntegerType())
    sorted_ = rows.repartition(*groups).sortWithinPartitions(*groups, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now = None, None
        for batch in batches:
            keys = zip(*[batch.column(g).to_pylist() for g in groups])
            costs = zip(*[batch.column(f).to_pylist() for f in fields])
            numbers = []
            for key, cost in zip(keys, costs):
                if fold is None or key != now:
                    fold, now = start(), key
                numbers.append(fold.place(cost))
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "batch"])
            yield made.filter(pc.is_valid(made.column("batch")))

    return sorted_.mapInArrow(run, schema)


def greedy_batches(rows: DataFrame, groups: list[str], order: list[str], fields: list[str], limits: BatchLimits) -> DataFrame:
    """Adds batch: greedy batches within each group in order; dropped rows leave.  Lengths must not be null."""
    return fold_rows(rows, groups, order, fields, lambda: GreedyFold(limits))


def token_budget_batches(rows: DataFrame, groups: list[str], order: list[str], tokens: str, max_tokens: int, max_rows: int) -> DataFrame:
    """Adds batch: token-budget batches within each group in order.  A row over the budget stays, alone or not."""
    if max_rows < 1 or max_tokens < 1:
        raise ValueError("budgets must be positive")
    return fold_rows(rows, groups, order, [tokens], lambda: BudgetFold(max_tokens, max_rows))


def batch_costs(rows: DataFrame, keys: list[str], fields: list[str] = list(LENGTH_FIELDS)) -> DataFrame:
    """Size, padded and unpadded cost of each batch."""
    widest = sum((F.max(f).cast("long") for f in fields[1:]), F.max(fields[0]).cast("long"))
    plain = sum((F.sum(f).cast("long") for f in fields[1:]), F.sum(fields[0]).cast("long"))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("size"), (n * widest).alias("padded"), plain.alias("unpadded"))


def keep_full(batches: DataFrame, keys: list[str], limits: BatchLimits) -> DataFrame:
    """Drop-last rule: batches below min_samples leave, or below max_samples where there is no cost limit."""
    least = limits.min_samples if limits.max_cost is not None else (limits.max_samples or 1)
    return batches.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")


def pack_offsets(rows: DataFrame, groups: list[str], order: str, length: str) -> DataFrame:
    """Adds offset: where each row begins in the concatenation of its batch."""
    before = F.sum(length).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)))


def pad_left(tokens: Column, width: Column, pad: Column) -> Column:
    return F.concat(F.array_repeat(pad, F.greatest(F.lit(0), width - F.size(tokens))), tokens)


def pad_right(tokens: Column, width: Column, pad: Column) -> Column:
    return F.concat(tokens, F.array_repeat(pad, F.greatest(F.lit(0), width - F.size(tokens))))


def pad_batch(rows: DataFrame, groups: list[str], user: str, assistant: str, pad: int = 0) -> DataFrame:
    """User tokens padded on the left and assistant tokens on the right to the width of the batch, with masks."""
    per = Window.partitionBy(*groups)
    widths = rows.withColumn("__u", F.max(F.size(user)).over(per)).withColumn("__a", F.max(F.size(assistant)).over(per))
    zero, one = F.lit(0), F.lit(1)
    return widths.withColumns(
        {
            "user_mask": pad_left(F.transform(user, lambda x: one), F.col("__u"), zero),
            "assistant_mask": pad_right(F.transform(assistant, lambda x: one), F.col("__a"), zero),
            user: pad_left(F.col(user), F.col("__u"), F.lit(pad)),
            assistant: pad_right(F.col(assistant), F.col("__a"), F.lit(pad)),
        }
    ).drop("__u", "__a")


def ordered_chunks(rows: DataFrame, groups: list[str], order: str, size: int) -> DataFrame:
    """Adds batch: consecutive runs of ``size`` rows of each group; groups of any size (range exchange)."""
    return with_group_position(rows, groups, order).withColumn("batch", F.floor(F.col("position") / size)).drop("position")


def top_p(rows: DataFrame, group: str, weight: str, key: str, share: float) -> DataFrame:
    """Nucleus: the likeliest keys of each group up to and with the one that crosses ``share``."""
    per = Window.partitionBy(group)
    ordered = per.orderBy(F.desc(weight), key)
    p = F.col(weight) / F.sum(weight).over(per)
    before = F.coalesce(F.sum("p").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("p", p).withColumn("before", before).where(F.col("before") <= share).drop("before")


def top_k(rows: DataFrame, group: str, weight: str, key: str, k: int) -> DataFrame:
    """The k largest of each group; the rank filter is pushed below the exchange by Spark's window group limit."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)




class BlockFold:
    """Blocks of at most ``rows`` rows and ``size`` bytes; a larger row is a block of its own."""

    def __init__(self, rows: int, size: int | None):
        self.rows, self.size, self.number, self.held, self.total = rows, size, -1, rows, 0

    def place(self, cost: tuple) -> int:
        over = self.size is not None and self.total + cost[0] > self.size
        if self.held >= self.rows or over:
            self.number, self.held, self.total = self.number + 1, 0, 0
        self.held, self.total = self.held + 1, self.total + cost[0]
        return self.number


def bounded_shuffle(rows: DataFrame, groups: list[str], order: list[str], key: str, size: str, max_rows: int, max_bytes: int | None, seed: int) -> DataFrame:
    """Adds batch and place: rows shuffled by hash inside blocks that a buffer of so many rows and bytes can hold.

    A row larger than the buffer passes alone in its place.
    """
    if max_rows < 1 or (max_bytes is not None and max_bytes < 1):
        raise ValueError("the bounds of a shuffle must be positive")
    blocks = fold_rows(rows, groups, order, [size], lambda: BlockFold(max_rows, max_bytes))
    place = F.row_number().over(Window.partitionBy(*groups, "batch").orderBy(seeded(F.col(key), seed), key)) - 1
    return blocks.withColumn("place", place)


def fold_refill(costs: list[tuple], sound: list[bool], limits: BatchLimits, most_errors: int = 32) -> list[int | None]:
    """Batch of every row of a queue whose rows may fail to decode; None for failed rows.

    A batch is formed as if all rows were sound.  A row that fails is replaced by the next of the queue, as long as the
    padded cost allows it; then the next batch is formed from what is left.
    """
    out: list[int | None] = [None] * len(costs)
    at, number, errors = 0, 0, 0

    def cost(some: list[int]) -> int:
        return len(some) * sum(max(costs[i][f] for i in some) for f in range(len(costs[0])))

    while at < len(costs):
        fold, begin = GreedyFold(limits), at
        while at < len(costs) and fold.place(costs[at]) in (0, None):
            at += 1
        target, kept, queue = at - begin, [], list(range(begin, at))
        while len(kept) < target:
            if queue:
                i = queue.pop(0)
            elif at < len(costs) and (limits.max_cost is None or cost([*kept, at]) <= limits.max_cost):
                i, at = at, at + 1
            else:
                break
            errors = 0 if sound[i] else errors + 1
            if errors >= most_errors:
                raise RuntimeError("too many rows in a row could not be decoded")
            if sound[i]:
                kept.append(i)
                out[i] = number
        number += bool(kept)
    return out


def refilled_batches(rows: DataFrame, groups: list[str], order: list[str], fields: list[str], sound: str, limits: BatchLimits) -> DataFrame:
    """Adds batch: see ``fold_refill``; groups are pools of bounded size, rows that could not be decoded leave."""
    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", batch int"

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(order, kind="stable")
        placed = fold_refill(list(pool[fields].astype("int64").itertuples(index=False, name=None)), pool[sound].tolist(), limits)
        pool = pool.assign(batch=pd.array(placed, dtype="Int32"))
        return pool[pool["batch"].notna()].astype({"batch": "int32"})

    return rows.groupBy(*groups).applyInPandas(fold, schema)
