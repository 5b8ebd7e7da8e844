"""Deterministic sampling, mixing and assignment.

Every choice comes from a hash of an identifier, so it does not depend on partitioning, order or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.chat import TASKS
from voxloom.operators.ranking import seeded, with_group_position, with_position


def weighted_task(available: Column, fraction: Column, weights: dict[str, float]) -> Column:
    """First task, in fixed order, whose cumulative weight exceeds ``fraction`` of the weight available.

    Missing weights count 1, negative ones 0; null where no available task has weight.
    """
    weight = {t: max(0.0, float(weights.get(t, 1.0))) for t in TASKS}
    has = {t: F.array_contains(available, t) for t in TASKS}
    share = {t: F.when(has[t], weight[t]).otherwise(0.0) for t in TASKS}
    total = sum(share.values(), F.lit(0.0))
    upto, pick, last = F.lit(0.0), None, F.lit(None).cast("string")
    for t in TASKS:
        upto = upto + share[t]
        hit = has[t] & (F.lit(weight[t]) > 0) & (upto > fraction * total)
        pick = F.when(hit, t) if pick is None else pick.when(hit, t)
        last = F.when(has[t], t).otherwise(last)
    return F.when(total > 0, F.coalesce(pick.otherwise(None), last))


def source_by_weight(fraction: Column, weights: dict[str, float]) -> Column:
    """Source whose stretch of the cumulative weights holds ``fraction`` (names in sorted order)."""
    total, upto, out = sum(weights.values()), 0.0, None
    names = sorted(n for n, w in weights.items() if w > 0)
    if not names or total <= 0:
        raise ValueError("weights must hold a positive value")
    for name in names[:-1]:
        upto += weights[name] / total
        out = F.when(fraction < upto, name) if out is None else out.when(fraction < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with their position in a seeded shuffle (a range exchange; no task holds more than its range)."""
    return with_position(rows.withColumn("__u", seeded(F.col(key), seed)), "__u", key).drop("__u")


def ratio_rows(rows: DataFrame, groups: list[str], order: str, ratio: Column, most: int | None = None) -> DataFrame:
    """The first floor(n * ratio) rows of each group in order, repeated from the start beyond n; adds copy (from 0)."""
    placed = with_group_position(rows.withColumn("__ratio", ratio), groups, order)
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    placed = placed.join(sizes, on=same)
    wanted = F.floor(F.col("__n") * F.col("__ratio"))
    wanted = F.least(wanted, F.lit(most)) if most is not None else wanted
    copies = F.floor(wanted / F.col("__n")) + F.when(F.col("position") < wanted % F.col("__n"), 1).otherwise(0)
    out = placed.withColumn("__copies", copies.cast("int")).where("__copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    return out.drop("__ratio", "__n", "__copies", *[f"__g{i}" for i in range(len(groups))])


def shard_ratio(shards: DataFrame, groups: list[str], url: str, position: str, ratio: Column, seed: int) -> DataFrame:
    """Shards of each group by ratio: at least one; below 1 a seeded subset, above 1 whole copies and a seeded rest.

    Repeated urls keep their first position.  Output holds copy (from 0) and the input position.
    """
    unique = shards.withColumn("__ratio", ratio).groupBy(*groups, url).agg(F.min(position).alias(position), F.min("__ratio").alias("__ratio"))
    ranked = with_group_position(unique.withColumn("__u", seeded(F.col(url), seed)), groups, "__u", url, name="__rank")
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ranked.join(sizes, on=[F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)])
    wanted = F.greatest(F.lit(1), F.floor(F.col("__n") * F.col("__ratio")))
    copies = F.floor(wanted / F.col("__n")) + F.when(F.col("__rank") < wanted % F.col("__n"), 1).otherwise(0)
    out = ranked.withColumn("__copies", copies.cast("int")).where("__copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    return out.drop("__ratio", "__u", "__rank", "__n", "__copies", *[f"__g{i}" for i in range(len(groups))])


def round_robin(rows: DataFrame, order: str, consumers: int, padded: bool = False) -> DataFrame:
    """Adds consumer and slot: position p goes to p % consumers; padded repeats the first rows to equal shares."""
    if consumers < 1:
        raise ValueError("consumers must be positive")
    placed = with_position(rows, order)
    if padded:
        n = placed.count()
        missing = -n % consumers if n else 0
        # at most consumers - 1 extra rows; a list shorter than that is repeated as often as needed
        places = F.filter(F.sequence(F.lit(n), F.lit(n + max(missing, 1) - 1)), lambda p: (p % max(n, 1) == F.col("position")) & F.lit(missing > 0))
        placed = placed.withColumn("position", F.explode(F.concat(F.array("position"), places.cast("array<bigint>"))))
    return placed.withColumn("consumer", (F.col("position") % consumers).cast("int")).withColumn("slot", F.floor(F.col("position") / consumers))


def rank_slice(rows: DataFrame, order: str, rank: int, world: int) -> DataFrame:
    """Rows of one rank out of the longest prefix whose length is a multiple of ``world``."""
    placed = with_position(rows, order)
    n = placed.count()
    return placed.where((F.col("position") < n - n % world) & (F.col("position") % world == rank))


def evict_oldest(files: DataFrame, size: str, touched: str, key: str, cap: int) -> DataFrame:
    """Files that leave, oldest first, until the rest fits ``cap``: those younger files and they themselves exceed it."""
    from pyspark.sql import Window

    placed = with_position(files, F.col(touched).desc(), F.col(key).desc())
    block = F.floor(F.col("position") / 4096)
    placed = placed.withColumn("__block", block)
    blocks = placed.groupBy("__block").agg(F.sum(size).alias("__held"))
    before = F.coalesce(F.sum("__held").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(blocks.select("__block", before.alias("__before")), "__block")
    inside = F.sum(size).over(Window.partitionBy("__block").orderBy("position"))
    return placed.withColumn("upto", F.col("__before") + inside).where(F.col("upto") > cap).drop("__block", "__before", "position")


def rotated_option(options: Column, draw: Column, rank: Column) -> Column:
    """One option for all, moved on by rank: ``draw`` is a shared whole number."""
    return F.try_element_at(options, (F.pmod(draw + rank, F.nullif(F.size(options), F.lit(0))) + 1).cast("int"))


def consumer_plan(shards: DataFrame, url: str, mode: str, consumers: int, seed: int, epoch: int, draws: int = 0, shuffle: bool = True) -> DataFrame:
    """``(consumer, slot, url)``: which shard each consumer opens in which order.

    finite_exact never repeats a shard, finite_padded repeats the head to equal shares, resampled draws ``draws`` shards
    for each consumer with repetition.  The choice hangs on seed, epoch and consumer only.
    """
    if mode not in ("finite_exact", "finite_padded", "resampled"):
        raise ValueError(f"unknown mode {mode}")
    names = shards.select(F.col(url).alias("url")).where("url is not null").distinct()
    if mode != "resampled":
        order = names.withColumn("__u", seeded(F.col("url"), f"{seed}:{epoch}") if shuffle else F.lit(0.0)).withColumn("__o", F.struct("__u", "url"))
        return round_robin(order, "__o", consumers, padded=mode == "finite_padded").select("consumer", "slot", "url")
    placed = with_position(names, "url")
    n = placed.count()
    slots = shards.sparkSession.range(consumers * draws).select((F.col("id") % consumers).cast("int").alias("consumer"), F.floor(F.col("id") / consumers).alias("slot"))
    key = F.concat_ws(":", F.lit(epoch).cast("string"), "consumer", "slot")
    return slots.withColumn("position", F.floor(seeded(key, seed) * n)).join(placed, "position").select("consumer", "slot", "url")


def window_shuffle(rows: DataFrame, groups: list[str], order: list[str], key: str, size: int, seed: int) -> DataFrame:
    """Adds place: rows in ``order``, shuffled by hash inside every window of ``size`` positions of their group."""
    placed = with_group_position(rows, groups, *order).withColumn("__window", F.floor(F.col("position") / size)).drop("position")
    shuffled = placed.withColumn("__u", seeded(F.col(key), seed))
    # windows are bounded, so a window function over one of them is too
    inside = F.row_number().over(Window.partitionBy(*groups, "__window").orderBy("__u", key)) - 1
    return shuffled.withColumn("place", F.col("__window") * size + inside).drop("__window", "__u")


def next_token(rows: DataFrame, group: str, key: str, logit: str, temperature: float = 1.0, k: int = 0, p: float = 1.0, seed: int = 0, greedy: bool = False) -> DataFrame:
    """``(group, key)``: one key drawn for each group from its logits, or the likeliest one.

    Logits are divided by the temperature, cut to the k largest (ties with the k-th stay), then to the likeliest keys up to and
    with the one that crosses the share p; the draw compares a hash of the group with the cumulated shares.
    """
    own = F.col(logit) / temperature if temperature > 0 and temperature != 1.0 else F.col(logit).cast("double")
    per = Window.partitionBy(group)
    ordered = per.orderBy(F.desc("__l"), key)
    rows = rows.select(group, key, own.alias("__l"))
    if k > 0:
        rows = rows.withColumn("__r", F.rank().over(per.orderBy(F.desc("__l")))).where(F.col("__r") <= k).drop("__r")
    if greedy:
        return rows.withColumn("__r", F.row_number().over(ordered)).where("__r = 1").select(group, key)
    rows = rows.withColumn("__w", F.exp(F.col("__l") - F.max("__l").over(per)))
    before = F.coalesce(F.sum("__w").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("__before", before).withColumn("__all", F.sum("__w").over(per))
    rows = rows.where(F.col("__before") <= p * F.col("__all")) if p < 1.0 else rows
    aim = seeded(F.col(group), seed) * F.sum("__w").over(per)
    return rows.withColumn("__hit", F.col("__before") <= aim).where("__hit").groupBy(group).agg(F.max_by(key, "__before").alias(key))
