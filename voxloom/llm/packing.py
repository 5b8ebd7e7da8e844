"""Filling fixed-capacity batches with items of varying length.

Method: hierarchical multi-length packing.  Lengths are routed to context-size tiers: the capacity and its halves down to
1/32.  Tiers are packed from long to short.  Items of a tier first fill the gaps that longer tiers left in batches (the
smallest gap that takes them); what is left of the tier is packed alone, largest first, into windows of the tier's own
context size; and the windows, by their load, are combined into batches of the capacity, whose pooled gaps wait for the
shorter tiers.  Batches are then dealt to step groups in rows of descending cost, the sum of the squared lengths (what
attention costs); each row runs over the steps in the direction that evens out what they already hold.

The plan works on the *histogram* of lengths, never on the items: equal lengths are placed as a run, so planning costs the
number of distinct lengths (bounded by the longest item), not of rows.  Items get a dense rank within their length by a
salted two-level count, and a narrow stage turns (length, rank) into batches with binary searches in the plan.  Shuffles:
one to drop repeated deliveries, one to rank.  A length that a third of all rows share is spread over all salts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import cut_lineage

#: Context sizes of the tiers below the capacity, as shares of it.
TIERS = (0.5, 0.25, 0.125, 0.0625, 0.03125)
#: Batches of one training step.
STEP_BATCHES = 8


@dataclass
class Plan:
    """Where the pieces of each length go, for one capacity.

    Pieces are numbered by (length, rank): ``start`` is the number of the first piece of each length.  The run that begins
    with piece ``piece`` fills ``each`` pieces at a time into the containers from ``first`` on, batches if ``direct``, else
    windows of a tier; windows from ``window`` on go into the batches from ``batch`` on, ``per`` at a time.
    """

    length: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    first: np.ndarray
    each: np.ndarray
    direct: np.ndarray
    window: np.ndarray
    batch: np.ndarray
    per: np.ndarray
    batches: int
    costs: np.ndarray  # by range of equal batches: first batch
    position: np.ndarray  # place of that first batch in the order of cost
    cost: np.ndarray  # cost of one batch of the range
    steps: int = 1
    turned: np.ndarray | None = None  # by row of the order of cost: whether it runs over the steps from the last to the first

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        number = self.start[np.searchsorted(self.length, length)] + rank
        run = np.searchsorted(self.piece, number, "right") - 1
        at = self.first[run] + (number - self.piece[run]) // self.each[run]
        inside = ~self.direct[run]
        window = at[inside]
        move = np.searchsorted(self.window, window, "right") - 1
        at[inside] = self.batch[move] + (window - self.window[move]) // self.per[move]
        return at

    def deal(self, full: int, cost: int, step_batches: int) -> None:
        """Sets the step groups of all batches and of ``full`` more of the greatest cost, numbered after them."""
        self.position = np.r_[self.position + full, 0].astype(np.int64)
        self.costs = np.r_[self.costs, self.batches].astype(np.int64)
        self.cost = np.r_[self.cost, cost].astype(np.float64)
        total = self.batches + full
        self.steps = max(1, -(-total // step_batches))
        order = np.argsort(self.position, kind="stable") if full else np.argsort(self.position[:-1], kind="stable")
        columns = np.unique(np.linspace(0, self.steps - 1, min(self.steps, 1025)).astype(np.int64))
        held, turned = np.zeros(len(columns)), []
        for row in range(-(-total // self.steps)):
            adds = []
            for place in (columns, self.steps - 1 - columns):
                at = np.searchsorted(self.position[order], row * self.steps + place, "right") - 1
                adds.append(np.where(row * self.steps + place < total, self.cost[order[at]], 0.0))
            turned.append(int(np.ptp(held + adds[1]) < np.ptp(held + adds[0])))
            held = held + adds[turned[-1]]
        self.turned = np.array(turned or [0], bool)

    def step(self, batch: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.costs, batch, "right") - 1
        row, column = np.divmod(self.position[at] + batch - self.costs[at], self.steps)
        return np.where(self.turned[row], self.steps - 1 - column, column)


class _Pool:
    """Ranges of equal containers (first, number, cost of one) by the room that is left in them."""

    def __init__(self) -> None:
        self.gaps: list[int] = []
        self.held: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, gap: int, first: int, number: int, cost: int) -> None:
        if number > 0:
            if gap not in self.held:
                insort(self.gaps, gap)
                self.held[gap] = []
            self.held[gap].append((first, number, cost))

    def best(self, size: int) -> tuple[int, int, int, int] | None:
        """Takes out a range with the smallest gap that holds ``size``."""
        at = bisect_left(self.gaps, size)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, number, cost = self.held[gap].pop()
        if not self.held[gap]:
            del self.held[gap]
            self.gaps.pop(at)
        return gap, first, number, cost

    def ranges(self) -> list[tuple[int, int, int, int]]:
        return [(gap, *some) for gap, held in self.held.items() for some in held]


def _put(pools: list[_Pool], room: int, opened: int, size: int, number: int, cost: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places ``number`` things of one size: the first pool with a gap takes them, the last opens containers of ``room``.

    Returns runs (thing, pool, first container, things in each) and the number of containers opened so far.
    """
    runs, done = [], 0
    while done < number:
        found = next(((no, got) for no, pool in enumerate(pools) if (got := pool.best(size))), None)
        if found is None:
            new = -(-(number - done) // (room // size))
            found = len(pools) - 1, (room, opened, new, 0)
            opened += new
        no, (gap, first, held, before) = found
        each = gap // size
        full = min(held, (number - done) // each)
        if full:
            runs.append((done, no, first, each))
            pools[no].add(gap - each * size, first, full, before + each * cost)
            done += full * each
        rest = number - done
        if full < held and 0 < rest < each:
            runs.append((done, no, first + full, rest))
            pools[no].add(gap - rest * size, first + full, 1, before + rest * cost)
            done, full = number, full + 1
        pools[no].add(gap, first + full, held - full, before)
    return runs, opened


def make_plan(counts: dict[int, int], capacity: int, tiers: tuple[float, ...] = TIERS) -> Plan:
    """Plan of ``counts`` pieces by length (1..capacity)."""
    contexts = [capacity, *(max(1, int(capacity * share)) for share in tiers)]
    length = sorted(s for s, n in counts.items() if n > 0)
    start = np.cumsum([0, *(counts[s] for s in length)], dtype=np.int64)
    base = dict(zip(length, start.tolist()))
    batches, opened_batches, opened_windows = _Pool(), 0, 0
    runs: list[tuple[int, int, int, bool]] = []
    moves: list[tuple[int, int, int]] = []
    for context, border in zip(contexts, [*contexts[1:], 0]):
        own = _Pool()
        for size in reversed(length[bisect_right(length, border) : bisect_right(length, context)]):
            made, opened_windows = _put([batches, own], context, opened_windows, size, counts[size], size * size)
            runs.extend((base[size] + rank, first, each, no == 0) for rank, no, first, each in made)
        for gap, window, number, cost in sorted(own.ranges()):
            made, opened_batches = _put([batches], capacity, opened_batches, context - gap, number, cost)
            moves.extend((window + rank, batch, each) for rank, _, batch, each in made)
    ranges, done = [], 0
    for cost, first, number in sorted((-cost, first, number) for _, first, number, cost in batches.ranges()):
        ranges.append((first, done, -cost))
        done += number
    ranges.sort()
    run_columns = np.array(sorted(runs), np.int64).reshape(-1, 4).T
    return Plan(
        np.array(length, np.int64), start, *run_columns[:3], run_columns[3].astype(bool), *np.array(sorted(moves), np.int64).reshape(-1, 3).T, opened_batches,
        np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int64), np.array([r[2] for r in ranges], np.float64),
    )


def known_lengths(samples: DataFrame, fields: tuple[str, ...], uid_col: str = "uid", lengths_col: str = "lengths", extra: list[Column] | None = None) -> DataFrame:
    """``(uid, size)``: one row for each uid whose length fields are all known (not null, not negative).

    Of repeated deliveries the latest with known lengths counts (the longest at equal times).  Rows without a uid have no
    identity to report and are left out.  ``extra`` aggregates are taken over all deliveries of a uid.
    """
    parts = [F.col(f"{lengths_col}.{f}").cast("long") for f in fields]
    known = F.lit(True)
    for part in parts:
        known = known & (part >= 0)
    size: Column = sum(parts[1:], parts[0])
    at = F.coalesce("ingested_at", F.lit("1000-01-01").cast("timestamp_ntz"))
    last = F.max(F.when(known, F.struct(at.alias("at"), size.alias("size")))).alias("last")
    rows = samples.where(F.col(uid_col).isNotNull())
    rows = rows if extra else rows.where(known)
    made = rows.groupBy(F.col(uid_col).alias("uid")).agg(last, *(extra or [])).where("last is not null")
    return made.select("uid", F.col("last.size").alias("size"), *[c for c in made.columns if c not in ("uid", "last")])


def ranked(items: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, 2, ... within each size, by salted two-level counting."""
    salts = max(8, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    salted = cut_lineage(salted)
    cells = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select("size", "salt", before.alias("offset"))
    local = F.row_number().over(Window.partitionBy("size", "salt").orderBy("uid")) - 1
    return salted.withColumn("local", local).join(offsets, ["size", "salt"]).select("uid", "size", (F.col("offset") + F.col("local")).alias("rank"))


def capacities(limits: DataFrame) -> dict[str, int]:
    """Capacity of each profile that has one: a configuration table, one row per profile."""
    rows = limits.where("profile is not null and max_cost is not null and not isnan(max_cost) and max_cost >= 1")
    return {r["profile"]: int(r["cap"]) for r in rows.groupBy("profile").agg(F.min("max_cost").alias("cap")).orderBy("profile").collect()}


def pack(items: DataFrame, caps: dict[str, int], step_batches: int = STEP_BATCHES, tiers: tuple[float, ...] = TIERS) -> DataFrame:
    """Batches of ``items (uid, size)`` for every capacity in ``caps``.

    ``(profile, uid, piece_no, piece_start, piece_size, batch_id, tier, step_no)``: one row per item, or per piece of an
    item longer than the capacity (full pieces take a batch each, the rest is packed like an item).  Items of size 0 are
    spread over the batches.  Batches never exceed the capacity and no item within it is split.  Empty inputs give an
    empty result.
    """
    spark = items.sparkSession
    schema = "profile string, uid string, piece_no int, piece_start bigint, piece_size bigint, batch_id bigint, tier int, step_no bigint"
    items = cut_lineage(ranked(items))
    # one row for each distinct length, whatever the number of items
    histogram = items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").toPandas()
    sizes, numbers = histogram["size"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    if not len(sizes) or not caps:
        return spark.createDataFrame([], schema)
    plans = []
    for profile, cap in caps.items():
        rest = np.where(sizes > cap, sizes % cap, sizes)
        order = np.lexsort((sizes, rest))
        total = np.cumsum(numbers[order]) - numbers[order]
        first = np.r_[True, rest[order][1:] != rest[order][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        counts: dict[int, int] = {}
        for size, number in zip(rest.tolist(), numbers.tolist()):
            if size:
                counts[size] = counts.get(size, 0) + number
        plan = make_plan(counts, cap, tiers)
        whole = np.where(sizes > cap, sizes // cap, 0)
        base = plan.batches + np.cumsum(whole * numbers) - whole * numbers
        full_batches = int((whole * numbers).sum())
        plan.deal(full_batches, cap * cap, step_batches)
        plans.append((profile, cap, plan, offset, whole, base, plan.batches + full_batches))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(sizes, size)
            for profile, cap, plan, offset, whole, base, all_batches in plans:
                pieces = whole[at]
                last = size - pieces * cap
                has_last = (last > 0) | (pieces == 0)
                # full pieces
                row = np.repeat(np.arange(len(size)), pieces)
                no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                full_id = base[at[row]] + rank[row] * pieces[row] + no
                # items and last pieces
                rest_row = np.flatnonzero(has_last)
                rest_rank = offset[at[rest_row]] + rank[rest_row]
                rest_id = rest_rank % max(1, all_batches)
                some = last[rest_row] > 0
                rest_id[some] = plan.place(last[rest_row][some], rest_rank[some])
                rows = np.r_[row, rest_row]
                piece = np.r_[no, pieces[rest_row]]
                piece_size = np.r_[np.full(len(row), cap, np.int64), last[rest_row]]
                batch_id = np.r_[full_id, rest_id]
                tier = sum((piece_size <= max(1, int(cap * share)) for share in tiers), np.zeros(len(rows), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), profile, object), pa.string()),
                        batch.column(0).take(pa.array(rows)),
                        pa.array(piece, pa.int32()),
                        pa.array(piece * cap, pa.int64()),
                        pa.array(piece_size, pa.int64()),
                        pa.array(batch_id, pa.int64()),
                        pa.array(tier, pa.int32()),
                        pa.array(plan.step(batch_id), pa.int64()),
                    ],
                    names=["profile", "uid", "piece_no", "piece_start", "piece_size", "batch_id", "tier", "step_no"],
                )

    return items.select("uid", "size", "rank").mapInArrow(run, schema)


#: Fields that make the size of an item in the batches.
PACKED_FIELDS = ("user_audio_tokens", "assistant_audio_tokens", "codec_tokens")


def pack_samples(samples: DataFrame, limits: DataFrame, step_batches: int = STEP_BATCHES) -> DataFrame:
    return pack(known_lengths(samples, PACKED_FIELDS), capacities(limits), step_batches)
