"""Mixing sources to target weights.

Method: Pareto order sampling.  A source that must contribute the size T and holds the size S uses every sample
floor(T / S) times (certain whole copies, at most the cap) and then draws a subset for the rest R.  A sample of size s
belongs to it with the chance c * s, so that large samples are as likely to be seen as their parts together; samples for
which that reaches 1 are certain and taken out first, and c is the value under which the expected size is R.  The others
enter in the order of (u / (1 - u)) / (p / (1 - p)), where u is a uniform number from a hash of the uid and p the chance,
up to the last that fits; one more sample, the nearest in size to what is left, closes the source.

Certain sizes and c come from the histogram of sizes.  The cut is found without ordering a source: ranks fall into fine
buckets, sums per (source, bucket) give the bucket in which the target is reached, and only its rows are put in order.  The
cut of a source is one (rank, uid) pair, so the last pass compares every sample with the pair of its source: no join by
uid and no round after round.  What reaches the driver is one row per configured source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from voxloom.llm.packing import known_lengths
from voxloom.operators.ranking import seeded
from voxloom.session import cut_lineage

#: Fields that make the size of a sample in a mixture.
MIXED_FIELDS = ("user_text_tokens", "assistant_text_tokens", "user_audio_tokens", "assistant_audio_tokens", "codec_tokens")
#: Shares of all known size that the registered mixtures draw.
TOTAL_SHARE, FULL_SHARE = 0.1, 1.0
#: Buckets of the Pareto rank of one source.
BUCKETS = 16384


def plain_name(name: Column) -> Column:
    """Source names without regard to case and outer blanks; null if blank."""
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def mixture_samples(samples: DataFrame) -> DataFrame:
    """``(uid, source_name, size)`` of the distinct samples with known lengths.

    A missing source name is read from the uid, which starts with it.
    """
    named = F.min(plain_name(F.col("source_name"))).alias("named")
    own = plain_name(F.substring_index("uid", ":", 1))
    return known_lengths(samples, MIXED_FIELDS, extra=[named]).select("uid", F.coalesce("named", own).alias("source_name"), "size")


def source_targets(sizes: DataFrame, sources: DataFrame, total_size: float | None, total_share: float) -> list[dict]:
    """Aim of every configured source, from ``sizes (source_name, size, n)``: a configuration table, one row per source.

    Shares are the weights over their sum, taken over the sources that have rows: an empty source has no share.  A ratio
    of 1 or more allows floor(ratio) uses of a sample; a smaller one allows one use of at most that part of the source.
    Sources named twice keep the larger weight and ratio.
    """
    named = sources.select(plain_name(F.col("name")).alias("source_name"), F.nanvl("weight", F.lit(0.0)).alias("weight"), F.nanvl("ratio", F.lit(1.0)).alias("ratio"))
    named = named.where("source_name is not null").groupBy("source_name").agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("ratio"), F.lit(1.0)).alias("ratio"))
    both = sizes.groupBy("source_name").agg(F.sum("n").alias("samples"), F.sum(F.col("n") * F.col("size")).alias("available_size"))
    held = both.join(F.broadcast(named), "source_name", "right").orderBy("source_name").collect()
    if total_size is None:
        total_size = (both.agg(F.sum("available_size").alias("t")).first()["t"] or 0) * total_share
    usable = {r["source_name"]: r["weight"] if (r["available_size"] or 0) > 0 and r["weight"] > 0 else 0.0 for r in held}
    whole_weight = math.fsum(usable.values())
    out = []
    for r in held:
        available, ratio = r["available_size"] or 0, r["ratio"]
        share = usable[r["source_name"]] / whole_weight if whole_weight else 0.0
        target = share * float(total_size)
        limit = math.floor(ratio) * available if ratio >= 1 else max(ratio, 0.0) * available
        drawn = min(target, float(limit))
        whole = int(drawn // available) if available else 0
        out.append(
            {
                "source_name": r["source_name"], "weight": r["weight"], "max_uses": max(1, math.floor(ratio)), "samples": r["samples"] or 0, "available_size": available,
                "target_share": share, "target_size": target, "whole": whole, "rest": drawn - whole * float(available),
            }
        )
    return out


def _local(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A table of one row per configured source, safe to broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def certain_sizes(sizes: DataFrame, aims: list[dict]) -> dict[str, Row]:
    """By source: the size beyond which samples are certain (``border``), their ``certain`` sum, and ``c``.

    With all sizes above s certain, c(s) = (rest - their sum) / (sum of the squares of the others); the border is the largest
    s with c(s) * s < 1.  One window over the distinct sizes of each source.
    """
    open_ = _local(sizes, [(a["source_name"], a["rest"]) for a in aims if a["rest"] > 0], "source_name string, rest double")
    down, up = Window.partitionBy("source_name").orderBy(F.desc("size")), Window.partitionBy("source_name").orderBy("size")
    held = F.col("n").cast("decimal(18,0)") * F.col("size")
    above = F.coalesce(F.sum(held).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    squares = F.sum((held * F.col("size")).cast("decimal(38,0)")).over(up).cast("double")
    rows = sizes.where("size > 0").join(open_, "source_name").select("source_name", "size", above.alias("certain"), ((F.col("rest") - above) / squares).alias("c"))
    best = rows.where(F.col("c") * F.col("size") < 1).groupBy("source_name").agg(F.max(F.struct(F.col("size").alias("border"), "certain", "c")).alias("b"))
    return {r["source_name"]: r for r in best.select("source_name", "b.*").collect()}


def draw(items: DataFrame, sources: DataFrame, total_size: float | None = None, seed: int = 7, total_share: float = TOTAL_SHARE) -> tuple[DataFrame, DataFrame]:
    """``(uses, shares)`` of a mixture of ``total_size`` (``total_share`` of everything if None).

    uses: ``(uid, source_name, size, uses)``, a row for every sample, 0 where it is not drawn or its source is not
    configured.  shares: targets and results of every configured source; a source that its cap keeps below the target
    shows it.  Samples of size 0 take part in whole copies only.  The size drawn from a source differs from its aim by less
    than the sample that would fit best.
    """
    items = cut_lineage(items.select("uid", "source_name", "size"))
    sizes = cut_lineage(items.groupBy("source_name", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = source_targets(sizes, sources, total_size, total_share)
    borders = certain_sizes(sizes, aims)
    rules = [
        (a["source_name"], a["whole"], borders[a["source_name"]]["border"], borders[a["source_name"]]["c"], a["rest"] - borders[a["source_name"]]["certain"])
        if a["source_name"] in borders
        else (a["source_name"], a["whole"], None, None, None)
        for a in aims
    ]
    rows = items.join(_local(items, rules, "source_name string, whole int, border bigint, c double, gap double"), "source_name", "left")
    chance, u = F.col("c") * F.col("size"), seeded(F.col("uid"), seed)
    rank = F.when((F.col("size") > 0) & (F.col("size") <= F.col("border")), (u / (1 - u)) * ((1 - chance) / chance))
    certain = F.when(F.col("size") > F.col("border"), 1).otherwise(0)
    keep = ("uid", "source_name", "size", "rank", "gap")
    ranked = rows.select(*keep[:3], rank.alias("rank"), "gap", (F.coalesce("whole", F.lit(0)) + certain).alias("uses"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    # the bucket in which the gap of each source is filled
    sums = ranked.where("rank is not null").groupBy("source_name", "bucket").agg(F.sum("size").alias("held"), F.max("gap").alias("gap"))
    sums = sums.withColumn("upto", F.sum("held").over(Window.partitionBy("source_name").orderBy("bucket")))
    crossing = F.min(F.struct("bucket", (F.col("upto") - F.col("held")).alias("before"))).alias("x")
    at = sums.where("upto > gap").groupBy("source_name").agg(crossing).select("source_name", "x.*").collect()
    crossed = _local(items, [(r["source_name"], r["bucket"], r["before"]) for r in at], "source_name string, bucket int, before bigint")
    # the first sample that does not fit any more, and what is left before it
    running = F.sum("size").over(Window.partitionBy("source_name").orderBy("rank", "uid"))
    inside = ranked.join(crossed, ["source_name", "bucket"]).withColumn("upto", F.col("before") + running).where("upto > gap")
    first = F.min(F.struct("rank", "uid", (F.col("gap") - F.col("upto") + F.col("size")).alias("left"))).alias("x")
    cuts = inside.groupBy("source_name").agg(first).select("source_name", "x.*").collect()
    cut = _local(items, [(r["source_name"], r["rank"], r["uid"], r["left"]) for r in cuts], "source_name string, cut_rank double, cut_uid string, left double")
    placed = ranked.join(cut, "source_name", "left")
    before = F.col("rank").isNotNull() & (F.col("cut_rank").isNull() | (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("uid") < F.col("cut_uid"))))
    placed = placed.withColumn("taken", before)
    # closing step: the one sample nearest in size to what is left enters if that makes it smaller
    off = F.abs(F.col("left") - F.col("size"))
    last = placed.where(F.col("rank").isNotNull() & ~F.col("taken") & (off < F.col("left"))).groupBy("source_name").agg(F.min(F.struct(off.alias("off"), "rank", "uid")).alias("x"))
    closing = _local(items, [(r["uid"],) for r in last.select("x.uid").collect()], "uid string")
    uses = placed.join(closing.withColumn("closing", F.lit(1)), "uid", "left")
    uses = uses.select("uid", "source_name", "size", (F.col("uses") + F.col("taken").cast("int") + F.coalesce("closing", F.lit(0))).cast("int").alias("uses"))
    drawn = uses.groupBy("source_name").agg(F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("size")).alias("actual_size"))
    fields = ("source_name", "weight", "max_uses", "samples", "available_size", "target_share", "target_size")
    targets = _local(items, [tuple(a[f] for f in fields) for a in aims], "source_name string, weight double, max_uses int, samples bigint, available_size bigint, target_share double, target_size double")
    shares = drawn.join(targets, "source_name", "right").withColumns({"uses": F.coalesce("uses", F.lit(0)), "actual_size": F.coalesce("actual_size", F.lit(0))})
    actual = F.coalesce(F.col("actual_size") / F.nullif(F.sum("actual_size").over(Window.partitionBy()), F.lit(0)), F.lit(0.0))
    return uses, shares.select(*fields, "uses", "actual_size", actual.alias("actual_share"))
