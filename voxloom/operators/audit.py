"""Audit of tar shards from the list of their members: counts by shard, layouts, tasks, codecs, errors with examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import layouts

#: Examples of errors in a report.
EXAMPLES = 20


def audited(members: DataFrame) -> DataFrame:
    """Samples (runs of equal keys) of ``members (shard, place, name, size, text)``, with everything a report needs.

    ``(shard, key, place, sizes, layout, tasks, codecs, errors)``: errors is an array of (member, error).  A member whose name
    has no key, and a shard that cannot be read on (name null), make a row without a key.  Nothing raises.
    """
    key, suffix = (layouts.split_member(F.col("name"))[part] for part in ("key", "suffix"))
    named = members.withColumns({"key": key, "suffix": suffix})
    order = Window.partitionBy("shard").orderBy("place")
    whole = named.where("key is not null").withColumn("new", (~F.lag("key").over(order).eqNullSafe(F.col("key"))).cast("int"))
    whole = whole.withColumn("run", F.sum("new").over(order))
    first = F.min("run").over(Window.partitionBy("shard", "key"))
    whole = whole.withColumn("again", F.col("run") > first)
    one = F.struct("place", "suffix", "size", "name", "text")
    samples = whole.groupBy("shard", "run", "key").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(one)).alias("m"), F.max("again").alias("again"))
    suffixes = F.transform("m", lambda x: x["suffix"])
    twice = F.size(F.array_distinct(suffixes)) < F.size(suffixes)
    held = F.map_from_arrays(F.array_distinct(suffixes), F.array_repeat(F.lit(1), F.size(F.array_distinct(suffixes))))
    layout = layouts.audit_layout(held)
    tasks = layouts.tasks_of(held, layout)
    found = samples.withColumns({"suffixes": suffixes, "held": held, "layout": F.when(~twice, layout), "tasks": F.when(twice, F.array().cast("array<string>")).otherwise(tasks)})
    audio = {prefix: layouts.single_audio(F.col("held"), prefix)["error"] for prefix in ("question", "response", "audio")}
    sound = F.when(F.col("layout") == "s2s_pair", F.coalesce(audio["question"], audio["response"], F.when(~F.array_contains("suffixes", "json"), "MissingMember"))).when(
        F.col("layout") == "shared_audio_tasks", F.coalesce(audio["audio"], F.when(F.size("tasks") == 0, "MissingMember"))
    )
    whole_error = (
        F.when(twice, "DuplicateMember").when(F.col("layout") == "ambiguous", "AmbiguousLayout").when(F.col("layout") == "unknown", "UnknownLayout").otherwise(sound)
    )
    empty = F.transform(F.filter("m", lambda x: x["size"] == 0), lambda x: _error(x["name"], F.lit("EmptyMember")))
    unread = F.transform(
        F.filter("m", lambda x: x["suffix"].endswith("json") & (x["size"] > 0) & F.try_parse_json(x["text"]).isNull()), lambda x: _error(x["name"], F.lit("MetadataDecode"))
    )
    again = F.when(F.col("again"), F.array(_error(F.element_at("m", 1)["name"], F.lit("NonContiguousKey")))).otherwise(F.array().cast("array<struct<member:string,error:string>>"))
    wrong = F.when(whole_error.isNotNull(), F.array(_error(F.lit(None).cast("string"), whole_error))).otherwise(F.array().cast("array<struct<member:string,error:string>>"))
    codec = F.transform(
        F.filter("suffixes", lambda s: s.rlike(rf"(?i)^(question|response|audio)\.({'|'.join(layouts.AUDIO_EXTENSIONS)})$")), lambda s: F.lower(F.substring_index(s, ".", -1))
    )
    made = found.select(
        "shard", "key", "place", F.transform("m", lambda x: x["size"]).alias("sizes"),
        F.when(F.col("layout").isin(*layouts.LAYOUTS), F.col("layout")).alias("layout"),
        F.when(whole_error.isNull(), F.col("tasks")).otherwise(F.array().cast("array<string>")).alias("tasks"),
        codec.alias("codecs"), F.concat(empty, again, wrong, unread).alias("errors"),
    )
    nothing = F.array().cast("array<string>")
    odd = named.where("key is null").select(
        "shard", F.lit(None).cast("string").alias("key"), "place", F.when(F.col("name").isNotNull(), F.array("size")).otherwise(F.array().cast("array<bigint>")).alias("sizes"),
        F.lit(None).cast("string").alias("layout"), nothing.alias("tasks"), nothing.alias("codecs"),
        F.array(_error(F.col("name"), F.when(F.col("name").isNull(), "UnreadableShard").otherwise("InvalidMemberName"))).alias("errors"),
    )
    return made.unionByName(odd)


def _error(member: Column, name: Column) -> Column:
    return F.struct(member.alias("member"), name.alias("error"))


def _constant(value: str) -> Callable[[Column], Column]:
    return lambda _: F.lit(value)


def shard_reports(samples: DataFrame) -> DataFrame:
    """``(shard, physical_samples, logical_samples, members, member_bytes, errors)`` of every audited shard."""
    total = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
    return samples.groupBy("shard").agg(
        F.count("key").alias("physical_samples"),
        F.sum(F.size("tasks")).alias("logical_samples"),
        F.sum(F.size("sizes")).alias("members"),
        F.sum(total("sizes")).alias("member_bytes"),
        F.sum(F.size("errors")).alias("errors"),
    )


def frequencies(samples: DataFrame) -> DataFrame:
    """``(kind, name, n)`` for layouts, tasks, codecs and error types."""
    kinds = {"layout": F.filter(F.array("layout"), lambda x: x.isNotNull()), "task": F.col("tasks"), "codec": F.col("codecs"), "error": F.transform("errors", lambda e: e["error"])}
    tagged = F.concat(*[F.arrays_zip(F.transform(names, _constant(kind)).alias("kind"), names.alias("name")) for kind, names in kinds.items()])
    return samples.select(F.inline(tagged)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def error_examples(samples: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """The first ``limit`` errors by shard and place: ``(shard, key, member, error)``."""
    rows = samples.select("shard", "place", "key", F.posexplode("errors").alias("no", "e")).orderBy("shard", "place", "no").limit(limit)
    return rows.select("shard", "key", "e.member", "e.error")


def report(samples: DataFrame, limit: int = EXAMPLES) -> dict:
    """The whole report as plain values; one row per shard reaches the driver."""
    shards = [r.asDict() for r in shard_reports(samples).orderBy("shard").collect()]
    counts = {kind: {} for kind in ("layout", "task", "codec", "error")}
    for row in frequencies(samples).orderBy("kind", "name").collect():
        counts[row["kind"]][row["name"]] = row["n"]
    summary = {name: sum(s[name] for s in shards) for name in ("members", "member_bytes", "physical_samples", "logical_samples", "errors")}
    return {
        "ok": summary["errors"] == 0, "summary": {"shards": len(shards), **summary}, "layouts": counts["layout"], "tasks": counts["task"], "audio_codecs": counts["codec"],
        "error_types": counts["error"], "error_examples": [r.asDict() for r in error_examples(samples, limit).collect()], "shards": shards,
    }
