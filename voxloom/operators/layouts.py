"""Physical samples (one key of a shard, a map of members) to logical task rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.chat import TASKS

# Audio member extensions, the form of a member path.
AUDIO_EXTENSIONS = ("wav", "flac", "mp3", "m4a", "ogg")
MEMBER_PATTERN = r"^((?:.*/|)[^.]+)[.]([^/]*)$"
_AUDIO = "|".join(AUDIO_EXTENSIONS)

#: name -> (match, expand) of column builders over a map of members; open for registration.
LAYOUTS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {}


def register_layout(name: str, match: Callable[[Column], Column], expand: Callable[[Column], Column]) -> None:
    """A layout: ``match`` tells whether members belong to it, ``expand`` gives the array of their tasks."""
    LAYOUTS[name] = (match, expand)


def audio_members(members: Column, prefix: str) -> Column:
    """Member names ``prefix.<audio extension>``, case-insensitive, in order."""
    return F.array_sort(F.filter(F.map_keys(members), lambda k: k.rlike(rf"(?i)^{prefix}\.({_AUDIO})$")))


def single_audio(members: Column, prefix: str, preference: tuple[str, ...] | None = None) -> Column:
    """Struct(member, error): the one audio member, MissingMember, or by preference where several are allowed."""
    found = audio_members(members, prefix)
    if preference is None:
        error = F.when(F.size(found) == 0, "MissingMember").when(F.size(found) > 1, "DuplicateMember")
        return F.struct(F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).alias("member"), error.alias("error"))
    order = F.array(*[F.lit(p.lower()) for p in preference])

    def rank(k: Column) -> Column:
        place = F.array_position(order, F.lower(F.substring_index(k, ".", -1)))
        return F.struct(F.when(place > 0, place).otherwise(1_000_000).alias("r"), k.alias("k"))

    best = F.array_min(F.transform(found, rank))
    return F.struct(best["k"].alias("member"), F.when(F.size(found) == 0, "MissingMember").alias("error"))


def _match_pair(members: Column) -> Column:
    return F.array_contains(F.map_keys(members), "json") & (F.size(audio_members(members, "question")) == 1) & (F.size(audio_members(members, "response")) == 1)


def _match_shared(members: Column) -> Column:
    tasks = F.array(*[F.lit(f"{t}.json") for t in TASKS])
    return (F.size(audio_members(members, "audio")) == 1) & F.arrays_overlap(F.map_keys(members), tasks)


register_layout("s2s_pair", _match_pair, lambda members: F.array(F.lit("s2s")))
register_layout(
    "shared_audio_tasks", _match_shared, lambda members: F.filter(F.array(*[F.lit(t) for t in TASKS]), lambda t: F.array_contains(F.map_keys(members), F.concat(t, F.lit(".json"))))
)


def resolve_layout(members: Column, forced: Column | None = None) -> Column:
    """Struct(layout, error): the forced layout, the one that matches, UnknownLayout or AmbiguousLayout."""
    forced = forced if forced is not None else F.lit(None).cast("string")
    matches = F.filter(F.array(*[F.when(match(members), F.lit(name)) for name, (match, _) in LAYOUTS.items()]), lambda m: m.isNotNull())
    auto = forced.isNull() | (forced == "auto")
    known = forced.isin(*LAYOUTS)
    layout = F.when(~auto & known, forced).when(auto & (F.size(matches) == 1), F.try_element_at(matches, F.lit(1)))
    error = F.when(layout.isNull(), F.when(auto & (F.size(matches) > 1), "AmbiguousLayout").otherwise("UnknownLayout"))
    return F.struct(layout.alias("layout"), error.alias("error"))


def audit_layout(members: Column) -> Column:
    """Layout by clues (a json, question or response member; a task sidecar or audio member), for precise reports."""
    keys = F.map_keys(members)
    pair = F.exists(keys, lambda k: (k == "json") | k.startswith("question.") | k.startswith("response."))
    shared = F.exists(keys, lambda k: k.startswith("audio.") | k.isin(*[f"{t}.json" for t in TASKS if t != "s2s"]))
    return F.when(pair & shared, "ambiguous").when(pair, "s2s_pair").when(shared, "shared_audio_tasks").otherwise("unknown")


def tasks_of(members: Column, layout: Column) -> Column:
    out = None
    for name, (_, expand) in LAYOUTS.items():
        out = F.when(layout == name, expand(members)) if out is None else out.when(layout == name, expand(members))
    return out.otherwise(F.array().cast("array<string>"))


def requested_tasks(present: Column, wanted: list[str] | None) -> Column:
    """Present tasks in fixed order, restricted to ``wanted`` if given."""
    order = [t for t in ("asr", "tts", "s2tt", "ser", "asc", "s2s") if wanted is None or t in wanted]
    return F.array_intersect(F.array(*[F.lit(t) for t in order]), present)


def explode_tasks(rows: DataFrame, physical_uid: str, present: str, wanted: list[str] | None = None) -> DataFrame:
    """One row per present and wanted task with its uid; rows without any leave (they are a report of their own)."""
    return rows.withColumn("task", F.explode(requested_tasks(F.col(present), wanted))).withColumn("uid", F.concat_ws(":", physical_uid, "task"))


def split_member(name: Column) -> Column:
    """Struct(key, suffix) of a member path: the key ends at the first dot of the file name."""
    return F.struct(*[F.nullif(F.regexp_extract(name, MEMBER_PATTERN, i), F.lit("")).alias(part) for i, part in ((1, "key"), (2, "suffix"))])


def metadata_task_error(declared: Column, task: Column) -> Column:
    """MetadataDecode if a sidecar declares another task than its member name."""
    return F.when(declared.isNotNull() & (declared != task), "MetadataDecode")


def match_member(names: Column, values: Column, member: Column) -> Column:
    """The value of the one name that equals ``member`` or ends in ``.member``; null unless exactly one value is known."""
    tail = F.concat(F.lit("."), member)
    pairs = F.filter(
        F.arrays_zip(names.alias("n"), values.alias("v")),
        lambda p: p["v"].isNotNull() & ((F.substring_index(p["n"], "/", -1) == member) | F.substring_index(p["n"], "/", -1).endswith(tail)),
    )
    return F.when((F.size(names) == F.size(values)) & (F.size(pairs) == 1), F.try_element_at(pairs, F.lit(1))["v"])


def resolve_tokens(names: Column, tokens: Column, member: Column, place: Column, seconds: Column, rate: int = 17) -> Column:
    """Audio tokens of a binding: by member name, else by place where names and tokens cannot be paired, else by duration, else 0."""
    by_name = match_member(names, tokens, member)
    unpaired = names.isNull() | tokens.isNull() | (F.size(names) != F.size(tokens))
    by_place = F.when(unpaired, F.try_element_at(tokens, place + 1))
    return F.coalesce(by_name, by_place, F.floor(F.when(~F.isnan(seconds), seconds) * rate).cast("long"), F.lit(0).cast("long"))


def broken_runs(members: DataFrame, shard: str, place: str, key: str) -> DataFrame:
    """``(shard, key, runs)`` of the keys whose members do not lie together in their shard."""
    before = F.lag(key).over(Window.partitionBy(shard).orderBy(place))
    starts = members.withColumn("__start", F.when(before.eqNullSafe(F.col(key)), 0).otherwise(1))
    return starts.groupBy(shard, key).agg(F.sum("__start").alias("runs")).where("runs > 1")


def duplicate_suffixes(members: DataFrame, shard: str, key: str, suffix: str) -> DataFrame:
    return members.groupBy(shard, key, suffix).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def same_members(a: Column, b: Column) -> Column:
    """Whether two name lists hold the same set."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))
