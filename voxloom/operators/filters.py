"""Reason columns and the quarantine split.  A row is never lost: it is kept, or set apart with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.chat import content_error, duplex_error
from voxloom.functions.lengths import duration_error

DETAIL_CHARS = 4096


def binding_error(bindings: Column, assets: Column) -> Column:
    """``role:reason`` of the first binding, in order, whose asset's duration is out of bounds; null if none is.

    A binding without an asset and an unknown duration pass.
    """
    found = F.transform(
        bindings, lambda b: F.concat(b["role"], F.lit(":"), duration_error(F.try_element_at(assets, b["asset_id"])["duration"], b["role"]))
    )
    return F.try_element_at(F.filter(found, lambda e: e.isNotNull()), F.lit(1))


def unknown_asset(bindings: Column, assets: Column) -> Column:
    """The asset that the first binding (by message and tag) names and the row does not hold; null if all are there."""
    ordered = F.array_sort(F.transform(bindings, lambda b: F.struct(b["message_index"].alias("m"), b["tag_index_in_message"].alias("t"), b["asset_id"].alias("asset_id"))))
    held = F.coalesce(F.map_keys(assets), F.array().cast("array<string>"))
    return F.try_element_at(F.filter(ordered, lambda b: ~F.array_contains(held, b["asset_id"])), F.lit(1))["asset_id"]


def quality_error(messages: Column, case_dir: Column, strategy: Column, turns: Column) -> Column:
    """First reason to reject a row: duplex policy, then code or CJK in an assistant message."""
    return F.coalesce(duplex_error(case_dir, strategy, turns), content_error(messages))


def split_quarantine(rows: DataFrame, error: Column, stage: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, quarantined rows with stage, error and detail).  A null error keeps the row."""
    marked = rows.withColumn("error", error)
    kept = marked.where("error is null").drop("error")
    bad = marked.where("error is not null").withColumn("stage", F.lit(stage)).withColumn("error", F.left("error", F.lit(DETAIL_CHARS)))
    return kept, bad


def drop_internal(rows: DataFrame) -> DataFrame:
    """Without ``id`` and columns that begin with an underscore."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "id" and not c.startswith("_")])


def corpus_row(text: Column, audio: Column, prompt: Column) -> Column:
    """Messages and audios of a speech-corpus row; null without audio or with a blank text."""
    content = F.trim(text)
    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.coalesce(prompt, F.lit("")).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.concat(content, F.lit("<|audio|>")).alias("content")),
    )
    return F.when(audio.isNotNull() & (F.length(content) > 0), F.struct(messages.alias("messages"), F.array(audio).alias("audios")))
