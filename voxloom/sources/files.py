"""Readers and writers of chat, request, trace and corpus files."""

from __future__ import annotations

import json
import os

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.lengths import row_estimate
from voxloom.functions.text import safe_stem
from voxloom.operators.setops import duplicates
from voxloom.session import cut_lineage

MESSAGES = "array<struct<role:string,content:string>>"
CHAT_SCHEMA = f"messages {MESSAGES}, audios array<string>, audio_durations array<double>, audio_tokens array<bigint>, num_tokens_est bigint"
#: File splits whose line counts may be broadcast (about 100 bytes each).
MOST_SPLITS = 200_000
AUDIO = "struct<path:string,bytes:binary,array:array<float>,sampling_rate:int>"


def read_chat_jsonl(spark: SparkSession, path: str, extra: str = "", multi_line: bool = False) -> DataFrame:
    """Chat rows with an explicit schema; a line that is no JSON keeps its text in ``_corrupt_record``.

    Only the named fields are parsed.  ``multi_line`` reads files that are one JSON array.
    """
    schema = CHAT_SCHEMA + (f", {extra}" if extra else "") + ", _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)``: lines of text files numbered from 0 in file order, blank lines included.

    Lines are counted by split first; a line's number is the lines of earlier splits and its place in its own, so no text
    moves.  The splits (one row each) are broadcast while there are at most ``MOST_SPLITS``, else joined.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    splits = lines.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = cut_lineage(splits.select("__f", "__b", "__first", before.alias("__before")))
    if splits.count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    numbered = lines.join(splits, ["__f", "__b"])
    return numbered.select((F.col("__before") + F.col("__i") - F.col("__first")).alias("line_no"), "value")


def read_requests(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Request lines with index (default: the physical line number), request and error.

    An index must be a whole number, not a boolean; a repeated one is an error of the later lines.  ``strict`` raises on
    the first error, otherwise the rows carry it.
    """
    lines = read_lines(spark, path).where("length(trim(value)) > 0").withColumn("__v", F.try_parse_json("value"))
    kind = F.schema_of_variant(F.variant_get("__v", "$.index", "variant"))
    index = F.when(kind.isNull(), F.col("line_no")).when(kind == "BIGINT", F.try_variant_get("__v", "$.index", "bigint"))
    rows = lines.withColumn("index", index)
    first = rows.where("index is not null").groupBy("index").agg(F.min("line_no").alias("__first"))
    rows = rows.join(first, "index", "left")
    error = (
        F.when(F.col("__v").isNull() | ~F.schema_of_variant("__v").startswith("OBJECT"), "not_an_object")
        .when(F.col("index").isNull(), "index_not_integer")
        .when(F.col("line_no") > F.col("__first"), "duplicate_index")
    )
    rows = rows.select("line_no", "index", F.col("value").alias("request"), error.alias("error"))
    if strict:
        bad = rows.where("error is not null").orderBy("line_no").head(1)
        if bad:
            raise ValueError(f"line {bad[0]['line_no']}: {bad[0]['error']}")
    return rows


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(id, audio, duration, transcript, error)``: header skipped, split at the first three tabs only."""
    lines = read_lines(spark, path).where("line_no > 0")
    parts = F.split("value", "\t", 4)
    ok = F.size(parts) == 4
    return lines.select(
        *[F.when(ok, parts[i]).alias(n) for i, n in ((0, "id"), (1, "audio"))],
        F.when(ok, parts[2].try_cast("double")).alias("duration"),
        F.when(ok, parts[3]).alias("transcript"),
        F.when(~ok, "columns").when(parts[2].try_cast("double").isNull(), "duration").alias("error"),
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``(stem, transcript)`` of ``stem text`` lines."""
    return spark.read.text(path).where("length(value) > 0").select(F.substring_index("value", " ", 1).alias("stem"), F.expr("substring(value, instr(value, ' ') + 1)").alias("transcript"))


def list_audio(spark: SparkSession, path: str, suffix: str = "*.wav") -> DataFrame:
    """``(stem, path, bytes)`` of audio files; their content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)
    return files.select(safe_stem(F.col("path")).alias("stem"), "path", F.col("length").alias("bytes"))


def join_transcripts(audio: DataFrame, transcripts: DataFrame, strict: bool = True) -> DataFrame:
    """Audio with transcripts by stem: a missing one is an error, or an empty text."""
    joined = audio.join(transcripts, "stem", "left")
    if strict and joined.where("transcript is null").head(1):
        raise ValueError("an audio file has no transcript")
    return joined.withColumn("transcript", F.coalesce("transcript", F.lit("")))


def read_corpus_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """Speech-corpus parquet files below ``path``; None if they lack generated_text or generated_wav."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows if {"generated_text", "generated_wav"} <= set(rows.columns) else None


def listed(spark: SparkSession, path: str) -> list[str] | None:
    """Names of the files directly below a path of any file system (the file itself); None if there is nothing."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else None


def load_any(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet, JSON array or JSONL by name; None for a path that does not exist (a warning upstream, no error)."""
    names = listed(spark, path)
    if names is None:
        return None
    if path.endswith(".parquet") or any(n.endswith(".parquet") for n in names):
        return spark.read.option("recursiveFileLookup", True).parquet(path)
    return read_chat_jsonl(spark, path, multi_line=path.endswith(".json"))


def sidecar_path(path: str) -> str:
    root, ext = os.path.splitext(path)
    return f"{root}.with_durations{ext}"


def prefer_sidecar(path: str, budget: int | None) -> str:
    """The file with measured durations if a token budget needs them and it exists."""
    side = sidecar_path(path)
    session = SparkSession.getActiveSession()
    there = listed(session, side) is not None if session else os.path.exists(side)
    return side if budget is not None and there else path


def with_estimates(rows: DataFrame, durations: Column) -> DataFrame:
    """Durations rounded to milliseconds, audio tokens and the row estimate."""
    rounded = F.transform(durations, lambda x: F.round(x, 3))
    rows = rows.withColumn("audio_durations", rounded)
    rows = rows.withColumn("audio_tokens", F.transform("audio_durations", lambda x: F.floor(x * 17).cast("bigint")))
    return rows.withColumn("num_tokens_est", row_estimate(F.col("messages"), F.col("audio_durations")))


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing target is kept unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "ignore").json(path)


def write_results(rows: DataFrame, path: str, fail_fast: bool = False) -> dict[str, int]:
    """Rows with a null ``error`` below ``path/traces``, the rest below ``path/errors``; returns the counts.

    One pass: the rows are evaluated once, and the counts are observed while they are written.  ``fail_fast`` stops at the
    first row with an error, which the rows themselves raise.
    """
    error = F.col("error")
    if fail_fast:
        rows = rows.withColumn("error", F.when(error.isNotNull(), F.raise_error(error).cast("string")))
    seen = Observation()
    watched = rows.observe(seen, F.count_if(error.isNull()).alias("traces"), F.count_if(error.isNotNull()).alias("errors"))
    try:
        watched.withColumn("status", F.when(error.isNull(), "traces").otherwise("errors")).write.mode("overwrite").partitionBy("status").json(path)
    except PySparkException as failed:
        if fail_fast:
            raise RuntimeError(str(failed).partition("\n")[0]) from failed
        raise
    return {name: int(seen.get[name]) for name in ("traces", "errors")}


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Error rows appended by source and stage."""
    rows.write.mode("append").partitionBy("source", "stage").parquet(path)


def eval_file(folder: str, model: str, dataset: str) -> str:
    return os.path.join(folder, f"{model}_{dataset}.jsonl")


def write_report(counts: dict, path: str) -> None:
    """A small report as one JSON file, replaced in one step."""
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        json.dump(counts, file, ensure_ascii=False, indent=2, default=str)
    os.replace(f"{path}.part", path)


def repeated_index(rows: DataFrame) -> DataFrame:
    return duplicates(rows, "index")
