"""Requests, traces, eval rows and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.text import judge_score, safe_stem, word_edit_distance

TRACE_FIELDS = ("index", "task", "input", "output", "evaluation", "metadata")


def real_text(text: Column) -> Column:
    """``text`` unless it is the word null in any case, then null."""
    return F.when(F.lower(F.trim(text)) != "null", text)


def direct_text(output_text: Column, output_audio: Column, prediction_text: Column) -> Column:
    """The model's own text; empty for spoken output, whose prediction text is a transcription."""
    spoken = F.coalesce(F.length(output_audio) > 0, F.lit(False))
    return F.coalesce(real_text(output_text), F.when(spoken, F.lit("")), real_text(prediction_text), F.lit(""))


def audio_text(transcription: Column, output_audio: Column, prediction_text: Column) -> Column:
    """A transcription of spoken output; empty if there is none."""
    spoken = F.coalesce(F.length(output_audio) > 0, F.lit(False))
    return F.coalesce(F.nullif(transcription, F.lit("")), F.when(spoken, real_text(prediction_text)), F.lit(""))


def selected_prediction(direct: Column, audio: Column, source: str = "auto") -> Column:
    """direct_text, audio_asr or auto (audio, else direct); ``null`` as a word if empty."""
    chosen = {"direct_text": direct, "audio_asr": audio, "auto": F.coalesce(F.nullif(audio, F.lit("")), direct)}[source]
    return F.coalesce(F.nullif(chosen, F.lit("")), F.lit("null"))


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank; empty if all are."""
    return F.coalesce(*[F.when(F.length(F.trim(t)) > 0, t) for t in texts], F.lit(""))


def build_requests(items: DataFrame, task: str, with_prompt: bool, default_subset: str = "items") -> DataFrame:
    """Nested requests of benchmark items; items without an audio path leave."""
    content = F.coalesce("audio_content", F.lit(""))
    return items.where("audio_path is not null").select(
        F.col("index").cast("long").alias("index"),
        F.lit(task).alias("task"),
        F.struct(F.col("audio_path"), F.when(F.lit(with_prompt), content).alias("model_prompt")).alias("input"),
        F.struct(
            F.coalesce(F.nullif("subset", F.lit("")), F.lit(default_subset)).alias("subset"),
            "answer",
            content.alias("audio_content"),
            "instruction",
            "instruction_kwargs",
            F.col("answer").alias("reference_text"),
        ).alias("evaluation"),
        F.struct(safe_stem(F.col("audio_path")).alias("sample_id")).alias("metadata"),
    )


def request_error(row: str = "request") -> Column:
    """First defect of a request column: index, task, text for tts, audio for the other tasks."""
    r = F.col(row)
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    task = r["task"]
    return (
        F.when(r["index"].isNull(), "index")
        .when(~F.coalesce(task.isin("tts", "asr", "audio_qa", "s2s"), F.lit(False)), "task")
        .when((task == "tts") & blank(r["input"]["text"]), "text")
        .when((task != "tts") & blank(r["input"]["audio_path"]), "audio_path")
    )


def eval_rows(items: DataFrame, traces: DataFrame, index: str = "index", only_traced: bool = False) -> DataFrame:
    """Items with their traces; an item without a trace gets the prediction ``null`` (or leaves)."""
    joined = items.join(traces, index, "inner" if only_traced else "left")
    return joined.withColumn("prediction", F.coalesce("prediction", F.lit("null")))


def pending(items: DataFrame, done: DataFrame, index: str = "index") -> DataFrame:
    return items.join(done.select(index).distinct(), index, "left_anti")


def cached_scores(rows: DataFrame, cache: DataFrame, keys: list[str], judged: str) -> DataFrame:
    """Adds score from valid cached judgements that agree on every key; null where one must be asked."""
    valid = cache.withColumn("score", judge_score(F.col(judged))).where("score is not null")
    best = valid.groupBy(*keys).agg(F.max("score").alias("score"))
    return rows.join(best, keys, "left")


def judge_mean(rows: DataFrame, groups: list[str], score: str) -> DataFrame:
    """Mean score to 2 places where every row of the group has one, else null; with the rows still missing."""
    return rows.groupBy(*groups).agg(
        F.when(F.count(F.lit(1)) == F.count(score), F.round(F.avg(score), 2)).alias("mean_score"), F.count_if(F.col(score).isNull()).alias("missing"), F.count(F.lit(1)).alias("rows")
    )


def word_error_rate(rows: DataFrame, groups: list[str], reference: str, hypothesis: str) -> DataFrame:
    """Word edits over reference words, summed over each group."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce(reference, F.lit(""))), r"\s+"), lambda w: w != ""))
    scored = rows.withColumn("__e", word_edit_distance(reference, hypothesis)).withColumn("__w", words)
    return scored.groupBy(*groups).agg(F.sum("__e").alias("edits"), F.sum("__w").alias("words"), (F.sum("__e") / F.nullif(F.sum("__w"), F.lit(0))).alias("wer"))


def plan_jobs(items: DataFrame, subset: str, modes: list[str], devices: int = 1) -> DataFrame:
    """Every subset with every mode and a device by turns: a small table made from distinct subsets."""
    jobs = items.select(subset).where(F.col(subset).isNotNull()).distinct().withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    number = F.row_number().over(Window.orderBy(subset, "mode")) - 1  # one row per subset and mode
    return jobs.withColumn("device", (number % devices).cast("int"))


def parse_traces(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """Trace lines with error: the first broken rule, in fixed order; null for a sound record.

    Rules: a JSON object, the required fields, an integer index that is no boolean, an index not seen on an earlier line,
    evaluation is an object with reference_text and prediction_text (texts or null) and subset or group.
    """
    j = F.col(line)
    kind = lambda path: F.schema_of_variant(F.variant_get(F.col("__v"), path, "variant"))
    parsed = lines.withColumn("__v", F.try_parse_json(j))
    root = F.schema_of_variant("__v")
    index = F.try_variant_get("__v", "$.index", "bigint")
    missing = F.lit(False)
    for name in TRACE_FIELDS:
        missing = missing | kind(f"$.{name}").isNull()
    parsed = parsed.withColumn("index", F.when(kind("$.index") == "BIGINT", index))
    first = parsed.where("index is not null").groupBy("index").agg(F.min(number).alias("__first"))
    parsed = parsed.join(first, "index", "left")
    evaluation = kind("$.evaluation")
    has = lambda name: kind(f"$.evaluation.{name}").isNotNull()
    text = lambda name: kind(f"$.evaluation.{name}").isin("STRING", "VOID")
    error = (
        F.when(F.col("__v").isNull() | ~root.startswith("OBJECT"), "not_an_object")
        .when(missing, "missing_field")
        .when(F.col("index").isNull(), "index_not_integer")
        .when(F.col(number) > F.col("__first"), "duplicate_index")
        .when(~evaluation.startswith("OBJECT"), "evaluation_not_object")
        .when(~has("reference_text") | ~has("prediction_text"), "missing_text")
        .when(~has("subset") & ~has("group"), "missing_group")
        .when(~text("reference_text") | ~text("prediction_text"), "text_not_string")
    )
    return parsed.withColumn("error", error).drop("__v", "__first")


def error_rate_rows(traces: DataFrame, default_subset: str = "items") -> DataFrame:
    """Eval rows for error rates: reference or answer, transcription before direct text, subset or group."""
    direct = direct_text(F.col("output_text"), F.col("output_audio"), F.col("prediction_text"))
    heard = audio_text(F.col("transcription"), F.col("output_audio"), F.col("prediction_text"))
    return traces.select(
        "index",
        F.coalesce(F.nullif("subset", F.lit("")), F.nullif("group", F.lit("")), F.lit(default_subset)).alias("subset"),
        F.coalesce(F.nullif("reference_text", F.lit("")), "answer", F.lit("")).alias("answer"),
        selected_prediction(direct, heard, "auto").alias("prediction"),
        F.nullif(direct, F.lit("")).alias("prediction_text"),
        F.nullif("output_audio", F.lit("")).alias("audio_path"),
    )


def resolved_rate(explicit: Column, stored: Column, default: Column) -> Column:
    """Explicit before stored before default."""
    return F.coalesce(explicit, stored, default).cast("double")


def resolved_sample_rate(result: Column, engine: Column, fallback: Column, flow_matching: Column) -> Column:
    """First positive rate; 16 kHz under a flow-matching decoder is really 24 kHz, which is also its default."""
    positive = lambda c: F.when(c.try_cast("int") > 0, c.try_cast("int"))
    rate = F.coalesce(positive(result), positive(engine), positive(fallback))
    native = F.when(flow_matching, 24000).otherwise(16000)
    return F.coalesce(F.when(flow_matching & (rate == 16000), 24000).otherwise(rate), native)
