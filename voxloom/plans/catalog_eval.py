"""Queries over requests, traces, scores, counters and losses.

The data holds benchmark items but no traces; traces are made from the items in the same way in both engines: every item
whose index leaves no remainder by 13 lacks one, and the texts alternate between filled, empty and the word null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import evaluate, layouts, metrics
from voxloom.plans.registry import query
from voxloom.session import table

_TRACES = """SELECT "index", CASE "index" % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Null ' WHEN 2 THEN '' ELSE answer END AS output_text, CASE WHEN "index" % 4 = 1 THEN 'out/' || "index" || '.wav' WHEN "index" % 4 = 2 THEN '' END AS output_audio,
  CASE "index" % 7 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE question END AS prediction_text, CASE WHEN "index" % 11 = 0 THEN 'heard ' || "index" END AS transcription FROM benchmark_items WHERE "index" % 13 <> 0"""


def _traces(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("index")
    rows = table(spark, d, "benchmark_items").where(i % 13 != 0)
    return rows.select(
        "index",
        F.when(i % 5 == 0, None).when(i % 5 == 1, " Null ").when(i % 5 == 2, "").otherwise(F.col("answer")).alias("output_text"),
        F.when(i % 4 == 1, F.concat(F.lit("out/"), i.cast("string"), F.lit(".wav"))).when(i % 4 == 2, "").alias("output_audio"),
        F.when(i % 7 == 0, None).when(i % 7 == 1, "null").otherwise(F.col("question")).alias("prediction_text"),
        F.when(i % 11 == 0, F.concat(F.lit("heard "), i.cast("string"))).alias("transcription"),
    )


_REAL = "CASE WHEN lower(trim({x})) <> 'null' THEN {x} END"
_PREDICTED = f"""p AS (SELECT "index", coalesce({_REAL.format(x="output_text")}, CASE WHEN length(output_audio) > 0 THEN '' END, {_REAL.format(x="prediction_text")}, '') AS direct,
  coalesce(nullif(transcription, ''), CASE WHEN length(output_audio) > 0 THEN {_REAL.format(x="prediction_text")} END, '') AS audio FROM ({_TRACES}))"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    out, audio, text = F.col("output_text"), F.col("output_audio"), F.col("prediction_text")
    return _traces(spark, d).select("index", evaluate.direct_text(out, audio, text).alias("direct"), evaluate.audio_text(F.col("transcription"), audio, text).alias("audio"))


@query(f"WITH {_PREDICTED} SELECT \"index\", coalesce(nullif(coalesce(nullif(audio, ''), direct), ''), 'null') AS auto, coalesce(nullif(direct, ''), 'null') AS direct_text, coalesce(nullif(audio, ''), 'null') AS audio_asr FROM p")
def prediction_select(spark: SparkSession, d: str) -> DataFrame:
    direct, audio = F.col("direct"), F.col("audio")
    return _predicted(spark, d).select("index", *[evaluate.selected_prediction(direct, audio, s).alias(s) for s in ("auto", "direct_text", "audio_asr")])


@query(f"WITH {_PREDICTED} SELECT b.\"index\", b.subset, b.answer, coalesce(coalesce(nullif(coalesce(nullif(audio, ''), direct), ''), 'null'), 'null') AS prediction FROM benchmark_items b LEFT JOIN p USING (\"index\")")
def eval_left_join(spark: SparkSession, d: str) -> DataFrame:
    made = _predicted(spark, d).select("index", evaluate.selected_prediction(F.col("direct"), F.col("audio")).alias("prediction"))
    return evaluate.eval_rows(table(spark, d, "benchmark_items").select("index", "subset", "answer"), made)


@query('SELECT "index", coalesce(CASE WHEN length(trim(instruction)) > 0 THEN instruction END, CASE WHEN length(trim(audio_content)) > 0 THEN audio_content END, CASE WHEN length(trim(question)) > 0 THEN question END, \'\') AS prompt FROM benchmark_items')
def prompt_priority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_items").select("index", evaluate.first_filled(F.col("instruction"), F.col("audio_content"), F.col("question")).alias("prompt"))


@query(r"""
SELECT "index", 'audio_qa' AS task, audio_path, coalesce(audio_content, '') AS model_prompt, coalesce(nullif(subset, ''), 'items') AS subset, answer, instruction,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(audio_path, '^.*/', ''), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '0') AS sample_id
FROM benchmark_items WHERE audio_path IS NOT NULL""")
def request_build(spark: SparkSession, d: str) -> DataFrame:
    made = evaluate.build_requests(table(spark, d, "benchmark_items"), "audio_qa", True)
    return made.select("index", "task", "input.audio_path", "input.model_prompt", "evaluation.subset", "evaluation.answer", "evaluation.instruction", "metadata.sample_id")


@query("SELECT subset, count(*) AS items, count(audio_path) AS with_audio FROM benchmark_items GROUP BY 1")
def subset_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_items").groupBy("subset").agg(F.count(F.lit(1)).alias("items"), F.count("audio_path").alias("with_audio"))


@query(f'SELECT "index" FROM benchmark_items WHERE "index" NOT IN (SELECT "index" FROM ({_TRACES}))')
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pending(table(spark, d, "benchmark_items").select("index"), _traces(spark, d))


@query("""WITH j AS (SELECT subset, mode FROM (SELECT DISTINCT subset FROM benchmark_items WHERE subset IS NOT NULL), (SELECT unnest(['s2s', 's2t']) AS mode))
SELECT subset, mode, ((row_number() OVER (ORDER BY subset, mode) - 1) % 3)::INT AS device FROM j""")
def plan_cross(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.plan_jobs(table(spark, d, "benchmark_items"), "subset", ["s2s", "s2t"], 3)


_JUDGED = "CASE \"index\" % 6 WHEN 0 THEN '[[' || (\"index\" % 5 + 1) || ']]' WHEN 1 THEN (\"index\" % 7)::VARCHAR WHEN 2 THEN 'no score' WHEN 3 THEN NULL ELSE '4' END"
_CACHE = f"""c AS (SELECT "index", question, answer AS prediction, {_JUDGED} AS judged FROM benchmark_items WHERE "index" % 2 = 0 OR "index" % 5 = 0),
v AS (SELECT "index", question, prediction, max(s) AS score FROM (SELECT *, coalesce(try_cast(judged AS DOUBLE), try_cast(nullif(regexp_extract(judged, '\\[\\[(\\d+(?:\\.\\d+)?)\\]\\]', 1), '') AS DOUBLE)) AS s FROM c) WHERE s BETWEEN 1 AND 5 GROUP BY ALL),
s AS (SELECT b."index", b.subset, v.score FROM benchmark_items b LEFT JOIN v ON b."index" = v."index" AND b.question = v.question AND b.answer = v.prediction)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark_items")
    i = F.col("index")
    judged = (
        F.when(i % 6 == 0, F.concat(F.lit("[["), (i % 5 + 1).cast("string"), F.lit("]]"))).when(i % 6 == 1, (i % 7).cast("string")).when(i % 6 == 2, "no score").when(i % 6 == 3, None).otherwise("4")
    )
    cache = items.where((i % 2 == 0) | (i % 5 == 0)).select("index", "question", F.col("answer").alias("prediction"), judged.alias("judged"))
    rows = items.select("index", "subset", "question", F.col("answer").alias("prediction"))
    return evaluate.cached_scores(rows, cache, ["index", "question", "prediction"], "judged")


@query(f'WITH {_CACHE} SELECT "index", score FROM s')
def judge_cache_join(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("index", "score")


@query(f"WITH {_CACHE} SELECT subset, CASE WHEN count(*) = count(score) THEN round(avg(score), 2) END AS mean_score, count(*) - count(score) AS missing, count(*) AS rows FROM s GROUP BY 1")
def judge_mean(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judge_mean(_scored(spark, d), ["subset"], "score")


@query("SELECT source, stage, error, count(*) AS errors, count(member) AS with_member, max(length(detail))::INT AS longest_detail FROM quarantine GROUP BY 1, 2, 3")
def error_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_rollup(table(spark, d, "quarantine"), ["source", "stage", "error"])


@query("""SELECT event_type, count(w) AS waits, count(*) FILTER (w >= 50) AS over_50, count(*) FILTER (w >= 100) AS over_100, count(*) FILTER (w >= 500) AS over_500, count(*) FILTER (w >= 1000) AS over_1000,
  round(avg(w), 6) AS mean_wait, max(w) AS max_wait FROM (SELECT event_type, CASE WHEN NOT isnan(value) THEN value END AS w FROM events) GROUP BY 1""")
def wait_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.wait_histogram(table(spark, d, "events"), "value", ["event_type"]).withColumn("mean_wait", F.round("mean_wait", 6))


_LOSSES = """losses AS (SELECT event_id, user_id AS step, (event_id % 4)::INT AS rank, event_id % 6 AS task_id, event_type AS component, (event_id % 13) AS tokens,
  CASE WHEN event_id % 401 = 0 THEN 'nan'::DOUBLE WHEN event_id % 503 = 0 THEN 'inf'::DOUBLE ELSE value END AS loss FROM events)"""


def _losses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    loss = F.when(i % 401 == 0, float("nan")).when(i % 503 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("step"), (i % 4).cast("int").alias("rank"), (i % 6).alias("task_id"), F.col("event_type").alias("component"), (i % 13).alias("tokens"), loss.alias("loss")
    )


_OK = "loss IS NOT NULL AND NOT isnan(loss) AND NOT isinf(loss)"


@query(f"""WITH {_LOSSES} SELECT component, round(CASE WHEN sum(CASE WHEN {_OK} THEN tokens END) > 0 THEN sum(CASE WHEN {_OK} THEN loss * tokens END) / sum(CASE WHEN {_OK} THEN tokens END) END, 6) AS mean,
  count(*) FILTER ({_OK}) AS finite, count(*) AS seen FROM losses GROUP BY 1""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weighted_mean(_losses(spark, d), "loss", "tokens", ["component"]).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_LOSSES}, p AS (SELECT task_id, component, sum(loss) AS total, count(*) AS n FROM losses WHERE {_OK} GROUP BY 1, 2)
SELECT task_id, component, n, round(total / n, 6) AS mean, round(sum(total / n) OVER (PARTITION BY task_id), 6) AS task_total FROM p""")
def task_component_loss(spark: SparkSession, d: str) -> DataFrame:
    finite = _losses(spark, d).where("abs(loss) < double('infinity')")
    made = metrics.task_losses(finite, "task_id", "component", "loss")
    return made.select("task_id", "component", "n", F.round("mean", 6).alias("mean"), F.round("task_total", 6).alias("task_total"))


@query(f"WITH {_LOSSES} SELECT event_id, loss * 4 / nullif(sum(tokens) OVER (PARTITION BY step), 0) AS normalized FROM losses WHERE {_OK}")
def normalized_loss(spark: SparkSession, d: str) -> DataFrame:
    finite = _losses(spark, d).where("abs(loss) < double('infinity')").withColumn("world", F.lit(4))
    return metrics.normalized_losses(finite, "step", "loss", "tokens", "world").select("event_id", "normalized")


@query(f"""WITH {_LOSSES}, b AS (SELECT DISTINCT step FROM losses WHERE loss IS NULL OR isnan(loss) OR isinf(loss) OR (step > 100 AND loss > 400))
SELECT event_id, step FROM losses WHERE step NOT IN (SELECT step FROM b)""")
def step_reject(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rejected_steps(_losses(spark, d), "step", "loss", most=400.0, after=100).select("event_id", "step")


@query(f"WITH {_LOSSES} SELECT event_id, (sum(tokens) OVER (PARTITION BY step ORDER BY event_id))::BIGINT AS total FROM losses")
def samples_seen(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_total(_losses(spark, d), ["step"], "event_id", "tokens").select("event_id", "total")


@query("""WITH o AS (SELECT subset, count(*) AS n, 'old' AS state FROM benchmark_items WHERE "index" % 2 = 0 AND subset <> 'open_chat' GROUP BY 1), n AS (SELECT subset, count(*) AS n, 'new' AS state FROM benchmark_items WHERE subset <> 'lantern_qa' GROUP BY 1)
SELECT subset, CASE WHEN n.subset IS NOT NULL THEN n.n ELSE o.n END AS n, CASE WHEN n.subset IS NOT NULL THEN n.state ELSE o.state END AS state FROM o FULL JOIN n USING (subset)""")
def summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark_items")
    old = items.where("`index` % 2 = 0 and subset <> 'open_chat'").groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.lit("old").alias("state"))
    new = items.where("subset <> 'lantern_qa'").groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.lit("new").alias("state"))
    return metrics.upsert(old, new, "subset")


@query("""SELECT coalesce(c.url, m.url) AS url, CASE WHEN m.url IS NULL THEN 'unexpected' WHEN c.url IS NULL THEN 'missing' WHEN c.n IS DISTINCT FROM m.n THEN 'mismatch' END AS kind
FROM (SELECT url, count(*) AS n FROM shard_manifest WHERE url IS NOT NULL GROUP BY 1) m FULL JOIN (SELECT shard_url AS url, 1 AS n FROM canonical_samples WHERE shard_url IS NOT NULL GROUP BY 1) c ON c.url = m.url
WHERE m.url IS NULL OR c.url IS NULL OR c.n <> m.n""")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    """Manifest shards against shards that hold samples: missing, unexpected, or listed more than once."""
    listed = table(spark, d, "shard_manifest").where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    held = table(spark, d, "canonical_samples").where("shard_url is not null").groupBy(F.col("shard_url").alias("url")).agg(F.lit(1).cast("long").alias("n"))
    return metrics.key_diff(listed, held, "url", "n")


@query(r"SELECT uid, nullif(regexp_extract(path, '^((?:.*/|)[^.]+)[.]([^/]*)$', 1), '') AS key, nullif(regexp_extract(path, '^((?:.*/|)[^.]+)[.]([^/]*)$', 2), '') AS suffix FROM (SELECT DISTINCT uid, physical_key || '.' || task || '.json' AS path FROM canonical_samples WHERE uid IS NOT NULL)")
def member_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "canonical_samples").where("uid is not null").select("uid", F.concat("physical_key", F.lit("."), "task", F.lit(".json")).alias("path")).distinct()
    return names.select("uid", layouts.split_member(F.col("path")).alias("m")).select("uid", "m.key", "m.suffix")


#: Trace lines that break each rule once, in this order of rules.
TRACE_LINES = (
    '{"index": 1, "task": "tts", "input": {}, "output": {}, "evaluation": {"reference_text": "a", "prediction_text": null, "subset": "x"}, "metadata": {}}',
    "[1, 2]",
    "not json",
    '{"index": 2, "task": "tts"}',
    '{"index": true, "task": "tts", "input": {}, "output": {}, "evaluation": {}, "metadata": {}}',
    '{"index": "3", "task": "tts", "input": {}, "output": {}, "evaluation": {}, "metadata": {}}',
    '{"index": 1, "task": "tts", "input": {}, "output": {}, "evaluation": {"reference_text": "a", "prediction_text": "b", "subset": "x"}, "metadata": {}}',
    '{"index": 4, "task": "tts", "input": {}, "output": {}, "evaluation": "none", "metadata": {}}',
    '{"index": 5, "task": "tts", "input": {}, "output": {}, "evaluation": {"reference_text": "a", "subset": "x"}, "metadata": {}}',
    '{"index": 6, "task": "tts", "input": {}, "output": {}, "evaluation": {"reference_text": "a", "prediction_text": "b"}, "metadata": {}}',
    '{"index": 7, "task": "tts", "input": {}, "output": {}, "evaluation": {"reference_text": 5, "prediction_text": "b", "group": "g"}, "metadata": {}}',
    '{"index": 8, "task": "tts", "input": {}, "output": {}, "evaluation": {"reference_text": "a", "prediction_text": "b", "group": "g"}, "metadata": {}}',
)
_LINES = ", ".join(f"({i}, '{line}')" for i, line in enumerate(TRACE_LINES))


@query(f"""
WITH l AS (SELECT * FROM (VALUES {_LINES}) t(line_no, value)), j AS (SELECT line_no, CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN value::JSON END AS j FROM l),
k AS (SELECT *, CASE WHEN json_type(j, '$.index') IN ('BIGINT', 'UBIGINT') THEN (j->>'$.index')::BIGINT END AS "index", json_type(j, '$.evaluation.reference_text') AS r, json_type(j, '$.evaluation.prediction_text') AS p FROM j),
m AS (SELECT *, min(CASE WHEN "index" IS NOT NULL THEN line_no END) OVER (PARTITION BY "index") AS first FROM k)
SELECT line_no::INT AS line_no, CASE WHEN j IS NULL THEN 'not_an_object' WHEN len(list_filter(['index', 'task', 'input', 'output', 'evaluation', 'metadata'], lambda f: NOT json_exists(j, '$.' || f))) > 0 THEN 'missing_field'
  WHEN "index" IS NULL THEN 'index_not_integer' WHEN line_no > first THEN 'duplicate_index' WHEN json_type(j, '$.evaluation') <> 'OBJECT' THEN 'evaluation_not_object' WHEN r IS NULL OR p IS NULL THEN 'missing_text'
  WHEN NOT json_exists(j, '$.evaluation.subset') AND NOT json_exists(j, '$.evaluation.group') THEN 'missing_group' WHEN r NOT IN ('VARCHAR', 'NULL') OR p NOT IN ('VARCHAR', 'NULL') THEN 'text_not_string' END AS error FROM m""")
def trace_validate(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(TRACE_LINES)), "line_no int, value string")
    return evaluate.parse_traces(lines).select("line_no", "error")


@query(r"""WITH p AS (SELECT source_name, replace(list_filter(messages, lambda m: m.role IN ('assistant', 'gpt'))[1].content, '<|audio|>', '') AS ref,
  coalesce(regexp_replace(list_filter(messages, lambda m: m.role IN ('user', 'human'))[1].content, '^[^:>\n]*[:>\n] ?', ''), '') AS hyp FROM tts),
w AS (SELECT source_name, list_filter(regexp_split_to_array(ref, '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(hyp, '\s+'), lambda x: x <> '') AS b FROM p WHERE length(ref) > 0),
d AS (SELECT *, list_distinct(list_concat(a, b)) AS v FROM w),
e AS (SELECT source_name, len(a) AS words, levenshtein(array_to_string(list_transform(a, lambda x: chr(list_position(v, x)::INT)), ''), array_to_string(list_transform(b, lambda x: chr(list_position(v, x)::INT)), '')) AS edits FROM d)
SELECT source_name, sum(edits)::BIGINT AS edits, sum(words)::BIGINT AS words, sum(edits) / nullif(sum(words), 0) AS wer FROM e GROUP BY source_name""")
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Word error rate of the user prompts of chat rows against the spoken texts.

    The SQL gives every word of a pair a letter of its own (up to 127 different words) and takes the letter distance.
    """
    rows = table(spark, d, "tts")
    last = F.try_element_at(F.filter("messages", lambda m: m["role"].isin("assistant", "gpt")), F.lit(1))["content"]
    first = F.try_element_at(F.filter("messages", lambda m: m["role"].isin("user", "human")), F.lit(1))["content"]
    pairs = rows.select("source_name", F.replace(last, F.lit("<|audio|>"), F.lit("")).alias("ref"), F.regexp_replace(first, "^[^:>\n]*[:>\n] ?", "").alias("hyp"))
    return evaluate.word_error_rate(pairs.where("length(ref) > 0"), ["source_name"], "ref", "hyp")


@query()
def spoken_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Spoken form of every document: emoji removed, ordinals as words, sentences capitalized."""
    from voxloom.functions.text import normalize_spoken

    return table(spark, d, "documents").select("doc_id", normalize_spoken(F.col("text")).alias("spoken"))
