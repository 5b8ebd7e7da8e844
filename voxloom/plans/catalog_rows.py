"""Queries over derived rows: length vectors, prompts, recordings, rates and shard plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import chat, lengths
from voxloom.operators import evaluate, sampling
from voxloom.plans.registry import query
from voxloom.session import table

_SAID = "list_filter(messages, lambda m: m.role IN ('assistant', 'gpt') AND m.content IS NOT NULL)[1].content"


@query("""
WITH c AS MATERIALIZED (SELECT row_id, messages, audio_tokens, num_tokens_est FROM tts),
l AS (SELECT row_id, num_tokens_est AS est, coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role IN ('user', 'human')), lambda m: coalesce(length(m.content), 0))), 0)::BIGINT // 4 AS u,
  coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role IN ('assistant', 'gpt')), lambda m: coalesce(length(m.content), 0))), 0)::BIGINT // 4 AS a, coalesce(list_sum(audio_tokens), 0)::BIGINT AS s FROM c)
SELECT row_id, u AS user_text_tokens, a AS assistant_text_tokens, 0::BIGINT AS user_audio_tokens, s AS assistant_audio_tokens, greatest(0, coalesce(est, 0) - u - a - s)::BIGINT AS codec_tokens FROM l""")
def length_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    audio = F.aggregate("audio_tokens", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(t, F.lit(0).cast("long")))
    vector = lengths.length_vector(lengths.text_tokens(chat.users(m)), lengths.text_tokens(chat.assistants(m)), F.lit(0), audio, F.col("num_tokens_est"))
    return table(spark, d, "tts").select("row_id", vector.alias("v")).select("row_id", "v.*")


@query(f"""
WITH t AS (SELECT row_id, replace({_SAID}, '<|audio|>', '') AS said, audios[1] AS audio, audio_durations[1] AS sec FROM tts),
k AS (SELECT row_id, said, audio, floor(round(sec, 3) * 17)::BIGINT AS tokens FROM t WHERE length(said) > 0 AND audio IS NOT NULL AND sec > 0 AND NOT isnan(sec))
SELECT row_id, 'tts' AS task, ((34 + 2 * length(said) + 9) // 4 + tokens)::BIGINT AS num_tokens_est, 2 AS messages FROM k
UNION ALL SELECT row_id, 'asr', (({len(chat.TEXT_ONLY_PERSONA) + len(chat.ASR_PROMPT) + 9} + length(said)) // 4 + tokens)::BIGINT, 3 FROM k""")
def recording_rows(spark: SparkSession, d: str) -> DataFrame:
    """A speech-synthesis and a recognition row of every recording."""
    said = F.try_element_at(F.filter("messages", lambda m: m["role"].isin("assistant", "gpt") & m["content"].isNotNull()), F.lit(1))["content"]
    rows = table(spark, d, "tts").select(
        "row_id", F.replace(said, F.lit("<|audio|>"), F.lit("")).alias("said"), F.try_element_at("audios", F.lit(1)).alias("audio"), F.try_element_at("audio_durations", F.lit(1)).alias("sec")
    )
    rows = rows.where("length(said) > 0 and audio is not null and sec > 0 and not isnan(sec)")
    made = rows.select("row_id", F.explode(chat.speech_rows(F.col("said"), F.col("audio"), F.col("sec"))).alias("r"))
    return made.select("row_id", "r.task", "r.num_tokens_est", F.size("r.messages").alias("messages"))


@query("""
SELECT source_name, count(*) AS records, round(sum(s) / 3600, 6) AS hours FROM (SELECT source_name, unnest(audio_durations) AS s FROM tts) WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1""")
def corpus_hours(spark: SparkSession, d: str) -> DataFrame:
    seconds = table(spark, d, "tts").select("source_name", F.explode("audio_durations").alias("s")).where("s is not null and not isnan(s)")
    return seconds.groupBy("source_name").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("s") / 3600, 6).alias("hours"))


@query("""
SELECT row_id, place, CASE WHEN length(p) > 0 AND NOT starts_with(p, '/') THEN '/corpus/' || p ELSE p END AS path, kept::INT AS kept FROM (
  SELECT row_id, unnest(range(len(audios)))::INT AS place, unnest(audios) AS p, len(messages) - CASE WHEN messages[1].role = 'system' THEN 1 ELSE 0 END AS kept FROM tts)""")
def absolute_paths(spark: SparkSession, d: str) -> DataFrame:
    """Absolute audio paths and the number of messages without a leading system message."""
    rows = table(spark, d, "tts").select("row_id", F.size(chat.without_system(F.col("messages"))).alias("kept"), F.posexplode("audios").alias("place", "p"))
    return rows.select("row_id", "place", chat.absolute_path(F.col("p"), "/corpus").alias("path"), "kept")


@query(f"""
WITH t AS (SELECT "index", question, "index" % 3 <> 0 AS heard, "index" % 4 <> 0 AS spoken FROM benchmark_items)
SELECT "index", md5('<|im_start|>system' || chr(10) || CASE WHEN heard AND spoken THEN '{chat.SYSTEM_PROMPTS["s2s"].replace("'", "''")}' WHEN heard THEN '{chat.SYSTEM_PROMPTS["s2t"].replace("'", "''")}'
  WHEN spoken THEN '{chat.SYSTEM_PROMPTS["t2s"]}' ELSE '{chat.SYSTEM_PROMPTS["t2t"]}' END || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || question || CASE WHEN heard THEN '<|begin_of_audio|>' ELSE '' END) AS head FROM t""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    made = chat.prompt_text(F.col("question"), F.col("index") % 3 != 0, F.col("index") % 4 != 0)
    return table(spark, d, "benchmark_items").select("index", F.md5(made["head"]).alias("head"))


@query("""
WITH v AS (SELECT vec_id, least(greatest(vec_id % 20, 0), 15) / 15.0::DOUBLE AS x FROM embeddings), k AS (SELECT vec_id, x, unnest(range(4)) AS k FROM v)
SELECT vec_id, k::INT AS dim, round(sin(x * pow(10000.0::DOUBLE, -k / 4.0::DOUBLE)), 9) AS value FROM k UNION ALL SELECT vec_id, (k + 4)::INT, round(cos(x * pow(10000.0::DOUBLE, -k / 4.0::DOUBLE)), 9) FROM k""")
def rate_embeddings(spark: SparkSession, d: str) -> DataFrame:
    made = lengths.rate_embedding((F.col("vec_id") % 20).cast("double"), 8)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(made).alias("dim", "value")).withColumn("value", F.round("value", 9))


@query("SELECT doc_id, ['s2s', 's2t', 't2s'][((doc_id // 4 + doc_id % 4) % 3 + 1)] AS choice FROM documents")
def option_rotation(spark: SparkSession, d: str) -> DataFrame:
    options = F.array(F.lit("s2s"), F.lit("s2t"), F.lit("t2s"))
    return table(spark, d, "documents").select("doc_id", sampling.rotated_option(options, F.floor(F.col("doc_id") / 4), F.col("doc_id") % 4).alias("choice"))


_DRAW = "('0x' || substring(sha256('9:2:' || consumer || ':' || slot), 1, 13))::BIGINT / 4503599627370496.0"


@query(f"""
WITH s AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS p FROM (SELECT DISTINCT url FROM shard_manifest WHERE url IS NOT NULL)),
k AS (SELECT (id % 4)::INT AS consumer, id // 4 AS slot FROM (SELECT unnest(range(200)) AS id)),
w AS (SELECT consumer, slot, floor({_DRAW} * (SELECT count(*) FROM s))::BIGINT AS p FROM k) SELECT consumer, slot, url FROM w JOIN s USING (p)""")
def resampled_plan(spark: SparkSession, d: str) -> DataFrame:
    """50 shards with repetition for each of 4 consumers."""
    return sampling.consumer_plan(table(spark, d, "shard_manifest"), "url", "resampled", 4, 9, 2, 50)


@query("""
SELECT "index", coalesce(nullif(subset, ''), 'items') AS subset, coalesce(nullif(question, ''), answer, '') AS answer,
  coalesce(nullif(CASE WHEN "index" % 4 = 1 AND lower(trim(question)) <> 'null' THEN question WHEN "index" % 4 <> 1 OR answer IS NULL THEN '' END, ''),
    nullif(coalesce(CASE WHEN lower(trim(answer)) <> 'null' THEN answer END, CASE WHEN "index" % 4 = 1 THEN '' END, CASE WHEN lower(trim(question)) <> 'null' THEN question END, ''), ''), 'null') AS prediction FROM benchmark_items""")
def error_rate_rows(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark_items")
    traces = items.select(
        "index", "subset", F.lit(None).cast("string").alias("group"), F.col("question").alias("reference_text"), "answer", F.col("answer").alias("output_text"),
        F.when(F.col("index") % 4 == 1, "x.wav").alias("output_audio"), F.col("question").alias("prediction_text"), F.lit(None).cast("string").alias("transcription"),
    )
    return evaluate.error_rate_rows(traces).select("index", "subset", "answer", "prediction")
