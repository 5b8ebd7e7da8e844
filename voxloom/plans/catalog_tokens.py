"""Queries over shuffles, token choices, packed targets, refilled batches and spelled numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import chat, text
from voxloom.operators import batching, filters, sampling, segments
from voxloom.operators.ranking import seeded
from voxloom.plans.catalog_batches import _LATEST, _U, FIELDS, LIMITS, _latest
from voxloom.plans.registry import query
from voxloom.session import table


@query(f"WITH {_LATEST}, p AS (SELECT uid, shard_url, total, (row_number() OVER (PARTITION BY shard_url ORDER BY uid) - 1) // 8 AS batch FROM latest), o AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY shard_url, batch ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM p) SELECT uid, batch, greatest(o - 1, 0)::BIGINT AS first_target, (total - CASE WHEN o = 0 AND total > 0 THEN 1 ELSE 0 END)::BIGINT AS targets FROM o")
def packed_targets(spark: SparkSession, d: str) -> DataFrame:
    """Which of the shifted losses of its packed batch each sample owns."""
    chunks = batching.ordered_chunks(_latest(spark, d), ["shard_url"], "uid", 8)
    packed = batching.pack_offsets(chunks, ["shard_url", "batch"], "uid", "total")
    return segments.target_spans(packed, "offset", "total").select("uid", "batch", "first_target", "targets")


@query("SELECT row_id, list_append(audio_tokens[2:], -100)::VARCHAR AS labels FROM tts WHERE len(audio_tokens) > 0")
def shifted_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every token list shifted by one position."""
    rows = table(spark, d, "tts").where("size(audio_tokens) > 0")
    shown = F.transform(segments.shifted(F.col("audio_tokens")), lambda x: F.coalesce(x.cast("string"), F.lit("NULL")))
    return rows.select("row_id", F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("labels"))


@query(f"""WITH p AS (SELECT row_id, speaker, (row_number() OVER (PARTITION BY speaker ORDER BY num_tokens_est NULLS FIRST, row_id) - 1) AS position FROM tts),
w AS (SELECT *, position // 50 AS w FROM p)
SELECT row_id, (w * 50 + row_number() OVER (PARTITION BY speaker, w ORDER BY {_U.format(seed=23, key="row_id")}, row_id) - 1)::BIGINT AS place FROM w""")
def window_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Rows sorted by tokens and shuffled inside windows of 50."""
    rows = table(spark, d, "tts").select("row_id", "speaker", "num_tokens_est")
    return sampling.window_shuffle(rows, ["speaker"], ["num_tokens_est", "row_id"], "row_id", 50, 23).select("row_id", "place")


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, source, n_chars AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
f AS (SELECT source, rn, doc_id, c AS total, 1 AS held, 0 AS block FROM o WHERE rn = 1 UNION ALL
  SELECT o.source, o.rn, o.doc_id, CASE WHEN s.fresh THEN o.c ELSE f.total + o.c END, CASE WHEN s.fresh THEN 1 ELSE f.held + 1 END, CASE WHEN s.fresh THEN f.block + 1 ELSE f.block END
  FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1, LATERAL (SELECT f.held >= 20 OR f.total + o.c > 12000 AS fresh) s)
SELECT doc_id, block, (row_number() OVER (PARTITION BY source, block ORDER BY {_U.format(seed=29, key="doc_id")}, doc_id) - 1)::INT AS place FROM f""")
def bounded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source shuffled inside a buffer of 20 rows and 12,000 characters."""
    rows = table(spark, d, "documents").where("source is not null and n_chars is not null").select("doc_id", "source", "n_chars")
    return batching.bounded_shuffle(rows, ["source"], ["doc_id"], "doc_id", "n_chars", 20, 12_000, 29).select("doc_id", F.col("batch").alias("block"), "place")


_LOGITS = "l AS (SELECT user_id, event_type, count(*) / 2.0 AS l FROM events GROUP BY ALL)"


@query(f"""WITH {_LOGITS}, k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY l DESC) AS r FROM (SELECT user_id, event_type, l / 0.7 AS l FROM l)),
w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY user_id)) AS w FROM k WHERE r <= 4),
b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY user_id ORDER BY l DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY user_id) AS t FROM w),
n AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS kept FROM b WHERE before <= 0.9 * t)
SELECT user_id, arg_max(event_type, before) AS event_type FROM n WHERE before <= {_U.format(seed=31, key="user_id")} * kept GROUP BY user_id""")
def token_sample(spark: SparkSession, d: str) -> DataFrame:
    """One event type for each user, drawn under temperature 0.7, top 4 and share 0.9."""
    logits = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) / 2.0).alias("l"))
    return sampling.next_token(logits, "user_id", "event_type", "l", 0.7, 4, 0.9, 31)


@query(f"WITH {_LOGITS} SELECT user_id, arg_min(event_type, (-l, event_type)) AS event_type FROM l GROUP BY user_id")
def token_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest event type of each user."""
    logits = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) / 2.0).alias("l"))
    return sampling.next_token(logits, "user_id", "event_type", "l", greedy=True)


@query()
def refilled_batches(spark: SparkSession, d: str) -> DataFrame:
    """Greedy batches in which every seventh sample cannot be decoded and is replaced by the next of its queue."""
    rows = batching.with_pool(_latest(spark, d), "shard_url", "uid", 256).withColumn("sound", seeded(F.col("uid"), 37) >= 1 / 7)
    made = batching.refilled_batches(rows.select("uid", "shard_url", "pool", "total", "sound", *FIELDS), ["shard_url", "pool"], ["total", "uid"], FIELDS, "sound", LIMITS)
    return made.select("uid", "shard_url", "pool", "batch")


_ONES = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"
_TENS = "['', '', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"


def _below_hundred(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN {_ONES}[{n} + 1] ELSE {_TENS}[{n} // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN '-' || {_ONES}[{n} % 10 + 1] ELSE '' END END"


@query(f"""SELECT n, 'take ' || CASE WHEN n < 100 THEN {_below_hundred("n")} ELSE {_ONES}[n // 100 + 1] || ' hundred' || CASE WHEN n % 100 > 0 THEN ' and ' || {_below_hundred("(n % 100)")} ELSE '' END END || ' of it' AS spoken
FROM (SELECT DISTINCT event_id % 1000 AS n FROM events)""")
def numbers_spelled(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers below a thousand inside a sentence, as words."""
    rows = table(spark, d, "events").select((F.col("event_id") % 1000).alias("n")).distinct()
    return rows.select("n", text.numbers_as_words(F.format_string("take %d of it", "n")).alias("spoken"))


@query(f"""SELECT y, 'in ' || CASE WHEN y = 2000 THEN 'two thousand' WHEN y BETWEEN 2001 AND 2009 THEN 'two thousand ' || {_ONES}[y - 1999] WHEN y % 100 = 0 THEN {_below_hundred("(y // 100)")} || ' hundred'
  WHEN y BETWEEN 2010 AND 2099 THEN 'twenty ' || {_below_hundred("(y % 100)")} ELSE {_below_hundred("(y // 100)")} || CASE WHEN y % 100 < 10 THEN ' oh ' ELSE ' ' END || {_below_hundred("(y % 100)")} END AS spoken
FROM (SELECT DISTINCT 1700 + event_id % 500 AS y FROM events)""")
def years_spelled(spark: SparkSession, d: str) -> DataFrame:
    """Years from 1700 to 2199 as they are spoken."""
    rows = table(spark, d, "events").select((1700 + F.col("event_id") % 500).alias("y")).distinct()
    return rows.select("y", text.numbers_as_words(F.format_string("in %d", "y")).alias("spoken"))


@query("""SELECT doc_id, nullif(regexp_extract(text, '["\u201c]([^"\u201d]+)["\u201d]', 1), '') AS quoted FROM documents""")
def quoted_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The first text in quotation marks."""
    return table(spark, d, "documents").select("doc_id", text.quoted_sentence(F.col("text")).alias("quoted"))


_TAGGED = "len(list_filter({m}, lambda m: coalesce(contains(m.content, '<|audio|>'), false)))"


@query(f"""WITH r AS (SELECT row_id, messages, coalesce(audios, []) AS a, list_transform(messages, lambda m: CASE WHEN m.role IN ('user', 'human') THEN 'user' WHEN m.role IN ('assistant', 'gpt', 'assistant_content') THEN 'assistant' END) AS roles FROM tts WHERE messages IS NOT NULL),
p AS (SELECT *, list_position(roles, 'user') AS u, list_position(roles, 'assistant') AS s FROM r),
t AS (SELECT row_id, a, {_TAGGED.format(m="messages[1:(u - 1)::INT]")} AS before, {_TAGGED.format(m="messages[u::INT:(CASE WHEN coalesce(s, 0) > 0 THEN s ELSE u END)::INT]")} AS held FROM p WHERE u > 0 AND (coalesce(s, 0) = 0 OR u < s))
SELECT row_id, len(a[(before + 1)::INT:(before + held)::INT])::INT AS kept, a[(before + 1)::INT:(before + held)::INT][1] AS first FROM t""")
def turn_audios(spark: SparkSession, d: str) -> DataFrame:
    """Audio paths of the kept turn of every chat row."""
    rows = table(spark, d, "tts").select("row_id", chat.kept_audios(F.col("messages"), F.col("audios")).alias("k")).where("k is not null")
    return rows.select("row_id", F.size("k").alias("kept"), F.try_element_at("k", F.lit(1)).alias("first"))


@query(f"""SELECT row_id, CASE WHEN coalesce({_TAGGED.format(m="messages")}, 0) <> len(coalesce(audios, [])) THEN 'tag_count' WHEN len(list_filter(audios, lambda p: p IS NULL)) > 0 THEN 'path_missing' END AS error FROM tts""")
def audio_path_check(spark: SparkSession, d: str) -> DataFrame:
    """Chat rows whose tags and audio paths do not pair up."""
    return table(spark, d, "tts").select("row_id", chat.audio_paths_error(F.col("messages"), F.col("audios")).alias("error"))


@query("""SELECT uid, ingested_at, list_filter(list_sort(list_transform(bindings, lambda b: {'m': b.message_index, 't': b.tag_index_in_message, 'a': b.asset_id})), lambda b: NOT coalesce(list_contains(map_keys(assets), b.a), false))[1].a AS unknown FROM canonical_samples""")
def binding_assets(spark: SparkSession, d: str) -> DataFrame:
    """The first asset that a binding names and its row does not hold."""
    return table(spark, d, "canonical_samples").select("uid", "ingested_at", filters.unknown_asset(F.col("bindings"), F.col("assets")).alias("unknown"))
