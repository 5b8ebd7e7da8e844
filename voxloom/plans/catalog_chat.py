"""Queries over chat rows, canonical rows and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import chat, lengths, text
from voxloom.operators import filters, layouts, sampling, segments, setops
from voxloom.operators.ranking import seeded
from voxloom.plans.registry import query
from voxloom.session import spread, table

_ROLE = "CASE {r} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'assistant_content' THEN 'assistant' ELSE {r} END"
_TURNS = "turns AS (SELECT row_id, unnest(range(len(messages)))::INT AS pos, unnest(messages) AS m FROM tts)"
_TAGS = "((length({c}) - length(replace({c}, '<|audio|>', ''))) / 9)::INT"


def quote(s: str) -> str:
    return s.replace("'", "''")


@query(f"WITH {_TURNS} SELECT row_id, pos, {_ROLE.format(r='m.role')} AS role, length(m.content)::INT AS chars FROM turns")
def normalize_roles(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "tts").select("row_id", F.posexplode(chat.canonical_messages(F.col("messages"))).alias("pos", "m"))
    return turns.select("row_id", "pos", "m.role", F.length("m.content").alias("chars"))


@query(f"""
SELECT row_id, CASE WHEN messages IS NULL OR len(messages) = 0 THEN 'no_messages'
  WHEN len(list_filter(messages, lambda m: NOT coalesce(({_ROLE.format(r="m.role")}) IN ('system', 'user', 'assistant'), false))) > 0 THEN 'unsupported_role'
  WHEN len(list_filter(messages, lambda m: m.content IS NULL)) > 0 THEN 'content_not_text' END AS error
FROM tts""")
def message_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tts").select("row_id", chat.message_error(F.col("messages")).alias("error"))


@query(f"""
WITH tagged AS (
  SELECT task, coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role IN ('user', 'human')), lambda m: {_TAGS.format(c="coalesce(m.content, '')")})), 0) AS user_tags,
    coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role IN ('assistant', 'gpt')), lambda m: {_TAGS.format(c="coalesce(m.content, '')")})), 0) AS assistant_tags
  FROM canonical_samples)
SELECT task, user_tags::INT AS user_tags, assistant_tags::INT AS assistant_tags,
  coalesce((task = 's2s' AND user_tags = 1 AND assistant_tags = 1) OR (task IN ('asr', 's2tt', 'ser', 'asc') AND user_tags = 1 AND assistant_tags = 0)
    OR (task = 'tts' AND user_tags = 0 AND assistant_tags = 1), false) AS ok, count(*) AS n
FROM tagged GROUP BY ALL""")
def audio_binding_check(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    rows = table(spark, d, "canonical_samples").select(
        "task",
        F.coalesce(chat.tag_count(chat.users(m)), F.lit(0)).alias("user_tags"),
        F.coalesce(chat.tag_count(chat.assistants(m)), F.lit(0)).alias("assistant_tags"),
    )
    return rows.groupBy("task", "user_tags", "assistant_tags", chat.tags_match(F.col("user_tags"), F.col("assistant_tags"), F.col("task")).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT physical_uid, task, concat_ws(':', physical_uid, task) AS uid FROM canonical_samples WHERE task IN ('asr', 'tts', 's2tt') AND physical_uid IS NOT NULL")
def task_explode(spark: SparkSession, d: str) -> DataFrame:
    physical = table(spark, d, "canonical_samples").where("physical_uid is not null").groupBy("physical_uid").agg(F.collect_set("task").alias("present"))
    return layouts.explode_tasks(physical, "physical_uid", "present", ["asr", "tts", "s2tt"]).select("physical_uid", "task", "uid")


@query("""
WITH p AS (SELECT physical_uid, list(DISTINCT task) AS present FROM canonical_samples WHERE physical_uid IS NOT NULL GROUP BY 1)
SELECT physical_uid, array_to_string(list_filter(['asr', 's2tt', 'ser'], lambda t: list_contains(present, t)), ',') AS tasks FROM p""")
def task_intersect(spark: SparkSession, d: str) -> DataFrame:
    physical = table(spark, d, "canonical_samples").where("physical_uid is not null").groupBy("physical_uid").agg(F.collect_set("task").alias("present"))
    return physical.select("physical_uid", F.array_join(layouts.requested_tasks(F.col("present"), ["asr", "s2tt", "ser"]), ",").alias("tasks"))


TASK_WEIGHTS = {"asr": 2.0, "tts": 1.0, "s2tt": 1.0, "ser": 0.5, "asc": 0.0}
_PICK = "('0x' || substring(sha256('{seed}:' || {key}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0"


@query(f"""
WITH p AS (SELECT physical_uid, bool_or(task = 'asr') AS a, bool_or(task = 'tts') AS t, bool_or(task = 's2tt') AS s, bool_or(task = 'ser') AS e, bool_or(task = 'asc') AS c,
    {_PICK.format(seed=3, key="physical_uid")} AS u FROM canonical_samples WHERE physical_uid IS NOT NULL GROUP BY physical_uid),
w AS (SELECT *, CASE WHEN a THEN 2.0 ELSE 0 END AS wa, CASE WHEN t THEN 1.0 ELSE 0 END AS wt, CASE WHEN s THEN 1.0 ELSE 0 END AS ws, CASE WHEN e THEN 0.5 ELSE 0 END AS we FROM p),
x AS (SELECT *, wa + wt + ws + we AS total FROM w)
SELECT physical_uid, CASE WHEN total <= 0 THEN NULL WHEN a AND wa > u * total THEN 'asr' WHEN t AND wa + wt > u * total THEN 'tts'
  WHEN s AND wa + wt + ws > u * total THEN 's2tt' WHEN e AND total > u * total THEN 'ser' WHEN c THEN 'asc' WHEN e THEN 'ser' WHEN s THEN 's2tt' WHEN t THEN 'tts' WHEN a THEN 'asr' END AS task
FROM x""")
def weighted_task_pick(spark: SparkSession, d: str) -> DataFrame:
    physical = table(spark, d, "canonical_samples").where("physical_uid is not null").groupBy("physical_uid").agg(F.collect_set("task").alias("present"))
    return physical.select("physical_uid", sampling.weighted_task(F.col("present"), seeded(F.col("physical_uid"), 3), TASK_WEIGHTS).alias("task"))


@query("""
WITH b AS (SELECT uid, ingested_at, list_transform(bindings, lambda b: CASE
    WHEN isnan(assets[b.asset_id].duration) OR isinf(assets[b.asset_id].duration) THEN b.role || ':not_finite'
    WHEN assets[b.asset_id].duration < 1.5 THEN b.role || ':too_short'
    WHEN assets[b.asset_id].duration > (CASE WHEN b.role = 'user' THEN 30 ELSE 60 END) THEN b.role || ':too_long' END) AS found FROM canonical_samples)
SELECT uid, list_filter(found, lambda e: e IS NOT NULL)[1] AS error FROM b""")
def duration_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_samples").select("uid", filters.binding_error(F.col("bindings"), F.col("assets")).alias("error"))


_CODE, _BARE = quote(text.CODE_REGEX), f"regexp_replace(l, '{quote(text.OUTER_SPACE)}', '', 'g')"


@query(f"""
WITH c AS (SELECT doc_id, text, length(text) - length(replace(text, ';', '')) + length(text) - length(replace(text, '{{', '')) + length(text) - length(replace(text, '}}', ''))
    + (length(text) - length(replace(text, '()', ''))) // 2 AS marks FROM documents)
SELECT doc_id, coalesce(length(text) > 0 AND (regexp_matches(text, '{_CODE}')
  OR (marks > 0.02 * length(text) AND marks >= 3 AND ((contains(text, '{{') AND contains(text, '}}')) OR (contains(text, ';') AND contains(text, '('))))
  OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{quote(text.CODE_WORD_REGEX)}')
    OR (ends_with({_BARE}, ';') AND contains(l, '{{')) OR (ends_with({_BARE}, '}}') AND contains(l, ';')))) >= 3), false) AS has_code
FROM c""")
def code_filter(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.contains_code(F.col("text")).alias("has_code"))


_NO_MARKS = r"regexp_replace(text, '<\|[^|]+\|>', '', 'g')"


@query(f"""
SELECT doc_id, round(coalesce(length(regexp_replace({_NO_MARKS}, '{text.NOT_CJK_CLASS}', '', 'g')) / nullif(length(regexp_replace({_NO_MARKS}, '{text.SPACE_CLASS}', '', 'g')), 0), 0), 6)::DOUBLE AS share,
  coalesce(length(regexp_replace({_NO_MARKS}, '{text.NOT_CJK_CLASS}', '', 'g')) / nullif(length(regexp_replace({_NO_MARKS}, '{text.SPACE_CLASS}', '', 'g')), 0), 0) >= 0.15 AS is_cjk
FROM documents""")
def cjk_ratio(spark: SparkSession, d: str) -> DataFrame:
    share = text.cjk_share(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(share, 6).alias("share"), (share >= text.CJK_THRESHOLD).alias("is_cjk"))


@query(f"SELECT doc_id, md5(regexp_replace(replace(text, '*', ''), '{text.EMOJI_CLASS}', '', 'g')) AS digest FROM documents")
def emoji_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_emoji(F.col("text"))).alias("digest"))


@query(r"""
SELECT "index", coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(audio_path, '^.*/', ''), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '0') AS stem
FROM benchmark_items""")
def safe_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_items").select("index", text.safe_stem(F.col("audio_path")).alias("stem"))


_SCORES = ("3", " 4.5 ", "[[2]]", "Rating: [[5]]", "[[6]]", "0", "", "five", "1e0", "[[3.5]] and [[1]]", "-2", "5.", ".5", "[[ 4 ]]", "4 stars", "nan")


@query(r"""
WITH s AS (SELECT unnest([""" + ", ".join(f"'{s}'" for s in _SCORES) + r"""]) AS reply UNION ALL SELECT NULL),
n AS (SELECT reply, coalesce(CASE WHEN regexp_matches(trim(reply), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN try_cast(trim(reply) AS DOUBLE) END,
  try_cast(nullif(regexp_extract(reply, '\[\[(\d+(?:\.\d+)?)\]\]', 1), '') AS DOUBLE)) AS x FROM s)
SELECT reply, CASE WHEN x BETWEEN 1 AND 5 THEN x END AS score FROM n""")
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    replies = spark.createDataFrame([(s,) for s in (*_SCORES, None)], "reply string")
    return replies.select("reply", text.judge_score(F.col("reply")).alias("score"))


#: Duplex marks of the test rows, made from row_id; the data has none.
_DUPLEX = "CASE row_id % 9 WHEN 0 THEN 'assistant_waiting' WHEN 1 THEN ' Normal_Conversation' WHEN 2 THEN 'user_interruption' WHEN 3 THEN 'backchanneling' END"
_TURN_COUNT = "CASE row_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'x' WHEN 3 THEN '3' END"
_CONTENT_FLAW = f"""CASE WHEN regexp_matches(m.content, '{_CODE}') THEN 'code'
  WHEN length(regexp_replace(regexp_replace(m.content, '<\\|[^|]+\\|>', '', 'g'), '{text.NOT_CJK_CLASS}', '', 'g')) / nullif(length(regexp_replace(regexp_replace(m.content, '<\\|[^|]+\\|>', '', 'g'), '{text.SPACE_CLASS}', '', 'g')), 0) >= 0.15 THEN 'cjk' END"""


@query(f"""
WITH r AS (SELECT row_id, lower(trim({_DUPLEX})) AS k, try_cast({_TURN_COUNT} AS INT) AS n, messages FROM tts)
SELECT row_id, coalesce(CASE WHEN k = 'assistant_waiting' THEN 'assistant_waiting' WHEN k = 'normal_conversation' AND n <> 1 THEN 'turn_count'
  WHEN k = 'user_interruption' AND n NOT IN (2, 3) THEN 'turn_count' WHEN k = 'backchanneling' AND n <> 2 THEN 'turn_count' END,
  list_filter(list_transform(list_filter(messages, lambda m: m.role IN ('assistant', 'gpt')), lambda m: {_CONTENT_FLAW}), lambda e: e IS NOT NULL)[1]) AS reason
FROM r""")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "tts").select("row_id", "messages"))
    return rows.select("row_id", filters.quality_error(F.col("messages"), F.expr(_DUPLEX), F.lit(None).cast("string"), F.expr(_TURN_COUNT)).alias("reason"))


_FINITE = "(CASE WHEN NOT isnan({x}) AND NOT isinf({x}) THEN {x} END)"
_CHARS = "coalesce(list_sum(list_transform({m}, lambda m: coalesce(length(m.content), 0))), 0)"


@query(f"""
WITH r AS (
  SELECT row_id, num_tokens_est AS tokens, audio_durations AS ds, {_CHARS.format(m="list_filter(messages, lambda m: m.role IN ('assistant', 'gpt'))")}::BIGINT AS chars,
    CASE WHEN len(audio_durations) > 1 THEN audio_durations[2] ELSE audio_durations[1] END AS sec FROM tts),
s AS (SELECT *, floor({_FINITE.format(x="sec")} * 9)::BIGINT AS speech, floor({_FINITE.format(x="sec")} * 17)::BIGINT AS audio, chars // 4 AS words FROM r)
SELECT row_id, CASE WHEN tokens > 500 THEN 'tokens' WHEN len(list_filter(ds, lambda x, i: isnan(x) OR isinf(x) OR x < 1.5 OR x > (CASE WHEN len(ds) > 1 AND i = 1 THEN 30 ELSE 60 END))) > 0 THEN 'duration'
  WHEN chars > 3000 THEN 'assistant_chars' WHEN words > 0 AND speech <> 0 AND speech < words THEN 'speech_shorter_than_text' WHEN tokens + audio > 2000 THEN 'total' END AS reason
FROM s""")
def length_caps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tts")
    chars = F.coalesce(lengths.text_chars(chat.assistants(F.col("messages"))), F.lit(0))
    seconds = F.when(F.size("audio_durations") > 1, F.try_element_at("audio_durations", F.lit(2))).otherwise(F.try_element_at("audio_durations", F.lit(1)))
    reason = lengths.length_error(F.col("num_tokens_est"), F.col("audio_durations"), chars, F.floor(chars / 4), seconds)
    return rows.select("row_id", reason.alias("reason"))


_ANY = "len(list_filter(list_filter(messages, lambda m: m.role IN ({roles})), lambda m: coalesce({cond}, false))) > 0"
_USER, _ASSISTANT = "'user', 'human'", "'assistant', 'gpt'"
_HEARD = _ANY.format(roles=_USER, cond="contains(m.content, '<|audio|>')")
_SPOKEN = _ANY.format(roles=_ASSISTANT, cond="contains(m.content, '<|audio|>')")
_ASKED = _ANY.format(roles=_USER, cond=f"regexp_matches(m.content, '(?i){quote('|'.join(chat.ASR_REQUESTS))}')")
_INSTRUCT = _ANY.format(roles=_USER, cond=r"regexp_matches(m.content, '(?i)\binstruction\s*:')")
_PROMPTS = {k: quote(v) for k, v in chat.SYSTEM_PROMPTS.items()}


@query(f"""
WITH c AS (SELECT task, coalesce({_HEARD}, false) AS heard, coalesce({_SPOKEN}, false) AS spoken, coalesce({_ASKED}, false) AS asked, coalesce({_INSTRUCT}, false) AS instruct FROM canonical_samples)
SELECT task, CASE WHEN heard AND NOT spoken AND asked THEN '{_PROMPTS["asr"]}' WHEN NOT heard AND spoken AND instruct THEN '{_PROMPTS["instruct"]}'
  WHEN heard AND spoken THEN '{_PROMPTS["s2s"]}' WHEN heard THEN '{_PROMPTS["s2t"]}' WHEN spoken THEN '{_PROMPTS["t2s"]}' ELSE '{_PROMPTS["t2t"]}' END AS prompt, count(*) AS n
FROM c GROUP BY ALL""")
def system_prompt_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_samples").groupBy("task", chat.system_prompt(F.col("messages")).alias("prompt")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_TURNS}, f AS (SELECT row_id, min(CASE WHEN {_ROLE.format(r="m.role")} = 'user' THEN pos END) AS u, min(CASE WHEN {_ROLE.format(r="m.role")} = 'assistant' THEN pos END) AS a FROM turns GROUP BY row_id)
SELECT row_id, (CASE WHEN a IS NULL THEN 1 ELSE a - u + 1 END)::INT AS kept FROM f WHERE u IS NOT NULL AND (a IS NULL OR u < a)""")
def first_turn_pair(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "tts").select("row_id", chat.first_turn(F.col("messages")).alias("m"))
    return kept.where("m is not null").select("row_id", F.size("m").alias("kept"))


@query(f"""
WITH {_TURNS}, a AS (SELECT row_id, pos, m.role AS role, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m.content, '{chat.PERSONA}', '', 'g'),
    '(?i){chat.ASSISTANT_PERSONA}', '', 'g'), '(?i){"|".join((chat.ASR_REQUESTS[0], chat.ASR_REQUESTS[2], chat.ASR_REQUESTS[1]))}', '{chat.ASR_PROMPT}', 'g'),
    '(?i){chat.TTS_PROMPT}|{chat.READ_PROMPT}', '{chat.TTS_PROMPT}', 'g') AS c FROM turns)
SELECT row_id, pos, md5(CASE WHEN role IN ('user', 'human') THEN replace(c, '<|audio|>', '{chat.AUDIO_START}{chat.AUDIO_END}') ELSE replace(c, '<|audio|>', '') END) AS digest FROM a""")
def prompt_rewrite(spark: SparkSession, d: str) -> DataFrame:
    turns = spread(table(spark, d, "tts").select("row_id", "messages")).select("row_id", F.posexplode("messages").alias("pos", "m"))
    return turns.select("row_id", "pos", F.md5(chat.rewrite_content(F.col("m.content"), F.col("m.role"))).alias("digest"))


@query("""
WITH t AS (SELECT row_id, audio_tokens, coalesce(
    list_transform(list_filter(messages, lambda m: m.role = 'assistant' AND ends_with(m.content, '<|audio|>')), lambda m: left(m.content, length(m.content) - 9))[1],
    list_transform(list_filter(messages, lambda m: m.role = 'user' AND starts_with(m.content, 'Read the following text out loud: ')), lambda m: substr(m.content, 35))[1]) AS transcript FROM tts)
SELECT row_id, transcript, ((66 + 39 + length(transcript)) // 4 + coalesce(list_sum(audio_tokens), 0))::BIGINT AS tokens FROM t WHERE transcript IS NOT NULL""".replace("66 + 39", str(len(chat.TEXT_ONLY_PERSONA) + len(chat.ASR_PROMPT) + 9)))
def tts_to_asr(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tts").select("row_id", chat.tts_transcript(F.col("messages")).alias("transcript"), "audio_tokens").where("transcript is not null")
    audio = F.coalesce(F.aggregate("audio_tokens", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(t, F.lit(0).cast("long"))), F.lit(0).cast("long"))
    return rows.select("row_id", "transcript", (lengths.text_tokens(chat.asr_messages(F.col("transcript"))) + audio).alias("tokens"))


@query(f"""
SELECT row_id, ({_CHARS.format(m="messages")}::BIGINT // 4 + coalesce(list_sum(list_transform(audio_durations, lambda x: coalesce(floor({_FINITE.format(x="round(x, 3)")} * 17), 0))), 0))::BIGINT AS tokens FROM tts""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tts").select("row_id", lengths.row_estimate(F.col("messages"), F.col("audio_durations")).alias("tokens"))


@query(f"""
SELECT row_id, coalesce(num_tokens_est, {_CHARS.format(m="messages")}::BIGINT // 4 + coalesce(CASE WHEN len(audio_tokens) > 0 THEN coalesce(list_sum(audio_tokens), 0) END,
  CASE WHEN len(audio_durations) > 0 THEN floor(coalesce(list_sum(list_transform(audio_durations, lambda x: {_FINITE.format(x="x")})), 0) * 17) END, coalesce(len(audios), 0) * 170))::BIGINT AS tokens FROM tts""")
def column_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = lengths.column_estimate(*[F.col(x) for x in ("num_tokens_est", "audio_tokens", "audio_durations", "audios", "messages")])
    return table(spark, d, "tts").select("row_id", c.alias("tokens"))


@query(f"""
WITH a AS (SELECT row_id, unnest(range(len(audios)))::INT AS place, audios, audio_tokens, audio_durations FROM tts),
m AS (SELECT *, regexp_replace(audios[place + 1], '^.*[./]([^./]+[.][^./]+)$', '\\1') AS member, audio_durations[place + 1] AS sec FROM a),
v AS (SELECT *, list_filter(list_zip(audios, audio_tokens), lambda p: p[2] IS NOT NULL AND (string_split(p[1], '/')[-1] = member OR ends_with(string_split(p[1], '/')[-1], '.' || member))) AS hits FROM m)
SELECT row_id, place, coalesce(CASE WHEN len(audios) = len(audio_tokens) AND len(hits) = 1 THEN hits[1][2] END,
  CASE WHEN audio_tokens IS NULL OR len(audios) <> len(audio_tokens) THEN audio_tokens[place + 1] END, floor({_FINITE.format(x="sec")} * 17), 0)::BIGINT AS tokens FROM v""")
def audio_token_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tts").select("row_id", "audios", "audio_tokens", "audio_durations", F.posexplode("audios").alias("place", "path"))
    member = F.regexp_replace("path", r"^.*[./]([^./]+[.][^./]+)$", "$1")
    tokens = layouts.resolve_tokens(F.col("audios"), F.col("audio_tokens"), member, F.col("place"), F.try_element_at("audio_durations", F.col("place") + 1))
    return rows.select("row_id", "place", tokens.alias("tokens"))


@query(f"WITH {_TURNS} SELECT a.row_id, a.pos, md5(coalesce((SELECT string_agg(coalesce(b.m.content, ''), chr(10) ORDER BY b.pos) FROM turns b WHERE b.row_id = a.row_id AND b.pos < a.pos), '')) AS digest FROM turns a")
def history_concat(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tts").select("row_id", F.posexplode(segments.history_of(F.col("messages"))).alias("pos", "h"))
    return rows.select("row_id", "pos", F.md5("h").alias("digest"))


@query("""
SELECT 'canonical' AS source_name, uid AS key, source_name AS origin, NULL::BIGINT AS tokens FROM canonical_samples
UNION ALL SELECT 'tts', row_id::VARCHAR, source_name, num_tokens_est FROM tts UNION ALL SELECT 'quarantine', uid, source, NULL FROM quarantine""")
def source_union(spark: SparkSession, d: str) -> DataFrame:
    return setops.tagged_union(
        {
            "canonical": table(spark, d, "canonical_samples").select(F.col("uid").alias("key"), F.col("source_name").alias("origin")),
            "tts": table(spark, d, "tts").select(F.col("row_id").cast("string").alias("key"), F.col("source_name").alias("origin"), F.col("num_tokens_est").alias("tokens")),
            "quarantine": table(spark, d, "quarantine").select(F.col("uid").alias("key"), F.col("source").alias("origin")),
        }
    )


@query("""
SELECT doc_id AS id, lang, NULL::BIGINT AS num_tokens_est, n_chars FROM documents UNION ALL SELECT row_id, lang, num_tokens_est, NULL FROM tts
UNION ALL SELECT "index", NULL, NULL, NULL FROM benchmark_items""")
def schema_union(spark: SparkSession, d: str) -> DataFrame:
    return setops.aligned_union(
        [
            table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit(None).alias("num_tokens_est"), "n_chars"),
            table(spark, d, "tts").select(F.col("row_id").alias("id"), "lang", "num_tokens_est"),
            table(spark, d, "benchmark_items").select(F.col("index").alias("id"), F.lit(None).alias("lang")),
        ]
    )


@query("""
WITH k AS (SELECT url, count(*) AS copies, bool_or(coalesce(disabled, false)) AS off, min(path) AS path FROM shard_manifest WHERE url IS NOT NULL GROUP BY url)
SELECT url, copies, path FROM k WHERE NOT off""")
def manifest_shards(spark: SparkSession, d: str) -> DataFrame:
    """Enabled shards of the manifest with the number of times each is listed."""
    m = table(spark, d, "shard_manifest").where("url is not null").groupBy("url")
    return m.agg(F.count(F.lit(1)).alias("copies"), F.bool_or(F.coalesce("disabled", F.lit(False))).alias("off"), F.min("path").alias("path")).where("not off").drop("off")


@query("""
SELECT q.url, q.samples, coalesce(c.rejected, 0) AS rejected FROM (SELECT shard_url AS url, count(*) AS samples FROM canonical_samples GROUP BY 1) q
LEFT JOIN (SELECT shard AS url, count(*) AS rejected FROM quarantine WHERE shard IS NOT NULL GROUP BY 1) c ON q.url = c.url""")
def shard_audit(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "canonical_samples").groupBy(F.col("shard_url").alias("url")).agg(F.count(F.lit(1)).alias("samples"))
    bad = table(spark, d, "quarantine").where("shard is not null").groupBy(F.col("shard").alias("url")).agg(F.count(F.lit(1)).alias("rejected"))
    return good.join(bad, "url", "left").select("url", "samples", F.coalesce("rejected", F.lit(0).cast("long")).alias("rejected"))


@query("""
WITH r AS (SELECT user_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS s FROM events)
SELECT user_id, event_type, sum(s)::BIGINT AS runs FROM r GROUP BY 1, 2 HAVING sum(s) > 1""")
def noncontiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose members do not lie together: event types within the events of a user stand for keys within a shard."""
    rows = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("place"))
    return layouts.broken_runs(rows, "user_id", "place", "event_type")


def _layout_members(spark: SparkSession, d: str) -> DataFrame:
    """Physical samples with the member names their assets and tasks imply."""
    rows = table(spark, d, "canonical_samples").where("physical_uid is not null")
    keys = F.transform(F.map_values("assets"), lambda a: a["member_key"])
    side = F.when(F.col("task") == "s2s", "json").otherwise(F.concat("task", F.lit(".json")))
    names = F.filter(F.concat(F.coalesce(keys, F.array().cast("array<string>")), F.array(side)), lambda k: k.isNotNull())
    grouped = rows.select("physical_uid", F.explode(names).alias("k")).groupBy("physical_uid").agg(F.collect_set("k").alias("ks"))
    return grouped.select("physical_uid", F.map_from_entries(F.transform("ks", lambda k: F.struct(k, F.lit(1)))).alias("members"))


@query("""
WITH k AS (SELECT physical_uid, unnest(list_append(list_transform(map_values(assets), lambda a: a.member_key), CASE WHEN task = 's2s' THEN 'json' ELSE task || '.json' END)) AS k FROM canonical_samples WHERE physical_uid IS NOT NULL
  UNION SELECT physical_uid, CASE WHEN task = 's2s' THEN 'json' ELSE task || '.json' END FROM canonical_samples WHERE physical_uid IS NOT NULL),
g AS (SELECT physical_uid, list(DISTINCT k) AS ks FROM k WHERE k IS NOT NULL GROUP BY 1),
m AS (SELECT physical_uid, list_contains(ks, 'json') AND len(list_filter(ks, lambda x: regexp_matches(x, '(?i)^question[.](wav|flac|mp3|m4a|ogg)$'))) = 1
    AND len(list_filter(ks, lambda x: regexp_matches(x, '(?i)^response[.](wav|flac|mp3|m4a|ogg)$'))) = 1 AS pair,
  len(list_filter(ks, lambda x: regexp_matches(x, '(?i)^audio[.](wav|flac|mp3|m4a|ogg)$'))) = 1 AND list_has_any(ks, ['asr.json', 'tts.json', 's2tt.json', 'ser.json', 'asc.json']) AS shared FROM g)
SELECT CASE WHEN pair AND shared THEN NULL WHEN pair THEN 's2s_pair' WHEN shared THEN 'shared_audio_tasks' END AS layout,
  CASE WHEN pair AND shared THEN 'AmbiguousLayout' WHEN NOT pair AND NOT shared THEN 'UnknownLayout' END AS error, count(*) AS n FROM m GROUP BY ALL""")
def layout_resolve(spark: SparkSession, d: str) -> DataFrame:
    found = _layout_members(spark, d).select(layouts.resolve_layout(F.col("members")).alias("r"))
    return found.groupBy("r.layout", "r.error").agg(F.count(F.lit(1)).alias("n"))
