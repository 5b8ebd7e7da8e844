"""Queries over frame sequences (embeddings by label) and token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.lengths import output_rate
from voxloom.operators import segments
from voxloom.plans.registry import query
from voxloom.session import table

_SIM = """
p AS (SELECT label AS seq_id, vec_id AS t, embedding AS vec, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
s AS (SELECT seq_id, t, vec, CASE WHEN b IS NOT NULL THEN round(coalesce(list_sum(list_transform(list_zip(vec, b), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / nullif(sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))), 0), 0), 6) END AS sim FROM p)"""
_TARGET, _BASE, _RUN, _THRESHOLD = 6.25, 12.5, 4, 0.0
_TOPK = f"""WITH {_SIM},
k AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY sim ASC NULLS LAST, t) AS rk, greatest(1, round_even(count(*) OVER (PARTITION BY seq_id) * {_TARGET / _BASE}::DOUBLE, 0)::INT) AS n FROM s),
n AS (SELECT *, CASE WHEN sim IS NULL OR rk <= n - 1 THEN 1 ELSE 0 END AS fresh FROM k)"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("seq_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("vec"))


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return segments.adjacent_similarity(_frames(spark, d))


@query(f"WITH {_SIM} SELECT seq_id, t, sim FROM s")
def adjacent_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select("seq_id", "t", "sim")


@query(f"WITH {_SIM} SELECT seq_id, t, (sum(CASE WHEN sim IS NULL OR sim <= {_THRESHOLD} THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY t) - 1)::INT AS segment FROM s")
def threshold_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.threshold_segments(_similar(spark, d), _THRESHOLD).select("seq_id", "t", "segment")


@query(f"{_TOPK} SELECT seq_id, t, (sum(fresh) OVER (PARTITION BY seq_id ORDER BY t) - 1)::INT AS segment FROM n")
def topk_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.topk_segments(_similar(spark, d), _TARGET, _BASE).select("seq_id", "t", "segment")


@query(f"""{_TOPK}, q AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS p FROM n),
r AS (SELECT *, max(CASE WHEN fresh = 1 THEN p ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY t) AS st FROM q)
SELECT seq_id, t, (sum(CASE WHEN (p - st) % {_RUN} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY t) - 1)::INT AS segment FROM r""")
def max_run_split(spark: SparkSession, d: str) -> DataFrame:
    return segments.topk_segments(_similar(spark, d), _TARGET, _BASE, max_run=_RUN).select("seq_id", "t", "segment")


_UNIFORM = """u AS (SELECT label AS seq_id, vec_id AS t, embedding AS vec, count(*) OVER (PARTITION BY label) AS len, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings),
v AS (SELECT *, greatest(1, round_even(len * 0.5::DOUBLE, 0)::INT) AS n FROM u), w AS (SELECT seq_id, t, vec, least(floor(p * n / len), n - 1)::INT AS segment FROM v)"""


@query(f"WITH {_UNIFORM} SELECT seq_id, t, segment FROM w")
def uniform_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.uniform_segments(_frames(spark, d), _TARGET, _BASE).select("seq_id", "t", "segment")


@query(f"""WITH {_UNIFORM}, x AS (SELECT seq_id, segment, unnest(range(len(vec)))::INT AS dim, unnest(vec) AS x FROM w)
SELECT seq_id, segment, dim, round(avg(x::DOUBLE), 6) AS mean, count(*) AS frames FROM x GROUP BY ALL""")
def segment_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = segments.pool_segments(segments.uniform_segments(_frames(spark, d), _TARGET, _BASE))
    return pooled.withColumn("mean", F.round("mean", 6))


@query(f"WITH {_SIM}, g AS (SELECT seq_id, (sum(CASE WHEN sim IS NULL OR sim <= {_THRESHOLD} THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY t))::INT AS k FROM s) SELECT seq_id, k - 1 AS segment, count(*) AS size FROM g GROUP BY ALL")
def segment_sizes(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_sizes(segments.threshold_segments(_similar(spark, d), _THRESHOLD))


@query(f"WITH {_SIM}, g AS (SELECT seq_id, sum(CASE WHEN sim IS NULL OR sim <= {_THRESHOLD} THEN 1 ELSE 0 END) AS n, count(*) AS f FROM s GROUP BY 1) SELECT round(avg(n / f * {_BASE}::DOUBLE), 6) AS rate FROM g")
def achieved_rate(spark: SparkSession, d: str) -> DataFrame:
    made = segments.threshold_segments(_similar(spark, d), _THRESHOLD)
    return segments.achieved_rate(made, _BASE).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_UNIFORM}, y AS (SELECT seq_id, segment, row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS p FROM w)
SELECT seq_id, 'frame' AS kind, p AS item, p + segment AS place FROM y UNION ALL SELECT seq_id, 'query', segment, max(p) + segment + 1 FROM y GROUP BY seq_id, segment""")
def query_interleave(spark: SparkSession, d: str) -> DataFrame:
    placed = segments.query_positions(segments.uniform_segments(_frames(spark, d), _TARGET, _BASE))
    return placed.select("seq_id", "kind", F.col("item").cast("long").alias("item"), F.col("place").cast("long").alias("place"))


@query("""WITH p AS (SELECT user_id, event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS paired FROM events)
SELECT user_id, event_id, paired FROM p WHERE paired IS NOT NULL AND paired >= 1""")
def delayed_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return segments.delayed_pairs(rows, "user_id", "at", "value", F.col("paired") >= 1).select("user_id", "event_id", "paired")


#: Tokens of a benchmark item: the code points of its question, a marker behind the first half.
_TOKENS = 'SELECT "index", list_transform(string_split(question, \'\'), lambda c: unicode(c)::INT) AS q FROM benchmark_items WHERE question IS NOT NULL'


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    chars = F.filter(F.split("question", ""), lambda c: c != "")
    rows = table(spark, d, "benchmark_items").where("question is not null")
    return rows.select("index", F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")).alias("q"))


@query(f"""WITH t AS ({_TOKENS}), p AS (SELECT "index", q, list_position(q, 44) AS place FROM t)
SELECT "index", CASE WHEN place > 0 THEN array_to_string(list_concat(list_concat(q[:place - 1], [-1, -2]), q[place:]), ' ') END AS tokens FROM p""")
def splice_before_marker(spark: SparkSession, d: str) -> DataFrame:
    """Two tokens before the first comma; null without one."""
    made = segments.splice_before(F.col("q"), F.array(F.lit(-1), F.lit(-2)), F.lit(44))
    return _tokens(spark, d).select("index", F.array_join(F.transform(made, lambda x: x.cast("string")), " ").alias("tokens"))


@query(f"""WITH t AS ({_TOKENS}), p AS (SELECT "index", q, list_reverse(q)[:len(q) // 2] AS r FROM t)
SELECT "index", array_to_string(flatten(list_transform(list_zip(q[:len(r)], r), lambda x: [x[1], x[2]])), ' ') AS tokens FROM p""")
def interleave_streams(spark: SparkSession, d: str) -> DataFrame:
    """The question's tokens with the first half of its reversed tokens."""
    back = F.slice(F.reverse("q"), F.lit(1), F.floor(F.size("q") / 2).cast("int"))
    return _tokens(spark, d).select("index", F.array_join(F.transform(segments.interleave(F.col("q"), back), lambda x: x.cast("string")), " ").alias("tokens"))


@query(f"""WITH t AS ({_TOKENS}), p AS (SELECT "index", q[:len(q) // 2 * 2] AS w FROM t)
SELECT "index", array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ') AS even, array_to_string(list_filter(w, lambda x, i: i % 2 = 0), ' ') AS odd FROM p""")
def even_odd_split(spark: SparkSession, d: str) -> DataFrame:
    even, odd = segments.even_odd(F.col("q"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return _tokens(spark, d).select("index", join(even).alias("even"), join(odd).alias("odd"))


@query(f"""WITH t AS ({_TOKENS}), p AS (SELECT "index", q, list_concat(list_concat([-3, -3, -3], q[:len(q) // 2 + 5]), [-4]) AS s FROM t)
SELECT "index", len(q) + greatest(0, len(s) - len(q)) AS text_size, len(s) + greatest(0, len(q) - len(s)) AS speech_size, abs(len(s) - len(q)) AS padded FROM p""")
def stream_alignment(spark: SparkSession, d: str) -> DataFrame:
    speech = F.slice("q", F.lit(1), (F.floor(F.size("q") / 2) + 5).cast("int"))
    made = segments.align_streams(F.col("q"), speech, 3, F.lit(-3), F.lit(-4), F.lit(0))
    rows = _tokens(spark, d).select("index", made.alias("a"))
    return rows.select("index", F.size("a.text").cast("long").alias("text_size"), F.size("a.speech").cast("long").alias("speech_size"), F.col("a.padded").cast("long").alias("padded"))


@query("""
WITH v AS (SELECT uid, ingested_at, lengths.codec_tokens AS codes, lengths.user_audio_tokens AS feats FROM canonical_samples)
SELECT uid, round(CASE WHEN coalesce(feats, 0) = 0 THEN 0 ELSE least(15, greatest(0, coalesce(codes / greatest(1, floor(feats / 1.33::DOUBLE)) * 12.5::DOUBLE, 12.5))) END, 6)::DOUBLE AS rate FROM v""")
def output_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = output_rate(F.col("lengths.codec_tokens"), F.col("lengths.user_audio_tokens"))
    return table(spark, d, "canonical_samples").select("uid", F.round(rate, 6).alias("rate"))
