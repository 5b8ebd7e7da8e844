"""Queries over batches, sampling and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import lengths
from voxloom.operators import batching, metrics, sampling
from voxloom.operators.ranking import seeded, with_position
from voxloom.plans.config import BatchLimits
from voxloom.plans.registry import query
from voxloom.session import table

FIELDS = list(lengths.LENGTH_FIELDS)
_U = "(('0x' || substring(sha256('{seed}:' || {key}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)"
#: Latest delivery of each sample with known lengths.
_LATEST = """samples AS MATERIALIZED (SELECT uid, shard_url, source_name, lengths, ingested_at FROM canonical_samples),
latest AS (SELECT uid, shard_url, source_name, lengths.user_text_tokens AS user_text_tokens, lengths.assistant_text_tokens AS assistant_text_tokens,
    lengths.user_audio_tokens AS user_audio_tokens, lengths.assistant_audio_tokens AS assistant_audio_tokens, lengths.codec_tokens AS codec_tokens,
    (lengths.user_text_tokens + lengths.assistant_text_tokens + lengths.user_audio_tokens + lengths.assistant_audio_tokens + lengths.codec_tokens)::BIGINT AS total
  FROM samples WHERE coalesce(lengths.user_text_tokens, -1) >= 0 AND coalesce(lengths.assistant_text_tokens, -1) >= 0 AND coalesce(lengths.user_audio_tokens, -1) >= 0 AND coalesce(lengths.assistant_audio_tokens, -1) >= 0 AND coalesce(lengths.codec_tokens, -1) >= 0
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ingested_at DESC) = 1)"""
_POOL_ROWS, _CHUNK = 256, 64
_POOLED = f"""pooled AS (SELECT l.*, floor({_U.format(seed=0, key='uid')} * ceil(n / {_POOL_ROWS}))::INT AS pool FROM (SELECT *, count(*) OVER (PARTITION BY shard_url) AS n FROM latest) l)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("lengths")
    known = F.lit(True)
    for f in FIELDS:
        known = known & (length[f] >= 0)
    rows = table(spark, d, "canonical_samples").where(known)
    # the latest delivery by aggregate, so a uid delivered any number of times needs no window
    last = rows.groupBy("uid").agg(F.max_by(F.struct("shard_url", "source_name", "lengths"), "ingested_at").alias("r"))
    out = last.select("uid", "r.shard_url", "r.source_name", *[F.col(f"r.lengths.{f}").alias(f) for f in FIELDS])
    return out.withColumn("total", sum((F.col(f).cast("long") for f in FIELDS[1:]), F.col(FIELDS[0]).cast("long")))


@query(f"WITH {_LATEST} SELECT shard_url, count(*) * (max(user_text_tokens) + max(assistant_text_tokens) + max(user_audio_tokens) + max(assistant_audio_tokens) + max(codec_tokens))::BIGINT AS padded, sum(total)::BIGINT AS unpadded, count(*) AS size FROM latest GROUP BY 1")
def padding_cost(spark: SparkSession, d: str) -> DataFrame:
    return batching.batch_costs(_latest(spark, d), ["shard_url"])


@query(f"""WITH {_LATEST}, {_POOLED}, c AS (SELECT *, floor((row_number() OVER (PARTITION BY shard_url, pool ORDER BY total, uid) - 1) / {_CHUNK})::INT AS chunk FROM pooled)
SELECT uid, pool, chunk, (row_number() OVER (PARTITION BY shard_url, pool, chunk ORDER BY {_U.format(seed=1, key='uid')}, uid) - 1)::INT AS place FROM c""")
def length_bucket(spark: SparkSession, d: str) -> DataFrame:
    return batching.length_buckets(_latest(spark, d), "shard_url", "uid", "total", _CHUNK, _POOL_ROWS).select("uid", "pool", "chunk", "place")


LIMITS = BatchLimits(max_cost=5000, max_samples=5, oversized_sample="single")
_GREEDY = f"""RECURSIVE {_LATEST}, {_POOLED},
o AS (SELECT *, row_number() OVER (PARTITION BY shard_url, pool ORDER BY total, uid) AS rn FROM pooled),
f AS (
  SELECT shard_url, pool, rn, uid, total, 0 AS batch, 1 AS held, user_text_tokens AS a, assistant_text_tokens AS b, user_audio_tokens AS c, assistant_audio_tokens AS e, codec_tokens AS g, total > 5000 AS closed FROM o WHERE rn = 1
  UNION ALL
  SELECT o.shard_url, o.pool, o.rn, o.uid, o.total, CASE WHEN s.fresh THEN f.batch + 1 ELSE f.batch END, CASE WHEN s.fresh THEN 1 ELSE f.held + 1 END,
    CASE WHEN s.fresh THEN o.user_text_tokens ELSE greatest(f.a, o.user_text_tokens) END, CASE WHEN s.fresh THEN o.assistant_text_tokens ELSE greatest(f.b, o.assistant_text_tokens) END,
    CASE WHEN s.fresh THEN o.user_audio_tokens ELSE greatest(f.c, o.user_audio_tokens) END, CASE WHEN s.fresh THEN o.assistant_audio_tokens ELSE greatest(f.e, o.assistant_audio_tokens) END,
    CASE WHEN s.fresh THEN o.codec_tokens ELSE greatest(f.g, o.codec_tokens) END, o.total > 5000
  FROM f JOIN o ON o.shard_url IS NOT DISTINCT FROM f.shard_url AND o.pool = f.pool AND o.rn = f.rn + 1,
  LATERAL (SELECT f.closed OR o.total > 5000 OR f.held + 1 > 5 OR (f.held + 1) * (greatest(f.a, o.user_text_tokens) + greatest(f.b, o.assistant_text_tokens) + greatest(f.c, o.user_audio_tokens)
    + greatest(f.e, o.assistant_audio_tokens) + greatest(f.g, o.codec_tokens)) > 5000 AS fresh) s)"""


def _greedy(spark: SparkSession, d: str) -> DataFrame:
    pooled = batching.with_pool(_latest(spark, d), "shard_url", "uid", _POOL_ROWS)
    return batching.greedy_batches(pooled, ["shard_url", "pool"], ["total", "uid"], FIELDS, LIMITS)


@query(f"WITH {_GREEDY} SELECT uid, pool, batch FROM f")
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Greedy batches by increasing length within pools of bounded size."""
    return _greedy(spark, d).select("uid", "pool", "batch")


@query(f"""WITH {_GREEDY}, k AS (SELECT shard_url, pool, batch, count(*) AS size, count(*) * (max(a) + max(b) + max(c) + max(e) + max(g))::BIGINT AS padded, sum(total)::BIGINT AS unpadded FROM f GROUP BY 1, 2, 3)
SELECT count(*) AS batches, sum(size)::BIGINT AS samples, sum(padded)::BIGINT AS padded_cost, sum(unpadded)::BIGINT AS unpadded_cost, round(1 - sum(unpadded) / sum(padded), 6)::DOUBLE AS padding_ratio,
  round(sum(size) / count(*), 6)::DOUBLE AS mean_size, round(sum(padded) / count(*), 6)::DOUBLE AS mean_cost, max(size) AS max_size FROM k""")
def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Batches, padding and sizes of the greedy batches of the canonical stream."""
    made = metrics.stream_metrics(batching.batch_costs(_greedy(spark, d), ["shard_url", "pool", "batch"]))
    return made.withColumns({c: F.round(c, 6) for c in ("padding_ratio", "mean_size", "mean_cost")})


_BUDGET_TOKENS, _BUDGET_ROWS = 4000, 20


@query(f"""
WITH RECURSIVE b AS (SELECT row_id, speaker, coalesce(num_tokens_est, 0) AS tok, floor({_U.format(seed=0, key='row_id')} * ceil(count(*) OVER (PARTITION BY speaker) / {_POOL_ROWS}))::INT AS pool FROM tts),
o AS (SELECT *, row_number() OVER (PARTITION BY speaker, pool ORDER BY tok, row_id) AS rn FROM b),
f AS (SELECT speaker, pool, rn, row_id, tok AS total, 1 AS held, 0 AS batch FROM o WHERE rn = 1 UNION ALL
  SELECT o.speaker, o.pool, o.rn, o.row_id, CASE WHEN s.fresh THEN o.tok ELSE f.total + o.tok END, CASE WHEN s.fresh THEN 1 ELSE f.held + 1 END, CASE WHEN s.fresh THEN f.batch + 1 ELSE f.batch END
  FROM f JOIN o ON o.speaker IS NOT DISTINCT FROM f.speaker AND o.pool = f.pool AND o.rn = f.rn + 1,
  LATERAL (SELECT (f.total + o.tok > {_BUDGET_TOKENS} OR f.held >= {_BUDGET_ROWS}) AND f.held >= {_BUDGET_ROWS // 5} AS fresh) s)
SELECT row_id, pool, batch FROM f""")
def token_budget_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tts").select("row_id", "speaker", F.coalesce("num_tokens_est", F.lit(0).cast("long")).alias("tok"))
    pooled = batching.with_pool(rows, "speaker", "row_id", _POOL_ROWS)
    return batching.token_budget_batches(pooled, ["speaker", "pool"], ["tok", "row_id"], "tok", _BUDGET_TOKENS, _BUDGET_ROWS).select("row_id", "pool", "batch")


@query(f"WITH {_LATEST}, p AS (SELECT uid, shard_url, total, (row_number() OVER (PARTITION BY shard_url ORDER BY uid) - 1) // 8 AS batch FROM latest) SELECT uid, batch, coalesce(sum(total) OVER (PARTITION BY shard_url, batch ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM p")
def pack_offsets(spark: SparkSession, d: str) -> DataFrame:
    chunks = batching.ordered_chunks(_latest(spark, d), ["shard_url"], "uid", 8)
    return batching.pack_offsets(chunks, ["shard_url", "batch"], "uid", "total").select("uid", "batch", "offset")


@query("""
WITH t AS (SELECT o_orderkey AS k, o_custkey AS g, list_transform(range(o_orderkey % 7 + 1), lambda i: (i + 1)::INT) AS u, list_transform(range(o_orderkey % 5 + 1), lambda i: (i + 1)::INT) AS a FROM orders),
w AS (SELECT *, max(len(u)) OVER (PARTITION BY g) AS uw, max(len(a)) OVER (PARTITION BY g) AS aw FROM t)
SELECT k, array_to_string(list_concat(list_transform(range(uw - len(u)), lambda i: 0::INT), u), ' ') AS u, array_to_string(list_concat(a, list_transform(range(aw - len(a)), lambda i: 0::INT)), ' ') AS a,
  (uw - len(u))::INT AS u_masked, (aw - len(a))::INT AS a_masked FROM w""")
def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    """Token lists made from order keys, padded to the width of their customer's batch."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("g"),
        F.sequence(F.lit(1), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("u"),
        F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("a"),
    )
    made = batching.pad_batch(rows, ["g"], "u", "a")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    zeros = lambda c: F.size(F.filter(c, lambda x: x == 0))
    return made.select("k", join("u").alias("u"), join("a").alias("a"), zeros("user_mask").alias("u_masked"), zeros("assistant_mask").alias("a_masked"))


@query(f"WITH {_LATEST}, b AS (SELECT uid, shard_url, (row_number() OVER (PARTITION BY shard_url ORDER BY uid) - 1) // 8 AS batch FROM latest) SELECT uid, batch FROM b QUALIFY count(*) OVER (PARTITION BY shard_url, batch) >= 8")
def drop_last(spark: SparkSession, d: str) -> DataFrame:
    chunks = batching.ordered_chunks(_latest(spark, d), ["shard_url"], "uid", 8)
    return batching.keep_full(chunks, ["shard_url", "batch"], BatchLimits(max_samples=8)).select("uid", "batch")


@query(f"WITH {_GREEDY}, k AS (SELECT shard_url, count(*) AS size FROM f GROUP BY shard_url, pool, batch) SELECT shard_url, min(size) AS smallest, round(avg(size), 6) AS mean, max(size) AS largest FROM k GROUP BY 1")
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = _greedy(spark, d).groupBy("shard_url", "pool", "batch").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("shard_url").agg(F.min("size").alias("smallest"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("largest"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_U.format(seed=11, key='doc_id')}, doc_id) - 1 AS position FROM documents")
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return sampling.seeded_order(table(spark, d, "documents").select("doc_id"), "doc_id", 11)


_RATIO = "(length(coalesce(source, '')) % 5 + 1) * 0.4"


@query(f"""
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n, ({_RATIO})::DOUBLE AS r FROM documents),
c AS (SELECT *, floor(n * r) AS w FROM p), k AS (SELECT doc_id, source, (floor(w / n) + CASE WHEN position < w % n THEN 1 ELSE 0 END)::INT AS copies FROM c)
SELECT doc_id, unnest(range(copies))::INT AS copy FROM k WHERE copies > 0""")
def ratio_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first part of every source by its ratio, or repeats beyond 1."""
    rows = table(spark, d, "documents").select("doc_id", "source")
    return sampling.ratio_rows(rows, ["source"], "doc_id", F.expr(_RATIO).cast("double")).select("doc_id", "copy")


@query(f"""
WITH s AS (SELECT url, min(path) AS path, split_part(url, '/', 2) AS src FROM shard_manifest WHERE url IS NOT NULL GROUP BY url),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY url) - 1 AS position FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {_U.format(seed=5, key='url')}, url) - 1 AS rk, count(*) OVER (PARTITION BY src) AS n, (length(src) % 4 + 1) * 0.4::DOUBLE AS ratio FROM p),
w AS (SELECT *, greatest(1, floor(n * ratio)) AS m FROM r), k AS (SELECT *, (floor(m / n) + CASE WHEN rk < m % n THEN 1 ELSE 0 END)::INT AS copies FROM w)
SELECT src, url, position, unnest(range(copies))::INT AS copy FROM k WHERE copies > 0""")
def shard_ratio(spark: SparkSession, d: str) -> DataFrame:
    shards = table(spark, d, "shard_manifest").where("url is not null").select("url", F.split("url", "/")[1].alias("src")).distinct()
    from voxloom.operators.ranking import with_group_position

    placed = with_group_position(shards, ["src"], "url")
    return sampling.shard_ratio(placed, ["src"], "url", "position", (F.length("src") % 4 + 1) * F.lit(0.4), 5).select("src", "url", "position", "copy")


@query("SELECT url, (p % 4)::INT AS consumer, p // 4 AS slot FROM (SELECT url, row_number() OVER (ORDER BY url) - 1 AS p FROM (SELECT DISTINCT url FROM shard_manifest WHERE url IS NOT NULL))")
def round_robin_assign(spark: SparkSession, d: str) -> DataFrame:
    shards = table(spark, d, "shard_manifest").where("url is not null").select("url").distinct()
    return sampling.round_robin(shards, "url", 4).select("url", "consumer", "slot")


@query("""
WITH s AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT url FROM shard_manifest WHERE url IS NOT NULL)),
x AS (SELECT q, unnest([q % (SELECT max(n) FROM s)]) AS p FROM (SELECT unnest(range((SELECT ceil(max(n) / 4) * 4 FROM s)::BIGINT)) AS q))
SELECT url, (q % 4)::INT AS consumer, q // 4 AS slot FROM x JOIN s USING (p)""")
def round_robin_padded(spark: SparkSession, d: str) -> DataFrame:
    shards = table(spark, d, "shard_manifest").where("url is not null").select("url").distinct()
    return sampling.round_robin(shards, "url", 4, padded=True).select("url", "consumer", "slot")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) WHERE p < n - n % 3 AND p % 3 = 1")
def rank_slice(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rank_slice(table(spark, d, "documents").select("doc_id"), "doc_id", 1, 3).select("doc_id")


MIX = {"brookline_reads": 0.3, "kettle_dialogs": 0.2, "lantern_tts": 0.1, "parlor_duplex": 0.4}


@query(f"""WITH u AS (SELECT doc_id, {_U.format(seed=17, key='doc_id')} AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.3 / 1.0 THEN 'brookline_reads' WHEN u < 0.5 THEN 'kettle_dialogs' WHEN u < 0.6 THEN 'lantern_tts' ELSE 'parlor_duplex' END AS source_name FROM u""")
def weighted_mix(spark: SparkSession, d: str) -> DataFrame:
    """Source of every slot of a resampled stream; document ids stand for the slots."""
    return table(spark, d, "documents").select("doc_id", sampling.source_by_weight(seeded(F.col("doc_id"), 17), MIX).alias("source_name"))


@query("WITH p AS (SELECT user_id, event_type, sum(value) AS w FROM events GROUP BY 1, 2), q AS (SELECT user_id, event_type, round(w, 4) AS w FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS rank FROM q) SELECT user_id, event_type, rank::INT AS rank FROM r WHERE rank <= 2")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("w"))
    return batching.top_k(weights, "user_id", "w", "event_type", 2).select("user_id", "event_type", "rank")


@query("""
WITH q AS (SELECT user_id, event_type, count(*)::DOUBLE AS w FROM events GROUP BY 1, 2), p AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS p FROM q),
b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY user_id ORDER BY w DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY user_id) AS t FROM p)
SELECT user_id, event_type, round(p, 6) AS p FROM b WHERE before <= 0.55 * t""")
def top_p_filter(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return batching.top_p(weights, "user_id", "w", "event_type", 0.55).select("user_id", "event_type", F.round("p", 6).alias("p"))


@query("""
WITH s AS (SELECT shard_url AS url, count(*) AS bytes, max(ingested_at) AS at_ FROM canonical_samples GROUP BY 1),
c AS (SELECT url, sum(bytes) OVER (ORDER BY at_ DESC, url DESC) AS upto FROM s) SELECT url, upto::BIGINT AS upto FROM c WHERE upto > (SELECT sum(bytes) * 0.5 FROM s)""")
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Shards that leave a cache of half the samples, the longest untouched first."""
    files = table(spark, d, "canonical_samples").groupBy(F.col("shard_url").alias("url")).agg(F.count(F.lit(1)).alias("bytes"), F.max("ingested_at").alias("touched"))
    cap = files.agg(F.sum("bytes")).first()[0] or 0
    return sampling.evict_oldest(files, "bytes", "touched", "url", cap * 0.5).select("url", "upto")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents QUALIFY position < 25")
def longest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Preview: the 25 longest documents."""
    top = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(25)
    return with_position(top, F.desc_nulls_last("n_chars"), "doc_id").select("doc_id", "position")
