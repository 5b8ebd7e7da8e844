"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import language, mixing, neardup, packing, stuffing, tokenize
from voxloom.llm import leaks as _leaks
from voxloom.session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of every sample, or of each piece of one longer than the capacity, for every profile."""
    return packing.pack_samples(table(spark, sf_dir, "canonical_samples"), table(spark, sf_dir, "batch_limits"))


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches hold, by profile: samples, pieces, their size, the largest piece and the batches of full pieces."""
    batches = p1_batches(spark, sf_dir)
    caps = table(spark, sf_dir, "batch_limits").select("profile", F.floor("max_cost").alias("cap"))
    full = F.count(F.when(F.col("piece_size") == F.col("cap"), 1))
    return (
        batches.join(F.broadcast(caps), "profile")
        .groupBy("profile")
        .agg(
            F.count(F.when(F.col("piece_no") == 0, 1)).alias("samples"),
            F.count(F.lit(1)).alias("pieces"),
            F.sum("piece_size").alias("total_size"),
            F.max("piece_size").alias("largest_piece"),
            full.alias("full_pieces"),
        )
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = neardup.spoken_members(table(spark, sf_dir, "tts"))
    members = cut_lineage(members)
    return neardup.similar_rows(members, neardup.links(members))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cut_lineage(neardup.spoken_members(table(spark, sf_dir, "tts")))
    return neardup.groups(members, neardup.links(members))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(language.label_chats(table(spark, sf_dir, "tts")))


def p3_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every stretch of every row."""
    return language.label_chats(table(spark, sf_dir, "tts")).drop("label")


def p4_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of every sample in a mixture of a tenth of the whole size."""
    samples = mixing.mixture_samples(table(spark, sf_dir, "canonical_samples"))
    return mixing.draw(samples, table(spark, sf_dir, "streaming_sources"))[0]


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every configured source."""
    samples = mixing.mixture_samples(table(spark, sf_dir, "canonical_samples"))
    shares = mixing.draw(samples, table(spark, sf_dir, "streaming_sources"))[1]
    return shares.withColumns({name: F.round(name, 6) for name in ("target_share", "target_size", "actual_share")})


def _targets(spark: SparkSession, sf_dir: str, total_share: float) -> DataFrame:
    samples = mixing.mixture_samples(table(spark, sf_dir, "canonical_samples"))
    samples = cut_lineage(samples)
    shares = mixing.draw(samples, table(spark, sf_dir, "streaming_sources"), total_share=total_share)[1]
    largest = samples.groupBy("source_name").agg((F.max("size") / 2).alias("half"))
    capped = F.col("target_size") > F.col("max_uses") * F.col("available_size")
    lacks = F.col("target_size") - F.col("actual_size")
    return shares.join(largest, "source_name", "left").select(
        "source_name", "max_uses", F.col("samples").cast("long"), F.col("available_size").cast("long"), F.round("target_size", 3).alias("target_size"),
        F.col("actual_size").cast("long"), capped.alias("capped"), F.coalesce(F.abs(lacks) <= F.col("half"), F.col("target_size") == 0).alias("met"),
    )


def p4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and drawn sizes; met: within half of the source's largest sample, which is what whole samples can promise."""
    return _targets(spark, sf_dir, mixing.TOTAL_SHARE)


def p4_full_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of every sample in a mixture of the whole size, in which samples repeat and sources reach their caps."""
    samples = mixing.mixture_samples(table(spark, sf_dir, "canonical_samples"))
    return mixing.draw(samples, table(spark, sf_dir, "streaming_sources"), total_share=mixing.FULL_SHARE)[0]


def p4_full_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the mixture of the whole size; capped sources stay below theirs."""
    return _targets(spark, sf_dir, mixing.FULL_SHARE)


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (p1_batches, p1_totals, p2_found, p2_groups, p3_found, p3_stretches, p4_uses, p4_shares, p4_targets, p4_full_uses, p4_full_targets, p5_ids, p6_found, p7_found)
    return {f.__name__: f for f in found}


_KNOWN = """
known AS (
  SELECT uid, arg_max(size, (coalesce(ingested_at, TIMESTAMP '1000-01-01'), size)) AS size
  FROM (SELECT uid, ingested_at, {sum} AS size FROM canonical_samples WHERE uid IS NOT NULL AND {known})
  GROUP BY uid
)"""


def _known(fields: tuple[str, ...]) -> str:
    return _KNOWN.format(sum=" + ".join(f"lengths.{f}::BIGINT" for f in fields), known=" AND ".join(f"coalesce(lengths.{f}, -1) >= 0" for f in fields))


P1_TOTALS = f"""
WITH {_known(packing.PACKED_FIELDS)},
caps AS (SELECT profile, floor(max_cost)::BIGINT AS cap FROM batch_limits WHERE max_cost IS NOT NULL AND NOT isnan(max_cost) AND max_cost >= 1)
SELECT profile, count(*)::BIGINT AS samples, sum(CASE WHEN size <= cap THEN 1 ELSE ceil(size / cap) END)::BIGINT AS pieces,
  sum(size)::BIGINT AS total_size, max(least(size, cap))::BIGINT AS largest_piece, sum(size // cap)::BIGINT AS full_pieces
FROM known, caps GROUP BY profile
"""

# The whole draw: aims, certain sizes, Pareto order, cut and closing sample of every source.
_DRAW = """
WITH {known},
names AS (
  SELECT uid, coalesce(min(nullif(lower(trim(source_name)), '')), nullif(lower(trim(split_part(uid, ':', 1))), '')) AS source_name
  FROM canonical_samples WHERE uid IS NOT NULL GROUP BY uid
),
items AS MATERIALIZED (SELECT uid, source_name, size FROM known JOIN names USING (uid)),
held AS (SELECT source_name, count(*) AS samples, sum(size)::BIGINT AS available_size, max(size) / 2 AS half FROM items GROUP BY source_name),
both_ AS (
  SELECT lower(trim(name)) AS source_name, weight, ratio, coalesce(samples, 0)::BIGINT AS samples, coalesce(available_size, 0)::BIGINT AS available_size, half,
    CASE WHEN coalesce(available_size, 0) > 0 AND weight > 0 THEN weight ELSE 0 END AS usable
  FROM streaming_sources LEFT JOIN held ON lower(trim(name)) = source_name
),
whole_ AS (
  SELECT b.*, usable / (SELECT fsum(usable) FROM both_) AS target_share, (SELECT sum(size) FROM items)::DOUBLE * {share}::DOUBLE AS total FROM both_ b
),
targets AS (
  SELECT *, greatest(1, floor(ratio))::INT AS max_uses, target_share * total AS target_size,
    least(target_size, CASE WHEN ratio >= 1 THEN floor(ratio) * available_size ELSE greatest(ratio, 0) * available_size END) AS drawn,
    CASE WHEN available_size > 0 THEN floor(drawn / available_size) ELSE 0 END AS whole, drawn - whole * available_size AS rest
  FROM whole_
),
steps AS (
  SELECT source_name, size, coalesce(sum(n * size) OVER (PARTITION BY source_name ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS certain,
    (rest - certain) / (sum(n * size * size) OVER (PARTITION BY source_name ORDER BY size))::DOUBLE AS c, rest
  FROM (SELECT source_name, size, count(*) AS n FROM items WHERE size > 0 GROUP BY ALL) JOIN targets USING (source_name) WHERE rest > 0
),
borders AS (SELECT source_name, max(size) AS border, arg_max(c, size) AS c, arg_max(rest - certain, size) AS gap FROM steps WHERE c * size < 1 GROUP BY source_name),
ranked AS (
  SELECT i.uid, i.source_name, i.size, coalesce(whole, 0) + CASE WHEN i.size > border THEN 1 ELSE 0 END AS base, gap, border, c,
    ('0x' || substring(sha256('7:' || i.uid), 1, 13))::BIGINT / 4503599627370496.0 AS u,
    CASE WHEN i.size > 0 AND i.size <= border THEN (u / (1 - u)) * ((1 - c * i.size) / (c * i.size)) END AS rank
  FROM items i LEFT JOIN targets USING (source_name) LEFT JOIN borders USING (source_name)
),
placed AS (
  SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source_name ORDER BY rank IS NULL, rank, uid ROWS UNBOUNDED PRECEDING) END AS upto FROM ranked
),
lefts AS (SELECT source_name, arg_min(gap - upto + size, upto) AS lack FROM placed WHERE upto > gap GROUP BY source_name),
closing AS (
  SELECT arg_min(uid, (abs(lack - size), rank, uid)) AS uid, true AS closes FROM placed JOIN lefts USING (source_name)
  WHERE upto > gap AND abs(lack - size) < lack GROUP BY source_name
),
uses AS (
  SELECT uid, source_name, size, (base + CASE WHEN upto <= gap THEN 1 ELSE 0 END + CASE WHEN closes THEN 1 ELSE 0 END)::INT AS uses
  FROM placed LEFT JOIN closing USING (uid)
),
drawn AS (SELECT source_name, sum(uses)::BIGINT AS uses, sum(uses * size)::BIGINT AS actual_size FROM uses GROUP BY source_name),
shares AS (
  SELECT source_name, weight, max_uses, samples, available_size, target_share, target_size, coalesce(uses, 0) AS uses, coalesce(actual_size, 0) AS actual_size, half
  FROM targets LEFT JOIN drawn USING (source_name)
)
"""


def _draw(share: float, select: str) -> str:
    return _DRAW.format(known=_known(mixing.MIXED_FIELDS), share=share) + select


_USES = "SELECT uid, source_name, size, uses FROM uses"
_SHARES = """SELECT source_name, weight, max_uses, samples, available_size, round(target_share, 6) AS target_share, round(target_size, 6) AS target_size, uses, actual_size,
  round(actual_size / (SELECT sum(actual_size) FROM shares), 6) AS actual_share FROM shares"""
_TARGETS = """SELECT source_name, max_uses, samples, available_size, round(target_size, 3) AS target_size, actual_size, target_size > max_uses * available_size AS capped,
  coalesce(abs(target_size - actual_size) <= half, target_size = 0) AS met FROM shares"""


# Similar texts without sketches: sets of runs, candidates by their rarest runs (a pair of similarity 0.7 shares one of them),
# exact similarity of every candidate.
_ALIKE = r"""
WITH said AS (
  SELECT row_id, trim(replace(array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(m.role)) IN ('assistant', 'gpt') AND m.content IS NOT NULL), lambda m: m.content), chr(10)), '<|audio|>', '')) AS t FROM tts WHERE messages IS NOT NULL
),
rows_ AS (SELECT DISTINCT row_id, n FROM (SELECT row_id, regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g') AS n FROM said) WHERE length(n) >= 40),
texts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n) AS k, n, list_distinct(list_transform(range(1, length(n) - 2), lambda i: substring(n, i, 4))) AS s FROM (SELECT DISTINCT n FROM rows_)),
held AS (SELECT k, len(s) AS c, unnest(s) AS g FROM texts),
df AS (SELECT g, count(*) AS d FROM held GROUP BY g),
pre AS MATERIALIZED (SELECT k, g, c FROM (SELECT k, c, g, row_number() OVER (PARTITION BY k ORDER BY d, g) AS r FROM held JOIN df USING (g)) WHERE r <= c - ceil(0.7 * c) + 1),
cand AS (SELECT DISTINCT a.k AS a, b.k AS b FROM pre a JOIN pre b ON a.g = b.g AND a.k < b.k AND least(a.c, b.c) >= 0.7 * greatest(a.c, b.c)),
scored AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS u FROM cand JOIN texts x ON x.k = a JOIN texts y ON y.k = b),
links AS MATERIALIZED (SELECT a, b FROM scored WHERE i::DOUBLE / (u - i) >= 0.7),
ids AS MATERIALIZED (SELECT k, row_id FROM rows_ JOIN texts USING (n))
"""
_PAIRS = """SELECT least(x.row_id, y.row_id) AS row_id_a, greatest(x.row_id, y.row_id) AS row_id_b FROM links JOIN ids x ON x.k = a JOIN ids y ON y.k = b
UNION ALL SELECT x.row_id, y.row_id FROM ids x JOIN ids y ON x.k = y.k AND x.row_id < y.row_id"""
_CLASSES = """,
both_ AS MATERIALIZED (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k AS u, k AS v FROM texts UNION SELECT reach.u, both_.v FROM reach JOIN both_ ON both_.u = reach.v),
class AS (SELECT u AS k, min(v) AS root FROM reach GROUP BY u),
least_ AS (SELECT root, min(row_id) AS group_id FROM class JOIN ids USING (k) GROUP BY root)
SELECT row_id, group_id, coalesce(d.links, 0)::BIGINT AS links FROM ids JOIN class USING (k) JOIN least_ USING (root) LEFT JOIN (SELECT u AS k, count(*) AS links FROM both_ GROUP BY u) d USING (k)"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can state; the other queries are tested against brute force in ``tests/llm``."""
    return {
        "p1_totals": P1_TOTALS,
        "p2_found": _ALIKE + _PAIRS,
        "p2_groups": _ALIKE.replace("WITH said", "WITH RECURSIVE said") + _CLASSES,
        "p4_uses": _draw(mixing.TOTAL_SHARE, _USES),
        "p4_shares": _draw(mixing.TOTAL_SHARE, _SHARES),
        "p4_targets": _draw(mixing.TOTAL_SHARE, _TARGETS),
        "p4_full_uses": _draw(mixing.FULL_SHARE, _USES),
        "p4_full_targets": _draw(mixing.FULL_SHARE, _TARGETS),
    }
