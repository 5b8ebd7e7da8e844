"""Queries over sources and sinks.

Each writes files made from the tables into the shared folder, in the format that its reader or sink is for, and reads them
back; the SQL states what must come out in terms of the tables alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import audit, evaluate
from voxloom.plans.registry import query
from voxloom.session import cut_lineage, ensure_checkpoint_dir, table
from voxloom.sources import audio, files, manifest, tar


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files/{uuid.uuid4()}"


# Shards: a sidecar for each row, a member for each asset (its id as payload); some keys get an empty note, some an unreadable
# sidecar, and some shards a member without a suffix.
_MEMBERS = r"""
rows_ AS (SELECT shard_url AS shard, physical_key AS key, task, assets FROM canonical_samples WHERE shard_url IS NOT NULL AND physical_key IS NOT NULL AND task IS NOT NULL),
all_ AS (
  SELECT shard, key, CASE WHEN task = 's2s' THEN 'json' ELSE task || '.json' END AS suffix, CASE WHEN right(key, 2) = '13' THEN '{' ELSE '{"task":"' || task || '"}' END AS data FROM rows_
  UNION ALL SELECT shard, key, a.member_key, coalesce(a.asset_id, '') FROM (SELECT shard, key, unnest(map_values(assets)) AS a FROM rows_) WHERE a.member_key IS NOT NULL
  UNION ALL SELECT shard, key, 'note.txt', '' FROM rows_ WHERE right(key, 1) = '7'
),
members AS (SELECT shard, key, suffix, max(data) AS data FROM all_ GROUP BY ALL),
loose AS (SELECT DISTINCT shard FROM rows_ WHERE right(shard, 5) = '1.tar')"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_samples").where("shard_url is not null and physical_key is not null and task is not null")
    rows = rows.select(F.col("shard_url").alias("shard"), F.col("physical_key").alias("key"), "task", "assets")
    suffix = F.when(F.col("task") == "s2s", "json").otherwise(F.concat("task", F.lit(".json")))
    text = F.when(F.right("key", F.lit(2)) == "13", "{").otherwise(F.concat(F.lit('{"task":"'), "task", F.lit('"}')))
    side = rows.select("shard", "key", suffix.alias("suffix"), text.alias("data"))
    assets = rows.select("shard", "key", F.explode(F.map_values("assets")).alias("a")).select("shard", "key", F.col("a.member_key").alias("suffix"), F.coalesce("a.asset_id", F.lit("")).alias("data"))
    notes = rows.where(F.right("key", F.lit(1)) == "7").select("shard", "key", F.lit("note.txt").alias("suffix"), F.lit("").alias("data"))
    members = side.unionByName(assets.where("suffix is not null")).unionByName(notes).groupBy("shard", "key", "suffix").agg(F.max("data").alias("data"))
    loose = rows.where(F.right("shard", F.lit(5)) == "1.tar").select("shard").distinct().select("shard", F.lit("zz_readme").alias("name"), F.lit("x").alias("data"))
    return members.select("shard", F.concat_ws(".", "key", "suffix").alias("name"), "data").unionByName(loose)


def _shards(spark: SparkSession, d: str) -> list[dict[str, str]]:
    return tar.write_shards(_members(spark, d), _folder(spark))


@query(f"WITH {_MEMBERS} SELECT shard AS url, key, count(*) AS members, sum(strlen(data))::BIGINT AS bytes, max(CASE WHEN suffix = 'asr.json' THEN data END) AS asr FROM members GROUP BY ALL")
def tar_scan(spark: SparkSession, d: str) -> DataFrame:
    """Physical samples of tar shards."""
    rows = tar.read_shards(spark, _shards(spark, d)).where("error is null")
    size = F.aggregate(F.map_values("sizes"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("url", "key", F.size("members").cast("long").alias("members"), size.alias("bytes"), F.try_element_at("members", F.lit("asr.json")).cast("string").alias("asr"))


_AUDITED = rf"""{_MEMBERS},
keys AS (SELECT shard, key, list(suffix) AS s, sum(strlen(data)) AS bytes, count(*) AS members, count(*) FILTER (data = '') AS empty, count(*) FILTER (data = '{{') AS broken FROM members GROUP BY ALL),
clues AS (
  SELECT *, len(list_filter(s, lambda x: x = 'json' OR starts_with(x, 'question.') OR starts_with(x, 'response.'))) > 0 AS pair,
    len(list_filter(s, lambda x: starts_with(x, 'audio.') OR x IN ('asr.json', 'tts.json', 's2tt.json', 'ser.json', 'asc.json'))) > 0 AS shared,
    len(list_filter(s, lambda x: regexp_matches(x, '(?i)^question[.](wav|flac|mp3|m4a|ogg)$'))) AS q, len(list_filter(s, lambda x: regexp_matches(x, '(?i)^response[.](wav|flac|mp3|m4a|ogg)$'))) AS r,
    len(list_filter(s, lambda x: regexp_matches(x, '(?i)^audio[.](wav|flac|mp3|m4a|ogg)$'))) AS a, list_filter(['asr', 'tts', 's2tt', 'ser', 'asc'], lambda t: list_contains(s, t || '.json')) AS t FROM keys
),
judged AS (
  SELECT *, CASE WHEN pair AND NOT shared THEN 's2s_pair' WHEN shared AND NOT pair THEN 'shared_audio_tasks' END AS layout,
    CASE WHEN pair AND shared THEN 'AmbiguousLayout' WHEN NOT pair AND NOT shared THEN 'UnknownLayout'
      WHEN pair THEN CASE WHEN q = 0 THEN 'MissingMember' WHEN q > 1 THEN 'DuplicateMember' WHEN r = 0 THEN 'MissingMember' WHEN r > 1 THEN 'DuplicateMember' WHEN NOT list_contains(s, 'json') THEN 'MissingMember' END
      ELSE CASE WHEN a = 0 THEN 'MissingMember' WHEN a > 1 THEN 'DuplicateMember' WHEN len(t) = 0 THEN 'MissingMember' END END AS error
  FROM clues
),
samples AS (SELECT *, CASE WHEN error IS NOT NULL THEN [] WHEN layout = 's2s_pair' THEN ['s2s'] ELSE t END AS tasks FROM judged)"""


@query(f"""WITH {_AUDITED}
SELECT shard, count(*) AS physical_samples, sum(len(tasks))::BIGINT AS logical_samples, (sum(members) + coalesce(max(l.n), 0))::BIGINT AS members, (sum(bytes) + coalesce(max(l.n), 0))::BIGINT AS member_bytes,
  (sum(empty + broken + CASE WHEN error IS NULL THEN 0 ELSE 1 END) + coalesce(max(l.n), 0))::BIGINT AS errors
FROM samples LEFT JOIN (SELECT shard, 1 AS n FROM loose) l USING (shard) GROUP BY shard""")
def shard_report(spark: SparkSession, d: str) -> DataFrame:
    """Samples, members, bytes and errors of every shard."""
    return audit.shard_reports(audit.audited(tar.read_members(spark, _shards(spark, d))))


@query(f"""WITH {_AUDITED}
SELECT 'layout' AS kind, layout AS name, count(*) AS n FROM samples WHERE layout IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'task', t, count(*) FROM (SELECT unnest(tasks) AS t FROM samples) GROUP BY ALL
UNION ALL SELECT 'codec', lower(regexp_extract(suffix, '[^.]*$')), count(*) FROM members WHERE regexp_matches(suffix, '(?i)^(question|response|audio)[.](wav|flac|mp3|m4a|ogg)$') GROUP BY ALL
UNION ALL SELECT 'error', error, count(*) FROM (
  SELECT error FROM samples WHERE error IS NOT NULL UNION ALL SELECT 'EmptyMember' FROM members WHERE data = '' UNION ALL SELECT 'MetadataDecode' FROM members WHERE data = '{{' UNION ALL SELECT 'InvalidMemberName' FROM loose
) GROUP BY ALL""")
def shard_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Layouts, tasks, codecs and error types over all shards."""
    return audit.frequencies(audit.audited(tar.read_members(spark, _shards(spark, d))))


_LISTED = "SELECT url, min(path) AS path FROM shard_manifest WHERE url IS NOT NULL GROUP BY url HAVING NOT bool_or(coalesce(disabled, false))"


@query(_LISTED)
def manifest_read(spark: SparkSession, d: str) -> DataFrame:
    """A JSONL manifest, one entry per url, read as a list of enabled shards; a path beside the url is where to read."""
    rows = table(spark, d, "shard_manifest").where("url is not null").groupBy("url").agg(F.min("path").alias("path"), F.bool_or(F.coalesce("disabled", F.lit(False))).alias("disabled"))
    folder = _folder(spark)
    line = F.to_json(F.struct("url", "path", "disabled"))
    with tar.open_sink(f"{folder}/m.jsonl") as out:  # a manifest is a driver-side list
        out.write("\n".join(r["line"] for r in rows.select(line.alias("line")).orderBy("line").collect()).encode())
    made = manifest.load_manifest(f"{folder}/m.jsonl")
    return spark.createDataFrame([(m["url"], None if m["path"].startswith(folder) else m["path"]) for m in made], "url string, path string")


@query("SELECT 'shards/' || n || '/p' || lpad(i::VARCHAR, 2, '0') || '-' || k || '.tar' AS url FROM (SELECT DISTINCT name AS n FROM streaming_sources WHERE name IS NOT NULL), range(8, 13) t(i), (VALUES ('a'), ('b')) v(k)")
def brace_expand(spark: SparkSession, d: str) -> DataFrame:
    """Brace patterns of every configured source (a configuration table)."""
    names = [r["name"] for r in table(spark, d, "streaming_sources").select("name").where("name is not null").distinct().orderBy("name").collect()]
    return spark.createDataFrame([(u,) for u in manifest.expand_all([f"shards/{n}/p{{08..12}}-{{a,b}}.tar" for n in names])], "url string")


_CHAT_SIZES = "coalesce(len(messages), 0)::INT AS turns, coalesce(list_sum(list_transform(messages, lambda m: length(m.content))), 0)::BIGINT AS chars"


def _chat_sizes(rows: DataFrame, *more: Column | str) -> DataFrame:
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    return rows.select(*more, F.coalesce(F.size(F.when(F.col("messages").isNotNull(), F.col("messages"))), F.lit(0)).alias("turns"), F.coalesce(chars, F.lit(0).cast("long")).alias("chars"))


@query(f"""SELECT row_id, false AS broken, {_CHAT_SIZES}, num_tokens_est FROM tts WHERE row_id % 10 <> 3
UNION ALL SELECT NULL, true, 0, 0, NULL FROM tts WHERE row_id % 10 = 3""")
def chat_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Chat rows written as JSON lines and read with an explicit schema; each tenth line is broken and keeps its text."""
    path = _folder(spark)
    line = F.to_json(F.struct("row_id", "messages", "audios", "num_tokens_est"))
    rows = table(spark, d, "tts").select(F.when(F.col("row_id") % 10 == 3, F.left(line, F.lit(7))).otherwise(line).alias("value"))
    rows.write.text(path)
    read = files.read_chat_jsonl(spark, path, "row_id bigint").withColumn("broken", F.col("_corrupt_record").isNotNull())
    return _chat_sizes(read, "row_id", "broken", "num_tokens_est")


@query("SELECT \"index\", length(question) AS q, answer FROM benchmark_items")
def json_array(spark: SparkSession, d: str) -> DataFrame:
    """A file that is one JSON array (the evaluation items, a fixed table)."""
    folder = _folder(spark)
    rows = table(spark, d, "benchmark_items").select("index", "question", "answer").orderBy("index")
    with tar.open_sink(f"{folder}/items.json") as out:
        out.write(("[" + ",\n".join(r["j"] for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()) + "]").encode())
    return files.read_chat_jsonl(spark, f"{folder}/items.json", "index bigint, question string, answer string", multi_line=True).select("index", F.length("question").alias("q"), "answer")


@query("SELECT row_id, len(audios) AS audios, audios[1] AS first, num_tokens_est FROM tts")
def jsonl_projection(spark: SparkSession, d: str) -> DataFrame:
    """Only the named fields of wide JSON lines are parsed."""
    path = _folder(spark)
    files.write_jsonl(table(spark, d, "tts"), path)
    return files.read_chat_jsonl(spark, path, "row_id bigint").select("row_id", F.size(F.when(F.col("audios").isNotNull(), F.col("audios"))).alias("audios"), F.try_element_at("audios", F.lit(1)).alias("first"), "num_tokens_est")


_CORPUS = """SELECT row_id::VARCHAR AS uuid, messages[1].content AS generated_text, audios[1] AS path, speaker, source_name AS src FROM tts"""


@query(f"SELECT uuid, length(generated_text) AS chars, path FROM ({_CORPUS})")
def corpus_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Speech-corpus parquet below nested folders; a table without its two columns is none."""
    folder = _folder(spark)
    wav = F.struct(F.try_element_at("audios", F.lit(1)).alias("path"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("array<float>").alias("array"), F.lit(None).cast("int").alias("sampling_rate"))
    rows = table(spark, d, "tts").select(F.col("row_id").cast("string").alias("uuid"), F.try_element_at("messages", F.lit(1))["content"].alias("generated_text"), wav.alias("generated_wav"), "speaker", F.col("source_name").alias("src"))
    rows.write.parquet(f"{folder}/a/b")
    table(spark, d, "region").write.parquet(f"{folder}/c")
    if files.read_corpus_parquet(spark, f"{folder}/c") is not None:
        raise AssertionError("a table without audio passed for a corpus")
    return files.read_corpus_parquet(spark, f"{folder}/a").select("uuid", F.length("generated_text").alias("chars"), F.col("generated_wav.path").alias("path"))


@query("SELECT 'jsonl' AS kind, count(*) AS n FROM tts UNION ALL SELECT 'parquet', count(*) FROM tts UNION ALL SELECT 'missing', 0")
def load_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """One loader for parquet folders, JSON lines and paths that do not exist."""
    folder, rows = _folder(spark), table(spark, d, "tts").select("messages", "audios")
    rows.write.parquet(f"{folder}/p.parquet")
    files.write_jsonl(rows, f"{folder}/l.jsonl")
    found = [(kind, files.load_any(spark, f"{folder}/{name}")) for kind, name in (("parquet", "p.parquet"), ("jsonl", "l.jsonl"), ("missing", "none.jsonl"))]
    counts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") if f is not None else spark.createDataFrame([(k, 0)], "kind string, n bigint") for k, f in found]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_TSV = r"""SELECT row_id, coalesce(speaker, '') AS speaker, CASE WHEN audio_durations[1] IS NULL OR isnan(audio_durations[1]) THEN 'x' ELSE round(audio_durations[1], 3)::VARCHAR END AS duration,
  replace(replace(coalesce(messages[1].content, ''), chr(10), ' '), chr(13), ' ') || chr(9) || 'tail' AS transcript FROM tts WHERE len(coalesce(source_name, '')) > 0"""


@query(rf"""SELECT 'r' || row_id AS id, CASE WHEN row_id % 9 = 0 THEN NULL ELSE speaker END AS audio, CASE WHEN row_id % 9 <> 0 THEN transcript END AS transcript,
  CASE WHEN row_id % 9 = 0 THEN 'columns' WHEN duration = 'x' THEN 'duration' END AS error FROM ({_TSV})""".replace("'r' || row_id AS id", "CASE WHEN row_id % 9 = 0 THEN NULL ELSE 'r' || row_id END AS id"))
def tsv_read(spark: SparkSession, d: str) -> DataFrame:
    """TSV metadata split at the first three tabs only; the header is skipped, rows of too few columns or without a number are errors."""
    path = _folder(spark)
    text = F.translate(F.coalesce(F.try_element_at("messages", F.lit(1))["content"], F.lit("")), "\n\r", "  ")
    seconds = F.try_element_at("audio_durations", F.lit(1))
    seconds = F.when(seconds.isNull() | F.isnan(seconds), "x").otherwise(F.round(seconds, 3).cast("string"))
    rows = table(spark, d, "tts").where("length(source_name) > 0")
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("row_id").cast("string")), F.coalesce("speaker", F.lit("")), seconds, text, F.lit("tail"))
    line = F.when(F.col("row_id") % 9 == 0, F.concat(F.lit("r"), F.col("row_id").cast("string"))).otherwise(line)
    # one file, as the format has one header: a fixture of this query, not a sink
    rows.select(F.col("row_id").alias("at"), line.alias("value")).unionByName(spark.createDataFrame([(-1, "ID\tAUDIO\tDURATION\tTEXT")], "at bigint, value string")).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return files.read_tsv(spark, path).select("id", "audio", "transcript", "error")


_AUDIO_FILES = "SELECT \"index\", 'a' || \"index\" AS stem, replace(replace(coalesce(audio_content, ''), chr(10), ' '), chr(13), ' ') AS text FROM benchmark_items WHERE \"index\" % 5 = 0"


@query(f"""SELECT stem, CASE WHEN "index" % 10 = 0 OR text = '' THEN '' ELSE text END AS transcript, (44 + 2 * ("index" % 50))::BIGINT AS bytes FROM ({_AUDIO_FILES})""")
def transcript_join(spark: SparkSession, d: str) -> DataFrame:
    """Audio files listed without reading them, joined with transcripts by stem; a missing transcript is empty."""
    folder = _folder(spark)
    rows = table(spark, d, "benchmark_items").where("index % 5 = 0").select("index", F.translate(F.coalesce("audio_content", F.lit("")), "\n\r", "  ").alias("text"))
    for row in rows.select("index").orderBy("index").collect():  # a fixed table of 400 items
        with tar.open_sink(f"{folder}/audio/{row['index'] % 3}/a{row['index']}.wav") as out:
            out.write(audio.wav_bytes(b"\0\0" * (row["index"] % 50), 16000))
    rows.where("index % 10 <> 0 and text <> ''").select(F.concat(F.lit("a"), F.col("index").cast("string"), F.lit(" "), "text").alias("value")).write.text(f"{folder}/text")
    joined = files.join_transcripts(files.list_audio(spark, f"{folder}/audio"), files.read_transcripts(spark, f"{folder}/text"), strict=False)
    return joined.select("stem", "transcript", "bytes")


@query("SELECT \"index\", answer FROM benchmark_items WHERE subset IN (SELECT min(subset) FROM benchmark_items UNION SELECT max(subset) FROM benchmark_items)")
def subset_scan(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as JSON lines, read with a subset filter."""
    path, rows = _folder(spark), table(spark, d, "benchmark_items")
    files.write_jsonl(rows, path)
    wanted = rows.agg(F.min("subset").alias("a"), F.max("subset").alias("b")).first()
    read = spark.read.schema("index bigint, subset string, answer string").json(path)
    return read.where(F.col("subset").isin(wanted["a"], wanted["b"])).select("index", "answer")


@query("""WITH l AS (SELECT (row_number() OVER (ORDER BY "index") - 1)::BIGINT AS line_no, "index" AS i FROM benchmark_items),
v AS (SELECT line_no, CASE WHEN i % 7 = 0 THEN line_no WHEN i % 7 = 1 THEN NULL WHEN i % 7 = 2 THEN 3 ELSE 100000 + i END AS "index" FROM l WHERE i % 7 <> 6),
f AS (SELECT "index", min(line_no) AS first FROM v WHERE "index" IS NOT NULL GROUP BY 1)
SELECT line_no, v."index", CASE WHEN v."index" IS NULL THEN 'index_not_integer' WHEN line_no > first THEN 'duplicate_index' END AS error FROM v LEFT JOIN f ON v."index" = f."index" """)
def request_read(spark: SparkSession, d: str) -> DataFrame:
    """Request lines: default index by line number (blank lines count), whole numbers only, repeated ones are errors."""
    path, i = _folder(spark), F.col("index")
    head = F.when(i % 7 == 0, "").when(i % 7 == 1, '"index": true, ').when(i % 7 == 2, '"index": 3, ').otherwise(F.concat(F.lit('"index": '), (i + 100000).cast("string"), F.lit(", ")))
    line = F.when(i % 7 == 6, "").otherwise(F.concat(F.lit("{"), head, F.lit('"task": "asr"}')))
    table(spark, d, "benchmark_items").select("index", line.alias("value")).coalesce(1).sortWithinPartitions("index").select("value").write.text(path)
    return files.read_requests(spark, path, strict=False).select("line_no", "index", "error")


@query("""SELECT "index", CASE "index" % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad' ELSE 'ok' END AS state FROM benchmark_items""")
def trace_scan(spark: SparkSession, d: str) -> DataFrame:
    """Trace lines read from files and checked against their schema; each fourth has a boolean index."""
    path, i = _folder(spark), F.col("index")
    trace = F.struct(
        F.lit("asr").alias("task"), F.struct(F.lit(None).cast("string").alias("text"), F.coalesce("audio_path", F.lit("x.wav")).alias("audio_path"), F.lit("").alias("model_prompt")).alias("input"),
        F.struct(F.coalesce("answer", F.lit("")).alias("text"), F.lit(None).cast("string").alias("audio_path")).alias("output"),
        F.struct(*[F.lit("").alias(n) for n in ("subset", "group", "answer", "audio_content", "instruction", "instruction_kwargs", "reference_text", "prediction_text")]).alias("evaluation"),
        F.struct(F.lit("s").alias("sample_id"), F.lit("c").alias("checkpoint"), F.lit(12.5).alias("target_framerate_hz"), F.lit(1.5).alias("audio_duration_seconds")).alias("metadata"),
    )
    body = F.expr("substring(b, 2)")
    index = F.when(i % 4 == 1, "true").otherwise(i.cast("string"))
    rows = table(spark, d, "benchmark_items").withColumn("b", F.to_json(trace, {"ignoreNullFields": "false"})).select("index", F.concat(F.lit('{"index": '), index, F.lit(", "), body).alias("value"))
    rows.select("value").write.text(path)
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    checked = cut_lineage(evaluate.parse_traces(lines))
    good = checked.where("error is null").select(F.try_variant_get(F.parse_json("value"), "$.index", "bigint").alias("index"), F.lit("ok").alias("state"))
    lost = table(spark, d, "benchmark_items").select("index").join(good, "index", "left_anti").select("index", F.lit("bad").alias("state"))
    return good.unionByName(lost)


@query("""SELECT CASE WHEN detail IS NULL THEN 'traces' ELSE 'errors' END AS status, count(*) AS n, count(DISTINCT detail) AS kinds FROM quarantine GROUP BY ALL""")
def results_split(spark: SparkSession, d: str) -> DataFrame:
    """Results and errors written apart in one pass; what is read back is what was counted."""
    path = _folder(spark)
    counts = files.write_results(table(spark, d, "quarantine").select("key", "task", F.col("detail").alias("error")), path)
    read = spark.read.schema("key string, task string, error string, status string").json(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("error").alias("kinds"))
    return read.where(F.col("n") == F.when(F.col("status") == "traces", counts["traces"]).otherwise(counts["errors"]))


@query("SELECT 'voice-1_' || coalesce(nullif(subset, ''), 'items') || '.jsonl' AS name, count(*) AS n FROM benchmark_items GROUP BY ALL")
def eval_file_write(spark: SparkSession, d: str) -> DataFrame:
    """One evaluation file per dataset, named after model and dataset (a handful of subsets of a fixed table)."""
    folder = _folder(spark)
    rows = table(spark, d, "benchmark_items").select("index", F.coalesce(F.nullif("subset", F.lit("")), F.lit("items")).alias("dataset"), "answer")
    for row in rows.select("dataset").distinct().orderBy("dataset").collect():
        files.write_jsonl(rows.where(F.col("dataset") == row["dataset"]).drop("dataset"), files.eval_file(folder, "voice-1", row["dataset"]))
    read = spark.read.schema("index bigint, answer string").option("recursiveFileLookup", True).json(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]*\.jsonl)/", 1).alias("name"))
    return read.groupBy(F.url_decode("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, stage, count(*) AS n, count(DISTINCT key) AS keys FROM quarantine GROUP BY ALL")
def quarantine_write(spark: SparkSession, d: str) -> DataFrame:
    """Error rows appended in two runs, by source and stage."""
    path, rows = _folder(spark), table(spark, d, "quarantine").select("source", "stage", "key", "error", "epoch")
    files.write_quarantine(rows.where("coalesce(epoch, 0) % 2 = 0"), path)
    files.write_quarantine(rows.where("coalesce(epoch, 0) % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("source", "stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@query("""SELECT row_id, len(audio_durations) AS n, round(CASE WHEN NOT isnan(audio_durations[1]) THEN audio_durations[1] END, 3) AS seconds,
  CASE WHEN isnan(audio_durations[1]) THEN 0 ELSE floor(round(audio_durations[1], 3) * 17) END::BIGINT AS tokens FROM tts WHERE audio_durations IS NOT NULL""")
def sidecar_write(spark: SparkSession, d: str) -> DataFrame:
    """Measured durations and tokens in a sidecar file that is preferred under a token budget; a second run leaves it alone."""
    base = f"{_folder(spark)}/chat.jsonl"
    rows = table(spark, d, "tts").where("audio_durations is not null").select("row_id", "messages", "audios", "audio_durations")
    side = files.sidecar_path(base)
    files.write_jsonl(files.with_estimates(rows, F.col("audio_durations")), side)
    files.write_jsonl(rows.limit(0), side)  # exists already
    read = files.read_chat_jsonl(spark, files.prefer_sidecar(base, 5000), "row_id bigint")
    first = F.try_element_at("audio_durations", F.lit(1))
    return read.select("row_id", F.size("audio_durations").alias("n"), F.when(~F.isnan(first), first).alias("seconds"), F.try_element_at("audio_tokens", F.lit(1)).alias("tokens"))


@query("SELECT row_id AS line_no, row_id AS value FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS row_id FROM events)")
def line_splits(spark: SparkSession, d: str) -> DataFrame:
    """Lines of many files numbered in file order, without one task for all."""
    path = _folder(spark)
    n = table(spark, d, "events").count()
    spark.range(0, n, 1, 7).select(F.col("id").cast("string").alias("value")).write.text(path)
    return files.read_lines(spark, path).select("line_no", F.col("value").cast("long").alias("value"))


_SOUNDS = """SELECT uid, e.key AS asset, (e.value.num_frames % 4000)::INT AS frames, e.value.sample_rate AS rate FROM (SELECT uid, unnest(map_entries(assets)) AS e FROM (SELECT DISTINCT uid, assets FROM canonical_samples))
WHERE e.value.num_frames >= 0 AND e.value.sample_rate > 0"""


@query(f"SELECT uid, asset, frames, round(max(CASE WHEN frames % 5 = 0 THEN NULL ELSE frames / rate END), 9) AS seconds, count(*) AS n FROM ({_SOUNDS}) GROUP BY ALL")
def wav_durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations from WAV headers; bytes that are no WAV have none."""
    rows = table(spark, d, "canonical_samples").select("uid", F.to_json("assets").alias("same"), "assets").dropDuplicates(["uid", "same"]).select("uid", F.explode("assets").alias("asset", "a"))
    rows = rows.where("a.num_frames >= 0 and a.sample_rate > 0").select("uid", "asset", (F.col("a.num_frames") % 4000).cast("int").alias("frames"), F.col("a.sample_rate").alias("rate"))
    sound = F.when(F.col("frames") % 5 == 0, F.lit("no sound").cast("binary")).otherwise(audio.silence(F.col("frames"), F.col("rate")))
    timed = rows.withColumn("seconds", audio.audio_seconds(sound))
    return timed.groupBy("uid", "asset", "frames").agg(F.round(F.max("seconds"), 9).alias("seconds"), F.count(F.lit(1)).alias("n"))
