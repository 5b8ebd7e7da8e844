import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from voxloom.operators import layouts
from voxloom.plans.config import BatchLimits, SourceConfig, StreamConfig
from voxloom.sources import audio, files, manifest, tar
from voxloom.streaming import pipeline


def shard(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def test_tar_source(spark, tmp_path):
    wav = audio.wav_bytes(b"\0\0" * 16000, 16000)
    good = shard(tmp_path / "a.tar", [("d/01.audio.wav", wav), ("d/01.asr.json", b"{}"), ("d/02.json", b"{}"), ("d/02.json", b"again"), ("d/01.tts.json", b"{}")])
    bad = tmp_path / "b.tar"
    bad.write_bytes(b"this is no tar")
    rows = tar.read_shards(spark, [good, str(bad)], source="s").orderBy("url", "place").collect()
    assert [(r["key"], sorted(r["members"])) for r in rows[:3]] == [("d/01", ["asr.json", "audio.wav"]), ("d/02", ["json"]), ("d/01", ["tts.json"])]
    assert rows[1]["duplicates"] == ["json"] and rows[3]["error"]
    light = tar.read_shards(spark, [good], include_audio=False).orderBy("place").first()
    assert sorted(light["members"]) == ["asr.json"] and light["sizes"]["audio.wav"] == len(wav)
    frame = tar.read_shards(spark, [good])
    assert [r["key"] for r in layouts.broken_runs(frame.withColumn("place", F.col("place")), "url", "place", "key").collect()] in ([], ["d/01"])
    seconds = frame.select(audio.audio_seconds(F.try_element_at("members", F.lit("audio.wav"))).alias("s")).where("s is not null").first()["s"]
    assert seconds == 1.0


def test_truncated_shard_gives_no_sound_half_sample(spark, tmp_path):
    whole = shard(tmp_path / "w.tar", [("a.json", b"{}"), ("a.audio.wav", b"1" * 700), ("b.json", b"{}"), ("b.audio.wav", b"2" * 5000), ("c.json", b"{}")])
    cut = tmp_path / "cut.tar"
    cut.write_bytes(open(whole, "rb").read()[: 512 * 8])  # ends inside b.audio.wav
    rows = tar.read_shards(spark, [str(cut)]).orderBy("place").collect()
    assert [(r["key"], r["error"] is None) for r in rows] == [("a", True), ("b", False)]
    assert sorted(rows[0]["members"]) == ["audio.wav", "json"] and sorted(rows[1]["members"]) == ["json"]
    assert tar.read_shards(spark, [f"file://{whole}"]).count() == 3
    missing = tar.read_shards(spark, [str(tmp_path / "none.tar")]).collect()
    assert len(missing) == 1 and missing[0]["key"] is None and missing[0]["error"]


def test_manifest(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"shards": ["a.tar", {"url": "b", "path": "/x/b.tar"}, {"url": "c", "disabled": True}]}))
    made = manifest.load_manifest(str(tmp_path / "m.json"))
    assert [m["url"] for m in made] == ["a.tar", "b"] and made[0]["path"].endswith("/a.tar") and made[1]["path"] == "/x/b.tar"
    (tmp_path / "m.txt").write_text("a.tar # one\n\n# two\n")
    assert len(manifest.load_manifest(str(tmp_path / "m.txt"))) == 1
    for content in ("# nothing\n", "a\na\n"):
        (tmp_path / "m.txt").write_text(content)
        with pytest.raises(ValueError):
            manifest.load_manifest(str(tmp_path / "m.txt"))


def test_braces():
    assert manifest.expand_braces("x-{08..10}-{a,b}.tar") == ["x-08-a.tar", "x-08-b.tar", "x-09-a.tar", "x-09-b.tar", "x-10-a.tar", "x-10-b.tar"]
    assert manifest.expand_braces("plain") == ["plain"]


def test_jsonl_and_requests(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"messages": [{"role": "user", "content": "a"}], "audios": []}\nnot json\n')
    rows = files.read_chat_jsonl(spark, str(path)).collect()
    assert rows[0]["messages"][0]["content"] == "a" and rows[1]["_corrupt_record"] == "not json"
    path.write_text('{"task": "tts"}\n\n{"index": true}\n{"index": 0}\n')
    made = files.read_requests(spark, str(path), strict=False).orderBy("line_no").collect()
    assert [(r["line_no"], r["index"], r["error"]) for r in made] == [(0, 0, None), (2, None, "index_not_integer"), (3, 0, "duplicate_index")]
    with pytest.raises(ValueError):
        files.read_requests(spark, str(path))


def test_tsv(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("ID\tAUDIO\tDURATION\tTEXT\na\tx.wav\t1.5\tone\ttwo\nb\ty.wav\n")
    rows = files.read_tsv(spark, str(path)).orderBy("id").collect()
    assert rows[1]["transcript"] == "one\ttwo" and rows[0]["error"] == "columns"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x")], "index int, error string")
    assert files.write_results(rows, str(tmp_path / "out")) == {"traces": 1, "errors": 1}
    with pytest.raises(RuntimeError):
        files.write_results(rows, str(tmp_path / "out2"), fail_fast=True)
    side = files.sidecar_path(str(tmp_path / "a.jsonl"))
    assert files.prefer_sidecar(str(tmp_path / "a.jsonl"), 5) != side
    open(side, "w").close()
    assert files.prefer_sidecar(str(tmp_path / "a.jsonl"), 5) == side and files.prefer_sidecar(str(tmp_path / "a.jsonl"), None) != side
    assert files.load_any(spark, str(tmp_path / "missing.jsonl")) is None


def test_cursor_refuses_other_configuration(tmp_path):
    one = StreamConfig((SourceConfig("a"),), BatchLimits(max_samples=1))
    assert pipeline.Cursor(str(tmp_path), one).open() == pipeline.Cursor(str(tmp_path), one).open()
    with pytest.raises(ValueError):
        pipeline.Cursor(str(tmp_path), StreamConfig((SourceConfig("a"),), BatchLimits(max_samples=1), seed=5)).open()


def test_stream_split(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    rows = pipeline.read_stream(spark, str(tmp_path / "in"), "*.parquet", "id bigint")
    pipeline.split_stream(rows, F.when(F.col("id") > 6, "big"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 7 and spark.read.parquet(str(tmp_path / "bad")).count() == 3


def test_wav():
    assert audio.wav_seconds(audio.wav_bytes(b"\0\0" * 800, 8000)) == 0.1
    assert audio.wav_seconds(b"x") is None and audio.wav_seconds(None) is None


def test_config_file_and_quotas(tmp_path, monkeypatch):
    from voxloom.plans.config import load_config

    monkeypatch.setenv("VOX_ROOT", "/data")
    (tmp_path / "c.json").write_text('{"root": "$VOX_ROOT/x", "n": 3}')
    assert load_config(str(tmp_path / "c.json")) == {"root": "/data/x", "n": 3}
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "c.json"))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"root": "${VOX_ROOT}"}))
    assert load_config(str(tmp_path / "c.yaml")) == {"root": "/data"}
    config = StreamConfig((SourceConfig("a"),), BatchLimits(max_samples=1), mode="resampled", fixed_batches=5, world_size=2)
    config.check_quotas([3, 2])
    with pytest.raises(RuntimeError):
        config.check_quotas([3, 1])


def test_an_idle_key_emits_its_open_batch(spark, tmp_path):
    import time

    spark.createDataFrame([("a", f"u{i}", 10) for i in range(5)], "k string, uid string, cost bigint").write.parquet(str(tmp_path / "in"))
    rows = pipeline.read_stream(spark, str(tmp_path / "in"), "*.parquet", "k string, uid string, cost bigint")
    made = pipeline.live_batches(rows, "k", "uid", ["cost"], BatchLimits(max_samples=3), idle_ms=500)
    running = made.writeStream.format("memory").queryName("idle_batches").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 40
        while time.time() < until and spark.table("idle_batches").count() < 5:
            time.sleep(0.3)
    finally:
        running.stop()
    assert sorted((r["batch"], r["uid"]) for r in spark.table("idle_batches").collect()) == [(0, "u0"), (0, "u1"), (0, "u2"), (1, "u3"), (1, "u4")]
