import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.operators import batching, evaluate, filters, inference, layouts, metrics, ranking, sampling, segments, setops
from voxloom.plans.config import BatchLimits, SourceConfig, StreamConfig


def test_positions_are_dense_and_ordered(spark):
    rows = spark.createDataFrame([(i * 7 % 101, "g" if i % 3 else None) for i in range(101)], "k int, g string")
    made = ranking.with_position(rows, "k").collect()
    assert sorted((r["position"], r["k"]) for r in made) == [(i, i) for i in range(101)]
    grouped = ranking.with_group_position(rows, ["g"], "k").collect()
    for g in ("g", None):
        keys = [r["k"] for r in sorted((r for r in grouped if r["g"] == g), key=lambda r: r["position"])]
        assert keys == sorted(keys) and sorted(r["position"] for r in grouped if r["g"] == g) == list(range(len(keys)))
    assert ranking.with_position(rows.limit(0), "k").count() == 0


LIMITS = st.builds(BatchLimits, max_cost=st.integers(10, 60).map(float), max_samples=st.integers(1, 6), oversized_sample=st.sampled_from(["drop", "single"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40), LIMITS)
def test_greedy_fold_keeps_limits(costs, limits):
    places = batching.fold_greedy(costs, limits)
    assert len(places) == len(costs)
    batches = {}
    for place, cost in zip(places, costs):
        if place is None:
            assert limits.oversized_sample == "drop" and sum(cost) > limits.max_cost
        else:
            batches.setdefault(place, []).append(cost)
    for held in batches.values():
        padded = len(held) * sum(max(c[i] for c in held) for i in range(2))
        assert len(held) <= limits.max_samples and (padded <= limits.max_cost or len(held) == 1)
    kept = [p for p in places if p is not None]
    assert kept == sorted(kept)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(20, 100), st.integers(1, 12))
def test_budget_fold(tokens, budget, rows):
    places = batching.fold_budget(tokens, budget, rows)
    batches = {}
    for p, t in zip(places, tokens):
        batches.setdefault(p, []).append(t)
    for held in list(batches.values())[:-1]:
        assert len(held) >= max(1, rows // 5)
    for held in batches.values():
        assert sum(held) <= budget or len(held) <= max(1, rows // 5)


def test_pools_are_bounded_under_skew(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    sizes = batching.with_pool(rows, "g", "id", 200).groupBy("g", "pool").count().collect()
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) < 320


def test_ratio_and_repeats(spark):
    rows = spark.createDataFrame([(i, "a" if i < 4 else None) for i in range(6)], "i int, g string")
    made = sampling.ratio_rows(rows, ["g"], "i", F.lit(1.5)).collect()
    assert sorted((r["i"], r["copy"]) for r in made) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (4, 1), (5, 0)]
    assert sampling.ratio_rows(rows.limit(0), ["g"], "i", F.lit(1.5)).count() == 0


def test_shard_ratio_keeps_one(spark):
    shards = spark.createDataFrame([("s", f"u{i}", i) for i in range(10)] + [("s", "u0", 3)], "src string, url string, position int")
    assert sampling.shard_ratio(shards, ["src"], "url", "position", F.lit(0.01), 1).count() == 1
    assert sampling.shard_ratio(shards, ["src"], "url", "position", F.lit(2.5), 1).count() == 25
    assert sampling.shard_ratio(shards, ["src"], "url", "position", F.lit(1.0), 1).count() == 10


def test_round_robin_padding(spark):
    rows = spark.createDataFrame([(f"u{i}",) for i in range(5)], "u string")
    made = sampling.round_robin(rows, "u", 3, padded=True).groupBy("consumer").count().collect()
    assert [r["count"] for r in made] == [2, 2, 2]
    few = sampling.round_robin(rows.where("u = 'u0'"), "u", 4, padded=True)
    assert few.count() == 4 and few.select("slot").distinct().count() == 1


def test_source_mix_shares(spark):
    made = spark.range(20_000).select(sampling.source_by_weight(ranking.seeded(F.col("id"), 4), {"a": 1, "b": 3}).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 20_000 for r in made}
    assert abs(share["a"] - 0.25) < 0.02
    with pytest.raises(ValueError):
        sampling.source_by_weight(F.lit(0.1), {"a": 0})


def test_eviction(spark):
    files = spark.createDataFrame([(f"f{i}", i, 10) for i in range(6)], "k string, t int, size int")
    assert sorted(r["k"] for r in sampling.evict_oldest(files, "size", "t", "k", 35).collect()) == ["f0", "f1", "f2"]


def frames(spark, vectors):
    return spark.createDataFrame([(0, t, v) for t, v in enumerate(vectors)], "seq_id int, t int, vec array<float>")


def test_segments(spark):
    rows = segments.adjacent_similarity(frames(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 2.0]]))
    assert [r["sim"] for r in rows.orderBy("t").collect()] == [None, 1.0, 0.0, 0.0, 0.0]
    assert [r["segment"] for r in segments.threshold_segments(rows, 0.5).orderBy("t").collect()] == [0, 0, 1, 2, 3]
    # three segments wanted: ties in similarity fall to the earlier frames
    assert [r["segment"] for r in segments.topk_segments(rows, 7.5, 12.5).orderBy("t").collect()] == [0, 0, 1, 2, 2]
    assert [r["segment"] for r in segments.uniform_segments(rows, 5.0, 12.5).orderBy("t").collect()] == [0, 0, 0, 1, 1]
    assert [r["segment"] for r in segments.topk_segments(rows, 1.0, 12.5, max_run=2).orderBy("t").collect()] == [0, 0, 1, 1, 2]
    single = segments.segment_frames(frames(spark, [[1.0]]), 6.25, 12.5)
    assert [r["segment"] for r in single.collect()] == [0]
    assert segments.achieved_rate(rows.withColumn("segment", F.lit(0)).limit(0), 12.5).first()["rate"] == 12.5


def test_pooling_is_a_mean(spark):
    rows = frames(spark, [[1.0, 3.0], [3.0, 5.0], [7.0, 7.0]]).withColumn("segment", F.when(F.col("t") < 2, 0).otherwise(1))
    assert [r["vec"] for r in segments.pooled_vectors(rows).orderBy("segment").collect()] == [[2.0, 4.0], [7.0, 7.0]]


def test_streams(spark):
    row = spark.createDataFrame([([1, 2, 3, 9, 4],)], "a array<int>").select(
        segments.splice_before(F.col("a"), F.array(F.lit(0)), F.lit(9)).alias("s"),
        segments.splice_before(F.col("a"), F.array(F.lit(0)), F.lit(8)).alias("none"),
        segments.interleave(F.col("a"), F.array(F.lit(5), F.lit(6))).alias("i"),
        segments.align_streams(F.col("a"), F.array(F.lit(7)), 2, F.lit(-1), F.lit(-2), F.lit(0)).alias("al"),
    ).first()
    assert row["s"] == [1, 2, 3, 0, 9, 4] and row["none"] is None and row["i"] == [1, 5, 2, 6]
    assert row["al"]["speech"] == [-1, -1, 7, -2, 0] and row["al"]["padded"] == 1


def test_layouts(spark):
    rows = [
        ({"json": b"", "question.WAV": b"", "response.mp3": b""}, "s2s_pair", None),
        ({"asr.json": b"", "audio.wav": b""}, "shared_audio_tasks", None),
        ({"json": b"", "question.wav": b"", "response.wav": b"", "audio.wav": b"", "tts.json": b""}, None, "AmbiguousLayout"),
        ({"json": b"", "question.wav": b"", "question.mp3": b"", "response.wav": b""}, None, "UnknownLayout"),
        ({}, None, "UnknownLayout"),
    ]
    frame = spark.createDataFrame(rows, "m map<string,binary>, layout string, error string")
    made = frame.select("layout", "error", layouts.resolve_layout(F.col("m")).alias("r")).collect()
    assert all((r["layout"], r["error"]) == (r["r"]["layout"], r["r"]["error"]) for r in made)
    pick = frame.select(layouts.single_audio(F.col("m"), "question").alias("a"), layouts.single_audio(F.col("m"), "question", ("mp3", "wav")).alias("b")).collect()
    assert pick[3]["a"]["error"] == "DuplicateMember" and pick[3]["b"]["member"] == "question.mp3" and pick[4]["a"]["error"] == "MissingMember"


def test_member_matching(spark):
    frame = spark.createDataFrame([(["a/02.audio.mp3", "b.wav"], [5, 6], "audio.mp3"), (["x.audio.mp3", "y.audio.mp3"], [1, 2], "audio.mp3"), (None, [9], "audio.mp3")], "n array<string>, v array<bigint>, m string")
    made = [r[0] for r in frame.select(layouts.match_member(F.col("n"), F.col("v"), F.col("m"))).collect()]
    assert made == [5, None, None]
    tokens = [r[0] for r in frame.select(layouts.resolve_tokens(F.col("n"), F.col("v"), F.col("m"), F.lit(0), F.lit(2.0))).collect()]
    assert tokens == [5, 34, 9]


def test_quarantine_loses_nothing(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "y" * 9000)], "i int, e string")
    kept, bad = filters.split_quarantine(rows, F.col("e"), "stage")
    assert kept.count() + bad.count() == 3
    assert bad.agg(F.max(F.length("error"))).first()[0] == 4096


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "size bigint, padded bigint, unpadded bigint")
    row = metrics.stream_metrics(empty).first()
    assert row["batches"] == 0 and row["padding_ratio"] == 0.0 and row["mean_size"] == 0.0
    rows = spark.createDataFrame([("a", float("nan"), 2), ("a", 3.0, 0)], "g string, v double, w int")
    assert metrics.weighted_mean(rows, "v", "w", ["g"]).first()["mean"] is None


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    assert {r["k"]: r["v"] for r in metrics.upsert(old, new, "k").collect()} == {"a": 1, "b": None, "c": 3}
    assert {r["k"]: r["kind"] for r in metrics.key_diff(old, new, "k", "v").collect()} == {"a": "missing", "b": "mismatch", "c": "unexpected"}


def test_union_types(spark):
    a = spark.sql("select 1L id, cast(null as void) audios, cast(null as void) other")
    b = spark.sql("select 2L id, array('x') audios, 5 extra")
    made = setops.aligned_union([a, b])
    assert dict(made.dtypes) == {"id": "bigint", "audios": "array<string>", "other": "string", "extra": "int"}
    with pytest.raises(ValueError):
        setops.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_engine_errors_are_rows(spark):
    def load():
        def engine(request):
            if request["text"] is None:
                raise KeyError("text")
            return {"text": request["text"].upper()}

        return engine

    rows = spark.createDataFrame([(1, "tts", "a", None), (2, "tts", None, None)], "index bigint, task string, text string, audio_path string")
    made = {r["index"]: r for r in inference.run_engine(rows, load).collect()}
    assert made[1]["output_text"] == "A" and made[2]["error"].startswith("KeyError")


def test_judge_retries(spark):
    def judge(rows):
        return rows.withColumn("judge_result", F.when(F.col("index") % 2 == 0, "4"))

    rows = spark.range(4).withColumnRenamed("id", "index")
    made = {r["index"]: (r["judge_result"], r["score"]) for r in inference.judge_with_retries(rows, judge).collect()}
    assert made == {0: ("4", 4.0), 1: (None, None), 2: ("4", 4.0), 3: (None, None)}


def test_a_slow_request_gives_an_error_in_its_place():
    import time

    def engine(request):
        time.sleep(request["wait"])
        return {"text": request["name"]}

    made = inference.timed(engine, 0.3, at_once=3)([{"wait": 0.0, "name": "a"}, {"wait": 1.0, "name": "b"}, {"wait": 0.05, "name": "c"}])
    assert [m.get("text") for m in made] == ["a", None, "c"] and made[1]["error"].startswith("TimeoutError")


def test_word_edits():
    import random as rnd

    from voxloom.functions.text import word_edits

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = rnd.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        assert word_edits(" ".join(a), " ".join(b)) == plain(a, b)


def test_wer(spark):
    rows = spark.createDataFrame([("g", "a b c", "a x c"), ("g", "d", None), ("h", "", "z")], "g string, r string, h string")
    made = {r["g"]: (r["edits"], r["words"], r["wer"]) for r in evaluate.word_error_rate(rows, ["g"], "r", "h").collect()}
    assert made == {"g": (2, 4, 0.5), "h": (1, 0, None)}


def test_config_checks():
    for bad in (dict(), dict(max_cost=-1.0), dict(max_cost=float("nan")), dict(max_samples=2, min_samples=3), dict(max_samples=1, oversized_sample="x")):
        with pytest.raises(ValueError):
            BatchLimits(**bad)
    source = SourceConfig("a", weight=1.0)
    with pytest.raises(ValueError):
        StreamConfig((source,), BatchLimits(max_samples=1))
    config = StreamConfig((source,), BatchLimits(max_samples=1), mode="resampled", fixed_batches=7, world_size=2, workers=2)
    assert config.quotas() == [2, 2, 2, 1] and config.for_validation().mode == "finite_padded"
    assert config.signature() != config.for_validation().signature()


def test_seeded_choice_does_not_depend_on_partitions(spark):
    rows = spark.range(50)
    a = [r[0] for r in sampling.seeded_order(rows.repartition(7), "id", 3).orderBy("position").collect()]
    b = [r[0] for r in sampling.seeded_order(rows.coalesce(1), "id", 3).orderBy("position").collect()]
    assert a == b and a != sorted(a)
    random.shuffle(a)


def test_refill_keeps_batches_full_while_the_cost_allows():
    limits = BatchLimits(max_cost=100, max_samples=3)
    assert batching.fold_refill([(10,)] * 7, [True] * 7, limits) == [0, 0, 0, 1, 1, 1, 2]
    # the second row fails: the fourth takes its place, and the next batch begins with the fifth
    assert batching.fold_refill([(10,)] * 7, [True, False, *[True] * 5], limits) == [0, None, 0, 0, 1, 1, 1]
    # a replacement that would cost too much waits for the next batch
    assert batching.fold_refill([(10,), (10,), (10,), (60,), (10,)], [True, False, True, True, True], limits) == [0, None, 0, 1, 2]
    # replacements may fail too
    assert batching.fold_refill([(10,)] * 6, [False, True, True, False, True, True], limits) == [None, 0, 0, None, 0, 1]
    assert batching.fold_refill([], [], limits) == []
    with pytest.raises(RuntimeError):
        batching.fold_refill([(1,)] * 9, [False] * 9, limits, most_errors=5)


def test_audit_of_odd_shards(spark):
    from voxloom.operators import audit

    rows = [
        ("a", 0, "k1.json", 2, "{}"), ("a", 1, "k1.question.wav", 5, None), ("a", 2, "k1.response.wav", 0, None), ("a", 3, "k2.audio.mp3", 5, None), ("a", 4, "k2.asr.json", 3, "{x"),
        ("a", 5, "k1.json", 2, "{}"), ("a", 6, "noname", 1, None), ("b", 0, "k.audio.wav", 1, None), ("b", 1, "k.audio.wav", 1, None), ("c", 0, None, None, "ReadError: x"),
    ]
    made = audit.report(audit.audited(spark.createDataFrame(rows, "shard string, place bigint, name string, size bigint, text string")))
    assert made["summary"] == {"shards": 3, "members": 9, "member_bytes": 20, "physical_samples": 4, "logical_samples": 2, "errors": 7} and not made["ok"]
    assert made["error_types"] == {"DuplicateMember": 1, "EmptyMember": 1, "InvalidMemberName": 1, "MetadataDecode": 1, "MissingMember": 1, "NonContiguousKey": 1, "UnreadableShard": 1}
    assert made["layouts"] == {"s2s_pair": 2, "shared_audio_tasks": 1} and made["tasks"] == {"asr": 1, "s2s": 1} and made["audio_codecs"] == {"mp3": 1, "wav": 4}
    assert [(e["shard"], e["error"]) for e in made["error_examples"]][0] == ("a", "EmptyMember")


def test_pooled_segments_of_odd_vectors(spark):
    rows = [("a", 0, 0, [1.0, 2.0]), ("a", 1, 0, [3.0, None]), ("a", 2, 1, [5.0, 7.0]), (None, 0, 0, [1.0, 1.0]), ("b", 0, 0, None), ("c", 0, 0, [1.0]), ("c", 1, 0, [1.0, 4.0])]
    frames = spark.createDataFrame(rows, "seq_id string, t int, segment int, vec array<double>").repartition(3)
    made = {(r["seq_id"], r["segment"]): (r["sums"], r["frames"]) for r in segments.segment_sums(frames).collect()}
    assert made == {("a", 0): ([4.0, 2.0], 2), ("a", 1): ([5.0, 7.0], 1), (None, 0): ([1.0, 1.0], 1), ("c", 0): ([2.0, 4.0], 2)}
    assert {r["seq_id"]: r["vec"] for r in segments.pooled_vectors(frames.where("seq_id = 'c'")).collect()} == {"c": [1.0, 2.0]}
    assert segments.segment_sums(frames.limit(0)).count() == 0
