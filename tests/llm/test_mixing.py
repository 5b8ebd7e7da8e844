import random

import pytest

from voxloom.llm import mixing

SOURCES = "name string, weight double, ratio double, size int, uid string"


def items(spark, rows):
    return spark.createDataFrame(rows, "uid string, source_name string, size bigint, weight double")


def drawn(spark, rows, sources, total, **how):
    frame = spark.createDataFrame([(*s, 1, "x") for s in sources], SOURCES)
    uses, shares = mixing.draw(items(spark, rows), frame, total, **how)
    return uses.collect(), {r["source_name"]: r for r in shares.collect()}


def test_shares_caps_and_repeats(spark):
    rng = random.Random(4)
    rows = [(f"a{i}", "a", rng.randint(1, 80), 1.0) for i in range(2000)] + [(f"b{i}", "b", rng.randint(1, 80), 1.0) for i in range(100)] + [(f"c{i}", "c", 50, 1.0) for i in range(10)] + [("z", "other", 5, 1.0), ("n", None, 5, 1.0)]
    uses, shares = drawn(spark, rows, [("A ", 0.5, 1.0), ("b", 0.3, 9.0), ("c", 0.2, 2.0), ("empty", 5.0, 1.0), (None, 1.0, 1.0)], 40_000.0)
    assert len(uses) == len(rows)
    most = {"a": 1, "b": 9, "c": 2, "other": 0, None: 0}
    assert all(0 <= r["uses"] <= most[r["source_name"]] for r in uses)
    assert abs(shares["a"]["actual_size"] - 20_000) <= 2 and abs(shares["b"]["actual_size"] - 12_000) <= 12
    assert shares["c"]["actual_size"] == 1000 and shares["c"]["target_size"] == 8000
    assert shares["empty"]["target_share"] == 0 and abs(sum(s["actual_share"] for s in shares.values()) - 1) < 1e-9
    # certain whole copies: every sample of b is used at least floor(target / size) times
    floor = int(shares["b"]["target_size"] // shares["b"]["available_size"])
    assert min(r["uses"] for r in uses if r["source_name"] == "b") == floor


def test_inclusion_frequencies_over_200_draws(spark):
    """200 sources of the same sizes are 200 independent draws; chances follow c * size, and sizes beyond the border are certain."""
    rng = random.Random(11)
    sizes = [int(rng.lognormvariate(3, 0.8)) + 1 for _ in range(300)] + [900, 700, 20_000]
    rows = [(f"r{k}:{i}", f"r{k}", s, 1.0) for k in range(200) for i, s in enumerate(sizes)]
    total = 0.35 * sum(sizes) + 0.6 * 20_000
    uses, shares = drawn(spark, rows, [(f"r{k}", 1.0, 1.0) for k in range(200)], 200.0 * total)
    seen = [0] * len(sizes)
    for r in uses:
        seen[int(r["uid"].split(":")[1])] += r["uses"]
    certain = {i for i, s in enumerate(sizes) if s == 20_000}
    rest, c = total, 0.0
    while True:
        c = (rest := total - sum(sizes[i] for i in certain)) / sum(s * s for i, s in enumerate(sizes) if i not in certain)
        more = {i for i, s in enumerate(sizes) if i not in certain and c * s >= 1}
        if not more:
            break
        certain |= more
    assert rest > 0 and all(seen[i] == 200 for i in certain)
    others = sorted((i for i in range(len(sizes)) if i not in certain), key=lambda i: sizes[i])
    for start in range(0, len(others), 30):
        some = others[start : start + 30]
        want, got = sum(c * sizes[i] for i in some) / len(some), sum(seen[i] for i in some) / 200 / len(some)
        assert abs(got - want) < 4 * (want * (1 - want) / (200 * len(some))) ** 0.5 + 0.01, (start, want, got)
    assert max(abs(s["actual_size"] - total) for s in shares.values()) <= max(sizes[i] for i in others) / 2


def test_plan_of_a_draw(spark):
    """No join by uid but the closing sample's, no exchange in the last pass."""
    rows = [(f"u{i}", "ab"[i % 2], 1 + i % 9, 1.0) for i in range(500)]
    frame = spark.createDataFrame([("a", 1.0, 1.0, 1, "x"), ("b", 2.0, 2.0, 1, "x")], SOURCES)
    uses, _ = mixing.draw(items(spark, rows), frame)
    plan = uses._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 3 and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_a_third_in_one_source_is_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    rows = [(f"u{i}", "hot" if i % 3 else "b", 1 + i % 7, 1.0) for i in range(3000)]
    _, shares = drawn(spark, rows, [("hot", 3.0, 1.0), ("b", 1.0, 1.0)], 4000.0)
    assert abs(shares["hot"]["actual_size"] - 3000) <= 1 and abs(shares["b"]["actual_size"] - 1000) <= 1


def test_edges(spark):
    uses, shares = drawn(spark, [], [("a", 1.0, 1.0)], 100.0)
    assert uses == [] and shares["a"]["actual_size"] == 0 and shares["a"]["actual_share"] == 0
    uses, shares = drawn(spark, [("u", "a", 0, 1.0), ("v", "a", 7, 1.0)], [("a", float("nan"), None)], 100.0)
    assert {r["uses"] for r in uses} == {0}
    uses, shares = drawn(spark, [("u", "a", 10, 1.0)], [("a", 1.0, 0.5)], 100.0)
    assert shares["a"]["actual_size"] <= 10


def test_names_and_deliveries(spark):
    import datetime as dt

    lengths = "struct<user_text_tokens:int,assistant_text_tokens:int,user_audio_tokens:int,assistant_audio_tokens:int,codec_tokens:int>"
    day = lambda d: dt.datetime(2031, 1, d)
    rows = [("s:x:1:tts", "S ", day(1), (1, 1, 1, 1, 1)), ("s:x:1:tts", None, day(2), (2, 2, 2, 2, 2)), ("s:x:2:tts", None, day(1), (1, 1, 1, 1, 1)), ("s:x:3:tts", "s", day(1), (1, None, 1, 1, 1)), (None, "s", day(1), (1, 1, 1, 1, 1))]
    made = mixing.mixture_samples(spark.createDataFrame(rows, f"uid string, source_name string, ingested_at timestamp_ntz, lengths {lengths}")).collect()
    assert sorted((r["uid"], r["source_name"], r["size"]) for r in made) == [("s:x:1:tts", "s", 10), ("s:x:2:tts", "s", 5)]


def test_the_whole_size_is_registered(spark, small):
    from voxloom.llm import queries

    registered = queries.queries()
    targets = registered["p4_full_targets"](spark, small).collect()
    short = {r["source_name"] for r in targets if r["capped"]}
    assert short and all(r["met"] for r in targets if not r["capped"]) and all(r["actual_size"] == r["max_uses"] * r["available_size"] for r in targets if r["capped"])
    most = {r["source_name"]: r["max_uses"] for r in targets}
    uses = registered["p4_full_uses"](spark, small).collect()
    assert all(r["uses"] == most[r["source_name"]] for r in uses if r["source_name"] in short and r["size"] > 0)
    assert all(r["uses"] <= most.get(r["source_name"], 0) for r in uses) and max(r["uses"] for r in uses) > 1


@pytest.mark.parametrize("name", ["p4_uses", "p4_shares", "p4_targets", "p4_full_uses", "p4_full_targets", "p1_totals", "p2_found", "p2_groups"])
def test_draw_agrees_with_sql(spark, small, name):
    import os

    import duckdb

    from voxloom.llm import queries

    connection = duckdb.connect()
    for file in os.listdir(small):
        connection.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{small}/{file}')")
    wanted = connection.execute(queries.oracle_sql()[name]).df()
    made = queries.queries()[name](spark, small).toPandas()
    assert sorted(made.columns) == sorted(wanted.columns) and len(made) == len(wanted) > 0
    columns = sorted(made.columns)
    plain = lambda frame: sorted(repr([round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False, name=None))
    assert plain(made) == plain(wanted)
