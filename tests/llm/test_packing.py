import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import packing

LENGTHS = "struct<user_text_tokens:int,assistant_text_tokens:int,user_audio_tokens:int,assistant_audio_tokens:int,codec_tokens:int>"
SAMPLES = f"uid string, ingested_at timestamp_ntz, lengths {LENGTHS}, size int, rank string, profile string"


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 200), st.dictionaries(st.integers(1, 200), st.integers(1, 60), max_size=25))
def test_plan(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    plan = packing.make_plan(counts, capacity)
    load = np.zeros(plan.batches, np.int64)
    for size, number in counts.items():
        where = plan.place(np.full(number, size, np.int64), np.arange(number))
        np.add.at(load, where, size)
    assert (load <= capacity).all() and (load > 0).all()
    total = sum(s * n for s, n in counts.items())
    big = sum(n for s, n in counts.items() if 2 * s > capacity)
    # first-fit decreasing bound
    assert plan.batches <= 11 / 9 * max(big, -(-total // capacity)) * 1.25 + 1


def lengths_of(seed, number=30_000):
    rng = np.random.default_rng(seed)
    sizes, n = np.unique(np.clip(rng.lognormal(5.5, 1.0, number).astype(np.int64), 1, None), return_counts=True)
    return dict(zip(sizes.tolist(), n.tolist()))


def loads(plan, counts):
    load, cost = np.zeros(plan.batches, np.int64), np.zeros(plan.batches)
    for size, number in counts.items():
        where = plan.place(np.full(number, size, np.int64), np.arange(number))
        np.add.at(load, where, size)
        np.add.at(cost, where, float(size) ** 2)
    return load, cost


def test_tiers_shape_the_plan_and_fill_it():
    counts = {s: n for s, n in lengths_of(1).items() if s <= 2000}
    total = sum(s * n for s, n in counts.items())
    plans = [packing.make_plan(counts, 2000, tiers=tiers) for tiers in (packing.TIERS, (0.5, 0.25), ())]
    runs = [tuple(map(tuple, (p.piece, p.first, p.each))) for p in plans]
    assert len(set(runs)) == 3
    load, _ = loads(plans[0], counts)
    assert load.max() <= 2000 and total / (plans[0].batches * 2000) >= 0.999
    # every tier has windows of its own context size, several of which make a batch
    assert len(plans[0].window) > 100 and (plans[0].per > 1).any()
    # and gaps of longer tiers are filled directly
    assert plans[0].direct.any() and not plans[0].direct.all()


def test_steps_cost_alike():
    counts = {s: n for s, n in lengths_of(2).items() if s <= 2000}
    plan = packing.make_plan(counts, 2000)
    plan.deal(0, 2000 * 2000, 8)
    _, cost = loads(plan, counts)
    steps = plan.step(np.arange(plan.batches))
    assert set(np.bincount(steps)) <= {7, 8}
    full = np.bincount(steps)[steps] == 8
    of_step = np.bincount(steps[full], cost[full])
    of_step = of_step[of_step > 0]
    assert of_step.max() / of_step.mean() < 1.03 < 2 < cost.max() / cost.mean()


def test_lengths_beyond_two_to_the_23():
    rng = np.random.default_rng(3)
    sizes, n = np.unique(rng.integers(1, 10_000_000, 5000), return_counts=True)
    counts = dict(zip(sizes.tolist(), n.tolist()))
    load, _ = loads(plan := packing.make_plan(counts, 10_000_000), counts)
    assert load.max() <= 10_000_000 and load.sum() == sum(s * k for s, k in counts.items()) and plan.batches <= 1.02 * load.sum() / 10_000_000


def frame(spark, rows):
    import datetime as dt

    made = [(uid, at and dt.datetime(2031, 1, at), None if sizes is None else (1, 1, *sizes), 3, "r", "p") for uid, at, sizes in rows]
    return spark.createDataFrame(made, SAMPLES)


def limits(spark, caps):
    return spark.createDataFrame(caps, "profile string, max_cost double, uid string")


def test_batches(spark):
    rng = random.Random(2)
    rows = [(f"u{i}", 1, (rng.choice([0, 5, 333]), rng.randint(0, 60), rng.choice([0, 0, 0, 900]))) for i in range(900)]
    rows += [("late", 1, (10, 0, 0)), ("late", 3, (20, 0, 0)), ("late", 2, (30, 0, 0)), ("late", 4, None), ("bad", 1, (-1, 0, 0)), ("bad2", 1, (None, 1, 1)), (None, 1, (1, 1, 1)), ("zero", None, (0, 0, 0)), ("huge", 1, (100_000, 0, 0))]
    made = packing.pack_samples(frame(spark, rows), limits(spark, [("a", 400.0, "x"), ("b", 1000.5, "x"), ("none", None, "x"), ("nan", float("nan"), "x")])).collect()
    size = {u: sum(s) for u, _, s in rows[:900]} | {"late": 20, "zero": 0, "huge": 100_000}
    for profile, cap in (("a", 400), ("b", 1000)):
        mine = [r for r in made if r["profile"] == profile]
        held, load, step = defaultdict(list), defaultdict(int), defaultdict(set)
        for r in mine:
            held[r["uid"]].append((r["piece_no"], r["piece_start"], r["piece_size"]))
            load[r["batch_id"]] += r["piece_size"]
            step[r["step_no"]].add(r["batch_id"])
        assert set(held) == set(size) and max(load.values()) <= cap
        for uid, pieces in held.items():
            pieces.sort()
            assert sum(p[2] for p in pieces) == size[uid]
            assert [p[1] for p in pieces] == [p[0] * cap for p in pieces]
            assert len(pieces) == 1 if size[uid] <= cap else all(p[2] == cap for p in pieces[:-1])
        total = sum(size.values())
        assert len([b for b in load if load[b]]) <= 1.03 * -(-total // cap) + 3
        assert max(map(len, step.values())) - min(map(len, step.values())) <= 1
    assert {r["profile"] for r in made} == {"a", "b"}


def test_nothing_to_pack(spark):
    empty = frame(spark, [("u", 1, (1, 1, 1))]).limit(0)
    assert packing.pack_samples(empty, limits(spark, [("a", 5.0, "x")])).count() == 0
    assert packing.pack_samples(frame(spark, [("u", 1, (1, 1, 1))]), limits(spark, [("a", None, "x")])).count() == 0
    only_zero = packing.pack_samples(frame(spark, [("u", 1, (0, 0, 0)), ("v", 1, (0, 0, 0))]), limits(spark, [("a", 5.0, "x")])).collect()
    assert [r["batch_id"] for r in only_zero] == [0, 0]
