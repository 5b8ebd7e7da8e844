import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import neardup


def jaccard(a, b):
    p, q = ({t[i : i + 4] for i in range(len(t) - 3)} for t in (a, b))
    return len(p & q) / len(p | q)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(200)]
    out = []
    while len(out) < n:
        base = rng.choices(words, k=30)
        out.append("".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("".join(copy))
    return out[:n]


def members(spark, rows):
    frame = spark.createDataFrame(rows, "row_id bigint, said string, key string, norm string")
    return neardup.members_of(frame, "row_id", F.col("said"))


def pairs(spark, rows, **how):
    made = members(spark, rows)
    return {(r["row_id_a"], r["row_id_b"]) for r in neardup.similar_rows(made, neardup.links(made, **how)).collect()}


def brute(rows):
    held = [(i, "".join(c for c in t.lower() if c.isalnum())) for i, t, *_ in rows if t]
    held = [(i, t) for i, t in held if len(t) >= 40]
    return {(min(i, j), max(i, j)) for n, (i, t) in enumerate(held) for j, u in held[:n] if i != j and jaccard(t, u) >= 0.7}


@pytest.mark.parametrize("tile", [2048, 4])
def test_recall_against_brute_force(spark, tile):
    """tile=4 makes every node hot, so tiles meet in pairs."""
    rows = [(i, t, None, "x") for i, t in enumerate(texts(300, 3))]
    want = brute(rows)
    got = pairs(spark, rows, tile=tile)
    assert got <= want and len(got) >= 0.99 * len(want) > 50


def test_nodes_are_masked_bits_of_the_fingerprint():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (50, neardup.FIELDS), np.uint8)
    nodes = neardup.masked(prints)
    for mask in range(neardup.MASKS):
        kept = np.zeros(neardup.FIELDS, np.uint8)
        kept[mask * neardup.KEPT : (mask + 1) * neardup.KEPT] = 255
        shown = prints & kept
        assert [int.from_bytes(row.tobytes(), "big") for row in shown[:, kept > 0]] == (nodes[:, mask] & 0xFFFFFFFF).tolist()
    high, low = neardup.compared_bits(prints)
    for row, h, l in zip(prints, high.tolist(), low.tolist()):
        bits = [b & 1 for b in row] + [(b >> 1) & 1 for b in row[:32]]
        assert f"{h:064b}{l:064b}" == "".join(map(str, bits))


def test_recall_of_the_index_alone(spark):
    """Candidates of the masked, Gray-ordered index before the exact check."""
    rows = [(i, t, None, "x") for i, t in enumerate(texts(1200, 8))]
    made = members(spark, rows)
    prints = neardup.fingerprints_of(made.groupBy("key").agg(F.min("norm").alias("norm")), 4)
    key = {r["row_id"]: r["key"] for r in made.collect()}
    got = {(r["a"], r["b"]) for r in neardup.candidate_pairs(prints).collect()}
    held = {i: {t[j : j + 4] for j in range(len(t) - 3)} for i, t, *_ in rows}
    want = {tuple(sorted((key[i], key[j]))) for i in held for j in range(i) if key[i] != key[j] and len(held[i] & held[j]) >= 0.7 * len(held[i] | held[j])}
    assert len(want) > 300 and len(want & got) >= 0.99 * len(want)


def test_hot_node_is_found_and_spread(spark):
    """Two fifths of all texts share the bits of mask 5; the index names that node before the exchange and tiles its members."""
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 256, (6000, neardup.FIELDS), np.uint8)
    prints[:2400, 5 * neardup.KEPT : 6 * neardup.KEPT] = 9
    prints[1] = prints[0]
    frame = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "key bigint, print binary").repartition(5)
    hot = neardup.hot_nodes(frame)
    assert list(hot) == [(5 << 32) | 0x09090909] and 2400 <= hot[(5 << 32) | 0x09090909] <= 2400 + 6000 / 512 + 1
    bits = np.stack(neardup.compared_bits(prints), axis=1)
    nodes = neardup.masked(prints)
    near = {(i, int(j)) for i in range(6000) for j in i + 1 + np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1) <= neardup.RADIUS)}
    want = {(i, j) for i, j in near if (nodes[i] == nodes[j]).any()}
    assert (0, 1) in want and {(r["a"], r["b"]) for r in neardup.candidate_pairs(frame, tile=100).collect()} == want
    cold = neardup.sketches_of(frame, hot).select(F.explode("nodes").alias("node")).groupBy("node").count().agg(F.max("count")).first()[0]
    assert cold <= 2 * 6000 / 512


def test_many_copies_are_paired_in_tiles(spark):
    ids = spark.range(300).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("row_id"))
    got = neardup.equal_rows(ids, tile=16).collect()
    assert len(got) == 100 * 99 // 2 and {(r["x"], r["y"]) for r in got} == {(i, j) for j in range(100) for i in range(j)}


def test_edges(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(1, base), (2, base.upper() + "!!"), (3, base), (3, base), (4, None), (5, ""), (6, "short"), (7, base * 2000), (8, base.replace("fox", "cat")), (9, "ABC" * 13), (10, "abc" * 13)]
    rows = [(*r, None, None) for r in rows]
    assert pairs(spark, rows) == {p for p in brute(rows)} - {(3, 3)}
    assert pairs(spark, rows[:0]) == set()


def test_groups(spark):
    rows = [(i, t, None, None) for i, t in enumerate(texts(120, 5))] + [(900, texts(120, 5)[0], None, None)]
    made = members(spark, rows)
    linked = neardup.links(made)
    got = {r["row_id"]: r["group_id"] for r in neardup.groups(made, linked).collect()}
    root = {i: i for i in got}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs(spark, rows):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert got == {i: top(i) for i in got}


def test_long_chain_settles(spark):
    rng = random.Random(1)
    names = list(range(400))
    rng.shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a bigint, b bigint")
    made = neardup.components(edges).collect()
    assert len(made) == 400 and {r["root"] for r in made} == {0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 128) - 1), min_size=1, max_size=20))
def test_gray_order(values):
    high = np.array([v >> 64 for v in values], np.uint64)
    low = np.array([v & ((1 << 64) - 1) for v in values], np.uint64)
    a, b = neardup.gray_rank(high, low)
    x, y = neardup.from_rank(a, b)
    assert (x == high).all() and (y == low).all()
    for v, p, q in zip(values, a.tolist(), b.tolist()):
        rank = (p << 64) | q
        assert rank ^ (rank >> 1) == v


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 60))
def test_index_search_is_exact(seed, radius):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 90, 4)
    group = np.repeat(np.arange(4), sizes)
    n = len(group)
    prints = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    near = rng.integers(0, n, n)
    flip = rng.random(n) < 0.6
    prints[flip] = prints[near[flip]] ^ (np.uint64(1) << rng.integers(0, 63, (int(flip.sum()), 2), dtype=np.uint64))
    ranks = neardup.gray_rank(prints[:, 0].copy(), prints[:, 1].copy())
    order = np.lexsort((ranks[1], ranks[0], group))
    group, high, low = group[order], prints[order, 0], prints[order, 1]
    a, b = neardup.search(group, np.zeros(n, np.int64), high, low, radius)
    got = set(zip(a.tolist(), b.tolist()))
    bits = lambda i, j: bin(int(high[i] ^ high[j])).count("1") + bin(int(low[i] ^ low[j])).count("1")
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and bits(i, j) <= radius}
    assert got == want


def test_large_nodes_take_bounded_memory():
    """Three nodes of 2,048 members without near pairs, six million pairs to look at, and one whose members are all near."""
    rng = np.random.default_rng(6)
    group = np.repeat(np.arange(4), [2048, 2048, 2048, 200])
    prints = rng.integers(0, 1 << 63, (len(group), 2), dtype=np.uint64)
    prints[-200:] = prints[-1]
    ranks = neardup.gray_rank(prints[:, 0].copy(), prints[:, 1].copy())
    order = np.lexsort((ranks[1], ranks[0], group))
    high, low = prints[order, 0], prints[order, 1]
    tracemalloc.start()
    a, b = neardup.search(group, np.zeros(len(group), np.int64), high, low, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 200 * 199 // 2 and (a >= 3 * 2048).all() and peak < 16e6


def test_chance_neighbours_are_not_candidates(spark):
    """Fields of which only the upper compared bits agree leave a pair within the radius; the other bits tell it apart."""
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 256, (3, neardup.FIELDS), np.uint8)
    prints[1] = prints[0]
    prints[1, neardup.KEPT :] ^= 0b1100
    prints[2] = prints[0]
    prints[2, -20:] ^= 0b0100
    frame = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "key bigint, print binary")
    entries = neardup.entries_of(np.arange(3), prints)
    assert neardup.differing_fields(entries, np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [92, 20, 92]
    assert {(r["a"], r["b"]) for r in neardup.candidate_pairs(frame).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {(r["a"], r["b"]) for r in neardup.candidate_pairs(frame, fields=neardup.FIELD_RADIUS).collect()} == {(0, 2)}


def test_passes_and_large_nodes_change_nothing(spark, monkeypatch):
    """Six passes over the masks, many buckets and a node that is hot by its members alone."""
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 256, (5000, neardup.FIELDS), np.uint8)
    prints[:1500, 4 : 8] = 7
    prints[2000:2400] = prints[2400:2800]
    frame = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "key bigint, print binary").repartition(3)
    want = {(r["a"], r["b"]) for r in neardup.candidate_pairs(frame, tile=200).collect()}
    monkeypatch.setattr(neardup, "PASS_TEXTS", 500)
    monkeypatch.setattr(neardup, "BUCKET", 700)
    monkeypatch.setattr(neardup, "HOT_MEMBERS", 600)
    monkeypatch.setattr(neardup, "HOT", 1.0)
    monkeypatch.setattr(neardup, "TILE", 100)
    assert list(neardup.hot_nodes(frame)) == [(1 << 32) | 0x07070707]
    assert {(r["a"], r["b"]) for r in neardup.candidate_pairs(frame, tile=200).collect()} == want >= {(i, i + 400) for i in range(2000, 2400)}
