import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import leaks

QUESTION = "In the weeks before the salted fire of Ulljor how many anthems did the magistrate forbid"
CHINESE = "宓珂筠在石林之年前往澄筠城请问栎溪画坊为何把五十六座浮桥交给蒯翎禾保管"


def items(spark, rows):
    return spark.createDataFrame(rows, "index bigint, question string, answer string, audio_content string, instruction string, text string")


def found(spark, docs, rows):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, item_index string, question string")
    return {(r["doc_id"], r["item_index"]) for r in leaks.leaks(frame, items(spark, rows)).collect()}


def test_definition(spark):
    words = QUESTION.split()
    rows = [(7, QUESTION, "null", None, "listen to the recording first and then reply as if talking to a friend", None), (8, CHINESE, None, None, None, None), (None, QUESTION, None, None, None, None), (9, None, None, "", None, None)]
    docs = [
        (1, "x " + " ".join(words[3:11]) + " y", None, None),
        (2, "x " + " ".join(words[3:10]) + " y", None, None),
        (3, "<b>" + "</b>\n- ".join(w.upper() for w in words[2:12]) + "!!", None, None),
        (4, "​".join(" ".join(words[0:9])), None, None),
        (5, "前" + CHINESE[4:16] + "后", None, None),
        (6, "前" + CHINESE[4:15] + "后", None, None),
        (7, "listen to the recording first and then reply as if talking to a friend", None, None),
        (8, None, None, None),
        (9, "", None, None),
        (1, " ".join(words), None, None),
        (10, "z" * 300_000 + " " + QUESTION + " " + "y" * 300_000, None, None),
    ]
    assert found(spark, docs, rows) == {(1, 7), (3, 7), (4, 7), (5, 8), (10, 7)}
    assert found(spark, docs[:0], rows) == set() and found(spark, docs, rows[:0]) == set()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(2, 6), st.integers(1, 6))
def test_winnowing_marks_every_window(values, k, w):
    hashes = leaks.gram_hashes(np.array(values, np.uint32), k)
    picked = set(leaks.winnow(hashes, w).tolist())
    for i in range(len(hashes) - w + 1):
        window = hashes[i : i + w]
        low = max(j for j in range(w) if window[j] == window.min())
        assert i + low in picked


def brute(texts, passages, need=8):
    want = set()
    for t, text in texts:
        squeezed = text.replace(" ", "")
        for i, passage in passages:
            words = passage.split()
            if any("".join(words[a : a + need]) in squeezed for a in range(len(words) - need + 1)):
                want.add((t, i))
    return want


def made_up(seed, passages, texts):
    """Short and long words, so that passages of several span classes occur."""
    rng = random.Random(seed)
    short, long_ = list("abcdefgh"), [f"{a}{b}" for a in ("ka", "li", "mo", "nu") for b in ("", "ra", "tes", "vion", "brandel")]
    said = [(i, " ".join(rng.choices(rng.choice((short, long_, short + long_)), k=rng.randint(5, 16)))) for i in range(passages)]
    out = []
    for t in range(texts):
        words = rng.choices(long_ + short, k=rng.randint(0, 30))
        if rng.random() < 0.7:
            source = rng.choice(said)[1].split()
            at = rng.randrange(len(source))
            words[rng.randint(0, len(words)) :] = source[at : at + rng.randint(4, 12)]
        out.append((t, " ".join(words)))
    return said, out


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot):
    """One pass over the corpus finds every leak of every span class; with hot every print is salted."""
    passages, texts = made_up(5, 60, 400)
    passes = []
    narrow = leaks.corpus_hits
    monkeypatch.setattr(leaks, "corpus_hits", lambda *a: passes.append(a[1]) or narrow(*a))
    if hot:
        monkeypatch.setattr(leaks, "HOT_ROWS", 0)
    want = brute(texts, passages)
    assert found(spark, [(t, x, None, None) for t, x in texts], [(i, p, None, None, None, None) for i, p in passages]) == want and len(want) > 50
    assert len(passes) == 1 and len(passes[0]) > 2


def test_one_short_passage_leaves_the_others_alone(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h"), (2, QUESTION)], "passage bigint, text string")
    got = {r["passage"]: r for r in leaks.winnowed_passages(rows, 8, 12).collect()}
    assert got[1]["span"] == 8 and got[2]["span"] == 16


def test_filter_holds_all_and_little_else(spark):
    rng = np.random.default_rng(1)
    inside, outside = (rng.integers(0, 1 << 64, 4000, np.uint64) for _ in range(2))
    frame = spark.createDataFrame([(int(v),) for v in inside.view(np.int64)], "print bigint")
    held = leaks.print_filter(frame, 4000)
    assert len(leaks.in_filter(held, inside)) == 4000 and len(leaks.in_filter(held, outside)) < 10


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(leaks, "HOT_ROWS", 5000)
    many = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(30_100)], "k int, v int")
    few = spark.createDataFrame([(k, f"n{j}") for k in (*range(5), 99) for j in range(2)], "k int, name string")
    got = sorted(tuple(r) for r in leaks.salted_join(many, few, "k").select("k", "v", "name").collect())
    assert got == sorted(tuple(r) for r in many.join(few, "k").select("k", "v", "name").collect())


@pytest.mark.parametrize("length", [50, 300, 100_000])
def test_tags_of_any_length_do_not_count(spark, length):
    words = QUESTION.split()
    text = f"{' '.join(words[2:6])} <a title='{'long ' * (length // 5)}'>{' '.join(words[6:11])}</a>"
    assert found(spark, [(1, text, None, None)], [(7, QUESTION, None, None, None, None)]) == {(1, 7)}


def test_whole_table(spark, small):
    from voxloom.llm.queries import p6_found

    assert p6_found(spark, small).count() == p6_found(spark, small).distinct().count() > 0


def test_tags_do_not_count():
    chars, _ = leaks.streams(pa.array(["<b>ab</b>&nbsp;c <|audio|>d", None, "1 < 2"]))
    assert "".join(map(chr, chars)) == "abcd12"
