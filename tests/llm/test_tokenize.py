import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import tokenize

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenize.DEFAULT_VOCABULARY, "rb"))}
    other = tiktoken.Encoding("other", pat_str=tokenize.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tokenize.encoder(), other.encode_ordinary


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["ing", "tion", "    ", "aaaa", "!!!!", "====", "<|endoftext|>", "\r\n", "𝔘", "é"])), max_size=25).map("".join))
def test_ids_equal_the_reference_encoder(both, text):
    ours, theirs = both
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert list(ours.encode(text)) == theirs(text)
    assert ours.decode(ours.encode(text)) == text


def test_long_pieces_are_linear(both):
    ours, theirs = both
    assert list(ours.encode_bytes(b"ab" * 2000)) == theirs("ab" * 2000)
    assert len(ours.encode("x" * 200_000)) > 0


def test_unreachable_memory_limit_changes_nothing(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(tokenize, "MEMORY", 3)
    for text in ("one two three four five", "six seven eight nine ten eleven"):
        assert list(ours.encode(text)) == theirs(text)


def test_frame_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (3, "a b", "x"), (None, "a b", "x"), (4, "<|endoftext|>", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # ids clashes with the result
    made = tokenize.encode_corpus(frame).collect()
    assert len(made) == 6
    by = {}
    for r in made:
        by.setdefault(r["doc_id"], []).append(r["ids"])
    assert by[1] == [[]] and by[2] == [[]] and len(by[3]) == 2 and by[None] == [[64, 275]] and len(by[4][0]) > 1
    assert tokenize.encode_corpus(frame.limit(0)).count() == 0
    assert dict(tokenize.encode_corpus(frame).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


def test_round_trip_over_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = tokenize.encoder()
    for r in docs.join(tokenize.encode_corpus(docs), "doc_id").where(F.length("text") > 0).select("text", "ids").collect():
        assert model.decode(r["ids"]) == r["text"]
