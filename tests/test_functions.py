from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.functions import chat, lengths, text


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_code_detector(spark):
    samples = [
        ("#include <iostream>\nint main() { return 0; }", True),
        ("def f(x):\n    return x", True),
        ("const a = 1", True),
        ("f(); g(); {h}", True),
        ("int a\nvoid b\nclass c", True),
        ("It was a calm evening; nobody spoke.", False),
        ("", False),
        (None, False),
    ]
    made = spark.createDataFrame(samples, "t string, want boolean").select("want", text.contains_code(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in made)


def test_cjk_share_edge(spark):
    # 3 of 20 characters that are no space: exactly the threshold
    assert one(spark, "你好吗" + "a" * 17 + " \t", "string", text.is_primarily_cjk) is True
    assert one(spark, "你好吗" + "a" * 18, "string", text.is_primarily_cjk) is False
    assert one(spark, "<|audio|>", "string", text.cjk_share) == 0.0
    assert one(spark, None, "string", text.cjk_share) == 0.0


def test_scores(spark):
    assert one(spark, " 4 ", "string", text.judge_score) == 4.0
    assert one(spark, "so [[3.5]]", "string", text.judge_score) == 3.5
    assert one(spark, "[[9]]", "string", text.judge_score) is None
    assert one(spark, None, "string", text.judge_score) is None


def test_numbers():
    assert text.cardinal(1234567) == "one million, two hundred and thirty-four thousand, five hundred and sixty-seven"
    assert text.cardinal(1005) == "one thousand and five"
    assert text.ordinal(21) == "twenty-first" and text.ordinal(112) == "one hundred and twelfth" and text.ordinal(40) == "fortieth"
    assert text.spoken_year(1980) == "nineteen eighty" and text.spoken_year(1905) == "nineteen oh five" and text.spoken_year(2007) == "two thousand seven"
    assert text.spoken_year(2031) == "twenty thirty-one" and text.spoken_year(1700) == "seventeen hundred" and text.spoken_year(999) is None
    assert text.spoken_decade(1980) == "nineteen eighties" and text.spoken_decade(2000) == "two thousands"
    assert text.spell_numbers("In the 1990s, 3.14 and 1,000") == "In the nineteen nineties, three point one four and one thousand"
    assert text.capitalize_sentences("a b. c? d") == "A b. C? D"


def test_normalize(spark):
    assert one(spark, "*the* 1st 😀 day. ok", "string", text.normalize_spoken) == "The first  day. Ok"
    assert one(spark, None, "string", text.normalize_spoken) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_word_edits_are_a_distance(a, b):
    x, y = " ".join(a), " ".join(b)
    d = text.word_edits(x, y)
    assert d == text.word_edits(y, x)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert (d == 0) == (a == b)


def messages(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


def test_message_errors(spark):
    def error(value):
        return one(spark, value, chat.MESSAGES, chat.message_error)

    assert error(None) == error([]) == "no_messages"
    assert error(messages(("robot", "x"))) == "unsupported_role"
    assert error(messages((None, "x"))) == "unsupported_role"
    assert error(messages(("human", None))) == "content_not_text"
    assert error(messages(("human", "a"), ("gpt", "b"))) is None


def test_first_turn(spark):
    def turn(*pairs):
        kept = one(spark, messages(*pairs), chat.MESSAGES, chat.first_turn)
        return kept and [m["content"] for m in kept]

    assert turn(("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "v")) == ["u", "a"]
    assert turn(("human", "u"), ("system", "s"), ("gpt", "a")) == ["u", "s", "a"]
    assert turn(("user", "u")) == ["u"]
    assert turn(("assistant", "a"), ("user", "u")) is None


def test_prompts(spark):
    def prompt(*pairs):
        return one(spark, messages(*pairs), chat.MESSAGES, chat.modality)

    assert prompt(("user", "<|audio|>"), ("assistant", "x<|audio|>")) == "s2s"
    assert prompt(("user", "transcribe the following audio:<|audio|>"), ("assistant", "x")) == "asr"
    assert prompt(("user", "Instruction: whisper"), ("assistant", "x<|audio|>")) == "instruct"
    assert prompt(("user", "a"), ("assistant", "b")) == "t2t"


def test_rewrite(spark):
    frame = spark.createDataFrame([("Your Name: Omni\nYour Gender: female \n\nTRANSCRIBE the following audio:<|audio|>", "user"), ("ok<|audio|>", "gpt")], "c string, r string")
    made = [r[0] for r in frame.select(chat.rewrite_content(F.col("c"), F.col("r"))).collect()]
    assert made == ["Transcribe the following audio:<|begin_of_audio|><|end_of_audio|>", "ok"]


def test_fallback_and_descriptions(spark):
    row = spark.createDataFrame([("", "said", "tts")], "t string, u string, k string").select(chat.fallback_messages(F.col("t"), F.col("u"), F.col("k")).alias("m")).first()["m"]
    assert row[1]["content"] == "said<|audio|>"
    frame = spark.createDataFrame([(True, " calm ", None), (False, "x", "y")], "single boolean, a string, b string")
    made = frame.select(chat.describe_rows(F.col("single"), {"emotion_summary": F.col("a"), "primary_emotion": F.col("b")}).alias("d")).collect()
    assert [len(r["d"]) for r in made] == [1, 0] and made[0]["d"][0]["answer"] == "calm"


def test_duration_edges(spark):
    frame = spark.createDataFrame([(1.5, "user"), (1.49, "user"), (30.0, "user"), (30.1, "user"), (60.0, "assistant"), (float("nan"), "user"), (None, "user")], "s double, r string")
    made = [r[0] for r in frame.select(lengths.duration_error(F.col("s"), F.col("r"))).collect()]
    assert made == [None, "too_short", None, "too_long", None, "not_finite", None]


def test_estimates_with_nulls(spark):
    frame = spark.createDataFrame([(None, None), (messages(("user", None), ("assistant", "12345678")), [None, 2.0, float("nan")])], f"m {chat.MESSAGES}, d array<double>")
    assert [r[0] for r in frame.select(lengths.row_estimate(F.col("m"), F.col("d"))).collect()] == [0, 36]


def test_recordings_and_paths(spark):
    frame = spark.createDataFrame([("hello", "a.wav", 2.0)], "t string, a string, s double")
    rows = frame.select(chat.speech_rows(F.col("t"), F.col("a"), F.col("s")).alias("r")).first()["r"]
    assert [r["task"] for r in rows] == ["tts", "asr"] and rows[0]["audio_tokens"] == [34] and len(rows[1]["messages"]) == 3
    paths = spark.createDataFrame([("a\\/b.wav",), ("/x",), ("",), (None,)], "p string").select(chat.absolute_path(F.col("p"), "/r/").alias("p")).collect()
    assert [r["p"] for r in paths] == ["/r/a/b.wav", "/x", "", None]


def test_rate_embedding(spark):
    made = one(spark, 99.0, "double", lambda c: lengths.rate_embedding(c, 5))
    assert len(made) == 5 and abs(made[0] - 0.8414709848) < 1e-9 and made[4] == 0.0


def test_length_vector(spark):
    row = spark.sql("select 1 a, 2 b, cast(null as int) c, 4 d, 20 e").select(lengths.length_vector(*[F.col(x) for x in "abcde"]).alias("v")).first()["v"]
    assert row["codec_tokens"] == 13 and row["user_audio_tokens"] == 0


def test_sample_rates(spark):
    from voxloom.operators.evaluate import resolved_sample_rate

    rows = spark.createDataFrame([(16000, None, None, True), (None, 0, 22050, False), (None, None, None, True), (None, None, None, False)], "a int, b int, c int, f boolean")
    assert [r[0] for r in rows.select(resolved_sample_rate(F.col("a"), F.col("b"), F.col("c"), F.col("f"))).collect()] == [24000, 22050, 24000, 16000]


def test_code_lines_end_at_any_space(spark):
    made = spark.createDataFrame(
        [(1, "a {x} b;\t\r\n{ y; }\r\n z {w};\u00a0\nplain"), (2, "import \u53d8\u91cf"), (3, "\u4e2dint a\n\u4e2dint b\n\u4e2dint c"), (4, "int a\nint b\nint c")], "i int, t string"
    ).select("i", text.contains_code(F.col("t")).alias("code"))
    assert {r["i"]: r["code"] for r in made.collect()} == {1: True, 2: True, 3: False, 4: True}


def test_sentence_capitals():
    assert text.capitalize_sentences("one. two!  three? \u00e4 b.c d") == "One. Two!  Three? \u00e4 b.c d"
    assert text.capitalize_sentences("") == "" and text.spell_numbers("the 1980S and 1905") == "the nineteen eighties and nineteen oh five"
