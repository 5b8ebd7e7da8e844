import pytest
from pyspark.sql import functions as F

from voxloom.llm import language

SENTENCES = {
    "en": ["The old baker admired the broken headset inside the greenhouse.", "Nobody here knows why the choir leader left the maps outside.", "Every other week the lamp lighter sold a pocket mirror in the attic."],
    "de": ["Der alte Bäcker bestellte neben dem Brunnen das kurze Lied.", "Niemand weiß, warum die Lehrerin das lange Protokoll gelassen hat.", "Um halb zehn holte der Gärtner am Rand der Stadt die fehlende Schraube."],
    "ru": ["Старый пекарь дарит треснувший чайник вдоль канала ещё раз.", "Никто не знает, зачем соседка приносит длинную запись на чердаке.", "Юная скрипачка забывает ржавый ключ за мельницей."],
}


@pytest.fixture(scope="module")
def model():
    samples = [(lang, " ".join(s)) for lang, s in SENTENCES.items() for _ in range(6)]
    return language.fit_clean(samples + [("de", SENTENCES["en"][0])])


def test_stretches(model):
    text = f"{SENTENCES['en'][0]} {SENTENCES['de'][1]} {SENTENCES['ru'][2]}"
    found = language.stretches(model, text)
    assert [f[2] for f in found] == ["en", "de", "ru"]
    assert "".join(text[a:b] for a, b, _, _ in found) == text and all(0.5 < f[3] <= 1 for f in found)


def test_names_numbers_and_interjections_open_no_stretch(model):
    assert [f[2] for f in language.stretches(model, f"{SENTENCES['de'][0]} Fenno! 3.141 592? {SENTENCES['de'][2]}")] == ["de"]
    assert language.stretches(model, "Fenno, Lusken!") == [] and language.stretches(model, "") == []


def test_very_long_text(model):
    assert [f[2] for f in language.stretches(model, (SENTENCES["en"][0] + " ") * 3000)] == ["en"]


def chats(spark, rows):
    made = [(i, None if said is None else [{"role": "user", "content": None}, {"role": role, "content": said}], lang, "x", 5) for i, said, lang, role in rows]
    return spark.createDataFrame(made, "row_id bigint, messages array<struct<role:string,content:string>>, lang string, confidence string, seg_no int")


def test_rows(spark, model):
    en, de = SENTENCES["en"][0], SENTENCES["de"][0]
    rows = chats(spark, [(1, en, "en-US", "assistant"), (2, en, "German", "gpt"), (3, f"{en}\n{de}", "en", "assistant"), (4, de, None, "assistant"), (5, de, "", "assistant"), (6, None, "en", "gpt"), (7, "<|audio|>", "xx", "gpt"), (8, en, "en", "user"), (4, de, "unknown", "assistant"), (9, None, None, "gpt")])
    labelled = language.label_rows(rows, model, "row_id", language.normal_label(F.col("lang")), language.spoken_text("messages"))
    assert labelled.where("row_id = 9 and lang is null").count() == 1
    found = sorted((r["row_id"], r["seg_no"], r["lang"]) for r in language.mislabelled(labelled).collect())
    assert found == [(2, 0, "en"), (3, 0, "en"), (3, 1, "de"), (4, 0, "de"), (4, 0, "de"), (5, 0, "de")]


def test_empty_table(spark):
    assert language.label_chats(chats(spark, [(1, None, None, "gpt")]).limit(0)).count() == 0


def test_labels(spark):
    names = [("EN", "en"), ("en-US", "en"), ("deu", "de"), ("German", "de"), ("zh_CN", "zh"), ("und", None), ("", None), (None, None), ("xx", None), ("mul", None), (" ja ", "ja")]
    made = spark.createDataFrame(names, "l string, want string").select("want", language.normal_label(F.col("l")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in made)


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/tts.parquet")
    label, text = language.normal_label(F.col("lang")), language.spoken_text("messages")
    fit = language.fit_clean(language.training_rows(rows.where("row_id % 5 <> 0"), "row_id", label, text))
    held = language.label_rows(rows.where("row_id % 5 = 0 and lang in ('fr', 'es', 'pt', 'it', 'nl', 'ru', 'zh', 'ja')"), fit, "row_id", label, text).where("segments = 1 and lang is not null")
    assert held.where("lang = label").count() >= 0.9 * held.count() > 0


def test_short_sentences_of_another_language(model):
    en, de = SENTENCES["en"], SENTENCES["de"]

    def found(text):
        return [(f[2], text[f[0] : f[1]].strip()) for f in language.stretches(model, text)]

    for short, lang in (("Niemand weiß das lange Lied.", "de"), ("Niemand weiß das.", "de"), ("Старый пекарь дарит ключ.", "ru")):
        assert found(f"{en[0]} {short} {en[1]}") == [("en", en[0]), (lang, short), ("en", en[1])]
        assert found(f"{short} {en[1]}") == [(lang, short), ("en", en[1])]
        assert found(f"{en[1]} {short}") == [("en", en[1]), (lang, short)]
    assert len(found(f"{de[0]} Fenno Lusken Barsken! {de[2]}")) == 1
    assert len(found(f"{en[0]} Niemand weiß {en[1]}")) == 1  # no sentence of its own
    # neither does a unit that only names something lean on the clear sentence after it
    assert [f[0] for f in found(f"Fenno, Lusken. {de[0]}")] == ["de"]


def test_short_wide_sentences(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/tts.parquet")
    fit = language.fit_clean(language.training_rows(rows, "row_id", language.normal_label(F.col("lang")), language.spoken_text("messages"), 200))
    chinese, english = "老面包师在温室里修好了坏掉的耳机。", SENTENCES["en"][0]
    for text, want in (
        (f"{english} 请再说一遍。 {english}", ["en", "zh", "en"]),
        (f"{chinese}Please say it again.{chinese}", ["zh", "en", "zh"]),
        (f"{english} 你好。 {english}", ["en"]),
    ):
        assert [f[2] for f in language.stretches(fit, text)] == want


@pytest.mark.parametrize("said", ["안녕하세요 오늘은 날씨가 참 좋네요 내일 다시 만나요", "Καλημέρα σας θέλω να μάθω τι ώρα φεύγει το τρένο"])
def test_no_evidence_no_language(model, said):
    assert [(f[2], f[3]) for f in language.stretches(model, said)] == [(None, 0.0)]
    mixed = language.stretches(model, f"{SENTENCES['en'][0]} {SENTENCES['en'][1]}")
    assert [f[2] for f in mixed] == ["en"] and mixed[0][3] > 0.9


def test_no_evidence_is_no_case(spark, model):
    rows = chats(spark, [(1, "안녕하세요 오늘은 날씨가 참 좋네요 내일 다시 만나요 그럼 이만", "en", "gpt"), (2, "안녕하세요 오늘은 날씨가 참 좋네요 내일 다시 만나요 그럼 이만", None, "gpt")])
    labelled = language.label_rows(rows, model, "row_id", language.normal_label(F.col("lang")), language.spoken_text("messages"))
    assert {(r["row_id"], r["lang"], r["confidence"]) for r in labelled.collect()} == {(1, None, 0.0), (2, None, 0.0)}
    assert language.mislabelled(labelled).count() == 0


def test_confidence_is_the_share_of_right_answers(spark):
    """Fragments of rows that took no part in the fit: accuracy lies within 0.05 of confidence in the bins that
    hold most of them, within 0.1 in the rare middle ones, and within 0.02 on the whole."""
    rows = spark.read.parquet("/root/testdata/sf0.01/tts.parquet")
    labelled = rows.select(language.normal_label(F.col("lang")).alias("lang"), language.spoken_text("messages").alias("text")).where("lang is not null and length(text) > 60").distinct()
    pairs = sorted((r["lang"], r["text"]) for r in labelled.collect())
    # copies with the same beginning stay on one side
    train, held = [p for i, p in enumerate(pairs) if i // 40 % 2], [p for i, p in enumerate(pairs) if not i // 40 % 2]
    fitted = language.fit_clean(train)
    bins = {}
    for lang, text in held:
        for _, unit in language.units_of(text):
            words = language.words_of(unit)
            if not words or fitted.total(words).argmax() != fitted.languages.index(lang):
                continue  # the label does not hold for this sentence
            for number in language.FRAGMENTS:
                if len(words) < number:
                    break
                total = fitted.total(words[:number])
                chance = fitted.confidence(total, sum(map(len, words[:number])), int(total.argmax()))
                bins.setdefault(min(4, int(chance * 5)), []).append((chance, fitted.languages[total.argmax()] == lang))
    total, off = sum(map(len, bins.values())), 0.0
    for some in bins.values():
        gap = abs(sum(c for c, _ in some) / len(some) - sum(r for _, r in some) / len(some))
        off += gap * len(some) / total
        assert gap <= (0.05 if len(some) > 0.1 * total else 0.1 if len(some) >= 200 else 0.2), (gap, len(some), total)
    assert off <= 0.02 and len(bins) >= 3, off
