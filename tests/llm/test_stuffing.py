import random
from collections import Counter

import numpy as np

from voxloom.llm import stuffing

PROSE = (
    "The old baker admired the broken headset inside the greenhouse. A tired courier repaired the wet umbrella beneath the clock tower. "
    "Nobody here knows why the choir leader left three paper maps outside the bakery. We cut every recording at the first cough. "
)
KEYWORDS = "voice changer app, call center voice pack, podcast mic stand, ringtone download, "
LINKS = "\n".join(f"https://host{i}.example/path/{i}" for i in range(20))


def found(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, share double, line string, words string")
    return {r["doc_id"] for r in stuffing.stuffed_pages(frame).collect()}


def doc(i, text, lang="en"):
    return (i, text, lang, 1.0, "line", "words")


def test_kinds(spark):
    rows = [
        doc(1, KEYWORDS * 12),
        doc(2, PROSE + "\n" + LINKS),
        doc(3, " ".join(f"#voice{i} #mic #app" for i in range(20))),
        doc(4, " | ".join(f"Brand Z{100 + i} red mic stand {i},49" for i in range(20))),
        doc(5, PROSE * 3 + "\n" + KEYWORDS),
        doc(6, "The old baker admired the broken headset inside the greenhouse.\n" * 40),
        doc(7, "\n".join(f"step {i} loss_text 1.{i} lr 8.9e-04" for i in range(60))),
        doc(8, "\n".join(f"{i}. {PROSE} (https://a{i}.example)" for i in range(5))),
        doc(9, "def f(a):\n    return [a]\n" * 20),
        doc(10, " ".join(str(i * 7919) for i in range(200))),
        doc(11, "配音价格, 铃声下载, 耳机促销, " * 20, "zh"),
        doc(12, "<a href='//x.test/a'>cheap voice</a> " * 30, None),
        doc(13, "Looking for voice app? Our voice app beats every other voice app. Why voice app? Because voice app means mic stand and mic stand means voice app. Top voice app, top mic stand, top voice app and mic stand. " * 5),
    ]
    assert found(spark, rows) == {1, 2, 3, 4, 11, 12, 13}


def test_edges(spark):
    rows = [doc(1, None), doc(2, ""), doc(3, " \n \t"), doc(4, KEYWORDS * 12, None), doc(4, KEYWORDS * 12, None), doc(None, KEYWORDS * 12), doc(5, KEYWORDS * 30_000)]
    assert found(spark, rows) == {4, None, 5}
    assert found(spark, rows[:0]) == set()


def test_links_and_products_of_any_length(spark):
    rng = random.Random(3)

    def long_path(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz/-") for _ in range(n))

    rows = [
        doc(1, "\n".join(f"https://host{i}.example/{long_path(5000)}" for i in range(8)) + "\n" + PROSE),
        doc(2, "\n".join(f"<a href='//x.test/{long_path(5000)}'>{'voice app ' * 80}</a>" for i in range(8)) + "\n" + PROSE),
        doc(3, "\n".join(f"[{'cheap mic ' * 90}](//y.test/{long_path(4000)})" for i in range(8)) + "\n" + PROSE),
        doc(4, "\n".join(f"Z{100 + i} {'mic stand ' * 40}, {i},49" for i in range(20)) + "\n" + PROSE),
        doc(5, "[(<a " * 20_000 + "\n" + PROSE),  # marks that open and never close
    ]
    assert {1, 2, 3, 4} <= found(spark, rows)


def test_fit_is_that_of_all_ranks(spark):
    """The sums over runs of equal frequency give the least squares line through every (ln rank, ln frequency)."""
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(600)]
    spectrum = Counter(Counter(words).values())
    parts = spark.createDataFrame([(1, 0, 0, "list", 600, list(spectrum), list(spectrum.values()))], "page bigint, part int, win int, kind string, n bigint, f array<int>, c array<int>")
    got = stuffing.fitted(parts).first()
    f = np.array(sorted(Counter(words).values(), reverse=True))
    x, y = np.log(np.arange(1, len(f) + 1)), np.log(f)
    slope, level = np.polyfit(x, y, 1)
    assert abs(got["slope"] - slope) < 1e-3
    assert abs(got["residual"] - ((y - slope * x - level) ** 2).mean()) < 1e-3
    assert abs(got["middle"] - np.exp(level + slope * np.log(len(f) / 2))) < 1e-2
    assert got["head"] == f[0] / 600 and np.allclose(got["shares"], [f[:r].sum() / 600 for r in stuffing.RANKS])


def test_links_without_a_foreign_curve_are_no_case(spark):
    """Form alone is no reason: a line with a link whose tokens are spread like prose stays unflagged."""
    rng = random.Random(6)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(700)]
    weights = [1 / (rank + 2.7) for rank in range(700)]
    said = " ".join(rng.choices(words, weights, k=200)) + " www.a.example"
    prose = [" ".join(" ".join(rng.choices(words, weights, k=12)) + "." for _ in range(16)) for _ in range(30)]
    assert [p[2] for p in stuffing.cut_page(said, "en")] == ["link", "page"]
    assert found(spark, [doc(1, said), *[doc(i + 10, text) for i, text in enumerate(prose)]]) == set()


def test_half_is_not_enough(spark):
    keywords = KEYWORDS * 6
    prose = (PROSE * 8)[: len(keywords) * 2].rsplit(".", 1)[0] + "."
    assert found(spark, [doc(1, keywords + "\n" + prose), doc(2, keywords * 3 + "\n" + prose)]) == {2}


def test_long_parts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(700)]
    weights = [1 / (rank + 2) for rank in range(len(words))]
    said = [" ".join(rng.choices(words, weights, k=rng.randint(6, 18))) for _ in range(2500)]
    half = "; ".join(words[:600])
    rows = [
        doc(1, ". ".join(said) + "."),  # a transcript on one long line
        doc(2, ".\n".join(said) + "."),  # and one of short lines
        doc(3, " ".join(said)),  # and one without punctuation
        doc(4, f"{half}; " * 4),  # a stock larger than a window, repeated
        doc(5, ". ".join(said[:400]) + ".\n" + KEYWORDS * 700),
        doc(6, ". ".join(said) + ".\n" + KEYWORDS * 60),
    ]
    assert found(spark, rows) == {4, 5}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, share double, line string, words string")
    chars = {r["doc_id"]: r["chars"] for r in stuffing.judged(stuffing.curves(frame)).groupBy("doc_id").sum("chars").withColumnRenamed("sum(chars)", "chars").collect()}
    assert chars == {i: sum(len(line.strip()) for line in text.split("\n")) for i, text, *_ in rows}


def test_keywords_used_once(spark):
    goods = "voice mic podcast ringtone headset speaker studio cable mixer karaoke audio radio".split()
    offers = "changer stand download sale coupon kit pack shop review price deal rental".split()
    once = ", ".join(f"{g} {o}" for g, o in zip(goods, offers))
    said = "so then we all went down to the harbour and she asked me whether it was too late for him or if they could still find a boat"
    chinese = "配音价格铃声下载耳机促销变声器软件麦克风支架播客设备录音棚租赁语音克隆朗读工具音箱评测声卡驱动混音教程"
    japanese = "着信音ダウンロード格安音声合成高音質録音機器通販無料変声器比較人気配信機材割引防音室価格"
    transcript = "我们昨天晚上去了河边的小店他说那里的茶很好喝但是我觉得太贵了所以我们就走了她也没有买什么东西"
    rows = [
        doc(1, once),
        doc(2, once, "de"),
        doc(3, said),
        doc(4, said, None),
        doc(5, chinese, "zh"),
        doc(6, japanese, "ja"),
        doc(7, transcript, "zh"),
        doc(8, "配音价格铃声下载耳机促销" * 20, "zh"),
        doc(9, once, "pl"),  # no function words are known
        doc(10, "Anna, Bo, Carl, Dora"),
    ]
    assert found(spark, rows) == {1, 2, 5, 6, 8}
