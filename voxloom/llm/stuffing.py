"""Keyword-stuffed pages, link lists and product tags.

Method: rank-frequency curves.  A narrow stage cuts every page into parts (long lines alone, short sentence lines together,
short list lines together, links, tags and product entries together) and counts the words of each part and of the page
as a whole; a curve depends on its counts only through how many words occur how often, so a part leaves the stage as a
short spectrum of (frequency, words), not as its words.  SQL windows turn the spectrum into ranks, and a line is fitted
through (ln rank, ln frequency): slope, residual and the frequency at the middle rank, beside the head (share of the first
rank).  The divergence of a curve is the largest distance between its cumulated shares at ranks 1, 2, 4, ... and those of
the prose of the same language and length class.

Two kinds of curves are judged.  *Word* curves of list and sentence parts are stuffed if they have too few word types for
their length and an extreme slope, residual, head or middle.  *Token* curves (links, digits and marks count as tokens,
numbers as one token) of links, tags and product entries are stuffed if they diverge from prose by ``DIVERGENCE`` or are
steeper with too few types; their form only says which lines make such a part.  A page is a case if stuffed parts make up
more than half of its characters and the token curve of the whole page lies outside ``PAGE_BAND`` around that of prose.

Repeated sentences are counted once, so that drills keep the curve of one sentence, while keyword lists keep their
repeats.  Types over words fall with length, so a long part is judged in windows of its words, all of them, each held
against prose of its own length; the part as a whole is stuffed if it repeats a large stock evenly, which no window of it
shows.  Keywords that hardly repeat have no curve; a list of them lacks the function words that head the curve of prose.
Scripts without spaces are counted by pairs of characters where a list has no separators.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import cut_lineage, spread

#: Words that make a line a part of its own.
LONG_LINE = 30
#: Share of the prose type/token ratio (same language, same length class) below which a part is stuffed.
LIST_RATIO, SENTENCE_RATIO = 0.9, 0.55
#: Curves that prose does not have: the fitted frequency of the middle rank is clearly above 1 (a small stock repeated
#: evenly), the fit is poor or the first rank holds a large share (a few words far above a tail of single ones), or the
#: slope is steep.
MIDDLE, RESIDUAL, SLOPE, HEAD = 1.05, 0.15, -0.9, 0.2
#: An even curve counts only below this share of the prose ratio: short texts of few words are even by chance.
EVEN_RATIO = 0.72
#: Share of the first rank that marks a list by itself.
ALONE = 0.3
#: Words of a window: a part of at least twice as many is cut into windows of equal length.
WINDOW = 256
#: Curve of a long part that repeats a stock of words evenly: a middle rank well above 1 under a flat slope.
EVEN_MIDDLE, FLAT = 1.5, -0.35
#: A token curve is stuffed beyond this divergence from prose, or if it is this much steeper under fewer than
#: ``SENTENCE_RATIO`` of the types of prose.
DIVERGENCE, STEEPER = 0.1, 0.15
#: The curve of a page is that of prose within this divergence and these differences of slope, residual and share of types.
PAGE_BAND = (0.03, 0.1, 0.03, 0.1)
#: Ranks at which cumulated shares are compared.
RANKS = (1, 2, 4, 8, 16, 32, 64)
#: Rank offset of the curve 1 / (rank + OFFSET) that stands for prose where a language has too little of a length class.
OFFSET = 2.7
#: Slope, residual and, by length class, types over tokens of prose there.
PROSE_SLOPE, PROSE_RESIDUAL = -0.5, 0.04
PROSE_RATIO = {3: 0.95, 4: 0.87, 5: 0.8, 6: 0.7, 7: 0.6, 8: 0.52}
#: Parts of prose that a language must have in a length class to be its own measure.
SEEN = 20
#: Share of function words (or of pairs of characters with one) among the words of a list, below which it is no prose, and
#: the least words and pairs for that.
FUNCTION_SHARE, FUNCTION_WORDS, FUNCTION_PAIRS = 0.05, 20, 40
#: Characters per word beyond which wide characters are written without separators.
RUN = 24
#: Least ratio expected of prose by length class (log2 of the words): holds where a language has few parts of a class,
#: or where stuffed pages outnumber its prose.
LEAST_RATIO = {3: 0.85, 4: 0.75, 5: 0.65, 6: 0.55, 7: 0.47, 8: 0.42}

# Frequent function words of the languages written with spaces, and characters of the others.
FUNCTION = {
    "en": "the a an of to and in is it that for on with as was at by this from or be are not but have i you he she we they his her my",
    "de": "der die das und in zu den mit von ist im dem nicht ein eine einen auf für es sich auch als an er sie ich wir aus hat dass wie bei um nach am",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au ce il elle je nous vous avec par plus ne se à l d son sa mais ou",
    "es": "el la los las de del y en un una es que por con para no se lo su al como más pero le me o si ya este cuando mi",
    "pt": "o a os as de do da dos das e em um uma é que por com para não se no na ao como mais mas eu ele ela seu sua ou",
    "it": "il lo la i gli le di del della e in un una è che per con non si al da dal come più ma mi ho ha suo sua o nel",
    "nl": "de het een van en in is dat op te voor met niet zijn er aan ook als bij door maar om uit ik je hij ze we naar",
    "ru": "и в во не на я что он она с со как это по но из у к за от до для же бы мы вы они его её о об при",
}
FUNCTION_CHARS = "的了是我你他她们这那吗呢吧把被就也都很着没让给和与但のはをがにへともでてただなかられします"

_ALL_FUNCTION = frozenset(w for some in FUNCTION.values() for w in some.split())
_FUNCTION_CHAR = re.compile(f"[{FUNCTION_CHARS}]")
_JUDGED_BARE = frozenset((*FUNCTION, "zh", "ja", "un"))
_MARKUP = re.compile(r"<\|[A-Za-z_]+\|>")
_LINES = re.compile("[\\r\\n\\u2028\\u2029]+")
# every repeated class stops at the mark that opens or closes the form, so a scan is linear whatever the length of a link
_LINK = re.compile(
    r"<a\s[^<>]*>[^<]*</a>|!?\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))+\)|\b(?:https?|ftp)://[^\s<>)\]]+|\bwww\.[^\s<>)\]]+", re.IGNORECASE
)
_LINK_MARKS = ("://", "](", "<a ", "<A ", "www.", "WWW.")
_CODE = re.compile(r"\b[A-Z]{1,3}-?[0-9]{2,6}\b", re.IGNORECASE)
_PRICE = re.compile(r"[0-9]+[.,][0-9][0-9](?![0-9])")
_SENTENCES = re.compile(r"[.!?…]\s+|[。！？]\s*")
_CLOSED = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_NUMBER = re.compile(r"\d+")
_WIDE = re.compile("[\\u3040-\\u30ff\\u3400-\\u9fff]")

PARTS = (
    "doc_id {id}, page bigint, part int, win int, kind string, lang string, pairs boolean, chars bigint, link_chars bigint, n bigint, types bigint, bare boolean, "
    "f array<int>, c array<int>"
)


class _Line:
    """What one line is made of."""

    __slots__ = ("chars", "kind", "line", "link_chars", "tokens", "words")

    def __init__(self, line: str):
        rest = _LINK.sub(" ", line) if any(m in line for m in _LINK_MARKS) else line
        self.line, self.chars, self.link_chars = line, len(line), len(line) - len(rest)
        said = _SENTENCES.split(rest)
        ends = len(said) - 1 + (1 if said[-1] and _CLOSED.search(rest.rstrip(" ")[-6:]) else 0)
        once = dict.fromkeys(said)
        # words, marks and numbers (all one token) of the line with its links
        self.tokens = _TOKENS.findall(_NUMBER.sub("0", line.lower()))
        if len(once) == len(said) and not self.link_chars:
            self.words = list(filter(str.isalpha, self.tokens))
        else:
            self.words = list(filter(str.isalpha, _TOKENS.findall(" ".join(once).lower())))
        n, digits = len(self.words), sum(map(rest.count, "0123456789"))
        hashes, symbols = rest.count("#"), sum(map(rest.count, "(){}[]=_<>\\"))
        sentence = ends > 0 and n <= 45 * ends
        code = _CODE.search(rest) if digits >= 3 and not sentence else None
        if self.link_chars and not sentence:
            self.kind = "link"
        elif hashes >= 3 and 2 * hashes >= n:
            self.kind = "tags"
        elif code and _PRICE.search(rest, code.end()):
            self.kind = "product"
        elif rest[:1] == "|" or 20 * symbols >= self.chars or 4 * digits >= self.chars:
            self.kind = "other"
        else:
            self.kind = "sentence" if sentence else "list"


def _pairs(words: list[str]) -> list[str] | None:
    """Pairs of characters of a list of wide characters without separators, else None."""
    run = "".join(words)
    if words and len(run) >= RUN * len(words) and 2 * len(_WIDE.findall(run)) > len(run):
        return [a + b for a, b in zip(run, run[1:])]
    return None


def _bare(kind: str, lang: str, words: list[str], pairs: bool) -> bool:
    """Whether a list of a language in ``FUNCTION`` (or of Chinese, Japanese or an unknown one) is long and lacks its words."""
    if kind != "list" or lang not in _JUDGED_BARE or len(words) < (FUNCTION_PAIRS if pairs else FUNCTION_WORDS):
        return False
    held = sum(w in _ALL_FUNCTION or _FUNCTION_CHAR.search(w) is not None for w in words)
    return held < FUNCTION_SHARE * len(words)


def cut_page(text: str, lang: str) -> list[tuple]:
    """Rows ``(part, win, kind, lang, pairs, chars, link_chars, n, types, bare, f, c)`` of one page, c words of frequency f.

    Kinds list and sentence carry word curves, link, tags and product token curves, other none.  Two kinds carry token
    curves without characters: prose (the sentence parts once more) and page (all of it).  A part of at least two windows
    is cut into windows 0, 1, ... that share its characters; window -1 is a list or sentence part as a whole.
    """
    lines = [_Line(line) for line in (x.strip() for x in _LINES.split(_MARKUP.sub(" ", text) if "<|" in text else text)) if line]
    parts: list[tuple[str, list[_Line]]] = []
    together: dict[str, list[_Line]] = {}
    for line in lines:
        if line.kind in ("list", "sentence") and len(line.words) >= LONG_LINE:
            parts.append((line.kind, [line]))
        else:
            together.setdefault(line.kind, []).append(line)
    parts.extend(together.items())
    out, everything = [], []

    def add(part: int, kind: str, own: str, counted: list[str], chars: int, link_chars: int, pairs: bool = False) -> None:
        number = max(1, len(counted) // WINDOW)
        cuts = [(0, 0, len(counted), chars, link_chars)]
        if number > 1:
            at = [len(counted) * i // number for i in range(number + 1)]
            share = [(chars * i // number, link_chars * i // number) for i in range(number + 1)]
            cuts = [(i, at[i], at[i + 1], share[i + 1][0] - share[i][0], share[i + 1][1] - share[i][1]) for i in range(number)]
            if kind in ("list", "sentence"):
                cuts.append((-1, 0, len(counted), 0, 0))
        for win, begin, end, c, lc in cuts:
            some = counted[begin:end]
            counts = Counter(some)
            spectrum = Counter(counts.values())
            out.append((part, win, kind, own, pairs, c, lc, len(some), len(counts), _bare(kind, own, some, pairs), list(spectrum), list(spectrum.values())))

    for part, (kind, held) in enumerate(parts):
        chars, link_chars = sum(x.chars for x in held), sum(x.link_chars for x in held)
        if kind in ("list", "sentence"):
            lists = dict.fromkeys(tuple(x.words) for x in held) if kind == "sentence" and len(held) > 1 else [x.words for x in held]
            words = [w for some in lists for w in some]
            own, pairs = lang, _pairs(words) if kind == "list" else None
            # a part in Latin letters on a page labelled with a language of another script is held against English prose
            if lang in ("zh", "ja", "ru") and sum("a" <= w[0] <= "z" for w in words) > 0.7 * len(words):
                own = "en"
            add(part, kind, own, words if pairs is None else pairs, chars, link_chars, pairs is not None)
            tokens = [t for x in held for t in x.tokens]
            if kind == "sentence":
                once = tokens if len(held) == 1 else [t for x in {x.line: x for x in held}.values() for t in x.tokens]
                add(part, "prose", own, once, 0, 0)
        else:
            tokens = [t for x in held for t in x.tokens]
            add(part, kind, lang, [] if kind == "other" else tokens, chars, link_chars)
        everything.extend(tokens)
    if lines:
        add(len(parts), "page", lang, everything, 0, 0)
    return out


def page_parts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The parts of every page with their spectra (``PARTS``), in one narrow stage; see ``cut_page``."""
    schema = PARTS.format(id=docs.schema[id_col].dataType.simpleString())
    code = F.lower(F.substring(F.trim(F.col(lang_col)), 1, 2))
    lang = F.when(code.rlike("^[a-z]{2}$"), code).otherwise(F.lit("un"))
    pages = spread(docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 4, pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["part", "win", "kind", "lang", "pairs", "chars", "link_chars", "n", "types", "bare", "f", "c"]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                cut = [cut_page(t, own) for t, own in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                take = pa.array([i for i, rows in enumerate(cut) for _ in rows], pa.int64())
                columns = list(zip(*[row for rows in cut for row in rows])) or [[]] * len(types)
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(3).take(take), *arrays], names=["doc_id", "page", *names])

    return pages.withColumn("page", F.monotonically_increasing_id()).select("doc_id", "text", "lang", "page").mapInArrow(run, schema)


def _sum_ln(n: Column) -> Column:
    """Sum of ln 1 .. ln n (Stirling's series, error under 0.001)."""
    n = n.cast("double")
    return F.when(n <= 1, 0.0).otherwise(n * F.log(n) - n + 0.5 * F.log(2 * F.pi() * n) + 1 / (12 * n) - 1 / (360 * n * n * n))


def _sum_ln2(n: Column) -> Column:
    """Sum of the squares of ln 1 .. ln n (Euler and Maclaurin's series)."""
    n = n.cast("double")
    x = F.log(n)
    return F.when(n <= 1, 0.0).otherwise(n * (x * x - 2 * x + 2) + x * x / 2 + x / (6 * n) - (4 * x - 6) / (720 * n * n * n) - 2.006356457)


def fitted(parts: DataFrame) -> DataFrame:
    """Rank-frequency curves of all parts: ``(page, part, win, kind, slope, residual, middle, head, shares)``.

    Words of equal frequency fill a run of ranks, so the sums of the fit come from the runs.  middle is the frequency that
    the fit gives the word of middle rank: about 1 in prose, where half of the types occur once, and clearly more where a
    small stock of words is repeated.  shares are cumulated over the first 1, 2, 4, ... ranks.
    """
    key = ("page", "part", "win", "kind")
    runs = parts.where("n > 0").select(*key, F.inline(F.arrays_zip(F.col("f").cast("array<bigint>").alias("f"), F.col("c").cast("array<bigint>").alias("c"))).alias("f", "c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before)
    y, c = F.log("f"), F.col("c")
    x = _sum_ln(F.col("before") + c) - _sum_ln(F.col("before"))
    sums = runs.groupBy(*key).agg(
        F.sum("c").alias("types"), F.sum(F.col("f") * c).alias("total"), F.max("f").alias("top"),
        F.sum(x).alias("sx"), F.sum(_sum_ln2(F.col("before") + c) - _sum_ln2(F.col("before"))).alias("sxx"),
        F.sum(c * y).alias("sy"), F.sum(c * y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        *[F.sum(F.col("f") * F.least(F.greatest(F.lit(r) - F.col("before"), F.lit(0)), c)).alias(f"upto{r}") for r in RANKS],
    )
    t = F.col("types")
    xx, xy, yy = F.col("sxx") - F.col("sx") * F.col("sx") / t, F.col("sxy") - F.col("sx") * F.col("sy") / t, F.col("syy") - F.col("sy") * F.col("sy") / t
    slope = F.when((t > 1) & (xx > 1e-9), xy / xx).otherwise(0.0)
    made = sums.withColumn("slope", slope)
    middle = F.exp((F.col("sy") - F.col("slope") * F.col("sx")) / t + F.col("slope") * F.log(F.greatest(F.lit(1.0), t / 2)))
    residual = F.when(t > 1, F.greatest(yy - F.col("slope") * xy, F.lit(0.0)) / t).otherwise(0.0)
    shares = F.array(*[F.col(f"upto{r}") / F.col("total") for r in RANKS])
    return made.select(*key, "slope", residual.alias("residual"), middle.alias("middle"), (F.col("top") / F.col("total")).alias("head"), shares.alias("shares"))


def curves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All parts of all pages, their curves, and what prose of the language and length class shows.

    expected is the type/token ratio of prose, divergence the distance of a token curve from that of prose.
    """
    parts = cut_lineage(page_parts(docs, id_col, text_col, lang_col))
    # a window has less than twice WINDOW words, a page any number; a whole part has no use for its class
    size_class = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")
    made = parts.drop("f", "c").join(fitted(parts), ["page", "part", "win", "kind"], "left").withColumn("size_class", size_class)
    made = made.withColumn("ratio", F.col("types") / F.greatest(F.col("n"), F.lit(1)))
    made = cut_lineage(made)
    # one window of each part, so that a long page weighs no more than another; at most 677 language codes x 40 classes
    words = made.where("kind = 'sentence' and n >= 8 and win = 0").withColumn("size_class", F.least(F.lit(max(LEAST_RATIO)), "size_class"))
    words = words.groupBy("lang", "size_class").agg(F.percentile_approx("ratio", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= SEEN)
    class_ = F.least(F.lit(max(LEAST_RATIO)), F.greatest(F.col("size_class"), F.lit(min(LEAST_RATIO))))
    least = F.element_at(F.create_map(*[F.lit(v) for kv in LEAST_RATIO.items() for v in kv]), class_)
    # repeated lines that pass for sentences (logs, tables) are no measure of prose
    tokens = made.where("kind = 'prose' and n >= 8 and win = 0").where(F.col("ratio") >= SENTENCE_RATIO * least).groupBy("lang", "size_class")
    tokens = tokens.agg(
        F.count(F.lit(1)).alias("seen"),
        *[F.percentile_approx(name, 0.5, 1000).alias(f"prose_{name}") for name in ("slope", "residual", "ratio")],
        F.array(*[F.percentile_approx(F.col("shares")[i], 0.5, 1000) for i in range(len(RANKS))]).alias("prose_shares"),
    ).where(F.col("seen") >= SEEN)
    # where prose is too rare to be measured: the curve 1 / (rank + OFFSET) over its types, of which the last occur once
    usual = F.element_at(F.create_map(*[F.lit(v) for kv in PROSE_RATIO.items() for v in kv]), class_)
    ranks = F.greatest(usual * F.col("n"), F.lit(2.0))

    def law(r: int) -> Column:
        share = F.lit(math.log((r + OFFSET + 0.5) / (OFFSET + 0.5))) / F.log((ranks + OFFSET + 0.5) / (OFFSET + 0.5))
        return F.when(ranks <= r, 1.0).otherwise(F.least(share, 1 - (ranks - r) / F.greatest("n", F.lit(1))))

    law_shares = F.array(*map(law, RANKS))
    made = made.withColumn("own_class", F.least(F.lit(max(LEAST_RATIO)), "size_class"))
    made = made.join(F.broadcast(words.select("lang", F.col("size_class").alias("own_class"), "median")), ["lang", "own_class"], "left")
    made = made.join(F.broadcast(tokens.drop("seen")), ["lang", "size_class"], "left")
    made = made.withColumn("expected", F.greatest(F.when(~F.col("pairs"), F.col("median")), least))
    far = F.array_max(F.zip_with("shares", F.coalesce("prose_shares", law_shares), lambda a, b: F.abs(a - b)))
    made = made.withColumns({"prose_ratio": F.coalesce("prose_ratio", usual), "prose_slope": F.coalesce("prose_slope", F.lit(PROSE_SLOPE)), "prose_residual": F.coalesce("prose_residual", F.lit(PROSE_RESIDUAL))})
    return made.withColumn("divergence", F.when(F.col("kind").isin("link", "tags", "product", "page", "prose"), far))


def judged(parts: DataFrame) -> DataFrame:
    """Adds stuffed to the windows of list, sentence, link, tags, product and other parts."""
    wholes = parts.where("win = -1").select("page", "part", F.col("middle").alias("whole_middle"), F.col("slope").alias("whole_slope"))
    both = parts.where("win >= 0 and kind not in ('prose', 'page')").join(wholes, ["page", "part"], "left")
    few = F.col("ratio") < F.when(F.col("kind") == "list", LIST_RATIO).otherwise(SENTENCE_RATIO) * F.col("expected")
    long_enough = F.col("n") >= F.when(F.col("kind") == "list", 8).otherwise(20)
    steep = (F.col("residual") > RESIDUAL) | (F.col("slope") < SLOPE) | (F.col("head") > HEAD)
    extreme = steep | ((F.col("middle") > MIDDLE) & (F.col("ratio") < EVEN_RATIO * F.col("expected")))
    # one word that makes up a third of a list needs no comparison with prose
    alone = (F.col("kind") == "list") & (F.col("head") > ALONE) & (F.col("n") >= 20)
    words = (F.col("kind").isin("list", "sentence") & few & long_enough & extreme) | alone
    even = F.col("kind").isin("list", "sentence") & (F.col("whole_middle") > EVEN_MIDDLE) & (F.col("whole_slope") > FLAT)
    poor = (F.col("slope") < F.col("prose_slope") - STEEPER) & (F.col("ratio") < SENTENCE_RATIO * F.col("prose_ratio"))
    tokens = F.col("kind").isin("link", "tags", "product") & ((F.col("divergence") > DIVERGENCE) | poor)
    flags = [F.coalesce(flag, F.lit(False)) for flag in (F.col("bare"), words, even, tokens)]
    return both.withColumn("stuffed", flags[0] | flags[1] | flags[2] | flags[3])


def page_shares(parts: DataFrame) -> DataFrame:
    """``(doc_id, share, divergence, slope, residual, extreme)``: stuffed share of the characters, and the curve of the page.

    The curve of a long page is that of its windows: the mean of each trait, weighted by tokens.
    """
    held = judged(parts).groupBy("doc_id").agg((F.sum(F.when(F.col("stuffed"), F.col("chars")).otherwise(F.col("link_chars"))) / F.sum("chars")).alias("share"))
    off = {
        "divergence": F.col("divergence"),
        "slope": F.col("slope") - F.col("prose_slope"),
        "residual": F.col("residual") - F.col("prose_residual"),
        "types": F.col("ratio") / F.col("prose_ratio") - 1,
    }
    mean = [(F.sum(value * F.col("n")) / F.sum("n")).alias(name) for name, value in off.items()]
    pages = parts.where("kind = 'page' and n > 0").groupBy(F.col("doc_id").alias("__id")).agg(*mean)
    outside = F.lit(False)
    for name, band in zip(off, PAGE_BAND):
        outside = outside | (F.abs(name) > band)
    return held.join(pages.withColumn("extreme", outside), F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")


def stuffed_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id)`` of every page of which more than half is stuffed keywords, links or product tags.

    Null, empty and blank texts are no cases.  A row id that occurs twice is one page made of both texts.  A null
    language is compared with the other pages of unknown language.
    """
    shares = page_shares(curves(docs, id_col, text_col, lang_col))
    return shares.where((F.col("share") > 0.5) & F.col("extreme")).select("doc_id")
