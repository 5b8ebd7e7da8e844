"""Language of documents and of each one-language stretch of mixed documents.

Method: word-first backoff.  A word known from training scores by its log frequency in each language; an unseen word
is covered from left to right by the longest known character n-grams, which shrink from five letters to one.  Units
(sentences) are scored by the sum over their words and joined by a Viterbi pass in which a change of language costs
``SWITCH`` nats, so a name, a number or a short interjection never opens a stretch of its own.  A complete sentence of
more than names that speaks clearly for its language is entered for ``SHORT_SWITCH`` nats, however short it is, if the
stretch before it holds such a sentence too.

The classifier is fitted on a bounded sample of labelled rows (``ROWS_PER_LANGUAGE`` of each language, chosen by hash of
the row id) and cleaned once: sentences that a fit on one half of them places elsewhere leave the second fit.  The
confidence comes from the softmax of the scores over ``a * letters ** b``; a and b are those under which fragments of 1 to
12 words from the other half are most likely, and the share of right answers among fragments of a like softmax is the
confidence.  Text of which no more than
``EVIDENCE`` of the letters lie in words the model has evidence for (another script) gets a null language and confidence 0.

Scoring covers every row in one narrow pass; the model, bounded by the sample, travels with the tasks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import spread

#: Bound of the training sample.
ROWS_PER_LANGUAGE = 800
#: Longest text of a training row; longer rows are scored like all others but do not train.
TRAINING_CHARS = 20_000
#: Cost of a change of language between neighbouring units, in nats.
SWITCH = 14.0
#: Cost of a change into a complete sentence that speaks for its language by ``CLEAR`` nats a word (four wide characters), at
#: most ``SWITCH``.
SHORT_SWITCH, CLEAR = 2.0, 2.0
#: Least words of such a sentence (known, or in small letters; one of four may be a name) and least wide characters.
SHORT_WORDS, SHORT_WIDE = 2, 5
#: Most nats by which one word can speak against a language (runs of wide characters: for every four characters).
MOST = 5.0
#: Least letters of a text that gets a language.
MIN_LETTERS = 20
#: Share of letters in words with evidence, at or below which a stretch has no language.
EVIDENCE = 0.5
#: Words of the fragments that measure confidence, and how many of each length and language.
FRAGMENTS, FRAGMENTS_EACH = (1, 2, 3, 5, 8, 12), 300
#: A word is known if training saw it this often; rarer ones are left to the n-grams.
MIN_WORD_COUNT = 3
NGRAM = 5

# The languages, their three-letter codes (both forms) and English names.
LABELS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "ru": ("rus", "russian"),
    "zh": ("zho", "chi", "chinese"),
    "ja": ("jpn", "japanese"),
}
LANGUAGES = tuple(LABELS)

_UNIT = regex.compile(r"[^.!?…。！？\n\r/|;“”«»„—]*[.!?…。！？\n\r/|;“”«»„—]*[\"'’)\]\s]*")
_CLOSED = regex.compile(r"[.!?…。！？][.!?…。！？\"'’”»)\]\s]*$")
_OPENS = regex.compile(r"[.!?…。！？\n\r][.!?…。！？\n\r\"'’”“»«„)\]\s]*$")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def normal_label(label: Column) -> Column:
    """The two-letter language a label names, whatever its spelling; null for unknown marks and anything else."""
    root = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for code, names in LABELS.items() for name in (code, *names) for x in (name, code)])
    return F.try_element_at(table, root)


def spoken_text(messages: str = "messages") -> Column:
    """The assistant's contents of a chat row without audio tags; empty if there are none."""
    said = F.filter(messages, lambda m: F.lower(F.trim(m["role"])).isin("assistant", "gpt") & m["content"].isNotNull())
    joined = F.array_join(F.transform(said, lambda m: m["content"]), "\n")
    return F.coalesce(F.trim(F.regexp_replace(joined, r"<\|audio\|>", "")), F.lit(""))


def units_of(text: str) -> list[tuple[int, str]]:
    """(offset, text) of sentence-like units; together they make the text."""
    return [(m.start(), m.group()) for m in _UNIT.finditer(text) if m.group()]


def words_of(text: str) -> list[str]:
    """Words in lower case; runs of wide characters are words without spaces."""
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Log scores of words and n-grams by language."""

    languages: tuple[str, ...] = LANGUAGES
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray | None = None
    temper: tuple[float, float] = (0.4, 0.5)
    levels: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0, 1.0), (0.0, 1.0))
    memory: dict[str, np.ndarray] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}, "ids": {}, "table": None}

    def units(self, words: list[list[str]]) -> np.ndarray:
        """Scores of many units at once, one row each: words become rows of a table, which are summed by unit."""
        flat = [w for some in words for w in some]
        if self.table is None or len(self.ids) > 200_000:
            self.ids, self.table = {}, np.zeros((1 << 12, len(self.languages)))
        known = self.ids.get
        at = np.array([known(w, -1) for w in flat], np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            word = flat[i]
            place = known(word, -1)
            if place < 0:
                place = self.ids[word] = len(self.ids)
                if place == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[place] = self.word(word)
            at[i] = place
        lengths = np.array([len(some) for some in words], np.int64)
        out = np.zeros((len(words), len(self.languages)))
        if len(flat):
            out[lengths > 0] = np.add.reduceat(self.table[at], (np.cumsum(lengths) - lengths)[lengths > 0], axis=0)
        return out

    def word(self, word: str) -> np.ndarray:
        score = self.memory.get(word)
        if score is None:
            score = self.words.get(word)
            if score is None:
                score = self.backoff(word)
            score = self.bounded(word, score)
            if len(self.memory) > 200_000:
                self.memory.clear()
            if len(word) < 40:
                self.memory[word] = score
        return score

    def backoff(self, word: str) -> np.ndarray:
        """Longest known n-grams from left to right; an unknown character counts the same for all languages."""
        padded, at, total, parts = f"_{word}_", 0, np.zeros(len(self.languages)), 0
        while at < len(padded):
            for n in range(min(NGRAM, len(padded) - at), 0, -1):
                score = self.grams.get(padded[at : at + n])
                if score is not None:
                    if padded[at : at + n] != "_":  # the border of a word alone says nothing
                        total = total + score
                    break
            else:
                n, total = 1, total + self.unseen
            parts += 1
            at += n
        # a word counts once, however many pieces cover it; runs of wide characters count by their length
        return total if _WIDE.search(word) else total / max(1.0, parts / 2)

    def bounded(self, word: str, score: np.ndarray) -> np.ndarray:
        score = score - score.max()
        return np.maximum(score, -MOST * (max(1.0, len(word) / 4) if _WIDE.search(word) else 1.0))

    def total(self, words: list[str]) -> np.ndarray:
        out, known, word = np.zeros(len(self.languages)), self.memory.get, self.word
        for w in words:
            score = known(w)
            out += word(w) if score is None else score
        return out

    def unit(self, text: str) -> np.ndarray:
        return self.total(words_of(text))

    def evidence(self, words: list[str]) -> float:
        """Share of the letters that lie in words which speak for one language more than for another."""
        return sum(len(w) for w in words if self.word(w).any()) / max(1, sum(map(len, words)))

    def confidence(self, total: np.ndarray, letters: int, own: int) -> float:
        """Share of right answers among fragments that spoke as clearly for their language."""
        return float(np.interp(self.chance(total, letters)[own], *self.levels))

    def chance(self, total: np.ndarray, letters: int) -> np.ndarray:
        a, b = self.temper
        scaled = np.exp((total - total.max()) / (a * max(1, letters) ** b))
        return scaled / scaled.sum()


def fit(samples: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model of (language, text) pairs."""
    place = {lang: i for i, lang in enumerate(languages)}
    seen = [Counter() for _ in languages]
    for lang, text in samples:
        seen[place[lang]].update(words_of(text))
    words = {word: i for i, word in enumerate(dict.fromkeys(word for some in seen for word in some))}
    counts = np.zeros((len(words), len(languages)))
    for lang, some in enumerate(seen):
        counts[[words[word] for word in some], lang] = list(some.values())
    model = Model(languages)

    def scores(keys: list[str], table: np.ndarray, least: int, alpha: float = 0.5) -> dict[str, np.ndarray]:
        totals = np.maximum(table.sum(axis=0), 1) + alpha * len(table)
        often = np.flatnonzero(table.sum(axis=1) >= least)
        rows = np.log((table[often] + alpha) / totals)
        rows -= rows.max(axis=1, keepdims=True)  # only differences between languages count
        return dict(zip([keys[i] for i in often.tolist()], rows))

    model.words = scores(list(words), counts, MIN_WORD_COUNT)
    for n in range(1, NGRAM + 1):
        number: dict[str, int] = {}
        grams, owners = [], []
        for word, i in words.items():
            padded = f"_{word}_"
            some = [number.setdefault(padded[j : j + n], len(number)) for j in range(len(padded) - n + 1)]
            grams += some
            owners += [i] * len(some)
        if grams:
            at = np.array(grams)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
            table = np.add.reduceat(counts[np.array(owners)[order]], first, axis=0)
            model.grams.update(scores(list(number), table, 3))
    model.unseen = np.zeros(len(languages))
    return model


def measure(model: Model, samples: list[tuple[str, str]]) -> None:
    """Sets temper, the (a, b) under which fragments of sentences the model did not see are most likely, and levels."""
    sentences: dict[str, list[list[str]]] = defaultdict(list)
    for lang, text in samples:
        for _, unit in units_of(text):
            words = words_of(unit)
            # other sentences have a wrong label or stand in another language
            if words and not any(map(_WIDE.search, words)) and model.total(words).argmax() == model.languages.index(lang):
                sentences[lang].append(words)
    totals, letters, truth = [], [], []
    for lang, some in sentences.items():
        for number in FRAGMENTS:
            long_enough = [words[:number] for words in some if len(words) >= number]
            for part in long_enough[:: max(1, len(long_enough) // FRAGMENTS_EACH)]:
                totals.append(model.total(part))
                letters.append(sum(map(len, part)))
                truth.append(model.languages.index(lang))
    if len(truth) < FRAGMENTS_EACH:
        return
    scores, n, own = np.array(totals), np.array(letters, float), np.array(truth)
    scores -= scores.max(axis=1, keepdims=True)

    def loss(a: float, b: float) -> float:
        scaled = scores / (a * n**b)[:, None]
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(own)), own]).mean())

    grid = [(a, b) for a in np.geomspace(0.1, 10, 41) for b in np.linspace(-1, 1, 9)]
    model.temper = min(grid, key=lambda at: loss(*at))
    best = scores.argmax(axis=1)
    chance = np.array([model.chance(t, k)[i] for t, k, i in zip(scores, letters, best)])
    order = np.argsort(chance, kind="stable")
    some = [part for part in np.array_split(order, min(20, len(order) // 50)) if len(part)]
    shown = [float(chance[part].mean()) for part in some]
    right = np.maximum.accumulate([float((best[part] == own[part]).mean()) for part in some])
    model.levels = ((0.0, *shown, 1.0), (0.0, *right.tolist(), max(1.0 - 1 / len(order), float(right[-1]))))


def fit_clean(samples: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> Model:
    """Fit on half of the rows of each language, measure confidence on the rest, drop the sentences of all rows that the fit
    places in another language (wrong labels, mixed texts), fit again.

    The halves are taken in the order of the texts, so that copies with the same beginning are not split between them.
    """
    by_lang: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for sample in sorted(samples):
        by_lang[sample[0]].append(sample)
    first = fit([s for some in by_lang.values() for s in some[: (len(some) + 1) // 2]], languages)
    measure(first, [s for some in by_lang.values() for s in some[(len(some) + 1) // 2 :]])
    kept = []
    for lang, text in samples:
        for _, unit in units_of(text):
            score = first.unit(unit)
            if len(words_of(unit)) and score.argmax() == languages.index(lang):
                kept.append((lang, unit))
    model = fit(kept or samples, languages)
    model.temper, model.levels = first.temper, first.levels
    return model


def training_rows(rows: DataFrame, id_col: str, label: Column, text: Column, bound: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``bound`` labelled rows of each language: the first by hash of their id (a ranking Spark limits map-side)."""
    labelled = rows.select(F.col(id_col).alias("id"), label.alias("lang"), text.alias("text")).where(f"lang is not null and length(text) between {MIN_LETTERS} and {TRAINING_CHARS}")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "text"))
    return [(r["lang"], r["text"]) for r in labelled.withColumn("place", place).where(F.col("place") <= bound).select("lang", "text").collect()]


def sentence_words(model: Model, before: str, unit: str, words: list[str]) -> float:
    """Words (four wide characters count as one, unknown ones twice) of a unit that is a complete sentence of more than
    names; 0 if it is none."""
    if not words or not _CLOSED.search(unit) or (before and not _OPENS.search(before)):
        return 0.0
    wide = sum(len(w) for w in words if _WIDE.search(w))
    plain = [w for w in _WORD.findall(unit) if not _WIDE.search(w)]
    known = sum(w.lower() in model.words for w in plain)
    if wide >= SHORT_WIDE or (known >= SHORT_WORDS and 4 * (len(plain) - known) <= len(plain)):
        return len(plain) + wide / 4
    # unknown words in small letters are no names, but must speak twice as clearly, as another script does
    if sum(w[0].islower() for w in plain) >= SHORT_WORDS and sum(not w[0].islower() for w in plain[1:]) * 4 <= len(plain):
        return 2.0 * len(plain)
    return 0.0


def stretches(model: Model, text: str) -> list[tuple[int, int, str | None, float]]:
    """(start, end, language, confidence) of each one-language stretch; empty for texts of too few letters."""
    return all_stretches(model, [text])[0]


def all_stretches(model: Model, texts: list[str]) -> list[list[tuple[int, int, str | None, float]]]:
    """``stretches`` of many texts, whose words are scored together."""
    cut, words = [], []
    for text in texts:
        units = units_of(text)
        some = [words_of(unit) for _, unit in units]
        letters = sum(len(w) for unit in some for w in unit)
        if letters < 4 * MIN_LETTERS and len(_LETTER.findall(text)) < MIN_LETTERS:  # marks are no letters
            units, some = [], []
        cut.append((text, units, some))
        words += some
    scores, out, begin = model.units(words), [], 0
    for text, units, some in cut:
        out.append(_parsed(model, text, units, some, scores[begin : begin + len(units)]) if units else [])
        begin += len(units)
    return out


def _path(model: Model, units: list[tuple[int, str]], words: list[list[str]], scores: np.ndarray) -> list[int]:
    """The language of every unit."""
    whole = int(scores.sum(axis=0).argmax())
    if (scores[:, whole] >= scores.max(axis=1)).all():
        return [whole] * len(units)  # one language is best throughout, so no change can gain
    best, back = scores[0], []
    # firm[a, b]: the stretch in a that ends here holds a complete sentence that speaks for a and against b
    firm, states = np.zeros((len(best), len(best)), bool), np.arange(len(best))
    own = int(best.argmax())
    clear = sentence_words(model, "", units[0][1], words[0])
    if clear:
        firm[own] = best[own] - best >= min(CLEAR * clear, SWITCH)
    for i, row in enumerate(scores[1:], 1):
        jump = best.max() - SWITCH
        stay = best >= jump
        came, value = np.where(stay, states, best.argmax()), np.where(stay, best, jump)
        own = int(row.argmax())
        clear = 0.0
        if own != best.argmax() or np.count_nonzero(firm[own]) < len(best) - 1:
            clear = sentence_words(model, units[i - 1][1], units[i][1], words[i])
        against = row[own] - row >= min(CLEAR * clear, SWITCH)
        if clear and own != best.argmax():
            others = np.where(against & firm[:, own], best, -np.inf)
            if others.max() - SHORT_SWITCH > value[own]:
                came[own], value[own] = others.argmax(), others.max() - SHORT_SWITCH
        firm = firm & (came == states)[:, None]
        if clear:
            firm[own] |= against
        back.append(came)
        best = value + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    path.reverse()
    return path


def _parsed(model: Model, text: str, units: list[tuple[int, str]], words: list[list[str]], scores: np.ndarray) -> list[tuple[int, int, str | None, float]]:
    path = _path(model, units, words, scores)
    out, begin = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[begin]:
            total = scores[begin:i].sum(axis=0)
            count = sum(len(w) for some in words[begin:i] for w in some)
            end = units[i][0] if i < len(units) else len(text)
            # scores near zero are looked at more closely: words of another script speak for no language
            if total.min() > -0.5 * sum(map(len, words[begin:i])) and model.evidence([w for some in words[begin:i] for w in some]) <= EVIDENCE:
                out.append((units[begin][0], end, None, 0.0))
            else:
                out.append((units[begin][0], end, model.languages[path[begin]], model.confidence(total, count, path[begin])))
            begin = i
    return out


def label_rows(rows: DataFrame, model: Model, id_col: str, label: Column, text: Column) -> DataFrame:
    """One row per stretch: ``(row id, seg_no, lang, confidence, start, n_chars, label, segments)``.

    Null, empty and short texts (under ``MIN_LETTERS`` letters) give one row with a null language and confidence 0, so no
    input row is lost.  Repeated rows are labelled each; extra columns are not read.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, seg_no int, lang string, confidence double, start int, n_chars int, label string, segments int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            parsed = [found for start in range(0, len(texts), 200) for found in all_stretches(model, texts[start : start + 200])]
            for i, (text, label, found) in enumerate(zip(texts, batch.column(2).to_pylist(), parsed)):
                found = found or [(0, len(text), None, 0.0)]
                for no, (start, end, lang, chance) in enumerate(found):
                    take.append(i)
                    out.append((no, lang, chance, start, end - start, label, len(found)))
            columns = list(zip(*out)) if out else [[]] * 7
            types = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), *arrays],
                names=[id_col, "seg_no", "lang", "confidence", "start", "n_chars", "label", "segments"],
            )

    return spread(rows.select(F.col(id_col), text.alias("__text"), label.alias("__label"))).mapInArrow(run, schema)


def label_chats(rows: DataFrame, id_col: str = "row_id", bound: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Language and confidence of every stretch of the spoken text of every chat row; see ``label_rows``."""
    label, text = normal_label(F.col("lang")), spoken_text("messages")
    model = fit_clean(training_rows(rows, id_col, label, text, bound))
    return label_rows(rows, model, id_col, label, text)


def mislabelled(labelled: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Stretches of the rows whose label is missing or names another language, and of all mixed rows."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return labelled.where(F.col("lang").isNotNull() & ((F.col("segments") > 1) | wrong)).select(id_col, "seg_no", "lang")
