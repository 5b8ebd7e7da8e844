"""Held-out evaluation passages inside a training corpus.

Method: winnowing.  Texts become streams of folded letters and digits (case, punctuation, markup tags, line breaks,
spacing, accents as combining marks and invisible characters vanish).  Of every window of ``w`` consecutive k-gram
hashes the smallest is a fingerprint, so two streams that share a span of ``k + w - 1`` characters share a fingerprint
chosen from it.  Every passage falls into a span class, the largest of ``SPANS`` not above its own shortest leak, and k and
w follow from the class, so the guarantee holds for every case and a short passage costs the others nothing.

The corpus is read once, whatever the number of items.  A narrow stage winnows it for every class that occurs, drops the
fingerprints that are not in a Bloom filter of the item fingerprints (bounded in size; it only saves shuffle) and keeps
the streams of documents that have any left.  The rest is joined with the item fingerprints on the fingerprint, prints
that very many documents hold being salted, and every hit is extended to the maximal common span, whose whole item words
(or characters, for Chinese and Japanese items) are counted.  Neither side passes through the driver.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut_lineage, spread

#: Consecutive words of an item that make a leak; characters for items in scripts without spaces.
MIN_WORDS, MIN_CHARS = 8, 12

#: Span classes: characters that a fingerprint of the class covers at least.
SPANS = (1, 2, 4, 8, 12, 16, 32, 64)
#: Bits of the Bloom filter for each item fingerprint, at most ``FILTER_BITS`` in all (32 MB), and probes.
PRINT_BITS, FILTER_BITS, PROBES = 32, 1 << 28, 8
#: Rows beyond which a key is hot, the hot keys that are joined in several tasks, and the tasks of each.
HOT_ROWS, HOT_KEYS, SALTS = 100_000, 1024, 32
#: Tasks over which the documents of one passage are spread.
COPIES = 8

# The longest name of a character reference has 31 letters.
_TAG = r"(?i)</?[a-z!|][^<>]*>|&[a-z][a-z0-9]{1,30};|&#x?[0-9a-f]+;"


def _fold_table() -> np.ndarray:
    """Code point -> folded code point, 0 where the character does not count."""
    folded = np.zeros(sys.maxunicode + 1, np.uint32)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            form = [c for c in unicodedata.normalize("NFKD", chr(code)).lower() if unicodedata.category(c)[0] in "LN"]
            folded[code] = ord(form[0]) if form else code
    return folded


_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    return _FOLD[0]


def streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(folded characters of all texts, start of each text in them; one more entry than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring_regex(texts, pattern=_TAG, replacement="")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist()).encode("utf-32-le", errors="surrogatepass")
    folded = fold_table()[np.frombuffer(joined, np.uint32)]
    kept = np.flatnonzero(folded)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return folded[kept], np.searchsorted(kept, bounds)


def gram_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` characters."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(chars) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        # runs of 1, 2, 4, ... characters are doubled; the set bits of k are chained
        run, length, power = chars.astype(np.uint64), 1, base
        total, done = None, 0
        while True:
            if k & length:
                part = run[done : done + n]
                if total is None:
                    total = part.copy()
                else:
                    total = total * power + part
                done += length
            if 2 * length > k:
                break
            run = run[:-length] * power + run[length:]
            power = power * power
            length *= 2
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every window of ``w`` (the rightmost at equal hashes)."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low, length = hashes, 1
    while 2 * length <= w:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    if length < w:
        low = np.minimum(low[:n], low[w - length : w - length + n])
    picked = np.zeros(len(hashes), bool)
    open_ = np.ones(n, bool)
    for back in range(w - 1, -1, -1):
        hit = open_ & (hashes[back : back + n] == low)
        picked[back : back + n] |= hit
        open_ &= ~hit
        if back and not open_.any():
            break
    return np.flatnonzero(picked)


def _has_han(text: str) -> bool:
    letters = [c for c in text if unicodedata.category(c)[0] == "L"]
    wide = sum(0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x9FFF or ord(c) >= 0x20000 for c in letters)
    return 2 * wide > len(letters)


def _words(text: str) -> list[int]:
    """Length in folded characters of each word."""
    import regex

    table = fold_table()
    text = regex.sub(_TAG, "", text)
    text = regex.sub(r"[\p{M}\p{Cf}\p{Cc}--\s]", "", text, flags=regex.V1)
    return [int(np.count_nonzero(table[[ord(c) for c in word]])) for word in regex.findall(r"[\p{L}\p{N}]+", text)]


def grams_of(span: int) -> tuple[int, int]:
    """(k, w) of a span class: k + w - 1 = span."""
    k = (3 * span + 3) // 4
    return k, span - k + 1


def prints_of(chars: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all k-grams of a span class; the class is part of the hash."""
    return gram_hashes(chars, grams_of(span)[0]) ^ np.uint64(span * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


_PASSAGE = "passage bigint, text string, need int, span int, stream string, units array<int>, prints array<bigint>, places array<int>"


def winnowed_passages(passages: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """Streams, units (words, or characters of scripts without spaces) and fingerprints of ``passages (passage, text)``.

    Passages with fewer units than make a leak can leak nothing and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for passage, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units, wide = _words(text), _has_han(text)
                units = [1] * sum(units) if wide else units
                need = min_chars if wide else min_words
                if len(units) >= need:
                    shortest = int(np.convolve(units, np.ones(need, int), "valid").min())
                    span = max(s for s in SPANS if s <= shortest)
                    chars, _ = streams(pa.array([text]))
                    hashes = prints_of(chars, span)
                    at = winnow(hashes, grams_of(span)[1])
                    rows.append((passage, text, need, span, _text(chars), units, hashes[at].view(np.int64).tolist(), at.tolist()))
            columns = list(zip(*rows)) or [[]] * 8
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["passage", "text", "need", "span", "stream", "units", "prints", "places"])

    return passages.select("passage", "text").mapInArrow(run, _PASSAGE)


def _text(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le")


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def print_filter(prints: DataFrame, number: int) -> np.ndarray:
    """Bytes of a Bloom filter of ``prints (print)``: partial bitmaps are merged in the cluster, ``FILTER_BITS`` at most arrive."""
    bits = 1 << 15
    while bits < min(FILTER_BITS, PRINT_BITS * number):
        bits *= 2
    low, high = F.col("print").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("print", 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(low + high * i).bitwiseAND(bits - 1) for i in range(PROBES)]))
    cells = prints.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("cell")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for cell in cells.collect():
        out[cell["cell"] * 4096 : (cell["cell"] + 1) * 4096] = np.frombuffer(cell["bits"], np.uint8)
    return out


def in_filter(filter_: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Positions of the prints that the filter may hold."""
    mask = np.uint64(8 * len(filter_) - 1)
    at = np.arange(len(prints))
    for i in range(PROBES):
        some = prints[at]
        bit = ((some & np.uint64(0xFFFFFFFF)) + (some >> np.uint64(32) | np.uint64(1)) * np.uint64(i)) & mask
        at = at[(filter_[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def hits_in(chars: np.ndarray, starts: np.ndarray, span: int, filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, print) of the fingerprints of a batch of streams that the filter may hold."""
    k, w = grams_of(span)
    hashes = prints_of(chars, span)
    if not len(hashes):
        return np.empty(0, np.int64), hashes
    # runs that cross the border of two texts are no k-grams; the largest hash never wins a window
    crossing = starts[1:-1, None] - np.arange(1, k)[None, :]
    crossing = np.unique(crossing[(crossing >= 0) & (crossing < len(hashes))])
    hashes[crossing] = np.uint64(0xFFFFFFFFFFFFFFFF)
    # most k-grams occur in no passage, so only those around possible hits are winnowed
    maybe = in_filter(filter_, hashes)
    if not len(maybe):
        return maybe, hashes[maybe]
    picked = np.zeros(len(hashes), bool)
    near = np.unique((maybe[:, None] + np.arange(-(w - 1), w)[None, :]).ravel())
    near = near[(near >= 0) & (near < len(hashes))]
    breaks = np.flatnonzero(np.diff(near) > 1) + 1
    for run in np.split(near, breaks):
        picked[run[0] + winnow(hashes[run[0] : run[-1] + 1], min(w, len(run)))] = True
    hits = maybe[picked[maybe]]
    return hits, hashes[hits]


def corpus_hits(docs: DataFrame, spans: list[int], filter_: np.ndarray) -> DataFrame:
    """``(row, doc_id, stream, prints, places)`` of the documents of ``docs (row, doc_id, text)`` with possible hits."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                chars, starts = streams(part.column(2))
                some = [hits_in(chars, starts, span, shared.value) for span in spans]
                place, found = np.concatenate([p for p, _ in some]), np.concatenate([h for _, h in some])
                text = np.searchsorted(starts, place, "right") - 1
                order = np.argsort(text, kind="stable")
                text, place, found = text[order], place[order], found[order]
                kept, first = np.unique(text, return_index=True)
                offsets = pa.array(np.r_[first, len(text)].astype(np.int32))
                rows = pa.array(kept)
                held = [_text(chars[starts[i] : starts[i + 1]]) for i in kept.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows),
                        part.column(1).take(rows),
                        pa.array(held, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((place - starts[text]).astype(np.int32))),
                    ],
                    names=["row", "doc_id", "stream", "prints", "places"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {id_type}, stream string, prints array<bigint>, places array<int>")


def salted_join(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; the hottest keys of ``many`` (more than ``HOT_ROWS`` rows, the first ``HOT_KEYS`` of them) go to ``SALTS`` tasks.

    Any other key has at most ``HOT_ROWS`` rows or fewer than 1 / ``HOT_KEYS`` of all.
    """
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = [(r[key],) for r in counts.orderBy(F.desc("n")).limit(HOT_KEYS).collect()]
    if not hot:
        return many.join(few, key)
    hot = F.broadcast(many.sparkSession.createDataFrame(hot, many.select(key).schema).withColumn("salts", F.lit(SALTS)))
    salts = F.coalesce("salts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int")).drop("salts")
    right = few.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key`` in which every key is spread over ``COPIES`` tasks by a hash of ``by``; ``few`` is the query side."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(COPIES)).cast("int"))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return left.join(right, [key, "salt"]).drop("salt")


def _extend(a: np.ndarray, a_low: int, a_high: int, i: int, b: np.ndarray, b_low: int, b_high: int, j: int) -> tuple[int, int]:
    """Characters equal to the left of, and from, positions i and j."""
    room = min(i - a_low, j - b_low)
    differ = np.flatnonzero(a[i - room : i][::-1] != b[j - room : j][::-1])
    left = int(differ[0]) if len(differ) else room
    room = min(a_high - i, b_high - j)
    differ = np.flatnonzero(a[i : i + room] != b[j : j + room])
    return left, int(differ[0]) if len(differ) else room


def extended(candidates: DataFrame) -> DataFrame:
    """``(doc_id, passage)`` of the candidates whose hits extend to a span of enough whole units.

    Columns: doc_id, stream, passage, need, item_stream, units, hits (array of (place, item_place)).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (stream, need, item, units, hits) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3, 4, 5, 6)))):
                a, b, edges, ends = _chars(stream), _chars(item), np.r_[0, np.cumsum(units)], {}
                for hit in sorted(hits, key=lambda h: h["place"]):
                    at, place = hit["place"], hit["item_place"]
                    if ends.get(place - at, -1) >= at:  # inside a span already extended
                        continue
                    left, right = _extend(a, 0, len(a), at, b, 0, len(b), place)
                    ends[place - at] = at + right
                    if np.searchsorted(edges, place + right, "right") - 1 - np.searchsorted(edges, place - left, "left") >= need:
                        keep.append(i)
                        break
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows)], names=["doc_id", "passage"])

    columns = ("doc_id", "stream", "passage", "need", "item_stream", "units", "hits")
    return candidates.select(*columns).mapInArrow(run, f"doc_id {candidates.schema['doc_id'].dataType.simpleString()}, passage bigint")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    index_col: str = "index",
    fields: tuple[str, ...] = ("question", "answer", "audio_content"),
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``(doc_id, item_index)``: every document with every item of which it holds a long enough passage.

    Null and empty texts and items leak nothing; rows with a null item index are no items; repeated rows of either
    side give one output row; columns besides the named ones are not read.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = items.select(F.col(index_col).cast("long").alias("item_index"), F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("text"))
    texts = texts.where("item_index is not null and length(text) > 0").distinct()
    # equal passages of several items are searched once
    passages = texts.select("text").distinct().withColumn("passage", F.monotonically_increasing_id())
    built = cut_lineage(winnowed_passages(passages, min_words, min_chars))
    # at most as many rows as there are span classes
    spans = {r["span"]: r["n"] for r in built.groupBy("span").agg(F.sum(F.size("prints")).alias("n")).collect()}
    if not spans:
        return spark.createDataFrame([], f"doc_id {id_type}, item_index bigint")
    prints = built.select("passage", F.inline(F.arrays_zip("prints", "places")).alias("print", "item_place"))
    filter_ = print_filter(prints, sum(spans.values()))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= min(min_words, min_chars))
    source = spread(source).withColumn("row", F.monotonically_increasing_id())
    corpus = cut_lineage(corpus_hits(source, sorted(spans), filter_))
    hits = corpus.select("row", F.inline(F.arrays_zip("prints", "places")).alias("print", "place"))
    met = salted_join(hits, prints, "print").groupBy("row", "passage").agg(F.collect_set(F.struct("place", "item_place")).alias("hits"))
    met = spread_join(met, built.select("passage", "need", F.col("stream").alias("item_stream"), "units"), "passage", "row")
    found = extended(met.join(corpus.select("row", "doc_id", "stream"), "row")).distinct()
    named = spread_join(texts, built.select("text", "passage"), "text", "item_index").select("passage", "item_index")
    return spread_join(found, named, "passage", "doc_id").select("doc_id", "item_index").distinct()
