"""Near-duplicate texts by a Gray-order hierarchical index over fingerprints.

Every distinct normal form gets a fingerprint of ``FIELDS`` x 8 bits: field i holds eight bits of the least value of the
i-th permutation of its character runs, so two fields are equal with chance J and their bits differ in half otherwise.

*Upper nodes* of the index are masked bit patterns of that fingerprint: mask b keeps the 32 bits of block b (a block
permutation brings them to the front), and fingerprints that agree under a mask share its node.  There are as many masks
as recall needs: with 24, two texts of similarity 0.7 meet below some node with chance 0.9986 (0.9999 at 0.75).  Below
its node a fingerprint is sorted by the Gray rank of its first bit plane; runs of 32 and 512 neighbours become lower
nodes that hold the bits on which all members agree.  Differences accumulate on the way down: two nodes whose agreed bits
already differ in more than ``RADIUS`` places are pruned with everything below.  Members are compared in blocks of ``BLOCK``
pairs, so the memory of a task does not follow the size of its nodes.  A pair within the radius is a candidate if at most
``FIELD_RADIUS`` fields differ in their lower four bits: unrelated texts of one vocabulary meet in numbers that grow with the
square of the corpus, and no such pair may reach the exact check, which reads texts.

Members travel packed, four bits of each field with them, in buckets of whole nodes.  The masks are taken in passes; the
shuffle files of a pass are removed at its end.

Hot nodes are known before anything moves: every chunk of the corpus names the nodes that hold more than a share of it
(``HOT``, less in a corpus where that would be over ``HOT_MEMBERS``), and the sums of these counts find every node that holds
more than twice that share of all texts (at most ``MASKS`` / share of them, a proven bound).  Their members go straight to
tiles that meet pairwise in tasks of their own.
Equal texts are one member; copies come back by a join at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.language import spoken_text
from voxloom.session import cut_lineage, cut_lineage_and_shuffles

#: Characters in a run, least characters of a text, least shared part of the runs.
SHINGLE, MIN_CHARS, SIMILARITY = 4, 40, 0.7
#: Masks, and the eight-bit fields that one mask keeps.
MASKS, KEPT = 24, 4
#: Fields of a fingerprint.
FIELDS = MASKS * KEPT
#: Bits of the 128 compared below a node (first plane, and the second of 32 fields) that may differ: at similarity 0.7 the
#: mean is 18.4 with deviation 4.4.
RADIUS = 36
#: Fields of a candidate whose lower four bits may differ: at similarity 0.7 the mean is 27 with deviation 4.4, at 0.3 it is 63.
FIELD_RADIUS = 46
#: Rows of a lowest node, and pairs of rows looked at in one step (arrays of that many words).
LEAF, BLOCK = 32, 1 << 16
#: Members of a hot node that one task compares with each other, or with as many of another tile.
TILE = 2048
#: Passes over the masks, one more for every so many texts; texts whose members are packed together, members of a bucket.
PASSES, PASS_TEXTS, PACKED, BUCKET = 6, 100_000, 1 << 15, 1 << 16
#: Share of a chunk of ``CHUNK`` texts from which a node is counted as a candidate for a hot one.
HOT, CHUNK = 1 / 512, 2048
#: Members above which a node is hot whatever its share.
HOT_MEMBERS = 16_384
#: Share of all rows from which the copies of one text are paired in tiles.
COPIES = 1 / 4096


def normal_form(text: Column) -> Column:
    """Lower case letters and digits of any script, nothing else."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(text: str, k: int = SHINGLE) -> np.ndarray:
    """Hashed runs of ``k`` characters in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = np.zeros(n, np.uint64)
        for i in range(k):
            runs = runs * np.uint64(0x100000001B3) + codes[i : i + n]
    return _mix(runs)


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashed runs of ``k`` characters, sorted."""
    return np.unique(runs_of(text, k))


def _factors() -> np.ndarray:
    steps = np.arange(1, FIELDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return ((_mix(steps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


_FACTORS = _factors()[:, None]


def fingerprint(runs: np.ndarray) -> np.ndarray:
    """Eight bits of the least value of each permutation of 32-bit numbers (products with odd factors) over mixed runs."""
    low = (runs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(FIELDS, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(low), 4096):  # long texts in pieces that stay in the cache
        np.minimum(least, (low[None, start : start + 4096] * _FACTORS).min(axis=1), out=least)
    with np.errstate(over="ignore"):
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def masked(prints: np.ndarray) -> np.ndarray:
    """Upper nodes of fingerprints, one column for each mask: the number of the mask and the 32 bits that it keeps."""
    blocks = np.ascontiguousarray(prints).reshape(-1, MASKS, KEPT).view(">u4")[:, :, 0].astype(np.int64)
    return blocks | (np.arange(MASKS, dtype=np.int64) << 32)[None, :]


def compared_bits(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits compared below a node: the first plane of all fields, then the second plane of the first 32."""
    planes = np.concatenate([prints & 1, (prints[:, : 128 - FIELDS] >> 1) & 1], axis=1)
    words = np.packbits(planes, axis=1).view(">u8").astype(np.uint64)
    return words[:, 0].copy(), words[:, 1].copy()


def gray_rank(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of 128-bit numbers in the order of the reflected Gray code."""
    high, low = high.copy(), low.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        high ^= high >> np.uint64(shift)
        low ^= low >> np.uint64(shift)
    odd = (high & np.uint64(1)).astype(bool)  # the parity of the upper half turns the lower one over
    low[odd] = ~low[odd]
    return high, low


def from_rank(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of Gray ranks."""
    carried = (low >> np.uint64(1)) | (high << np.uint64(63))
    return high ^ (high >> np.uint64(1)), low ^ carried


def fingerprints_of(texts: DataFrame, k: int) -> DataFrame:
    """``(key, print)``: the fingerprint of every distinct text, ``FIELDS`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(runs_of(t, k)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["key", "print"])

    return texts.select("key", "norm").mapInArrow(run, "key bigint, print binary")


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FIELDS)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, the last one smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def hot_nodes(prints: DataFrame) -> dict[int, int]:
    """Nodes that hold more than twice the share ``HOT`` of all texts, or more than ``2 * HOT_MEMBERS`` (and perhaps some that
    hold more than half of that), with at least as many members as they have.

    A node that holds twice the share is counted in the chunks where it holds more than the share; the others add at
    most the share, so the sum reaches the share of all.  At most ``MASKS / share`` nodes can.
    """
    total = prints.count()
    if total <= TILE:
        return {}
    share = min(HOT, HOT_MEMBERS / total)
    chunk = max(CHUNK, int(4 / share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, chunk):
            rows = _prints(table.column(1))
            for start in range(0, len(rows), chunk):
                part = rows[start : start + chunk]
                node, n = np.unique(masked(part), return_counts=True)
                often = n > share * len(part)
                yield pa.RecordBatch.from_arrays([pa.array(node[often]), pa.array(n[often], pa.int64())], names=["node", "n"])

    found = prints.mapInArrow(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total)
    found = found.where(F.col("n") + share * total > TILE)
    return {r["node"]: r["n"] + int(share * total) + 1 for r in found.collect()}


def sketches_of(prints: DataFrame, hot: dict[int, int]) -> DataFrame:
    """``(key, rank_high, rank_low, nodes, hot)``: Gray rank of the compared bits, the nodes, and those known to be hot.

    A view of the index for inspection; ``candidate_pairs`` sends the same members packed.
    """
    known = np.array(sorted(hot), np.int64)

    def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _prints(batch.column(1))
            high, low = gray_rank(*compared_bits(prints))
            nodes = masked(prints)
            is_hot = np.isin(nodes, known)
            row = np.repeat(np.arange(len(nodes)), MASKS).reshape(nodes.shape)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(high.view(np.int64)),
                    pa.array(low.view(np.int64)),
                    lists(row[~is_hot], nodes[~is_hot], len(nodes)),
                    lists(row[is_hot], nodes[is_hot], len(nodes)),
                ],
                names=["key", "rank_high", "rank_low", "nodes", "hot"],
            )

    return prints.mapInArrow(run, "key bigint, rank_high bigint, rank_low bigint, nodes array<bigint>, hot array<bigint>")


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else _ONES[x.view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1, dtype=np.uint8)


def _near(high: np.ndarray, low: np.ndarray, radius: int) -> np.ndarray:
    """Whether differences of two words hold at most ``radius`` bits."""
    return _popcount(high) + _popcount(low) <= radius


def _agreed(high: np.ndarray, low: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For runs of rows from each head to the next: agreed bits and their values, as (high, agreed high, low, agreed low)."""
    both = [(np.bitwise_and.reduceat(x, heads), ~(np.bitwise_or.reduceat(x, heads) ^ np.bitwise_and.reduceat(x, heads))) for x in (high, low)]
    return np.stack([*both[0], *both[1]])


def _unpruned(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    p, q = nodes[:, a], nodes[:, b]
    return _near((p[0] ^ q[0]) & p[1] & q[1], (p[2] ^ q[2]) & p[3] & q[3], radius)


def _large_group(high: np.ndarray, low: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within one group, a < b: nodes of 512 rows, those of ``LEAF`` rows below the pairs that are not pruned, then rows."""
    n, fan = len(high), 512 // LEAF
    leaves, tops = (_agreed(high, low, np.arange(0, n, width)) for width in (LEAF, 512))
    a, b = np.triu_indices(tops.shape[1])
    keep = _unpruned(tops, a, b, radius)
    a, b = a[keep], b[keep]
    i, j = (x.ravel() for x in np.indices((fan, fan)))
    inside = np.arange(LEAF)
    for start in range(0, len(a), 64):
        x, y = ((t[start : start + 64, None] * fan + k).ravel() for t, k in ((a, i), (b, j)))
        there = (x <= y) & (y < leaves.shape[1])
        x, y = x[there], y[there]
        there = _unpruned(leaves, x, y, radius)
        x, y = x[there] * LEAF, y[there] * LEAF
        step = max(1, BLOCK // LEAF**2)
        for at in range(0, len(x), step):
            p, q = (np.minimum(t[at : at + step, None] + inside, n - 1) for t in (x, y))  # the last leaf may be short
            m, r, c = np.nonzero(_near(high[p][:, :, None] ^ high[q][:, None, :], low[p][:, :, None] ^ low[q][:, None, :], radius))
            p, q = x[at + m] + r, y[at + m] + c
            keep = (p < q) & (q < n)
            if keep.any():
                yield p[keep], q[keep]


def searched(group: np.ndarray, side: np.ndarray, high: np.ndarray, low: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``search`` in pieces: at most about ``BLOCK`` pairs are looked at, held and given at once, whatever the groups' sizes."""

    def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (side[a] == 0) | (side[a] != side[b])
        return a[keep], b[keep]

    n = len(group)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    for size in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]).tolist():
        some = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, BLOCK // len(i))
        for at in range(0, len(some), step):
            a, b = ((some[at : at + step, None] + k).ravel() for k in (i, j))
            keep = _near(high[a] ^ high[b], low[a] ^ low[b], radius)
            if keep.any():
                yield met(a[keep], b[keep])
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        for a, b in _large_group(high[start : start + size], low[start : start + size], radius):
            yield met(a + start, b + start)


def search(group: np.ndarray, side: np.ndarray, high: np.ndarray, low: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group within ``radius`` bits; rows come sorted by group and Gray rank.

    ``side`` is 0 for the only tile of a group, else 1 or 2 for the two tiles that meet; rows of the same side of a
    two-tile group are not compared.  Groups of more than ``LEAF`` rows have nodes: runs of ``LEAF`` and 512 rows with the
    bits on which the run agrees; a pair of nodes that has accumulated too many differences is pruned with all below it.
    """
    found = list(searched(group, side, high, low, radius))
    z = np.empty(0, np.int64)
    return (np.concatenate([z, *(a for a, _ in found)]), np.concatenate([z, *(b for _, b in found)]))


#: A member of a node on its way: bits 0 to 3 of all fields, those compared in Gray order first (``compared_bits``).
_ENTRY = np.dtype([("node", "<i8"), ("key", "<i8"), ("high", "<u8"), ("low", "<u8"), ("rest", "<u8", 3), ("last", "<u4", 3)])


def entries_of(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Members without their node."""
    made = np.zeros(len(keys), _ENTRY)
    made["key"] = keys
    made["high"], made["low"] = compared_bits(prints)
    for i in (1, 2, 3):
        plane = np.packbits((prints >> i) & 1, axis=1)
        made["rest"][:, i - 1] = np.ascontiguousarray(plane[:, :8]).view(">u8")[:, 0]
        made["last"][:, i - 1] = np.ascontiguousarray(plane[:, 8:]).view(">u4")[:, 0]
    return made


def differing_fields(entries: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fields whose lower four bits differ."""
    first = entries["high"][a] ^ entries["high"][b]
    second = (entries["low"][a] ^ entries["low"][b]) >> np.uint64(32)
    for i in range(3):
        first |= entries["rest"][a, i] ^ entries["rest"][b, i]
        second |= entries["last"][a, i] ^ entries["last"][b, i]
    return _popcount(first).astype(np.int64) + _popcount(second)


def _tile_of(keys: np.ndarray, tiles: int) -> np.ndarray:
    return (_mix(keys.astype(np.uint64)) % np.uint64(tiles)).astype(np.int64)


def _candidates_of(prints: DataFrame, masks: list[int], buckets: int, tiles: dict[int, int], radius: int, fields: int) -> DataFrame:
    """``(a, b)`` of the nodes of some masks; pairs that meet in several nodes come several times.

    Members travel packed, by buckets of whole nodes.  Member m of a hot node of t tiles goes to the buckets of the t pairs of
    tiles that hold its own.
    """
    known = np.array(sorted(n for n in tiles if n >> 32 in masks), np.int64)
    count = [tiles[n] for n in known.tolist()]
    offset = buckets + np.cumsum([0, *(t * t for t in count)])

    def packed(entries: np.ndarray, bucket: np.ndarray, row: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(bucket, kind="stable")
        sent, bucket = entries[row[order]], bucket[order]
        sent["node"] = node[order]
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)]):
            yield int(bucket[x]), sent[x:y].tobytes()

    def placed(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
        entries, nodes = entries_of(keys, rows), masked(rows)[:, masks]
        is_hot = np.isin(nodes, known)
        row, at = np.nonzero(~is_hot)
        node = nodes[row, at]
        yield from packed(entries, (_mix(node.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), row, node)
        for i in np.unique(np.searchsorted(known, nodes[is_hot])).tolist():
            row = np.flatnonzero((nodes == known[i]).any(axis=1))
            mine = _tile_of(keys[row], count[i])
            for other in range(count[i]):
                pair = np.minimum(mine, other) * count[i] + np.maximum(mine, other)
                yield from packed(entries, offset[i] + pair, row, np.full(len(row), known[i]))

    def batch_of(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["bucket", "entries"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, PACKED):
            made, size = [], 0
            for one in placed(table.column(0).to_numpy(), _prints(table.column(1))):
                made.append(one)
                size += len(one[1])
                if size > 1 << 23:
                    yield batch_of(made)
                    made, size = [], 0
            yield batch_of(made)

    def compared(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        entries = np.frombuffer(b"".join(held), _ENTRY)
        rank_high, rank_low = gray_rank(entries["high"], entries["low"])
        entries = entries[np.lexsort((rank_low, rank_high, entries["node"]))]
        side = np.zeros(len(entries), np.int64)
        if bucket >= buckets:
            i = int(np.searchsorted(offset, bucket, "right")) - 1
            low_tile, high_tile = divmod(bucket - int(offset[i]), count[i])
            if low_tile != high_tile:
                side = np.where(_tile_of(entries["key"], count[i]) == low_tile, 1, 2)
        key = entries["key"]
        found, size = [], 0
        for a, b in searched(entries["node"], side, entries["high"].copy(), entries["low"].copy(), radius):
            near = differing_fields(entries, a, b) <= fields
            found.append(np.stack([np.minimum(key[a[near]], key[b[near]]), np.maximum(key[a[near]], key[b[near]])]))
            size += found[-1].shape[1]
            if size > BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, axis=1)], names=["a", "b"])
                found, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(found, axis=1), axis=1)], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = -1, []
        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != last and held:
                    yield from compared(last, held)
                    held = []
                last = bucket
                held.append(entries.as_py())
        if held:
            yield from compared(last, held)

    sent = prints.mapInArrow(place, "bucket bigint, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(compare, "a bigint, b bigint").distinct()


def candidate_pairs(prints: DataFrame, tile: int = TILE, radius: int = RADIUS, fields: int = FIELDS) -> DataFrame:
    """``(a, b)``, a < b: keys of fingerprints that meet below some node within ``radius`` bits and ``fields`` differing fields.

    The masks are taken in up to ``PASSES`` passes, so that the members of only some masks lie on disk at a time.
    """
    hot = hot_nodes(prints)
    tiles = {node: -(-n // tile) for node, n in hot.items()}
    total = prints.count()
    passes = min(PASSES, 1 + total // PASS_TEXTS)
    found = []
    for i in range(passes):
        masks = list(range(i, MASKS, passes))
        buckets = 1 + total * len(masks) // BUCKET
        part = _candidates_of(prints, masks, buckets, tiles, radius, fields)
        found.append(cut_lineage_and_shuffles(part) if passes > 1 else part)
    return reduce(DataFrame.unionByName, found).distinct() if passes > 1 else found[0]


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """``(a, b, similarity)`` of the pairs that reach ``similarity`` exactly.

    The runs of a text are computed once for all pairs of a batch; sets whose sizes alone exclude a pair are not compared.
    """
    left = texts.select(F.col("key").alias("a"), F.col("norm").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("norm").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            runs: dict[int, np.ndarray] = {}
            for side in (0, 1):
                some, first = np.unique(keys[side], return_index=True)
                for key, text in zip(some.tolist(), batch.column(2 + side).take(pa.array(first)).to_pylist()):
                    if key not in runs:
                        runs[key] = shingles(text, k)
            score = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(keys[0].tolist(), keys[1].tolist())):
                p, q = runs[x], runs[y]
                if min(len(p), len(q)) >= similarity * max(len(p), len(q)):
                    at = np.searchsorted(p, q)
                    at[at == len(p)] = 0
                    both = np.count_nonzero(p[at] == q) if len(p) else 0
                    score[i] = both / max(1, len(p) + len(q) - both)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["a", "b", "similarity"])
            yield out.filter(pa.array(score >= similarity))

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def members_of(rows: DataFrame, id_col: str, text: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row_id, key, norm)`` of the rows whose normal form is long enough; key stands for equal normal forms."""
    normal = rows.select(F.col(id_col).alias("row_id"), normal_form(text).alias("norm")).where(F.length("norm") >= min_chars)
    return normal.select("row_id", F.xxhash64("norm").alias("key"), "norm")


def links(members: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """``(a, b, similarity)``: similar pairs of distinct normal forms, by key."""
    texts = members.groupBy("key").agg(F.min("norm").alias("norm"))
    prints = cut_lineage(fingerprints_of(texts, k))
    return cut_lineage(verified(candidate_pairs(prints, tile, radius, FIELD_RADIUS), texts, k, similarity))


def equal_rows(ids: DataFrame, tile: int = TILE) -> DataFrame:
    """``(x, y)``, x < y: all pairs of rows with the same key; ``ids`` are distinct ``(key, row_id)``.

    A text with more than the share ``COPIES`` of all rows (at most 1 / COPIES texts) is paired in tiles, each a task.
    """
    counts = ids.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hot = counts.where(F.col("c") > max(tile, int(COPIES * ids.count()))).select("key", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    copies = ids.join(counts.select("key"), "key", "left_semi").join(F.broadcast(hot), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    copies = copies.withColumn("mine", F.pmod(F.xxhash64("row_id"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = copies.select("key", F.col("mine").alias("i"), other.alias("j"), F.col("row_id").alias("x"))
    right = copies.select("key", other.alias("i"), F.col("mine").alias("j"), F.col("row_id").alias("y"))
    return left.join(right, ["key", "i", "j"]).where("x < y").select("x", "y")


def similar_rows(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``(row_id_a, row_id_b)``, a < b: all pairs of similar rows, equal texts included."""
    ids = members.select("key", "row_id").distinct()
    left = ids.select(F.col("key").alias("a"), F.col("row_id").alias("x"))
    right = ids.select(F.col("key").alias("b"), F.col("row_id").alias("y"))
    across = linked.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    return across.unionByName(equal_rows(ids)).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(key, root)`` of every key that has an edge ``(a, b)``: the least key of its component.

    Every round links each key to the least key it can see and then jumps pointers, so long chains take a number of
    rounds that grows with the logarithm of their length.  Rounds end when nothing changes; only a count reaches the driver.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut_lineage(both.distinct())
    roots = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")))
    for _ in range(max_rounds):
        # hook: the root of a key is pulled down to the least root among its neighbours
        seen = both.join(roots.select(F.col("u").alias("v"), F.col("root").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("seen"))
        pulled = roots.join(seen, "u").select("u", "root", F.least("root", "seen").alias("low"))
        hooks = pulled.groupBy(F.col("root").alias("u")).agg(F.min("low").alias("hook"))
        merged = pulled.join(hooks, "u", "left").select("u", F.least("low", F.coalesce("hook", "low")).alias("root"))
        jump = merged.select(F.col("u").alias("root"), F.col("root").alias("next"))
        step = merged.join(jump, "root", "left").select("u", F.least("root", F.coalesce("next", "root")).alias("root"))
        step = cut_lineage(step)
        changed = step.join(roots.withColumnRenamed("root", "old"), "u").where("root <> old").limit(1).count()
        roots = step
        if not changed:
            return roots.select(F.col("u").alias("key"), "root")
    raise RuntimeError("components did not settle")


def groups(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``(row_id, group_id, links)``: one row per input row with the least row id of its class and its distinct partners.

    links counts the distinct normal forms that the row's text is linked with.
    """
    ids = members.select("key", "row_id").distinct()
    edges = linked.select("a", "b")
    degree = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    placed = ids.join(components(edges), "key", "left").join(degree, "key", "left")
    placed = placed.withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("row_id").alias("group_id"))
    return placed.join(least, "root").select("row_id", "group_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def spoken_members(rows: DataFrame, id_col: str = "row_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """Members of the spoken texts of chat rows."""
    return members_of(rows, id_col, spoken_text("messages"), min_chars)
