"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: per-prefix dynamic programming.  For every prefix of a piece the *last* token of its encoding is unique.
An automaton over the vocabulary reports every token that ends at a position; the one whose predecessor (the last
token of the shorter prefix) stays apart from it under the merge rules is stored, and following those back-pointers
gives the exact ids.  The work is linear in the piece, so a run of a megabyte without a space is no special case.

The stage is one narrow ``mapInArrow``: no shuffle, no driver state.  Each Python worker builds the automaton once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.session import spread

#: Fixed value: the split pattern that belongs to the rank files (published with the vocabulary).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary files lie; a parameter of every function below.
DEFAULT_VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

#: Pieces kept per worker.  A full memory is emptied; results do not depend on it.
MEMORY = 200_000


class PrefixEncoder:
    """Exact byte-level BPE by per-prefix dynamic programming."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {r: None for t, r in ranks.items() if len(t) == 1}
        self.edges: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        self.apart_memory: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        encoder = self

        class Memory(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = encoder.encode_bytes(piece.encode("utf-8"))
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.memory = Memory()

    @classmethod
    def load(cls, path: str, pattern: str = SPLIT_PATTERN) -> PrefixEncoder:
        ranks = {}
        with open(path, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.parts:
            units = [bytes([b]) for b in self.bytes_of[token]]
            while len(units) > 2:
                _, at = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(units, units[1:])))
                units[at : at + 2] = [units[at] + units[at + 1]]
            self.parts[token] = (self.ranks[units[0]], self.ranks[units[1]])
        return self.parts[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(piece, birth, death) of the pieces that stand at one edge of ``token`` while it is being merged.

        Kept for each token: bounded by twice the vocabulary.
        """
        if (token, side) not in self.edges:
            self.edges[token, side] = self._edge(token, side)
        return self.edges[token, side]

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        out, death = [], float("inf")
        while True:
            halves = self.halves(token)
            birth = token if halves else -1
            out.append((token, birth, death))
            if not halves:
                return out
            token, death = halves[side], birth

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens.

        A crossing merge fires if its rank comes before either border piece is swallowed by its own token; at
        equal rank the leftmost pair goes first.  Border pieces are visited backwards in time.
        """
        a, b, i, j, answer = self.edge(left, 1), self.edge(right, 0), 0, 0, True
        while True:
            (x, x_birth, x_death), (y, y_birth, y_death) = a[i], b[j]
            crossing = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if crossing is not None and crossing < x_death and crossing <= y_death:
                answer = False
                break
            if x_birth < 0 and y_birth < 0:
                break
            if x_birth > y_birth:
                i += 1
            else:
                j += 1
        if len(self.apart_memory) > 4 * MEMORY:
            self.apart_memory.clear()
        self.apart_memory[left, right] = answer
        return answer

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:  # the last token of the longest prefix is the piece itself
            return (whole,)
        last, known = [-1] * (len(piece) + 1), self.apart_memory.get
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - length
                if before == 0:
                    last[end] = token
                else:
                    pair = (last[before], token)
                    apart = known(pair)
                    if self.apart(*pair) if apart is None else apart:
                        last[end] = token
        ids, at = [], len(piece)
        while at > 0:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; empty for an empty and for a null text."""
        if not text:
            return np.empty(0, np.int32)
        if len(self.memory) > MEMORY:
            self.memory.clear()
        return np.fromiter(chain.from_iterable(map(self.memory.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", errors="replace")


_LOADED: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY, pattern: str = SPLIT_PATTERN) -> PrefixEncoder:
    """The encoder of this process, built on first use."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = PrefixEncoder.load(path, pattern)
    return _LOADED[path, pattern]


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    pattern: str = SPLIT_PATTERN,
) -> DataFrame:
    """``(id_col, ids)``: the token ids of every row, without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text; repeated and
    null row ids pass through, one output row for each input row; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shipped = os.path.isfile(vocabulary)
    if shipped:  # the executors get the driver's file; a path that only they know is read where it is
        docs.sparkSession.sparkContext.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        model = encoder(SparkFiles.get(os.path.basename(vocabulary)) if shipped else vocabulary, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [model.encode(text) for text in part.column(1).to_pylist()]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
