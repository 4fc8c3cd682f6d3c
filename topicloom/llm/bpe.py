"""Byte-level BPE with a public vocabulary: a backtracking encoder and a table decoder."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern the public vocabulary splits text by before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A worker remembers the ids of so many pieces of at most so many bytes; beyond, it encodes anew.
REMEMBERED, REMEMBERED_BYTES = 150_000, 48
#: Texts encoded before a result batch is handed on are about so many characters.
BATCH_CHARS = 4_000_000


class Bpe:
    """Encoder and decoder of one vocabulary, given as rank lines (base64 token, rank).

    A token's rank is its id, and merges apply in order of rank. Encoding walks a piece from left to
    right, trying the longest token first; all matches of a piece come from one Aho-Corasick pass.
    Two neighbours are compatible if merging their joint bytes would leave the boundary between them
    alone. That is decided by undoing merges from the boundary outwards, and remembered. A token that
    fits no way is given up together with the one before it, and the position is marked as dead, so
    every position is visited at most once per token length: linear time, and exact merges.
    """

    def __init__(self, lines: bytes) -> None:
        import ahocorasick
        import regex

        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines.splitlines() if line.strip()))
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.tokens = [t.decode("latin-1") for _, t in ranked]  # a character for each byte
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = [len(t) for t in self.tokens]
        self.split = regex.compile(SPLIT).findall
        self.finder = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.finder.add_word(t, i)
        self.finder.make_automaton()
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        self.compatible: dict[tuple[int, int], bool] = {}
        for i in range(len(self.tokens)):
            self.parts.append(self._parts(i))
        self.compatible.clear()  # they were decided with part of the merges
        self.remembered: dict[str, list[int]] = {}
        self.bytes = np.frombuffer("".join(self.tokens).encode("latin-1"), np.uint8)
        self.offsets = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)

    def _prefix(self, token: str) -> int:
        """The longest token that is a proper prefix; -1 if there is none."""
        return next((i for end in range(len(token) - 1, 0, -1) if (i := self.ids.get(token[:end])) is not None), -1)

    def _parts(self, i: int) -> tuple[int, int]:
        """The two tokens that merge into i; (i, i) for a single byte."""
        token, left = self.tokens[i], self.shorter[i]
        while left >= 0:
            right = self.ids.get(token[self.sizes[left] :], i)
            if left < i and right < i and self._undo(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _undo(self, left: int, right: int) -> bool:
        """Whether the boundary survives the merges of its two sides."""
        merged, parts = self.merged, self.parts
        bound = len(self.tokens)  # merges from here on come too late to cross the boundary
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            # undo the later merge of the two sides; when one is a single byte, the other's
            if left > right:
                bound, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                bound, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                bound, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def _fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self._undo(left, right)
        return known

    def piece(self, raw: str) -> list[int]:
        """Ids of one piece, given with a character for each byte."""
        whole = self.ids.get(raw)
        if whole is not None:
            return [whole]
        sizes, shorter = self.sizes, self.shorter
        longest = [-1] * (len(raw) + 1)  # by start
        for end, i in self.finder.iter(raw):
            start = end + 1 - sizes[i]
            if longest[start] < 0 or sizes[longest[start]] < sizes[i]:
                longest[start] = i
        alive = bytearray(b"\1") * (len(raw) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(raw):
            while token >= 0 and not (alive[at + sizes[token]] and (not out or self._fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at]
            else:
                alive[at] = 0
                given_up = out.pop()
                at -= sizes[given_up]
                token = given_up  # its end is dead now, so a shorter one follows
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.remembered, []
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(p) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Joined token bytes, looked up in one array through its table of offsets."""
        ids = np.asarray(ids, np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
        return self.bytes[places].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[int, Bpe] = {}


def _bpe(lines: bytes) -> Bpe:
    """One per worker process, built when first needed."""
    key = hash(lines)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(lines)
    return _loaded[key]


def _text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about BATCH_CHARS, so that long texts make small batches."""
    size = np.cumsum(batch.column(1).fill_null("").to_pandas().str.len().to_numpy()) if batch.num_rows else np.zeros(0)
    cuts = np.r_[0, np.flatnonzero(np.diff(size // BATCH_CHARS)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _shared_lines(df: DataFrame, vocabulary: str):
    """The vocabulary file, read by the driver and broadcast (1 MB, fixed), so that executors need
    no copy of it."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>): each row with the token ids of its whole text, without special
    tokens; text that looks like one is plain text. Null and empty texts have an empty list. Rows
    are kept as they are, repeated and null ids included; other columns are not read. No shuffle.
    """
    lines = _shared_lines(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(lines.value)
        for batch in batches:
            for part in _text_slices(batch):
                ids = [bpe.encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], [id_col, "ids"])

    rows = df.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], *, text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, as_col: str = "n_tokens") -> DataFrame:
    """The columns of keep and as_col bigint: the number of tokens of the text; 0 if null or empty."""
    lines = _shared_lines(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(lines.value)
        for batch in batches:
            counts = [len(bpe.encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*keep, as_col])

    rows = df.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{schema}, {as_col} long")


def decode(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, text): the text of each row's ids; null ids give null, an empty list the empty text.
    Bytes that are no UTF-8 (ids cut within a character) become U+FFFD."""
    lines = _shared_lines(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(lines.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    rows = df.select(F.col(id_col), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")
