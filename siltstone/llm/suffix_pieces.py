"""Operator 6, SentencePiece encoding and decoding by suffix-array matching.

The batch's different chunks (a run of spaces and the word after it; no piece of the vocabulary spans two of them) are
concatenated into one text, whose suffixes are sorted. A binary search for every piece of the vocabulary gives the range of
suffixes that start with it, so all its occurrences. These are the edges of a lattice over the text; they are sorted by
position and then relaxed. The model's kind decides how: the given model is BPE, where the best segmentation is not a
shortest path but the result of merging neighbours in the order of piece scores, so relaxing an edge means joining the two
symbols it covers, the best-scored edge of a chunk first, the leftmost on ties. Long chunks do the same from a heap.
Characters that no piece covers become byte pieces, or the unknown id where the model has none.

Defined results: null text is the empty text, with no ids; texts of any length are read whole, in blocks of chunks, so the
index stays bounded by the longest chunk: a chunk is merged whole, and one without any space takes about 200 bytes a character; decoding gives the normalised text, which is the text itself for a model without normalisation;
repeated rows each get a row; an empty table gives no rows; other columns pass through as they are, and outputs whose names
the input has get free ones (see ``common.free``).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free, table

SPACE, STOP, CHARS, LONG, KNOWN = "▁", "\x00", 150_000, 48, 700_000
_NONE = np.int32(2**31 - 1)
_coders: dict[str, SuffixCoder] = {}


def suffix_ranges(text: str, pieces: np.ndarray, tops: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of ``text`` to a depth of ``width`` characters, and for each piece the range of it where suffixes
    start with the piece, that is, lie from it to its entry of ``tops``."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    padded = np.concatenate([codes, np.zeros(width, "<u4")])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)]
    suffixes = np.ascontiguousarray(windows).view(f"<U{width}").ravel()
    order = np.argsort(suffixes, kind="stable")
    ranked = suffixes[order]
    return order, np.searchsorted(ranked, pieces, "left"), np.searchsorted(ranked, tops, "right")


class SuffixCoder:
    def __init__(self, path: str, limit: int = KNOWN):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.unknown, self.limit = model.unk_id(), limit
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = {i: r for r, i in enumerate(by_score)}
        self.ids = np.array(sorted(plain, key=lambda i: self.names[i]))
        self.pieces = np.array([self.names[i] for i in self.ids])
        self.ranks = np.array([self.rank[i] for i in self.ids], np.int32)
        self.by_rank = np.array(by_score)
        self.width = max(map(len, self.pieces))
        self.lengths = np.char.str_len(self.pieces)
        self.tops = np.char.add(self.pieces, "\U0010ffff").astype(f"<U{self.width + 1}")
        self.raw = [self._piece(i) for i in range(n)]
        self.spans = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        #: The ids of each chunk met, as little-endian 32-bit integers, so those of a text are joined by one copy.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> SuffixCoder:
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def chunks(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        return [marked] if self.spans and marked else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", marked)

    def edges(self, text: str) -> np.ndarray:
        """table[start, length]: the rank of the piece there; edges come from the suffix array, sorted by position."""
        order, low, high = suffix_ranges(text, self.pieces, self.tops, self.width)
        size = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(size)), size)
        start = order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        length = self.lengths[which]
        by = np.lexsort((length, start))
        out = np.full((len(text), self.width + 1), _NONE, np.int32)
        out[start[by], length[by]] = self.ranks[which[by]]
        return out

    def learn(self, chunks: list[str]) -> None:
        short = [c for c in chunks if len(c) <= LONG]
        block, size = [], 0
        for c in short:
            block.append(c)
            size += len(c) + 1
            if size > CHARS:
                self._merge_block(block)
                block, size = [], 0
        if block:
            self._merge_block(block)
        for c in chunks:
            if len(c) > LONG:
                self.known[c] = self._merge_long(c)

    def _merge_block(self, chunks: list[str]) -> None:
        text = STOP.join(chunks)
        best = self.edges(text)
        sizes = np.array([len(c) for c in chunks])
        begins = np.cumsum(sizes + 1) - sizes - 1
        start = np.arange(sizes.sum()) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
        end, chunk = start + 1, np.repeat(np.arange(len(chunks)), sizes)
        done: list[tuple[np.ndarray, ...]] = []
        while len(start):
            length = np.append(end[1:], 0) - start
            pair = np.append(chunk[1:] == chunk[:-1], False) & (length <= self.width)
            rank = np.where(pair, best[start, np.where(pair, length, 0)], _NONE).astype(np.int64)
            heads = np.nonzero(np.append(True, chunk[1:] != chunk[:-1]))[0]
            least = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), heads)
            live = (least >> 32) < _NONE
            where = np.repeat(live, np.diff(np.append(heads, len(start))))
            if not live.all():
                done.append((chunk[~where], start[~where], end[~where]))
            at = least[live] & 0xFFFFFFFF
            end[at] = end[at + 1]
            keep = where.copy()
            keep[at + 1] = False
            start, end, chunk = start[keep], end[keep], chunk[keep]
        chunk, start, end = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.lexsort((start, chunk))
        chunk, start, end = chunk[by], start[by], end[by]
        rank = np.where(end - start <= self.width, best[start, np.minimum(end - start, self.width)], _NONE)
        ids = np.where(rank < _NONE, self.by_rank[np.minimum(rank, len(self.by_rank) - 1)], -1)
        bounds = np.searchsorted(chunk, np.arange(len(chunks) + 1)).tolist()
        bad = set(chunk[ids < 0].tolist())
        ids = ids.astype("<i4")
        raw = ids.tobytes()
        for i, (c, a, b) in enumerate(zip(chunks, bounds, bounds[1:], strict=False)):
            self.known[c] = self._bytes(text, start[a:b], end[a:b], ids[a:b]) if i in bad else raw[4 * a : 4 * b]

    def _bytes(self, text: str, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> bytes:
        out: list[int] = []
        for a, b, i in zip(start, end, ids, strict=True):
            out += [int(i)] if i >= 0 else [self.bytes[x] for x in text[a:b].encode()] if self.bytes else [self.unknown]
        return np.array(out, "<i4").tobytes()

    def _merge_long(self, chunk: str) -> bytes:
        """One chunk of any length, in O(n log n) from a heap, block by block indexed."""
        parts = []
        for at in range(0, len(chunk), CHARS):
            parts.append(self.edges(chunk[at : at + CHARS + self.width])[:CHARS])
        best = np.concatenate(parts)
        n = len(chunk)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(a):
            b = end[a]
            if a >= 0 and b < n and end[b] - a <= self.width and (r := int(best[a, end[b] - a])) < _NONE:
                heapq.heappush(heap, (r, a, end[b]))

        for a in range(n - 1):
            push(a)
        while heap:
            _, a, e = heapq.heappop(heap)
            if not alive[a] or end[a] >= n or not alive[end[a]] or end[end[a]] != e:
                continue
            b = end[a]
            alive[b], end[a] = False, e
            if e < n:
                prev[e] = a
                push(a)
            if prev[a] >= 0:
                push(prev[a])
        start = np.array([a for a in range(n) if alive[a]])
        stop = np.array([end[a] for a in start])
        rank = best[start, np.minimum(stop - start, self.width)]
        return self._bytes(chunk, start, stop, np.where(rank < _NONE, self.by_rank[np.minimum(rank, len(self.by_rank) - 1)], -1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.chunks(t) for t in texts]
        here = set().union(*split)
        missing = here - self.known.keys()
        # Two generations of half the limit each: chunks still in use are carried over when the younger one is full.
        if len(self.known) + len(missing) > self.limit // 2:
            self.before, self.known, missing = self.known, {}, here
        self.known.update((c, self.before[c]) for c in missing & self.before.keys())
        missing -= self.known.keys()
        if missing:
            self.learn(sorted(missing))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, s)), "<i4") for s in split]

    def _piece(self, i: int) -> bytes:
        """What a piece stands for in a decoded text."""
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else self.names[i].replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, path: str, text: str = "text", step: int = 1024) -> DataFrame:
    """``docs`` with ``ids``."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = SuffixCoder.of(path)
        for batch in batches:
            yield pd.Series([x.astype(np.int32) for i in range(0, len(batch), step) for x in coder.encode([t or "" for t in batch.iloc[i : i + step]])], dtype=object)

    return docs.withColumn(free(docs, "ids"), run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = SuffixCoder.of(path)
        for batch in batches:
            yield pd.Series([coder.decode(np.asarray(x, np.int64)) if x is not None else "" for x in batch], dtype=object)

    return docs.withColumn(free(docs, "decoded"), run(F.col(ids)))


def digests(docs: DataFrame, path: str, text: str = "text", step: int = 1024) -> DataFrame:
    """``docs`` with ``n_ids``, ``ids_crc32`` (little-endian unsigned 32-bit ids) and ``round_trip`` (decoding gives the text)."""

    @F.pandas_udf("n_ids long, ids_crc32 long, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = SuffixCoder.of(path)
        for batch in batches:
            rows = []
            for i in range(0, len(batch), step):
                texts = [t or "" for t in batch.iloc[i : i + step]]
                rows += [(len(x), zlib.crc32(x.astype("<u4").tobytes()), coder.decode(x) == t) for t, x in zip(texts, coder.encode(texts), strict=True)]
            yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "round_trip"])

    return docs.withColumn("__d", run(F.col(text))).select(*docs.columns, *[F.col(f"__d.{n}").alias(free(docs, n)) for n in ("n_ids", "ids_crc32", "round_trip")])


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_bpe()).drop("text")


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
SQL: dict[str, str] = {}
