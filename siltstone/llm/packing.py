"""Operator 2, packing into sequences by vector best-fit.

A document becomes pieces of at most ``tokens`` ids; only longer documents are cut. A sequence has three capacities:
tokens, documents (pieces) and attention cost (the sum of squared lengths). Pieces go longest first, each to the open
sequence that has room in all three and the least weighted residual norm after it (or the least weighted dot-product of
need and residual). Pieces of one length are alike, so the choice is made on the driver for counts by length, at most
``tokens`` rows: sequences in the same state form a range of numbers, and a step fills many at once with the same
outcome as one by one. The plan (a few intervals of ranks a length, bounded by the capacity, not by the data) goes to the
executors, where every piece finds its place by its rank within its length. Ranks come from counts by (length, salt), so
a length that a third of all pieces have is spread over as many tasks as there are salts.

Defined results: null text is the empty text, a piece with the end id alone; repeated rows are packed once each; rows with
a null doc_id are packed too; an empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, shuffle_partitions, table

TOKENS, END, KNOWN = 4096, 1, 400_000
WEIGHTS = (1.0, 1e-3, 1e-3)
_encoders: dict[str, WordEncoder] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level characters, by the public rule: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Words of these characters alone are the same after NFC, hold no white space, and lower-case letter by letter.
_EASY = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The split of the tokenizer for such words in lower case (ª, º, µ, × and ÷ are not among them).
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\na-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Ids of texts by a BPE tokenizer with word ends whose tokens never span white space, encoding each different word
    once while known.

    Common words go in one text through the byte-pair core of tiktoken: U+0001 stands for the word end, and its merge with
    any byte comes first, as in the tokenizer's alphabet. The rest go through the tokenizer itself, and so do whole texts
    that may hold special tokens. At most ``limit`` words are known at a time.
    """

    def __init__(self, path: str, limit: int = KNOWN):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        byte, ranks = _byte_of(), {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>")
            if all(c in byte for c in body):
                ranks[bytes(byte[c] for c in body) + (b"\x01" if body != token else b"")] = i
        self.core = tiktoken.Encoding("words", pat_str=r"[^\x01\n]+\x01|\n", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, words: set[bytes]) -> None:
        easy, hard = [], []
        for w in words:
            (easy if _EASY.fullmatch(t := w.decode()) else hard).append(t)
        marked = _SPLIT.sub("\\g<0>\x01", "\n".join(easy).lower())
        ids = np.array(self.core.encode_ordinary(marked), np.uint32)
        ends = np.append(np.nonzero(ids == self.line)[0], len(ids))
        flat = ids[ids != self.line]
        size = np.diff(ends, prepend=-1) - 1 if easy else np.zeros(0, np.int64)
        self.add([t.encode() for t in easy], size, flat)
        if hard:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)]
            self.add([t.encode() for t in hard], np.array([len(x) for x in found]), np.fromiter(chain.from_iterable(found), np.uint32))

    def add(self, words: list[bytes], size: np.ndarray, flat: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [None if "<|" in t else t.encode().lower().split() for t in texts]
        new = set(chain.from_iterable(w for w in words if w)).difference(self.known)
        if len(self.known) + len(new) > self.limit and self.known:
            self.clear()
            new = set(chain.from_iterable(w for w in words if w))
        if new:
            self.learn(new)
        out = []
        for text, own in zip(texts, words, strict=True):
            if own is None:
                out.append(self.whole(text))
                continue
            i = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            size = self.size[i]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.at[i] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])
        return out


def token_pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokens: int = TOKENS, end: int = END, ids: bool = False, step: int = 256) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document, with ``row``, a number of the document. Only the text
    goes through Python, so keys of any type stay as they are."""

    @F.pandas_udf("length array<long>, ids_crc32 array<long>" + (", ids array<array<int>>" if ids else ""))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            out: dict[str, list] = {"length": [], "ids_crc32": []} | ({"ids": []} if ids else {})
            for at in range(0, len(batch), step):
                for found in encoder.encode([t or "" for t in batch.iloc[at : at + step]]):
                    found = np.append(found, np.uint32(end)).astype("<u4")
                    pieces = [found[i : i + tokens] for i in range(0, len(found), tokens)]
                    out["length"].append([len(p) for p in pieces])
                    out["ids_crc32"].append([zlib.crc32(p) for p in pieces])
                    if ids:
                        out["ids"].append([p.astype(np.int32) for p in pieces])
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in out.items()})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("__key"), run(F.col(text)).alias("__p"))
    rows = rows.select("row", "__key", F.posexplode(F.arrays_zip(*[f"__p.{n}" for n in ("length", "ids_crc32", *(["ids"] if ids else []))])).alias("piece", "p"))
    start = (F.col("piece") * F.lit(tokens).cast("long")).alias("start")
    return rows.select("row", F.col("__key").alias(key), "piece", start, "p.length", "p.ids_crc32", *(["p.ids"] if ids else []))


def plan(counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights: tuple = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces a sequence, offset), sorted, and the number of sequences, for
    ``counts`` pieces by length. ``cost`` and ``documents`` default to what ``tokens`` already implies."""
    room = np.array([tokens, documents or tokens, cost or tokens * tokens], np.float64)
    weight = np.array(weights)
    left, first, size, used, rows, opened = np.zeros((64, 3)), np.zeros(64, np.int64), np.zeros(64, np.int64), 0, [], 0

    def add(state, lo, n):
        nonlocal left, first, size, used
        if n <= 0:
            return
        free = np.nonzero(size[:used] == 0)[0]
        i = int(free[0]) if len(free) else used
        if i == len(size):
            left, first, size = np.concatenate([left, np.zeros_like(left)]), np.concatenate([first, np.zeros_like(first)]), np.concatenate([size, np.zeros_like(size)])
        used = max(used, i + 1)
        left[i], first[i], size[i] = state, lo, n

    for length in sorted(counts, reverse=True):
        need, todo, rank = np.array([length, 1, length * length], np.float64), counts[length], 0
        if (need > room).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            fits = (left[:used] >= need).all(1) & (size[:used] > 0)
            if fits.any():
                at = np.nonzero(fits)[0]
                score = (((left[at] - need) / room) ** 2 @ weight) if rule == "norm" else (left[at] * need / room**2) @ weight
                i = int(at[np.lexsort((first[at], score))[0]])
                state, lo, n = left[i].copy(), int(first[i]), int(size[i])
                size[i] = 0
            else:
                state, lo = room.copy(), opened
                n = -(-todo // int((room // need).min()))
                opened += n
            each = int((state // need).min())
            full = min(n, todo // each)
            rest = min(todo - full * each, each) if full < n else 0
            rows.append((length, rank, lo, each, int(room[0] - state[0])))
            rank, todo = rank + full * each + rest, todo - full * each - rest
            add(state - need * each, lo, full)
            if rest:
                add(state - need * rest, lo + full, 1)
            add(state, lo + full + bool(rest), n - full - bool(rest))
    return np.array(sorted(rows), np.int64).reshape(-1, 5), opened


def ranks(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0, within their length."""
    salts = max(64, shuffle_partitions(pieces.sparkSession))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = cut(counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base")), "piece-counts")
    own = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")))
    return own.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("salt", "own", "base")


def best_fit(pieces: DataFrame, tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights: tuple = WEIGHTS, rule: str = "norm") -> DataFrame:
    """``pieces`` (``row``, ``piece`` and ``length`` among their columns) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps, _ = plan(counts, tokens, documents, cost, weights, rule)
    keys = steps[:, 0] * (1 << 40) + steps[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = steps[np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1]
        nth = rank - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 2] + nth // s[:, 3], "offset": s[:, 4] + nth % s[:, 3] * length})

    return ranks(pieces).withColumn("__place", place("length", "rank")).select(*pieces.columns, "__place.*")


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokens: int = TOKENS, ids: bool = False, **capacities) -> DataFrame:
    pieces = cut(token_pieces(docs, path, text, key, tokens, ids=ids), "pieces")
    return best_fit(pieces, tokens, **capacities).drop("row")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
SQL: dict[str, str] = {}
