"""Operator 3, quality classifier: ordinal cumulative-link regression on graded ratings.

A document with labels has a grade: 0 low quality, 1 fluent but toxic, 2 good. Its text becomes a set of hashed features:
lower-case words without the punctuation around them, their stems (beginnings of STEMS letters, which also tell words never
seen), the kinds of symbols on words, and buckets of length, repeated words and repeated lines. All thresholds share one weight
vector w, P(grade > j) = sigmoid(w.x - b_j) with b_0 < b_1 kept ordered by fitting b_0 and the logarithms of the gaps. It is
fitted in numpy (Adam, L1: few words tell a grade and most tell nothing) on at most SAMPLE labelled rows a grade, picked by
hash, on features that at least RARE of these rows have; scoring reads every whole text. ``expected_grade`` is sum P(grade > j), ``tail`` is P(grade >= top), and a
document is ``kept`` if the tail is at least ``least``.

Defined results: null, empty and blank texts have no words, only the bucket features; rows with a null or missing label are
not learned from; several labels of one document count with their lowest grade, and rows that share a doc_id are learned
from as one; without labels of two different grades every document has expected grade and tail null and is kept; repeated
rows each get a row; other columns pass through as they are, and outputs whose names the input has get free ones (see
``common.free``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, free, table

SIZE, SAMPLE, STEPS, LEAST, RARE = 1 << 18, 4000, 300, 0.5, 4
#: Lengths of the stems, and the factor of the L1 penalty.
STEMS, L1 = (5, 7), 0.15
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_SYMBOLS = frozenset("#*$%&|<>")
_places: dict[str, tuple[int, ...]] = {}


def _place(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode()) % SIZE


def _of(word: str) -> tuple[int, ...]:
    """Features of a lower-case word: itself without punctuation around it, its stems, and the kinds of symbols on it."""
    at = _places.get(word)
    if at is None:
        bare = word if word.isalnum() else _EDGE.sub("", word)
        found = [bare] if bare else []
        found += ["\x01" + bare[:n] for n in STEMS if len(bare) > n]
        if bare != word:
            found += ["\x00symbol" + c for c in _SYMBOLS.intersection(word)]
        if len(_places) > 250_000:
            _places.clear()
        at = _places[word] = tuple(_place(f) for f in found)
    return at


def _bucket(name: str, share: float) -> int:
    return _place(f"\x00{name}{next((i for i, x in enumerate((0.0, 0.02, 0.1, 0.2, 0.4, 0.7)) if share <= x), 6)}")


def features(text: str | None) -> list[int]:
    text = text or ""
    words = text.lower().split()
    kinds = set(words)
    found = set().union(*map(_of, kinds))
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    found.update((_bucket("symbols", sum(text.count(c) for c in _SYMBOLS) / n), _bucket("again", sum(a == b for a, b in zip(words, words[1:], strict=False)) / n)))
    found.update((_bucket("lines", 1 - len(set(lines)) / max(len(lines), 1)), _place(f"\x00length{len(words).bit_length()}"), _bucket("kinds", 1 - len(kinds) / n)))
    return sorted(found)


@dataclass
class Ordinal:
    w: np.ndarray
    b: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for every threshold j, falling in j."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.b, -40, 40)))

    def score(self, rows: list[list[int]]) -> np.ndarray:
        size = np.array([len(r) for r in rows])
        at = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
        return np.bincount(np.repeat(np.arange(len(rows)), size), self.w[at], len(rows))


def thresholds(t: np.ndarray) -> np.ndarray:
    """The first threshold, and the others by the logarithms of the gaps."""
    return t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])


def loss_and_gradient(w: np.ndarray, t: np.ndarray, at: np.ndarray, of: np.ndarray, grades: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log likelihood of grades, with l2 / 2 |w|^2, and its gradient in w and t; feature at[i] is in row of[i]."""
    n, top = len(grades), len(t)
    tail = Ordinal(w, thresholds(t)).tails(np.bincount(of, w[at], n))
    over = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
    i = np.arange(n)
    up, down = over[i, grades], over[i, grades + 1]
    p = np.maximum(up - down, 1e-12)
    slope = np.stack([up * (1 - up), down * (1 - down)], 1) * (weight / p)[:, None]
    gw = np.bincount(at, -(slope[:, 0] - slope[:, 1])[of], len(w)) + l2 * w
    gb = np.array([slope[grades == j + 1, 0].sum() - slope[grades == j, 1].sum() for j in range(top)])
    gt = np.array([gb.sum(), *(gb[j:].sum() * np.exp(t[j]) for j in range(1, top))])
    return float(-(weight * np.log(p)).sum() + l2 / 2 * (w @ w)), gw, gt


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, top: int, **settings) -> Ordinal:
    """``fit_flat`` on the feature lists of rows."""
    return fit_flat(np.concatenate([np.asarray(r, np.int32) for r in rows]), np.array([len(r) for r in rows]), grades, top, **settings)


def fit_flat(at: np.ndarray, size: np.ndarray, grades: np.ndarray, top: int, steps: int = STEPS, rate: float = 0.05, l1: float = L1, l2: float = 0.0, rare: int = RARE) -> Ordinal:
    """Full-batch Adam on the mean negative log likelihood, each grade weighted alike, with a proximal step for
    l1 / sqrt(rows) * |w|_1 in Adam's own scale; ``l2`` adds l2 / 2 |w|^2. ``at`` holds the features of row after row, size[i]
    of them in row i; the driver's memory is about 30 bytes for each."""
    often = np.bincount(at, minlength=SIZE) >= min(rare, len(size) // 20 + 1)
    used, index = np.flatnonzero(often), np.cumsum(often) - 1
    of = np.repeat(np.arange(len(size)), size)[often[at]]
    at, penalty = index[at[often[at]]], l1 / np.sqrt(len(size))
    weight = 1 / np.bincount(grades, minlength=top + 1)[grades] / len(np.unique(grades))
    w, t = np.zeros(len(used)), np.concatenate([[-1.0], np.zeros(top - 1)])
    m1, m2 = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1):
        _, gw, gt = loss_and_gradient(w, t, at, of, grades, weight, l2)
        for k, (x, g) in enumerate(((w, gw), (t, gt))):
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.001 * (g * g - m2[k])
            move = rate / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-9)
            x -= move * (m1[k] / (1 - 0.9**step))
            if k == 0:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - move * penalty, 0)
    full = np.zeros(SIZE)
    full[used] = w
    return Ordinal(full, thresholds(t))


def grades_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade): 0 if quality is 0, 1 if it is 1 and toxic is 1, 2 otherwise; the lowest of several."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, graded: DataFrame, text: str = "text", key: str = "doc_id", top: int = 2, sample: int = SAMPLE) -> Ordinal | None:
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(int(min(1.0, sample / n) * (1 << 24))))])
    picked = cut(graded.where(F.pmod(F.xxhash64(key), F.lit(1 << 24)) < share[F.col("grade")]).select(key, "grade"), "graded-sample")
    # About ``sample`` keys a grade, whatever the size of the tables; where that holds, no text is shuffled to meet its label.
    small = F.broadcast(picked) if picked.count() <= 2 * sample * len(counts) else picked
    read = F.pandas_udf(lambda t: pd.Series([features(x) for x in t]), "array<int>")
    # Rows that share a key are one example, the least list of features, joined in each task before it leaves it.
    read_rows = docs.select(key, text).join(small, key).select(key, "grade", read(F.col(text)).alias("x"))
    rows = read_rows.groupBy(key, "grade").agg(F.min("x").alias("x")).toArrow().sort_by(key)
    grades, x = rows["grade"].to_numpy().astype(np.int64), rows["x"].combine_chunks()
    if len(np.unique(grades)) < 2:
        return None
    return fit_flat(x.flatten().to_numpy(), x.value_lengths().to_numpy(), grades, top)


def classify(docs: DataFrame, model: Ordinal | None, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail`` and ``kept``."""
    names = [free(docs, n) for n in ("expected_grade", "tail", "kept")]
    if model is None:
        return docs.withColumns(dict(zip(names, (F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True)), strict=True)))

    @F.pandas_udf("expected double, tail double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tails = model.tails(model.score([features(t) for t in batch]))
            yield pd.DataFrame({"expected": tails.sum(1), "tail": tails[:, -1]})

    out = docs.withColumn("__p", predict(F.col(text)))
    return out.withColumns(dict(zip(names, (F.col("__p.expected"), F.col("__p.tail"), F.col("__p.tail") >= least), strict=True))).drop("__p")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs, grades_of(table(spark, sf_dir, "labels")))).drop("text")


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
SQL: dict[str, str] = {}
