"""Operator 4, language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in segments of SEGMENT positions from both ends, h += z * (c - h) with a gate z and a
candidate c that see the byte and the last state. Every position gets a softmax over the learned languages; a document's
probabilities are the mean over all its positions. It is trained in numpy by backpropagation through time (Adam) on at
most SAMPLE excerpts of EXCERPT characters a language and TOTAL in all (but one a language), picked by hash among the
documents that may be learned from; every language they have is learned. Only the training set is bounded; prediction reads
every byte of every text.

Defined results: null text, empty text and text without a letter are ``und`` with score 0; without any labelled document
everything is ``und``; rows with a null doc_id are not held out and not learned from; repeated rows each get a row; long
texts are cut into segments of a block, so memory does not grow with their length. All input columns pass through as they
are; outputs whose names the input has get free ones (see ``common.free``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free, table

HIDDEN, SEGMENT, BLOCK = 12, 96, 1024
SAMPLE, TOTAL, EXCERPT, STEPS, BATCH = 500, 100_000, 480, 260, 128


@dataclass
class Network:
    """E: byte to gate and candidate inputs, by direction; U: state to the same; V, c: both states to the languages."""

    langs: list[str]
    E: np.ndarray
    U: np.ndarray
    V: np.ndarray
    c: np.ndarray

    def states(self, x: np.ndarray, keep: bool = False):
        """x: (positions, segments) bytes. Both directions' states at each position; with ``keep`` what training needs."""
        steps, n = x.shape
        H = self.U.shape[1]
        kind = self.U.dtype
        out = np.empty((2, steps, n, H), kind)
        acts = np.empty((2, steps, n, 2 * H), kind) if keep else None
        h = np.zeros((2, n, H), kind)
        a = np.empty((2, n, 2 * H), kind)
        for t in range(steps):
            np.matmul(h, self.U, out=a)
            a[0] += self.E[0].take(x[t], axis=0)
            a[1] += self.E[1].take(x[steps - 1 - t], axis=0)
            np.tanh(a, out=a)
            if keep:
                acts[:, t] = a
            z = a[..., :H] * 0.5
            z += 0.5
            d = a[..., H:] - h
            d *= z
            h += d
            out[0, t], out[1, steps - 1 - t] = h[0], h[1]
        return (out, acts) if keep else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(languages, positions * segments). States lie in (-1, 1), so logits are bounded and exp cannot overflow."""
        s, H = self.states(x), self.U.shape[1]
        p = self.V[:H].T @ s[0].reshape(-1, H).T
        p += self.V[H:].T @ s[1].reshape(-1, H).T
        p += (self.c - np.abs(self.V).sum(0).max())[:, None]
        np.exp(p, out=p)
        p /= p.sum(0)
        return p

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities and shares of position labels, (documents, languages)."""
        k, lengths = len(self.langs), np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)
        begins = np.cumsum(lengths) - lengths
        counts = -(-lengths // SEGMENT)
        total, labels = np.zeros((len(texts), k)), np.zeros((len(texts), k))
        doc = np.repeat(np.arange(len(texts)), counts)
        part = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * SEGMENT
        place = np.arange(SEGMENT)[:, None]
        block = max(1, min(BLOCK, (1 << 23) // (SEGMENT * k)))
        for i in range(0, len(doc), block):
            d, s = doc[i : i + block], part[i : i + block]
            inside = place < (lengths[d] - s)
            p = self.probabilities(np.where(inside, flat[begins[d] + s + place], 0)).reshape(k, SEGMENT, len(d))
            p *= inside
            best = (p == p.max(0)) & inside
            np.add.at(total, d, p.sum(1, dtype=np.float32).T.astype(np.float64))
            np.add.at(labels, d, best.sum(1).T)
        n = np.maximum(lengths, 1)[:, None]
        return total / n, labels / n


def loss_and_gradient(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of ``x`` (positions, texts), and its gradient by backpropagation through time."""
    T, batch = x.shape
    H = net.U.shape[1]
    s, acts = net.states(x, keep=True)
    p = s[0] @ net.V[:H] + s[1] @ net.V[H:] + net.c
    p = np.exp(p - p.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    loss = float(-np.log(np.maximum(p[:, np.arange(batch), label], 1e-30)).mean())
    p[:, np.arange(batch), label] -= 1
    p /= T * batch
    grad = {"c": p.sum((0, 1)), "V": np.concatenate([np.tensordot(s[d], p, ([0, 1], [0, 1])) for d in (0, 1)]), "E": np.zeros_like(net.E), "U": np.zeros_like(net.U)}
    for d in (0, 1):
        own, dout = (s[d], p @ net.V[:H].T) if d == 0 else (s[d][::-1], (p @ net.V[H:].T)[::-1])
        bytes_ = x if d == 0 else x[::-1]
        dh = np.zeros((batch, H), s.dtype)
        for t in range(T - 1, -1, -1):
            before = own[t - 1] if t else np.zeros((batch, H), s.dtype)
            g, c = acts[d, t, :, :H], acts[d, t, :, H:]
            z = 0.5 * g + 0.5
            dh = dh + dout[t]
            da = np.concatenate([dh * (c - before) * 0.5 * (1 - g * g), dh * z * (1 - c * c)], 1)
            grad["U"][d] += before.T @ da
            np.add.at(grad["E"][d], bytes_[t], da)
            dh = dh * (1 - z) + da @ net.U[d].T
    return loss, grad


def train(texts: list[bytes], marks: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    H, k = HIDDEN, len(langs)
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    net = Network(langs, f(2, 256, 2 * H, scale=0.3), f(2, H, 2 * H, scale=0.3), f(2 * H, k, scale=0.1), np.zeros(k, np.float32))
    net.E[:, 0, :H] = -30  # byte 0, which also fills segments, shuts the gate: the state stays as it is
    names = ("E", "U", "V", "c")
    m1, m2 = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    by = [np.nonzero(marks == i)[0] for i in range(k)]
    T = 64
    for step in range(1, steps + 1):
        label = rng.integers(0, k, BATCH)
        x = np.zeros((BATCH, T), np.uint8)
        for row, lang in enumerate(label):
            t = texts[by[lang][rng.integers(len(by[lang]))]]
            at = rng.integers(max(1, len(t) - T + 1))
            piece = t[at : at + T]
            x[row, : len(piece)] = np.frombuffer(piece, np.uint8)
        _, grad = loss_and_gradient(net, np.ascontiguousarray(x.T), label)
        rate = 0.02 * min(1.0, 2 * (steps - step + 1) / steps)
        for n in names:
            m1[n] += 0.1 * (grad[n] - m1[n])
            m2[n] += 0.01 * (grad[n] ** 2 - m2[n])
            setattr(net, n, (getattr(net, n) - rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return net


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Network | None:
    """The network, from rows that are not held out; None if no such row has a language and a letter."""
    open_ = docs.where(F.col(key).isNotNull() & ~held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    counts = open_.groupBy("lang").count().collect()
    if not counts:
        return None
    sample = max(1, min(sample, TOTAL // len(counts)))
    langs = sorted(r["lang"] for r in counts)
    # Small counts are kept whole, so that no language is missed by chance.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, (2 * sample + 32) / r["count"]) * (1 << 24))))])
    h = F.xxhash64(F.col("k"))
    # Twice as many as needed are expected; the driver drops the rest. An excerpt's place in its text comes from the hash.
    excerpt = F.substring("t", (F.lit(1) + F.pmod(F.shiftright(h, 24), F.greatest(F.length("t") - EXCERPT, F.lit(1)).cast("long"))).cast("int"), F.lit(EXCERPT))
    rows = open_.where(F.pmod(h, F.lit(1 << 24)) < share[F.col("lang")]).select("lang", h.alias("h"), excerpt.alias("t")).toPandas()
    if not len(rows):
        rows = open_.select("lang", h.alias("h"), excerpt.alias("t")).limit(sample).toPandas()
    rows = rows.sort_values(["lang", "h", "t"]).groupby("lang").head(sample)
    langs = [x for x in langs if x in set(rows["lang"])]
    return train([t.encode() for t in rows["t"]], np.array([langs.index(x) for x in rows["lang"]]), langs)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its pooled probability) and ``lang_shares`` (language: share of positions with its label)."""
    names = [free(docs, n) for n in ("lang_pred", "score", "lang_shares")]
    if net is None:
        return docs.withColumns(dict(zip(names, (F.lit("und"), F.lit(0.0), F.create_map().cast("map<string,double>")), strict=True)))

    @F.pandas_udf("lang string, score double, shares array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mean, labels = net.documents([(t or "").encode() for t in batch])
            best = mean.argmax(1)
            yield pd.DataFrame({"lang": [net.langs[i] for i in best], "score": np.clip(mean[np.arange(len(best)), best], 0, 1), "shares": list(labels)})

    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # The text is nulled where no prediction is due; the network then has nothing to read.
    out = docs.withColumn("__p", predict(F.when(has, F.col(text))))
    shares = F.when(has, F.map_from_arrays(F.array(*map(F.lit, net.langs)), F.col("__p.shares"))).otherwise(F.create_map().cast("map<string,double>"))
    found = (F.when(has, F.col("__p.lang")).otherwise("und"), F.when(has, F.col("__p.score")).otherwise(0.0), shares)
    return out.withColumns(dict(zip(names, found, strict=True))).drop("__p")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
