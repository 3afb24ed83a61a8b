"""Operator 8, exact top-k inner products by a pivot-distance index.

Vectors become integers, floor(scale * x). Equal vectors are one point that carries its smallest ids, with repeats, as many
as any answer can hold. Every point is keyed by its nearest pivot and its distance to it; quantiles of the sampled distances
cut each pivot's points into annuli, and (pivot, annulus) is a shard, split further by hash where the table is large. The
shard keeps the interval [r0, r1] of its points' distances to every pivot. For a query at distances d from the pivots, a
point x of the shard has |q - x| >= gap, the largest distance of a d from its interval, so
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + N - gap^2) / 2 with N the largest squared norm there. A query first
visits the shards with the highest bounds, then expands to the others and stops at those whose bound is below its last
wanted score so far. Queries travel in blocks of rows to the shards that any of them has to visit. Pivots and cuts come from
a bounded sample; they set the speed only. Vectors without any cluster, such as random ones, leave no bound that prunes: the
search is then a blocked product of all queries and points, still exact.

Defined results: vectors that are null, hold null or non-finite components (also after scaling), have no id, or have another
length than ``dim`` (default: the most frequent length, the larger on ties) take no part; repeated rows are candidates as
often as they occur, rows that share the query's id never; repeated query rows with equal vectors are one query, with
different vectors one query each; scores beyond 64 bits count as the nearest 64-bit number; ties go to the smaller id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, shuffle_partitions, table

SCALE, K, EVERY = 256, 5, 50
PIVOTS, RINGS, SAMPLE, ROWS, LEAST_ROWS, FIRST, ASKED = 32, 16, 20_000, 20_000, 1000, 2, 256
_FOUND = "query long, score long, id long"


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE, dim: int | None = None) -> DataFrame:
    """(id, v, n): vectors of integers, held as doubles, that occur n times with an id."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * F.lit(float(scale)))
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Doubles from 2**53 on have no fraction.
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v))
    rows = rows.where(fine).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    if dim is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
        dim = most["d"] if most else 0
    return rows.where(F.size("v") == dim).groupBy("id", "v").agg(F.count("*").alias("n"))


def pivots_of(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Means of a few Lloyd rounds from random starting points."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:pivots]].astype(np.float64)
    for _ in range(rounds):
        near = ((sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)).argmin(1)
        centres = np.array([sample[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)), 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact: in doubles where no sum can pass 2**53, else in Python's integers, cut to 64 bits."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(q: np.ndarray, x: np.ndarray, ids: list, k: int, wanted: np.ndarray | None = None, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, score, id) of the k best ids of each query, ties to the smaller id, without scores under ``wanted``."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, begin = np.concatenate(ids).astype(np.int64), np.cumsum(size) - size
    out = []
    for at in range(0, len(q), block):
        s = products(q[at : at + block], x)
        least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k] if s.shape[1] > k else s.min(1)
        if wanted is not None:
            least = np.maximum(least, wanted[at : at + block])
        row, point = np.nonzero(s >= least[:, None])
        score, n = s[row, point], size[point]
        i = flat[np.repeat(begin[point] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        row, score = np.repeat(row, n), np.repeat(score, n)
        by = np.lexsort((i, -score.astype(np.float64) if np.abs(score).max(initial=0) < 2**53 else ~score, row))
        row, score, i = row[by], score[by], i[by]
        first = np.searchsorted(row, row, "left")
        keep = np.arange(len(row)) - first < k
        out.append((at + row[keep], score[keep], i[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def search(points: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE, rows: int = ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(query, score, id): the k best ids for each query vector. points: v, ids (sorted); queries: query, v."""
    n = points.count()
    share = min(1.0, sample / max(n, 1))
    picked = points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").toPandas()["v"]
    if n and not len(picked):
        picked = points.limit(sample).select("v").toPandas()["v"]
    if not len(picked):
        return queries.select("query", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("id")).where("false")
    x = _matrix(picked)
    centres = pivots_of(x, pivots)
    d = distances(x, centres)
    near = d.argmin(1)
    rings = int(np.clip(n // (len(centres) * least_rows), 1, rings))
    cuts = np.array([np.quantile(d[near == p, p], np.arange(1, rings) / rings) if (near == p).any() else np.zeros(rings - 1) for p in range(len(centres))]).reshape(len(centres), rings - 1)
    parts = max(1, -(-n // (len(centres) * rings * rows)))
    top = float(np.sqrt((centres**2).sum(1).max()))

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["v"])
            d = distances(v, centres)
            p = d.argmin(1)
            ring = (cuts[p] < d[np.arange(len(p)), p][:, None]).sum(1)
            yield batch.assign(shard=p * rings + ring, r=list(d), norm=(v**2).sum(1))

    keyed = cut(points.mapInPandas(key, "v array<double>, ids array<long>, shard long, r array<double>, norm double").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts))), "annuli")
    # pivots x rings rows at most.
    reach = [f for p in range(len(centres)) for f in (F.min(F.get("r", F.lit(p))).alias(f"low{p}"), F.max(F.get("r", F.lit(p))).alias(f"high{p}"))]
    known = keyed.groupBy("shard").agg(F.max("norm").alias("norm"), F.sum(F.size("ids")).alias("n"), *reach).toPandas().sort_values("shard")
    shard, norm, count = (known[c].to_numpy() for c in ("shard", "norm", "n"))
    low, high = (known[[f"{c}{p}" for p in range(len(centres))]].to_numpy() for c in ("low", "high"))

    def bounds(q: np.ndarray) -> np.ndarray:
        own = (q**2).sum(1)[:, None]
        d = distances(q, centres)
        gap = np.zeros((len(q), len(shard)))
        for p in range(len(centres)):
            away = np.maximum(low[:, p] - d[:, p, None], d[:, p, None] - high[:, p])
            gap = np.maximum(gap, away - 1e-6 * (1 + np.sqrt(own) + np.sqrt(norm) + top))
        return (own + norm - gap**2) / 2 + 1e-6 * (1 + own + norm)

    def nearest(b: np.ndarray) -> np.ndarray:
        """The shards with the highest bounds, FIRST of them and as many as hold k ids."""
        order = np.argsort(-b, axis=1, kind="stable")
        before = np.cumsum(count[order], 1) - count[order]
        take = np.zeros(b.shape, bool)
        np.put_along_axis(take, order, (before < k) | (np.arange(b.shape[1]) < FIRST), 1)
        return take

    kind = "shard long, part long, query array<long>, wanted array<long>, v binary"

    def blocks(batches: Iterator[pd.DataFrame], later: bool) -> Iterator[pd.DataFrame]:
        """A row for each shard and block of queries that visit it: their numbers, wanted scores and vectors."""
        for batch in batches:
            for at in range(0, len(batch), ASKED):
                own = batch.iloc[at : at + ASKED]
                q, number = _matrix(own["v"]), own["query"].to_numpy(np.int64)
                b = bounds(q)
                take, wanted = nearest(b), np.full(len(q), -(2**63))
                if later:
                    known_score = own["least"].notna().to_numpy()
                    wanted[known_score] = own["least"][known_score].astype("int64")
                    # Written so that a bound that is not a number counts as reached.
                    take = ~take & ~(known_score[:, None] & (b < wanted[:, None]))
                rows = [(int(shard[s]), part, number[m], wanted[m], q[m].tobytes()) for s in np.nonzero(take.any(0))[0] for m in [np.nonzero(take[:, s])[0]] for part in range(parts)]
                if rows:
                    yield pd.DataFrame(rows, columns=["shard", "part", "query", "wanted", "v"])

    def compare(of: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(of):
            x, ids = _matrix(of["v"]), of["ids"].to_list()
            for number, wanted, v in zip(asked["query"], asked["wanted"], asked["v"], strict=True):
                at, score, i = best(np.frombuffer(v).reshape(len(number), -1), x, ids, k, np.asarray(wanted, np.int64))
                out.append((np.asarray(number, np.int64)[at], score, i))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query", "score", "id"), columns, strict=True)))

    def visit(asked: DataFrame) -> DataFrame:
        return keyed.select("shard", "part", "v", "ids").groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(compare, _FOUND)

    # Blocks are dealt over all tasks; the order makes neighbours in a block neighbours in space where vectors cluster.
    tasks = shuffle_partitions(points.sparkSession)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    opened = cut(visit(queries.repartition(tasks, "query").mapInPandas(lambda b: blocks(b, False), kind)).withColumn("place", place).where(F.col("place") <= k), "opened")
    least = opened.where(F.col("place") == k).select("query", F.col("score").alias("least"))
    more = visit(queries.join(least, "query", "left").repartition(tasks, "query").mapInPandas(lambda b: blocks(b, True), kind))
    return opened.drop("place").union(more).withColumn("place", place).where(F.col("place") <= k).drop("place")


def top_k(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, dim: int | None = None, **index) -> DataFrame:
    """(query_id, rank, id, score) for all rows whose id is divisible by ``every``, against all others."""
    base = cut(integer_vectors(rows, key, vector, scale, dim), "vectors")
    asked = base.where(F.col("id") % every == 0).drop("n")
    # Own rows are dropped from what is found, so that many more are looked for.
    own = base.where(F.col("id") % every == 0).groupBy("id").agg(F.sum("n").alias("n")).agg(F.max("n")).head()[0] or 0
    want = k + int(own)
    first = base.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= want)
    repeated = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "n"))), lambda x: F.array_repeat(x["id"], F.least(x["n"], F.lit(want)).cast("int"))))
    points = cut(first.groupBy("v").agg(F.slice(repeated, 1, want).alias("ids")), "points")
    # One id may ask with several vectors, so queries have numbers of their own, fixed once they are written.
    named = cut(asked.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    found = search(points, named, want, **index)
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "id"))).alias("found"))
    answers = asked.join(named, "v").join(lists, "query").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"), F.bitwise_not("x.s").alias("score"))


def op8_exact_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


_ORACLE = f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM x WHERE vec_id % {EVERY} = 0),
s AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM q JOIN x c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}"""

QUERIES = {"op8_exact_topk_search": op8_exact_topk_search}
SQL = {"op8_exact_topk_search": _ORACLE}
