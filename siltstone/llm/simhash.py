"""Operator 7, SimHash near-duplicates by vantage-point trees.

Fingerprints of 64 bits link at 4 or fewer differing bits. Distances of whole fingerprints crowd around 32, where no
tree can prune, so a fingerprint is cut into three segments: of two fingerprints that differ in at most 4 bits, one
segment differs in at most 4 // 3 = 1. For every segment a vantage-point tree is grown on the driver from a bounded
sample (SAMPLE rows; it sets pivots and median distances only and so the speed, never the result). Every distinct
fingerprint goes down each tree to the one shard that is its home; where the triangle inequality lets a point within the
radius lie on the other side of a split, it also visits that side. Every shard compares its homes with its homes and
visitors, exactly and on all 64 bits, in blocks, and returns a spanning star of each linked set, never all pairs. The
stars of all shards are joined into components by alternating large-star and small-star steps on DataFrames.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other; rows that share a doc_id
each get a fingerprint; ``component_id`` is the smallest doc_id of the component that is not null, null if there is none;
an empty table gives an empty result. Text is processed whole. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, table

BITS, SHINGLE, SEED, RADIUS = 64, 4, 42, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SAMPLE, LEAF, LEAST_POINTS = 100_000, 1500, 8
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    a, b = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for i in range(0, n, _BLOCK):
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(a[i : i + _BLOCK], b[i : i + _BLOCK], strict=True)), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", extra: tuple = ()) -> DataFrame:
    """key, ``extra`` columns and ``fp``, the fingerprint as a signed long. Only the text goes through Python."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))

    return docs.select(key, *extra, run(F.col(text)).alias("fp"))


def grow(sample: np.ndarray, rows: int, leaf: int = LEAF) -> list[list[tuple]]:
    """A tree for each segment: nodes (pivot, median, inner, outer), where a child below 0 is the leaf -child - 1. The
    pivot is the one of eight sampled values whose distances spread most; ``rows`` sets the depth."""
    trees = []
    for at, width in SEGMENTS:
        values = (sample >> np.uint64(at)) & np.uint64((1 << width) - 1)
        nodes: list[tuple] = []
        leaves = 0
        share = rows / max(len(values), 1)
        root: list = [None]
        stack = [(values, root, 0)]
        while stack:
            points, parent, side = stack.pop()
            child = None
            if len(points) * share > leaf and len(points) >= LEAST_POINTS:
                step = max(1, len(points) // 8)
                best = max(points[::step][:8], key=lambda p, x=points: float(np.bitwise_count(x ^ p).astype(np.float32).std()))
                d = np.bitwise_count(points ^ best)
                m = int(np.median(d))
                if (d <= m).all():
                    m -= 1
                if (d <= m).any():
                    node = [int(best), m, None, None]
                    nodes.append(node)
                    child = len(nodes) - 1
                    stack += [(points[d <= m], node, 2), (points[d > m], node, 3)]
            if child is None:
                leaves += 1
                child = -leaves
            parent[side] = child
        trees.append([tuple(root), *map(tuple, nodes)])
    return trees


def route(fp: np.ndarray, trees: list, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, places in ``fp``, home or visitor) for all shards that a fingerprint belongs to or whose points it may link to."""
    for t, ((at, width), (root, *nodes)) in enumerate(zip(SEGMENTS, trees, strict=True)):
        values = (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)
        stack = [(root[0], np.arange(len(fp)), np.arange(0))]
        while stack:
            child, home, guest = stack.pop()
            if not len(home) + len(guest):
                continue
            if child < 0:
                shard = (t << 40) - child - 1
                yield shard, home, True
                yield shard, guest, False
                continue
            pivot, m, inner, outer = nodes[child]
            dh = np.bitwise_count(values[home] ^ np.uint64(pivot)).astype(np.int16)
            dg = np.bitwise_count(values[guest] ^ np.uint64(pivot)).astype(np.int16)
            # A pair split here is found on the inner side, so only outer homes near the boundary cross it.
            stack.append((inner, home[dh <= m], np.concatenate([home[(dh > m) & (dh <= m + radius)], guest[dg <= m + radius]])))
            stack.append((outer, home[dh > m], guest[dg > m - radius]))


def linked_sets(homes: np.ndarray, guests: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint linked to it in this shard) for each that has a link to a home, without the smallest."""
    every = np.concatenate([homes, guests])
    near = np.zeros(len(every), bool)
    step = max(1, _BLOCK // max(len(every), 1))
    for i in range(0, len(homes), step):
        hit = np.bitwise_count(homes[i : i + step, None] ^ every[None, i:]) <= radius
        rows = np.arange(min(step, len(homes) - i))
        hit[rows, rows] = False
        near[i:] |= hit.any(0)
        near[i : i + len(rows)] |= hit.any(1)
    rest = np.sort(every[near].view(np.int64))
    found, roots = [], []
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            step = max(1, _BLOCK // len(rest))
            part, frontier = frontier[:step], frontier[step:]
            hit = (np.bitwise_count(part.view(np.uint64)[:, None] ^ rest.view(np.uint64)[None, :]) <= radius).any(0)
            new, rest = rest[hit], rest[~hit]
            frontier = np.concatenate([frontier, new])
            found.append(new)
            roots.append(np.full(len(new), root))
    return (np.concatenate(found), np.concatenate(roots)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(classes: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b), a > b, between distinct fingerprints ``fp`` that connect what the radius connects."""
    rows = classes.count()
    keep = min(1.0, sample / max(rows, 1))
    picked = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(keep * (1 << 20))).select("fp").toPandas()["fp"].to_numpy(np.int64)
    trees = grow(np.sort(picked).view(np.uint64), rows, leaf)
    within = radius // len(SEGMENTS)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            parts = [(np.full(len(at), shard), fp[at], np.full(len(at), home)) for shard, at, home in route(fp.view(np.uint64), trees, within)]
            if parts:
                yield pd.DataFrame(dict(zip(("shard", "fp", "home"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    def compare(points: pd.DataFrame) -> pd.DataFrame:
        fp, home = points["fp"].to_numpy(np.int64).view(np.uint64), points["home"].to_numpy(bool)
        a, b = linked_sets(np.sort(fp[home]), np.sort(fp[~home]), radius)
        return pd.DataFrame({"a": a, "b": b})

    dealt = classes.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node of its component. Large-star and small-star steps,
    each written to the shared folder, until nothing changes; the driver gets a count and a checksum per step."""
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == state or not now[0]:
            break
        state = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, extra: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: key, ``extra`` columns, ``fp``, ``component_id`` and ``root``, the component's smallest fingerprint."""
    rows = cut(fingerprints(docs, text, key, extra), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-classes")
    roots = cut(components(links(classes, radius)), "fingerprint-roots")
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id", "root"), "fp").select(key, *extra, "fp", "component_id", "root")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
SQL: dict[str, str] = {}
