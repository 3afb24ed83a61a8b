"""Character n-grams counted in numpy over Arrow batches: rows of n-grams, many times their text, never move."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.spread import written


def clean(text: str):
    """Lower case, runs of two and more white space as one space; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(F.col(text)), r"\s\s+", " "), F.lit(""))


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other; each one's text; and how many of its text are left from it on."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return at, np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(at))


def dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Values by their place among the distinct ones, and the number of these."""
    distinct, ids = np.unique(values, return_inverse=True)
    return ids, max(1, len(distinct))


def keys(ranks: np.ndarray, letters: int, room: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, key, number of keys) for each length from ``low`` to ``high``: n-grams are the same where their keys are. Keys
    become dense where they would leave 62 bits, so any alphabet and length is exact."""
    at, ids, most = np.arange(len(ranks)), ranks, letters
    for n in range(1, high + 1):
        if n > 1:
            keep = room[at] >= n
            at, ids = at[keep], ids[keep]
            if most * letters >= 1 << 62:
                ids, most = dense(ids)
            ids, most = ids * letters + ranks[at + n - 1], most * letters
        if n >= low:
            yield at, ids, most


def group_similarities(texts: list[str], docs: np.ndarray, n: int, low: int, high: int, least: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) with a < b of one group's tf-idf vectors. docs: the place of each text, where texts of one place add up;
    n: the rows of the group, with those without a text."""
    at, of, room = points(texts)
    ranks, letters = dense(at)
    terms, owners, first = [], [], 0
    for where, ids, _ in keys(ranks, letters, room, low, high):
        ids, most = dense(ids)
        terms.append(ids + first)
        owners.append(docs[of[where]])
        first += most
    m = int(docs.max()) + 1 if len(docs) else 0
    both, tf = np.unique(np.concatenate(terms) * m + np.concatenate(owners), return_counts=True)
    term, doc = both // max(m, 1), both % max(m, 1)
    df = np.bincount(term, minlength=first)[term]
    w = (1 + np.log(tf)) * (np.log((1 + n) / (1 + df)) + 1)
    w /= np.sqrt(np.bincount(doc, w * w, minlength=m))[doc]
    return cosines(term[df > 1], doc[df > 1], w[df > 1], m, least, block)


def cosines(term: np.ndarray, doc: np.ndarray, w: np.ndarray, m: int, least: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, product) with a < b and product >= least of ``m`` rows given by their entries, as dense products of blocks."""
    found = list(products(term, doc, w, m, least, block))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def nearest_rows(term: np.ndarray, doc: np.ndarray, w: np.ndarray, m: int, least: float, neighbours: int, held: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, product): of each row its ``neighbours`` largest products of ``least`` at least, the smaller row on ties. No more than
    about ``held`` others wait, so a group of copies takes no room for its pairs."""

    def best(a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((b, -np.round(sims, 9), a))
        keep = by[np.arange(len(by)) - np.searchsorted(a[by], a[by]) < neighbours]
        return a[keep], b[keep], sims[keep]

    parts, size = [], 0
    for a, b, sims in products(term, doc, w, m, least, 1024):
        parts += [(a, b, sims), (b, a, sims)]
        size += 2 * len(a)
        if size > held:
            parts, size = [best(*(np.concatenate([f[k] for f in parts]) for k in range(3)))], 0
    return best(*(np.concatenate([f[k] for f in parts]) for k in range(3))) if parts else (np.zeros(0, np.int64),) * 3


def products(term: np.ndarray, doc: np.ndarray, w: np.ndarray, m: int, least: float, block: int, first: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """With ``first`` only products of one of the ``first`` rows and one behind them."""
    term, columns = dense(term)
    by = np.argsort(doc, kind="stable")
    starts = np.searchsorted(doc[by], np.arange(0, m + block, block))
    width = 4_000_000 // block
    for i in range(0, m if first is None else first, block):
        for j in range(i if first is None else first // block * block, m, block):
            sims = np.zeros((min(block, m - i), min(block, m - j)))
            one, two = by[starts[i // block] : starts[i // block + 1]], by[starts[j // block] : starts[j // block + 1]]
            for c in range(0, columns, width):
                x, y = (np.zeros((len(side), min(width, columns - c))) for side in (sims, sims.T))
                for to, rows, base in ((x, one, i), (y, two, j)):
                    rows = rows[(term[rows] >= c) & (term[rows] < c + width)]
                    to[doc[rows] - base, term[rows] - c] = w[rows]
                sims += x @ y.T
            a, b = np.nonzero(sims >= least)
            keep = a + i < b + j if first is None else (a + i < first) & (b + j >= first)
            yield a[keep] + i, b[keep] + j, sims[a[keep], b[keep]]


#: Characters of the largest group that one task takes whole.
GROUP_CHARS = 2_000_000


def placed(p: list, t: list, least: float, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(a, b, cosine) of one group's texts ``t`` at the places ``p``, as numbers of the places that follow. Texts without a place are
    in no pair."""
    names = sorted({x for x in p if x is not None})
    number = {x: i for i, x in enumerate(names)} | {None: len(names)}
    a, b, sims = group_similarities(t, np.array([number[x] for x in p]), len(t), low, high, least)
    keep = b < len(names)
    return a[keep], b[keep], sims[keep], names


def by_group(done, names: list[str], types: list[pa.DataType], fewest: int):
    """A function over batches of (group, ...) by group: the columns that ``done`` returns for each group of ``fewest`` rows at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
        held, out = None, [[] for _ in names]

        def close() -> None:
            if held is not None and len(held[1]) >= fewest:
                for to, v in zip(out, done(*held), strict=True):
                    to.extend(v)

        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != g:
                    close()
                    held = (g, *([] for _ in row))
                for to, v in zip(held[1:], row, strict=True):
                    to.append(v)
                if len(out[0]) > 50_000:
                    yield made()
                    out = [[] for _ in names]
        close()
        yield made()

    return run


def similar_texts(df: DataFrame, group: str, pos: str, text: str, least: float, low: int = 2, high: int = 4, most: int | None = None) -> DataFrame:
    """(group, a, b, sim) with cosine >= least for a < b of one group, on tf-idf of character n-grams fitted on that group.

    Texts are dealt by group, and only pairs come out. A group of more than ``most`` characters (``GROUP_CHARS``) is too much for
    one task: its terms are rows that meet in a join (``groups.similar_pairs``), which gives the same pairs.
    """
    from siltstone.operators import groups as G

    most = GROUP_CHARS if most is None else most
    rows = df.where(F.col(group).isNotNull()).select(group, pos, text)
    large = written(rows.groupBy(group).agg(F.sum(F.length(text)).alias("__n")).where(F.col("__n") > most).select(group), "large-groups")
    kind, place = df.schema[group].dataType, df.schema[pos].dataType

    def done(g, p: list, t: list) -> tuple[list, list, list, list]:
        a, b, sims, names = placed(p, t, least, low, high)
        return [g] * len(a), [names[i] for i in a], [names[i] for i in b], sims.tolist()

    from pyspark.sql.pandas.types import to_arrow_type

    pairs = by_group(done, ["g", "a", "b", "sim"], [to_arrow_type(kind), to_arrow_type(place), to_arrow_type(place), pa.float64()], 2)
    small = rows.join(large, group, "left_anti").select(group, pos, clean(text).alias("__t"))
    small = small.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group).sortWithinPartitions(group)
    out = small.mapInArrow(pairs, f"g {kind.simpleString()}, a {place.simpleString()}, b {place.simpleString()}, sim double").withColumnRenamed("g", group)
    if large.isEmpty():
        return out
    vectors = G.char_tfidf(rows.join(large, group, "left_semi"), [group, pos], text, low, high, within=[group])
    return out.union(G.similar_pairs(vectors, group, pos, least))


def group_reports(df: DataFrame, group: str, pos: str, text: str, least: float, low: int = 2, high: int = 4, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(group, valid, duplicate_members, duplicate_groups, pairs, max_similarity, clusters) of each group, clusters as lists of places
    or null; and the groups of more than ``most`` characters (``GROUP_CHARS``), which have no row there.

    A task has all texts of a group, so its copies, pairs and clusters come as one row: no n-gram, pair or edge is written."""
    from pyspark.sql.pandas.types import to_arrow_type

    most = GROUP_CHARS if most is None else most
    rows = df.where(F.col(group).isNotNull()).select(group, pos, text)
    large = written(rows.groupBy(group).agg(F.sum(F.length(text)).alias("__n")).where(F.col("__n") > most).select(group), "large-groups")
    kind, place = df.schema[group].dataType, df.schema[pos].dataType

    def done(g, p: list, keys: list, t: list) -> tuple[list, ...]:
        counts = [n for n in Counter(keys).values() if n > 1]
        a, b, sims, names = placed(p, t, least, low, high) if len(t) > 1 else ([], [], np.zeros(0), [])
        root = np.arange(len(names))
        for i, j in zip(a, b, strict=True):
            if root[i] != root[j]:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
        inside = sorted({*map(int, a), *map(int, b)})
        clusters = sorted([names[i] for i in inside if root[i] == r] for r in {root[i] for i in inside})
        return [g], [len(t)], [sum(counts)], [len(counts)], [len(a)], [float(sims.max()) if len(a) else None], [clusters or None]

    columns = {"g": to_arrow_type(kind), "valid": pa.int64(), "duplicate_members": pa.int64(), "duplicate_groups": pa.int64(), "pairs": pa.int64(), "max_similarity": pa.float64(), "clusters": pa.list_(pa.list_(to_arrow_type(place)))}
    small = rows.join(large, group, "left_anti").select(group, pos, F.col(text).alias("__k"), clean(text).alias("__t"))
    small = small.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group).sortWithinPartitions(group)
    schema = f"g {kind.simpleString()}, valid long, duplicate_members long, duplicate_groups long, pairs long, max_similarity double, clusters array<array<{place.simpleString()}>>"
    return small.mapInArrow(by_group(done, list(columns), list(columns.values()), 1), schema).withColumnRenamed("g", group), large


@dataclass
class Terms:
    """The n-grams that count, the most frequent ones by count, then by term. A code is a term's letters, as places from 1 in
    ``letters``, the digits of a number of ``high`` places: codes stand in the order of their terms. Codes rise."""

    letters: np.ndarray
    low: int
    high: int
    codes: np.ndarray
    df: np.ndarray
    cf: np.ndarray
    n: int

    @property
    def idf(self) -> np.ndarray:
        return np.log((1 + self.n) / (1 + self.df)) + 1

    def names(self) -> list[str]:
        out, rest, base = [""] * len(self.codes), self.codes.copy(), len(self.letters) + 1
        digits = []
        for _ in range(self.high):
            digits.append(rest % base)
            rest //= base
        signs = ["", *map(chr, self.letters.tolist())]
        for d in reversed(digits):
            out = [x + signs[k] for x, k in zip(out, d.tolist(), strict=True)]
        return out

    def entries(self, texts: list[str], sublinear: bool = True, idf: np.ndarray | None = None, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, text, tf-idf before its norm) of the known terms, by text, then term. ``order`` renumbers the terms."""
        term, doc, times = [], [], []
        idf = self.idf if idf is None else idf
        for codes, owner, tf in counted(texts, self.letters, self.low, self.high):
            head = np.flatnonzero(np.diff(codes, prepend=-1))
            at = np.minimum(np.searchsorted(self.codes, codes[head]), len(self.codes) - 1)
            at = np.repeat(np.where(self.codes[at] == codes[head], at, -1), np.diff(np.append(head, len(codes)))) if len(self.codes) else np.full(len(codes), -1)
            keep = at >= 0
            term.append(at[keep])
            doc.append(owner[keep])
            times.append(tf[keep])
        term, doc, tf = np.concatenate(term), np.concatenate(doc), np.concatenate(times)
        if order is not None:
            term, idf = order[term], idf[np.argsort(order)]
        # Sorted as one number each, which has room for any text that fits in memory; else by places.
        size, most = max(1, len(self.codes)), int(tf.max()) + 1 if len(tf) else 1
        if len(texts) * size * most < 1 << 62:
            whole = np.sort((doc * size + term) * most + tf)
            whole, tf = whole // most, whole % most
            doc, term = whole // size, whole % size
        else:
            by = np.lexsort((term, doc))
            term, doc, tf = term[by], doc[by], tf[by]
        return term, doc, (1 + np.log(tf) if sublinear else tf) * idf[term]


def counted(texts: list[str], letters: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, text, count) for each length, by code, then text. A letter that is not in ``letters`` ends all terms it is in."""
    at, of, room = points(texts)
    base, m = len(letters) + 1, max(1, len(texts))
    place = np.searchsorted(letters, at)
    ranks = np.where((place < len(letters)) & (letters[np.minimum(place, max(0, len(letters) - 1))] == at), place + 1, 0) if len(letters) else np.zeros(len(at), np.int64)
    where, codes = np.arange(len(at)), np.zeros(len(at), np.int64)
    for n in range(1, high + 1):
        keep = room[where] >= n
        where, codes = where[keep], codes[keep]
        last = ranks[where + n - 1]
        where, codes = where[last > 0], (codes * base + last)[last > 0]
        if n >= low:
            aligned = codes * base ** (high - n)
            if base**high * m < 1 << 62:
                both, names = np.sort(aligned * m + of[where]), None
            else:
                names, ids = np.unique(aligned, return_inverse=True)
                both = np.sort(ids * m + of[where])
            head = np.flatnonzero(np.diff(both, prepend=-1))
            first = both[head]
            yield first // m if names is None else names[first // m], first % m, np.diff(np.append(head, len(both)))


#: Characters that are counted at once.
CHARS = 1 << 19


def cut(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first place, texts) of about ``CHARS`` characters each."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHARS or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, chars = i + 1, 0


def known_terms(names: list[str], low: int, high: int) -> tuple[Terms, np.ndarray] | None:
    """Terms of these names, and the place of each of them among the names. None where their letters are too many."""
    letters = np.array(sorted({ord(x) for n in names for x in n}), np.int64)
    base = len(letters) + 1
    if base**high >= 1 << 62:
        return None
    place = {chr(x): i + 1 for i, x in enumerate(letters.tolist())}
    codes = np.array([sum(place[x] * base ** (high - 1 - i) for i, x in enumerate(n)) for n in names], np.int64)
    order = np.argsort(codes)
    return Terms(letters, low, high, codes[order], np.zeros(0), np.zeros(0), 0), order


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of some rows, the last one texts, of about ``CHARS`` characters."""
    held, chars = None, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = held or [[] for _ in row]
            for to, x in zip(held, row, strict=True):
                to.append(x)
            chars += len(row[-1])
            if chars >= CHARS:
                yield held
                held, chars = None, 0
    if held:
        yield held


def common_terms(df: DataFrame, text: str, low: int, high: int, min_df: int, max_features: int) -> Terms | None:
    """The ``max_features`` most frequent terms of at least ``min_df`` rows. Each task sums its own counts before they move. None
    where the letters are too many for codes of 62 bits."""
    texts = df.select(clean(text).alias("t"))

    def alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for (part,) in portions(batches):
            seen[points(part)[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["x"])

    letters = np.array(sorted(r["x"] for r in texts.mapInArrow(alphabet, "x long").distinct().collect()), np.int64)
    if (len(letters) + 1) ** high >= 1 << 62:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for (part,) in portions(batches):
            for codes, _, tf in counted(part, letters, low, high):
                head = np.flatnonzero(np.diff(codes, prepend=-1))
                parts.append((codes[head], np.diff(np.append(head, len(codes))), np.add.reduceat(tf, head) if len(head) else tf))
                size += len(head)
            if size > 2_000_000:
                parts = [summed(parts)]
                size = 0
        if parts:
            codes, rows, times = summed(parts)
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in (codes, rows, times)], names=["code", "df", "cf"])

    sums = texts.mapInArrow(count, "code long, df long, cf long").groupBy("code").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= min_df)
    top = sorted((r["code"], r["df"], r["cf"]) for r in sums.orderBy(F.desc("cf"), "code").limit(max_features).collect())
    codes, rows, times = (np.array([r[k] for r in top], np.int64) for k in range(3))
    return Terms(letters, low, high, codes, rows, times, df.count())


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    by = np.argsort(codes, kind="stable")
    head = np.flatnonzero(np.diff(codes[by], prepend=-1))
    return codes[by][head], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[by], head) if len(head) else np.zeros(0, np.int64) for k in (1, 2))


#: Squared norm that the leading, rarest terms of a row reach; more of them leave fewer pairs to compare. The result is exact for any.
LEAD = 0.22
#: Ranks at which a row's norm behind them is kept, and rows of a block, which meets in its task the larger rows that can be near.
CUTS, BLOCK_ROWS, BLOCKS = 32, 10_000, 18
#: Terms in the leads of a block, bytes of leads that meet it at once, and common terms that are summed at once.
BLOCK_TERMS, PASSING, MEETINGS = 2_000_000, 1_000_000, 500_000
#: Characters of near copies that one task compares; of a larger group a task takes such a part and meets the rest in batches.
PART_CHARS = 3_000_000
#: Blocks whose tasks are planned as one job.
WAVE = 64
#: Weights of a lead are rounded up to one of these.
STEPS = np.exp(-0.03 * np.arange(256))


def near_texts(df: DataFrame, key: str, text: str, terms: Terms, least: float, neighbours: int) -> DataFrame:
    """(a, b, sim): of each row its ``neighbours`` nearest others with cosine >= least of the tf-idf vectors of all rows, exactly,
    the smaller key on ties. Keys are unique.

    Terms have one order, by rising document frequency. A row's lead are its first terms with ``LEAD`` of its squared norm. Behind
    the shorter of two leads, both rows' norms are known, and all before it that both share is in both leads, so a product is at most
    that of the leads plus that of these norms. Leads are written once; a task reads those of its own block of rows, by number of terms, and
    of the larger rows that can be near, as the smaller of two rows has to hold ``least`` of the other's norm at least. No lead is
    shuffled, as a row can be near many blocks. Pairs
    whose bound is ``least`` are candidates; of these a task returns a forest that joins the same rows, never all pairs. Rows that
    candidates join are compared on all terms. A task holds its block, or its part of a group, and never what it meets.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    rarity = np.empty(len(terms.codes), np.int64)
    rarity[np.lexsort((terms.codes, terms.df))] = np.arange(len(terms.codes))
    gap = np.dtype("<u2" if len(terms.codes) <= 1 << 16 else "<u4")
    cuts = np.linspace(0, len(terms.codes), CUTS + 1).astype(np.int64)[:-1]
    rows = df.select(key, clean(text).alias("t"))

    def vectors(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, terms by rarity, weights) of those with a term."""
        term, doc, x = terms.entries(texts, order=rarity)
        ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
        for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            if b > a:
                yield i, term[a:b], x[a:b] / np.sqrt(x[a:b] @ x[a:b])

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in portions(batches):
            out = [[] for _ in range(8)]
            for i, term, w in vectors(texts):
                squares = w * w
                sums = np.cumsum(squares)
                k = min(int(np.searchsorted(sums, LEAD)) + 1, len(term))
                most = np.cumsum(np.sort(squares)[::-1])
                need = min(int(np.searchsorted(most, least * least - 1e-9)) + 1, len(term))
                behind = np.sqrt(np.maximum(0.0, 1 - np.append(0.0, sums)[np.searchsorted(term, cuts)])) + 1e-7
                up = np.minimum(np.floor(-np.log(w[:k]) / 0.03 + 1e-9), 255).clip(0).astype(np.uint8)
                up -= (STEPS[up] < w[:k]) & (up > 0)
                for to, v in zip(out, (names[i], len(term), need, int(term[k - 1]), float(np.sqrt(max(0.0, 1 - sums[k - 1])) + 1e-7), np.diff(term[:k], prepend=0).astype(gap).tobytes(), up.tobytes(), behind.astype("<f4").tobytes()), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (name, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["k", "n", "need", "last", "left", "terms", "w", "behind"])

    from pyspark.sql.pandas.types import to_arrow_type

    name = to_arrow_type(kind)
    short = kind.simpleString()
    lead = written(rows.mapInArrow(leads, f"k {short}, n long, need long, last long, left double, terms binary, w binary, behind binary"), "leads")
    count = lead.count()
    blocks = max(BLOCKS, -(-count // BLOCK_ROWS))
    edges = sorted({int(x) for x in lead.approxQuantile("n", [i / blocks for i in range(1, blocks)], 0.001)}) if count else []
    total, steps = len(terms.codes), STEPS.astype(np.float32) * np.float32(1.0001)
    columns = ["k", "n", "need", "last", "left", "terms", "w", "behind"]
    # Rows of one range of n, which equal texts' sizes can make large, are split by hash: a block has few rows and few terms.
    at = F.lit(0)
    for e in edges:
        at += (F.col("n") > e).cast("int")
    sizes = lead.groupBy(at.alias("c")).agg(F.count("*").alias("rows"), F.sum(F.length("terms")).alias("bytes")).collect()
    cells = [(r["c"], j, m) for r in sorted(sizes) for m in [max(-(-r["rows"] // BLOCK_ROWS), -(-r["bytes"] // (gap.itemsize * BLOCK_TERMS)))] for j in range(m)]

    def dealt(c: int, j: int, m: int) -> DataFrame:
        """The rows of one task, the block's own first: part ``j`` of ``m`` of range ``c``, then the parts behind it and the rows of
        higher ranges that need no more terms than its rows have."""
        above = F.col("n") > edges[c - 1] if c else F.lit(True)
        within = F.col("n") <= edges[c] if c < len(edges) else F.lit(True)
        part = F.pmod(F.xxhash64("k"), F.lit(m))
        some = lead.where(above & (F.col("need") <= edges[c] if c < len(edges) else F.lit(True)) & (~within | (part >= j)))
        return some.select((within & (part == j)).alias("own"), *columns).coalesce(1).sortWithinPartitions(F.desc("own"))

    def flat(part: pa.Table | pa.RecordBatch) -> dict:
        x = {c: part[c].to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else part[c].to_numpy() for c in ("n", "need", "last", "left")}
        x["k"], lists = part["k"].to_pylist(), part["terms"].to_pylist()
        sizes = np.array([len(t) // gap.itemsize for t in lists], np.int64)
        ends = np.cumsum(sizes)
        term = np.cumsum(np.frombuffer(b"".join(lists), gap), dtype=np.int64)
        x["term"] = (term - np.repeat(np.append(0, term[ends[:-1] - 1]), sizes)).astype(np.int32)
        x["w"] = steps[np.frombuffer(b"".join(part["w"].to_pylist()), np.uint8)]
        x["behind"] = np.frombuffer(b"".join(part["behind"].to_pylist()), "<f4").reshape(len(lists), CUTS)
        x["cut"] = np.maximum(np.searchsorted(cuts, x["last"], "right") - 1, 0)
        x["ends"], x["sizes"] = np.append(0, ends), sizes
        return x

    def hits(x: dict, y: dict, index: tuple[np.ndarray, ...]) -> Iterator[tuple[int, np.ndarray]]:
        """(row of y, rows of x that can be near it); a few rows of y are summed at once."""
        starts, owner, weight = index
        width = len(x["k"])
        first = starts[y["term"]]
        many = starts[y["term"] + 1] - first
        reach = np.append(0, np.cumsum(many))[y["ends"]]
        s = 0
        while s < len(y["k"]):
            e = max(s + 1, min(s + max(1, 100_000 // width), int(np.searchsorted(reach, reach[s] + MEETINGS, "right")) - 1))
            part = slice(y["ends"][s], y["ends"][e])
            spans = many[part]
            ends = np.cumsum(spans)
            at = np.repeat(first[part] - (ends - spans), spans)
            at += np.arange(len(at))
            to = np.repeat(np.repeat(np.arange(e - s) * width, y["sizes"][s:e]), spans)
            to += owner[at]
            p = np.bincount(to, weight[at] * np.repeat(y["w"][part], spans), minlength=(e - s) * width)
            # The norm behind a lead bounds the rest of a product, as no other is over 1.
            found = np.flatnonzero(p >= least - 1e-5 - max(x["left"].max(), y["left"][s:e].max()))
            i, j = found // width + s, found % width
            # Behind the lead that ends first; a norm behind an earlier cut is no less.
            rest = np.where(x["last"][j] >= y["last"][i], y["left"][i] * x["behind"][j, y["cut"][i]], x["left"][j] * y["behind"][i, x["cut"][j]])
            keep = (p[found] + rest >= least - 1e-5) & (x["n"][j] >= y["need"][i]) & (y["n"][i] >= x["need"][j])
            i, j = i[keep], j[keep]
            for r in np.unique(i):
                yield int(r), j[i == r]
            s = e

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the block's own rows are held; the others pass by in batches."""
        own, x, index, joined = [], None, None, None

        def joins(y: dict, inner: bool) -> pa.RecordBatch:
            found_a, found_b = [], []
            for i, near in hits(x, y, index):
                near = near[near < i] if inner else near
                others, at = np.unique(joined[near], return_index=True)
                new = others != joined[i] if inner else np.ones(len(others), bool)
                if new.any():
                    found_a += [y["k"][i]] * int(new.sum())
                    found_b += [x["k"][m] for m in near[at[new]].tolist()]
                    if inner or len(others) > 1:
                        joined[np.isin(joined, others)] = joined[i] if inner else others[0]
            return pa.RecordBatch.from_arrays([pa.array(found_a, name), pa.array(found_b, name)], names=["a", "b"])

        def start() -> pa.RecordBatch:
            nonlocal x, index, joined
            x = flat(pa.Table.from_batches(own))
            by = np.argsort(x["term"], kind="stable")
            index = np.searchsorted(x["term"][by], np.arange(total + 1)), np.repeat(np.arange(len(x["k"])), x["sizes"])[by], x["w"][by]
            joined = np.arange(len(x["k"]))
            own.clear()
            return joins(x, True)

        for batch in batches:
            if not len(batch):
                continue
            mine = batch["own"]
            if x is None:
                own.append(batch.filter(mine))
                if not sum(map(len, own)):
                    return
            others = batch.filter(pc.invert(mine))
            if len(others):
                if x is None:
                    yield start()
                few = max(1, len(others) * PASSING // max(1, others["terms"].nbytes))
                for i in range(0, len(others), few):
                    yield joins(flat(others.slice(i, few)), False)
        if x is None and sum(map(len, own)):
            yield start()

    # Spark puts a union of one-task inputs into one task, unless they differ from another input: the empty one.
    if not cells:
        return spark.createDataFrame([], f"a {short}, b {short}, sim double")
    none = spark.createDataFrame([], dealt(*cells[0]).schema)
    met = [written(reduce(DataFrame.union, (dealt(*c) for c in cells[i : i + WAVE]), none).mapInArrow(meets, f"a {short}, b {short}"), "candidates") for i in range(0, len(cells), WAVE)]
    candidates = reduce(DataFrame.union, met)
    from siltstone.operators import groups as G

    if candidates.isEmpty():
        return spark.createDataFrame([], f"a {short}, b {short}, sim double")
    roots = written(G.connected(candidates).select(F.col("node").alias("__k"), "root"), "candidate-groups")

    def entries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, text, weight), unit vectors."""
        every = [(at + i, term, w) for at, some in cut(texts) for i, term, w in vectors(some)]
        if not every:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate([t for _, t, _ in every]), np.repeat([i for i, *_ in every], [len(t) for _, t, _ in every]), np.concatenate([w for *_, w in every])

    def compare(part: pa.Table) -> pa.Table:
        names, texts = part["k"].to_pylist(), part["t"].to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i])
        names = [names[i] for i in order]
        a, b, sims = nearest_rows(*entries([texts[i] for i in order]), len(names), least, neighbours)
        return pa.table({"a": pa.array([names[i] for i in a], name), "b": pa.array([names[i] for i in b], name), "sim": pa.array(sims, pa.float64())})

    def compares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part of a large group, its own rows first, against the whole group, which passes by: only the part's terms and nearest rows are held."""
        names, texts, own, best = [], [], None, None

        def keep(a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> None:
            nonlocal best
            a, b, sims = (np.concatenate(x) for x in zip(best, (a, b, sims), strict=True)) if best else (a, b, sims)
            by = np.lexsort((np.unique(b, return_inverse=True)[1], -np.round(sims, 9), a))
            by = by[np.arange(len(by)) - np.searchsorted(a[by], a[by]) < neighbours]
            best = a[by], b[by], sims[by]

        def start() -> None:
            nonlocal own
            own = entries(texts)
            for a, b, sims in products(*own, len(names), least, 1024):
                keep(np.append(a, b), np.array(names)[np.append(b, a)], np.append(sims, sims))

        for mine, keys, some in portions(batches):
            inner = sum(mine)
            names, texts = names + keys[:inner], texts + some[:inner]
            if not names:
                return
            if inner < len(keys):
                if own is None:
                    start()
                term, doc, w = entries(some[inner:])
                both = np.append(own[0], term), np.append(own[1], doc + len(names)), np.append(own[2], w)
                for a, b, sims in products(*both, len(names) + len(keys) - inner, least, 1024, len(names)):
                    keep(a, np.array(keys[inner:])[b - len(names)], sims)
        if own is None and names:
            start()
        a, b, sims = best or ([], np.zeros(0), [])
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], name), pa.array(b.tolist(), name), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    whole = rows.join(roots, F.col(key) == F.col("__k")).select("root", F.col("__k").alias("k"), "t")
    large = written(df.select(key, F.length(text).alias("chars")).join(roots, F.col(key) == F.col("__k")).groupBy("root").agg(F.sum("chars").alias("chars")).where(F.col("chars") > PART_CHARS), "large-groups")
    made = f"a {short}, b {short}, sim double"
    near = [written(whole.join(large.select("root"), "root", "left_anti").groupBy("root").applyInArrow(compare, made), "nearest")]
    parts = [(r["root"], j, m) for r in large.collect() for m in [-(-r["chars"] // PART_CHARS)] for j in range(m)]
    if parts:
        held = written(whole.join(large.select("root"), "root", "left_semi"), "large-group-texts")
        part = lambda r, j, m: held.where(F.col("root") == F.lit(r)).select((F.pmod(F.xxhash64("k"), F.lit(m)) == j).alias("own"), "k", "t").coalesce(1).sortWithinPartitions(F.desc("own"))
        none = spark.createDataFrame([], part(*parts[0]).schema)
        near += [written(reduce(DataFrame.union, (part(*p) for p in parts[i : i + WAVE]), none).mapInArrow(compares, made), "nearest-in-parts") for i in range(0, len(parts), WAVE)]
    return reduce(DataFrame.union, near)
