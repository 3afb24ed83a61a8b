"""Operator 5, line deduplication by content-defined chunks of lines. DataFrame functions only.

Two rules cut a text's lines into chunks:

``rolling``: a line's hash is the first 28 bits of its MD5; rolling over a window of two line hashes gives
r(i) = (h(i-1) * B + h(i)) mod M, and a chunk ends after line i where r(i) is a local minimum (r(i) < r(i-1), r(i) <= r(i+1)).
Whether a line ends a chunk depends on its near neighbours alone, so an inserted line moves no boundary further away. A
passage that is shared between unlike texts mixes with their own lines in its first and last chunk, though, so most passages
of a few lines hold no whole chunk: this rule alone misses two thirds of the repeats (README).

``every``, the rule of the query: many rules side by side, each of which depends on the chunk's own lines. With the rule of a
bit b, a chunk opens at a line whose hash has the bit clear and closes at the next line if that has it set; neighbouring lines
that differ do so in some bit, so over all bits and both directions every pair of neighbours is a chunk. These chunks are taken
directly, each once: from every line ahead, and to every line back, the fewest lines that make ``min_lines`` lines with a word
and ``min_words`` words, or ``long_words`` words in one line; lines without a word are passed over. Every shared passage of that
size is covered by such chunks from its first line to its last, wherever it stands.

A chunk that is long enough is shared if it occurs more than once in the table, in one document or several. Its first
occurrence by (doc_id, text hash, place) stays; of the others all lines go, line ends included. A line that goes has an equal
line earlier in that order, so no line is lost. Chunks are counted by two 64-bit hashes, pre-aggregated in each task; chunks
found twice meet their counts in a join that Spark may split where one chunk is frequent. All occurrences are then compared
byte for byte: the smallest and largest text of a hash must be equal, otherwise nothing of it is removed.

Defined results: null text stays null and empty text stays empty, both without lines; rows that are equal in doc_id and
text are one document, so they keep the same lines; rows with a null doc_id are ordered first; a doc_id that is no whole number
is ordered by its hash; all other columns pass through as they are, ``n_chars`` (if there is one of a number type) is set to the
new length where a text changed, and outputs whose names the input has get free ones (see ``common.free``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, cut, free, let, table, words_of

BASE, MODULUS = 1_000_003, 2_147_483_647
MIN_LINES, MIN_WORDS, LONG_WORDS = 2, 10, 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def rolling_chunks(text: Column, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> Column:
    """array<struct<first, last, text>>: the chunks between local minima that are long enough to be removed, in order."""

    def chunks(lines):
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))
        rolled = let(hashes, lambda h: F.transform(h, lambda x, i: F.pmod(F.coalesce(F.get(h, i - 1), F.lit(0).cast("long")) * BASE + x, F.lit(MODULUS).cast("long"))))
        ends = let(rolled, lambda r: F.filter(F.transform(r, lambda x, i: F.when((i == F.size(r) - 1) | ((x < F.get(r, i - 1)) & (x <= F.get(r, i + 1))), i)), lambda x: x.isNotNull()))

        def piece(start, end):
            part = F.slice(lines, start + 1, end - start + 1)
            return let(part, lambda p: let(F.array_join(p, "\n"), lambda t: F.when(wide(p, F.size(words_of(t))), F.struct(start.alias("first"), end.alias("last"), t.alias("text")))))

        def wide(part, words):
            return ((F.size(F.filter(part, lambda x: x.rlike(WORD))) >= min_lines) & (words >= min_words)) | (words >= long_words)

        cut_at = lambda e: F.transform(e, lambda end, k: piece(F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1), end))
        return F.filter(let(ends, cut_at), lambda x: x.isNotNull())

    return let(_lines(text), chunks)


def every_chunk(text: Column, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> Column:
    """array<struct<first, last, text>>: the shortest chunks ahead of and back from every line with a word, by their places."""
    most = max(min_lines, min_words)

    def chunks(held):
        sizes = F.transform(held, lambda x: F.size(words_of(x["line"])))

        def enough(part):
            """How many of the sizes it takes; 0 if all do not suffice."""
            short = lambda s: ((s["words"] < min_words) | (s["lines"] < min_lines)) & (s["words"] < long_words)
            start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
            return F.aggregate(part, start, lambda s, n: F.when(short(s), F.struct((s["words"] + n).alias("words"), (s["lines"] + 1).alias("lines"))).otherwise(s), lambda s: F.when(short(s), 0).otherwise(s["lines"]))

        def count(own, next_, part):
            """The same, without a loop where one line or two suffice."""
            return F.when(own >= long_words, 1).when(F.lit(min_lines <= 2) & (own + next_ >= min_words), 2).otherwise(enough(part))

        def found(n):
            code = lambda start, k: F.when(k > 0, start.cast("long") * (most + 1) + k)
            ahead = F.transform(n, lambda x, i: code(i, count(x, F.get(n, i + 1), F.slice(n, i + 1, most))))
            back = F.transform(n, lambda x, i: let(count(x, F.get(n, i - 1), F.reverse(F.slice(n, F.greatest(i + 2 - most, F.lit(1)), F.least(i + 1, F.lit(most))))), lambda k: code(i + 1 - k, k)))
            return F.transform(F.sort_array(F.array_compact(F.array_distinct(F.concat(ahead, back)))), lambda x: run((x / (most + 1)).cast("int"), (x % (most + 1)).cast("int")))

        def run(start, k):
            return F.struct(F.get(held, start)["at"].alias("first"), F.get(held, start + k - 1)["at"].alias("last"), F.array_join(F.transform(F.slice(held, start + 1, k), lambda x: x["line"]), "\n").alias("text"))

        return let(sizes, found)

    lines = F.transform(_lines(text), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    return let(F.filter(lines, lambda x: x["line"].rlike(WORD)), chunks)


#: rule: (its chunks, whether a line belongs to a chunk's text)
RULES = {"rolling": (rolling_chunks, lambda x: F.lit(True)), "every": (every_chunk, lambda x: x.rlike(WORD))}


def _hashes(chunk: Column) -> tuple[Column, Column]:
    return F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit("second"), chunk).alias("b")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, rule: str = "every", spans: bool = False) -> DataFrame:
    """``docs`` with shared chunks removed from ``text``; with ``spans`` also ``n_lines``, ``n_removed`` (lines) and ``removed_chars``."""
    units, belongs = RULES[rule]
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    order = [F.coalesce(number, F.lit(-(1 << 63)).cast("long")).alias("__k"), F.xxhash64(F.col(text)).alias("__h")]
    chunks = F.transform(units(F.col(text), min_lines, min_words, long_words), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), *_hashes(c["text"])))
    # Hashes and places only, written so that texts are cut once for them.
    wide = cut(docs.where(F.col(text).isNotNull()).select(*order, F.explode(chunks).alias("c")).select("__k", "__h", "c.*"), "line-chunks")
    place = F.struct("__k", "__h", "first", "last")
    # Written, so that its size is known and the join's two sides come straight from their exchanges: a chunk that a third of
    # all texts hold is then split over tasks.
    shared = cut(wide.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1").drop("n"), "shared-chunks")
    found = cut(wide.join(shared, ["a", "b"]).select("__k", "__h", "first", "last", "a", "b", (place != F.col("least")).alias("again")), "shared-places")
    # The chunks of a document are all that its arrays can hold; repeated rows bring them again.
    here = found.groupBy("__k", "__h").agg(F.collect_set(F.struct("first", "last", "a", "b", "again")).alias("__found"))
    # Texts meet their shared chunks once; these rows then serve the byte comparison and the removal.
    left = cut(docs.select("*", *order).join(here, ["__k", "__h"], "left"), "chunk-holders")
    chunk_text = lambda ls, x: F.array_join(F.filter(F.slice(ls, x["first"] + 1, x["last"] - x["first"] + 1), belongs), "\n")
    shown = left.where(F.col("__found").isNotNull()).select(F.explode(let(_lines(F.col(text)), lambda ls: F.transform("__found", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), chunk_text(ls, x).alias("t"))))).alias("x")).select("x.*")
    differ = cut(shown.groupBy("a", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("a", "b"), "unequal-chunks")
    # Written, so that its size is known: a table without rows, unless different chunks have the same two hashes.
    spared = cut(found.where("again").join(differ, ["a", "b"], "left_semi").groupBy("__k", "__h").agg(F.collect_set(F.struct("first", "last")).alias("__spared")), "spared-chunks")
    again = F.transform(F.filter("__found", lambda x: x["again"]), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    gone = F.array_except(again, F.coalesce("__spared", F.array().cast("array<struct<first:int,last:int>>")))
    left = left.join(spared, ["__k", "__h"], "left").withColumn("__gone", F.array_distinct(F.flatten(F.transform(gone, lambda x: F.sequence(x["first"], x["last"])))))
    lines_left = let(_lines(F.col(text)), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__gone")), lambda i: F.get(ls, i)))
    change = F.coalesce(F.size("__gone"), F.lit(0)) > 0
    out = left.withColumn("__new", F.when(change, F.array_join(lines_left, "\n")).otherwise(F.col(text)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    columns[docs.columns.index(text)] = F.col("__new").alias(text)
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("short", "integer", "long", "double", "float", "decimal"):
        columns[docs.columns.index("n_chars")] = F.when(change, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    if spans:
        lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(_lines(F.col(text))))
        columns += [lines.alias(free(docs, "n_lines")), F.coalesce(F.size("__gone"), F.lit(0)).alias(free(docs, "n_removed")), (F.length(F.col(text)) - F.length("__new")).alias(free(docs, "removed_chars"))]
    return out.select(*columns)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), spans=True)


_ORACLE = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, doc_id, i, ls[i + 1] AS line FROM (SELECT rid, doc_id, ls, unnest(generate_series(0, len(ls) - 1)) AS i FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text <> ''))),
w AS (SELECT rid, doc_id, i, line, row_number() OVER (PARTITION BY rid ORDER BY i) AS j, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT a.rid, a.j AS s, b.j AS e, b.j - a.j + 1 AS k, sum(b.n) OVER (PARTITION BY a.rid, a.j ORDER BY b.j) AS ahead, sum(a.n) OVER (PARTITION BY a.rid, b.j ORDER BY a.j DESC) AS back
      FROM w a JOIN w b ON a.rid = b.rid AND b.j BETWEEN a.j AND a.j + {max(MIN_LINES, MIN_WORDS) - 1}),
r AS (SELECT rid, s, min(e) AS e FROM p WHERE (ahead >= {MIN_WORDS} AND k >= {MIN_LINES}) OR ahead >= {LONG_WORDS} GROUP BY rid, s
      UNION SELECT rid, max(s), e FROM p WHERE (back >= {MIN_WORDS} AND k >= {MIN_LINES}) OR back >= {LONG_WORDS} GROUP BY rid, e),
c AS (SELECT r.rid, any_value(doc_id) AS doc_id, s, min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY j) AS chunk FROM r JOIN w ON r.rid = w.rid AND w.j BETWEEN s AND e GROUP BY r.rid, s, e),
o AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS FIRST, first, last) AS occurrence FROM c),
g AS (SELECT DISTINCT rid, unnest(generate_series(first, last)) AS i FROM o WHERE occurrence > 1),
t AS (SELECT l.rid, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed FROM l LEFT JOIN g ON l.rid = g.rid AND l.i = g.i GROUP BY l.rid)
SELECT d.doc_id, CASE WHEN d.text <> '' THEN t.text ELSE d.text END AS text, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed,
       (length(d.text) - length(coalesce(t.text, d.text)))::INT AS removed_chars
FROM d LEFT JOIN t USING (rid)"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {"op5_line_dedup": _ORACLE}
