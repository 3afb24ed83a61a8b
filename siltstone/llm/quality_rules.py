"""Operator 1, quality rules with risk-controlled thresholds. DataFrame functions only.

Every text gets integer scores in thousandths (symbols a word, repeated lines a line, repeated words a word). For each
stratum and rule a cutoff is chosen from a fixed grid: labelled good documents are the holdout, a cutoff counts as safe
when the exact lower binomial tail P(Bin(n, alpha) <= k) of its k false rejections among n good documents is at most
delta / (strata x rules) (Bonferroni over strata and rules; within a rule the cutoffs are nested, so going from the
loosest to the tightest is a fixed-sequence test that needs no further correction). With probability 1 - delta no
stratum loses more than alpha of its good documents to any one rule, len(RULES) * alpha in all. Among safe cutoffs the
one with the largest ``bad rejected - cost * good rejected`` is used, the looser on ties, none if that is not positive.

The tail is exact at any size: the probability of k itself comes from Loader's saddle-point form of the binomial, and the
terms below it are summed down until they no longer count, a number that grows with the square root of n.

Defined results: null text is the empty text and fails the base rules; a null stratum is the stratum ``und``; documents
whose label is null or missing are no part of the holdout; a document labelled more than once counts as bad if any label
is 0; rows that share a doc_id are one draw of the holdout, the one with the least (stratum, scores); with no labels no
cutoff is safe and only the base rules reject. All columns of the input stay as they are, and outputs whose names the input
has get free ones (see ``common.free``).
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, cut, free, let, table, words_of

SYMBOLS = "#*$%&|<>"
#: rule: (score in thousandths, higher is worse; cutoffs, a score above the cutoff rejects)
RULES = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", (1000, 700, 500, 300, 200, 150, 100, 70, 50)),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", (800, 700, 600, 500, 400, 300, 250, 200, 150, 100)),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", (190, 170, 150, 130, 110, 90, 70, 50)),
}
ALPHA, DELTA, COST = 0.03, 0.05, 10
_STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


_INDEX_BITS = 24


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows found twice or more. Equal hashes only select; the windows are then compared as words.

    Sorted keys hold a window's hash above its place, so equal windows are neighbours. Where neighbours with equal hashes
    differ as words, or a text has 2**24 words or more, the windows themselves are sorted instead.
    """
    low = (1 << _INDEX_BITS) - 1

    def same(w, a, b):
        return F.slice(w, a.bitwiseAND(F.lit(low)).cast("int") + 1, 5) == F.slice(w, b.bitwiseAND(F.lit(low)).cast("int") + 1, 5)

    def spread(places):
        return let(places, lambda p: _total(F.transform(p, lambda x, k: F.least(F.lit(5).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(5).cast("long"))))))

    def by_window(w):
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.struct(F.slice(w, i + 1, 5).alias("s"), i.cast("long").alias("i")))
        return let(F.sort_array(windows), lambda s: spread(F.sort_array(F.transform(F.filter(s, lambda x, k: (x["s"] == F.get(s, k + 1)["s"]) | (x["s"] == F.get(s, k - 1)["s"])), lambda x: x["i"]))))

    def by_key(w, h):
        def found(keys):
            equal = lambda x, y: F.shiftright(x, _INDEX_BITS) == F.shiftright(y, _INDEX_BITS)
            twice = F.filter(keys, lambda x, k: equal(x, F.get(keys, k + 1)) | equal(x, F.get(keys, k - 1)))
            clash = F.exists(F.transform(keys, lambda x, k: equal(x, F.get(keys, k + 1)) & ~same(w, x, F.get(keys, k + 1))), lambda x: F.coalesce(x, F.lit(False)))
            return F.when(clash, by_window(w)).otherwise(spread(F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.lit(low))))))

        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        return F.when(F.size(w) > low, by_window(w)).otherwise(let(keys, found))

    def counted(w):
        starts = F.sequence(F.lit(0), F.size(w) - 5)
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))
        none = F.lit(0).cast("long")
        return F.when(F.size(w) < 6, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(by_key(w, h))))

    return let(words, counted)


def stats_of(text: Column) -> Column:
    """struct of the counts of a whole text and ``base_failed``."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    of_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n_symbols = (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long")
    found = lambda w, x: F.struct(*[w[c].alias(c) for c in ("n_words", "word_chars")], n_symbols.alias("n_symbols"), *[x[c].alias(c) for c in ("n_lines", "n_dup_lines")], w["n_repeat_words"].alias("n_repeat_words"), ((w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])).alias("base_failed"))
    return let(of_words, lambda w: let(of_lines, lambda x: found(w, x)))


def score_of(rule: str, stats: str) -> Column:
    """The score of a rule from the column ``stats``."""
    return F.expr(re.sub(r"\bn_", f"{stats}.n_", rule))


def _log_tail_steps(n: Column, k: Column, alpha: float) -> Column:
    """ln P(Bin(n, alpha) = k) for 0 < k < n, by Loader's form: Stirling's error of n, k and n - k, and two deviances."""
    exact = [math.lgamma(z + 1) - (z + 0.5) * math.log(z) + z - 0.5 * math.log(2 * math.pi) if z else 0.0 for z in range(16)]

    def error(z):
        x = F.greatest(z.cast("double"), F.lit(16.0))
        series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x
        return F.when(z < 16, F.element_at(F.array(*map(F.lit, exact)), F.least(z, F.lit(15)).cast("int") + 1)).otherwise(series)

    deviance = lambda x, mean: x * F.log(x / mean) + mean - x
    return error(n) - error(k) - error(n - k) - deviance(k, n * alpha) - deviance(n - k, n * (1 - alpha)) + 0.5 * F.log(n / (2 * math.pi * k * (n - k)))


def _tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k); 1 where k is not below the mean."""
    odds = (1 - alpha) / alpha
    # Below the mean the terms fall at least like a normal density: 12 deviations are far below double precision.
    steps = F.least(k, F.ceil(12 * F.sqrt(n * (alpha * (1 - alpha)))) + 64).cast("long")

    def step(a, i):
        term = a["term"] * (k - i + 1) * odds / (n - k + i)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    one = F.lit(1.0)
    below = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), F.struct(one.alias("term"), one.alias("sum")), step, lambda a: a["sum"])
    return F.when(k >= n * alpha, one).when(k == 0, F.exp(n * math.log1p(-alpha))).otherwise(F.exp(_log_tail_steps(n, k, alpha)) * below)


def calibrate(held: DataFrame, labels: DataFrame, stats: str = "stats", stratum: str = "lang", rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA, cost: int = COST, label: str = "quality", key: str = "doc_id") -> DataFrame:
    """One row per stratum with a holdout and rule: stratum, rule, cutoff (null: none is safe and useful), good, false_rejected, bad_rejected, p_value."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__good"))
    held = held.where(~F.col(f"{stats}.base_failed")).select(F.col(key).alias("__key"), F.struct(F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), *[score_of(score, stats).alias(name) for name, (score, _) in rules.items()]).alias("x"))
    held = held.join(marks, "__key").groupBy("__key").agg(F.min("x").alias("x"), (F.max("__good") > 0).alias("good")).select("x.*", "good")
    grid = [(name, c) for name, (_, cutoffs) in rules.items() for c in cutoffs]
    sums = [F.count_if("good").alias("n")]
    for i, (name, c) in enumerate(grid):
        sums += [F.count_if(F.col("good") & (F.col(name) > c)).alias(f"g{i}"), F.count_if(~F.col("good") & (F.col(name) > c)).alias(f"b{i}")]
    tests = held.groupBy("stratum").agg(*sums).select(
        "stratum", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(c).cast("long").alias("cutoff"), F.col(f"g{i}").alias("k"), F.col(f"b{i}").alias("bad")) for i, (name, c) in enumerate(grid)])).alias("t")
    ).select("stratum", "n", "t.*")
    tests = tests.withColumn("p_value", _tail(F.col("n"), F.col("k"), alpha))
    strata = tests.agg(F.count_distinct("stratum").alias("strata"))
    gain = F.col("bad") - cost * F.col("k")
    safe = (F.col("p_value") * F.greatest(F.col("strata"), F.lit(1)) * len(rules) <= delta) & (gain > 0)
    best = tests.join(strata, how="left").groupBy("stratum", "rule").agg(F.max(F.when(safe, F.struct(gain.alias("gain"), F.col("cutoff"), F.col("k"), F.col("bad"), F.col("p_value")))).alias("b"), F.max("n").alias("good"))
    return best.select("stratum", "rule", F.col("b.cutoff").alias("cutoff"), "good", F.col("b.k").alias("false_rejected"), F.col("b.bad").alias("bad_rejected"), F.col("b.p_value").alias("p_value"))


def judge(rows: DataFrame, cutoffs: DataFrame, stats: str = "stats", stratum: str = "lang", rules: dict = RULES, kept: str = "kept") -> DataFrame:
    """``rows`` with ``kept``: false where the base rules or a cutoff of the row's stratum reject."""
    per = cutoffs.where(F.col("cutoff").isNotNull()).groupBy(F.col("stratum").alias("__stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in rules])
    # Written, so that its size is known and Spark broadcasts it only below its threshold.
    per = cut(per, "quality-cutoffs")
    out = rows.join(per, F.coalesce(F.col(stratum).cast("string"), F.lit("und")) == F.col("__stratum"), "left")
    rejected = reduce(lambda a, b: a | b, [F.coalesce(score_of(score, stats) > F.col(f"__{r}"), F.lit(False)) for r, (score, _) in rules.items()])
    return out.withColumn(kept, ~F.col(f"{stats}.base_failed") & ~rejected).drop("__stratum", *[f"__{r}" for r in rules])


def quality_rules(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``; all columns of ``docs`` stay, or those of ``columns``."""
    docs = docs.select(*columns, *{c for c in ("doc_id", "lang", "text") if c not in columns}) if columns else docs
    at = free(docs, "stats")
    # Counting costs more than writing the rows with their counts, which the cutoffs and the verdict then both read.
    rows = docs.withColumn(at, stats_of(F.col("text")))
    rows = cut(rows.select(*columns, *{"lang"} - set(columns), at) if columns else rows, "quality-stats")
    found = judge(rows, calibrate(rows.select("doc_id", "lang", at), labels, at), at, kept=free(docs, "kept"))
    own = columns or docs.columns
    outputs = [F.col(f"{at}.{n}").alias(free(docs.select(*own), n)) for n in (*_STATS, "base_failed")]
    return found.select(*own, *outputs, F.col(free(docs, "kept")).alias(free(docs.select(*own), "kept")))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    scores = {r: s.replace(" div ", " // ") for r, (s, _) in RULES.items()}
    tests = " UNION ALL ".join(f"SELECT '{r}' AS rule, {c} AS cutoff" for r, (_, cutoffs) in RULES.items() for c in cutoffs)
    case = "CASE rule " + " ".join(f"WHEN '{r}' THEN s_{r}" for r in RULES) + " END"
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
wins AS (SELECT rid, i, ws[i:i+4] AS win FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
dups AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_rep FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dups) GROUP BY rid),
st AS (
  SELECT doc_id, stratum, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {', '.join(f'{s} AS s_{r}' for r, s in scores.items())} FROM st),
m AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
g AS ({tests}),
c AS (SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND {case} > cutoff) AS k, count(*) FILTER (NOT good AND {case} > cutoff) AS bad
      FROM (SELECT x.*, good FROM (SELECT min({{'stratum': stratum, {', '.join(f"'s_{r}': s_{r}" for r in RULES)}}}) AS x, any_value(good) AS good FROM f JOIN m USING (doc_id) WHERE NOT base_failed GROUP BY doc_id)) CROSS JOIN g GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln({1 - ALPHA}))) FROM generate_series(0, k) AS s(i)) END AS p_value FROM c),
b AS (SELECT stratum, rule, arg_max(cutoff, (bad - {COST} * k) * 100000 + cutoff) AS cutoff FROM p
      WHERE bad - {COST} * k > 0 AND p_value * (SELECT count(DISTINCT stratum) FROM c) * {len(RULES)} <= {DELTA} GROUP BY stratum, rule)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM b WHERE b.stratum = f.stratum AND {case} > b.cutoff) AS kept
FROM f"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {"op1_quality_rules": _oracle()}
