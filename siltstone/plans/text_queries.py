"""Scalar functions, filters, joins, set operations and OCR rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import layers
from siltstone.plans.base import SPLIT, Registry, split_of, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_S = T.UNICODE_SPACE


def _clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{_S}+', ' ', 'g'))"


_TERMS = (("the", "then", "und", "License"), ("les", "que", "Version"), ("was", "rights", "elle"))


@query(f"SELECT doc_id, {_clean('text')} AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, concat({_clean('source')}, chr(10), {_clean('text')}) AS kept, trim(regexp_replace(concat(source, chr(10), text), '{_S}+', ' ', 'g')) AS joined FROM documents")
def title_and_body(spark, d):
    s, t = F.col("source"), F.col("text")
    return table(spark, d, "documents").select("doc_id", T.joined_parts(s, t).alias("kept"), T.joined_parts(s, t, keep_newline=False).alias("joined"))


@query("SELECT doc_id, substr(sha256(concat(source, '-', doc_id)), 1, 16) AS id FROM documents")
def short_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', '', 'g') AS canonical FROM documents")
def canonical_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.canonical(F.col("text")).alias("canonical"))


@query(f"""SELECT conv_id, turn, regexp_replace(regexp_replace(lower(regexp_replace(text, '^{_S}+|{_S}+$', '', 'g')), '{_S}+', '', 'g'), '{T.COMMENT_PUNCTUATION.replace("'", "''")}', '', 'g') AS key FROM conversations""")
def comment_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.comment_key(F.col("text")).alias("key"))


@query("SELECT source, CASE WHEN n_chars < 100 THEN '<100' WHEN n_chars < 300 THEN '100-299' ELSE '300+' END AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def length_buckets(spark, d):
    return table(spark, d, "documents").groupBy("source", T.length_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"))


def _terms(i):
    return "list_filter([" + ", ".join(f"'{t}'" for t in sorted(_TERMS[i])) + "], lambda t: contains(c, t))"


_SCOPE = f"""SELECT *, 2 * (len(r) >= 1)::INT + (len(k) >= 1)::INT + (len(e) >= 1)::INT + (len(r) >= 2)::INT AS s, length(c) >= 20 AND (len(r) >= 1 OR len(k) >= 1 AND len(e) >= 1) AS ok
FROM (SELECT doc_id, source, c, {_terms(0)} AS r, {_terms(1)} AS k, {_terms(2)} AS e FROM (SELECT doc_id, source, {_clean('text')} AS c FROM documents))"""


def _scoped(spark, d):
    docs = table(spark, d, "documents").withColumn("clean", T.clean_text(F.col("text")))
    return docs.withColumns(T.scope(F.col("clean"), *_TERMS))


@query(f"SELECT doc_id, array_to_string(r, '|') AS recommendation, array_to_string(k, '|') AS commerce, array_to_string(e, '|') AS experience, s AS scope_score, ok AS accepted FROM ({_SCOPE})")
def scope_filter(spark, d):
    return _scoped(spark, d).select("doc_id", *[F.array_join(f"{n}_terms", "|").alias(n) for n in ("recommendation", "commerce", "experience")], "scope_score", "accepted")


@query(f"SELECT source, count(*) AS seen, count(*) FILTER (ok) AS saved FROM ({_SCOPE}) GROUP BY source")
def scope_by_source(spark, d):
    return _scoped(spark, d).groupBy("source").agg(F.count("*").alias("seen"), F.count_if("accepted").alias("saved"))


@query("SELECT l_orderkey, l_linenumber, p, ln(p / (1 - p)) AS margin, 1 / (1 + exp(-(1.5 * ln(p / (1 - p)) - 0.25))) AS calibrated, CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT *, greatest(least(l_discount * 10, 1 - 1e-7), 1e-7) AS p FROM lineitem)")
def calibrated_scores(spark, d):
    p = F.greatest(F.least(F.col("l_discount") * 10, F.lit(1 - 1e-7)), F.lit(1e-7))
    margin = T.log_odds(F.col("l_discount") * 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"), margin.alias("margin"), T.sigmoid(margin, 1.5, -0.25).alias("calibrated"), T.risk_band(F.col("l_discount"), 0.08, 0.04).alias("risk"))


@query("SELECT doc_id, greatest(least(n_chars / 1000.0::DOUBLE, 1.0), 0.0) AS clipped, n_chars / 1000.0::DOUBLE <= 1 AS valid, ((doc_id - 1) % 5 + 5) % 5 AS family FROM documents")
def clip_and_family(spark, d):
    x = F.col("n_chars") / 1000.0
    return table(spark, d, "documents").select("doc_id", T.clip01(x).alias("clipped"), T.valid_score(x).alias("valid"), T.family(F.concat(F.lit("case_"), F.col("doc_id").cast("string"))).alias("family"))


@query("SELECT doc_id, replace(replace(left(replace(text, 'the', '[redacted]'), 1500), 'Version', 'version'), 'version 2', 'v2') AS text FROM documents")
def redacted(spark, d):
    t = T.replace_in_order(T.redact(F.col("text"), ["the"]), [("Version", "version"), ("version 2", "v2")])
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


#: What each URL is, by (conv_id + turn) % 8.
_URLS = ("completed", "completed", "completed", "bad_base64", "bad_base64", "bad_format", "empty", "bad_format")


@query(f"SELECT conv_id, turn, ['{"', '".join(_URLS)}'][(conv_id + turn) % 8 + 1] AS status, CASE WHEN (conv_id + turn) % 8 < 3 THEN octet_length(encode(text)) END AS n_bytes, CASE (conv_id + turn) % 8 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.img' END AS suffix FROM conversations")
def data_urls(spark, d):
    """Valid images of three types, a body with spaces, one without its padding, no base64 mark, no body, and no image."""
    # Spark breaks long base64 into lines, which a data URL must not have.
    body = F.regexp_replace(F.base64(F.encode("text", "utf-8")), "\\s", "")
    urls = [F.concat(F.lit(f"data:image/{t};base64,"), body) for t in ("png", "jpeg", "gif")]
    urls += [F.concat(F.lit("data:image/png;base64,"), F.left(body, F.lit(4)), F.lit(" "), body), F.concat(F.lit("data:image/png;base64,"), F.left(body, F.lit(7)))]
    urls += [F.concat(F.lit("data:image/png,"), body), F.lit("data:image/png;base64,"), F.concat(F.lit("data:text/plain;base64,"), body)]
    rows = table(spark, d, "conversations").withColumn("url", F.get(F.array(*urls), ((F.col("conv_id") + F.col("turn")) % 8).cast("int")))
    return rows.withColumn("x", T.data_url(F.col("url"))).select("conv_id", "turn", "x.status", F.octet_length("x.bytes").cast("long").alias("n_bytes"), "x.suffix")


_WIN = """WITH n AS (SELECT doc_id, (n_chars // 5)::INT AS n FROM documents),
s AS (SELECT doc_id, n, CASE WHEN n <= 63 THEN [0] ELSE list_transform(generate_series(0, ceil((n - 63) / 55.0)::INT), lambda i: least(i * 55, n - 63)) END AS st FROM n),
f AS (SELECT doc_id, n, CASE WHEN len(st) <= 16 THEN st ELSE list_transform(generate_series(0, 15), lambda i: st[round_even(i * (len(st) - 1) / 15.0::DOUBLE, 0)::INT + 1]) END AS st FROM s)
"""


@query(_WIN + "SELECT doc_id, n AS tokens, len(st) AS windows, array_to_string(st, ',') AS starts, list_sum(list_transform(st, lambda x, i: least(x + 63, n) - CASE WHEN i = 1 THEN x ELSE greatest(x, least(st[i - 1] + 63, n)) END))::INT AS covered FROM f")
def token_windows(spark, d):
    n = F.expr("cast(n_chars div 5 as int)")
    rows = table(spark, d, "documents").select("doc_id", n.alias("tokens")).withColumn("w", T.token_windows(F.col("tokens")))
    return rows.select("doc_id", "tokens", F.size("w").cast("long").alias("windows"), F.array_join(F.transform("w", lambda x: x["first"].cast("string")), ",").alias("starts"), T.covered(F.col("w")).alias("covered"))


@query("SELECT n, CASE WHEN n <= 60 THEN 'image_text_alignment' WHEN n <= 85 THEN 'reference_image_comparison' ELSE 'visual_anomaly_experimental' END AS task_type, CASE WHEN n <= 35 THEN 0 WHEN n <= 60 THEN 1 END AS mismatch, CASE WHEN n BETWEEN 61 AND 85 THEN 1 END AS edited, CASE WHEN n > 85 THEN 1 END AS ai_generated, n <= 85 AS eligible, count(*) AS rows FROM (SELECT doc_id % 100 + 1 AS n FROM documents) GROUP BY ALL")
def case_labels(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 100 + 1).alias("n"))
    return rows.withColumns(layers.case_fields(F.col("n"))).groupBy("n", "task_type", "mismatch", "edited", "ai_generated", "eligible").agg(F.count("*").alias("rows"))


@query(f"SELECT d.doc_id, {SPLIT} AS split, CASE WHEN doc_id % 4 < 2 THEN 'train' WHEN doc_id % 4 = 2 THEN 'validation' ELSE 'test' END AS route, CASE WHEN doc_id % 4 < 2 THEN 1 WHEN doc_id % 4 = 2 THEN 2 ELSE 3 END AS priority, 0 AS unknown FROM documents d")
def split_routes(spark, d):
    s = split_of(F.col("doc_id"))
    other = F.get(F.array(*map(F.lit, ("Train_9", "TEST", "training set", "validation"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", s.alias("split"), T.split_route(s).alias("route"), T.split_priority(s).alias("priority"), T.split_priority(other).alias("unknown"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id) WHERE trim(l.quality::VARCHAR) = '0'")
def reviewed_join(spark, d):
    labels = table(spark, d, "labels").where(F.trim(F.col("quality").cast("string")) == "0")
    return labels.join(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


_KEYS = f"replace(regexp_replace(lower(text), '{_S}+', '', 'g'), 'ß', 'ss')"


@query(f"WITH a AS (SELECT doc_id, text, {_KEYS} AS k FROM documents WHERE doc_id % 5 = 0), b AS (SELECT doc_id, upper(replace(text, 'ß', 'ss')) || ' ' AS text, {_KEYS} AS k FROM documents WHERE doc_id % 5 <> 0) SELECT (SELECT count(*) FROM (SELECT text FROM a INTERSECT SELECT text FROM b)) AS shared_texts, (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS shared_keys")
def key_overlap(spark, d):
    """Texts that a set shares with another one whose texts are in capitals: none as they are, all copies by their keys."""
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 5 = 0").select("text", T.overlap_key(F.col("text")).alias("k"))
    b = docs.where("doc_id % 5 <> 0").select(F.concat(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), F.lit(" ")).alias("text"))
    b = b.withColumn("k", T.overlap_key(F.col("text")))
    texts = a.select(F.sha2("text", 256)).intersect(b.select(F.sha2("text", 256))).agg(F.count("*").alias("shared_texts"))
    keys = a.select(F.sha2("k", 256).alias("k")).join(b.select(F.sha2("k", 256).alias("k")).distinct(), "k", "left_semi").agg(F.count("*").alias("shared_keys"))
    return texts.crossJoin(keys)


@query("SELECT md5(text) AS text_key, count(DISTINCT s) AS splits, count(*) AS rows FROM (SELECT text, doc_id % 3 AS s FROM documents) GROUP BY text HAVING count(DISTINCT s) = 3")
def texts_in_all_splits(spark, d):
    rows = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_key"), (F.col("doc_id") % 3).alias("s"))
    return rows.groupBy("text_key").agg(F.count_distinct("s").alias("splits"), F.count("*").alias("rows")).where("splits = 3")


@query("SELECT 'documents' AS source_table, lang AS kind, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role UNION ALL SELECT 'benchmark', NULL, count(*) FROM benchmark")
def union_of_sources(spark, d):
    parts = [table(spark, d, "documents").select(F.lit("documents").alias("source_table"), F.col("lang").alias("kind"), "text"), table(spark, d, "conversations").select(F.lit("conversations").alias("source_table"), F.col("role").alias("kind"), "text"), table(spark, d, "benchmark").select(F.lit("benchmark").alias("source_table"), "text")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("source_table", "kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id, len(c) >= 5 AS enough, len(c) AS n, array_to_string(list_transform(c[1:3], lambda x: left(x, 20)), '|') AS firsts FROM (SELECT conv_id, list(trim(text) ORDER BY turn) FILTER (trim(text) <> '') AS c FROM conversations GROUP BY conv_id)")
def comment_groups(spark, d):
    got = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    c = F.slice(T.clean_comments(F.transform("c", lambda x: x["text"])), 1, 30)
    return got.withColumn("c", c).select("conv_id", (F.size("c") >= 5).alias("enough"), F.size("c").cast("long").alias("n"), F.array_join(F.transform(F.slice("c", 1, 3), lambda x: F.left(x, F.lit(20))), "|").alias("firsts"))


@query("SELECT doc_id, CASE WHEN n_chars < 20 THEN 'insufficient_text' ELSE 'completed' END AS status, CASE WHEN n_chars >= 20 THEN 1 / (1 + exp(-(2 * ln(p / (1 - p)) + 0.1))) END AS calibrated, CASE WHEN n_chars >= 20 THEN (1 / (1 + exp(-(2 * ln(p / (1 - p)) + 0.1))) >= 0.5)::INT END AS label, CASE WHEN n_chars < 20 THEN 'unknown' WHEN 1 / (1 + exp(-(2 * ln(p / (1 - p)) + 0.1))) >= 0.5 THEN 'ai_involved' ELSE 'human' END AS prediction, CASE WHEN text = '' THEN 'unknown' WHEN score >= 0.55 THEN 'covert_ad' ELSE 'normal' END AS ad_prediction FROM (SELECT doc_id, text, length(trim(text)) AS n_chars, (doc_id % 97 + 1) / 100.0::DOUBLE AS score, greatest(least((doc_id % 97 + 1) / 100.0::DOUBLE, 1 - 1e-7), 1e-7) AS p FROM documents)")
def text_verdicts(spark, d):
    rows = table(spark, d, "documents").withColumn("score", (F.col("doc_id") % 97 + 1) / 100.0)
    return layers.covert_ad(layers.authorship(rows, "text", "score", 2.0, 0.1), "text", "score").select("doc_id", "status", "calibrated", "label", "prediction", "ad_prediction")


_ALIGN = "SELECT vec_id, label AS post, embedding[1]::DOUBLE AS sim, (vec_id % 3 + 1)::INT AS windows, CASE WHEN vec_id % 4 = 0 THEN 0.75 ELSE 1.0 END AS coverage FROM embeddings"
_VERDICT = f"SELECT *, CASE WHEN windows > 1 AND coverage >= 1 THEN 0.05 ELSE 0.0278 END AS threshold, windows > 1 AND coverage < 1 AS provisional FROM ({_ALIGN})"


@query(f"SELECT post, count(*) AS images, count(*) FILTER (NOT provisional) AS completed, bool_or(NOT provisional AND sim < threshold) AS any_mismatch, bool_and(provisional) AS all_provisional, min(coverage) FILTER (provisional)::DOUBLE AS least_coverage, CASE WHEN bool_or(NOT provisional AND sim < threshold) THEN 'high' WHEN count(*) FILTER (NOT provisional) > 0 THEN 'low' ELSE 'unknown' END AS risk FROM ({_VERDICT}) GROUP BY post")
def image_verdicts(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("post"), F.col("embedding")[0].cast("double").alias("sim"), (F.col("vec_id") % 3 + 1).cast("int").alias("windows"), F.when(F.col("vec_id") % 4 == 0, 0.75).otherwise(1.0).alias("coverage"))
    return layers.image_rollup(layers.alignment(rows, "sim", "windows", "coverage", 0.0278, 0.05), "post")


@query("SELECT doc_id, '{\"layer1\":{\"status\":\"' || CASE WHEN n_chars < 20 THEN 'insufficient_text' ELSE 'completed' END || '\"' || CASE WHEN n_chars >= 20 THEN ',\"label\":' || (doc_id % 2) ELSE '' END || '},\"layer2\":{\"risk\":\"' || CASE WHEN doc_id % 10 >= 6 THEN 'high' WHEN doc_id % 10 >= 3 THEN 'medium' ELSE 'low' END || '\"}}' AS evidence, CASE WHEN n_chars < 20 THEN 'longer text' ELSE '' END AS missing FROM documents")
def four_layer_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    one = docs.select("doc_id", F.struct(F.when(F.col("n_chars") < 20, "insufficient_text").otherwise("completed").alias("status"), F.when(F.col("n_chars") >= 20, F.col("doc_id") % 2).alias("label")).alias("layer1"))
    two = docs.select("doc_id", F.struct(T.risk_band(F.col("doc_id") % 10, 6, 3).alias("risk")).alias("layer2"))
    report = docs.select("doc_id").join(one, "doc_id", "left").join(two, "doc_id", "left")
    return report.select("doc_id", layers.evidence({"layer1": ["status", "label"], "layer2": ["risk"]}).alias("evidence"), F.array_join(layers.missing_inputs({"l1": "layer1.status"}, {"l1": "longer text"}), ",").alias("missing"))


#: Lines that end a card, one of each kind; a row of turn 2, 5 and so on is one of them.
_ENDS = ("2 hours ago", "2024-03-05 回复", "3天前", "昨天 10:20", "Like 12 reply", "赞 3", "View 4 replies", "展开 2 条回复")
_ENDING = "['" + "', '".join(_ENDS) + "'][(conv_id + turn) % 8 + 1]"
_CARD = f"SELECT conv_id AS image_id, turn, turn % 3 = 2 AS e, CASE WHEN turn % 3 = 2 THEN {_ENDING} ELSE text END AS text, (0.5 + turn / 100.0)::DOUBLE AS confidence, (70 + CASE WHEN turn = 4 THEN 40 ELSE 0 END)::DOUBLE AS l, (turn * CASE WHEN conv_id % 5 = 0 THEN 9 ELSE 30 END)::DOUBLE AS t, CASE WHEN conv_id % 5 = 0 THEN 6 ELSE 22 END AS h FROM conversations"


@query(f"""WITH r AS ({_CARD}),
s AS (SELECT *, sum(e::INT) OVER (PARTITION BY image_id ORDER BY t) AS ends FROM r),
k AS (SELECT *, lag(ends) OVER w IS NULL OR lag(ends) OVER w <> ends OR t - lag(t) OVER w > 1.9 * h OR abs(l - lag(l) OVER w) > 0.75 * h AS new FROM s WHERE NOT e WINDOW w AS (PARTITION BY image_id ORDER BY t)),
c AS (SELECT *, sum(new::INT) OVER (PARTITION BY image_id ORDER BY t) AS card FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id, card ORDER BY t) AS n FROM c),
g AS (SELECT image_id, card, trim(string_agg(text, '' ORDER BY n)) AS text, round(avg(confidence), 4) AS confidence, min(l) AS l, min(t) AS top, any_value(h) AS h FROM b WHERE n > 1 GROUP BY image_id, card),
m AS (SELECT *, (SELECT count(*) FROM g x WHERE x.image_id = g.image_id AND abs(x.l - g.l) <= 0.75 * g.h) AS near FROM g),
z AS (SELECT *, first_value(l) OVER (PARTITION BY image_id ORDER BY near DESC, l) AS root FROM m)
SELECT image_id, card, text, confidence, l AS "left", top FROM z WHERE abs(l - root) <= 0.75 * h""")
def comment_cards(spark, d):
    """Cards from rows of two heights; rows of 3 pixels count as 6 high, the least height."""
    c, flat = table(spark, d, "conversations"), F.col("conv_id") % 5 == 0
    end = F.get(F.array(*map(F.lit, _ENDS)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    text = F.when(F.col("turn") % 3 == 2, end).otherwise(F.col("text"))
    left, top = (F.lit(70) + F.when(F.col("turn") == 4, 40).otherwise(0)).cast("double"), (F.col("turn") * F.when(flat, 9).otherwise(30)).cast("double")
    rows = c.select(F.col("conv_id").alias("image_id"), text.alias("text"), (F.lit(0.5) + F.col("turn") / 100.0).alias("confidence"), left.alias("left"), top.alias("top"), (left + 200).alias("right"), (top + F.when(flat, 3).otherwise(22)).alias("bottom"))
    return layers.comment_cards(rows).select("image_id", "card", "text", "confidence", "left", "top")


@query("SELECT severity, message, count(*) AS n FROM (SELECT 'error' AS severity, 'label is not 0 or 1' AS message FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT 'warning', 'under 100 characters' FROM documents WHERE length(text) < 100 UNION ALL SELECT 'warning', 'copied text' FROM (SELECT count(*) OVER (PARTITION BY text) AS c FROM documents) WHERE c > 1) GROUP BY ALL")
def validation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("k"))
    copied = docs.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    rows = docs.join(copied, "k", "left")
    a = layers.violations(rows, [("warning", "under 100 characters", F.col("n") < 100), ("warning", "copied text", F.col("c").isNotNull())], "doc_id")
    b = layers.violations(table(spark, d, "labels"), [("error", "label is not 0 or 1", ~F.col("quality").isin(0, 1))], "doc_id")
    return a.union(b).groupBy("severity", "message").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT CASE WHEN turn = 0 THEN 'H' ELSE 'L' || turn END)), ',') AS variants FROM conversations GROUP BY conv_id HAVING count(*) NOT IN (1, 5) OR max(turn) <> count(*) - 1")
def variant_groups(spark, d):
    rows = table(spark, d, "conversations").withColumn("variant", F.when(F.col("turn") == 0, "H").otherwise(F.concat(F.lit("L"), F.col("turn").cast("string"))))
    return layers.variant_groups(rows, "conv_id", "variant").select("conv_id", "n", F.array_join("variants", ",").alias("variants"))


_PIX = "SELECT o_custkey % 50 AS image_id, abs(o_totalprice::BIGINT % 256 - (o_totalprice::BIGINT // 7) % 256)::DOUBLE AS d FROM (SELECT o_custkey, floor(o_totalprice) AS o_totalprice FROM orders)"


@query(f"""WITH p AS ({_PIX}), m AS (SELECT image_id, median(d) AS mid FROM p GROUP BY image_id), a AS (SELECT image_id, any_value(mid) AS mid, median(abs(d - mid)) AS mad FROM p JOIN m USING (image_id) GROUP BY image_id),
t AS (SELECT image_id, least(greatest(mid + 6 * 1.4826 * mad, 12.0), 80.0) AS threshold FROM a)
SELECT image_id, any_value(threshold) AS threshold, avg(d) / 255 AS difference_mean, quantile_cont(d, 0.995) / 255 AS difference_p995, count(*) FILTER (d > threshold) / count(*)::DOUBLE AS changed_ratio FROM p JOIN t USING (image_id) GROUP BY image_id""")
def pixel_differences(spark, d):
    x = F.floor("o_totalprice").cast("long")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("image_id"), F.lit(0).alias("b"), F.lit(0).alias("g"), (x % 256).alias("r"), F.lit(0).alias("rb"), F.lit(0).alias("rg"), F.pmod(F.floor(x / 7), F.lit(256)).alias("rr"))
    return layers.pixel_differences(rows)
