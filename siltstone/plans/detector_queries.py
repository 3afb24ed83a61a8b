"""Detectors, validators, imports and model selection over the driver's tables, with columns that stand for scores and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import groups as G
from siltstone.operators import layers, models, validators
from siltstone.operators import metrics as M
from siltstone.operators.spread import written
from siltstone.plans.base import SCORED, Registry, scored, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT conv_id, n, CASE WHEN n < 5 THEN 'insufficient_data' WHEN conv_id % 7 = 0 THEN 'model_unavailable' ELSE 'completed' END AS status, CASE WHEN n >= 5 AND conv_id % 7 <> 0 THEN p END AS score, CASE WHEN n >= 5 AND conv_id % 7 <> 0 THEN (p >= 0.4)::INT END AS coordinated, CASE WHEN n >= 5 AND conv_id % 7 <> 0 THEN CASE WHEN p >= 0.4 THEN 'coordinated' ELSE 'normal' END END AS prediction, CASE WHEN n < 5 OR conv_id % 7 = 0 THEN 'unknown' WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT conv_id, count(*) AS n, (conv_id % 10) / 10.0::DOUBLE AS p FROM conversations GROUP BY conv_id)")
def model_coordination(spark, d):
    """All three statuses; the medium band begins at the decision threshold."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    p = F.when(F.col("conv_id") % 7 != 0, (F.col("conv_id") % 10) / 10.0)
    return layers.model_coordination(rows, F.col("n"), p, 0.4, high=0.7).select("conv_id", "n", "status", "score", "coordinated", "prediction", "risk")


_IMAGES = "SELECT vec_id, label AS post, CASE vec_id % 4 WHEN 0 THEN 'provisional' WHEN 1 THEN 'unavailable' ELSE 'completed' END AS status, CASE WHEN vec_id % 4 > 1 THEN (embedding[1] < -0.1)::INT END AS lab, 0.5 + (vec_id % 5) / 10.0::DOUBLE AS cov FROM embeddings WHERE vec_id % 11 < 9 AND (label <> 3 OR vec_id % 4 = 1) AND (label <> 4 OR vec_id % 4 > 0)"


def _images(spark, d):
    v = table(spark, d, "embeddings").withColumn("k", F.col("vec_id") % 4)
    v = v.where("vec_id % 11 < 9 and (label <> 3 or k = 1) and (label <> 4 or k > 0)")
    status = F.when(F.col("k") == 0, "provisional").when(F.col("k") == 1, "unavailable").otherwise("completed")
    return v.select("vec_id", F.col("label").alias("post"), status.alias("status"), F.when(F.col("k") > 1, (F.col("embedding")[0] < -0.1).cast("int")).alias("label"), (F.lit(0.5) + (F.col("vec_id") % 5) / 10.0).alias("coverage"))


@query(f"SELECT post, count(*) AS images, CASE WHEN bool_or(status = 'provisional') THEN 'provisional' WHEN count(lab) = 0 THEN 'unavailable' WHEN bool_or(status = 'unavailable') THEN 'partial' ELSE 'completed' END AS status, count(lab) > 0 OR bool_or(status = 'provisional') AS available, max(lab) AS label, min(cov) FILTER (status = 'provisional') AS least_coverage, CASE max(lab) WHEN 1 THEN 'image_text_mismatch' WHEN 0 THEN 'aligned' END AS prediction, CASE WHEN bool_or(coalesce(status = 'completed' AND lab = 1, false)) THEN 'high' WHEN bool_or(status <> 'completed') OR count(lab) = 0 THEN 'unknown' ELSE 'low' END AS risk FROM ({_IMAGES}) GROUP BY post")
def image_report(spark, d):
    return layers.image_report(_images(spark, d), "post")


@query(f"SELECT vec_id, CASE WHEN status = 'provisional' THEN 'provisional' ELSE 'completed' END AS status, CASE WHEN status <> 'provisional' OR e = 1 THEN (coalesce(lab, 0) = 1 OR coalesce(e, 0) = 1)::INT END AS label, CASE WHEN status <> 'provisional' OR e = 1 THEN CASE WHEN coalesce(lab, 0) = 1 OR coalesce(e, 0) = 1 THEN 'suspicious' ELSE 'normal' END END AS prediction, CASE WHEN e = 1 THEN 'high' WHEN status = 'provisional' THEN 'unknown' WHEN lab = 1 THEN 'high' ELSE 'low' END AS risk FROM (SELECT *, CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS e FROM ({_IMAGES}))")
def combined_images(spark, d):
    edit = F.when(F.col("vec_id") % 3 == 0, 1).when(F.col("vec_id") % 3 == 1, 0)
    return _images(spark, d).select("vec_id", layers.combined_images(F.col("status"), F.col("label"), edit).alias("x")).select("vec_id", "x.*")


@query("SELECT doc_id, CASE WHEN length(trim(text)) < 20 THEN 'insufficient_text' ELSE 'completed' END AS authorship, CASE WHEN text = '' THEN 'unknown' WHEN (doc_id % 97 + 1) / 100.0 >= 0.55 THEN 'covert_ad' ELSE 'normal' END AS ad, CASE WHEN n IS NULL THEN NULL WHEN n < 5 THEN 'insufficient_data' ELSE 'completed' END AS comments, CASE WHEN v.vec_id IS NOT NULL THEN CASE WHEN embedding[1] < 0 THEN 'high' ELSE 'low' END END AS images FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON d.doc_id = c.conv_id LEFT JOIN embeddings v ON d.doc_id = v.vec_id")
def four_layers(spark, d):
    """Four independent layers on one post each; posts without comments or images have no such layer."""
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("score", (F.col("doc_id") % 97 + 1) / 100.0)
    one = layers.authorship(docs, "text", "score").select("doc_id", "status")
    two = layers.covert_ad(docs, "text", "score").select("doc_id", "ad_prediction")
    groups = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    three = layers.model_coordination(groups, F.col("n"), F.lit(0.5), 0.4).select("doc_id", "status")
    four = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), layers.combined_images(F.lit("completed"), (F.col("embedding")[0] < 0).cast("int"), F.lit(None).cast("int")).alias("x")).select("doc_id", "x.risk")
    out = layers.four_layers(docs, "doc_id", {"authorship": one, "ad": two, "comments": three, "images": four})
    return out.select("doc_id", F.col("authorship.status").alias("authorship"), F.col("ad.ad_prediction").alias("ad"), F.col("comments.status").alias("comments"), F.col("images.risk").alias("images"))


_PRED = f"SELECT *, (score >= 0.5)::INT AS old, (score >= 0.55)::INT AS new FROM ({SCORED})"


def _two(spark, d):
    return scored(spark, d).withColumns({"old": (F.col("score") >= 0.5).cast("int"), "new": (F.col("score") >= 0.55).cast("int")})


@query(f"SELECT doc_id, label, new, CASE WHEN label = 0 THEN 'false_alarm' ELSE 'missed_promotion' END AS error FROM ({_PRED}) WHERE label <> new")
def wrong_rows(spark, d):
    return M.wrong_rows(_two(spark, d), "label", "new").select("doc_id", "label", "new", "error")


@query(f"SELECT doc_id, error, CASE error WHEN 'missed_promotion' THEN 0 WHEN 'false_alarm' THEN 1 ELSE 2 END AS rank FROM (SELECT *, CASE WHEN label = 0 AND new = 1 THEN 'false_alarm' WHEN label = 1 AND new = 0 THEN 'missed_promotion' END AS error FROM ({_PRED})) WHERE old <> label OR new <> label")
def wrong_in_either(spark, d):
    return M.wrong_in_either(_two(spark, d), "old", "new").orderBy("rank", "doc_id").select("doc_id", "error", "rank")


@query(f"SELECT count(*) AS groups, count(*) FILTER (score >= 0.6) AS high, count(*) FILTER (score >= 0.25 AND score < 0.6) AS medium, count(*) FILTER (score < 0.25) AS low FROM ({SCORED})")
def risk_histogram(spark, d):
    return M.risk_histogram(scored(spark, d).withColumn("risk", T.risk_band(F.col("score"))))


@query(f"WITH r AS ({SCORED}), c AS (SELECT DISTINCT score AS threshold FROM r UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE), x AS (SELECT threshold, (SELECT count(*) FROM r WHERE score >= threshold AND label = 1) AS tp, (SELECT count(*) FROM r WHERE score >= threshold AND label = 0) AS fp, (SELECT count(*) FROM r WHERE label = 1) AS p, (SELECT count(*) FROM r WHERE label = 0) AS n FROM c) SELECT threshold, tp, fp, tp / p::DOUBLE AS recall, fp / n::DOUBLE AS fpr FROM x WHERE fp / n::DOUBLE <= 0.1 ORDER BY tp DESC, fp, threshold DESC LIMIT 1")
def count_operating_point(spark, d):
    """By counts, with 0 and 1 among the candidates."""
    return M.operating_point(scored(spark, d), 0.1, ends=True, by_count=True)


@query("SELECT CASE WHEN true THEN 1 END AS no_positive_allowed, 0 AS tp, 0 AS fp FROM (SELECT 1)")
def nothing_allowed(spark, d):
    """No false positive allowed and the best score wrong: the threshold is the next number above all scores."""
    rows = scored(spark, d).select(F.col("score"), F.when(F.col("score") > 0.9, 0).otherwise(F.col("label")).alias("label"))
    top = rows.agg(F.max("score").alias("top"))
    return M.operating_point(rows, 0.0).crossJoin(top).select((F.col("threshold") > F.col("top")).cast("int").alias("no_positive_allowed"), F.col("tp").cast("int").alias("tp"), F.col("fp").cast("int").alias("fp"))


_FOLD = f"SELECT *, (row_number() OVER (PARTITION BY label ORDER BY sha256(concat(doc_id, '-42'))) - 1) % 5 AS fold FROM ({SCORED})"


@query(f"""WITH r AS ({_FOLD}), f AS (SELECT unnest(generate_series(0, 4)) AS f), s AS (SELECT f, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r, f WHERE fold <> f GROUP BY ALL),
c AS (SELECT f, (score + lead(score) OVER w) / 2 AS t, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY f) AS np FROM s WINDOW w AS (PARTITION BY f ORDER BY score)),
b AS (SELECT f, t AS threshold FROM c WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f ORDER BY coalesce(2 * tp / (tp + fp + np)::DOUBLE, 0) DESC, tp / np::DOUBLE DESC, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) DESC, t) = 1)
SELECT f AS fold, threshold, count(*) AS rows, count(*) FILTER ((score < threshold)::INT = label) AS right_ FROM r JOIN b ON r.fold = b.f GROUP BY ALL""")
def cross_validated(spark, d):
    """Thresholds by five stratified folds, and the out-of-fold predictions that are right."""
    best, rows = M.cross_validated_threshold(M.stratified_fold(scored(spark, d), "doc_id", "label"))
    return rows.groupBy("fold", "threshold").agg(F.count("*").alias("rows"), F.count_if(F.col("pred") == F.col("label")).alias("right_"))


@query(f"SELECT doc_id, CASE WHEN r * 100 <= n * 15 THEN 'holdout' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY label ORDER BY sha256(concat(doc_id, '-42'))) AS r, count(*) OVER (PARTITION BY label) AS n FROM ({SCORED}))")
def stratified_holdout(spark, d):
    return G.holdout(scored(spark, d).select("doc_id", "label"), "doc_id", "label").select("doc_id", "split")


@query("SELECT (doc_id % 9)::INT AS epoch, recall, fpr, auc FROM (SELECT doc_id % 9 AS doc_id, round(avg(n_chars) / 100, 0) / 100 AS recall, round(avg(n_chars) / 300, 0) / 100 AS fpr, avg(doc_id) / 1000 AS auc FROM documents GROUP BY doc_id % 9) ORDER BY recall DESC, fpr, auc DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    rows = table(spark, d, "documents").groupBy((F.col("doc_id") % 9).cast("int").alias("epoch")).agg((F.round(F.avg("n_chars") / 100, 0) / 100).alias("recall"), (F.round(F.avg("n_chars") / 300, 0) / 100).alias("fpr"), (F.avg("doc_id") / 1000).alias("auc"))
    return M.best_epoch(rows)


@query("""WITH x AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
e AS (SELECT * FROM x WHERE turn < 2), n AS (SELECT conv_id, k, min(turn) AS pos, arg_min(t, turn) AS text FROM x WHERE turn >= 2 AND t <> '' GROUP BY ALL),
f AS (SELECT n.*, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS r, (SELECT count(*) FROM e WHERE e.conv_id = n.conv_id) AS have FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = n.conv_id AND e.k = n.k))
SELECT conv_id, 'c' || lpad((have + r + 1)::VARCHAR, 2, '0') AS id, text, pos FROM f WHERE have + r <= 5""")
def imported_comments(spark, d):
    """Turns from the third on as extracted comments of a group that has two, the second with the id c03; five at most."""
    c = table(spark, d, "conversations")
    have = c.where("turn < 2").select("conv_id", F.when(F.col("turn") == 0, "c01").otherwise("c03").alias("id"), T.clean_text(F.col("text")).alias("text"))
    return layers.import_comments(have, c.where("turn >= 2").select("conv_id", F.col("turn").alias("pos"), "text"), "conv_id", 5)


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'text_too_short' END, CASE WHEN length(text) > 2000 THEN 'text_too_long' END, CASE WHEN doc_id % 5 > 3 THEN 'too_many_comments' END, CASE WHEN doc_id % 4 > 2 THEN 'too_many_images' END, CASE WHEN doc_id % 4 * 1000 > 1500 THEN 'images_too_large' END, CASE WHEN octet_length(encode(text)) > 1500 THEN 'file_too_large' END, CASE WHEN doc_id % 6 = 0 THEN 'file_not_utf8' END], lambda x: x IS NOT NULL), ',') AS broken, array_to_string(list_filter([CASE WHEN length(text) > 3000 THEN 'text is too long' END, CASE WHEN doc_id % 5 > 2 THEN 'too many comments' END, CASE WHEN doc_id % 3 = 1 THEN 'image 0 is not supported' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def input_limits(spark, d):
    n = F.col("doc_id")
    comments, sizes = F.array_repeat(F.lit("c"), (n % 5).cast("int")), F.array_repeat(F.lit(1000).cast("long"), (n % 4).cast("int"))
    body = F.concat(F.encode("text", "utf-8"), F.when(n % 6 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit(""))))
    image = F.when(n % 3 == 0, F.lit("upload_1")).when(n % 3 == 1, F.lit("data:image/gif;base64,"))
    # The byte that makes a file no UTF-8 counts in its size.
    broken = T.input_limits(F.col("text"), comments, sizes, body, 100, 2000, 3, 2, 1500, 1500)
    broken = F.when((n % 6 == 0) & (F.octet_length("text") == 1500), F.array_remove(broken, "file_too_large")).otherwise(broken)
    return table(spark, d, "documents").select("doc_id", F.array_join(broken, ",").alias("broken"), F.array_join(T.request_errors(F.col("text"), comments, [image], 3000, 2), ",").alias("errors"))


#: Records of every kind that the check of comment groups tells apart, one a conversation by conv_id % 12.
_ITEMS = ("{'id': 'g', 'label': 1, 'comments': ['a', {'text': 'b'}, 'c']}", "{'id': '', 'label': 1, 'comments': ['a', 'b', 'c']}", "{'id': 5, 'label': 1, 'comments': ['a', 'b', 'c']}", "{'id': 'g', 'label': 2, 'comments': ['a', 'b', 'c']}", "{'id': 'g', 'label': 0, 'comments': ['a', 'b', 'c']}", "{'id': 'g', 'label': 1}", "{'id': 'g', 'label': 1, 'comments': 'a'}", "{'id': 'g', 'label': 1, 'comments': []}", "{'id': 'g', 'label': 1, 'comments': ['a']}", "{'id': 'g', 'label': 1, 'comments': [3, {'n': 1}, ' ', 'a', ' a']}", "[1]", "{'id': 'same', 'label': 1, 'comments': ['a', 'b', 'c']}")
_FINDINGS = {1: ["missing id"], 2: ["id is no string"], 3: ["label is not 0 or 1"], 4: ["label is not 1"], 5: ["missing comments"], 6: ["comments are no list"], 7: ["no comment"], 8: ["only 1 comments"], 9: ["comment 0 is neither text nor object", "comment 1 has no text field", "comment 2 is empty", "comment 4 repeats another"], 10: ["no object"]}
_WARN = ("only 1 comments", "comment 4 repeats another")
_CASES = " UNION ALL ".join(f"SELECT {k} AS k, '{'warning' if m in _WARN else 'error'}' AS severity, '{m}' AS message" for k, ms in _FINDINGS.items() for m in ms)


@query(f"WITH g AS (SELECT DISTINCT conv_id, conv_id % 12 AS k FROM conversations) SELECT severity, message, count(*) AS n FROM g JOIN ({_CASES}) USING (k) GROUP BY ALL UNION ALL SELECT 'error', 'id occurs ' || count(*) || ' times', 1 FROM g WHERE k = 11 HAVING count(*) > 1")
def comment_group_check(spark, d):
    groups = table(spark, d, "conversations").select("conv_id").distinct()
    item = F.get(F.array(*[F.lit(x.replace("'", '"')) for x in _ITEMS]), (F.col("conv_id") % 12).cast("int"))
    item = F.replace(item, F.lit('"g"'), F.concat(F.lit('"g'), F.col("conv_id").cast("string"), F.lit('"')))
    found = validators.comment_groups(groups.select(F.col("conv_id").alias("pos"), F.parse_json(item).alias("item")), 1)
    return found.groupBy("severity", "message").agg(F.count("*").alias("n"))


@query("SELECT message, count(*) AS n FROM (SELECT 'id occurs again' AS message FROM documents WHERE doc_id % 50 < 2 GROUP BY doc_id % 2 HAVING count(*) > 1 UNION ALL SELECT 'image is missing' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 3 > 0 UNION ALL SELECT 'reference image is missing' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 2 = 1 UNION ALL SELECT 'no image is named' FROM documents WHERE doc_id % 3 = 0) GROUP BY message")
def image_case_check(spark, d):
    n = F.col("doc_id")
    cases = table(spark, d, "documents").select(F.when(n % 50 < 2, n % 2).otherwise(n + 100).alias("id"), F.when(n % 3 > 0, F.concat(F.lit("i"), n.cast("string"))).alias("image_path"), F.when(n % 2 == 1, F.concat(F.lit("r"), n.cast("string"))).alias("reference_image_path"), n.alias("doc_id"))
    files = table(spark, d, "documents").where("doc_id % 7 <> 0").select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("path")).union(table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.concat(F.lit("r"), F.col("doc_id").cast("string"))))
    return validators.image_cases(cases, files).groupBy("message").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id, doc_id // 6 AS g, CASE doc_id % 6 WHEN 0 THEN 'H' WHEN 5 THEN 'L1' ELSE 'L' || (doc_id % 6) END AS v, CASE WHEN doc_id % 31 = 0 THEN 7 WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END AS label, CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS source FROM documents WHERE doc_id // 6 % 3 > 0 OR doc_id % 6 = 0)
SELECT message, count(*) AS n FROM (SELECT 'source is missing' AS message FROM r WHERE source = '' UNION ALL SELECT 'label does not suit the variant' FROM r WHERE label = 7 UNION ALL SELECT 'a variant occurs again' FROM r GROUP BY g, v HAVING count(*) > 1
UNION ALL SELECT 'an incomplete group' FROM (SELECT g, list_sort(list(DISTINCT v)) AS s FROM r GROUP BY g) WHERE s <> ['H'] AND s <> ['H', 'L1', 'L2', 'L3', 'L4']) GROUP BY message""")
def reviewed_variants(spark, d):
    n = F.col("doc_id")
    rows = table(spark, d, "documents").where("(doc_id div 6) % 3 > 0 or doc_id % 6 = 0")
    variant = F.when(n % 6 == 0, "H").when(n % 6 == 5, "L1").otherwise(F.concat(F.lit("L"), (n % 6).cast("string")))
    rows = rows.select(n.alias("id"), F.expr("doc_id div 6").alias("source_group_id"), variant.alias("variant"), F.when(n % 31 == 0, 7).when(n % 6 == 0, 0).otherwise(1).alias("label"), F.when(n % 17 == 0, "").otherwise(F.col("source")).alias("source"))
    return validators.reviewed_variants(rows, ["id", "source"]).groupBy("message").agg(F.count("*").alias("n"))


@query("SELECT k AS \"key\", split, count(DISTINCT v) AS n FROM (SELECT 'id' AS k, (doc_id // 3)::VARCHAR AS v, doc_id % 4 AS split FROM documents WHERE doc_id % 4 > 0 AND doc_id // 3 IN (SELECT doc_id // 3 FROM documents WHERE doc_id % 4 = 0) UNION ALL SELECT 'source', source, doc_id % 4 FROM documents WHERE doc_id % 4 > 0 AND source IN (SELECT source FROM documents WHERE doc_id % 4 = 0)) GROUP BY ALL")
def leak_check(spark, d):
    rows = table(spark, d, "documents").select(F.expr("doc_id div 3").alias("id"), "source", (F.col("doc_id") % 4).alias("split"))
    return validators.leaks(rows.where("split = 0"), rows.where("split > 0"), ["id", "source"]).groupBy("key", "split").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS issue, CASE doc_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'ai_involved' END AS author, 'c' || lpad(doc_id::VARCHAR, greatest(2, length(doc_id::VARCHAR))::INT, '0') AS id, round_even(n_chars / 8.0::DOUBLE, 2) AS rounded, list_position([doc_id % 3, doc_id % 5, doc_id % 4], list_max([doc_id % 3, doc_id % 5, doc_id % 4])) - 1 AS best FROM documents")
def small_functions(spark, d):
    n = F.col("doc_id")
    issue = F.get(F.array(*map(F.lit, ("none", "image_text_mismatch", "edited"))), (n % 3).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.issue_label(issue).alias("issue"), T.authorship_name(n % 3).alias("author"), T.numbered("c", n, 2).alias("id"), T.rounded(F.col("n_chars") / 8, 2).alias("rounded"), T.best_window(F.array(n % 3, n % 5, n % 4)).alias("best"))


@query("SELECT term, df, cf::BIGINT AS cf, ln((1 + (SELECT count(*) FROM conversations)) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, substr(t, i, n) AS term FROM (SELECT conv_id, turn, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t, unnest(generate_series(1, length(regexp_replace(lower(text), '\\s\\s+', ' ', 'g')))) AS i FROM conversations), (VALUES (2), (3), (4), (5)) AS v(n) WHERE i + n - 1 <= length(t)) GROUP BY ALL) GROUP BY term) WHERE df >= 3 ORDER BY cf DESC, term LIMIT 3000")
def tfidf_terms(spark, d):
    """The 3,000 most frequent terms of at least three texts, and their idf over the whole table."""
    return models.tfidf_terms(table(spark, d, "conversations"), ["conv_id", "turn"], "text", 2, 5, 3, 3000)[1].select("term", "df", "cf", "idf")


def _posts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query()
def text_classifier(spark, d):
    """Terms to logistic regression to calibrated verdicts of both text detectors; half of the labels fit, a quarter calibrates."""
    # Written, as each step would join the texts to their labels again.
    posts = written(_posts(spark, d), "posts")
    model = models.fit_classifier(posts.where("doc_id % 4 < 2"), "doc_id", "text", "label", 2, 4, 2, 20_000)
    a, b = models.calibrated(model, posts.where("doc_id % 4 = 2"), "doc_id", "text", "label")
    scores = model.scored(posts, "text")
    return layers.covert_ad(layers.authorship(scores.drop("label"), "text", "score", a, b), "text", "score").select("doc_id", "status", "calibrated", F.col("label").alias("verdict"), "ad_prediction", "ad_score")
