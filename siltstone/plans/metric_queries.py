"""Counts, metrics and threshold selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import length_bucket
from siltstone.operators import layers
from siltstone.operators import metrics as M
from siltstone.operators.spread import written
from siltstone.plans.base import SCORED, SPLIT, Registry, scored, split_of, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_P = f"SELECT *, (score >= 0.5)::INT AS pred, CASE WHEN n_chars < 100 THEN '<100' WHEN n_chars < 300 THEN '100-299' ELSE '300+' END AS bucket FROM ({SCORED})"
_CELLS = "count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp"
_RATES = "coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS fpr"


def _predicted(spark, d):
    return scored(spark, d).withColumn("pred", (F.col("score") >= 0.5).cast("int")).withColumn("bucket", length_bucket(F.col("n_chars")))


@query(f"SELECT source, tn, fp, fn, tp, {_RATES} FROM (SELECT source, {_CELLS} FROM ({_P}) GROUP BY source)")
def confusion_by_source(spark, d):
    return M.prf(M.confusion(_predicted(spark, d), ["source"]))


@query(f"SELECT tn, fp, fn, tp, {_RATES} FROM (SELECT {_CELLS} FROM ({_P}))")
def confusion(spark, d):
    return M.prf(M.confusion(_predicted(spark, d)))


@query(f"""WITH p AS ({_P}), c AS (SELECT c::VARCHAR AS "class", coalesce(hit / nullif(said, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * hit / nullif(support + said, 0)::DOUBLE, 0) AS f1, support FROM (SELECT c, (SELECT count(*) FROM p WHERE label = c AND pred = c) AS hit, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE pred = c) AS said FROM (VALUES (0), (1)) AS v(c)))
SELECT * FROM c UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM c UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM c""")
def class_report(spark, d):
    return M.class_report(_predicted(spark, d))


_AUC = "(SELECT {g}sum((label = 1)::INT * (rk + (ties - 1) / 2.0)) AS ranks, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM (SELECT *, rank() OVER ({w}ORDER BY score) AS rk, count(*) OVER (PARTITION BY {g}score) AS ties FROM ({s})) {b})"


@query("SELECT lang, (ranks - np * (np + 1) / 2.0) / nullif(np * nn, 0)::DOUBLE AS auc FROM " + _AUC.format(g="lang, ", w="PARTITION BY lang ", s=SCORED, b="GROUP BY lang"))
def roc_auc_by_lang(spark, d):
    return M.roc_auc(scored(spark, d), ["lang"])


@query("SELECT (ranks - np * (np + 1) / 2.0) / nullif(np * nn, 0)::DOUBLE AS auc FROM " + _AUC.format(g="", w="", s=SCORED, b=""))
def roc_auc(spark, d):
    return M.roc_auc(scored(spark, d))


@query(f"SELECT lang, avg((score - label) ** 2) AS brier, -avg(label * ln(greatest(least(score, 1 - 1e-7), 1e-7)) + (1 - label) * ln(1 - greatest(least(score, 1 - 1e-7), 1e-7))) AS log_loss FROM ({SCORED}) GROUP BY lang")
def brier_logloss(spark, d):
    return M.brier_logloss(scored(spark, d), ["lang"])


@query(f"""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(bucket) = 0 THEN 'bucket' WHEN grouping(source) = 0 THEN 'source' ELSE 'ALL' END AS slice, coalesce(lang, bucket, source, 'ALL') AS "value", count(*) AS n, count(*) FILTER (n_chars > 512) AS flagged,
count(*) FILTER (label = 0 AND pred = 1) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE AS fpr, count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE AS recall FROM ({_P}) GROUP BY GROUPING SETS ((), (lang), (bucket), (source))""")
def sliced_metrics(spark, d):
    return M.sliced(_predicted(spark, d).withColumn("long", F.col("n_chars") > 512), ["lang", "bucket", "source"], flag="long")


def _grid(a, b, step, scale, order):
    return f"SELECT threshold, tp, fp, fn, tn, {_RATES} FROM (SELECT k / {scale}.0::DOUBLE AS threshold, count(*) FILTER (score >= k / {scale}.0::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= k / {scale}.0::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < k / {scale}.0::DOUBLE AND label = 1) AS fn, count(*) FILTER (score < k / {scale}.0::DOUBLE AND label = 0) AS tn FROM ({SCORED}), (SELECT unnest(generate_series({a}, {b}, {step})) AS k) GROUP BY k) ORDER BY {order}, threshold LIMIT 1"


@query(_grid(200, 800, 25, 1000, "f1 DESC"))
def f1_sweep(spark, d):
    return M.grid_sweep(scored(spark, d), list(range(200, 801, 25)), 1000)


@query(_grid(10, 190, 1, 200, "f1 DESC, precision DESC, recall DESC"))
def f1_fine_sweep(spark, d):
    return M.grid_sweep(scored(spark, d), list(range(10, 191)), 200, ("f1", "precision", "recall"))


@query(f"WITH s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM ({SCORED}) GROUP BY score), c AS (SELECT (score + lead(score) OVER w) / 2 AS threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM s WINDOW w AS (ORDER BY score)) SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {_RATES} FROM (SELECT threshold, tp, fp, np - tp AS fn, nn - fp AS tn FROM c WHERE threshold IS NOT NULL) ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1")
def f1_midpoint(spark, d):
    return M.midpoint_threshold(scored(spark, d))


@query(f"WITH s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM ({SCORED}) GROUP BY score), c AS (SELECT score AS threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM s WINDOW w AS (ORDER BY score DESC)) SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tp / np::DOUBLE AS recall, fp / nn::DOUBLE AS fpr FROM c WHERE fp / nn::DOUBLE <= 0.05 ORDER BY tp DESC, fp, threshold DESC LIMIT 1")
def fpr_operating_point(spark, d):
    return M.operating_point(scored(spark, d), 0.05)


@query("SELECT label, count(*) AS n, min(x) AS least, max(x) AS most, avg(x) AS mean, median(x) AS median, list_sort(list(x))[((count(*) - 1) * 0.75)::DOUBLE::BIGINT + CASE WHEN ((count(*) - 1) * 0.75)::DOUBLE::BIGINT > (count(*) - 1) * 0.75 THEN 0 ELSE 1 END] AS p75_cut, list_sort(list(x))[count(*) // 2 + 1] AS upper_median FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def score_summary(spark, d):
    x = F.col("x")
    rows = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    stats = rows.groupBy("label").agg(F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.median(x).alias("median"))
    ranks = {"p75_cut": F.floor((F.col("n") - 1) * 0.75), "upper_median": F.floor(F.col("n") / 2)}
    return stats.join(M.rank_values(rows, "label", "x", ranks), "label")


@query(f"SELECT split, label, n, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY split) AS percent FROM (SELECT {SPLIT} AS split, quality AS label, count(*) AS n FROM documents d JOIN labels USING (doc_id) GROUP BY ALL)")
def label_percentages(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", split_of(F.col("doc_id")).alias("split")).join(table(spark, d, "labels"), "doc_id")
    n = rows.groupBy("split", F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("split")))


@query(f"SELECT count(*) FILTER (old <> label AND new = label) AS newly_right, count(*) FILTER (old = label AND new <> label) AS newly_wrong, count(*) FILTER (old <> label OR new <> label) AS wrong_in_either, count(*) FILTER (new = 1 AND label = 0) AS false_alarm, count(*) FILTER (new = 0 AND label = 1) AS missed_promotion FROM (SELECT label, (score >= 0.5)::INT AS old, (score >= 0.55)::INT AS new FROM ({SCORED}))")
def model_changes(spark, d):
    old, new, y = (F.col("score") >= 0.5).cast("int"), (F.col("score") >= 0.55).cast("int"), F.col("label")
    return scored(spark, d).agg(F.count_if((old != y) & (new == y)).alias("newly_right"), F.count_if((old == y) & (new != y)).alias("newly_wrong"), F.count_if((old != y) | (new != y)).alias("wrong_in_either"), F.count_if((new == 1) & (y == 0)).alias("false_alarm"), F.count_if((new == 0) & (y == 1)).alias("missed_promotion"))


@query(f"SELECT doc_id, score FROM ({SCORED}) ORDER BY score DESC, doc_id LIMIT 20")
def top_20(spark, d):
    return scored(spark, d).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query()
def reservoir_200(spark, d):
    """A sample of 200: the least hashes of id and seed."""
    return table(spark, d, "documents").select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("h")).orderBy("h", "doc_id").limit(200).select("doc_id")


@query()
def calibrated_model(spark, d):
    """Balanced logistic regression on standardised counts, Platt scaling and temperature; three parameters a row."""
    from pyspark.ml.functions import array_to_vector

    rows = scored(spark, d).withColumn("x1", F.log1p(F.col("n_chars").cast("double"))).withColumn("x2", F.col("score"))
    rows = written(rows, "scored")
    std = layers.standardized(rows, ["x1", "x2"]).withColumn("features", array_to_vector(F.array("x1", "x2")))
    model = layers.fit_logistic(std, "features", "label")
    from siltstone.functions.text import log_odds

    margins = rows.select(log_odds(F.col("score")).alias("m"), "label")
    a, b = layers.fit_platt(margins, "m", "label")
    t = layers.fit_temperature(margins, "m", "label")
    values = [("weight_x1", float(model.coefficients[0])), ("weight_x2", float(model.coefficients[1])), ("platt_a", a), ("platt_b", b), ("temperature", t)]
    return spark.createDataFrame([(n, v) for n, v in values], "parameter string, value double")
