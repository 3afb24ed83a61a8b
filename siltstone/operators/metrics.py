"""Classification metrics and threshold selection in one pass over sorted distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.spread import following, ranked, running


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, by: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(pred) == p))
    return df.groupBy(*(by or [])).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def prf(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 (0 where undefined) of rows with tn, fp, fn, tp."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)})


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A row per class, then macro and weighted averages."""
    own = df.select(F.col(label).alias("c"), (F.col(label) == F.col(pred)).cast("int").alias("hit"), F.lit(1).alias("y"), F.lit(0).alias("p"))
    said = df.select(F.col(pred).alias("c"), F.lit(0).alias("hit"), F.lit(0).alias("y"), F.lit(1).alias("p"))
    per = own.union(said).groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("y").alias("support"), F.sum("p").alias("said"))
    per = per.select(F.col("c").cast("string").alias("class"), ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("support") + F.col("said")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = per.agg(*[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return per.unionByName(macro).unionByName(weighted)


def by_score(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score: everything that ranking metrics need, summed before any sort."""
    return df.groupBy(*(by or []), F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """Rank-sum AUC with ties counted half; null unless both classes are there."""
    sums = by_score(df, by, label, score).withColumn("upto", F.col("neg"))
    wins = running(sums, ["upto"], by=by).withColumn("below", F.col("upto") - F.col("neg"))
    pos, neg = F.sum("pos"), F.sum("neg")
    return wins.groupBy(*(by or [])).agg((F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))) / F.nullif(2 * pos * neg, F.lit(0))).alias("auc"))


def rank_values(df: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each ``by`` group the value at each place (from 0, an expression of the count ``n``) of its sorted values, from running
    counts of distinct values instead of an array of them all."""
    counts = df.groupBy(by, F.col(value).alias("score")).agg(F.count("*").alias("here")).withColumn("upto", F.col("here"))
    n = df.groupBy(F.col(by).alias("__g")).agg(F.count("*").alias("n"))
    rows = running(counts, ["upto"], by=[by]).join(n, F.col(by).eqNullSafe(F.col("__g")))
    at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("here") <= r), F.col("score")))
    return rows.groupBy(by).agg(*[at(r).alias(name) for name, r in ranks.items()])


def brier_logloss(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score", edge: float = 1e-7) -> DataFrame:
    p, y = F.greatest(F.least(F.col(score), F.lit(1 - edge)), F.lit(edge)), F.col(label)
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def sliced(df: DataFrame, slices: list[str], label: str = "label", pred: str = "pred", flag: str | None = None) -> DataFrame:
    """Counts, FPR and recall over all rows and for every value of every slice; null where a class is missing."""
    y, p = F.col(label), F.col(pred)
    cols = [F.count("*").alias("n"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if(y == 0).alias("negatives"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if(y == 1).alias("positives"), F.count_if(F.col(flag) if flag else F.lit(False)).alias("flagged")]
    grouped = df.groupingSets([[], *[[s] for s in slices]], *slices).agg(*cols, F.grouping_id().alias("gid"))
    top = (1 << len(slices)) - 1
    name = F.when(F.col("gid") == top, "ALL")
    for i, s in enumerate(slices):
        name = name.when(F.col("gid") == top - (1 << (len(slices) - 1 - i)), F.lit(s))
    return grouped.select(name.alias("slice"), F.coalesce(*[F.col(s).cast("string") for s in slices], F.lit("ALL")).alias("value"), "n", "flagged", (F.col("fp") / F.nullif("negatives", F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif("positives", F.lit(0))).alias("recall"))


def grid_sweep(df: DataFrame, grid: list[int], scale: int, order: tuple = ("f1",), label: str = "label", score: str = "score") -> DataFrame:
    """The threshold k / scale of the grid that is best by ``order``, the lowest on ties; score >= threshold is positive."""
    cells = df.agg(*[f for k in grid for f in (F.count_if((F.col(score) >= k / scale) & (F.col(label) == 1)).alias(f"t{k}"), F.count_if((F.col(score) >= k / scale) & (F.col(label) == 0)).alias(f"f{k}"))], F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    rows = cells.select("positives", "negatives", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("tp"), F.col(f"f{k}").alias("fp")) for k in grid])).alias("x"))
    rows = rows.select((F.col("x.k") / scale).alias("threshold"), "x.tp", "x.fp", (F.col("positives") - F.col("x.tp")).alias("fn"), (F.col("negatives") - F.col("x.fp")).alias("tn"))
    return prf(rows).orderBy(*[F.desc(o) for o in order], "threshold").limit(1)


def midpoint_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Best F1, then recall, then precision over midpoints of neighbouring scores, where score < threshold is positive; the
    lowest on ties. Fewer than two distinct scores are an error when the rows are read."""
    sums = by_score(df, None, label, score)
    total = sums.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    rows = running(following(sums, "score", "up"), ["pos", "neg"]).where("up is not null").select("score", "up", F.col("pos").alias("tp"), F.col("neg").alias("fp"))
    rows = rows.crossJoin(F.broadcast(total))
    rows = prf(rows.select(((F.col("score") + F.col("up")) / 2).alias("threshold"), "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), (F.col("negatives") - F.col("fp")).alias("tn")))
    best = rows.agg(F.max_by(F.struct(*rows.columns), F.struct("f1", "recall", "precision", -F.col("threshold"))).alias("b"))
    few = F.when(F.col("b").isNull(), F.raise_error(F.lit("a threshold needs two distinct scores")).cast("boolean"))
    return best.where(F.coalesce(few, F.lit(True))).select("b.*")


def _next_above(x: Column) -> Column:
    """The next double above x, which is finite: one unit of the exponent's last place, found by halving."""
    # 2 ** -52 of the power of two at or below |x|; below a power of two going down from a negative x the step is half of that.
    size = F.when(x == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))).cast("double") - 52))
    up = F.when(x + size / 2 > x, x + size / 2).otherwise(x + size)
    return F.when(up > x, up).otherwise(x + 2 * size)


def operating_point(df: DataFrame, max_fpr: float, label: str = "label", score: str = "score", ends: bool = False, by_count: bool = False) -> DataFrame:
    """Most recall, then least FPR, then the largest threshold, with FPR within ``max_fpr``, over the scores and the next number
    above them all; with ``ends`` 0 and 1 are candidates too. ``by_count`` orders by true and false positives instead of their
    rates, which differs only where a class is missing."""
    scores = by_score(df, None, label, score)
    total = scores.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.max("score").alias("top"))
    extra = [_next_above(F.col("top").cast("double")), *([F.lit(0.0), F.lit(1.0)] if ends else [])]
    none = [F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")]
    more = total.where("top is not null").select(F.explode(F.array(*extra)).alias("score"), *none)
    every = scores.select(F.col("score").cast("double").alias("score"), "pos", "neg").union(more).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = running(every, ["pos", "neg"], descending=True).select(F.col("score").alias("threshold"), F.col("pos").alias("tp"), F.col("neg").alias("fp"))
    rows = rows.crossJoin(F.broadcast(total.drop("top")))
    rows = rows.select("threshold", "tp", "fp", ratio(F.col("tp"), F.col("positives")).alias("recall"), ratio(F.col("fp"), F.col("negatives")).alias("fpr")).where(F.col("fpr") <= max_fpr)
    order = [F.desc("tp"), "fp"] if by_count else [F.desc("recall"), "fpr"]
    return rows.orderBy(*order, F.desc("threshold")).limit(1)


def risk_histogram(df: DataFrame, risk: str = "risk") -> DataFrame:
    """groups, high, medium and low: counts of each band."""
    return df.agg(F.count("*").alias("groups"), *[F.count_if(F.col(risk) == band).alias(band) for band in ("high", "medium", "low")])


def wrong_rows(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The rows with a wrong prediction and their ``error``: false_alarm or missed_promotion."""
    from siltstone.functions.text import error_type

    return df.withColumn("error", error_type(F.col(label), F.col(pred))).where("error is not null")


def wrong_in_either(df: DataFrame, old: str, new: str, label: str = "label") -> DataFrame:
    """Rows that the old or the new model has wrong, with the error of the new one (null where it is right), missed promotions
    first, then false alarms, then rows that only the old model had wrong."""
    from siltstone.functions.text import error_type

    rows = df.withColumn("error", error_type(F.col(label), F.col(new))).where((F.col(old) != F.col(label)) | (F.col(new) != F.col(label)))
    return rows.withColumn("rank", F.when(F.col("error") == "missed_promotion", 0).when(F.col("error") == "false_alarm", 1).otherwise(2))


def stratified_fold(df: DataFrame, key: str, label: str, k: int = 5, seed: str = "42") -> DataFrame:
    """``df`` with ``fold``: rows of a label in hash order, dealt in turn. Ranks come from counts by hash bucket, so no label is one task."""
    return ranked(df, label, F.sha2(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)), 256), "__r").withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def cross_validated_threshold(df: DataFrame, k: int = 5, label: str = "label", score: str = "score", fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(fold, threshold) by the best midpoint of the other folds, and ``df`` with the out-of-fold ``threshold`` and ``pred``;
    score < threshold is positive. One plan for all folds."""
    others = df.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))).alias("fold"), label, score)
    sums = by_score(others, ["fold"], label, score)
    w = Window.partitionBy("fold").orderBy("score")
    total = Window.partitionBy("fold")
    rows = sums.withColumns({"up": F.lead("score").over(w), "tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w), "positives": F.sum("pos").over(total), "negatives": F.sum("neg").over(total)}).where("up is not null")
    rows = prf(rows.select("fold", ((F.col("score") + F.col("up")) / 2).alias("threshold"), "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), (F.col("negatives") - F.col("fp")).alias("tn")))
    best = rows.groupBy("fold").agg(F.max_by("threshold", F.struct("f1", "recall", "precision", -F.col("threshold"))).alias("threshold"))
    out = df.join(best.withColumnRenamed("fold", "__f"), F.col(fold) == F.col("__f")).drop("__f")
    return best, out.withColumn("pred", (F.col(score) < F.col("threshold")).cast("int"))


def best_epoch(history: DataFrame, epoch: str = "epoch", order: tuple = ("recall", "fpr", "auc")) -> DataFrame:
    """The epoch with the most recall, then the least FPR, then the largest AUC; the earliest on ties."""
    recall, fpr, auc = order
    return history.orderBy(F.desc(recall), fpr, F.desc(auc), epoch).limit(1)


def feature_ranking(weights: dict[str, float], spark, n: int = 10) -> DataFrame:
    """(feature, weight, rank) of the ``n`` largest absolute weights, by name on ties."""
    rows = sorted(weights.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:n]
    return spark.createDataFrame([(k, float(v), i + 1) for i, (k, v) in enumerate(rows)], "feature string, weight double, rank int")
