"""Comment cards from OCR rows, detector status columns, validation rows, models and image differences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import is_card_end, log_odds, sigmoid, strip


def box_bounds(points: Column) -> Column:
    """struct<left, top, right, bottom, center_y, height> of array<struct<x, y>>."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    mean = F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / F.size(y)
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom"), mean.alias("center_y"), (F.array_max(y) - F.array_min(y)).alias("height"))


def visual_rows(parts: DataFrame, image: str = "image_id", least: float = 0.5) -> DataFrame:
    """OCR parts (text, confidence, left, top, right, bottom) merged into rows: a part joins the latest of the last three
    rows whose running mean centre is within 0.55 of the median height. A stateful fold, so one image is one group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(mid=(pdf["top"] + pdf["bottom"]) / 2).sort_values(["mid", "left"], kind="stable")
        near = 0.55 * max(6.0, float((pdf["bottom"] - pdf["top"]).median()))
        centres: list[list[float]] = []
        own = []
        for mid in pdf["mid"]:
            at = next((r for r in range(len(centres) - 1, max(-1, len(centres) - 4), -1) if abs(mid - np.mean(centres[r])) <= near), None)
            if at is None:
                centres.append([])
                at = len(centres) - 1
            centres[at].append(mid)
            own.append(at)
        rows = pdf.assign(row=own).sort_values(["row", "left"], kind="stable").groupby("row")
        out = rows.agg(text=("text", lambda t: " ".join(t).strip()), confidence=("confidence", "mean"), left=("left", "min"), top=("top", "min"), right=("right", "max"), bottom=("bottom", "max")).reset_index()
        out.insert(0, image, pdf[image].iloc[0])
        return out[out["text"] != ""].round({"confidence": 4, "left": 2, "top": 2, "right": 2, "bottom": 2})

    kind = parts.schema[image].dataType.simpleString()
    kept = parts.where((F.col("confidence") >= least) & (F.trim("text") != ""))
    return kept.groupBy(image).applyInPandas(fold, f"{image} {kind}, row long, text string, confidence double, left double, top double, right double, bottom double")


def comment_cards(rows: DataFrame, image: str = "image_id") -> DataFrame:
    """Comments from text rows: a date or action line ends a card, so do a vertical gap over 1.9 heights and a left shift over
    0.75 heights from the last kept row; a card's first row is its author, one-row cards go, and cards at the most common
    left edge (the smallest on ties) stay."""
    img = Window.partitionBy(image)
    order = img.orderBy("top", "left", "text")
    # Fixed value: the least height of a row, in pixels.
    height = F.greatest(F.median(F.col("bottom") - F.col("top")).over(img), F.lit(6.0))
    rows = rows.withColumn("h", height).withColumn("end", is_card_end(F.col("text"))).withColumn("ends", F.sum(F.col("end").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.where("not end")
    new = F.lag("ends").over(order).isNull() | (F.lag("ends").over(order) != F.col("ends")) | (F.col("top") - F.lag("top").over(order) > 1.9 * F.col("h")) | (F.abs(F.col("left") - F.lag("left").over(order)) > 0.75 * F.col("h"))
    kept = kept.withColumn("new", new.cast("int")).withColumn("card", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(image, "card").orderBy("top", "left", "text")
    body = kept.withColumn("n", F.row_number().over(own)).where("n > 1")
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), ""))
    cards = body.groupBy(image, "card").agg(text.alias("text"), F.round(F.avg("confidence"), 4).alias("confidence"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.max("h").alias("h"))
    w = Window.partitionBy(image)
    cards = cards.withColumn("__l", F.collect_list("left").over(w))
    near = F.size(F.filter("__l", lambda x: F.abs(x - F.col("left")) <= 0.75 * F.col("h")))
    cards = cards.withColumn("__root", F.max(F.struct(near.alias("n"), (-F.col("left")).alias("l"))).over(w))
    return cards.where(F.abs(F.col("left") + F.col("__root.l")) <= 0.75 * F.col("h")).drop("__l", "__root", "h")


def authorship(df: DataFrame, text: str, score: str, a: float = 1.0, b: float = 0.0, threshold: float = 0.5, least: int = 20) -> DataFrame:
    """Status, calibrated score and label; texts under ``least`` characters get a status, never a label."""
    short = F.length(strip(F.coalesce(F.col(text), F.lit("")))) < least
    p = sigmoid(log_odds(F.col(score)), a, b)
    label = (p >= threshold).cast("int")
    return df.select("*", F.when(short, "insufficient_text").otherwise("completed").alias("status"), F.when(~short, p).alias("calibrated"), F.when(~short, label).alias("label"), F.when(short, "unknown").when(label == 1, "ai_involved").otherwise("human").alias("prediction"))


def covert_ad(df: DataFrame, text: str, score: str, threshold: float = 0.55) -> DataFrame:
    empty = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    return df.select("*", F.when(empty, "unknown").when(F.col(score) >= threshold, "covert_ad").otherwise("normal").alias("ad_prediction"), F.when(empty, 0.0).otherwise(F.col(score)).alias("ad_score"))


def alignment(df: DataFrame, similarity: str, windows: str, coverage: str, threshold: float, long_threshold: float | None = None) -> DataFrame:
    """Completed or provisional verdicts; several windows without a long-text threshold or full coverage give no label."""
    long = F.col(windows) > 1
    calibrated = long & (F.col(coverage) >= 1.0) & F.lit(long_threshold is not None)
    cutoff = F.when(calibrated, F.lit(long_threshold).cast("double")).otherwise(F.lit(threshold))
    candidate, provisional = (F.col(similarity) < cutoff).cast("int"), long & ~calibrated
    return df.select("*", F.when(provisional, "provisional").otherwise("completed").alias("status"), cutoff.alias("threshold"), (F.col(similarity) - cutoff).alias("decision_margin"), F.when(~provisional, candidate).alias("label"), F.when(provisional, candidate).alias("candidate_label"), F.when(provisional, "unknown").when(candidate == 1, "high").otherwise("low").alias("risk"))


def image_rollup(df: DataFrame, post: str, coverage: str = "coverage") -> DataFrame:
    """One row per post from its image verdicts: any mismatch, all provisional, least coverage among provisional ones."""
    done = F.col("status") == "completed"
    return df.groupBy(post).agg(F.count("*").alias("images"), F.count_if(done).alias("completed"), F.bool_or(done & (F.col("label") == 1)).alias("any_mismatch"), F.bool_and(F.col("status") == "provisional").alias("all_provisional"), F.min(F.when(F.col("status") == "provisional", F.col(coverage))).alias("least_coverage")).withColumn("risk", F.when(F.col("any_mismatch"), "high").when(F.col("completed") > 0, "low").otherwise("unknown"))


def image_report(df: DataFrame, post: str, coverage: str = "coverage") -> DataFrame:
    """The other roll-up, of images that may be unavailable: status, label over all with a verdict, risk by the confirmed ones."""
    has = F.col("label").isNotNull()
    provisional, unavailable = F.bool_or(F.col("status") == "provisional"), F.bool_or(F.col("status") == "unavailable")
    status = F.when(provisional, "provisional").when(~F.bool_or(has), "unavailable").when(unavailable, "partial").otherwise("completed")
    label = F.when(F.bool_or(has), F.max("label").cast("int"))
    confirmed = F.coalesce(F.bool_or((F.col("status") == "completed") & (F.col("label") == 1)), F.lit(False))
    out = df.groupBy(post).agg(F.count("*").alias("images"), status.alias("status"), (F.bool_or(has) | provisional).alias("available"), label.alias("label"), confirmed.alias("confirmed"), F.min(F.when(F.col("status") == "provisional", F.coalesce(F.col(coverage), F.lit(1.0)))).alias("least_coverage"))
    prediction = F.when(F.col("label") == 1, "image_text_mismatch").when(F.col("label") == 0, "aligned")
    return out.withColumn("prediction", prediction).withColumn("risk", F.when(F.col("confirmed"), "high").when(F.col("status") != "completed", "unknown").otherwise("low")).drop("confirmed")


def combined_images(alignment_status: Column, alignment_label: Column, edit_label: Column) -> Column:
    """struct<status, label, prediction, risk> of the alignment and the comparison with a reference image, which may be null: a
    confirmed edit is a verdict even beside a provisional alignment."""
    edited = F.coalesce(edit_label == 1, F.lit(False))
    suspicious = (F.coalesce(alignment_label == 1, F.lit(False)) | edited).cast("int")
    provisional = alignment_status == "provisional"
    firm = ~provisional | edited
    risk = F.when(edited, "high").when(provisional, "unknown").when(suspicious == 1, "high").otherwise("low")
    return F.struct(F.when(provisional, "provisional").otherwise("completed").alias("status"), F.when(firm, suspicious).alias("label"), F.when(firm, F.when(suspicious == 1, "suspicious").otherwise("normal")).alias("prediction"), risk.alias("risk"))


def model_coordination(groups: DataFrame, comments: Column, probability: Column, threshold: float, high: float | None = None, medium: float | None = None, available: bool = True, least: int = 5) -> DataFrame:
    """``groups`` with status, score, threshold, coordinated (0, 1 or null), prediction, risk and comment_count: insufficient_data
    under ``least`` comments, model_unavailable without a model or score, else completed."""
    from siltstone.functions.text import model_risk

    n = F.coalesce(comments, F.lit(0))
    status = F.when(n < least, "insufficient_data").when(F.lit(not available) | probability.isNull(), "model_unavailable").otherwise("completed")
    done = status == "completed"
    label = (probability >= threshold).cast("int")
    return groups.select(
        "*", status.alias("status"), F.when(done, probability).alias("score"), F.when(done, F.lit(threshold)).alias("threshold"), F.when(done, label).alias("coordinated"),
        F.when(done, F.when(label == 1, "coordinated").otherwise("normal")).alias("prediction"), F.when(done, model_risk(probability, threshold, high, medium)).otherwise("unknown").alias("risk"), n.cast("long").alias("comment_count"),
    )


def four_layers(posts: DataFrame, key: str, layers: dict[str, DataFrame]) -> DataFrame:
    """A row per post with a struct column for each layer, null where the layer has no row. Layers stay independent: there is no
    combined score. Every layer is one row per ``key``."""
    out = posts.select(key)
    for name, df in layers.items():
        out = out.join(df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)), key, "left")
    return out


def import_comments(existing: DataFrame, extracted: DataFrame, group: str, most: int = 30) -> DataFrame:
    """(group, id, text, pos) of the comments that are added to a group: cleaned, without those it has (in any case) or repeats,
    up to ``most`` in all; ids cNN from the number of comments on, passing over those in use. existing: id, text; extracted:
    pos, text."""
    from siltstone.functions.text import clean_text, numbered

    have = existing.groupBy(group).agg(F.count("*").alias("have"), F.collect_set("id").alias("used"))
    fresh = extracted.withColumn("text", clean_text(F.col("text"))).where("text <> ''").withColumn("key", F.lower("text"))
    fresh = fresh.groupBy(group, "key").agg(F.min(F.struct("pos", "text")).alias("x")).join(existing.select(group, F.lower(strip(F.col("text"))).alias("key")).distinct(), [group, "key"], "left_anti")
    place = F.row_number().over(Window.partitionBy(group).orderBy("x.pos"))
    fresh = fresh.withColumn("n", place).join(have, group, "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("n") + F.col("have") <= most)
    # At most ``most`` ids are in use below the cap, so a group's free numbers lie among the next 2 * most.
    free = F.filter(F.transform(F.sequence(F.col("have").cast("int") + 1, F.col("have").cast("int") + 2 * most), lambda i: numbered("c", i, 2)), lambda c: ~F.array_contains(F.coalesce("used", F.array().cast("array<string>")), c))
    return fresh.select(group, F.get(free, F.col("n") - 1).alias("id"), "x.text", "x.pos")


def evidence(layers: dict[str, list[str]]) -> Column:
    """JSON of the listed fields of each layer's struct column; absent fields are left out."""
    return F.to_json(F.struct(*[F.struct(*[F.col(f"{layer}.{f}").alias(f) for f in fields]).alias(layer) for layer, fields in layers.items()]))


def missing_inputs(status: dict[str, str], names: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "completed", F.lit(names[k])) for k, c in status.items()]))


def parse_transcription(raw: Column, comments: int = 100, lines: int = 300, longest: int = 10_000) -> Column:
    """struct<comments, lines, valid> of a transcription JSON; missing arrays, entries that are neither strings nor objects with
    a text, and texts over the limits make it invalid. Entries are told apart by their JSON type."""
    got = F.try_parse_json(raw)
    array = lambda name: F.try_variant_get(got, f"$.{name}", "array<variant>")
    plain = lambda v, path="$": F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", strip(F.try_variant_get(v, path, "string")))
    text = lambda c: F.transform(c, lambda v: F.coalesce(plain(v), plain(v, "$.text")))
    fine = lambda c, cap: c.isNotNull() & (F.size(c) <= cap) & ~F.exists(text(c), lambda x: x.isNull() | (F.length(x) > longest))
    valid = F.coalesce(fine(array("comments"), comments) & fine(array("lines"), lines), F.lit(False))
    keep = lambda c: F.filter(text(c), lambda x: F.length(x) > 0)
    return F.struct(F.when(valid, keep(array("comments"))).alias("comments"), F.when(valid, keep(array("lines"))).alias("lines"), valid.alias("valid"))


def ocr_parts(df: DataFrame, image: str, boxes: Column, texts: Column, scores: Column, rows: Column) -> DataFrame:
    """(image, text, confidence, left, top, right, bottom) from either shape of OCR output: parallel arrays of boxes, texts and
    scores, or an array of rows with the fields box, text and score; blank texts and missing arrays give no part."""
    parallel = F.when(boxes.isNotNull() & texts.isNotNull() & scores.isNotNull(), F.arrays_zip(boxes.alias("box"), texts.alias("text"), scores.alias("score")))
    parts = F.transform(F.coalesce(parallel, rows), lambda r: F.struct(box_bounds(r["box"]).alias("box"), strip(r["text"]).alias("text"), r["score"].cast("double").alias("confidence")))
    one = df.select(F.col(image), F.explode(parts).alias("p")).where(F.length("p.text") > 0)
    return one.select(image, "p.text", "p.confidence", *[F.col(f"p.box.{n}").cast("double").alias(n) for n in ("left", "top", "right", "bottom")])


def case_fields(number: Column) -> dict[str, Column]:
    """Task, labels and eligibility of a numbered image case."""
    pick = lambda *v: F.when(number.between(1, 35), v[0]).when(number.between(36, 60), v[1]).when(number.between(61, 85), v[2]).when(number.between(86, 100), v[3])
    task = F.when(number.between(1, 60), "image_text_alignment").when(number.between(61, 85), "reference_image_comparison").when(number.between(86, 100), "visual_anomaly_experimental")
    none = F.lit(None).cast("int")
    return {"task_type": task.otherwise(F.raise_error(F.concat(F.lit("unexpected case "), number.cast("string"))).cast("string")), "mismatch": pick(F.lit(0), F.lit(1), none, none), "edited": pick(none, none, F.lit(1), none), "ai_generated": pick(none, none, none, F.lit(1)), "eligible": number <= 85}


def violations(df: DataFrame, checks: list[tuple[str, str, Column]], key: str) -> DataFrame:
    """(severity, location, message) for each row and check that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, when in checks]))
    return df.select(F.col(key).cast("string").alias("location"), F.explode(found).alias("v")).select("v.severity", "location", "v.message")


def variant_groups(df: DataFrame, group: str, variant: str) -> DataFrame:
    """Groups whose variants are neither {H} nor {H, L1, L2, L3, L4}, once each."""
    got = df.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(variant)).alias("variants"))
    full = F.array(*map(F.lit, ("H", "L1", "L2", "L3", "L4")))
    return got.where(~((F.col("variants") == F.array(F.lit("H"))) | (F.col("variants") == full)) | (F.size("variants") != F.col("n")))


def fit_logistic(df: DataFrame, features: str, label: str, c: float = 1.0, balanced: bool = True, free_intercept: bool = True):
    """MLlib logistic regression with the penalty of C: regParam = 1 / (C * sum of weights), no standardisation. Without a free
    intercept the caller adds a constant feature, whose weight is penalised like any other."""
    from pyspark.ml.classification import LogisticRegression

    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = reduce(lambda w, kv: w.when(F.col(label) == kv[0], n / (len(counts) * kv[1])), counts.items(), F.when(F.lit(False), 1.0)) if balanced else F.lit(1.0)
    rows = df.select(features, F.col(label).cast("int").alias(label), weight.cast("double").alias("__w"))
    if not free_intercept:
        # MLlib gives constant features the weight 0. A row without features has a constant loss, so it moves nothing else.
        from pyspark.ml.linalg import Vectors

        size = df.select(features).head()[0].size
        rows = rows.union(df.sparkSession.createDataFrame([(Vectors.sparse(size, [], []), 0, 1.0)], rows.schema))
        n += 1
    model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="__w", regParam=1 / (c * n), standardization=False, fitIntercept=free_intercept, maxIter=200, tol=1e-9)
    return model.fit(rows)


def fit_platt(df: DataFrame, margin: str, label: str, c: float = 1.0) -> tuple[float, float]:
    from pyspark.ml.functions import array_to_vector

    model = fit_logistic(df.withColumn("__x", array_to_vector(F.array(F.col(margin).cast("double")))), "__x", label, c, balanced=False)
    return float(model.coefficients[0]), float(model.intercept)


def fit_isotonic(df: DataFrame, score: str, label: str):
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=score, labelCol=label).fit(df.select(F.col(score).cast("double"), F.col(label).cast("double")))


def fit_temperature(df: DataFrame, margin: str, label: str, low: float = 0.05, high: float = 100.0, steps: int = 40) -> float:
    """Golden-section search for ln T on the aggregated log loss; each step sends one number to the driver."""
    def loss(t: float) -> float:
        x = F.col(margin) / t
        return df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * F.col(label) + F.log1p(F.exp(-F.abs(x)))).alias("l")).head()["l"]

    a, b, g = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(np.exp(c)), loss(np.exp(d))
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(np.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(np.exp(d))
        if b - a < 1e-4:
            break
    return float(np.exp((a + b) / 2))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0)."""
    stats = df.agg(*[f for c in columns for f in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"{c}__m")) / F.coalesce(F.nullif(F.col(f"{c}__s"), F.lit(0.0)), F.lit(1.0)) for c in columns}).drop(*[f"{c}__{k}" for c in columns for k in "ms"])


def _blur(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    p = np.pad(x, r, mode="reflect") if min(x.shape) > r else np.pad(x, r, mode="edge")
    p = sum(k * p[i : i + x.shape[0]] for i, k in enumerate(kernel))
    return sum(k * p[:, i : i + x.shape[1]] for i, k in enumerate(kernel))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    g = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    g /= g.sum()
    a, b, c1, c2 = a.astype(float), b.astype(float), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = _blur(a, g), _blur(b, g)
    va, vb, cov = _blur(a * a, g) - ma * ma, _blur(b * b, g) - mb * mb, _blur(a * b, g) - ma * mb
    return float(np.clip((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean(), 0, 1))


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means, by sampled edges."""
    ys, xs = np.linspace(0, x.shape[0], height + 1), np.linspace(0, x.shape[1], width + 1)
    sums = np.pad(x.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    def at(v, edges, axis):
        lo = np.floor(edges).astype(int)
        hi = np.minimum(lo + 1, v.shape[axis] - 1)
        f = (edges - lo).reshape([-1 if i == axis else 1 for i in range(3)])
        return np.take(v, lo, axis) * (1 - f) + np.take(v, hi, axis) * f
    s = at(at(sums, ys, 0), xs, 1)
    return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / ((ys[1] - ys[0]) * (xs[1] - xs[0]))


def regions(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(area, left, top, right, bottom) of 8-connected regions, largest first; the area is a count of pixels."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(labels, 1)
        best = np.max([p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0) * mask
        if (best == labels).all():
            break
        labels = best
    out = []
    for v in np.unique(labels[labels > 0]):
        y, x = np.nonzero(labels == v)
        out.append((len(y), int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    return sorted(out, key=lambda r: (-r[0], r[1:]))


def image_difference(target: np.ndarray, reference: np.ndarray, longest: int = 1024) -> dict:
    """Six features and the changed regions of two BGR images: similarity, difference mean and 99.5th percentile, changed
    share, largest region's share, number of regions; the threshold is clip(median + 6 * 1.4826 * MAD, 12, 80)."""
    scale = min(1.0, longest / max(reference.shape[:2]))
    h, w = max(1, round(reference.shape[0] * scale)), max(1, round(reference.shape[1] * scale))
    a, b = resize(target, h, w), resize(reference, h, w)
    k = np.full(3, 1 / 3)
    a, b = (np.stack([_blur(x[..., c], k) for c in range(3)], -1) for x in (a, b))
    gray = lambda x: x @ np.array([0.114, 0.587, 0.299])
    diff = np.abs(a - b).max(-1)
    mid = np.median(diff)
    cut = float(np.clip(mid + 6 * 1.4826 * np.median(np.abs(diff - mid)), 12, 80))
    mask = diff > cut
    grow = lambda m: np.max([np.pad(m, 1)[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    shrink = lambda m: ~grow(~m)
    mask = shrink(grow(grow(shrink(mask) if mask.any() else mask)))
    found = [r for r in regions(mask) if r[0] >= max(20, 2e-5 * h * w)][:10]
    return {"similarity": ssim(gray(a), gray(b)), "difference_mean": float(diff.mean() / 255), "difference_p995": float(np.percentile(diff, 99.5) / 255), "changed_ratio": float(mask.mean()), "largest_ratio": found[0][0] / (h * w) if found else 0.0, "region_count": len(found), "threshold": cut, "regions": [(int(r[1] / scale), int(r[2] / scale), int(r[3] / scale), int(r[4] / scale), r[0] / (h * w)) for r in found]}


def image_differences(pairs: DataFrame, key: str, target: str, reference: str) -> DataFrame:
    """``image_difference`` of pairs of images, each a struct<height, width, data> of BGR bytes as Spark's image source gives."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda x: np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], 3)
        for batch in batches:
            rows = [{key: k} | image_difference(read(t), read(r)) for k, t, r in zip(batch[key], batch[target], batch[reference], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "similarity", "difference_mean", "difference_p995", "changed_ratio", "largest_ratio", "region_count", "threshold"])

    return pairs.select(key, target, reference).mapInPandas(run, f"{key} {kind}, similarity double, difference_mean double, difference_p995 double, changed_ratio double, largest_ratio double, region_count long, threshold double")


def pixel_differences(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """The same threshold and ratios from rows (image, y, x, b, g, r, rb, rg, rr) without blur: ordinary aggregates."""
    diff = F.greatest(F.abs(F.col("b") - F.col("rb")), F.abs(F.col("g") - F.col("rg")), F.abs(F.col("r") - F.col("rr"))).cast("double")
    d = pixels.select(image, diff.alias("d"))
    mid = d.groupBy(image).agg(F.median("d").alias("mid"))
    mad = d.join(mid, image).groupBy(image).agg(F.first("mid").alias("mid"), F.median(F.abs(F.col("d") - F.col("mid"))).alias("mad"))
    cut = mad.select(image, F.least(F.greatest(F.col("mid") + 6 * 1.4826 * F.col("mad"), F.lit(12.0)), F.lit(80.0)).alias("threshold"))
    return d.join(cut, image).groupBy(image).agg(F.first("threshold").alias("threshold"), (F.avg("d") / 255).alias("difference_mean"), (F.percentile("d", 0.995) / 255).alias("difference_p995"), (F.count_if(F.col("d") > F.col("threshold")) / F.count("*")).alias("changed_ratio"))
