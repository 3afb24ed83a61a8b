"""Text and table models: tf-idf terms with logistic regression, their folders on disk, feature selection and scoring hooks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import sigmoid
from siltstone.operators.grams import clean, common_terms, cut, known_terms, portions
from siltstone.operators.groups import char_grams, vocabulary
from siltstone.operators.layers import fit_logistic, fit_platt
from siltstone.operators.spread import written


@dataclass
class TextClassifier:
    """Logistic regression on L2-normalised tf-idf of character n-grams. ``terms``: term, idf, weight."""

    terms: DataFrame
    intercept: float
    low: int
    high: int
    sublinear: bool = True
    settings: dict = field(default_factory=dict)

    def scores(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, margin, score) for every row. Rows without a known term have the intercept as margin."""
        margin = self.margin(text)
        if margin is not None:
            return df.select(key, margin.alias("margin")).select(key, "margin", sigmoid(F.col("margin")).alias("score"))
        grams = char_grams(df, [key], text, self.low, self.high)
        counts = grams.join(self.terms, "term").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"), F.first("weight").alias("weight"))
        value = (1 + F.log("tf") if self.sublinear else F.col("tf")) * F.col("idf")
        sums = counts.groupBy(key).agg((F.sum(value * F.col("weight")) / F.sqrt(F.sum(value * value))).alias("__m"))
        margin = F.coalesce("__m", F.lit(0.0)) + F.lit(self.intercept)
        return df.select(key).join(sums, key, "left").select(key, margin.alias("margin"), sigmoid(margin).alias("score"))

    def scored(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``score``: rows stay where they are."""
        margin = self.margin(text)
        if margin is not None:
            return df.withColumn("__m", margin).withColumn("score", sigmoid(F.col("__m"))).drop("__m")
        numbered = written(df.withColumn("__at", F.monotonically_increasing_id()), "numbered-rows")
        return numbered.join(self.scores(numbered, "__at", text).select("__at", "score"), "__at").drop("__at")

    def margin(self, text: str) -> Column | None:
        """The margin of a text, from the terms in each task, at most as many as the fit held on the driver. None where the terms'
        letters are too many for codes (``grams.known_terms``); then rows of n-grams meet the terms in a join (``scores``)."""
        rows = self.terms.select("term", "idf", "weight").collect()
        known = known_terms([r["term"] for r in rows], self.low, self.high)
        if known is None:
            return None
        terms, order = known
        idf, weight = (np.array([r[k] for r in rows], float)[order] for k in ("idf", "weight"))
        intercept, sublinear = self.intercept, self.sublinear

        def run(series: pd.Series) -> pd.Series:
            out, texts = np.full(len(series), intercept), series.tolist()
            for start, part in cut(texts):
                term, doc, x = terms.entries(part, sublinear, idf)
                norm = np.sqrt(np.bincount(doc, x * x, minlength=len(part)))
                out[start : start + len(part)] += np.bincount(doc, x * weight[term], minlength=len(part)) / np.where(norm > 0, norm, 1.0)
            return pd.Series(out)

        return F.pandas_udf(run, "double")(clean(text))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """The terms as Parquet and the rest as one JSON line, so any reader of either opens the model."""
        self.terms.write.mode(mode).parquet(f"{path}/terms")
        meta = json.dumps({"intercept": self.intercept, "low": self.low, "high": self.high, "sublinear": self.sublinear, "settings": self.settings})
        self.terms.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/metadata")


_loaded: dict[tuple[str, str], TextClassifier] = {}


def load_classifier(spark: SparkSession, path: str) -> TextClassifier:
    """A saved model, read once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _loaded:
        meta = json.loads(spark.read.text(f"{path}/metadata").head()["value"])
        _loaded[key] = TextClassifier(spark.read.parquet(f"{path}/terms"), meta.pop("intercept"), **meta)
    return _loaded[key]


def tfidf_terms(df: DataFrame, keys: list[str], text: str, low: int = 2, high: int = 5, min_df: int = 2, max_features: int | None = 50_000) -> tuple[DataFrame, DataFrame]:
    """(keys, term, tf), and (term, df, cf, n, idf) of the terms that count, by the whole table."""
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    grams = char_grams(df, keys, text, low, high)
    tf = written(grams.groupBy(*keys, "term").agg(F.count("*").alias("tf")), "term-counts")
    terms = vocabulary(tf, df.count(), min_df, max_features)
    return tf, terms.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def fit_classifier(df: DataFrame, key: str, text: str, label: str, low: int = 2, high: int = 5, min_df: int = 2, max_features: int = 50_000, c: float = 1.0, penalize_intercept: bool = False, sublinear: bool = True) -> TextClassifier:
    """Balanced logistic regression with the penalty of C on the tf-idf of the labelled rows of ``df``. With
    ``penalize_intercept`` the intercept is penalised like any weight. The fit holds ``max_features`` numbers on the driver."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import IntegerType, StructField, StructType

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias(label), F.col(text).alias("t"))
    spark = df.sparkSession
    terms = common_terms(rows, "t", low, high, min_df, max_features)
    if terms is None:
        return _fit_joined(df, key, text, label, low, high, min_df, max_features, c, penalize_intercept, sublinear)
    names = terms.names()
    size = len(names) + penalize_intercept

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts in portions(batches):
            term, doc, x = terms.entries(texts, sublinear)
            x = x / np.sqrt(np.bincount(doc, x * x, minlength=len(texts)))[doc]
            if penalize_intercept:
                at = np.cumsum(np.bincount(doc, minlength=len(texts)))
                term, x, doc = np.insert(term, at, size - 1), np.insert(x, at, 1.0), np.insert(doc, at, np.arange(len(texts)))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))), pa.int32())
            parts = [pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x))]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], names=[label, "x"])

    # A vector's struct is written as it is and read as a vector, so no row passes a function of its own.
    plain = rows.select(label, clean("t").alias("t")).mapInArrow(vectors, f"`{label}` int, x struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
    data = written(plain, "training-rows", StructType([StructField(label, IntegerType()), StructField("x", VectorUDT())]))
    model = fit_logistic(data, "x", label, c, free_intercept=not penalize_intercept)
    w = model.coefficients.toArray()
    intercept = float(w[-1]) if penalize_intercept else float(model.intercept)
    kept = written(spark.createDataFrame(pd.DataFrame({"term": names, "idf": terms.idf, "weight": w[: len(names)]}), "term string, idf double, weight double"), "classifier-terms")
    return TextClassifier(kept, intercept, low, high, sublinear)


def _fit_joined(df: DataFrame, key: str, text: str, label: str, low: int, high: int, min_df: int, max_features: int, c: float, penalize_intercept: bool, sublinear: bool) -> TextClassifier:
    """``fit_classifier`` for texts of any number of letters: n-grams as rows."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = df.where(F.col(label).isNotNull()).select(key, text, label)
    tf, terms = tfidf_terms(rows, [key], text, low, high, min_df, max_features)
    names = [r["term"] for r in terms.select("term").orderBy("term").toLocalIterator()]
    spark = df.sparkSession
    # At most max_features rows, numbered by the driver that will hold a weight for each.
    numbered = written(spark.createDataFrame(pd.DataFrame({"term": names, "i": range(len(names))}), "term string, i int").join(terms, "term"), "numbered-terms")
    value = (1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf")
    weighted = tf.join(numbered.select("term", "i", "idf"), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))).alias("v"), F.sqrt(F.sum(value * value)).alias("norm"))
    size = len(names) + penalize_intercept

    # A vector of terms has no column function; this is one call a training row.
    @F.udf(VectorUDT())
    def sparse(v, norm):
        at, values = [x["i"] for x in v or ()], [x["x"] / norm for x in v or ()]
        return SparseVector(size, [*at, size - 1], [*values, 1.0]) if penalize_intercept else SparseVector(size, at, values)

    data = written(rows.select(key, F.col(label).cast("int").alias(label)).join(weighted, key, "left").select(label, "v", "norm"), "training-rows")
    model = fit_logistic(data.select(label, sparse("v", "norm").alias("x")), "x", label, c, free_intercept=not penalize_intercept)
    w = model.coefficients.toArray()
    intercept = float(w[-1]) if penalize_intercept else float(model.intercept)
    weights = spark.createDataFrame(pd.DataFrame({"i": range(len(names)), "weight": w[: len(names)]}), "i int, weight double")
    kept = written(numbered.join(weights, "i").select("term", "idf", "weight"), "classifier-terms")
    return TextClassifier(kept, intercept, low, high, sublinear)


def calibrated(model: TextClassifier, df: DataFrame, key: str, text: str, label: str, c: float = 1.0) -> tuple[float, float]:
    """Platt's slope and offset from the model's margins on the labelled rows of a calibration split."""
    margins = model.scores(df, key, text).join(df.where(F.col(label).isNotNull()).select(key, label), key)
    return fit_platt(written(margins.select("margin", F.col(label).cast("int").alias("label")), "margins"), "margin", "label", c)


def select_features(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """The keys and the model's features in its order; a missing feature is an error when the plan is built."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df.select(*keys, *features)


def save_pipeline(model, path: str, metadata: dict, spark: SparkSession) -> None:
    """An MLlib model, overwritten, with a metadata table beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_pipeline(path: str, kind, spark: SparkSession) -> tuple[object, dict]:
    return kind.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").head()["value"])


def score_with(load: Callable[[], Callable[[list], list[float]]], *inputs: Column, batch: int = 32) -> Column:
    """A score per row from a caller's own model (a transformer, an OCR or image-text model): ``load`` runs once per Python worker,
    and its result becomes the worker's model only when it has returned. It gets lists of at most ``batch`` rows: values where
    there is one input, tuples where there are more."""
    name = f"{getattr(load, '__module__', '')}.{getattr(load, '__qualname__', id(load))}"

    def run(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held = _models.get(name)
        if held is None:
            held = load()
            _models[name] = held
        for series in columns:
            rows = list(series[0]) if len(series) == 1 else list(zip(*series, strict=True))
            out: list[float] = []
            for at in range(0, len(rows), batch):
                out += [None if x is None else float(x) for x in held(rows[at : at + batch])]
            yield pd.Series(out, dtype="float64")

    if len(inputs) == 1:
        def one(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return run((c,) for c in columns)

        return F.pandas_udf(one, "double")(*inputs)
    return F.pandas_udf(run, "double")(*inputs)


_models: dict[str, Callable] = {}


def best_image_window(windows: Column, scores: Column) -> Column:
    """struct<window, score, at> of one image's best text window: the largest score, the first on ties."""
    at = F.array_position(scores, F.array_max(scores)) - 1
    return F.when(F.size(scores) > 0, F.struct(F.get(windows, at.cast("int")).alias("window"), F.array_max(scores).alias("score"), at.cast("int").alias("at")))


def attach_scores(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Rows with the scores of the same id, never of the same place; an id without a score, or with two, is an error when read."""
    one = scores.groupBy(key).agg(*[F.first(c).alias(c) for c in scores.columns if c != key], F.count("*").alias("__n"))
    both = rows.join(one, key, "left")
    wrong = F.raise_error(F.format_string("%s has %d scores", F.col(key).cast("string"), F.coalesce("__n", F.lit(0)))).cast("boolean")
    return both.where(F.when(F.coalesce("__n", F.lit(0)) != 1, wrong).otherwise(F.lit(True))).drop("__n")
