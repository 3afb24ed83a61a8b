"""Detectors on streams. The reference has none; the stateless ones run unchanged, repeats are counted per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clean_text, comment_key, scope


def scoped(stream: DataFrame, text: str, **lists) -> DataFrame:
    """The scope filter on a stream; no state."""
    return stream.withColumn("clean", clean_text(F.col(text))).withColumns(scope(F.col("clean"), **lists)).where("accepted")


def repeated_comments(stream: DataFrame, time: str, text: str, window: str = "1 hour", late: str = "10 minutes", least: int = 2) -> DataFrame:
    """Comments that occur at least ``least`` times in a window; state is dropped ``late`` after its end."""
    keyed = stream.withWatermark(time, late).withColumn("key", comment_key(F.col(text))).where(F.length("key") > 0)
    return keyed.groupBy(F.window(time, window), "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
