"""Tables and the columns that stand for labels, scores and splits in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key):
    return F.element_at(F.array(*map(F.lit, ("Train_1", "Train_2", "Validation", "Test"))), (F.pmod(key, F.lit(4)) + 1).cast("int"))


SPLIT = "(CASE d.doc_id % 4 WHEN 0 THEN 'Train_1' WHEN 1 THEN 'Train_2' WHEN 2 THEN 'Validation' ELSE 'Test' END)"
#: A score between 0 and 1 in thousandths, with ties, for metric queries only.
SCORED = "SELECT doc_id, source, lang, quality AS label, ((n_chars * 7 + doc_id) % 1000) / 1000.0::DOUBLE AS score, n_chars FROM documents JOIN labels USING (doc_id)"


def scored(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    score = (F.pmod(F.col("n_chars") * 7 + F.col("doc_id"), F.lit(1000)) / 1000.0).alias("score")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("label"), score, "n_chars")
