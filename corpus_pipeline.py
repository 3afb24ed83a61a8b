"""A corpus through five stages: quality rules, language ID, line dedup, SimHash near-dedup, best-fit packing.

Every stage but the last returns the columns of ``documents``; it is written as Parquet and reread as the next one's input.
Empty input, nulls in any column, repeated rows and extra columns have the results that the operators' docstrings state. Extra
columns keep their values, whatever their names, also those of the operators' outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, free, table
from siltstone.llm.language_id import fit, identify
from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.packing import pack, word_bpe
from siltstone.llm.quality_rules import quality_rules
from siltstone.llm.simhash import near_duplicates

#: Language ID rejects documents without a letter and those of whose positions the network is less sure than this.
LEAST_SCORE = 0.35


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, table(spark, sf_dir, "labels")).where(F.col(free(docs, "kept"))).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = F.col(free(docs, "lang_pred")), F.col(free(docs, "score"))
    return identify(docs, fit(docs)).where((lang != "und") & (score >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (a null one last), then the smallest hash of its text,
    then of the whole row; of rows that are alike in all columns any."""
    hashable = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    marks = [F.xxhash64("text").alias("__text_hash"), F.xxhash64(*hashable).alias("__row_hash")]
    groups = near_duplicates(docs.select("doc_id", "text", *marks), extra=("__text_hash", "__row_hash"))
    # A component is known by its root: component_id is null without any doc_id, and rows of two components may share a doc_id.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__text_hash", "__row_hash")
    first = groups.groupBy("root").agg(F.min(order).alias("x")).select("x.doc_id", "x.__text_hash", "x.__row_hash")
    # The same plain columns key the join and the distinct rows, so texts are moved once for both.
    name = [F.col("doc_id").isNull().alias("__n"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__d")]
    first = cut(first.select(*name, "__text_hash", "__row_hash"), "kept-documents")
    keys = ["__n", "__d", "__text_hash", "__row_hash"]
    return docs.select("*", *name, *marks).join(first, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_bpe()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", rules), ("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near), ("best_fit_packing", packing)]

#: Language ID, SimHash and packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
