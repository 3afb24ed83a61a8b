"""Shared helpers: the shared checkpoint folder, written cut points, bound lambda values and sentinels."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: Found in a text or line that has a word.
WORD = "[^ \\x09-\\x0D]"
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only for a local master (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = _made.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there and the files outlive any executor."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"
    if top not in _made:
        _made[top] = top
        atexit.register(_forget, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, top: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to clash with no column of ``df``. Operators name their outputs
    so and leave every column of the input as it is."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, although lambdas inside ``body`` use it for every element."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\x09-\\x0D]+")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
