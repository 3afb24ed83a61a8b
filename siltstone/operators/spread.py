"""Steps that would take one task with a plain window, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may do without: then a temporary folder serves."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = _made.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return named.rstrip("/")


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, as ``schema`` if given: the lineage ends there, and the files last until
    the application ends."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/siltstone-core/{spark.sparkContext.applicationId}"
    if top not in _made:
        _made[top] = top
        atexit.register(_forget, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def _forget(spark: SparkSession, top: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, sums: list[str], score: str = "score", descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """``df`` with each of ``sums`` made its running sum by ``score``, within ``by``. Rows are range partitioned and written with
    their partition's number; the sums of each partition, one small row a partition and group, give the others' start."""
    by = by or []
    order = [F.desc(score) if descending else F.col(score)]
    parts = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "score-parts")
    inner = Window.partitionBy("__p", *by).orderBy(*order)
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__p", *by).agg(*[F.sum(c).alias(c) for c in sums]).select(F.col("__p").alias("__q"), *[F.col(b).alias(f"__{b}") for b in by], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__start_{c}") for c in sums])
    on = [F.col("__p") == F.col("__q"), *[F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]]
    out = parts.withColumns({c: F.sum(c).over(inner) for c in sums}).join(starts, on)
    return out.withColumns({c: F.col(c) + F.col(f"__start_{c}") for c in sums}).select(*df.columns)


def following(df: DataFrame, score: str, name: str) -> DataFrame:
    """``df`` (distinct scores) with ``name``, the next larger score, null for the last."""
    parts = written(df.repartitionByRange(score).withColumn("__p", F.spark_partition_id()), "score-parts")
    least = parts.groupBy("__p").agg(F.min(score).alias("__least"))
    after = least.select((F.col("__p")).alias("__q"), F.lead("__least").over(Window.orderBy("__p")).alias("__after"))
    inner = Window.partitionBy("__p").orderBy(score)
    return parts.join(after, F.col("__p") == F.col("__q")).withColumn(name, F.coalesce(F.lead(score).over(inner), F.col("__after"))).drop("__p", "__q", "__after")


def ranked(df: DataFrame, by: str, order: Column, name: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``name``, the place from 1 of a row by ``order``, a hash in hex, among the rows of its ``by`` value. The first
    digits are a bucket whose start comes from counts, so the largest task is a bucket of one value."""
    rows = df.withColumn("__o", order).withColumn("__b", F.floor(F.conv(F.substring("__o", 1, 4), 16, 10).cast("long") * buckets / (1 << 16)).cast("int"))
    counts = rows.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    starts = counts.select(F.col(by).alias("__by"), F.col("__b").alias("__c"), (F.sum("__n").over(Window.partitionBy(by).orderBy("__b")) - F.col("__n")).alias("__s"))
    own = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__b").orderBy("__o")))
    out = own.join(starts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__c")))
    return out.withColumn(name, F.col("__r") + F.col("__s")).select(*df.columns, name)
