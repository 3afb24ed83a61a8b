"""Readers and writers with explicit schemas; files are lists of paths that Spark's readers open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_checked_jsonl(spark: SparkSession, path: str, schema: StructType | str, key: str = "id", text: str = "text", group: str | None = None, label: str = "label") -> DataFrame:
    """Fails unless rows exist, both labels occur, text and group are there and ids are unique."""
    df = read_jsonl(spark, path, schema)
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    got = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.count_distinct(label).alias("labels"), F.count_if(blank(text) | (blank(group) if group else F.lit(False))).alias("blank")).head()
    if not got["n"] or got["labels"] < 2 or got["blank"] or got["ids"] < got["n"]:
        raise ValueError(f"{path}: rows {got['n']}, ids {got['ids']}, labels {got['labels']}, rows without text or group {got['blank']}")
    return df


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, wrapper: str | None = None) -> DataFrame:
    """A JSON array of records, or an object that holds one under ``wrapper``."""
    if wrapper is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    record = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType().add(wrapper, ArrayType(record))).option("multiLine", True).json(path).select(F.inline(wrapper))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With header; a byte-order mark is dropped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_splits(spark: SparkSession, paths: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Parquet splits in one table with ``original_split``; only ``columns`` are read."""
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path)
        one = (one.select(*columns) if columns else one).withColumn("original_split", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_images(spark: SparkSession, path: str, limit: int = 12 * 1024 * 1024) -> DataFrame:
    """path, content and status: completed, 422 for empty files, 413 for those over ``limit``, which are not read."""
    files = spark.read.format("binaryFile").load(path)
    status = F.when(F.col("length") == 0, "422").when(F.col("length") > limit, "413").otherwise("completed")
    return files.select("path", "length", status.alias("status"), F.when(F.col("length") <= limit, F.col("content")).alias("content"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def parse_requests(df: DataFrame, body: str) -> DataFrame:
    """JSON requests to text, comments (strings or objects, told apart by their JSON type), images and locale."""
    request = F.try_parse_json(body)
    field = lambda v, name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    plain = lambda c: F.schema_of_variant(c) == "STRING"
    comment = lambda c: F.struct(F.when(~plain(c), field(c, "id")).alias("id"), F.when(plain(c), F.try_variant_get(c, "$", "string")).otherwise(field(c, "text")).alias("text"), F.when(~plain(c), field(c, "timestamp")).alias("timestamp"))
    image = field(F.col("__r"), "image")
    return df.withColumn("__r", request).withColumns({
        "text": field(F.col("__r"), "text"),
        "comments": F.transform(field(F.col("__r"), "comments", "array<variant>"), comment),
        "images": F.coalesce(field(F.col("__r"), "images", "array<string>"), F.when(image.isNotNull(), F.array(image)), F.array().cast("array<string>")),
        "reference_image": field(F.col("__r"), "reference_image"),
        "locale": F.coalesce(field(F.col("__r"), "locale"), F.lit("en")),
    }).drop("__r")


def upload_status(media: Column, size: Column, limit: int = 12 * 1024 * 1024) -> Column:
    """The status of an upload: 415 if it is no image, 422 if it is empty, 413 if it is over ``limit``."""
    return F.when(~F.coalesce(F.startswith(F.lower(media), F.lit("image/")), F.lit(False)), "415").when(size == 0, "422").when(size > limit, "413").otherwise("completed")


def read_named_splits(spark: SparkSession, path: str, splits: list[str], columns: list[str] | None = None) -> DataFrame:
    """The named splits of a dataset laid out as ``path``/split-*.parquet or ``path``/split, one table with ``original_split``; lazy, row groups are read as needed."""
    return read_splits(spark, {name: f"{path}/{{{name},{name}-*.parquet,{name}.parquet}}" for name in splits}, columns)


def read_config(spark: SparkSession, path: str, section: str = "alignment", number: str = "similarity_threshold") -> dict:
    """A JSON object of settings, read once by the driver; an error unless ``section`` holds a number under ``number``."""
    import json

    rows = spark.read.text(path, wholetext=True).collect()
    try:
        config = json.loads(rows[0]["value"].removeprefix("\ufeff")) if len(rows) == 1 else None
    except json.JSONDecodeError as error:
        raise ValueError(f"{path} is no JSON") from error
    value = config.get(section, {}).get(number) if isinstance(config, dict) and isinstance(config.get(section, {}), dict) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{path}: {section}.{number} is missing or no number")
    return config


def read_decoded_images(spark: SparkSession, path: str, most: int = 25_000_000) -> DataFrame:
    """(path, status, height, width, data): BGR bytes as Spark's image source decodes them; 422 for files that are no image, 413
    for more than ``most`` pixels."""
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    status = F.when((F.col("height") <= 0) | (F.col("width") <= 0) | (F.octet_length("data") == 0), "422").when(F.col("height").cast("long") * F.col("width") > most, "413").otherwise("completed")
    good = status == "completed"
    # Gray images and those with alpha become three channels.
    return image.select(F.col("origin").alias("path"), status.alias("status"), "height", "width", "nChannels", F.when(good, F.col("data")).alias("data"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Non-ASCII stays as it is; an existing folder is refused unless ``mode`` says otherwise ("append" adds a batch)."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, bom: bool = True, mode: str = "errorifexists") -> None:
    """Nested values as JSON, arrays of strings joined by newlines, columns in the frame's order, a BOM before the header."""
    flat = df.select(*[_flat(df, f.name) for f in df.schema])
    if bom and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def _flat(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    c = F.col(f"`{name}`")
    if kind == "array<string>":
        return F.array_join(c, "\n").alias(name)
    return F.to_json(c).alias(name) if kind.startswith(("array", "struct", "map")) else c


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One indented JSON array for a small result, in the frame's order, in a folder of one file; more than ``most`` rows are an
    error, before anything is written. An existing folder is refused."""
    import json

    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write_jsonl takes tables of any size")
    text = json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def responses(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``response``, the JSON of the named columns; absent values stay as nulls."""
    return df.withColumn("response", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def write_reports(df: DataFrame, path: str, columns: list[str]) -> None:
    """A JSON report a row, as a download of one analysis holds it."""
    responses(df, columns).select(F.col("response").alias("value")).write.text(path)


def write_scores(df: DataFrame, path: str, key: str, scores: list[str]) -> None:
    """Score arrays as compressed columns, keyed by id so that no later step relies on their order."""
    df.select(key, *scores).write.option("compression", "zstd").parquet(path)
