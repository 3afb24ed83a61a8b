"""Checks of datasets: rows of (severity, location, message), and gates that raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import comment_text


def _found(checks: list[tuple[str, Column, Column]]) -> Column:
    """array<struct<severity, message>> of the checks (severity, message, when) that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), message.alias("message"))) for severity, message, when in checks]))


def comment_groups(items: DataFrame, expected: int, item: str = "item", at: str = "pos", least: int = 3) -> DataFrame:
    """(severity, location, message) for comment groups given as variants with their places: the id, the label, the list of comments
    and each comment, and ids and texts that occur again. ``location`` is the id, else the place."""
    field = lambda name: F.try_variant_get(item, f"$.{name}", "variant")
    kind = lambda v: F.coalesce(F.when(F.is_variant_null(v), F.lit("VOID")).otherwise(F.schema_of_variant(v)), F.lit("missing"))
    rows = items.select(F.col(at).alias("at"), kind(F.col(item)).alias("kind"), kind(field("id")).alias("id_kind"), F.try_variant_get(item, "$.id", "string").alias("id"), kind(field("label")).alias("label_kind"), F.try_variant_get(item, "$.label", "double").alias("label"), kind(field("comments")).alias("list_kind"), F.try_variant_get(item, "$.comments", "array<variant>").alias("comments"))
    place = F.concat(F.lit("item "), F.col("at").cast("string"))
    named = F.when((F.col("id_kind") == "STRING") & (F.col("id") != ""), F.col("id")).otherwise(place)
    rows = rows.withColumn("location", named).withColumn("n", F.size("comments"))
    is_object = F.startswith("kind", F.lit("OBJECT"))
    no_id = F.col("id_kind").isin("missing", "VOID") | F.coalesce((F.col("id_kind") == "STRING") & (F.col("id") == ""), F.lit(False))
    binary = F.coalesce(F.col("label").isin(0.0, 1.0) & F.col("label_kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.lit(False))
    is_list = F.startswith("list_kind", F.lit("ARRAY"))
    text = lambda m: F.lit(m)
    own = rows.select("location", F.explode(F.when(~is_object, _found([("error", text("no object"), F.lit(True))])).otherwise(_found([
        ("error", text("missing id"), no_id), ("error", text("id is no string"), ~no_id & (F.col("id_kind") != "STRING")),
        ("error", text("label is not 0 or 1"), ~binary), ("error", text(f"label is not {expected}"), binary & (F.col("label") != expected)),
        ("error", text("missing comments"), F.col("list_kind").isin("missing", "VOID")), ("error", text("comments are no list"), ~F.col("list_kind").isin("missing", "VOID") & ~is_list),
        ("error", text("no comment"), F.col("n") == 0), ("warning", F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" comments")), F.col("n").between(1, least - 1)),
    ]))).alias("v")).select("v.severity", "location", "v.message")
    one = rows.where(is_object & is_list).select("at", "location", F.posexplode("comments").alias("i", "c"))
    one = one.select("at", "location", "i", kind(F.col("c")).alias("kind"), comment_text(F.col("c")).alias("text"))
    usable = (F.col("kind") == "STRING") | F.startswith("kind", F.lit("OBJECT"))
    first = one.where(usable & (F.length("text") > 0)).groupBy("at", "text").agg(F.min("i").alias("__first"))
    one = one.join(first.withColumnRenamed("at", "__at").withColumnRenamed("text", "__text"), (F.col("at") == F.col("__at")) & (F.col("text") == F.col("__text")), "left")
    number = F.concat(F.lit("comment "), F.col("i").cast("string"), F.lit(" "))
    inner = one.select("location", F.explode(_found([
        ("error", F.concat(number, F.lit("is neither text nor object")), ~usable), ("error", F.concat(number, F.lit("has no text field")), usable & F.col("text").isNull()),
        ("error", F.concat(number, F.lit("is empty")), F.col("text") == ""), ("warning", F.concat(number, F.lit("repeats another")), F.col("__first") < F.col("i")),
    ])).alias("v")).select("v.severity", "location", "v.message")
    twice = rows.where((F.col("id_kind") == "STRING") & (F.col("id") != "")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    twice = twice.select(F.lit("error").alias("severity"), F.col("id").alias("location"), F.concat(F.lit("id occurs "), F.col("n").cast("string"), F.lit(" times")).alias("message"))
    return own.unionByName(inner).unionByName(twice)


def comment_group_summary(items: DataFrame, item: str = "item") -> DataFrame:
    """groups, comments, and the least, most and mean comments of a group."""
    sizes = items.select(F.size(F.try_variant_get(item, "$.comments", "array<variant>")).alias("n")).where("n is not null and n >= 0")
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("comments"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def image_cases(cases: DataFrame, files: DataFrame, key: str = "id", image: str = "image_path", reference: str = "reference_image_path", path: str = "path") -> DataFrame:
    """(severity, location, message): ids that occur again, and images and references that are not among the files' paths."""
    twice = cases.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("error").alias("severity"), F.col(key).cast("string").alias("location"), F.lit("id occurs again").alias("message"))
    named = [cases.where(F.col(c).isNotNull()).select(F.col(key).cast("string").alias("location"), F.col(c).alias("__path"), F.lit(m).alias("message")) for c, m in ((image, "image is missing"), (reference, "reference image is missing"))]
    lost = named[0].union(named[1]).join(files.select(F.col(path).alias("__path")).distinct(), "__path", "left_anti")
    none = cases.where(F.col(image).isNull()).select(F.lit("error").alias("severity"), F.col(key).cast("string").alias("location"), F.lit("no image is named").alias("message"))
    return twice.unionByName(lost.select(F.lit("error").alias("severity"), "location", "message")).unionByName(none)


def edit_cases(cases: DataFrame, issue: str = "issue_type", reference: str = "reference_image_path", kinds: tuple = ("none", "image_text_mismatch")) -> DataFrame:
    """``cases`` with ``alignment_case`` (its issue is one of ``kinds``) and ``reference_case`` (a reference image is named)."""
    return cases.withColumns({"alignment_case": F.coalesce(F.col(issue).isin(*kinds), F.lit(False)), "reference_case": F.coalesce(F.trim(F.col(reference)) != "", F.lit(False))})


def edit_pairs(cases: DataFrame, key: str = "id", image: str = "image_path", reference: str = "reference_image_path", control: str = "control_path") -> DataFrame:
    """Two rows for each reference case: the edited image (label 1) and a recompressed copy of the reference (label 0)."""
    edited = cases.select(key, F.lit("edited").alias("example_type"), F.lit(1).alias("label"), F.col(image).alias("target_path"), reference)
    copied = cases.select(key, F.lit("control").alias("example_type"), F.lit(0).alias("label"), F.col(control).alias("target_path"), reference)
    return edited.unionByName(copied)


def gate(df: DataFrame, checks: dict[str, Column]) -> None:
    """Raises with the names of the aggregate conditions that do not hold for the table."""
    got = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks.values())]).head()
    wrong = [name for name, ok in zip(checks, got, strict=True) if not ok]
    if wrong:
        raise ValueError("; ".join(wrong))


def short_case_gate(cases: DataFrame, windows: str = "windows", n: int = 60) -> None:
    gate(cases, {f"exactly {n} short cases are needed": F.count("*") == n, "short cases have one window": F.bool_and(F.col(windows) == 1)})


def long_case_gate(cases: DataFrame, key: str = "id", label: str = "label", windows: str = "windows", coverage: str = "coverage", n: int = 10, per_label: int = 5) -> None:
    gate(cases, {
        f"at least {n} long cases are needed": F.count("*") >= n, f"at least {per_label} long cases of each label are needed": (F.count_if(F.col(label) == 0) >= per_label) & (F.count_if(F.col(label) == 1) >= per_label),
        "ids of long cases are unique": F.count_distinct(key) == F.count("*"), "long cases have two windows or more": F.bool_and(F.col(windows) >= 2), "long cases are covered fully": F.bool_and(F.col(coverage) >= 1.0),
    })


def reference_case_gate(cases: DataFrame, n: int = 25) -> None:
    gate(cases, {f"exactly {n} reference cases are needed": F.count("*") == n})


def leaks(test: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, split): rows of other splits that share an id or a group with the test set. One semi-join a key, no OR."""
    out = None
    for k in keys:
        one = others.where(F.col(k).isNotNull()).join(test.select(k).distinct(), k, "left_semi").select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), "split").distinct()
        out = one if out is None else out.union(one)
    return out


def independent_test(test: DataFrame, others: DataFrame, key: str = "id", group: str = "source_group_id") -> None:
    """Raises if the test set repeats an id, or shares an id or group with another split."""
    gate(test, {"the test set repeats an id": F.count_distinct(key) == F.count("*")})
    found = leaks(test, others, [key, group]).head()
    if found:
        raise ValueError(f"{found['split']} shares the {found['key']} {found['value']} with the test set")


def reviewed_variants(df: DataFrame, required: list[str], key: str = "id", group: str = "source_group_id", variant: str = "variant", label: str = "label") -> DataFrame:
    """(severity, location, message) of reviewed rows: required fields, unique ids, known variants with their label (0 for H, else
    1), one row a variant, and groups of H alone or of H and all of L1 to L4."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    known = F.col(variant).isin("H", "L1", "L2", "L3", "L4")
    checks = [*[("error", F.lit(f"{c} is missing"), blank(c)) for c in required], ("error", F.lit("unknown variant"), ~F.coalesce(known, F.lit(False))), ("error", F.lit("label does not suit the variant"), known & ~F.coalesce(F.col(label) == F.when(F.col(variant) == "H", 0).otherwise(1), F.lit(False)))]
    own = df.select(F.col(key).cast("string").alias("location"), F.explode(_found(checks)).alias("v")).select("v.severity", "location", "v.message")
    error = lambda rows, where, message: rows.select(F.lit("error").alias("severity"), F.col(where).cast("string").alias("location"), F.lit(message).alias("message"))
    ids = error(df.where(~blank(key)).groupBy(key).count().where("count > 1"), key, "id occurs again")
    twice = error(df.groupBy(group, variant).count().where("count > 1"), group, "a variant occurs again")
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(variant)).alias("v"))
    full = F.array(*map(F.lit, ("H", "L1", "L2", "L3", "L4")))
    partial = error(sets.where((F.col("v") != F.array(F.lit("H"))) & (F.col("v") != full)), group, "an incomplete group")
    return own.unionByName(ids).unionByName(twice).unionByName(partial)


def unchanged(df: DataFrame, stored: str) -> bool:
    """Whether the rows are those of a stored fingerprint, see ``fingerprint``."""
    return fingerprint(df) == stored


def fingerprint(df: DataFrame) -> str:
    """Of a split: the number of rows and a sum of row hashes, so the order of rows and files does not matter."""
    got = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).head()
    return f"{got[0]}-{got[1]}"


def disjoint_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that more than one split holds."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def in_range(name: str, value: float, low: float | None = None, high: float | None = None, open_low: bool = False, whole: bool = False) -> float:
    """The argument, or an error if it is out of its range."""
    bad = (whole and value != int(value)) or (low is not None and (value <= low if open_low else value < low)) or (high is not None and value > high)
    if bad:
        raise ValueError(f"{name} = {value} is out of range")
    return value


def ready(spark: SparkSession, models: dict[str, bool]) -> dict:
    """What a health check reports: whether the session answers, and which models are there."""
    return {"status": "ok" if spark.range(1).count() == 1 else "failed", "models": dict(models)}
