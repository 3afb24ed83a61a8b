"""Copies, comment groups, their features, similarity and connected groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.spread import ranked, written

def copy_groups(df: DataFrame, key: str, member: str, least: int = 2) -> DataFrame:
    """(key, n, first, member): a row for each member of a key that at least ``least`` rows share, with its least member; long
    texts are given by their hash. Groups are rows and never arrays, so a key of any size is spread over tasks."""
    groups = written(df.groupBy(key).agg(F.count("*").alias("n"), F.min(member).alias("first")).where(F.col("n") >= least), "copied-keys")
    return df.select(key, member).join(groups, key).select(key, "n", "first", member)


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).where("labels > 1")


def drop_label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """All rows but those whose key has more than one label; copies stay."""
    return df.join(label_conflicts(df, key, label).select(key), key, "left_anti")


def keep_best(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key with the least ``order``, picked in each task before anything moves."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__best")).select("__best.*")


def majority_label(df: DataFrame, group: str, label: str, pos: str) -> DataFrame:
    """The most frequent label of each group, the first seen on ties."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(group).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("majority"))


def repeat_features(df: DataFrame, group: str, key: str) -> DataFrame:
    """comment_count, duplicate_ratio and max_exact_repeat_ratio."""
    per = df.groupBy(group, key).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("comment_count"), F.count("*").alias("distinct"), F.max("n").alias("most"))
    return per.select(group, "comment_count", ((F.col("comment_count") - F.col("distinct")) / F.col("comment_count")).alias("duplicate_ratio"), (F.col("most") / F.col("comment_count")).alias("max_exact_repeat_ratio"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def within_cap(df: DataFrame, group: str, most: int) -> DataFrame:
    """``df``, with an error when it is read if a group has more than ``most`` rows."""
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    large = F.raise_error(F.format_string(f"a group has %d rows, more than {most}", F.col("__n")))
    return df.join(sizes, F.col(group) == F.col("__g")).where(F.when(F.col("__n") > most, large.cast("boolean")).otherwise(F.lit(True))).drop("__g", "__n")


def vector_pairs(df: DataFrame, group: str, key: str, vector: str, most: int = 30) -> DataFrame:
    """(group, a, b, sim) for a < b within a group. A group of more than ``most`` rows is an error: the contract is 30 comments a
    post, and pairs grow with the square."""
    df = within_cap(df, group, most)
    a = df.select(F.col(group).alias("g"), F.col(key).alias("a"), F.col(vector).alias("va"))
    b = df.select(F.col(group).alias("g"), F.col(key).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, "g").where("a < b").select(F.col("g").alias(group), "a", "b", dot(F.col("va"), F.col("vb")).alias("sim"))


def pair_features(pairs: DataFrame, group: str) -> DataFrame:
    """Mean, population deviation, interpolated 75th and 90th percentile, maximum, and mean of the top ceil(20 %)."""
    w = Window.partitionBy(group)
    top = pairs.withColumns({"r": F.row_number().over(w.orderBy(F.desc("sim"), "a", "b")), "n": F.count("*").over(w)})
    return top.groupBy(group).agg(F.avg("sim").alias("semantic_pair_mean"), F.stddev_pop("sim").alias("semantic_pair_std"), F.percentile("sim", 0.75).alias("semantic_pair_p75"), F.percentile("sim", 0.9).alias("semantic_pair_p90"), F.max("sim").alias("semantic_pair_max"), F.avg(F.when(F.col("r") <= F.ceil(F.col("n") * 0.2), F.col("sim"))).alias("semantic_top_pair_mean"))


def nearest_features(pairs: DataFrame, group: str) -> DataFrame:
    both = pairs.select(group, F.explode(F.array("a", "b")).alias("id"), "sim").groupBy(group, "id").agg(F.max("sim").alias("near"))
    return both.groupBy(group).agg(F.avg("near").alias("semantic_nearest_mean"), F.stddev_pop("near").alias("semantic_nearest_std"))


def centroid_features(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Similarity to the normalised mean vector, mean and population deviation; 0 for a zero mean."""
    long = df.select(group, key, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    sims = long.join(mean, [group, "i"]).groupBy(group, key).agg(F.sum(F.col("x").cast("double") * F.col("m")).alias("d")).join(norm, group)
    return sims.withColumn("s", F.when(F.col("norm") > 0, F.col("d") / F.col("norm")).otherwise(0.0)).groupBy(group).agg(F.avg("s").alias("semantic_centroid_mean"), F.stddev_pop("s").alias("semantic_centroid_std"))


def concentration(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The first singular value's share of the squared spectrum of each group's matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vector].to_list()).astype(float)
        s = np.linalg.eigvalsh(x @ x.T if len(x) <= x.shape[1] else x.T @ x)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "semantic_component_concentration": [float(s[-1] / s.sum()) if s.sum() > 0 else 0.0]})

    kind = df.schema[group].dataType.simpleString()
    return df.select(group, vector).groupBy(group).applyInPandas(run, f"{group} {kind}, semantic_component_concentration double")


FEATURES = ("comment_count", "duplicate_ratio", "max_exact_repeat_ratio", "semantic_pair_mean", "semantic_pair_std", "semantic_pair_p75", "semantic_pair_p90", "semantic_pair_max", "semantic_top_pair_mean", "semantic_nearest_mean", "semantic_nearest_std", "semantic_centroid_mean", "semantic_centroid_std", "semantic_component_concentration")


def group_features(groups: DataFrame, comments: DataFrame, group: str, key: str, text_key: str, vector: str) -> DataFrame:
    """All features of every group of ``groups``; 0 where a group has too few comments for one."""
    pairs = vector_pairs(comments, group, key, vector)
    parts = [repeat_features(comments, group, text_key), pair_features(pairs, group), nearest_features(pairs, group), centroid_features(comments, group, key, vector), concentration(comments, group, vector)]
    out = groups.select(group).distinct()
    for p in parts:
        out = out.join(p, group, "left")
    alone = F.coalesce(F.col("comment_count"), F.lit(0)) < 2
    return out.select(group, *[(F.when(alone, 0.0).otherwise(F.coalesce(F.col(f), F.lit(0.0))) if f.startswith("semantic") else F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in FEATURES])


def char_grams(df: DataFrame, keys: list[str], text: str, low: int, high: int, size: int = 256) -> DataFrame:
    """(keys, term): a row for each character n-gram of a lower-case text whose runs of two and more white space are one space.

    Places in a string are found by counting from its start, so texts are first cut into pieces of ``size`` places that reach
    over into the next by ``high - 1`` characters. The rest is generated code over rows, not lambdas over arrays.
    """
    clean = df.select(*keys, F.regexp_replace(F.lower(F.col(text)), r"\s\s+", " ").alias("__t")).where(F.length("__t") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("__t") - 1) / size).cast("int")), lambda k: F.substring("__t", k * size + 1, F.lit(size + high - 1)))
    rows = clean.select(*keys, F.explode(pieces).alias("__c"))
    rows = rows.select(*keys, "__c", F.explode(F.sequence(F.lit(1), F.least(F.length("__c"), F.lit(size)))).alias("__i"))
    grams = [F.when(F.col("__i") + (n - 1) <= F.length("__c"), F.substring("__c", F.col("__i"), F.lit(n))) for n in range(low, high + 1)]
    return rows.select(*keys, F.explode(F.array(*grams)).alias("term")).where("term is not null")


def char_tfidf(df: DataFrame, keys: list[str], text: str, low: int = 2, high: int = 4, min_df: int = 1, within: list[str] | None = None, max_features: int | None = None, sublinear: bool = True) -> DataFrame:
    """(keys, term, weight): L2-normalised tf-idf with smooth idf ln((1 + n) / (1 + df)) + 1, fitted on all rows, or with
    ``within`` (among the keys) on each group. Groups are dealt once, as texts: their further steps run where they lie."""
    within = within or []
    # N-grams are many times their text, so texts are dealt over all tasks; a stated number of partitions is not put together again.
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(within or keys))
    tf = char_grams(df, keys, text, low, high).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    if within:
        n = df.groupBy(*within).agg(F.count("*").alias("n"))
        group = Window.partitionBy(*within, "term")
        stats = tf.withColumns({"df": F.count("*").over(group), "cf": F.sum("tf").over(group)}).where(F.col("df") >= min_df)
        if max_features:
            stats = stats.withColumn("r", F.dense_rank().over(Window.partitionBy(*within).orderBy(F.desc("cf"), "term"))).where(F.col("r") <= max_features)
        raw = stats.join(n, within)
    else:
        tf = written(tf, "term-counts")
        raw = tf.join(vocabulary(tf, df.count(), min_df, max_features), "term")
    raw = raw.withColumn("w", (1 + F.log("tf") if sublinear else F.col("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    if within:
        return raw.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).select(*keys, "term", (F.col("w") / F.col("norm")).alias("weight"))
    norm = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("weight"))


def vocabulary(tf: DataFrame, n: int, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, df, cf, n) of the terms of at least ``min_df`` rows, the ``max_features`` most frequent by count, then by term."""
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    if max_features:
        stats = stats.orderBy(F.desc("cf"), "term").limit(max_features)
    # Written, so that its size is known where it is joined.
    return written(stats.withColumn("n", F.lit(n).cast("long")), "vocabulary")


def similar_pairs(vectors: DataFrame, group: str, pos: str, least: float) -> DataFrame:
    """(group, a, b, sim) with cosine >= least for a < b of one group, over shared terms."""
    a = vectors.select(group, "term", F.col(pos).alias("a"), F.col("weight").alias("wa"))
    b = vectors.select(group, "term", F.col(pos).alias("b"), F.col("weight").alias("wb"))
    return a.join(b, [group, "term"]).where("a < b").groupBy(group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim")).where(F.col("sim") >= least)


def near_pairs(vectors: DataFrame, key: str, least: float = 0.92, neighbours: int = 5) -> DataFrame:
    """(a, b, sim): for each row its ``neighbours`` nearest others with cosine >= least, exactly. vectors: key, term, weight, of
    unit length.

    Terms have one order, by rising document frequency. A row's prefix are its leading terms while the norm of what is left is at
    least ``least``; rows whose prefixes share no term have a smaller product. Rows meet on prefix terms, and a pair's common
    prefix terms are summed together with the squared norms ta, tb left after the last of them. Whatever else the pair shares
    lies behind it, and one of the two prefixes ends there with less than ``least`` left, so the product is at most
    sum + min(sqrt(ta * tb), least * sqrt(max(ta, tb))). Few pairs reach ``least`` so; they are compared on all terms.
    """
    counts = vectors.groupBy("term").agg(F.count("*").alias("df"))
    ranked_terms = vectors.join(counts, "term").select(key, F.col("df"), F.xxhash64("term").alias("t"), "term", "weight")
    after = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("t"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    lead = ranked_terms.withColumn("left", F.sum(F.col("weight") * F.col("weight")).over(after)).where((F.col("left") >= (least - 1e-9) ** 2) & (F.col("df") > 1))
    lead = written(lead.select(key, "term", F.col("weight").alias("w"), (F.col("left") - F.col("weight") * F.col("weight")).alias("left")), "prefixes")
    side = lambda n: lead.select("term", F.col(key).alias(n), F.col("w").alias(f"w{n}"), F.greatest("left", F.lit(0.0)).alias(f"t{n}"))
    # Norms fall along the order, so those after the last common term are the least.
    met = side("a").join(side("b"), "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("p"), F.min("ta").alias("ta"), F.min("tb").alias("tb"))
    bound = F.col("p") + F.least(F.sqrt(F.col("ta") * F.col("tb")), least * F.sqrt(F.greatest("ta", "tb")))
    candidates = written(met.where(bound >= least - 1e-6).select("a", "b"), "candidates")
    one = vectors.join(candidates.select(F.col("a").alias(key)).union(candidates.select("b")).distinct(), key)
    whole = written(one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v")), "candidate-vectors")
    pairs = candidates.join(whole.select(F.col(key).alias("a"), F.col("v").alias("va")), "a").join(whole.select(F.col(key).alias("b"), F.col("v").alias("vb")), "b")
    pairs = pairs.select("a", "b", "vb", F.explode("va").alias("term", "wa")).withColumn("wb", F.try_element_at("vb", F.col("term")))
    sims = written(pairs.groupBy("a", "b").agg(F.sum(F.col("wa") * F.coalesce("wb", F.lit(0.0))).alias("sim")).where(F.col("sim") >= least), "near-pairs")
    return nearest(sims, neighbours)


def nearest(sims: DataFrame, neighbours: int) -> DataFrame:
    """Of each row of either side the ``neighbours`` most similar ones, the smaller key on ties."""
    both = sims.union(sims.select("b", "a", "sim"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b"))).where(F.col("r") <= neighbours).drop("r")


def near_text_edges(df: DataFrame, key: str, text: str, least: float = 0.92, low: int = 3, high: int = 5, min_df: int = 2, max_features: int | None = 50_000, neighbours: int = 5) -> DataFrame:
    """(a, b, sim) between rows of nearly the same text: the rows that stand first for their text, as copies are linked by
    other edges, and the terms of those texts. Texts stay where they are, and so do their terms (``grams.near_texts``); keys that are
    not unique, no bound on the terms and too many letters for codes take rows of terms (``near_pairs``)."""
    from siltstone.operators import grams

    if max_features and df.groupBy(key).count().where("count > 1").isEmpty():
        hashed = df.select(key, F.coalesce(F.sha2(text, 256), F.lit("")).alias("__h"))
        firsts = hashed.groupBy("__h").agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
        copies = written(hashed.join(firsts, "__h").where(F.col(key) != F.col("__first")).select(key), "copies")
        first = df.select(key, text).join(copies, key, "left_anti")
        terms = grams.common_terms(first, text, low, high, min_df, max_features)
        if terms is not None:
            return grams.near_texts(first, key, text, terms, least, neighbours)
    first = df.groupBy(F.sha2(text, 256)).agg(F.min(F.struct(key, text)).alias("x")).select(f"x.{key}", f"x.{text}")
    first = written(first, "distinct-texts")
    return near_pairs(char_tfidf(first, [key], text, low, high, min_df, max_features=max_features), key, least, neighbours)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large-star and small-star steps on written edges."""
    e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()) != state and now[0]:
        state = now
        both = e.union(e.select("v", "u"))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u != v").union(m.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def copy_edges(df: DataFrame, key: str, node: str) -> DataFrame:
    """Edges from each row to the first row with its key, a star and not all pairs."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("b"))
    return df.join(first, key).where(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b")


def safe_groups(df: DataFrame, node: str, keys: list[str], edges: DataFrame | None = None) -> DataFrame:
    """(node, component): rows joined by any of ``keys`` (the same text, the same origin), stars and not all pairs, and by ``edges``
    (a, b) of near copies. A missing origin is the caller's error to raise; null keys join nothing."""
    every = edges.select("a", "b") if edges is not None else None
    for key in keys:
        one = copy_edges(df, key, node)
        every = one if every is None else every.union(one)
    roots = connected(every)
    return df.select(node).join(roots, F.col(node) == F.col("node"), "left").select(node, F.coalesce("root", node).alias("component"))


def joined_reports(valid: DataFrame, group: str, pos: str, key: str, least: float, low: int, high: int) -> DataFrame:
    """The rows of ``grams.group_reports`` for groups of any size, from rows of n-grams."""
    n = valid.groupBy(group).agg(F.count("*").alias("valid"))
    copies = valid.groupBy(group, key).agg(F.count("*").alias("c")).where("c >= 2").groupBy(group).agg(F.sum("c").alias("duplicate_members"), F.count("*").alias("duplicate_groups"))
    pairs = written(similar_pairs(char_tfidf(valid, [group, pos], key, low, high, within=[group]), group, pos, least), "pairs")
    # Nodes are numbered by group and place, so one run finds the clusters of all groups.
    node = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("p"))
    roots = connected(pairs.select(node("a").alias("a"), node("b").alias("b")))
    clusters = roots.groupBy("root").agg(F.sort_array(F.collect_list("node.p")).alias("members")).select(F.col("root.g").alias(group), "members")
    clusters = clusters.groupBy(group).agg(F.array_sort(F.collect_list("members")).alias("clusters"))
    stats = pairs.groupBy(group).agg(F.count("*").alias("pairs"), F.max("sim").alias("max_similarity"))
    return n.join(copies, group, "left").join(stats, group, "left").join(clusters, group, "left")


def coordination(comments: DataFrame, group: str, pos: str, key: str, least: float = 0.78, shortest: int = 4, low: int = 2, high: int = 4) -> DataFrame:
    """The heuristic report per group from normalised comments ``key``: counts, pairs, clusters, score in [0, 1], risk.

    A group comes from one task (``grams.group_reports``); only one that is too large for that takes rows of n-grams and joins."""
    from siltstone.functions.text import clip01, risk_band
    from siltstone.operators import grams

    valid = comments.where(F.length(key) >= shortest)
    report, large = grams.group_reports(valid, group, pos, key, least - 1e-9, low, high)
    if not large.isEmpty():
        report = report.unionByName(joined_reports(valid.join(large, group, "left_semi"), group, pos, key, least - 1e-9, low, high))
    report = report.withColumns({"similar_members": F.aggregate("clusters", F.lit(0), lambda n, c: n + F.size(c)), "largest": F.array_max(F.transform("clusters", lambda c: F.size(c)))})
    out = comments.groupBy(group).agg(F.count("*").alias("comments")).join(written(report, "reports"), group, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_pairs = F.greatest(zero("valid") * (zero("valid") - 1) / 2, F.lit(1))
    per = F.greatest(zero("valid"), F.lit(1))
    score = clip01(0.35 * zero("duplicate_members") / per + 0.30 * zero("similar_members") / per + 0.20 * zero("largest") / per + 0.15 * zero("pairs") / all_pairs)
    score = F.when(zero("valid") < 2, 0.0).otherwise(score)
    evidence = F.array_compact(F.array(
        F.when(zero("duplicate_groups") > 0, F.format_string("Found %d exact duplicate comment group(s).", zero("duplicate_groups"))),
        F.when(zero("pairs") > 0, F.format_string("Found %d highly similar comment pair(s).", zero("pairs"))),
        F.when(zero("largest") > 0, F.format_string("Largest suspicious similarity cluster contains %d comments.", zero("largest"))),
        F.when((zero("duplicate_groups") == 0) & (zero("pairs") == 0) & (zero("largest") == 0), F.lit("No strong comment coordination signals detected.")),
    ))
    return out.select(group, zero("valid").alias("valid"), zero("duplicate_members").alias("duplicate_members"), zero("pairs").alias("similar_pairs"), F.coalesce("largest", F.lit(0)).alias("largest_cluster"), "clusters", F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), score.alias("score"), risk_band(score).alias("risk"), evidence.alias("evidence"))


def group_split(groups: DataFrame, group: str, label: str, parts: tuple = (("fit", 50), ("dev", 15), ("calibration", 15), ("test_locked", 20)), seed: str = "42") -> DataFrame:
    """A split for each group, stratified by label: groups in hash order, cut at cumulative percents."""
    placed = ranked(groups, label, F.sha2(F.concat_ws("-", F.col(group).cast("string"), F.lit(seed)), 256), "__r")
    n = groups.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    placed = placed.join(n, F.col(label).eqNullSafe(F.col("__l")))
    done, case = 0, None
    for name, percent in parts[:-1]:
        done += percent
        here = F.col("__r") * 100 <= F.col("__n") * done
        case = F.when(here, name) if case is None else case.when(here, name)
    return placed.withColumn("split", case.otherwise(parts[-1][0])).drop("__r", "__n", "__l")


def holdout(groups: DataFrame, group: str, label: str, percent: int = 15, seed: str = "42") -> DataFrame:
    """``groups`` with ``split``: ``holdout`` for ``percent`` of each label, else ``train``."""
    return group_split(groups, group, label, (("holdout", percent), ("train", 100 - percent)), seed)


def deal(counts: dict[int, int], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first rank, groups, folds): the largest groups first, each to the lightest fold (the first on ties). Groups of one
    size are alike, so whole rounds are dealt at once: from its first rank on, a row's groups go to its folds in turn."""
    load, out = [0] * k, []
    for size in sorted(counts, reverse=True):
        todo, rank = counts[size], 0
        while todo:
            order = sorted(range(k), key=lambda f: (load[f], f))
            base = load[order[0]]
            part = [f for f in order if load[f] - base < size]
            above = min((load[f] for f in order if f not in part), default=None)
            n = min(todo, len(part) * (todo if above is None else max(1, (above - base) // size)))
            out.append((size, rank, n, part))
            for i, f in enumerate(part):
                load[f] += size * (n // len(part) + (i < n % len(part)))
            rank, todo = rank + n, todo - n
    return out


def folds(groups: DataFrame, group: str, size: str, k: int = 5, seed: str = "42") -> DataFrame:
    """(group, fold), GroupKFold: the largest group to the lightest fold, groups of one size in hash order. The driver gets the
    number of groups of each size, and no group."""
    counts = {r[size]: r["n"] for r in groups.groupBy(size).agg(F.count("*").alias("n")).collect()}
    steps = [(int(s), first, n, part) for s, first, n, part in deal(counts, k)]
    plan = groups.sparkSession.createDataFrame(steps, "__s long, __first long, __n long, __part array<int>")
    rows = ranked(groups, size, F.sha2(F.concat_ws("-", F.col(group).cast("string"), F.lit(seed)), 256), "__r")
    place = F.col("__r") - 1 - F.col("__first")
    rows = rows.join(plan, (F.col(size) == F.col("__s")) & place.between(F.lit(0), F.col("__n") - 1))
    return rows.select(group, F.get("__part", (place % F.size("__part")).cast("int")).alias("fold"))


def split_leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
