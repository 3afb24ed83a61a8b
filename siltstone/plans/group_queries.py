"""Copies, groups, similarity, components and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import canonical, split_priority
from siltstone.operators import groups as G
from siltstone.operators.grams import similar_texts
from siltstone.plans.base import SPLIT, Registry, split_of, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_PRIO = f"(CASE {SPLIT} WHEN 'Test' THEN 3 WHEN 'Validation' THEN 2 ELSE 1 END)"
#: Groups of at most 30 vectors, as comments of one post are capped.
_G = "SELECT vec_id, vec_id // 20 AS g, embedding AS v FROM embeddings"
_PAIRS = f"SELECT a.g, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS sim FROM ({_G}) a JOIN ({_G}) b ON a.g = b.g AND a.vec_id < b.vec_id"


def _copied(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", split_of(F.col("doc_id")).alias("split"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 20").alias("g"), F.col("embedding").alias("v"))


def _pairs(spark, d):
    return G.vector_pairs(_vectors(spark, d), "g", "vec_id", "v")


@query("SELECT md5(text) AS text_key, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first, doc_id FROM documents QUALIFY n >= 2")
def exact_dup_groups(spark, d):
    """A row for each member of a group of copies; texts move as their hashes."""
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"))
    return G.copy_groups(rows, "text_key", "doc_id")


@query(f"SELECT doc_id, split, source FROM (SELECT d.doc_id, {SPLIT} AS split, source, row_number() OVER (PARTITION BY text ORDER BY {_PRIO} DESC, d.doc_id) AS r FROM documents d) WHERE r = 1")
def keep_best_copy(spark, d):
    rows = _copied(spark, d).withColumn("k", F.sha2("text", 256)).drop("text")
    return G.keep_best(rows, "k", [-split_priority(F.col("split")), F.col("doc_id")]).select("doc_id", "split", "source")


@query(f"SELECT source, count(*) AS rows, count(*) FILTER (n > 1) AS copied, count(*) FILTER (n > 1 AND r = 1) AS duplicate_groups, count(*) FILTER (r = 1 AND splits > 1) AS cross_split_groups, count(*) FILTER (r > 1) AS removed FROM (SELECT source, count(*) OVER w AS n, len(list_distinct(list({SPLIT}) OVER w)) AS splits, row_number() OVER (PARTITION BY text ORDER BY {_PRIO} DESC, d.doc_id) AS r FROM documents d WINDOW w AS (PARTITION BY text)) GROUP BY source")
def dedup_stats(spark, d):
    """Copies per source after keeping the best of each text; long texts are counted by their hash pair, not shuffled."""
    rows = table(spark, d, "documents").select("doc_id", "source", split_of(F.col("doc_id")).alias("split"), F.sha2("text", 256).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.min(F.struct((-split_priority(F.col("split"))).alias("p"), "doc_id")).alias("best"))
    best = F.col("best.doc_id") == F.col("doc_id")
    return rows.join(groups, "key").groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 1).alias("copied"), F.count_if((F.col("n") > 1) & best).alias("duplicate_groups"), F.count_if((F.col("splits") > 1) & best).alias("cross_split_groups"), F.count_if(~best).alias("removed"))


#: Labels by id, so that copies contradict each other.
_LABELLED = "SELECT doc_id, md5(text) AS k, doc_id % 2 AS label FROM documents"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"), (F.col("doc_id") % 2).alias("label"))


@query(f"SELECT k, count(*) AS n, count(DISTINCT label) AS labels FROM ({_LABELLED}) GROUP BY k HAVING count(DISTINCT label) > 1")
def label_conflicts(spark, d):
    return G.label_conflicts(_labelled(spark, d), "k", "label")


@query(f"WITH l AS ({_LABELLED}) SELECT doc_id, k, label FROM l WHERE k NOT IN (SELECT k FROM l GROUP BY k HAVING count(DISTINCT label) > 1)")
def without_conflicts(spark, d):
    return G.drop_label_conflicts(_labelled(spark, d), "k", "label").select("doc_id", "k", "label")


@query("SELECT source, arg_max(lang, n * 1000000000 - f) AS majority FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) GROUP BY source")
def majority_label(spark, d):
    return G.majority_label(table(spark, d, "documents"), "source", "lang", "doc_id")


@query("SELECT source, sum(n)::BIGINT AS comment_count, (sum(n) - count(*)) / sum(n)::DOUBLE AS duplicate_ratio, max(n) / sum(n)::DOUBLE AS max_exact_repeat_ratio FROM (SELECT source, text, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def repeat_features(spark, d):
    return G.repeat_features(table(spark, d, "documents").select("source", F.sha2("text", 256).alias("k")), "source", "k")


@query(f"SELECT g, avg(sim) AS semantic_pair_mean, stddev_pop(sim) AS semantic_pair_std, quantile_cont(sim, 0.75) AS semantic_pair_p75, quantile_cont(sim, 0.9) AS semantic_pair_p90, max(sim) AS semantic_pair_max, avg(sim) FILTER (r <= ceil(n * 0.2)) AS semantic_top_pair_mean FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sim DESC, a, b) AS r, count(*) OVER (PARTITION BY g) AS n FROM ({_PAIRS})) GROUP BY g")
def pair_features(spark, d):
    return G.pair_features(_pairs(spark, d), "g")


@query(f"SELECT g, avg(s) AS semantic_nearest_mean, stddev_pop(s) AS semantic_nearest_std FROM (SELECT g, id, max(sim) AS s FROM (SELECT g, a AS id, sim FROM ({_PAIRS}) UNION ALL SELECT g, b, sim FROM ({_PAIRS})) GROUP BY g, id) GROUP BY g")
def nearest_features(spark, d):
    return G.nearest_features(_pairs(spark, d), "g")


@query(f"WITH x AS (SELECT g, vec_id, i, v[i]::DOUBLE AS x FROM ({_G}), (SELECT unnest(generate_series(1, 64)) AS i)), m AS (SELECT g, i, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT g, sqrt(sum(m * m)) AS n FROM m GROUP BY g), s AS (SELECT g, vec_id, sum(x * m) / any_value(n) AS s FROM x JOIN m USING (g, i) JOIN n USING (g) GROUP BY ALL) SELECT g, avg(s) AS semantic_centroid_mean, stddev_pop(s) AS semantic_centroid_std FROM s GROUP BY g")
def centroid_features(spark, d):
    return G.centroid_features(_vectors(spark, d), "g", "vec_id", "v")


@query()
def group_features(spark, d):
    """All fourteen features; the spectrum's share has no SQL form."""
    v = _vectors(spark, d).withColumn("key", (F.col("vec_id") % 15).cast("string"))
    return G.group_features(v.select("g"), v, "g", "vec_id", "key", "v")


_GRAMS = "SELECT conv_id, turn, substr(t, i, n) AS term FROM (SELECT conv_id, turn, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t, unnest(generate_series(1, length(regexp_replace(lower(text), '\\s\\s+', ' ', 'g')))) AS i FROM conversations), (VALUES (2), (3), (4)) AS v(n) WHERE i + n - 1 <= length(t)"
_TFIDF = f"tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM ({_GRAMS}) GROUP BY ALL), df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, turn, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (conv_id, term) JOIN n USING (conv_id)), l AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS l FROM w GROUP BY ALL), z AS (SELECT conv_id, turn, term, w / l AS weight FROM w JOIN l USING (conv_id, turn))"


@query(f"WITH {_TFIDF} SELECT conv_id, turn, count(*) AS terms, max(weight) AS heaviest, sum(weight) AS total FROM z GROUP BY ALL")
def char_tfidf(spark, d):
    v = G.char_tfidf(table(spark, d, "conversations"), ["conv_id", "turn"], "text", within=["conv_id"])
    return v.groupBy("conv_id", "turn").agg(F.count("*").alias("terms"), F.max("weight").alias("heaviest"), F.sum("weight").alias("total"))


@query(f"WITH {_TFIDF} SELECT a.conv_id, a.turn AS a, b.turn AS b, sum(a.weight * b.weight) AS sim FROM z a JOIN z b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn < b.turn GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.2")
def similar_pairs(spark, d):
    return similar_texts(table(spark, d, "conversations"), "conv_id", "turn", "text", 0.2)


_RECOORD = f"""WITH RECURSIVE conversations_ AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS text FROM conversations UNION ALL SELECT conv_id, turn + 100, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') || 'x' FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn + 200, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') FROM conversations WHERE turn % 3 = 0),
valid AS (SELECT * FROM conversations_ WHERE length(text) >= 4),
{_TFIDF.replace("conversations", "valid")},
pairs AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, sum(a.weight * b.weight) AS sim FROM z a JOIN z b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn < b.turn GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.78 - 1e-9),
both_ AS (SELECT conv_id, a, b FROM pairs UNION ALL SELECT conv_id, b, a FROM pairs),
r(conv_id, node, root) AS (SELECT DISTINCT conv_id, a, a FROM both_ UNION SELECT r.conv_id, both_.b, r.root FROM r JOIN both_ ON r.conv_id = both_.conv_id AND r.node = both_.a WHERE r.root < both_.b),
m AS (SELECT conv_id, node, min(root) AS root FROM r GROUP BY ALL),
c AS (SELECT conv_id, max(n) AS largest, sum(n) AS members FROM (SELECT conv_id, root, count(*) AS n FROM m GROUP BY ALL) GROUP BY conv_id),
dup AS (SELECT conv_id, sum(n) AS members FROM (SELECT conv_id, text, count(*) AS n FROM valid GROUP BY ALL HAVING count(*) > 1) GROUP BY conv_id),
pp AS (SELECT conv_id, count(*) AS n, max(sim) AS top FROM pairs GROUP BY conv_id),
v AS (SELECT conv_id, count(*) AS n FROM valid GROUP BY conv_id),
o AS (SELECT g.conv_id, coalesce(v.n, 0) AS valid, coalesce(dup.members, 0)::BIGINT AS duplicate_members, coalesce(pp.n, 0) AS similar_pairs, coalesce(c.largest, 0) AS largest_cluster, coalesce(pp.top, 0) AS max_similarity, coalesce(c.members, 0) AS members
      FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN v USING (conv_id) LEFT JOIN dup USING (conv_id) LEFT JOIN pp USING (conv_id) LEFT JOIN c USING (conv_id)),
s AS (SELECT *, CASE WHEN valid < 2 THEN 0 ELSE least(greatest(0.35 * duplicate_members / valid + 0.30 * members / valid + 0.20 * largest_cluster / valid + 0.15 * similar_pairs / (valid * (valid - 1) / 2), 0), 1) END AS score FROM o)
SELECT conv_id, valid, duplicate_members, similar_pairs, largest_cluster, max_similarity, score::DOUBLE AS score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS risk FROM s"""


@query(_RECOORD)
def coordination(spark, d):
    """The heuristic report of every conversation, to whose comments near and exact copies are added."""
    c = G.written(table(spark, d, "conversations").select("conv_id", "turn", canonical(F.col("text")).alias("key")), "canonical")
    near = c.where("turn % 2 = 0").select("conv_id", (F.col("turn") + 100).alias("turn"), F.concat("key", F.lit("x")).alias("key"))
    exact = c.where("turn % 3 = 0").select("conv_id", (F.col("turn") + 200).alias("turn"), "key")
    return G.coordination(c.union(near).union(exact), "conv_id", "turn", "key").select("conv_id", "valid", "duplicate_members", "similar_pairs", "largest_cluster", "max_similarity", "score", "risk")


_ORIGIN = "concat(source, '/', n_chars % 97)"
_COMP = f"""WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS t, {_ORIGIN} AS o FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY t) AS b FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY o) FROM d),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a WHERE r.root < s.b),
c AS (SELECT node AS doc_id, min(root) AS component FROM r GROUP BY node)"""


def _components(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"), F.concat_ws("/", "source", (F.col("n_chars") % 97).cast("string")).alias("o"))
    roots = G.connected(G.copy_edges(docs, "t", "doc_id").union(G.copy_edges(docs, "o", "doc_id")))
    return docs.select("doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component"))


@query(_COMP + " SELECT doc_id, component FROM c")
def components(spark, d):
    """Rows joined by the same text or the same origin."""
    return _components(spark, d)


_SPLITS = _COMP + ", g AS (SELECT component, count(*) AS size, component % 2 AS label FROM c GROUP BY component), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(concat(component, '-42'))) AS r, count(*) OVER (PARTITION BY label) AS n FROM g), q AS (SELECT *, CASE WHEN r * 100 <= n * 50 THEN 'fit' WHEN r * 100 <= n * 65 THEN 'dev' WHEN r * 100 <= n * 80 THEN 'calibration' ELSE 'test_locked' END AS split FROM p)"


def _splits(spark, d):
    comps = _components(spark, d)
    groups = comps.groupBy("component").agg(F.count("*").alias("size")).withColumn("label", F.col("component") % 2)
    return comps, G.group_split(groups, "component", "label")


@query(_SPLITS + " SELECT split, label, count(*) AS groups, sum(size)::BIGINT AS rows FROM q GROUP BY ALL")
def group_split(spark, d):
    return _splits(spark, d)[1].groupBy("split", "label").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"))


@query(_SPLITS + " SELECT count(*) AS leaks FROM (SELECT md5(text) AS k FROM documents JOIN c USING (doc_id) JOIN q USING (component) GROUP BY k HAVING count(DISTINCT split) > 1)")
def leak_audit(spark, d):
    comps, split = _splits(spark, d)
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k")).join(comps, "doc_id").join(split.select("component", "split"), "component")
    return G.split_leaks(rows, "k").agg(F.count("*").alias("leaks"))


@query("SELECT k, count(DISTINCT split) AS splits FROM (SELECT md5(text) AS k, " + SPLIT + " AS split FROM documents d) GROUP BY k HAVING count(DISTINCT split) > 1")
def split_leaks(spark, d):
    return G.split_leaks(_copied(spark, d).withColumn("k", F.md5(F.col("text").cast("binary"))), "k")


@query()
def group_folds(spark, d):
    """Five folds over the sources by size, greedily; the order of work has no SQL form."""
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return G.folds(sizes, "source", "n").groupBy("fold").agg(F.count("*").alias("sources"))



_NEAR = """t AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text),
ch AS (SELECT id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM (SELECT id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS s FROM t)),
g3 AS (SELECT id, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS a, lead(c, 3) OVER w AS d, lead(c, 4) OVER w AS e FROM ch WINDOW w AS (PARTITION BY id ORDER BY i)),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, a AS term FROM g3 UNION ALL SELECT id, a || d FROM g3 UNION ALL SELECT id, a || d || e FROM g3) WHERE term IS NOT NULL GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 50000),
w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term)),
l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY id), z AS (SELECT id, term, w / l AS w FROM w JOIN l USING (id)),
sims AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS sim FROM z a JOIN z b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.92),
near AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS r FROM (SELECT * FROM sims UNION ALL SELECT b, a, sim FROM sims)) WHERE r <= 5)"""


def _near(spark, d):
    return G.near_text_edges(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_NEAR} SELECT a, b, round(sim, 6) AS sim FROM near")
def near_pairs(spark, d):
    """The five nearest texts of each text, by character n-grams, with a cosine of 0.92 or more."""
    return _near(spark, d).select("a", "b", F.round("sim", 6).alias("sim"))


_SAFE = "WITH RECURSIVE " + _NEAR + f""", d AS (SELECT doc_id, md5(text) AS t, {_ORIGIN} AS o FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY t) AS b FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY o) FROM d UNION SELECT a, b FROM near),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a WHERE r.root < s.b),
c AS (SELECT node AS doc_id, min(root) AS component FROM r GROUP BY node)"""


def _safe_components(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"), F.concat_ws("/", "source", (F.col("n_chars") % 97).cast("string")).alias("o"))
    return G.safe_groups(docs, "doc_id", ["t", "o"], _near(spark, d))


@query(_SAFE + " SELECT doc_id, component FROM c")
def safe_components(spark, d):
    """Rows joined by the same text, the same origin or nearly the same text."""
    return _safe_components(spark, d)


@query(_SAFE + _SPLITS[len(_COMP):] + " SELECT (SELECT count(*) FROM near) AS edges, (SELECT count(*) FROM near JOIN c x ON near.a = x.doc_id JOIN q y ON x.component = y.component JOIN c u ON near.b = u.doc_id JOIN q v ON u.component = v.component WHERE y.split <> v.split) AS leaks, (SELECT count(*) FROM near WHERE a % 4 <> b % 4) AS naive_leaks")
def safe_split_leaks(spark, d):
    """Edges of near copies, and how many of them a group split and a split by id part."""
    near = G.written(_near(spark, d), "near")
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"), F.concat_ws("/", "source", (F.col("n_chars") % 97).cast("string")).alias("o"))
    comps = G.written(G.safe_groups(docs, "doc_id", ["t", "o"], near), "safe-groups")
    split = G.group_split(comps.groupBy("component").agg(F.count("*").alias("size")).withColumn("label", F.col("component") % 2), "component", "label")
    where = comps.join(split, "component").select("doc_id", "split")
    both = near.join(where.select(F.col("doc_id").alias("a"), F.col("split").alias("sa")), "a").join(where.select(F.col("doc_id").alias("b"), F.col("split").alias("sb")), "b")
    return both.agg(F.count("*").alias("edges"), F.count_if(F.col("sa") != F.col("sb")).alias("leaks"), F.count_if(F.col("a") % 4 != F.col("b") % 4).alias("naive_leaks"))
