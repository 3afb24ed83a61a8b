import itertools
import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import groups as G
from siltstone.operators import grams, layers, metrics
from siltstone.plans import registry
from siltstone.sources import io

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    "text, n, score, accepted",
    [("周末去了新开的店铺，喝了一杯拿铁，环境安静适合看书", 25, 2, True), ("好用推荐", 4, 3, False), ("无限回购的一款洗面奶，洗完脸很干净也不紧绷呢", 22, 3, True), ("不推荐这家，排队两个小时才吃上饭，味道真的很普通", 24, 3, True), ("品牌官方的链接在主页，需要的可以自己去找找看哦哦", 24, 1, False), ("今天下雨我们在图书馆写作业然后一起回宿舍休息", 22, 0, False)],
)
def test_scope(spark, text, n, score, accepted):
    got = T.scope(F.col("t"))
    row = one(spark, F.struct(F.length("t").alias("n"), got["scope_score"].alias("s"), got["accepted"].alias("a")), t=text)
    assert (row["n"], row["s"], row["a"]) == (n, score, accepted)


def test_text_keys(spark):
    assert one(spark, T.canonical(F.col("t")), t="Ａｂ c，１２！") == "abc12"
    assert one(spark, T.canonical(F.col("t")), t="ﬁne_é　x") == "fine_éx"
    assert one(spark, T.canonical(F.col("t")), t="！！") == ""
    assert one(spark, T.clean_text(F.col("t")), t="　a   b\n") == "a b"
    assert one(spark, T.clean_text(F.col("t")), t=F.lit(None).cast("string")) == ""
    assert one(spark, T.overlap_key(F.col("t")), t="Straße X") == "strassex"


@pytest.mark.parametrize("n, windows, starts, last, covered", [(10, 1, [0], 0, 10), (63, 1, [0], 0, 63), (64, 2, [0, 1], 1, 64), (120, 3, [0, 55, 57], 57, 120), (200, 4, [0, 55, 110], 137, 200), (880, 16, [0, 55, 110], 817, 880), (2000, 16, [0, 110, 275], 1937, 1008)])
def test_token_windows(spark, n, windows, starts, last, covered):
    row = one(spark, F.struct(T.token_windows(F.col("n")).alias("w"), T.covered(T.token_windows(F.col("n"))).alias("c")), n=n)
    first = [w["first"] for w in row["w"]]
    assert (len(first), first[: len(starts)], first[-1], row["c"]) == (windows, starts, last, covered)


@pytest.mark.parametrize(
    "comments, valid, dup, pairs, clusters, score, risk",
    [(["非常好喝推荐", "非常好喝推荐！", "非常 好喝 推荐", "店里灯光很暖", "下次还想再来"], 5, 3, 3, [[0, 1, 2]], 0.555, "medium"), (["一样的评论内容"] * 4 + ["完全不同的一句话"], 5, 4, 6, [[0, 1, 2, 3]], 0.77, "high"), (["好"], 0, 0, 0, None, 0.0, "low")],
)
def test_coordination(spark, comments, valid, dup, pairs, clusters, score, risk):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(comments)], "g long, pos int, text string").withColumn("key", T.canonical(F.col("text")))
    r = G.coordination(df, "g", "pos", "key").head()
    assert (r["valid"], r["duplicate_members"], r["similar_pairs"], r["clusters"], r["risk"]) == (valid, dup, pairs, clusters, risk)
    assert math.isclose(r["score"], score, abs_tol=1e-9)


def test_auc_ties_and_thresholds(spark):
    df = spark.createDataFrame(list(zip([0.1, 0.4, 0.35, 0.8, 0.35], [0, 0, 1, 1, 0], strict=True)), "score double, label int")
    assert metrics.roc_auc(df).head()["auc"] == 0.75
    assert metrics.roc_auc(df.where("label = 1")).head()["auc"] is None
    none = metrics.operating_point(df.withColumn("label", 1 - F.col("label")), 0.0).head()
    assert none["threshold"] == math.nextafter(0.8, 1) and none["tp"] == 0
    with pytest.raises(Exception, match="two distinct scores"):
        metrics.midpoint_threshold(df.where("score = 0.35")).count()


def test_components_are_an_equivalence(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (3, 10)]
    got = {r["node"]: r["root"] for r in G.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}


def test_near_pairs_equal_brute_force(spark):
    texts = ["the cat sat on the mat today", "the cat sat on the mat today.", "a dog ran in the park", "a dog ran in the park!", "nothing alike here"]
    v = G.char_tfidf(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t", 2, 3)
    rows = {}
    for r in v.collect():
        rows.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = {(a, b) for a, b in itertools.permutations(rows, 2) if sum(w * rows[b].get(t, 0) for t, w in rows[a].items()) >= 0.6}
    assert {(r["a"], r["b"]) for r in G.near_pairs(v, "id", 0.6).collect()} == want and want


def test_comment_cards(spark):
    lines = ["user_a", "first comment", "2 hours ago", "user_b", "wrapped", "line", "3天前 回复", "user_c", "last"]
    rows = [(1, t, 0.9, 70.0, i * 24.0, 300.0, i * 24.0 + 22) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "image_id long, text string, confidence double, left double, top double, right double, bottom double")
    assert [r["text"] for r in layers.comment_cards(df).orderBy("top").collect()] == ["first comment", "wrappedline", "last"]
    assert layers.comment_cards(df.where("false")).count() == 0


def test_visual_rows(spark):
    parts = [(1, "world", 0.9, 60.0, 10.5, 100.0, 30.0), (1, "hello", 0.8, 0.0, 10.0, 50.0, 30.0), (1, "below", 0.7, 0.0, 60.0, 50.0, 80.0), (1, "dim", 0.2, 0.0, 100.0, 50.0, 120.0)]
    df = spark.createDataFrame(parts, "image_id long, text string, confidence double, left double, top double, right double, bottom double")
    assert [r["text"] for r in layers.visual_rows(df).orderBy("row").collect()] == ["hello world", "below"]


def test_image_difference():
    a = np.full((60, 60, 3), 120, np.uint8)
    b = a.copy()
    b[10:30, 20:45] = 250
    same, edit = layers.image_difference(a, a), layers.image_difference(b, a)
    assert same["similarity"] == pytest.approx(1) and same["region_count"] == 0
    assert edit["region_count"] == 1 and 0.1 < edit["changed_ratio"] < 0.2 and edit["similarity"] < 0.99


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    open(p, "w").write('{"id":"1","text":"ä","label":0}\n\n{"id":"2","text":"b","label":1}\n')
    df = io.read_checked_jsonl(spark, p, "id string, text string, label int")
    assert df.count() == 2
    io.write_csv(df.withColumn("tags", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv"), "id string, text string, label int, tags string").orderBy("id").head()["tags"] == "x\ny"
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_csv(df, str(tmp_path / "csv"))
    open(tmp_path / "b.json", "w").write(json.dumps({"cases": [{"id": "c", "n": 3}]}))
    assert io.read_json_array(spark, str(tmp_path / "b.json"), "id string, n int", "cases").head()["n"] == 3
    req = spark.createDataFrame([('{"text":"t","comments":["a",{"id":"1","text":"b"}]}',)], "body string")
    assert [c["text"] for c in io.parse_requests(req, "body").head()["comments"]] == ["a", "b"]


def test_data_urls(spark):
    got = lambda u: one(spark, T.data_url(F.col("u")).alias("x")["status"], u=u)
    assert [got(u) for u in ("data:image/png;base64,AAAA", "data:image/png;base64,@@", "http://x", "data:image/png;base64,")] == ["completed", "bad_base64", "bad_format", "empty"]


def test_streams(spark, tmp_path):
    from siltstone.streaming import detectors

    spark.createDataFrame([("2026-01-01 00:00:00", "Hi!"), ("2026-01-01 00:01:00", "hi")], "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = detectors.repeated_comments(stream, "ts", "text").writeStream.format("memory").queryName("repeats").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("repeats").head()["n"] == 2


def test_folds_and_split(spark):
    g = spark.createDataFrame([(i, i % 2, i % 7 + 1) for i in range(100)], "g long, label int, n int")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["split"]: r["count"] for r in G.group_split(g, "g", "label").groupBy("split").count().collect()} == {"fit": 50, "dev": 14, "calibration": 16, "test_locked": 20}
    loads = [r["s"] for r in G.folds(g, "g", "n").join(g, "g").groupBy("fold").agg(F.sum("n").alias("s")).collect()]
    assert max(loads) - min(loads) <= 7


def _plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["clean_text", "scope_filter", "dedup_stats", "f1_midpoint", "token_windows", "centroid_features", "group_split", "comment_cards", "score_summary", "data_urls", "coordination", "comment_group_check", "reviewed_variants", "cross_validated", "imported_comments", "near_pairs"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(_plain, r)) for r in con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_similar_texts_equal_the_join_and_move_no_terms(spark):
    texts = ["the cat sat  on the mat", "The cat sat on the mat!", None, "", "a dog ran", "xx", "你好 \U0001f600 cat"]
    rows = [(g, p, texts[(p * g) % 7]) for g in range(1, 6) for p in range(9)] + [(2, 3, "twice the place"), (3, None, "the cat sat"), (None, 1, "lost"), (9, 0, "alone")]
    df = spark.createDataFrame(rows, "g long, p int, t string")
    got = lambda x: sorted((r["g"], r["a"], r["b"], round(r["sim"], 9)) for r in x.collect())
    want = got(G.similar_pairs(G.char_tfidf(df, ["g", "p"], "t", within=["g"]), "g", "p", 0.1))
    here = grams.similar_texts(df, "g", "p", "t", 0.1)
    assert want and got(here) == want == got(grams.similar_texts(df, "g", "p", "t", 0.1, most=100))
    plan = registry.QUERIES["similar_pairs"](spark, DATA)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "Generate" not in plan
    long = [f"{'ab' * 30} {i} {'cd' * (i % 5)}" for i in range(40)]
    a, b, sims = grams.group_similarities(long, np.arange(40), 40, 2, 4, 0.3, block=7)
    whole = grams.group_similarities(long, np.arange(40), 40, 2, 4, 0.3)
    assert dict(zip(zip(a, b), sims.round(9))) == dict(zip(zip(*whole[:2]), whole[2].round(9))) and len(a)


def test_coordination_takes_a_group_in_one_task(spark, monkeypatch):
    """No rows of n-grams, pairs or edges are written, and a group that is too large for a task has the same report from rows."""
    texts = ["the cat sat on the mat", "the cat sat on the mat!", "a dog ran off", "xyz", None, "the cat sat on the mat", "a dog ran of"]
    rows = [(g, p, texts[(p * g) % 7]) for g in range(1, 7) for p in range(9)] + [(2, 3, "twice the place"), (3, None, "the cat sat on"), (None, 1, "lost words"), (9, 0, "alone")]
    df = spark.createDataFrame(rows, "g long, p int, key string")
    got = lambda: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in G.coordination(df, "g", "p", "key").collect()), key=repr)
    monkeypatch.setattr(grams, "GROUP_CHARS", 40)
    want = got()
    monkeypatch.undo()
    labels = []
    for name in ("char_tfidf", "similar_pairs", "connected"):
        monkeypatch.setattr(G, name, None)
    monkeypatch.setattr(G, "written", lambda out, label, f=G.written: (labels.append(label), f(out, label))[1])
    assert got() == want and len(want) == 8 and max(r[3] for r in want) > 2 and "pairs" not in labels


def test_near_texts_equal_the_join(spark, monkeypatch):
    """The exact pairs of rows of terms, from leads alone: over random words with copies changed a little, in blocks of few rows."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeé "), 5)) for _ in range(80)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(60)]
    texts += [t + rng.choice(["", " x", "!", " " + words[0]]) for t in texts for _ in range(2)] + [None, "", "", "ab", "你好"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = lambda x: sorted((r["a"], r["b"], round(r["sim"], 9)) for r in x.collect())
    near = lambda: got(G.near_text_edges(df, "id", "t", 0.9, max_features=400))
    monkeypatch.setattr(grams, "common_terms", lambda *a, f=grams.common_terms: None)
    want = near()
    monkeypatch.undo()
    plan = G.near_text_edges(df, "id", "t", 0.9, max_features=400)._jdf.queryExecution().toString()
    assert len(want) > 100 and near() == want and "Generate" not in plan
    monkeypatch.setattr(G, "near_pairs", None)  # rows of terms are not made
    monkeypatch.setattr(grams, "BLOCK_ROWS", 9)
    monkeypatch.setattr(grams, "LEAD", 0.4)
    assert near() == want


def test_near_texts_hold_a_block_and_not_what_it_meets(spark, monkeypatch):
    """Texts of one size and a large group of near copies are split over tasks; none makes arrays of more than its part and a batch."""
    words = [f"word{i:02}" for i in range(40)]
    texts = [" ".join([*words[:i], f"othe{i:02}", *words[i + 1 :]]) for i in range(40)] + [" ".join(f"el{i:02}{k}" for k in range(3)) for i in range(20)]
    for kind, keys in (("long", range(60)), ("string", [f"k{(i * 7) % 60}" for i in range(60)])):
        df = spark.createDataFrame(list(zip(keys, texts, strict=True)), f"id {kind}, t string")
        got = lambda: sorted((r["a"], r["b"], round(r["sim"], 9)) for r in G.near_text_edges(df, "id", "t", 0.9).collect())
        want, rows = got(), {}
        tasks = lambda out: out.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        monkeypatch.setattr(grams, "written", lambda out, label, f=grams.written: (f(out, label), rows.update({label: len(tasks(out)) if label in ("candidates", "nearest-in-parts") else 0}))[0])  # noqa: B023
        monkeypatch.setattr(grams, "BLOCK_TERMS", 400)
        monkeypatch.setattr(grams, "PART_CHARS", 2000)
        monkeypatch.setattr(grams, "CHARS", 1000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert got() == want and len(want) == 200 and rows["candidates"] > 10 and rows["nearest-in-parts"] > 4
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        monkeypatch.undo()


@pytest.mark.parametrize("name", ["safe_components", "safe_split_leaks"])
def test_safe_queries_make_no_rows_of_terms(spark, monkeypatch, name):
    monkeypatch.setattr(G, "near_pairs", None)
    monkeypatch.setattr(G, "char_tfidf", None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    cursor = con.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, DATA).collect()) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", ["safe_components", "safe_split_leaks"])
def test_a_group_of_near_copies_writes_no_pairs(spark, tmp_path, monkeypatch, name):
    """40 texts that are near each other: candidates are a tree in each task, and of each text five others at most are written, not all 780 pairs."""
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"other{i}", *words[i + 1 :]]) for i in range(40)] + [" ".join(f"else{i}{k}" for k in range(20)) for i in range(5)]
    docs = [(i, t, f"s{i}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {}
    monkeypatch.setattr(grams, "written", lambda df, label, f=grams.written: (out := f(df, label), rows.update({label: out.count()}))[0])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(cursor.fetchall())
    assert 39 <= rows["candidates"] <= 160 and rows["nearest"] == 220


def test_safe_split_leaks_in_small_blocks_and_parts(spark, monkeypatch):
    """The SQL's result where blocks and parts of groups are far smaller than the table."""
    for name, most in (("BLOCK_TERMS", 20_000), ("PART_CHARS", 3000), ("PASSING", 5000), ("MEETINGS", 2000)):
        monkeypatch.setattr(grams, name, most)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    cursor = con.execute(registry.SQL["safe_split_leaks"])
    columns = [c[0] for c in cursor.description]
    assert [tuple(r[c] for c in columns) for r in registry.QUERIES["safe_split_leaks"](spark, DATA).collect()] == cursor.fetchall()


def test_leads_are_read_by_block_and_not_shuffled(spark, monkeypatch):
    """A row can be near many blocks, so a shuffle to them takes a copy of its lead for each; blocks read the written leads, a task each."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcde "), 5)) for _ in range(80)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + [t + " x" for t in texts])), "id long, t string")
    plans, tasks = [], []

    def seen(out, label, f=grams.written):
        if label == "candidates":
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            tasks.append(sum(n > 0 for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()))
        return f(out, label)

    got = lambda: sorted((r["a"], r["b"], round(r["sim"], 9)) for r in G.near_text_edges(df, "id", "t", 0.9).collect())
    monkeypatch.setattr(grams, "written", seen)
    want = got()
    assert len(want) > 60 and len(plans) == 1 and "Exchange" not in plans[0] and tasks[0] > 5
    monkeypatch.setattr(grams, "WAVE", 4)
    assert got() == want and len(plans) > 4
