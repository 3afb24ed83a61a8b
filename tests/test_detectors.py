import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import groups as G
from siltstone.operators import layers, metrics, models, spread, validators
from siltstone.sources import io

ENDS = ["2024-01-02", "01-02 上海", "1/2", "2024/1/2 foo", "01-02回复", "3天前 回复", "5分钟前", "刚刚", "昨天 10:20", "2 hours ago", "3 h ago", "1d ago", "10 minutes ago!", "reply", "like reply", "Like 12 reply", "like12 translate", "reply translate", "回复", "赞 12", "翻译", "view 3 replies", "viow 12 repl", "展开 3 条回复", "展开回复", "展开3条回复"]
OTHERS = ["2024 was good", "hello", "3天", "天前", "2 hours", "ago", "like this", "reply to me", "赞 abc", "view replies", "展开", "12 reply", "reply 3", "5分钟前后", "今天气", "", "1-234", "2024-01-02abc"]


def test_card_ends(spark):
    got = spark.createDataFrame([(t,) for t in ENDS + OTHERS], "t string").select(T.is_card_end(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [True] * len(ENDS) + [False] * len(OTHERS)


def test_splits_by_exact_names(spark):
    names = ["Train_1", "Train_4", "Validation", "Test", "Train_9", "TEST", "training set", "validation"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(T.split_priority(F.col("s"))).collect()] == [1, 1, 2, 3, 0, 0, 0, 0]
    for n in names[4:]:
        with pytest.raises(Exception, match="unknown split"):
            df.where(F.col("s") == n).select(T.split_route(F.col("s"))).collect()


def test_base64_is_strict(spark):
    bodies = {"AAAA": "completed", "AA==": "completed", "AAA A": "bad_base64", "AA\nAA": "bad_base64", "AAA": "bad_base64", "AA=": "bad_base64", "A===": "bad_base64", "": "empty"}
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", T.data_url(F.concat(F.lit("data:image/png;base64,"), F.col("b")))["status"].alias("s")).collect()
    assert {r["b"]: r["s"] for r in got} == bodies


def test_comments_by_their_json_type(spark):
    body = '{"text": "t", "comments": ["{smile} nice", {"id": "1", "text": "b"}], "image": "x"}'
    row = io.parse_requests(spark.createDataFrame([(body,), ("no json",)], "body string"), "body").collect()
    assert [(c["id"], c["text"]) for c in row[0]["comments"]] == [(None, "{smile} nice"), ("1", "b")] and row[1]["comments"] is None
    raw = ['{"comments": ["{smile} nice", {"text": " b "}, " "], "lines": []}', '{"comments": [3], "lines": []}', '{"comments": []}', "no json"]
    got = [r["x"] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(layers.parse_transcription(F.col("r")).alias("x")).collect()]
    assert got[0]["comments"] == ["{smile} nice", "b"] and [x["valid"] for x in got] == [True, False, False, False]
    values = ['" a "', '{"text": 5, "content": " x "}', '{"text": "", "content": "y"}', '{"id": 1}', '{"text": 0, "comment": "z"}']
    df = spark.createDataFrame([(v,) for v in values], "r string").select(F.parse_json("r").alias("v"))
    assert [tuple(r) for r in df.select(T.comment_text(F.col("v")), T.candidate_text(F.col("v"))).collect()] == [("a", "a"), ("x", "5"), ("", "y"), (None, ""), ("z", "z")]


def test_rows_of_three_pixels_are_one_card(spark):
    rows = [(1, t, 0.9, 70.0, i * 9.0, 300.0, i * 9.0 + 3) for i, t in enumerate(["author", "first", "second"])]
    df = spark.createDataFrame(rows, "image_id long, text string, confidence double, left double, top double, right double, bottom double")
    assert [r["text"] for r in layers.comment_cards(df).collect()] == ["firstsecond"]


def test_next_number_above(spark):
    xs = [0.1, 1.0, 0.999, 2.0, 1e-300, -1.0, -0.3, 0.0, 123456.789, 0.5, 3.0, 1e300]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(metrics._next_above(F.col("x"))).collect()
    assert [r[0] for r in got] == [math.nextafter(x, math.inf) for x in xs]


def test_folds_equal_one_by_one():
    rng = random.Random(3)
    for k in (1, 3, 5):
        for _ in range(60):
            counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 8))}
            load, want = [0] * k, []
            for size in sorted(counts, reverse=True):
                for _ in range(counts[size]):
                    f = load.index(min(load))
                    load[f] += size
                    want.append((size, f))
            got = [(s, part[i % len(part)]) for s, _, n, part in G.deal(counts, k) for i in range(n)]
            assert got == want


def test_running_and_ranked_equal_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(s), int(n)) for g, s, n in zip(rng.integers(0, 3, 400), rng.permutation(400) / 7, rng.integers(0, 9, 400), strict=True)]
    df = spark.createDataFrame(rows, "g int, score double, n long").repartition(7)
    for by in ([], ["g"]):
        for down in (False, True):
            got = {(r["g"], r["score"]): r["n"] for r in spread.running(df, ["n"], descending=down, by=by).collect()}
            keep = lambda a, b: (not by or a[0] == b[0]) and (a[1] >= b[1] if down else a[1] <= b[1])
            assert got == {(g, s): sum(x[2] for x in rows if keep(x, (g, s))) for g, s, _ in rows}
    order = sorted(s for _, s, _ in rows)
    after = {r["score"]: r["up"] for r in spread.following(df, "score", "up").collect()}
    assert after == dict(zip(order, [*order[1:], None], strict=True))
    h = F.sha2(F.col("score").cast("string"), 256)
    got = spread.ranked(df, "g", h, "place").select("g", h.alias("h"), "place").collect()
    for g in range(3):
        assert [r["place"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["h"])] == list(range(1, sum(r["g"] == g for r in got) + 1))


def test_groups_over_the_cap_are_an_error(spark):
    df = spark.createDataFrame([(1, i, [1.0]) for i in range(31)], "g int, k int, v array<double>")
    assert G.vector_pairs(df.where("k < 30"), "g", "k", "v").count() == 435
    with pytest.raises(Exception, match="more than 30"):
        G.vector_pairs(df, "g", "k", "v").count()


def test_near_copies_are_one_group(spark):
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"else{i}" for i in range(60))]
    df = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "id long, t string, o string")
    edges = G.near_text_edges(df, "id", "t", min_df=1)
    assert {(r["a"], r["b"]) for r in edges.collect()} == {(0, 1), (1, 0)}
    groups = {r["id"]: r["component"] for r in G.safe_groups(df, "id", ["o"], edges).collect()}
    assert groups == {0: 0, 1: 0, 2: 2}


def test_text_classifier_equals_numpy(spark, tmp_path):
    """Weights of the fit against gradient descent in numpy on the same terms; saved and read again."""
    rng = np.random.default_rng(2)
    words = {0: ["calm", "plain", "river"], 1: ["buy", "promo", "river"]}
    rows = [(i, " ".join(rng.choice(words[i % 2], 6)), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, y int")
    for penalize in (False, True):
        model = models.fit_classifier(df, "id", "t", "y", 2, 3, 2, 40, penalize_intercept=penalize)
        terms = {r["term"]: (r["idf"], r["weight"]) for r in model.terms.collect()}
        names = sorted(terms)
        grams = lambda t: [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
        x = np.array([[(1 + math.log(grams(t).count(n))) * terms[n][0] if n in grams(t) else 0.0 for n in names] for _, t, _ in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = np.array([y for *_, y in rows])
        x1, w, reg = np.hstack([x, np.ones((len(x), 1))]), np.zeros(len(names) + 1), np.append(np.ones(len(names)), float(penalize))
        for _ in range(200):  # Newton's method
            p = 1 / (1 + np.exp(-x1 @ w))
            g, h = x1.T @ (p - y) + reg * w, (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(reg + 1e-12)
            w -= np.linalg.solve(h, g)
        assert np.allclose([terms[n][1] for n in names], w[:-1], atol=1e-3) and abs(model.intercept - w[-1]) < 1e-3
        scores = {r["id"]: r["margin"] for r in model.scores(df, "id", "t").collect()}
        assert np.allclose([scores[i] for i, *_ in rows], x1 @ w, atol=5e-3)
    model.save(str(tmp_path / "model"))
    again = models.load_classifier(spark, str(tmp_path / "model"))
    assert again.intercept == model.intercept and again.terms.count() == len(terms)
    unknown = spark.createDataFrame([(1, None), (2, ""), (3, "zz")], "id long, t string")
    assert {r["margin"] for r in again.scores(unknown, "id", "t").collect()} == {model.intercept}


def test_model_folder_and_hooks(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, y int")
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    model = layers.fit_logistic(rows.withColumn("f", array_to_vector(F.array("x"))), "f", "y")
    models.save_pipeline(model, str(tmp_path / "m"), {"threshold": 0.4}, spark)
    again, meta = models.load_pipeline(str(tmp_path / "m"), LogisticRegressionModel, spark)
    assert again.coefficients == model.coefficients and meta == {"threshold": 0.4}
    got = rows.select("x", models.score_with(_half, F.col("x")).alias("s"), models.score_with(_sum, F.col("x"), F.col("y"), batch=3).alias("t")).collect()
    assert all(r["s"] == r["x"] / 2 for r in got) and sorted(r["t"] for r in got) == sorted(i + i % 2 for i in range(20))
    with pytest.raises(ValueError, match="missing features: z"):
        models.select_features(rows, ["x", "z"], [])
    scores = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, s double")
    assert models.attach_scores(rows.where("x = 0"), scores, "x").head()["s"] == 1.0
    for x in (1, 2):
        with pytest.raises(Exception, match="scores"):
            models.attach_scores(rows.where(f"x = {x}"), scores, "x").collect()


def _half():
    return lambda batch: [x / 2 for x in batch]


def _sum():
    return lambda batch: [a + b for a, b in batch]


def test_windows_that_fit(spark):
    decode, encode = lambda ids: "".join(chr(97 + i) for i in ids), lambda text: [0, *text]
    df = spark.createDataFrame([([(0, [0, 1, 2, 3]), (2, [2, 3])],)], "w array<struct<start:int,ids:array<int>>>")
    got = df.select(T.fit_windows(F.col("w"), decode, encode, 4).alias("x")).head()["x"]
    assert [(w["start"], w["text"], w["size"]) for w in got] == [(0, "abc", 3), (2, "cd", 2)]
    with pytest.raises(Exception, match="can be encoded"):
        df.select(T.fit_windows(F.col("w"), decode, encode, 0)).collect()


def test_ocr_output_of_both_shapes(spark):
    box = [(0.0, 1.0), (9.0, 1.0), (9.0, 5.0), (0.0, 5.0)]
    kind = "array<struct<x:double,y:double>>"
    rows = [(1, [box, box], [" a ", " "], [0.9, 0.8], None), (2, None, None, None, [(box, "b", 0.7)]), (3, [box], None, [0.9], None)]
    df = spark.createDataFrame(rows, f"i int, boxes array<{kind}>, texts array<string>, scores array<double>, r array<struct<box:{kind},text:string,score:double>>")
    got = layers.ocr_parts(df, "i", F.col("boxes"), F.col("texts"), F.col("scores"), F.col("r")).collect()
    assert sorted((r["i"], r["text"], r["left"], r["bottom"]) for r in got) == [(1, "a", 0.0, 5.0), (2, "b", 0.0, 5.0)]


def test_gates_and_ranges(spark):
    rows = [(i, i % 2, 2, 1.0) for i in range(10)]
    cases = lambda rows: spark.createDataFrame(rows, "id int, label int, windows int, coverage double")
    validators.long_case_gate(cases(rows))
    for bad, message in ((rows[:9], "10 long"), ([(0, 0, 2, 1.0)] * 10, "unique"), ([*rows[:9], (9, 1, 1, 1.0)], "two windows"), ([*rows[:9], (9, 1, 2, 0.9)], "covered")):
        with pytest.raises(ValueError, match=message):
            validators.long_case_gate(cases(bad))
    validators.short_case_gate(cases([(i, 0, 1, 1.0) for i in range(60)]))
    with pytest.raises(ValueError, match="exactly 60"):
        validators.short_case_gate(cases(rows))
    with pytest.raises(ValueError, match="exactly 25"):
        validators.reference_case_gate(cases(rows))
    assert validators.in_range("rate", 0.1, 0, 1, open_low=True) == 0.1
    for args in (("rate", 0, 0, 1, True), ("epochs", 2.5, 1, None, False, True), ("fpr", 1.2, 0, 1)):
        with pytest.raises(ValueError, match="out of range"):
            validators.in_range(*args)
    assert validators.ready(spark, {"a": True}) == {"status": "ok", "models": {"a": True}}


def test_independent_test_set(spark):
    schema = "id string, source_group_id string, split string"
    test, other = spark.createDataFrame([("a", "g1", "t"), ("b", "g2", "t")], schema), spark.createDataFrame([("c", "g3", "fit")], schema)
    validators.independent_test(test, other)
    for row, name in (("a", "id a"), ("x", "source_group_id g1")):
        with pytest.raises(ValueError, match=name):
            validators.independent_test(test, spark.createDataFrame([(row, "g1" if row == "x" else "g9", "dev")], schema))
    with pytest.raises(ValueError, match="repeats"):
        validators.independent_test(test.union(test), other)
    stored = validators.fingerprint(test)
    assert validators.unchanged(test.orderBy(F.desc("id")), stored) and not validators.unchanged(other, stored)
    assert validators.disjoint_groups(test.union(other.withColumn("source_group_id", F.lit("g1"))), "source_group_id").count() == 1


def test_sources(spark, tmp_path):
    open(tmp_path / "c.json", "w").write('{"alignment": {"similarity_threshold": 0.0278}}')
    assert io.read_config(spark, str(tmp_path / "c.json"))["alignment"]["similarity_threshold"] == 0.0278
    for bad in ('{"alignment": {"similarity_threshold": "x"}}', "[1]", "no"):
        open(tmp_path / "c.json", "w").write(bad)
        with pytest.raises(ValueError):
            io.read_config(spark, str(tmp_path / "c.json"))
    df = spark.createDataFrame([(1, "ä", [1, 2])], "id int, t string, l array<int>")
    io.write_json_array(df, str(tmp_path / "out"))
    assert io.read_json_array(spark, str(tmp_path / "out"), "id int, t string, l array<int>").head() == df.head()
    with pytest.raises(ValueError, match="more than 0"):
        io.write_json_array(df, str(tmp_path / "out2"), most=0)
    assert io.responses(df.withColumn("n", F.lit(None).cast("int")), ["id", "n"]).head()["response"] == '{"id":1,"n":null}'
    open(tmp_path / "w.json", "w").write('{"cases": [{"id": "c", "box": {"left": 1.5}, "tags": ["a", "b"]}]}')
    assert io.read_json_array(spark, str(tmp_path / "w.json"), "id string, box struct<left: double, top: decimal(5,2)>, tags array<string>", "cases").head()["box"]["left"] == 1.5
    for name, n in (("train", 2), ("train-00001", 1), ("test", 3)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "hub" / f"{name}.parquet"))
    got = io.read_named_splits(spark, str(tmp_path / "hub"), ["train", "test"], ["id"]).groupBy("original_split").count().collect()
    assert {r["original_split"]: r["count"] for r in got} == {"train": 3, "test": 3}
    status = spark.createDataFrame([("image/png", 5), ("text/plain", 5), (None, 5), ("image/png", 0), ("IMAGE/JPEG", 99)], "m string, n long").select(io.upload_status(F.col("m"), F.col("n"), 50)).collect()
    assert [r[0] for r in status] == ["completed", "415", "415", "422", "413"]
    io.write_csv(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf") and part.read_text("utf-8-sig").splitlines()[0].replace('"', "") == "b,a"


def test_images_are_decoded_by_the_image_source(spark, tmp_path):
    spark._jvm.javax.imageio.ImageIO.write(spark._jvm.java.awt.image.BufferedImage(4, 3, 5), "png", spark._jvm.java.io.File(str(tmp_path / "a.png")))
    open(tmp_path / "b.png", "wb").write(b"no image")
    got = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["height"], r["width"], len(r["data"] or b"")) for r in io.read_decoded_images(spark, str(tmp_path)).collect()}
    assert got["a.png"] == ("completed", 3, 4, 36) and got["b.png"][0] == "422"
    big = io.read_decoded_images(spark, str(tmp_path), most=11).where("height > 0").head()
    assert big["status"] == "413" and big["data"] is None


def test_classifier_without_rows_of_terms(spark, monkeypatch):
    """The fit and the scores from counted terms equal those from rows of n-grams, which any number of letters may take."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([["calm", "é你"], ["buy", "PROMO "]][i % 2] + ["river"], 5)), i % 2) for i in range(40)] + [(40, None, 1), (41, "", 0), (42, "zz", None)]
    df = spark.createDataFrame(rows, "id long, t string, y int")
    got = {}
    for way in ("counted", "joined"):
        if way == "joined":
            monkeypatch.setattr(models, "common_terms", lambda *a: None)
            monkeypatch.setattr(models, "known_terms", lambda *a: None)
        model = models.fit_classifier(df, "id", "t", "y", 2, 4, 2, 60)
        got[way] = {r["id"]: r["margin"] for r in model.scores(df, "id", "t").collect()}, {r["id"]: r["score"] for r in model.scored(df, "t").collect()}
        plan = model.scores(df, "id", "t")._jdf.queryExecution().toString()
        assert ("Generate" in plan) == (way == "joined")
    for a, b in zip(*got.values(), strict=True):
        assert len(a) == 43 and all(abs(a[k] - b[k]) < 1e-4 for k in a)
