"""Gradients against finite differences, held-out accuracy, and the binomial tail against exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language_id, quality_classifier, quality_rules

DATA = "/root/testdata/sf0.01"


def test_language_gradients():
    rng = np.random.default_rng(3)
    H, k, T, batch = 5, 3, 7, 4
    net = language_id.Network(list("abc"), rng.normal(size=(2, 256, 2 * H)) * 0.3, rng.normal(size=(2, H, 2 * H)) * 0.3, rng.normal(size=(2 * H, k)), rng.normal(size=k))
    x, label = rng.integers(0, 4, (T, batch)).astype(np.uint8), rng.integers(0, k, batch)
    _, grad = language_id.loss_and_gradient(net, x, label)
    for name in ("E", "U", "V", "c"):
        value = getattr(net, name)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(12)] if name != "E" else [(d, b, j) for d in (0, 1) for b in range(4) for j in (0, 4, 7)]:
            before, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = before + step
                losses.append(language_id.loss_and_gradient(net, x, label)[0])
            value[at] = before
            assert grad[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-7), (name, at)


def test_ordinal_gradients(monkeypatch):
    rng = np.random.default_rng(4)
    w, t = rng.normal(size=20), np.array([-0.5, 0.2, -0.3])
    at, of = rng.integers(0, 20, 90), np.sort(rng.integers(0, 15, 90))
    grades, weight = rng.integers(0, 4, 15), rng.random(15)
    f = lambda: quality_classifier.loss_and_gradient(w, t, at, of, grades, weight, 0.1)
    _, gw, gt = f()
    for value, grad in ((w, gw), (t, gt)):
        for i in range(len(value)):
            before, losses = value[i], []
            for step in (1e-6, -1e-6):
                value[i] = before + step
                losses.append(f()[0])
            value[i] = before
            assert grad[i] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-6)


def test_language_held_out_accuracy(spark):
    rows = language_id.op4_language_id(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = rows.where("lang_pred <> 'und'").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).head()[0]
    assert right > 0.98


def test_every_language_is_learned(spark):
    """Also beyond the total bound of rows: then one row a language."""
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i}") for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(docs.withColumn("doc_id", F.col("doc_id") * 0 + F.lit(1)), sample=2)
    assert len(net.langs) == 260


def test_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 7, 15, 16, 40, 300, 2000) for k in sorted({0, 1, 2, n // 60, n // 40, n // 34}) if k <= n]
    got = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality_rules._tail(F.col("n"), F.col("k"), 0.03)).collect()
    a = Fraction(3, 100)
    for r in got:
        want = 1.0 if r["k"] >= r["n"] * 0.03 else float(sum(math.comb(r["n"], i) * a**i * (1 - a) ** (r["n"] - i) for i in range(r["k"] + 1)))
        assert r["p"] == pytest.approx(want, rel=1e-9)
    big = spark.createDataFrame([(10**9, 29_900_000), (10**9, 29_990_000)], "n long, k long").select(quality_rules._tail(F.col("n"), F.col("k"), 0.03).alias("p")).collect()
    # Far below, and 1.85 deviations below, the mean.
    assert big[0]["p"] < 1e-70 and big[1]["p"] == pytest.approx(0.0319, abs=2e-3)


def test_repeated_documents_are_one_draw(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(i, f"{text} {i}", "en") for i in range(300)] + [(400 + i, f"{text} {i}".replace(" ", "## "), "en") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _, _ in rows], "doc_id long, quality int")
    one = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    held = spark.createDataFrame(rows + rows[5:6] * 500, "doc_id long, text string, lang string").withColumn("stats", quality_rules.stats_of(F.col("text")))
    cutoffs = quality_rules.calibrate(held, labels)
    assert {r["good"] for r in cutoffs.collect()} == {300}
    assert {r["doc_id"] for r in one.where("not kept").collect()} == {400 + i for i in range(40)}


def test_own_columns_stay(spark):
    """Columns with the names of all outputs keep their values; the outputs get free names."""
    names = [*quality_rules._STATS, "base_failed", "kept", "stats", "Kept_", "lang_pred", "score", "lang_shares", "expected_grade", "tail"]
    rows = [(i, "one two three four five six seven eight nine ten eleven", "en", *(["mine"] * len(names))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out, new in ((quality_rules.quality_rules(docs, labels), "kept__"), (language_id.identify(docs, None), "lang_pred_"), (quality_classifier.classify(docs, None), "tail_")):
        got = out.collect()
        assert len(got) == 3 and all(r[n] == "mine" for r in got for n in names) and new in out.columns


def test_stems_tell_words_never_seen():
    """A stem marks grade 1; held-out rows carry it only in words that no fitted row has, among random words."""
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]

    def text(grade, end):
        words = list(rng.choice(noise, 60))
        return " ".join(words + ["zzyxqu" + end] * int(grade == 1) + ["word##"] * (20 * int(grade == 0)))

    grades = np.array([i % 3 for i in range(600)])
    model = quality_classifier.fit_ordinal([quality_classifier.features(text(g, "abc"[i % 2])) for i, g in enumerate(grades)], grades, 2)
    held = model.tails(model.score([quality_classifier.features(text(g, "stu")) for g in grades]))
    kept = held[:, 1] >= 0.5
    assert not kept[grades == 0].any() and not kept[grades == 1].any() and kept[grades == 2].mean() > 0.98
    assert 0 < np.count_nonzero(model.w) < 60
    assert (held[grades == 0, 0] < 0.5).all() and (held[grades == 1, 0] > 0.5).all()


def test_features_of_long_and_empty_texts():
    f = quality_classifier.features
    assert f(None) == f("") == f(" \n ") and len(f("")) >= 4
    assert set(f("Idiot!")) > set(quality_classifier._of("idiot"))
    assert len(f("idiotic word " * 200_000)) < 20


def test_labels_without_documents(spark):
    """Grades whose documents are missing, or of string keys: nothing to learn from, or learned as any other."""
    docs = spark.createDataFrame([(str(i), "fine words" if i % 2 else "bad## words##") for i in range(80)], "doc_id string, text string")
    graded = lambda names: spark.createDataFrame([(n, 2 * (i % 2)) for i, n in enumerate(names)], "doc_id string, grade int")
    assert quality_classifier.fit(docs, graded([f"x{i}" for i in range(80)])) is None
    model = quality_classifier.fit(docs, graded([str(i) for i in range(80)]))
    assert {(r["doc_id"], r["kept"]) for r in quality_classifier.classify(docs, model).collect()} == {(str(i), bool(i % 2)) for i in range(80)}
