"""The pipeline against a plain version of its stages, and with columns named like the operators' outputs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from siltstone.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OWN = ["n_words", "kept", "base_failed", "lang_pred", "lang_shares", "score", "fp", "root", "component_id", "stats", "n_lines"]


def _corpus(rng):
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 14))
    shared = [line() for _ in range(3)]
    texts = {i: "\n".join([line() for _ in range(5)] + (shared if 10 <= i < 14 else []) + [line()]) for i in range(30)}
    copies = {100: texts[0], 101: texts[1].replace("\n", " "), 102: texts[2].upper()}
    bad = {200: "too short", 201: None, 202: "again " * 50, 203: "12 345 6 78 9 10 11 12 13 14 15 16 17"}
    return texts, shared, copies, bad


def test_stages_equal_plain_version(spark, tmp_path):
    texts, shared, copies, bad = _corpus(np.random.default_rng(7))
    rows = [(i, t, "en", None, None if t is None else len(t), *(["mine"] * len(OWN))) for i, t in {**texts, **copies, **bad}.items()]
    spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` string" for n in OWN)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = p.cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns and all(r[n] == "mine" for r in docs.collect() for n in OWN)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {**texts, **copies}
    assert seen["quality_rules"] == good | {203: bad[203]} and seen["language_id"] == good
    # Shared lines stay where they stand first; the exact copy keeps nothing.
    expected = {i: "\n".join(x for x in t.split("\n") if x not in shared or i == 10) for i, t in good.items()} | {100: ""}
    assert seen["line_dedup"] == expected
    prints = {i: simhash.fingerprint(t) for i, t in expected.items()}
    left = {}
    for i in sorted(prints):
        if not any((prints[i] ^ prints[j]).bit_count() <= 4 for j in left):
            left[i] = expected[i]
    assert seen["simhash_near_dedup"] == left and 102 not in left
    packed = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_near_breaks_ties_by_the_whole_row(spark):
    rows = [(1, "one two three four five six", s) for s in "cab"] * 2 + [(None, "one two three four five six", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {tuple(p.near(spark, docs.orderBy(F.rand(seed)), "").collect()[0]) for seed in range(3)}
    assert len(got) == 1 and next(iter(got))[0] == 1
