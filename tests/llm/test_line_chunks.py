import duckdb
import numpy as np
import pytest

from siltstone.llm import line_dedup


def _random_docs(seed):
    """Texts from few lines, so that passages repeat within and across them at all offsets."""
    rng = np.random.default_rng(seed)
    lines = ["", " ", *(" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in (1, 2, 3, 5, 6, 9, 12, 55))]
    return [(i, "\n".join(rng.choice(lines, int(n)))) for i, n in enumerate(rng.integers(0, 14, 120))] + [(500, None), (501, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sql_and_loses_no_line(spark, seed):
    rows = _random_docs(seed)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), spans=True)
    got = sorted((tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_removed", "removed_chars").collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, text, n_lines, n_removed, removed_chars FROM ({line_dedup.SQL['op5_line_dedup']})").fetchall()
    assert got == sorted(want, key=repr) and sum(r[3] or 0 for r in got) > 100
    worded = lambda texts: {x for t in texts if t for x in t.split("\n") if x.strip()}
    assert worded(t for _, t in rows) == worded(r[1] for r in got)


def test_long_lines_alone_and_short_ones(spark):
    long, short = " ".join(f"l{i}" for i in range(50)), " ".join(f"s{i}" for i in range(49))
    rows = [(i, f"own {i}\n{x}\nmore {i}") for i, x in enumerate([long, long, short, short, "a b c d e", "a b c d e"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {1: "own 1\nmore 1"}


def test_any_key_own_columns_and_repeated_rows(spark):
    passage = "one two three four five six\nseven eight nine ten eleven"
    rows = [(k, f"{k} a\n{passage}", "many", "mine", "mine") for k in ("x", "y", None)] + [("y", f"y a\n{passage}", "many", "mine", "mine")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_chars string, n_lines string, n_removed string")
    out = line_dedup.dedup_lines(docs, spans=True).collect()
    assert len(out) == 4 and {(r["n_chars"], r["n_lines"], r["n_removed"]) for r in out} == {("many", "mine", "mine")}
    assert sorted(r["n_removed_"] for r in out) == [0, 2, 2, 2] or sorted(r["n_removed_"] for r in out) == [0, 0, 2, 2]
    assert len({r["text"] for r in out if r["doc_id"] == "y"}) == 1
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_very_long_text(spark):
    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(4000)]
    rows = [(1, "\n".join(lines)), (2, "head of its own\n" + "\n".join(lines[1000:3000]) + "\ntail")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "head of its own\ntail"}
