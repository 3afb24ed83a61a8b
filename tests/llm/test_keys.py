"""Keys pass through the packing and the near-duplicates as they are, whatever their type."""

import collections

import numpy as np
import pytest

from siltstone.llm import packing, simhash

BIG = 2**60 + 1


@pytest.mark.parametrize("kind, keys", [("long", [BIG, None, BIG + 2, 7]), ("string", ["a", None, "b/1", "7"]), ("decimal(38,0)", [10**30 + 1, None, 3, 4])])
def test_keys_stay_as_they_are(spark, kind, keys):
    texts = ["one two three four five six", None, "one two three four five six", "x"]
    if kind.startswith("decimal"):
        rows = spark.createDataFrame([(None if k is None else str(k), t) for k, t in zip(keys, texts, strict=True)], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    else:
        rows = spark.createDataFrame(list(zip(keys, texts, strict=True)), f"doc_id {kind}, text string")
    rows = rows.coalesce(1)
    assert collections.Counter(r["doc_id"] for r in packing.pack(rows, packing.word_bpe()).collect()) == collections.Counter(keys)
    found = simhash.near_duplicates(rows).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(keys)
    by = {r["doc_id"]: r["component_id"] for r in found}
    assert by[keys[0]] == by[keys[2]] == min(keys[0], keys[2]) and by[keys[3]] == keys[3]


def one_by_one(counts, tokens, documents, cost, weights, rule):
    """Best fit of single pieces, longest first: the fitting sequence with the least score, then the one opened first."""
    room = np.array([tokens, documents, cost], float)
    left = []
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        for _ in range(counts[length]):
            score = [(((r - need) / room) ** 2 @ weights if rule == "norm" else (r * need / room**2) @ weights, i) for i, r in enumerate(left) if (r >= need).all()]
            if not score:
                left.append(room.copy())
                score = [(0.0, len(left) - 1)]
            left[min(score)[1]] -= need
    return sorted(tuple((room - r).astype(int).tolist()) for r in left)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_equals_one_by_one(rule):
    rng = np.random.default_rng(9)
    for documents, cost in ((60, 3600), (4, 3600), (5, 1500)):
        for _ in range(6):
            counts = {int(n): int(c) for n, c in zip(rng.integers(1, 36, 9), rng.integers(1, 14, 9), strict=True)}
            steps, opened = packing.plan(counts, 60, documents, cost, rule=rule)
            load = collections.defaultdict(lambda: np.zeros(3, int))
            for length, count in counts.items():
                mine = [s for s in steps if s[0] == length]
                for rank in range(count):
                    s = [s for s in mine if s[1] <= rank][-1]
                    load[int(s[2] + (rank - s[1]) // s[3])] += [length, 1, length * length]
            assert len(load) == opened
            assert sorted(tuple(v.tolist()) for v in load.values()) == one_by_one(counts, 60, documents, cost, np.array(packing.WEIGHTS), rule)
