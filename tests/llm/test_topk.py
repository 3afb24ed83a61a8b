import math

import numpy as np
import pytest

from siltstone.llm import topk_search

SCHEMA = "vec_id long, embedding array<double>, score string, rank int, query string"


def brute(rows, k=5, every=50):
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows]
    out = []
    for i, v in sorted({r for r in whole if r[0] % every == 0}):
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in whole if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def _cases():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    vectors = rng.integers(-3, 4, (300, 6)) / 2
    vectors[50:120] = vectors[50]
    mixed = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return {
        "seven rows, no second visit": ([(i, [float(i % 3), 1.0]) for i in range(7)], {}),
        "one row": ([(0, [1.0, 2.0])], {}),
        "nearly equal vectors": ([(i, (centre + rng.normal(size=16) * 0.01).tolist()) for i in range(300)], {}),
        "repeated rows, one id with two vectors": (mixed + mixed[:60] + [(100, [9.0] * 6)] + mixed[3:4] * 9, {"pivots": 4, "rings": 3, "least_rows": 10}),
        "scores beyond 64 bits": ([(i, (rng.normal(size=4) * 1e18).tolist()) for i in range(60)], {}),
        "far clusters": ([(i, (np.eye(4)[i % 4] * 100 + rng.normal(size=4)).tolist()) for i in range(400)], {"pivots": 8, "rings": 4, "least_rows": 5}),
    }


@pytest.mark.parametrize("name", list(_cases()))
def test_equals_brute_force(spark, name):
    rows, index = _cases()[name]
    got = topk_search.top_k(spark.createDataFrame([(*r, "mine", 7, "mine") for r in rows], SCHEMA), **index).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == brute(rows)
