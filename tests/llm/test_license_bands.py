import time

import numpy as np

from siltstone.llm import license_scan


def test_short_templates_and_marks(spark):
    rows = [(1, "x All rights\nreserved. y"), (2, "all rights"), (3, "SPDX-License-Identifier: MIT"), (4, "MIT"), (5, "all rights reserved"), (6, "reserved " * 9), (None, "All Rights Reserved"), (8, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["license"], r["first_word"], r["containment"]) for r in got) == [("1", "all-rights-reserved", 1, 1.0), ("3", "mit-mark", 0, 1.0), ("5", "all-rights-reserved", 0, 1.0), ("None", "all-rights-reserved", 0, 1.0)]


def test_bands_meet_the_promised_chance():
    for kind in license_scan.kinds():
        least = min(len(license_scan.template_shingles(license_scan.TEMPLATES[n])[1]) for n in kind.names)
        j = 1.0 if kind.shingles == 1 else 0.8 * least / (kind.shingles + 0.2 * least)
        assert (1 - j) ** kind.bands <= license_scan.MISS
        assert all(len(license_scan._template_words(license_scan.TEMPLATES[n])) <= kind.window - kind.step + 1 for n in kind.names)


def _brute(text, templates):
    """{license: (n_matched, first_word)} over the windows of the template's class."""
    words, out = license_scan._template_words(text), {}
    for kind in license_scan.kinds(templates):
        n = max(len(words) - kind.shingle + 1, 0)
        grams = [" ".join(words[i : i + kind.shingle]) for i in range(n)]
        for name in kind.names:
            goal = set(license_scan.template_shingles(templates[name])[1])
            count = -(-max(n - kind.shingles, 0) // kind.step) + 1 if n else 0
            found = max(((len(goal & set(grams[k * kind.step : k * kind.step + kind.shingles])), -k * kind.step) for k in range(count)), default=(0, 0))
            if found[0] >= license_scan.CONTAINMENT * len(goal):
                out[name] = (found[0], -found[1])
    return out


def test_three_hundred_templates_equal_brute_force(spark):
    """Planted passages, some edited, at any place; the plan stays small."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    templates = {f"t{i}": words(int(n)) for i, n in enumerate(rng.integers(5, 90, 300))}
    rows = []
    for i in range(150):
        passage = templates[f"t{int(rng.integers(300))}"].split()
        if i % 3 == 0 and len(passage) > 40:
            passage[int(rng.integers(len(passage)))] = "changed"
        rows.append((i, f"{words(int(rng.integers(0, 200)))} {' '.join(passage)} {words(int(rng.integers(0, 120)))}"))
    began = time.time()
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert time.time() - began < 90
    found = {(r["doc_id"], r["license"]): (r["n_matched"], r["first_word"]) for r in got}
    assert found == {(i, k): v for i, t in rows for k, v in _brute(t, templates).items()} and len(found) >= 140
