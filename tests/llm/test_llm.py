import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import html_extraction, language_id, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_pieces, topk_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
LINE = "one two three four five six seven eight nine ten"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), "mine", "mine") for i, t, lang in rows], DOCS)


ODD = [(9001, None, "en"), (9002, "", None), (None, "alpha beta", "en"), (9004, "x " * 30_000, "en"), (9005, "alpha beta", "de"), (9005, "alpha beta", "de"), (9007, " \n\t ", None)]


def test_quality_rules(spark):
    rows = [(i, LINE + f" w{i}" * 1, "en") for i in range(400)] + [(1000 + i, " ".join(f"{w}### " for w in (LINE + f" z{i}").split()), "en") for i in range(50)] + ODD
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i in [*range(400), *range(1000, 1050)]] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs(spark, rows), labels).collect()
    # The rows bring a column ``kept`` of their own, which stays.
    kept = {r["doc_id"]: r["kept_"] for r in out}
    assert {r["kept"] for r in out} == {"mine"}
    assert len(out) == len(rows) and all(kept[i] for i in range(400)) and not any(kept[i] for i in range(1000, 1050))
    assert not any(kept[i] for i in (9001, 9002, 9004, 9005, 9007))
    by = {r["doc_id"]: r for r in out}
    assert by[9004]["n_repeat_words"] == 30_000 and by[9001]["n_words"] == 0
    none = quality_rules.quality_rules(docs(spark, rows[:3]), labels.where("false")).collect()
    assert [r["kept_"] for r in none] == [True] * 3
    assert quality_rules.quality_rules(docs(spark, []), labels.where("false")).count() == 0


def test_repeat_words_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 60, 80)]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", quality_rules.stats_of(F.col("text")).alias("x")).select("doc_id", "x.*").collect()
    for r in got:
        w = texts[r["doc_id"]].split()
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert r["n_repeat_words"] == len({j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_packing(spark):
    path = packing.word_bpe()
    rows = [*ODD, *((100 + i, "word " * (i * 37 % 900), "en") for i in range(60))]
    out = packing.pack(docs(spark, rows), path, tokens=512, ids=True).collect()
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"] <= 512 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(seqs) <= -(-sum(r["length"] for r in out) // 512) + 1
    assert sum(r["doc_id"] == 9005 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 1
    assert packing.pack(docs(spark, []), path).count() == 0


def test_packing_keeps_every_capacity():
    counts = {900: 5, 500: 7, 300: 9, 10: 40}
    for rule in ("norm", "dot"):
        steps, n = packing.plan(counts, 1000, documents=6, cost=850_000, rule=rule)
        load = collections.defaultdict(list)
        for length, count in counts.items():
            mine = [s for s in steps if s[0] == length]
            for rank in range(count):
                s = [s for s in mine if s[1] <= rank][-1]
                load[s[2] + (rank - s[1]) // s[3]].append(length)
        assert len(load) == n and all(sum(x) <= 1000 and len(x) <= 6 and sum(v * v for v in x) <= 850_000 for x in load.values())


def test_word_encoder_equals_tokenizer():
    enc = packing.WordEncoder(packing.word_bpe(), limit=50)
    for x in ["", "a<|endoftext|>b", "Don't  STOP,now... É é x　y ab,. it's 12,3. ΑΣ. İx ﬁ", "a\x00b\x1cc", "´ñ¡ é"]:
        assert enc.encode([x])[0].tolist() == enc.tokenizer.encode(x, add_special_tokens=False).ids


def test_language_id(spark):
    rng = np.random.default_rng(1)
    vocab = {"en": "the and thing with ation".split(), "de": "der und sch keit ung".split()}
    rows = [(i, " ".join(rng.choice(vocab[k], 60)), k) for i in range(160) for k in [("en", "de")[i % 2]]]
    net = language_id.fit(docs(spark, rows + ODD[:3]))
    out = language_id.identify(docs(spark, rows + ODD + [(900, "12 !!", "en")]), net).collect()
    assert len(out) == len(rows) + len(ODD) + 1 and all(0 <= r["score_"] <= 1 and r["score"] == "mine" for r in out)
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert np.mean([by[i] == k for i, _, k in rows]) > 0.95 and {by[i] for i in (9001, 9002, 9007, 900)} == {"und"}
    assert language_id.fit(docs(spark, [])) is None
    assert language_id.identify(docs(spark, ODD), None).select("lang_pred").distinct().count() == 1


def test_training_and_padding():
    x = np.random.default_rng(0).integers(97, 123, (64, 3)).astype(np.uint8)
    net = language_id.train([b"abcabc" * 20, b"xyzxyz" * 20], np.array([0, 1]), ["a", "x"], steps=200)
    p = net.documents([b"abcabc" * 30, b"xyzxyz" * 30, b""])[0]
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9 and not p[2].any() and net.probabilities(x).shape == (2, 192)


def test_line_dedup(spark):
    rng = np.random.default_rng(2)
    line = lambda: " ".join(rng.choice(LINE.split(), 12)) + f" {rng.integers(10**9)}"
    shared = [line() for _ in range(12)]
    rows = [(i, "\n".join([line() for _ in range(6)] + shared + [line() for _ in range(6)]), "en") for i in range(20)]
    out = line_dedup.dedup_lines(docs(spark, rows + ODD), rule="rolling", spans=True).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) + len(ODD) and by[0]["text"] == rows[0][1]
    assert all(by[i]["n_removed"] >= 1 and by[i]["n_chars"] == len(by[i]["text"]) for i in range(1, 20))
    assert all(x in by[0]["text"] for x in shared)
    same = {r["text"] for r in out if r["doc_id"] == 9005 and r["lang"] == "de"}
    assert same == {"alpha beta"} and line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_spares_unequal_chunks(spark, monkeypatch):
    """Where different chunks have the same hashes, nothing of that hash is removed; other shared chunks are."""
    line = lambda i, j: " ".join(f"w{i}x{j}x{k}" for k in range(8))
    own = [(i, "\n".join(line(i, j) for j in range(4)), "en") for i in range(5)]
    shared = [(i, "\n".join("x" + line(0, j) for j in range(4)), "en") for i in range(10, 12)]
    first = lambda c: F.ascii(F.substring(c, 1, 1)).cast("long")
    monkeypatch.setattr(line_dedup, "_hashes", lambda c: (first(c).alias("a"), F.when(c.startswith("x"), F.xxhash64(c)).otherwise(1).alias("b")))
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, own + shared), rule="rolling").collect()}
    rest = texts.pop(11)
    # The lone last line is a chunk of its own, too short to be removed.
    assert texts == {i: t for i, t, _ in own + shared[:1]} and shared[1][1].endswith(rest) and len(rest) < len(shared[1][1])


def test_line_runs_remove_short_passages(spark):
    """Passages of 2 to 5 lines between unlike lines, one with short lines and blank lines, go from all texts but the first."""
    rng = np.random.default_rng(5)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**9, 9))
    passages = [[line() for _ in range(n)] for n in (2, 3, 4, 5)] + [["a b", "", *(f"short{i} line" for i in range(5)), " ", "end"]]
    own = {(p, i): ([line() for _ in range(3)], [line() for _ in range(3)]) for p in range(len(passages)) for i in range(4)}
    rows = [(p * 10 + i, "\n".join([*own[p, i][0], *lines, *own[p, i][1]]), "en") for p, lines in enumerate(passages) for i in range(4)]
    twice = [line() for _ in range(2)]
    rows += [(80, "\n".join(twice * 3), "en"), (81, "one two\nthree four", "en"), (82, "one two\nthree four", "en")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    for p, lines in enumerate(passages):
        assert out[p * 10] == rows[p * 4][1]
        for i in range(1, 4):
            assert out[p * 10 + i] == "\n".join([*own[p, i][0], *own[p, i][1]]), (p, i)
    assert out[80] == "\n".join(twice) and out[81] == out[82] == "one two\nthree four"
    odd = line_dedup.dedup_lines(docs(spark, ODD)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in odd) == sorted((str(i), str(t)) for i, t, _ in ODD)


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{i}" for i in range(400)], 120)) for _ in range(60)]
    texts = base + [b.replace(b.split()[5], "zz", 1) for b in base[:40]] + base[:10]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(2000, None, None), (2001, "", None), (None, "  ", None), (2002, base[0], None)]
    out = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [(i, simhash.fingerprint(t)) for i, t, _ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(fps):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    want = sorted((-1 if i is None else i, least[find(a)]) for a, (i, _) in enumerate(fps))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in out) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_vantage_point_shards_lose_no_pair():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = fp[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    every = np.unique(np.concatenate([fp, near]))
    trees = simhash.grow(every, len(every), leaf=100)
    homes, seen = collections.defaultdict(list), collections.defaultdict(list)
    for shard, at, home in simhash.route(every, trees, 1):
        (homes if home else seen)[shard].append(at)
    found = set()
    for shard, parts in homes.items():
        h = np.concatenate(parts)
        x = np.concatenate([h, *seen[shard]])
        a, b = np.nonzero(np.bitwise_count(every[h][:, None] ^ every[x][None, :]) <= 4)
        found |= {tuple(sorted((int(h[i]), int(x[j])))) for i, j in zip(a, b, strict=True) if h[i] != x[j]}
    want = {(i, j) for i in range(len(every)) for j in (np.nonzero(np.bitwise_count(every[i] ^ every[i + 1 :]) <= 4)[0] + i + 1).tolist()}
    assert found == want and len(homes) > 30


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (400, 6)) / 2
    v[50:150] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(None, [1.0] * 6), (950, None), (1000, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1050, [float("nan")] * 6), (1100, [1.0] * 5), (100, [float(x) for x in v[100]])]
    got = topk_search.top_k(spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, embedding array<double>, score string"), pivots=4, rings=3).collect()
    w = np.floor(256 * v).astype(np.int64)
    for q in range(0, 400, 50):
        want = sorted((-int(w[q] @ w[i]), i) for i in range(400) if i != q)[:5]
        assert sorted((r["rank"], -r["score"], r["id"]) for r in got if r["query_id"] == q) == [(k + 1, *x) for k, x in enumerate(want)]
    assert {r["query_id"] for r in got} == set(range(0, 400, 50))
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_html(spark):
    page = lambda t: f"<html><head><title>x</title></head><body><nav><a href='/'>Home</a></nav><div class='box'><h1>{t}</h1><p>Some <b>te</b>xt &amp; {t}</p><p>more {t}</p></div><aside>side</aside><div id='comments'><p>{t} very nice and quite long comment</p></div><script>var a='</p>'</script><footer>f</footer></body></html>"
    rows = [(i, f"http://h{i % 2}.example/x", page(f"n{i}")) for i in range(8)] + [(20, None, None), (21, "bad", ""), (22, "http://h0.example/", "plain"), (23, "http://h0.example", page("n0")), (23, "http://h0.example", page("n0"))]
    out = html_extraction.extract(spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r["main_text"] for r in out}
    assert len(out) == len(rows) and all(by[i] == f"n{i} Some text & n{i} more n{i}" for i in range(8)) and (by[20], by[21], by[22]) == ("", "", "plain")
    wrapper = html_extraction.infer(["<ul><li>a</li></ul><p>x</p>", "<ul><li>b</li><li>c</li></ul><p>y</p>"])
    assert ("(+", [("<li", ""), ("*", ""), (">li", "")]) in wrapper and wrapper[-2] == ("*", "")


def _html_pages(body, hosts=1, n=8):
    return [(i, f"http://h{i % hosts}.example/{i}", f"<html><body><nav><a>Home</a></nav>{body(i)}<footer>f</footer></body></html>") for i in range(n)]


def _extracted(spark, rows):
    return {r["page_id"]: r["main_text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_keeps_all_parts_without_article(spark):
    """Heading and paragraphs stay beside a list, table, quotation, code or a second container that holds most of the text."""
    long = lambda i: f"long words of page {i} " * 12
    parts = {
        "list": lambda i: f"<ul><li>{long(i)}</li><li>b{i}</li></ul>", "table": lambda i: f"<table><tbody><tr><td>{long(i)}</td><td>c{i}</td></tr></tbody></table>",
        "quote": lambda i: f"<blockquote><p>{long(i)}</p></blockquote>", "code": lambda i: f"<pre>{long(i)}</pre>", "section": lambda i: f"<section><div class='in'><p>{long(i)}</p></div></section>",
    }
    for name, part in parts.items():
        for n in (1, 8):
            got = _extracted(spark, _html_pages(lambda i, part=part: f"<div class='content'><h1>Title {i}</h1><p>First {i}</p>{part(i)}<p>Last {i}</p></div>", n=n))
            assert all(t.startswith(f"Title {i} First {i} long") and t.endswith(f"Last {i}") for i, t in got.items()), (name, n)
    got = _extracted(spark, _html_pages(lambda i: f"<div class='one'><p>{long(i)}</p></div><div class='two'><p>second {i}</p></div>"))
    assert all(t.startswith("long") and t.endswith(f"second {i}") for i, t in got.items())
    got = _extracted(spark, _html_pages(lambda i: f"<article class='a'><p>{long(i)}</p></article><div><p>x {i}</p></div><article class='b'><p>second {i}</p></article>"))
    assert all(t.startswith("long") and t.endswith(f"second {i}") and f"x {i}" not in t for i, t in got.items())


def test_html_matches_pages_against_the_wrapper(spark):
    """Constant blocks in the region go, real blocks with a listed word in the class stay; a page of another shape keeps its data."""
    body = lambda i: (
        f"<div class='content'><h1>Title {i}</h1><p>Text of {i}</p><div class='box'><p>Follow <b>us</b> now</p></div><div class='side-by-side'><p>left {i}</p></div>"
        f"<div class='notice'><p>take note {i}</p></div><div class='related-posts'><p>other {i}</p></div><p>The price is {i}</p>" + "".join(f"<p>more {i} {k}</p>" for k in range(i % 3)) + "</div>"
    )
    rows = _html_pages(body, n=20)
    other = "<html><body><nav><a>Home</a></nav><div class='else'><p>Something of its own</p><ul><li>and a list</li></ul></div><footer>f</footer></body></html>"
    got = _extracted(spark, [*rows, (50, "http://h0.example/o", other)])
    for i in range(20):
        more = "".join(f" more {i} {k}" for k in range(i % 3))
        assert got[i] == f"Title {i} Text of {i} left {i} take note {i} The price is {i}{more}"
    assert got[50] == "Something of its own and a list"
    two = _extracted(spark, _html_pages(lambda i: f"<div class='content'><p>shared by chance</p><p>Text of {i}</p></div>", n=2))
    assert two == {i: f"shared by chance Text of {i}" for i in range(2)}
    wrapper = html_extraction.program(html_extraction.infer([f"<p>a</p><ul>{'<li>x</li>' * n}</ul>" for n in (1, 2, 3)]))
    flat = lambda page: html_extraction.tokens(page)
    assert html_extraction.match(wrapper, flat("<p>a</p><ul>" + "<li>y</li>" * 9 + "</ul>")) == {1} and html_extraction.match(wrapper, flat("<p>a</p><ol></ol>")) is None


def test_html_samples_distinct_pages(spark):
    """Copies of a page take one place in the sample of their host."""
    page = lambda i: f"<div class='content'><p>Text of {i}</p><div class='box'>Follow us</div></div>"
    rows = _html_pages(page, n=8)
    low = spark.createDataFrame(rows, "page_id long, url string, html string").orderBy(F.xxhash64("html")).first()
    got = _extracted(spark, rows + [(100 + i, low["url"], low["html"]) for i in range(20)])
    assert {got[i] for i in range(8)} == {f"Text of {i}" for i in range(8)}


def test_licenses(spark):
    mit = license_scan.TEMPLATES["mit"].split()
    edited = mit.copy()
    edited[20] = "changed"
    rows = [(10, "intro " * 50 + " ".join(mit) + " tail" * 20, None), (11, "x " * 33 + " ".join(edited), None), (12, "Some\nReleased under the MIT License.\nend", None), (13, "released under the old license of mit", None), *ODD]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[10, "mit"] == 1 and 0.8 <= got[11, "mit"] < 1 and got[12, "mit-line"] == 1 and len(got) == 3
    assert license_scan.scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.kinds({"none": " -- "})


def test_quality_classifier(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(50)]
    make = lambda g: " ".join([*rng.choice(words, 40), *(["awful", "scum"] if g == 1 else []), *(["a### b$$$"] * 8 if g == 0 else [])])
    rows = [(i, make(i % 3), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(300)] + [(None, 1, 0), (301, None, 1)], "doc_id long, quality int, toxic int")
    data = docs(spark, rows + ODD)
    model = quality_classifier.fit(docs(spark, rows), quality_classifier.grades_of(labels))
    assert model.b[0] < model.b[1]
    out = quality_classifier.classify(data, model).collect()
    good = [r["kept_"] == (r["doc_id"] % 3 == 2) and r["kept"] == "mine" for r in out[:300]]
    assert len(out) == len(rows) + len(ODD) and np.mean(good) > 0.95 and all(0 <= r["expected_grade"] <= 2 for r in out)
    assert quality_classifier.fit(data, quality_classifier.grades_of(labels.where("false"))) is None
    again = quality_classifier.fit(docs(spark, rows + rows[:1] * 50), quality_classifier.grades_of(labels))
    assert np.array_equal(again.w, model.w)


def test_suffix_pieces_equal_library(spark):
    import sentencepiece

    path = suffix_pieces.piece_bpe()
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), suffix_pieces.SuffixCoder(path, limit=20)
    for x in ["", "a", " a  b ", "x\ty\nz", "ééé ñ 漢字🙂 \x01", "a▁b", "ab" * 60, "the" * 60, "\n\n  \n", "a\x00b", "hello world. " * 30]:
        ids = coder.encode([x])[0]
        assert ids.tolist() == sp.encode(x) and coder.decode(np.asarray(ids)) == sp.decode(sp.encode(x))
    out = suffix_pieces.digests(docs(spark, ODD), path).collect()
    assert len(out) == len(ODD) and all(r["round_trip"] for r in out)
    assert suffix_pieces.decode(suffix_pieces.encode(docs(spark, ODD[2:3]), path), path).head()["decoded"] == "alpha beta"


def test_near_keeps_one_document_without_id(spark, tmp_path):
    """Texts without a doc_id whose fingerprints differ in 1 to 4 bits are one group."""
    import corpus_pipeline as p

    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    goal = simhash.fingerprint(" ".join(words))
    other = next(t for t in (" ".join([*words, f"z{i}"]) for i in range(10_000)) if 1 <= (simhash.fingerprint(t) ^ goal).bit_count() <= 4)
    far = " ".join(f"v{x}" for x in rng.integers(0, 10**6, 400))
    out = p.near(spark, docs(spark, [(None, " ".join(words), "en"), (None, other, "en"), (None, far, "en")]), str(tmp_path)).collect()
    assert len(out) == 2 and far in {r["text"] for r in out}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = np.random.default_rng(7)
    rows = [(i, "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 5000, 15)) for _ in range(8)), "en") for i in range(30)]
    rows += [(100, rows[0][1], "en"), (101, rows[0][1].replace("\n", " "), "en"), *ODD]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"] for r in p.run(spark, str(tmp_path)).select(F.col("doc_id")).collect()}
    assert set(range(30)) <= got and 101 not in got and not got & {9001, 9002, 9004, 9005, 9007}
