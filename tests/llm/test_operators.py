"""The operators against brute force on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import gzip
import hashlib
import io
import itertools
import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import ann, common, components, fingerprints, html_text, language_id, line_dedup, mixing, ngram_jaccard, packing, queries, token_counts, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, k int, t string, score string"


def table(spark, texts, langs=None, sources=None):
    """documents with columns more whose names clash with inner ones."""
    rows = [(i, t, (langs or {}).get(i), (sources or {}).get(i, "s"), None, "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# ---- 1, 2: pages ----

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>A title here</h1><p>First &amp; long enough
 paragraph, with words.<br><p>Second one has a <a href=x>link</a> too, as they do.</p></article><div class="sidebar"><p>Related things that you may like to read as well.</p></div>
<div id="comments"><p>What a great article, thanks a lot for it.</p></div><script>var s="</p>";</script><form><p>Type here please, and send it.</p></form><footer>&copy; us</foot"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A title here\nFirst & long enough paragraph, with words.\nSecond one has a link too, as they do."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>" + "word " * 50_000).count("word") == 50_000


ONE = "One long paragraph, with words in it."


def test_main_text_despite_names():
    assert html_text.main_text(f"<article class='post-content share-page'><p>{ONE}</p></article>") == ONE
    assert html_text.main_text(f"<div class='header-image-post'><p>{ONE}</p><p>Two.</p></div>") == f"{ONE}\nTwo."
    thanks = "<p>What a great article, thanks a lot for it.</p>"
    assert html_text.main_text(f"<article><p>{ONE}</p><div id='discussion'>{thanks}</div><p>Last one, as they say.</p></article><div><h3>3 Comments</h3>{thanks}</div>") == f"{ONE}\nLast one, as they say."
    for name in ("related-posts", "commentBody", "sidebar_content", "header", "ad"):
        assert html_text.main_text(f"<div class='{name}'><p>{ONE}</p></div>") == "", name


def test_the_cut_changes_labels():
    page = f"<div><p>{ONE}</p><p>Yes</p><p>{ONE}</p></div><ul><li><a href=x>Home</a></li><li>A word.</li><li><a href=y>About</a></li></ul>"
    assert html_text.main_text(page) == f"{ONE}\nYes\n{ONE}" and html_text.cut_effect(page)[1] > 0


def test_fitted_costs(spark):
    rng = random.Random(11)
    x = np.array([[1, rng.uniform(1, 7), rng.random(), rng.randrange(2), rng.randrange(2), 1, 0, 0, 0] for _ in range(600)], float)
    y = (x @ np.array([-1, 1, -6, 2, 0, 0, 0, 0, 0]) > 0).astype(float)
    w = html_text.fitted(x, y)
    assert ((x @ np.array(w) > 0) == y).mean() > 0.95 and w[5:] == html_text.PRIOR[5:]
    assert html_text.fitted(x, y * 0) == html_text.PRIOR
    plain = spark.createDataFrame([(None,), ("<p>x</p>",)], "html string")
    assert html_text.fit(plain) == html_text.PRIOR and html_text.fit(plain.where("html = 'q'")) == html_text.PRIOR
    some = spark.createDataFrame([(PAGE,)] * 5, "html string")
    assert html_text.fit(some) == html_text.fit(some.limit(1)) != html_text.PRIOR


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9)
        bs = [html_text.Block("w " * rng.randrange(1, 9) + rng.choice([".", ""]), (0, rng.randrange(3), i + 5), rng.choice([0.0, 0.5, 1.0]), False, rng.random() < 0.2, rng.random() < 0.2, rng.choice(["p", "li", "div"])) for i in range(n)]
        edges = {(i, i + 1): html_text.smoothness(bs[i], bs[i + 1]) for i in range(n - 1)}
        last = {}
        for i, b in enumerate(bs):
            if b.path[-2] in last:
                e = (last[b.path[-2]], i)
                edges[e] = edges.get(e, 0) + html_text.SIBLING_EDGE
            last[b.path[-2]] = i
        energy = lambda y: sum(-html_text.costs(b) * k for b, k in zip(bs, y)) + sum(w for (i, j), w in edges.items() if y[i] != y[j])
        best = min(map(energy, itertools.product((False, True), repeat=n)))
        assert energy(html_text.labels(bs)) == pytest.approx(best)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c"), (2, None, None, "c")], "page_id long, url string, html string, text string")
    rows = html_text.main_texts(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["n_chars"]) for r in rows] == [(1, len(html_text.main_text(PAGE))), (2, 0), (2, 0)]
    assert html_text.main_texts(pages.where("page_id = 9")).count() == 0


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, "http://b/", None)], "page_id long, url string, html string")
    source = warc.responses_of_pages(pages)
    rows = warc.derive(source, keep=("page_id",)).collect()
    assert sorted((r["page_id"], r["warc_type"]) for r in rows) == [(1, "conversion"), (1, "metadata"), (2, "conversion"), (2, "metadata")]
    ids = {r["page_id"]: r["record_id"] for r in source.collect()}
    for r in rows:
        assert r["refers_to"] == ids[r["page_id"]] and r["block_digest"] == warc.digest(bytes(r["block"])) and r["source_status"] == 200
        assert r["content_length"] == len(r["block"]) and r["source_headers"].startswith("Content-Type: text/html; charset=utf-8\r\nContent-Length: ")
    conv = next(r for r in rows if (r["page_id"], r["warc_type"]) == (1, "conversion"))
    assert "Home" in bytes(conv["block"]).decode() and conv["concurrent_to"] == next(r["record_id"] for r in rows if (r["page_id"], r["warc_type"]) == (1, "metadata"))
    assert conv["source_payload_digest"] == warc.digest(PAGE.encode())
    warc.write_warc(warc.derive(source), f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w", ("metadata", "conversion")).collect()
    assert sorted((r["record_id"], bytes(r["block"])) for r in back) == sorted((r["record_id"], bytes(r["block"])) for r in rows)
    assert warc.read_warc(spark, f"file://{tmp_path}/w", ("metadata", "conversion"), through_spark=True).count() == len(rows)
    assert warc.derive(source.where("page_id = 9")).count() == 0
    odd = source.unionAll(source).withColumn("content_type", F.lit(1)).withColumn("refers_to", F.lit("x"))  # repeated rows, names that clash
    assert sorted(r["record_id"] for r in warc.derive(odd).collect()) == sorted(2 * [r["record_id"] for r in rows])


def test_warc_odd_responses():
    zipped = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=latin-1\r\nX-A: 1\r\n 2\r\n\r\n" + gzip.compress("<p>é".encode("latin-1"))
    meta, conv = warc.derivatives_of("<r>", "u", "d", zipped, "sha1:GIVEN")
    assert conv[-1].decode() == "é" and conv[9] == "sha1:GIVEN" and b"source-header: X-A: 1 2" in meta[-1]
    assert [r[0] for r in warc.derivatives_of("<r>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x00", None)] == ["metadata"]
    assert [r[0] for r in warc.derivatives_of("<r>", "u", "d", None, None)] == ["metadata"]
    assert [r[0] for r in warc.derivatives_of("<r>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n\x0b\x02ab", None)] == ["metadata"]
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Type: text/plain\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    assert warc.derivatives_of("<r>", "u", "d", chunked, None)[1][-1] == b"abcde"
    record = warc.record_bytes({"warc_type": "conversion", "record_id": "<x>", "block": b"hi"})
    assert list(warc.parse_records(io.BytesIO(record * 2)))[1]["block"] == b"hi"


# ---- 3 ----


def test_token_counts_equal_the_library(spark):
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    texts = [None, "", " ", "Hello World's", "don'T I'LL", "<|endoftext|> a<|startoftext|>b", "é café ﬁ 12½", "ΑΣ Σ", "a" * 5000, "中文 字符", "🤣🤣", "word " * 3000, "x\u0085y z"]
    got = token_counts.token_counts(table(spark, texts), path).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        want = len(theirs.encode(t or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len((t or "").encode()), want > 2048), t
    c = token_counts.counter(path)
    long = "ab cd " * 300_000
    assert c._windows(long, 1000) == c._plain(long)


def test_frequent_words_are_merged_once(monkeypatch):
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinsé") for _ in range(9))
    texts = [" ".join(["frequent", *(word() for _ in range(30)), "frequent, the 'll it's"]) for _ in range(100)]
    texts += ["a\x1cb \x1d\x1e c\x1f", "a,b it's, x., ., .,' Don't.", "É. é, 1, 2.5 a1.", ",", ".", "x" * 100 + ", " + "x" * 100, "a\u2003b\u0085c"]
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 200)
    c = token_counts.MergeCounter(path)
    merged, word_of = [], c.word
    monkeypatch.setattr(c, "word", lambda w: merged.append(w) or word_of(w))
    for t in texts:
        assert c.count(t) == len(theirs.encode(t, add_special_tokens=False).ids), t
    assert merged.count("frequent") == merged.count("the") == 1


def test_words_with_punctuation_are_met_again_without_it():
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = [chr(i) for i in range(256)] + list("'' \n.,stremvlld") * 8
    texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(2000)]
    c = token_counts.MergeCounter(path)
    for t in [*texts, *(f"{t} –" for t in texts)]:  # the latter aren't Latin-1
        assert c.count(t) == len(theirs.encode(t, add_special_tokens=False).ids), t
    c, asked = token_counts.MergeCounter(path, 1000), []
    count = c.memo.count
    c.memo.count = lambda run: asked.append(run) or count(run)
    assert c.count("fire, fire. «été», fire; 'fire' " * 500) == 500 * c.count("fire, fire. «été», fire; 'fire' ")
    assert len(asked) < 20


# ---- 4 ----


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x[7] = x[3]
    x[8] = x[3]
    rows = [(i, list(map(float, v)), "e") for i, v in enumerate(x)] + [(900, None, "e"), (901, [0.0] * 16, "e"), (902, [float("nan")] * 16, "e"), (903, [None] * 16, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, p string")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0 or vec_id = 3"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = n = 0
    for q, rows in got.items():
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(300), -np.round(s, 12)))[:5].tolist()
        rows.sort()
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert all(abs(sc - s[v]) < 1e-12 for _, v, sc in rows)
        hit += len(set(want) & {v for _, v, _ in rows})
        n += 5
    assert set(got) == {3, *range(0, 300, 10)} and hit / n >= 0.95
    assert [v for _, v, _ in got[3]][:2] == [7, 8]
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few, 5).count() == 6 and ann.nearest(df.where("vec_id = 901"), df.where("vec_id = 901"), 5).count() == 0


def test_search_ends_only_when_nothing_is_left(spark):
    rows = [(i, [float(np.cos(i / 20)), float(np.sin(i / 20))]) for i in range(9)]
    pts, _ = ann.points(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1)
    chain = spark.createDataFrame([(i, i + 1, 0.0) for i in range(8)], "p long, q long, s float")
    found = ann.search(spark.createDataFrame([(0,)], "c long"), ann.stash(pts), chain, expand=4).collect()
    assert {r["q"] for r in found} == set(range(1, 9))  # by rounds of one edge each


def test_edges_of_hubs_are_bounded(spark):
    star = spark.createDataFrame([(i, 0, 1 - i / 100) for i in range(1, 60)], "p long, q long, s float")
    rows = {r["p"]: sorted(r["nbrs"]) for r in ann.adjacency(star, 5).collect()}
    assert rows[0] == [1, 2, 3, 4, 5] and all(rows[i] == [0] for i in range(1, 60))


# ---- 5 ----


def test_language_labels(spark):
    rng = random.Random(3)
    words = {"en": "the and that with from this which thing often".split(), "de": "der und nicht mit von dieses welche schon auch".split()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    texts = [prose("en" if i % 2 else "de", 40) for i in range(60)] + [None, "", "123 !", prose("en", 3000)]
    langs = {i: "en" if i % 2 else "de" for i in range(60)}
    docs = table(spark, texts, langs)
    model = language_id.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert all(got[i][0] == langs[i] and got[i][1] > 0.8 for i in langs) and got[63][0] == "en"
    assert all(got[i] == ("und", 0.0) for i in (60, 61, 62))
    odd = table(spark, ["\u0301\u0300 \u0302", "和" * 200, "the" * 3000, "Сегодня"])
    known = {r["doc_id"]: (r["lang_pred"], r["known"]) for r in language_id.predict(odd, model).collect()}
    assert known[0] == ("und", 0.0) and known[1][1] == 0 and known[3][1] == 0 and known[2][0] == "en"
    assert len(model.label("和" * 200)) == 7  # a long run is several positions
    many = docs.unionAll(docs.where("doc_id = 1").crossJoin(spark.range(500)).select(*docs.columns))  # rows that repeat count once
    assert language_id.train(many).weights.tolist() == model.weights.tolist()
    assert language_id.predict(docs.where("doc_id < 0"), model).count() == 0
    mixed = [p for _, p in model.label(" ".join(words["en"][:6] + words["de"][:6]))]
    assert [model.langs[int(p.argmax())] for p in mixed] == ["en"] * 6 + ["de"] * 6
    assert language_id.train(docs.where("lang is null")) is None and language_id.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_windows_give_whole_marginals():
    m = language_id.Crf(["a", "b"])
    m.weights = np.random.default_rng(0).standard_normal(m.weights.shape).astype(np.float32)
    m.trans = np.array([[1.0, -1.0], [-1.0, 1.0]])
    words = [f"w{i % 97}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(2000)]
    whole = language_id.marginals(m.emissions(words)[:, :-1], m.start, m.trans).sum(axis=0)
    assert np.allclose(m.texts([" ".join(words)])[0][:-1], whole, atol=1e-6)


def test_hashed_features():
    words = ["a", "ab", "abc", "abcd", "bcd", "a" * 32]
    heads, tri, size = language_id.hashed(words)
    assert size.tolist() == list(map(len, words)) and len(tri) == sum(map(len, words))
    cut = np.split(tri, np.cumsum(size)[:-1])
    grams = [[f"^{w}$"[i : i + 3] for i in range(len(w))] for w in words]
    of = {}
    for own, names in zip(cut, grams):
        for h, name in zip(own.tolist(), names):
            assert of.setdefault(name, h) == h
    assert len(set(of.values())) == len(of)
    assert heads[2, 1] == heads[3, 1] and heads[2, 5] == heads[3, 5] and heads[3, 6] == heads[4, 6] and heads[2, 6] != heads[3, 6]  # a, abc, bcd


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    e, start, trans = rng.standard_normal((5, 3)), rng.standard_normal(3), rng.standard_normal((3, 3))
    p = np.zeros((5, 3))
    for y in itertools.product(range(3), repeat=5):
        w = np.exp(start[y[0]] + sum(e[t, y[t]] for t in range(5)) + sum(trans[y[t], y[t + 1]] for t in range(4)))
        for t in range(5):
            p[t, y[t]] += w
    assert np.allclose(language_id.marginals(e, start, trans), p / p.sum(axis=1, keepdims=True))


# ---- 6 ----


def test_packing(spark):
    texts = [None, "", "one", "w " * 700, "w " * 20000, *["w " * n for n in range(1, 400, 7)], "w " * 512, "w " * 512]
    docs = table(spark, texts)
    rows = packing.packed(docs, shard_items=40).collect()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    bins = {}
    for i, n in size.items():
        own = sorted((r["piece"], r["start"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        assert sum(x[2] for x in own) == n and all(s == p * 8192 for p, s, _ in own) and len(own) == max(1, -(-n // 8192))
    for r in rows:
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["n_tokens"] for x in own[:k]) for k in range(len(own))]
        held = sum(r["n_tokens"] for r in own)
        assert {(r["bin_tokens"], r["bin_size"]) for r in own} == {(held, min(c for c in packing.CAPACITIES if c >= held))}
    assert packing.packed(docs.where("doc_id < 0")).count() == 0


def test_packing_and_mixture_count_tokens(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    c = token_counts.counter(P.path("word_bpe_49k.json"))
    texts = [None, "", "Hello World's unbelievably", "xq7" * 9000, "a few words", "a few words"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: c.count(t) for i, t in enumerate(texts)}
    assert want[3] > 8192
    pieces = queries.QUERIES["op6_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {i: sum(r["n_tokens"] for r in pieces if r["doc_id"] == i) for i in want} == want and max(r["n_tokens"] for r in pieces) == 8192
    assert {r["doc_id"]: r["mix_n_tokens"] for r in queries.QUERIES["op8_source_mixing"](spark, str(tmp_path)).collect()} == want


def test_packing_fills_bins():
    lengths = sorted(np.random.default_rng(5).integers(1, 3000, 3000).tolist(), reverse=True)
    _, _, sizes = packing.pack(lengths, packing.CAPACITIES, 16)
    assert sum(lengths) / sum(sizes) > 0.98


# ---- 7, components ----


def test_long_rows_in_pieces():
    rng = random.Random(10)
    texts = [None, "", "x" * 1000, "a b " + "Y" * 500 + " c", " " * 700 + "a b c", "a " * 3 + " " * 500 + "b", "q" * 130 + "\n" + "r" * 70]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choice(["a", "B", "cc", "é" * rng.randrange(1, 9), "x" * 130]) for _ in range(rng.randrange(60))) for _ in range(200)]

    def sets(most):
        out = {i: [] for i in range(len(texts))}
        for a, b, h, row, _ in common.shingle_runs(pa.array(texts), 5, most):
            for i in range(a, b):
                out[i] += h[row == i - a].tolist()
        return {i: sorted(x) for i, x in out.items()}

    whole = sets(common.SLICE_BYTES)
    assert whole == sets(64) and [sorted(set(x)) for x in whole.values()] == [s.tolist() for s in ngram_jaccard.sets_of(pa.array(texts))]
    maker = fingerprints.Fingerprinter()
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    assert len(long) > 2 * common.SLICE_BYTES
    (h,) = list(ngram_jaccard.sets_of(pa.array([long])))
    assert len(h) == 200_000 - 4
    low, _ = maker.bins(pa.array(["a b", long, "c"]))
    least = [h[(h >> np.uint64(56)) == b].min() & np.uint64(15) for b in range(256)]
    assert low[1].tolist() == [int(x) for x in least]


def brute_components(texts):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), label[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("long_run", [3, 10_000])
def test_jaccard_components(spark, monkeypatch, long_run):
    monkeypatch.setattr(ngram_jaccard, "LONG_RUN", long_run)
    rng = random.Random(4)
    prose = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(n)]
    texts = [None, "", " \t", "A b", "a B", "a b c", "one two three four five"]
    base, passage = prose(120), prose(60)
    for _ in range(40):  # near copies, chained, and copies
        w = base[:]
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(["q", "zz"])
        texts.append(" ".join(w))
    texts += [texts[-1], texts[-1].upper()]
    for _ in range(20):  # a passage that many share
        texts.append(" ".join(prose(40) + passage + prose(rng.randrange(0, 60))))
    texts += [" ".join(passage), " ".join(passage + prose(8)), " ".join(passage + prose(20))]
    got = ngram_jaccard.jaccard_components(table(spark, texts), sample_docs=30, sample_least=3).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts)
    assert ngram_jaccard.jaccard_components(table(spark, texts).where("doc_id < 0")).count() == 0


def test_jaccard_of_repeated_ids_and_long_texts(spark):
    rng = random.Random(12)
    long = [str(rng.randrange(10**6)) for _ in range(120_000)]
    other = long[:60_000] + ["x"] * 3 + long[60_000:]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, " ".join(long)), (4, " ".join(other)), (None, "a b c d e f"), (5, None)]
    got = sorted(map(tuple, ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 119_996, 3), (4, 119_999, 3), (None, 2, 1), (5, 0, 5)], key=str)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_the_filter_of_ids_stays_packed_in_workers(spark, monkeypatch):
    wanted = list(range(0, 3000, 3))
    on = ngram_jaccard._id_filter(spark.createDataFrame([(i,) for i in wanted], "k long"))
    assert on.dtype == np.uint8 and len(on) * 8 == ngram_jaccard.FILTER_BITS
    batch = pa.record_batch({"k": pa.array(range(3000), pa.int64()), "t": pa.array(["a b c d e f"] * 3000)})
    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast.side_effect = lambda x: SimpleNamespace(value=x)
    docs.where.return_value.select.return_value.mapInArrow.side_effect = lambda run, _: run(iter([batch]))
    monkeypatch.setattr(ngram_jaccard, "_id_filter", lambda _: on)
    list(ngram_jaccard.sets_of(batch.column(1)))  # tables that stay are made
    tracemalloc.start()
    got = [k for x in ngram_jaccard._full_sets(docs, None) for k in x.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(wanted) <= set(got) and len(got) < len(wanted) + 10
    assert peak < ngram_jaccard.FILTER_BITS // 8


# ---- 8 ----


def test_mixture(spark):
    rng = random.Random(6)
    sources = {i: ("big" if i < 300 else "mid" if i < 360 else "small" if i < 380 else None) for i in range(390)}
    texts = ["w " * rng.randrange(1, 30) if i % 50 else None for i in range(390)]
    docs = table(spark, texts, sources=sources)
    rows = mixing.mixture(docs, max_repeat=3.0, block_docs=16).collect()
    tokens = {s: sum(len((t or "").split()) for i, t in enumerate(texts) if sources[i] == s) for s in set(sources.values())}
    seen = {s: sum(r["mix_n_tokens"] for r in rows if r["source"] == s) for s in tokens}
    assert {r["doc_id"] for r in rows} == set(range(390))
    most = max(seen[s] / tokens[s] for s in tokens)
    assert seen["big"] == tokens["big"] and 2.5 <= most <= 3.0
    weights = {r["source"]: r["mix_weight"] for r in rows}
    for s in tokens:  # realised to within a document
        assert abs(seen[s] - weights[s] / weights["big"] * tokens["big"]) <= 31
    clash = docs.withColumns({c: F.lit(-1) for c in ("weight", "blocks", "full", "rest", "ebk", "edk", "s", "ps", "b")})
    assert sorted((r["doc_id"], r["mix_epoch"], r["weight"]) for r in mixing.mixture(clash, max_repeat=3.0, block_docs=16).collect()) == sorted((r["doc_id"], r["mix_epoch"], -1) for r in rows)
    partial = mixing.mixture(docs, target_entropy=1.0, max_repeat=None, budget_share=0.5).collect()
    got = {s: sum(r["mix_n_tokens"] for r in partial if r["source"] == s) for s in tokens}
    p = np.array([w for w in {r["source"]: r["mix_weight"] for r in partial}.values()])
    assert abs(-(p * np.log(p)).sum() - 1.0) < 1e-3 and abs(sum(got.values()) - sum(tokens.values()) / 2) <= 31 * 4
    assert mixing.mixture(docs.where("doc_id < 0")).count() == 0 and mixing.mixture(docs.where("text is null")).count() == 8


# ---- 9 ----


def brute_lines(texts, least=20):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, before = [], []
    for t in texts:
        keep, exact, close = [], 0, 0
        for line in [] if t is None else t.split("\n"):
            if len(line) >= least and line in before:
                exact += 1
            elif len(line) >= least and any(near(line, x) for x in before):
                close += 1
                before.append(line)
            else:
                keep.append(line)
                if len(line) >= least:
                    before.append(line)
        out.append((None if t is None else "\n".join(keep), exact, close))
    return out


def test_line_dedup(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeé ") for _ in range(n)) for n in (20, 21, 33, 64, 200)]
    lines = list(base)
    for _ in range(120):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            i, kind = rng.randrange(len(x)), rng.randrange(3)
            x[i : i + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdex")]
        lines.append("".join(x))
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 5] + ["short", ""]) for i in range(0, len(lines), 5)] + [None, "", "x" * 5000, "x" * 4999, "aaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaa"]
    docs = table(spark, texts).withColumn("at", F.lit(1)).withColumn("line", F.lit("l"))
    got = [(r["text"], r["n_exact"], r["n_near"]) for r in line_dedup.without_repeated_lines(docs).orderBy("doc_id").collect()]
    assert got == brute_lines(texts)
    clash = docs.withColumns({c: F.lit("c") for c in ("__k", "__gone", "__doc", "__map", "k", "gone", "exact", "near", "n_lines", "n_near", "h1", "halves")})
    assert [(r["text"], r["n_exact"], r["n_near"]) for r in line_dedup.without_repeated_lines(clash).orderBy("doc_id").collect()] == got
    assert line_dedup.without_repeated_lines(docs.where("doc_id < 0")).count() == 0


def test_short_repeated_lines_go(spark):
    docs = table(spark, ["Les.\nA line of its own that stays\n\n  ", "Les.\nLos.\n\n  ", "Les.", None])
    got = [(r["text"], r["n_exact"], r["n_near"]) for r in line_dedup.without_repeated_lines(docs, exact_chars=1).orderBy("doc_id").collect()]
    assert got == [(docs.where("doc_id = 0").first()["text"], 0, 0), ("Los.\n\n  ", 1, 0), ("", 1, 0), (None, 0, 0)]


def test_lines_two_edits_apart(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcde") for _ in range(n)) for n in (20, 23, 30)]
    lines = list(base)
    for _ in range(45):
        x = list(rng.choice(base))
        for _ in range(rng.choice([1, 2, 3, 4])):
            i, kind = rng.randrange(len(x)), rng.randrange(3)
            x[i : i + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdex")]
        lines.append("".join(x))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {(i, lines[i] not in lines[:i]) for i in range(len(lines)) if len(lines[i]) >= 20 and any(len(x) >= 20 and distance(lines[i], x) <= 2 for x in lines[:i])}
    got = {(r["doc_id"], r["near"]) for r in line_dedup.repeated_lines(table(spark, lines), max_edits=2).collect()}
    assert got == want and any(near for _, near in want)


# ---- 10 ----


def test_fingerprints(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "a", "a b c", *[" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randrange(1, 400))) for _ in range(40)]]
    texts += [texts[10], texts[10], "é" * 3000, "long word " * 30_000]
    docs = table(spark, texts)
    rows = fingerprints.edit_report(docs).orderBy("doc_id").collect()
    full = [t or "" for t in texts]
    print_of = dict(map(tuple, fingerprints.fingerprints(docs).collect()))
    for i, r in enumerate(rows):
        t, after = full[i], full[(i + 1) % len(full)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest()) and r["fingerprint"] == print_of[i]
        assert 0 <= r["near_edited"] <= 1 and (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)
    assert rows[10]["fingerprint"] == rows[45]["fingerprint"] == rows[46]["fingerprint"] and rows[45]["near_next"] == 1
    one = fingerprints.edit_report(docs.where("doc_id = 20")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and fingerprints.edit_report(docs.where("doc_id < 0")).count() == 0


def test_likeness_estimates_jaccard():
    rng = random.Random(9)
    maker = fingerprints.Fingerprinter()
    off = []
    for _ in range(60):
        w = [str(rng.randrange(10**6)) for _ in range(300)]
        cut = rng.randrange(300)
        a, b = " ".join(w), " ".join(w[:cut] + [str(rng.randrange(10**6)) for _ in range(300 - cut)])
        sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(296)}
        low, full = maker.bins(pa.array([a, b]))
        off.append(maker.likeness(low[:1], full[:1], low[1:], full[1:])[0] - len(sh(a) & sh(b)) / len(sh(a) | sh(b)))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_crc_is_that_of_the_text(spark):
    rows = spark.range(50).select("id", (F.crc32(F.col("id").cast("string")) % 4).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)
