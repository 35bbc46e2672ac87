"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rationale.llm import ann, html, jaccard, mixing, packing, quality, registry, scoring, substring, suffix, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, s int, r_text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list:
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgé"), rng.integers(1, 7))) for _ in range(300)]
    new = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = new(160), new(70)
    out = [None, "", "   \n\t", "one", "a b c", "A b C", "x " * 300, base, base, base.upper(), new(30) + "\n" + passage + " " + new(20), passage + "\t" + new(50), new(6000) + " " + passage, "ab" * 400, new(36)]
    for k in range(90):  # near copies: enough for wide columns
        words = base.split()
        for i in rng.integers(0, len(words), k % 4):
            words[i] = f"new{k}x{i}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 211, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), i, "clash") for i, t in enumerate(texts())]
    rows.append(rows[8])  # a row that stands twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_substring_dedup(spark, docs):
    rows = [(i, WORD.findall(t)) for i, t in local(docs)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    wanted = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        wanted.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    out = substring.substring_dedup(docs, carry=("s", "r_text"), with_text=True).cache()
    assert all(WORD.findall(r.cut_text) == r.kept_text.split() for r in out.collect())
    assert sorted(wanted) == sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect())
    assert out.where("r_text <> 'clash'").isEmpty()
    assert substring.substring_dedup(empty(spark)).isEmpty()


def test_substring_heavy_grams(spark, docs, monkeypatch):
    """The order of minimisers doesn't change what is found."""
    before = sorted(map(tuple, substring.substring_dedup(docs).collect()))
    monkeypatch.setattr(substring, "_survey", lambda d: (10_000_000, np.sort(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64))))
    assert before == sorted(map(tuple, substring.substring_dedup(docs).collect()))


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(230, 8)).astype(np.float32)
    v[7] = v[3]
    rows = [(i, [float(x) for x in a], i) for i, a in enumerate(v)] + [(900, None, 0), (950, [1.0, None] + [0.0] * 6, 0), (1000, [float("nan")] * 8, 0), (1050, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    x = {i: np.floor(256 * np.array(a, float)).astype(int) for i, a, _ in rows if a is not None and None not in a and np.isfinite(a).all()}
    wanted = []
    for q in (i for i in x if i % 50 == 0):
        best = sorted(((-int(x[q] @ x[j]), j) for j in x if j != q))[:5]
        wanted += [(q, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    for block in (4096, 50):
        assert sorted(wanted) == sorted(map(tuple, topk.top_inner_products(df, block=block).collect()))
    assert topk.top_inner_products(df.where("vec_id < 0")).isEmpty()
    assert topk.top_inner_products(df.where("vec_id in (50, 51)")).collect()[0].vec_id == 51


def test_topk_edges(spark):
    """Huge components, empty vectors, other lengths, repeated rows and columns with clashing names."""
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, -1.0]), (2, [2.0**41, 0.0]), (3, [-1e300, 0.0]), (4, []), (5, [1.0, 2.0, 3.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (50, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("dim", F.lit("x"))
    got = [tuple(r) for r in topk.top_inner_products(df).orderBy("query_id", "rank").collect()]
    one = 2**40 * 256
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 6, one * 128 + 256 * 128), (0, 4, 6, one * 128 + 256 * 128), (0, 5, 3, -(2**63)), (50, 1, 5, 256 * 256 * 6)]


@pytest.mark.parametrize("n", [1, 4, 60, 700])
def test_topk_bounds(n):
    """Reading in part never loses one of the best, however many ties there are."""
    rng = np.random.default_rng(n)
    for d, top in ((1, 3), (3, 2), (12, 40)):
        x, q = rng.integers(-top, top + 1, (n, d)), rng.integers(-top, top + 1, (9, d)).astype(float)
        found = topk.qualified(topk.Lists(x), np.arange(n), q, np.arange(9) * 3, 5)
        for i, left in enumerate(found):
            s = x @ q[i]
            best = sorted((-s[j], j) for j in range(n) if j != 3 * i)[:5]
            assert {j for _, j in best} <= set(left.tolist()) and 3 * i not in left


def test_repeated_bytes(spark, docs, monkeypatch):
    rows = sorted(set(local(docs)))
    wanted, seen = {}, set()
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        wanted[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in suffix.repeated_bytes(docs).collect()} == wanted
    assert suffix.repeated_bytes(docs).count() == docs.count()
    monkeypatch.setattr(suffix, "_repeated_anchors", lambda hot, groups, f=suffix._repeated_anchors: f(3, 5))  # many hot anchors
    assert {r.doc_id: tuple(r)[1:] for r in suffix.repeated_bytes(docs).collect()} == wanted
    assert suffix.repeated_bytes(empty(spark)).isEmpty()


@pytest.mark.parametrize("parts", [1, 2])
def test_repeated_bytes_equal_rows(spark, parts):
    """Equal rows are one place, in one slice or in two: their text isn't its own repeat."""
    text = " ".join(f"word{i}" for i in range(60))
    row = (1, text, None, None, 0, 0, "x")
    df = spark.createDataFrame(spark.sparkContext.parallelize([row, row], parts), SCHEMA)
    assert [r.n_removed for r in suffix.repeated_bytes(df).collect()] == [0, 0]


def test_merge_of_transforms():
    rng = np.random.default_rng(3)
    shards = [np.concatenate([rng.integers(97, 100, n), [255]]).astype(np.uint8) for n in (300, 41, 500)]
    shard, position, interval = suffix.merge_transforms(shards, 12)
    keys = [bytes(np.roll(shards[s], -p)[:12]) for s, p in zip(shard, position, strict=True)]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:], strict=False)] == [a == b for a, b in zip(interval, interval[1:], strict=False)]


def test_quality(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.quality_scores(spark_docs, labels)
    held = out.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97
    assert out.where("score < 0 or score > 1 or score is null").isEmpty()
    kept = quality.good_documents(spark_docs, labels)
    assert kept.columns == spark_docs.columns and kept.count() == out.where("predicted = 1").count()


def test_quality_discriminant():
    """Scores against densities written out, with a covariance shrunk by hand."""
    rng = np.random.default_rng(9)
    d = len(quality.FEATURES)
    x, y = rng.normal(size=(400, d)) @ rng.normal(size=(d, d)), rng.integers(0, 2, 400)
    x[y == 1] += 0.5
    sums = np.array([np.concatenate([[(y == c).sum()], x[y == c].sum(0), (x[y == c].T @ x[y == c]).ravel()]) for c in (0, 1)])
    got = quality.log_odds(x[:20], *quality.discriminant(sums, 0.3))
    within = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = np.diag(np.diag(sum((y == c).mean() * within[c] for c in (0, 1)))) + 1e-4 * np.eye(d)
    odds = np.full(20, np.log((y == 1).sum() / (y == 0).sum()))
    for c, sign in ((0, -1), (1, 1)):
        cov, gap = 0.7 * within[c] + 0.3 * pooled, x[:20] - x[y == c].mean(0)
        odds += sign * -0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) + np.linalg.slogdet(cov)[1])
    assert np.allclose(got, odds)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels)
    assert out.count() == docs.count() and out.where("score is null").isEmpty()
    assert quality.quality_scores(empty(spark), labels).isEmpty()
    none = quality.quality_scores(docs, labels.where("doc_id < 0"))
    assert none.count() == docs.count() and none.where("score <> 0.5").isEmpty()


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = spark.createDataFrame([(900, "a b \x1cc <|endoftext|>d ΣΑΣ é 's 12", None, None, 1, 1, "x")], SCHEMA)
    every = docs.dropDuplicates(["doc_id"]).union(odd)
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in local(every)}
    rows = packing.packed_sequences(every, 512, part_ids=4000).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512 and at & (at - 1) == 0
    lengths = [sum(r.length for r in pieces) for _, pieces in sorted(by_sequence.items())]
    rest = sum(map(len, ids.values())) % 512
    assert sorted(by_sequence) == list(range(len(lengths))) and [x for x in lengths if x < 512] == [1 << b for b in range(8, -1, -1) if rest >> b & 1]
    assert packing.packed_sequences(empty(spark)).isEmpty()


def test_hilbert_curve():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_mixing(spark, docs):
    out = mixing.mixed(docs, temper=1.0, share=0.5, carry=("s",)).toPandas()
    assert len(out) == docs.count()
    assert np.allclose(out.probability[out.n_words > 0], 0.5)
    cells = spark.createDataFrame([("a", "x", 4.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", "y", 3.0)], "source string, lang string, w double")
    targets = {"source": spark.createDataFrame([("a", 0.3), ("b", 0.7), ("none", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, share double")}
    got = mixing.rake(cells, targets, 50, 1e-9).toPandas()
    m = np.array([[4.0, 1], [2, 3]])
    a, b = np.array([0.3, 0.7]) / 1.5, np.array([0.5, 0.5])
    a /= a.sum()
    for _ in range(200):
        m *= (a / m.sum(1))[:, None]
        m *= b / m.sum(0)
    assert np.allclose(got.sort_values(["source", "lang"]).w, m.ravel(), atol=1e-6)
    assert mixing.mixed(empty(spark)).isEmpty()


def test_mixing_topics(spark):
    """Documents that share no words but by topic fall apart by topic, in either language."""
    rng = np.random.default_rng(6)
    words = {(a, b): [f"{a}{b}{''.join(rng.choice(list('abcdefgh'), 6))}" for _ in range(25)] for a in ("en", "de") for b in ("x", "y")}
    rows = [(i, " ".join(rng.choice(words[("en", "de")[i % 2], ("x", "y")[i // 2 % 2]], 60)), ("en", "de")[i % 2], "s", 0, 0, "x") for i in range(200)]
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).toPandas()
    for lang in ("en", "de"):
        parts = [set(out[(out.lang == lang) & (out.doc_id // 2 % 2 == k)].topic % 4) for k in (0, 1)]  # by the first axes
        assert not parts[0] & parts[1]


def test_mixing_meets_targets_on_skewed_data(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(200)]
    shares = np.array([33.4, 30, 20, 10, 5, 1, 0.5, 0.1])
    pick = lambda: np.repeat(np.arange(8), (20 * shares).astype(int))[rng.permutation(2000)]
    rows = [(i, " ".join(rng.choice(vocabulary, 10)), f"l{b}", f"s{a}", 0, 0, "x") for i, (a, b) in enumerate(zip(pick(), pick(), strict=True))]
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).toPandas()
    kept = out.probability * out.n_words
    assert out.probability.max() <= 1 and kept.sum() > 0
    for d in mixing.DIMENSIONS:
        wanted = out.groupby(d).n_words.sum() ** 0.8
        assert np.allclose(kept.groupby(out[d]).sum() / kept.sum(), wanted / wanted.sum(), rtol=1e-3)


def test_raking_says_when_it_ends_early(spark):
    cells = spark.createDataFrame([("a", "x", 4.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", "y", 3.0)], "source string, lang string, w double")
    targets = {"source": spark.createDataFrame([("a", 0.3), ("b", 0.7)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, share double")}
    with pytest.warns(UserWarning, match="raking ended after 1 rounds"):
        mixing.rake(cells, targets, 1, 1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href="/x">Menu entry</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept.</div>
<div class="ad">Buy now, it is cheap. Really cheap.</div><article><h1>Head &amp; line</h1><p>First   para&shy;graph,\n with <i>inline</i> text.<br>More.<p>Sec&#111;nd: x &lt; y.<ul><li>one<li>two</ul>
<p>End.</article><aside>See also, this and that.</aside><div id="comments"><p>Nice text, thank you. I liked it.</p></div><form><p>Name, please.</p></form><footer>&copy; all, rights.</footer></body></html>"""


def test_html(spark):
    wanted = "Head & line\nFirst para­graph, with inline text. More.\nSecond: x < y.\none\ntwo\nEnd."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>Bare <b>text"), (4, "u", "<p>Bare <b>text"), (5, "u", "a < b and <"), (6, "u", "<div><p>" + "long, " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract_main_text(df).collect()]
    assert got[0] == (1, wanted, len(wanted))
    assert got[1:3] == [(2, "", 0), (3, "", 0)] and got[3][1] == got[4][1] == "Bare text"
    assert got[6][2] == 299999
    assert html.extract_main_text(df.where("page_id < 0")).isEmpty()


SENTENCE = "It is a long sentence, with several words, and it ends here."


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (f"<article><h1>A</h1><p>{SENTENCE}</p></article><article><p>B: {SENTENCE}</article>", f"A\n{SENTENCE}\nB: {SENTENCE}"),  # several articles
        (f"<article><p>{SENTENCE}</p><div class='share-price notice-board'><p>{SENTENCE}</p></div><div class='social-share'>Share, now.</div></article>", f"{SENTENCE}\n{SENTENCE}"),  # names of known parts alone
        (f"<main><article><p>{SENTENCE}<p>{SENTENCE}</article><section><p>Reader: nice, thank you!</section></main>", f"{SENTENCE}\n{SENTENCE}"),  # the article within main
        (f"<div class='widget'><div><p>{SENTENCE}</p><p>{SENTENCE}</p></div></div><div class='ad'>Buy, now.</div>", f"{SENTENCE}\n{SENTENCE}"),  # a named box around nearly all text
        (f"<div><div>{SENTENCE}</div><div>{SENTENCE}</div></div><nav><p>{SENTENCE}</nav>", f"{SENTENCE}\n{SENTENCE}"),  # an article of neutral boxes
        ("<div>" * 5000 + SENTENCE, SENTENCE),  # deep nesting
        ("".join(f"<div>{i}: {SENTENCE}" for i in range(3000)), "\n".join(f"{i}: {SENTENCE}" for i in range(3000))),
        ("<p" + " x='" * 3000, ""),  # quotes that never close
    ],
)
def test_html_pages(page, wanted):
    got = html.main_text(f"<html><body>{page}")
    assert got == wanted or wanted == "" and len(got) < len(page) + 10


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p>x</p><svg><svg></svg>inside</svg><p>y, z.</p>", "x\ny, z."),  # elements that are left out, within each other
        ("<p>a <template>q<template></template>inside</template> b.</p>", "a b."),
        ("<p>t <svg/> u <noscript>v<noscript>w</noscript>x</noscript> y</p>", "t u y"),
        ('<p>one <a href="foo>link</a> more text.</p>', "one link more text."),  # a quote without a partner
        ("<p title=it's>a, it's b</p>", "a, it's b"),
        ("<p>a<!-->b<!-- c --> d</p><p>e <3 </3> f", "ab d\ne <3 f"),
        ("<script>a</script x>b<p>c <d", "b\nc"),  # a page that ends within a tag
        ("<p>&#" + "9" * 6000 + "; &#0000000065;&#x110000;", "\ufffd A\ufffd"),
    ],
)
def test_html_broken_pages(page, wanted):
    assert html.main_text(page) == wanted


@pytest.mark.parametrize(
    "piece",
    ["<a ", "</a ", "<!", "<!--", '<a href="x>', '<a =">" ', "</script ", "<b>", "<p><table><i>", "&#9"],
)
@pytest.mark.parametrize("end", ["", '="', ">", "<hr>" * 40000, "<li></li>" * 40000])
def test_html_reads_forward_once(piece, end):
    """A page of 400 KB and more in a few seconds; it took hours where each piece looked at all behind it."""
    start = time.process_time()
    html.main_text(piece * (400_000 // len(piece)) + end)
    assert time.process_time() - start < 8


def test_html_path_scores():
    """Ratios of each path by a plain reading: sums over its blocks, smoothed over the page, multiplied."""
    page = "<html><body>" + "".join(f"<div><p>{'word, ' * (3 * i + 1)}</p></div><ul><li>item {i}<li>b</ul>" for i in range(6))
    elements, blocks = html.page_blocks(page)
    paths = [tuple(_path(e)) for e, _ in blocks]
    ratio = {}
    for k in (0, 1):
        measure = (lambda t: len(t)) if k == 0 else (lambda t: sum(c in ".,;:!?" for c in t))
        ratio[k] = [np.mean([measure(t) for (_, t), q in zip(blocks, paths, strict=True) if q == p]) for p in paths]
    fused = []
    for i in range(len(blocks)):
        near = [j for j in range(len(blocks)) if abs(i - j) <= 2]
        weight = [(1.0, 0.6, 0.15)[abs(i - j)] for j in near]
        a, b = (np.average([ratio[k][j] for j in near], weights=weight) for k in (0, 1))
        fused.append(np.log(1 + a * (1 + b)))
    score, bar = html.path_scores(blocks)
    for (e, _), p in zip(blocks, paths, strict=True):
        assert score[e.path] == pytest.approx(max(f for f, q in zip(fused, paths, strict=True) if q == p))
    assert bar == pytest.approx(min(np.mean(fused) - 0.5 * np.std(fused), 0.75 * np.mean(fused), max(fused)))


def _path(element):
    return [] if element.parent is None else [*_path(element.parent), element.tag]


def test_scoring(spark, docs):
    out = scoring.pseudo_likelihood(docs).toPandas()
    assert len(out) == docs.count()
    assert (out.log_likelihood[out.n_words > 0] < 0).all() and (out.log_likelihood[out.n_words == 0] == 0).all()
    assert out.mean_log_prob[out.n_words == 0].isna().all()
    assert scoring.pseudo_likelihood(empty(spark)).isEmpty()


def test_scoring_learns():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 200, 10), 4000)
    near = scoring.contexts(ids, np.zeros(len(ids), int))
    net = scoring.initial_network()
    squares = [np.full(p.shape, 1e-4, np.float32) for p in net]
    before = scoring.log_probabilities(net, near, ids).mean()
    for _ in range(5):
        scoring.train(net, squares, near, ids)
    assert scoring.log_probabilities(net, near, ids).mean() > before / 10


def test_scoring_gradient():
    """One step of descent follows the slope of the loss by finite differences."""
    rng = np.random.default_rng(3)
    net = [rng.normal(0, 0.5, s).astype(np.float32) for s in scoring.SHAPES]
    ids, near = rng.integers(0, scoring.ENTRIES, 60), rng.integers(0, scoring.ENTRIES + 1, (60, 4))
    for i, p in enumerate(net):
        after, squares = [x.copy() for x in net], [np.ones(x.shape, np.float32) for x in net]  # steps nearly in proportion to the gradient
        scoring.train(after, squares, near, ids)
        slope = (net[i] - after[i]).astype(float) / scoring.RATE
        gain = lambda h: -scoring.log_probabilities([x + np.float32(h) * slope.reshape(x.shape).astype(np.float32) if j == i else x for j, x in enumerate(net)], near, ids).mean()  # noqa: B023, E731
        size = (slope**2).sum()
        h = 1e-2 / np.sqrt(size)
        assert p.shape == after[i].shape and (gain(h) - gain(-h)) / (2 * h) == pytest.approx(size, rel=0.1)


def test_scoring_trains_on_every_word(monkeypatch):
    monkeypatch.setattr(scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.record_batch({"text": ["one", None, "a b c", "w " * 40]})
    out = next(scoring._learn(scoring.initial_network(), np.zeros(0, np.uint64), np.zeros(0, np.int64))(iter([batch])))
    assert out["n"][0].as_py() == 44


def test_scoring_brute_force(spark, docs, monkeypatch):
    """Scores of a given network, word by word, whatever the slices, buckets and partitions."""
    rng = np.random.default_rng(8)
    net = [rng.normal(0, 0.3, s).astype(np.float32) for s in scoring.SHAPES]
    monkeypatch.setattr(scoring, "fit", lambda *a: net)
    monkeypatch.setattr(scoring, "KEYS_PER_BUCKET", 400)
    many = [" ".join(f"word{x}" for x in rng.integers(0, 6000, 300)) for _ in range(40)]
    docs = docs.union(spark.createDataFrame([(1000 + i, t, None, None, 0, 0, "x") for i, t in enumerate(many)], SCHEMA)).cache()
    most = scoring.FREQUENT
    fold = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    rows = [(i, [fold(w) for w in WORD.findall(t)]) for i, t in local(docs)]
    counts = Counter(w for _, ws in rows for w in ws)
    joined = "\n".join(counts).encode()
    code = dict(zip(counts, scoring.Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), fold=True).codes.tolist(), strict=True))
    top = sorted(counts, key=lambda w: (-counts[w], np.uint64(code[w]).astype(np.int64)))[:most]
    place = {w: k for k, w in enumerate(top)}
    entry = {w: place[w] if w in place else most + code[w] % 64 for w in counts}
    members = {}
    for w in counts:
        members.setdefault(entry[w], []).append(w)
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    wanted = {}
    for i, ws in rows:
        ids, total = [entry[w] for w in ws], 0.0
        for k, w in enumerate(ws):
            beside = [ids[k + s] if 0 <= k + s < len(ids) else scoring.EDGE for s in scoring.SIDES]
            h = np.tanh(sum(net[0][b] * net[1][j] for j, b in enumerate(beside)) + net[2])
            c, m = divmod(ids[k], 64)
            total += np.log(softmax(h @ net[3] + net[4])[c]) + np.log(softmax(h @ net[5][c] + net[6][c])[m])
            if ids[k] >= most:
                others = members[ids[k]]
                here = Counter(ws)
                total += np.log(counts[w] - here[w] + scoring.ALPHA) - np.log(sum(counts[x] - here[x] for x in others) + scoring.ALPHA * len(others))
        wanted.setdefault(i, []).append(total)
    got = {}
    for r in scoring.pseudo_likelihood(docs.repartition(5)).collect():
        got.setdefault(r.doc_id, []).append(r.log_likelihood)
    assert got.keys() == wanted.keys()
    for i, x in wanted.items():
        assert sorted(got[i]) == pytest.approx(sorted(x), rel=1e-4, abs=1e-4)


def test_scoring_tells_what_the_corpus_repeats(spark):
    """Of documents alike but for one rare word, the one whose word others use scores higher."""
    common = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "w1 w2 rarely w3 w4"), *[(2 + i, "w1 w2 oftener w3 w4") for i in range(7)], *[(100 + i, common) for i in range(9)]]
    got = {r.doc_id: r.log_likelihood for r in scoring.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] > got[1]


def test_nearest_neighbours(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    got = ann.nearest_neighbours(v).toPandas()
    hit = asked = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(np.square(x - x[i]).sum(1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert np.allclose(mine.score, [d[np.flatnonzero(ids == j)[0]] for j in mine.vec_id], rtol=1e-12)
        hit += len(set(mine.vec_id) & set(ids[best]))
        asked += 10
    assert hit / asked >= 0.9


def test_nearest_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (100, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest_neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest_neighbours(df.where("vec_id = 3")).isEmpty()


@pytest.mark.parametrize("unit", [1.0, 1e9, 1e200, 1e-200])
def test_nearest_neighbours_of_any_size(spark, unit):
    """Near rows far from the origin, several lengths, an empty vector, and columns with clashing names."""
    rows = [(i, [unit * (1e6 + i * i), unit * 1e6, unit]) for i in range(30)] + [(100, [unit * 1e6, unit * 1e6, unit]), (200, [unit, unit]), (201, [unit, 2 * unit]), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("row", F.lit(2))
    got = {}
    for r in ann.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score / unit))
    assert [i for i, _ in got[0]] == [100, 1, 2, 3, 4, 5, 6, 7, 8, 9] and [i for i, _ in got[100]] == list(range(10))
    assert [s for _, s in got[100]] == pytest.approx([i * i for i in range(10)], rel=1e-9)
    assert got[200] == [(201, pytest.approx(1.0))] and 300 not in got


def shingles(text: str) -> frozenset:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = WORD.findall(folded)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows) -> dict:
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    every = sorted(sets)
    for a, i in enumerate(every):
        for j in every[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("wide", [64, 3])
def test_jaccard_components(spark, docs, wide):
    wanted = components(local(docs))
    rows = jaccard.jaccard_components(docs, wide=wide).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).isEmpty()


def test_pipeline_stages(spark):
    """Every stage but the first and the sampling, on what came before, by brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.stored(stages["quality classifier"](spark, docs, sf))
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
    near = corpus_pipeline.stored(stages["n-gram Jaccard join"](spark, kept, sf))
    wanted = {i for i, (_, c) in components(local(kept)).items() if i == c}
    assert {r.doc_id for r in near.collect()} == wanted
    cut = corpus_pipeline.stored(stages["substring dedup"](spark, near, sf))
    before, after = dict(local(near)), dict(local(cut))
    rows = [(i, WORD.findall(t)) for i, t in before.items()]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    for i, w in rows:
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        left = [x for k, x in enumerate(w) if k not in gone]
        assert (i in after) == bool(left or not w) and WORD.findall(after.get(i, "")) == left
        assert gone or after[i] == before[i]
    mixed = corpus_pipeline.stored(stages["mixing sources to target weights"](spark, cut, sf))
    assert mixed.columns == docs.columns and mixed.exceptAll(cut).isEmpty() and 0 < mixed.count() < cut.count()
    packed = stages["packing"](spark, mixed, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.collect()}


def test_pipeline_stages_on_edges(spark):
    """Empty tables, nulls in every column, and a column with a name that operators use inside."""
    sf = "/root/testdata/sf0.001"
    rows = [(None, None, None, None, None, 0, "x"), (1, "", "en", None, 0, 0, "x"), (2, "line one\n\n  line two\t" + " ".join(f"word{i}" for i in range(50)), "en", "s", 9, 0, "x"), (2, "other text of no more than some words", None, "s", 9, 0, "x")]
    full = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty(spark), sf).isEmpty() and stage(spark, empty(spark), sf).columns == full.columns, name
        out = stage(spark, full, sf)
        assert out.columns == full.columns and out.exceptAll(full).isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), sf).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, full, sf).where("start = 0").count() == 4


def test_sql(spark):
    """Queries that SQL can express, on the smallest tables."""
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, "/root/testdata/sf0.001")
        wanted = con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(wanted), name


def test_pipeline_keeps_unrelated_rows_of_one_id(spark):
    """Different texts under one id or under none stay; equal rows are one; a sampled row needs no id."""
    one, two, three = (" ".join(f"{k}{i}" for i in range(20)) for k in "abc")
    rows = [(1, one), (1, two), (1, two), (None, three), (None, one), (2, ""), (2, ""), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "x") for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    near = stages["n-gram Jaccard join"](spark, df, "")
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(1, one), (1, two), (None, three), (2, ""), (3, None)], key=str)
    nameless = spark.createDataFrame([(None, f"word{i} " * 5, "en", "s", 0, 0, "x") for i in range(40)], SCHEMA)
    assert 0 < stages["mixing sources to target weights"](spark, nameless, "").count() < 40
