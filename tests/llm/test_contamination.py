"""Benchmark decontamination against a word-by-word reading of the rules."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, r_text string, n_hit int, spans string"


def made():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcXé7"), rng.integers(1, 4))) for _ in range(40)]
    new = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(f"i{k}", new(int(n))) for k, n in enumerate(rng.integers(1, 40, 30)) if n > 3]
    items += [("z", "lone É-word"), ("none", " .,; "), ("null", None), (None, new(14)), ("i0", new(12)), ("again", items[3][1].lower()), ("again2", items[3][1])]
    items += [("deep", new(30) + " " + items[5][1] + " " + new(9)), ("10", new(10)), ("9", new(9))]
    texts = [None, "", " . ", "lone é word lone é word", "LONE é--WORD", new(400), items[3][1] * 3]
    for k in range(60):
        words = (items[k % len(items)][1] or "x").split()
        lo = int(rng.integers(0, len(words)))
        texts.append(new(int(rng.integers(0, 30))) + " ," + "; ".join(words[lo:]).upper() + "\n" + new(int(rng.integers(0, 30))))
    texts.append(new(20000) + " " + items[-3][1] + "\x00" + new(5))
    return texts, items


@pytest.fixture(scope="module")
def tables(spark):
    texts, items = made()
    rows = [(k % 50 if k % 9 else None, t, "clash", 1, "x") for k, t in enumerate(texts)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, DOCS).repartition(3).cache(), spark.createDataFrame([(a, b, 0) for a, b in items], "item_id string, text string, size int").repartition(2).cache()


def plain(text, items, size=10):
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer((text or "").translate(UPPER))]
    w = [x[2] for x in words]
    hit, found = set(), set()
    for name, item in items:
        x = WORD.findall((item or "").translate(UPPER))
        n = min(size, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if name is not None:
                    found.add(name)
    return words, hit, sorted(found)


def expected(docs, items):
    out = []
    for r in docs:
        words, hit, found = plain(r.text, items)
        out.append((r.doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("block", [contamination.BLOCK, 300])
def test_report(spark, tables, block, monkeypatch):
    """One scan, or one for each of many blocks of items: the same rows."""
    docs, items = tables
    wanted = expected(docs.collect(), made()[1])
    assert sum(r[5] for r in wanted) > 10 and not all(r[5] for r in wanted)
    monkeypatch.setattr(contamination.contamination, "__defaults__", (*contamination.contamination.__defaults__[:-1], block))
    assert key(wanted) == key(contamination.contamination_report(docs, items).collect())


@pytest.mark.parametrize("block", [contamination.BLOCK, 300])
def test_spans_are_cut(spark, tables, block):
    docs, items = tables
    wanted = []
    for r in docs.collect():
        words, hit, _ = plain(r.text, made()[1])
        text, at, i = r.text or "", 0, 0
        kept = ""
        while i < len(words):
            if i in hit:
                kept += text[at : words[i][0]]
                while i in hit:
                    at = words[i][1]
                    i += 1
            else:
                i += 1
        wanted.append((r.doc_id, None if r.text is None else kept + text[at:], *r[2:]))
    out = contamination.decontaminated(docs, items, block=block)
    assert out.columns == docs.columns and key(wanted) == key(out.collect())
    clean = contamination.decontaminated(docs, items, "documents", block=block)
    assert key(clean.collect()) == key(r for r in docs.collect() if not plain(r.text, made()[1])[1])
    with pytest.raises(ValueError):
        contamination.decontaminated(docs, items, "words")


def test_edges(spark, tables, monkeypatch):
    """No documents, no items, long items in pieces, and texts that share a fingerprint."""
    docs, items = tables
    assert contamination.contamination_report(docs.limit(0), items).isEmpty()
    assert contamination.contamination_report(docs, items.limit(0)).where("contaminated or n_items > 0").isEmpty()
    wanted = expected(docs.collect(), made()[1])
    monkeypatch.setattr(contamination, "PIECE", 7)
    assert key(wanted) == key(contamination.contamination_report(docs, items).collect())
    carried = contamination.contamination(docs.withColumn("r_id", F.lit("y")), items, carry=("r_id", "n_hit"))
    assert carried.columns == ["doc_id", "r_id", "n_hit", "n_words", "n_hit", "spans", "item_ids"]


def test_shared_fingerprints():
    """Windows are told apart by their text where fingerprints are equal."""
    names, texts = ["a", "b"], [b"one two three", b"four five six"]
    found = contamination.WindowSet(names, texts, 3)
    data = np.frombuffer(b"x one two three y four five six z", np.uint8)
    words = contamination.normal_words(data, np.array([0, len(data)]))
    whole = found.scan(words)[0].tolist()
    g = found.grams[0]
    first, codes = words.windows(3)
    g.codes = np.full(2, codes[1])  # both windows under the fingerprint of the first
    words.windows = lambda n: (first, np.where(np.isin(np.arange(len(first)), [1, 5]), codes[1], codes))
    g.bitmap[:] = True
    assert found.scan(words)[0].tolist() == whole == [False, True, True, True, False, True, True, True, False]
