"""Document scores by masked pseudo-likelihood.

A bidirectional network predicts each word from two words to either side: their
embeddings, scaled by place, add up to a hidden layer.  A softmax over classes
and one over the entries of the class follow, so a word costs two softmaxes of
``CLASSES`` and ``MEMBERS`` values.  A document's score is the sum over its words
of the conditional log-probability given both sides.

Vocabulary: every word of the corpus, with its count over all documents.  The
most frequent words are entries of the network; the others fall into the hashed
entries of the last class, and within one of these a word has its share of what
the other documents hold of the entry: with c(w) and c(e) the counts of the word
and the entry there, and ``ALPHA`` for each of the V(e) words known,
P(word | sides) = P(e | sides) * (c(w) + ALPHA) / (c(e) + ALPHA * V(e)).
One more entry stands for the edge of a text.

Training visits every word of every document: each partition runs stochastic
gradient steps over its texts, from the same start, and the networks are averaged
by Spark, weighted by words seen.  So the result depends on how the input is
dealt to partitions, as it does with any training by parallel descent; counts and
scores of a given network don't.

Scale.  A network has a fixed size; those of ``FAN`` partitions are added up at a
time, until one is left.  Word counts are summed before they are shuffled, and
stay a table as large as the vocabulary.  Each slice of text asks for the counts
of its distinct rare words, packed by bucket, and gets them back packed in the
same order.  Null and empty texts have no words, score 0 and a null mean.  A very
long text is a slice of its own.  Repeated rows are scored alike (and count twice
in training); null ids and other columns play no part.  No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored
from .text import Words, mix, slices

CLASSES = MEMBERS = 64
OTHERS = MEMBERS  # hashed entries: the last class
FREQUENT = (CLASSES - 1) * MEMBERS
ENTRIES = FREQUENT + OTHERS
EDGE = ENTRIES
HIDDEN = 16
SIDES = (-2, -1, 1, 2)
BATCH = 8192
RATE = 0.1
ALPHA = 0.05
SAFE = 80  # the exponential of a number below it is far from the largest of 32 bits
FAN = 64
KEYS_PER_BUCKET = 1_000_000
#: embeddings, scale by place, bias; classes and their bias; members and their bias
SHAPES = ((ENTRIES + 1, HIDDEN), (len(SIDES), HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS))


def initial_network(entry_counts: np.ndarray | None = None) -> list[np.ndarray]:
    """Small weights; with counts of the entries, biases that give their shares."""
    rng = np.random.default_rng(7)
    net = [rng.normal(0, 0.1, s).astype(np.float32) for s in SHAPES]
    net[1][:] = 1
    net[2][:] = 0
    counts = (np.ones(ENTRIES) if entry_counts is None else entry_counts + 1.0).reshape(CLASSES, MEMBERS)
    net[4][:] = np.log(counts.sum(1) / counts.sum())
    net[6][:] = np.log(counts / counts.sum(1, keepdims=True))
    return net


def word_entries(words: Words, codes: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Entry of each word; ``codes`` are the sorted codes of the frequent words, ``entry`` theirs."""
    ids = FREQUENT + (words.codes % np.uint64(OTHERS)).astype(np.int64)
    if len(codes):
        at = np.minimum(np.searchsorted(codes, words.codes), len(codes) - 1)
        ids = np.where(codes[at] == words.codes, entry[at], ids)
    return ids


def contexts(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Entries of the words beside each word, the edge's beyond a text."""
    out = np.full((len(ids), len(SIDES)), EDGE)
    for k, side in enumerate(SIDES):
        n = len(ids) - abs(side)
        if n > 0:
            a, b = (slice(0, n), slice(side, side + n)) if side > 0 else (slice(-side, -side + n), slice(0, n))
            out[a, k] = np.where(text[a] == text[b], ids[b], EDGE)
    return out


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts targets of one class side by side, and where each class starts."""
    own = (target // MEMBERS).astype(np.uint8)
    return np.argsort(own, kind="stable"), np.append(0, np.cumsum(np.bincount(own, minlength=CLASSES)))


def _weights(net: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights of the classes and of the members with their biases as a last row, and whether no logit can be large, as the hidden layer is within 1."""
    classes, members = np.concatenate([net[3], net[4][None]]), np.concatenate([net[5], net[6][:, None]], axis=1)
    return classes, members, bool(np.abs(classes).sum(0).max() < SAFE and np.abs(members).sum(1).max() < SAFE)


def _forward(net: list[np.ndarray], near: np.ndarray, first: np.ndarray, weights: tuple[np.ndarray, np.ndarray, bool]) -> tuple[np.ndarray, ...]:
    """Embeddings of the sides, hidden layer (and a column of 1), logits of the classes and of the members of each word's own class."""
    side = np.take(net[0], near.T, axis=0)
    hidden = np.ones((len(near), HIDDEN + 1), np.float32)
    total = side[0] * net[1][0]
    for k in range(1, len(SIDES)):
        total += side[k] * net[1][k]
    total += net[2]
    np.tanh(total, out=hidden[:, :-1])
    logits = hidden @ weights[0], np.empty((len(near), MEMBERS), np.float32)
    for c in np.flatnonzero(np.diff(first)).tolist():
        np.matmul(hidden[first[c] : first[c + 1]], weights[1][c], out=logits[1][first[c] : first[c + 1]])
    if not weights[2]:
        for x in logits:
            x -= x.max(1, keepdims=True)
    return side, hidden, *logits


def log_probabilities(net: list[np.ndarray], near: np.ndarray, target: np.ndarray, rows: int = 16384) -> np.ndarray:
    """Log-probability of each target given its sides."""
    out, weights, one = np.empty(len(target)), _weights(net), np.ones(MEMBERS, np.float32)
    for a in range(0, len(target), rows):
        order, first = _by_class(target[a : a + rows])
        x, y = near[a : a + rows][order], target[a : a + rows][order]
        every, logits = np.arange(len(y)), _forward(net, x, first, weights)[2:]
        own = [x[every, at] for x, at in zip(logits, np.divmod(y, MEMBERS), strict=True)]
        out[a + order] = sum(x - np.log(np.exp(z, out=z) @ one) for x, z in zip(own, logits, strict=True))
    return out


def train(net: list[np.ndarray], squares: list[np.ndarray], near: np.ndarray, target: np.ndarray) -> None:
    """One pass of gradient steps (scaled by sums of squares) over the examples, in place."""
    one = np.ones(MEMBERS, np.float32)

    def step(i: int, where, gradient: np.ndarray) -> None:
        squares[i][where] += gradient * gradient
        net[i][where] -= RATE * gradient / np.sqrt(squares[i][where])

    for a in range(0, len(target), BATCH):
        order, first = _by_class(target[a : a + BATCH])
        x, y = near[a : a + BATCH][order], target[a : a + BATCH][order]
        n, every, weights = np.float32(1 / len(y)), np.arange(len(y)), _weights(net)
        side, hidden, error, inner = _forward(net, x, first, weights)
        for z, at in zip((error, inner), np.divmod(y, MEMBERS), strict=True):
            np.exp(z, out=z)
            z *= (n / (z @ one))[:, None]
            z[every, at] -= n
        back = error @ net[3].T
        slope = np.zeros_like(weights[1])
        for c in np.flatnonzero(np.diff(first)).tolist():
            own = slice(first[c], first[c + 1])
            back[own] += inner[own] @ net[5][c].T
            np.matmul(hidden[own].T, inner[own], out=slope[c])
        # a class without words has no slope, so nothing of it changes
        step(5, slice(None), slope[:, :-1])
        step(6, slice(None), slope[:, -1])
        slope = hidden.T @ error
        step(3, slice(None), slope[:-1])
        step(4, slice(None), slope[-1])
        hidden = hidden[:, :-1]
        back *= 1 - hidden * hidden
        step(2, slice(None), np.ones(len(y), np.float32) @ back)
        scale = np.einsum("nd,knd->kd", back, side)
        flat = x.T.ravel().astype(np.uint16)
        by = np.argsort(flat, kind="stable")
        entry, head = np.unique(flat[by], return_index=True)
        np.multiply(back, net[1][:, None], out=side)
        step(0, entry, np.add.reduceat(np.take(side.reshape(-1, HIDDEN), by, axis=0), head, axis=0))
        step(1, slice(None), scale)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            code, n = np.unique(Words(data, offsets, fold=True).codes, return_counts=True)
            yield pa.record_batch({"code": code.view(np.int64), "n": n.astype(np.int64)})


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of every word of all documents."""
    return stored(docs.select("text").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes of the frequent words and their entries; words and distinct words of each entry."""
    top = counts.orderBy(F.desc("n"), "code").limit(FREQUENT).collect()
    code, n = np.array([r.code for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    words, known = np.zeros(ENTRIES), np.zeros(ENTRIES)
    words[: len(top)], known[: len(top)] = n, 1
    of_entry = counts.groupBy(F.pmod("code", F.lit(OTHERS)).alias("entry")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    for r in of_entry:
        words[FREQUENT + r.entry], known[FREQUENT + r.entry] = r.n, r.words
    np.subtract.at(words, FREQUENT + (code % np.uint64(OTHERS)).astype(np.int64), n)
    np.subtract.at(known, FREQUENT + (code % np.uint64(OTHERS)).astype(np.int64), 1)
    order = np.argsort(code)
    return code[order], np.arange(len(top))[order], words, known


def _learn(net: list[np.ndarray], codes: np.ndarray, entry: np.ndarray):
    """The network after the texts of this partition, times the words seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares, seen = [p.copy() for p in net], [np.full(p.shape, 1e-4, np.float32) for p in net], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                words = Words(data, offsets, fold=True)
                if len(words):
                    ids = word_entries(words, codes, entry)
                    at = np.random.default_rng(len(words)).permutation(len(words))
                    train(own, squares, contexts(ids, words.text)[at], ids[at])
                    seen += len(at)
        flat = np.concatenate([p.ravel() for p in own]) * np.float32(seen)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() // FAN], pa.int64()), pa.array([float(seen)]), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "net"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    total = 0.0
    for blob in table.column("net").to_pylist():
        total = total + np.frombuffer(blob, np.float32).astype(float)
    return pa.table({"part": [table.column("part")[0].as_py() // FAN], "n": [float(sum(table.column("n").to_pylist()))], "net": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def fit(docs: DataFrame, codes: np.ndarray, entry: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The mean of the networks of all partitions."""
    net = initial_network(words)
    kind = "part long, n double, net binary"
    texts = docs.select("text")
    sums, parts = stored(texts.mapInArrow(_learn(net, codes, entry), kind)), texts.rdd.getNumPartitions()
    while True:
        sums, parts = sums.groupBy("part").applyInArrow(_add_up, kind), -(-parts // FAN)
        if parts <= 1:
            break
    total = sums.first()
    if total is None or not total.n:
        return net
    flat = np.frombuffer(total.net, np.float32) / np.float32(total.n)
    return [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([np.prod(s) for s in SHAPES])[:-1]), SHAPES, strict=True)]


def _packed(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _score(net: list[np.ndarray], codes: np.ndarray, entry: np.ndarray):
    """For each slice: log-probabilities of the entries by document, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_no = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, fold=True)
                ids = word_entries(words, codes, entry)
                logp = np.bincount(words.text, log_probabilities(net, contexts(ids, words.text), ids), len(words.counts))
                rare = ids >= FREQUENT
                key, which = np.unique(words.codes[rare], return_inverse=True)
                pair, times = np.unique(words.text[rare] * max(1, len(key)) + which, return_counts=True)
                text, word = np.divmod(pair, max(1, len(key)))
                own = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), batch.column(0).slice(first, last - first))
                yield pa.record_batch([pa.array([slice_no]), own, *(pa.array([_packed(x)], pa.binary()) for x in (words.counts.astype(np.int64), logp.astype(float), text.astype(np.int32), word.astype(np.int32), times.astype(np.int32), key))], ["slice", "ids", "counts", "logp", "text", "word", "times", "key"])
                slice_no += 1

    return run


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray) -> list[np.ndarray]:
    by = np.argsort(bucket, kind="stable")
    return [p for p in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(p)]


def _ask(buckets: int):
    """The rare words of each slice, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_no, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = _unpacked(blob, np.uint64)
                bucket = _bucket_of(key, buckets)
                parts = _parts(bucket)
                yield pa.record_batch([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([slice_no] * len(parts), pa.int64()), pa.array([_packed(key[p]) for p in parts], pa.binary())], ["bucket", "slice", "key"])

    return run


def _deal(buckets: int):
    """Counts of words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            bucket = _bucket_of(key, buckets)
            parts = _parts(bucket)
            yield pa.record_batch([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), *(pa.array([_packed(x[p]) for p in parts], pa.binary()) for x in (key, n))], ["bucket", "key", "n"])

    return run


def _answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """The counts that slices asked for, in their order."""
    if not asked.num_rows:
        return pa.table({"slice": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "n": pa.array([], pa.binary())})
    key, n = (np.concatenate([_unpacked(b, k) for b in counts.column(c).to_pylist()]) for c, k in (("key", np.uint64), ("n", np.int64)))
    order = np.argsort(key)
    key, n = key[order], n[order]
    out = [_packed(n[np.searchsorted(key, _unpacked(b, np.uint64))]) for b in asked.column("key").to_pylist()]
    return pa.table({"slice": asked.column("slice"), "bucket": asked.column("bucket"), "n": pa.array(out, pa.binary())})


def _finish(words: np.ndarray, known: np.ndarray, buckets: int, kind: pa.DataType):
    """Scores of the documents of one slice."""

    def run(scored: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"id": [], "n_words": [], "log_likelihood": []}
        for row in scored.to_batches():
            for i in range(row.num_rows):
                counts, logp, text, word, times, key = (_unpacked(row.column(row.schema.names.index(c))[i].as_py(), k) for c, k in (("counts", np.int64), ("logp", float), ("text", np.int32), ("word", np.int32), ("times", np.int32), ("key", np.uint64)))
                if len(key):
                    n = np.empty(len(key), np.int64)
                    bucket = _bucket_of(key, buckets)
                    blobs = dict(zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), strict=True))
                    for p in _parts(bucket):
                        n[p] = _unpacked(blobs[int(bucket[p[0]])], np.int64)
                    entry = (key % np.uint64(OTHERS)).astype(np.int64)[word]
                    held, at = np.unique(text.astype(np.int64) * OTHERS + entry, return_inverse=True)  # the document's own words don't count
                    of_entry = np.maximum(words[FREQUENT + entry] - np.bincount(at, times, len(held))[at], 0)
                    share = np.log(n[word] - times + ALPHA) - np.log(of_entry + ALPHA * known[FREQUENT + entry])
                    logp = logp + np.bincount(text, times * share, len(logp))
                out["id"].append(row.column(row.schema.names.index("ids"))[i].values)
                out["n_words"].append(counts)
                out["log_likelihood"].append(logp)
        ids = pa.chunked_array(out["id"], kind)
        return pa.table({"id": ids, **{k: np.concatenate([*out[k], np.zeros(0, t)]) for k, t in (("n_words", np.int64), ("log_likelihood", float))}})

    return run


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_prob) for each document."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    counts = word_counts(named)
    codes, entry, words, known = vocabulary(counts)
    net = fit(named, codes, entry, words)
    scored = stored(named.mapInArrow(_score(net, codes, entry), f"slice long, ids array<{kind}>, counts binary, logp binary, text binary, word binary, times binary, key binary"))
    buckets = max(1, int(known.sum()) // KEYS_PER_BUCKET)
    asked = scored.select("slice", "key").mapInArrow(_ask(buckets), "bucket long, slice long, key binary")
    dealt = counts.mapInArrow(_deal(buckets), "bucket long, key binary, n binary")
    answers = asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(_answer, "slice long, bucket long, n binary")
    finish = _finish(words, known, buckets, scored.limit(0).toArrow().schema.field("ids").type.value_type)
    out = scored.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, f"id {kind}, n_words long, log_likelihood double")
    return out.select(F.col("id").alias(id_col), "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_prob"))
