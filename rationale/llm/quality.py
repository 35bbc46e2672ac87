"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a few statistics: rates of symbols, marks, capitals,
digits and long words, word length, how evenly bytes are spread, and how often
words and pairs of words repeat.  Each is damped for short texts and put on a log
scale.  For either class the labelled training rows give mean and covariance, from
sums that Spark adds up over all of them.  A class covariance is shrunk towards
the diagonal of the pooled one; of ``SHRINKS``, the share is taken with which one
half of the training rows tells the classes of the other half best.  The Cholesky
factor is kept, so a score is the logistic of a difference of log-densities, two
triangular products a document.

Null texts are empty texts: their statistics are those of no words, and they are
scored like any other.  Without training rows of both classes every score is the
share of label 1 (0.5 without any).  Repeated rows are scored alike; labels
that stand twice count twice.  No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored
from .text import Words, slices

SHRINKS = (0.02, 0.1, 0.3, 0.7)
DAMP = 20.0  # words added to each denominator
FEATURES = ("symbol", "bang", "bar", "upper", "capital", "same_as_before", "top_word", "word_bytes", "stop", "digit", "long_word", "distinct", "pair_again", "byte_spread")
_SCALE = 0.02

_CLASSES = np.zeros((5, 256), bool)
_CLASSES[0, list(b"#%$&*^~<>\\{}[]")] = True
_CLASSES[1, list(b"!")] = True
_CLASSES[2, list(b"|")] = True
_CLASSES[3, 65:91] = True
_CLASSES[4, 48:58] = True


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    words = Words(data, offsets)
    n = words.counts.astype(float)
    t = len(n)

    def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1)
        np.cumsum(mask, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    symbol, bang, bar, upper, digit = (per_text(c[data], offsets) for c in _CLASSES)
    width = (words.ends - words.starts).astype(float)
    total = per_text(width, words.first)
    first_byte, last_byte = data[words.starts], data[words.ends - 1]
    capital = per_text((first_byte >= 65) & (first_byte < 91), words.first)
    stop = per_text(np.isin(last_byte, np.frombuffer(b".,;:?", np.uint8)), words.first)
    same = np.zeros(len(words), bool)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (words.text[1:] == words.text[:-1])
    order = np.lexsort((words.codes, words.text))
    code, text = words.codes[order], words.text[order]
    head = np.ones(len(code), bool)
    head[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(head)
    top = np.zeros(t)
    np.maximum.at(top, text[at], np.diff(np.append(at, len(code))))
    distinct = np.bincount(text[at], minlength=t)
    first, pairs = words.windows(2)
    order = np.lexsort((pairs, words.text[first]))
    pairs, text = pairs[order], words.text[first][order]
    again = np.bincount(text[1:][(pairs[1:] == pairs[:-1]) & (text[1:] == text[:-1])], minlength=t)
    seen = np.bincount(np.repeat(np.arange(t), np.diff(offsets)) * 256 + data, minlength=256 * t).reshape(t, 256)
    share = seen / np.maximum(np.diff(offsets), 1)[:, None]
    spread = -(share * np.log(np.maximum(share, 1e-12))).sum(1) * n / (n + DAMP)

    rate = lambda x, of: np.log1p(x / (of + DAMP) / _SCALE)
    mean_width = (total + DAMP * 5) / (n + DAMP)
    return np.stack([rate(symbol, n), rate(bang, n), rate(bar, n), rate(upper, total), rate(capital, n), rate(per_text(same, words.first), n), rate(np.maximum(top - 1, 0), n), np.log(mean_width), rate(stop, n), rate(digit, total), rate(per_text(width > 12, words.first), n), np.log((distinct + DAMP) / (n + DAMP)), rate(again, n), spread], axis=1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(1)):
            x = document_statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0).slice(first, last - first), lists], ["id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each half and class, as one array."""
    d = len(FEATURES)
    sums = np.zeros((2, 2, 1 + d + d * d))
    for batch in batches:
        half, y, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
        for h in (0, 1):
            for c in (0, 1):
                z = x[(half == h) & (y == c)]
                sums[h, c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    yield pa.record_batch({"i": np.arange(sums.size), "v": sums.ravel()})


def discriminant(sums: np.ndarray, shrink: float) -> tuple[float, list[tuple[np.ndarray, np.ndarray, float]]]:
    """Prior log-odds of label 1, and for each class mean, inverse Cholesky factor and log-determinant, from sums by class."""
    d = len(FEATURES)
    n = sums[:, 0]
    if n.min() < 2:
        share = n[1] / n.sum() if n.sum() else 0.5
        return float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), []
    means = sums[:, 1 : 1 + d] / n[:, None]
    cov = [sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.diag(reduce(np.add, (n[c] * cov[c] for c in (0, 1))) / n.sum())) + 1e-4 * np.eye(d)
    classes = []
    for c in (0, 1):
        lower = np.linalg.cholesky((1 - shrink) * cov[c] + shrink * pooled)
        classes.append((means[c], np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum())))
    return float(np.log(n[1] / n[0])), classes


def log_odds(x: np.ndarray, prior: float, classes: list) -> np.ndarray:
    odds = np.full(len(x), prior)
    for sign, (mean, inverse, logdet) in zip((-1, 1), classes, strict=False):
        odds += sign * -0.5 * ((((x - mean) @ inverse.T) ** 2).sum(1) + logdet)
    return np.clip(odds, -700, 700)


def _losses(models: list):
    """Log-losses of each model (fitted on one half) on the rows of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(models))
        for batch in batches:
            half, y, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
            for k, (of, prior, classes) in enumerate(models):
                other = half != of
                loss[k] += np.logaddexp(0, np.where(y[other] == 1, -1, 1) * np.clip(log_odds(x[other], prior, classes), -30, 30)).sum()
        yield pa.record_batch({"i": np.arange(len(models)), "v": loss})

    return run


def _added_up(rows: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in rows.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def fit(labelled: DataFrame, shrinks: tuple[float, ...] = SHRINKS) -> tuple[float, list[tuple[np.ndarray, np.ndarray, float]]]:
    """The discriminant of ``labelled`` (half 0 or 1, quality 0 or 1, x).  The driver gets sums of fixed number."""
    d = len(FEATURES)
    rows = labelled.select("half", "quality", "x")
    sums = _added_up(rows.mapInArrow(_moments, "i long, v double"), 4 * (1 + d + d * d)).reshape(2, 2, -1)
    models = [(h, *discriminant(sums[h], s)) for s in shrinks for h in (0, 1)]
    best = shrinks[0]
    if len(shrinks) > 1 and all(classes for _, _, classes in models):
        losses = _added_up(rows.mapInArrow(_losses(models), "i long, v double"), len(models)).reshape(-1, 2).sum(1)
        best = shrinks[int(losses.argmin())]
    return discriminant(sums.sum(0), best)


def _scored(prior: float, classes: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = log_odds(_matrix(batch.column(1)), prior, classes)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-odds)))], ["id", "score"])

    return run


def _kept(prior: float, classes: list, at: int):
    score = _scored(prior, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["id", "text"])
            scores = np.concatenate([np.zeros(0), *[s.column(1).to_numpy() for s in score(_statistics([pair]))]])
            yield batch.filter(pa.array(scores >= 0.5))

    return run


def _model(docs: DataFrame, labels: DataFrame, id_col: str, shrinks: tuple[float, ...]) -> tuple[DataFrame, tuple]:
    """Statistics of all documents (id, text), and the model fitted on the training rows."""
    stats = stored(docs.mapInArrow(_statistics, "id long, x array<double>"))
    known = labels.where("quality in (0, 1)").select(F.col(id_col).cast("long").alias("id"), "quality").where(~_out_of_fit())
    return stats, fit(stats.join(known, "id").withColumn("half", F.crc32(F.concat(F.col("id").cast("string"), F.lit("half")).cast("binary")) % 2), shrinks)


def _out_of_fit():
    return F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", shrinks: tuple[float, ...] = SHRINKS) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of 0.5 or more; scoring moves no text."""
    _, model = _model(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), labels, id_col, shrinks)
    return docs.mapInArrow(_kept(*model, docs.columns.index(text_col)), docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", shrinks: tuple[float, ...] = SHRINKS) -> DataFrame:
    """(id, held_out, score, predicted); rows with crc32(id) mod 3 = 1 are held out of the fit."""
    stats, (prior, classes) = _model(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), labels, id_col, shrinks)
    scored = stats.mapInArrow(_scored(prior, classes), "id long, score double")
    return scored.select(F.col("id").alias(id_col), _out_of_fit().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
