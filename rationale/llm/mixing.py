"""Mixing sources to target weights by iterative proportional fitting.

Every document falls into a cell: source, language, topic.  Cells start with
their words as weight and are raked: scaled in turn so that the sums of each
source, each language and each topic meet their targets, until all do.  The
raked weight of a cell over its words, times the words wanted, is the
probability with which its documents are sampled; a keyed hash of the id decides,
so the choice is the same on every run and every partitioning.  Where that asks
for more of a cell than there is, fewer words are wanted of all cells, so that
the targets are met with no probability above 1; a warning tells the share that
is left.  Another warns of targets that contradict each other, which no raking meets.

Topics come from which words occur together: a document's long words, hashed to
``TERMS`` groups, give a vector of damped counts of length 1; less the mean of its
language, and turned to the ``AXES`` directions in which all documents vary most
(principal components), the signs of its coordinates are its topic, one of 8.  A
first pass over the texts adds up the vectors and their products, a second turns them;
no vector leaves its task.
Without words, or with a single document, that is topic 0 or the last.  Targets default to the corpus's own shares
raised to ``TEMPER`` and normalised, which lifts small sources and languages.

Scale.  Two passes over the texts, of which sums and numbers remain; raking adds up a
table of cells by windows, one row a cell, and never leaves Spark.  A source with a third of all rows is a few cells.  Null sources
and languages are groups of their own; null texts have no words, topic 0, and
are sampled with their cell.  Repeated rows share their fate; without an id the
text's hash decides.  No rows: no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .session import stored
from .text import Words, slices

TERMS, AXES = 64, 3
LONG_WORD = 5
TEMPER = 0.8
SHARE = 0.7  # of all words, to be kept
SWEEPS = 3  # rounds of one job
STALLED = 0.999  # a job that leaves the sums as far off as this share of before ends the raking
TOLERANCE = 1e-4
DIMENSIONS = ("source", "lang", "topic")


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and damped counts of word groups, of length 1, for each text, a slice at a time."""
    for _, _, data, offsets in slices(column):
        words = Words(data, offsets, fold=True)
        long = words.ends - words.starts >= LONG_WORD
        group = words.text * TERMS + (words.codes % np.uint64(TERMS)).astype(np.int64)
        damped = np.log1p(np.bincount(group[long], minlength=len(words.counts) * TERMS).reshape(-1, TERMS))
        yield words.counts, damped / np.maximum(np.sqrt(np.square(damped).sum(1, keepdims=True)), 1e-9)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sum of the vectors of each language, and under place -1 - i the sums of their products; of a task, as (lang, place, value)."""
    of_lang: dict[str | None, np.ndarray] = {}
    products = np.zeros((TERMS, TERMS))
    for batch in batches:
        langs, at = batch.column(0).to_pylist(), 0
        for _, x in _vectors(batch.column(1)):
            products += x.T @ x
            mine = langs[at : at + len(x)]
            at += len(x)
            for lang in set(mine):
                own = x[[k == lang for k in mine]]
                of_lang.setdefault(lang, np.zeros(TERMS + 1))
                of_lang[lang] += np.append(own.sum(0), len(own))
    place = np.concatenate([*[np.arange(TERMS + 1)] * len(of_lang), -1 - np.arange(products.size)])
    names = [k for k in of_lang for _ in range(TERMS + 1)] + [None] * products.size
    yield pa.record_batch({"r_lang": pa.array(names, pa.string()), "place": pa.array(place, pa.int64()), "value": np.concatenate([*of_lang.values(), products.ravel()])})


def _of_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the languages' means add to the sums of products."""
    out, n = np.zeros((TERMS, TERMS)), 0.0
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, TERMS + 1)
        out += (x[:, :-1] / x[:, -1:]).T @ x[:, :-1]
        n += x[:, -1].sum()
    yield pa.record_batch({"place": np.arange(out.size + 1), "value": np.append(out.ravel(), n)})


def main_axes(texts: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The ``AXES`` directions of most variation within languages, and (r_lang, r_mean); the driver gets sums of fixed number."""
    sums = stored(texts.select("r_lang", "r_text").mapInArrow(_sums, "r_lang string, place long, value double").groupBy("r_lang", "place").agg(F.sum("value").alias("value")))
    langs = stored(sums.where("place >= 0").groupBy("r_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]).alias("r_sums")))
    products = np.zeros(TERMS * TERMS)
    for r in sums.where("place < 0").collect():
        products[-1 - r.place] = r.value
    of_means = np.zeros(TERMS * TERMS + 1)
    for r in langs.select("r_sums").mapInArrow(_of_means, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        of_means[r.place] = r.value
    axes = np.linalg.eigh((products - of_means[:-1]).reshape(TERMS, TERMS))[1][:, : -AXES - 1 : -1]
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) >= 0, 1, -1)  # an axis has no direction of its own
    if of_means[-1] < 2:
        axes = np.zeros((TERMS, AXES))
    n = F.element_at("r_sums", TERMS + 1)
    return axes, langs.select("r_lang", F.transform(F.slice("r_sums", 1, TERMS), lambda v: v / n).alias("r_mean"))


def _measure(axes: np.ndarray):
    """Words and coordinates in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n, places = [np.zeros(0, np.int64)], [np.zeros((0, AXES))]
            for counts, x in _vectors(batch.column(names.index("r_text"))):
                n.append(counts)
                places.append(x @ axes)
            rest = {k: batch.column(i) for i, k in enumerate(names) if k != "r_text"}
            at = np.concatenate(places)
            yield pa.record_batch({**rest, "r_words": np.concatenate(n).astype(np.int64), **{f"r_y{k}": at[:, k] for k in range(AXES)}})

    return run


def with_topics(named: DataFrame) -> DataFrame:
    """``r_words`` and ``r_topic`` (text) in place of ``r_text``: signs along the axes, less the mean of the language."""
    axes, means = main_axes(named)
    added = StructType.fromDDL("r_words long, " + ", ".join(f"r_y{k} double" for k in range(AXES)))
    measured = named.mapInArrow(_measure(axes), StructType([*(f for f in named.schema.fields if f.name != "r_text"), *added.fields]))
    start = [sum((F.get("r_mean", F.lit(i)) * float(axes[i, k]) for i in range(TERMS)), F.lit(0.0)).alias(f"r_m{k}") for k in range(AXES)]
    placed = measured.join(means.select(F.col("r_lang").alias("r_of"), *start), F.col("r_lang").eqNullSafe(F.col("r_of")))
    topic = sum((F.when(F.col(f"r_y{k}") - F.col(f"r_m{k}") > 0, 1 << k).otherwise(0) for k in range(AXES)), F.lit(0)).cast("string")
    return placed.withColumn("r_topic", topic).drop("r_of", *[f"r_{x}{k}" for x in "ym" for k in range(AXES)])


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """Targets of one dimension: its own shares to the power ``temper``, normalised."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("w"), F.lit(temper)).alias("share"))
    return sums.join(F.broadcast(sums.agg(F.sum("share").alias("of"))), how="inner").select(dimension, (F.col("share") / F.col("of")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dimensions..., w) with w scaled until the sums over each dimension are its target shares.

    Targets of values without cells are left out and the rest normalised.  Raking
    goes on while it brings the sums closer (or for ``rounds``): targets that
    contradict each other where cells are missing are never met, and a warning
    tells by how much.
    """
    dimensions = list(targets)
    for d, target in targets.items():
        there = target.join(cells.where("w > 0").select(d).distinct(), d)
        there = stored(there.join(F.broadcast(there.agg(F.sum("share").alias("of"))), how="inner").select(d, (F.col("share") / F.col("of")).alias(f"x_{d}")))
        cells = cells.join(there, d, "left")
    done, before = 0, None
    while True:
        for _ in range(min(SWEEPS, rounds - done) if rounds else SWEEPS):
            off = F.lit(0.0)
            for d in dimensions:  # one row a cell
                factor = F.coalesce(F.col(f"x_{d}") / F.sum("w").over(Window.partitionBy(d)), F.lit(0.0))
                cells = cells.withColumn(f"f_{d}", F.when(F.col("w") > 0, factor).otherwise(0.0)).withColumn("w", F.col("w") * F.col(f"f_{d}"))
                off = F.greatest(off, F.when(F.col("w") > 0, F.abs(F.col(f"f_{d}") - 1)).otherwise(0.0))
            cells = cells.withColumn("off", off).drop(*[f"f_{d}" for d in dimensions])
            done += 1
        cells = stored(cells)
        worst = cells.agg(F.max("off")).first()[0]
        cells = cells.drop("off")
        if worst is None or worst < tolerance:
            break
        if done == rounds or (before is not None and worst > STALLED * before):
            warnings.warn(f"raking ended after {done} rounds with sums off their targets by up to {worst:.2g} of them", stacklevel=2)
            break
        before = worst
    return cells.drop(*[f"x_{d}" for d in dimensions])


def words_wanted(raked: DataFrame, most: float) -> float:
    """``most`` words, or as many as can be had with no cell asked for more than its words."""
    least = raked.where("w > 0").agg(F.min(F.col("words") / F.col("w"))).first()[0]
    if least is None or least >= most:
        return most
    warnings.warn(f"targets can be met with {least / most:.3f} of the words wanted", stacklevel=2)
    return least


def mixed(docs: DataFrame, share: float = SHARE, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: id, carried columns, source, lang, topic, n_words, probability, sampled.

    ``targets`` may give (value, share) tables by dimension, under the names source, lang and topic.
    """
    named = docs.select(F.col(id_col).alias("r_0"), *[F.col(c).alias(f"r_c{i}") for i, c in enumerate(carry)], F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("r_key"), F.col(source_col).cast("string").alias("r_source"), F.col(lang_col).cast("string").alias("r_lang"), F.col(text_col).alias("r_text"))
    measured = stored(with_topics(named))
    keyed = measured.select("*", *[F.coalesce(f"r_{d}", F.lit("\x00")).alias(d) for d in DIMENSIONS])
    cells = stored(keyed.groupBy(*DIMENSIONS).agg(F.sum("r_words").cast("double").alias("words")))
    total = cells.agg(F.sum("words")).first()[0] or 1.0
    start = cells.withColumn("w", F.col("words") / max(total, 1.0))
    wanted = {d: tempered(start, d, temper) for d in DIMENSIONS} | (targets or {})
    raked = rake(start, wanted)
    chance = raked.select(*DIMENSIONS, F.when(F.col("words") > 0, F.least(F.lit(1.0), words_wanted(raked, share * total) * F.col("w") / F.col("words"))).otherwise(F.lit(float(share))).alias("probability"))
    placed = keyed.join(chance, list(DIMENSIONS))
    draw = F.pmod(F.xxhash64(F.lit("mixing"), "r_0", "r_key"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return placed.select(F.col("r_0").alias(id_col), *[F.col(f"r_c{i}").alias(c) for i, c in enumerate(carry)], F.col("r_source").alias("source" if "source" not in carry else "mix_source"), F.col("r_lang").alias("lang" if "lang" not in carry else "mix_lang"), F.col("r_topic").cast("int").alias("topic"), F.col("r_words").alias("n_words"), "probability", (draw < F.col("probability")).alias("sampled"))
