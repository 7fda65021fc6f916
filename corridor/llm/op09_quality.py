"""Operator 9: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (neither toxic nor good) and 2 (good).  One weight per
hashed feature is shared by all grades, and ordered thresholds cut the score:
P(grade <= k) = sigmoid(threshold_k - w . x).  Features are lower-cased words
without the marks around them, and the shape of each word (capitals, a bar, an
exclamation mark), over the whole text: a word counts as present, a shape by the
root of its share.  Only features whose mean grade in the sample lies at least
``SCREEN`` standard errors from the overall mean have a weight; the others
would be learnt by heart.

Training takes at most ``SAMPLE`` labelled rows, those with the smallest hashes
of doc_id; documents for which ``held_out`` holds, ``HELD_OUT`` in 16, are never
trained on, so that grades can be held against their labels.

Defined results: a text that is null, empty or without a word has the grade
that the thresholds give to score 0.  Labels with a null, and documents without
a label, are not trained on; a doc_id labelled twice counts with each label.
Without any usable label every document has expected grade null, tail null and
``keep`` true.  Null and repeated ids keep their rows; empty tables give none;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import lean, table

SAMPLE = 12_000
BITS = 17
EPOCHS = 12
SCREEN = 4.0
HELD_OUT = 1  # sixteenths of the documents
TAIL = 1  # the tail is P(grade >= TAIL)
KEEP = 0.8  # documents with a tail of at least this are kept
SEED = 3

FEATURES = T.StructType([T.StructField("grade", T.IntegerType()), T.StructField("index", T.BinaryType()), T.StructField("value", T.BinaryType())])
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])

_EDGE = np.ones(256, bool)  # bytes that are no mark: letters, digits and everything beyond ASCII
_EDGE[:48] = _EDGE[58:65] = _EDGE[91:97] = _EDGE[123:128] = False


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) triples, one per distinct feature of a document."""
    starts, ends, doc = _text.words(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    bang, bar = (np.concatenate([[0], np.cumsum(data == c)]) for c in (33, 124))
    shape = ((upper[ends] - upper[starts] > 1) * 1 + (bang[ends] > bang[starts]) * 2 + (bar[ends] > bar[starts]) * 4).astype(np.int64)
    s, e = starts.copy(), ends.copy()
    for _ in range(3):  # marks around a word: at most three on a side are taken off
        s += (s < e - 1) & ~_EDGE[data[s]]
        e -= (e - 1 > s) & ~_EDGE[data[e - 1]]
    clean = np.where(_edge_mask(data, s, e), data, 32)
    h = _text.word_hashes(clean, s, e, lower=True)
    word = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
    space = 1 << BITS
    n = len(offs) - 1
    key = np.concatenate([doc * (space + 8) + word, doc * (space + 8) + space + shape])
    key, count = np.unique(key, return_counts=True)
    d, f = key // (space + 8), key % (space + 8)
    words = np.bincount(doc, minlength=n)
    return d, f, np.where(f < space, 1.0, np.sqrt(count / words[d]))


def _edge_mask(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """True inside the trimmed words."""
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, s, 1)
    np.subtract.at(step, e, 1)
    return np.cumsum(step[:-1]) > 0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, margin: np.ndarray, tail: int = TAIL) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= tail))."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None] - margin[:, None], -40, 40)))
        return above.sum(1), above[:, tail - 1]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int = EPOCHS, seed: int = SEED, decay: float = 1e-4, screen: float = SCREEN) -> Model:
    """Adagrad on the likelihood; thresholds are a first one and positive gaps, so they stay in order."""
    rng = np.random.default_rng(seed)
    w, gw = np.zeros((1 << BITS) + 8, np.float32), np.full((1 << BITS) + 8, 1e-2, np.float32)
    y = np.array([r[0] for r in rows])
    every, times = np.concatenate([r[1] for r in rows]), [len(r[1]) for r in rows]
    n = np.bincount(every, minlength=len(w))
    off = np.bincount(every, weights=np.repeat(y - y.mean(), times), minlength=len(w))
    seen = np.abs(off) >= screen * max(y.std(), 1e-9) * np.sqrt(np.maximum(n, 1))
    seen[1 << BITS :] = True
    rows = [(g, f[seen[f]], v[seen[f]]) for g, f, v in rows]
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 0.01, 0.99)
    t = np.maximum.accumulate(np.log(share / (1 - share)))
    first, gaps = t[0], np.log(np.maximum(np.diff(t), 0.1))
    gt = np.full(grades - 1, 1e-1)
    weight = len(y) / (grades * np.maximum(1, np.bincount(y, minlength=grades)))
    weight = np.sqrt(weight)  # rare grades count for more
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for epoch in range(epochs):
        for k in rng.permutation(len(rows)):
            grade, f, v = rows[k]
            cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            m = float(w[f] @ v)
            hi = sig(cuts[grade] - m) if grade < grades - 1 else 1.0
            lo = sig(cuts[grade - 1] - m) if grade else 0.0
            p = max(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of -log p: by the upper cut -dhi, by the lower +dlo
            g = (dhi - dlo) * weight[grade] * v + decay * w[f]
            gw[f] += g * g
            w[f] -= 0.3 * g / np.sqrt(gw[f])
            gc = np.zeros(grades - 1)
            if grade < grades - 1:
                gc[grade] -= dhi
            if grade:
                gc[grade - 1] += dlo
            gc *= weight[grade]
            gp = np.cumsum(gc[::-1])[::-1].copy()  # the first threshold moves all, a gap those above it
            gp[1:] *= np.exp(gaps)
            gt += gp * gp
            step = 0.1 * gp / np.sqrt(gt)
            first, gaps = first - step[0], gaps - step[1:]
    return Model(w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(SEED + 1)), F.lit(16)) < HELD_OUT


def grade() -> F.Column:
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = _text.buffers(batch.column("text"))
        grades, rows = batch.column("grade").to_pylist(), []
        for lo, hi in _text.slices(offs):
            d, f, v = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            cut = np.searchsorted(d, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                own = slice(cut[k], cut[k + 1])
                rows.append((grades[lo + k], f[own].astype("<i4").tobytes(), v[own].astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=FEATURES.names)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled rows; the labels' ids are bounded by it, so they are broadcast."""
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED))
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("label_id"), grade().alias("grade"), order.alias("o"))
    chosen = chosen.orderBy("o", "label_id", "grade").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    got = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "grade").mapInArrow(lean(_extract), FEATURES).collect()
    rows = sorted((r["grade"], bytes(r["index"]), bytes(r["value"])) for r in got)
    if not rows:
        return None
    return fit([(g, np.frombuffer(f, "<i4"), np.frombuffer(v, "<f4")) for g, f, v in rows], 3)


def score(docs: DataFrame, model: Model | None, tail: int = TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = _text.buffers(batch.column("text"))
            for lo, hi in _text.slices(offs):
                n = hi - lo
                if m is None:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names=SCORES.names)
                    continue
                d, f, v = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                expected, above = m.scores(np.bincount(d, weights=m.weights[f] * v, minlength=n), tail)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(expected), pa.array(above)], names=SCORES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCORES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("keep", F.coalesce(F.col("tail") >= KEEP, F.lit(True)))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
