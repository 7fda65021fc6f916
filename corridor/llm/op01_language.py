"""Operator 1: language identification by a byte convolutional network.

Filters of widths 2, 3 and 4 over learned byte vectors, the maximum of each
filter over a window of 256 bytes, and a softmax; trained here with numpy (Adam)
on labelled windows.  A whole text is cut into windows, and its languages'
probabilities are the windows' means weighted by their bytes.

For application the filters become tables: a filter's answer at a place is the
sum of table rows for the byte pairs it covers, so a byte costs a few look-ups.

Training reads only text and non-null lang of the documents that the fold
leaves in.  ``SAMPLE`` bounds the training windows; they are those with the
smallest hashes over all labelled documents, so any input size is treated alike.

Defined results: a null text or one without a letter is ``und`` with score 0;
without any labelled window every text is ``und``.  Null and repeated ids keep
their rows.  An empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import lean, table

LENGTH = 256  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
SAMPLE = 16_000  # training windows
PER_DOC = 4  # training windows of one document at most
STEPS = 1500  # of the optimiser, whatever the sample's size
BATCH = 64
SEED = 7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_LOWER == 0] = 32  # 0 fills short windows

WINDOWS = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("lang", T.StringType()), T.StructField("order", T.LongType())])
PREDICTIONS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x LENGTH bytes, their document, their bytes): every byte of every text is in one."""
    sizes = np.diff(offs)
    counts = -(-sizes // LENGTH)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(first[-1]) * LENGTH, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * LENGTH - offs[:-1], sizes)] = _LOWER[data]
    doc = np.repeat(np.arange(len(sizes)), counts)
    rank = np.arange(len(doc)) - first[doc]
    return flat.reshape(-1, LENGTH), doc, np.minimum(LENGTH, sizes[doc] - rank * LENGTH)


class Network:
    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": rng.normal(0, 0.3, (256, DIM))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes)))
        self.p["bias"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        p, emb = self.p, self.p["emb"][x]
        rows, pooled, tops = np.arange(len(x))[:, None], [], []
        for w in WIDTHS:
            n = LENGTH - w + 1
            out = sum(emb[:, j : j + n] @ p[f"w{w}"][j] for j in range(w)) + p[f"b{w}"]
            top = out.argmax(axis=1)
            tops.append(top)
            pooled.append(np.take_along_axis(out, top[:, None, :], 1)[:, 0])
        z = np.concatenate(pooled, 1)
        h = np.maximum(z, 0)
        logit = h @ p["out"] + p["bias"]
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        d = prob
        d[np.arange(len(x)), y] -= 1
        d /= len(x)
        g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dz = (d @ p["out"].T) * (z > 0)
        for k, w in enumerate(WIDTHS):
            own, top = dz[:, k * FILTERS : (k + 1) * FILTERS], tops[k]
            g[f"b{w}"] = own.sum(0)
            gw = np.empty_like(p[f"w{w}"])
            for j in range(w):
                gw[j] = np.einsum("bfd,bf->df", emb[rows, top + j], own)
                np.add.at(g["emb"], x[rows, top + j], own[..., None] * p[f"w{w}"][j].T)
            g[f"w{w}"] = gw
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 4e-3, seed: int = SEED) -> Network:
        rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(len(x))])
            own, order = order[:BATCH], order[BATCH:]
            for k, g in self.step(x[own], y[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= rate * 0.05 ** (t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        return self

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the rows of its first byte pair and of its other byte or pair."""
        p, out = self.p, []
        for w in WIDTHS:
            tap = [p["emb"] @ p[f"w{w}"][j] for j in range(w)]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            out.append((pair(tap[0] + p[f"b{w}"], tap[1]), None if w == 2 else tap[2] if w == 3 else pair(tap[2], tap[3])))
        return out

    def predict(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Probabilities of the classes for every window."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        for lo in range(0, len(x), 64):
            part = x[lo : lo + 64].astype(np.int64)
            pair = part[:, :-1] * 256 + part[:, 1:]
            z = []
            for w, (first, rest) in zip(WIDTHS, tables):
                n = LENGTH - w + 1
                c = first.take(pair[:, :n], axis=0)
                if w == 3:
                    c += rest.take(part[:, 2:], axis=0)
                elif w == 4:
                    c += rest.take(pair[:, 2:], axis=0)
                z.append(c.max(axis=1))
            logit = np.maximum(np.concatenate(z, 1), 0) @ self.p["out"] + self.p["bias"]
            e = np.exp(logit - logit.max(1, keepdims=True))
            out[lo : lo + 64] = e / e.sum(1, keepdims=True)
        return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = _text.buffers(batch.column("text"))
        rows = []
        for lo, hi in _text.slices(offs):
            own = offs[lo : hi + 1]
            x, doc, size = windows(data[own[0] : own[-1]], own - own[0])
            if not len(x):
                continue
            # hashes of the windows' bytes: the same at any partitioning, and equal windows tie harmlessly
            h = _text.mix((x.view("<u8") * (2 * np.arange(LENGTH // 8, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))).sum(1, dtype=np.uint64))
            order = np.lexsort((h, doc))
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)[order]
            for k in order[rank < PER_DOC]:
                if size[k] >= LENGTH // 4 or size[k] == own[doc[k] + 1] - own[doc[k]]:
                    rows.append((x[k].tobytes(), batch.column("lang")[lo + int(doc[k])].as_py(), int(h[k] >> np.uint64(1))))
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64()))], names=WINDOWS.names)


def train(labelled: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Network | None:
    """Fit on at most ``sample`` windows of (text, lang) rows with both present."""
    fit = labelled.where("text is not null and lang is not null").select("text", "lang")
    # every text has a window or more; hashes beyond this share of their range cannot be among the smallest, and need not travel
    least = int(2**63 * min(1.0, 2 * sample / max(1, fit.count()))) - 1
    rows = fit.mapInArrow(lean(_sample), WINDOWS).where(F.col("order") <= least)
    got = rows.orderBy("order", "lang", "window").limit(sample).collect()
    classes = sorted({r["lang"] for r in got})
    if not classes:
        return None
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in got), np.uint8).reshape(-1, LENGTH)
    y = np.array([classes.index(r["lang"]) for r in got])
    return Network(classes).fit(x, y, steps)


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = (_LOWER[data] >= 97) & (_LOWER[data] <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offs[1:]] > total[offs[:-1]]
    for k in np.flatnonzero(~out):
        if offs[k + 1] > offs[k]:
            out[k] = any(map(str.isalpha, data[offs[k] : offs[k + 1]].tobytes().decode()))
    return out


def classify(net: Network | None, tables: list | None, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of every text of a slice."""
    n = len(offs) - 1
    lang, score = np.full(n, "und", object), np.zeros(n)
    known = _has_letter(data, offs) if net else np.zeros(n, bool)
    if known.any():
        x, doc, size = windows(data, offs)
        prob = net.predict(x, tables) * size[:, None]
        total = np.zeros((n, len(net.classes)))
        np.add.at(total, doc, prob)
        total /= np.maximum(1, np.diff(offs))[:, None]
        lang[known] = np.array(net.classes, object)[total[known].argmax(1)]
        score[known] = np.clip(total[known].max(1), 0, 1)
    return lang, score


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            data, offs = _text.buffers(batch.column("text"))
            for lo, hi in _text.slices(offs, 1 << 20):
                lang, score = classify(net, tables, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], names=PREDICTIONS.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), PREDICTIONS)


def accept(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language, that is a letter, with all their columns and no shuffle; a network is not needed for it."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            data, offs = _text.buffers(batch.column(place))
            for lo, hi in _text.slices(offs, 1 << 20):
                part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                keep = classify(net, tables, part, own)[0] != "und" if net else _has_letter(part, own)
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def fold(id_col: str = "doc_id") -> F.Column:
    """True for the held-out quarter of documents; a null id is held out as well."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = train(docs.where(~fold()))
    return identify(docs, network).withColumn("held_out", fold()).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
