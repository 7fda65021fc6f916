"""Operator 3: repeated word windows found by level-wise doubling.

To find the windows of ``min_words`` words that occur in another document, the
lengths ``min_words``, its half, the half's half and so on down to at most
``FIRST`` words are taken from below.  At each length the windows that start in
more than one document survive; only where two overlapping survivors make up a
window of twice the length (at most ``min_words``) is that window a candidate
of the next level.  When no candidate survives, the later levels are empty.

Levels below the last are filters and go by the leading bits of a window's
hash: few enough to be cheap to shuffle, and enough that under 1 % of different
windows look alike.  The last level goes by all 64 bits and by the bucket's
range.  Chunks send a window once with its smallest doc_id, so a passage held
by a third of all documents is one entry for each chunk.

Defined results: words are compared unchanged.  A null text has no words (the
digest is that of the empty text).  A null doc_id counts as larger than any
other; rows that share a doc_id never remove words from each other by that id
alone.  Empty tables give no rows, extra columns are ignored.  Whole texts are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _chunks as C
from . import _text
from ._spark import lean, materialise, release, table

MIN_WORDS = 13
FIRST = 8

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def levels(min_words: int, first: int = FIRST) -> list[int]:
    """Window lengths from below, each at most twice the one before."""
    out = [min_words]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


class Windows:
    """A chunk's words and window hashes."""

    def __init__(self, row: dict):
        self.ids, self.none, self.data, self.offs = C.unpack(row)
        # places in the order of ids, null last; equal ids share one
        order = np.lexsort((self.ids, self.none))
        ids, none = self.ids[order], self.none[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
        self.rank = np.empty(len(ids), np.int64)
        self.rank[order] = np.cumsum(new) - 1
        self.by_rank = ids[new], none[new]
        self.starts, self.ends, self.doc = _text.words(self.data, self.offs)
        self.h = _text.word_hashes(self.data, self.starts, self.ends)

    def keys(self, length: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of ``length`` words that are candidates."""
        h, valid = _text.window_hashes(self.h, self.doc, length)
        if alive is not None:
            shift = length - alive[1]
            valid &= alive[0][: len(valid)] & alive[0][shift : shift + len(valid)]
        at = np.flatnonzero(valid)
        return at, h[at]


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sorted keys, the smallest and largest of their documents' ranks, each entry's place among them)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        e = np.zeros(0, np.int64)
        return k, e, e, e
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    own = ids[order]
    return k[first], np.minimum.reduceat(own, first), np.maximum.reduceat(own, first), place


def _send(chunk: int, w: Windows, at: np.ndarray, keys: np.ndarray, bits: int | None, n: int) -> list:
    if bits is not None:  # a filter: leading bits and whether two documents of the chunk hold the window
        k, lo, hi, _ = _distinct(C.lead(keys, bits), w.rank[w.doc[at]])
        several = lo != hi
        return C.send(chunk, k << np.uint64(64 - bits), n, lambda part, own: C.join_blobs(C.steps(C.lead(part, bits)), np.packbits(several[own]).tobytes()))
    k, lo, _, _ = _distinct(keys, w.rank[w.doc[at]])
    ids, none = w.by_rank
    return C.send(chunk, k, n, lambda part, own: C.join_blobs(C.steps(part), C.squeeze(ids[lo[own]]), C.squeeze(np.packbits(none[lo[own]]))))


def _repeated(t: pa.Table) -> pa.Table:
    """Filter levels: for each key of each chunk whether another document holds it."""
    blobs = [C.split_blobs(b) for b in t.column("blob").to_pylist()]
    keys = [C.unsteps(b[0]) for b in blobs]
    flat = np.concatenate(keys)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = np.concatenate([np.unpackbits(np.frombuffer(b[1], np.uint8), count=len(k)) for b, k in zip(blobs, keys)])
    hit = (count > 1) | (np.bincount(place, weights=several, minlength=len(count)) > 0)
    return _reply(t, keys, hit[place])


def _earlier(t: pa.Table) -> pa.Table:
    """The last level: whether a document of another chunk has a smaller id than the chunk's smallest."""
    blobs = [C.split_blobs(b) for b in t.column("blob").to_pylist()]
    keys = [C.unsteps(b[0]) for b in blobs]
    own = np.concatenate([C.expand(b[1], np.int64) for b in blobs])
    none = np.concatenate([np.unpackbits(C.expand(b[2], np.uint8), count=len(k)) for b, k in zip(blobs, keys)])
    own = np.where(none, np.iinfo(np.int64).max, own)  # null last: after the largest id, too
    flat = np.concatenate(keys)
    order = np.lexsort((none, own, flat))
    k = flat[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    at = order[np.flatnonzero(first)][np.cumsum(first) - 1]  # for each entry the one that comes first of its key
    later = np.empty(len(flat), bool)
    later[order] = (own[at] < own[order]) | (none[at] < none[order])
    return _reply(t, keys, later)


def _reply(t: pa.Table, keys: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    blobs = [C.squeeze(np.packbits(flags[a:b])) for a, b in zip(cut, cut[1:])]
    return pa.table([t.column("chunk"), t.column("bucket"), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "blob"])


def _flags(replies: dict[int, bytes], k: np.ndarray, n: int) -> np.ndarray:
    """The replies to sorted distinct keys, in their order."""
    out = np.zeros(len(k), bool)
    for b, own in C.ranges(k, n):
        out[own] = np.unpackbits(C.expand(replies[b], np.uint8), count=own.stop - own.start)
    return out


def _alive(w: Windows, length: int, before, replies: dict[int, bytes], bits: int, n: int) -> np.ndarray:
    """Word places where a window of ``length`` words survives its level."""
    at, keys = w.keys(length, before)
    k, _, _, place = _distinct(C.lead(keys, bits), w.rank[w.doc[at]])
    out = np.zeros(len(w.h), bool)
    out[at] = _flags(replies, k << np.uint64(64 - bits), n)[place]
    return out


def _state(blobs: dict[int, bytes], length: int, words: int):
    """What survived the level before, as sent by the step before."""
    return (np.unpackbits(C.expand(blobs[-1], np.uint8), count=words).astype(bool), length) if blobs else None


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its words, those removed, and the digest of the rest."""
    chunks = C.make(docs, "chunks", id_col, text_col)
    n, bits, lengths = C.buckets(chunks), C.filter_bits(chunks), levels(min_words)
    last = len(lengths) - 1

    def level_bits(k: int) -> int | None:
        return None if k == last else bits

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = Windows(row)
                yield C.sent_batch(_send(row["chunk"], w, *w.keys(lengths[0], None), level_bits(0), n))

    def advance(k: int):
        """From the replies at level k: the survivors (bucket -1) and the next level's keys."""

        def run(t: pa.Table) -> pa.Table:
            chunk, row, (state, replies) = C.group(t, 2)
            w = Windows(row)
            alive = _alive(w, lengths[k], _state(state, lengths[k - 1], len(w.h)), replies, bits, n)
            rows = _send(chunk, w, *w.keys(lengths[k + 1], (alive, lengths[k])), level_bits(k + 1), n)
            return C.sent_table([(chunk, -1, C.squeeze(np.packbits(alive))), *rows])

        return run

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = Windows(row)
                yield from _result(w, np.zeros(len(w.h), bool)).to_batches()

    def finish(t: pa.Table) -> pa.Table:
        _, row, (state, replies) = C.group(t, 2)
        w = Windows(row)
        at, keys = w.keys(min_words, _state(state, lengths[last - 1], len(w.h)) if last else None)
        k, least, _, place = _distinct(keys, w.rank[w.doc[at]])
        hit = at[_flags(replies, k, n)[place] | (w.rank[w.doc[at]] > least[place])]
        cover = np.zeros(len(w.h) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.subtract.at(cover, hit + min_words, 1)
        return _result(w, np.cumsum(cover[:-1]) > 0)

    sent = chunks.mapInArrow(lean(begin), C.SENT)
    state = None
    for k in range(last):
        reply = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_repeated, C.SENT)
        none = reply.limit(0) if state is None else state
        sent = materialise(C.by_chunk(chunks, none, reply).groupBy("chunk").applyInArrow(advance(k), C.SENT), "windows", "uncompressed")
        state = sent.where("bucket < 0")
        release()
        if sent.where("bucket >= 0").isEmpty():  # no candidate survives
            return chunks.mapInArrow(lean(untouched), RESULT)
    reply = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_earlier, C.SENT)
    return C.by_chunk(chunks, reply.limit(0) if state is None else state, reply).groupBy("chunk").applyInArrow(finish, RESULT)


def _result(w: Windows, removed: np.ndarray) -> pa.Table:
    n = len(w.ids)
    total = np.bincount(w.doc, minlength=n)
    gone = np.bincount(w.doc[removed], minlength=n)
    s, e, d = w.starts[~removed], w.ends[~removed], w.doc[~removed]
    sizes = e - s + 1  # with the blank after the word
    ends = np.cumsum(sizes)
    src = np.repeat(s - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    text = w.data[np.minimum(src, max(len(w.data) - 1, 0))]
    text[ends - 1] = 32
    raw = text.tobytes()
    cut = np.concatenate([[0], ends])[np.searchsorted(d, np.arange(n + 1))]
    digests = [hashlib.sha256(raw[cut[k] : max(cut[k], cut[k + 1] - 1)]).hexdigest() for k in range(n)]
    ids = pa.array(w.ids, mask=w.none)
    return pa.table([ids, pa.array(total.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array(digests)], names=RESULT.names)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substrings": op3_substrings}
ORACLES = {
    # each document's words as a list; windows as their words joined by a character that is in none
    "op3_substrings": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        i AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM d WHERE len(w) >= {MIN_WORDS}),
        k AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS doc_id, i, sha256(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) AS k FROM i),
        m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
        c AS (SELECT DISTINCT rid, unnest(range(i, i + {MIN_WORDS})) AS p FROM k JOIN m USING (k) WHERE least < doc_id),
        g AS (SELECT rid, list(p) AS gone FROM c GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, j: NOT coalesce(list_contains(gone, j), false)), ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (rid)
    """
}
