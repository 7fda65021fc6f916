"""Operator 10: benchmark passages found by the q-gram lemma and banded alignment.

A passage is any ``WINDOW`` folded characters of a benchmark item, wherever in it
they start (the whole item if it is shorter), and it is found with at most
e = floor(RATE * m) edits, m being its length.  Such a window shares at least
m + 1 - q * (e + 1) q-grams with the text, all of them on at most e + 1
neighbouring diagonals.  So hits of an item's q-grams are counted in overlapping
diagonal bands of 2 (e + 1), the windows with enough hits in a band are
candidates, and each is aligned inside its band; only alignments within the
budget count.  So a verbatim quote of WINDOW - e = 92 folded characters is always
found, and a shorter one of an item of at least WINDOW characters only where more
of the text happens to agree.

Texts are compared in a folded form: A-Z in lower case, ASCII punctuation and
white space as one blank.  The benchmark is the stated query set: it is taken
in blocks of ``BLOCK_CHARS`` folded characters, each a small index that every
task gets, and a pass over the documents goes through all blocks with a slab of
texts at a time, holding one block.  Items longer than a block are cut into
parts that share all but the starts of their windows.

Repetitive text costs no more than other text: of windows of an item that are
the same only the first is looked for and stands for all, and in a document with
many more hits than characters only first occurrences of what a window can meet
are looked at.  Hits are expanded in bounded portions, also within a document.

Defined results: null or empty texts and items match nothing, nor do items
with under ``q`` folded characters.  A repeated doc_id is searched row by row.
Null ids stay null; items without an id are reported together, one row for a
document.  Empty tables give no rows; other columns are ignored.  Texts are
searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import lean, table

Q = 8
WINDOW = 100
RATE = 0.08
BLOCK_CHARS = 2 << 20
SLAB_BYTES = 16 << 20  # of texts that go through the blocks together
HITS_AT_ONCE = 2 << 20  # expanded hits held at a time
HEAVY = 32  # expanded hits a character from which a document is looked at for repeats
_FILTER_BITS = 20
_CELL_BITS = 17

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(48, 58):
    _FOLD[_c] = _c
for _c in range(97, 123):
    _FOLD[_c] = _c
    _FOLD[_c - 32] = _c

HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("windows", T.LongType()),  # starts in the item whose windows are found
        T.StructField("edits", T.LongType()),
    ]
)


def fold(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and offsets."""
    x = _FOLD[data]
    blank = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = offs[:-1][offs[:-1] < len(x)]
    keep[inner] = ~blank[inner]  # no blank at the start of a document
    total = np.zeros(len(x) + 1, np.int32 if len(x) < 2**31 else np.int64)
    np.cumsum(keep, out=total[1:])
    return x[keep], total[offs].astype(np.int64)


def grams(x: np.ndarray) -> np.ndarray:
    """The ``Q`` = 8 bytes from every position as one integer."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for r in range(min(Q, n)):
        count = (n - r + Q - 1) // Q
        out[r::Q] = np.frombuffer(x[r : r + count * Q].tobytes(), "<u8")
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    h = g * np.uint64(0x9E3779B97F4A7C15)
    h >>= np.uint64(64 - _FILTER_BITS)
    return h.view(np.int64)


_BYTE = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def same_windows(x: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` (at least Q) places how many are the same as it; 0 if one before it is."""
    n = len(x) - length + 1
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTE[x] * _powers(_BASE, len(x)), out=total[1:])
    _, first, place = np.unique((total[length:] - total[:n]) * _powers(_BACK, n), return_index=True, return_inverse=True)
    lead = first[place]
    again, g = np.flatnonzero(lead < np.arange(n)), grams(x)
    equal = np.ones(len(again), bool)
    for k in [*range(0, length - Q, Q), length - Q]:
        equal &= g[again + k] == g[lead[again] + k]
    lead[again[~equal]] = again[~equal]  # equal by hash alone: it stands for itself
    return np.bincount(lead, minlength=n)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie within ``width`` places from any start on."""
    step = np.zeros(n + width + 1, np.int32)
    np.add.at(step, starts, 1)
    np.subtract.at(step, starts + width, 1)
    return np.cumsum(step)[:n] > 0


@dataclass
class Index:
    """A block of items, or parts of them, and where each q-gram stands in them."""

    ids: list
    body: np.ndarray  # the folded parts one after the other
    base: np.ndarray  # where each begins
    sizes: np.ndarray
    length: np.ndarray  # of a part's windows
    edits: np.ndarray
    need: np.ndarray
    weight: np.ndarray  # for each place of body as a window's start: how many windows of its part are the same, 0 if one before is
    codes: np.ndarray  # sorted q-grams
    at: np.ndarray  # codes' ranges in item/pos
    item: np.ndarray
    pos: np.ndarray
    slots: np.ndarray

    @cached_property
    def text(self) -> list[np.ndarray]:
        """Every window."""
        return [self.body[b + s : b + s + m] for b, n, m in zip(self.base, self.sizes, self.length) for s in range(n - m + 1)]


def folded(body: str | None) -> np.ndarray:
    raw = np.frombuffer((body or "").encode(), np.uint8)
    x, _ = fold(raw, np.array([0, len(raw)]))
    return x[:-1] if len(x) and x[-1] == 32 else x


def cut(x: np.ndarray, most: int, window: int) -> Iterator[np.ndarray]:
    """Parts of at most ``most`` window starts; together they have every window once."""
    for at in range(0, max(1, len(x) - window + 1), most):
        yield x[at : at + most + window - 1]


def build(items: list[tuple], window: int = WINDOW, rate: float = RATE) -> Index | None:
    """``items`` are (id, text or folded bytes)."""
    ids, text = [], []
    for item, body in items:
        x = body if isinstance(body, np.ndarray) else folded(body)
        if len(x) >= Q:
            ids.append(item)
            text.append(x)
    if not text:
        return None
    sizes = np.array([len(x) for x in text])
    lengths = np.minimum(sizes, window)
    # the largest budget, up to the rate, that leaves the lemma something to count
    edits = np.minimum((rate * lengths).astype(int), np.maximum(0, (lengths + 1) // Q - 2))
    need = np.maximum(1, lengths + 1 - Q * (edits + 1))
    weight, g, p = [], [], []
    for x, m in zip(text, lengths):
        w = same_windows(x, int(m))
        at = np.flatnonzero(cover(np.flatnonzero(w), int(m) - Q + 1, len(x) - Q + 1))
        weight.append(np.concatenate([w, np.zeros(len(x) - len(w), w.dtype)]))
        g.append(grams(x)[at])
        p.append(at.astype(np.int32))
    own = np.repeat(np.arange(len(text), dtype=np.int32), [len(x) for x in p])
    g, p = np.concatenate(g), np.concatenate(p)
    order = np.argsort(g, kind="stable")
    codes, first = np.unique(g[order], return_index=True)
    slots = np.zeros(1 << _FILTER_BITS, bool)
    slots[_slot(codes)] = True
    return Index(ids, np.concatenate(text), np.cumsum(sizes) - sizes, sizes, lengths, edits, need, np.concatenate(weight).astype(np.int32), codes, np.append(first, len(g)), own[order], p[order], slots)


def banded(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edits of each row of ``patterns`` against any part of that row of ``texts``, on its diagonals.

    With m and m + d columns the d diagonals are those that begin in the first d characters.
    """
    rows, m = patterns.shape
    width = texts.shape[1] - m
    p, t = np.ascontiguousarray(patterns.T), np.ascontiguousarray(texts.T)
    step = np.arange(width, dtype=np.int16)[:, None]
    prev = np.zeros((width, rows), np.int16)
    for i in range(m):
        cur = prev + (t[i : i + width] != p[i])
        np.minimum(cur[:-1], prev[1:] + 1, out=cur[:-1])
        cur -= step
        for d in range(1, width):
            np.minimum(cur[d], cur[d - 1], out=cur[d])
        cur += step
        prev = cur
    return prev.min(axis=0)


def align(pattern: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edits of ``pattern`` against any part of each row of ``texts`` (255 pads), on all diagonals."""
    rows, m = len(texts), len(pattern)
    pad = np.full((rows, m), 255, np.uint8)
    return banded(np.broadcast_to(pattern, (rows, m)), np.concatenate([pad, texts, pad], axis=1))


def search(ix: Index, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, windows found, least edits) for one slice of documents."""
    x, offs = fold(data, offs)
    g = grams(x)
    if not len(g):
        return
    like = ix.slots[_slot(g)]
    # a region holds `need` hits in m + e - q + 1 places: keep only places in regions dense enough for the least demanding window
    span = int((ix.length + ix.edits).max())
    total = np.zeros(len(g) + span, np.int32)
    np.cumsum(like, out=total[1 : len(g) + 1])
    total[len(g) + 1 :] = total[len(g)]
    dense = np.flatnonzero(total[span:] - total[: len(g)] >= ix.need.min())
    if not len(dense):
        return
    # the places that dense regions cover: runs of starts less than a region apart are one
    new = np.flatnonzero(np.diff(dense, prepend=-span - 1) > span)
    first, last = dense[new], np.append(dense[new[1:] - 1], dense[-1]) + span
    hits = np.flatnonzero(like)
    run = np.searchsorted(first, hits, "right") - 1
    at = hits[(run >= 0) & (hits < last[np.maximum(run, 0)])]
    place = np.searchsorted(ix.codes, g[at])
    place[place == len(ix.codes)] = 0
    same = ix.codes[place] == g[at]
    at, place = at[same], place[same]
    if not len(at):
        return
    doc = np.searchsorted(offs, at, "right") - 1
    inside = at + Q <= offs[doc + 1]
    at, place, doc = at[inside], place[inside], doc[inside]
    at, place, doc = _lighter(ix, x, offs, at, place, doc)
    found = list(_regions(ix, x, offs, at, place, doc))
    if found:
        yield from _count(ix, np.concatenate(found))


def _lighter(ix: Index, x, offs, at, place, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the hits of heavy documents that lie in no first occurrence of what a window can meet."""
    total = np.bincount(doc, ix.at[place + 1] - ix.at[place], len(offs) - 1)
    sizes, reach = np.diff(offs), int((ix.length + ix.edits).max())
    keep = np.ones(len(at), bool)
    for d in np.flatnonzero((total > HEAVY * sizes) & (sizes > 2 * reach)):
        own = x[offs[d] : offs[d + 1]]
        starts = np.flatnonzero(same_windows(own, reach))
        near = cover(starts, reach - Q + 1, len(own))
        near[-reach:] = True  # what begins here is cut short by the end
        mine = slice(*np.searchsorted(doc, [d, d + 1]))
        keep[mine] = near[at[mine] - offs[d]]
    return at[keep], place[keep], doc[keep]


def _portions(ix: Index, at, place) -> Iterator[slice]:
    """Ranges of hits with a bounded number of expanded ones; each begins a window's reach of text before the last one's end."""
    many = np.cumsum(ix.at[place + 1] - ix.at[place])
    reach = int((ix.length + 4 * (ix.edits + 1)).max())
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + HITS_AT_ONCE, "right")))
        yield slice(int(np.searchsorted(at, at[lo] - reach)) if lo else 0, min(hi, len(at)))
        lo = hi


def _regions(ix: Index, x, offs, at, place, doc) -> Iterator[np.ndarray]:
    """Rows (document, part, start, edits) of the windows that align, some of them more than once."""
    shift_by = int(ix.sizes.max())  # makes diagonals not negative
    for part in _portions(ix, at, place):
        pl = place[part]
        sizes = ix.at[pl + 1] - ix.at[pl]
        ends = np.cumsum(sizes)
        src = np.repeat(ix.at[pl] - ends + sizes, sizes) + np.arange(int(ends[-1]))
        pos, own, ipos = np.repeat(at[part], sizes), ix.item[src].astype(np.int64), ix.pos[src].astype(np.int64)
        diag = pos - ipos + shift_by
        half = (ix.edits + 1)[own]
        kept = []
        for shift in (0, 1):
            key = (own << 40) | (diag + shift * half) // (2 * half)
            # hits by hashed band: a band cannot have more than its cell, so most hits end here, unsorted
            cell = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CELL_BITS)).view(np.int64)
            many = np.flatnonzero(np.bincount(cell, minlength=1 << _CELL_BITS)[cell] >= ix.need[own])
            if not len(many):
                continue
            k, ip = key[many], ipos[many]
            dd = np.searchsorted(offs, pos[many], "right") - 1
            order = np.lexsort((ip, dd, k))
            k, ip, dd = k[order], ip[order], dd[order]
            it = k >> 40
            last = np.arange(len(k)) + ix.need[it] - 1
            ok = last < len(k)
            last[~ok] = 0
            reach = ix.length[it] - Q  # from a window's first q-gram to its last
            ok &= (k[last] == k) & (dd[last] == dd) & (ip[last] - ip <= reach)
            k, dd, it = k[ok], dd[ok], it[ok]
            # the windows that hold these hits start in a..b; both rise inside a band, so each start is taken once
            a, b = np.maximum(ip[last[ok]] - reach[ok], 0), np.minimum(ip[ok], ix.sizes[it] - ix.length[it])
            again = (k[1:] == k[:-1]) & (dd[1:] == dd[:-1])
            a[1:] = np.where(again, np.maximum(a[1:], b[:-1] + 1), a[1:])
            n = np.maximum(b - a + 1, 0)
            starts = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            width = 2 * (ix.edits[it] + 1)
            low = (k & ((1 << 40) - 1)) * width - shift * (width // 2) - shift_by
            rows = np.stack([np.repeat(dd, n), np.repeat(it, n), starts, np.repeat(low, n)], 1)
            kept.append(rows[ix.weight[ix.base[rows[:, 1]] + starts] > 0])
        if not kept:
            continue
        cand = np.concatenate(kept)
        length = ix.length[cand[:, 1]]
        for m in np.unique(length):
            mine = cand[length == m]
            e = int(ix.edits[mine[0, 1]])
            for lo in range(0, len(mine), 4096):
                c = mine[lo : lo + 4096]
                pattern = ix.body[(ix.base[c[:, 1]] + c[:, 2])[:, None] + np.arange(m)]
                take = (c[:, 2] + c[:, 3] - e)[:, None] + np.arange(m + 2 * (e + 1) + 2 * e)
                inside = (take >= offs[c[:, 0]][:, None]) & (take < offs[c[:, 0] + 1][:, None])
                least = banded(pattern, np.where(inside, x[np.clip(take, 0, len(x) - 1)], 255))
                good = least <= e
                if good.any():
                    yield np.column_stack([c[good, :3], least[good]])


def _count(ix: Index, rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, part, starts, least edits); a start may have been found in two bands or portions."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    pair = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    fresh = pair | np.append(True, rows[1:, 2] != rows[:-1, 2])
    weight = np.where(fresh, ix.weight[ix.base[rows[:, 1]] + rows[:, 2]], 0)
    first = np.flatnonzero(pair)
    for (d, part), n, e in zip(rows[first, :2], np.add.reduceat(weight, first), np.minimum.reduceat(rows[:, 3], first)):
        yield int(d), int(part), int(n), int(e)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int | None = None) -> Iterator[Index]:
    """Indexes of at most ``most`` folded characters and a window; the driver holds one block's items."""
    held, size, most = [], 0, most or BLOCK_CHARS
    for item, body in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        for x in cut(folded(body), most, WINDOW):
            if held and size + len(x) > most:
                if (ix := build(held)) is not None:
                    yield ix
                held, size = [], 0
            held.append((item, x))
            size += len(x)
    if held and (ix := build(held)) is not None:
        yield ix


def _slabs(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(place).nbytes
        if size >= SLAB_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(batches: list[pa.RecordBatch], place: int, shared: list) -> Iterator[tuple[int, int, int | None, int, int]]:
    """(batch, row, item, windows found, least edits), block by block; with several blocks a worker keeps one."""
    for block in shared:
        ix = block.value
        for k, batch in enumerate(batches):
            data, offs = _text.buffers(batch.column(place))
            for lo, hi in _text.slices(offs):
                for d, part, n, e in search(ix, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
                    yield k, lo + d, ix.ids[part], n, e
        if len(shared) > 1:
            del ix, block._value  # read again from the executor's disk for the next slab


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each pair of a document and an item of which it holds a passage."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = [spark.sparkContext.broadcast(ix) for ix in blocks(benchmark, item_col, item_text)]
    if not shared:
        return spark.createDataFrame([], HITS)

    def run(batches):
        for slab in _slabs(batches, 1):
            pairs: dict[tuple, tuple[int, int]] = {}  # an item's parts and blocks make one row
            for k, row, item, n, e in _found(slab, 1, shared):
                n0, e0 = pairs.get((k, row, item), (0, e))
                pairs[k, row, item] = n0 + n, min(e0, e)
            out = [(slab[k].column(0)[row].as_py(), item, n, e) for (k, row, item), (n, e) in pairs.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=HITS.names)

    return rows.mapInArrow(lean(run), HITS)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no benchmark passage, with all their columns and no shuffle."""
    place = docs.columns.index(text_col)
    shared = [docs.sparkSession.sparkContext.broadcast(ix) for ix in blocks(benchmark, item_col, item_text)]
    if not shared:
        return docs

    def run(batches):
        for slab in _slabs(batches, place):
            keep = [np.ones(b.num_rows, bool) for b in slab]
            for k, row, *_ in _found(slab, place, shared):
                keep[k][row] = False
            for batch, kept in zip(slab, keep):
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(lean(run), docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
