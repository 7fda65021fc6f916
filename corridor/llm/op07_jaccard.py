"""Operator 7: exact n-gram Jaccard join with set relations.

A document's set is its distinct shingles.  Documents with one set are a class;
one of them stands for it.  A shingle's document frequency orders the shingles,
rare ones first, and sets with similarity s >= t share one of the first
n - ceil(t n) + 1 shingles of each.  A shingle of one class alone can be shared
with none, so a class in whose prefix all are such has no partner and drops out.

For the rest, the index lists a shingle's classes with the size of their sets
and the shingle's position.  Not all pairs of a list are tried:

* answer skipping: in each list one class is the pivot, the one that comes
  first in an order common to all lists, and the others are verified against it
  alone.  Classes found linked are one component, and lists within one component
  are done, which leaves few lists open.
* what remains are pairs of different components in an open list.  List entries
  too far apart by size or position are skipped.  The overlaps already computed
  with a common pivot p bound the new one: |x & y| <= min(|x & p|, |y & p|) +
  min(|x' - p|, |y' - p|), where x' has those of x's shingles that occur in any
  other class.  So do sketches of parity bits: sets differ in as many shingles
  at least as their sketches in bits.  Pairs that this rules out are skipped,
  and only the rest is verified from the sets.

So no link between different components is lost, while a large group of near
copies costs one verification for each of its members.

Defined results: null or empty texts and texts without a word have an empty
set, are linked with nothing, and are their own component.  Texts with fewer
words than a shingle have the whole sequence as one.  A null doc_id takes part
as a text but never names a component of others; alone its component is null.
Rows repeating an id keep their rows.  Empty tables give no rows; other columns
are ignored.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _chunks as C
from . import _text
from ._spark import lean, materialise, release, settle, table

WORDS = 4
PERCENT = 85
ORDERS = 1  # rounds of pivots; each further one tries another order

SETS = "node long, doc_id long, n long, d1 long, d2 long"
SURVIVORS = "node long, n long, unique long, tokens array<long>, sketch array<long>"
SKETCH = 8  # longs of parity bits


def sets(row: dict, k: int) -> tuple[pa.Array, list[np.ndarray]]:
    """(ids, sorted distinct shingle hashes of every document)."""
    ids, none, data, offs = C.unpack(row)
    starts, ends, doc = _text.words(data, offs)
    h = _text.word_hashes(data, starts, ends, lower=True)
    grams, valid = _text.window_hashes(h, doc, k)
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    out = []
    for d in range(len(ids)):
        lo, hi = cut[d], cut[d + 1]
        if hi - lo >= k:
            g = np.sort(grams[lo : hi - k + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif hi > lo:
            out.append(_text.window_hashes(h[lo:hi], doc[lo:hi], int(hi - lo))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return pa.array(ids, mask=none), out


def _node(chunk: int, n: int) -> np.ndarray:
    return (chunk << 17) + np.arange(n)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, own = sets(row, k)
                with np.errstate(over="ignore"):
                    d1 = np.array([_text.mix(s).sum(dtype=np.uint64) for s in own], np.uint64)
                    d2 = np.array([_text.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in own], np.uint64)
                cols = [_node(row["chunk"], len(ids)), ids, np.array([len(s) for s in own], np.int64), d1.view(np.int64), d2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["node", "doc_id", "n", "d1", "d2"])

    return run


def _chosen(t: pa.Table, kinds: int, k: int):
    """(chunk, sets of the documents that stand for their class, their nodes, replies)."""
    chunk, row, (reps, *rest) = C.group(t, kinds)
    if not reps or row is None:
        return chunk, [], np.zeros(0, np.int64), rest
    pick = np.sort(np.array(reps[0].split(b","), np.int64))
    _, own = sets(row, k)
    return chunk, [own[i] for i in pick], (chunk << 17) + pick, rest


def _lead_counts(own: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(own) >> np.uint64(64 - bits)
    return np.unique(flat, return_inverse=True, return_counts=True)


def _send_counts(k: int, bits: int, n: int):
    def run(t: pa.Table) -> pa.Table:
        chunk, own, _, _ = _chosen(t, 1, k)
        if not own:
            return C.sent_table([])
        keys, _, count = _lead_counts(own, bits)
        return C.sent_table(C.send(chunk, keys << np.uint64(64 - bits), n, lambda part, r: C.join_blobs(C.steps(part >> np.uint64(64 - bits)), C.squeeze(count[r].astype(np.uint32)))))

    return run


def _frequencies(t: pa.Table) -> pa.Table:
    """For each key of each chunk its frequency in all, as 8 log2: 0 for a key that stands alone."""
    blobs = [C.split_blobs(b) for b in t.column("blob").to_pylist()]
    keys = [C.unsteps(b[0]) for b in blobs]
    count = np.concatenate([C.expand(b[1], np.uint32) for b in blobs])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=count)
    level = np.minimum(255, np.round(8 * np.log2(total))).astype(np.uint8)[place]
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    out = [C.squeeze(level[a:b]) for a, b in zip(cut, cut[1:])]
    return pa.table([t.column("chunk"), t.column("bucket"), pa.array(out, pa.binary())], names=["chunk", "bucket", "blob"])


def _survivors(k: int, bits: int, n_buckets: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        chunk, own, nodes, rest = _chosen(t, 2, k)
        rows: list[tuple] = []
        if own:
            keys, place, _ = _lead_counts(own, bits)
            level = np.zeros(len(keys), np.uint8)
            for b, part in C.ranges(keys << np.uint64(64 - bits), n_buckets):
                level[part] = C.expand(rest[0][b], np.uint8)
            at = 0
            for node, s in zip(nodes, own):
                f = level[place[at : at + len(s)]]
                at += len(s)
                alone = int((f == 0).sum())
                if alone < prefix(len(s), percent):
                    order = np.lexsort((s, f))[alone:]
                    rows.append((int(node), len(s), alone, s[order].view(np.int64), sketch(s)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["node", "n", "unique", "tokens", "sketch"])

    return run


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles' counts by hash: bits in which two sketches differ are shingles that only one set has."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def prefix(n: int, percent: int) -> int:
    """First shingles of a set of which similar sets share one."""
    return n - -(-percent * n // 100) + 1


def need(nx, ny, percent: int) -> F.Column:
    """Least overlap of linked sets: 100 o >= percent (nx + ny - o)."""
    return F.ceil((nx + ny) * percent / F.lit(100.0 + percent) - 1e-9)


def verify(pairs: DataFrame, sets_: DataFrame) -> DataFrame:
    """(a, b, overlap, na, nb, ma, mb): the sets are looked up and intersected once for each pair.

    m is the number of a set's shingles that occur in other classes at all.
    """
    a = sets_.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets_.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    return both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("overlap"), "na", "nb", F.size("ta").cast("long").alias("ma"), F.size("tb").cast("long").alias("mb"))


def components(nodes: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """(node, comp): smallest node reachable over ``links`` (a, b), by label propagation with pointer jumping."""
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), tag)
    label = materialise(nodes.select("node", F.col("node").alias("comp")), tag)
    while True:
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(near, "node", "left").select("node", F.least("comp", F.coalesce("m", "comp")).alias("comp"), F.col("comp").alias("old"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = materialise(step.join(jump, "comp").select("node", F.col("root").alias("comp"), "old"), tag)
        label = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return label


def merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only components that a link joins are gone over."""
    ends = [label.select(F.col("node").alias(e), F.col("comp").alias(f"c{e}")) for e in ("a", "b")]
    joins = links.join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joins = materialise(joins, "joins")
    if joins.isEmpty():
        return label
    nodes = joins.select(F.col("a").alias("node")).union(joins.select("b")).distinct()
    root = components(nodes, joins, "labels").select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return materialise(label.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")


def link(chunks: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(every row's node, doc_id and class; every class's component)."""
    described = materialise(chunks.mapInArrow(lean(_describe(k)), SETS), "sets")
    best = F.min("node").alias("class")
    classes = materialise(described.where("n > 0").groupBy("n", "d1", "d2").agg(best), "classes")
    reps = classes.select((F.shiftright("class", 17)).alias("chunk"), (F.col("class") % (1 << 17)).alias("place"))
    reps = reps.groupBy("chunk").agg(F.array_join(F.collect_list(F.col("place").cast("string")), ",").cast("binary").alias("blob"))
    reps = materialise(reps.select("chunk", F.lit(0).alias("bucket"), "blob"), "reps")
    bits, n = C.filter_bits(chunks), C.buckets(chunks)
    counts = C.by_chunk(chunks, reps).groupBy("chunk").applyInArrow(_send_counts(k, bits, n), C.SENT)
    levels = counts.groupBy("bucket").applyInArrow(_frequencies, C.SENT)
    found = C.by_chunk(chunks, reps, levels).groupBy("chunk").applyInArrow(_survivors(k, bits, n, percent), SURVIVORS)
    alive = materialise(found, "survivors")
    release()
    size = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9) + 1
    index = alive.select("node", "n", F.posexplode(F.slice("tokens", F.lit(1), (size - F.col("unique")).cast("int"))).alias("pos", "token"), "unique", "sketch")
    index = materialise(index.select("token", "node", "n", (F.col("pos") + F.col("unique")).alias("pos"), (F.col("unique") / F.col("n")).alias("alone"), "sketch"), "index")
    label = alive.select("node", F.col("node").alias("comp"))
    linked = lambda got: got.where(F.col("overlap") >= need(F.col("na"), F.col("nb"), percent)).select("a", "b")
    tested = None
    for order in range(ORDERS):
        # first the class with the smallest share of shingles of its own: the middle of a group of copies
        rank = F.col("alone") if order == 0 else F.xxhash64("node", F.lit(order)).cast("double")
        lists = index.drop("sketch").join(label, "node")
        heads = lists.groupBy("token").agg(F.min_by(F.struct("node", "n", "comp"), F.struct(rank, "node")).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "p")
        near = (F.col("n") * 100 >= F.col("p.n") * percent) & (F.col("p.n") * 100 >= F.col("n") * percent)
        pairs = lists.join(heads, "token").where((F.col("comp") != F.col("p.comp")) & near).select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        got = materialise(verify(pairs, alive), "verified")
        tested = got if tested is None else tested.unionByName(got)
        label = merge(label, linked(got))
        release()
    rest = _open_pairs(index.drop("alone"), label, tested, percent)
    label = merge(label, linked(materialise(verify(rest, alive), "verified")))
    comp = classes.join(label.withColumnRenamed("node", "class"), "class", "left").select("n", "d1", "d2", F.coalesce("comp", "class").alias("comp"))
    return described, comp


def _open_pairs(index: DataFrame, label: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a list and that neither size, position nor a pivot rules out.

    All this is decided inside the join.  Of a list, classes outside its largest
    component are joined with the whole list, so that a large component is not
    paired with itself.
    """
    # each class's pivot, the one with which it shares most, how much, and how many of its shared shingles lie outside
    best = tested.groupBy("a").agg(F.max(F.struct("overlap", "b", "ma")).alias("t"))
    best = best.select(F.col("a").alias("node"), F.col("t.b").alias("p"), F.col("t.overlap").alias("o"), (F.col("t.ma") - F.col("t.overlap")).alias("out"))
    own = tested.groupBy("b").agg(F.max("mb").alias("o")).select(F.col("b").alias("node"), F.col("b").alias("p"), "o", F.lit(0).cast("long").alias("out"))
    pivot = best.unionByName(own).groupBy("node").agg(F.max(F.struct("o", "p", "out")).alias("t")).select("node", "t.*")
    lists = index.join(label, "node").join(pivot, "node", "left")
    sizes = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("token", "main")
    lists = lists.join(main, "token")
    cols = ("node", "n", "pos", "comp", "p", "o", "out", "sketch")
    x = lists.where("comp <> main").select("token", *[F.col(c).alias(f"{c}_x") for c in cols])
    y = lists.select("token", *[F.col(c).alias(f"{c}_y") for c in cols])
    least = need(F.col("n_x"), F.col("n_y"), percent)
    left = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) + F.least("pos_x", "pos_y")
    sized = (F.col("n_x") * 100 >= F.col("n_y") * percent) & (F.col("n_y") * 100 >= F.col("n_x") * percent)
    bound = F.least("o_x", "o_y") + F.least("out_x", "out_y")
    ruled_out = F.coalesce((F.col("p_x") == F.col("p_y")) & (bound < least), F.lit(False))
    apart = sum((F.bit_count(F.col("sketch_x")[k].bitwiseXOR(F.col("sketch_y")[k])) for k in range(SKETCH)), F.lit(0))
    fits = (F.col("comp_x") != F.col("comp_y")) & sized & (left >= least) & ~ruled_out & (F.col("n_x") + F.col("n_y") - apart >= 2 * least)
    pairs = x.join(y, (x["token"] == y["token"]) & fits).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id."""
    described, comp = link(C.make(docs, "chunks", id_col, text_col), k, percent)
    own = described.where("n > 0").join(comp, ["n", "d1", "d2"])
    least = own.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = own.select("doc_id", "n", "comp").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One document of each group, the one with the smallest id; rows without an id stay."""
    gone = settle(docs.sparkSession, lambda: groups(docs, k, percent).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "gone")
    # merged, not broadcast: the list grows with the documents, and the plan is the same at every size
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLES: dict[str, str] = {}
