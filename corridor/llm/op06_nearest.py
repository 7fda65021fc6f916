"""Operator 6: approximate nearest neighbours by cross-polytope hashing.

Vectors of dimension d are padded to a power of two and scaled to the unit
sphere (with one more component that makes the largest inner product the
nearest angle when norms differ).  Each of ``TABLES`` tables makes a bucket of
several cross-polytopes in a row: the vector is rotated by three rounds of
random signs and a fast Hadamard transform and its nearest signed axis is
taken, of all axes or, in the last one, of the first few, so that a table has
about ``LOAD`` vectors a bucket however many rows there are.  A query probes the
``PROBES`` buckets of every table whose axes lie nearest.  What it meets in
enough tables is a candidate: in so many that by chance, vectors being dealt
evenly over buckets, not more than ``STRAY`` of all would be met as often.
Candidates' original vectors are scored exactly in double precision.  The more
rows there are, the more buckets, and the fewer of them a candidate has to share.

The index and the probes are rows of a bucket and an id, and meet by a join on
the bucket, which adaptive execution splits where a bucket is hot.  Vectors
travel for the scoring alone: candidates in blocks of ``BLOCK`` vectors, each
sent once for every ``PAIRS`` pairs that a block has, and a query's vector once
to each block in which it has candidates.

Equal vectors are one class, of which only the smallest k + 1 ids can be among
anyone's k nearest, so a hot vector is indexed once.  All rows are indexed.

Defined results: vectors null, zero, of another length than the first usable
one's, or holding null or non-finite components take no part.  Null ids take no
part.  Rows repeating an id count once, with the vector whose bytes sort first,
and a query's own id is never its neighbour.  Fewer than k candidates give them
all: a query that has too few is searched exactly, in blocks.
Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import lean, materialise, table

K = 20
TABLES = 64
PROBES = 32
STRAY = 0.08
LOAD = 2
BLOCK = 8192
PAIRS = 1 << 19  # pairs scored by one task
SEED = 11


def rotate(v: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rounds of random signs and the Hadamard transform."""
    n = v.shape[1]
    for s in signs:
        v, h = v * s, 1
        while h < n:
            w = v.reshape(len(v), -1, 2, h)
            v = np.stack([w[:, :, 0] + w[:, :, 1], w[:, :, 0] - w[:, :, 1]], 2).reshape(len(v), n)
            h *= 2
        v = v / np.sqrt(n)
    return v


class Hashes:
    """``axes`` has the number of coordinates of which each cross-polytope of a table takes the nearest."""

    def __init__(self, dim: int, norm: float, rows: int, tables: int = TABLES, load: float = LOAD, seed: int = SEED, lift: bool = False):
        self.dim, self.norm, self.lift, self.tables = dim, norm, lift, tables
        self.size = 1 << max(1, (dim + lift - 1).bit_length())
        self.axes: list[int] = []
        self.buckets = 1
        while not self.axes or self.buckets < min(rows / load, 1 << 40):
            n = self.size
            while n > 1 and n * self.buckets >= rows / load:
                n //= 2
            self.axes.append(n)
            self.buckets *= 2 * n
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.axes), 3, self.size))

    def meetings(self, probes: int, stray: float) -> int:
        """The fewest tables of which no more than a share ``stray`` of unrelated vectors is met in as many."""
        p, n = min(1.0, probes / self.buckets), self.tables
        tail = 0.0
        for v in range(n, 0, -1):
            tail += math.comb(n, v) * p**v * (1 - p) ** (n - v)
            if tail > stray:
                return min(n, v + 1)
        return 1

    def sphere(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        norms = np.linalg.norm(x, axis=1)
        out[:, : self.dim] = x / (norms[:, None] if query else self.norm)
        if self.lift and not query:
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norms / self.norm) ** 2))
        return out

    def probes(self, x: np.ndarray, count: int, query: bool) -> Iterator[np.ndarray]:
        """For each table the ``count`` nearest buckets of every row, numbered through all tables.

        A bucket is as far as its axes are shorter than the longest, squared and summed; the
        nearest of a row of polytopes have the nearest of the ones before as their beginning.
        """
        v = self.sphere(x, query)
        for t, table_ in enumerate(self.signs):
            far, place = np.zeros((len(x), 1)), np.full((len(x), 1), t, np.int64)
            for s, n in zip(table_, self.axes):
                r = rotate(v, s)[:, :n]
                both = np.concatenate([r, -r], 1)
                cost = (both.max(1, keepdims=True) - both) ** 2
                far = (far[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
                place = (place[:, :, None] * (2 * n) + np.arange(2 * n)).reshape(len(x), -1)
                if far.shape[1] > count:
                    near = np.argpartition(far, count - 1, axis=1)[:, :count]
                    far, place = np.take_along_axis(far, near, 1), np.take_along_axis(place, near, 1)
            yield place


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("class", T.LongType()), T.StructField("score", T.DoubleType())])


def usable(table_: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table_.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("v")).where("id is not null and v is not null")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _emit(hashes: Hashes, count: int, query: bool):
    """(bucket, id) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = np.asarray(part.column("id"))
                for place in hashes.probes(_matrix(part.column("vector"), hashes.dim), count, query):
                    yield pa.RecordBatch.from_arrays([pa.array(place.ravel()), pa.array(np.repeat(ids, place.shape[1]))], names=["bucket", "id"])

    return run


def _score(dim: int, k: int):
    """Groups of rows (kind, id, query_id, vector): 0 a class, 1 a query, 2 a pair of them; without pairs every query meets every class."""

    def run(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        kind, ids, asked = (data.column(x).to_numpy() for x in ("kind", "id", "query_id"))
        c, q, p = (np.flatnonzero(kind == n) for n in range(3))
        out = []
        if len(c) and len(q):
            c, q = c[np.argsort(ids[c])], q[np.argsort(asked[q])]
            x, y = (_matrix(data.column("vector").take(pa.array(rows)), dim) for rows in (c, q))
            if len(p):
                i, j = np.searchsorted(ids[c], ids[p]), np.searchsorted(asked[q], asked[p])
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                score = np.concatenate([np.einsum("ij,ij->i", x[i[lo : lo + 8192]], y[j[lo : lo + 8192]]) for lo in range(0, len(i), 8192)])
                first = np.flatnonzero(np.diff(j, prepend=-1))
                # the k + 1 best of each query and all that equal the last of them; its own class may be one
                rank = np.lexsort((-score, j))
                place = np.arange(len(j)) - np.repeat(first, np.diff(np.append(first, len(j))))
                last = np.full(len(y), -np.inf)
                last[j[rank][place == k]] = score[rank][place == k]
                keep = score >= last[j]
                out.append((asked[q][j[keep]], ids[c][i[keep]], score[keep]))
            else:
                most = min(k + 1, len(c))
                for lo in range(0, len(q), 128):
                    score = y[lo : lo + 128] @ x.T
                    least = -np.partition(-score, most - 1, axis=1)[:, most - 1]
                    r, s = np.nonzero(score >= least[:, None])
                    out.append((asked[q][lo + r], ids[c][s], score[r, s]))
        cols = [np.concatenate(v) for v in zip(*out)] if out else [[]] * 3
        return pa.table([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=FOUND.names)

    return run


def candidates(classes: DataFrame, asks: DataFrame, hashes: Hashes, probes: int = PROBES, stray: float = STRAY) -> DataFrame:
    """(query_id, id): what a query meets in enough tables; its own class is none."""
    index = classes.mapInArrow(lean(_emit(hashes, 1, False)), "bucket long, id long")
    asked = asks.mapInArrow(lean(_emit(hashes, min(probes, hashes.buckets), True)), "bucket long, id long").withColumnRenamed("id", "query_id")
    # merged: what is small on disk may be many rows in a hash table
    met = index.join(asked.hint("merge"), "bucket").where("id <> query_id").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") >= hashes.meetings(probes, stray)).select("query_id", "id")


def scored(pairs: DataFrame, classes: DataFrame, asks: DataFrame, dim: int, k: int, total: int) -> DataFrame:
    """(query_id, class, score) of each query's best pairs in each block."""
    n_pairs = pairs.count()
    blocks = -(-total // BLOCK)
    parts = max(1, -(-n_pairs // (blocks * PAIRS)))
    none = {"id": "long", "query_id": "long", "vector": "binary"}
    rows = lambda df, kind: df.select("i", "j", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i")
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("j")
    placed = pairs.select("id", "query_id", block, part)
    own = asks.select(F.col("id").alias("query_id"), "vector")
    where = placed.select("query_id", "i", "j").distinct().join(own, "query_id")
    every = classes.select("id", "vector", block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"))
    return rows(every, 0).unionByName(rows(where, 1)).unionByName(rows(placed, 2)).groupBy("i", "j").applyInArrow(_score(dim, k), FOUND)


def nearest(vectors: DataFrame, queries: F.Column, k: int = K, tables: int = TABLES, probes: int = PROBES, stray: float = STRAY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows for which ``queries`` (on ``id``) holds."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    v = usable(vectors, id_col, vec_col)
    shape = v.select(F.size("v").alias("d"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), "id")
    first = shape.agg(F.min_by("d", "id").alias("d")).first()["d"]
    if first is None:
        return spark.createDataFrame([], out)
    v = v.where(F.size("v") == first)
    norms = shape.where(F.col("d") == first).agg(F.max("norm").alias("hi"), F.min("norm").alias("lo")).first()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column("v").flatten(), "<f8").reshape(-1, first) + 0.0  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "vector"])

    packed = v.mapInArrow(pack, "id long, vector binary").groupBy("id").agg(F.min("vector").alias("vector"))
    keyed = materialise(packed.withColumn("digest", F.sha2("vector", 256)), "vectors")
    member = materialise(_members(keyed), "members")
    classes = materialise(keyed.join(member.where("id = class").select("id"), "id").select("id", "vector"), "classes")

    total = classes.count()
    hashes = Hashes(first, norms["hi"], total, tables, lift=norms["lo"] < norms["hi"] * (1 - 1e-5))
    # queries with one vector share their search: the class asks once
    asker = member.where(queries).select(F.col("id").alias("asker"), F.col("class").alias("query_id"))
    asks = materialise(asker.select(F.col("query_id").alias("id")).distinct().join(classes, "id"), "asked")
    pairs = materialise(candidates(classes, asks, hashes, probes, stray), "pairs")
    found = materialise(scored(pairs, classes, asks, first, k, total), "found")
    own = asks.select(F.col("id").alias("query_id"), F.col("id").alias("class"), F.col("vector"))
    found = found.unionByName(_self(own, first)).unionByName(_rest(pairs, asks, classes, first, k, total))
    found = found.groupBy("query_id", "class").agg(F.max("score").alias("score"))
    top = found.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= k + 1).drop("r")
    # a class's smallest k + 1 ids: no more of them can be among the k nearest of one query
    part = Window.partitionBy("class", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = member.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("r") <= k + 1)
    pairs = asker.join(top.join(few.select("class", F.col("id").alias("vec_id")), "class"), "query_id").where("asker <> vec_id")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("asker").alias("query_id"), "rank", "vec_id", "score")


def _self(own: DataFrame, dim: int) -> DataFrame:
    """A query's own class: its other ids are neighbours like any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), dim) if b.num_rows else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("class"), pa.array(np.einsum("ij,ij->i", x, x))], names=FOUND.names)

    return own.mapInArrow(lean(run), FOUND)


def _rest(pairs: DataFrame, asks: DataFrame, classes: DataFrame, dim: int, k: int, total: int) -> DataFrame:
    """Exact search, in blocks of all classes, for queries with fewer than k candidates although there are more."""
    n = pairs.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = materialise(asks.join(n, "id", "left").where(F.coalesce("n", F.lit(0)) < min(k, total - 1)).select("id", "vector"), "short")
    if short.isEmpty():
        return pairs.sparkSession.createDataFrame([], FOUND)
    count = -(-total // BLOCK)
    block = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("i")
    parts = max(1, -(-short.count() // BLOCK))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("j")
    none = F.lit(None).cast("long")
    every = classes.select(block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), F.lit(0).alias("kind"), "id", none.alias("query_id"), "vector")
    asked = short.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), part, F.lit(1).alias("kind"), none.alias("id"), F.col("id").alias("query_id"), "vector")
    return every.unionByName(asked).groupBy("i", "j").applyInArrow(_score(dim, k), FOUND)


def _members(keyed: DataFrame) -> DataFrame:
    """(class, id): equal vectors' class is their smallest id; the digest stands for the vector."""
    rep = keyed.groupBy("digest").agg(F.min("id").alias("class"))
    return keyed.select("digest", "id").join(rep, "digest").select("class", "id")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op6_nearest": op6_nearest}
ORACLES: dict[str, str] = {}
