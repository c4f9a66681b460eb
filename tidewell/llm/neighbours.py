"""Approximate nearest neighbours by cross-polytope hashing with multiprobe, and exact reranking.

Candidates are dealt into ranges by their norm (powers of RATIO), so that a few long vectors do not
squeeze the others together. The vectors of a range are brought to the length of its longest with one more
coordinate (so that the largest inner product is the nearest), padded to a power of two and rotated by
three rounds of random signs and a fast Hadamard transform. A table's bucket is the signed axis nearest to
the rotated vector: twice the dimension buckets in each of several independent tables. A query probes the
``probes`` nearest axes of each table in every range, however many vectors the table or the range has. A query
that comes out with fewer than ``k`` rows is compared with all vectors of its dimension. Only a caller who gives
``meet`` has ranges searched whole: those where a query expects fewer than ``meet`` vectors under its probes.
Query rows and vectors meet in a shuffle on (dimension, range, table, bucket), cut into blocks of at most about
BLOCK rows of either, so that a bucket of any size spreads over tasks. Inside a block numpy finds the
best of every query; candidate pairs are never written out. What blocks return is merged by Spark.

The index needs no training.

Result: up to ``k`` rows for each query row, ranked by inner product in double precision, ties to the
smaller vec_id. A query's own vec_id is no candidate. Rows with a NULL vec_id and vectors that are NULL,
empty, zero or hold NULL or non-finite components take no part; vectors meet those of their own
dimension. Repeated rows count once; of different vectors under one vec_id the nearest counts. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.stored import stored

NEAREST, TABLES, PROBES, BLOCK, SEED = 20, 14, 16, 4096, 20240607
RATIO = 1.25
BUCKET = ("dim", "range", "table", "bucket")
KEYS = (*BUCKET, "v_block", "q_block")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vector, log_norm, range) of the rows that take part; range 0 lies around norm 1."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("vector", lambda x: x != 0)).distinct()
    largest = F.array_max(F.transform("vector", F.abs))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("largest")) * (x / F.col("largest")))
    rows = rows.withColumn("dim", F.size("vector")).withColumn("largest", largest)
    rows = rows.withColumn("log_norm", F.log("largest") + F.log(square) / 2).drop("largest")
    return rows.withColumn("range", F.floor(F.col("log_norm") / math.log(RATIO) + 0.5).cast("int"))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of every row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transforms, the same for a table in every task."""
    signs = np.random.default_rng([seed, table, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def lengthened(x: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors, one coordinate longer and padded to a power of two, in which nearest is largest inner product.

    ``share`` is the norm of a candidate over the largest of its range; queries have none.
    """
    n, d = x.shape
    out = np.zeros((n, 1 << d.bit_length()))
    out[:, :d] = x / np.abs(x).max(1)[:, None]
    out[:, :d] /= np.sqrt((out[:, :d] * out[:, :d]).sum(1))[:, None]
    if share is not None:
        out[:, :d] *= share[:, None]
        out[:, d] = np.sqrt(np.maximum(0, 1 - share * share))
    return out


def hashed(rows: DataFrame, tables: int, probes: int, seed: int, query: bool) -> DataFrame:
    """A row for each vector, table and probed bucket; ``probes`` buckets for a query, one for a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            share = None if query else np.minimum(1, np.exp(batch.column("log_norm").to_numpy() - batch.column("most").to_numpy()))
            flat, ends = batch.column("vector").values.to_numpy(), batch.column("vector").offsets.to_numpy()
            for d in np.unique(dims).tolist():
                all_at = np.flatnonzero(dims == d)
                for first in range(0, len(all_at), 2048):
                    at = all_at[first : first + 2048]
                    x = flat[ends[at][:, None] + np.arange(d)]
                    long = lengthened(x, None if query else share[at])
                    raw = [row.tobytes() for row in x]
                    for t in range(tables):
                        y = rotated(long, t, seed)
                        axes = np.stack([y, -y], axis=2).reshape(len(at), -1)
                        p = min(probes, axes.shape[1]) if query else 1
                        best = np.argpartition(-axes, p - 1, axis=1)[:, :p] if p < axes.shape[1] else np.tile(np.arange(p), (len(at), 1))
                        which = np.repeat(np.arange(len(at)), p)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(which), d, np.int32)),
                                pa.array(np.full(len(which), t, np.int32)),
                                pa.array(best.ravel().astype(np.int32)),
                                batch.column("vec_id").take(pa.array(at[which])),
                                pa.array(raw, pa.binary()).take(pa.array(which)),
                            ]
                            + ([] if query else [batch.column("range").take(pa.array(at[which]))]),
                            names=["dim", "table", "bucket", "vec_id", "vector"] + ([] if query else ["range"]),
                        )

    names, kinds = ("vec_id", "dim", "vector"), "dim int, table int, bucket int, vec_id long, vector binary"
    if query:
        return rows.select(*names).mapInArrow(run, kinds)
    return rows.select(*names, "range", "log_norm", "most").mapInArrow(run, f"{kinds}, range int")


def packed(rows: DataFrame) -> DataFrame:
    """The rows unhashed: one bucket for the range they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column("vector").values.to_numpy(), batch.column("vector").offsets.to_numpy()
            raw = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            none = pa.array(np.full(batch.num_rows, -1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("range"), none, none, batch.column("vec_id"), raw], names=[*BUCKET, "vec_id", "vector"])

    return rows.select("vec_id", "dim", "range", "vector").mapInArrow(run, "dim int, range int, table int, bucket int, vec_id long, vector binary")


def best_in_block(k: int):
    """The k nearest of a block's vectors to each of its queries."""

    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not vectors.num_rows:
            return empty
        d = key[0].as_py()
        q, x = (np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, d) for t in (queries, vectors))
        q_id, x_id = (t.column("vec_id").to_numpy() for t in (queries, vectors))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, one in enumerate(q):
            score = x @ one
            score[x_id == q_id[i]] = -np.inf
            if len(score) > k:  # ties and rounding: a little more than k, scored again row by row
                least = np.partition(score, -k)[-k]
                at = np.flatnonzero(score >= least - 1e-9 * max(1.0, abs(least)))
            else:
                at = np.arange(len(score))
            at = at[score[at] > -np.inf]
            exact = (x[at] * one).sum(1)
            order = np.lexsort((x_id[at], -exact))[:k]
            found.append((np.full(len(order), q_id[i]), x_id[at[order]], exact[order]))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEAREST,
    tables: int = TABLES,
    probes: int = PROBES,
    meet: int = 0,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id and score for every row of ``vectors`` (vec_id, embedding) that is a query."""
    rows = usable(vectors)
    ranges = rows.groupBy("dim", "range").agg(F.max("log_norm").alias("most"), F.count("*").alias("of_range"))
    axes = F.lit(2) * F.pow(F.lit(2.0), F.length(F.bin("dim")))
    ranges = ranges.withColumn("whole", F.col("of_range") * probes < meet * axes)
    queries, rows = rows.filter(is_query), rows.join(ranges, ["dim", "range"])
    own = ranges.select("dim", "range", "whole")
    v = hashed(rows.filter("NOT whole"), tables, 1, seed, False).select(*BUCKET, "vec_id", "vector")
    v = v.unionByName(packed(rows.filter("whole")))
    q = hashed(queries.join(own.filter("NOT whole").select("dim").distinct(), "dim", "left_semi"), tables, probes, seed, True)
    q = q.join(own.filter("NOT whole").select("dim", "range"), "dim").select(*BUCKET, "vec_id", "vector")
    q = q.unionByName(packed(queries.drop("range").join(own.filter("whole").select("dim", "range"), "dim")))
    found = stored(ranked(met(q, v, k, block), k))
    n = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    short = stored(queries.join(n, "vec_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("vec_id", "dim", "vector"))
    if short.isEmpty():
        return found
    every = rows.join(short.select("dim").distinct(), "dim", "left_semi").withColumn("range", F.lit(0))
    more = met(packed(short.withColumn("range", F.lit(0))), packed(every), k, block)
    return ranked(found.drop("rank").unionByName(more), k)


def met(q: DataFrame, v: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id and score of the ``k`` best of every block of a bucket for each query in it."""
    bucket = list(BUCKET)
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = v.groupBy(bucket).count().withColumn("v_blocks", blocks("count")).drop("count")
    sizes = sizes.join(q.groupBy(bucket).count().withColumn("q_blocks", blocks("count")).drop("count"), bucket)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = v.join(sizes, bucket).withColumn("v_block", own("v_blocks")).withColumn("q_block", every("q_blocks")).select(*KEYS, "vec_id", "vector")
    q = q.join(sizes, bucket).withColumn("q_block", own("q_blocks")).withColumn("v_block", every("v_blocks")).select(*KEYS, "vec_id", "vector")
    return q.groupBy(*KEYS).cogroup(v.groupBy(*KEYS)).applyInArrow(best_in_block(k), "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
