"""Exact top-k search of vectors by inner product, with score bounds (MaxScore).

A vector's components are floor(256 x), integers. A query's terms are the
dimensions; a dimension's postings in a shard are the components of its rows, and
its bound is the most that the query's component makes of any of them. Terms are
taken from the query's largest component to its smallest. Those at the end that
cannot lift a row over the threshold by themselves are not essential: their bound
is the lesser of the sum of the terms' bounds and of the product of the norms that
the query has in them and a row has in all. The postings of essential terms are
traversed for all rows of the shard, the others probed in steps for rows that are
still competitive. A shard whose bound over all terms is under the threshold is
left out as a whole. All sums are exact, so pruning never changes a result.

The threshold of a query is the k-th best score that is known: at first of
SEED_ROWS rows, then of what a task has seen. Queries are taken in blocks of at
most QUERY_BYTES, each of which passes over all rows once; every task sends on the
best of each query, and only these meet in a shuffle.

Edge cases: vectors that are null or hold a null or a component that is not
finite take no part; of vectors of unequal length the shorter counts as filled up
with zeros, so an empty one scores 0 with all. A null id makes no query and is
last among equals. Equal rows ask once; one of them is the query's own, and the
others are candidates. Rows that share an id but not a vector each ask. Scores
that may pass 64 bits are an error. Columns besides the two are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import cluster

#: Bytes of the components of a block of queries, at most (a larger query is a block of its own).
QUERY_BYTES = 16 << 20
#: Rows whose scores give the first thresholds.
SEED_ROWS = 2048
#: Rows of a shard.
SHARD_ROWS = 8192
#: Terms that are probed at a time.
STEP = 8


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (floor(256 x) of each component) of the vectors that take part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(vector).isNotNull()).where(~odd)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of `dims` components, filled up with zeros, or cut where queries have none."""
    bounds = np.asarray(lists.offsets, np.int64)
    values = np.asarray(lists.flatten(), np.int64)
    size = np.diff(bounds)
    if len(size) and (size == dims).all():
        return values.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(values)) - np.repeat(bounds[:-1] - bounds[0], size)
    inside = place < dims
    out[row[inside], place[inside]] = values[inside]
    return out


def _kind(bound: float) -> type:
    """A number type in which sums up to `bound` are exact; the smallest is the fastest."""
    if bound < 1 << 24:
        return np.float32
    if bound < 1 << 53:
        return np.float64
    if bound < 1 << 63:
        return np.int64
    raise OverflowError("inner products may pass 64 bits")


class Queries:
    """A block of queries: components in the order of their size, and the norms of what is left from each place on."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.argsort(-np.abs(vectors), axis=1, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, 1)
        squares = np.cumsum(self.sorted.astype(float)[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.norm = np.sqrt(np.pad(squares, ((0, 0), (0, 1))))
        self.most = np.abs(vectors).max(axis=1, initial=0)

    def __len__(self) -> int:
        return len(self.sorted)

    def rest(self, low: np.ndarray, high: np.ndarray, norm: float, part: slice) -> np.ndarray:
        """Of queries `part`, the most that the terms from each place on add for any row of a shard of these components and greatest norm."""
        q, order = self.sorted[part], self.order[part]
        each = np.maximum(q * high[order].astype(float), q * low[order].astype(float))
        sums = np.pad(np.cumsum(each[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1)))
        # A little is added for what floats lose.
        return np.minimum(sums * (1 + 1e-9 * np.sign(sums)), self.norm[part] * norm * (1 + 1e-9)) + 1e-6


def _best_of_shard(queries: Queries, rows: np.ndarray, threshold: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of a query, and places and scores of all rows of the shard that reach its threshold (a number, in place: it may have risen meanwhile)."""
    norm = float(np.sqrt((rows.astype(float) ** 2).sum(1).max()))
    low, high = rows.min(0, initial=0), rows.max(0, initial=0)
    kind = _kind(float(queries.most.max()) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]))
    postings = np.ascontiguousarray(rows.T, kind)
    dims = rows.shape[1]
    for begin in range(0, len(queries), 1024):
        part = slice(begin, begin + 1024)
        rest = queries.rest(low, high, norm, part)
        essential = (rest >= threshold[part, None]).sum(1)
        terms = queries.sorted[part].astype(kind)
        for i in np.flatnonzero(rest[:, 0] >= threshold[part]):
            n, order, q, least = int(essential[i]), queries.order[begin + i], terms[i], threshold[begin + i]
            n = min(dims, n)
            score = q[:n] @ postings[order[:n]]
            rows_left = np.flatnonzero(score >= least - rest[i, n])
            score = score[rows_left]
            while n < dims and len(rows_left):
                more = min(dims, n + STEP)
                score = score + q[n:more] @ postings[order[n:more, None], rows_left]
                n = more
                competitive = score >= least - rest[i, n] if n < dims else score >= least
                rows_left, score = rows_left[competitive], score[competitive]
            if len(rows_left):
                yield begin + int(i), rows_left, score.astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= SHARD_ROWS:
            yield pa.concat_arrays([b.column(0) for b in held]), np.concatenate([_matrix(b.column(1), dims) for b in held])
            held, size = [], 0
    if held:
        yield pa.concat_arrays([b.column(0) for b in held]), np.concatenate([_matrix(b.column(1), dims) for b in held])


def _kept(score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, pa.Array]:
    """The k best, by descending score, then ascending id, null last."""
    order = np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), -score))[:k]
    return score[order], ids.take(pa.array(order))


def _search(rows: DataFrame, vectors: np.ndarray, threshold: np.ndarray, k: int) -> DataFrame:
    """number (of the query), id, score: the k best of each query in each task, of those that reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, reached, best = Queries(vectors), threshold.copy(), {}
        for ids, shard in _shards(batches, vectors.shape[1]):
            for number, places, score in _best_of_shard(queries, shard, reached):
                own = ids.take(pa.array(places))
                if number in best:
                    score, own = np.concatenate([best[number][0], score]), pa.concat_arrays([best[number][1], own])
                best[number] = _kept(score, own, k)
                if len(best[number][0]) == k:
                    reached[number] = max(reached[number], best[number][0][-1])
        for number, (score, own) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), number)), own, pa.array(score)], ["number", "id", "score"])

    cluster.bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "number long, id long, score long")


def _block(queries: DataFrame, blocks: int, number: int) -> tuple[list, np.ndarray]:
    """ids and vectors of a block of queries; its size is bounded by QUERY_BYTES."""
    got = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == number).toArrow().combine_chunks()
    dims = int(np.diff(np.asarray(got["v"].combine_chunks().offsets)).max(initial=0)) if len(got) else 0
    return got["id"].to_pylist(), _matrix(got["v"].combine_chunks(), dims)


def _seeded(rows: DataFrame, vectors: np.ndarray, k: int) -> np.ndarray:
    """A threshold of each query that its k-th best is sure to reach: the k-th best among a few rows, which rows does not matter."""
    got = rows.select("v").limit(SEED_ROWS).toArrow()["v"].combine_chunks()
    seeds = _matrix(got, vectors.shape[1])
    out = np.full(len(vectors), float(-(1 << 63)))
    if len(seeds) >= k:
        kind = _kind(float(np.abs(vectors).max(initial=0)) * float(np.abs(seeds).max(initial=0)) * max(1, vectors.shape[1]))
        seeds = np.ascontiguousarray(seeds.T, kind)
        for at in range(0, len(vectors), 1024):
            out[at : at + 1024] = np.partition(vectors[at : at + 1024].astype(kind) @ seeds, -k, axis=1)[:, -k]
    return out


def top(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `every` divides, the k other rows of greatest inner product; ties go to smaller ids."""
    spark = vectors.sparkSession
    rows = cluster.written(quantised(vectors, id_column, vector))
    queries = rows.where(F.col("id") % every == 0).distinct()
    many, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, parts = max(1, -(-many * max(dims, 1) * 8 // QUERY_BYTES)), []
    for number in range(blocks if many else 0):
        ids, asked = _block(queries, blocks, number)
        if not ids:
            continue
        # One more than asked for, as the query's own row is among them.
        found = _search(rows, asked, _seeded(rows, asked, k + 1), k + 1)
        own = [(i, q, s) for i, (q, s) in enumerate(zip(ids, (asked * asked).sum(1).tolist(), strict=True))]
        names = spark.createDataFrame(own, "number long, query_id long, own long")  # of one block
        best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
        found = found.join(F.broadcast(names), "number")
        # Of rows that look like the query's own, the first is it.
        alike = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own"))
        before = Window.partitionBy("number").orderBy("place")
        found = found.withColumn("alike", F.coalesce(alike, F.lit(False))).withColumn("owns", F.sum(F.col("alike").cast("int")).over(before))
        found = found.where(~(F.col("alike") & (F.col("owns") == 1))).withColumn("rank", F.col("place") - F.least("owns", F.lit(1))).where(F.col("rank") <= k)
        parts.append(found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
