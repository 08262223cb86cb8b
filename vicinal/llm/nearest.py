"""Exact nearest neighbours of stated queries by a block matrix join.

Queries and vectors are dealt into blocks of bounded size; every query block meets every vector block once. Inside a
tile both sides are rounded to int8 with one scale per vector, a matrix product of the small integers gives all
distances at once, and the rounding errors are bounded: ``|a . b - a' . b'| <= |a| |b - b'| + |b'| |a - a'|``. Of each
query only the vectors stay whose lower bound is not above its k-th smallest upper bound; their distances are computed
anew in double precision from the original vectors. Heaps merge the tiles of a query: first those that a task holds,
then what the tasks have found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Bytes of a block of queries or vectors in double precision, as expected: few blocks mean few copies of either side.
BLOCK_BYTES = 8_000_000
#: Distances of a tile that are held together.
CELLS = 2_000_000
#: Squares of a tile, whose largest component is about one, that count as nothing.
LEAST = 1e-280
#: Queries whose heaps a task holds together.
HELD = 10_000

TILE = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector is there, has no null or non-finite component, and some that is not zero."""
    big = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def rounded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values as float32, scale, length, length of the rounded, length of the error) of each row."""
    scale = np.abs(m).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # too small beside the tile's largest: its whole length is error
    small = np.clip(np.rint(m / scale[:, None]), -127, 127)
    back = small * scale[:, None]
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    return small.astype(np.int8).astype(np.float32), scale, norm(m), norm(back), norm(m - back)


def distances(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of the rows of m from q; where squares don't fit into a double, by way of the largest difference."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        d = m - q
        out = np.sqrt((d * d).sum(axis=1))
        odd = np.flatnonzero((out > 1e150) | (out < 1e-150))
        if len(odd):
            most = np.abs(d[odd]).max(axis=1)
            far = most * np.sqrt(((d[odd] / most[:, None]) ** 2).sum(axis=1))
            out[odd] = np.where(most == 0, 0.0, np.where(np.isfinite(most), far, np.inf))
    return out


def nearest_in_tile(qids: np.ndarray, q: np.ndarray, vids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest rows of v for each row of q, without the query's own, by distance and id."""
    if not len(q) or not len(v):
        return
    # Bounds are of the vectors divided by a power of two, so that no square is too large; exact distances are not.
    original, originals = q, v
    unit = 2.0 ** -np.floor(np.log2(max(np.abs(q).max(), np.abs(v).max())) + 1)
    unit = min(unit, 2.0**1000)
    q, v = q * unit, v * unit
    vs, vscale, vlen, vback, verr = rounded(v)
    products = min(len(v[0]), 1040)  # of so many int8 pairs float32 holds the exact sum
    slack = 1e-9
    stripe = max(1, CELLS // len(v))
    for a in range(0, len(q), stripe):
        part = q[a : a + stripe]
        qs, qscale, qlen, qback, qerr = rounded(part)
        dot = np.zeros((len(part), len(v)))
        for c in range(0, v.shape[1], products):
            dot += qs[:, c : c + products] @ vs[:, c : c + products].T
        dot *= qscale[:, None] * vscale[None, :]
        error = qlen[:, None] * verr[None, :] + qerr[:, None] * vback[None, :]
        squares = (qlen**2)[:, None] + (vlen**2)[None, :]
        low, high = squares - 2 * (dot + error), squares - 2 * (dot - error)
        own = qids[a : a + stripe, None] == vids[None, :]
        high[own] = np.inf
        kth = np.partition(high, k - 1, axis=1)[:, k - 1] if len(v) > k else np.full(len(part), np.inf)
        keep = ~(low > kth[:, None] + slack * squares + LEAST) & ~own
        for i in range(len(part)):
            rows = np.flatnonzero(keep[i])
            exact = distances(original[a + i], originals[rows])
            order = np.lexsort((vids[rows], exact))[:k]
            qid = int(qids[a + i])
            for vid, score in zip(vids[rows[order]].tolist(), exact[order].tolist(), strict=True):
                yield qid, vid, score


def tile(k: int):
    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if queries.num_rows and vectors.num_rows:
            d = key[0].as_py()
            q, v = matrix(queries.column("vector"), d), matrix(vectors.column("vector"), d)
            rows = list(nearest_in_tile(queries.column("id").to_numpy(), q, vectors.column("id").to_numpy(), v, k))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def ranked(heaps: dict[int, list]) -> pa.RecordBatch:
    out = [(qid, rank, -v, -s) for qid, heap in heaps.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
    ids, ranks, vids, scores = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vids, pa.int64()), pa.array(scores, pa.float64()), pa.array(ranks, pa.int32())], ["query_id", "vec_id", "score", "rank"])


def merged(k: int):
    """Heaps of the k best of each query over the rows of a task, HELD queries at a time.

    Where rows are sorted by query these are the query's best; else a query may come again, with the best of later rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for qid, vid, score in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if qid not in heaps and len(heaps) >= HELD:
                    yield ranked(heaps)
                    heaps = {}
                heap = heaps.setdefault(qid, [])
                if len(heap) < k:
                    heapq.heappush(heap, (-score, -vid))
                elif (-score, -vid) > heap[0]:
                    heapq.heapreplace(heap, (-score, -vid))
        if heaps:
            yield ranked(heaps)

    return run


MERGED = TILE + ", rank int"


def clean(df: DataFrame) -> DataFrame:
    """(id, vector) of the rows that take part; single precision stays so until a tile computes with it."""
    single = df.schema["embedding"].dataType == ArrayType(FloatType())
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    return df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"))


def blocks(df: DataFrame) -> int:
    """Into how many blocks the rows are dealt."""
    numbers = df.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    return -(-8 * numbers // BLOCK_BYTES) or 1


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` (vec_id, embedding) for those of ``queries``.

    Nearness is the smallest Euclidean distance in double precision; ties go to the smaller vec_id, and a query's own
    vec_id is no neighbour. Rows whose vector is null, empty, zero or holds null or non-finite components, and rows
    without vec_id, take no part; of several rows of one vec_id each is a neighbour by itself, while such a query is
    answered once, from its least vector. Only vectors of the query's dimension are compared. Fewer candidates give
    fewer rows; an empty table gives none; other columns are not looked at.
    """
    spark = vectors.sparkSession
    q, v = clean(queries).groupBy("id").agg(F.min("vector").alias("vector")), clean(vectors)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_q, n_v = blocks(q), max(blocks(v), least)
    block = lambda name, n: F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias(name)
    size = F.size("vector").alias("size")
    left = q.select(size, block("row", n_q), every("column", n_v), "id", "vector")
    right = v.select(size, every("row", n_q), block("column", n_v), "id", "vector")
    tiles = left.groupBy("size", "row", "column").cogroup(right.groupBy("size", "row", "column")).applyInArrow(tile(k), TILE)
    first = tiles.mapInArrow(merged(k), MERGED).drop("rank")
    return first.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged(k), MERGED).select("query_id", "rank", "vec_id", "score")
