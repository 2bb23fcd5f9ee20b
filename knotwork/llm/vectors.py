"""What the vector searches share: which vectors take part, stated queries in
bounded blocks against all rows, and the merging of each partition's best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import new_path

#: Queries that are broadcast together, and rows that are scored together.
QUERY_BLOCK = 16_384
ROW_BLOCK = 8192


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows with an id and at least one component, all finite."""
    v = F.col(vector_column).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~odd)


def sampled(rows: DataFrame, sample: int) -> dict[int, list[np.ndarray]]:
    """Vectors of about ``sample`` rows of (vec_id, v) by their length: those of least hash, twice as many at most."""
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(sample / n * (1 << 30))).limit(2 * sample)
    by_length: dict[int, list[np.ndarray]] = {}
    for batch in rows.select("vec_id", "v").toArrow().to_batches() if n else ():
        for _, x in by_width(batch):
            by_length.setdefault(x.shape[1], []).append(x)
    return by_length


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, matrix, further columns) of the rows of each vector length; a further column
    is one of numbers, or of bytes, as many for all vectors of a length."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        more = [c.take(pa.array(rows)) for c in batch.columns[2:]]
        more = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(rows), -1) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in more]
        yield ids[rows], flat[starts[rows][:, None] + np.arange(width)], *more


def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of equal vector length, ROW_BLOCK together, smaller ids first in each block."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def joined(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    for batch in batches:
        for part in by_width(batch):
            parts = held.setdefault(part[1].shape[1], [])
            parts.append(part)
            if sum(len(p[0]) for p in parts) >= ROW_BLOCK:
                yield joined(held.pop(part[1].shape[1]))
    for parts in held.values():
        yield joined(parts)


class Best:
    """For each query its ``k`` largest scores, ties to smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n
        self.least = np.full(n, -np.inf) if least is None else np.where(np.isnan(least), -np.inf, least)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.found[query] is not None:
            scores, ids = np.concatenate([self.found[query][0], scores]), np.concatenate([self.found[query][1], ids])
        if len(scores) > self.k:
            at_least = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[at_least], ids[at_least]
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[query] = max(self.least[query], scores[order[-1]])

    def batch(self, query_ids: np.ndarray, kind: pa.DataType) -> pa.RecordBatch | None:
        rows = [i for i, x in enumerate(self.found) if x is not None and len(x[0])]
        if not rows:
            return None
        n = [len(self.found[i][0]) for i in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids[rows], n)), pa.array(np.concatenate([self.found[i][1] for i in rows])), pa.array(np.concatenate([self.found[i][0] for i in rows])).cast(kind)],
            ["query_id", "vec_id", "score"],
        )


Scan = Callable[[np.ndarray, np.ndarray], Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[tuple[np.ndarray, Best]]]]


def search(rows: DataFrame, asked: DataFrame, k: int, scan: Callable, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``asked`` the ``k`` best of ``rows``.

    ``scan(queries, blocks)`` runs in a task: queries is a list of (ids, matrix, further columns),
    one for each vector length, and blocks are those of ``row_blocks``, with any further
    columns of ``rows``; it gives
    (ids, Best).  An id asked for more than once is asked with its least vector.
    Queries are held and broadcast QUERY_BLOCK at a time; with several blocks
    each one's result is written before the next is read.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if rows.rdd.getNumPartitions() < context.defaultParallelism:
        rows = rows.repartition(context.defaultParallelism)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"), *(F.max(c).alias(c) for c in asked.columns if c not in ("vec_id", "v")))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kind = pa.int64() if score == "long" else pa.float64()

    def best(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, found in scan(shared.value, row_blocks(batches)):
                out = found.batch(ids, kind)
                if out is not None:
                    yield out

        per_task = rows.mapInArrow(run, f"query_id long, vec_id long, score {score}")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return per_task.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    path = new_path(spark, "search")
    for block in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).toArrow()
        shared = context.broadcast([x for b in part.combine_chunks().to_batches() for x in by_width(b)])
        found = best(shared)
        if n_blocks == 1:
            return found
        found.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.parquet(path)
