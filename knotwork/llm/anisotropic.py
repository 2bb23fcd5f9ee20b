"""Approximate nearest neighbours by largest inner product, with score-aware
anisotropic quantisation, four-bit table scans and exact reranking.

A vector x is its nearest coarse centre c plus s * u, with s the length of the
residual and u its direction.  u is cut into pairs of components and each pair
is coded by one of 16 centres, four bits.  Codes and centres are chosen to make

    eta * (error along x)^2 + (error across x)^2

small: the error along x is what shifts inner products with the queries that x
answers, so eta > 1 penalises it.  Codes are found by coordinate descent over the
pairs, centres by least squares with the same weights.  Because u has unit length
a tight cluster of near copies is coded as finely as any other.

The rows of a coarse centre are its list.  Each query first scans the list of the centre of
largest inner product; its ``k``-th best there is a bound, and of the other lists it
scans those that may hold better: q.c plus the length of q times the longest residual
of the list, in the block at hand, is the most that a row can reach.  So where vectors
lie in clusters most lists are left out, and nothing is lost by it.

A row also carries the factor that makes the coded vector's inner product with x
itself right, so no parallel error is left for the queries closest to x.  A query's
scan adds q.c and s times the sum of its table entries, two four-bit codes looked up
at once, and multiplies by that factor; of every block of rows the ``rerank`` best are scored
exactly, in doubles, and the ``k`` best of those remain.

Every row is coded, once, into a table of its own in the shared folder, and scanned;
only the quantiser is fitted on a sample of about ``sample`` rows, those of least hash.
Vectors of a length that the sample doesn't hold are scored exactly.

Defined results: vectors that are null, empty or zero or hold null or non-finite
components take no part, nor do rows without an id; vectors of different length
aren't compared; a row never answers a query of its own id; other rows that
repeat an id are candidates each; ties go to the smaller id; fewer candidates
than k are all returned; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import written
from knotwork.llm.vectors import Best, row_blocks, sampled, search, usable

CENTRES, CODES, PAIR = 64, 16, 2
#: Share of a score below which queries of a row aren't its neighbours; eta follows from it.
THRESHOLD = 0.2
#: Rows, in expectation, that the quantiser is fitted on.
SAMPLE = 20_000
#: Rows of a block that are scored exactly for each query.
RERANK = 100
#: Queries whose tables are built together, and partitions that a list is dealt to.
TOGETHER, PARTS = 128, 8


def eta(width: int, threshold: float = THRESHOLD) -> float:
    """The weight of parallel error against perpendicular error."""
    return max(1.0, (width - 1) * threshold**2 / (1 - threshold**2))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def _means(x: np.ndarray, codes: np.ndarray, old: np.ndarray) -> np.ndarray:
    counts = np.bincount(codes, minlength=len(old))
    sums = np.stack([np.bincount(codes, x[:, j], len(old)) for j in range(x.shape[1])], axis=1)
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        centres = _means(x, _nearest(x, centres), centres)
    return centres


class Quantiser:
    """Coarse centres and, for each pair of components, 16 centres of directions."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = sample.shape[1]
        self.pairs = -(-self.width // PAIR)
        self.centres = _lloyd(sample, CENTRES, 8, rng)
        parts, ways, _, _ = self._parts(sample)
        self.books = np.stack([_lloyd(parts[:, m], CODES, 8, rng) for m in range(self.pairs)])
        for _ in range(2):
            self._refit(parts, ways, self._codes(parts, ways))

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pairs * PAIR - self.width))).reshape(len(x), self.pairs, PAIR)

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Residual directions and directions of x by pair, coarse numbers, residual lengths."""
        coarse = _nearest(x, self.centres)
        residual = x - self.centres[coarse]
        length = np.sqrt((residual**2).sum(1))
        norm = np.sqrt((x**2).sum(1))
        return (
            self._padded(residual / np.where(length > 0, length, 1)[:, None]),
            self._padded(x / np.where(norm > 0, norm, 1)[:, None]),
            coarse,
            length,
        )

    def _codes(self, parts: np.ndarray, ways: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, pairs) that lower the anisotropic loss, from the nearest centres on."""
        codes = np.stack([_nearest(parts[:, m], self.books[m]) for m in range(self.pairs)], axis=1)
        rows = np.arange(len(parts))
        extra = eta(self.width) - 1
        along = sum(((parts[:, m] - self.books[m][codes[:, m]]) * ways[:, m]).sum(1) for m in range(self.pairs))
        for _ in range(sweeps):
            for m in range(self.pairs):
                error = parts[:, m, None] - self.books[m]
                own = (error * ways[:, m, None]).sum(2)
                rest = along - own[rows, codes[:, m]]
                best = (extra * (rest[:, None] + own) ** 2 + (error**2).sum(2)).argmin(1)
                codes[:, m], along = best, rest + own[rows, best]
        return codes

    def _refit(self, parts: np.ndarray, ways: np.ndarray, codes: np.ndarray) -> None:
        """Moves each centre to where the loss of the rows coded by it is least."""
        extra = eta(self.width) - 1
        error = [parts[:, m] - self.books[m][codes[:, m]] for m in range(self.pairs)]
        along = sum((e * ways[:, m]).sum(1) for m, e in enumerate(error))
        for m in range(self.pairs):
            w, code = ways[:, m], codes[:, m]
            want = along + (self.books[m][code] * w).sum(1)
            for c in np.unique(code):
                at = code == c
                left = extra * (w[at].T @ w[at]) + at.sum() * np.eye(PAIR)
                self.books[m][c] = np.linalg.solve(left, extra * (want[at] @ w[at]) + parts[at, m].sum(0))
            along = want - (self.books[m][code] * w).sum(1)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two four-bit codes a byte, coarse numbers, residual lengths and factors."""
        parts, ways, coarse, length = self._parts(x)
        codes = self._codes(parts, ways).astype(np.uint8)
        along = (self.centres[coarse] * x).sum(1)
        wide = self._padded(x)
        for m in range(self.pairs):
            along += length * (self.books[m][codes[:, m]] * wide[:, m]).sum(1)
        norms = (x**2).sum(1)
        factor = np.where(along > 0.5 * norms, norms / np.where(along > 0, along, 1), 1.0)
        if self.pairs % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] << 4 | codes[:, 1::2], coarse, length, factor

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each byte of codes adds to the score."""
        parts = self._padded(q)
        single = np.einsum("qmp,mcp->qmc", parts, self.books)
        if self.pairs % 2:
            single = np.pad(single, ((0, 0), (0, 1), (0, 0)))
        high, low = single[:, ::2], single[:, 1::2]
        return (high[..., :, None] + low[..., None, :]).reshape(len(q), -1, CODES * CODES).astype(np.float32)


def _chosen(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores; of equal ones the first."""
    if len(scores) <= most:
        return np.arange(len(scores))
    edge = np.partition(scores, -most)[-most]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: most - len(above)]])


def coded(rows: DataFrame, fitted: Broadcast) -> DataFrame:
    """(vec_id, v, codes, coarse, length, factor) of rows (vec_id, v); no codes for lengths without a quantiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in row_blocks(batches):
            model = fitted.value.get(x.shape[1])
            if model is None:
                codes, coarse, length, factor = np.zeros((len(ids), 0), np.uint8), *np.zeros((3, len(ids)))
            else:
                codes, coarse, length, factor = model.coded(x)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), vectors, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(coarse.astype(np.int32)), pa.array(length.astype(np.float32)), pa.array(factor.astype(np.float32))],
                ["vec_id", "v", "codes", "coarse", "length", "factor"],
            )

    return rows.mapInArrow(run, "vec_id long, v array<double>, codes binary, coarse int, length float, factor float")


def scan(queries: list[tuple[np.ndarray, ...]], blocks: Iterator[tuple[np.ndarray, ...]], k: int, rerank: int, fitted: dict[int, Quantiser], others: bool) -> Iterator[tuple[np.ndarray, Best]]:
    """The best rows of a task: of each query's own list or, with ``others``, of the lists that may beat its bound."""
    held = {}
    for ids, q, *bound in queries:
        model = fitted.get(q.shape[1])
        near = q @ model.centres.T if model is not None else np.zeros((len(q), 1))
        held[q.shape[1]] = ids, q, near, near.argmax(1), np.sqrt((q**2).sum(1)), Best(len(ids), k, *bound)
    for ids, x, packed, coarse, length, factor in blocks:
        if x.shape[1] not in held:
            continue
        query_ids, q, near, own, norms, best = held[x.shape[1]]
        model = fitted.get(x.shape[1])
        lists, row_list = np.unique(coarse, return_inverse=True)
        if others:
            reach = np.zeros(len(lists))
            np.maximum.at(reach, row_list, length)
            most = near[:, lists] + norms[:, None] * reach
            open_lists = (most * (1 + 1e-6) + 1e-6 * norms[:, None] >= best.least[:, None]) & (own[:, None] != lists)
        else:
            open_lists = own[:, None] == lists
        columns = np.ascontiguousarray(packed.T).astype(np.intp)
        asking = np.flatnonzero(open_lists.any(1))
        for begin in range(0, len(asking), TOGETHER):
            some = asking[begin : begin + TOGETHER]
            tables = model.tables(q[some]) if model is not None else None
            for i, query in enumerate(some):
                rows = np.flatnonzero(open_lists[query][row_list]) if not open_lists[query].all() else np.arange(len(x))
                if model is not None:
                    total = np.zeros(len(rows), np.float32)
                    whole = len(rows) == len(x)
                    for b, column in enumerate(columns):
                        total += np.take(tables[i, b], column if whole else column[rows], mode="clip")
                    total = (total * length[rows] + near[query].astype(np.float32)[coarse[rows]]) * factor[rows]
                    rows = rows[_chosen(total, rerank + 1)]
                rows = rows[ids[rows] != query_ids[query]]
                scores = (x[rows] * q[query]).sum(1)
                good = scores >= best.least[query]
                if good.any():
                    best.add(query, scores[good], ids[rows[good]])
    for query_ids, *_, best in held.values():
        yield query_ids, best


def nearest(df: DataFrame, asked: DataFrame, k: int = 20, sample: int = SAMPLE, rerank: int = RERANK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score double) of the rows ``asked`` against those of ``df``."""
    nonzero = F.exists("v", lambda c: c != 0)
    rows = usable(df, id_column, vector_column).filter(nonzero)
    asked = usable(asked, id_column, vector_column).filter(nonzero)
    fitted = {width: Quantiser(np.concatenate(parts)) for width, parts in sampled(rows, sample).items()}
    shared = df.sparkSession.sparkContext.broadcast(fitted)
    # the rows of a list lie together, those of a large one in several partitions
    index = coded(rows, shared).repartition("coarse", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).sortWithinPartitions("coarse")
    index = written(index, "codes")
    first = written(search(index, asked, k, lambda q, b: scan(q, b, k, rerank, shared.value, False), "double"), "first")
    bound = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = search(index, asked.join(bound, "vec_id", "left"), k, lambda q, b: scan(q, b, k, rerank, shared.value, True), "double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.union(rest).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
