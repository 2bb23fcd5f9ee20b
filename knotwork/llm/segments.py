"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are turned by an orthonormal basis, which leaves distances as they are, so that
their first components vary most: the principal axes of a bounded sample of the rows.
At every resolution a vector is cut into segments, the first components each on its own
and the rest as one, and a segment is described by its mean and standard deviation.
``sum L * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)`` is a lower bound of the
squared distance of q and x, and with the two norms an upper bound of their
inner product.  Resolutions go from coarse to fine; a pair leaves as soon as its bound
falls short of the query's k-th best score so far, for which in each block the pairs of
the best bounds are scored first.  The pairs that survive the finest resolution, and
they alone, are scored exactly.

Components are turned into floor(scale * x).  Scores are exact: in doubles where
they can't exceed 2^53, else in integers of any size, limited to those of 64 bits
at the end.  The basis moves no result, only what the bounds can exclude.

Defined results: vectors that are null or empty or hold null or non-finite
components take no part, nor do rows without an id; vectors of different length
aren't compared; a row never answers a query of its own id; other rows that
repeat an id are candidates each; ties go to the smaller id; fewer candidates
than k are all returned; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from knotwork.llm.vectors import Best, sampled, search, usable

#: Share of the components that stand on their own at each resolution, coarse to fine, and the one after which pairs are scored for a first threshold.
RESOLUTIONS, SEED = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8), 2
#: Rows, in expectation, from which the basis is taken.
SAMPLE = 20_000
#: Queries whose survivors are gathered together, and pairs that are scored at once.
TOGETHER, PAIRS = 64, 1 << 15
EXACT, MOST = float(1 << 53), 1e300


def features(x: np.ndarray, alone: int) -> np.ndarray:
    """Segment means and deviations, each times the root of the segment's length, so that
    squared differences of features add up to the lower bound: the first ``alone``
    components (of no deviation), then mean and deviation of the rest."""
    rest = x[:, alone:]
    if not rest.shape[1]:
        return x
    length = np.sqrt(rest.shape[1])
    return np.concatenate([x[:, :alone], rest.mean(1, keepdims=True) * length, rest.std(1, keepdims=True) * length], axis=1)


def lower_bounds(fq: np.ndarray, fx: np.ndarray) -> np.ndarray:
    return (fq**2).sum(1)[:, None] + (fx**2).sum(1) - 2 * (fq @ fx.T)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(np.clip(scale * x, -MOST, MOST))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of x of the same place."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    pairs = zip(q.tolist(), x.tolist(), strict=True)
    return np.array([max(1 - 2**63, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in pairs], np.int64)


class Rows:
    """Whole-number vectors with what the bounds need."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, basis: np.ndarray | None):
        self.ids, self.x = ids, x
        turned = x if basis is None else x @ basis
        self.norms = (x**2).sum(1)
        self.features = [features(turned, int(x.shape[1] * share)) for share in RESOLUTIONS]


def survivors(q: Rows, at: slice, x: Rows, best: Best) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``at``, place in x) of the pairs that no resolution excludes."""
    least = np.maximum(best.least[at], -MOST)
    norms = q.norms[at][:, None] + x.norms
    room = 1e-9 * norms + 1e-3  # for rounding
    columns, alive = np.arange(len(x.ids)), q.ids[at][:, None] != x.ids
    for i, (fq, fx) in enumerate(zip(q.features, x.features, strict=True)):
        low = lower_bounds(fq[at], fx[columns])
        if i == SEED and len(columns) > best.k:
            near = np.argpartition(np.where(alive, low, np.inf), best.k, axis=1)[:, : best.k]
            for j in np.flatnonzero(np.take_along_axis(alive, near, 1).all(1)):
                scores = exact_scores(np.repeat(q.x[at][j : j + 1], best.k, 0), x.x[columns[near[j]]])
                least[j] = max(least[j], scores.min())
        # a bound that isn't a number excludes nothing
        alive = alive & ~(low > (norms - 2 * least[:, None] + room)[:, columns])
        some = alive.any(0)
        columns, alive = columns[some], alive[:, some]
        if not len(columns):
            break
    query, row = np.nonzero(alive)
    return query, columns[row]


def scan(queries: list[tuple[np.ndarray, np.ndarray]], chunks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, scale: float, bases: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, Best]]:
    held = {rows.shape[1]: (Rows(ids, whole(rows, scale), bases.get(rows.shape[1])), Best(len(ids), k)) for ids, rows in queries}
    for ids, rows in chunks:
        if rows.shape[1] not in held:
            continue
        q, best = held[rows.shape[1]]
        x = Rows(ids, whole(rows, scale), bases.get(rows.shape[1]))
        for begin in range(0, len(q.ids), TOGETHER):
            at = slice(begin, begin + TOGETHER)
            query, row = survivors(q, at, x, best)
            scores = np.concatenate([np.zeros(0, np.int64), *(exact_scores(q.x[at][query[i : i + PAIRS]], x.x[row[i : i + PAIRS]]) for i in range(0, len(query), PAIRS))])
            edges = np.searchsorted(query, np.arange(len(q.ids[at]) + 1))
            for i in np.flatnonzero(np.diff(edges)):
                own = slice(edges[i], edges[i + 1])
                good = scores[own] >= best.least[begin + i]
                if good.any():
                    best.add(begin + i, scores[own][good], ids[row[own][good]])
    for q, best in held.values():
        yield q.ids, best


def fit(rows: DataFrame, sample: int = SAMPLE, scale: float = 1024.0) -> dict[int, np.ndarray]:
    """For each vector length the principal axes of about ``sample`` rows of (vec_id, v), most variance first."""
    bases = {}
    for width, parts in sampled(rows, sample).items():
        x = whole(np.concatenate(parts), scale)
        with np.errstate(all="ignore"):
            spread = np.cov(x.T).reshape(width, width)
        if len(x) > 1 and np.isfinite(spread).all():
            bases[width] = np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1])
    return bases


def top_k(df: DataFrame, asked: DataFrame, k: int = 10, scale: float = 1024.0, sample: int = SAMPLE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long) of the rows ``asked`` against those of ``df``."""
    rows = usable(df, id_column, vector_column)
    shared = df.sparkSession.sparkContext.broadcast(fit(rows, sample, scale))
    return search(rows, usable(asked, id_column, vector_column), k, lambda q, b: scan(q, b, k, scale, shared.value), "long")
