"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 64-bit key, the upper half from the text and the lower from
the id, so equal texts lie together and yet can be parted.  A shard's boundary that
falls among equal texts goes to where they begin or end, if that is within
``GROUP_TOLERANCE``; so only a group too large for that is parted.  Probes are put between
the least and largest possible key; each round counts, in every partition, the
exact bytes and rows below each probe, adds the counts up, and narrows each
boundary to the two probes around its target, until the boundaries are within
tolerance or no key lies between them.  One exchange then brings every row to its
range.

Ranges are finer than shards: a shard is several ranges, each small enough for one
task, and the rows below a range's start, known from the same counts, are where
its slots begin.  Only the narrow table of ids, sizes and keys is counted and moved.

Defined results: a null text has no bytes and the checksum of the empty text; rows
that repeat id and text have one key and stay in one shard; a null id is a value
of its own; a table without rows gives none.  Columns other than the two named are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import written

OVERHEAD = 16
LOW, HIGH = -(1 << 63), 1 << 63
#: Rows of a range, about, and ranges of a shard at least.
RANGE_ROWS, LEAST_RANGES = 500_000, 4
#: Ranges in all at most: what the driver counts doesn't grow beyond.
MOST_RANGES = 16_384
#: Probes of each open boundary in a round.
PROBES = 16
#: What a boundary may miss its target by: of a shard's bytes, and of a range's for those inside a shard.
TOLERANCE, INNER_TOLERANCE = 0.002, 0.25
#: What a shard's boundary may miss its target by, of a shard's bytes, to keep equal texts together.
GROUP_TOLERANCE = 0.004


def keyed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, sort_key)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    key = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.xxhash64(F.col(id_column)).bitwiseAND(F.lit((1 << 32) - 1)))
    return df.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("sort_key"))


def below(rows: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """(bytes, rows) with a key below each probe, and last of all rows."""
    edges = np.array(probes, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), "right")
            order = np.argsort(at, kind="stable")
            bins, first = np.unique(at[order], return_index=True)
            if len(bins):
                sizes[bins] += np.add.reduceat(batch.column(1).to_numpy()[order], first)
                counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used]), pa.array(counts[used])], ["bin", "bytes", "n"])

    found = rows.select("sort_key", "size").mapInArrow(run, "bin long, bytes long, n long").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    totals = np.zeros((len(edges) + 1, 2), object)
    for r in found:
        totals[r["bin"]] = r["bytes"], r["n"]
    return [tuple(map(int, x)) for x in np.cumsum(totals, axis=0)]


def splitters(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], int]:
    """(key, rows below it) of every range's start but the first, and the ranges of a shard."""
    probes = [LOW + (HIGH - LOW) * i // 1024 for i in range(1, 1024)]
    counted = below(rows, probes)
    total, n = counted[-1]
    per_shard = max(LEAST_RANGES, min(-(-n // (n_shards * RANGE_ROWS)), MOST_RANGES // n_shards))
    ranges = n_shards * per_shard
    known = {LOW: (0, 0), HIGH: (total, n), **dict(zip(probes, counted, strict=False))}
    chosen: dict[int, int] = {}
    while True:
        keys = sorted(known)
        amounts = np.array([known[k][0] for k in keys], np.float64)
        probes = []
        for j in range(1, ranges):
            if j in chosen:
                continue
            target = total * j / ranges
            at = int(np.searchsorted(amounts, target, "right")) - 1
            lower, upper = keys[at], keys[min(at + 1, len(keys) - 1)]
            nearest = min(lower, upper, key=lambda k: abs(known[k][0] - target))
            allowed = tolerance * total / n_shards if j % per_shard == 0 else INNER_TOLERANCE * total / ranges
            if abs(known[nearest][0] - target) <= allowed or upper - lower <= 1:
                chosen[j] = nearest
            else:
                step = max(1, (upper - lower) // (PROBES + 1))
                probes += [lower + step * i for i in range(1, PROBES + 1) if lower + step * i < upper]
        if not probes:
            break
        probes = sorted(set(probes))
        known.update(zip(probes, below(rows, probes), strict=False))

    groups = {j: ((k >> 32) << 32, ((k >> 32) + 1) << 32) for j, k in chosen.items() if j % per_shard == 0 and k % (1 << 32)}
    probes = sorted({k for ends in groups.values() for k in ends} - known.keys())
    if probes:
        known.update(zip(probes, below(rows, probes), strict=False))
    for j, ends in groups.items():
        target = total * j / ranges
        nearest = min(ends, key=lambda k: abs(known[k][0] - target))
        if abs(known[nearest][0] - target) <= GROUP_TOLERANCE * total / n_shards:
            chosen[j] = nearest
    return [(k, known[k][1]) for k in sorted(chosen.values())], per_shard


def sharded(df: DataFrame, n_shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, by the law ``bytes``."""
    rows = written(keyed(df, id_column, text_column), "keys")
    starts, per_shard = splitters(rows, n_shards)
    edges = np.array([k for k, _ in starts if k < HIGH], np.int64)
    rows_before = np.array([0, *(n for _, n in starts)], np.int64)
    first_slot = rows_before - rows_before[np.arange(len(rows_before)) // per_shard * per_shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(edges, batch.column("sort_key").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(first_slot[part])], [*batch.schema.names, "part", "first_slot"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, sort_key long, part int, first_slot long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("sort_key", "doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("part") / per_shard).cast("int").alias("shard"),
        (F.col("first_slot") + place - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
