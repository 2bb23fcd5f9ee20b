"""Best-fit packing of token sequences into bins of several permitted lengths.

Documents come as token ids; each gets an end mark, and one longer than the largest
length is cut into pieces of it and a rest.  Pieces are dealt to cells by a hash of
the row, so that equal rows spread; a cell, of about ``CELL_TOKENS`` tokens, is packed
on its own, in decreasing order of length: a piece goes to the open bin that it fills
best; where none has room, a bin is opened of the length whose cost per token is least,
given what is left to fill it with.  The lengths are chosen together: a cell is packed
once for each set of lengths that leaves out the largest ones (a piece that needs one
of those gets it all the same, and its room takes smaller pieces), opening the least
cost or the largest of the set, and the cheapest packing is kept.  At the end every
bin is cut down to the least permitted length that holds its contents.

The cost of a bin is its length, plus a part that grows with the square of the
length as attention does, plus a fixed part for each sequence.

Defined results: null ids count as none, so that an end mark alone is packed; rows that
repeat are packed each; pieces of equal length go in order of id and piece; a table
without rows gives no bins.  Columns other than the two named are not read.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.bpe import encoder_of, ragged, text_blocks, vocabulary_file
from knotwork.llm.common import released, written
from knotwork.llm.shingles import blocks

CAPACITIES = (2048, 4096, 8192, 16384)
#: Tokens and pieces of a cell, about, and shuffle partitions at most; a partition may hold several cells.
CELL_TOKENS, CELL_PIECES, PARTITIONS = 1 << 22, 1 << 16, 32_768
#: Tokens of bins that leave Python together, and bytes of a token, about.
OUT_TOKENS, TOKEN_BYTES = 1 << 19, 3
#: Length at which the square part of the cost equals the linear one, and the fixed part.
SQUARE, FIXED = 65_536, 32


def bin_cost(capacity: int) -> float:
    return capacity * (1 + capacity / SQUARE) + FIXED


def _opened(length: int, left: int, capacities: tuple[int, ...], cost: Callable[[int], float]) -> int:
    """The permitted length of least cost for each token that it can come to hold."""
    return min((c for c in capacities if c >= length), key=lambda c: (cost(c) / max(1, min(c, length + left)), c))


def _fit(lengths: list[int], capacities: tuple[int, ...], chosen: int, cost: Callable[[int], float], greedy: bool) -> tuple[list[int], list[int]]:
    """Bin of each piece and contents of each bin, opened from the first ``chosen`` capacities
    where these suffice; the lengths come in decreasing order."""
    spaces: list[int] = []  # distinct spaces of open bins, ascending
    with_space: dict[int, list[int]] = {}
    where, held, capacity = [], [], []
    left = sum(lengths)
    for length in lengths:
        left -= length
        at = bisect_left(spaces, length)
        if at < len(spaces):
            space = spaces[at]
            number = with_space[space].pop()
            if not with_space[space]:
                del with_space[space], spaces[at]
        else:
            number = len(held)
            if length > capacities[chosen - 1]:
                opened = capacities[bisect_left(capacities, length)]
            elif greedy:
                opened = capacities[chosen - 1]
            else:
                opened = _opened(length, left, capacities[:chosen], cost)
            capacity.append(opened)
            held.append(0)
        where.append(number)
        held[number] += length
        space = capacity[number] - held[number]
        if space not in with_space:
            insort(spaces, space)
            with_space[space] = []
        with_space[space].append(number)
    return where, held


def downsized(held: list[int], capacities: tuple[int, ...]) -> list[int]:
    return [capacities[bisect_left(capacities, h)] for h in held]


def pack_cell(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int]]:
    """Bin of each of ``lengths`` (none above the last capacity) and length of each bin."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = [lengths[i] for i in order]
    best = None
    for n in range(1, len(capacities) + 1):
        for greedy in (False, True):
            where, held = _fit(falling, capacities, n, cost, greedy)
            sizes = downsized(held, capacities)
            total = sum(map(cost, sizes))
            if best is None or total < best[0]:
                best = total, where, sizes
    if best is None:
        return [], []
    out = [0] * len(lengths)
    for i, number in zip(order, best[1], strict=True):
        out[i] = number
    return out, best[2]


def cut_up(flat: np.ndarray, offsets: np.ndarray, end: int, most: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and length of each piece of documents with their end marks, and all their tokens."""
    n = np.diff(offsets) + 1
    ends = np.cumsum(n)
    tokens = np.full(int(ends[-1]) if len(n) else 0, end, kind)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = flat
    counts = -(-n // most)
    row = np.repeat(np.arange(len(n)), counts)
    number = ragged(np.zeros(len(n), np.int64), counts)
    return row, number, np.minimum(n[row] - number * most, most), tokens


def _pieces(doc_ids: pa.Array, rows: pa.Array, flat: np.ndarray, offsets: np.ndarray, end: int, most: int, kind: np.dtype) -> pa.RecordBatch:
    row, number, lengths, tokens = cut_up(flat, offsets, end, most, kind)
    at = pa.array(row)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * np.int32(tokens.itemsize)
    held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(tokens))])
    return pa.RecordBatch.from_arrays([doc_ids.take(at), rows.take(at), pa.array(number.astype(np.int32)), pa.array(lengths.astype(np.int32)), held], ["doc_id", "row", "piece", "length", "tokens"])


def _schema(doc_kind: str) -> str:
    return f"doc_id {doc_kind}, row long, piece int, length int, tokens binary"


def packed(df: DataFrame, end: int, capacities: tuple[int, ...] = CAPACITIES, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(cell, bin, capacity, n_tokens, doc_ids, pieces, lengths, ids): a row for every bin,
    with the pieces in it in order of place and their tokens, one after the other."""
    capacities = tuple(sorted(set(capacities)))
    ids = F.coalesce(F.col(ids_column).cast("array<int>"), F.array().cast("array<int>"))
    rows = written(df.select(F.col(id_column).alias("doc_id"), ids.alias("ids")), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            yield _pieces(batch.column(0), batch.column(1), lists.flatten().to_numpy(), offsets - offsets[0], end, capacities[-1], np.dtype(np.int32))

    n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).collect()[0]
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids").mapInArrow(run, _schema(kind))
    return _binned(cut, n, tokens, capacities, np.dtype(np.int32))


def packed_texts(df: DataFrame, rank_file: str, pattern: str, end: int, capacities: tuple[int, ...] = CAPACITIES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``packed`` of the tokens of texts, which go from the tokeniser to their cells and are
    not stored between.  ``df`` is a stored table, so that a row's number is the same
    whenever it is read."""
    capacities = tuple(sorted(set(capacities)))
    shared = vocabulary_file(df.sparkSession, rank_file)
    kind = np.dtype(np.uint16 if end <= 0xFFFF else np.int32)  # ``end`` is above all ids of the rank file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        if encoder.vocabulary.size > end:
            raise ValueError("the end mark is an id of the vocabulary")
        for batch in text_blocks(batches, 2):
            yield _pieces(batch.column(0), batch.column(1), *encoder.encode(batch.column(2)), end, capacities[-1], kind)

    text = F.col(text_column)
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).collect()[0]
    rows = df.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.cast("string").alias("text"))
    return _binned(rows.mapInArrow(run, _schema(rows.schema["doc_id"].dataType.simpleString())), n, n + size // TOKEN_BYTES, capacities, kind)


def _binned(cut: DataFrame, n: int, tokens: int, capacities: tuple[int, ...], token_kind: np.dtype) -> DataFrame:
    n_cells = max(1, round(max(n / CELL_PIECES, tokens / CELL_TOKENS)))
    kind = cut.schema["doc_id"].dataType.simpleString()
    cut = cut.select("doc_id", "piece", "length", "tokens", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(n_cells)).alias("cell"))
    dealt = cut.repartition(min(n_cells, PARTITIONS), "cell").sortWithinPartitions("cell", F.desc("length"), "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            lengths = t.column("length").to_numpy().astype(np.int64)
            where, sizes = pack_cell(lengths.tolist(), capacities)
            order = np.argsort(where, kind="stable")
            starts = np.cumsum(lengths) - lengths
            flat = np.concatenate([_bytes(c) for c in t.column("tokens").chunks]).view(token_kind)
            starts, lengths = starts[order], lengths[order]
            edges = np.searchsorted(np.array(where)[order], np.arange(len(sizes) + 1))
            filled = np.add.reduceat(lengths, edges[:-1])
            doc_ids, numbers = t.column("doc_id").take(pa.array(order)).combine_chunks(), t.column("piece").take(pa.array(order)).combine_chunks()
            for begin, stop in blocks(filled.tolist(), OUT_TOKENS):
                a, b = int(edges[begin]), int(edges[stop])
                held = pa.array(edges[begin : stop + 1] - a, pa.int32())
                at = pa.array(np.concatenate([[0], np.cumsum(filled[begin:stop])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(stop - begin, t.column("cell")[0].as_py())),
                        pa.array(np.arange(begin, stop, dtype=np.int32)),
                        pa.array(sizes[begin:stop], pa.int32()),
                        pa.array(filled[begin:stop].astype(np.int32)),
                        *(pa.ListArray.from_arrays(held, x.slice(a, b - a)) for x in (doc_ids, numbers)),
                        pa.ListArray.from_arrays(held, pa.array(lengths[a:b].astype(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(flat[ragged(starts[a:b], lengths[a:b])].astype(np.int32))),
                    ],
                    ["cell", "bin", "capacity", "n_tokens", "doc_ids", "pieces", "lengths", "ids"],
                )

    return dealt.mapInArrow(run, f"cell long, bin int, capacity int, n_tokens int, doc_ids array<{kind}>, pieces array<int>, lengths array<int>, ids array<int>")


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column, one value after the other."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, which come together."""
    held: list[pa.RecordBatch] = []
    for batch in released(batches):
        cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for begin, end in itertools.pairwise(cuts):
            if begin == end:
                continue
            if held and held[0].column("cell")[0].as_py() != cells[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)
