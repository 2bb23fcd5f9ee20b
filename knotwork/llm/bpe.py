"""Byte-level BPE encoding and decoding over padded numpy matrices.

Texts are cut into pieces by numpy where the pattern is the byte-level one (``CUT``):
code points have classes, pieces are runs of one, and a few rules about blanks and
apostrophes move their edges; any other pattern goes through ``regex``.  Pieces are
known by two 64-bit hashes of their bytes.

The pieces that a worker hasn't met are grouped into length buckets, powers of two,
and laid out as padded matrices of symbol ids, one piece a row.  In each round every
row merges its leftmost pair of least rank; ranks come from an open-addressing hash
table over symbol pairs, rows are closed up after a merge, and rows without a merge
left leave the matrix.  In the matrices of pieces over ``NARROW`` bytes a row merges
all its pairs of least rank in a round, as long as no pair that comes up on the way
could go before the next of them: there merging them together and one after the other
is the same.  So a round serves many merges, and long runs don't cost the square of
their length.  Matrices are bounded by cells.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; equal texts get equal ids; a table without rows gives none;
columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import released, sliced
from knotwork.llm.shingles import blocks

NO_RANK = np.int32(1 << 30)  # above every id
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of pieces whose rows merge one pair in a round; cells of a matrix; pieces that a worker remembers, and their ids.
NARROW, CELLS, REMEMBERED, REMEMBERED_IDS = 64, 1 << 18, 1 << 19, 1 << 22
#: Bytes of text that are tokenised together.
BLOCK_BYTES = 1 << 19


class PairTable:
    """(left id, right id) -> id of the merged symbol, by hashing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY, np.uint64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        slots, left = self.home(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == EMPTY
            _, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], values[won]
            placed = np.zeros(len(keys), bool)
            placed[won] = True
            left = left[~placed[left]]
            taken = self.keys[slots[left]] != EMPTY
            slots[left[taken]] = (slots[left[taken]] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NO_RANK for one that can't merge or has a negative id."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self.home(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], NO_RANK)
        more = np.flatnonzero((held != keys) & (held != EMPTY))
        while len(more):
            slots[more] = (slots[more] + 1) & self.mask
            held = self.keys[slots[more]]
            hit = held == keys[more]
            out[more[hit]] = self.values[slots[more[hit]]]
            more = more[~hit & (held != EMPTY)]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out


class Vocabulary:
    """Token bytes, their ranks and the pair table of a rank file (base64 token and rank a line)."""

    def __init__(self, rank_file: bytes):
        rows = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        size = self.size = max(self.ranks.values(), default=-1) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        pool = bytearray(int(self.starts[-1]))
        for token, rank in self.ranks.items():
            pool[self.starts[rank] : self.starts[rank] + len(token)] = token
        self.pool = np.frombuffer(bytes(pool), np.uint8)
        self.bytes_of = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.uint64), np.array(values, np.int32))
        self.encoders: dict[str, Encoder] = {}

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces and the offsets of each."""
        counts = np.zeros(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, matrix, counts
        lengths = np.array([len(p) for p in pieces], np.int64)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        rows = np.flatnonzero(whole >= 0)
        done.append((rows, whole[rows][:, None], np.ones(len(rows), np.int64)))
        width = np.left_shift(4, np.maximum(0, np.ceil(np.log2(np.maximum(lengths, 1))) - 2).astype(np.int64))
        width[whole >= 0] = 0
        for w in np.unique(width[width > 0]):
            rows, most = np.flatnonzero(width == w), max(1, CELLS // int(w))
            merge = self._merge_rows if w <= NARROW else self._merge_wide
            for begin in range(0, len(rows), most):
                some = rows[begin : begin + most]
                done.append((some, *merge([pieces[i] for i in some], lengths[some], int(w))))
        for rows, _, n in done:
            counts[rows] = n
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(int(offsets[-1]), np.int32)
        for rows, matrix, n in done:
            columns = np.arange(matrix.shape[1])
            filled = columns < n[:, None]
            flat[(offsets[rows][:, None] + columns)[filled]] = matrix[filled]
        return flat, offsets

    def _merge_rows(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.full((len(pieces), width), -1, np.int32)
        symbols[np.arange(width) < lengths[:, None]] = self.bytes_of[np.frombuffer(b"".join(pieces), np.uint8)]
        counts = lengths.copy()
        out = symbols.copy()
        active = np.arange(len(pieces))
        ranks = np.full((len(pieces), width), NO_RANK, np.int32)
        ranks[:, :-1] = self.pairs.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(pieces), width - 1)
        columns = np.arange(width)
        while len(active):
            at = ranks.argmin(1)
            row = np.arange(len(active))
            best = ranks[row, at]
            going = best < NO_RANK
            if not going.all():
                out[active[~going]] = symbols[~going]
                active, symbols, ranks, at, best = active[going], symbols[going], ranks[going], at[going], best[going]
                row = np.arange(len(active))
                if not len(active):
                    break
            symbols[row, at] = best
            counts[active] -= 1
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, 1)
            symbols[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
            ranks[:, -1] = NO_RANK
            ranks[row, at] = self.pairs.find(best, np.where(at + 1 < width, symbols[row, np.minimum(at + 1, width - 1)], -1))
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pairs.find(symbols[inner, at[inner] - 1], best[inner])
        return out, counts

    def _merge_wide(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``_merge_rows``, but a row merges all its pairs of least rank that can't get in each other's way."""
        out = np.full((len(pieces), width), -1, np.int32)
        symbols = np.full((len(pieces), width + 2), -1, np.int32)  # two more, so that every place has two to its right
        symbols[:, :width][np.arange(width) < lengths[:, None]] = self.bytes_of[np.frombuffer(b"".join(pieces), np.uint8)]
        counts, held, active = lengths.copy(), lengths.copy(), np.arange(len(pieces))
        ranks = np.full(symbols.shape, NO_RANK, np.int32)
        ranks[:, :-1] = self.pairs.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(pieces), -1)
        while True:
            best = ranks.min(1)
            going = best < NO_RANK
            if not going.all():
                rows = active[~going]
                out[rows, : min(width, symbols.shape[1])], counts[rows] = symbols[~going][:, :width], held[~going]
                active, symbols, ranks, best, held = active[going], symbols[going], ranks[going], best[going], held[going]
                if not len(active):
                    return out, counts
            columns = np.arange(symbols.shape[1])
            hit = ranks == best[:, None]
            opens = hit.copy()
            opens[:, 1:] &= ~hit[:, :-1]
            hit &= (columns - np.maximum.accumulate(np.where(opens, columns, -1), axis=1)) % 2 == 0  # of a run every second one
            row, at = np.nonzero(hit)
            after = self.pairs.find(best[row], symbols[row, at + 2])
            before = np.where(at > 0, symbols[row, at - 1], -1)
            before[(at > 1) & hit[row, at - 2]] = best[row][(at > 1) & hit[row, at - 2]]
            before = self.pairs.find(before, best[row])
            risky = np.zeros(len(active), bool)
            risky[row[np.minimum(before, after) <= best[row]]] = True
            if risky.any():
                first = hit[risky].argmax(1)
                hit[risky] = columns == first[:, None]
                row, at = np.nonzero(hit)
            symbols[row, at] = best[row]
            keep = columns < held[:, None]
            keep[row, at + 1] = False
            held -= hit.sum(1)
            place = keep.cumsum(1) - 1
            old_row, old = np.nonzero(keep)
            new = place[old_row, old]
            size = int(held.max()) + 2
            closed, closed_ranks = np.full((len(active), size), -1, np.int32), np.full((len(active), size), NO_RANK, np.int32)
            closed[old_row, new], closed_ranks[old_row, new] = symbols[old_row, old], ranks[old_row, old]
            symbols, ranks, at = closed, closed_ranks, place[row, at]
            ranks[row, at] = self.pairs.find(symbols[row, at], symbols[row, at + 1])
            row, at = row[at > 0], at[at > 0]
            ranks[row, at - 1] = self.pairs.find(symbols[row, at - 1], symbols[row, at])

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids and the offsets of each text in them."""
        starts, stops = self.starts[ids], self.starts[ids + 1]
        lengths = stops - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[ragged(starts, lengths)], ends[offsets]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: The pattern whose pieces are cut by ``cut``.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_classes: list[np.ndarray] = []
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def classes() -> np.ndarray:
    """The class of every code point, built once in a worker."""
    if not _classes:
        import regex

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(name, every):
                begin, end = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
                table[begin:end] = kind
                if begin < 0xD800 and end > 0xE000:
                    table[0xD800:0xE000] = OTHER
        _classes.append(table)
    return _classes[0]


def cut(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of several texts, which end at ``ends``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # whether a text begins here
    first[0] = True
    first[ends] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run)
    stops = np.append(starts[1:], n)
    begins = run.copy()
    # of blanks before something else the last stands alone, or goes with what follows if it is a plain one
    blanks = (kind[starts] == SPACE) & ~first[stops]
    last = stops[blanks] - 1
    begins[last] = True
    plain = points[last] == 32
    begins[stops[blanks][plain]] = False
    # an apostrophe alone, not after a plain blank, takes what it shortens
    mark = np.flatnonzero((points[starts] == 39) & (stops - starts == 1) & begins[starts] & ~first[stops])
    mark = mark[kind[stops[mark]] == LETTER]
    at, end = starts[mark], stops[mark + 1]
    one = points[at + 1]
    two = np.where(at + 2 < end, points[np.minimum(at + 2, n - 1)], 0)
    single = (one == 115) | (one == 116) | (one == 109) | (one == 100)
    double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    begins[at[single | double] + 1] = False
    for which, size in ((single, 2), (double & ~single, 3)):
        after = at[which] + size
        begins[after[after < end[which]]] = True
    return np.flatnonzero(begins)


def parted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The offsets of texts, with places between in those longer than ``BLOCK_BYTES`` at which
    a piece begins whatever comes before: a blank between two visible ASCII characters."""
    out = [offsets]
    for text in np.flatnonzero(np.diff(offsets) > BLOCK_BYTES):
        at, end = int(offsets[text]) + BLOCK_BYTES, int(offsets[text + 1])
        while at < end - 1:
            part = data[at - 1 : min(at + BLOCK_BYTES, end)]
            seen = (part > 32) & (part < 127)
            free = np.flatnonzero((part[1:-1] == 32) & seen[:-2] & seen[2:])
            if len(free):
                at += int(free[0])
                out.append(np.array([at]))
            at += BLOCK_BYTES
    return np.unique(np.concatenate(out)) if len(out) > 1 else offsets


def _powers_to(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for base in _BASES:
            both = []
            for step in (base, pow(base, -1, 1 << 64)):
                steps = np.full(max(n, BLOCK_BYTES + 1), step, np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            _powers.append((both[0], both[1]))
    return _powers


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each stretch of bytes."""
    out = []
    for (power, inverse), salt in zip(_powers_to(len(data) + 1), (SPREAD, SPREAD + np.uint64(2)), strict=True):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        mixed = ((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)) * salt
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return out


class _Numbers(dict):
    """Numbers its keys in order of first sight."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Encoder:
    """A vocabulary, and the ids of the pieces that it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.findall = None if pattern == CUT else compiled(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # by key: the hashes of the pieces known
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)  # and where their ids are
        self.flat = np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each; a null counts as empty."""
        texts = pa.compute.fill_null(texts, "")
        if self.findall is not None:
            return self._by_pattern(texts.to_pylist())
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        bounds = parted(data, offsets)
        ids, before = [], np.zeros(len(bounds), np.int64)  # ids before each bound
        for begin, end in blocks(np.diff(bounds).tolist(), BLOCK_BYTES):
            some, ends = self._block(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin])
            before[begin + 1 : end + 1] = before[begin] + ends[1:]
            ids.append(some)
        return np.concatenate([np.zeros(0, np.int32), *ids]), before[np.searchsorted(bounds, offsets)]

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, given as bytes and offsets, and the offsets of each."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin among the bytes
        begins = cut(points, np.searchsorted(heads, offsets[1:]))
        starts = heads[begins]
        ids, counts = self._looked_up(data, starts, np.append(starts[1:], len(data)))
        pieces = np.searchsorted(starts, offsets)
        return ids, np.concatenate([[0], np.cumsum(counts)])[pieces]

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pieces of the data, and how many each has."""
        key, check = hashes(data, starts, stops)
        found, one, which = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == found
        if not (np.array_equal(check, check[one][which]) and np.array_equal(self.checks[place[known]], check[one][known])):
            # two pieces of one hash: this block's are merged without being remembered
            flat, ends = self.vocabulary.encode_pieces([data[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
            return flat, np.diff(ends)
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[one[new]], stops[one[new]]
            flat, ends = self.vocabulary.encode_pieces([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            if len(self.keys) + len(new) > REMEMBERED or len(self.flat) + len(flat) > REMEMBERED_IDS:
                keep = np.flatnonzero(known)  # what this block has in common with those before it, and its own
                kept_starts, kept_lengths = self.starts[place[keep]], self.lengths[place[keep]]
                old = self.flat[ragged(kept_starts, kept_lengths)]
                self.keys, self.checks = found[keep], check[one[keep]]
                self.lengths, self.flat = kept_lengths, old
                self.starts = np.concatenate([[0], np.cumsum(kept_lengths)[:-1]]).astype(np.int64) if len(keep) else np.zeros(0, np.int64)
            at = np.searchsorted(self.keys, found[new])
            self.keys, self.checks = np.insert(self.keys, at, found[new]), np.insert(self.checks, at, check[one[new]])
            self.starts, self.lengths = np.insert(self.starts, at, ends[:-1] + len(self.flat)), np.insert(self.lengths, at, np.diff(ends))
            self.flat = np.concatenate([self.flat, flat])
            place = np.searchsorted(self.keys, found)
        begins, counts = self.starts[place][which], self.lengths[place][which]
        return self.flat[ragged(begins, counts)], counts

    def _by_pattern(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers = _Numbers()
        pieces, per_text = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            found = np.fromiter(map(numbers.__getitem__, self.findall(text)), np.int64)
            per_text[i + 1] = len(found)
            pieces.append(found)
        flat, offsets = self.vocabulary.encode_pieces([w.encode() for w in numbers])
        used = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        lengths = offsets[used + 1] - offsets[used]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ragged(offsets[used], lengths)], ends[np.cumsum(per_text)]


def encode_texts(texts: list[str], vocabulary: Vocabulary, pattern: str = CUT) -> tuple[np.ndarray, np.ndarray]:
    return Encoder(vocabulary, pattern).encode(pa.array(texts, pa.string()))


def text_blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``BLOCK_BYTES`` of text; a longer text stands alone."""
    for batch in released(batches):
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for begin, end in blocks(sizes.tolist(), BLOCK_BYTES):
            yield batch.slice(begin, end - begin)


def compiled(pattern: str):
    """``pattern`` with white space as Unicode's White_Space, as the tokenisers' engines have it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def vocabulary_file(spark: SparkSession, rank_file: str) -> Broadcast:
    """The bytes of a rank file, for all workers."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>), and ``decoded`` binary, the bytes that these ids stand for, if asked for.

    The rank file is read on the driver, its size is that of a vocabulary, and
    it is broadcast once; each Python worker builds its tables once.
    """
    shared = vocabulary_file(df.sparkSession, rank_file)
    kind = df.schema[id_column].dataType.simpleString()
    out = f"`{id_column}` {kind}, ids array<int>" + (", decoded binary" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        for batch in text_blocks(batches, 1):
            ids, offsets = encoder.encode(batch.column(1))
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                data, ends = encoder.vocabulary.decode_flat(ids, offsets)
                columns.append(pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "decoded"][: len(columns)])

    return df.select(id_column, text_column).mapInArrow(run, out)


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary_of(rank_file: bytes) -> Vocabulary:
    """Built once in a worker."""
    key = hash(rank_file)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(rank_file)
    return _VOCABULARIES[key]


def encoder_of(rank_file: bytes, pattern: str) -> Encoder:
    """Built once in a worker."""
    vocabulary = vocabulary_of(rank_file)
    held = vocabulary.encoders
    if pattern not in held:
        held[pattern] = Encoder(vocabulary, pattern)
    return held[pattern]


def decode(df: DataFrame, rank_file: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, decoded binary) of rows with ids; null ids count as none."""
    shared = vocabulary_file(df.sparkSession, rank_file)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(shared.value)
        for batch in sliced(batches):
            lists = batch.column(1)
            lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            data, ends = vocabulary.decode_flat(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])], [id_column, "decoded"])

    return df.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Per row of ``encode(..., decoded=True)``: number of ids, SHA-256 of the ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
