import base64
import itertools
import random
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

from knotwork.llm import packing, queries


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, ids string, cell int, tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op8_best_fit(spark, str(tmp_path)).collect()


def least_cost(lengths, capacities):
    """Over every way to split the lengths into bins."""
    if not lengths:
        return 0.0
    first, rest = lengths[0], lengths[1:]
    best = float("inf")
    for n in range(len(rest) + 1):
        for others in itertools.combinations(range(len(rest)), n):
            total = first + sum(rest[i] for i in others)
            if total <= capacities[-1]:
                cost = packing.bin_cost(next(c for c in capacities if c >= total))
                best = min(best, cost + least_cost([x for i, x in enumerate(rest) if i not in others], capacities))
    return best


def test_cells_against_the_best_of_all_splits():
    rng = random.Random(3)
    ratios = []
    for _ in range(30):
        lengths = [rng.choice([0, 1, 300, 900, 1500, 2047, 3000, 5000, 8192, 12_000, 16_384]) for _ in range(6)]
        where, sizes = packing.pack_cell(lengths)
        held = Counter()
        for x, b in zip(lengths, where, strict=True):
            held[b] += x
        assert sizes == packing.downsized([held[b] for b in range(len(sizes))], packing.CAPACITIES)
        ratios.append(sum(map(packing.bin_cost, sizes)) / least_cost(lengths, packing.CAPACITIES))
    assert min(ratios) >= 1 - 1e-9 and sum(ratios) / len(ratios) < 1.03 and max(ratios) < 1.25


def test_a_large_piece_does_not_decide_for_the_others():
    """With one piece of the largest length, the others are packed as cheaply as without it."""
    rng = random.Random(5)
    others = [rng.choice([300, 700, 1100, 1500, 1900]) for _ in range(200)]
    cost = lambda x: sum(map(packing.bin_cost, packing.pack_cell(x)[1]))
    assert cost([*others, 16_384]) <= cost(others) + packing.bin_cost(16_384) + 1e-9
    assert set(packing.pack_cell([*others, 16_384])[1]) > {16_384}


def test_every_token_once_and_bins_as_their_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 100)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANK_FILE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["é", "word", "Übung", "x1"]) for _ in range(rng.randrange(2500))), "odd", 1, 2) for i in range(700)]
    rows += [(1000, None, "odd", 1, 2), (1001, "", "odd", 1, 2), (1002, "x y " * 30_000, "odd", 1, 2), (None, "no id", "odd", 1, 2), (5, "again", "odd", 1, 2), (5, "again", "odd", 1, 2)]
    got = run(spark, tmp_path, rows)
    assert len({r.cell for r in got}) > 1 and len({(r.cell, r.bin) for r in got}) == len(got)
    parts = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.n_tokens == sum(r.lengths) and len(r.doc_ids) == len(r.pieces) == len(r.lengths)
        assert r.capacity == next(c for c in packing.CAPACITIES if c >= r.n_tokens)
        at = 0
        for d, piece, n in zip(r.doc_ids, r.pieces, r.lengths, strict=True):
            parts[d].append((piece, r.ids[at : at + n]))
            at += n
    want = defaultdict(list)
    for d, t, *_ in rows:
        ids = [*own.encode_ordinary(t or ""), queries.END]
        want[d] += [(i, ids[b : b + 16_384]) for i, b in enumerate(range(0, len(ids), 16_384))]
    assert {d: sorted(p) for d, p in parts.items()} == {d: sorted(p) for d, p in want.items()}
    assert sum(len(i) for p in want.values() for _, i in p) / sum(r.capacity for r in got) > 0.9


def test_given_tokens_are_packed_as_texts_are(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 30)
    rng = random.Random(6)
    rows = [(f"d{i}", [rng.randrange(100_000) for _ in range(rng.choice([0, 1, 50, 3000, 40_000]))], 1) for i in range(60)] + [(None, [7], 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "name string, ids array<int>, tokens int")
    got = packing.packed(df, 100_000, (512, 4096), "name").collect()
    parts = defaultdict(list)
    for r in got:
        at = 0
        for d, piece, n in zip(r.doc_ids, r.pieces, r.lengths, strict=True):
            parts[d].append((piece, r.ids[at : at + n]))
            at += n
        assert r.n_tokens == at <= r.capacity in (512, 4096)
    assert {d: [t for _, ids in sorted(p) for t in ids] for d, p in parts.items()} == {d: [*(ids or []), 100_000] for d, ids, _ in rows}


def test_equal_rows_spread_over_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 50)
    got = run(spark, tmp_path, [(1, "the same text", "odd", 1, 2)] * 1000)
    per_cell = Counter()
    for r in got:
        per_cell[r.cell] += len(r.pieces)
    assert sum(per_cell.values()) == 1000 and len(per_cell) == 20 and max(per_cell.values()) < 100


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
