import random
import zlib
from collections import Counter

from knotwork.llm import histogram_sort, queries


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, size string, shard int, part string").write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op5_histogram_sort(spark, str(tmp_path)).collect()]


def test_near_equal_bytes_and_gapless_slots(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(400), "s", 1, "p") for i in range(4000)]
    rows += [(4000 + i, "one text for a third of all rows " * 5, "s", 1, "p") for i in range(2000)]
    rows += [(9000, None, "s", 1, "p"), (9001, "", "s", 1, "p"), (9002, "long " * 2000, "s", 1, "p"), (None, "no id", "s", 1, "p"), (5, rows[5][1], "s", 1, "p")]
    got = run(spark, tmp_path, rows)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter(r[:3] for r in got) == want
    assert {r[3] for r in got} == {"bytes"} and {r[6] for r in got} == {None}
    sizes, slots = Counter(), {}
    for _, size, _, _, shard, slot, _ in got:
        sizes[shard] += size
        slots.setdefault(shard, []).append(slot)
    assert sorted(sizes) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / 40, max(r[1] for r in got)
    assert max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean + largest


def test_equal_texts_stay_together_where_the_sizes_permit(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"text {i // 4} " + "x" * (i // 4 % 50), "s", 1, "p") for i in range(40_000)]  # a shard holds a thousand rows, a group four
    rng.shuffle(rows)
    got, text = run(spark, tmp_path, rows), {d: t for d, t, *_ in rows}
    shards, sizes = {}, Counter()
    for d, size, *_, shard, _, _ in got:
        shards.setdefault(text[d], set()).add(shard)
        sizes[shard] += size
    mean = sum(sizes.values()) / 40
    assert max(map(len, shards.values())) == 1 and len(shards) == 10_000
    assert max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean


def test_counts_below_probes_match_brute_force(spark):
    rng = random.Random(4)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [7] * 50 + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(k, i % 90 + 1) for i, k in enumerate(keys)], "sort_key long, size long")
    probes = sorted({*keys[::7], 7, 8, 0})
    got = histogram_sort.below(df, probes)
    rows = [(k, i % 90 + 1) for i, k in enumerate(keys)]
    assert got == [(sum(s for k, s in rows if k < p), sum(k < p for k, _ in rows)) for p in probes] + [(sum(s for _, s in rows), len(rows))]


def test_few_rows_and_none(spark, tmp_path):
    got = run(spark, tmp_path / "a", [(1, "x", "s", 1, "p"), (2, "y", "s", 1, "p")])
    assert sorted(r[0] for r in got) == [1, 2] and all(r[5] == 0 or r[5] == 1 for r in got)
    assert run(spark, tmp_path / "b", []) == []
