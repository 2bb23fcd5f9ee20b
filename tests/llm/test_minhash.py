import random
import re

from knotwork.llm import minhash, shingles


def brute(rows):
    """(n, component, kept) a row by comparing all pairs of documents."""
    sets, parent = [], {}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
        if d is not None:
            parent.setdefault(d, d)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((str(d), len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets, strict=True))


def corpus(seed=3, families=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Übung", "été", "ÑU"]
    texts = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 40, 120]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", " \t "]).join(copy))
    texts += [None, "", " \n ", "A b C", "a B c", "a b c d e", "A B C D E\n"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "1 AS n", "'x' AS label", "array(1) AS bands", "2 AS component_id", "false AS kept")
    return sorted((str(r[0]), r[1], r[2], r[3]) for r in minhash.near_duplicates(df).collect())


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows, extra=True) == brute(rows)


def test_small_blocks_and_large_near_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    chain, rows = list(base), []
    for i in range(40):  # each is near the one before it, the ends are far apart
        chain[rng.randrange(200)] = f"x{i}"
        rows.append((i * 3, " ".join(chain)))
    rows += [(500 + i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(40)])) for i in range(30)]  # a shared passage
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, "one two three four five six"), (None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_an_id_with_several_texts(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "z y x w v u t"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (7, None), (9, c), (9, c), (None, c), (10, c + " s"), (11, "")]
    assert run(spark, rows) == brute(rows)
    assert {r[2] for r in run(spark, rows) if r[0] in "357"} == {3}
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _row_key int")
    got = sorted(((r[0], r[1]) for r in minhash.without_duplicates(df).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (7, ""), (7, None), (9, c), (None, c), (11, "")], key=str)  # no text is lost


def test_random_ids_with_several_texts(spark):
    rng = random.Random(8)
    rows = [(d if rng.random() < 0.7 else rng.randrange(30), t) for d, t in corpus(21, 8)]
    assert run(spark, rows) == brute(rows)
    texts = {d: t for d, t in enumerate(dict.fromkeys(t for _, t in rows if t and t.strip()))}
    of = {t: c for d, t in texts.items() for d2, _, c, _ in brute(list(texts.items())) if d2 == str(d)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.text for r in minhash.without_duplicates(df).collect() if r.text and r.text.strip()]
    assert sorted(of[t] for t in kept) == sorted(set(of.values()))  # one text of each component


def test_low_bit_estimate_counts_equal_minima(spark):
    sets = shingles.shingle_sets([b"a b c d e f g h", b"a b c d e f g i", b"q"])
    low = minhash.packed(minhash.minima(sets)).view("int64")
    df = spark.createDataFrame([[i, *map(int, r)] for i, r in enumerate(low)], ["doc_id", *minhash.SIGNATURE])
    got = {(r[0], r[1]): r[2] for r in df.alias("a").join(df.alias("b"), minhash.F.expr("a.doc_id <= b.doc_id")).select("a.doc_id", "b.doc_id", minhash.matches("a", "b")).collect()}
    values = minhash.minima(sets)
    nib = (values ^ (values >> 32)) & 15
    assert got == {(i, j): int((nib[i] == nib[j]).sum()) for i in range(3) for j in range(i, 3)}


def test_components_of_chains_and_stars(spark):
    from knotwork.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keeps_one_of_each_group(spark):
    rows = corpus(5, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.without_duplicates(df).collect()) == sorted(int(r[0]) for r in brute(rows) if r[3])
