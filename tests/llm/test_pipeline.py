import base64
import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from knotwork.llm import queries, secret_scan
from test_minhash import brute, corpus
from test_secret_scan import guesser

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def rows_of(pairs):
    return [(d, t, ["en", "de", None][i % 3], "src", None if t is None else len(t)) for i, (d, t) in enumerate(pairs)]


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    pairs = corpus(9, 8)
    pairs += [(1000 + i, f"note {i} " + " ".join(rng.choice("abcdef") * 4 for _ in range(30)) + f" token = {i:040x}") for i in range(12)]
    pairs += [(2000, "12345 ... 6789"), (2001, "?"), (2002, "long words here " + "x" * 40_000)]
    df = documents(spark, tmp_path, rows_of(pairs))
    kept = [r for r in pairs if r[1] and any(c.isalpha() for c in r[1])]
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language"](spark, df, str(tmp_path))
    assert one.columns == df.columns and sorted(r.doc_id for r in one.collect()) == sorted(d for d, _ in kept)
    two = steps["near_duplicates"](spark, one, str(tmp_path))
    firsts = {int(r[0]) for r in brute(kept) if r[3]}
    assert two.columns == df.columns and {r.doc_id for r in two.collect()} == firsts
    three = steps["secrets"](spark, two, str(tmp_path))
    texts = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == df.columns and texts == {d: secret_scan.masked(t, guesser()) for d, t in kept if d in firsts}
    assert any("[secret]" in t for t in texts.values()) and not any(secret_scan.spans(t, guesser()) for t in texts.values())
    held = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        at = 0
        for d, n in zip(r.doc_ids, r.lengths, strict=True):
            held[d] = held.get(d, []) + r.ids[at : at + n]
            at += n
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANK_FILE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {d: [ids[-1], own.decode(ids[:-1])] for d, ids in held.items()} == {d: [queries.END, t] for d, t in texts.items()}


def test_nulls_repeats_extra_columns_and_no_rows(spark, tmp_path):
    rows = rows_of([(1, "some words of text"), (1, "some words of text"), (None, "a text without id"), (3, None), (4, "")])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", lang_pred string, score int")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert sorted(str(d) for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect() for d in r.doc_ids) == ["1", "None"]
    documents(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
