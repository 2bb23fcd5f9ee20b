"""Text queries against brute force on small tables."""

import pytest

from knotwork.plans import text_queries


def grams(text):
    return {text[i : i + 2] for i in range(len(text) - 1)}


def dice(a, b):
    return 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))


def test_near_pairs_reach_over_the_whole_pool(spark, tmp_path):
    fillers = "abcdefghijklmnopqrstuvwxyz"
    # the longer a document, the lower its rank; 20 and 21, 26 and 27 are near copies of each other
    texts = ["amber " + " ".join(fillers[i % 26] * 2 + fillers[(i + j + 1) % 26] * 2 for j in range(i + 1)) for i in range(28)]
    texts[21], texts[27] = texts[20] + " zq", texts[26] + " qz"
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "amber")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if f"doc:{i}" < f"doc:{j}" and dice(a, b) >= 0.9:
                want["0", f"doc:{i}", f"doc:{j}"] = round(dice(a, b), 9)
    assert {("0", "doc:20", "doc:21"), ("0", "doc:26", "doc:27")} <= set(want)
    got = {(r.query, r.a, r.b): r.score for r in text_queries.near_dup_pairs(spark, path).collect()}
    assert got == want


def parts(spark, path, names):
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{path}/part.parquet")


def test_names_of_different_first_characters_are_compared(spark, tmp_path):
    names = ["small ring", "ring", "blue ring", "king", "ring"]
    parts(spark, tmp_path, names)
    got = {(r.a, r.b): (r.dice, r.containment) for r in text_queries.name_similarity(spark, str(tmp_path)).collect()}
    assert got == {(a, b): (round(dice(a, b), 9), round(min(len(a), len(b)) / max(len(a), len(b)), 9)) for a in names for b in names}
    assert got["ring", "small ring"][1] == 0.4 and got["king", "ring"][0] > 0.6


def test_too_many_names_are_refused(spark, tmp_path, monkeypatch):
    parts(spark, tmp_path, ["a b", "c d", "e f"])
    monkeypatch.setattr(text_queries, "NAMES", 2)
    with pytest.raises(ValueError, match="more than 2 names"):
        text_queries.name_similarity(spark, str(tmp_path))
