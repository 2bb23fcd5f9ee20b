import random
import zlib

import numpy as np

from knotwork.llm import language, queries


def sentences(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(n)]


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int, c0 int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i * 3 + j, t, lang, "s", 1, 1) for j, (lang, letters) in enumerate((("aa", "etaoinsrh"), ("bb", "etäoünsßk"), ("cc", "éèaluiqnt"))) for i, t in enumerate(sentences(rng, letters, 120))]
    odd = [(1000, None, "aa", "s", 1, 1), (1001, "", "bb", "s", 1, 1), (1002, "123 ... !!", "aa", "s", 1, 1), (1003, rows[0][1], None, "s", 1, 1), (None, rows[1][1], "aa", "s", 1, 1), (1004, "z" * 200_000, None, "s", 1, 1), (1005, "日本語", None, "s", 1, 1)]
    got = {r.doc_id: r for r in queries.op9_language(spark, write(spark, tmp_path, rows + odd + [rows[0]])).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    held = [(i, lang) for i, _, lang, *_ in rows if got[i].held_out]
    assert len(held) > 40 and sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1003].lang_pred == got[0].lang_pred and got[1003].score == got[0].score


def grams(text):
    t = "\ufdd0" + text.lower() + "\ufdd0"
    return set(t[1:-1]) | {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}


def kernel(a, b):
    k = lambda s: sum(language.SINGLE if len(g) == 1 else language.LONGER for g in s)
    return k(grams(a) & grams(b)) / np.sqrt(max(1, k(grams(a))) * max(1, k(grams(b))))


def test_kernel_matches_brute_force(monkeypatch):
    monkeypatch.setattr(language, "COLUMNS", 50)
    monkeypatch.setattr(language, "POINTS", 7)
    rng = random.Random(5)
    texts = [*sentences(rng, "abcdeé", 12), "\U00020000\U0010ffff\0a"]
    model = language.fit(texts, ["x"] * 6 + ["y"] * 7)
    other = [*texts, "zz abc", "q", "İ\U0010ffff"]
    got, known = model.kernels(other)
    landmarks = sorted(texts[:6]), sorted(texts[6:])
    for i, a in enumerate(other):
        want = sorted(kernel(a, b) for part in landmarks for b in part)
        assert np.allclose(sorted(got[i]), want, atol=1e-12)
        held = set().union(*map(grams, texts))
        weight = lambda s: sum(language.SINGLE if len(g) == 1 else language.LONGER for g in s)
        assert abs(known[i] - weight(grams(a) & held) / max(1, weight(grams(a)))) < 1e-12


def test_predictions_match_a_plain_ridge(monkeypatch):
    """With all texts as landmarks, Nystroem features give back kernel ridge in closed form."""
    monkeypatch.setattr(language, "LANDMARKS", 40)
    rng = random.Random(3)
    texts = [*sentences(rng, "abcdefgh", 20), *sentences(rng, "efghijkl", 20)]
    labels = ["x"] * 20 + ["y"] * 20
    model = language.fit(texts, labels)
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    y = np.array([[1.0, -1.0]] * 20 + [[-1.0, 1.0]] * 20)
    dual = np.linalg.solve(k + language.RIDGE * np.eye(40), y)  # 40 rows over 40 landmarks
    asked = sentences(rng, "cdefghij", 30)
    values = np.array([[kernel(a, b) for b in texts] for a in asked]) @ dual
    best, score, _ = model.predict(asked)
    assert (best == values.argmax(1)).all()
    assert np.allclose(score, 1 / np.exp(4 * (values - values.max(1)[:, None])).sum(1), atol=1e-6)


def test_a_score_does_not_depend_on_other_texts():
    rng = random.Random(9)
    texts = [*sentences(rng, "etaoinsrh", 50), *sentences(rng, "etäoünsßk", 50)]
    model = language.fit(texts[::2], (["a"] * 25 + ["b"] * 25))
    together = model.predict(texts * 3)
    alone = [model.predict([t]) for t in texts]
    for i, t in enumerate(texts):
        assert all(x[j] == y[0] for j in (i, i + 100, i + 200) for x, y in zip(together, alone[i], strict=True)), t


def test_numerals_are_not_letters():
    assert not any(map(language.has_letter, (None, "", "½ 12", "²", "① Ⅷ", "12 _ !", "\u0301")))
    assert all(map(language.has_letter, ("a", "12ß", "日", "ª", "ʰ", "\U00020000")))


def test_scripts_with_many_letters_are_told_apart():
    rng = random.Random(7)
    script = lambda first, n: [chr(first + i) for i in range(n)]
    letters = {"de": script(97, 26), "el": script(0x3B1, 17), "ru": script(0x430, 32), "zh": script(0x4E00, 300), "ko": script(0xAC00, 300), "xx": script(0x20000, 300)}
    pairs = [(lang, t) for lang, of in letters.items() for t in sentences(rng, of, 60)]
    model = language.fit([t for _, t in pairs[::2]], [lang for lang, _ in pairs[::2]])
    best = [model.predict([t])[0][0] for _, t in pairs[1::2]]
    right = [model.languages[b] == lang for b, (lang, _) in zip(best, pairs[1::2], strict=True)]
    assert sum(right) >= 0.97 * len(right)


def test_no_labels_and_no_rows(spark, tmp_path):
    got = queries.op9_language(spark, write(spark, tmp_path / "a", [(1, "some text", None, "s", 1, 1)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert queries.op9_language(spark, write(spark, tmp_path / "b", [])).collect() == []


def test_texts_with_letters_stay_where_no_row_is_labelled(spark):
    rows = [(1, "some clean text", None), (2, "12 ... !", None), (3, None, None), (4, "", None), (5, "日本語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.accepted(df).collect()) == [1, 5]


def test_texts_in_no_learned_language_go_and_missing_labels_are_filled(spark):
    rng = random.Random(4)
    rows = [(i, t, "aa") for i, t in enumerate(sentences(rng, "etaoinsrh", 80))] + [(100 + i, t, "bb") for i, t in enumerate(sentences(rng, "ujklmväö", 80))]
    odd = [(300, "日本語の文章です", None), (302, rows[0][1], None), (303, rows[80][1], None), (304, "e", None), (305, "12 !", "aa")]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in language.accepted(df).collect()}
    assert set(got) >= {r[0] for r in rows} and 300 not in got and 305 not in got
    assert (got[302], got[303]) == ("aa", "bb") and 304 in got
