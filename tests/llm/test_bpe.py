import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from knotwork.llm import bpe, queries

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(RANKS, "rb").read())


def test_matches_tiktoken_on_random_texts(own, vocabulary):
    rng = random.Random(7)
    alphabets = ["abcdeilnorst ", "aA1. ", "äöéñ ç'", "\t\n\r\x1c\x85  x", "日本語カナ 🙂", "'s't're'll", "0123456789 ", "aaaa"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(0, 300))) for _ in range(300)]
    texts += ["", "a" * 5000, "ab" * 3000, "=" * 997, "".join(rng.choice("abc") for _ in range(4000)), "é" * 700, "don't  stop\n\n now "]
    texts += ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    ids, offsets = bpe.encode_texts(texts, vocabulary)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == own.encode_ordinary(text), repr(text[:80])
    data, ends = vocabulary.decode_flat(ids, offsets)
    assert [data[ends[i] : ends[i + 1]].tobytes().decode() for i in range(len(texts))] == texts


def test_long_pieces_in_matrices(own, vocabulary, monkeypatch):
    rng = random.Random(12)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pieces = [word("ACGTacgt+/0123", n) for n in (65, 100, 129, 700, 3000)] + [word("ab", n) for n in (66, 257, 5000)] + [word("etaoinshrdlu", n) for n in (80, 900, 20_000)]
    pieces += ["a" * n for n in (65, 66, 67, 1001)] + ["ab" * 300, "aab" * 200, "aba" * 201, "é" * 333, "日本" * 200, "the" * 500, "ing" * 77 + "x", "=-" * 400, " " * 500]
    monkeypatch.setattr(bpe, "CELLS", 4096)
    flat, offsets = vocabulary.encode_pieces([p.encode() for p in pieces])
    for i, piece in enumerate(pieces):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == own._encode_single_piece(piece), piece[:40]


def test_an_encoder_that_forgets(own, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    rng, encoder = random.Random(2), bpe.Encoder(vocabulary, P.PATTERN)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20))) for _ in range(5)]
        ids, offsets = encoder.encode(pa.array(texts))
        assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(5)] == [own.encode_ordinary(t) for t in texts]


def test_pieces_as_the_pattern_cuts_them():
    assert bpe.CUT == P.PATTERN
    rng = random.Random(5)
    bits = ["'", "'s", "'ll", "'re", "'t", "'S", "'l", "'v", "’s", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u1680", "\x85", "\x1c", "\u200b", "a", "Zz", "é", "日", "ª", "ß", "1", "²", "Ⅷ", "٣", "½", "_", "-", "!?", "🙂", "\u0301", "\U00020000", "\U0010ffff", "\0", "\ufeff", "\ud7ff", "\ue000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(6000)] + ["", " ", "\n", "'", "''", "'s", " 's", "\n's", "'s's", "x'", "'ll've"]
    findall = bpe.compiled(P.PATTERN).findall
    for begin in range(0, len(texts), 500):
        some = texts[begin : begin + 500]
        points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in some])
        at, whole = bpe.cut(points, ends), "".join(some)
        want = [p for t in some for p in findall(t)]
        assert [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)], strict=True)] == want


def test_long_texts_go_in_parts(own, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 40)
    rng = random.Random(11)
    bits = ["word", "don't", "é", " ", "  ", "\n", " \n ", "'s", "12", " x", " y's", "日本", "!", "\u00a0", "a b c d e f"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(120))) for _ in range(60)] + ["", None, "x" * 500, "a " * 300]
    encoder = bpe.Encoder(vocabulary, P.PATTERN)
    ids, offsets = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == own.encode_ordinary(text or ""), text
    data = np.frombuffer(("a " * 300).encode(), np.uint8)
    assert len(bpe.parted(data, np.array([0, 600]))) > 10


def test_equal_hashes_do_not_mix_pieces_up(own, vocabulary, monkeypatch):
    plain = bpe.hashes
    monkeypatch.setattr(bpe, "hashes", lambda *a: [plain(*a)[0] % np.uint64(50), plain(*a)[1]])
    encoder = bpe.Encoder(vocabulary, P.PATTERN)
    rng = random.Random(3)
    for _ in range(10):
        texts = [" ".join(rng.choice(["a", "bb", "word", "other", "x", "yy", "zz"]) + str(rng.randrange(5)) for _ in range(6)) for _ in range(3)]
        ids, offsets = encoder.encode(pa.array(texts))
        assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(3)] == [own.encode_ordinary(t) for t in texts]


def test_other_patterns_go_through_regex(vocabulary):
    ids, offsets = bpe.encode_texts(["ab  cd", None, ""], vocabulary, r"\S+|\s+")
    assert [vocabulary.decode_flat(ids, offsets)[0].tobytes(), offsets[1:].tolist()] == [b"ab  cd", [len(ids)] * 3]


def test_query_rows_and_odd_inputs(spark, own, tmp_path):
    texts = [None, "", "hello world", "hello world", "x" * 300_000, "\n\n é"]
    rows = [(i, t, "other", 5) for i, t in enumerate(texts)] + [(None, "no id", None, 1), (2, "hello world", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_byte_bpe(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(d), len(ids := own.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t, *_ in rows
    )
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op3_byte_bpe(spark, str(tmp_path)).collect() == []


def test_decode_alone(spark):
    df = spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, RANKS).collect()} == {1: b"hello world", 2: b"", 3: b""}
