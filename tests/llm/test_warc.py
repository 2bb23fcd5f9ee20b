import gzip
import hashlib
import random
import zlib

from knotwork.llm import queries, warc


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key int").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def brute(rows):
    best = {}
    for k, _, h, *_ in rows:
        h = h or ""
        if len(h.encode()) >= 1000:
            best[h] = max(best.get(h, -1), -1 if k is None else k)
    out = []
    for k, _, h, *_ in rows:
        data = (h or "").encode()
        original = best.get(h or "", k)
        again = len(data) >= 1000 and (-1 if k is None else k) != original
        out.append((str(k), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    bodies = [None, "", "x" * 999, "x" * 1000, "é" * 500, "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" * 40, "\r\n\r\n" * 600, "line\n" * 400_000, "\x00\x01" * 700]
    rows = [(i, rng.choice([None, "http://a.example/x", "http://b.example/\r\nX: y"]), rng.choice(bodies), "d", 1) for i in range(60)]
    rows += [(None, "u", "x" * 1000, "d", 1), (7, "u", "z" * 2000, "d", 1), (7, "u", "z" * 2000, "d", 1), (None, "u", "only null " * 200, "d", 1)]
    got = [tuple(r) for r in queries.op1_warc_revisits(spark, write(spark, tmp_path, rows)).collect()]
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == brute(rows)


def test_archives_hold_payloads_once_and_resolve(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", "same " * 300 if i < 5 else f"page {i} \r\n\r\n tail", "d", 1) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key int")
    warc.write(df.coalesce(1), f"{tmp_path}/out", archive_bytes=900)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) >= 4 and all(f.stat().st_size < 1200 for f in files)  # by bytes, not by records
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"same " * 300) == 1 and text.count(b"WARC-Type: revisit") == 4 == text.count(b"WARC-Refers-To-Date: ")
    assert text.count(b"WARC-Type: warcinfo") == len(files) and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in files)
    found = {r.key: bytes(r.payload).decode() for r in warc.resolved(warc.read(spark, f"{tmp_path}/out", payloads=True)).collect()}
    assert found == {r[0]: r[2] for r in rows}


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    df = spark.createDataFrame([(i, None, f"page {i}" * i) for i in range(7)], "page_id long, url string, html string")
    warc.write(df.coalesce(1), f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("part-*")
    left, members = file.read_bytes(), []
    while left:
        inflate = zlib.decompressobj(31)
        members.append(inflate.decompress(left) + inflate.flush())
        left = inflate.unused_data
    assert members.pop() == b"" and len(members) == 8
    assert [m[: m.index(b"\r\nWARC-Record")].split()[-1] for m in members] == [b"warcinfo"] + [b"response"] * 7
    assert all(len(list(warc.parse(m))) == 1 for m in members)


def test_members_and_plain_files_parse(spark):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for data in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        assert [p for _, p in warc.parse(data)] == [b"ab\r\nc"] * 3
    assert list(warc.parse(b"")) == []


def test_empty_table(spark, tmp_path):
    assert queries.op1_warc_revisits(spark, write(spark, tmp_path, [])).collect() == []
