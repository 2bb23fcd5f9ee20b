"""WARC archives with revisit records in place of repeated payloads.

Writing: the headers alone (key, digest, length) are made once and shuffled by payload
digest; of equal payloads long enough, the row of the largest key is the response and
the others are joined to it and become revisit records.  Every record gets fresh
headers and is a gzip member of its own; members are joined to WARC/1.1 archives of
about ``archive_bytes`` at most (a larger record stands alone), each of which begins
with a warcinfo record.  Spark's text writer puts one archive in a file, through its
commit protocol and to any store that Spark reaches; what it adds as the end of a line
is a gzip member without contents.  Reading: records are parsed by Content-Length, so payloads may hold
anything; length and digest are taken from the payload itself, and a revisit
record takes both from the response that it refers to, joined by record id.

Defined results: a null payload counts as empty; payloads shorter than
``least_bytes`` are always responses; rows that repeat both key and payload share
a record id and a type, so several may be the response of their group; a null key
ranks below every other and comes back as null; a null url leaves out its header;
a table without rows gives no archive and no records.  Columns other than the
three named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import sliced, written

LEAST_BYTES = 1000
#: Compressed bytes of an archive.
ARCHIVE_BYTES = 32 << 20
#: Revisit records that may be joined to the payloads by broadcast; more go by shuffle.
BROADCAST_REVISITS = 500_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BATCH_BYTES = 8_000_000
_GZIP = 31


def record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", key.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def described(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(key, url, payload, bytes, digest, id); the url on one line."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    out = df.select(F.col(key).cast("long").alias("key"), F.replace(F.replace(F.col(url).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), body.alias("payload"))
    out = out.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    return out.withColumn("id", record_id(F.col("key"), F.col("digest")))


def revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, refers_to, refers_url) of the rows of (key, url, bytes, digest, id) that repeat a payload."""
    long_enough = headers.filter(F.col("bytes") >= least_bytes)
    originals = long_enough.groupBy("digest").agg(F.max("key").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "original")
    found = long_enough.join(originals, "digest").filter(~F.col("key").eqNullSafe(F.col("original")))
    urls = long_enough.join(originals, "digest").filter(F.col("key").eqNullSafe(F.col("original"))).groupBy("digest").agg(F.max("url").alias("refers_url"))
    found = found.join(urls, "digest").select("id", record_id(F.col("original"), F.col("digest")).alias("refers_to"), "refers_url")
    return found.dropDuplicates(["id"])


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own, without a time, so that equal data gives equal bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
    return squeeze.compress(data) + squeeze.flush()


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record; headers of no value are left out."""
    lines = [f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", len(block))] if value is not None]
    return b"".join([b"WARC/1.1\r\n", "".join(lines).encode(), b"\r\n", block, b"\r\n\r\n"])


def _info(first: str, date: str) -> bytes:
    """The record that begins an archive, named by its first record."""
    named = hashlib.md5(f"warcinfo|{first}".encode()).hexdigest()
    name = "-".join((named[:8], named[8:12], named[12:16], named[16:20], named[20:]))
    about = b"software: knotwork\r\nformat: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)


def _page(key: int | None, url: str | None, payload: bytes, size: int, digest: str, name: str, refers_to: str | None, refers_url: str | None, date: str) -> bytes:
    again = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if again else None),
        ("WARC-Refers-To", refers_to),
        ("WARC-Refers-To-Target-URI", refers_url if again else None),
        ("WARC-Refers-To-Date", date if again else None),
        ("X-Source-Key", key),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return record(headers, http if again else http + payload)


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of ``df`` as archives below ``path``."""
    rows = described(df, key, url, payload)
    repeated = written(revisits(written(rows.drop("payload"), "headers"), least_bytes), "revisits")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_REVISITS else repeated
    rows = rows.join(repeated, "id", "left")
    names = ["key", "url", "payload", "bytes", "digest", "id", "refers_to", "refers_url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches):
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = member(_page(*values, date))
                if held and size + len(data) > archive_bytes:
                    yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
                if not held:
                    held, size = [member(_info(values[5], date))], 0
                held.append(data)
                size += len(data)
        if held:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], ["value"])

    archives = rows.select(*(F.col(n).cast("binary") if n == "payload" else F.col(n) for n in names)).mapInArrow(run, "value binary")
    nothing = member(b"").decode("latin-1")
    archives.select(F.col("value").cast("string")).write.option("lineSep", nothing).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


class _Stream:
    """Bytes of a plain or gzipped file (of any number of members), inflated as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at : self.at + (1 << 18)]
        self.at += len(chunk)
        if self.inflate is None:
            self.held += chunk
            return True
        self.held += self.inflate.decompress(chunk)
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; empty at the end of the data."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return b""
        return self.read(at + len(mark))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, payload) of each record of a file."""
    stream = _Stream(data)
    while head := stream.until(b"\r\n\r\n"):
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = stream.read(int(headers["content-length"]))
        stream.read(4)
        if headers.get("content-type", "").startswith("application/http"):
            block = block[block.find(b"\r\n\r\n") + 4 :]
        yield headers, block


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records below ``path``: key, id, url, record_type, refers_id, payload_bytes,
    payload_digest, and the payload itself if asked for (a revisit has none of its own)."""
    names = ["key", "id", "url", "record_type", "refers_id", "payload_bytes", "payload_digest", *["payload"] * payloads]
    schema = "key long, id string, url string, record_type string, refers_id string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for headers, payload in parse(batch.column(0)[i].as_py()):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    own = headers["warc-type"] != "revisit"
                    key = headers.get("x-source-key")
                    row = [None if key is None else int(key), headers["warc-record-id"], headers.get("warc-target-uri"), headers["warc-type"], headers.get("warc-refers-to"), len(payload) if own else None, hashlib.sha1(payload).hexdigest() if own else None]
                    held.append([*row, payload if own else None][: len(names)])
                    size += len(payload) if payloads else 200
                    if size >= _BATCH_BYTES:
                        yield _rows(held, names, kinds)
                        held, size = [], 0
                if held:
                    yield _rows(held, names, kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _rows(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, the key of the response that a revisit refers
    to, and with that response's length, digest and payload for the revisit's own."""
    carried = [c for c in ("payload_bytes", "payload_digest", "payload") if c in records.columns]
    firsts = records.filter("record_type = 'response'")
    targets = firsts.select(F.col("id").alias("refers_id"), F.col("key").alias("refers_to"), *carried).dropDuplicates(["refers_id"])
    plain = ["key", "id", "url", "record_type"]
    again = records.filter("record_type = 'revisit'").select(*plain, "refers_id").join(targets, "refers_id", "left")
    return firsts.select(*plain, F.lit(None).cast("long").alias("refers_to"), *carried).union(again.select(*plain, "refers_to", *carried))
