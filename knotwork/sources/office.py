"""Paragraphs of office files: documents and slides as they are zipped, pages of PDF where a
parser is installed, and pictures where a reader of them is given.

Every function takes files (path, content) as the binary reader gives them, and gives
(source, paragraph, text, section, locator_kind, locator); a file that can't be read gives
one row with ``refused`` and no text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "source string, paragraph int, text string, section string, locator_kind string, locator string, refused string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Name spaces of the two formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
#: Bytes that a part of a file may unpack to.
MOST_BYTES = 256 << 20
Part = tuple[str, str | None, str, str]


def files(spark: SparkSession, folder: str, *endings: str) -> DataFrame:
    """(path, content) of the files of a folder with one of the endings."""
    glob = f"*.{{{','.join(endings)}}}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")


def _read(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} unpacks to more than {MOST_BYTES} bytes")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def docx_parts(content: bytes) -> list[Part]:
    """Paragraphs of a document with the heading above them."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _read(archive, "word/document.xml")
    out, section, number = [], None, 0
    for p in body.iter(f"{WORD}p"):
        bits = []
        for node in p.iter():
            if node.tag == f"{WORD}t":
                bits.append(node.text or "")
            elif node.tag in (f"{WORD}tab", f"{WORD}br"):
                bits.append(" ")
        text = " ".join("".join(bits).split())
        number += 1
        if not text:
            continue
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        if style is not None and re.match(r"(?i)heading\s*\d|title", style.get(f"{WORD}val", "")):
            section = text
            continue
        out.append((text, section, "paragraph", str(number)))
    return out


def pptx_parts(content: bytes) -> list[Part]:
    """Paragraphs of slides in their order, with the slide's first line as section."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        slides = sorted((int(m[1]), m[0]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            section = None
            for p in _read(archive, name).iter(f"{DRAWING}p"):
                text = " ".join("".join(t.text or "" for t in p.iter(f"{DRAWING}t")).split())
                if not text:
                    continue
                if section is None:
                    section = text
                else:
                    out.append((text, section, "slide", str(number)))
            if section is not None and (not out or out[-1][3] != str(number)):
                out.append((section, section, "slide", str(number)))
    return out


def pdf_parts(content: bytes, picture_text: Callable[[bytes], str] | None = None) -> list[Part]:
    """Paragraphs of pages; a page without text goes to ``picture_text`` as the pictures it
    holds, if that is given.  Needs a parser that isn't part of this library."""
    try:
        import pypdf
    except ModuleNotFoundError:
        raise ValueError("no parser of PDF is installed") from None
    out = []
    for number, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
        text = page.extract_text() or ""
        if not text.strip() and picture_text is not None:
            text = "\n\n".join(picture_text(i.data) for i in page.images)
        out += [(" ".join(t.split()), None, "page", str(number)) for t in re.split(r"\n\s*\n", text) if t.strip()]
    return out


def paragraphs(found: DataFrame, parts: Callable[[bytes], list[Part]]) -> DataFrame:
    """The paragraphs of files (path, content), by one of the functions above."""

    def of(path: str, content: bytes) -> list[tuple]:
        source = path.rsplit("/", 1)[-1]
        try:
            held = parts(bytes(content))
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as wrong:
            return [(source, None, None, None, None, None, str(wrong) or type(wrong).__name__)]
        return [(source, i, *part, None) for i, part in enumerate(held)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"], strict=True) for r in of(p, c)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"paragraph": "Int32"})

    return found.mapInPandas(run, SCHEMA)
