"""Text, outline and tables of office documents, by the standard library's zip and XML readers, Arrow-batched."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Name spaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ODT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"

CONTENT = (
    "format string, paragraphs array<string>, slides array<struct<slide:int,text:string>>, text string, "
    "outline array<struct<level:int,title:string>>, tables array<array<array<string>>>, error string"
)
COLUMNS = ["format", "paragraphs", "slides", "text", "outline", "tables", "error"]


def _written(node: ElementTree.Element, space: str) -> str:
    marks = {f"{space}t": lambda n: n.text or "", f"{space}tab": lambda n: "\t", f"{space}br": lambda n: "\n"}
    return "".join(marks[n.tag](n) for n in node.iter() if n.tag in marks).strip()


def _docx(z: zipfile.ZipFile) -> dict:
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
            name = s.find(f"{W}name")
            names[s.get(f"{W}styleId")] = name.get(f"{W}val", "") if name is not None else ""
    paragraphs, outline = [], []
    for p in body.findall(f"{W}p"):
        if not (text := _written(p, W)):
            continue
        paragraphs.append(text)
        style = p.find(f"{W}pPr/{W}pStyle")
        key = style.get(f"{W}val", "") if style is not None else ""
        words = names.get(key, key).lower().split()
        if words[:1] == ["title"] and len(words) == 1:
            outline.append({"level": 0, "title": text})
        elif words and words[0].startswith("heading"):
            outline.append({"level": int(words[-1]) if words[-1].isdigit() else 1, "title": text})
    tables = [[_cells(r) for r in t.findall(f"{W}tr")] for t in body.findall(f"{W}tbl")]
    return {"format": "docx", "paragraphs": paragraphs, "text": "\n".join(paragraphs), "outline": outline, "tables": tables}


def _cells(row: ElementTree.Element) -> list[str]:
    """Texts of a row's cells; one that spans columns stands in each."""
    out = []
    for c in row.findall(f"{W}tc"):
        span = c.find(f"{W}tcPr/{W}gridSpan")
        text = "\n".join(_written(p, W) for p in c.findall(f"{W}p")).strip()
        out += [text] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
    return out


def _pptx(z: zipfile.ZipFile) -> dict:
    targets = {r.get("Id"): posixpath.join("ppt", r.get("Target", "")).removeprefix("ppt//") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
    order = ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId")
    slides = []
    for n, s in enumerate(order, 1):
        tree = ElementTree.fromstring(z.read(targets[s.get(f"{REL}id")])).find(f"{P}cSld/{P}spTree")
        shapes = ("\n".join(_written(p, A) for p in body.findall(f"{A}p")).strip() for body in tree.findall(f"{P}sp/{P}txBody"))
        slides.append({"slide": n, "text": "\n".join(filter(None, shapes))})
    return {"format": "pptx", "slides": slides, "text": "\n\n".join(f"[slide {s['slide']}]\n{s['text']}" for s in slides)}


def _odt(z: zipfile.ZipFile) -> dict:
    """A paragraph's own text; text of elements inside it isn't read."""
    found = ((p.text or "") + "".join(c.tail or "" for c in p) for p in ElementTree.fromstring(z.read("content.xml")).iter(f"{ODT}p"))
    paragraphs = [t for t in map(str.strip, found) if t]
    return {"format": "odt", "paragraphs": paragraphs, "text": "\n".join(paragraphs)}


#: What tells the formats apart: a member of the archive.
READERS = {"word/document.xml": _docx, "ppt/presentation.xml": _pptx, "content.xml": _odt}


def read(content: bytes | None) -> dict:
    """One document's parts; one that can't be read has an ``error`` and nothing else."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            names = set(z.namelist())
            reader = next((r for member, r in READERS.items() if member in names), None)
            return reader(z) if reader else {"error": "no office document"}
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError, ValueError, NotImplementedError, RuntimeError) as e:
        return {"error": f"{type(e).__name__}: {e}"}


def office(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, format, paragraphs, slides, text, outline, tables, error of each document (docx, pptx, odt) in ``content``.

    A null, empty or broken file is a row with an error. Tables' paragraphs aren't among the paragraphs of a docx.
    """

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *(got.get(c) for c in COLUMNS)) for k, got in zip(f["key"], map(read, f["content"]), strict=True)]
            yield pd.DataFrame(rows, columns=["key", *COLUMNS])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS key", f"`{content}` AS content").mapInPandas(parts, f"key {kind}, {CONTENT}")
