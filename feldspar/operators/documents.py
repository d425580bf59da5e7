"""Segments of documents, and what HTML, Markdown, JSON notebooks and binary files hold.

General HTML and fenced Markdown are parsed by one Arrow-batched function each on the standard library's parser; links
and headings of regular markup have forms in built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text isn't read, and those that end a line.
SKIPPED = ("script", "style", "noscript", "nav", "footer", "header", "aside")
BLOCKS = ("p", "div", "li", "ul", "ol", "table", "tr", "br", "section", "article", "main", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")

#: Names and first bytes of file formats.
SIGNATURES = (
    ("pdf", b"%PDF"), ("zip/office/ooxml", b"PK\x03\x04"), ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("gzip", b"\x1f\x8b"),
    ("mp3", b"ID3"), ("ogg", b"OggS"), ("riff/wav/avi", b"RIFF"), ("mp4", b"\x00\x00\x00\x18ftyp"), ("mp4", b"\x00\x00\x00\x1cftyp"),
    ("sqlite", b"SQLite format"), ("json?", b"{\n"), ("html", b"<!DOCTYPE"), ("html", b"<html"),
)


def blocks(text: Column) -> Column:
    """Blocks between blank lines: array of struct(label, text)."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda b: F.regexp_replace(b, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda b: b != "")
    return F.transform(parts, lambda b, i: F.struct(F.concat(F.lit("block "), (i + 1).cast("string")).alias("label"), b.alias("text")))


def sections(df: DataFrame, key: str, text: str, *, fenced: bool, preamble: bool) -> DataFrame:
    """key, pos, heading, level, text: text under each ATX heading.

    ``fenced``: headings in code fences are text. ``preamble``: text before the first heading stays as (preamble).
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text], strict=True):
                found, fence = [["(preamble)", 0, []]], False
                for line in (t or "").split("\n"):
                    fence ^= fenced and line.lstrip().startswith("```")
                    m = None if fence else re.match(r"(#{1,6})\s+(.*)$", line)
                    if m:
                        found.append([m[2].strip(), len(m[1]), []])
                    else:
                        found[-1][2].append(line)
                kept = [x for i, x in enumerate(found) if i or (preamble and "".join(x[2]).strip())]
                rows += [(k, p, h, n, "\n".join(b).strip()) for p, (h, n, b) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["key", "pos", "heading", "level", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(cut, f"key {kind}, pos int, heading string, level int, text string")


class _Page(HTMLParser):
    """Readable text, links, headings, meta and tables of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.open = 0, []
        self.parts: dict[str, list[str]] = {"all": [], "body": [], "article": [], "main": []}
        self.links, self.headings, self.meta, self.tables = [], [], {}, []
        self.title, self.link, self.heading, self.row, self.cell = "", None, None, None, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ("main", "article", "body", "title"):
            self.open.append(tag)
        if tag == "meta" and (name := a.get("name") or a.get("property")) and (name in ("description", "keywords", "author") or name.startswith("og:")):
            self.meta[name] = a.get("content", "")
        if tag == "a" and "href" in a:
            self.link = [a["href"], ""]
        if re.fullmatch("h[1-4]", tag):
            self.heading = [int(tag[1]), ""]
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
            self.tables[-1].append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
            self.cell = True
        if tag in BLOCKS:
            self.put("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.open:
            self.open.remove(tag)
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(self.link[1].split())[:120]))
            self.link = None
        if self.heading and tag == f"h{self.heading[0]}":
            self.headings.append((self.heading[0], " ".join(self.heading[1].split())))
            self.heading = None
        if tag in ("td", "th"):
            self.cell = None
        if tag == "table":
            self.row = None
        if tag in BLOCKS:
            self.put("\n")

    def put(self, s: str) -> None:
        if not self.skip:
            for k in {"all", *self.open} & self.parts.keys():
                self.parts[k].append(s)

    def handle_data(self, data):
        if "title" in self.open:
            self.title += data
            return
        self.put(data)
        if self.link:
            self.link[1] += data
        if self.heading:
            self.heading[1] += data
        if self.cell and self.row:
            self.row[-1] += data

    def text(self) -> str:
        for k in ("main", "article", "body", "all"):
            lines = [" ".join(x.split()) for x in "".join(self.parts[k]).split("\n")]
            if out := "\n".join(x for x in lines if x):
                return out
        return ""


PAGE = "title string, text string, links array<struct<href:string,text:string>>, headings array<struct<level:int,text:string>>, meta map<string,string>, tables array<array<array<string>>>"


def html_pages(df: DataFrame, key: str, html: str, cap: int = 300, rows: int = 200) -> DataFrame:
    """key, title, text, links and n_links, headings, meta, tables of each page; lists are cut at ``cap`` and ``rows``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, h in zip(f[key], f[html], strict=True):
                p = _Page()
                p.feed(h or "")
                p.close()
                out.append((k, p.title.strip(), p.text(), [{"href": a, "text": b} for a, b in p.links[:cap]], [{"level": n, "text": t} for n, t in p.headings[:100]], p.meta, [[[c.strip() for c in r] for r in t[:rows]] for t in p.tables], len(p.links)))
            yield pd.DataFrame(out, columns=["key", "title", "text", "links", "headings", "meta", "tables", "n_links"])

    return df.select(key, html).mapInPandas(read, f"key {df.schema[key].dataType.simpleString()}, {PAGE}, n_links int")


def html_links(html: Column) -> Column:
    """Targets of regular links: array of strings."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def html_headings(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("<h1[^>]*>([^<]*)</h1>"), F.lit(1))


def markdown_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def markdown_images(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def front_matter(text: Column) -> Column:
    """Flat ``key: value`` pairs of a leading --- block; empty if there is none."""
    body = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    pairs = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))
    name = lambda x: F.split(x, ":", 2)[0]
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: name(y) == name(x)))  # a repeated key: the last one counts
    return F.map_from_entries(F.transform(last, lambda x: F.struct(name(x), F.trim(F.split(x, ":", 2)[1]))))


def markdown_tables(text: Column) -> Column:
    """Each table as an array of rows of cells, header first: a line with pipes, a separator line, then lines with pipes."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)(^\|?[^\n|]+\|[^\n]*\n\|?[ :-]+-[-| :]*(?:\n[^\n]*\|[^\n]*)*)"), F.lit(1))
    cells = lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.transform(found, lambda t: F.transform(F.filter(F.split(t, "\n"), lambda r, i: i != 1), cells))


def notebook_cells(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, pos, cell_type, source, outputs of each cell of a notebook; outputs are cut at 2000 characters."""
    nb = "struct<cells:array<struct<cell_type:string,source:variant,outputs:array<struct<output_type:string,text:variant,ename:string>>>>>"
    cells = df.select(F.col(key).alias("key"), F.posexplode(F.from_json(json, nb).getField("cells")).alias("pos", "c"))
    flat = lambda v: F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"))
    outs = F.transform("c.outputs", lambda o: F.struct(o["output_type"].alias("type"), F.left(F.coalesce(flat(o["text"]), o["ename"]), F.lit(2000)).alias("text")))
    return cells.select("key", "pos", "c.cell_type", flat(F.col("c.source")).alias("source"), outs.alias("outputs"))


def detect(content: Column) -> Column:
    """struct(signature, image, is_text, encoding) of a binary file's first 512 bytes.

    A signature may stand anywhere in the first 16 bytes; the earlier in the list wins. ``image`` is the type of a picture
    that a viewer may show, by exact signatures.
    """
    h = F.hex(F.substring(content, 1, 512))
    starts = lambda sign: F.startswith(h, F.lit(sign))
    c = F.lit(None).cast("string")
    for name, sign in reversed(SIGNATURES):
        code = sign.hex().upper()
        within = F.substring(h, 1, 32).rlike(f"^(?:..)*?{code}")
        c = F.when(within | starts(code), name).otherwise(c)
    webp = starts("52494646") & (F.substring(h, 17, 8) == "57454250")
    image = F.when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg").when(starts("47494638") & (F.length(h) >= 12), "image/gif").when(webp, "image/webp")
    nul = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(h) / 2).cast("int")), lambda i: F.substring(h, 2 * i - 1, F.lit(2)) == "00")
    utf8 = F.is_valid_utf8(F.substring(content, 1, 512).cast("string"))
    return F.struct(c.alias("signature"), image.alias("image"), (~nul).alias("is_text"), F.when(nul, None).when(utf8, "utf-8").otherwise("latin-1").alias("encoding"))


def pdf_coverage(pages: DataFrame, key: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """Over extracted pages: key, n_pages, chars, scanned (pages under 20 characters), has_text (over 50 in all)."""
    n = F.coalesce(F.length(F.trim(text)), F.lit(0))
    scanned = F.array_sort(F.collect_list(F.when(n < 20, F.col(page))))
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.sum(n).alias("chars"), scanned.alias("scanned"), (F.sum(n) > 50).alias("has_text"))
