"""An index of files as DataFrames: what is known of each file, the terms and notes, and feedback for the next build.

Writers return the index with the rows in place of those of the same key; ``save`` and ``load`` keep versions as Parquet.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.errors import BadArgument, NotFound
from feldspar.functions import lineref
from feldspar.functions.text import glob_regex, sha12
from feldspar.operators.cache import upsert

SCHEMAS = {
    "nodes": "file string, summary string, access_count bigint",
    "toc": "file string, entries string",
    "edges": "file string, target string, source_lines string, relation string",
    "keywords": "file string, keyword string",
    "glossary": "term string, definition string, refs array<string>",
    "notes": "key string, value string",
}
#: Kinds of feedback.
FEEDBACK = ("note", "request", "link_research", "propose_merge", "dispute_merge", "add_link")


@dataclass(frozen=True)
class Index:
    nodes: DataFrame
    toc: DataFrame
    edges: DataFrame
    keywords: DataFrame
    glossary: DataFrame
    notes: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def rows(self, name: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), SCHEMAS[name])

    def has(self, file: str) -> None:
        if self.nodes.where(F.col("file") == file).isEmpty():
            raise NotFound(f"{file} is not in the index")


def init(spark: SparkSession, folder: str, glob: str = "**/*.md", ignore: list[str] = ()) -> Index:
    """An index of the files below ``folder`` whose path matches ``glob``, less those whose path holds an ignored text."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")  # contents aren't read
    base = F.lit(folder.rstrip("/")).alias("base")
    rel = names.select(F.regexp_replace("path", "^file:/*", "/").alias("p"), F.regexp_replace(base, "^file:/*", "/").alias("base"))
    rel = rel.select(F.expr("substring(p, length(base) + 2)").alias("file"))
    pattern = glob_regex(glob.removeprefix("**/"))
    part = F.regexp_extract("file", r"([^/]*)$", 1) if glob.startswith("**/") else F.col("file")
    kept = rel.where(part.rlike(pattern))
    for x in ignore:
        kept = kept.where(~F.contains("file", F.lit(x)))
    empty = {n: spark.createDataFrame([], ddl) for n, ddl in SCHEMAS.items()}
    nodes = kept.select("file", F.lit(None).cast("string").alias("summary"), F.lit(0).cast("bigint").alias("access_count"))
    return Index(**(empty | {"nodes": nodes}))


def save(ix: Index, root: str) -> str:
    """A new version below ``root``, visible once its marker is written; its path."""
    at = f"{root.rstrip('/')}/v={uuid.uuid4().hex}"
    for f in fields(ix):
        getattr(ix, f.name).write.parquet(f"{at}/{f.name}")
    ix.spark.range(1).select(F.current_timestamp().alias("at")).write.parquet(f"{at}/committed")
    return at


def load(spark: SparkSession, version: str) -> Index:
    spark.read.parquet(f"{version}/committed")
    return Index(**{n: spark.read.schema(ddl).parquet(f"{version}/{n}") for n, ddl in SCHEMAS.items()})


def _reference(spark: SparkSession, ref: str):
    r = spark.range(1).select(lineref.parse(F.lit(ref)).alias("r")).first()["r"]
    if r is None:
        raise BadArgument(f"{ref} is no line reference")
    return r


def write_summary(ix: Index, file: str, summary: str) -> Index:
    ix.has(file)
    return replace(ix, nodes=ix.nodes.withColumn("summary", F.when(F.col("file") == file, summary).otherwise(F.col("summary"))))


def write_toc(ix: Index, file: str, entries: str) -> Index:
    ix.has(file)
    return replace(ix, toc=upsert(ix.toc, ix.rows("toc", (file, entries)), ["file"]))


def write_edge(ix: Index, source: str, target: str, relation: str) -> Index:
    """An edge between two line references. The source's file must be indexed; repeats stay."""
    a, _ = _reference(ix.spark, source), _reference(ix.spark, target)
    ix.has(a["file"])
    lines = str(a["start"]) if a["start"] == a["end"] else f"{a['start']}-{a['end']}"
    return replace(ix, edges=ix.edges.unionByName(ix.rows("edges", (a["file"], target, lines, relation))))


def write_keyword(ix: Index, file: str, keyword: str) -> Index:
    """A file's keywords are a set."""
    ix.has(file)
    return replace(ix, keywords=upsert(ix.keywords, ix.rows("keywords", (file, keyword)), ["file", "keyword"]))


def write_glossary(ix: Index, term: str, definition: str, refs: str) -> Index:
    """``refs``: line references, comma-joined; blank ones don't count."""
    found = [r for r in map(str.strip, refs.split(",")) if r]
    for r in found:
        _reference(ix.spark, r)
    return replace(ix, glossary=upsert(ix.glossary, ix.rows("glossary", (term, definition, found)), ["term"]))


def write_note(ix: Index, key: str, value: str) -> Index:
    return replace(ix, notes=upsert(ix.notes, ix.rows("notes", (key, value)), ["key"]))


def node(ix: Index, file: str) -> DataFrame:
    """One row: the file, its summary, access count, table of contents, keywords and edges."""
    ix.has(file)
    at = F.col("file") == file
    words = ix.keywords.where(at).groupBy("file").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    edges = ix.edges.where(at).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("target", "source_lines", "relation"))).alias("edges"))
    return ix.nodes.where(at).join(ix.toc, "file", "left").join(words, "file", "left").join(edges, "file", "left")


def glossary(ix: Index, term: str | None = None) -> DataFrame:
    """All terms, or one; NotFound if it isn't there."""
    return _one(ix.glossary, "term", term)


def notes(ix: Index, key: str | None = None) -> DataFrame:
    """All notes, or one; NotFound if it isn't there."""
    return _one(ix.notes, "key", key)


def _one(df: DataFrame, key: str, value: str | None) -> DataFrame:
    if value is None:
        return df
    found = df.where(F.col(key) == value)
    if found.isEmpty():
        raise NotFound(f"{key} {value}")
    return found


def visible(cache: DataFrame) -> DataFrame:
    """store, visible (hot and trending entries), total, of a cache's rows (store, tier)."""
    return cache.groupBy("store").agg(F.count_if(F.col("tier") != "shadow").alias("visible"), F.count("*").alias("total"))


def give_feedback(spark: SparkSession, path: str, kind: str, targets: list[str], detail: str | None = None, **more) -> str:
    """Appends one entry of a kind of FEEDBACK, pending, to the JSON lines at ``path``; its id.

    ``more``: request_kind of a request; link_type and fact_ids of an added link.
    """
    if kind not in FEEDBACK:
        raise BadArgument(f"{kind} is no kind of feedback")
    ddl = "kind string, targets array<string>, detail string, request_kind string, link_type string, fact_ids array<string>"
    row = spark.createDataFrame([(kind, targets, detail, more.get("request_kind"), more.get("link_type"), more.get("fact_ids"))], ddl)
    row = row.withColumn("feedback_id", F.concat(F.lit("fb_"), sha12(F.to_json(F.struct("*")))))
    row = row.withColumns({"author": F.lit("consumer"), "status": F.lit("pending")})
    row.write.mode("append").json(path)
    return row.first()["feedback_id"]
