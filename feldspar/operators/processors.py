"""Processors: functions that read a file and propose facts, chosen by the file's kind, run once for each content.

A processor returns an envelope, as a dict or as text that holds one: facts, companions and diagnostics, and never an id
or a receipt, as those are the library's to give. What it did is kept by content hash and processor identity.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feldspar.errors import BadArgument
from feldspar.functions.text import redact
from feldspar.model import SPAN

ENVELOPE = "extraction.v1"
#: What an envelope and its facts may hold.
ENVELOPE_KEYS = ("envelope", "facts", "companions", "diagnostics")
FACT_KEYS = ("kind", "text", "confidence", "fidelity", "locator", "span", "view_id", "action_draft")
COMPANION_KINDS = ("transcript", "frame", "screenshot", "dom", "ax", "audio", "other")
KINDS, FIDELITIES = ("knowledge", "action"), ("claimed", "guessed")

FACT = f"struct<kind:string,text:string,confidence:double,fidelity:string,locator:string,span:{SPAN},view_id:string,action_draft:string>"
RESULT = f"source_id string, hash string, identity string, facts array<{FACT}>, companions array<struct<kind:string,path:string>>, diagnostics array<string>, error string"


@dataclass(frozen=True)
class Processor:
    """A function on (content, params) for files of one kind; ``version`` changes when its results may."""

    name: str
    kind: str
    run: Callable[[bytes, dict[str, Any]], dict | str]
    version: str = "0"
    params: dict[str, Any] = field(default_factory=dict)

    def identity(self, origin: str) -> str:
        return f"{origin}:{self.kind}:{self.name}:{self.version}:{json.dumps(self.params, sort_keys=True)}"


@dataclass(frozen=True)
class Registry:
    """Configured processors come before built-in ones; the kind ``generic`` serves all that have none."""

    configured: tuple[Processor, ...] = ()
    builtin: tuple[Processor, ...] = ()

    def table(self) -> dict[str, tuple[str, Processor]]:
        """Identity and processor by kind."""
        out: dict[str, tuple[str, Processor]] = {}
        for origin, some in (("config", self.configured), ("builtin", self.builtin)):
            for p in some:
                out.setdefault(p.kind, (p.identity(origin), p))
        return out

    def resolve(self, kind: str) -> tuple[str, Processor]:
        found = self.table()
        if kind not in found and "generic" not in found:
            raise BadArgument(f"no processor for {kind}")
        return found.get(kind) or found["generic"]


def parse_envelope(out: dict | str, name: str = ENVELOPE) -> dict:
    """The envelope, checked; BadArgument names the first thing that is wrong."""
    if isinstance(out, str):
        first, last = out.find("{"), out.rfind("}")
        if first < 0 or last < first:
            raise BadArgument("no JSON object in the output")
        try:
            out = json.loads(out[first : last + 1])
        except json.JSONDecodeError as e:
            raise BadArgument(f"no JSON: {e}") from e
    _only(out, ENVELOPE_KEYS, "envelope")
    if out.get("envelope") != name:
        raise BadArgument(f"the envelope is not {name}")
    if not isinstance(out.get("facts"), list):
        raise BadArgument("facts are no list")
    for i, f in enumerate(out["facts"]):
        at = f"facts[{i}]"
        _only(f, FACT_KEYS, at)
        number = f.get("confidence")
        if f.get("kind") not in KINDS or f.get("fidelity") not in FIDELITIES:
            raise BadArgument(f"{at}: kind or fidelity")
        if not isinstance(f.get("text"), str) or not f["text"]:
            raise BadArgument(f"{at}: text")
        if isinstance(number, bool) or not isinstance(number, int | float) or not 0 <= number <= 1:
            raise BadArgument(f"{at}: confidence")
    for i, c in enumerate(out.get("companions") or []):
        _only(c, ("kind", "path"), f"companions[{i}]")
        if c.get("kind") not in COMPANION_KINDS or not isinstance(c.get("path"), str):
            raise BadArgument(f"companions[{i}]: kind or path")
    return out


def _only(value: Any, keys: tuple[str, ...], at: str) -> None:
    if not isinstance(value, dict):
        raise BadArgument(f"{at} is no object")
    if extra := sorted(set(value) - set(keys)):
        raise BadArgument(f"{at}: {', '.join(extra)} not allowed")


def extract(files: DataFrame, registry: Registry, cached: DataFrame | None = None) -> DataFrame:
    """What processors make of ``files`` (source_id, kind, hash, content): a row a file with facts or an error.

    ``cached``: rows of an earlier run; those of the same content and processor identity without an error are taken as
    they are, so only the rest is run. A processor that fails, or whose envelope is wrong, costs its own file only.
    """
    table = registry.table()
    names = F.create_map(*(F.lit(x) for k, (identity, _) in sorted(table.items()) for x in (k, identity))) if table else F.lit(None).cast("map<string,string>")
    known = F.coalesce(F.element_at(names, F.col("kind")), F.element_at(names, F.lit("generic")))
    todo = files.select("source_id", "hash", "kind", "content", known.alias("identity"))
    keys = ["source_id", "hash", "identity"]
    if cached is not None:
        good = cached.where("error IS NULL")
        reused = good.join(todo.select(keys), keys, "left_semi")
        todo = todo.join(good.select(keys), keys, "left_anti")

    def one(kind: str, content: bytes) -> tuple:
        try:
            _, p = registry.resolve(kind)
            e = parse_envelope(p.run(content, dict(p.params)))
            drafts = [{**f, "confidence": float(f["confidence"]), "action_draft": json.dumps(f["action_draft"]) if f.get("action_draft") else None} for f in e["facts"]]
            full = [{k: d.get(k) for k in FACT_KEYS} for d in drafts]
            return full, e.get("companions") or [], e.get("diagnostics") or [], None
        except Exception as e:  # a processor is the caller's code: whatever it raises is its file's result
            return None, None, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, h, i, *one(k, c)) for s, h, k, c, i in zip(f["source_id"], f["hash"], f["kind"], f["content"], f["identity"], strict=True)]
            yield pd.DataFrame(rows, columns=["source_id", "hash", "identity", "facts", "companions", "diagnostics", "error"])

    made = todo.mapInPandas(run, RESULT)
    return made if cached is None else reused.select(made.columns).unionByName(made)


def facts(results: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """fact_id, kind, text, confidence, fidelity, source_refs: facts with the ids and receipts that the library gives.

    Secrets are redacted; a fact without a span has the document, or its locator, as its place.
    """
    f = results.select("source_id", F.posexplode("facts").alias("n", "f"))
    label = F.coalesce("f.locator", F.lit("document"))
    place = F.coalesce("f.span", F.from_json(F.to_json(F.struct(F.lit("doc").alias("kind"), label.alias("label"))), SPAN))
    refs = F.array(F.struct("source_id", place.alias("span")))
    return f.select(
        F.concat("source_id", F.lit("-f"), F.col("n").cast("string")).alias("fact_id"),
        "f.kind",
        redact(F.col("f.text"), patterns).alias("text"),
        "f.confidence",
        "f.fidelity",
        refs.alias("source_refs"),
    )
