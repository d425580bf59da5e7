"""Ontology documents: reading, exporting, and versioned snapshots of the frames as Parquet."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.errors import FeldsparError, InvalidGraph
from feldspar.model import DERIVED, REDUCER, REFS, OntologyFrames

_PROV = "provenance struct<fact_ids:array<string>,source_ids:array<string>>"
_PROPS = f"map<string,struct<value_kind:string,cardinality:string,ref_type_id:string,enum_values:array<string>,required:boolean,identity:boolean,reducer:{REDUCER},derived:{DERIVED},struct_fields:map<string,struct<value_kind:string,required:boolean>>,struct_main:string>>"
_STEP = "struct<step_id:string,text:string,evidence:array<struct<class:string,source_id:string,event_ids:array<string>,contradicts:boolean,note:string>>>"
_CONTRACT = "struct<outputs:array<struct<name:string,writes:string>>,restrictions:struct<writes:array<string>>,reversibility:string,blast_radius:struct<entities:bigint>,disposition:struct<requested:string,floor:string,effective:string>,baseline_steps:array<string>>"
#: The document's collections: the rows' DDL by collection.
DOCUMENT = {
    "sources": "source_id string, kind string, path string, uri string, hash string",
    "facts": f"fact_id string, kind string, text string, confidence double, fidelity string, source_refs {REFS}",
    "entity_types": f"type_id string, name string, description string, status string, extends array<string>, property_schema {_PROPS}, {_PROV}",
    "interfaces": f"interface_id string, name string, extends array<string>, property_schema {_PROPS}",
    "entities": f"entity_id string, type_id string, label string, status string, security_id string, resolved_from array<string>, merged_into string, aliases array<struct<text:string,source_id:string>>, properties map<string,array<struct<value:variant,fact_ids:array<string>,fidelity:string,security_id:string>>>, {_PROV}",
    "link_types": f"link_type_id string, name string, from_type_id string, to_type_id string, cardinality string, directed boolean, {_PROV}",
    "links": f"link_id string, link_type_id string, `from` string, `to` string, fidelity string, security_id string, {_PROV}",
    "resolutions": "resolution_id string, canonical string, members array<string>, evidence struct<fact_ids:array<string>,rationale:string>, confidence double, method string, reversible boolean",
    "logic_units": f"logic_unit_id string, name string, state string, trust_class string, steps array<{_STEP}>, contract {_CONTRACT}",
    "events": f"event_id string, logic_unit_id string, step_id string, seq bigint, source_refs {REFS}",
}
KNOWN_KEYS = {*DOCUMENT, "schema", "manifest", "glossary", "notes", "policy", "version", "extensions"}


class SchemaError(FeldsparError, ValueError):
    """The text is no document of the contract."""


def load_document(spark: SparkSession, path: str) -> OntologyFrames:
    """The frames of the JSON document at ``path`` (any store that Spark reads). Raises SchemaError for unknown top-level keys or no JSON."""
    return frames(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")))


def open_document(spark: SparkSession, path: str, shown: int = 5) -> OntologyFrames:
    """The frames of a document that passes all gates; InvalidGraph with the first errors otherwise."""
    from feldspar.operators import gates

    g = load_document(spark, path)
    report = gates.validate(g, path, shown)
    if not report["valid"]:
        first = "; ".join(f"{e['code']} at {e['location']}: {e['message']}" for e in report["errors"])
        raise InvalidGraph(f"{path}: {report['error_count']} violations: {first}")
    return g


def check(spark: SparkSession, path: str, shown: int = 5) -> dict:
    """The report of ``gates.validate`` on a document; one that can't be read or parsed has that as its one error."""
    from feldspar.operators import gates

    try:
        return gates.validate(load_document(spark, path), path, shown)
    except (SchemaError, PySparkException) as e:
        code = "schema" if isinstance(e, SchemaError) or "MALFORMED_RECORD" in str(e) else "io"
        message = str(e).splitlines()[0]
        return {"valid": False, "path": path, "error_count": 1, "errors": [{"code": code, "location": path, "message": message}]}


def frames(doc: DataFrame) -> OntologyFrames:
    """``doc``: one row with the document's text in ``doc``."""
    spark = doc.sparkSession
    head = doc.select(F.expr("json_object_keys(doc)").alias("keys")).first()
    if head is None or head["keys"] is None:
        raise SchemaError("not a JSON object")
    if extra := sorted(set(head["keys"]) - KNOWN_KEYS):
        raise SchemaError(f"unknown keys: {', '.join(extra)}")

    def rows(name: str) -> DataFrame:
        ddl = f"struct<{name}:map<string,struct<{', '.join(_field(c) for c in _columns(DOCUMENT[name]))}>>>"
        m = doc.select(F.explode(F.from_json("doc", ddl, {"mode": "FAILFAST"})[name]).alias("map_key", "r"))
        return m.select("map_key", "r.*")

    prov: list[Column] = [F.col("provenance.fact_ids").alias("fact_ids"), F.col("provenance.source_ids").alias("source_ids")]
    types, faces, ents, units = rows("entity_types"), rows("interfaces"), rows("entities"), rows("logic_units")
    props = [d.select(F.col(k).alias("owner_id"), F.lit(n).alias("owner_kind"), F.explode("property_schema").alias("prop", "s")).select("owner_id", "owner_kind", "prop", "s.*") for d, k, n in ((types, "type_id", "type"), (faces, "interface_id", "interface"))]
    values = ents.select("entity_id", F.explode("properties").alias("prop", "v")).select("entity_id", "prop", F.posexplode_outer("v").alias("pos", "x"))
    steps = units.select("logic_unit_id", F.posexplode("steps").alias("pos", "s"))
    c = F.col("contract")
    version = "struct<schema:string,manifest:struct<ontology_id:string,profile:string>,version:struct<version_id:string,parent_version_id:string,envelope:struct<source_hashes:map<string,string>>>,extensions:map<string,variant>,policy:struct<security:map<string,variant>>,notes:array<variant>>"
    v = doc.select(F.from_json("doc", version).alias("d"))
    return OntologyFrames.of(
        spark,
        sources=rows("sources"), facts=rows("facts"), entity_types=types.select("*", *prov), interfaces=faces, prop_schemas=props[0].unionByName(props[1]), entities=ents.select("*", *prov),
        entity_props=values.select("entity_id", "prop", "pos", F.to_json("x.value").alias("value"), "x.fact_ids", "x.fidelity", "x.security_id").where("pos IS NOT NULL"),
        link_types=rows("link_types").select("*", *prov), links=rows("links").withColumnsRenamed({"from": "from_id", "to": "to_id"}).select("*", *prov),
        resolutions=rows("resolutions").withColumn("evidence", F.col("evidence.fact_ids")), logic_units=units,
        lu_steps=steps.select("logic_unit_id", "pos", "s.step_id", "s.text"),
        lu_evidence=steps.select("logic_unit_id", "s.step_id", F.posexplode("s.evidence").alias("pos", "e")).select("logic_unit_id", "step_id", "pos", "e.class", "e.source_id", "e.event_ids", F.coalesce("e.contradicts", F.lit(False)).alias("contradicts")),
        lu_contracts=units.where(c.isNotNull()).select("logic_unit_id", c["reversibility"].alias("reversibility"), c["blast_radius"]["entities"].alias("blast_entities"), c["disposition"]["requested"].alias("requested"), c["disposition"]["floor"].alias("floor"), c["disposition"]["effective"].alias("effective"), c["baseline_steps"].alias("baseline_steps"), c["restrictions"]["writes"].alias("allowed_writes"), F.transform(c["outputs"], lambda o: o["writes"]).alias("output_writes")),
        events=rows("events"), notes=v.select(F.posexplode("d.notes").alias("pos", "n")).select("pos", F.to_json("n").alias("text")),
        security=v.select(F.explode(F.map_keys("d.policy.security")).alias("security_id")),
        version=v.select("d.schema", "d.manifest.ontology_id", "d.manifest.profile", "d.version.version_id", "d.version.parent_version_id", F.col("d.version.envelope.source_hashes").alias("source_hashes"), F.map_keys("d.extensions").alias("extension_keys")),
    )


def _columns(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def _field(column: str) -> str:
    name, _, kind = column.partition(" ")
    return f"{name}:{kind}"


def save(g: OntologyFrames, root: str, version_id: str) -> str:
    """A snapshot below ``root``/v=<id>: one Parquet table for each collection, then a marker that makes it visible."""
    at = f"{root.rstrip('/')}/v={version_id}"
    for name, df in g.items():
        df.write.mode("error").parquet(f"{at}/{name}")
    g.version.sparkSession.range(1).select(F.lit(version_id).alias("version_id"), F.current_timestamp().alias("at")).write.parquet(f"{at}/committed")
    return at


def load(spark: SparkSession, root: str, version_id: str) -> OntologyFrames:
    at = f"{root.rstrip('/')}/v={version_id}"
    spark.read.parquet(f"{at}/committed")  # fails for a snapshot that was never completed
    return OntologyFrames.of(spark, **{name: spark.read.parquet(f"{at}/{name}") for name, _ in OntologyFrames.of(spark).items()})


def history(spark: SparkSession, root: str, limit: int = 10) -> DataFrame:
    """version_id, at of the newest snapshots."""
    return spark.read.parquet(f"{root.rstrip('/')}/v=*/committed").select("version_id", "at").orderBy(F.desc("at")).limit(limit)


def rollback(spark: SparkSession, root: str, version_id: str, as_version: str) -> str:
    """An old snapshot as a new version: history only grows."""
    return save(load(spark, root, version_id), root, as_version)


def export_rows(g: OntologyFrames, name: str) -> str:
    """One collection as canonical JSON lines (keys sorted), for small graphs: it collects."""
    return "".join(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) + "\n" for r in getattr(g, name).collect())
