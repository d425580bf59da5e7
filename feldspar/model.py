"""The graph as a bundle of DataFrames, one for each collection of an ontology document."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

#: What stands in for a value that is withheld.
WITHHELD = "[withheld]"
#: Fixed values of the data model.
FIDELITY = ("confirmed", "claimed", "guessed", "absent", "derived")
VALUE_KINDS = ("string", "number", "boolean", "date", "geopoint", "enum", "ref", "struct")
SCHEMA_VERSION = "ontology.v1"

IDS = "fact_ids array<string>, source_ids array<string>"
SPAN = "struct<kind:string,t_start:double,t_end:double,page:bigint,section:string,lines:array<int>,label:string,page_id:string,url:string,note:string,resolver:string,`ref`:string>"
REFS = f"array<struct<source_id:string,span:{SPAN}>>"
REDUCER, DERIVED = "struct<rule:string,by:string>", "struct<link_type:string,direction:string,aggregation:string,of:string>"

#: Columns of each collection. ``map_key`` is the key under which the document held the row; values are JSON texts.
SCHEMAS = {
    "sources": "map_key string, source_id string, kind string, path string, uri string, hash string",
    "facts": f"map_key string, fact_id string, kind string, text string, confidence double, fidelity string, source_refs {REFS}",
    "entity_types": f"map_key string, type_id string, name string, description string, status string, extends array<string>, {IDS}",
    "prop_schemas": f"owner_id string, owner_kind string, prop string, value_kind string, cardinality string, ref_type_id string, enum_values array<string>, required boolean, identity boolean, reducer {REDUCER}, derived {DERIVED}, struct_fields map<string,struct<value_kind:string,required:boolean>>, struct_main string",
    "interfaces": "map_key string, interface_id string, name string, extends array<string>",
    "entities": f"map_key string, entity_id string, type_id string, label string, status string, security_id string, resolved_from array<string>, merged_into string, aliases array<struct<text:string,source_id:string>>, {IDS}",
    "entity_props": "entity_id string, prop string, pos int, value string, fact_ids array<string>, fidelity string, security_id string",
    "link_types": f"map_key string, link_type_id string, name string, from_type_id string, to_type_id string, cardinality string, directed boolean, {IDS}",
    "links": f"map_key string, link_id string, link_type_id string, from_id string, to_id string, fidelity string, security_id string, {IDS}",
    "resolutions": "map_key string, resolution_id string, canonical string, members array<string>, evidence array<string>, confidence double, method string, reversible boolean",
    "logic_units": "map_key string, logic_unit_id string, name string, state string, trust_class string",
    "lu_steps": "logic_unit_id string, pos int, step_id string, text string",
    "lu_evidence": "logic_unit_id string, step_id string, pos int, class string, source_id string, event_ids array<string>, contradicts boolean",
    "lu_contracts": "logic_unit_id string, reversibility string, blast_entities bigint, requested string, floor string, effective string, baseline_steps array<string>, allowed_writes array<string>, output_writes array<string>",
    "events": f"map_key string, event_id string, logic_unit_id string, step_id string, seq bigint, source_refs {REFS}",
    "notes": "pos int, text string",
    "security": "security_id string",
    "version": "schema string, ontology_id string, profile string, version_id string, parent_version_id string, source_hashes map<string,string>, extension_keys array<string>",
    "operations": "pos int, op string, target string, author string, detail string",
}


@dataclass(frozen=True)
class OntologyFrames:
    """All collections; those not given are empty."""

    sources: DataFrame
    facts: DataFrame
    entity_types: DataFrame
    prop_schemas: DataFrame
    interfaces: DataFrame
    entities: DataFrame
    entity_props: DataFrame
    link_types: DataFrame
    links: DataFrame
    resolutions: DataFrame
    logic_units: DataFrame
    lu_steps: DataFrame
    lu_evidence: DataFrame
    lu_contracts: DataFrame
    events: DataFrame
    notes: DataFrame
    security: DataFrame
    version: DataFrame
    operations: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **given: DataFrame) -> "OntologyFrames":
        """Frames with the given collections, whose missing columns are null."""
        from pyspark.sql import functions as F

        out = {}
        for name, ddl in SCHEMAS.items():
            empty = spark.createDataFrame([], ddl)
            if name in given:
                df = given[name]
                out[name] = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))
            else:
                out[name] = empty
        return cls(**out)

    def with_(self, **changed: DataFrame) -> "OntologyFrames":
        return replace(self, **changed)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]
