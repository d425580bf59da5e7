"""Integrity gates: each yields rows (gate, code, location, message); a graph is valid if there are none.

References are checked by anti-joins made from a table of (child, key, parent) entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feldspar.model import SCHEMA_VERSION, OntologyFrames
from feldspar.operators.graph import closure


def _rows(df: DataFrame, gate: str, code: str, location: Column, message: Column | str) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), F.lit(code).alias("code"), location.alias("location"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _none(ids: str) -> Column:
    return F.coalesce(F.size(ids), F.lit(0)) <= 0


def _at(kind: str, *keys: str) -> Column:
    return F.concat_ws(".", F.lit(kind), *(F.col(k) for k in keys))


def missing(child: DataFrame, key: str, parent: DataFrame, parent_key: str, gate: str, code: str, location: Column, what: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``key`` isn't in ``parent``."""
    known = parent.select(F.col(parent_key).alias(key))
    return _rows(child.where(F.col(key).isNotNull()).join(known, key, "left_anti"), gate, code, location, F.concat(F.lit(f"{what} "), F.col(key), F.lit(" is unknown")))


def header(g: OntologyFrames) -> DataFrame:
    version = _rows(g.version.where(~F.col("schema").eqNullSafe(SCHEMA_VERSION)), "G0", "schema", F.lit("schema"), F.concat(F.lit("unsupported schema "), F.coalesce("schema", F.lit("none"))))
    keys = g.version.select(F.explode("extension_keys").alias("key")).where(~F.contains("key", F.lit(".")))
    return version.unionByName(_rows(keys, "G0", "extensions", _at("extensions", "key"), "extension keys need a namespace"))


def grounding(g: OntologyFrames) -> DataFrame:
    refs = g.facts.select("fact_id", F.explode("source_refs.source_id").alias("source_id"))
    event_refs = g.events.select("event_id", F.explode("source_refs.source_id").alias("source_id"))
    bad = F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1)
    out = [
        _rows(g.facts.where(_none("source_refs")), "G1", "grounding", _at("facts", "fact_id"), "a fact needs a source"),
        _rows(g.facts.where(bad), "G1", "schema", _at("facts", "fact_id"), "confidence is outside 0 to 1"),
        missing(refs, "source_id", g.sources, "source_id", "G1", "grounding", _at("facts", "fact_id"), "source"),
        _rows(g.entity_props.where(_none("fact_ids")), "G1", "grounding", _at("entities", "entity_id", "prop"), "a value cites no fact"),
        _rows(g.events.where(_none("source_refs")), "G1", "grounding", _at("events", "event_id"), "an event needs a source"),
        missing(event_refs, "source_id", g.sources, "source_id", "G1", "grounding", _at("events", "event_id"), "source"),
    ]
    for name, key in (("entity_types", "type_id"), ("link_types", "link_type_id"), ("entities", "entity_id"), ("links", "link_id")):
        out.append(_rows(getattr(g, name).where(_none("fact_ids")), "G1", "grounding", _at(name, key), "cites no fact"))
    return reduce(DataFrame.unionByName, out)


def _kind(value: Column) -> Column:
    """The JSON type of a JSON text: string, number, boolean, object, array or null."""
    s = F.schema_of_variant(F.try_parse_json(value))
    return F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "VOID", "null").otherwise("number")


def conformance(g: OntologyFrames) -> DataFrame:
    """Required and unknown properties, cardinality, and the values of each kind; entities of unknown types are left out."""
    schemas = g.prop_schemas
    own = schemas.where("owner_kind = 'type'").withColumnRenamed("owner_id", "type_id")
    typed = g.entities.join(g.entity_types.select("type_id"), "type_id", "left_semi").select("entity_id", "type_id")
    present = g.entity_props.select("entity_id", "prop").distinct()
    required = own.where("required AND derived IS NULL").select("type_id", "prop")
    by_interface = closure(g).join(schemas.where("owner_kind = 'interface' AND required").select(F.col("owner_id").alias("interface_id"), "prop"), "interface_id").select("type_id", "prop")
    need = lambda r: typed.join(r.distinct(), "type_id").join(present, ["entity_id", "prop"], "left_anti")
    values = g.entity_props.join(typed, "entity_id")
    unknown = values.select("entity_id", "type_id", "prop").distinct().join(own.select("type_id", "prop"), ["type_id", "prop"], "left_anti")
    v = values.join(own.select("type_id", "prop", "value_kind", "cardinality", "ref_type_id", "enum_values", "struct_fields", "derived"), ["type_id", "prop"]).withColumn("json", _kind(F.col("value")))
    many = v.where("cardinality = 'one' AND derived IS NULL").groupBy("entity_id", "prop").count().where("count > 1")
    want = {"string": ["string"], "date": ["string"], "enum": ["string"], "ref": ["string"], "number": ["number"], "boolean": ["boolean"], "geopoint": ["object"], "struct": ["object"]}
    fits = reduce(lambda c, k: c.when(F.col("value_kind") == k[0], F.col("json").isin(*k[1])), list(want.items())[1:], F.when(F.col("value_kind") == "string", F.col("json").isin("string"))).otherwise(True)
    where = _at("entities", "entity_id", "prop")
    text = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    enums = v.where((F.col("value_kind") == "enum") & (F.col("json") == "string") & ~F.coalesce(F.array_contains("enum_values", text), F.lit(False)))
    targets = g.entities.select(F.col("entity_id").alias("target"), F.col("type_id").alias("target_type"))
    refs = v.where("value_kind = 'ref' AND json = 'string' AND ref_type_id IS NOT NULL").withColumn("target", text).join(targets, "target").where("target_type <> ref_type_id")
    parts = v.where("value_kind = 'struct' AND json = 'object'").select("entity_id", "prop", F.explode("struct_fields").alias("field", "spec"), F.from_json("value", "map<string,string>").alias("m"), "value")
    lacking = parts.where("spec.required AND NOT map_contains_key(m, field)")
    field_json = F.to_json(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").getItem(F.col("field")))
    kind_of = _kind(field_json)
    wrong = parts.where("map_contains_key(m, field)").where(~reduce(lambda c, k: c.when(F.col("spec.value_kind") == k[0], kind_of.isin(*k[1])), list(want.items())[1:], F.when(F.col("spec.value_kind") == "string", kind_of == "string")).otherwise(True))
    out = [
        _rows(need(required), "G2", "type", where, "a required property is missing"),
        _rows(need(by_interface), "G2", "type", where, "a property that an interface requires is missing"),
        _rows(unknown, "G2", "type", where, "the type has no such property"),
        _rows(many, "G2", "type", where, "more than one value"),
        _rows(v.where(~fits), "G2", "type", where, F.concat(F.lit("not a "), F.col("value_kind"))),
        _rows(enums, "G2", "type", where, "not among the allowed values"),
        _rows(refs, "G2", "type", where, "refers to an entity of another type"),
        _rows(lacking, "G2", "type", where, "a required field is missing"),
        _rows(wrong, "G2", "type", where, "a field of the wrong kind"),
    ]
    return reduce(DataFrame.unionByName, out)


def references(g: OntologyFrames) -> DataFrame:
    """Every reference resolves; links join the types they declare (* is any)."""
    ex = lambda df, key, col, to: df.select(key, F.explode(col).alias(to))
    text = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    ref_props = g.prop_schemas.where("owner_kind = 'type' AND value_kind = 'ref'").select(F.col("owner_id").alias("type_id"), "prop")
    ref_values = g.entity_props.join(g.entities.select("entity_id", "type_id"), "entity_id").join(ref_props, ["type_id", "prop"]).select(F.col("entity_id").alias("owner"), text.alias("entity_id"))
    members = g.entities.select("entity_id")
    table = [
        (g.entities.select("entity_id", "type_id"), "type_id", g.entity_types, "type_id", _at("entities", "entity_id")),
        (ex(g.entities, "entity_id", "fact_ids", "fact_id"), "fact_id", g.facts, "fact_id", _at("entities", "entity_id")),
        (ex(g.entities, "entity_id", "source_ids", "source_id"), "source_id", g.sources, "source_id", _at("entities", "entity_id")),
        (ex(g.entities, "entity_id", "aliases.source_id", "source_id"), "source_id", g.sources, "source_id", _at("entities", "entity_id")),
        (ex(g.entity_props, "entity_id", "fact_ids", "fact_id"), "fact_id", g.facts, "fact_id", _at("entities", "entity_id")),
        (ref_values, "entity_id", members, "entity_id", _at("entities", "owner")),
        (ex(g.entity_types, "type_id", "fact_ids", "fact_id"), "fact_id", g.facts, "fact_id", _at("entity_types", "type_id")),
        (ex(g.link_types, "link_type_id", "fact_ids", "fact_id"), "fact_id", g.facts, "fact_id", _at("link_types", "link_type_id")),
        (ex(g.entity_types, "type_id", "extends", "interface_id"), "interface_id", g.interfaces, "interface_id", _at("entity_types", "type_id")),
        (g.interfaces.select(F.col("interface_id").alias("child"), F.explode("extends").alias("interface_id")), "interface_id", g.interfaces, "interface_id", _at("interfaces", "child")),
        (g.links.select("link_id", "link_type_id"), "link_type_id", g.link_types, "link_type_id", _at("links", "link_id")),
        (g.links.select("link_id", "from_id"), "from_id", members, "entity_id", _at("links", "link_id")),
        (g.links.select("link_id", "to_id"), "to_id", members, "entity_id", _at("links", "link_id")),
        (ex(g.links, "link_id", "fact_ids", "fact_id"), "fact_id", g.facts, "fact_id", _at("links", "link_id")),
        (ex(g.resolutions, "resolution_id", "evidence", "fact_id"), "fact_id", g.facts, "fact_id", _at("resolutions", "resolution_id")),
        (g.events.select("event_id", "logic_unit_id"), "logic_unit_id", g.logic_units, "logic_unit_id", _at("events", "event_id")),
        (g.lu_evidence.select("logic_unit_id", "step_id", "source_id"), "source_id", g.sources, "source_id", _at("logic_units", "logic_unit_id", "step_id")),
        (g.lu_evidence.select("logic_unit_id", "step_id", F.explode("event_ids").alias("event_id")), "event_id", g.events, "event_id", _at("logic_units", "logic_unit_id", "step_id")),
    ]
    out = [missing(child, key, parent, parent_key, "G3", "ref", location, key) for child, key, parent, parent_key, location in table]
    kinds = g.link_types.select("link_type_id", "from_type_id", "to_type_id")
    for end in ("from", "to"):
        e = g.entities.select(F.col("entity_id").alias(f"{end}_id"), F.col("type_id").alias("actual"))
        bad = g.links.join(kinds, "link_type_id").join(e, f"{end}_id").where(f"{end}_type_id <> '*' AND {end}_type_id <> actual")
        out.append(_rows(bad, "G3", "ref", _at("links", "link_id"), f"the {end} end has another type than declared"))
    return reduce(DataFrame.unionByName, out)


def identity(g: OntologyFrames) -> DataFrame:
    keys = {"sources": "source_id", "facts": "fact_id", "entity_types": "type_id", "interfaces": "interface_id", "entities": "entity_id", "link_types": "link_type_id", "links": "link_id", "resolutions": "resolution_id", "logic_units": "logic_unit_id", "events": "event_id"}
    return reduce(DataFrame.unionByName, (_rows(getattr(g, n).where(F.col("map_key").isNotNull() & (F.col("map_key") != F.col(k))), "G4", "identity", _at(n, "map_key"), F.concat(F.lit("holds "), F.col(k))) for n, k in keys.items()))


def resolution(g: OntologyFrames) -> DataFrame:
    r, e = g.resolutions, g.entities.select("entity_id", "resolved_from")
    where = _at("resolutions", "resolution_id")
    members = r.select("resolution_id", "canonical", F.explode("members").alias("member"))
    before = members.withColumn("other", F.lag("canonical").over(Window.partitionBy("member").orderBy("resolution_id")))
    listed = members.join(e.where("resolved_from IS NOT NULL").withColumnRenamed("entity_id", "canonical"), "canonical").where("member <> canonical AND NOT array_contains(resolved_from, member)")
    out = [
        missing(r.select("resolution_id", "canonical"), "canonical", g.entities, "entity_id", "G5", "resolution", where, "canonical"),
        _rows(r.where(_none("evidence")), "G5", "resolution", where, "no evidence"),
        _rows(r.where("NOT coalesce(reversible, false)"), "G5", "resolution", where, "not reversible"),
        missing(members, "member", g.entities, "entity_id", "G5", "resolution", where, "member"),
        _rows(before.where("other <> canonical"), "G5", "resolution", where, F.concat(F.lit("a member of "), F.col("other"), F.lit(" too"))),
        _rows(listed, "G5", "resolution", where, "the canonical entity doesn't list a member"),
    ]
    return reduce(DataFrame.unionByName, out)


def security(g: OntologyFrames) -> DataFrame:
    out = [missing(getattr(g, n).select(k, "security_id"), "security_id", g.security, "security_id", "G6", "security", _at(at, k), "security id") for n, k, at in (("entities", "entity_id", "entities"), ("entity_props", "entity_id", "entities"), ("links", "link_id", "links"))]
    return reduce(DataFrame.unionByName, out)


def envelope(g: OntologyFrames) -> DataFrame:
    blank = _rows(g.version.where("trim(coalesce(version_id, '')) = ''"), "G7", "envelope", F.lit("version"), "no version id")
    pinned = g.version.select(F.explode(F.map_keys("source_hashes")).alias("source_id"))
    return blank.unionByName(_rows(g.sources.select("source_id").join(pinned, "source_id", "left_anti"), "G7", "envelope", _at("sources", "source_id"), "no pinned hash"))


def eligibility(g: OntologyFrames) -> DataFrame:
    from feldspar.operators.process import steps

    s = steps(g).where("state = 'executable'")
    where = _at("logic_units", "logic_unit_id", "step_id")
    return _rows(s.where("conflict"), "G8", "eligibility", where, "evidence contradicts the step").unionByName(_rows(s.where("NOT de_facto"), "G8", "eligibility", where, "nothing attests the step"))


def autonomy(g: OntologyFrames) -> DataFrame:
    from feldspar.operators.process import floor_level

    c = g.lu_contracts.join(g.logic_units.where("state = 'executable'").select("logic_unit_id", "trust_class"), "logic_unit_id")
    level = F.regexp_extract("effective", "^L([0-3])$", 1).try_cast("int")
    low = floor_level(F.col("reversibility"), F.col("blast_entities"), F.col("trust_class"))
    where = _at("logic_units", "logic_unit_id")
    out = [
        _rows(c.where(level.isNull()), "G9", "autonomy", where, "not a level"),
        _rows(c.where(level > low), "G9", "autonomy", where, "above its floor"),
        _rows(c.select("*", F.explode("output_writes").alias("write")).where("NOT array_contains(coalesce(allowed_writes, array()), write)"), "G9", "autonomy", where, F.concat(F.lit("may not write "), F.col("write"))),
    ]
    return reduce(DataFrame.unionByName, out)


GATES = {"G0": header, "G1": grounding, "G2": conformance, "G3": references, "G4": identity, "G5": resolution, "G6": security, "G7": envelope, "G8": eligibility, "G9": autonomy}


def violations(g: OntologyFrames, gates: tuple[str, ...] = tuple(GATES)) -> DataFrame:
    return reduce(DataFrame.unionByName, (GATES[n](g) for n in gates))


def validate(g: OntologyFrames, path: str = "", shown: int = 5) -> dict:
    """A report: valid, path, error_count and the first errors."""
    bad = violations(g)
    count = bad.count()
    errors = bad.orderBy("gate", "code", "location", "message").limit(shown).collect() if count else []
    return {"valid": not count, "path": path, "error_count": count, "errors": [{k: r[k] for k in ("code", "location", "message")} for r in errors]}
