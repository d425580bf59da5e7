"""A small hand-written document: a mill that supplies two shops."""

from __future__ import annotations

import copy
import json

PROV = {"fact_ids": ["f1"], "source_ids": ["s1"]}
SPAN = [{"source_id": "s1", "span": {"kind": "doc", "label": "intro"}}]


def val(v, fact="f1", **more):
    return {"value": v, "fact_ids": [fact], "fidelity": "claimed", **more}


DOC = {
    "schema": "ontology.v1",
    "manifest": {"ontology_id": "ont-1", "schema": "ontology.v1", "profile": "default"},
    "sources": {s: {"source_id": s, "kind": "markdown", "path": f"{s}.md", "hash": f"h{s}"} for s in ("s1", "s2")},
    "facts": {f: {"fact_id": f, "kind": "knowledge", "text": f"fact {f}", "confidence": 0.7, "fidelity": "claimed", "source_refs": SPAN} for f in ("f1", "f2", "f3")},
    "interfaces": {"i_named": {"interface_id": "i_named", "name": "Named", "extends": [], "property_schema": {"name": {"value_kind": "string", "cardinality": "one", "required": True}}}},
    "entity_types": {
        "et_mill": {"type_id": "et_mill", "name": "Mill", "status": "active", "extends": ["i_named"], "provenance": PROV, "property_schema": {
            "name": {"value_kind": "string", "cardinality": "one", "required": True, "identity": True},
            "output": {"value_kind": "number", "cardinality": "many", "reducer": {"rule": "max"}},
            "site": {"value_kind": "struct", "cardinality": "one", "struct_fields": {"city": {"value_kind": "string", "required": True}}, "struct_main": "city"},
            "grade": {"value_kind": "enum", "cardinality": "one", "enum_values": ["a", "b"]},
            "clients": {"value_kind": "number", "cardinality": "one", "derived": {"link_type": "lt_supplies", "direction": "out", "aggregation": "count"}},
            "sold": {"value_kind": "number", "cardinality": "one", "derived": {"link_type": "lt_supplies", "direction": "out", "aggregation": "sum", "of": "bought"}},
        }},
        "et_shop": {"type_id": "et_shop", "name": "Shop", "status": "active", "extends": ["i_named"], "provenance": PROV, "property_schema": {"name": {"value_kind": "string", "cardinality": "one", "required": True}, "bought": {"value_kind": "number", "cardinality": "one"}}},
    },
    "entities": {
        "e_mill": {"entity_id": "e_mill", "type_id": "et_mill", "label": "Old Mill", "status": "active", "resolved_from": ["e_mill2", "e_gone"], "aliases": [{"text": "The Old Mill", "source_id": "s1"}], "provenance": PROV, "properties": {"name": [val("Old Mill")], "output": [val(6500)], "site": [val({"city": "Ulm"})], "grade": [val("a")]}},
        "e_mill2": {"entity_id": "e_mill2", "type_id": "et_mill", "label": "Mill (old)", "status": "active", "merged_into": "e_mill", "aliases": [{"text": "Ye Mill", "source_id": "s2"}], "provenance": {"fact_ids": ["f2"], "source_ids": ["s2"]}, "properties": {"name": [val("Mill", "f2")], "output": [val(7200, "f2")]}},
        "e_shop1": {"entity_id": "e_shop1", "type_id": "et_shop", "label": "Corner Shop", "status": "active", "aliases": [], "provenance": PROV, "properties": {"name": [val("Corner")], "bought": [val(3)]}},
        "e_shop2": {"entity_id": "e_shop2", "type_id": "et_shop", "label": "Far Shop", "status": "orphan", "aliases": [], "provenance": PROV, "properties": {"name": [val("Far")], "bought": [val(4, security_id="sec1")]}},
    },
    "link_types": {"lt_supplies": {"link_type_id": "lt_supplies", "name": "supplies", "from_type_id": "et_mill", "to_type_id": "et_shop", "cardinality": "many", "directed": True, "provenance": PROV}},
    "links": {f"l{i}": {"link_id": f"l{i}", "link_type_id": "lt_supplies", "from": "e_mill", "to": f"e_shop{i}", "fidelity": "claimed", "provenance": PROV} for i in (1, 2)},
    "resolutions": {"r1": {"resolution_id": "r1", "canonical": "e_mill", "members": ["e_mill2"], "evidence": {"fact_ids": ["f1", "f2"], "rationale": "same"}, "confidence": 0.95, "method": "agent+verified", "reversible": True}},
    "logic_units": {"lu1": {"logic_unit_id": "lu1", "name": "Deliver", "state": "observed", "trust_class": "measured", "steps": [
        {"step_id": "load", "text": "load", "evidence": [{"class": "de_jure", "source_id": "s1", "contradicts": False}]},
        {"step_id": "drive", "text": "drive", "evidence": []},
        {"step_id": "sing", "text": "sing", "evidence": [{"class": "de_jure", "source_id": "s1", "contradicts": False}]},
        {"step_id": "pay", "text": "pay", "evidence": [{"class": "de_jure", "source_id": "s1", "contradicts": True}]}]}},
    "events": {f"ev{i}": {"event_id": f"ev{i}", "logic_unit_id": "lu1", "step_id": s, "seq": i, "source_refs": SPAN} for i, s in enumerate(["load", "drive", "load"])},
    "notes": [{"about": "f3"}],
    "policy": {"security": {"sec1": {"who": "board"}}},
    "version": {"version_id": "v-1", "envelope": {"source_hashes": {"s1": "hs1", "s2": "hs2"}}},
    "extensions": {"acme.x": 1},
}


def document(**changes) -> dict:
    """The document with dotted paths set; a value of None removes the key."""
    doc = copy.deepcopy(DOC)
    for path, value in changes.items():
        at = doc
        *way, last = path.split("__")
        for k in way:
            at = at[k]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return doc


def frames_of(spark, doc):
    from feldspar.sources import ontology

    return ontology.frames(spark.createDataFrame([(json.dumps(doc),)], "doc string"))
