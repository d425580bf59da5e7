from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from feldspar.model import WITHHELD, OntologyFrames
from feldspar.operators import gates, graph, process
from feldspar.sources import adapters, ontology

from .fixture import PROV, SPAN, document, frames_of, val


@pytest.fixture(scope="module")
def g(spark):
    return frames_of(spark, document())


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_types_and_summaries(g):
    assert rows(graph.types(g)) == [("et_mill", "Mill", "active", 6, 2), ("et_shop", "Shop", "active", 2, 2)]
    assert rows(graph.entities(g, type="Shop"), "entity_id", "alias_count", "restricted") == [("e_shop1", 0, False), ("e_shop2", 0, False)]
    assert graph.entities(g, interface="Named").count() == 4 and graph.entities(g, type="Shop", interface="Other").count() == 0
    assert rows(graph.search(g, "OLD"), "entity_id") == [("e_mill",), ("e_mill2",)]
    assert rows(graph.gaps(g), "kind", "entity_id", "text") == [("note", None, '{"about":"f3"}'), ("orphan_entity", "e_shop2", "Far Shop")] or graph.gaps(g).count() == 2
    assert rows(graph.interfaces(g)) == [("i_named", "Named", 1, ["et_mill", "et_shop"])]
    assert graph.show(g).first().asDict() == {"ontology_id": "ont-1", "profile": "default", "version_id": "v-1", "entities": 4, "entity_types": 2, "links": 2, "resolutions": 1, "facts": 3, "sources": 2}


def test_entity_union_heads_and_masks(g):
    p = graph.properties(g).where("entity_id = 'e_mill'")
    assert rows(p.where("prop = 'output'"), "value", "from_entity") == [("6500", "e_mill"), ("7200", "e_mill2")]
    h = {(r.entity_id, r.prop): r["head"] for r in graph.heads(g).collect()}
    assert h["e_mill", "output"] == "7200" and h["e_mill", "site"] == "Ulm"
    bought = {r.entity_id: r.value for r in graph.properties(g).where("prop = 'bought'").collect()}
    assert bought == {"e_shop1": "3", "e_shop2": WITHHELD}
    assert {r.value for r in graph.properties(g, reveal=True).where("prop = 'bought'").collect()} == {"3", "4"}
    assert rows(graph.aliases(g).where("entity_id = 'e_mill'"), "text", "from_entity") == [("The Old Mill", "e_mill"), ("Ye Mill", "e_mill2")]
    assert rows(graph.facts(g).where("entity_id = 'e_mill'"), "fact_id") == [("f1",), ("f2",)]


def test_derived(g):
    strict = {(r.entity_id, r.prop): r.value for r in graph.derived(g).collect()}
    assert strict["e_mill", "clients"] == "2" and float(strict["e_mill", "sold"]) == 3 and strict["e_mill2", "clients"] == "0"
    assert float({(r.entity_id, r.prop): r.value for r in graph.derived(g, strict_security=False).collect()}["e_mill", "sold"]) == 7


def test_links_traverse_resolve_receipts(g):
    assert rows(graph.links(g).where("entity_id = 'e_shop1'"), "link_id", "link_type_name", "neighbor", "neighbor_label") == [("l1", "supplies", "e_mill", "Old Mill")]
    reached, path = graph.traverse(g, "e_shop1", 2)
    assert rows(reached, "entity_id", "depth") == [("e_mill", 1), ("e_shop1", 0), ("e_shop2", 2)]
    assert rows(path) == [(0, "e_shop1", "l1"), (1, "e_mill", "l1"), (1, "e_mill", "l2")]
    assert graph.traverse(g, "e_shop1", 0)[1].count() == 0
    role = {r.entity_id: (r.role, r.canonical, r.members, r.method) for r in graph.resolve(g).collect()}
    assert role["e_mill"] == ("canonical", "e_mill", ["e_mill2", "e_gone"], "agentverified") and role["e_mill2"][:2] == ("member", "e_mill") and role["e_shop1"][0] == "independent"
    cited = g.entities.select("entity_id", F.array(F.lit("f1"), F.lit("nope")).alias("fact_ids"))
    got = graph.receipts(g, cited, ["entity_id"]).where("entity_id = 'e_mill'").collect()
    assert [(r.source_id, r.resolved, r.source_kind, r.span.label) for r in got] == [("s1", True, "markdown", "intro")]


def test_traverse_small_levels_meet_links_unsorted(g, spark, monkeypatch):
    reached, path = graph.traverse(g, "e_shop1", 3)
    assert "SortMergeJoin" not in path._jdf.queryExecution().executedPlan().toString()  # links aren't dealt and sorted for a few nodes
    ends = [("a", "hub"), ("hub", "a"), ("hub", "hub"), ("a", "z"), *(("hub", f"n{i}") for i in range(40)), *((f"n{i}", f"m{i % 7}") for i in range(40)), ("x", "y")]
    links = spark.createDataFrame([(f"l{i}", *e) for i, e in enumerate(ends)], "link_id string, from_id string, to_id string")
    big = OntologyFrames.of(spark, links=links, entities=spark.createDataFrame([(n, n) for n in sorted({n for e in ends for n in e})], "entity_id string, label string"))
    depths, expected = {"a": 0}, []
    for d in range(3):
        level = [n for n, at in depths.items() if at == d]
        expected += [(d, n, f"l{i}") for i, e in enumerate(ends) for n in level if n in e]
        for e in ends:
            if set(e) & set(level):
                depths |= {n: d + 1 for n in e if n not in depths}
    for most in (100_000, 20, 0):  # all levels sent, the hub's neighbours dealt, all dealt
        monkeypatch.setattr(graph, "SENT_NODES", most)
        reached, path = graph.traverse(big, "a", 3)
        assert rows(path) == sorted(expected)
        assert rows(reached, "entity_id", "depth") == sorted(depths.items())


def test_self_loop_and_empty(spark):
    doc = document(links__l1__to="e_mill")
    assert rows(graph.incidence(frames_of(spark, doc)).where("link_id = 'l1'"), "entity_id", "neighbor", "direction") == [("e_mill", "e_mill", "both")]
    empty = OntologyFrames.of(spark)
    assert not graph.types(empty).count() and not graph.derived(empty).count() and not gates.violations(empty).where("gate <> 'G7'").count()


def test_processes(g):
    s = {r.step_id: r.status for r in process.steps(g).collect()}
    assert s == {"load": "confirmed", "drive": "de_facto_only", "sing": "de_jure_only", "pay": "conflict"}
    assert rows(process.logic_units(g), "step_count", "event_count") == [(4, 3)]
    assert process.conformance_summary(g).first().conflict == 1
    e = process.eligible(g).first()
    assert e.ratio == 0.5 and not e.eligible and "conflicting evidence" in e.reasons
    up = process.promote(g, "lu1", requested=3, reversibility="reversible", blast=60)
    assert up.lu_contracts.first().effective == "L2" and up.lu_contracts.first().baseline_steps == ["drive", "load"]
    assert process.drift(up).first().drift == 0 and process.demote(up, "lu1").lu_contracts.count() == 0
    assert rows(process.demote(up, "lu1").operations, "op") == [("demote",), ("promote",)]


def test_valid(g):
    assert gates.validate(g)["valid"], gates.violations(g).collect()


@pytest.mark.parametrize(
    ("code", "message", "changes"),
    [
        ("grounding", "cites no fact", {"entities__e_shop1__provenance": {"fact_ids": [], "source_ids": []}}),
        ("grounding", "source s9", {"facts__f1__source_refs": [{"source_id": "s9", "span": {"kind": "doc"}}]}),
        ("schema", "confidence", {"facts__f2__confidence": 1.5}),
        ("schema", "unsupported", {"schema": "ontology.v0"}),
        ("extensions", "namespace", {"extensions": {"plain": 1}}),
        ("type", "required property", {"entities__e_mill__properties__name": None}),
        ("type", "no such", {"entities__e_shop1__properties__hue": [val("red")]}),
        ("type", "more than one", {"entities__e_shop1__properties__name": [val("a"), val("b")]}),
        ("type", "not a number", {"entities__e_shop1__properties__bought": [val("three")]}),
        ("type", "allowed", {"entities__e_mill__properties__grade": [val("z")]}),
        ("type", "required field", {"entities__e_mill__properties__site": [val({"town": "Ulm"})]}),
        ("type", "wrong kind", {"entities__e_mill__properties__site": [val({"city": 5})]}),
        ("ref", "from_id nowhere", {"links__l1__from": "nowhere"}),
        ("ref", "another type", {"links__l1__to": "e_mill2"}),
        ("ref", "fact_id f9", {"entities__e_shop1__properties__bought": [val(3, "f9")]}),
        ("identity", "holds", {"entities__e_shop1__entity_id": "e_other", "links__l1__to": "e_other"}),
        ("resolution", "no evidence", {"resolutions__r1__evidence": {"fact_ids": []}}),
        ("resolution", "reversible", {"resolutions__r1__reversible": False}),
        ("resolution", "too", {"resolutions__r2": {"resolution_id": "r2", "canonical": "e_shop1", "members": ["e_mill2"], "evidence": {"fact_ids": ["f1"]}, "reversible": True}}),
        ("resolution", "list", {"entities__e_mill__resolved_from": ["e_gone"]}),
        ("security", "sec2", {"entities__e_shop1__security_id": "sec2"}),
        ("envelope", "hash", {"version__envelope__source_hashes": {"s1": "x"}}),
        ("eligibility", "contradicts", {"logic_units__lu1__state": "executable"}),
        ("autonomy", "floor", {"logic_units__lu1__state": "executable", "logic_units__lu1__contract": {"reversibility": "irreversible", "blast_radius": {"entities": 3}, "disposition": {"effective": "L3"}, "outputs": [], "restrictions": {"writes": []}}}),
        ("autonomy", "may not write", {"logic_units__lu1__state": "executable", "logic_units__lu1__contract": {"reversibility": "irreversible", "blast_radius": {"entities": 3}, "disposition": {"effective": "L0"}, "outputs": [{"name": "o", "writes": "x"}], "restrictions": {"writes": ["y"]}}}),
    ],
)
def test_gates(spark, code, message, changes):
    found = gates.violations(frames_of(spark, document(**changes))).collect()
    assert any(r.code == code and message in r.message for r in found), found


def test_document_source(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(document()))
    g = ontology.load_document(spark, str(path))
    assert g.entities.count() == 4
    ontology.save(g, str(tmp_path / "store"), "a")
    ontology.rollback(spark, str(tmp_path / "store"), "a", "b")
    back = ontology.load(spark, str(tmp_path / "store"), "b")
    assert gates.validate(back)["valid"] and rows(ontology.history(spark, str(tmp_path / "store")), "version_id") == [("a",), ("b",)]
    assert ontology.export_rows(g, "links").count("\n") == 2
    path.write_text(json.dumps(document() | {"views": {}}))
    with pytest.raises(ontology.SchemaError):
        ontology.load_document(spark, str(path))
    path.write_text("[1]")
    with pytest.raises(ontology.SchemaError):
        ontology.load_document(spark, str(path))


def test_fixture_is_shared():
    assert PROV["fact_ids"] and SPAN


def test_process_graph_holds_all_events(spark, tmp_path):
    # dates other than the test tables': all events count, the periods follow the table
    start = datetime.datetime(2031, 5, 1)
    events = [(i, 10 * (i % 2), "early" if i < 2 else "late" if i > 717 else f"mid{i % 3}", start + datetime.timedelta(hours=i), 1.0) for i in range(721)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    p = adapters.process_graph(spark, str(tmp_path))
    assert rows(process.logic_units(p), "step_count", "event_count") == [(5, 721)]
    assert all(r.de_facto for r in process.steps(p).collect())
    d = process.drift(p, adapters.current_events(spark, str(tmp_path))).first()
    assert d.baseline_steps == ["early", "mid2"] and d.current_steps == ["late"] and d.drift == 1
