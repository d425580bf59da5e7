from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from feldspar import errors
from feldspar.functions import settings
from feldspar.operators import graph, index, process, resolution
from feldspar.sources import ontology

from .fixture import document, frames_of


def test_open_and_check(spark, tmp_path):
    good, bad, odd = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "odd.json"
    good.write_text(json.dumps(document()))
    bad.write_text(json.dumps(document(schema="other")))
    odd.write_text("{ no json")
    assert ontology.check(spark, str(good)) == {"valid": True, "path": str(good), "error_count": 0, "errors": []}
    assert ontology.open_document(spark, str(good)).entities.count() == 4
    with pytest.raises(errors.InvalidGraph):
        ontology.open_document(spark, str(bad))
    assert any(e["code"] == "schema" for e in ontology.check(spark, str(bad))["errors"])
    for path, code in ((odd, "schema"), (tmp_path / "none.json", "io")):
        got = ontology.check(spark, str(path))
        assert (got["valid"], got["error_count"], got["errors"][0]["code"]) == (False, 1, code)


def test_entity_view(spark):
    g = frames_of(spark, document())
    e = graph.entity(g, "e_mill")
    assert (e.label, e.type_name, e.restricted) == ("Old Mill", "Mill", False)
    assert [a.text for a in e.aliases] == ["The Old Mill", "Ye Mill"]
    assert [r.fact_id for r in e.receipts] == ["f1", "f2"]
    assert e.properties["name"][0].from_entity == "e_mill" and e.derived["clients"] == "2"
    far = graph.entity(g, "e_shop2")
    assert far.properties["bought"][0].withheld and far.heads == {} and far.resolved_from == []
    assert graph.entity(g, "e_shop2", reveal=True).properties["bought"][0].value == "4"
    with pytest.raises(errors.NotFound) as no:
        graph.entity(g, "e_nobody")
    assert no.value.exit_code == 3
    assert {r.collection: r.n for r in graph.counts(g).collect()} == {"entities": 4, "links": 2, "facts": 3, "entity_types": 2, "link_types": 1, "resolutions": 1}


def test_conformance_loop(spark):
    g = process.promote(frames_of(spark, document()), "lu1", requested=3, reversibility="reversible")
    same, acted = process.run_conformance(g)
    assert acted.count() == 0 and same.notes.count() == 1
    other = spark.createDataFrame([("lu1", "fly"), ("lu1", "load")], "logic_unit_id string, step_id string")
    after, acted = process.run_conformance(g, other)
    assert [(r.logic_unit_id, r.action) for r in acted.collect()] == [("lu1", "demote")]
    assert after.logic_units.first().state == "observed" and after.lu_contracts.count() == 0
    assert [(r.pos, r.op, r.author) for r in after.operations.orderBy("pos").collect()] == [(0, "promote", "user"), (1, "demote", "system")]
    assert json.loads(after.notes.orderBy(F.desc("pos")).first().text)["kind"] == "conformance_demote"


def test_canonical_names(spark):
    names = spark.createDataFrame([("User", 3), ("Users", 1), ("Client", 2), ("Customer", 5), ("A", 1), ("B", 1)], "name string, n long")
    proposals = [("User", "Nobody"), ("User", "Client"), ("Client", "Customer"), ("A", "B"), ("B", "A"), ("B", "B")]
    got = {r["name"]: r["canonical"] for r in resolution.canonical_names(names, proposals).collect()}
    assert got == {"User": "Customer", "Users": "Customer", "Client": "Customer", "Customer": "Customer", "A": "A", "B": "B"}
    assert resolution.canonical_names(names).count() == 6
    assert resolution.ends_of_chains({"x": "a", "a": "b", "b": "a"})["x"] == "a"


def test_index(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    for name in ("a.md", "sub/b.md", "sub/skip.md", "c.txt"):
        (root / name).write_text("x")
    ix = index.init(spark, str(root), ignore=["skip"])
    assert sorted(r.file for r in ix.nodes.collect()) == ["a.md", "sub/b.md"]
    ix = index.write_summary(ix, "a.md", "first")
    ix = index.write_toc(index.write_toc(ix, "a.md", "1-2 old"), "a.md", "1-3 new")
    ix = index.write_keyword(index.write_keyword(ix, "a.md", "k"), "a.md", "k")
    ix = index.write_edge(ix, "a.md:2-3", "elsewhere.md:1", "cites")
    ix = index.write_glossary(ix, "mill", "grinds", "a.md:1, ,sub/b.md:2-4")
    ix = index.write_note(index.write_note(ix, "who", "a"), "who", "b")
    ix = index.load(spark, index.save(ix, str(tmp_path / "state")))
    n = index.node(ix, "a.md").first()
    assert (n.summary, n.entries, n.keywords) == ("first", "1-3 new", ["k"])
    assert [tuple(e) for e in n.edges] == [("elsewhere.md:1", "2-3", "cites")]
    assert index.glossary(ix, "mill").first().refs == ["a.md:1", "sub/b.md:2-4"] and index.glossary(ix).count() == 1
    assert [r.value for r in index.notes(ix, "who").collect()] == ["b"]
    for bad, error in (
        (lambda: index.write_edge(ix, "nowhere.md:1", "a.md:1", "r"), errors.NotFound),
        (lambda: index.write_edge(ix, "a.md:0", "a.md:1", "r"), errors.BadArgument),
        (lambda: index.write_glossary(ix, "t", "d", "a.md"), errors.BadArgument),
        (lambda: index.notes(ix, "nobody"), errors.NotFound),
    ):
        with pytest.raises(error):
            bad()


def test_feedback(spark, tmp_path):
    path = str(tmp_path / "feedback")
    first = index.give_feedback(spark, path, "note", ["e_mill"], "stale")
    index.give_feedback(spark, path, "add_link", ["a", "b"], "seen", link_type="lt", fact_ids=["f1"])
    rows = {r.kind: r for r in spark.read.json(path).collect()}
    assert rows["note"].feedback_id == first and {r.status for r in rows.values()} == {"pending"}
    assert rows["add_link"].fact_ids == ["f1"]
    with pytest.raises(errors.BadArgument):
        index.give_feedback(spark, path, "praise", [])


def test_settings(tmp_path):
    assert settings.safe_environment({"API_key": "x", "SSH_AUTH_SOCK": "s", "PATH": "p"}) == {"SSH_AUTH_SOCK": "s", "PATH": "p"}
    assert settings.credential_slot("env:billing", "X_") == "X_BILLING"
    assert settings.credential_slot("s3cret") is settings.credential_slot("env:") is settings.credential_slot("file:x") is None
    assert settings.inside(str(tmp_path), "a/../b") and not settings.inside(str(tmp_path), "../b")
    with pytest.raises(errors.NoIndex):
        settings.state_dir(str(tmp_path), ".no-such-folder")
    made = settings.create_state_dir(str(tmp_path))
    (tmp_path / "x").mkdir()
    assert settings.state_dir(str(tmp_path / "x")) == made
    with pytest.raises(errors.NotFound):
        settings.graph_path(None, str(tmp_path))
    assert settings.graph_path("given.json", "/") == "given.json"
