from __future__ import annotations

import io
import zipfile

import pytest

from feldspar.errors import BadArgument
from feldspar.operators import office, processors
from feldspar.operators.processors import ENVELOPE, Processor, Registry


def archive(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def test_office(spark):
    w, a, p = (x.strip("{}") for x in (office.W, office.A, office.P))
    para = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    table = f'<w:tbl><w:tr><w:tc>{para("a")}</w:tc><w:tc>{para("b")}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{para("c")}</w:tc></w:tr></w:tbl>'
    body = para("Top", "Title") + para("One", "h") + para(" ") + para("Two", "Heading3") + para("plain") + table
    styles = f'<w:styles xmlns:w="{w}"><w:style w:styleId="h"><w:name w:val="heading 2"/></w:style></w:styles>'
    docx = archive(word__document_DOT_xml=f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>', word__styles_DOT_xml=styles)
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda *t: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{"".join(map(shape, t))}</p:spTree></p:cSld></p:sld>'
    rel = office.REL.strip("{}")
    pptx = archive(
        ppt__presentation_DOT_xml=f'<p:presentation xmlns:p="{p}" xmlns:r="{rel}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        ppt___rels__presentation_DOT_xml_DOT_rels='<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        ppt__slides__slide1_DOT_xml=slide("last"),
        ppt__slides__slide2_DOT_xml=slide("first", "", "more"),
    )
    t = office.ODT.strip("{}")
    odt = archive(content_DOT_xml=f'<d xmlns:t="{t}"><t:p>own <t:span>inner</t:span> tail</t:p><t:p> </t:p><t:p>next</t:p></d>')
    files = [(1, docx), (2, pptx), (3, odt), (4, b"no zip"), (5, None), (6, archive(x="y"))]
    got = {r.key: r for r in office.office(spark.createDataFrame(files, "id int, body binary"), "id", "body").collect()}
    assert got[1].paragraphs == ["Top", "One", "Two", "plain"] and got[1].text == "Top\nOne\nTwo\nplain"
    assert [tuple(o) for o in got[1].outline] == [(0, "Top"), (2, "One"), (1, "Two")]
    assert got[1].tables == [[["a", "b"], ["c", "c"]]]
    assert got[2].text == "[slide 1]\nfirst\nmore\n\n[slide 2]\nlast"
    assert got[3].paragraphs == ["own  tail", "next"]
    assert all(got[k].error and got[k].text is None for k in (4, 5, 6))


def lines(content, params):
    if content == b"fail":
        raise ValueError("no")
    facts = [{"kind": "knowledge", "text": x, "confidence": params.get("c", 1), "fidelity": "claimed"} for x in content.decode().split("|")]
    return {"envelope": ENVELOPE, "facts": facts, "diagnostics": ["ran"]}


def forged(content, params):
    return 'log {"envelope": "extraction.v1", "facts": [{"fact_id": "mine", "kind": "action"}]} end'


def test_extract_and_cache(spark):
    ddl = "source_id string, kind string, hash string, content binary"
    files = spark.createDataFrame([("s1", "md", "h1", b"a|b"), ("s2", "md", "h2", b"fail"), ("s3", "csv", "h3", b"x"), ("s4", "png", "h4", b"x")], ddl)
    registry = Registry(configured=(Processor("lines", "md", lines, params={"c": 0.5}),), builtin=(Processor("other", "md", forged), Processor("forged", "csv", forged)))
    got = {r.source_id: r for r in processors.extract(files, registry).collect()}
    assert [f.text for f in got["s1"].facts] == ["a", "b"] and got["s1"].diagnostics == ["ran"] and got["s1"].identity.startswith("config:md:lines")
    assert "no" in got["s2"].error and "fact_id not allowed" in got["s3"].error and "no processor" in got["s4"].error
    first = processors.extract(files, registry).cache()
    f = processors.facts(first).orderBy("fact_id").collect()
    assert [(r.fact_id, r.text, r.confidence, r.source_refs[0].source_id, r.source_refs[0].span.label) for r in f] == [("s1-f0", "a", 0.5, "s1", "document"), ("s1-f1", "b", 0.5, "s1", "document")]
    edited = spark.createDataFrame([("s1", "md", "h1", b"never read"), ("s2", "md", "h9", b"c")], ddl)
    again = {r.source_id: [f.text for f in r.facts] for r in processors.extract(edited, registry, first).collect()}
    assert again == {"s1": ["a", "b"], "s2": ["c"]}
    newer = Registry(configured=(Processor("lines", "md", lines, version="1"),))
    assert {r.source_id: len(r.facts) for r in processors.extract(edited, newer, first).collect()} == {"s1": 1, "s2": 1}
    assert processors.extract(files.limit(0), registry).count() == 0


def test_envelopes():
    good = {"kind": "action", "text": "t", "confidence": 1, "fidelity": "guessed"}
    assert processors.parse_envelope({"envelope": ENVELOPE, "facts": [good], "companions": [{"kind": "audio", "path": "p"}]})["facts"] == [good]
    wrong = [{"facts": []}, {"envelope": ENVELOPE}, {"envelope": ENVELOPE, "facts": [], "brief_id": "b"}, "none", "{ x }"]
    wrong += [{"envelope": ENVELOPE, "facts": [good | change]} for change in ({"confidence": 2}, {"confidence": True}, {"text": ""}, {"kind": "x"}, {"source_refs": []})]
    wrong.append({"envelope": ENVELOPE, "facts": [], "companions": [{"kind": "x", "path": "p"}]})
    for e in wrong:
        with pytest.raises(BadArgument):
            processors.parse_envelope(e)
