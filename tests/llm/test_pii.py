from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from feldspar.llm import pii
from feldspar.llm.registry import op7_pii  # noqa: F401

from .cases import documents, no_documents, odd_documents


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    spans = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "", re.ASCII) if ok(m[0])]
    return spans


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_base_spans(spark, make):
    docs = make(spark)
    extra = docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "concat(text, ' 1.2.3.4.5.6.7.8 ', text, ' a@b.c_d@e.f 4111-1111 1111 1111 +49 (30) 123-45') AS text") if make is documents else docs
    for t in (docs, extra):
        base = tuple(k for k in pii.KINDS if k.base)
        got = pii.find(t).select("doc_id", pii.joined(base).alias("s"), F.sha2(pii.joined(base), 256).alias("h")).collect()
        want = sorted(((r.doc_id, ",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text))) for r in t.collect()), key=str)
        assert sorted(((r.doc_id, r.s) for r in got), key=str) == want
        assert all(r.h == hashlib.sha256(r.s.encode()).hexdigest() for r in got)


def test_added_spans_and_redaction(spark):
    t = spark.createDataFrame([(1, "pay GB82WEST12345698765432 by Visa 378282246310005; GB82WEST12345698765433; 378282246310005 " + "x" * 50 + " 378282246310005, SSN 123-45-6789"), (2, None), (3, "write to a@b.org or 1.2.3.4")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(t).collect()}
    assert [(s.start, s.end, s.score) for s in got[1].iban] == [(4, 26, 1.0)]
    assert len(got[1].short_card) == 1 and len(got[1].tax_id) == 1
    red = {r.doc_id: r.text for r in pii.redact(t).collect()}
    assert red[2] == "" and red[3] == "write to <email> or <ip>" and "GB82WEST12345698765432" not in red[1]
    assert pii.find(no_documents(spark)).count() == 0


def test_grouped_ibans(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "FR14 2004 1010 0505 0001 3M02 606", "NO93-8601-1117-947", "GB82WEST12345698765432"]
    bad = ["DE88 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 0", "XDE89 3704 0044 0532 0130 00", "ZZ89 3704 0044 0532 0130 00", "DE89 37040 0440 5320 1300 0"]
    texts = [" ".join(f"pay {x} AT ONCE;" for x in good), " ".join(f"pay {x}A or {x[2:]}," for x in good), " ".join(f"pay {x}." for x in bad), None]
    got = {r.doc_id: r.iban for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [texts[0][s.start : s.end] for s in got[0]] == good
    assert got[1] == [] and got[2] == [] and got[3] == []


def test_many_matches_and_long_runs(spark):
    text = " ".join(f"u{i}@ex.org" for i in range(3000)) + " " + "7" * 100_000 + " " + "z" * 200_000 + "@"
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in row.email] == [(m.start(), m.end()) for m in re.finditer(BASE["email"][0], text[: text.index("777777")])]
    assert not row.card


def test_no_python(spark):
    plan = pii.find(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
