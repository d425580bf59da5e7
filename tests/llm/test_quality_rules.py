from __future__ import annotations

import re
from collections import Counter

import pytest

from feldspar.llm import quality_rules

from .cases import documents, no_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_figures(spark, make):
    docs = make(spark)
    got = [tuple(r) for r in quality_rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    want = [(r.doc_id, *brute(r.text)) for r in docs.collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: (r[0] is None, str(r))) == sorted(want, key=lambda r: (r[0] is None, str(r))), key


def test_verdict_and_stage(spark):
    docs = odd_documents(spark)
    judged = quality_rules.apply_rules(docs)
    assert not judged.where("base_failed AND kept").count()
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count() > 0
    only = quality_rules.apply_rules(docs, (quality_rules.Rule("n_words", 100, 4000),))
    assert {r.n_words for r in only.where("kept").collect()} <= set(range(100, 4001))
    assert quality_rules.apply_rules(no_documents(spark)).count() == 0


def test_stop_words_in_any_case(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{body} The Der FÜR und OF {body}"), (2, f"{body} tHe dEr fuer {body}"), (3, f"the of und für der {body} {body}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_stop for r in quality_rules.apply_rules(docs).collect()} == {1: 5, 2: 0, 3: 5}


def test_labels(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality_rules.apply_rules(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_no_python(spark):
    plan = quality_rules.apply_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
