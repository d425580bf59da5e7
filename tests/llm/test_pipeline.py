from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from tokenizers import Tokenizer

from feldspar.llm import mixing
from feldspar.llm.common import new_dir, written
from feldspar.llm.registry import VOCABULARY

from .cases import SF, documents
from .test_jaccard_join import brute as brute_components
from .test_other_operators import WORD, brute_lines, crc, ids_of
from .test_quality_rules import brute as brute_figures


def test_stages_against_brute_force(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: written(stages[name](spark, d, SF), new_dir(spark, "t"))

    good = step("quality rules", docs)
    failed = {r.doc_id for r in docs.collect() if brute_figures(r.text)[5]}
    assert good.columns == docs.columns and not failed & {r.doc_id for r in good.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert all(d in kept for d, q in quality.items() if q == 1 and d not in failed)

    lined = step("line dedup", good)
    want = {d: t for d, t, _, gone in brute_lines([(r.doc_id, r.text) for r in good.collect()]) if not gone or (t and WORD.search(t))}
    assert {r.doc_id: r.text for r in lined.collect()} == want

    single = step("n-gram Jaccard join", lined)
    parts = brute_components([(r.doc_id, r.text) for r in lined.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in parts})

    mixed = step("mixing", single)
    taken, out = defaultdict(int), defaultdict(int)
    for r in mixing.mix(single).collect():
        taken[r.doc_id] += r.taken
    for r in mixed.collect():
        out[r.doc_id] += len(WORD.findall(r.text))
    assert mixed.columns == docs.columns and dict(out) == {k: v for k, v in taken.items() if v}

    plain = Tokenizer.from_file(VOCABULARY)
    rows = stages["best-fit packing"](spark, mixed, SF).collect()
    pieces = [(r.doc_id, p, k, len(x[k : k + 2048]), crc(x[k : k + 2048])) for r in mixed.collect() for x in (ids_of(plain, r.text, 0),) for p, k in enumerate(range(0, len(x), 2048))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(pieces)
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(pieces)
