from __future__ import annotations

import random
import re

import numpy as np
import pytest

from feldspar.llm import jaccard_join as jj
from feldspar.llm.components import connected

from .cases import documents, no_documents, odd_documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, num, den):
    sets, up = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    ids: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return [(d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(n_base, n_copies, size, seed):
    r, out = random.Random(seed), []
    for b in range(n_base):
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        for _ in range(n_copies):
            w = list(base)
            for _ in range(r.randrange(0, max(2, size // 25))):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.3:
                w = w[: -r.randrange(1, 8)]
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("make", [documents, odd_documents, "edited"])
def test_components(spark, make, k, num, den):
    if make == "edited":
        texts = edited(3, 60, 90, 1) + edited(4, 12, 14, 2) + edited(2, 20, 400, 3) + [words(n, n) for n in range(1, 40)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    else:
        docs = make(spark)
    got = jj.jaccard_classes(docs, words=k, num=num, den=den, chunk_hashes=2500).select("doc_id", "n_shingles", "component_id").collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, num, den)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    if make == "edited":
        assert 10 < len({c for _, _, c in want}) < len(want)


def test_keys_meet():
    """Any two sets that reach the threshold share a key, whatever their sizes and the hashes' rarities."""
    r = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        t = jj.Threshold(num, den)
        for _ in range(400):
            n = int(r.integers(2, 300))
            s = np.unique(r.integers(0, 1 << 63, n, dtype="u8"))
            gone = int(r.integers(0, max(1, n * (den - num) // den) + 1))
            other = np.unique(np.concatenate([s[gone:], r.integers(0, 1 << 63, int(r.integers(0, 3)), dtype="u8")]))
            common = len(np.intersect1d(s, other))
            if 0 < common < max(len(s), len(other)) and t.reached(common, len(s) + len(other)):
                rarity = lambda h: (int(h) * 2654435761 >> 7) % 5  # noqa: E731  any numbers do
                order = lambda h: (h > t.limit, rarity(h) if h <= t.limit else 0, h)
                first = [sorted(x.tolist(), key=order)[: t.first(len(x))] for x in (s, other)]
                assert set(first[0]) & set(first[1]) and set(first[0]) <= set(t.listed(s)[0].tolist())
                assert abs(t.level(len(s)) - t.level(len(other))) <= 1


def test_tree_finds_all():
    r, t = np.random.default_rng(6), jj.Threshold(80, 100)
    base = r.integers(0, 1 << 63, (6, 120), dtype="u8")
    sets = [np.unique(np.concatenate([base[i % 6][int(r.integers(0, 25)) :], r.integers(0, 1 << 63, int(r.integers(0, 15)), dtype="u8")])) for i in range(500)]
    tree = jj.Tree(np.stack([jj.folded(jj.point(s), jj.GROUPS) for s in sets]))
    got = {(min(i, j), max(i, j)) for x, y in jj.tree_join(tree, tree, t) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if t.reached(jj.overlap(sets[i], sets[j]), len(sets[i]) + len(sets[j]))}
    assert want <= got and len(got) < 125_000


def test_points_bound_overlaps():
    r = np.random.default_rng(8)
    pool = r.integers(0, 1 << 63, 900, dtype="u8") * np.uint64(2)
    sets = [np.unique(r.choice(pool, int(r.integers(1, 700)))) for _ in range(60)] + [pool[:0], np.arange(300, dtype="u8")]
    points = jj.Points([jj.unpacked(jj.packed(jj.point(s))) for s in sets])
    assert points.sizes.tolist() == [len(s) for s in sets] and len(points.fine) == 3
    x, y = (p.ravel() for p in np.meshgrid(np.arange(len(sets)), np.arange(len(sets)), indexing="ij"))
    true = np.array([jj.overlap(sets[i], sets[j]) if len(sets[i]) and len(sets[j]) else 0 for i, j in zip(x, y, strict=True)])
    bound = points.common(x, y)
    assert (bound >= true).all() and (bound <= np.minimum(points.sizes[x], points.sizes[y])).all()


@pytest.mark.parametrize(("rows", "hashes"), [(7, 10**9), (10**9, 900)])
def test_large_families_are_dealt(spark, rows, hashes):
    """Chunks of a family, within a level of sizes and across two, lose no link and hold few rows."""
    texts = edited(2, 150, 60, 11) + edited(1, 40, 45, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jj.jaccard_classes(docs, words=3, num=80, den=100, chunk_rows=rows, chunk_hashes=hashes).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(list(enumerate(texts)), 3, 80, 100))
    members = spark.createDataFrame([(1, i, 50 + i, 20 + i % 2, b"") for i in range(60)], "root long, node long, n long, level int, data binary")
    dealt = jj._dealt(members, 10, 10**9).collect()
    seen = {frozenset((a.node, b.node)) for a in dealt for b in dealt if a.node < b.node and tuple(a)[:5] == tuple(b)[:5]}
    assert len(seen) == 60 * 59 // 2 and len({tuple(r)[:5] for r in dealt}) > 10


def test_long_text_sets():
    text = words(400_000, 3).encode()
    whole, = jj.shingle_sets([text], 3)
    lower = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text).split()
    assert len(whole) == len({tuple(lower[i : i + 3]) for i in range(len(lower) - 2)})


def test_keep_one_and_empty(spark):
    docs = odd_documents(spark)
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    assert kept.where("text rlike '[^ \\t-\\r]'").count() == len({c for _, n, c in want if n}) + 1  # id 3 names two documents
    assert jj.jaccard_classes(no_documents(spark)).count() == 0


def test_connected(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    up = {i: i for e in edges for i in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert all(got.get(i, i) == root(i) for i in up)


def test_overlaps_of_blocks_are_those_of_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 300), dtype="u8") << np.uint64(50)) for _ in range(70)]
    want = np.array([[jj.overlap(a, b) if len(a) and len(b) else 0 for b in sets[30:]] for a in sets[:30]])
    for columns in (1 << 14, 7):
        monkeypatch.setattr(jj, "COLUMNS", columns)
        assert (jj.overlaps(sets[:30], sets[30:]) == want).all()
    assert jj.overlaps([sets[0][:0]], [sets[1][:0]]).tolist() == [[0]]
    t = jj.Threshold(80, 100)
    x, y = (p.ravel() for p in np.meshgrid(np.arange(30), np.arange(30, 70), indexing="ij"))
    assert jj.verified(x, y, sets, t).tolist() == [bool(t.reached(c, len(sets[i]) + len(sets[j]))) for i, j, c in zip(x, y, want.ravel(), strict=True)]
