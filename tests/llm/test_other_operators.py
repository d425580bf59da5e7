from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feldspar.llm import compaction, knn_tiles, line_dedup, mixing, packing, pairwise_quality, token_store
from feldspar.llm.common import WordEncoder, new_dir, read_text

from .cases import SF, documents, no_documents, odd_documents, odd_texts, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(plain, text, end):
    return [*plain.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# tokens ---------------------------------------------------------------------------------------------------------------


def test_encoder_is_exact(plain, spark):
    texts = [t for t in odd_texts() if t is not None] + [r.text for r in documents(spark).collect()]
    texts += ["A. b, c). d., 5. 6,7. é. É, 'S. x.\x1cy z.é", "<|endoftext|>. a<|startoftext|> b", "ΑΣ. Σ x́. y,́", "don't it's. 'll, 're"]
    got = WordEncoder(read_text(VOCABULARY)).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_on_random_texts(plain):
    """Seeded texts of letters, marks, spaces and special tokens in any case."""
    r = random.Random(11)
    parts = [*"aAbZzéÉßΣ19.,;:!?'\"-_|<>#%&* \n\t\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", ". ", ", ", "don't", "the ", "'S "]
    texts = ["a <|ENDOFTEXT|> b", "<|endoftext|><|EndOfText|>"] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(4000)]
    got = WordEncoder(read_text(VOCABULARY)).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (700, 3), (5000, 50_000), (3000, 1 << 31)):
        ids = r.integers(0, top, n, dtype="u8").astype("u4")
        m = token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(ids).to_bytes())
        assert (m.decode() == ids).all()
        for i in r.integers(0, max(n, 1), 20 if n else 0).tolist():
            v = int(ids[i])
            places = np.flatnonzero(ids == v)
            assert m.access(i) == v and m.count(v) == len(places) and m.rank(v, i) == int((places < i).sum())
            assert m.select(v, len(places) - 1) == places[-1]


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_token_store(spark, plain, make):
    docs, path = make(spark), new_dir(spark, "t")
    token_store.write_store(docs.repartition(3), path, VOCABULARY, end_id=1, shard_tokens=3000)
    got = sorted((tuple(r) for r in token_store.read_documents(spark, path).drop("ids").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((r.doc_id, len(x), crc(x)) for r in docs.collect() for x in (ids_of(plain, r.text, 1),)), key=str)
    ends = [s + n - 1 for _, s, n, _ in got]
    found = token_store.find_token(spark, path, 1).collect()
    assert set(ends) <= {p for r in found for p in r.places} and sum(r.n for r in found) == sum(len(r.places) for r in found)


def test_empty_store(spark):
    path = new_dir(spark, "t")
    token_store.write_store(no_documents(spark), path, VOCABULARY)
    assert token_store.read_documents(spark, path).count() == 0


# packing --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, r.choice([20, 101])) for _ in range(r.randrange(1, 400))]
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 100 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 100) * 1.2 + 1
    assert packing.best_two_fit([60, 30, 20, 20], 100) == [[60, 20, 20], [30]]
    assert packing.best_two_fit([], 9) == []


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_packing(spark, plain, make):
    docs = make(spark)
    rows = packing.pack(docs, VOCABULARY, capacity=256, end_id=0, block_pieces=500).collect()
    want = [(r.doc_id, p, k, len(x[k : k + 256]), crc(x[k : k + 256])) for r in docs.collect() for x in (ids_of(plain, r.text, 0),) for p, k in enumerate(range(0, len(x), 256))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in rows) // 256) * 1.02 + 3
    assert packing.pack(no_documents(spark), VOCABULARY).count() == 0


# mixing ---------------------------------------------------------------------------------------------------------------


def test_sainte_lague():
    r = random.Random(2)
    for _ in range(60):
        votes = [r.choice([0, r.randrange(1, 10), r.randrange(1, 10_000)]) for _ in range(r.randrange(1, 12))]
        seats = r.randrange(0, 60)
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        assert mixing.sainte_lague(votes, seats) == [sum(i == j for _, j in quotients) for i in range(len(votes))]


def capped_targets(sizes, weights, share, limit):
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * left > limit * sizes[i] * w]
        if not full:
            for i in open_:
                out[i] = weights[i] * left / w
            break
        for i in full:
            out[i] = limit * float(sizes[i])
        left -= sum(limit * sizes[i] for i in full)
        open_ = [i for i in open_ if not out[i]]
    return out


def test_targets_and_seats_of_all_sources(spark):
    r = random.Random(3)
    assert capped_targets([100, 100, 100, 0], [5, 2, 1, 5], 1.5, 2.0) == [200.0, 500 / 3, 250 / 3, 0.0]
    for sizes in ([100, 100, 100, 0], [r.choice([0, 1, 7, 7, 300, 10**6]) for _ in range(40)], [7] * 25, [5]):
        table = spark.createDataFrame(list(enumerate(sizes)), "number long, source_size long")
        got = mixing.targeted(table, (5, 2, 1), 1.5, 2.0).orderBy("number").collect()
        want = capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
        assert np.allclose([x.target for x in got], want, rtol=1e-12)
        for seats in (1, 17, 60, 1000):
            dealt = mixing.allotted(table.withColumn("votes", F.col("source_size").cast("double")), "votes", seats).orderBy("number").collect()
            assert [x.seats for x in dealt] == mixing.sainte_lague(sizes, seats)


def test_numbered(spark):
    got = mixing.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), F.col("x")).collect()
    assert sorted((r.x, r.number) for r in got) == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_mix(spark, make):
    docs = make(spark)
    rows = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect()), key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(x for x in by if x is not None) + [None] * (None in by)
    sizes = [sum(r.size for r in by[s]) for s in names]
    targets = capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for s, size, target in zip(names, sizes, targets, strict=True):
        assert {r.source_size for r in by[s]} == {size} and all(abs(r.target - target) < 1e-6 for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= 64 + 32 * len({r.shard for r in by[s]})
        assert all(0 <= r.taken <= 2 * r.size for r in by[s])
        assert all(r.part == sum(x.n for x in r.runs) and all(0 <= x.begin and x.begin + x.n <= r.size for x in r.runs) for r in by[s])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(no_documents(spark)).count() == 0


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_mixed_documents(spark, make):
    docs = make(spark)
    plan, out = mixing.mix(docs).collect(), mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken, words_out = defaultdict(int), defaultdict(int)
    for r in plan:
        taken[r.doc_id] += r.taken
    for r in out.collect():
        words_out[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words_out.items() if v}


@pytest.mark.parametrize("with_large", [True, False])
def test_mix_keeps_small_sources(spark, with_large):
    rows = [(i, words(1 + i % 9, i), f"tiny{i:02}") for i in range(30)] + [(100 + i, words(400, i), "large") for i in range(10 * with_large)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert len(by) == 30 + with_large
    for r in by:
        assert 0 < r.taken <= 2 * r.size and abs(r.taken - r.target) <= (96 if r.source == "large" else 1)


# neighbours -----------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(420, 24)).astype("f4")
    x[100:180] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * 24), (503, [None] + [1.0] * 23), (504, [float("nan")] * 24), (505, [float("inf")] * 24), (520, [1.0, 2.0]), (540, [2.0, -1.0]), (None, [1.0] * 24), (9, [float(c) for c in x[9]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for q in knn_tiles.nearest(df, F.col("vec_id") % 20 == 0, k=20, query_block=8, candidate_block=100).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    exact = x.astype("f8") @ x.astype("f8").T
    for q in range(0, 420, 20):
        order = sorted((i for i in range(420) if i != q), key=lambda i: (-float(np.cumsum(x[q].astype("f8") * x[i])[-1]), i))[:20]
        assert [v for _, v, _ in got[q]] == order and [k for k, _, _ in got[q]] == list(range(1, 21))
        assert np.allclose([s for _, _, s in got[q]], exact[q, order], rtol=0, atol=1e-12)
    assert got[520] == [(1, 540, 0.0)] and got[540] == [(1, 520, 0.0)] and 500 not in got
    assert knn_tiles.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_repeated_rows(spark):
    # copies of one row take one of the k + 1 places of its group of equal vectors, on either side
    rows = [(5, [1.0, 1.0])] * 30 + [(6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [0.5, 1.0])] + [(3, [2.0, 2.0])] * 25 + [(9, [2.0, 2.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for q in knn_tiles.nearest(df, F.col("vec_id").isin(3, 20), k=4).orderBy("query_id", "rank").collect():
        found[q.query_id].append((q.rank, q.vec_id, q.score))
    assert found == {3: [(1, 9, 8.0), (2, 5, 4.0), (3, 6, 4.0), (4, 7, 4.0)], 20: [(1, 3, 2.0), (2, 9, 2.0), (3, 5, 1.0), (4, 6, 1.0)]}


def test_nearest_extreme_magnitudes(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1.0]), (2, [1e160, 1.0]), (3, [1.0, 1.0]), (4, [5e-324, 0.0]), (5, [1e-310, 1e-310]), (6, [-1e308, 1e308]), (7, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(q.vec_id, q.score) for q in knn_tiles.nearest(df, F.col("vec_id") == 0, k=20).orderBy("rank").collect()]
    assert got == [(7, 1e308), (1, 1e200), (2, 1e160), (3, 1.0), (5, 1e-310), (4, 5e-324), (6, -1e308)]
    tiny = [(q.vec_id, q.score) for q in knn_tiles.nearest(df, F.col("vec_id") == 5, k=2).orderBy("rank").collect()]
    assert [v for v, _ in tiny] == [7, 1]


# compaction -----------------------------------------------------------------------------------------------------------


def test_compaction(spark):
    docs, root = documents(spark), new_dir(spark, "s")
    store = compaction.ShardStore(spark, root, target_bytes=400_000, fanout=3, smallest=20_000)
    for i in range(6):
        store.append(docs.where(f"doc_id % 6 = {i}").repartition(3))
    before = store.manifest()
    store.compact()
    after = store.manifest()
    assert len(after["shards"]) < len(before["shards"]) == 18 and after["version"] > before["version"] == 6
    back = store.read()
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert back.select("shard_id", "row_in_shard").distinct().count() == docs.count()
    assert store.read(1).count() == docs.where("doc_id % 6 = 0").count()
    with pytest.raises(compaction.CommitConflict):
        store.commit(3, "x", [])
    assert not store.vacuum() and store.vacuum(grace_seconds=0) and store.read().count() == docs.count()
    assert store.versions() == [after["version"]]


def test_compaction_beside_another_writer(spark, monkeypatch):
    docs, root = documents(spark), new_dir(spark, "s")
    one, other = (compaction.ShardStore(spark, root, target_bytes=400_000, fanout=2, smallest=20_000) for _ in range(2))
    for i in range(4):
        one.append(docs.where(f"doc_id % 4 = {i}").coalesce(1))
    write = one._write

    def slowly(*a):
        out = write(*a)
        other.compact()  # commits first
        return out

    monkeypatch.setattr(one, "_write", slowly)
    with pytest.raises(compaction.CommitConflict):
        one.compact()
    assert sorted(r.doc_id for r in one.read().collect()) == sorted(r.doc_id for r in docs.collect())


def test_compaction_odd_rows(spark):
    store = compaction.ShardStore(spark, new_dir(spark, "s"))
    assert store.read().count() == 0
    store.append(no_documents(spark))
    assert store.read().count() == 0
    store.append(odd_documents(spark))
    assert sorted(map(str, store.read().drop("shard_id", "row_in_shard").collect())) == sorted(map(str, odd_documents(spark).collect()))


def test_compaction_of_one_large_task(spark):
    docs, target = documents(spark), 100_000
    store = compaction.ShardStore(spark, new_dir(spark, "s"), target_bytes=target, fanout=4, smallest=5_000)
    store.append(docs.coalesce(1))
    before = store.manifest()["shards"]
    store.compact()
    after = store.manifest()["shards"]
    assert store.manifest()["version"] > 1 and 1 < len(after) < len(before)
    assert sorted(s.size for s in before)[len(before) // 2] < target / 2 and max(s.size for s in after) < 1.5 * target
    assert sorted(map(str, store.read().select(docs.columns).collect())) == sorted(map(str, docs.collect()))


# lines ----------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    """doc_id, kept text, lines, dropped lines of (doc_id, text) rows, by the tree of the module's docstring on real tokens."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    wholes, shorts, nodes = defaultdict(list), defaultdict(list), defaultdict(list)

    def fields(w):
        n = len(w)
        return [tuple(w[f * n // 8 : (f + 1) * n // 8]) for f in range(8)]

    for doc in docs:
        for k, line in enumerate(doc[1].split("\n")):
            plain = WORD.findall(line)
            w = ["<*>" if re.search("[0-9]", x) else x for x in plain]
            w = plain if 2 * w.count("<*>") > len(w) else w
            n, h = len(w), (len(w) + 3) // 2
            if n < 5:
                if any(c.isalpha() for c in line):
                    shorts[tuple(plain)].append((doc, k))
                continue
            wholes[tuple(w)].append((doc, k))
            for node in [("^", n, *w[:3])] * (n >= 8) + [("<", n, *w[:h]), ("<<", n, *w[: 3 * n // 4]), (">", n, *w[:3], "|", *w[h:])] * (n >= 14):
                nodes[node].append((doc, k, n, fields(w)))
    gone = set()
    for by, least in ((wholes, 2), (shorts, 10)):
        for held in by.values():
            if len({d for d, _ in held}) >= least:
                gone |= {(d, k) for d, k in held if d != held[0][0]}
    for held in nodes.values():
        first, _, n, g = held[0]
        taken, mask = [], -1
        for d, k, _, f in held:
            same = [i for i in range(8) if f[i] == g[i] and f[i] not in ((), ("<*>",))]
            constant = [i for i in range(8) if f[i] and not (f[i] == g[i] == ("<*>",))]
            if d != first and len(same) >= 0.7 * len(constant):
                taken.append((d, k))
                mask &= sum(1 << i for i in same)
        if (n >= 14 or len({d for d, _ in taken}) > 1) and (mask & 0xFF).bit_count() >= 0.5 * 8:
            gone |= set(taken)
    out = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for k, x in enumerate(lines) if ((d, t), k) not in gone]
        out.append((d, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


COUNTS = ("all", "dropped")


def test_line_dedup(spark):
    docs = documents(spark)
    shared = [(1000 + i, f"intro {words(9, i)}\nPosted on 2024-01-0{i} by user{i} in forum 7\nbye", "en", "s", 3) for i in range(5)]
    both = docs.unionByName(spark.createDataFrame(shared, docs.schema))
    got = line_dedup.drop_recurring(both, counts=COUNTS)
    assert sorted((r.doc_id, r.text, r["all"], r.dropped) for r in got.collect()) == sorted(brute_lines([(r.doc_id, r.text) for r in both.collect()]))
    assert [r.text.count("Posted") for r in got.where("doc_id >= 1000").orderBy("doc_id").collect()] == [1, 0, 0, 0, 0]


def test_line_dedup_odd(spark):
    docs = odd_documents(spark).where("doc_id IS NOT NULL AND NOT (doc_id = 3 AND lang = 'fr')")
    got = line_dedup.drop_recurring(docs, counts=COUNTS)
    assert got.columns == [*docs.columns, *COUNTS]
    assert sorted(((r.doc_id, r.text, r["all"], r.dropped) for r in got.collect()), key=str) == sorted(brute_lines([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert line_dedup.drop_recurring(odd_documents(spark)).count() == odd_documents(spark).count()
    assert line_dedup.drop_recurring(no_documents(spark)).count() == 0
    assert line_dedup.drop_recurring(docs, drop_emptied=True, counts=COUNTS).where("dropped > 0 AND trim(text) = ''").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["row", "gone", "lines", "line", "doc", "i", "n", "__row", "__gone", "__n_lines"]
    rows = [(i, "the same line of seven words here\nown " + words(9, i), *(f"{c}{i}" for c in names)) for i in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = line_dedup.drop_recurring(docs).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == [r[2:] for r in rows] and [r.text.count("same") for r in got] == [1, 0, 0]
    with pytest.raises(ValueError):
        line_dedup.drop_recurring(docs, counts=("row", "x"))


def test_line_dedup_short_lines(spark):
    rows = [(i, f"{words(9, i)}\nAll  rights reserved.\n\n}}\n7\nPage {i}\nrare {i // 9}\nAll rights reserved.") for i in range(12)]
    got = line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got.collect():
        own = rows[r.doc_id][1].split("\n")
        assert r.text.split("\n") == (own if r.doc_id == 0 else own[:1] + own[2:-1])  # nine documents are too few for 'rare 0'


def test_line_dedup_constant_text(spark):
    figures = ["1 2 3 4 5", "7 8 9 10 11", "12 of 13 14 15"]  # hardly any constant text: only equal rows recur
    head, tail = words(8, 71).replace("12", "of"), words(6, 72).replace("12", "of")
    left = [f"{head} {' '.join([x] * 6)}" for x in ("red", "blue")]
    right = [f"{' '.join(tail.split()[:3])} {' '.join([x] * 5)} {tail}" for x in ("red", "blue")]
    near = [" ".join((head + " " + tail).split()[:-1] + [x]) for x in ("one", "two")]
    texts = [[figures[0], left[0], right[0], near[0]], [figures[1], left[1], right[1], near[1]], [figures[0], figures[2], figures[1] + " "]]
    got = line_dedup.drop_recurring(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert [r.text.split("\n") for r in got.orderBy("doc_id").collect()] == [texts[0], texts[1][:-1], texts[2][1:2]]


def test_line_dedup_half_alike(spark):
    """Lines that share a half, and nothing else, stay."""
    half = "one two three four five six seven eight"
    texts = [f"{half} alpha beta gamma delta epsilon zeta", f"{half} red green blue black white brown"]
    got = line_dedup.drop_recurring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.text for r in got.orderBy("doc_id").collect()] == texts


def test_line_dedup_learns_fields(spark):
    """Fields without digits become variable by the lines that differ there; a template of two documents is too few for short lines."""
    log = [f"Posted on board by {who} about {what} matters here today" for who, what in (("ann", "garden"), ("bob", "house"), ("eve", "city"))]
    pair = [f"She looked at the {x} door and went away quietly" for x in ("red", "blue")]
    texts = [f"{words(9, i)}\n{log[i]}" + (f"\n{pair[i]}" if i < 2 else "") for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in line_dedup.drop_recurring(docs).orderBy("doc_id").collect()]
    assert [("Posted" in x, "door" in x) for x in got] == [(True, True), (False, True), (False, False)]
    assert [tuple(r) for r in line_dedup.templates(docs).collect()] == [(0, 1, 10, 6, 2)]


def test_line_dedup_many_templates_a_node(spark):
    """A node learns as many templates as its lines need, whatever its first line is."""
    kinds = [
        ("Posted on board seven of the old house by nobody", 1), ("Posted on board by {} about garden matters here today", 4), ("Posted on board {} red green blue black white brown", 3),
        ("Posted on board one two three four five six {}", 1), ("Posted on board by fox {} about city matters here", 5),
    ]
    texts = [f"{kind.format(who)}\nown {words(8, 10 * k + j)}" for k, (kind, n) in enumerate(kinds) for j, who in enumerate(["ann", "bob", "eve", "joe", "kim"][:n])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text.count("Posted") for r in line_dedup.drop_recurring(docs).orderBy("doc_id").collect()]
    assert got == [1] + [1, 0, 0, 0] + [1, 0, 0] + [1] + [1, 0, 0, 0, 0]
    assert sorted((r.doc_id, r.n_lines) for r in line_dedup.templates(docs).collect()) == [(1, 3), (5, 2), (9, 4)]


def templates_one_by_one(rows, variable):
    """(doc, line): whether its template is the node's first, and where that starts; of (doc, line, fields) rows at one node."""
    seeds, out = [], {}
    for i, line, s in sorted(rows):
        for number, (j, k, x) in enumerate(seeds):
            both = sum(a == b == v for a, b, v in zip(s, x, variable, strict=True))
            if i != j and sum(a == b for a, b in zip(s, x, strict=True)) - both >= 0.7 * (8 - both):
                out[i, line] = (number == 0, j, k)
                break
        else:
            seeds.append((i, line, s))
    return out


def test_line_dedup_templates_in_order(spark):
    """Random fields, many alike and some variable, with chains and with documents that repeat themselves, against one line after the other."""
    r = random.Random(5)
    word = spark.range(1).select(line_dedup._word(lambda f: line_dedup._byte(F.array(F.lit(line_dedup.VARIABLE)), f))).first()[0]
    variable = (word % (1 << 64)).to_bytes(8, "little")
    for few in (True, False):
        bases, rows = [[r.randrange(6) if r.random() < 0.75 else variable[f] for f in range(8)] for _ in range(3 if few else 40)], []
        for i in range(150):
            for line in range(r.randrange(1, 5)):
                s = list(r.choice(bases))
                for _ in range(r.randrange(5 if few else 3)):
                    f = r.randrange(8)
                    s[f] = r.choice([variable[f], *range(12)])
                rows.append((i, line, bytes(s)))
        held = [(i, 1000 - i, line, 8, int.from_bytes(s, "little", signed=True), 7, *[None] * 3) for i, line, s in rows]
        lines = spark.createDataFrame(held, "i long, row long, line int, n int, s long, leaf long, left long, most long, right long")
        got = [((x.i, x.line), (x.node == 7, x.seed.i, x.seed.line)) for x in line_dedup._taken(lines)[0].withColumn("i", 1000 - F.col("row")).collect()]
        assert len(got) == len(dict(got)) and dict(got) == templates_one_by_one(rows, variable)
        assert sum(not first for _, (first, _, _) in got) > 100


# classifier -----------------------------------------------------------------------------------------------------------


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = pairwise_quality.train(docs, labels, max_labels=1000)
    rows = {r.doc_id: r for r in pairwise_quality.score(docs, model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    # labels of held-out rows make no difference
    flipped = labels.withColumn("quality", F.when(pairwise_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert pairwise_quality.train(docs, flipped, max_labels=1000) == model


def test_classifier_odd(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (8, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    assert pairwise_quality.score(docs, pairwise_quality.train(docs, labels)).count() == docs.count()
    none = pairwise_quality.train(docs, labels.limit(0))
    assert pairwise_quality.score(docs, none).where("predicted = 1").count() == docs.count()
    assert pairwise_quality.score(no_documents(spark), none).count() == 0
