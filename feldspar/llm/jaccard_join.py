"""N-gram Jaccard join: a count-vector R-tree over sets of word shingles.

A document's set holds the 64-bit hashes of its distinct k-word shingles (ASCII letters lower-cased). Equal sets are one
class. The hashes fall into groups; a class is the point of its counts by group, and the sum of coordinate minima of two
points, or of the upper corners of two boxes of points, bounds how much their sets overlap. R-trees of such points are
joined with themselves, pairs of nodes that can't reach the threshold are cut, and pairs of points that survive are
verified on the sets.

A tree's top boxes overlap, so points are first dealt out to trees, without loss: of two sets that reach the threshold
t, in any one order of all hashes, the first n - ceil(t n) + 1 hashes of each (n: its size) hold a common one. The order
taken puts rare hashes first: those below a limit come by the binary logarithm of the number of documents that hold them,
then by value; the others follow by value, so that a set's first hashes are among those below the limit (or among its
least ones, if these are too few) and only they are counted. Passages that many documents share, which would connect all
of them, so come last. Hashes that no other set holds are never keys, and a set with enough of them has none. Classes
connected by keys are a family. A small family is one tree and one task. A larger one is dealt by levels of size, such
that partners are of one level or of two that follow each other, and a level by chunks: each chunk is joined with itself,
with the others of its level and with those of the next, each pair of chunks as a task, whatever their number.

A point has about as many groups as its set has hashes (a power of two), so that the bound stays sharp for large sets;
a tree's boxes, and first of all the points themselves, are compared by their counts in GROUPS coarse groups. Pairs that
pass leave the close families, whose texts alone are read again and verified.

Components follow from the verified pairs; a pair whose ends are connected already isn't verified again.

Edge cases: null and empty texts have an empty set and are linked with nothing; a text with fewer than k words is one
shingle; null ids never are a component's id (a component of null ids only has a null one); rows with equal ids are
documents of their own; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feldspar.llm.common import SPACE, SPACE_CHARS, new_dir, remove, scratch, written
from feldspar.llm.components import connected

GROUPS, LEAF, FANOUT = 64, 64, 8
#: Hashes below the limit are about this many times as many as keys are needed.
SPREAD = 2
#: Rows and hashes of a chunk; the chunks of a level before chunks grow instead, and the rows that they grow to.
CHUNK_ROWS, CHUNK_HASHES, CHUNKS, MOST_ROWS = 1024, 4_000_000, 16, 16_384
SEGMENT, COLUMNS, U64 = 1 << 20, 1 << 14, np.uint64
_random = np.random.default_rng(20240229)
_BYTES = _random.integers(0, 1 << 63, 256, dtype="u8") * U64(2) + U64(1)
_BYTES[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True
_ODD = _random.integers(0, 1 << 62, 64, dtype="u8") * U64(2) + U64(1)
_BASE = int(_ODD[0])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, "u8")
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in a run of bytes."""
    blank = _IS_SPACE[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype("i1"))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_BYTES[data] * power[: len(data)])])
    return starts, mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype("u8") * _ODD[1])


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of ``texts`` in order, in runs of about SEGMENT bytes, each with the texts' numbers."""
    held, numbers, size = [], [], 0

    def run() -> tuple[np.ndarray, np.ndarray]:
        starts, hashes = _hash_words(np.frombuffer(b" ".join(held), "u1"))
        begin = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
        return hashes, np.asarray(numbers)[np.searchsorted(begin, starts, "right") - 1]

    for number, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = len(text)
            if end - at > SEGMENT and (found := _SPACE.search(text, at + SEGMENT)):
                end = found.start() + 1
            held.append(text[at:end])
            numbers.append(number)
            size += end - at
            if size >= SEGMENT:
                yield run()
                held, numbers, size = [], [], 0
            at = end
            if not text:
                break
    if held:
        yield run()


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles."""
    texts = [t or b"" for t in texts]
    out: list[np.ndarray] = []
    pieces: dict[int, list[np.ndarray]] = {}

    def close(before: int) -> None:
        while len(out) < before:
            parts = pieces.pop(len(out), [])
            w = np.concatenate(parts) if parts else np.zeros(0, "u8")
            if 0 < len(w) < k:
                s = np.add.reduce(w * _ODD[2 : 2 + len(w)], keepdims=True) + U64(len(w))
            else:
                n = max(0, len(w) - k + 1)
                s = np.zeros(n, "u8")
                for i in range(k if n else 0):
                    s += w[i : i + n] * _ODD[20 + i]
            out.append(np.unique(mixed(s)))

    for hashes, numbers in _segments(texts):
        if len(numbers):
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for part, at in zip(np.split(hashes, cuts), numbers[np.concatenate([[0], cuts])].tolist(), strict=True):
                pieces.setdefault(at, []).append(part)
            close(int(numbers[-1]))
    close(len(texts))
    return out


class Threshold:
    """Jaccard similarity of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.limit = min((1 << 64) - 1, (SPREAD * (den - num) << 64) // den)  # of the hashes that come by their frequency
        self.starts = [1]  # the least size of each level: a partner is at most den/num times as large, so one level on
        while self.starts[-1] < 1 << 40:
            self.starts.append(self.starts[-1] * den // num + 1)

    def reached(self, common, total):
        """``total``: the sizes' sum."""
        return common * (self.num + self.den) >= self.num * total

    def level(self, n: int) -> int:
        """Sets that reach the threshold are of one level, or of two that follow each other."""
        return int(np.searchsorted(self.starts, n, "right"))

    def first(self, n: int) -> int:
        """How many first hashes of a set of ``n`` are keys: any two sets that reach the threshold and aren't equal share one."""
        if n * self.den < self.num * (n + 1) and (n - 1) * self.den < self.num * n:
            return 0  # equal sets alone reach
        return n - -(-self.num * n // self.den) + 1

    def listed(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The hashes of a sorted set among which its keys are, and how many of them lie below the limit."""
        p = self.first(len(s))
        low = int(np.searchsorted(s, U64(self.limit), "right")) if p else 0
        return s[: max(low, p)], low


def point(s: np.ndarray) -> np.ndarray:
    """A set's counts by group, in as many groups as the largest power of two that isn't over its size, GROUPS at least."""
    bits = max(GROUPS.bit_length(), len(s).bit_length()) - 1
    counts = np.bincount((s >> U64(64 - bits)).astype("i8"), minlength=1 << bits)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """Points (or one point) by fewer groups."""
    return p.reshape(*p.shape[:-1], groups, -1).sum(axis=-1, dtype="i4")


def packed(p: np.ndarray) -> bytes:
    return p.dtype.str[-1:].encode() + p.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[:1] == b"4" else "u1", offset=1)


class Points:
    """Points of any number of groups, and their coarse counts."""

    def __init__(self, points: list[np.ndarray]):
        self.coarse = np.stack([folded(p, GROUPS) for p in points])
        self.sizes = self.coarse.sum(axis=1, dtype="i8")
        self.groups = np.array([len(p) for p in points])
        self.place, self.fine = np.zeros(len(points), "i8"), {}
        for g in np.unique(self.groups).tolist():
            at = np.flatnonzero(self.groups == g)
            self.place[at], self.fine[g] = np.arange(len(at)), np.stack([points[i] for i in at])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bound of the overlap of each pair: the sum of minima, by the groups of the coarser one."""
        out = np.zeros(len(x), "i8")
        pairs = np.stack([self.groups[x], self.groups[y]], axis=1)
        for gx, gy in np.unique(pairs, axis=0).tolist():
            at, g = np.flatnonzero((pairs[:, 0] == gx) & (pairs[:, 1] == gy)), min(gx, gy)
            step = max(1, (1 << 24) // max(gx, gy))
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                a, b = self.fine[gx][self.place[x[part]]], self.fine[gy][self.place[y[part]]]
                out[part] = np.minimum(a if gx == g else folded(a, g), b if gy == g else folded(b, g)).sum(axis=1, dtype="i8")
        return out


class Tree:
    """An R-tree of count vectors: boxes by their upper corners and their least and largest set sizes."""

    def __init__(self, points: np.ndarray):
        self.sizes, self.points = points.sum(axis=1, dtype="i8"), points
        order: list[np.ndarray] = []
        todo = [np.argsort(self.sizes, kind="stable")]
        while todo:  # halves along the coordinate of largest spread
            at = todo.pop()
            if len(at) <= LEAF:
                order.append(at)
                continue
            p = self.points[at]
            by = np.argsort(p[:, np.argmax(p.max(axis=0) - p.min(axis=0))], kind="stable")
            half = -(-len(at) // (2 * LEAF)) * LEAF
            todo += [at[by[half:]], at[by[:half]]]
        self.leaves = order
        self.levels = [self._boxes(self.points, self.sizes, self.sizes, order)]
        while len(self.levels[-1][0]) > 1:
            upper, low, high = self.levels[-1]
            self.levels.append(self._boxes(upper, low, high, [np.arange(i, min(i + FANOUT, len(low))) for i in range(0, len(low), FANOUT)]))

    @staticmethod
    def _boxes(upper, low, high, members):
        return np.stack([upper[m].max(axis=0) for m in members]), np.array([low[m].min() for m in members]), np.array([high[m].max() for m in members])


def tree_join(a: Tree, b: Tree, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of pairs (place in a, place in b) that may reach ``t``; with ``a is b``, each pair once."""
    top = lambda x: np.arange(len(x.levels[-1][0]))
    stack = [(len(a.levels) - 1, len(b.levels) - 1, int(i), int(j)) for i in top(a) for j in top(b)]
    while stack:
        la, lb, i, j = stack.pop()
        if la == lb == 0:
            rows, cols = a.leaves[i], b.leaves[j]
            na, nb = a.sizes[rows][:, None], b.sizes[cols][None, :]
            common = np.minimum(a.points[rows][:, None, :], b.points[cols][None, :, :]).sum(axis=2)
            fits = t.reached(common, na + nb) & t.reached(np.minimum(na, nb), na + nb)
            if a is b and i == j:
                fits &= np.arange(len(rows))[:, None] < np.arange(len(cols))[None, :]
            x, y = np.nonzero(fits)
            if len(x):
                yield rows[x], cols[y]
            continue
        down_a, down_b = la >= lb, lb >= la
        ia = np.arange(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][0]))) if down_a else np.array([i])
        ib = np.arange(j * FANOUT, min((j + 1) * FANOUT, len(b.levels[lb - 1][0]))) if down_b else np.array([j])
        la, lb = la - down_a, lb - down_b
        (ua, lowa, higha), (ub, lowb, highb) = a.levels[la], b.levels[lb]
        common = np.minimum(ua[ia][:, None, :], ub[ib][None, :, :]).sum(axis=2)
        total = lowa[ia][:, None] + lowb[ib][None, :]
        smaller = np.minimum(higha[ia][:, None], highb[ib][None, :])
        larger = np.maximum(lowa[ia][:, None], lowb[ib][None, :])
        fits = t.reached(common, total) & (smaller * t.den >= t.num * larger)
        if a is b and la == lb:
            fits &= ia[:, None] <= ib[None, :]
        stack += [(int(la), int(lb), int(ia[x]), int(ib[y])) for x, y in zip(*np.nonzero(fits), strict=True)]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of each of ``left`` with each of ``right`` (sorted distinct arrays), by products of 0/1 blocks."""
    both = np.sort(np.concatenate([_distinct(np.concatenate(left)), _distinct(np.concatenate(right))]))
    shared = both[:-1][both[1:] == both[:-1]]
    out = np.zeros((len(left), len(right)), "i8")
    if not len(shared):
        return out
    sides = []
    for sets in (left, right):
        x, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
        hit = np.flatnonzero(shared[at] == x)
        sides.append((len(sets), row[hit], at[hit]))
    for start in range(0, len(shared), COLUMNS):
        blocks = []
        for n, row, at in sides:
            block = np.zeros((n, min(COLUMNS, len(shared) - start)), "f4")
            here = np.flatnonzero((at >= start) & (at < start + COLUMNS))
            block[row[here], at[here] - start] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype("i8")
    return out


def verified(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], t: Threshold) -> np.ndarray:
    """Which pairs (x, y) of places in ``sets`` reach ``t``; all pairs of two leaves at once where they are many."""
    if len(x) < LEAF:
        return np.array([t.reached(overlap(sets[i], sets[j]), len(sets[i]) + len(sets[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
    (rows, at_x), (cols, at_y) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
    left, right = [sets[i] for i in rows], [sets[j] for j in cols]
    total = np.array([len(s) for s in left])[at_x] + np.array([len(s) for s in right])[at_y]
    return t.reached(overlaps(left, right)[at_x, at_y], total)


def family_links(nodes: np.ndarray, points: list[np.ndarray], sets: list[np.ndarray] | None, side: np.ndarray | None, t: Threshold) -> list[tuple[int, int]]:
    """Pairs that connect all that pairs which reach ``t`` connect, verified if ``sets`` are given, else by their points' bound.

    ``side``: False and True for two chunks, None for one.
    """
    first, second = (np.arange(len(nodes)),) * 2 if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    if not len(first) or not len(second):
        return []
    p = Points(points)
    a = Tree(p.coarse[first])
    b = a if side is None else Tree(p.coarse[second])
    up, links = np.arange(len(nodes)), []

    def tops(x: np.ndarray) -> np.ndarray:
        while (up[x] != x).any():
            x = up[x]
        return x

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    for x, y in tree_join(a, b, t):
        x, y = first[x], second[y]
        apart = np.flatnonzero(tops(x) != tops(y))
        x, y = x[apart], y[apart]
        fits = np.flatnonzero(t.reached(p.common(x, y), p.sizes[x] + p.sizes[y]))
        x, y = x[fits], y[fits]
        if sets is not None and len(x):
            fits = verified(x, y, sets, t)
            x, y = x[fits], y[fits]
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            k, m = root(i), root(j)
            if k != m:
                up[max(k, m)] = min(k, m)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view("i8")


def _with_roots(labels: DataFrame) -> DataFrame:
    """node, root: roots, too, have a row."""
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())


def _dealt(members: DataFrame, chunk_rows: int, chunk_hashes: int) -> DataFrame:
    """``members`` (root, node, n, level, data), each for every task (root, at, cross, i, j) that it takes part in, with its side.

    A family of at most ``chunk_rows`` rows and ``chunk_hashes`` hashes is one task. Of larger ones, task (at, 0, i, j)
    joins chunks i and j of level ``at``, and task (at, 1, i, j) joins its chunk i with chunk j of the next level.
    """
    cells = members.groupBy("root", "level").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes"))
    many = F.ceil(F.col("rows") / chunk_rows)
    chunks = F.greatest(F.when(many <= CHUNKS, many).otherwise(F.greatest(F.lit(CHUNKS), F.ceil(F.col("rows") / (chunk_rows * (MOST_ROWS // CHUNK_ROWS))))), F.ceil(F.col("hashes") / chunk_hashes)).cast("int")
    by_root = cells.groupBy("root").agg(F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes"), F.map_from_entries(F.collect_list(F.struct("level", chunks))).alias("chunks"))  # an entry a level
    large = by_root.where((F.col("rows") > chunk_rows) | (F.col("hashes") > chunk_hashes)).select("root", "chunks")
    of = members.join(large, "root", "left")
    here, above, below = (F.col("chunks").getItem((F.col("level") + d).cast("int")) for d in (0, 1, -1))
    of = of.withColumn("chunk", F.pmod(F.xxhash64("node"), here).cast("int"))
    task = lambda at, cross, i, j, side: F.struct(at.cast("int").alias("at"), F.lit(cross).alias("cross"), i.alias("i"), j.alias("j"), side.alias("side"))
    each = lambda n, make: F.when(n.isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), n - 1), make))
    c, level, zero = F.col("chunk"), F.col("level"), F.lit(0)
    parts = F.concat(
        each(here, lambda o: task(level, 0, F.least(c, o), F.greatest(c, o), c > o)),
        each(above, lambda o: task(level, 1, c, o, F.lit(False))),
        each(below, lambda o: task(level - 1, 1, o, c, F.lit(True))),
    )
    tasks = F.when(F.col("chunks").isNull(), F.array(task(F.lit(-1), 0, zero, zero, F.lit(False)))).otherwise(parts)
    return of.select("root", "node", "data", F.explode(tasks).alias("task")).select("root", "task.*", "node", "data")


def _family_tasks(members: DataFrame, read: Callable, t: Threshold, chunk_rows: int, chunk_hashes: int) -> DataFrame:
    """a, b: family_links of each family of ``members`` (root, node, n, level, data); ``read`` makes points and sets of data."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, points, sets, side = None, [], [], [], []

        def links() -> pa.RecordBatch:
            alone = not now[2] and now[3] == now[4]
            found = family_links(np.array(nodes), points, sets or None, None if alone else np.array(side), t)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                keys = list(zip(*(part.column(x).to_pylist() for x in ("root", "at", "cross", "i", "j")), strict=True))
                own, sides = part.column("node").to_pylist(), part.column("side").to_pylist()
                new_points, new_sets = read(part.column("data").to_pylist())
                for k, key in enumerate(keys):
                    if key != now:
                        if now and len(nodes) > 1:
                            yield links()
                        now, nodes, points, sets, side = key, [], [], [], []
                    nodes.append(own[k])
                    points.append(new_points[k])
                    side.append(sides[k])
                    if new_sets is not None:
                        sets.append(new_sets[k])
        if now and len(nodes) > 1:
            yield links()

    by = ("root", "at", "cross", "i", "j")
    return _dealt(members, chunk_rows, chunk_hashes).repartition(*by).sortWithinPartitions(*by).mapInArrow(linked, "a long, b long")


def jaccard_classes(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, chunk_rows: int = CHUNK_ROWS, chunk_hashes: int = CHUNK_HASHES, passes: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (of equal sets), component_id, row (its hash) and keeper (the row hash of the one to keep), for each row of ``docs``.

    Two documents link when den * intersection >= num * union. ``chunk_rows`` and ``chunk_hashes`` bound what one side of
    a family task holds (a single larger set is a chunk of its own); keys are shuffled in ``passes`` ranges.
    """
    path = new_dir(docs.sparkSession, "jaccard")
    with scratch(docs.sparkSession):
        return written(_classes(docs, words, Threshold(num, den), chunk_rows, chunk_hashes, passes, id_col, text_col), path)


def _classes(docs: DataFrame, words: int, t: Threshold, chunk_rows: int, chunk_hashes: int, passes: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    row = F.xxhash64("id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                sums = [(np.add.reduce(s, dtype="u8"), np.add.reduce(mixed(s + _ODD[50]), dtype="u8")) for s in sets]
                prints = mixed(np.array(sums, "u8").reshape(-1, 2) + np.array([[len(s)] for s in sets], "u8"))
                keys, low = zip(*(t.listed(s) for s in sets), strict=True)
                keys = [_signed(x) for x in keys]
                ends = np.cumsum([0, *map(len, keys)])
                listed = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())).cast(pa.list_(pa.int64()))
                sizes = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row"), pa.array(sizes, pa.int64()), pa.array([t.level(n) for n in sizes], pa.int32()), pa.array(_signed(prints[:, 0].copy())), pa.array(_signed(prints[:, 1].copy())), pa.array([packed(point(s)) for s in sets], pa.binary()), listed, pa.array(low, pa.int32()), pa.array([t.first(n) for n in sizes], pa.int32())],
                    names=["id", "row", "n", "level", "f1", "f2", "point", "keys", "low", "first"],
                )

    keyed_path = new_dir(spark, "shingles")
    with_keys = written(rows.withColumn("row", row).mapInArrow(hashed, "id long, row long, n long, level int, f1 long, f2 long, point binary, keys array<bigint>, low int, first int"), keyed_path)
    # one row a class; node: the class's 64-bit print
    classes = with_keys.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("smallest"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "row"))["row"].alias("row"), F.first("n").alias("n"), F.first("level").alias("level"), F.min("point").alias("point"))
    classes_path = new_dir(spark, "classes")
    classes = written(classes.withColumnRenamed("f1", "node"), classes_path)
    # documents of one class have the same node and keys, which the aggregation before the shuffle folds; ranges of keys
    # go one after the other, so that a range's shuffles bound the disk; the join is a merge of two tables at every size,
    # so that Spark may split a skewed side
    shared = []
    for p in range(passes):
        of_range = F.filter(F.transform("keys", lambda x, i: F.struct(x.alias("key"), i.alias("at"))), lambda x: F.pmod(x["key"], F.lit(passes)) == F.lit(p))
        keyed = with_keys.select(F.col("f1").alias("node"), "low", "first", F.explode(of_range if passes > 1 else F.transform("keys", lambda x, i: F.struct(x.alias("key"), i.alias("at")))).alias("k")).select("node", "low", "first", "k.*")
        path = new_dir(spark, "counted-keys")
        counted = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("documents")).where("least <> most")
        counted = written(counted.select("key", "least", F.floor(F.log2("documents")).alias("rarity")), path)
        shared.append(written(keyed.join(counted.hint("merge"), "key").distinct(), new_dir(spark, "shared-keys")))
        remove(spark, path)
    sets = written(with_keys.select("id", "row", "n", "f1"), new_dir(spark, "sets"))
    remove(spark, keyed_path)  # the keys are most of this operator's disk, and nothing below reads them
    # the place of a shared hash among its set's hashes in the common order: those that it shares with no set come first
    shared, below = reduce(DataFrame.unionByName, shared), F.col("at") < F.col("low")
    by_set = Window.partitionBy("node", below)
    place = F.when(below, F.col("low") - F.count("*").over(by_set) + F.row_number().over(by_set.orderBy("rarity", "at")) - 1).otherwise(F.col("at"))
    met = shared.withColumn("place", place).where("place < first AND node <> least").select("node", "least").distinct()
    families = connected(met, "node", "least")
    # what shares keys is loose: the points' trees, which take little room, leave the families whose texts are compared
    loose = _with_roots(families).join(classes.select("node", "n", "level", F.col("point").alias("data")), "node")
    tasks = _family_tasks(loose, lambda x: ([unpacked(p) for p in x], None), t, chunk_rows, chunk_hashes)
    close = connected(written(tasks, new_dir(spark, "close")), "a", "b")
    members = written(_with_roots(close).join(classes.select("node", "n", "level", "row"), "node"), new_dir(spark, "members"))
    texts = rows.withColumn("row", row).join(members.hint("merge"), "row").groupBy("row").agg(*(F.first(c).alias(c) for c in ("root", "node", "n", "level")), F.first("text").alias("data"))

    def of_texts(x: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        sets = shingle_sets(x, words)
        return [point(s) for s in sets], sets

    links = written(_family_tasks(texts, of_texts, t, chunk_rows, chunk_hashes), new_dir(spark, "links"))
    parts = connected(links, "a", "b")
    rooted = classes.select("node", "smallest", F.col("row").alias("class_row")).join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.min(F.struct(F.col("smallest").isNull().alias("z"), "smallest", "class_row"))["class_row"].alias("keeper"))
    named = rooted.join(names, "root").select(F.col("node").alias("f1"), "component_id", "keeper")
    out = sets.select("id", "row", "n", "f1").join(named, "f1", "left")
    has = F.col("n") > 0
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("f1").alias("class_id"), F.when(has, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "row", F.when(has, F.col("keeper")).alias("keeper"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, less all but one of each component (the one with the smallest id, nulls last).

    Documents without words all stay; of fully repeated rows (equal id and text) one stays.
    """
    keepers = jaccard_classes(docs, id_col=id_col, text_col=text_col, **options).where("keeper IS NOT NULL").select(F.col("keeper").alias("key")).distinct()
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).alias("key")
    whole = docs.where(worded).select(key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    kept = whole.join(keepers, "key", "left_semi").dropDuplicates(["key"]).select(*(F.col(f"doc.`{c}`") for c in docs.columns))
    return kept.unionByName(docs.where(~worded))
