"""Exact nearest neighbours by largest inner product, as a block matrix join.

Queries and candidates are dealt into blocks; each pair of blocks is one tile. A tile quantises its rows to int8 and
multiplies the int8 matrices (exactly, in float arithmetic wide enough for the sums). With x = x' + r, x' the quantised
row, |x.y - x'.y'| <= |x'| |ry| + |rx| |y|, so each product comes with an error bound, and only pairs whose upper bound
reaches the k-th largest lower bound of their query survive. They are recomputed in double precision on the original
vectors, summed in component order, and a query's best of all tiles are merged by heaps.

Edge cases: vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows with a null
id; vectors compare with vectors of their own dimension only; ties go to the smaller id; a query never finds its own id;
of rows with the same id the best is listed once; components may be as large or small as doubles are. Of equal vectors in a tile only the k + 1 smallest distinct ids are
compared, as no other can be among the k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 rows, their largest components, and the norms of the quantised rows, of what they leave and of the rows, all
    three in units of the largest component, so that no norm overflows or vanishes."""
    top = np.abs(x).max(axis=1)
    unit = x / top[:, None]
    q = np.rint(unit * 127).astype("i1")
    near = q / 127.0
    return q, top, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1), np.linalg.norm(unit, axis=1)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best (query_id, vec_id, score) of each query in one tile."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    other = new | np.concatenate([[True], ids[1:] != ids[:-1]])  # not a repeat of the row before
    ids, vectors, new = ids[other], vectors[other], new[other]
    starts = np.flatnonzero(new)
    keep = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) <= k
    ids, vectors = ids[keep], vectors[keep]
    repeats = len(ids) - len(np.unique(ids))  # rows that may stand in for a row with the same id
    cq, ctop, _, cr, whole = quantised(vectors)
    exact = "f4" if vectors.shape[1] * 127 * 127 < 1 << 24 else "f8"
    columns, out = cq.astype(exact).T, []
    for at in range(0, len(query_ids), 256):
        qid, x = query_ids[at : at + 256], queries[at : at + 256]
        qq, _, qn, qr, _ = quantised(x)
        own = qid[:, None] == ids[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            # in units of the query's largest component, which don't change the order of its candidates
            near = (qq.astype(exact) @ columns) / 127.0**2 * ctop[None, :]
            error = (qn[:, None] * cr[None, :] + qr[:, None] * whole[None, :]) * ctop[None, :] * (1 + 1e-9) + 1e-12 * np.abs(near) + 1e-300
            bounded = np.isfinite(near) & np.isfinite(error)  # others survive
            upper = np.where(bounded, near + error, np.inf)
            lower = np.where(own | ~bounded, -np.inf, near - error)
        least = np.partition(lower, len(ids) - k - repeats, axis=1)[:, len(ids) - k - repeats] if len(ids) > k + repeats else np.full(len(qid), -np.inf)
        rows, cols = np.nonzero((upper >= least[:, None]) & ~own)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.cumsum(x[rows] * vectors[cols], axis=1)[:, -1]
        best = np.lexsort((ids[cols], -scores, rows))
        rows, cols, scores = rows[best], cols[best], scores[best]
        if repeats:
            _, once = np.unique(rows * len(ids) + np.searchsorted(np.sort(ids), ids[cols]), return_index=True)
            once.sort()
            rows, cols, scores = rows[once], cols[once], scores[once]
        first = np.searchsorted(rows, rows)
        chosen = np.arange(len(rows)) - first < k
        out += zip(qid[rows[chosen]].tolist(), ids[cols[chosen]].tolist(), scores[chosen].tolist(), strict=True)
    return out


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, query_block: int = 4096, candidate_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row that ``is_query`` marks, among all rows.

    Each row crosses to one tile for each block of the other side; a task holds one tile.
    """
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, m = rows.agg(F.count("*"), F.count_if("q")).first()
    down, across = max(1, -(-m // query_block)), max(1, -(-n // candidate_block))
    deal = F.xxhash64("id", "v")
    left = rows.where("q").select("id", "v", F.pmod(deal, F.lit(down)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"))
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"), F.pmod(deal, F.lit(across)).cast("int").alias("j"))

    def joined(a: pa.Table, b: pa.Table) -> pa.Table:
        def of(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            ids, v = t.column("id").to_numpy(), t.column("v").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) and v.num_chunks else v
            lengths = np.diff(v.offsets.to_numpy()) if len(ids) else np.array([], int)
            flat, out = v.flatten().to_numpy() if len(ids) else None, {}
            ends = np.cumsum(lengths)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                out[d] = ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)]
            return out

        x, y = of(a), of(b)
        found = [r for d in x if d in y for r in tile(*x[d], *y[d], k)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    tiles = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(joined, FOUND)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, dict[int, float]] = {}
        best: dict[int, list[tuple[float, int]]] = {}
        for f in frames:
            for query, vec, score in zip(f.query_id.tolist(), f.vec_id.tolist(), f.score.tolist(), strict=True):
                seen, heap = heaps.setdefault(query, {}), best.setdefault(query, [])
                if vec in seen:  # another row with the same id: the better one counts
                    if score <= seen[vec]:
                        continue
                    heap.remove((seen[vec], -vec))
                    heapq.heapify(heap)
                elif len(heap) == k:
                    if (score, -vec) <= heap[0]:
                        continue
                    del seen[-heapq.heappop(heap)[1]]
                heapq.heappush(heap, (score, -vec))
                seen[vec] = score
        for query, heap in best.items():
            top = sorted(heap, reverse=True)
            yield pd.DataFrame({"query_id": query, "rank": np.arange(1, len(top) + 1, dtype="i4"), "vec_id": [-v for _, v in top], "score": [s for s, _ in top]})

    return tiles.repartition("query_id").mapInPandas(merged, "query_id long, rank int, vec_id long, score double")
