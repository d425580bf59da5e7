"""The index's access cache: three tiers of line references, changed by each hit in order.

One pure function changes a store's state; batch and streaming jobs share it. A store's hits are sequential by nature,
so one store is one key; stores are spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feldspar.functions import lineref

TIERS = ("hot", "trending", "shadow")


@dataclass
class Limits:
    hot: int = 20
    trending: int = 30
    shadow: int = 100
    promote: int = 3
    overlap: float = 0.5


@dataclass
class Entry:
    file: str
    start: int
    end: int
    description: str
    hits: int
    last_hit: float


@dataclass
class State:
    hot: list[Entry] = field(default_factory=list)
    trending: list[Entry] = field(default_factory=list)
    shadow: list[Entry] = field(default_factory=list)


def hit(state: State, file: str, start: int, end: int, description: str, at: float, limits: Limits | None = None) -> str:
    """Count one access; the tier in which it was found, before any promotion, or ``shadow`` if it is new."""
    limits = limits or Limits()
    for tier in TIERS:
        for e in getattr(state, tier):
            common = min(e.end, end) - max(e.start, start) + 1
            if e.file == file and common > 0 and common / min(e.end - e.start + 1, end - start + 1) >= limits.overlap:
                e.start, e.end, e.hits, e.last_hit = min(e.start, start), max(e.end, end), e.hits + 1, at
                if len(description.encode()) > len(e.description.encode()):
                    e.description = description
                _promote(state, tier, e, limits)
                return tier
    state.shadow.append(Entry(file, start, end, description, 1, at))
    while len(state.shadow) > limits.shadow:
        state.shadow.remove(min(state.shadow, key=lambda e: e.last_hit))
    return "shadow"


def _promote(state: State, tier: str, e: Entry, limits: Limits) -> None:
    if tier == "shadow" and e.hits >= limits.promote:
        state.shadow.remove(e)
        while len(state.trending) >= limits.trending:
            state.trending.remove(min(state.trending, key=lambda x: x.last_hit))
        state.trending.append(e)
    elif tier == "trending":
        if state.hot:
            low = min(state.hot, key=lambda x: x.hits)
            if e.hits > low.hits:
                state.trending[state.trending.index(e)] = low
                state.hot[state.hot.index(low)] = e
        elif limits.hot:
            state.trending.remove(e)
            state.hot.append(e)


ROWS = "store string, tier string, pos int, ref string, description string, hits bigint, last_hit double"


def rows(store: str, state: State) -> pd.DataFrame:
    out = [(store, t, i, e.file + (f":{e.start}" if e.start == e.end else f":{e.start}-{e.end}"), e.description, e.hits, e.last_hit) for t in TIERS for i, e in enumerate(getattr(state, t))]
    return pd.DataFrame(out, columns=["store", "tier", "pos", "ref", "description", "hits", "last_hit"])


def replay(hits: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The cache after all ``hits`` (store, seq, ref, description, at), each store's in order of seq."""
    parsed = hits.withColumn("r", lineref.parse(F.col("ref"))).where("r IS NOT NULL").select("store", "seq", "r.file", "r.start", "r.end", F.coalesce("description", F.lit("")).alias("description"), F.col("at").cast("double").alias("at"))

    def of(key: tuple[str], f: pd.DataFrame) -> pd.DataFrame:
        state = State()
        for r in f.sort_values("seq").itertuples():
            hit(state, r.file, r.start, r.end, r.description, r.at, limits)
        return rows(key[0], state)

    return parsed.groupBy("store").applyInPandas(of, ROWS)


def overlapping(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of references (id, ref) of two tables with enough lines in common: an equi-join on the file, then a range."""
    x, y = (d.select(F.col("id").alias(f"{n}_id"), lineref.parse(F.col("ref")).alias(n)).withColumn("file", F.col(f"{n}.file")) for d, n in ((a, "a"), (b, "b")))
    score = lineref.overlap(F.col("a"), F.col("b"))
    return x.join(y, "file").where("a.start <= b.end AND b.start <= a.end").withColumn("overlap", score).where(F.col("overlap") >= least).select("a_id", "b_id", "file", "overlap")


def view(cache: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of hot and of trending of each store, in stored order."""
    w = Window.partitionBy("store", "tier").orderBy("pos")
    return cache.where("tier <> 'shadow'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def sync_diff(indexed: DataFrame, current: DataFrame, key: str = "file") -> DataFrame:
    """key, change: files added and deleted."""
    a = current.select(key).distinct().join(indexed.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return a.unionByName(indexed.select(key).distinct().join(current.select(key), key, "left_anti").withColumn("change", F.lit("deleted")))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those with the same keys."""
    return table.join(rows.select(keys).distinct(), keys, "left_anti").unionByName(rows)
