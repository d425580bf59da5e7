"""Streams of changes, steps and hits. A stream's result equals the batch result over all its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.operators import cache


def latest(changes: DataFrame) -> DataFrame:
    """The state after changes (path, seq, op, content): the last write of each path, if it is no delete."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("op", "content", "seq"), "seq").alias("c"))
    return last.where("c.op <> 'delete'").select("path", "c.content", "c.seq")


def apply_burst(state: DataFrame, burst: DataFrame) -> DataFrame:
    """``state`` (path, content, seq) after one burst; deletes of unknown paths do nothing."""
    return state.join(burst.select("path").distinct(), "path", "left_anti").unionByName(latest(burst))


def run_upserts(changes: DataFrame, root: str, checkpoint: str, rebuild: Callable[[DataFrame, int], None] | None = None) -> None:
    """Apply a stream of changes as bursts: each writes the next snapshot ``root``/n=<batch>, then calls ``rebuild``.

    A burst that is run again after a failure writes the same snapshot, from the one before it.
    """

    def burst(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        new = latest(df) if not batch else apply_burst(spark.read.parquet(f"{root}/n={batch - 1}"), df)
        new.write.mode("overwrite").parquet(f"{root}/n={batch}")
        if rebuild:
            rebuild(spark.read.parquet(f"{root}/n={batch}"), batch)

    changes.writeStream.foreachBatch(burst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n: counts by tumbling window; works on a stream and on a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def distinct_steps(events: DataFrame) -> DataFrame:
    """logic_unit_id with the sorted set of its steps; complete or update mode on a stream."""
    return events.groupBy("logic_unit_id").agg(F.array_sort(F.collect_set("step_id")).alias("current_steps"))


def hit_stream(hits: DataFrame, limits: cache.Limits | None = None) -> DataFrame:
    """The cache's rows of each store after each micro-batch of hits (store, seq, ref, description, at)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from feldspar.functions import lineref

    parsed = hits.withColumn("r", lineref.parse(F.col("ref"))).where("r IS NOT NULL").select("store", "seq", "r.file", "r.start", "r.end", F.coalesce("description", F.lit("")).alias("description"), F.col("at").cast("double").alias("at"))

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = cache.State()
        if held.exists:
            for tier, file, start, end, description, n, at in held.get[0]:
                getattr(state, tier).append(cache.Entry(file, start, end, description, n, at))
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            cache.hit(state, r.file, r.start, r.end, r.description, r.at, limits)
        held.update(([(t, e.file, e.start, e.end, e.description, e.hits, e.last_hit) for t in cache.TIERS for e in getattr(state, t)],))
        yield cache.rows(key[0], state)

    entry = "struct<tier:string,file:string,start:int,end:int,description:string,hits:bigint,last_hit:double>"
    return parsed.groupBy("store").applyInPandasWithState(step, cache.ROWS, f"entries array<{entry}>", "update", GroupStateTimeout.NoTimeout)


def as_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The state after the last burst that ``run_upserts`` has applied."""
    snapshots = spark.read.parquet(root)
    last = snapshots.agg(F.max("n")).first()[0]
    return spark.read.parquet(f"{root}/n={last}")
