"""Runs, gaps, grids and thinning over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feldspar.functions.text import clock


def runs(df: DataFrame, key: str, order: str, label: str, start: str, end: str, score: str, text: str | None = None) -> DataFrame:
    """Consecutive rows of one label: key, run, label, start, end, n, mean (3 places), span, text."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    isles = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ") if text else F.lit(None).cast("string")
    out = isles.groupBy(key, "run", label).agg(F.min_by(start, order).alias("start"), F.max_by(end, order).alias("end"), F.count("*").alias("n"), F.round(F.avg(score), 3).alias("mean"), joined.alias("text"))
    return out.withColumn("span", F.concat(clock(F.col("start")), F.lit("–"), clock(F.col("end"))))


def complement(df: DataFrame, key: str, start: str, end: str, total: str, least: float = 0.05) -> DataFrame:
    """What a key's intervals leave of 0 to its total: key, start, end; gaps of ``least`` or less don't count."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inner = df.select(key, before.alias("start"), F.col(start).alias("end"))
    last = df.groupBy(key).agg(F.max(end).alias("start"), F.max(total).alias("end"))
    return inner.unionByName(last.select(inner.columns)).where(F.col("end") - F.col("start") > least)


def grid(start: Column, end: Column, count: int | None = None, step: float | None = None) -> Column:
    """Times from start to end: ``count`` of them, ends included, or one each ``step`` (a tenth, 1 s at least)."""
    if count is not None:
        return F.transform(F.sequence(F.lit(0), F.lit(max(1, count) - 1)), lambda i: start + (end - start) * i / max(1, count - 1))
    width = F.lit(step) if step else F.greatest(F.lit(1.0), (end - start) / 10)
    return F.transform(F.sequence(F.lit(0), F.floor((end - start) / width).cast("int")), lambda i: start + width * i)


def thin(df: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """At most ``budget`` rows a key, evenly spread: those at floor(i * n / budget)."""
    w = Window.partitionBy(key)
    at, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    rows = df.withColumn("__at", at).withColumn("__n", n)
    first = F.ceil(F.col("__at") * budget / F.col("__n"))
    return rows.where((F.col("__n") <= budget) | (F.floor(first * F.col("__n") / budget) == F.col("__at"))).drop("__at", "__n")
