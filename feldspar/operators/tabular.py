"""Aggregates and profiles of tables, and views of JSON columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from json import loads

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StructType

from feldspar.session import checkpointed


def aggregate(df: DataFrame, by: list[str], measures: list[str], how: str = "sum", top: int = 20) -> DataFrame:
    """Groups without null keys, largest first measure first, then keys; the ``top`` of them."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[how]
    out = df.dropna(subset=by).groupBy(*by).agg(*(fn(m).alias(m) for m in measures))
    return out.orderBy(F.desc_nulls_last(measures[0]), *by).limit(top)


def _values(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """column, value: a row for each cell."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _positions(counts: DataFrame) -> DataFrame:
    """``counts`` (column, value, n) with before: the cells of the column with smaller values; sorted by ranges, so that no task holds a column."""
    part = F.spark_partition_id().alias("part")
    rows = checkpointed(counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value").select("*", part))
    sums = sorted((r["column"], r.part, r.n) for r in rows.groupBy("column", "part").agg(F.sum("n").alias("n")).collect())  # a row a task and column
    starts, at, last = [], 0, None
    for column, p, n in sums:
        at = 0 if column != last else at
        starts.append((column, p, at))
        at, last = at + n, column
    first = counts.sparkSession.createDataFrame(starts, "column string, part int, start long")
    earlier = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return rows.join(F.broadcast(first), ["column", "part"]).select("column", "value", "n", before.alias("before"))


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n_null, n_unique, mean, std (of a sample), min, quartiles, max, sum; rounded to 4 places.

    Cells are counted by column and value first; the quartiles are the values at exact places of the sorted counts.
    """
    counts = checkpointed(_values(df, columns, "double").groupBy("column", "value").agg(F.count("*").alias("n")))
    known = F.col("value").isNotNull()
    total = F.sum(F.when(known, F.col("value").cast("decimal(38,6)") * F.col("n")).cast("decimal(38,6)"))
    stats = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("rows"), total.cast("double").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    stats = stats.withColumn("mean", F.col("sum") / F.nullif("rows", F.lit(0)))
    off = F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2.0))
    spread = counts.where(known).join(F.broadcast(stats.select("column", "mean")), "column").groupBy("column").agg(F.sum(off).alias("squares"))
    at = {q: (F.col("rows") - 1) * q for q in (0.25, 0.5, 0.75)}
    placed = _positions(counts.where(known)).join(F.broadcast(stats.select("column", "rows")), "column")  # a row a column
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    ends = [F.max(F.when(holds(f(at[q])), F.col("value"))).alias(f"{side}{i}") for i, q in enumerate(at) for side, f in (("low", F.floor), ("high", F.ceil))]
    quartiles = placed.groupBy("column").agg(*ends)
    joined = stats.join(spread, "column", "left").join(quartiles, "column", "left")
    between = [F.round(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (at[q] - F.floor(at[q])), 4).alias(f"q{round(q * 100)}") for i, q in enumerate(at)]
    std = F.sqrt(F.try_divide(F.col("squares"), F.col("rows") - 1))
    return joined.select("column", "n_null", "n_unique", F.round("mean", 4).alias("mean"), F.round(std, 4).alias("std"), F.round("min", 4).alias("min"), *between, F.round("max", 4).alias("max"), F.round("sum", 4).alias("sum"))


def profile_categorical(df: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """The ``top`` values of each column: column, value, n, rank (by count, then value)."""
    long = reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    n = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def completeness(df: DataFrame) -> DataFrame:
    """One row: non-null cells over all cells; 1 of an empty table."""
    cells = reduce(lambda a, b: a + b, (F.count(c) for c in df.columns))
    return df.agg(F.when(F.count("*") == 0, 1.0).otherwise(cells / (F.count("*") * len(df.columns))).alias("completeness"))


def roles(df: DataFrame) -> DataFrame:
    """column, role: a measure is numeric (or boolean), repeats values, and has more of them than the smaller of 20 and half the rows."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType | BooleanType)}
    unique = _values(df, df.columns, "string").distinct().groupBy("column").agg(F.count("value").alias("u"))
    named = df.sparkSession.createDataFrame([(c, c in numeric) for c in df.columns], "column string, numeric boolean")
    s = named.join(unique, "column", "left").withColumn("u", F.coalesce("u", F.lit(0))).join(df.agg(F.count("*").alias("n")), how="cross")  # one row
    measure = F.col("numeric") & (F.col("u") < F.col("n")) & (F.col("u") > F.least(F.lit(20), F.col("n") / 2))
    return s.select("column", F.col("u").alias("n_unique"), F.when(measure, "measure").otherwise("dimension").alias("role"))


def sample(df: DataFrame, n: int, by: str, seed: int | None = None) -> DataFrame:
    """The first ``n`` rows by ``by``, or ``n`` in an order made from the seed."""
    return df.orderBy(by).limit(n) if seed is None else df.orderBy(F.xxhash64(F.lit(seed), by), by).limit(n)


def sheets(tables: dict[str, DataFrame]) -> DataFrame:
    """sheet, n_rows, n_columns, header of each table."""
    one = lambda n, d: d.agg(F.lit(n).alias("sheet"), F.count("*").alias("n_rows"), F.lit(len(d.columns)).alias("n_columns"), F.array(*map(F.lit, d.columns)).alias("header"))
    return reduce(DataFrame.unionByName, (one(n, d) for n, d in tables.items()))


def dig(json: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path, whose numbers are places in arrays; null if there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return F.try_variant_get(F.try_parse_json(json), "$" + steps, kind)


def flatten(df: DataFrame, mark: str = ".") -> DataFrame:
    """Struct columns as columns with dotted names, at every depth."""

    def leaves(schema: StructType, at: list[str]) -> list[Column]:
        out = []
        for f in schema:
            path = [*at, f.name]
            out += leaves(f.dataType, path) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in path)).alias(mark.join(path))]
        return out

    return df.select(*leaves(df.schema, []))


def json_nodes(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, depth, name, type, length of each node of each JSON text, by one walk a text; texts that are no JSON have none."""

    def kind(v: object) -> str:
        names = ((dict, "object"), (list, "array"), (str, "string"), (bool, "boolean"), (type(None), "null"))
        return next((name for t, name in names if isinstance(v, t)), "number")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, text in zip(f["key"], f["json"], strict=True):
                try:
                    todo = [(0, None, loads(text))]
                except (ValueError, TypeError):
                    continue
                while todo:
                    depth, name, v = todo.pop()
                    rows.append((k, depth, name, kind(v), len(v) if isinstance(v, list) else None))
                    items = v.items() if isinstance(v, dict) else ((None, x) for x in v) if isinstance(v, list) else ()
                    todo += [(depth + 1, n, x) for n, x in items]
            yield pd.DataFrame(rows, columns=["key", "depth", "name", "type", "length"]).astype({"length": "Int32"})

    kept = df.select(F.col(key).alias("key"), F.col(json).alias("json"))
    return kept.mapInPandas(walk, f"key {df.schema[key].dataType.simpleString()}, depth int, name string, type string, length int")


def json_types(nodes: DataFrame) -> DataFrame:
    """type, n: how many nodes are of each type."""
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def json_keys(nodes: DataFrame, top: int = 40) -> DataFrame:
    """name, n: the ``top`` names of object fields, by count, then name."""
    return nodes.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def json_stats(nodes: DataFrame) -> DataFrame:
    """One row: n_nodes, max_depth, and array lengths' least, greatest and sum."""
    return nodes.agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.sum("length").alias("total_length"))


def json_schema(df: DataFrame, json: str) -> DataFrame:
    """One row: the merged schema of all texts, as Spark writes it."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(json)).alias("schema"))


def array_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
