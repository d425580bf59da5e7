"""Line references ``file:n`` and ``file:a-b``: closed intervals of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(ref: Column) -> Column:
    """struct(file, start, end), split at the last colon; null unless 1 <= start <= end."""
    lines = F.substring_index(ref, ":", -1)
    file = F.left(ref, F.length(ref) - F.length(lines) - 1)
    a, b = F.substring_index(lines, "-", 1).try_cast("int"), F.substring_index(lines, "-", -1).try_cast("int")
    whole = lines.rlike("^[0-9]+(-[0-9]+)?$") & (F.length(ref) > F.length(lines) + 1)
    return F.when(whole & (a >= 1) & (b >= a), F.struct(file.alias("file"), a.alias("start"), b.alias("end")))


def text(r: Column) -> Column:
    return F.when(r["start"] == r["end"], F.concat_ws(":", r["file"], r["start"].cast("string"))).otherwise(F.concat(r["file"], F.lit(":"), r["start"].cast("string"), F.lit("-"), r["end"].cast("string")))


def size(r: Column) -> Column:
    return r["end"] - r["start"] + 1


def overlap(a: Column, b: Column) -> Column:
    """Common lines over the smaller size; 0 across files."""
    common = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1)
    return F.when(a["file"] == b["file"], common / F.least(size(a), size(b))).otherwise(0.0)


def hull(a: Column, b: Column) -> Column:
    return F.struct(a["file"].alias("file"), F.least(a["start"], b["start"]).alias("start"), F.greatest(a["end"], b["end"]).alias("end"))


def toc_entries(toc: Column) -> Column:
    """struct(depth, line, title) of each ``depth:line:title`` line, blank lines left out; null where malformed."""
    lines = F.filter(F.split(toc, "\n"), lambda x: F.trim(x) != "")

    def entry(x: Column) -> Column:
        p = F.split(x, ":", 3)
        d, n = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int")
        return F.when(d.between(1, 6) & (n > 0) & (F.size(p) == 3), F.struct(d.alias("depth"), n.alias("line"), F.get(p, F.lit(2)).alias("title")))

    return F.transform(lines, entry)
