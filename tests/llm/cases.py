"""Inputs that the tests of this folder share."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
#: Columns whose names clash with those that operators use within.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size string, line string, w string, __n string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "tion", "ered", "Onth", "wh", "re.", "st,", "le", "12", "é"]) + r.choice("abcdefgh") * r.randint(0, 2) for _ in range(n))


def odd_texts() -> list[str | None]:
    base = words(120, 1)
    near = base.split()
    near[60] = "CHANGED"
    return [
        None, "", "   \n\t ", "one", "one two", "One TWO", base, base, " ".join(near), base.upper(), base + "\n" + words(80, 2), words(80, 2),
        "\n".join([words(12, 3)] * 4), words(30_000, 4), words(5000, 5) + " 4000 0000 0000 0002 " + "1" * 50, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 +1 (234) 567-8901, 256.1.1.1",
        "é" * 50 + " mail: jo.é.x@ex-a.mple.org!", "\x0b\x0c\r", "x" * 20_000, "### $$$ %%% | <a>", words(60, 6), words(60, 6) + " more words here", "GB82WEST12345698765432 and visa 378282246310005",
    ]


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and long texts, ties, repeated rows, null and repeated ids, clashing names."""
    rows = []
    for i, t in enumerate(odd_texts()):
        rows.append((i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "r", "k", "s", "l", "w", "n"))
    rows += [rows[6], rows[6], (None, words(90, 9), None, None, None, None, None, None, None, None, None), (None, words(90, 9), None, None, None, None, None, None, None, None, None), (3, words(70, 10), "fr", "s1", 7, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")
