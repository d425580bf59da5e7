"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

The targets: each source gets its weight's part of ``share`` times all words, stops at ``limit`` times its own words,
and what it can't use goes to the others by weight until none is above. Blocks of ``block_words`` words are allocated to
sources by highest quotients target/1, target/3, target/5, ..., then in the same way to the shards of each source by
their words. A shard's documents lie end to end in seeded order, cut into blocks. A shard whose quota is over its words
is taken whole (once or more); the rest of the quota are the blocks that come first by a seeded hash, one of them cut if
the rest isn't a number of blocks. The hash is that of a run of RUN blocks, so that documents are cut less often. A
source's words miss its target by half a block.

A source whose target is under SMALL blocks has a block of one word, and at least one, so that none vanishes.

The table of sources may be large: it is numbered by a range sort, the excess of full sources is reshared by repeated
sums, and the divisor that gives the highest quotients is found by sums over all sources for several divisors at a time;
sources whose quotients tie get what is left in order. Shards hold a number of words that grows with the square root of
all words, so both the shards of the largest source and the documents of a shard stay few enough for one task each.

Edge cases: null texts and null sources are allowed (the null source comes last); sources with no words get nothing;
rows with equal doc_id and text are interchangeable; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feldspar.llm.common import SPACE, new_dir, scratch, words_of, written

#: Sources with a target of fewer blocks than this are apportioned by single words.
SMALL = 4
#: Blocks that follow each other are selected in runs of this many.
RUN = 32
#: Divisors tried at a time.
WAYS = 24


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes/(2k+1); ties go to the earlier entry."""
    total = math.fsum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    got = [max(0, int(v * seats / total + 0.5)) for v in votes]
    missing = seats - sum(got)
    if missing > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif missing < 0:
        heap = [(votes[i] / (2 * g - 1), -i) for i, g in enumerate(got) if g]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, each row's place from 0 by ``order``, without a single task that holds all rows."""
    spark, at = df.sparkSession, F.col("at")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, new_dir(spark, "numbered"))
    part = F.shiftright(at, 33).cast("int")
    before, base = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):  # a row a task
        before.append((r.part, base))
        base += r["count"]
    starts = spark.createDataFrame(before, "part int, base long")
    return rows.join(F.broadcast(starts), part == F.col("part")).withColumn("number", F.col("base") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "base")


def targeted(sources: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """``sources`` (number, source_size) with target: weighted parts of ``share`` times all words, none above ``limit`` times its size."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    size, some = F.col("source_size"), F.col("source_size") > 0
    total = sources.agg(F.sum(size)).first()[0] or 0
    full, known = F.lit(False), -1
    while True:
        free = F.when(some & ~full, w)
        got = sources.agg(F.sum(free).alias("weight"), F.count_if(some & full).alias("n"), F.sum(F.when(some & full, size)).alias("size")).first()
        left = share * total - limit * (got["size"] or 0)
        if got.n == known or not got.weight:
            break
        known, full = got.n, w * F.lit(left) > limit * size * F.lit(got.weight)
    part = F.when(full, limit * size) if not got.weight else F.when(full, limit * size).otherwise(w * F.lit(left) / F.lit(got.weight))
    return sources.withColumn("target", F.when(some, part).otherwise(0.0).cast("double"))


def allotted(sources: DataFrame, votes: str, seats: int) -> DataFrame:
    """``sources`` (number, votes; none negative) with ``seats`` of them by highest quotients votes/(2k+1), ties by number."""
    got = lambda d: F.floor(F.col(votes) / F.lit(float(d)) + 0.5)
    n, total, most = sources.agg(F.count_if(F.col(votes) > 0), F.sum(F.col(votes).cast("decimal(38,6)")), F.max(votes)).first()
    if not n or seats <= 0:
        return sources.withColumn("seats", F.lit(0).cast("long"))
    # by ``low`` there are too many seats or just enough, by ``high`` too few or just enough
    low, high = float(total) / (seats + n / 2 + 1), float(total) / (seats - n / 2 - 1) if seats > n / 2 + 2 else 2.1 * most
    while True:
        tried = [low + (high - low) * k / WAYS for k in range(WAYS + 1)]
        sums = sources.agg(*(F.sum(got(d)) for d in tried)).first()
        if seats in list(sums):
            return sources.withColumn("seats", got(tried[list(sums).index(seats)]))
        k = max(i for i, x in enumerate(sums) if x > seats)
        if (low, high) == (tried[k], tried[k + 1]) or not tried[k] < tried[k] + (tried[k + 1] - tried[k]) / WAYS:
            break
        low, high = tried[k], tried[k + 1]
    tied = numbered(sources.where(got(low) > got(high)).select("number", (got(low) - got(high)).alias("more")).withColumnRenamed("number", "of"), F.col("of"))
    tied = tied.where(F.col("number") < seats - sums[k + 1]).select(F.col("of").alias("number"), F.lit(1).alias("one"))
    return sources.join(tied, "number", "left").withColumn("seats", got(high) + F.coalesce("one", F.lit(0))).drop("one")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block_words: int = 64, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, key (its row's hash), size, source_size, target, whole (times it is taken whole),
    runs (array of begin and n: the words taken besides), part (their number), taken, shard.

    Weights go to the sources in code point order, null last, repeating.
    """
    path = new_dir(docs.sparkSession, "mix")
    with scratch(docs.sparkSession):
        return written(_mix(docs, weights, share, limit, block_words, seed, id_col, text_col, source_col), path)


def _mix(docs: DataFrame, weights: tuple[int, ...], share: float, limit: float, block_words: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("key"),
        F.size(words_of(text)).cast("long").alias("size"),
    )
    sized = written(sized, new_dir(spark, "sizes"))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(by_source, F.col("source").isNull(), F.col("source"))
    sources = written(targeted(sources, weights, share, limit), new_dir(spark, "targets"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shard_words = max(block_words, math.isqrt(total) * 32)
    small = F.col("target") < SMALL * block_words
    large = sources.withColumn("votes", F.when(small, 0.0).otherwise(F.col("target")))
    seats = round((large.agg(F.sum(F.col("votes").cast("decimal(38,6)"))).first()[0] or 0) / block_words)
    of_words = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round("target"))).otherwise(0)
    sources = allotted(large, "votes", seats).select(
        "number", "source", "source_size", "target", F.when(small, of_words).otherwise(F.col("seats")).cast("long").alias("blocks"),
        F.when(small, 1).otherwise(block_words).cast("long").alias("block"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"),
    )
    sources = written(sources.withColumnRenamed("source", "name"), new_dir(spark, "mix-sources"))
    dealt = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")))

    def quotas(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("shard", ignore_index=True)
        got = sainte_lague([int(x) for x in t.words], int(t.blocks.iloc[0]))
        return t.assign(quota=np.array(got, "i8"))[["number", "shard", "words", "block", "quota"]]

    by_shard = dealt.groupBy("number", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"), F.first("block").alias("block"))
    shards = by_shard.groupBy("number").applyInPandas(quotas, "number long, shard long, words long, block long, quota long")
    words, block = F.col("words"), F.col("block")
    wanted = F.least(F.col("quota") * block, (limit * words).cast("long"))
    shards = shards.select("*", F.when(words > 0, F.floor(wanted / words)).otherwise(0).cast("long").alias("whole"), F.when(words > 0, wanted % words).otherwise(0).alias("rest"))
    shards = written(shards, new_dir(spark, "mix-shards"))
    # a shard's blocks in seeded order, the short one at its end last: the first ones make up the rest
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((words - 1) / block)))
    listed = shards.where("rest > 0").select("number", "shard", "words", "block", "rest", number.alias("b"))
    by_hash = Window.partitionBy("number", "shard").orderBy((F.col("b") + 1) * block > words, F.xxhash64(F.lit(seed), "number", "shard", F.floor(F.col("b") / RUN)), "b")
    open_words = F.col("rest") - (F.row_number().over(by_hash) - 1) * block
    chosen = listed.select("number", "shard", "b", F.least(block, open_words).alias("n")).where("n > 0")
    before = Window.partitionBy("number", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).join(shards.select("number", "shard", "whole", "rest"), ["number", "shard"])
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), new_dir(spark, "mix-places"))
    size, at = F.col("size"), F.col("at")
    covered = placed.where("rest > 0 AND size > 0").select("place", "number", "shard", "size", "at", "block", F.explode(F.sequence(F.floor(at / block), F.floor((at + size - 1) / block))).alias("b"))
    begin = F.greatest(F.lit(0).cast("long"), F.col("b") * block - at)
    hits = covered.join(chosen.hint("merge"), ["number", "shard", "b"]).select("place", begin.alias("begin"), (F.least(size, F.col("b") * block + F.col("n") - at) - begin).alias("n")).where("n > 0")
    runs = hits.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("begin", "n"))).alias("runs"), F.sum("n").alias("part"))  # of one document
    out = placed.join(runs.hint("merge"), "place", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    none = F.array().cast("array<struct<begin:bigint,n:bigint>>")
    return out.select("doc_id", "source", "key", "size", "source_size", "target", "whole", F.coalesce("runs", none).alias("runs"), "part", (F.col("whole") * size + F.col("part")).alias("taken"), "shard")


def mixed_documents(docs: DataFrame, *, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy, and one with the words of a partly taken document.

    A partial copy has the document's words of the chosen blocks, in order. A document's row keeps its id in each copy.
    Rows with equal id and text give the copies that all of them are taken for, with the other columns of one. The texts'
    lengths in ``n_chars``, if there is such a column, follow the cut.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plan = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("taken > 0")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    whole = F.col("whole") + F.when((F.col("part") > 0) & ~cut, 1).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(None).cast("array<struct<begin:bigint,n:bigint>>"), whole.cast("int")), F.when(cut, F.array("runs")).otherwise(F.array()))
    plan = plan.select("key", F.explode(copies).alias("runs"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    texts = docs.select(F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("key"), row).dropDuplicates(["key"])
    rows = texts.join(plan, "key").select("doc", "runs")
    body = F.coalesce(F.col(f"doc.`{text_col}`").cast("string"), F.lit(""))
    # each word with the white space after it, of documents that are cut only
    words = F.when(F.col("runs").isNotNull(), F.regexp_extract_all(body, F.lit(f"[^{SPACE}]++[{SPACE}]*+"), F.lit(0)))
    rows = rows.select("doc", "runs", words.alias("words"))
    pieces = F.flatten(F.transform("runs", lambda r: F.slice("words", (r["begin"] + 1).cast("int"), r["n"].cast("int"))))
    rows = rows.select("doc", F.array_join(pieces, "").alias("cut"))
    columns = [F.coalesce("cut", F.col(f"doc.`{c}`")).alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        columns[at] = F.when(F.col("cut").isNotNull(), F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars")).alias("n_chars")
    return rows.select(*columns)
