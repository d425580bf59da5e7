"""Token ids in binary shards, each a wavelet matrix.

A shard holds the ids of consecutive documents (ascending doc_id) as succinct bit-planes: plane ``l`` has bit ``l`` of
every id, stably partitioned by the planes above it, with a rank directory of one 32-bit count for each 512 bits. From
that one blob come token access, counts of an id before a place (rank), places of an id's occurrences (select), and the
whole sequence. The files are Parquet: one row a shard, its ids, lengths and blob, so that any store Spark writes to
will do and the commit protocol handles lost executors; the codec is zstd.

Edge cases: null or empty texts have only the end id; null doc_ids sort first; equal doc_ids follow each other by the
text's hash; an empty table gives an empty store. A document is never split over shards, so the largest document
bounds a shard that is over its target.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.llm.common import WordEncoder, read_text

MAGIC, BLOCK = b"FWM1", 512


class WaveletMatrix:
    """Rank, select and access over unsigned ids below ``2 ** depth``."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros, self.depth = n, planes, zeros, len(planes)
        self._ranks: list[np.ndarray] = [self._directory(p) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, depth: int | None = None) -> "WaveletMatrix":
        ids = np.asarray(ids, "u4")
        depth = depth or max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros, cur = [], [], ids.astype("u2") if depth <= 16 else ids
        for level in range(depth - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)  # places, as they are several times faster than masks
            zeros.append(len(low))
            cur = np.concatenate([cur[low], cur[high]])
        return cls(len(ids), planes, zeros)

    def _directory(self, plane: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 bits."""
        ones = np.bitwise_count(plane).astype("u4")
        sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)) if len(ones) else ones
        return np.concatenate([[0], np.cumsum(sums)]).astype("u4")

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QI", self.n, self.depth) + struct.pack(f"<{self.depth}Q", *self.zeros)
        return head + b"".join(r.astype("<u4").tobytes() + p.tobytes() for r, p in zip(self._ranks, self.planes, strict=True))

    @classmethod
    def from_bytes(cls, blob: bytes) -> "WaveletMatrix":
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, depth = struct.unpack_from("<QI", blob, 4)
        zeros, at, size = list(struct.unpack_from(f"<{depth}Q", blob, 16)), 16 + 8 * depth, (n + 7) // 8
        ranks = 4 * (-(-size // (BLOCK // 8)) + 1)
        out, directories, planes = cls.__new__(cls), [], []
        for _ in range(depth):
            directories.append(np.frombuffer(blob, "<u4", ranks // 4, at))
            planes.append(np.frombuffer(blob, "u1", size, at + ranks))
            at += ranks + size
        out.n, out.depth, out.zeros, out.planes, out._ranks = n, depth, zeros, planes, directories
        return out

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        whole, rest = self.planes[level][block * (BLOCK // 8) : i >> 3], i & 7
        part = int(self.planes[level][i >> 3] & ((1 << rest) - 1)).bit_count() if rest else 0
        return int(self._ranks[level][block]) + int(np.bitwise_count(whole).sum()) + part

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.depth):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` ids."""
        if value >> self.depth:
            return 0
        start, end = 0, min(i, self.n)
        for level in range(self.depth):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if value >> (self.depth - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.rank(value, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane's partition is undone on the bits gathered so far."""
        value = np.zeros(self.n, "u2" if self.depth <= 16 else "u4")
        for level in range(self.depth - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, out = self.zeros[level], np.empty_like(value)
            out[np.flatnonzero(~bit)] = value[:z]
            out[np.flatnonzero(bit)] = value[z:] | value.dtype.type(1 << (self.depth - 1 - level))
            value = out
        return value.astype("u4")


SHARD_SCHEMA = "part int, shard int, first long, doc_ids array<bigint>, lengths array<bigint>, n_tokens long, matrix binary"


def write_store(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 1, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text of ``docs`` and write the shards in ascending order of ``id_col`` to ``path``.

    ``vocabulary`` is the tokenizer's file. Only the id and text columns are read, so other columns may have any name.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_text(vocabulary))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = WordEncoder.of(spec.value), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size, first, number = 0, 0, 0

        def row() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(x for _, x in held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([[len(x) // 4 for _, x in held]], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([matrix.to_bytes()], pa.binary())],
                names=["part", "shard", "first", "doc_ids", "lengths", "n_tokens", "matrix"],
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                for i, x in zip(ids[at : at + 256], encoder.encode(texts[at : at + 256].to_pylist()), strict=True):
                    held.append((i, x + end))
                    size += len(x) // 4 + 1
                    if size >= shard_tokens:
                        yield row()
                        held, first, number, size = [], first + size, number + 1, 0
        if held:
            yield row()

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def part_bases(store: DataFrame) -> DataFrame:
    """part, base: the ids before each written part; one row a part, so no more rows than the write had tasks."""
    parts = sorted((r.part, r.n) for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, rows = 0, []
    for part, n in parts:
        rows.append((part, base))
        base += n
    return store.sparkSession.createDataFrame(rows, "part int, base long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids, decoded from the shards alone."""
    store = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(r["matrix"]).decode().astype("<u4")
                ends = np.cumsum(r["lengths"])
                starts = ends - np.asarray(r["lengths"])
                pieces = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(pieces, pa.binary())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    rows = store.mapInArrow(decoded, "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(F.broadcast(part_bases(store)), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def find_token(spark: SparkSession, path: str, token: int, per_shard: int | None = None) -> DataFrame:
    """part, shard, n (occurrences) and places (global places of the first ``per_shard``, or all) of one id, by rank and select."""
    store = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = WaveletMatrix.from_bytes(r["matrix"])
                n = m.count(token)
                places = [r["first"] + m.select(token, k) for k in range(n if per_shard is None else min(n, per_shard))]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["shard"]], pa.int32()), pa.array([n], pa.int64()), pa.array([places], pa.list_(pa.int64()))], names=["part", "shard", "n", "local"])

    rows = store.mapInArrow(found, "part int, shard int, n long, local array<bigint>")
    return rows.join(F.broadcast(part_bases(store)), "part").select("part", "shard", "n", F.expr("transform(local, x -> x + base)").alias("places"))
