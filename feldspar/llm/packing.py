"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut; whole sequences stand alone. The remaining pieces are dealt evenly over
blocks, and each block fills one sequence at a time: greedily, largest fitting piece first; then, if a gap is left, the
smallest piece of the sequence makes way for the two unpacked pieces that fill its place and the gap best. A block
keeps only counts by length, so a fill costs a few operations on a bit set of the lengths in stock.

Edge cases: null and empty texts have only the end id; equal lengths go by (doc_id, piece), nulls first; repeated rows
are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feldspar.llm.common import WordEncoder, new_dir, read_text, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins, each a list of lengths at most ``capacity`` in sum, that hold all of ``lengths``."""
    count = [0] * (capacity + 1)
    for x in lengths:
        count[x] += 1
    stock = rev = 0  # bit x of stock and bit capacity-x of rev: length x is unpacked
    for x, n in enumerate(count):
        if n:
            stock, rev = stock | 1 << x, rev | 1 << (capacity - x)

    def take(x: int) -> None:
        nonlocal stock, rev
        count[x] -= 1
        if not count[x]:
            stock, rev = stock ^ 1 << x, rev ^ 1 << (capacity - x)

    def put_back(x: int) -> None:
        nonlocal stock, rev
        count[x] += 1
        stock, rev = stock | 1 << x, rev | 1 << (capacity - x)

    bins = []
    while stock:
        gap, held = capacity, []
        while fits := stock & ((2 << gap) - 1):
            x = fits.bit_length() - 1
            take(x)
            held.append(x)
            gap -= x
        if gap and stock:
            small = held[-1]  # the last piece put in is the smallest
            for total in range(small + gap, small, -1):
                pairs = stock & (rev >> (capacity - total)) if total <= capacity else 0
                if total % 2 == 0 and pairs >> (total // 2) & 1 and count[total // 2] < 2:
                    pairs ^= 1 << (total // 2)
                if pairs:
                    a = pairs.bit_length() - 1
                    put_back(held.pop())
                    take(a)
                    take(total - a)
                    held += [a, total - a]
                    break
        bins.append(held)
    return bins


def pieces_of(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' pieces; a narrow pass that reads only the id and text columns."""
    spec = docs.sparkSession.sparkContext.broadcast(read_text(vocabulary))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(spec.value), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows = []
                for i, x in zip(ids[at : at + 256], encoder.encode(texts[at : at + 256].to_pylist()), strict=True):
                    x += end
                    rows += [(i, p, p * capacity, len(y) // 4, zlib.crc32(y)) for p, k in enumerate(range(0, len(x), 4 * capacity)) for y in (x[k : k + 4 * capacity],)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, block_pieces: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES with sequence_id and offset: where each piece lies.

    ``block_pieces`` bounds what one task holds; a block wastes at most about one sequence, so more pieces a block
    pack tighter, and the number of blocks follows the input.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, vocabulary, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), new_dir(spark, "pieces"))
    blocks = max(1, -(-pieces.count() // block_pieces))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [f for f in frames if len(f)]
        if not got:
            return
        rows = pd.concat(got).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], na_position="first", ignore_index=True)
        base = TaskContext.get().partitionId() << 32
        by_length: dict[int, deque[int]] = defaultdict(deque)
        for i, x in enumerate(rows.length.to_list()):
            by_length[x].append(i)
        sequence, offset = np.empty(len(rows), "i8"), np.empty(len(rows), "i8")
        for k, held in enumerate(best_two_fit(rows.length.to_list(), capacity)):
            at = 0
            for x in held:
                i = by_length[x].popleft()
                sequence[i], offset[i] = base + k, at
                at += x
        yield rows.assign(sequence_id=sequence, offset=offset)

    # dealt round robin: even whatever the ids are, and repeatable, as Spark sorts the rows of each task first
    return pieces.repartition(blocks).mapInPandas(packed, PIECES + ", sequence_id long, offset long")
