"""Packing whole documents by best two fit.

Documents become token ids; only those longer than a sequence are cut, into pieces of which the first takes what full
ones leave over. Groups of pieces are packed by length: a bin takes the longest piece that fits until none does; then
its smallest piece goes back if two unpacked ones fit the wider gap more tightly, the pair of the largest total being
taken. Available lengths are a bit set, so the longest fitting piece is one mask, and a pair of a given total is one
conjunction with the mirrored set.

Tokens are made where the texts lie and written to the shared folder; groups are whole runs of those rows, so nothing is
shuffled and memory is that of one group. Each group leaves at most one bin that nothing was left to fill.

Defined cases: a null text is an empty one (the end id alone); ids may be null or repeated, each row is packed; only the
id and text columns are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.lineage import cut
from tidemark.llm.tokens import ByteTokens, tokens

CAPACITY = 2048
END_ID = 0
GROUP = 20_000


def _pair(counts: list[int], free: int, mirror: int, capacity: int, low: int, high: int) -> tuple[int, int] | None:
    """Two available lengths, the larger first, with the largest total above ``low`` and at most ``high``."""
    high = min(high, 2 * (free.bit_length() - 1))
    low = max(low, 2 * ((free & -free).bit_length() - 1) - 1)
    for total in range(high, low, -1):
        found = free & (mirror >> capacity - total if total <= capacity else mirror << total - capacity)
        if total % 2 == 0 and found >> total // 2 & 1 and counts[total // 2] < 2:
            found ^= 1 << total // 2
        if found:
            longer = found.bit_length() - 1
            return longer, total - longer
    return None


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths lie between 1 and ``capacity``."""
    order = np.argsort(lengths, kind="stable").tolist()
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    begins = np.cumsum([0, *counts]).tolist()
    free = sum(1 << n for n, c in enumerate(counts) if c)
    mirror = sum(1 << capacity - n for n, c in enumerate(counts) if c)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while free:
        taken, room = [], capacity

        def move(length: int, by: int) -> None:
            nonlocal free, mirror, room
            counts[length] += by
            room += by * length
            if counts[length] == (by > 0):  # the first one back or the last one gone
                free ^= 1 << length
                mirror ^= 1 << capacity - length

        while room and (length := (free & (2 << room) - 1).bit_length() - 1) > 0:
            move(length, -1)
            taken.append(length)
        if room and free and (pair := _pair(counts, free, mirror, capacity, taken[-1], taken[-1] + room)):
            move(taken.pop(), 1)
            for length in pair:
                move(length, -1)
            taken += pair
        offset, again = 0, {}
        for length in taken:
            # Rows of a length are used from the last to the first; those of this bin are the ones just above the count.
            at = again[length] = again.get(length, taken.count(length)) - 1
            row = order[begins[length] + counts[length] + at]
            bins[row], offsets[row] = number, offset
            offset += length
        number += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked, the ids of each piece."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, id_type = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
        return pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    def run(batches: Iterator[pa.RecordBatch]):
        found = []
        for key, ids in tokens(ByteTokens, tokenizer).rows(batches, end_id):
            cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                some = (ids[a:b].astype(np.int32),) if with_ids else ()
                found.append((key, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), *some))
            if len(found) >= 5_000:
                yield batch(found)
                found = []
        if found:
            yield batch(found)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``pieces`` with sequence_id and offset. Sequence ids are unique, not consecutive."""
    rows = cut(pieces(docs, tokenizer, doc_id, text, capacity, end_id, with_ids))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]):
        base, held, size = TaskContext.get().partitionId() << 40, [], 0

        def packed():
            nonlocal base
            table = pa.Table.from_batches(held)
            bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
            yield from (table.append_column("sequence_id", pa.array(base + bins))
                        .append_column("offset", pa.array(offsets)).to_batches())
            base += int(bins.max()) + 1

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= GROUP:
                yield from packed()
                held, size = [], 0
        if held:
            yield from packed()

    return rows.coalesce(max(1, -(-rows.count() // GROUP))).mapInArrow(run, schema)
