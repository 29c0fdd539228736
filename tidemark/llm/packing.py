"""Packing token sequences by minimum bin slack.

Each task turns its documents into token ids, cuts off full windows, and fills further windows from the pool of
remaining pieces: a bitset subset-sum over the multiset of piece lengths finds the total closest to the capacity, and
the counts are read back from the stages of the table. A window that no subset fills exactly takes the missing ids from
a piece cut for it; the ids left at the end of a task form windows whose lengths are powers of two, which need no
padding. No shuffle: a window never spans tasks, so a lost task is repeated as a whole.

Defined cases: a null text is an empty one (one piece: the end id alone); ids may be null or repeated; only the id and
text columns are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import returning
from tidemark.llm.tokens import WordTokens, tokens

CAPACITY = 4096
END_ID = 2
POOL = 256
# Ids of finished windows that a task holds before it hands them on.
READY_IDS = 1 << 20

def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take so that their total is closest to ``capacity`` from below.

    The longest piece is always taken; the rest follows from a bitset of reachable totals, whose stages are walked
    backwards for the counts.
    """
    longest = max(counts)
    room, full = capacity - longest, (1 << (capacity - longest + 1)) - 1
    reach, stages = 1, []
    for length in sorted(counts, reverse=True):
        left, batch = counts[length] - (length == longest), 1
        while left and batch * length <= room and not reach >> room & 1:
            batch = min(batch, left)
            stages.append((length, batch, reach))
            reach |= reach << batch * length & full
            left -= batch
            batch *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int, {longest: 1})
    for length, batch, before in reversed(stages):
        if not before >> total & 1:
            total -= length * batch
            taken[length] += batch
    return dict(taken)


class Packer:
    """Windows of one task. ``ready`` collects (document index, start, ids, document tokens, window, offset)."""

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL):
        self.capacity, self.pool = capacity, pool
        self.pieces: dict[int, list] = defaultdict(list)
        self.held = self.windows = 0
        self.ready: list[tuple] = []
        self.ready_ids = 0

    def _window(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, tokens in pieces:
            self.ready.append((key, start, ids, tokens, self.windows, offset))
            offset += len(ids)
        self.ready_ids += offset
        self.windows += 1

    def add(self, key, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            self._window([(key, start, ids[start:start + self.capacity], len(ids))])
        if full < len(ids):
            self._hold((key, full, ids[full:], len(ids)))
        if self.held >= 2 * self.pool:
            while self.held > self.pool:
                self._fill()

    def _hold(self, piece: tuple) -> None:
        self.pieces[len(piece[2])].append(piece)
        self.held += 1

    def _take(self, length: int) -> tuple:
        piece = self.pieces[length].pop()
        if not self.pieces[length]:
            del self.pieces[length]
        self.held -= 1
        return piece

    def _fill(self) -> None:
        taken = fill({n: len(p) for n, p in self.pieces.items()}, self.capacity)
        window = [self._take(length) for length, n in taken.items() for _ in range(n)]
        gap = self.capacity - sum(length * n for length, n in taken.items())
        if gap and self.held:  # every piece left is longer than the gap: cut one
            key, start, ids, tokens = self._take(min(self.pieces))
            window.append((key, start, ids[:gap], tokens))
            self._hold((key, start + gap, ids[gap:], tokens))
        elif gap:
            self._powers(window)
            return
        self._window(window)

    def _powers(self, pieces: list[tuple]) -> None:
        """Windows of lengths that are powers of two, for what is left."""
        left, pieces = sum(len(p[2]) for p in pieces), pieces[::-1]
        while left:
            size = room = 1 << left.bit_length() - 1
            window = []
            while room:
                key, start, ids, tokens = pieces.pop()
                window.append((key, start, ids[:room], tokens))
                if len(ids) > room:
                    pieces.append((key, start + room, ids[room:], tokens))
                room -= len(window[-1][2])
            self._window(window)
            left -= size

    def finish(self) -> None:
        while self.held:
            self._fill()

    def rows(self) -> list[tuple]:
        out, self.ready, self.ready_ids = self.ready, [], 0
        return out


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = True, keep_words: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, its ids. The words of a
    task are kept for the next one of its worker; without ``keep_words`` they go, where other stages need the memory."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, id_type = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)
    schema = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint" + ", ids array<int>" * with_ids)

    def run(batches: Iterator[pa.RecordBatch]):
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 40

        def flush():
            if not (found := packer.rows()):
                return
            keys, starts, ids, totals, windows, offsets = zip(*found)
            columns = [pa.array(keys, id_type), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                       pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(totals, pa.int64()),
                       pa.array([base + w for w in windows], pa.int64()), pa.array(offsets, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

        words = tokens(WordTokens, tokenizer)
        for key, ids in words.rows(batches, end_id):
            packer.add(key, ids)
            if len(packer.ready) >= 5_000 or packer.ready_ids >= READY_IDS:
                yield from flush()
        packer.finish()
        yield from flush()
        if not keep_words:
            words.forget()

    return rows.mapInArrow(returning(run), schema)
