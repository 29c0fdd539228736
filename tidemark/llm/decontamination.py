r"""Benchmark decontamination by an FM-index per shard of training text.

Texts are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A window is ``window`` consecutive
words of a benchmark item; an item with fewer words, but not none, is one window. A task cuts its documents into shards,
indexes each shard and searches all windows of a block of the benchmark backwards, all at once; rows of the found
intervals are located by sampled suffix positions and merged into removal spans per document.

Only runs of words of the block's own vocabulary that are at least as long as its shortest window go into a shard:
an occurrence lies in such a run, so nothing is lost and the index stays small.

The benchmark is read in blocks of at most about ``block_bytes`` of text (an item is never split), so what a task holds
is bounded whatever the benchmark's size; each block is one pass over the documents, and with one block there is one.

Defined cases: null and empty texts have no words; null item ids count as empty text; rows with the same id are rows
of their own; other columns pass through, whatever their names; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lineage import cut
from tidemark.llm.common import returning, text_bytes, word_blocks

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD = 500_000

# Bytes outside words become spaces, letters small.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPAN),
         T.StructField("hit_items", T.ArrayType(T.StringType()))]


class Windows:
    """Windows of a block of items as rows of word numbers, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        holders: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                     for w in (text or "").encode().translate(WORDS).split()]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                holders[tuple(words[i:i + window])].add(item or "")
        self.phrases, self.items = {}, {}
        for length in sorted({len(w) for w in holders}):
            found = [w for w in holders if len(w) == length]
            self.phrases[length] = np.array(found, np.int32)
            self.items[length] = [sorted(holders[w]) for w in found]
        self.shortest = min(self.phrases, default=0)
        self.window = window


class Shard:
    """Segments of documents until there are enough of them to index."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.clear()

    def clear(self) -> None:
        self.parts, self.docs, self.starts, self.at, self.size = [], [], [], [], 0

    def add(self, doc: int, first: int, words: list[bytes]) -> None:
        """The runs of known words of a block of a document."""
        known = np.fromiter(map(self.windows.vocabulary.get, words, repeat(0)), np.int32, len(words))
        gaps = np.flatnonzero(np.concatenate([[True], known == 0, [True]]))
        lengths = np.diff(gaps) - 1
        for i in np.flatnonzero(lengths >= self.windows.shortest):
            run = known[gaps[i]:gaps[i] + lengths[i]]
            self.parts += [run, np.zeros(1, np.int32)]
            self.docs.append(doc)
            self.starts.append(first + int(gaps[i]))
            self.at.append(self.size)
            self.size += len(run) + 1

    def search(self, spans: dict, items: dict) -> None:
        """Index the shard, find every window and note spans and items per document."""
        from tidemark.llm.suffix import FMIndex

        if not self.size:
            return
        index, at = FMIndex(np.concatenate(self.parts[:-1])), np.array(self.at)
        docs, starts = np.array(self.docs), np.array(self.starts, np.int64)
        for length, phrases in self.windows.phrases.items():
            which, low, high = index.intervals(phrases)
            if not len(which):
                continue
            counts = high - low
            rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            phrase, place = np.repeat(which, counts), index.locate(rows)
            segment = np.searchsorted(at, place, "right") - 1
            begin = starts[segment] + place - at[segment]
            for doc, p in set(zip(docs[segment].tolist(), phrase.tolist())):
                items[doc].update(self.windows.items[length][p])
            for doc, b in zip(docs[segment].tolist(), begin.tolist()):
                spans[doc].append((b, b + length))
        self.clear()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i) for i in range(parts)]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged spans of words inside an occurrence) and ``hit_items``."""
    return _passes(docs, benchmark, text, item_id, item_text, window, block_bytes, None)


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, block_bytes: int,
            finish) -> DataFrame:
    """One pass over the documents for each block of the benchmark; ``finish`` turns the columns of the last one's
    batches into those of the result, in the same task."""
    names = [f.name for f in FOUND]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    rows, blocks = docs, _blocks(benchmark, item_id, item_text, block_bytes)
    for number, block in enumerate(blocks):
        # A block's size is bounded by block_bytes.
        windows = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()], window))
        rows = _search(cut(rows) if number else rows, windows, text, number > 0, finish if number == len(blocks) - 1 else None)
    return rows


def _search(rows: DataFrame, windows, text: str, again: bool, finish) -> DataFrame:
    fields = [f for f in rows.schema.fields if not again or f.name not in {x.name for x in FOUND}]
    names = [f.name for f in fields]

    def run(batches):
        known = windows.value
        for batch in batches:
            spans, items, counts = defaultdict(list), defaultdict(set), []
            shard = Shard(known)
            for doc, data in enumerate(text_bytes(batch.column(text))):
                n = 0
                for first, words in word_blocks(data.translate(WORDS), known.window - 1):
                    n = first + len(words)
                    if known.shortest and len(words) >= known.shortest:
                        shard.add(doc, first, words)
                    if shard.size >= SHARD:
                        shard.search(spans, items)
                counts.append(n)
            shard.search(spans, items)
            if again:
                for doc, (old, held) in enumerate(zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())):
                    spans[doc] += [(s["start"], s["end"]) for s in old]
                    items[doc].update(held)
            each = [merged(spans[d]) if d in spans else [] for d in range(len(counts))]
            columns = {name: batch.column(name) for name in names}
            if finish:
                columns = finish(columns, each)
            else:
                columns["n_words"] = pa.array(counts, pa.int64())
                columns["hit_spans"] = pa.array([[{"start": a, "end": b} for a, b in spans_] for spans_ in each],
                                                pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                columns["hit_items"] = pa.array([sorted(items[d]) if d in items else [] for d in range(len(counts))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(returning(run), T.StructType(fields + ([] if finish else FOUND)))


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of ``spans`` and what stands between them."""
    out, at, spans, index = [], 0, iter(spans), 0
    span = next(spans, None)
    for word in WORD.finditer(data):
        if span is None:
            break
        if index == span[0]:
            out.append(data[at:word.start()])
        index += 1
        if index == span[1]:
            at, span = word.end(), next(spans, None)
    return b"".join(out) + data[at:]


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str = "n_chars", item_id: str = "item_id",
           item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every removal span cut out of its text; ``n_chars``, where there is one, follows. Documents without
    a hit pass unchanged; one that was nothing but benchmark text keeps its row with the little that is left."""
    def finish(columns: dict, spans: list) -> dict:
        if any(spans):
            texts = columns[text].to_pylist()
            for i, here in enumerate(spans):
                if here:
                    texts[i] = cut_words(texts[i].encode(), here).decode()
            columns[text] = pa.array(texts, columns[text].type)
            if n_chars in columns:
                counts = columns[n_chars].to_pylist()
                columns[n_chars] = pa.array([len(t) if s else c for t, s, c in zip(texts, spans, counts)], columns[n_chars].type)
        return columns

    return _passes(docs, benchmark, text, item_id, item_text, window, block_bytes, finish)
