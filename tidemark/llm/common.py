"""Pieces shared by the corpus operators: reading tables, label splits, byte-level word cutting."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import configure

# Bytes that separate words where a contract names [^\x20\x09-\x0D]: exactly those that bytes.split() cuts at.
SPACE = re.compile(rb"[ \t-\r]")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK = 1 << 20
# Two megabytes of row numbers.
BROADCAST_ROWS = 1 << 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def few_or_many(keys: DataFrame) -> DataFrame:
    """Keys for a semi join with wide rows: up to ``BROADCAST_ROWS`` are broadcast, so that the wide rows stay where they are;
    more are joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over batches, after which the memory freed goes back to the system. Python workers are used again by later
    stages, and what their allocators keep counts on top of what those need."""
    @wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return task


def text_bytes(values) -> Iterator[bytes]:
    """UTF-8 of each text of an Arrow column, one at a time; null counts as empty."""
    return (v.as_py() or b"" for v in values.cast("binary"))


def texts_of(values) -> Iterator[str]:
    """Each text of an Arrow column, one at a time, so that a batch of texts is not held twice; null counts as empty."""
    return (v.as_py() or "" for v in values)


def word_blocks(data: bytes, carry: int, separator: re.Pattern = SPACE, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Words of a text in blocks of about ``size`` bytes, so that a very long text never becomes one list of words.

    Yields the index of the block's first word and its words; each block repeats the last ``carry`` words of the one
    before, so every run of ``carry + 1`` words lies in some block.
    """
    if len(data) <= size:
        yield 0, data.split()
        return
    at, first, tail = 0, 0, []
    while at < len(data):
        cut = separator.search(data, min(at + size, len(data)))
        end = cut.start() if cut else len(data)
        words = tail + data[at:end].split()
        yield first, words
        tail = words[-carry:] if carry else []
        first += len(words) - len(tail)
        at = end


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most_rows: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of about ``most_rows`` labelled training rows at most: those outside the held-out remainder, thinned
    by a hash of their id. Ids with several labels count once, with the largest, and of the texts of a repeated id the one
    that hashes lowest; null ids and labels do not train.

    The labels kept are bounded by ``most_rows``, so they may be broadcast; each task keeps one text for each before the
    shuffle, however many rows share the id.
    """
    rows = (labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
            .where(F.col("label").isNotNull() & (remainder("__id", parts) != held))
            .groupBy("__id").agg(F.max("label").alias("label")).where(F.col("__id").isNotNull()))
    share = min(1.0, most_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(rows), "__id").groupBy("__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return chosen.select("__id", "text", "label")


def set_aside(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with those of its columns renamed to ``source_…`` whose names a result needs."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        for column in [c for c in df.columns if c.lower() == name.lower()]:
            new = f"source_{column}"
            while new.lower() in taken:
                new = f"source_{new}"
            taken.add(new.lower())
            df = df.withColumnRenamed(column, new)
    return df
