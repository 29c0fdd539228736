"""Candidates and proof for texts whose sets of 5-word shingles have a Jaccard similarity of at least ``SIMILAR``.

A text is lower-cased (A-Z) and cut into words as in ``simhash``; a text of fewer than five words is one shingle. 120
minima of hashed shingles form 24 bands of five; texts that share a band are candidates, and a candidate counts only
if its exact similarity passes. A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 24 = 0.00007.
Texts without words have no shingles and no bands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, returning, text_bytes, word_blocks

SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND_ROWS = 24, 5
PIECE = 1 << 12
SETS = 256
# Cells over which the shingles of a text are spread, one bit each.
CELLS = 2048

_numbers = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64)
FACTORS, SHIFTS = _numbers[0] | np.uint64(1), _numbers[1]
PLACES = np.random.default_rng(21).integers(0, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_blocks(text: bytes):
    """Hashes of a text's shingles, repeats included, in blocks of bounded size."""
    some, words = False, []
    for _, words in word_blocks(text.translate(LOWER), SHINGLE - 1):
        if len(words) >= SHINGLE:
            some = True
            w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            n = len(w) - SHINGLE + 1
            yield _mix(sum(_mix(w[i:i + n] * PLACES[i]) * PLACES[i] for i in range(SHINGLE)))
    if words and not some:  # the last block of so short a text holds all its words
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)


def bands(text: bytes) -> list[int] | None:
    """Signed 64-bit names of the text's bands."""
    least = None
    for block in shingle_blocks(text):
        for at in range(0, len(block), PIECE):
            low = (block[at:at + PIECE, None] * FACTORS + SHIFTS).min(axis=0)
            least = low if least is None else np.minimum(least, low)
    if least is None:
        return None
    names = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return [n - (1 << 64) if n >> 63 else n for n in names]


def shingle_set(text: bytes) -> np.ndarray:
    blocks = [np.unique(b) for b in shingle_blocks(text)]
    return np.unique(np.concatenate(blocks)) if blocks else np.array([], np.uint64)


def cells(shingles: np.ndarray) -> np.ndarray:
    """One bit for each cell that holds a shingle, as signed 64-bit words."""
    held = np.zeros(CELLS, np.uint8)
    held[shingles % np.uint64(CELLS)] = 1
    return np.packbits(held).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def digest(text: bytes) -> int:
    """Signed 64-bit hash of a text; texts of equal bytes get the same."""
    n = xxhash.xxh3_64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


def sketches(texts: DataFrame) -> DataFrame:
    """(row, digest, bands) of the rows (row, text)."""
    def run(batches):
        for batch in batches:
            digests, names = [], []
            for text in text_bytes(batch.column("text")):
                digests.append(digest(text))
                names.append(bands(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(digests, pa.int64()), pa.array(names, pa.list_(pa.int64()))], ["row", "digest", "bands"])

    return texts.select("row", "text").mapInArrow(returning(run), "row bigint, digest bigint, bands array<bigint>")


def sets(texts: DataFrame) -> DataFrame:
    """(row, shingles, size, cells) of the rows (row, text): the sorted distinct shingle hashes, eight bytes each, their number
    and the cells they lie in."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SETS):
                some = batch.slice(at, SETS)
                found = [shingle_set(t) for t in text_bytes(some.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(map(len, found), pa.int64()),
                     pa.array(map(cells, found), pa.list_(pa.int64()))], ["row", "shingles", "size", "cells"])

    return texts.select("row", "text").mapInArrow(returning(run), "row bigint, shingles binary, size bigint, cells array<bigint>")


def may_reach(least: float) -> Column:
    """False only where the sets of (size, cells) and (other_size, other_cells) are certainly less than ``least`` similar: every cell
    that one of them holds and the other does not holds a shingle of one alone, and those are too many."""
    a, b = F.col("size"), F.col("other_size")
    apart = F.aggregate(F.zip_with("cells", "other_cells", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (F.least(a, b) >= F.greatest(a, b) * least) & (apart * (1 + least) <= (a + b) * (1 - least) + 1e-6)


def proved(pairs: DataFrame, least: float) -> DataFrame:
    """(label, other_label) of the pairs (label, shingles, other_label, other_shingles) at least ``least`` similar. Sets of too
    different sizes are not compared."""
    sizes = F.length("shingles"), F.length("other_shingles")
    pairs = pairs.where(F.least(*sizes) >= F.greatest(*sizes) * least)

    def run(batches):
        for batch in batches:
            both = zip(batch.column("shingles"), batch.column("other_shingles"))  # read where they lie, not copied
            keep = [jaccard(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair)) >= least for pair in both]
            yield batch.select(["label", "other_label"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("label", "shingles", "other_label", "other_shingles").mapInArrow(
        returning(run), "label bigint, other_label bigint")
