r"""Quality rules from a suffix array of a text's words.

Words are ``[^\x20\x09-\x0D]+``. Many documents are indexed together, each with word numbers of its own, so that common
prefixes never cross documents. The prefix intervals beside a suffix give the longest repeat that starts there; the
maximal ones are those that cannot be extended to the left. Their spans are united: ``covered_words`` of the text lie in
a repeat of at least ``least`` words, and ``longest_repeat`` is the length of the longest. A text is kept if it passes
the base rules (10 words or more, at most 20 % of words in 5-word windows found twice) and both limits of the method:
at most ``most_covered`` percent covered and no repeat of more than ``longest`` words.

Defined cases: null and empty texts have no words and are not kept; ids may be null or repeated; only the id and text
columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes
from tidemark.llm.suffix import SuffixArray

LEAST = 8
MOST_COVERED = 20
LONGEST = 40
WINDOW = 5
SHARD = 500_000

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def _simple(data: bytes) -> tuple[int, int, int]:
    """Code points in words, symbols, repeated lines."""
    inside = data.translate(None, WHITE)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(inside.decode()), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines))


def _united(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Places of 0..n that lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def maximal_repeats(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the repeats of ``least`` words or more that extend neither way."""
    longest = SuffixArray(symbols).longest()
    tail = np.concatenate([[False], longest[:-1] == longest[1:] + 1])
    starts = np.flatnonzero((longest >= least) & ~tail)
    return starts, longest[starts]


def measure(word_lists: list[list[bytes]], least: int = LEAST, window: int = WINDOW) -> np.ndarray:
    """(n_repeat_words, covered_words, longest_repeat) per document of a shard."""
    parts, top, sizes = [], len(word_lists), [len(w) for w in word_lists]
    for doc, words in enumerate(word_lists):
        number = {w: i for i, w in enumerate(dict.fromkeys(words), top)}
        parts += [np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.array([doc])]
        top += len(number)
    symbols, n = np.concatenate(parts), sum(sizes) + len(sizes)
    starts, lengths = maximal_repeats(symbols, min(least, window))
    ends = np.cumsum(np.array(sizes) + 1)
    begins = ends - np.array(sizes) - 1
    out = np.zeros((len(sizes), 3), np.int64)
    for column, size in ((0, window), (1, least)):
        enough = lengths >= size
        out[:, column] = np.add.reduceat(_united(starts[enough], lengths[enough], n), begins, dtype=np.int64)
    np.maximum.at(out[:, 2], np.searchsorted(ends, starts, "right"), lengths)
    return out


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
               most_covered: int = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            simple, repeats, shard, size, n_words = [], [], [], 0, []
            for data in text_bytes(batch.column("text")):
                words = data.split()
                simple.append(_simple(data))
                n_words.append(len(words))
                shard.append(words)
                size += len(words) + 1
                if size >= SHARD:
                    repeats.append(measure(shard, least))
                    shard, size = [], 0
            if shard:
                repeats.append(measure(shard, least))
            found = np.column_stack([n_words, np.array(simple).reshape(-1, 3), np.concatenate(repeats)]) if n_words else np.zeros((0, 7))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in found.T)],
                                             ["doc_id", *COUNTS])

    counts = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
