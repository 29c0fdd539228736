"""Quality classifier: supervised subword embeddings.

Features of a text are its words, its byte 3- and 4-grams and a mark for every word that repeats the one before it,
hashed into buckets. Each bucket has a learned vector; a document is the average of its features' vectors, and a softmax
over two outputs gives the score. Training is stochastic gradient descent in numpy on a bounded sample of labelled rows.
As output and average are linear, a bucket's share of the score is one number, so scoring gathers one number a feature.

Defined cases: a null or empty text has the average vector zero; nothing labelled gives the score 0.5; ids may be null
or repeated; only the id and text columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLOCK, text_bytes

BITS = 17
DIMENSIONS = 8
EPOCHS = 4
RATE = 0.5
TRAIN_ROWS = 3_000
SEED = 7

# Odd multipliers of the rolling hashes, taken from a rule: powers of the golden ratio's 32-bit fraction.
MULTIPLIERS = [pow(0x9E3779B1, k, 1 << 32) for k in range(1, 6)]
PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
AGAIN = 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(PRIME, BLOCK + 1), _powers(INVERSE, BLOCK + 1)


def features(data: bytes) -> np.ndarray:
    """Bucket of every feature of at most ``BLOCK`` bytes."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    wide, found = b.astype(np.uint32), []
    for size in (3, 4):
        if len(b) >= size:
            h = np.full(len(b) - size + 1, size, np.uint32)
            for j in range(size):
                h += wide[j:len(b) - size + 1 + j] * np.uint32(MULTIPLIERS[j])
            h ^= h >> np.uint32(15)
            found.append(h * np.uint32(MULTIPLIERS[4]) >> np.uint32(32 - BITS))
    inside = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * UP[:len(b)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * DOWN[starts]
        found.append(((h ^ h >> np.uint64(29)) * PRIME >> np.uint64(64 - BITS)).astype(np.uint32))
        found.append(np.full(int((h[1:] == h[:-1]).sum()), AGAIN, np.uint32))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def pieces(data: bytes) -> Iterator[bytes]:
    """A very long text in blocks; a feature across a border is counted in neither."""
    return (data[at:at + BLOCK] for at in range(0, max(1, len(data)), BLOCK))


def bag(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of a text, how often each occurs, and the number of features."""
    counts = np.zeros(1 << BITS, np.int64)
    for part in pieces(data):
        counts += np.bincount(features(part), minlength=1 << BITS)
    kept = np.flatnonzero(counts)
    return kept.astype(np.int32), counts[kept].astype(np.float32), int(counts.sum())


class Embeddings:
    """Vectors of the buckets and two output vectors."""

    def __init__(self, vectors: np.ndarray, outputs: np.ndarray, bias: np.ndarray):
        self.bias = float(bias[1] - bias[0])
        self.share = (vectors @ (outputs[:, 1] - outputs[:, 0])).astype(np.float32)

    def score(self, data: bytes) -> float:
        total, n = 0.0, 0
        for part in pieces(data):
            found = features(part)
            total, n = total + float(self.share[found].sum(dtype=np.float64)), n + len(found)
        return float(1 / (1 + np.exp(-np.clip(total / max(1, n) + self.bias, -50, 50))))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Embeddings:
    """Softmax regression on averaged vectors, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    outputs, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    bags = [bag(t) for t in texts]
    step, steps = 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            kept, counts, total = bags[i]
            now, step = rate * (1 - step / steps), step + 1
            share = counts / max(1, total)
            mean = share @ vectors[kept]
            logits = mean @ outputs + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = outputs @ error
            outputs -= now * np.outer(mean, error)
            bias -= now * error
            # A vector's gradient is its small share of the document; scaling by the document's size keeps rates alike.
            vectors[kept] -= (now * min(total, 400) ** 0.5) * np.outer(share, back)
    return Embeddings(vectors, outputs, bias)


def learn(sample: DataFrame) -> Embeddings | None:
    """Fit on a bounded sample of (text, label) rows, in an order that does not depend on partitioning."""
    rows = sample.orderBy(F.xxhash64("__id"), "__id", F.xxhash64("text")).select("text", "label").toArrow()
    labels = (rows.column("label").to_numpy() > 0).astype(int)
    return train(list(text_bytes(rows.column("text"))), labels) if len(labels) else None


def classify(docs: DataFrame, model: Embeddings | None, doc_id: str = "doc_id", text: str = "text",
             threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = shared.value
        for batch in batches:
            scores = [0.5 if known is None else known.score(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
