"""Toxicity under disguise: a noisy-channel decoder restores words before they are scored.

A character language model (four-letter sequences over letters, one class for letters beyond a-z and one for everything
else) is counted over every text of the corpus. A token that shows signs of disguise, digits or symbols in place of
letters, a letter three times or more in a row, or letters set apart by spaces, opens a lattice of what each character
may stand for; Viterbi decoding picks the cheapest path under channel costs and language model. The restored words and
their beginnings are then weighed by how much oftener labelled toxic texts hold them than others, with the lower bound
of that ratio, so that chance finds weigh nothing, and a logistic curve over three sums of these weights gives the score.

Defined cases: null and empty texts have no words and get the score of a text without evidence; nothing labelled gives
the score 0; equal paths go to the one with fewer changes, then to the first by text; ids may be null or repeated; only
the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.llm.common import BLOCK, returning, text_bytes, texts_of

CLASSES = 28
OTHER, GAP = 27, 0
TRAIN_ROWS = 8_000
CACHE = 100_000
BEGINNINGS = (4, 5)
CAUTION = 1.28

# What a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
CHANGE, DROP, SET_APART = 1.0, 0.5, 0.4

SYMBOLS = "".join(c for c in STANDS_FOR if not c.isdigit())
ENDS = re.compile(r"^[^\w@$€£|]+|[^\w]{2,}$|[^\w@$€£]$")
MIXED = re.compile(rf"[^\W\d_][\w{re.escape(SYMBOLS)}]*[\d{re.escape(SYMBOLS)}]|[\d{re.escape(SYMBOLS)}][^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SPELLED = re.compile(rf"(?<![^\W_])(?<![^\W_]')[^\W_](?:[ ._*-]+(?:[^\W_]|[{re.escape(SYMBOLS)}])){{2,}}(?![^\W_])")
JOINS = re.compile(r"([ ._*-]+)")
# Signs inside a token that stand for no letter.
PARTS = re.compile(rf"(?:[^\w{re.escape(SYMBOLS)}]|_)+")

# Classes of bytes: letters 1..26, first bytes of letters beyond them 27, bytes that continue a character 255, others 0.
BYTE_CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else OTHER if b >= 192 else 255 if b >= 128
                       else GAP for b in range(256)], np.uint8)


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of every four-class sequence over all texts, each between gaps: a table of fixed size, summed by Spark."""
    rows = docs.select(F.col(text).alias("text"))

    def run(batches):
        total = np.zeros(CLASSES ** 4, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for data in text_bytes(batch.column("text")):
                c = BYTE_CLASS[np.frombuffer(data, np.uint8)]
                held += [np.zeros(3, np.uint8), c[c < 255]]
                size += len(c)
                if size >= BLOCK:
                    total += _count(np.concatenate(held))
                    held, size = [], 0
            if held:
                total += _count(np.concatenate(held))
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["code", "n"])

    table = rows.mapInArrow(returning(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES ** 4, np.int64)
    out[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return out


def _count(classes: np.ndarray) -> np.ndarray:
    c = classes.astype(np.int32)
    code = ((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:]
    return np.bincount(code, minlength=CLASSES ** 4)


class LetterModel:
    """Cost in nats of a class after the three before it, interpolated over shorter contexts (Witten-Bell)."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape((CLASSES,) * 4).astype(np.float64)
        p = np.full(CLASSES, 1 / CLASSES)
        for order in range(4):
            m = n.sum(axis=tuple(range(3 - order)))
            total, kinds = m.sum(-1, keepdims=True), (m > 0).sum(-1, keepdims=True)
            p = np.where(total > 0, (m + kinds * p) / np.maximum(total + kinds, 1), p)
        self.cost = (-np.log(p)).astype(np.float32)


def letter_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else GAP


def _options(token: str) -> list[list[tuple[str, float]]]:
    """What each place of a token may stand for, with channel costs; a run of one letter is one place."""
    out, at = [], 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        if c.isalpha() and end - at >= 3:
            out.append([(c, DROP), (c * 2, DROP), (c * (end - at), 0.0)])
        elif c in STANDS_FOR:
            for _ in range(end - at):
                out.append([(s, CHANGE) for s in STANDS_FOR[c]] + [(c, 0.0)])
        else:
            out.append([(c * (end - at), 0.0)])
        at = end
    return out


def viterbi(options: list[list[tuple[str, float]]], model: LetterModel) -> str:
    """The cheapest reading. States are the last three classes; a letter read from a sign never costs less than the
    sign kept would, unless the language model prefers it."""
    states = {(GAP, GAP, GAP): (0.0, 0, "")}
    for choices in options:
        new: dict[tuple, tuple] = {}
        for (a, b, c), (cost, changes, text) in states.items():
            for reading, channel in choices:
                x, y, z, total = a, b, c, cost + channel
                for letter in reading:
                    k = letter_class(letter)
                    total += float(model.cost[x, y, z, k])
                    x, y, z = y, z, k
                found = (total, changes + (channel > 0), text + reading)
                if (x, y, z) not in new or found < new[x, y, z]:
                    new[x, y, z] = found
        states = new
    ends = [(cost + float(model.cost[(*state, GAP)]), changes, text) for state, (cost, changes, text) in states.items()]
    return min(ends)[2]


class Restorer:
    """Restored words of whole texts; what a token becomes is remembered for a bounded number of tokens."""

    def __init__(self, model: LetterModel, keep: int = CACHE):
        self.model, self.keep = model, keep
        self.known: dict[str, tuple[str, ...]] = {}

    def read(self, token: str) -> tuple[str, ...]:
        """A lower-case token without punctuation at its ends; one that shows signs of disguise is cut at inner signs that
        stand for no letter, and each part that shows them is restored."""
        core = ENDS.sub("", token)
        if not (STRETCHED.search(core) or MIXED.search(core)):
            return (core,) if core else ()
        parts = (ENDS.sub("", part) for part in PARTS.split(core))
        return tuple(viterbi(_options(p), self.model) if STRETCHED.search(p) or MIXED.search(p) else p for p in parts if p)

    def spelled(self, token: str) -> str:
        """A word spelled with single letters set apart: each join may be dropped or stay a gap."""
        options = []
        for i, c in enumerate(JOINS.split(token)):
            if i % 2:
                options.append([("", SET_APART), (c, 0.0)])
            else:
                options.append([(s, CHANGE) for s in STANDS_FOR.get(c, "")] + [(c, 0.0)])
        return viterbi(options, self.model)

    def forget(self) -> None:
        """What is remembered goes with its task: workers are used again by later stages, which need the memory."""
        self.known.clear()

    def words(self, text: str) -> list[str]:
        """Restored words of a text in order."""
        return [w for t in self.tokens(text) for w in self.restore(t)]

    def restore(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            found = self.known[token] = self.read(token)
        return found

    def tokens(self, text: str) -> list[str]:
        text = text.lower()
        if SPELLED.search(text):
            text = SPELLED.sub(lambda m: " " + self.spelled(m[0]) + " ", text)
        return text.split()

    def restored(self, text: str) -> str:
        """The text with its words restored."""
        return " ".join(self.words(text))


def word_features(word: str) -> list[str]:
    """A word and its beginnings, which name word families."""
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


class Scorer:
    """Weights of features and the curve over their sums."""

    def __init__(self, model: LetterModel, weights: dict[str, float], curve: np.ndarray):
        self.restorer, self.weights, self.curve = Restorer(model), weights, curve
        self.token_weight: dict[str, float] = {}

    def _weight(self, token: str) -> float:
        if len(self.token_weight) >= CACHE:
            self.token_weight.clear()
        found = max((self.weights.get(f, 0.0) for w in self.restorer.read(token) for f in word_features(w)), default=0.0)
        self.token_weight[token] = found
        return found

    def forget(self) -> None:
        self.token_weight.clear()
        self.restorer.forget()

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The largest weight of a word, the second largest, and the sum of the rest over the square root of their number."""
        tokens = set(self.restorer.tokens(text))
        known, found, new = self.token_weight, [], []
        for t in tokens:
            w = known.get(t)
            if w is None:
                new.append(t)
            elif w:
                found.append(w)
        found += [w for w in map(self._weight, new) if w]
        found.sort(reverse=True)
        top = (found + [0.0, 0.0])[:2]
        return top[0], top[1], sum(found[2:]) / math.sqrt(max(1, len(tokens)))

    def score(self, text: str) -> float:
        x = np.array([1.0, *self.evidence(text)])
        return float(1 / (1 + np.exp(-np.clip(x @ self.curve, -50, 50))))


def lower_bound(a: int, b: int, toxic: int, clean: int) -> float:
    """Lower bound of a feature's log ratio of document shares, from counts of toxic and clean texts."""
    ratio = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    return ratio - CAUTION * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def may_weigh(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """Whether ``fit_weights`` can give a feature of these counts a weight, all counted or one clean text left out.
    One that no toxic text holds is no evidence."""
    def bound(b):
        ratio = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
        return ratio - CAUTION * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    return (a > 0) & (F.greatest(bound(b), bound(F.greatest(b - 1, F.lit(0)))) > -1e-9)


def fit_weights(counts: dict[str, tuple[int, int]], toxic: int, clean: int, without: int | None = None) -> dict[str, float]:
    """Positive weights of features. ``without`` gives those that a text of this label would get had it not been counted
    itself, so that the curve is not fitted to what the weights know by heart."""
    out = {}
    for feature, (a, b) in counts.items():
        bound = lower_bound(a - (without == 1), max(0, b - (without == 0)), toxic, clean)
        if bound > 0:
            out[feature] = bound
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) / 100 + 1e-9 * np.eye(x.shape[1])
        move = np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w * len(x) / 100)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, sample: DataFrame, text: str = "text") -> Scorer | None:
    """Letter model from all of ``docs``; weights and curve from a bounded sample of (text, label) rows."""
    model = LetterModel(letter_counts(docs, text))
    session = docs.sparkSession.sparkContext
    letters = session.broadcast(model)

    def features(batches):
        restorer, found, sizes = Restorer(letters.value), {}, [0, 0]
        for batch in batches:
            for value, label in zip(texts_of(batch.column("text")), batch.column("label").to_pylist()):
                side = int(label > 0)
                sizes[side] += 1
                words = {w for t in set(restorer.tokens(value)) for w in restorer.restore(t)}
                for f in {f for w in words for f in word_features(w)}:
                    found.setdefault(f, [0, 0])[side] += 1
        found[""] = sizes
        names = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[f][1] for f in names], pa.int64()),
                                          pa.array([found[f][0] for f in names], pa.int64())], ["feature", "toxic", "clean"])

    counts = sample.select("text", "label").mapInArrow(returning(features), "feature string, toxic bigint, clean bigint")
    counts = cut(counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    size = counts.where("feature = ''").agg(F.sum("toxic"), F.sum("clean")).first()
    counts = counts.where((F.col("feature") == "") | may_weigh(F.col("toxic"), F.col("clean"), size[0] or 0, size[1] or 0))
    table = {f: (a, b) for f, a, b in zip(*(c.to_pylist() for c in counts.toArrow().columns))}
    toxic, clean = table.pop("", (0, 0))
    if not toxic + clean:
        return None
    others = session.broadcast([Scorer(model, fit_weights(table, toxic, clean, side), np.zeros(4)) for side in (0, 1)])

    def evidence(batches):
        for batch in batches:
            rows = np.array([others.value[int(label > 0)].evidence(text) for text, label in zip(
                texts_of(batch.column("text")), batch.column("label").to_pylist())]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T] + [batch.column("label").cast("double")],
                                             ["a", "b", "c", "y"])
        for scorer in others.value:
            scorer.forget()

    rows = sample.select("text", "label").mapInArrow(returning(evidence), "a double, b double, c double, y double").toArrow()
    values = np.column_stack([c.to_numpy() for c in rows.columns])
    values = values[np.lexsort(values.T)]
    return Scorer(model, fit_weights(table, toxic, clean), fit_curve(values[:, :3], (values[:, 3] > 0).astype(float)))


def score(docs: DataFrame, scorer: Scorer | None, doc_id: str = "doc_id", text: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = shared.value
        for batch in batches:
            scores = [0.0 if known is None else known.score(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
        if known is not None:
            known.forget()

    return rows.mapInArrow(returning(run), f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, scorer: Scorer | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        known = shared.value
        for batch in batches:
            clean = [known is None or known.score(t) < threshold for t in texts_of(batch.column(text))]
            yield batch.filter(pa.array(clean, pa.bool_()))
        if known is not None:
            known.forget()

    return docs.mapInArrow(returning(run), docs.schema)
