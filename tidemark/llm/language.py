"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3, learned from a bounded sample of its texts and then frozen. The
code length of a byte is exact PPM (method C, with exclusions): the longest known context predicts it or escapes to the
next shorter one, where symbols seen in the longer one are excluded. As the symbols of a context are a subset of those
of its suffix, the excluded mass is one number per context, and the code length depends on four bytes alone: it is
computed once per distinct four-byte sequence of a chunk and summed per document.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is everything if nothing was learned;
equal code lengths go to the first language by name; ids may be null or repeated; only the named columns are read; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder

ORDER = 3
ROWS_PER_LANGUAGE = 1_500
MOST_LANGUAGES = 2_000
CHUNK = 1 << 20
PAD = b"\n" * ORDER
UNKNOWN = "und"


def grams(data: bytes) -> np.ndarray:
    """The four-byte sequence ending at each byte of a text, as a number; the text is preceded by line ends."""
    b = np.frombuffer(PAD + data, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


class ContextTree:
    """Frozen statistics of one language, from counts of four-byte sequences."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.grams, self.nodes = [], []
        for order in range(ORDER + 1):
            kept, inverse = np.unique(keys.astype(np.uint64) & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(inverse, counts, len(kept))
            context, node = np.unique(kept >> 8, return_inverse=True)
            total, distinct = np.bincount(node, n), np.bincount(node).astype(float)
            if order:  # what the next shorter context still predicts once this one's symbols are excluded
                shorter_keys, shorter_n = self.grams[-1]
                seen = np.bincount(node, shorter_n[np.searchsorted(shorter_keys, kept & ((1 << 8 * order) - 1))])
                suffix = np.searchsorted(self.nodes[-1][0], context & ((1 << 8 * (order - 1)) - 1))
                rest = self.nodes[-1][1][suffix] - seen, self.nodes[-1][2][suffix] - distinct
            else:
                rest = np.zeros(1), np.zeros(1)
            self.grams.append((kept, n))
            self.nodes.append((context, total, distinct, *rest))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte sequence after the three before it."""
        keys = keys.astype(np.uint64)
        out, open_, entered = np.zeros(len(keys)), np.ones(len(keys), bool), np.zeros(len(keys), bool)
        total, distinct = np.zeros(len(keys)), np.zeros(len(keys))
        for order in reversed(range(ORDER + 1)):
            known, n = self.grams[order]
            context, all_total, all_distinct, rest_total, rest_distinct = self.nodes[order]
            here = keys >> 8 & ((1 << 8 * order) - 1)
            node = np.minimum(np.searchsorted(context, here), len(context) - 1)
            exists = context[node] == here
            gram = keys & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            count = np.where(known[at] == gram, n[at], 0)
            total, distinct = np.where(entered, total, all_total[node]), np.where(entered, distinct, all_distinct[node])
            coded = open_ & exists & (count > 0)
            escaped = open_ & exists & (count == 0) & (distinct > 0)
            mass = np.log2(np.maximum(total + distinct, 1e-300))
            out[coded] += mass[coded] - np.log2(count[coded])
            out[escaped] += mass[escaped] - np.log2(distinct[escaped])
            open_ &= ~coded
            entered |= exists
            total, distinct = np.where(exists, rest_total[node], total), np.where(exists, rest_distinct[node], distinct)
        out[open_] += np.log2(max(1.0, 256 - self.nodes[0][2][0]))
        return out


class Languages:
    """Context trees by language and the code lengths of whole texts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        self.trees = [ContextTree(*counts[name]) for name in self.names]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out, keys, docs, size = np.zeros((len(texts), len(self.trees))), [], [], 0
        for doc, data in enumerate(texts):
            for at in range(0, len(data), CHUNK):  # a very long text is coded in pieces with their contexts
                part = grams(data[at:at + CHUNK])
                if at:
                    part[:ORDER] = grams(data[at - ORDER:at + ORDER])[ORDER:2 * ORDER][:len(part)]
                keys.append(part)
                docs.append(doc)
                size += len(part)
                if size >= CHUNK:
                    self._add(out, keys, docs)
                    keys, docs, size = [], [], 0
        self._add(out, keys, docs)
        return out

    def _add(self, out: np.ndarray, parts: list[np.ndarray], docs: list[int]) -> None:
        if not parts:
            return
        owner = np.repeat(np.array(docs, np.uint64), [len(p) for p in parts])
        both = np.sort(np.concatenate(parts).astype(np.uint64) << 32 | owner)
        key = both >> 32
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        which, doc = np.cumsum(fresh) - 1, (both & 0xFFFFFFFF).astype(np.int64)
        for column, tree in enumerate(self.trees):
            out[:, column] += np.bincount(doc, tree.bits(key[fresh])[which], len(out))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          rows_per_language: int = ROWS_PER_LANGUAGE) -> Languages:
    """Context trees from about ``rows_per_language`` whole texts a language, picked by a hash of ``key``."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key).alias("pick")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if (found := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{found} languages: every task holds a tree for each, {MOST_LANGUAGES} at most")
    share = F.lit(float(rows_per_language)) / F.col("n")
    sample = rows.join(F.broadcast(sizes), "lang").where(F.pmod("pick", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def run(batches):
        for batch in batches:
            found: dict[str, list] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").cast("binary").to_pylist()):
                found.setdefault(name, []).append(grams(value))
            for name, parts in found.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)],
                                                 ["lang", "gram", "n"])

    table = (sample.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram")
             .agg(F.sum("n").alias("n")).toArrow())
    names, keys, counts = (table.column(c).to_numpy() for c in ("lang", "gram", "n"))
    return Languages({name: (keys[names == name], counts[names == name].astype(float)) for name in set(names)})


def predict(docs: DataFrame, model: Languages, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the posterior of the predicted language, all being equally likely before), bits."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        languages = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            names, scores, lengths = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if languages.names and len(texts):
                bits = languages.code_lengths([t.encode() if good else b"" for t, good in zip(texts, lettered)])
                best = bits.argmin(1)
                lengths = np.where(lettered, bits.min(1), 0)
                scores = np.where(lettered, 1 / np.exp2(np.maximum(lengths[:, None] - bits, -1000)).sum(1), 0.0)
                names = [languages.names[b] if good else UNKNOWN for b, good in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores),
                                              pa.array(lengths)], ["doc_id", "lang_pred", "score", "bits"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double")


def training(docs: DataFrame, doc_id: str = "doc_id", parts: int = 4, held: int = 2) -> DataFrame:
    return docs.where(remainder(doc_id, parts) != held)
