"""Tokens by distinct words, best two fit, lookup-table clustering and whitening against plain versions, and their
defined cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import centroids, two_fit, whitening
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import ByteTokens, WordTokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
HARD = ["", " ", "\n", "  \n x", "one", "x  y   z", "foo \nbar\n\nbaz \n q", "a\r\nb\tc \t d", "end  ", "  start", " x   y \nz",
        "..,a.b,c. .d ,e", "don't it's I'LL 'S 12345 a1b2", "é è  über alles — “quoted” ’s", "漢字 テスト слово и дело　x  y z",
        "<|endoftext|> a <|ENDOFTEXT|>x <|endoftext|>  b<|startoftext|>", "é É Å K İstanbul ΣΑΣ ﬁ", "x" * 5000 + " y",
        "Ünï a'S. it's,ok  x.\ty,\x1cz", "HẖH̱ ,.a..b'll.,", "٣.a.1,b2.c", "a\x00b \x00"]


@pytest.mark.parametrize("kind, path", [(WordTokens, WORD), (ByteTokens, BYTE)])
@pytest.mark.parametrize("block, keep", [(1 << 20, 1 << 20), (40, 30)])
def test_ids_equal_those_of_whole_texts(kind, path, block, keep):
    rng = random.Random(4)
    signs = ["a", "b ", " ", "\n", ".", ",", "é", " ", "'s", "12", "<|", " ", "A", "ß́", "\t"]
    texts = HARD + ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(400)]
    plain, words = Tokenizer.from_file(path), kind(path, keep)
    for _ in range(2):  # new words, then known ones
        for text, got in zip(texts, words.ids([t.encode() for t in texts], block)):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text


# --- 11 best two fit -------------------------------------------------------------------------------------------------

def plain_best_two_fit(lengths, capacity):
    """Lengths of each bin, one after the other."""
    left, bins = sorted(lengths), []
    while left:
        taken, room = [], capacity
        while fitting := [n for n in left if n <= room]:
            taken.append(fitting[-1])
            left.remove(fitting[-1])
            room -= fitting[-1]
        low, best = taken[-1], None
        for i in range(len(left)):
            for j in range(i):
                if low < left[i] + left[j] <= low + room and room:
                    best = max(best or (0, 0), (left[i] + left[j], left[i]))
        if best:
            left.append(taken.pop())
            taken += [best[1], best[0] - best[1]]
            for n in taken[-2:]:
                left.remove(n)
            left.sort()
        bins.append(sorted(taken))
    return bins


def test_best_two_fit_against_plain_bins():
    rng = random.Random(11)
    for _ in range(150):
        capacity = rng.randrange(1, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 40))]
        bins, offsets = two_fit.best_two_fit(np.array(lengths, np.int64), capacity)
        found = defaultdict(list)
        for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths)):
            assert o == sum(found[b])
            found[b].append(n)
        assert [sorted(found[b]) for b in sorted(found)] == plain_best_two_fit(lengths, capacity)


def check_pieces(rows, ids, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for doc, found in by_doc.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(-(-len(ids[doc]) // capacity)))
        assert all(length == capacity for _, _, length in found[1:])
        assert [s for _, s, _ in found] == [sum(n for _, _, n in found[:i]) for i in range(len(found))]
        assert sum(n for _, _, n in found) == len(ids[doc])
    for found in by_bin.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))]
        assert sum(n for _, n in found) <= capacity
    return len(by_bin)


def test_pack_of_odd_texts(spark):
    plain = Tokenizer.from_file(BYTE)
    texts = HARD + [None, "same", "same", "word " * 5000]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, piece string, sequence_id int, offset int")
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    rows = two_fit.pack(docs, BYTE, capacity=512).collect()
    assert check_pieces(rows, ids, 512) == math.ceil(sum(map(len, ids.values())) / 512)
    assert all(list(r.ids) == ids[r.doc_id][r.start:r.start + r.length] for r in rows)
    assert two_fit.pack(docs.limit(0), BYTE).collect() == []
    again = two_fit.pack(docs.union(docs).withColumn("doc_id", F.lit(None).cast("bigint")), BYTE, capacity=512).collect()
    assert sum(r.length for r in again) == 2 * sum(map(len, ids.values())) and {r.doc_id for r in again} == {None}


def test_best_two_fit_query(spark):
    plain, docs = Tokenizer.from_file(BYTE), spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {d.doc_id: plain.encode(d.text or "", add_special_tokens=False).ids + [0] for d in docs}
    bins = check_pieces(QUERIES["op11_best_two_fit"](spark, SF).collect(), ids, 2048)
    assert bins <= 1.01 * math.ceil(sum(map(len, ids.values())) / 2048)


# --- 12 centroids ----------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, cluster string, x int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], VECTORS)


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v)]
    name = {i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept}
    centres = [x for _, x in sorted(kept, key=lambda r: (name[r[0]], r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centres)]
    found = [(i, *reversed(nearest(x))) for i, x in kept]
    own = defaultdict(int)
    for _, j, q in found:
        own[j] += q
    return sorted(((i, j, q, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                   for i, j, q in found), key=str)


def test_clusters_against_plain_code(spark):
    rng = random.Random(12)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    rows += [(301, [0.5] * 4)] * 100 + [(None, [0.1, 0.2, 0.3, 0.4])] * 2  # a repeated row and null ids
    rows += [(400, None), (401, []), (402, [1.0] * 5), (403, [1.0, None, 1.0, 1.0]), (404, [float("nan")] * 4), (405, [float("-inf")] * 4)]
    for k, rounds in ((3, 4), (8, 10), (1, 0)):
        found = centroids.cluster(vectors(spark, rows).repartition(3), width=4, centroids=k, rounds=rounds)
        got = found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
        assert sorted(map(tuple, got), key=str) == plain_clusters(rows, k, rounds)
    few = centroids.cluster(vectors(spark, rows[:2]), width=4).collect()
    assert sorted(r.distance for r in few) == [0, 0] and {r.cluster for r in few} == {0, 1}
    assert centroids.cluster(vectors(spark, rows).limit(0), width=4).collect() == []
    with pytest.raises(Exception, match="2\\*\\*27"):
        centroids.cluster(vectors(spark, [(1, [1e6] * 4)]), width=4)


# --- 13 whitening ----------------------------------------------------------------------------------------------------

def check_whitening(rows, table, size, places):
    """Rows against a plain eigendecomposition; only for spectra without near ties."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (size - len(v)) for _, v in table])
    n, sums = len(x), x.sum(axis=0)
    c = (x * n - sums) / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    by = defaultdict(dict)
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        by[r.vec_id][r.component] = (r.whitened, int(r.deviation))
    assert len(rows) == n * places
    want = c @ vecs[:, :places] / np.sqrt(values[:places])
    got = np.array([[by[i][k][0] for k in range(1, places + 1)] for i, _ in table])
    signs = np.sign((want * got).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-8
    for (i, _), row in zip(table, x.tolist()):
        assert {d for _, d in by[i].values()} == {sum((n * v - int(s)) ** 2 for v, s in zip(row, sums))}


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(13)
    table = [(i, v) for i, v in enumerate((rng.standard_normal((400, 12)) * np.linspace(1, 3, 12)).tolist())]
    table += [(400, table[0][1]), (401, []), (402, [1.0, 2.0])]
    bad = [(500, None), (501, [None] * 12), (502, [float("inf")] * 12), (503, [float("nan")])]
    rows = whitening.whiten(vectors(spark, table + bad).repartition(100)).collect()
    check_whitening(rows, table, 12, 8)


def test_whitening_of_few_dimensions(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    check_whitening(whitening.whiten(vectors(spark, line)).collect(), line, 3, 1)
    with pytest.raises(Exception, match="2\\*\\*40"):
        whitening.whiten(vectors(spark, [(1, [1e30])]))


def test_whitening_query(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op13_whitening"](spark, SF).collect(), table, 64, 8)


def hadamard(m):
    return np.ones((1, 1)) if not m else np.block([[hadamard(m - 1), hadamard(m - 1)], [hadamard(m - 1), -hadamard(m - 1)]])


def spectra():
    rng = np.random.default_rng(1)
    q, u = np.linalg.qr(rng.standard_normal((300, 24)))[0], np.linalg.qr(rng.standard_normal((24, 24)))[0]
    yield rng.standard_normal((100, 24))
    yield rng.standard_normal((100, 24)) * np.logspace(0, -12, 24)
    yield rng.standard_normal((100, 24)) * np.logspace(-12, 0, 24)
    yield np.repeat(rng.standard_normal((100, 12)), 2, axis=1)
    yield 3 * hadamard(4)
    yield 3 * hadamard(4) + 1e-9 * rng.standard_normal((16, 16))
    yield q * np.array([5] * 5 + [4] * 3 + [1] * 16) @ u.T
    yield q * np.array([5 + 1e-7 * i for i in range(5)] + [4] * 3 + [1] * 16) @ u.T
    yield rng.standard_normal((3, 24))
    yield np.ones((5, 4))
    yield np.zeros((5, 4))


def test_singular_values_and_vectors():
    """Close and equal values, graded rows and low rank: values to rounding, vectors orthogonal with small residuals."""
    for a in spectra():
        width = a.shape[1]
        r = np.linalg.qr(a, mode="r")
        r = np.concatenate([r, np.zeros((width - len(r), width))])
        s = np.linalg.svd(r, compute_uv=False)
        diagonal, above, _ = whitening.bidiagonal(r)
        assert np.abs(np.sqrt(whitening.squared_singular_values(diagonal, above)) - s).max() <= 1e-13 * max(s[0], 1e-300)
        values, vecs = whitening.largest(r, 8)
        assert len(values) == min(8, (s > 1e-12 * s[0]).sum() if s[0] else 0)
        assert np.abs(vecs.T @ vecs - np.eye(len(values))).max(initial=0) < 1e-10
        assert np.abs(r.T @ (r @ vecs) - vecs * values ** 2).max(initial=0) <= 1e-12 * s[0] ** 2
