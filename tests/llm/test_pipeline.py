"""The corpus pipeline stage by stage against plain code, on documents with planted cases; near-duplicates of templates;
columns whose names clash with results."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import common, licenses, secrets, similarity, simhash, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b + c for a in ("ba", "co", "di", "fu", "le") for b in ("ran", "mel", "tos", "vik") for c in ("a", "en", "ir", "os", "um")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def classes(texts, least):
    """Classes over all pairs: fingerprints within two bits, or similar sets of shingles."""
    root, sets = list(range(len(texts))), [shingles(t) for t in texts]
    prints = [simhash.fingerprint(t.encode()) for t in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or jaccard(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_run_with_planted_cases(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 25)
    base = [prose(rng, 80) for _ in range(6)]
    near = [" ".join(b.split()[:70] + prose(rng, 3).split() + b.split()[73:]) for b in base]
    texts = [prose(rng, 60) for _ in range(150)]
    texts += [f"{prose(rng, 40)} you bloody moron {prose(rng, 5)} stupid moron" for _ in range(80)]  # 150 to 229 are toxic
    texts += base + near + base[:2]  # 230 to 243
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}", passage]  # 244, 245
    texts += [f"{prose(rng, 20)} password = hunter2hunter2 {prose(rng, 20)}", f"key AKIA{'A1' * 10} {prose(rng, 20)}"]  # 246, 247
    texts += [None, "", "", "one two three"]  # 248 to 251
    folder = str(tmp_path)
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(150 <= i < 230)) for i in range(230)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = []

    def noted(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns
                kept.append((name, {r.doc_id: r for r in out.collect()}))
            return out
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    rows = corpus_pipeline.run(spark, folder).collect()
    stages = dict(kept)
    assert list(stages) == ["toxicity", "simhash near-dedup", "benchmark decontamination", "secret scans"]

    clean = stages["toxicity"]
    assert set(clean) == set(range(len(texts))) - set(range(150, 230))
    ids = sorted(clean)
    found = classes([texts[i] or "" for i in ids], 0.8)
    unique = stages["simhash near-dedup"]
    assert set(unique) == {ids[c] for c in set(found)} and not {*range(236, 244)} & set(unique) and {*range(230, 236)} <= set(unique)
    without = stages["benchmark decontamination"]
    assert set(without) == set(unique)
    for i, r in without.items():
        assert r.text == unique[i].text or passage in unique[i].text
        assert passage not in (r.text or "") and (r.text is None or r.n_chars == len(r.text))
    assert without[244].text.split() == texts[244].replace(passage, "").split() and without[245].text.strip() == ""
    marked = stages["secret scans"]
    assert set(marked) == set(without)
    assert "hunter2" not in marked[246].text and "AKIA" not in marked[247].text and "[secret]" in marked[246].text
    assert all(r.text == without[i].text for i, r in marked.items() if i not in (246, 247))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: plain.encode(r.text or "", add_special_tokens=False).ids + [2] for i, r in marked.items()}
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.start] = list(r.ids)
    assert {i: [t for _, part in sorted(p.items()) for t in part] for i, p in got.items()} == tokens


def test_texts_of_one_template(spark):
    """Three hundred texts, every two of which are just similar enough, and as many that are not: the first join into one,
    the others stay."""
    rng = random.Random(6)
    shared, loose = prose(rng, 360).split(), prose(rng, 300).split()
    alike = [" ".join(shared + [f"u{i}x{j}" for j in range(30)]) for i in range(300)]
    apart = [" ".join(loose + [f"v{i}x{j}" for j in range(60)]) for i in range(300)]
    sets = [shingles(t) for t in (alike[0], alike[1], apart[0], apart[1])]
    assert jaccard(*sets[:2]) >= 0.8 and 0.6 < jaccard(*sets[2:]) < 0.8
    begin = time.time()
    kept = corpus_pipeline.without_near_duplicates(spark, documents(spark, alike + apart).repartition(8), "")
    ids, took = {r.doc_id for r in kept.collect()}, time.time() - begin
    assert ids == set(classes(alike + apart, 0.8)) and len(ids) > 290 and took < 60


def test_pairs_that_cannot_be_similar_are_not_made(spark):
    """Of two hundred texts of one template that differ too much, every two share a bucket and none is compared."""
    rng = random.Random(8)
    loose = prose(rng, 300).split()
    apart = [" ".join(loose + [f"v{i}x{j}" for j in range(60)]) for i in range(200)]
    texts = spark.createDataFrame(list(enumerate(apart)), "row bigint, text string")
    members = texts.select("row", F.col("row").alias("label"), F.lit(1).alias("band"))
    held = similarity.sets(texts)
    assert simhash._each_other(members, held, 0.8).count() == 0
    assert simhash._each_other(members, held, 0.6).count() == 200 * 199 // 2


def test_cells_refuse_no_similar_pair(spark):
    rng = random.Random(9)
    words = prose(rng, 400).split()
    texts = ["", "one", *(" ".join(words[:400 - 8 * i] + [f"w{i}x{j}" for j in range(3 * i)]) for i in range(12)), *(prose(rng, n) for n in (4, 5, 900, 9_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    held = similarity.sets(rows)
    both = held.crossJoin(held.select(*[F.col(c).alias(f"other_{c}") for c in held.columns]))
    for least in (0.5, 0.8, 0.95):
        may = {(r.row, r.other_row) for r in both.where(similarity.may_reach(least)).select("row", "other_row").collect()}
        sets = [similarity.shingle_set(t.encode()) for t in texts]
        similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a) and len(b) and similarity.jaccard(a, b) >= least}
        assert similar <= may and len(similar) > len(texts) - 2


def test_stages_leave_little_behind(spark):
    """Batches are bounded in every stage, and what a task of the last one has learnt of words goes with it."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        docs = documents(spark, ["x" * 500_000] * 40).coalesce(1)
        corpus_pipeline.STAGES[3][1](spark, docs, "")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n_chars": pa.array([batch.nbytes], pa.int64())})

        most = docs.mapInArrow(sizes, "n_chars bigint").agg(F.max("n_chars")).first()[0]
        assert most <= corpus_pipeline.BATCH + 500_100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    words = tokens.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    first = words.ids([b"some words kept"])[0].tolist()
    assert words.known
    words.forget()
    assert not words.known and not words.older and words.ids([b"some words kept"])[0].tolist() == first


def test_labels_lie_in_as_many_partitions_as_they_need(spark, monkeypatch):
    rng = random.Random(8)
    edges = [tuple(sorted(rng.sample(range(900), 2))) for _ in range(400)] + [(1000 + i, 1001 + i) for i in range(40)]
    least = {n: n for e in edges for n in e}
    for _ in edges:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    links = spark.createDataFrame(edges, "lo bigint, fp bigint")
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        labels = simhash.components(links)
        assert {r.node: r.label for r in labels.collect()} == least
        assert labels.rdd.getNumPartitions() == 1
        monkeypatch.setattr(simhash, "ROWS", 100)
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
        labels = simhash.components(links)
        assert {r.node: r.label for r in labels.collect()} == least
        assert labels.rdd.getNumPartitions() == 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_chain_inside_a_bucket(spark):
    """Texts that their bucket's first one does not reach, but each other."""
    rng = random.Random(7)
    first = prose(rng, 300).split()
    texts = [" ".join(first[:300 - 9 * i] + [f"c{j}" for j in range(9 * i)]) for i in range(12)]
    found = classes(texts, 0.8)
    assert len(set(found)) == 1 and jaccard(shingles(texts[0]), shingles(texts[-1])) < 0.6
    kept = simhash.keep_first(documents(spark, texts), similar=similarity.SIMILAR).collect()
    assert [r.doc_id for r in kept] == [0]


def test_recall_of_similar_pairs(spark):
    """All pairs of the documents of the smallest table against what the stage leaves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    found = classes([r.text or "" for r in rows], 0.8)
    kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()}
    assert kept == {rows[c].doc_id for c in set(found)}


# --- clashing names, repeated ids -------------------------------------------------------------------------------------

def test_license_columns_of_the_caller_stay(spark):
    full = licenses.full_texts()["MIT"][0]
    files = spark.createDataFrame(
        [("a/LICENSE", full, "f1", 1, "mine", 2), ("a/b/x.py", "x = 1", "f2", 3, "mine", 4), (None, "y", "f3", 5, "mine", 6), (None, None, "f4", 7, None, 8)],
        "path string, text string, folder string, part int, license string, source_license int")
    rows = {r.folder: r for r in licenses.scan(files).collect()}
    assert {k: (r.part, r.source_source_license, r.source_license) for k, r in rows.items()} == {
        "f1": (1, "mine", 2), "f2": (3, "mine", 4), "f3": (5, "mine", 6), "f4": (7, None, 8)}
    assert {k: r.license for k, r in rows.items()} == {"f1": "MIT", "f2": "MIT", "f3": None, "f4": None}


def test_secret_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "token: abcdef1", "b", 7), (2, "", "c", 8), (3, None, "d", 9), (3, "", None, None)],
                                 "doc_id int, text string, blob string, findings int")
    rows = secrets.secrets(docs).collect()
    assert sorted((r.doc_id, r.source_blob or "", r.source_findings or 0, len(r.findings)) for r in rows) == [
        (1, "b", 7, 1), (2, "c", 8, 0), (3, "", 0, 0), (3, "d", 9, 0)]


def test_sample_has_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "x"), (2, "x"), (None, "y"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1)], "doc_id bigint, quality int")
    rows = common.labelled_sample(docs, labels, "quality", 4, 5, 100).collect()
    assert sorted((r["__id"], r.label) for r in rows) == [(1, 1), (2, 1), (3, 0)]
    again = common.labelled_sample(docs.repartition(7), labels, "quality", 4, 5, 100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
