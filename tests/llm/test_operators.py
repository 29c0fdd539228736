"""Corpus operators against brute force, and their defined cases: nulls, empty and long texts, repeats, empty tables,
and columns whose names clash with those of the results."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import (chat, decontamination, language, licenses, packing, quality, repetition, secrets, simhash,
                          suffix, toxicity)
from tidemark.llm import common
from tidemark.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp string, start string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed=0):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


ODD = [None, "", " \n\t ", "one", "one two", prose(40_000, 3), "same text here", "same text here", "ÄÖ éß 漢字 ,.!"]


# --- shared pieces -------------------------------------------------------------------------------------------------

def test_word_blocks_cover_every_run(monkeypatch):
    data = prose(500).encode()
    whole = data.split()
    runs = set()
    for first, words in common.word_blocks(data, 2, size=100):
        assert words == whole[first:first + len(words)]
        runs |= {first + i for i in range(len(words) - 2)}
    assert runs == set(range(len(whole) - 2))


def test_suffix_array_and_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = rng.integers(0, 40)
        s = np.concatenate([rng.integers(1, 4, n), [0]])
        array = suffix.SuffixArray(s)
        order = sorted(range(n + 1), key=lambda i: list(s[i:]))
        assert list(array.order) == order
        for k, c in enumerate(array.common()[1:], 1):
            a, b = s[order[k - 1]:], s[order[k]:]
            assert c == next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        words = rng.integers(0, 4, n)
        index, size = suffix.FMIndex(words, rate=4), rng.integers(1, 5)
        phrases = rng.integers(1, 5, (10, size))
        which, low, high = index.intervals(phrases)
        got = {(int(p), int(x)) for p, a, b in zip(which, low, high) for x in index.locate(np.arange(a, b))}
        assert got == {(p, i) for p in range(10) for i in range(n - size + 1) if list(words[i:i + size]) == list(phrases[p])}


# --- 1 quality -----------------------------------------------------------------------------------------------------

def test_quality(spark):
    good = [prose(60, i) for i in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in prose(60, i).split()) for i in range(80)]
    docs = documents(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    sample = common.labelled_sample(docs, labels, "quality", 4, 2, 1000)
    assert {zlib.crc32(str(r[0]).encode()) % 4 for r in sample.select("__id").collect()} == {0, 1, 3}
    model = quality.learn(sample)
    rows = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert len(rows) == 160 + len(ODD) and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i].predicted == (i < 80) for i in held) >= 0.95 * len(held)
    assert rows[160].score == rows[161].score  # null and empty
    assert quality.classify(docs.limit(0), model).collect() == []
    assert {r.score for r in quality.classify(docs, None).collect()} == {0.5}


def test_quality_score_is_the_averaged_embedding():
    rng = np.random.default_rng(0)
    vectors, outputs, bias = rng.normal(size=(1 << quality.BITS, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    text = prose(50).encode()
    logits = vectors[quality.features(text)].mean(0) @ outputs + bias
    assert quality.Embeddings(vectors, outputs, bias).score(text) == pytest.approx(1 / (1 + math.exp(logits[0] - logits[1])), abs=1e-5)


# --- 2 simhash -----------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint); smallest id reachable."""
    parent = {f: f for _, f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in list(parent):
        for b in list(parent):
            if a < b and (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        least[root(f)] = min(i, least.get(root(f), i))
    return sorted((i, f"{f:016x}", least[root(f)]) for i, f in prints)


def near_copies():
    rng, out = random.Random(5), []
    for base in range(6):
        words = prose(300, 100 + base).split()
        for _ in range(12):
            copy = words[:]
            copy[rng.randrange(300)] = rng.choice(WORDS)
            out.append(" ".join(copy))
    return out + [prose(30, i) for i in range(40)]


def test_simhash(spark):
    texts = near_copies() + ODD
    docs = documents(spark, texts)
    rows = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, rows)) == plain_components([(i, plain_fingerprint(t)) for i, t in enumerate(texts)])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in rows})
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    doubled = documents(spark, ["a b c d", "a b c d", None], [7, 7, None])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(doubled).collect()) == [(-1, -1), (7, 7), (7, 7)]
    assert simhash.keep_first(doubled).count() == 2
    nameless = documents(spark, [prose(40, 1), prose(40, 2), prose(40, 1), None, ""], [None, None, None, 3, 3])
    assert sorted(map(str, (r.text for r in simhash.keep_first(nameless).collect()))) in (
        sorted(map(str, [prose(40, 1), prose(40, 2), x])) for x in (None, ""))


def test_simhash_links_and_chains(spark):
    chain = [0]
    for b in range(0, 60, 2):
        chain.append(chain[-1] | 3 << b)
    far = [(1 << 63) | 0x5555 << 20, -5 & (1 << 64) - 1]
    fps = [f - (1 << 64) if f >> 63 else f for f in chain + far]
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    labels = {r.node: r.label for r in simhash.components(links).collect()}
    assert {labels[f] for f in fps[:31]} == {0} and not set(fps[31:]) & set(labels)
    with pytest.raises(ValueError):
        simhash.links(links, radius=3)


def test_fingerprint_of_a_long_first_word():
    run = "f" * (common.BLOCK + 9)
    for text in (f"{run} a b c", f"{run} {prose(60)}", f"one {run} {prose(60)}", f"{run} {run} a", f"{run} {run}", run, f"{run} a \n"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_near_duplicate_stage_links_similar_texts(spark):
    import corpus_pipeline

    rng, words = random.Random(8), [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(30):
        base = rng.choices(words, k=200)
        texts += [" ".join(base), " ".join(base[:90] + rng.choices(words, k=8) + base[98:])]
    shingles = lambda t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}
    pairs = [(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert all(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8 for a, b in pairs)
    assert sum((plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 2 for a, b in pairs) > 15
    half = texts[0].split()[:100] + rng.choices(words, k=100)
    docs = documents(spark, texts + [" ".join(half), "one two", None, "", "one two"])
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 60, 2), 60, 61, 62]


# --- 3 language ----------------------------------------------------------------------------------------------------

def plain_bits(counts, data):
    n = [defaultdict(Counter) for _ in range(4)]
    for key, v in zip(*counts):
        b = int(key).to_bytes(4, "big")
        for order in range(4):
            n[order][b[3 - order:3]][b[3]] += v
    total, data = 0.0, b"\n\n\n" + data
    for i in range(3, len(data)):
        excluded = set()
        for order in (3, 2, 1, 0):
            seen = n[order].get(data[i - order:i])
            if not seen:
                continue
            left = {s: v for s, v in seen.items() if s not in excluded}
            mass, kinds = sum(left.values()), len(left)
            if data[i] in left:
                total -= math.log2(left[data[i]] / (mass + kinds))
                break
            if kinds:
                total -= math.log2(kinds / (mass + kinds))
            excluded |= set(seen)
        else:
            total += math.log2(256 - len(excluded))
    return total


def test_language_code_lengths(monkeypatch):
    counts = np.unique(language.grams(prose(300, 1).encode()), return_counts=True)
    model = language.Languages({"x": (counts[0].astype(np.int64), counts[1].astype(float))})
    texts = [prose(40, 2).encode(), "Ünseen ÿ 漢".encode(), b"", b"a"]
    monkeypatch.setattr(language, "CHUNK", 50)
    assert model.code_lengths(texts)[:, 0] == pytest.approx([plain_bits(counts, t) for t in texts])


def test_language(spark):
    other = "uno dos tres cuatro cinco seis siete ocho nueve diez".split()
    texts = [prose(30, i) for i in range(40)] + [" ".join(random.Random(i).choices(other, k=30)) for i in range(40)]
    rows = [(i, t, "en" if i < 40 else "es") for i, t in enumerate(texts)] + [(99, "x", None), (None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(language.training(docs))
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(found[i].lang_pred == ("en" if i < 40 else "es") and 0.5 <= found[i].score <= 1 for i in range(80))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(documents(spark, [None, "", "12 ?", "x"]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] in ("en", "es")
    nothing = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).collect() == []


# --- 4 decontamination ---------------------------------------------------------------------------------------------

def plain_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, held = cut(text), set(), set()
    for item, content in items:
        known = cut(content)
        windows = {tuple(known[i:i + window]) for i in range(max(1, len(known) - window + 1))} if known else set()
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    held.add(str(item))
    return len(words), len(hit), sorted(held)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontamination(spark, block_bytes):
    items = [(i, prose(25, 50 + i)) for i in range(6)] + [(10, "Rare SHORT item"), (11, None), (12, "")]
    texts = [prose(30, 7) + " " + items[0][1][20:110] + ". " + prose(9, 1), items[1][1], items[2][1].upper().replace(" ", ", "),
             "a rare-short?item! b", "rare short", prose(80, 9)] + ODD + [prose(20_000, 4) + " " + items[3][1]]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontamination.find(docs, bench, block_bytes=block_bytes).collect()
    for r in rows:
        n_hit = sum(s.end - s.start for s in r.hit_spans)
        assert (r.n_words, n_hit, r.hit_items) == plain_hits(r.text, items)
    assert {r.doc_id for r in rows if r.hit_items} >= {0, 1, 2, 3, len(texts) - 1}
    clean = {r.doc_id: r for r in decontamination.remove(docs, bench, block_bytes=block_bytes).collect()}
    assert len(clean) == len(texts) and clean[1].text == "" and clean[5].text == texts[5] and clean[6].text is None
    assert all(plain_hits(r.text, items)[1] == 0 for r in clean.values())
    assert clean[0].n_chars == len(clean[0].text) and clean[0].text.startswith(prose(30, 7)[:100])
    assert all(not r.hit_items for r in decontamination.find(docs, bench.limit(0)).collect())
    assert decontamination.find(docs.limit(0), bench).collect() == []
    with pytest.raises(ValueError):
        decontamination.find(docs.withColumn("n_words", F.lit(1)), bench)


# --- 5 secrets -----------------------------------------------------------------------------------------------------

def plain_secrets(text):
    found = []
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for order, (kind, pattern, group, least) in enumerate([("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
                                                          ("hex", re.compile("[0-9a-f]+"), 0, 24)]):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


SECRETS = ["password=token:abcdefgh", "Ünï TOKEN: 'abc', secret=\"abcdef\" 漢 passwd:x", "AKIA" + "A1" * 8 + " AKIASHORT", "0" * 24 + "g" + "f" * 23,
           "api_key=" + "ab12" * 8, "pi 1234567890abcdef1234567890api_key=zzzzzz", "password=abcdef" * 300, "ſecret=abcdef"]


def test_secrets(spark, tmp_path):
    texts = SECRETS + ODD
    docs = documents(spark, texts)
    folder = str(tmp_path / "ledger")
    found = secrets.secrets(docs.select("doc_id", "text", F.lit("x").alias("findings")), folder)
    rows = {r.doc_id: r.s for r in found.select("doc_id", secrets.described(F.col("findings")).alias("s")).collect()}
    assert rows == {i: plain_secrets(t) for i, t in enumerate(texts)}
    first = spark.read.parquet(folder).count()
    assert first == len({t or "" for t in texts})
    secrets.secrets(documents(spark, texts[:3] + ["new password=abcdefg"]), folder)
    assert spark.read.parquet(folder).count() == first + 1  # only the unseen blob was scanned
    secrets.update(docs, folder, rules=secrets.RULES[:1])
    assert spark.read.parquet(folder).select("rule_version").distinct().count() == 2
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[0].text == "password=token:abcdefgh" and clean[4].text == "[secret]" and clean[len(SECRETS)].text is None
    assert clean[5].text == "pi [secret]" and clean[5].n_chars == 11
    assert all(plain_secrets(r.text) == "" for r in clean.values())
    assert secrets.redact(docs.limit(0)).collect() == []


# --- 6 repetition --------------------------------------------------------------------------------------------------

def plain_repetition(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def covered(size):
        seen, out = Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)), set()
        for i in range(len(words) - size + 1):
            if seen[tuple(words[i:i + size])] > 1:
                out |= set(range(i, i + size))
        return len(out)

    longest = 0
    while longest < len(words) and covered(longest + 1):
        longest += 1
    lines, dup, old = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in old
            old.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, covered(5), covered(least),
            longest if longest >= 5 else 0)


def test_repetition(spark, monkeypatch):
    texts = [t for t in ODD if len(t or "") < 1000] + ["a b " * 20, "x #1\ny\nx #1\n \n", prose(120, 1) + " " + prose(30, 1), prose(15), "the " * 9]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in repetition.repetition(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][c] for c in repetition.COUNTS) == plain_repetition(t, repetition.LEAST), t
    assert not rows[0].kept and rows[0].base_failed and rows[len(texts) - 2].kept
    assert repetition.repetition(docs.limit(0)).collect() == []


# --- 7 chat --------------------------------------------------------------------------------------------------------

def test_chat(spark):
    rows = [(1, 2, "assistant", "a\\ </turn> \\l ### x"), (1, 0, "user", "<more>"), (1, 1, "user", None), (1, 3, "assistant", "#### \\"),
            (None, 0, None, "only"), (2, 0, "ro:le\n", "\n:\n"), (2, 0, "ro:le\n", "\n:\n"), (3, 0, "assistant", ""), (4, 0, "user", "漢 😀"), (4, 1, "assistant", "😀\\é"), (4, 2, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("formatted", F.lit(1))
    shown = chat.format_conversations(turns)
    found = {r.conv_id: r for r in shown.withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_runs")), "")).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[conv].append((role or "", text or ""))
    assert {k: [tuple(t) for t in r.back] for k, r in found.items()} == want
    assert found[1].formatted.count("### user:") == 1 and found[1].loss == "a\\ </turn> \\l ### x#### \\"
    for r in found.values():
        assert sum(r.loss_runs) == len(r.formatted)
        ends = np.cumsum(r.loss_runs)
        under = [r.formatted[ends[i - 1]:ends[i]] for i in range(1, len(ends), 2)]
        assert "".join(under).replace("\\\\", "\0").replace("\\l", "<").replace("\\h", "#").replace("\0", "\\") == r.loss
    assert chat.format_conversations(turns.limit(0)).collect() == []


# --- 8 licences ----------------------------------------------------------------------------------------------------

def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x", "plain words"), ("a/b/c/y", None), ("z/q", "# Licensed under the Apache License, Version 2.0.\n" + prose(50)),
            ("z/r", ""), ("top", "words"), (None, "Licensed under CC BY-NC 4.0."), ("a/b/c/y", "another"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3.")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license_x", F.lit(1))
    found = defaultdict(list)
    for r in licenses.scan(files).collect():
        found[r.path].append((r.own_license, r.own_kind, r.license, r.inherited_from))
    assert found["a/LICENSE"] == [("MIT", "file", "MIT", None)] and found["a/b/x"] == [(None, None, "MIT", "a")]
    assert found["a/b/c/y"] == [(None, None, "GPL-3.0", "a/b/c")] * 2 and found["z/q"] == [("Apache-2.0", "header", "Apache-2.0", None)]
    assert found["z/r"] == found["top"] == [(None, None, None, None)] and found[None][0][0] == "CC-BY-NC-4.0"
    assert licenses.scan(files.limit(0)).collect() == []


def test_license_cosine_against_plain():
    model = licenses.Templates({"the": 90, "license": 3}, 100, licenses.TEMPLATES)
    idf = dict(zip(model.number, model.idf))
    vector = lambda text: {w: n * idf.get(w, model.other) for w, n in Counter(licenses.words(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for text in ("released under an MIT license", "licensed under the gnu license version 3 foo foo", "nothing here"):
        v, best = vector(text), (0.0, None)
        for name, t in model.rows:
            w = vector(t)
            best = max(best, (sum(v.get(k, 0) * w[k] for k in w) / norm(v) / norm(w), name), key=lambda x: x[0])
        got = model.best(licenses.words(text), 1e-9)
        assert (got is None and best[0] == 0) or (got[0], pytest.approx(got[1])) == (best[1], best[0])


def test_full_license_texts(spark):
    full = licenses.full_texts()
    rows = [(f"{name}/LICENSE", f"Copyright (c) 2020 Some One\n\n{t}") for name, (t,) in full.items()]
    rows += [(f"{name}/src/x", "plain words") for name in full]
    # Cut short and with other words around it; short source files that are only a header; a wrapped header.
    rows += [("cut/COPYING", full["GPL-2.0"][0][:-3000]), ("s/a.py", "# SPDX-License-Identifier: MIT\nx = 1"), ("s/b.py", "y = 2"),
             ("w/c.py", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n"
              "# Public License as published by the Free\n# Software Foundation, either version 3 of the License, or\n#\n" + prose(200))]
    files = spark.createDataFrame(rows, "path string, text string")
    found = {r.path: (r.own_license, r.own_kind, r.license, r.inherited_from) for r in licenses.scan(files).collect()}
    for name in full:
        assert found[f"{name}/LICENSE"] == (name, "file", name, None)
        assert found[f"{name}/src/x"] == (None, None, name, name)
    assert found["cut/COPYING"][:2] == ("GPL-2.0", "file")
    assert found["s/a.py"][:2] == ("MIT", "header") and found["s/b.py"] == (None, None, None, None)
    assert found["w/c.py"][:2] == ("GPL-3.0", "header")


def test_license_words_are_counted_as_they_are_compared(spark):
    files = spark.createDataFrame([("The License.",), ("licence-x license",), (None,)], "text string")
    assert licenses.frequencies(files, {"license", "licence-x", "the"}) == ({"license": 2, "licence-x": 1, "the": 1}, 3)


# --- 9 packing -----------------------------------------------------------------------------------------------------

def test_fill_finds_the_closest_total():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 9))]
        counts, longest = Counter(lengths), max(lengths)
        rest = sorted(lengths)[:-1]
        best = max(t for t in (longest + sum(x for i, x in enumerate(rest) if m >> i & 1) for m in range(1 << len(rest))) if t <= 20)
        taken = packing.fill(dict(counts), 20)
        assert sum(k * n for k, n in taken.items()) == best and all(n <= counts[k] for k, n in taken.items())


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ODD + [prose(n, n) for n in (5, 900, 3000, 9000, 50, 50)]
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = packing.pack(documents(spark, texts), TOKENIZER).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert list(r.ids) == ids[r.doc_id][r.start:r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for found, whole in [(p, len(ids[d])) for d, p in pieces.items()] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == whole if whole else at <= 4096 and (at == 4096 or at & at - 1 == 0)
    assert set(pieces) == set(ids)
    assert packing.pack(documents(spark, texts).limit(0), TOKENIZER).collect() == []


# --- 10 toxicity ---------------------------------------------------------------------------------------------------

def letters(*texts):
    h = []
    for t in texts:
        c = toxicity.BYTE_CLASS[np.frombuffer(t.encode(), np.uint8)]
        h += [np.zeros(3, np.uint8), c[c < 255]]
    return toxicity.LetterModel(toxicity._count(np.concatenate(h)))


def test_letter_model_is_a_distribution(spark):
    counts = toxicity.letter_counts(documents(spark, ODD + [prose(50)]))
    cost = toxicity.LetterModel(counts).cost
    assert np.exp(-cost.astype(float)).sum(-1) == pytest.approx(np.ones((28, 28, 28)), abs=1e-4)
    assert toxicity.letter_counts(documents(spark, ODD).limit(0)).sum() == 0


def test_viterbi_against_all_paths():
    import itertools

    model = letters(prose(200), "idiot moron")
    for token in ("1d10t", "m0r0n", "7aau", "aaaa1", "x$!"):
        options, best = toxicity._options(token), None
        for path in itertools.product(*options):
            x, total = (0, 0, 0), 0.0
            for reading, channel in path:
                total += channel
                for c in reading:
                    k = toxicity.letter_class(c)
                    total += float(model.cost[(*x, k)])
                    x = (x[1], x[2], k)
            total += float(model.cost[(*x, 0)])
            best = min(best or (1e9,), (total, "".join(r for r, _ in path)))
        got = toxicity.viterbi(options, model)
        assert got == best[1]


def test_disguise_beside_other_signs():
    restorer = toxicity.Restorer(letters(*[prose(200), "stupid head idiot moron scum stupid idiot moron you ass"] * 5))
    for text, want in (("1d10t's", "idiot s"), ("m0r0n,1d10t", "moron idiot"), ("you/1d10t", "you idiot"), ("_1d10t_", "idiot"),
                       ("<b>1d10t</b>", "b idiot b"), ("stuuupid's", "stupid s"), ("m0r0n-head", "moron head"), ('"i d i o t"', "idiot"),
                       ("(m o r o n)", "moron"), ("i d i o t;", "idiot"), ("m  o  r  o  n", "moron"), ("a s s", "ass"),
                       ("don't", "don't"), ("well-known", "well-known")):
        assert restorer.restored(text) == want


def test_features_of_one_toxic_text_may_weigh(spark):
    cases = [(a, b) for a in range(1, 6) for b in range(5)]
    table = spark.createDataFrame(cases, "a bigint, b bigint")
    for toxic, clean in ((400, 7600), (3000, 5000)):
        kept = {tuple(r) for r in table.where(toxicity.may_weigh(F.col("a"), F.col("b"), toxic, clean)).collect()}
        assert kept == {c for c in cases if any(toxicity.fit_weights({"x": c}, toxic, clean, side) for side in (None, 0, 1))}
    sample = spark.createDataFrame([(prose(9, i), 0) for i in range(95)] + [("rare " + prose(9, i), 1) for i in range(1)]
                                   + [(f"idiot {prose(9, i)}", 1) for i in range(4)], "text string, label int")
    assert toxicity.learn(sample, sample).weights.get("rare", 0) > 0


def test_toxicity(spark):
    rng = random.Random(1)
    clean = [prose(40, i) for i in range(150)]
    nasty = []
    for i in range(150):
        words = prose(40, 1000 + i).split()
        for w in rng.sample(["idiot", "moron", "scum"], 2):
            words[rng.randrange(40)] = w
        nasty.append(" ".join(words))
    hidden = [prose(20, 1) + " 1d10t " + prose(20, 2) + " m0r0n", prose(10, 3) + " i d i o t " + prose(10, 4) + " scuuuum"]
    texts = clean + nasty + hidden + ODD
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(300)] + [(None, 1)], "doc_id bigint, toxic int")
    scorer = toxicity.learn(docs, common.labelled_sample(docs, labels, "toxic", 5, 0, 10_000))
    rows = {r.doc_id: r for r in toxicity.score(docs, scorer).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(rows[i].predicted == (i >= 150) for i in held) >= 0.95 * len(held)
    assert rows[300].predicted == rows[301].predicted == 1 and rows[302].score == rows[303].score < 0.5
    kept = toxicity.reject(docs, scorer)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}
    assert scorer.restorer.restored("You 1d10t, i d i o t!") == "you idiot idiot"
    assert toxicity.learn(docs, common.labelled_sample(docs, labels.limit(0), "toxic", 5, 0, 10)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), scorer).collect() == []


# --- queries -------------------------------------------------------------------------------------------------------

COLUMNS = {"op1": "doc_id held_out score predicted", "op2": "doc_id fingerprint component_id", "op3": "doc_id held_out lang_pred score",
           "op4": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5": "doc_id n_assign n_access n_hex base_sha256 spans",
           "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
           "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8": "doc_id license",
           "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10": "doc_id held_out score predicted",
           "op11": "doc_id piece start length ids_crc32 sequence_id offset",
           "op12": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
           "op13": "vec_id component n deviation whitened explained identity_error"}


def test_columns_of_every_query(spark):
    for name, fn in QUERIES.items():
        assert set(COLUMNS[name.split("_")[0]].split()) <= set(fn(spark, "/root/testdata/sf0.001").columns), name


def test_simhash_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op2_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, rows)) == plain_components([(i, plain_fingerprint(t)) for i, t in texts])


def test_native_plan(spark):
    plan = QUERIES["op5_secrets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert hashlib.sha256(b"").hexdigest()


def test_toxicity_forgets_with_its_task():
    """What a scorer remembers of tokens does not stay in a worker that later stages use."""
    import numpy as np

    from tidemark.llm import toxicity

    scorer = toxicity.Scorer(toxicity.LetterModel(np.ones(toxicity.CLASSES ** 4, np.int64)), {"bad": 2.0}, np.array([0.0, 1.0, 0.0, 0.0]))
    before = scorer.score("a b4d bad word")
    scorer.restorer.restore("b4d")
    assert scorer.token_weight and scorer.restorer.known
    scorer.forget()
    assert not scorer.token_weight and not scorer.restorer.known
    assert scorer.score("a b4d bad word") == before
