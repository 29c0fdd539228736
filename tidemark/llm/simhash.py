r"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z), cut into words ``[^\x20\x09-\x0D]+`` and 3-word shingles, repeats included; each shingle
is hashed by XXH64 (seed 42) and a fingerprint bit is set if it is set in over half of the hashes. Two fingerprints
link if they differ in at most ``radius`` bits. Every distinct fingerprint emits all variants within half the radius
(65 for radius 2): two fingerprints within the radius share a variant, so one shuffle on variants finds every link.
A variant's bucket holds at most as many fingerprints as a ball has points, whatever the size of a group of copies,
because copies of a fingerprint are folded into one row first.

Defined cases: a null text is an empty one; an empty text has fingerprint zero, which links like any other; fewer than
three words are hashed as one shingle; rows with the same id are rows of their own; null ids are never a class id
unless no member has one; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.llm import similarity
from tidemark.llm.common import BROADCAST_ROWS, LOWER, few_or_many, returning, text_bytes, word_blocks

SHINGLE = 3
SEED = 42
RADIUS = 2
# Links of a partition.
ROWS = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    ones, total, words = np.zeros(64, np.int64), 0, []
    for _, words in word_blocks(text.translate(LOWER), shingle - 1):
        runs = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), "<u8", len(runs))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(runs)
    if words and not total:  # the last block of so short a text holds all its words
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, fp bigint"

    def run(batches):
        for batch in batches:
            values = np.fromiter(map(fingerprint, text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return ids.mapInArrow(returning(run), schema)


def _masks(half: int) -> list[int]:
    """All 64-bit words with at most ``half`` bits set, as signed numbers."""
    masks, last = {0}, {0}
    for _ in range(half):
        last = {m | 1 << b for m in last for b in range(64)}
        masks |= last
    return sorted(m - (1 << 64) if m >> 63 else m for m in masks)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (lo, fp) between distinct fingerprints that connect exactly those within ``radius`` bits.

    The members of a bucket all lie within half the radius of its variant, hence within the radius of each other; each
    is linked to the bucket's smallest, and the link is verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: both sides emit variants within half of it")
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(radius // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    lowest = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.withColumn("lo", lowest).where("lo < fp")
    return pairs.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("fp"))) <= radius).select("lo", "fp").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over undirected ``edges`` (lo, fp), by label spreading with
    pointer jumping. Labels halve their distance each round; each round is written to the shared folder.

    Links and labels lie in as many partitions as their number asks for, and few labels are broadcast, so that the rounds
    of a small graph are not dealt over partitions, tasks and files meant for documents."""
    edges = cut(edges.select("lo", "fp"))
    parts = 1 + edges.count() // ROWS
    ends = F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("fp").alias("v")), F.struct(F.col("fp").alias("u"), F.col("lo").alias("v"))))
    both = edges.coalesce(parts).select(ends.alias("e")).select("e.u", "e.v")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
                 .select("node", F.least("node", "least").alias("label")).coalesce(parts))
    shared = F.broadcast if labels.count() <= BROADCAST_ROWS // 2 else lambda df: df
    while True:
        spread = (both.join(shared(labels.select(F.col("node").alias("u"), "label")), "u").groupBy(F.col("v").alias("node"))
                  .agg(F.min("label").alias("near")))
        near = spread.join(shared(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(near.join(shared(hop), "label", "left")
                  .select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")).coalesce(parts))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _classes(prints: DataFrame, distinct: DataFrame, labels: DataFrame) -> DataFrame:
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = rooted.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "label").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id reachable over links, the own included)."""
    prints = cut(fingerprints(docs, doc_id, text))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return _classes(prints, distinct, components(links(distinct, radius)))


def _open(nodes: DataFrame) -> DataFrame:
    """(row, label, band, first) of the buckets that hold several labels, with the first text of each."""
    named = nodes.select("row", "label", F.explode("bands").alias("band"))
    first = F.min(F.struct("row", "label"))
    buckets = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), first.alias("first"))
    return named.join(buckets.where("low < high").select("band", "first"), "band")


def _with_first(members: DataFrame) -> DataFrame:
    """Candidates (row, label, other_row, other_label): every text with the first one of each of its buckets."""
    pairs = members.select("row", "label", F.col("first.row").alias("other_row"), F.col("first.label").alias("other_label"))
    return pairs.where("label <> other_label").distinct()


def _each_other(members: DataFrame, held: DataFrame, similar: float) -> DataFrame:
    """Candidates (row, label, other_row, other_label): every two texts of a bucket that differ in label and may be ``similar``."""
    members = members.select("band", "row", "label").join(held.select("row", "size", "cells"), "row")
    others = members.select("band", *[F.col(c).alias(f"other_{c}") for c in ("row", "label", "size", "cells")])
    apart = F.expr("row < other_row and label <> other_label")
    return members.join(others, "band").where(apart & similarity.may_reach(similar)).select("row", "label", "other_row", "other_label").distinct()


def similar_components(texts: DataFrame, prints: DataFrame, edges: DataFrame, similar: float) -> DataFrame:
    """Components as of ``components`` over ``edges`` and links between the fingerprints of texts at least ``similar``.

    ``texts`` has (row, text), ``prints`` (row, fp), rows being unique. Texts that share a band are candidates, and every
    candidate whose labels differ when its turn comes is verified. There are two turns. The first compares each text
    with the first of each of its buckets, which is linear and joins a group of near copies, whatever its size. The
    second compares what is still apart: the pairs left are texts that share a band although they are less than
    ``similar``, and the few that their first text did not join. Of those, pairs whose cells show that they cannot be
    ``similar`` are never made.
    """
    sketches = similarity.sketches(texts).join(prints, "row")
    nodes = sketches.groupBy("fp", "digest").agg(F.min("row").alias("row"), F.first("bands").alias("bands"))
    nodes = cut(nodes.join(few_or_many(components(edges).withColumnRenamed("node", "fp")), "fp", "left").select(
        "row", "fp", F.coalesce("label", "fp").alias("label"), "bands"))
    held = None
    for star in (True, False):
        members = _open(nodes)
        if held is None:  # buckets that are open in the second turn were so in the first
            members = cut(members)
            rows = cut(members.select("row").distinct())
            held = cut(similarity.sets(texts.join(few_or_many(rows), "row", "left_semi")))
        pairs = cut(_with_first(members) if star else _each_other(members, held, similar))
        both = pairs.join(held.select("row", "shingles"), "row").join(
            held.select(F.col("row").alias("other_row"), F.col("shingles").alias("other_shingles")), "other_row")
        found = similarity.proved(both, similar).select(
            F.least("label", "other_label").alias("lo"), F.greatest("label", "other_label").alias("fp")).distinct()
        merged = components(found).select(F.col("node").alias("label"), F.col("label").alias("to"))
        nodes = cut(nodes.join(few_or_many(merged), "label", "left").select("row", "fp", F.coalesce("to", "label").alias("label"), "bands"))
    return nodes.select(F.col("fp").alias("node"), "label").distinct()


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
               similar: float | None = None) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the one of the smallest id (null last) and, among rows
    that share it, the first. With ``similar``, texts whose 5-word shingles are at least so similar link as well,
    however far their fingerprints are apart.

    Rows are numbered and written out, so that ids need not be unique, and what is kept is known by row number, so a large
    class does not meet in one task.
    """
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__row").alias("row"))
    keyed = rows.select(key.alias("key"), F.col(text).alias("text"))
    if similar is None:
        classes = near_duplicates(keyed, "key", "text", radius)
    else:
        prints = cut(fingerprints(keyed, "key", "text"))
        distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
        texts = rows.select(F.col("__row").alias("row"), F.col(text).alias("text"))
        labels = similar_components(texts, prints.select(F.col("doc_id.row").alias("row"), "fp"), links(distinct, radius), similar)
        classes = _classes(prints, distinct, labels)
    kept = cut(classes.where(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias("__row")))
    return rows.join(few_or_many(kept), "__row", "left_semi").select(docs.columns)
