"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors become integers once and are stored in blocks: per dimension the integers that occur in the block, and for each
vector the places of its components among them. Each round tabulates, for every dimension, occurring integer and
centroid, the squared difference; distances are gathers from that table and sums. Sums per cluster are folded per task
before they are added up, so what reaches the driver is one number per cluster and dimension, however many copies of a
vector there are.

Defined cases: vectors that are null, have another number of components than ``width``, or hold a null or non-finite one
are left out; components beyond 2**27 after scaling are an error, since squared distances would not fit a long; equal
distances go to the smaller number; repeated rows are rows of their own; null ids hash as empty text, and rows with
equal hashes are ordered by their components; fewer vectors than centroids give fewer centroids; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

WIDTH, CENTROIDS, ROUNDS = 64, 8, 10
SCALE, PREFIX = 1024, "3:"
LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH,
             scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors kept, x being the floors of the scaled components."""
    c = F.col(vector).cast("array<double>")
    kept = vectors.where((F.size(c) == width) & finite(c))
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(c, lambda v: F.floor(v * scale)).alias("x"))


def blocks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(ids, values, sizes, codes) per Arrow batch: ``values`` lists the integers that occur, dimension by dimension,
    ``sizes`` how many each dimension has, ``codes`` the place among them of every component, dimension by dimension."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width).T
            if not x.size:
                continue
            if x.min() < -LIMIT or x.max() > LIMIT:
                raise OverflowError("scaled components must lie within 2**27 of zero")
            values, codes, base = [], np.empty(x.shape, np.int32), 0
            for i, row in enumerate(x):
                occurring, places = np.unique(row, return_inverse=True)
                codes[i] = places + base
                values.append(occurring)
                base += len(occurring)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("vec_id").to_pylist()], pa.list_(batch.column("vec_id").type)),
                 pa.array([np.concatenate(values).tobytes()]), pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                 pa.array([codes.tobytes()])], ["ids", "values", "sizes", "codes"])

    return rows.mapInArrow(run, f"ids array<{kind}>, values binary, sizes array<int>, codes binary")


def assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple]:
    """(ids, components, cluster, squared distance) of each block, by table gathers."""
    for ids, values, sizes, codes in zip(*(batch.column(n) for n in ("ids", "values", "sizes", "codes"))):
        values = np.frombuffer(values.as_py(), np.int64)
        codes = np.frombuffer(codes.as_py(), np.int32).reshape(centroids.shape[1], -1)
        dimension = np.repeat(np.arange(len(codes)), sizes.as_py())
        table = (values[:, None] - centroids.T[dimension]) ** 2
        distance = np.zeros((codes.shape[1], len(centroids)), np.int64)
        for places in codes:
            distance += table.take(places, axis=0)
        cluster = distance.argmin(axis=1)
        yield ids.values, values[codes], cluster, distance[np.arange(len(cluster)), cluster]


def first_centroids(rows: DataFrame, most: int = CENTROIDS, prefix: str = PREFIX) -> np.ndarray:
    """The vectors whose prefixed ids have the smallest hashes, in order."""
    name = F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    best = rows.orderBy(F.sha2(name.cast("binary"), 256), "x").limit(most).select("x").collect()
    return np.array([r["x"] for r in best], np.int64)


def next_centroids(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means of each cluster's vectors; empty clusters stay."""
    def run(batches: Iterator[pa.RecordBatch]):
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x, cluster, _ in assigned(batch, centroids):
                counts += np.bincount(cluster, minlength=len(counts))
                for c in np.unique(cluster):
                    sums[c] += x[:, cluster == c].sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(counts),
                                          pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = stored.mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>").where("n > 0")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    new = centroids.copy()
    for cluster, i, n, s in totals:
        new[cluster, i] = int(s) // n
    return new


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH,
            centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, prefix: str = PREFIX) -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (array of its
    cluster) and centroid_sha256. Rounds that would change nothing are left out."""
    spark, rows = vectors.sparkSession, integers(vectors, vec_id, vector, width, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    stored = cut(blocks(rows, width))
    now = first_centroids(rows, centroids, prefix).reshape(-1, width)
    for _ in range(rounds if len(now) else 0):
        before, now = now, next_centroids(stored, now)
        if (before == now).all():
            break

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, _, cluster, distance in assigned(batch, now):
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])

    found = stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r["s"]) for r in sums)
    about = spark.createDataFrame(
        [(r["cluster"], int(r["s"]), total, now[r["cluster"]].tolist(),
          hashlib.sha256(",".join(map(str, now[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
