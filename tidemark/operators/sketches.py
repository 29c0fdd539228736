"""Distinct counts and quantiles that can be stored and merged.

A table of sketches per hour (visitors and sessions) or per day (session durations) is written once; any longer period is
the union of its rows, so a report over a year reads 8 760 small rows per shop and hour series instead of the events, and
a late hour is merged instead of recomputed. Streams produce the same sketches (``streaming.stateful``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import cart_add, order_event, rollup_view
from tidemark.functions.timeutil import bucket
from tidemark.schema import SHOP

# Two to this power registers hold a distinct count; K is the size of a quantile sketch.
BITS, K = 12, 200


def distinct_error(bits: int = BITS) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / math.sqrt(1 << bits)


def rank_error(k: int = K) -> float:
    """Bound of the normalised rank error of a quantile, kept with 99 % confidence."""
    return 2.446 / k ** 0.9433


def visitor_sketch(bits: int = BITS) -> Column:
    return F.hll_sketch_agg("device_id", bits)


def hourly_sketches(ev: DataFrame, bits: int = BITS) -> DataFrame:
    """Per shop and hour: sketches of devices and sessions, and the counts that add up anyway."""
    return ev.groupBy(*SHOP, bucket(F.col("created_at"), "hour").alias("hour")).agg(
        visitor_sketch(bits).alias("visitor_sketch"), F.hll_sketch_agg("session_id", bits).alias("session_sketch"),
        F.count_if(rollup_view()).alias("pageviews"), F.count_if(cart_add()).alias("cart_adds"), F.count_if(order_event()).alias("purchases"),
        F.sum(F.coalesce("revenue_usd", "revenue", F.lit(0))).cast("bigint").alias("gross_revenue"))


_SUMS = ["pageviews", "cart_adds", "purchases", "gross_revenue"]


def merged(stored: DataFrame, interval: str, at: str = "hour") -> DataFrame:
    """Sketches of hours merged to days, weeks or months; the result can be stored and merged again. A sketch that is absent is left out."""
    sketches = [c for c in ("visitor_sketch", "session_sketch") if c in stored.columns]
    return stored.groupBy(*SHOP, bucket(F.col(at), interval).alias(interval)).agg(
        *[F.hll_union_agg(c).alias(c) for c in sketches], *[F.sum(c).alias(c) for c in _SUMS if c in stored.columns])


def counted(table: DataFrame) -> DataFrame:
    """The table with estimates in place of its sketches."""
    names = {"visitor_sketch": "unique_visitors", "session_sketch": "sessions"}
    return table.select(*[F.hll_sketch_estimate(c).alias(names[c]) if c in names else F.col(c) for c in table.columns])


def daily_durations(se: DataFrame, k: int = K) -> DataFrame:
    """Per shop and day on which sessions began: a quantile sketch of their durations, and their number."""
    return se.groupBy(*SHOP, bucket(F.col("started_at"), "day").alias("day")).agg(
        F.kll_sketch_agg_bigint("duration", k).alias("duration_sketch"), F.count(F.lit(1)).alias("sessions"))


def duration_quantile(stored: DataFrame, interval: str, q: float = 0.9, at: str = "day") -> DataFrame:
    """The quantile of durations in seconds over longer buckets, from the merged sketches."""
    out = stored.groupBy(*SHOP, bucket(F.col(at), interval).alias(interval)).agg(
        F.kll_merge_agg_bigint("duration_sketch").alias("s"), F.sum("sessions").alias("sessions"))
    return out.select(*SHOP, interval, "sessions", F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias("duration"))
