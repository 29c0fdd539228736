"""Sessions from idle gaps.

A chunk is a fixed slice of time no longer than the timeout, so a gap above the timeout can only lie
*between* two chunks of a device. Per-chunk minimum and maximum therefore decide every session
boundary: they are combined before the shuffle, and the only per-device ordering is over chunks,
whose number is bounded by elapsed time and not by how many events a device sent. No task ever
receives all events of one device.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import cart_add, order_event, overview_view
from tidemark.functions.timeutil import from_micros, micros, slot, ts, whole_seconds
from tidemark.schema import DEVICE, SHOP

TIMEOUT_SECONDS = 30 * 60

_FIRST = ["customer_id", "origin", "referrer", "referrer_name", "referrer_type", "os", "browser", "device", "country", "city"]


def chunk_of(col: Column, seconds: float) -> Column:
    return slot(micros(col), int(seconds * 1_000_000))


def session_key(start_micros: Column) -> Column:
    """Deterministic id from shop, device and first event."""
    parts = [F.col(c).cast("string") for c in ("shop_id", "device_id")]
    return F.sha2(F.concat_ws(":", *parts, start_micros.cast("string")), 256)


def number_spans(spans: DataFrame, timeout: float, keys: list[str] = DEVICE, closed: bool = True) -> DataFrame:
    """Session start of every chunk; a gap equal to the timeout extends (unless ``closed`` is off), a longer one opens a session."""
    order = Window.partitionBy(*keys).orderBy("_chunk")
    gap, limit = F.col("_lo") - F.lag("_hi").over(order), int(timeout * 1_000_000)
    opened = F.when(gap.isNull() | (gap > limit if closed else gap >= limit), F.col("_lo"))
    return spans.withColumn("_open", opened).withColumn(
        "_start", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def session_spans(ev: DataFrame, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """(device, chunk) → session start, for joining back to events."""
    at = micros(F.col("created_at"))
    spans = (ev.select(*DEVICE, chunk_of(F.col("created_at"), timeout).alias("_chunk"), at.alias("_at"))
             .groupBy(*DEVICE, "_chunk").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi")))
    return number_spans(spans, timeout).select(*DEVICE, "_chunk", "_start")


def sessionize(ev: DataFrame, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Events with ``session_id`` and ``session_start``, replacing any they carry."""
    rows = ev.drop("session_id", "session_start").withColumn("_chunk", chunk_of(F.col("created_at"), timeout))
    out = rows.join(session_spans(ev, timeout), [*DEVICE, "_chunk"])
    return (out.withColumn("session_id", session_key(F.col("_start")))
            .withColumn("session_start", from_micros(F.col("_start"))).drop("_chunk", "_start"))


def _summaries() -> list[Column]:
    """Per-chunk partials of a session. Struct minima and maxima order by (instant, id) first, so ties
    resolve the same way on every run."""
    seen = F.struct("created_at", "id")
    on_path = F.when(F.col("path") != "", F.struct(F.col("created_at"), F.col("id"), F.col("path")))
    usd = F.coalesce(F.col("revenue_usd"), F.lit(0))
    return [
        F.min(micros(F.col("created_at"))).alias("_lo"), F.max(micros(F.col("created_at"))).alias("_hi"),
        F.min(F.struct(seen.alias("at"), *_FIRST)).alias("_first"),
        F.min(on_path).alias("_in"), F.max(on_path).alias("_out"),
        F.count(F.lit(1)).alias("events_count"),
        F.count_if(overview_view()).alias("screen_views_count"),
        F.max(cart_add()).alias("has_cart_add"), F.max(order_event()).alias("has_purchase"),
        F.sum(F.when(order_event(), usd)).alias("total_revenue_usd"),
    ]


def fold_spans(spans: DataFrame) -> DataFrame:
    """Parts of sessions, which carry their session's ``_start``, as one part per session."""
    return spans.groupBy(*DEVICE, "_start").agg(
        F.max("_hi").alias("_hi"), F.min("_first").alias("_first"), F.min("_in").alias("_in"), F.max("_out").alias("_out"),
        F.sum("events_count").alias("events_count"), F.sum("screen_views_count").alias("screen_views_count"),
        F.max("has_cart_add").alias("has_cart_add"), F.max("has_purchase").alias("has_purchase"),
        F.coalesce(F.sum("total_revenue_usd"), F.lit(0)).cast("bigint").alias("total_revenue_usd"))


def folded_spans(ev: DataFrame, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """One part per session: events are reduced to chunk partials before the first shuffle and folded from those."""
    partials = ev.groupBy(*DEVICE, chunk_of(F.col("created_at"), timeout).alias("_chunk")).agg(*_summaries())
    return fold_spans(number_spans(partials, timeout))


def session_rows(folded: DataFrame) -> DataFrame:
    """Sessions from their folded parts."""
    start, end = from_micros(F.col("_start")), from_micros(F.col("_hi"))
    return folded.select(
        session_key(F.col("_start")).alias("session_id"), *DEVICE, start.alias("started_at"), end.alias("ended_at"),
        whole_seconds(start, end).alias("duration"),
        F.coalesce("_in.path", F.lit("")).alias("entry_path"), F.coalesce("_out.path", F.lit("")).alias("exit_path"),
        *[F.col(f"_first.{c}").alias(c) for c in _FIRST],
        "events_count", "screen_views_count", "has_cart_add", "has_purchase", "total_revenue_usd")


def sessions(ev: DataFrame, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """One row per session: extent, entry and exit path, first-touch dimensions, counts and markers."""
    return session_rows(folded_spans(ev, timeout))


def with_session_ids(ev: DataFrame) -> DataFrame:
    """``session_id`` of events that carry their ``session_start``."""
    return ev.withColumn("session_id", session_key(micros(F.col("session_start"))))


def inherit_referrer(ev: DataFrame, se: DataFrame) -> DataFrame:
    """Events with their session's first referrer; blanks of the first touch leave the event's own."""
    fields = ["referrer", "referrer_name", "referrer_type"]
    first = se.select(*DEVICE, "session_id", *[F.col(c).alias(f"_{c}") for c in fields])
    out = ev.join(first, [*DEVICE, "session_id"], "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(F.when(F.col(f"_{c}") != "", F.col(f"_{c}")), F.col(c)))
    return out.drop(*[f"_{c}" for c in fields])


_MARKER = [*DEVICE, "session_id", "customer_id", "origin", "referrer", "referrer_name", "referrer_type", "os", "browser",
           "device", "country", "city"]


def start_events(se: DataFrame) -> DataFrame:
    """``session_start`` 100 ms before each session's first event."""
    return se.select(*_MARKER, F.lit("session_start").alias("name"), F.col("entry_path").alias("path"),
                     F.create_map().cast("map<string,string>").alias("properties"),
                     (F.col("started_at") - F.expr("INTERVAL '0.1' SECOND")).alias("created_at"))


def end_events(se: DataFrame) -> DataFrame:
    """``session_end`` at each session's last event, with bounce flag and duration."""
    props = F.create_map(F.lit("__bounce"), (F.col("events_count") <= 1).cast("string"),
                         F.lit("__duration"), F.col("duration").cast("string"))
    return se.select(*_MARKER, F.lit("session_end").alias("name"), F.col("exit_path").alias("path"),
                     props.alias("properties"), F.col("ended_at").alias("created_at"))


def with_markers(ev: DataFrame, se: DataFrame) -> DataFrame:
    """Raw events plus the synthetic start and end events. Ids derive from the session."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("id", F.concat_ws(":", F.col("session_id"), F.col("name")))

    raw = ev.withColumn("id", F.col("id").cast("string"))
    return raw.unionByName(keyed(start_events(se)), True).unionByName(keyed(end_events(se)), True)


def closed(se: DataFrame, as_of: datetime, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Sessions idle for the whole timeout at ``as_of``."""
    return se.where(F.col("ended_at") <= ts(as_of - timedelta(seconds=timeout)))


def active_devices(ev: DataFrame, as_of: datetime, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Devices per shop with an event inside the timeout."""
    recent = ev.where(F.col("created_at").between(ts(as_of - timedelta(seconds=timeout)), ts(as_of)))
    return recent.groupBy(*SHOP).agg(F.count_distinct("device_id").alias("active_sessions"))
