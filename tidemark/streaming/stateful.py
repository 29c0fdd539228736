"""Windowed and stateful stream operators over canonical events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.predicates import cart_add, order_event, overview_view, rollup_view
from tidemark.functions.timeutil import from_micros, micros, whole_seconds
from tidemark.operators.scoring import stream_scores
from tidemark.operators.sessions import session_key
from tidemark.operators.sketches import BITS, visitor_sketch
from tidemark.schema import DEVICE, SHOP


def _timed(ev: DataFrame, delay: str) -> DataFrame:
    """Event time as the watermark needs it; events later than ``delay`` behind the newest are left out by the operators below."""
    return ev.withColumn("event_time", F.col("created_at").cast("timestamp")).withWatermark("event_time", delay)


def unique_events(ev: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event id once, for at-least-once sources."""
    return _timed(ev, delay).dropDuplicatesWithinWatermark([*SHOP, "id"])


def hourly_rollup(ev: DataFrame, delay: str = "10 minutes", bits: int = BITS) -> DataFrame:
    """Complete hours per shop. Distinct counts are sketches: exact ones would keep every visitor in state. The sketch itself is a
    column, so stored hours merge to longer periods with ``operators.sketches.merged``, together with those of batch runs."""
    out = _timed(ev, delay).groupBy(*SHOP, F.window("event_time", "1 hour").alias("w")).agg(
        visitor_sketch(bits).alias("visitor_sketch"), F.count_if(rollup_view()).alias("pageviews"), F.count_if(cart_add()).alias("cart_adds"),
        F.count_if(order_event()).alias("purchases"), F.sum(F.coalesce("revenue_usd", "revenue", F.lit(0))).cast("bigint").alias("gross_revenue"))
    return out.select(*SHOP, F.col("w.start").cast("timestamp_ntz").alias("hour"), F.hll_sketch_estimate("visitor_sketch").alias("unique_visitors"), "visitor_sketch",
                      "pageviews", "cart_adds", "purchases", "gross_revenue")


def live_counts(ev: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes", bits: int = BITS) -> DataFrame:
    """Events and visitors per shop over sliding windows."""
    out = _timed(ev, delay).groupBy(*SHOP, F.window("event_time", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("events"), visitor_sketch(bits).alias("s"))
    return out.select(*SHOP, F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events",
                      F.hll_sketch_estimate("s").alias("visitors"))


_FIRST = ["customer_id", "origin", "referrer", "referrer_name", "referrer_type", "os", "browser", "device", "country", "city"]


def closed_sessions(ev: DataFrame, timeout: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions as soon as no event can extend them any more: idle for the timeout behind the watermark. Same columns as the batch table."""
    at = micros(F.col("created_at"))
    onpath = F.when(F.col("path") != "", F.struct(F.col("created_at"), F.col("id"), F.col("path")))
    out = _timed(ev, delay).groupBy(*DEVICE, F.session_window("event_time", timeout).alias("w")).agg(
        F.min(at).alias("_start"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.min(F.struct("created_at", "id", *_FIRST)).alias("_f"),
        F.min(onpath).alias("_in"), F.max(onpath).alias("_out"), F.count(F.lit(1)).alias("events_count"), F.count_if(overview_view()).alias("screen_views_count"),
        F.max(cart_add()).alias("has_cart_add"), F.max(order_event()).alias("has_purchase"),
        F.sum(F.when(order_event(), F.coalesce("revenue_usd", F.lit(0))).otherwise(F.lit(0))).alias("total_revenue_usd"))
    return out.select(
        session_key(F.col("_start")).alias("session_id"), *DEVICE, "started_at", "ended_at", whole_seconds(F.col("started_at"), F.col("ended_at")).alias("duration"),
        F.coalesce("_in.path", F.lit("")).alias("entry_path"), F.coalesce("_out.path", F.lit("")).alias("exit_path"), *[F.col(f"_f.{c}").alias(c) for c in _FIRST],
        "events_count", "screen_views_count", "has_cart_add", "has_purchase", "total_revenue_usd")


# --- running shopper features ----------------------------------------------------------------

VIEWS, ORDERS = ("page_view", "view_product"), ("purchase", "order_completed")
_SNAPSHOT = ["id", "at", "views", "carts", "cart_value_usd", "distinct_products", "dwell_seconds", "has_purchase"]
ROWS = 10_000


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """A key's rows of a micro-batch by (at, id), in blocks; ``columns`` begin with these two. One frame, which Spark bounds, is sorted
    as it is: most keys have few rows, and then each conversion costs more than the rows. More are held and sorted as columns, and
    only a block is a list of rows."""
    first, second = next(frames), next(frames, None)
    if second is None:
        yield sorted(zip(*(first[c].tolist() for c in columns)), key=lambda row: (row[0], row[1] is None, row[1]))
        return
    table = pa.concat_tables([pa.Table.from_pandas(frame[columns], preserve_index=False) for frame in chain([first, second], frames)])
    for block in table.sort_by([("at", "ascending"), ("id", "ascending")]).to_batches(max_chunksize=ROWS):
        yield list(zip(*(block.column(c).to_pylist() for c in columns)))


def use_rocksdb(df: DataFrame) -> None:
    """The state store that processors with states of their own need."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunningFeatures(StatefulProcessor):
    """One device's counters, and for each product the run of views in which it was last seen.

    A run of views ends when none follows within ``ttl``; numbering runs makes forgetting one a matter of the next number,
    however many products it held. A timer at the end of the idle time removes everything. A device's rows of a micro-batch
    are put in order, looked at once each and handed on in blocks. The state is asked only for products that the run at hand may
    have seen in an earlier micro-batch, and told only of those new in the run that is open at the end: each question is a turn
    between the worker and the JVM, dearer than a row.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "first bigint, last bigint, views bigint, carts bigint, usd bigint, distinct bigint, viewed bigint, run bigint, timer bigint")
        self.seen = handle.getMapState("seen", "product string", "run bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.totals.get()
        first, last, views, carts, usd, distinct, viewed, run, timer = state or (None, None, 0, 0, 0, 0, None, 0, None)
        stored = run if distinct else None  # the one run whose products the state may hold
        known, new = set(), set()  # products of the run met in this micro-batch, and those of them that the state does not hold
        for block in in_order(rows, ["at", "id", "name", "product_id", "usd"]):
            out = []
            for at, id_, name, product, value in block:
                before = run
                if last is None or at - last > self.ttl:
                    first, views, carts, usd, distinct, viewed, run = at, 0, 0, 0, 0, None, run + 1
                if viewed is not None and at - viewed > self.ttl:
                    distinct, viewed, run = 0, None, run + 1
                if run != before:
                    known, new = set(), set()
                if name in VIEWS:
                    views += 1
                    if product:
                        viewed = at
                        if product not in known:
                            known.add(product)
                            seen = self.seen.getValue((product,)) if run == stored else None
                            if seen is None or seen[0] != run:
                                new.add(product)
                                distinct += 1
                elif name == "add_to_cart":
                    carts, usd = carts + 1, usd + value
                elif name in ORDERS:
                    carts, usd = 0, 0
                last = max(at, last or at)
                out.append((id_, at, views, carts, usd, max(1, distinct), (last - first) // 1_000_000, name == "purchase"))
            yield pd.DataFrame({**dict(zip(DEVICE, key)), **dict(zip(_SNAPSHOT, zip(*out)))})
        for product in new:
            self.seen.updateValue((product,), (run,))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max((last + self.ttl) // 1000, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.totals.update((first, last, views, carts, usd, distinct, viewed, run, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def running_features(ev: DataFrame, ttl_seconds: int = 45 * 60, delay: str = "10 minutes") -> DataFrame:
    """Feature snapshot and scores after every event, from state kept per shop and device that lapses after the idle time.

    Events of a micro-batch are put in order by (time, id) before the state moves on, as in the batch operator. Events are handed over
    in order across micro-batches as far as the source keeps a device's order. The state lies in RocksDB, which this kind of state
    needs: the session is set to it.
    """
    use_rocksdb(ev)
    keys = [f.dataType.simpleString() for f in ev.select(*DEVICE).schema]
    id_type = ev.schema["id"].dataType.simpleString()
    out = ", ".join(f"{c} {t}" for c, t in zip(DEVICE, keys)) + (
        f", id {id_type}, at bigint, views bigint, carts bigint, cart_value_usd bigint, distinct_products bigint, dwell_seconds bigint, has_purchase boolean")
    rows = _timed(ev, delay).select(*DEVICE, "id", "event_time", micros(F.col("created_at")).alias("at"), "name",
                                    F.coalesce(F.col("product_id").cast("string"), F.lit("")).alias("product_id"), F.coalesce("revenue_usd", F.lit(0)).cast("bigint").alias("usd"))
    snapshots = rows.groupBy(*DEVICE).transformWithStateInPandas(RunningFeatures(ttl_seconds * 1_000_000), out, "append", "EventTime")
    return stream_scores(snapshots.select(*DEVICE, "id", from_micros(F.col("at")).alias("created_at"), *_SNAPSHOT[2:]))
