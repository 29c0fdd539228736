"""Sessions kept up to date run by run.

Two tables partitioned by day: events with the session they belong to, and spans, one per session, which are partial
aggregates and can be merged. A run reads its new events and the spans they can touch: a span is touched if a new event
lies within the timeout of it, and since stored spans are further apart than that, merging never reaches any other. Spans
that grow or join are replaced together with the rest of their day; stored events are rewritten only where the start of
their session changed, which takes a late event. Day-by-day runs equal one run over everything, in whatever order the
events arrive.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.functions.timeutil import from_micros, micros
from tidemark.operators.sessions import TIMEOUT_SECONDS, chunk_of, fold_spans, folded_spans, session_key, session_rows, session_spans
from tidemark.schema import DEVICE, SHOP
from tidemark.sources.versioned import Versioned

RUN = "run"


def _day(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd").cast("int")


def _days(lo: int, hi: int) -> list[int]:
    """Days that an interval of microseconds touches."""
    first, last = (datetime.fromtimestamp(t / 1e6, UTC).date() for t in (lo, hi))
    return [int((first + timedelta(days=i)).strftime("%Y%m%d")) for i in range((last - first).days + 1)]


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, timeout: int = TIMEOUT_SECONDS):
        self.spark, self.timeout, self.reach = spark, timeout, timeout * 1_000_000
        self.events = Versioned(spark, f"{path}/events", "day")
        self.spans = Versioned(spark, f"{path}/spans", "day")

    def sessions(self) -> DataFrame | None:
        spans = self.spans.read()
        return None if spans is None else session_rows(spans.withColumnRenamed("_lo", "_start").drop("day"))

    def advance(self, new: DataFrame, run: int) -> None:
        """Take in the events of one run. Runs are numbered upwards; one that was broken off is run again with its number, and one
        that was completed is left out. An event whose id its shop and day have already is left out as well."""
        if int(self.spans.notes().get(RUN, -1)) >= run:
            return
        new = new.drop("session_id", "session_start", "day", RUN).withColumn("day", _day(F.col("created_at")))
        days = [r["day"] for r in new.select("day").distinct().collect()]
        new = new.dropDuplicates([*SHOP, "id", "day"])
        stored = self.events.read(days)
        if stored is not None:
            new = new.join(stored.where(F.col(RUN) < run).select(*SHOP, "id", "day"), [*SHOP, "id", "day"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            return
        fresh = cut(folded_spans(new.drop("day"), self.timeout).withColumnRenamed("_start", "_lo"))
        near = self._reached_days(fresh)
        before = self.spans.read(near)
        touched = None if before is None else cut(self._touched(before.drop("day"), fresh))
        pool = fresh if touched is None else fresh.unionByName(touched)
        named = cut(self._numbered(pool))
        self._store_events(new, named, run)
        merged = cut(fold_spans(named).withColumnRenamed("_start", "_lo").withColumn("day", _day(from_micros(F.col("_hi")))))
        self._store_spans(merged, touched, run)

    def _reached_days(self, fresh: DataFrame) -> list[str]:
        """Days whose spans may lie within the timeout of a new one. Of a day its last instant is known, of its spans the earliest is
        noted."""
        last = _day(from_micros(F.col("_lo") - self.reach)), _day(from_micros(F.col("_hi") + self.reach))
        new = fresh.groupBy(last[0].alias("a"), last[1].alias("b")).agg((F.max("_hi") + self.reach).alias("until")).collect()
        earliest = {d: int(n) for d, n in self.spans.notes().items() if d != RUN}
        return [d for d, lo in earliest.items() if any(r["a"] <= int(d) and lo <= r["until"] for r in new)]

    def _touched(self, spans: DataFrame, fresh: DataFrame) -> DataFrame:
        reach = fresh.select(*DEVICE, F.col("_lo").alias("_a"), F.col("_hi").alias("_b"))
        on = [spans[c] == reach[c] for c in DEVICE]
        return spans.join(reach, [*on, spans["_lo"] <= F.col("_b") + self.reach, spans["_hi"] >= F.col("_a") - self.reach], "left_semi")

    def _numbered(self, pool: DataFrame) -> DataFrame:
        """Spans with the start of the session they now belong to. They may overlap, so what counts is the latest end so far."""
        order = Window.partitionBy(*DEVICE).orderBy("_lo", "_hi")
        until = F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = F.when(until.isNull() | (F.col("_lo") - until > self.reach), F.col("_lo"))
        return pool.withColumn("_open", opened).withColumn(
            "_start", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")

    def _store_events(self, new: DataFrame, named: DataFrame, run: int) -> None:
        starts = named.select(*DEVICE, F.col("_lo"), F.col("_start")).distinct()
        # What a chunk belongs to is settled among spans, so that events themselves are joined once.
        chunks = session_spans(new, self.timeout).withColumnRenamed("_start", "_lo").join(starts, [*DEVICE, "_lo"])
        own = new.withColumn("_chunk", chunk_of(F.col("created_at"), self.timeout)).join(chunks, [*DEVICE, "_chunk"])
        rows = own.drop("_chunk").withColumn(RUN, F.lit(run))
        days = {r["day"] for r in new.select("day").distinct().collect()}
        moved = cut(named.where("_lo <> _start").select(*DEVICE, "_lo", "_hi", "_start"))
        for a, b in moved.groupBy((F.col("_lo") / 86_400_000_000).cast("int"), (F.col("_hi") / 86_400_000_000).cast("int")).agg(
                F.min("_lo").alias("a"), F.max("_hi").alias("b")).select("a", "b").collect():
            days.update(_days(a, b))
        stored = self.events.read(days)
        if stored is not None:
            old = stored.where(F.col(RUN) < run).withColumn("_lo", micros(F.col("session_start")))
            old = old.join(moved.select(*DEVICE, "_lo", "_start"), [*DEVICE, "_lo"], "left")
            rows = rows.unionByName(old.withColumn("_start", F.coalesce("_start", "_lo")), allowMissingColumns=True)
        rows = rows.withColumn("session_start", from_micros(F.col("_start"))).withColumn("session_id", session_key(F.col("_start")))
        self.events.replace(rows.drop("_start", "_lo").repartitionByRange("day", *SHOP, "created_at").sortWithinPartitions("day", *SHOP, "created_at"), days)

    def _store_spans(self, merged: DataFrame, touched: DataFrame | None, run: int) -> None:
        days = {str(r["day"]) for r in merged.select("day").distinct().collect()}
        rows = merged
        if touched is not None:
            days |= {str(r[0]) for r in touched.select(_day(from_micros(F.col("_hi")))).distinct().collect()}
        stored = self.spans.read(days)
        if stored is not None:
            gone = touched.select(*DEVICE, "_lo") if touched is not None else merged.select(*DEVICE, "_lo").limit(0)
            rows = rows.unionByName(stored.join(gone, [*DEVICE, "_lo"], "left_anti"))
        rows = cut(rows)
        earliest = {str(r["day"]): str(r["lo"]) for r in rows.groupBy("day").agg(F.min("_lo").alias("lo")).collect()}
        self.spans.replace(rows.repartitionByRange("day", *DEVICE), days, earliest | {RUN: str(run)})
