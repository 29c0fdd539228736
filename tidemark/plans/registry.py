"""Query registration: a name, a Spark callable and, where SQL can express it, the equivalent query."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import scratch
from tidemark.functions.timeutil import Period, event_months, resolve_period
from tidemark.operators.sessions import sessionize, sessions, with_session_ids
from tidemark.schema import configure
from tidemark.sources import testdata
from tidemark.sources.tables import read_events, write_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple[str, str, str, str], str] = {}
# Seconds the last build of each stored table took.
BUILD_SECONDS: dict[str, float] = {}

# The test events all fall in January 2024. A 12-hour session timeout gives them sessions of several events.
AS_OF = datetime(2024, 1, 31)
MONTH: Period = resolve_period(AS_OF, "30d")
HALF: Period = resolve_period(AS_OF, start=datetime(2024, 1, 16), end=AS_OF)
TIMEOUT = 12 * 3600


class Tables:
    """Inputs of a query, derived lazily from the files in one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.sf_dir, name)

    @cached_property
    def ev(self) -> DataFrame:
        """Canonical events without sessions."""
        return testdata.events(self.spark, self.sf_dir)

    @cached_property
    def _facts(self) -> DataFrame:
        """Raw events with the start of their session. Everything else follows row by row, so shuffles need not carry it."""
        return sessionize(testdata.facts(self.spark, self.sf_dir), TIMEOUT).drop("session_id")

    @cached_property
    def computed_evs(self) -> DataFrame:
        """Canonical events with session ids, sessionised by the query itself."""
        return with_session_ids(testdata.canonical(self._facts, "session_start"))

    @cached_property
    def computed_se(self) -> DataFrame:
        return sessions(self.ev, TIMEOUT)

    def _write_evs(self, path: str) -> None:
        write_events(self._facts, path, finish=lambda rows: with_session_ids(testdata.canonical(rows, "session_start", "event_month")))

    def _stored(self, name: str, build: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
        """A table of the shared folder, built once per application and input and read by all reports. Where no such folder is named,
        each report derives its table itself."""
        if not self.spark.conf.get("spark.checkpoint.dir", None):
            return getattr(self, f"computed_{name}")
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self._version, name)
        try:
            return read(_STORED[key])
        except (KeyError, AnalysisException):  # not built yet, or cleaned away
            path, begin = scratch(self.spark, name), time.perf_counter()
            build(path)
            _STORED[key], BUILD_SECONDS[name] = path, time.perf_counter() - begin
            return read(path)

    @cached_property
    def _version(self) -> str:
        """Changes with the files the stored tables are built from."""
        files = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        return str(files.distinct().agg(F.count(F.lit(1)), F.sum("file_size"), F.max("file_modification_time")).first())

    @cached_property
    def evs(self) -> DataFrame:
        """Canonical events with session ids, as stored by month."""
        return self._events(None)

    def during(self, period: Period) -> DataFrame:
        """``evs`` of the months that a period and the one before it touch; no other month's files are opened."""
        months = event_months(Period(period.prev_start, period.end))
        return self._events(months)

    def _events(self, months: list[int] | None) -> DataFrame:
        rows = self._stored("evs", self._write_evs, lambda path: read_events(self.spark, path))
        if "event_month" not in rows.columns:  # sessionised by the query itself
            return rows
        return (rows if months is None else rows.where(F.col("event_month").isin(months))).drop("event_month")

    @cached_property
    def se(self) -> DataFrame:
        """Sessions, as stored."""
        return self._stored("se", lambda path: self.computed_se.write.parquet(path), lambda path: self.spark.read.parquet(path))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, f"registered twice: {name}"
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _base(timeout: int) -> str:
    return f"""
ev AS ({testdata.duckdb_canonical()}),
gaps AS (
  SELECT *, CASE WHEN created_at - lag(created_at) OVER dev <= INTERVAL {timeout} SECOND THEN NULL ELSE epoch_us(created_at) END AS opened
  FROM ev WINDOW dev AS (PARTITION BY shop_id, device_id ORDER BY created_at, id)),
starts AS (
  SELECT * EXCLUDE (opened), max(opened) OVER (PARTITION BY shop_id, device_id ORDER BY created_at, id
                                               ROWS UNBOUNDED PRECEDING) AS start_us FROM gaps),
evs AS (
  SELECT * EXCLUDE (start_us), sha256(concat_ws(':', cast(shop_id AS varchar), device_id, cast(start_us AS varchar))) AS session_id,
    make_timestamp(start_us) AS session_start,
    row_number() OVER (PARTITION BY shop_id, device_id, start_us ORDER BY created_at, id) AS pos FROM starts),
se AS (
  SELECT tenant_id, shop_id, device_id, session_id, min(created_at) AS started_at, max(created_at) AS ended_at,
    cast(floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1000000) AS bigint) AS duration,
    coalesce(first(path ORDER BY created_at, id) FILTER (path <> ''), '') AS entry_path,
    coalesce(last(path ORDER BY created_at, id) FILTER (path <> ''), '') AS exit_path,
    max(CASE WHEN pos = 1 THEN customer_id END) AS customer_id, max(CASE WHEN pos = 1 THEN referrer END) AS referrer,
    max(CASE WHEN pos = 1 THEN referrer_name END) AS referrer_name, max(CASE WHEN pos = 1 THEN referrer_type END) AS referrer_type,
    max(CASE WHEN pos = 1 THEN os END) AS os, max(CASE WHEN pos = 1 THEN browser END) AS browser,
    max(CASE WHEN pos = 1 THEN device END) AS device, max(CASE WHEN pos = 1 THEN country END) AS country,
    max(CASE WHEN pos = 1 THEN city END) AS city,
    count(*) AS events_count, count(*) FILTER (name IN ('page_view', 'screen_view')) AS screen_views_count,
    bool_or(name = 'add_to_cart') AS has_cart_add, bool_or(name IN ('purchase', 'order_completed')) AS has_purchase,
    cast(coalesce(sum(CASE WHEN name IN ('purchase', 'order_completed') THEN coalesce(revenue_usd, 0) END), 0) AS bigint) AS total_revenue_usd
  FROM evs GROUP BY tenant_id, shop_id, device_id, session_id)"""


def sql(select: str, *ctes: str, timeout: int = TIMEOUT) -> str:
    """A SELECT over ``ev`` (events), ``evs`` (events with sessions) and ``se`` (sessions)."""
    return "WITH RECURSIVE " + ",\n".join([_base(timeout), *ctes]) + "\n" + select
