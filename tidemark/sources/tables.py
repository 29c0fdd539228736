"""Batch tables: partitioned event storage, latest-version reads, retention, column mapping."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timeutil import Period, event_months, ts
from tidemark.schema import DEVICE, SHOP, row_hash

# Key and version columns of the tables that keep several versions of a row.
VERSIONED = {
    "sessions": ([*DEVICE, "session_id"], "ended_at"),
    "hourly_metrics": ([*SHOP, "hour"], "inserted_at"),
    "project_insights": ([*SHOP, "id"], "created_at"),
    "shopper_features": ([*DEVICE, "session_id"], "last_event_at"),
    "session_replay_chunks": ([*SHOP, "session_id", "chunk_index"], "started_at"),
}


def write_events(ev: DataFrame, path: str, mode: str = "append", finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Month-partitioned events, clustered so that tenant, shop and date filters skip row groups.
    The range split is on the sort key itself, so one large shop spreads over many files. ``finish`` adds columns that follow from
    others row by row, after the shuffle, which need not carry them; it keeps ``event_month``."""
    keys = ["event_month", *SHOP, "created_at"]
    out = ev.withColumn("event_month", F.date_format("created_at", "yyyyMM").cast("int"))
    out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    (finish(out) if finish else out).write.mode(mode).partitionBy("event_month").parquet(path)


def read_events(spark: SparkSession, path: str, period: Period | None = None, scope: Column | None = None) -> DataFrame:
    """Scan by tenant, shop and time. The month list prunes partitions; the rest is pushed down."""
    df = spark.read.parquet(path)
    if period is not None:
        df = df.where(F.col("event_month").isin(event_months(period)) & period.current(F.col("created_at")))
    return df if scope is None else df.where(scope)


def latest_by_key(df: DataFrame, keys: list[str], version: str, tie: str | None = None) -> DataFrame:
    """The newest row per key; of equal versions the largest ``tie``, then the row that hashes lowest. The rank filter is applied before the shuffle as well as after it, so
    a key with many versions sends one row per input task."""
    order = [F.col(version).desc_nulls_last()] + ([F.col(tie).desc_nulls_last()] if tie else []) + [row_hash(df)]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def read_latest(spark: SparkSession, path: str, table: str, tie: str | None = None) -> DataFrame:
    keys, version = VERSIONED[table]
    return latest_by_key(spark.read.parquet(path), keys, version, tie)


def unexpired(chunks: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Replay chunks still inside their retention."""
    return chunks.where(F.col("started_at") >= ts(as_of - timedelta(days=days)))


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_insights(cards: DataFrame, path: str) -> None:
    cards.write.mode("append").parquet(path)


def training_extract(features: DataFrame, n: int = 20_000) -> DataFrame:
    """The latest feature rows, newest first: the report's own row limit."""
    return features.orderBy(F.desc("last_event_at"), *DEVICE, "session_id").limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside values are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def import_events(df: DataFrame, columns: dict[str, str], defaults: dict[str, Column] | None = None,
                  projects: DataFrame | None = None) -> DataFrame:
    """Another product's event export as canonical events.

    ``columns`` maps canonical names to source columns and ``defaults`` supplies the rest. ``projects``
    is a ``(from, to)`` table that renames shops; rows of unmapped shops are left out.
    """
    out = df.select(*[F.col(src).alias(dst) for dst, src in columns.items()],
                    *[value.alias(name) for name, value in (defaults or {}).items()])
    if projects is not None:
        mapping = projects.select(F.col("from").cast("string").alias("_from"), F.col("to").cast("string").alias("_to"))
        out = (out.join(mapping, F.col("shop_id").cast("string") == F.col("_from"))
               .withColumn("shop_id", F.col("_to")).drop("_from", "_to"))
    return out


# Column names of the two file export formats.
IMPORT_COLUMNS = {
    "umami": {"id": "event_id", "shop_id": "website_id", "device_id": "session_id", "name": "event_name", "path": "url_path",
              "referrer": "referrer_domain", "browser": "browser", "os": "os", "device": "device", "country": "country",
              "city": "city", "created_at": "created_at"},
    "plausible": {"shop_id": "site_id", "device_id": "user_id", "name": "name", "path": "pathname", "referrer": "referrer",
                  "country": "country_code", "browser": "browser", "os": "operating_system", "created_at": "timestamp"},
}
