"""The test tables seen as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.currency import DEFAULT_RATES
from tidemark.schema import DEVICE, configure

# One text serves Spark and DuckDB; {jk} reads the JSON field and {string} names the text type.
_COLUMNS = """event_id AS id, 1 AS tenant_id, user_id % 3 AS shop_id,
  concat('dev-', cast(user_id AS {string})) AS device_id,
  CASE WHEN user_id % 4 = 0 THEN concat('cust-', cast(user_id AS {string})) END AS customer_id,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                  WHEN 'signup' THEN 'checkout_step' ELSE event_type END AS name,
  CASE WHEN event_type IN ('purchase','click') THEN cast(round(value * 100) AS bigint) END AS revenue,
  CASE user_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'BDT' END AS currency,
  k AS product_id,
  CASE WHEN k % 17 = 0 THEN '' ELSE concat('/p/', cast(k % 10 AS {string})) END AS path,
  'https://shop.example.com' AS origin,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://www.google.com/' WHEN 2 THEN 'https://twitter.com/post'
             WHEN 3 THEN 'https://news.example.org/issue' ELSE 'https://www.reddit.com/r/deals' END AS referrer,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Google' WHEN 2 THEN 'Twitter' WHEN 3 THEN 'Newsletter' ELSE 'Reddit' END AS referrer_name,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'search' WHEN 3 THEN 'email' ELSE 'social' END AS referrer_type,
  CASE user_id % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' WHEN 2 THEN 'tablet' ELSE '' END AS device,
  CASE user_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE 'Firefox' END AS browser,
  CASE user_id % 5 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'iOS' WHEN 3 THEN 'Android' ELSE 'Linux' END AS os,
  CASE user_id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'BD' WHEN 4 THEN 'JP' ELSE '' END AS country,
  CASE user_id % 6 WHEN 0 THEN 'New York' WHEN 1 THEN 'London' WHEN 2 THEN 'Berlin' WHEN 3 THEN 'Dhaka' WHEN 4 THEN 'Tokyo' ELSE '' END AS city,
  cast(CASE user_id % 6 WHEN 0 THEN 40.7 WHEN 1 THEN 51.5 WHEN 2 THEN 52.5 WHEN 3 THEN 23.8 WHEN 4 THEN 35.7 END
    + CASE WHEN user_id % 6 < 5 THEN 0.01 * (k % 4) END AS double) AS latitude,
  cast(CASE user_id % 6 WHEN 0 THEN -74.0 WHEN 1 THEN -0.1 WHEN 2 THEN 13.4 WHEN 3 THEN 90.4 WHEN 4 THEN 139.7 END AS double) AS longitude,
  ts AS created_at
FROM (SELECT *, cast({jk} AS int) AS k FROM {events})
"""
CANONICAL = "\nSELECT " + _COLUMNS
# The raw columns, from which all others follow.
RAW = ["event_id", "ts", "user_id", "event_type", "value", "props"]

USD = """
SELECT *, cast(round(revenue / CASE currency WHEN 'EUR' THEN 0.89 WHEN 'GBP' THEN 0.77 WHEN 'BDT' THEN 123.0 ELSE 1.0 END)
               AS bigint) AS revenue_usd FROM ({canonical})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with USD cents and a one-entry property map."""
    return canonical(table(spark, sf_dir, "events"))


def canonical(raw: DataFrame, *more: str) -> DataFrame:
    """Canonical events of raw ones; columns named in ``more`` are passed on after theirs."""
    from pyspark.sql import functions as F

    from tidemark.functions.currency import to_usd

    text = "\nSELECT " + _COLUMNS.replace("ts AS created_at\n", ", ".join(["ts AS created_at", *more]) + "\n")
    ev = raw.sparkSession.sql(text.format(jk="get_json_object(props,'$.k')", string="string", events="{raw}"), raw=raw)
    return ev.withColumn("revenue_usd", to_usd(F.col("revenue"), F.col("currency"), DEFAULT_RATES)).withColumn(
        "properties", F.create_map(F.lit("k"), F.col("product_id").cast("string")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with the device and instant of the canonical ones: what has to be shuffled to find sessions."""
    return canonical(table(spark, sf_dir, "events"), *RAW).select(*DEVICE, "created_at", *RAW)


def duckdb_canonical() -> str:
    inner = CANONICAL.format(jk="json_extract_string(props,'$.k')", string="varchar", events="events")
    return USD.format(canonical=inner)
