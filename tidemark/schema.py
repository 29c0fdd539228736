"""Canonical tables.

``created_at`` and every other instant is ``timestamp_ntz`` holding UTC wall-clock time, so a
range filter compares like with like and reaches the parquet scan. Money is integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOP = ["tenant_id", "shop_id"]
DEVICE = [*SHOP, "device_id"]

NIL_UUID = "00000000-0000-0000-0000-000000000000"

EVENT_DDL = """
id string, tenant_id string, shop_id string, name string, device_id string, session_id string,
customer_id string, revenue bigint, revenue_usd bigint, currency string, product_id string,
cart_id string, order_id string, path string, origin string, referrer string,
referrer_name string, referrer_type string, os string, browser string, device string,
country string, city string, latitude double, longitude double,
properties map<string,string>, created_at timestamp_ntz
"""

SESSION_DDL = """
session_id string, tenant_id string, shop_id string, device_id string, customer_id string,
started_at timestamp_ntz, ended_at timestamp_ntz, duration bigint, entry_path string,
exit_path string, events_count bigint, screen_views_count bigint, has_cart_add boolean,
has_purchase boolean, total_revenue bigint, total_revenue_usd bigint, referrer_name string,
referrer_type string, os string, browser string, device string, country string, city string
"""

REPLAY_DDL = """
tenant_id string, shop_id string, session_id string, chunk_index bigint,
started_at timestamp_ntz, ended_at timestamp_ntz, events_count bigint,
is_full_snapshot boolean, payload string
"""


def configure(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Joins must hash on all their keys: (shop, device, chunk) may not fall back to (shop, device).
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    return spark


def row_hash(df: DataFrame) -> Column:
    """A total order among rows that differ, where nothing else decides; maps and variants count by their JSON text."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)


def with_default(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column the input lacks."""
    return df if name in df.columns else df.withColumn(name, value)


def clean_id(col: Column) -> Column:
    """Blank and nil UUIDs mean missing."""
    text = F.trim(col.cast("string"))
    return F.when((text != "") & (text != NIL_UUID), text)


def clean_country(col: Column) -> Column:
    """Two-byte country codes come NUL-padded from fixed-width storage."""
    return F.coalesce(F.regexp_replace(col, "\u0000", ""), F.lit(""))


def canonical_events(df: DataFrame) -> DataFrame:
    """Cast any event table to the canonical column set: absent columns become nulls, null text
    becomes '', a null property map becomes empty and instants become UTC wall-clock."""
    text = {"name", "device_id", "currency", "path", "origin", "referrer", "referrer_name",
            "referrer_type", "os", "browser", "device", "city"}
    ids = {"id", "tenant_id", "shop_id", "session_id", "customer_id", "product_id", "cart_id", "order_id"}
    out = []
    for field in [f.strip().rsplit(" ", 1) for f in EVENT_DDL.replace("\n", " ").split(", ")]:
        name, kind = field[0].strip(), field[1].strip()
        col = F.col(name) if name in df.columns else F.lit(None)
        if name in ids:
            col = clean_id(col)
        elif name in text:
            col = F.coalesce(col.cast("string"), F.lit(""))
        elif name == "country":
            col = clean_country(col.cast("string"))
        elif name == "properties":
            col = F.coalesce(col.cast("map<string,string>"), F.create_map().cast("map<string,string>"))
        else:
            col = col.cast(kind)
        out.append(col.alias(name))
    return df.select(*out)
