"""Stored sketches. Estimates are compared with exact counts by their error bounds: the SQL has the exact values, and every
bound must hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lineage import scratch
from tidemark.functions.timeutil import bucket
from tidemark.operators import sketches as K
from tidemark.plans.registry import query, sql
from tidemark.schema import SHOP


def stored(t, rows, name):
    """Sketches written to a table and read back, as reports use them."""
    path = scratch(t.spark, name)
    rows.write.parquet(path)
    return t.spark.read.parquet(path)


def close(estimate: str, exact: str, bits: int = K.BITS):
    """Within three standard errors; half a row is rounding."""
    return F.abs(F.col(estimate) - F.col(exact)) <= 3 * K.distinct_error(bits) * F.col(exact) + 0.5


def _compared(t, interval):
    found = K.counted(K.merged(stored(t, K.hourly_sketches(t.evs), "hourly"), interval))
    exact = t.evs.groupBy(*SHOP, bucket(F.col("created_at"), interval).alias(interval)).agg(
        F.count_distinct("device_id").alias("exact_visitors"), F.count_distinct("session_id").alias("exact_sessions"))
    return found.join(exact, [*SHOP, interval]).select(
        *SHOP, interval, "pageviews", "cart_adds", "purchases", "gross_revenue", "exact_visitors", close("unique_visitors", "exact_visitors").alias("visitors_close"),
        "exact_sessions", close("sessions", "exact_sessions").alias("sessions_close"))


def _exact(interval):
    return sql(f"""SELECT tenant_id, shop_id, date_trunc('{interval}', created_at) AS {interval}, count(*) FILTER (name IN ('view_product', 'page_view')) AS pageviews,
  count(*) FILTER (name = 'add_to_cart') AS cart_adds, count(*) FILTER (name IN ('purchase', 'order_completed')) AS purchases,
  cast(sum(coalesce(revenue_usd, revenue, 0)) AS bigint) AS gross_revenue, count(DISTINCT device_id) AS exact_visitors, true AS visitors_close,
  count(DISTINCT session_id) AS exact_sessions, true AS sessions_close FROM evs GROUP BY ALL""")


@query("sketched_days", _exact("day"))
def _(t):
    return _compared(t, "day")


@query("sketched_months", _exact("month"))
def _(t):
    return _compared(t, "month")


@query("sketched_duration_p90", sql("""SELECT tenant_id, shop_id, date_trunc('month', started_at) AS month, count(*) AS sessions, true AS rank_close FROM se GROUP BY ALL"""))
def _(t):
    found = K.duration_quantile(stored(t, K.daily_durations(t.se), "durations"), "month")
    rows = t.se.select(*SHOP, bucket(F.col("started_at"), "month").alias("month"), F.col("duration").alias("d")).join(found, [*SHOP, "month"])
    # The share of sessions below the estimate, and of those up to it, must enclose 0.9 but for the bound.
    ranks = rows.groupBy(*SHOP, "month", "sessions").agg(F.avg((F.col("d") < F.col("duration")).cast("int")).alias("below"), F.avg((F.col("d") <= F.col("duration")).cast("int")).alias("upto"))
    return ranks.select(*SHOP, "month", "sessions", ((F.col("below") <= 0.9 + K.rank_error()) & (F.col("upto") >= 0.9 - K.rank_error())).alias("rank_close"))
