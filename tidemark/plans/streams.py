"""Stream operators driven to completion over the event file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.currency import to_usd
from tidemark.functions.lineage import scratch
from tidemark.functions.timeutil import bucket
from tidemark.operators import sketches as K
from tidemark.operators.scoring import CHURN, INTENT, PRICE
from tidemark.plans.registry import TIMEOUT, Tables, query, sql
from tidemark.plans.sequences import _levels
from tidemark.plans.sketches import close
from tidemark.schema import SHOP
from tidemark.sources import testdata
from tidemark.streaming import notifications as N
from tidemark.streaming import sources as I
from tidemark.streaming import stateful as S

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(t: Tables) -> DataFrame:
    """Canonical events as a stream of the event file."""
    raw = I.read_files(t.spark, t.sf_dir, _SCHEMA, "parquet", glob="events.parquet")
    raw.createOrReplaceTempView("streamed_events")
    ev = t.spark.sql(testdata.CANONICAL.format(jk="get_json_object(props,'$.k')", string="string", events="streamed_events"))
    return ev.withColumn("revenue_usd", to_usd(F.col("revenue"), F.col("currency")))


def _run(t: Tables, out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there and read back what it wrote."""
    base = scratch(t.spark, "stream")
    writer = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{base}/out")


@query("stream_hourly_rollup", sql("""
SELECT tenant_id, shop_id, date_trunc('hour', created_at) AS hour, count(*) FILTER (name IN ('view_product', 'page_view')) AS pageviews, count(*) FILTER (name = 'add_to_cart') AS cart_adds,
  count(*) FILTER (name IN ('purchase', 'order_completed')) AS purchases, cast(sum(coalesce(revenue_usd, revenue, 0)) AS bigint) AS gross_revenue,
  count(DISTINCT device_id) AS exact_visitors, true AS visitors_close FROM ev
WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM ev) - INTERVAL 10 MINUTE GROUP BY ALL"""))
def _(t):
    exact = t.ev.groupBy(*SHOP, bucket(F.col("created_at"), "hour").alias("hour")).agg(F.count_distinct("device_id").alias("exact_visitors"))
    found = _run(t, S.hourly_rollup(_stream(t))).join(exact, [*SHOP, "hour"])
    return found.withColumn("visitors_close", close("unique_visitors", "exact_visitors")).drop("unique_visitors", "visitor_sketch")


@query("stream_sketches_by_day", sql("""
SELECT tenant_id, shop_id, date_trunc('day', created_at) AS day, count(*) FILTER (name = 'add_to_cart') AS cart_adds, count(DISTINCT device_id) AS exact_visitors, true AS visitors_close FROM ev
WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM ev) - INTERVAL 10 MINUTE GROUP BY ALL"""))
def _(t):
    # Hours stored by the stream, merged to days by the batch operator.
    hours = _run(t, S.hourly_rollup(_stream(t)))
    days = K.counted(K.merged(hours, "day"))
    complete = t.ev.withColumn("hour", bucket(F.col("created_at"), "hour")).join(hours.select(*SHOP, "hour"), [*SHOP, "hour"], "left_semi")
    exact = complete.groupBy(*SHOP, bucket(F.col("created_at"), "day").alias("day")).agg(F.count_distinct("device_id").alias("exact_visitors"))
    return days.join(exact, [*SHOP, "day"]).select(*SHOP, "day", "cart_adds", "exact_visitors", close("unique_visitors", "exact_visitors").alias("visitors_close"))


@query("stream_closed_sessions", sql(f"""
SELECT session_id, tenant_id, shop_id, device_id, started_at, ended_at, duration, entry_path, exit_path, referrer_name, events_count, screen_views_count, has_cart_add, has_purchase, total_revenue_usd
FROM se WHERE ended_at + INTERVAL {TIMEOUT} SECOND <= (SELECT date_trunc('millisecond', max(created_at)) FROM ev) - INTERVAL 10 MINUTE"""))
def _(t):
    return _run(t, S.closed_sessions(_stream(t), f"{TIMEOUT} seconds")).select(
        "session_id", "tenant_id", "shop_id", "device_id", "started_at", "ended_at", "duration", "entry_path", "exit_path", "referrer_name", "events_count", "screen_views_count", "has_cart_add",
        "has_purchase", "total_revenue_usd")


@query("stream_unique_events", sql("SELECT tenant_id, shop_id, name, count(*) AS count FROM ev GROUP BY ALL"))
def _(t):
    ev = _stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _run(t, S.unique_events(ev).select("tenant_id", "shop_id", "name")).groupBy("tenant_id", "shop_id", "name").agg(F.count(F.lit(1)).alias("count"))


@query("stream_live_counts", sql("""
SELECT tenant_id, shop_id, w AS window_start, w + INTERVAL 5 MINUTE AS window_end, count(*) AS events, count(DISTINCT device_id) AS exact_visitors, true AS visitors_close FROM (
  SELECT tenant_id, shop_id, device_id, unnest(generate_series(date_trunc('minute', created_at) - INTERVAL 4 MINUTE, date_trunc('minute', created_at), INTERVAL 1 MINUTE)) AS w FROM ev)
WHERE w + INTERVAL 5 MINUTE <= (SELECT max(created_at) FROM ev) - INTERVAL 10 MINUTE GROUP BY ALL"""))
def _(t):
    starts = F.explode(F.sequence(bucket(F.col("created_at"), "minute") - F.expr("INTERVAL 4 MINUTE"), bucket(F.col("created_at"), "minute"), F.expr("INTERVAL 1 MINUTE")))
    exact = t.ev.withColumn("window_start", starts).groupBy(*SHOP, "window_start").agg(F.count_distinct("device_id").alias("exact_visitors"))
    found = _run(t, S.live_counts(_stream(t))).join(exact, [*SHOP, "window_start"])
    return found.withColumn("visitors_close", close("visitors", "exact_visitors")).drop("visitors")


def _score(weights, scroll=0.70, sale=0.25):
    """A logistic score over the columns of the running features."""
    columns = {"views_count": "views", "cart_adds_count": "carts", "distinct_products": "distinct_products", "dwell_time_seconds": "dwell_seconds",
               "avg_scroll_depth": scroll, "sale_view_ratio": sale}
    return "1 / (1 + exp(-(" + " + ".join([f"{weights['bias']}::double", *(f"{w}::double * {columns[n]}" for n, w in weights.items() if n != "bias")]) + ")))"


@query("stream_running_features", sql(f"""
SELECT * EXCLUDE (i, c, p), round(i * 1e4::double) / 1e4::double AS intent, round(c * 1e4::double) / 1e4::double AS churn_risk, round(p * 1e4::double) / 1e4::double AS price_sensitivity,
  i >= 0.85 AS high_intent, c >= 0.60 AND carts > 0 AS abandon_risk FROM (SELECT *, {_score(INTENT)} AS i, {_score(CHURN)} AS c, {_score(PRICE)} AS p FROM (
SELECT tenant_id, shop_id, device_id, 'e,' || lpad(cast(id AS varchar), 12, '0') AS id, created_at, views, carts, cart_value_usd,
  cast(greatest(1, products) AS bigint) AS distinct_products, dwell_seconds, has_purchase FROM (
  SELECT tenant_id, shop_id, device_id, id, created_at, count(*) FILTER (name IN ('page_view', 'view_product')) OVER s AS views,
    CASE WHEN epoch_us(created_at) - last_view <= {TIMEOUT}000000 THEN len(list_distinct(list(product_id) FILTER (name IN ('page_view', 'view_product')) OVER v)) ELSE 0 END AS products, count(*) FILTER (name = 'add_to_cart') OVER o AS carts,
    cast(coalesce(sum(revenue_usd) FILTER (name = 'add_to_cart') OVER o, 0) AS bigint) AS cart_value_usd, (epoch_us(created_at) - epoch_us(session_start)) // 1000000 AS dwell_seconds, name = 'purchase' AS has_purchase
  FROM (SELECT *, sum(CASE WHEN name IN ('page_view', 'view_product') AND epoch_us(created_at) - earlier_view > {TIMEOUT}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, id) AS run
    FROM (SELECT *, count(*) FILTER (name IN ('purchase', 'order_completed')) OVER w AS orders, max(epoch_us(created_at)) FILTER (name IN ('page_view', 'view_product')) OVER w AS last_view,
      max(epoch_us(created_at)) FILTER (name IN ('page_view', 'view_product')) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_view
      FROM evs WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)))
  WINDOW v AS (PARTITION BY session_id, run ORDER BY created_at, id), s AS (PARTITION BY session_id ORDER BY created_at, id), o AS (PARTITION BY session_id, orders ORDER BY created_at, id))))"""))
def _(t):
    # Ids and products as texts that hold commas.
    ev = _stream(t).withColumn("id", F.concat(F.lit("e,"), F.lpad(F.col("id").cast("string"), 12, "0"))).withColumn(
        "product_id", F.concat_ws(",", F.lit("a"), F.col("product_id").cast("string")))
    return _run(t, S.running_features(ev, TIMEOUT))


# Fixed small rules; a device is listed for a rule if it ever completed it.
_RULES = [{"id": "bought", "steps": ["page_view", "purchase"], "window": 2 * 86400}, {"id": "carted", "steps": ["page_view", "add_to_cart", "purchase"], "window": 5 * 86400}]


@query("stream_notification_funnels", sql("""SELECT tenant_id, shop_id, device_id, 'bought' AS rule_id FROM two WHERE level = 2
UNION ALL SELECT tenant_id, shop_id, device_id, 'carted' FROM three WHERE level = 3""",
                                          *_levels("two", _RULES[0]["steps"], window=_RULES[0]["window"]), *_levels("three", _RULES[1]["steps"], window=_RULES[1]["window"])))
def _(t):
    return _run(t, N.funnel_notifications(_stream(t), _RULES)).select("tenant_id", "shop_id", "device_id", "rule_id").distinct()


@query("stream_notification_events", sql("""SELECT tenant_id, shop_id, device_id, id, name, created_at, 'sale' AS rule_id FROM ev WHERE name = 'purchase' AND os = 'macOS'"""))
def _(t):
    rule = {"id": "sale", "name": "purchase", "filters": [{"name": "os", "operator": "is", "value": ["macOS"]}]}
    return _run(t, N.notifications(_stream(t), [rule]))
