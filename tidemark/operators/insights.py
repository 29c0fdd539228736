"""Automated insight cards for every active shop in one job, and the views over stored cards."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed, round_to
from tidemark.functions.predicates import cart_add, or_default, purchase_event
from tidemark.functions.timeutil import Period, bucket, ts
from tidemark.operators.funnel import both_periods
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP


def _recent(as_of: datetime) -> tuple[Column, Column, Column]:
    """(last 24 hours, the seven days before them, both)"""
    at = F.col("created_at")
    day, week = ts(as_of - timedelta(hours=24)), ts(as_of - timedelta(days=8))
    upto = at <= ts(as_of)
    return (at >= day) & upto, (at >= week) & (at < day), (at >= week) & upto


def _trend(current: Column, base: Column) -> tuple[Column, Column]:
    """Percent change and direction; moves within 5 % are flat and a missing baseline is +100 %."""
    pct = F.when(base > 0, (current - base) / base * 100).when(current > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    way = F.when(pct > 5, F.lit("up")).when(pct < -5, F.lit("down")).otherwise(F.lit("flat"))
    return pct, way


def _arrow(way: Column) -> Column:
    return F.when(way == "up", F.lit("↑")).when(way == "down", F.lit("↓")).otherwise(F.lit("→"))


def _card(df: DataFrame, as_of: datetime, module: str, dimension: Column, title: Column, summary: Column, way: Column, pct: Column,
          current: Column, compare: Column, impact: Column) -> DataFrame:
    key = F.concat_ws(":", F.col("shop_id").cast("string"), F.lit(module), dimension, F.lit(as_of.isoformat()))
    return df.select(
        F.sha2(key, 256).alias("id"), *SHOP, F.lit(module).alias("module_key"), dimension.alias("dimension_key"), F.lit("rolling_24h").alias("window_kind"),
        title.alias("title"), summary.alias("summary"), way.alias("direction"), pct.alias("change_pct"), current.alias("current_val"),
        compare.alias("compare_val"), impact.alias("impact_score"), ts(as_of).alias("created_at"))


def _per_day(count: Column) -> Column:
    return F.round(count.cast("double") / 7.0, 1)


def referrer_cards(ev: DataFrame, as_of: datetime, k: int = 10) -> DataFrame:
    """Traffic per referrer against its daily baseline."""
    day, week, both = _recent(as_of)
    rows = ev.where(both).groupBy(*SHOP, or_default("referrer_name", "Direct / None").alias("ref")).agg(
        F.count_if(day).cast("double").alias("cur"), _per_day(F.count_if(week)).alias("base"))
    best = top_k(rows.where((F.col("cur") >= 1) | (F.col("base") >= 1)), SHOP, [F.desc("cur"), F.col("ref")], k)
    cur, base = F.col("cur"), F.col("base")
    pct, way = _trend(cur, base)
    title = F.when((base == 0) & (cur > 0), F.concat(F.lit("New acquisition source: "), F.col("ref"))).otherwise(
        F.concat(F.lit("Traffic from "), F.col("ref"), F.lit(" "), _arrow(way), F.lit(" "), fixed(F.abs(pct), 0), F.lit("% (24h)")))
    summary = F.concat(F.lit("Last 24h: "), fixed(cur, 0), F.lit(" sessions vs "), fixed(base, 1), F.lit(" daily baseline."))
    return _card(best, as_of, "referrers", F.concat(F.lit("referrer:"), F.col("ref")), title, summary, way, pct, cur, base, F.abs(pct) * F.log1p(cur))


def cart_cards(ev: DataFrame, as_of: datetime) -> DataFrame:
    """Cart additions against their daily baseline. Revenue is the shop's raw cents, unconverted."""
    day, week, both = _recent(as_of)
    rows = ev.where(both).groupBy(*SHOP).agg(
        F.count_if(cart_add() & day).cast("double").alias("cur"), _per_day(F.count_if(cart_add() & week)).alias("base"),
        (F.sum(F.when(day, F.coalesce("revenue", F.lit(0))).otherwise(F.lit(0))).cast("double") / 100.0).alias("rev"))
    rows = rows.where((F.col("cur") > 0) | (F.col("base") > 0))
    cur, base = F.col("cur"), F.col("base")
    pct, way = _trend(cur, base)
    title = F.when(way == "flat", F.concat(F.lit("Cart additions steady at "), fixed(cur, 0))).otherwise(
        F.concat(F.lit("Cart additions "), _arrow(way), F.lit(" "), fixed(F.abs(pct), 0), F.lit("% (24h)")))
    summary = F.concat(fixed(cur, 0), F.lit(" cart additions in the last 24h compared to "), fixed(base, 1), F.lit(" daily baseline (Revenue: $"),
                       fixed(F.col("rev"), 2), F.lit(")."))
    return _card(rows, as_of, "cart_trends", F.lit("cart_adds:24h"), title, summary, way, pct, cur, base, F.abs(pct) * F.log1p(cur))


def device_cards(ev: DataFrame, as_of: datetime) -> DataFrame:
    """Activity and order rate per device with at least five events in 24 hours."""
    day, _, _ = _recent(as_of)
    rows = ev.where(day).groupBy(*SHOP, or_default("device", "desktop").alias("dev")).agg(
        F.count(F.lit(1)).cast("double").alias("cur"), F.count_if(purchase_event()).cast("double").alias("orders")).where(F.col("cur") >= 5)
    cur, orders = F.col("cur"), F.col("orders")
    rate = orders / cur * 100
    title = F.concat(F.col("dev"), F.lit(" device activity ("), fixed(cur, 0), F.lit(" events, "), fixed(rate, 1), F.lit("% orders)"))
    summary = F.concat(F.lit("Shoppers on "), F.col("dev"), F.lit(" generated "), fixed(cur, 0), F.lit(" total interactions and "), fixed(orders, 0),
                       F.lit(" completed orders in the last 24 hours."))
    return _card(rows, as_of, "devices", F.concat(F.lit("device:"), F.col("dev")), title, summary, F.lit("flat"), rate, cur, orders, cur)


def page_cards(ev: DataFrame, as_of: datetime, k: int = 5) -> DataFrame:
    """Busiest pages with at least five visits in 24 hours."""
    day, week, both = _recent(as_of)
    rows = ev.where(both & (F.col("path") != "")).groupBy(*SHOP, "path").agg(
        F.count_if(day).cast("double").alias("cur"), _per_day(F.count_if(week)).alias("base")).where(F.col("cur") >= 5)
    best = top_k(rows, SHOP, [F.desc("cur"), F.col("path")], k)
    cur, base = F.col("cur"), F.col("base")
    pct, way = _trend(cur, base)
    summary = F.concat(fixed(cur, 0), F.lit(" visits in the last 24h (Daily baseline: "), fixed(base, 1), F.lit("). Trending "), way, F.lit("."))
    return _card(best, as_of, "top_pages", F.concat(F.lit("page:"), F.col("path")), F.concat(F.lit("High velocity page: "), F.col("path")), summary, way, pct,
                 cur, base, cur * 1.2)


def daily_insights(ev: DataFrame, as_of: datetime) -> DataFrame:
    """All cards of all shops active in the last seven days."""
    active = ev.where(F.col("created_at").between(ts(as_of - timedelta(days=7)), ts(as_of))).select(*SHOP).distinct()
    cards = referrer_cards(ev, as_of).unionByName(cart_cards(ev, as_of)).unionByName(device_cards(ev, as_of)).unionByName(page_cards(ev, as_of))
    return cards.join(active, SHOP, "left_semi")


# --- stored cards ----------------------------------------------------------------------------

def insight_list(cards: DataFrame, limit: int = 10) -> DataFrame:
    """Highest impact first, with severity, split dimension and change from the comparison."""
    impact, key = F.col("impact_score"), F.col("dimension_key")
    best = top_k(cards, SHOP, [F.desc("impact_score"), F.desc("created_at"), F.col("id")], limit)
    split = F.split(key, ":", 2)
    named = key.contains(":")
    cart = F.col("module_key") == "cart_trends"
    return (best.withColumn("severity_band", F.when(impact > 100, F.lit("severe")).when(impact > 30, F.lit("moderate")).otherwise(F.lit("subtle")))
            .withColumn("dimension", F.when(named, split[0]).otherwise(F.lit("dimension"))).withColumn("dimension_value", F.when(named, F.get(split, F.lit(1))).otherwise(key))
            .withColumn("metric", F.when(cart, F.lit("share")).otherwise(F.lit("sessions"))).withColumn("unit", F.when(cart, F.lit("ratio")).otherwise(F.lit("count")))
            .withColumn("delta", F.col("current_val") - F.col("compare_val")))


def dedupe_windows(cards: DataFrame, limit: int = 20) -> DataFrame:
    """One card per module and dimension, the narrowest window first; then the best ``limit`` of these.
    Relevance leads where it is known, impact decides otherwise."""
    order = [F.desc_nulls_last("relevance_score"), F.desc("impact_score"), F.col("id")]
    rank = F.when(F.col("window_kind") == "yesterday", 1).when(F.col("window_kind") == "rolling_7d", 2).when(F.col("window_kind") == "rolling_30d", 3).otherwise(999)
    one = top_k(cards, [*SHOP, "module_key", "dimension_key"], [rank, *order], 1)
    return top_k(one, SHOP, [F.desc(F.coalesce("relevance_score", F.lit(-1.0))), F.desc("impact_score"), F.col("id")], limit)


def insight_feed(cards: DataFrame, sort: str = "relevance", module: str | None = None, window: str | None = None, severity: str | None = None,
                 direction: str | None = None, text: str | None = None) -> DataFrame:
    """Filtered cards with their position in the chosen order."""
    rows = cards
    for column, value in (("module_key", module), ("window_kind", window), ("direction", direction)):
        rows = rows.where(F.col(column) == value) if value else rows
    if severity:
        rows = rows.where(F.col("severity_band").isNull() | (F.col("severity_band") == "") if severity == "none" else F.col("severity_band") == severity)
    if text:
        hay = F.lower(F.concat_ws(" ", "title", "summary", "dimension_key"))
        rows = rows.where(hay.contains(text.lower()))
    band = F.when(F.col("severity_band") == "severe", 3).when(F.col("severity_band") == "moderate", 2).when(F.col("severity_band") == "low", 1).otherwise(0)
    impact = F.coalesce("impact_score", F.lit(0.0))
    keys = {"relevance": [F.desc(F.coalesce("relevance_score", F.lit(-1.0))), impact.desc()], "impact-desc": [impact.desc()], "impact-asc": [impact.asc()],
            "severity-desc": [band.desc()], "severity-asc": [band.asc()], "recent": [F.desc_nulls_last("created_at")]}[sort]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*SHOP).orderBy(*keys, F.col("id"))))


def module_ranking(cards: DataFrame) -> DataFrame:
    """Modules in feed order: referrers, then by mean impact."""
    out = cards.groupBy(*SHOP, "module_key").agg(F.count(F.lit(1)).alias("cards"), F.avg(F.coalesce("impact_score", F.lit(0.0))).alias("avg_impact"))
    order = [F.desc(F.col("module_key") == "referrers"), F.desc("avg_impact"), F.col("module_key")]
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*SHOP).orderBy(*order)))


# Columns an insight is explained by.
EXPLAIN_COLUMNS = ("referrer_name", "country", "device", "browser", "os")


def explain_breakdowns(ev: DataFrame, period: Period, columns: Sequence[str] = EXPLAIN_COLUMNS, k: int = 8) -> DataFrame:
    """Top values per column by sessions, now and in the baseline, from one scan: every event is unpivoted to its (column, value)
    pairs, which are counted together."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    rows = both_periods(ev, period).select(*SHOP, "period", "session_id", F.explode(pairs).alias("p")).select(*SHOP, "period", "session_id", "p.*")
    counts = rows.groupBy(*SHOP, "period", "column", "value").agg(F.count_distinct("session_id").alias("sessions"))
    best = top_k(counts, [*SHOP, "period", "column"], [F.desc("sessions"), F.col("value")], k)
    now, then = (best.where(F.col("period") == p).select(*SHOP, "column", "value", F.col("sessions").alias(n))
                 for p, n in (("current", "current"), ("previous", "baseline")))
    return now.join(then, [*SHOP, "column", "value"], "full_outer")


def explain_series(ev: DataFrame, period: Period, column: str, value: str) -> DataFrame:
    """Daily sessions and page views of one segment, now and in the baseline."""
    rows = both_periods(ev.where(F.col(column) == value), period)
    return rows.groupBy(*SHOP, "period", bucket(F.col("created_at"), "day").alias("date")).agg(
        F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("name").isin("page_view", "screen_view")).alias("pageviews"))


def nearby_references(references: DataFrame, period: Period, k: int = 10) -> DataFrame:
    """Notes dated from three days before the window to one day after it, newest first."""
    near = references.where(F.col("date").between(ts(period.start - timedelta(days=3)), ts(period.end + timedelta(days=1))))
    return top_k(near, SHOP, [F.desc("date"), F.col("title")], k)


def referrer_spikes(ev: DataFrame, period: Period, interval: str = "day", threshold: float = 2.0, minimum: int = 5) -> DataFrame:
    """Buckets where a referrer's sessions lie ``threshold`` standard deviations above its mean, grouped into clusters of adjacent
    buckets; the anchor is a cluster's largest spike. Mean and deviation are per referrer over its active buckets."""
    rows = ev.where(period.current(F.col("created_at")) & (F.col("referrer_name") != ""))
    keys = [*SHOP, "referrer_name"]
    counts = rows.groupBy(*keys, bucket(F.col("created_at"), interval).alias("date")).agg(F.count_distinct("session_id").alias("sessions"))
    stats = counts.groupBy(*keys).agg(F.avg("sessions").alias("mean"), F.stddev_pop("sessions").alias("dev"))
    z = (F.col("sessions") - F.col("mean")) / F.nullif(F.col("dev"), F.lit(0.0))
    spikes = counts.join(stats, keys).withColumn("zscore", round_to(z, 4)).where((F.col("zscore") >= threshold) & (F.col("sessions") >= minimum))
    step = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 31 * 86400}[interval]
    # Clusters span referrers of a shop; spikes are at most one per referrer and bucket, so gaps are found over distinct buckets.
    days = spikes.select(*SHOP, "date").distinct()
    order = Window.partitionBy(*SHOP).orderBy("date")
    gap = F.unix_seconds(F.col("date").cast("timestamp")) - F.unix_seconds(F.lag("date").over(order).cast("timestamp"))
    days = days.withColumn("_new", F.when(gap <= step, 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(order).cast("int")).drop("_new")
    out = spikes.join(days, [*SHOP, "date"])
    anchor = out.groupBy(*SHOP, "cluster").agg(F.max(F.struct("zscore", "sessions", "date"))["date"].alias("anchor_date"))
    return out.join(anchor, [*SHOP, "cluster"]).select(*keys, "cluster", "anchor_date", "date", "sessions", "zscore")
