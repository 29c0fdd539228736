"""Traffic reports, computed for every shop at once: trends, hourly rollup, overview, top lists, live views."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.currency import from_usd
from tidemark.functions.numbers import difference, percent_change, round_to, safe_ratio
from tidemark.functions.predicates import (cart_add, conversion, or_default, order_event, overview_view, profile_id,
                                           rollup_view, trend_view)
from tidemark.functions.timeutil import Period, bucket, resolve_period, ts, zero_fill
from tidemark.functions.timeutil import months_back as _months_back
from tidemark.schema import SHOP


def usd() -> Column:
    return F.coalesce(F.sum("revenue_usd"), F.lit(0)).cast("bigint")


def distinct(column: str | Column, rsd: float | None = None) -> Column:
    """Exact distinct count, or a sketch with the given relative error."""
    return F.count_distinct(column) if rsd is None else F.approx_count_distinct(column, rsd)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group. Spark also applies the rank limit before the shuffle, so no task
    receives more than k rows per group from any other."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


TREND_RANGES = ("today", "24h", "7d", "30d")


# --- trends and rollup -----------------------------------------------------------------------

def trends(ev: DataFrame, metric: str = "page_views", as_of: datetime | None = None, time_range: str = "7d",
           interval: str | None = None, currency: str = "USD") -> DataFrame:
    """Bucketed metric per shop; hourly unless daily is asked for or the range is 30 days. Buckets
    without events are absent. Revenue is summed in dollars first and converted per bucket. An unknown
    metric or range is an error."""
    if time_range not in TREND_RANGES:
        raise ValueError(f"range {time_range!r}: one of {TREND_RANGES}")
    step = "day" if interval == "day" or time_range == "30d" else "hour"
    start = resolve_period(as_of, time_range).start
    kinds = {
        "page_views": (trend_view(), F.count(F.lit(1))),
        "unique_visitors": (F.lit(True), distinct("device_id")),
        "cart_adds": (cart_add(), F.count(F.lit(1))),
        "orders": (order_event(), F.count(F.lit(1))),
        "revenue": (F.col("revenue_usd").isNotNull(), from_usd(usd(), currency)),
    }
    if metric not in kinds:
        raise ValueError(f"metric {metric!r}: one of {sorted(kinds)}")
    keep, value = kinds[metric]
    rows = ev.where((F.col("created_at") >= ts(start)) & keep)
    return rows.groupBy(*SHOP, bucket(F.col("created_at"), step).alias("bucket")).agg(value.cast("double").alias("value"))


def hourly_rollup(ev: DataFrame, as_of: datetime, lookback_hours: int = 48) -> DataFrame:
    """Complete hours of the lookback, which starts on the hour so that no hour is overwritten by part of itself."""
    start = as_of.replace(minute=0, second=0, microsecond=0) - timedelta(hours=lookback_hours)
    gross = F.sum(F.coalesce("revenue_usd", "revenue", F.lit(0))).cast("bigint")
    return (ev.where(F.col("created_at").between(ts(start), ts(as_of)))
            .groupBy(*SHOP, bucket(F.col("created_at"), "hour").alias("hour"))
            .agg(distinct("device_id").alias("unique_visitors"), distinct("session_id").alias("sessions"),
                 F.count_if(rollup_view()).alias("pageviews"), F.count_if(cart_add()).alias("cart_adds"),
                 F.count_if(order_event()).alias("purchases"), gross.alias("gross_revenue")))


# --- overview --------------------------------------------------------------------------------

def _within(period: Period, current: bool, column: str) -> Column:
    return period.current(F.col(column)) if current else period.previous(F.col(column))


def overview(ev: DataFrame, se: DataFrame, period: Period, currency: str = "USD") -> DataFrame:
    """Visitors, sessions, bounce rate, mean duration, views and revenue with their previous-period twins.
    Sessions and events are each read once for both periods."""
    started = F.col("started_at")
    parts, views = [], []
    for prefix, cur in (("", True), ("prev_", False)):
        hit = _within(period, cur, "started_at")
        bounced = (F.col("events_count") <= 1) | (F.col("duration") == 0)
        parts += [
            F.count_distinct(F.when(hit, F.col("device_id"))).alias(f"{prefix}unique_visitors"),
            F.count_if(hit).alias(f"{prefix}total_sessions"),
            round_to(safe_ratio(F.count_if(hit & bounced), F.count_if(hit), 100), 2).alias(f"{prefix}bounce_rate"),
            F.coalesce(round_to(F.avg(F.when(hit & (F.col("duration") > 0), F.col("duration"))), 2), F.lit(0.0))
            .alias(f"{prefix}avg_session_duration"),
            from_usd(F.coalesce(F.sum(F.when(hit, F.col("total_revenue_usd"))), F.lit(0)), currency).alias(f"{prefix}total_revenue")]
        views.append(F.count_if(_within(period, cur, "created_at")).alias(f"{prefix}total_screen_views"))
    left = se.where(period.either(started)).groupBy(*SHOP).agg(*parts)
    right = ev.where(period.either(F.col("created_at")) & overview_view()).groupBy(*SHOP).agg(*views)
    out = left.join(right, SHOP, "full_outer")
    counts = [c for c in out.columns if c not in SHOP]
    out = out.fillna(0, counts)
    for prefix in ("", "prev_"):
        out = out.withColumn(f"{prefix}views_per_session",
                             safe_ratio(F.col(f"{prefix}total_screen_views"), F.col(f"{prefix}total_sessions")))
    return out


_SERIES = ["unique_visitors", "total_sessions", "total_screen_views", "total_revenue", "views_per_session"]


def overview_series(ev: DataFrame, period: Period, interval: str = "day", currency: str = "USD") -> DataFrame:
    """Bucketed overview; the i-th bucket carries the i-th bucket of the previous period. The series
    has no bounce rate or duration of its own, so both and their twins are 0."""
    at = F.col("created_at")
    # The shared instant belongs to both periods, so a row there is counted on both sides.
    sides = F.filter(F.array(F.when(period.current(at), F.lit(True)), F.when(period.previous(at), F.lit(False))),
                     lambda x: x.isNotNull())
    grouped = (ev.where(period.either(at)).withColumn("_cur", F.explode(sides))
               .groupBy(*SHOP, "_cur", bucket(at, interval).alias("bucket"))
               .agg(distinct("device_id").alias("unique_visitors"), distinct("session_id").alias("total_sessions"),
                    F.count_if(overview_view()).alias("total_screen_views"), from_usd(usd(), currency).alias("total_revenue")))
    grouped = grouped.withColumn("views_per_session", safe_ratio(F.col("total_screen_views"), F.col("total_sessions")))
    grouped = grouped.withColumn("_i", F.row_number().over(Window.partitionBy(*SHOP, "_cur").orderBy("bucket")))
    cur = grouped.where("_cur").drop("_cur")
    prev = grouped.where(~F.col("_cur")).select(*SHOP, "_i", *[F.col(c).alias(f"prev_{c}") for c in _SERIES])
    out = cur.join(prev, [*SHOP, "_i"], "left").drop("_i")
    for c in ("bounce_rate", "avg_session_duration"):
        out = out.withColumn(c, F.lit(0.0)).withColumn(f"prev_{c}", F.when(F.col("prev_total_sessions").isNotNull(), F.lit(0.0)))
    return out


# --- top lists -------------------------------------------------------------------------------

TOP_COLUMNS = ("device", "browser", "os", "referrer_name", "country", "city")


def top_dimension(ev: DataFrame, column: str, period: Period, limit: int | None = 10, currency: str = "USD") -> DataFrame:
    """Sessions, page views and revenue per value of a whitelisted column; another column is an error."""
    if column not in TOP_COLUMNS:
        raise ValueError(f"column {column!r}: one of {TOP_COLUMNS}")
    rows = ev.where(period.current(F.col("created_at")))
    out = rows.groupBy(*SHOP, or_default(column, "Unknown").alias("item")).agg(
        distinct("session_id").alias("sessions"), F.count_if(overview_view()).alias("pageviews"), from_usd(usd(), currency).alias("revenue"))
    return out if limit is None else top_k(out, SHOP, [F.desc("sessions"), F.col("item")], limit)


def top_pages(ev: DataFrame, period: Period, limit: int = 10, currency: str = "USD") -> DataFrame:
    rows = ev.where(period.current(F.col("created_at")) & (overview_view() | (F.col("path") != "")))
    out = rows.groupBy(*SHOP, or_default("path", "/").alias("item")).agg(
        distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("pageviews"), from_usd(usd(), currency).alias("revenue"))
    return top_k(out, SHOP, [F.desc("pageviews"), F.col("item")], limit)


def top_session_pages(se: DataFrame, mode: str, period: Period, limit: int = 10, currency: str = "USD") -> DataFrame:
    """Entry pages by session start, exit pages by session end."""
    path, at = ("exit_path", "ended_at") if mode == "exit" else ("entry_path", "started_at")
    rows = se.where(period.current(F.col(at)) & (F.col(path) != ""))
    out = rows.groupBy(*SHOP, F.col(path).alias("item")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("events_count").alias("pageviews"),
        from_usd(F.sum("total_revenue_usd"), currency).alias("revenue"))
    return top_k(out, SHOP, [F.desc("sessions"), F.col("item")], limit)


def top_sources(ev: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    return top_dimension(ev, "referrer_name", period, limit)


def top_geo(ev: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    return top_dimension(ev, "country", period, limit)


def country_map(ev: DataFrame, period: Period) -> DataFrame:
    """All known countries with their sessions. The map places a marker by code, so it has no coordinates."""
    out = top_dimension(ev, "country", period, None).where(~F.lower("item").isin("", "unknown"))
    return out.select(*SHOP, F.col("item").alias("country"), F.col("sessions").alias("count"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"))


def country_shares(counts: DataFrame, value: str = "count") -> DataFrame:
    """Country codes folded to lower case, with shares of the shop's maximum and total."""
    folded = counts.groupBy(*SHOP, F.lower("country").alias("country")).agg(F.sum(value).alias(value))
    totals = folded.groupBy(*SHOP).agg(F.max(value).alias("_max"), F.sum(value).alias("_sum"))
    return folded.join(totals, SHOP).select(*SHOP, "country", value, safe_ratio(F.col(value), F.col("_max")).alias("share_of_max"),
                                            safe_ratio(F.col(value), F.col("_sum")).alias("share_of_total"))


def top_events(ev: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    out = ev.where(period.current(F.col("created_at"))).groupBy(*SHOP, "name").agg(
        F.count(F.lit(1)).alias("count"), distinct("device_id").alias("unique_visitors"))
    return top_k(out, SHOP, [F.desc("count"), F.col("name")], limit)


def top_conversions(ev: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    return top_events(ev.where(conversion()), period, limit)


def top_outbound_links(ev: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    """Targets of outbound-link events."""
    rows = ev.where(period.current(F.col("created_at")) & (F.col("name") == "link_out"))
    out = rows.groupBy(*SHOP, F.col("properties")["href"].alias("item")).agg(
        F.count(F.lit(1)).alias("count"), distinct("device_id").alias("unique_visitors"))
    return top_k(out.where(F.col("item") != ""), SHOP, [F.desc("count"), F.col("item")], limit)


def top_origins(ev: DataFrame, as_of: datetime, limit: int = 3) -> DataFrame:
    """The three busiest origins of 30 days, less local ones."""
    rows = ev.where(resolve_period(as_of, "30d").current(F.col("created_at")) & (F.col("origin") != ""))
    out = top_k(rows.groupBy(*SHOP, "origin").agg(F.count(F.lit(1)).alias("count")), SHOP, [F.desc("count"), F.col("origin")], limit)
    return out.where(~F.col("origin").contains("localhost"))


def top_with_rest(counts: DataFrame, item: str, value: str, n: int, rest: str = "(rest)") -> DataFrame:
    """Top n items per shop and one bucket for all others. The winners are at most n per shop and
    are matched back by key, so the tail is summed where it lies."""
    best = top_k(counts, SHOP, [F.desc(value), F.col(item)], n).select(*SHOP, item, F.lit(True).alias("_top"))
    label = F.when(F.col("_top"), F.col(item)).otherwise(F.lit(rest))
    return counts.join(best, [*SHOP, item], "left").groupBy(*SHOP, label.alias(item)).agg(F.sum(value).alias(value))


def top_series(ev: DataFrame, column: str, period: Period, interval: str = "day", limit: int = 10) -> DataFrame:
    """Zero-filled session series of each of the top items."""
    best = top_dimension(ev, column, period, limit).select(*SHOP, "item")
    rows = ev.where(period.current(F.col("created_at"))).withColumn("item", or_default(column, "Unknown"))
    series = rows.groupBy(*SHOP, "item", bucket(F.col("created_at"), interval).alias("bucket")).agg(
        distinct("session_id").alias("sessions"), F.count_if(overview_view()).alias("pageviews"))
    return zero_fill(series, best, [*SHOP, "item"], ["sessions", "pageviews"], period, interval)


def page_series(ev: DataFrame, period: Period, interval: str = "day", limit: int = 10) -> DataFrame:
    best = top_pages(ev, period, limit).select(*SHOP, "item")
    rows = ev.where(period.current(F.col("created_at")) & (overview_view() | (F.col("path") != ""))).withColumn("item", or_default("path", "/"))
    series = rows.groupBy(*SHOP, "item", bucket(F.col("created_at"), interval).alias("bucket")).agg(F.count(F.lit(1)).alias("pageviews"))
    return zero_fill(series, best, [*SHOP, "item"], ["pageviews"], period, interval)


def period_change(ev: DataFrame, column: str, period: Period) -> DataFrame:
    """Sessions per value now and before, with relative change and direction."""
    at = F.col("created_at")
    out = ev.where(period.either(at)).groupBy(*SHOP, or_default(column, "Unknown").alias("item")).agg(
        F.count_distinct(F.when(period.current(at), F.col("session_id"))).alias("current"),
        F.count_distinct(F.when(period.previous(at), F.col("session_id"))).alias("previous"))
    diff, state = difference(F.col("current"), F.col("previous"))
    return out.select("*", diff.alias("diff"), state.alias("state"), percent_change(F.col("current"), F.col("previous")).alias("change_pct"))


# --- live ------------------------------------------------------------------------------------

def live_visitors(ev: DataFrame, as_of: datetime, minutes: int = 5) -> DataFrame:
    """Active shoppers, device counts, top countries and top paths of the last minutes, as (kind, item, value)."""
    live = ev.where(F.col("created_at").between(ts(as_of - timedelta(minutes=minutes)), ts(as_of)))
    # Every event is unpivoted to its (kind, item) pairs, so one scan serves all lists; only the first kind counts devices.
    pair = lambda kind, item: F.struct(F.lit(kind).alias("kind"), item.alias("item"))
    pairs = F.array(pair("active_shoppers", F.lit("")), *[F.when(F.col(c) != "", pair(c, F.col(c))) for c in ("device", "country", "path")])
    rows = live.select(*SHOP, "device_id", F.explode(pairs).alias("x")).where("x IS NOT NULL").select(*SHOP, "device_id", "x.*")
    shoppers = F.col("kind") == "active_shoppers"
    counts = rows.groupBy(*SHOP, "kind", "item").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(shoppers, F.col("device_id"))).alias("d"))
    counts = counts.select(*SHOP, "kind", "item", F.when(shoppers, F.col("d")).otherwise(F.col("n")).cast("bigint").alias("value"))
    place = F.row_number().over(Window.partitionBy(*SHOP, "kind").orderBy(F.desc("value"), "item"))
    most = F.when(F.col("kind") == "country", 10).when(F.col("kind") == "path", 5)
    return counts.withColumn("_place", place).where(most.isNull() | (F.col("_place") <= most)).drop("_place")


def live_minutes(ev: DataFrame, as_of: datetime, minutes: int = 30) -> DataFrame:
    """Sessions and visitors per minute, absent minutes as 0, with the whole window's session total."""
    period = Period(as_of - timedelta(minutes=minutes), as_of)
    live = ev.where(period.current(F.col("created_at")))
    per = live.groupBy(*SHOP, bucket(F.col("created_at"), "minute").alias("minute")).agg(
        distinct("session_id").alias("session_count"), distinct("device_id").alias("visitor_count"))
    total = live.groupBy(*SHOP).agg(distinct("session_id").alias("total_sessions"))
    return zero_fill(per, total, SHOP, ["session_count", "visitor_count"], period, "minute", "minute").join(total, SHOP)


def live_referrers(ev: DataFrame, as_of: datetime, minutes: int = 30, limit: int = 10) -> DataFrame:
    live = ev.where(F.col("created_at").between(ts(as_of - timedelta(minutes=minutes)), ts(as_of)))
    out = live.groupBy(*SHOP, or_default("referrer_name", "Direct").alias("referrer")).agg(distinct("session_id").alias("count"))
    return top_k(out, SHOP, [F.desc("count"), F.col("referrer")], limit)


def live_minute_referrers(ev: DataFrame, as_of: datetime, minutes: int = 30) -> DataFrame:
    """Known referrers per minute."""
    live = ev.where(F.col("created_at").between(ts(as_of - timedelta(minutes=minutes)), ts(as_of)) & (F.col("referrer_name") != ""))
    return live.groupBy(*SHOP, bucket(F.col("created_at"), "minute").alias("minute"), "referrer_name").agg(
        distinct("session_id").alias("count"))


def badge_visitors(ev: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    period = resolve_period(as_of, start=as_of - timedelta(days=days), end=as_of)
    return ev.where(period.current(F.col("created_at"))).groupBy(*SHOP).agg(distinct("device_id").alias("unique_visitors"))


def project_card(se: DataFrame, as_of: datetime) -> DataFrame:
    """Distinct session profiles over three calendar months, the three before, one month, one day and the day before, revenue of
    six months, and the rounded change of three months over the previous three."""
    at, who = F.col("started_at"), profile_id()
    start = {n: _months_back(as_of, n) for n in (1, 3, 6)}
    day, before = as_of - timedelta(days=1), as_of - timedelta(days=2)

    def visitors(lo: datetime, hi: datetime = as_of, closed: bool = True) -> Column:
        upper = at <= ts(hi) if closed else at < ts(hi)
        return F.count_distinct(F.when((at >= ts(lo)) & upper, who))

    out = se.where(at.between(ts(start[6]), ts(as_of))).groupBy(*SHOP).agg(
        visitors(start[3]).alias("three_months"), visitors(start[6], start[3], False).alias("previous_three_months"),
        visitors(start[1]).alias("one_month"), visitors(day).alias("one_day"), visitors(before, day, False).alias("previous_day"),
        F.sum("total_revenue_usd").alias("revenue"))
    now, then = F.col("three_months"), F.col("previous_three_months")
    change = F.when((then > 0) & (now > 0), F.round((now - then) / then * 100))
    direction = F.when(change > 0, F.lit("up")).when(change < 0, F.lit("down")).otherwise(F.lit("neutral"))
    return out.select("*", direction.alias("direction"), F.abs(change).alias("percentage"))


def project_card_series(se: DataFrame, as_of: datetime) -> DataFrame:
    """Daily session profiles and revenue of three months, absent days as 0."""
    period = Period(_months_back(as_of, 3), as_of)
    rows = se.where(period.current(F.col("started_at"))).withColumn("_profile", profile_id())
    daily = rows.groupBy(*SHOP, bucket(F.col("started_at"), "day").alias("bucket")).agg(
        distinct("_profile").alias("visitors"), F.sum("total_revenue_usd").alias("revenue"))
    return zero_fill(daily, daily.select(*SHOP).distinct(), SHOP, ["visitors", "revenue"], period, "day")


def tenant_volume(ev: DataFrame, period: Period, interval: str = "day") -> DataFrame:
    """Event volume per tenant over a billing window."""
    rows = ev.where(period.current(F.col("created_at")))
    return rows.groupBy("tenant_id", bucket(F.col("created_at"), interval).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def search_engines(se: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    """Sessions per search engine, with the totals of all engines in this period and the one before."""
    return _referring(se.where(F.col("referrer_type") == "search"), F.col("referrer_name"), period, limit)


# Referrer hosts that are AI assistants; names without the last label count too.
AI_HOSTS = ("chatgpt.com", "openai.com", "claude.ai", "anthropic.com", "perplexity.ai", "gemini.google.com", "copilot.com",
            "grok.com", "mistral.ai", "kagi.com")


def ai_engines(se: DataFrame, period: Period, limit: int = 10, hosts: tuple[str, ...] = AI_HOSTS) -> DataFrame:
    """As :func:`search_engines` for AI assistants."""
    names = {*hosts, *(h.rpartition(".")[0] for h in hosts)}
    label = F.lower(F.regexp_replace("referrer_name", "^https?://", ""))
    return _referring(se.where(F.col("referrer_name").isin(*sorted(names))), label, period, limit)


def _referring(se: DataFrame, label: Column, period: Period, limit: int) -> DataFrame:
    at = F.col("started_at")
    earlier = period.previous(at) & (at < ts(period.start))
    counts = se.where(period.either(at)).groupBy(*SHOP, label.alias("item")).agg(
        F.count_if(period.current(at)).alias("sessions"), F.count_if(earlier).alias("_before"))
    best = top_k(counts.where(F.col("sessions") > 0).drop("_before"), SHOP, [F.desc("sessions"), F.col("item")], limit)
    totals = counts.groupBy(*SHOP).agg(F.sum("sessions").alias("total"), F.sum("_before").alias("previous_total"))
    return best.join(totals, SHOP)


def realtime_widget(ev: DataFrame, as_of: datetime, minutes: int = 30, k: int = 20) -> DataFrame:
    """Sessions by country, referrer and path of the last minutes, from one scan, as (kind, item, count)."""
    live = ev.where(F.col("created_at").between(ts(as_of - timedelta(minutes=minutes)), ts(as_of)))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("item")) for kind, column in (("country", "country"), ("referrer", "referrer_name"), ("path", "path"))])
    rows = live.select(*SHOP, "session_id", F.explode(kinds).alias("x")).where(F.col("x.item") != "")
    counts = rows.groupBy(*SHOP, "x.kind", "x.item").agg(F.count_distinct("session_id").alias("count"))
    return top_k(counts, [*SHOP, "kind"], [F.desc("count"), F.col("item")], k)
