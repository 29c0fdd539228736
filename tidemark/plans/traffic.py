"""Trends, rollup, overview, top lists and live views."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.timeutil import resolve_interval, resolve_period
from tidemark.operators import traffic as T
from tidemark.plans.registry import AS_OF, HALF, MONTH, query, sql

_M = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"
_H = "created_at BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-31'"
_P = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-16'"
_VIEW = "name IN ('page_view', 'screen_view')"
_USD = "cast(coalesce(sum(revenue_usd), 0) AS bigint)"
_RANK = "GROUP BY tenant_id, shop_id, {1} QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY {0} DESC, {1}) <= {2}"
# Quiet instants at the end of the test month are empty, so the live views look at a busy one.
_LIVE = AS_OF - timedelta(days=15)


def _trend(metric, value, keep, bucket="day", since="2024-01-01"):
    return sql(f"""SELECT tenant_id, shop_id, date_trunc('{bucket}', created_at) AS bucket, cast({value} AS double) AS value
    FROM ev WHERE created_at >= TIMESTAMP '{since}' AND {keep} GROUP BY ALL""")


for _name, _value, _keep in [
    ("page_views", "count(*)", "name = 'page_view'"), ("unique_visitors", "count(DISTINCT device_id)", "true"),
    ("cart_adds", "count(*)", "name = 'add_to_cart'"), ("orders", "count(*)", "name IN ('purchase', 'order_completed')"),
    ("revenue", "sum(revenue_usd)", "revenue_usd IS NOT NULL"),
]:
    query(f"trend_{_name}", _trend(_name, _value, _keep))(lambda t, m=_name: T.trends(t.ev, m, AS_OF, "30d"))


@query("trend_revenue_hourly_bdt", _trend("revenue", "round(sum(revenue_usd) * 123.0)", "revenue_usd IS NOT NULL", "hour", "2024-01-24"))
def _(t):
    return T.trends(t.ev, "revenue", AS_OF, "7d", currency="bdt")


@query("hourly_rollup", sql("""
SELECT tenant_id, shop_id, date_trunc('hour', created_at) AS hour, count(DISTINCT device_id) AS unique_visitors,
  count(DISTINCT session_id) AS sessions, count(*) FILTER (name IN ('view_product', 'page_view')) AS pageviews,
  count(*) FILTER (name = 'add_to_cart') AS cart_adds, count(*) FILTER (name IN ('purchase', 'order_completed')) AS purchases,
  cast(sum(coalesce(revenue_usd, revenue, 0)) AS bigint) AS gross_revenue
FROM evs WHERE created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY ALL"""))
def _(t):
    return T.hourly_rollup(t.evs, AS_OF, 30 * 24)


def _overview_side(prefix, cond):
    return f"""
  count(DISTINCT CASE WHEN {cond} THEN device_id END) AS {prefix}unique_visitors, count(*) FILTER ({cond}) AS {prefix}total_sessions,
  CASE WHEN count(*) FILTER ({cond}) = 0 THEN 0.0 ELSE round(count(*) FILTER ({cond} AND (events_count <= 1 OR duration = 0))::double
    / count(*) FILTER ({cond})::double * 100.0 * 100) / 100 END AS {prefix}bounce_rate,
  coalesce(round(avg(duration) FILTER ({cond} AND duration > 0) * 100) / 100, 0.0) AS {prefix}avg_session_duration,
  cast(coalesce(sum(total_revenue_usd) FILTER ({cond}), 0) AS bigint) AS {prefix}total_revenue"""


@query("overview_totals", sql(f"""
SELECT s.*, v.total_screen_views, v.prev_total_screen_views,
  total_screen_views::double / total_sessions::double AS views_per_session,
  prev_total_screen_views::double / prev_total_sessions::double AS prev_views_per_session
FROM (SELECT tenant_id, shop_id, {_overview_side('', _H.replace('created_at', 'started_at'))}, {_overview_side('prev_', _P.replace('created_at', 'started_at'))}
      FROM se GROUP BY ALL) s
JOIN (SELECT tenant_id, shop_id, count(*) FILTER ({_H}) AS total_screen_views, count(*) FILTER ({_P}) AS prev_total_screen_views
      FROM ev WHERE {_VIEW} GROUP BY ALL) v USING (tenant_id, shop_id)"""))
def _(t):
    return T.overview(t.ev, t.se, HALF)


_S = f"""tenant_id, shop_id, date_trunc('day', created_at) AS bucket, count(DISTINCT device_id) AS unique_visitors,
  count(DISTINCT session_id) AS total_sessions, count(*) FILTER ({_VIEW}) AS total_screen_views,
  cast(round({_USD} * 0.89) AS bigint) AS total_revenue"""


@query("overview_series", sql("""
SELECT c.tenant_id, c.shop_id, c.bucket, c.unique_visitors, c.total_sessions, c.total_screen_views, c.total_revenue,
  c.total_screen_views::double / c.total_sessions::double AS views_per_session,
  p.unique_visitors AS prev_unique_visitors, p.total_sessions AS prev_total_sessions, p.total_screen_views AS prev_total_screen_views,
  p.total_revenue AS prev_total_revenue, p.total_screen_views::double / p.total_sessions::double AS prev_views_per_session,
  0.0::double AS bounce_rate, 0.0::double AS avg_session_duration,
  CASE WHEN p.i IS NOT NULL THEN 0.0::double END AS prev_bounce_rate, CASE WHEN p.i IS NOT NULL THEN 0.0::double END AS prev_avg_session_duration
FROM cur c LEFT JOIN prev p ON c.shop_id = p.shop_id AND c.tenant_id = p.tenant_id AND c.i = p.i""",
    f"cur AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY bucket) AS i FROM (SELECT {_S} FROM evs WHERE {_H} GROUP BY ALL))",
    f"prev AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY bucket) AS i FROM (SELECT {_S} FROM evs WHERE {_P} GROUP BY ALL))"))
def _(t):
    return T.overview_series(t.during(HALF), HALF, "day", "EUR")


@query("overview_auto_interval", sql(f"""SELECT tenant_id, shop_id, date_trunc('hour', created_at) AS bucket, count(DISTINCT device_id) AS unique_visitors, count(DISTINCT session_id) AS total_sessions
FROM evs WHERE created_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-16' GROUP BY ALL"""))
def _(t):
    """The bucket size that suits a range of a day."""
    period = resolve_period(datetime(2024, 1, 16), "24h")
    return T.overview_series(t.evs, period, resolve_interval(None, "24h")).select("tenant_id", "shop_id", "bucket", "unique_visitors", "total_sessions")


for _col in T.TOP_COLUMNS:
    query(f"top_{_col}", sql(f"""
    SELECT tenant_id, shop_id, coalesce(nullif({_col}, ''), 'Unknown') AS item, count(DISTINCT session_id) AS sessions,
      count(*) FILTER ({_VIEW}) AS pageviews, {_USD} AS revenue
    FROM evs WHERE {_M} {_RANK.format('sessions', 'item', 10)}"""))(
        lambda t, c=_col: T.top_dimension(t.during(MONTH), c, MONTH))


@query("top_pages", sql(f"""
SELECT tenant_id, shop_id, coalesce(nullif(path, ''), '/') AS item, count(DISTINCT session_id) AS sessions, count(*) AS pageviews,
  {_USD} AS revenue FROM evs WHERE {_M} AND ({_VIEW} OR path <> '') {_RANK.format('pageviews', 'item', 10)}"""))
def _(t):
    return T.top_pages(t.during(MONTH), MONTH)


@query("top_pages_all", sql(f"""
SELECT tenant_id, shop_id, path || '/' || device_id AS item, count(DISTINCT session_id) AS sessions, count(*) AS pageviews,
  {_USD} AS revenue FROM evs WHERE {_M} {_RANK.format('pageviews', 'item', 250)}"""))
def _(t):
    """More than a hundred pages: one for each path and device."""
    return T.top_pages(t.during(MONTH).withColumn("path", F.concat_ws("/", "path", "device_id")), MONTH, limit=250)


for _mode, _path, _at in [("entry", "entry_path", "started_at"), ("exit", "exit_path", "ended_at")]:
    query(f"top_{_mode}_pages", sql(f"""
    SELECT tenant_id, shop_id, {_path} AS item, count(*) AS sessions, cast(sum(events_count) AS bigint) AS pageviews,
      cast(sum(total_revenue_usd) AS bigint) AS revenue
    FROM se WHERE {_M.replace('created_at', _at)} AND {_path} <> '' {_RANK.format('sessions', 'item', 10)}"""))(
        lambda t, m=_mode: T.top_session_pages(t.se, m, MONTH))


@query("country_map", sql(f"""
SELECT tenant_id, shop_id, country, count(DISTINCT session_id) AS count, 0.0::double AS lat, 0.0::double AS lng
FROM evs WHERE {_M} AND country <> '' GROUP BY ALL"""))
def _(t):
    return T.country_map(t.during(MONTH), MONTH)


@query("country_map_all", sql(f"""
SELECT tenant_id, shop_id, device_id AS country, count(DISTINCT session_id) AS count, 0.0::double AS lat, 0.0::double AS lng
FROM evs WHERE {_M} AND device_id <> '' GROUP BY ALL"""))
def _(t):
    """More codes than there are countries: device ids stand in for them."""
    return T.country_map(t.during(MONTH).withColumn("country", F.col("device_id")), MONTH)


@query("country_shares", sql(f"""
SELECT tenant_id, shop_id, country, count, count::double / max(count) OVER w::double AS share_of_max,
  count::double / (sum(count) OVER w)::double AS share_of_total
FROM (SELECT tenant_id, shop_id, lower(country) AS country, count(DISTINCT session_id) AS count FROM evs WHERE {_M} AND country <> '' GROUP BY ALL)
WINDOW w AS (PARTITION BY tenant_id, shop_id)""".replace("max(count) OVER w::double", "(max(count) OVER w)::double")))
def _(t):
    return T.country_shares(T.country_map(t.during(MONTH), MONTH))


@query("top_events", sql(f"""
SELECT tenant_id, shop_id, name, count(*) AS count, count(DISTINCT device_id) AS unique_visitors FROM ev WHERE {_M}
{_RANK.format('count', 'name', 10)}"""))
def _(t):
    return T.top_events(t.ev, MONTH)


@query("top_conversions", sql(f"""
SELECT tenant_id, shop_id, name, count(*) AS count, count(DISTINCT device_id) AS unique_visitors FROM ev
WHERE {_M} AND (coalesce(revenue, 0) > 0 OR name IN ('purchase', 'add_to_cart', 'cart_view', 'checkout_step', 'checkout', 'subscribe'))
{_RANK.format('count', 'name', 10)}"""))
def _(t):
    return T.top_conversions(t.ev, MONTH)


@query("top_outbound_links", sql(f"""
SELECT tenant_id, shop_id, referrer AS item, count(*) AS count, count(DISTINCT device_id) AS unique_visitors FROM ev
WHERE {_M} AND name = 'error' AND referrer <> '' {_RANK.format('count', 'item', 10)}"""))
def _(t):
    # The test events hold no outbound links: error events stand in, with the referrer as their target.
    ev = t.ev.where(F.col("name") == "error").withColumn("name", F.lit("link_out")).withColumn(
        "properties", F.create_map(F.lit("href"), F.col("referrer")))
    return T.top_outbound_links(ev, MONTH)


@query("top_origins", sql(f"SELECT tenant_id, shop_id, origin, count(*) AS count FROM ev WHERE {_M} GROUP BY ALL"))
def _(t):
    return T.top_origins(t.ev, AS_OF)


@query("top_pages_with_rest", sql(f"""
SELECT tenant_id, shop_id, CASE WHEN r <= 3 THEN item ELSE '(rest)' END AS item, cast(sum(pageviews) AS bigint) AS pageviews
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY pageviews DESC, item) AS r FROM (
  SELECT tenant_id, shop_id, path AS item, count(*) AS pageviews FROM ev WHERE path <> '' GROUP BY ALL)) GROUP BY ALL"""))
def _(t):
    counts = t.ev.where(F.col("path") != "").groupBy("tenant_id", "shop_id", F.col("path").alias("item")).agg(
        F.count(F.lit(1)).alias("pageviews"))
    return T.top_with_rest(counts, "item", "pageviews", 3)


_DAYS = "unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS bucket"


@query("top_country_series", sql("""
SELECT b.tenant_id, b.shop_id, b.item, b.bucket, coalesce(s.sessions, 0) AS sessions, coalesce(s.pageviews, 0) AS pageviews
FROM best b LEFT JOIN s USING (tenant_id, shop_id, item, bucket)""",
    f"""best AS (SELECT *, {_DAYS} FROM (SELECT tenant_id, shop_id, coalesce(nullif(country, ''), 'Unknown') AS item, count(DISTINCT session_id) AS n
      FROM evs WHERE {_M} {_RANK.format('n', 'item', 10)}))""",
    f"""s AS (SELECT tenant_id, shop_id, coalesce(nullif(country, ''), 'Unknown') AS item, date_trunc('day', created_at) AS bucket,
      count(DISTINCT session_id) AS sessions, count(*) FILTER ({_VIEW}) AS pageviews FROM evs WHERE {_M} GROUP BY ALL)"""))
def _(t):
    return T.top_series(t.during(MONTH), "country", MONTH)


@query("top_page_series", sql("""
SELECT b.tenant_id, b.shop_id, b.item, b.bucket, coalesce(s.pageviews, 0) AS pageviews
FROM best b LEFT JOIN s USING (tenant_id, shop_id, item, bucket)""",
    f"""best AS (SELECT *, {_DAYS} FROM (SELECT tenant_id, shop_id, coalesce(nullif(path, ''), '/') AS item, count(*) AS n
      FROM evs WHERE {_M} AND ({_VIEW} OR path <> '') {_RANK.format('n', 'item', 10)}))""",
    f"""s AS (SELECT tenant_id, shop_id, coalesce(nullif(path, ''), '/') AS item, date_trunc('day', created_at) AS bucket, count(*) AS pageviews
      FROM evs WHERE {_M} AND ({_VIEW} OR path <> '') GROUP BY ALL)"""))
def _(t):
    return T.page_series(t.during(MONTH), MONTH)


@query("referrer_period_change", sql("""
SELECT *, CASE WHEN current <> previous AND least(current, previous) <> 0
    THEN round((greatest(current, previous)::double / least(current, previous) - 1) * 100 * 10) / 10 END AS diff,
  CASE WHEN current > previous THEN 'positive' WHEN current < previous THEN 'negative' ELSE 'neutral' END AS state,
  CASE WHEN previous <> 0 THEN round((current::double / previous - 1) * 100 * 10) / 10 END AS change_pct
FROM c""", f"""c AS (SELECT tenant_id, shop_id, coalesce(nullif(referrer_name, ''), 'Unknown') AS item,
  count(DISTINCT CASE WHEN {_H} THEN session_id END) AS current, count(DISTINCT CASE WHEN {_P} THEN session_id END) AS previous
  FROM evs GROUP BY ALL)"""))
def _(t):
    return T.period_change(t.during(HALF), "referrer_name", HALF)


_L60 = "created_at BETWEEN TIMESTAMP '2024-01-16' - INTERVAL 60 MINUTE AND TIMESTAMP '2024-01-16'"


@query("live_visitors", sql(f"""
SELECT tenant_id, shop_id, 'active_shoppers' AS kind, '' AS item, count(DISTINCT device_id) AS value FROM live GROUP BY ALL
UNION ALL SELECT tenant_id, shop_id, 'device', device AS item, count(*) FROM live WHERE device <> '' GROUP BY ALL
UNION ALL (SELECT tenant_id, shop_id, 'country', country AS item, count(*) AS n FROM live WHERE country <> '' {_RANK.format('n', 'item', 10)})
UNION ALL (SELECT tenant_id, shop_id, 'path', path AS item, count(*) AS n FROM live WHERE path <> '' {_RANK.format('n', 'item', 5)})""",
    f"live AS (SELECT * FROM ev WHERE {_L60})"))
def _(t):
    return T.live_visitors(t.ev, _LIVE, 60)


_L30 = _L60.replace("60 MINUTE", "30 MINUTE")


@query("live_minutes", sql("""
SELECT tot.tenant_id, tot.shop_id, tot.minute, coalesce(p.session_count, 0) AS session_count, coalesce(p.visitor_count, 0) AS visitor_count,
  tot.total_sessions FROM tot LEFT JOIN p USING (tenant_id, shop_id, minute)""",
    f"""tot AS (SELECT *, unnest(generate_series(TIMESTAMP '2024-01-15 23:30:00', TIMESTAMP '2024-01-16', INTERVAL 1 MINUTE)) AS minute
      FROM (SELECT tenant_id, shop_id, count(DISTINCT session_id) AS total_sessions FROM evs WHERE {_L30} GROUP BY ALL))""",
    f"""p AS (SELECT tenant_id, shop_id, date_trunc('minute', created_at) AS minute, count(DISTINCT session_id) AS session_count,
      count(DISTINCT device_id) AS visitor_count FROM evs WHERE {_L30} GROUP BY ALL)"""))
def _(t):
    return T.live_minutes(t.evs, _LIVE)


@query("live_referrers", sql(f"""
SELECT tenant_id, shop_id, coalesce(nullif(referrer_name, ''), 'Direct') AS referrer, count(DISTINCT session_id) AS count
FROM evs WHERE {_L30} GROUP BY 1, 2, 3
QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY count DESC, coalesce(nullif(referrer_name, ''), 'Direct')) <= 10"""))
def _(t):
    return T.live_referrers(t.evs, _LIVE)


@query("live_minute_referrers", sql(f"""
SELECT tenant_id, shop_id, date_trunc('minute', created_at) AS minute, referrer_name, count(DISTINCT session_id) AS count
FROM evs WHERE {_L30} AND referrer_name <> '' GROUP BY ALL"""))
def _(t):
    return T.live_minute_referrers(t.evs, _LIVE)


@query("badge_visitors", sql(f"SELECT tenant_id, shop_id, count(DISTINCT device_id) AS unique_visitors FROM ev WHERE {_M} GROUP BY ALL"))
def _(t):
    return T.badge_visitors(t.ev, AS_OF)


_WHO = "coalesce(customer_id, device_id)"


@query("project_card", sql(f"""
SELECT *, CASE WHEN previous_three_months > 0 AND three_months > previous_three_months THEN 'up'
    WHEN previous_three_months > 0 AND three_months < previous_three_months AND three_months > 0 THEN 'down' ELSE 'neutral' END AS direction,
  CASE WHEN previous_three_months > 0 AND three_months > 0 THEN abs(round((three_months - previous_three_months)::double
    / previous_three_months * 100)) END AS percentage
FROM (SELECT tenant_id, shop_id, count(DISTINCT {_WHO}) FILTER (started_at >= TIMESTAMP '2023-10-31') AS three_months,
  count(DISTINCT {_WHO}) FILTER (started_at < TIMESTAMP '2023-10-31') AS previous_three_months,
  count(DISTINCT {_WHO}) FILTER (started_at >= TIMESTAMP '2023-12-31') AS one_month,
  count(DISTINCT {_WHO}) FILTER (started_at >= TIMESTAMP '2024-01-30') AS one_day,
  count(DISTINCT {_WHO}) FILTER (started_at >= TIMESTAMP '2024-01-29' AND started_at < TIMESTAMP '2024-01-30') AS previous_day,
  cast(sum(total_revenue_usd) AS bigint) AS revenue FROM se GROUP BY ALL)"""))
def _(t):
    return T.project_card(t.se, AS_OF)


@query("project_card_series", sql(f"""
SELECT b.tenant_id, b.shop_id, b.bucket, coalesce(visitors, 0) AS visitors, coalesce(revenue, 0) AS revenue
FROM (SELECT tenant_id, shop_id, unnest(generate_series(TIMESTAMP '2023-10-31', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS bucket
      FROM (SELECT DISTINCT tenant_id, shop_id FROM se)) b
LEFT JOIN (SELECT tenant_id, shop_id, date_trunc('day', started_at) AS bucket, count(DISTINCT {_WHO}) AS visitors,
      cast(sum(total_revenue_usd) AS bigint) AS revenue FROM se GROUP BY ALL) d USING (tenant_id, shop_id, bucket)"""))
def _(t):
    return T.project_card_series(t.se, AS_OF)


@query("tenant_volume", sql(f"""
SELECT tenant_id, date_trunc('day', created_at) AS bucket, count(*) AS count FROM ev WHERE {_M} GROUP BY ALL"""))
def _(t):
    return T.tenant_volume(t.ev, MONTH)


def _referring_sql(where):
    cur, prev = _H.replace("created_at", "started_at"), "started_at >= TIMESTAMP '2024-01-01' AND started_at < TIMESTAMP '2024-01-16'"
    return sql(f"""
    SELECT b.*, p.total, p.previous_total FROM best b
    JOIN (SELECT tenant_id, shop_id, count(*) FILTER ({cur}) AS total, count(*) FILTER ({prev}) AS previous_total FROM se WHERE {where} GROUP BY ALL) p USING (tenant_id, shop_id)""",
        f"""best AS (SELECT tenant_id, shop_id, lower(referrer_name) AS item, count(*) AS sessions FROM se WHERE {cur} AND {where}
          {_RANK.format('sessions', 'item', 10)})""")


@query("search_engines", _referring_sql("referrer_type = 'search'").replace("lower(referrer_name)", "referrer_name"))
def _(t):
    return T.search_engines(t.se, HALF)


@query("ai_engines", _referring_sql("referrer_name IN ('Reddit', 'Twitter')"))
def _(t):
    # The test referrers hold no assistants: two of their names stand in for the host list.
    return T.ai_engines(t.se, HALF, hosts=("Reddit.com", "Twitter.com"))


# --- named ranges ---

_RANGE_END = datetime(2024, 1, 20, 15, 30)
_RANGES = {
    "today": "date_trunc('day', e), e", "yesterday": "date_trunc('day', e) - INTERVAL 1 DAY, date_trunc('day', e) - INTERVAL 1 MICROSECOND",
    "lastHour": "e - INTERVAL 1 HOUR, e", "last24h": "e - INTERVAL 24 HOUR, e", "30min": "e - INTERVAL 30 MINUTE, e", "90d": "e - INTERVAL 90 DAY, e", "12m": "e - INTERVAL 365 DAY, e",
    "3m": "date_trunc('day', e) - INTERVAL 3 MONTH, e", "6m": "date_trunc('day', e) - INTERVAL 6 MONTH, e", "monthToDate": "date_trunc('month', e), e",
    "lastMonth": "date_trunc('month', e) - INTERVAL 1 MONTH, date_trunc('month', e) - INTERVAL 1 MICROSECOND", "yearToDate": "date_trunc('year', e), e",
    "lastYear": "date_trunc('year', e) - INTERVAL 1 YEAR, date_trunc('year', e) - INTERVAL 1 MICROSECOND",
}


# Whole-month ranges end in February, so that they hold events of January.
_RANGE_CTES = ["ends AS (SELECT TIMESTAMP '2024-01-20 15:30:00' AS e, 0 AS later UNION ALL SELECT TIMESTAMP '2024-02-20 15:30:00', 1)",
               "ranges(key, a, b, later) AS (" + " UNION ALL ".join(f"SELECT '{k}', {bounds}, later FROM ends WHERE later = {int(k == 'lastMonth')}" for k, bounds in _RANGES.items()) + ")"]


@query("named_ranges", sql("SELECT tenant_id, shop_id, key, count(*) AS events, count(DISTINCT device_id) AS visitors FROM ev JOIN ranges ON created_at BETWEEN a AND b GROUP BY ALL", *_RANGE_CTES))
def _(t):
    at = F.col("created_at")
    hits = [F.when(resolve_period(_RANGE_END.replace(month=2) if key == "lastMonth" else _RANGE_END, key).current(at), F.lit(key)) for key in _RANGES]
    rows = t.ev.withColumn("key", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return rows.groupBy("tenant_id", "shop_id", "key").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("device_id").alias("visitors"))
