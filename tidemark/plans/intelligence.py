"""Insight cards, realtime map and search-console reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.numbers import round_to
from tidemark.operators import insights as I
from tidemark.operators import realtime as R
from tidemark.operators import search_console as G
from tidemark.plans.registry import AS_OF, HALF, MONTH, query, sql
from tidemark.schema import SHOP

_DAY = "created_at >= TIMESTAMP '2024-01-30' AND created_at <= TIMESTAMP '2024-01-31'"
_WEEK = "created_at >= TIMESTAMP '2024-01-23' AND created_at < TIMESTAMP '2024-01-30'"
_BOTH = "created_at >= TIMESTAMP '2024-01-23' AND created_at <= TIMESTAMP '2024-01-31'"
_H = "created_at BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-31'"
_P = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-16'"
_TREND = """CASE WHEN base > 0 THEN (cur - base) / base * 100 WHEN cur > 0 THEN 100.0 ELSE 0.0 END AS pct"""
_WAY = "CASE WHEN pct > 5 THEN 'up' WHEN pct < -5 THEN 'down' ELSE 'flat' END"
_ARROW = "CASE WHEN pct > 5 THEN '↑' WHEN pct < -5 THEN '↓' ELSE '→' END"


def _top(select, order, k, by="tenant_id, shop_id"):
    return f"SELECT * FROM ({select}) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}) <= {k}"


def _cards(module, source, dim, title, summary, way, pct, cur, compare, impact):
    return f"""SELECT sha256(concat_ws(':', cast(shop_id AS varchar), '{module}', {dim}, '2024-01-31T00:00:00')) AS id, tenant_id, shop_id, '{module}' AS module_key, {dim} AS dimension_key,
      'rolling_24h' AS window_kind, {title} AS title, {summary} AS summary, {way} AS direction, round({pct} * 10000) / 10000 AS change_pct, {cur}::double AS current_val,
      {compare}::double AS compare_val, round({impact} * 10000) / 10000 AS impact_score, TIMESTAMP '2024-01-31' AS created_at FROM ({source})"""


def _counts(dim, where="true"):
    return f"""SELECT *, {_TREND} FROM (SELECT tenant_id, shop_id, {dim} AS dim, (count(*) FILTER ({_DAY}))::double AS cur,
      round((count(*) FILTER ({_WEEK}))::double / 7.0, 1) AS base FROM ev WHERE {_BOTH} AND {where} GROUP BY ALL)"""


_REF = _cards("referrers", _top(f"SELECT * FROM ({_counts(chr(99) + 'oalesce(nullif(referrer_name, ' + chr(39) * 2 + '), ' + chr(39) + 'Direct / None' + chr(39) + ')')}) WHERE cur >= 1 OR base >= 1", "cur DESC, dim", 10),
              "'referrer:' || dim", f"CASE WHEN base = 0 AND cur > 0 THEN 'New acquisition source: ' || dim ELSE 'Traffic from ' || dim || ' ' || {_ARROW} || printf(' %.0f%% (24h)', abs(pct)) END",
              "printf('Last 24h: %.0f sessions vs %.1f daily baseline.', cur, base)", _WAY, "pct", "cur", "base", "abs(pct) * ln(1 + cur)")
_CART = _cards("cart_trends", f"""SELECT *, {_TREND} FROM (SELECT tenant_id, shop_id, (count(*) FILTER (name = 'add_to_cart' AND {_DAY}))::double AS cur,
  round((count(*) FILTER (name = 'add_to_cart' AND {_WEEK}))::double / 7.0, 1) AS base, coalesce(sum(revenue) FILTER ({_DAY}), 0)::double / 100.0 AS rev FROM ev WHERE {_BOTH} GROUP BY ALL)
  WHERE cur > 0 OR base > 0""", "'cart_adds:24h'", f"CASE WHEN {_WAY} = 'flat' THEN printf('Cart additions steady at %.0f', cur) ELSE 'Cart additions ' || {_ARROW} || printf(' %.0f%% (24h)', abs(pct)) END",
    "printf('%.0f cart additions in the last 24h compared to %.1f daily baseline (Revenue: $%.2f).', cur, base, rev)", _WAY, "pct", "cur", "base", "abs(pct) * ln(1 + cur)")
_DEVICE = _cards("devices", f"""SELECT *, orders / cur * 100 AS pct FROM (SELECT tenant_id, shop_id, coalesce(nullif(device, ''), 'desktop') AS dim, count(*)::double AS cur,
  (count(*) FILTER (name = 'purchase'))::double AS orders FROM ev WHERE {_DAY} GROUP BY ALL) WHERE cur >= 5""", "'device:' || dim",
    "dim || printf(' device activity (%.0f events, %.1f%% orders)', cur, pct)",
    "'Shoppers on ' || dim || printf(' generated %.0f total interactions and %.0f completed orders in the last 24 hours.', cur, orders)", "'flat'", "pct", "cur", "orders", "cur")
_PAGE = _cards("top_pages", _top(f"SELECT * FROM ({_counts('path', chr(112) + 'ath <> ' + chr(39) * 2)}) WHERE cur >= 5", "cur DESC, dim", 5), "'page:' || dim", "'High velocity page: ' || dim",
    f"printf('%.0f visits in the last 24h (Daily baseline: %.1f). Trending ', cur, base) || {_WAY} || '.'", _WAY, "pct", "cur", "base", "cur * 1.2")


def _rounded(df):
    return df.withColumn("change_pct", round_to(F.col("change_pct"), 4)).withColumn("impact_score", round_to(F.col("impact_score"), 4))


query("insight_referrers", sql(_REF))(lambda t: _rounded(I.referrer_cards(t.ev, AS_OF)))
query("insight_carts", sql(_CART))(lambda t: _rounded(I.cart_cards(t.ev, AS_OF)))
query("insight_devices", sql(_DEVICE))(lambda t: _rounded(I.device_cards(t.ev, AS_OF)))
query("insight_pages", sql(_PAGE))(lambda t: _rounded(I.page_cards(t.ev, AS_OF)))
_ALL = f"cards AS ({_REF} UNION ALL {_CART} UNION ALL {_DEVICE} UNION ALL {_PAGE})"
query("insight_cards", sql("SELECT * FROM cards", _ALL))(lambda t: _rounded(I.daily_insights(t.ev, AS_OF)))


@query("insight_list", sql(_top("""SELECT *, CASE WHEN impact_score > 100 THEN 'severe' WHEN impact_score > 30 THEN 'moderate' ELSE 'subtle' END AS severity_band,
  split_part(dimension_key, ':', 1) AS dimension, substr(dimension_key, strpos(dimension_key, ':') + 1) AS dimension_value, CASE module_key WHEN 'cart_trends' THEN 'share' ELSE 'sessions' END AS metric,
  CASE module_key WHEN 'cart_trends' THEN 'ratio' ELSE 'count' END AS unit, current_val - compare_val AS delta FROM cards""", "impact_score DESC, created_at DESC, id", 10), _ALL))
def _(t):
    return I.insight_list(_rounded(I.daily_insights(t.ev, AS_OF)))


# Stored cards of several windows are derived from events: one per shop, path and window.
_STORED = f"""st AS (SELECT cast(min(id) AS varchar) AS id, tenant_id, shop_id, device AS module_key, path AS dimension_key,
  CASE product_id % 3 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'rolling_7d' ELSE 'rolling_30d' END AS window_kind, 'Card ' || path AS title, 'from ' || device AS summary, 'up' AS direction,
  count(*)::double AS impact_score, CASE WHEN count(*) % 3 > 0 THEN (count(*) % 11)::double END AS relevance_score,
  CASE WHEN count(*) > 40 THEN 'severe' WHEN count(*) > 25 THEN 'moderate' END AS severity_band, max(created_at) AS created_at
  FROM ev WHERE device <> '' AND path <> '' GROUP BY tenant_id, shop_id, device, path, product_id % 3)"""


def _stored(t):
    kind = F.when(F.col("product_id") % 3 == 0, F.lit("yesterday")).when(F.col("product_id") % 3 == 1, F.lit("rolling_7d")).otherwise(F.lit("rolling_30d"))
    n = F.count(F.lit(1))
    return t.ev.where((F.col("device") != "") & (F.col("path") != "")).groupBy(*SHOP, F.col("device").alias("module_key"), F.col("path").alias("dimension_key"), kind.alias("window_kind")).agg(
        F.min("id").cast("string").alias("id"), F.concat(F.lit("Card "), F.first("path")).alias("title"), F.concat(F.lit("from "), F.first("device")).alias("summary"), F.lit("up").alias("direction"),
        n.cast("double").alias("impact_score"), F.when(n % 3 > 0, (n % 11).cast("double")).alias("relevance_score"),
        F.when(n > 40, F.lit("severe")).when(n > 25, F.lit("moderate")).alias("severity_band"), F.max("created_at").alias("created_at"))


@query("insight_dedupe", sql(_top("""SELECT * FROM (SELECT * FROM st
  QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id, module_key, dimension_key ORDER BY CASE window_kind WHEN 'yesterday' THEN 1 WHEN 'rolling_7d' THEN 2 ELSE 3 END,
    relevance_score DESC NULLS LAST, impact_score DESC, id) = 1)""", "coalesce(relevance_score, -1) DESC, impact_score DESC, id", 20), _STORED))
def _(t):
    return I.dedupe_windows(_stored(t))


for _sort, _order in [("relevance", "coalesce(relevance_score, -1) DESC, impact_score DESC"), ("impact-asc", "impact_score"), ("severity-desc", "CASE severity_band WHEN 'severe' THEN 3 WHEN 'moderate' THEN 2 ELSE 0 END DESC"),
                      ("recent", "created_at DESC")]:
    query(f"insight_feed_{_sort.replace('-', '_')}", sql(f"""SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY {_order}, id) AS int) AS position FROM st
    WHERE module_key = 'mobile' AND lower(title || ' ' || summary || ' ' || dimension_key) LIKE '%/p/%'""", _STORED))(
        lambda t, s=_sort: I.insight_feed(_stored(t), s, module="mobile", text="/P/"))


@query("insight_modules", sql("""SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY CASE module_key WHEN 'referrers' THEN 1 ELSE 0 END DESC, avg_impact DESC, module_key) AS int) AS position
FROM (SELECT tenant_id, shop_id, module_key, count(*) AS cards, avg(impact_score) AS avg_impact FROM st GROUP BY ALL)""", _STORED))
def _(t):
    return I.module_ranking(_stored(t))


_EXPLAIN = " UNION ALL ".join(f"SELECT tenant_id, shop_id, '{c}' AS col, {c} AS value, session_id, created_at FROM evs" for c in I.EXPLAIN_COLUMNS)


def _explain_side(name, cond):
    return _top(f"SELECT tenant_id, shop_id, col, value, count(DISTINCT session_id) AS {name} FROM px WHERE {cond} GROUP BY ALL", f"{name} DESC, value", 8, "tenant_id, shop_id, col")


@query("insight_explain_breakdowns", sql(f"""SELECT tenant_id, shop_id, col AS "column", value, current, baseline FROM ({_explain_side('current', _H)})
FULL JOIN ({_explain_side('baseline', _P)}) USING (tenant_id, shop_id, col, value)""", f"px AS ({_EXPLAIN})"))
def _(t):
    return I.explain_breakdowns(t.during(HALF), HALF)


@query("insight_explain_series", sql(" UNION ALL ".join(f"""SELECT tenant_id, shop_id, '{p}' AS period, date_trunc('day', created_at) AS date, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (name IN ('page_view', 'screen_view')) AS pageviews FROM evs WHERE {w} AND referrer_name = 'Google' GROUP BY ALL""" for p, w in (("current", _H), ("previous", _P)))))
def _(t):
    return I.explain_series(t.during(HALF), HALF, "referrer_name", "Google")


@query("insight_references", sql(_top("""SELECT tenant_id, shop_id, created_at AS date, 'note ' || id AS title FROM ev WHERE name = 'error'
  AND created_at BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-02-01'""", "date DESC, title", 10)))
def _(t):
    notes = t.ev.where(F.col("name") == "error").select(*SHOP, F.col("created_at").alias("date"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("title"))
    return I.nearby_references(notes, HALF)


@query("referrer_spikes", sql("""
SELECT s.tenant_id, s.shop_id, s.referrer_name, cluster, anchor_date, s.date, s.sessions, s.zscore FROM spikes s JOIN d USING (tenant_id, shop_id, date)
JOIN (SELECT tenant_id, shop_id, cluster, arg_max(date, (zscore, sessions, date)) AS anchor_date FROM spikes JOIN d USING (tenant_id, shop_id, date) GROUP BY ALL) USING (tenant_id, shop_id, cluster)""",
    """c AS (SELECT tenant_id, shop_id, referrer_name, date_trunc('day', created_at) AS date, count(DISTINCT session_id) AS sessions FROM evs WHERE referrer_name <> '' GROUP BY ALL)""",
    """spikes AS (SELECT * FROM (SELECT c.*, round((sessions - m) / nullif(sd, 0) * 10000) / 10000 AS zscore FROM c JOIN (
      SELECT tenant_id, shop_id, referrer_name, avg(sessions) AS m, stddev_pop(sessions) AS sd FROM c GROUP BY ALL) USING (tenant_id, shop_id, referrer_name)) WHERE zscore >= 1.5 AND sessions >= 5)""",
    """d AS (SELECT tenant_id, shop_id, date, cast(sum(n) OVER (PARTITION BY tenant_id, shop_id ORDER BY date) AS int) AS cluster FROM (
      SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY tenant_id, shop_id ORDER BY date) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT tenant_id, shop_id, date FROM spikes)))"""))
def _(t):
    return I.referrer_spikes(t.during(MONTH), MONTH, threshold=1.5)


# --- realtime: a February clock makes the day empty, a later one the week too ---

_FEB, _MARCH = datetime(2024, 2, 3), datetime(2024, 3, 1)
_AGG = "count(*) AS count, count(DISTINCT session_id) AS unique_sessions, 0.0::double AS avg_duration"


@query("realtime_paths", sql(_top(f"SELECT tenant_id, shop_id, origin, path, {_AGG} FROM evs WHERE path <> '' AND created_at >= TIMESTAMP '2024-01-30' GROUP BY ALL", "count DESC, path, origin", 50)))
def _(t):
    return R.paths(t.evs, AS_OF)


@query("realtime_geo", sql(_top(f"SELECT tenant_id, shop_id, country, city, {_AGG} FROM evs WHERE length(country) = 2 AND created_at >= TIMESTAMP '2024-01-27' GROUP BY ALL", "count DESC, country, city", 50)))
def _(t):
    return R.geo(t.evs, _FEB)


@query("realtime_referrals", sql(_top(f"SELECT tenant_id, shop_id, coalesce(nullif(referrer_name, ''), 'Direct') AS referrer_name, {_AGG} FROM evs GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
                                      "count DESC, referrer_name", 50)))
def _(t):
    return R.referrals(t.evs, _MARCH)


@query("realtime_referral_durations", sql(_top("""SELECT tenant_id, shop_id, coalesce(nullif(referrer_name, ''), 'Direct') AS referrer_name, count(*) AS count, count(DISTINCT session_id) AS unique_sessions,
  round(avg(product_id * 1000) / 1000 * 100) / 100 AS avg_duration FROM evs WHERE created_at >= TIMESTAMP '2024-01-30' GROUP BY 1, 2, 3""", "count DESC, referrer_name", 50)))
def _(t):
    return R.referrals(t.evs.withColumn("duration", F.col("product_id") * 1000), AS_OF, durations=True)


@query("realtime_coordinates", sql(_top("""SELECT tenant_id, shop_id, country, city, coalesce(longitude, -97.82::double) AS long, coalesce(latitude, 37.75::double) AS lat, count(DISTINCT session_id) AS count
FROM evs WHERE created_at >= TIMESTAMP '2024-01-30' AND (latitude IS NOT NULL OR length(country) = 2) GROUP BY ALL""", "count DESC, country, city, lat, long", 500)))
def _(t):
    return R.coordinates(t.evs, AS_OF)


@query("realtime_active_events", sql(_top("""SELECT tenant_id, shop_id, id, name, session_id, created_at, path, origin, os, browser, device, coalesce(nullif(referrer_name, ''), 'Direct') AS referrer_name
FROM evs""", "created_at DESC, id DESC", 50)))
def _(t):
    return R.active_events(t.evs)


_PLACES = [{"country": "US", "city": "New York", "lat": 40.71, "long": -74.0}, {"country": "JP", "city": "Osaka", "lat": 35.7, "long": 139.6}, {"country": "GB", "city": ""}]
_AT = """created_at BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31' AND ((country = 'US' AND city = 'New York') OR (abs(latitude - 40.71) < 0.2 AND abs(longitude + 74.0) < 0.2)
  OR (country = 'JP' AND city = 'Osaka') OR (abs(latitude - 35.7) < 0.2 AND abs(longitude - 139.6) < 0.2) OR country = 'GB')"""


@query("map_badge_summary", sql(f"""SELECT tenant_id, shop_id, count(DISTINCT session_id) AS total_sessions, count(DISTINCT customer_id) AS total_profiles, 3 AS total_locations,
  3 AS total_countries, 2 AS total_cities FROM evs WHERE {_AT} GROUP BY ALL"""))
def _(t):
    return R.badge_summary(t.evs, AS_OF, _PLACES)


@query("map_badge_top", sql(" UNION ALL ".join(f"({q})" for q in (
    _top(f"SELECT tenant_id, shop_id, 'referrer' AS kind, referrer_name AS item, count(DISTINCT session_id) AS count FROM evs WHERE {_AT} AND referrer_name <> '' GROUP BY ALL", "count DESC, item", 3),
    _top(f"SELECT tenant_id, shop_id, 'path' AS kind, origin || path AS item, count(DISTINCT session_id) AS count FROM evs WHERE {_AT} AND path <> '' GROUP BY ALL", "count DESC, item", 3),
    _top(f"SELECT tenant_id, shop_id, 'event' AS kind, name AS item, count(DISTINCT session_id) AS count FROM evs WHERE {_AT} GROUP BY ALL", "count DESC, item", 3)))))
def _(t):
    return R.badge_top(t.evs, AS_OF, _PLACES)


@query("map_badge_sessions", sql("SELECT * EXCLUDE (tie) FROM (" + _top(f"""SELECT tenant_id, shop_id, session_id, coalesce(last(customer_id ORDER BY created_at, id), session_id) AS id, last(customer_id ORDER BY created_at, id) AS profile_id,
  max(created_at) AS created_at, last(path ORDER BY created_at, id) AS latest_path, last(name ORDER BY created_at, id) AS latest_event, last(city ORDER BY created_at, id) AS city,
  last(country ORDER BY created_at, id) AS country, arg_max(id, (created_at, id)) AS tie FROM evs e WHERE {_AT} GROUP BY tenant_id, shop_id, session_id""", "created_at DESC, tie DESC", 8) + ")"))
def _(t):
    return R.recent_sessions(R.badge_rows(t.evs, AS_OF, _PLACES))


# --- search console: page views stand in for impressions, cart additions for clicks ---

_GSC = """gsc AS (SELECT tenant_id, shop_id, date_trunc('day', created_at) AS date, origin || path AS page, referrer_name || '-' || os AS query,
  count(*) FILTER (name = 'add_to_cart') AS clicks, count(*) * 10 AS impressions, avg(product_id % 30) + 1 AS position FROM ev WHERE path <> '' GROUP BY ALL)"""


def _gsc(t):
    return t.ev.where(F.col("path") != "").groupBy(*SHOP, F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("date"), F.concat("origin", "path").alias("page"),
                                                   F.concat(F.col("referrer_name"), F.lit("-"), F.col("os")).alias("query")).agg(
        F.count_if(F.col("name") == "add_to_cart").alias("clicks"), (F.count(F.lit(1)) * 10).alias("impressions"), (F.avg(F.col("product_id") % 30) + 1).alias("position"))


_TOT = """cast(sum(clicks) AS bigint) AS clicks, cast(sum(impressions) AS bigint) AS impressions, round(sum(clicks)::double / sum(impressions)::double * 1000000) / 1000000 AS ctr,
  round(sum(position * impressions) / sum(impressions)::double * 10000) / 10000 AS position"""
_D = "date BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-31'"
for _name, _keys in (("overview", ["date"]), ("pages", ["page"]), ("queries", ["query"]), ("page_queries", ["page", "query"])):
    query(f"search_console_{_name}", sql(f"SELECT tenant_id, shop_id, {', '.join(_keys)}, {_TOT} FROM gsc WHERE {_D} GROUP BY ALL", _GSC))(
        lambda t, k=_keys: G.by(_gsc(t), HALF, *k))


@query("search_console_compare", sql(f"""SELECT tenant_id, shop_id, 'current' AS period, {_TOT} FROM gsc WHERE {_D} GROUP BY ALL UNION ALL
SELECT tenant_id, shop_id, 'previous', {_TOT} FROM gsc WHERE date BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-16' GROUP BY ALL""", _GSC))
def _(t):
    return G.compare(_gsc(t), HALF)


@query("search_console_cannibalisation", sql(f"""SELECT p.*, n.pages, n.query_impressions FROM (SELECT tenant_id, shop_id, query, page, {_TOT} FROM gsc WHERE {_D} GROUP BY ALL) p
JOIN (SELECT tenant_id, shop_id, query, count(DISTINCT page) AS pages, cast(sum(impressions) AS bigint) AS query_impressions FROM gsc WHERE {_D} GROUP BY ALL) n USING (tenant_id, shop_id, query)
WHERE n.pages >= 2""", _GSC))
def _(t):
    return G.cannibalisation(_gsc(t), HALF)


_SP = f"""sp AS (SELECT tenant_id, shop_id, page, {_TOT.replace('sum(impressions)::double * 10000', 'sum(impressions)::double * 10000')} FROM gsc WHERE {_D} AND query <> '-Linux' GROUP BY ALL)"""
_SITE = """site AS (SELECT tenant_id, shop_id, 'https://shop.example.com' || entry_path AS page, count(*) AS sessions,
  round((count(*) FILTER (events_count <= 1))::double / count(*)::double * 100.0 * 100) / 100 AS bounce_rate FROM se WHERE entry_path <> '' GROUP BY ALL)"""


@query("page_opportunities", sql("""
SELECT * FROM (
  SELECT tenant_id, shop_id, page, 'low_ctr' AS type, impressions * (0.04::double - ctr / 10) AS impact FROM sp WHERE position <= 10 AND ctr / 10 < 0.04 AND impressions >= 100
  UNION ALL SELECT tenant_id, shop_id, page, 'near_page_one', impressions / position FROM sp WHERE position > 10 AND position <= 20 AND impressions >= 100
  UNION ALL SELECT tenant_id, shop_id, page, 'invisible_clicks', impressions::double FROM sp WHERE position > 10 AND ctr / 10 < 0.01 AND impressions >= 500
  UNION ALL SELECT s.tenant_id, s.shop_id, s.page, 'high_bounce', sessions * (b / 100) FROM (SELECT *, bounce_rate + 50 AS b FROM site) s LEFT JOIN sp USING (tenant_id, shop_id, page)
    WHERE CASE WHEN sp.page IS NOT NULL THEN b >= 70 AND sessions >= 20 ELSE b >= 75 AND sessions >= 30 END)""", _GSC, _SP, _SITE))
def _(t):
    pages = G.by(_gsc(t).where(F.col("query") != "-Linux"), HALF, "page").withColumn("ctr", F.col("ctr") / 10)
    site = G.site_pages(t.se, "https://shop.example.com").withColumn("bounce_rate", F.col("bounce_rate") + 50)
    return G.opportunities(pages, site)


_PQ = f"pq AS (SELECT tenant_id, shop_id, page, query, {_TOT} FROM gsc WHERE {_D} GROUP BY ALL)"


@query("ctr_benchmark", sql(f"""SELECT g.tenant_id, g.shop_id, g.position, g.benchmark, m.your_ctr, coalesce(m.pages, 0) AS pages FROM (SELECT tenant_id, shop_id, unnest(generate_series(1, 20))::int AS position,
  unnest([{', '.join(str(v) for v in G.BENCHMARK_CTR)}])::double AS benchmark FROM (SELECT DISTINCT tenant_id, shop_id FROM pq)) g
LEFT JOIN (SELECT tenant_id, shop_id, floor(position + 0.5)::int AS position, round(avg(ctr * 100) * 1000000) / 1000000 AS your_ctr, count(*) AS pages FROM pq WHERE impressions >= 10 GROUP BY 1, 2, 3) m
  USING (tenant_id, shop_id, position)""", _GSC, _PQ))
def _(t):
    return G.ctr_benchmark(G.by(_gsc(t), HALF, "page", "query"))


@query("ctr_benchmark_pages", sql("""SELECT tenant_id, shop_id, pos AS position, page, ctr, impressions FROM (SELECT *, floor(position + 0.5)::int AS pos FROM sp WHERE impressions >= 10)
WHERE pos BETWEEN 1 AND 20 QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id, pos ORDER BY ctr DESC, page) <= 5""", _GSC, _SP))
def _(t):
    return G.benchmark_pages(G.by(_gsc(t).where(F.col("query") != "-Linux"), HALF, "page"))
