"""Chart engine, segments, formulas, tables and the report library."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.predicates import field_filter, identified, search
from tidemark.operators import charts as C
from tidemark.plans.registry import AS_OF, MONTH, query, sql

_M = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"
_VIEW = "(name IN ('screen_view', 'page_view') OR (path <> '' AND name <> 'session_end'))"
_DAYS = "unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS bucket"


@query("chart_aggregate", sql(f"""
SELECT tenant_id, shop_id, CASE WHEN item = '' THEN 'unknown' ELSE item END AS item, count
FROM (SELECT tenant_id, shop_id, referrer_name AS item, count(*) AS count FROM ev WHERE {_M} GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY count DESC, item) <= 50"""))
def _(t):
    return C.aggregate(t.ev, MONTH, "referrer_name")


@query("chart_aggregate_summary", sql(f"""
SELECT tenant_id, shop_id, cast(sum(count) AS bigint) AS sum, round(avg(count) * 100) / 100 AS average, min(count) AS min, max(count) AS max
FROM (SELECT tenant_id, shop_id, path, count(*) AS count FROM ev WHERE {_M} AND {_VIEW} GROUP BY ALL) GROUP BY ALL"""))
def _(t):
    return C.aggregate_summary(C.aggregate(t.ev, MONTH, "path", ["page_view"]))


def _broken(col, where="true"):
    return [f"pts AS (SELECT tenant_id, shop_id, {col} AS item, date_trunc('day', created_at) AS bucket, count(*) AS count FROM ev WHERE {_M} AND {col} <> '' AND {where} GROUP BY ALL)",
            f"""best AS (SELECT tenant_id, shop_id, item, {_DAYS} FROM (SELECT * FROM (SELECT tenant_id, shop_id, item, sum(count) AS n FROM pts GROUP BY ALL)
              QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY n DESC, item) <= 10))""",
            "flat AS (SELECT b.*, coalesce(count, 0) AS count FROM best b LEFT JOIN pts USING (tenant_id, shop_id, item, bucket))"]


@query("chart_breakdown_series", sql("SELECT * FROM flat", *_broken("path")))
def _(t):
    return C.series_by(t.ev, MONTH, "path")


@query("chart_breakdown_two_events", sql("SELECT * FROM flat", *_broken("name", "name IN ('add_to_cart', 'purchase')")))
def _(t):
    return C.series_by(t.ev, MONTH, "name", ["add_to_cart", "purchase"])


_SUM = """SELECT tenant_id, shop_id{by}, cast(sum(count) AS bigint) AS sum, round(avg(count) * 100) / 100 AS average, min(count) AS min, max(count) AS max
FROM {src} GROUP BY ALL"""


@query("chart_series_summary", sql(_SUM.format(by=", item", src="flat"), *_broken("country")))
def _(t):
    return C.series_summary(C.series_by(t.ev, MONTH, "country"), ["item"])


@query("chart_breakdown_summary", sql("""
SELECT tenant_id, shop_id, cast(sum(count) AS bigint) AS sum, round(sum(count) / 31 * 100) / 100 AS average, 0::bigint AS min, cast(sum(count) AS bigint) AS max
FROM flat GROUP BY ALL""", *_broken("os")))
def _(t):
    return C.breakdown_summary(C.series_by(t.ev, MONTH, "os"), 31)


_SINGLE = [f"""one AS (SELECT d.*, coalesce(count, 0) AS count FROM (SELECT tenant_id, shop_id, {_DAYS} FROM (SELECT DISTINCT tenant_id, shop_id FROM ev)) d
  LEFT JOIN (SELECT tenant_id, shop_id, date_trunc('day', created_at) AS bucket, count(*) AS count FROM ev WHERE {_M} AND name = 'purchase' GROUP BY ALL)
  USING (tenant_id, shop_id, bucket))"""]


@query("chart_single_series", sql("SELECT * FROM one", *_SINGLE))
def _(t):
    return C.series(t.ev, MONTH, ["purchase"])


@query("chart_single_summary", sql(_SUM.format(by="", src="one"), *_SINGLE))
def _(t):
    return C.series_summary(C.series(t.ev, MONTH, ["purchase"]))


# --- filters ---

_FILTERS = {
    "is": ("os", ["macOS"], "os = 'macOS'"), "is_many": ("country", ["US", "DE"], "country IN ('US', 'DE')"),
    "isNot": ("browser", ["Chrome"], "browser <> 'Chrome'"), "isNot_many": ("city", ["Berlin", "Tokyo"], "city NOT IN ('Berlin', 'Tokyo')"),
    "contains": ("path", ["P/1"], "path ILIKE '%p/1%'"), "doesNotContain": ("referrer_name", ["o"], "referrer_name NOT ILIKE '%o%'"),
    "startsWith": ("referrer_name", ["goo"], "referrer_name ILIKE 'goo%'"), "endsWith": ("device", ["TOP"], "device ILIKE '%top'"),
    "isNull": ("device", [], "(device IS NULL OR device = '')"), "isNotNull": ("customer_id", [], "customer_id IS NOT NULL"),
    "regex": ("path", ["^/p/[13]$"], "regexp_matches(path, '^/p/[13]$')"), "gt": ("revenue", ["5000"], "revenue > 5000"),
    "lte": ("product_id", ["10"], "product_id <= 10"), "gte": ("created_at", ["2024-01-20"], "created_at >= TIMESTAMP '2024-01-20'"),
    "lt": ("latitude", ["35.72"], "latitude < 35.72"),
}
_COUNT = "SELECT tenant_id, shop_id, name, count(*) AS count FROM ev WHERE {} GROUP BY ALL"
for _op, (_col, _values, _cond) in _FILTERS.items():
    query(f"filter_{_op}", sql(_COUNT.format(_cond)))(
        lambda t, o=_op.split("_")[0], c=_col, v=_values: t.ev.where(
            field_filter(F.col(c), o, v, "datetime" if c == "created_at" else "number" if o in ("gt", "lte", "lt") else "string"))
        .groupBy("tenant_id", "shop_id", "name").count())
query("filter_search", sql(_COUNT.format("(device_id LIKE '%-1%' OR path LIKE '%/p/7%' OR city LIKE '%on%')")))(
    lambda t: t.ev.where(search("-1", ["device_id"], False) | search("/p/7", ["path"], False) | search("on", ["city"], False)).groupBy("tenant_id", "shop_id", "name").count())
query("filter_identified", sql(_COUNT.format("customer_id IS NOT NULL")))(lambda t: t.ev.where(identified()).groupBy("tenant_id", "shop_id", "name").count())


# --- segments and formulas ---

_WHO = "coalesce(customer_id, device_id)"
_SEGMENTS = {
    "event": ("count(*)", None), "user": (f"count(DISTINCT {_WHO})", None), "session": ("count(DISTINCT session_id)", None),
    "user_average": (f"round(count(*)::double / count(DISTINCT {_WHO}) * 100) / 100", None), "one_event_per_user": (f"count(DISTINCT {_WHO})", None),
    "property_sum": ("coalesce(sum(revenue), 0)", "revenue"), "property_average": ("avg(product_id)", "properties.k"),
    "property_max": ("max(product_id)", "properties.k"), "property_min": ("coalesce(min(revenue), 0)", "revenue"), "group": ("count(DISTINCT g)", None),
}
for _kind, (_value, _prop) in _SEGMENTS.items():
    _src = "evs" if _kind != "group" else "(SELECT *, unnest([os, country]) AS g FROM ev)"
    query(f"segment_{_kind}", sql(f"SELECT tenant_id, shop_id, name, cast({_value} AS double) AS value FROM {_src} GROUP BY ALL"))(
        lambda t, k=_kind, p=_prop: C.segment((t.evs if k == "session" else t.ev).withColumn("groups", F.array("os", "country")), ["tenant_id", "shop_id", "name"], k, p))


def _spec(name, segment, **kw):
    return {"name": name, "segment": segment, **kw}


_AB = f"""ab AS (SELECT d.*, coalesce(a, 0)::double AS A, coalesce(b, 0)::double AS B FROM (SELECT tenant_id, shop_id, {_DAYS} FROM (SELECT DISTINCT tenant_id, shop_id FROM ev)) d
  LEFT JOIN (SELECT tenant_id, shop_id, date_trunc('day', created_at) AS bucket, count(*) FILTER (name = 'page_view' AND os = 'macOS') AS a,
    count(DISTINCT {_WHO}) FILTER (name = 'purchase' AND os = 'macOS') AS b FROM ev WHERE {_M} GROUP BY ALL) USING (tenant_id, shop_id, bucket))"""


@query("chart_formula", sql("""
SELECT tenant_id, shop_id, bucket, A, CASE WHEN A = 0 THEN 0.0 ELSE B / A END * 100.0 AS C, (A + B) * 2 - A % 3 AS D, pow(A, 2) AS E FROM ab""", _AB))
def _(t):
    mac = [{"name": "os", "operator": "is", "value": ["macOS"]}]
    a = C.report_series(t.ev, _spec("page_view", "event"), MONTH, global_filters=mac)
    b = C.report_series(t.ev, _spec("purchase", "user"), MONTH, global_filters=mac)
    return C.formula_series({"A": a, "B": b}, {"C": "B / A * 100", "D": "(A + B) * 2 - A % 3", "E": "A ^ 2"}, hidden=["B"])


_REV = f"""rev AS (SELECT b.tenant_id, b.shop_id, b.item, b.bucket, coalesce(value, 0.0) AS value
  FROM (SELECT tenant_id, shop_id, item, {_DAYS} FROM (SELECT DISTINCT tenant_id, shop_id, country AS item FROM ev WHERE {_M} AND name = 'purchase' AND country <> '')) b
  LEFT JOIN (SELECT tenant_id, shop_id, country AS item, date_trunc('day', created_at) AS bucket, coalesce(sum(revenue), 0)::double AS value FROM ev
    WHERE {_M} AND name = 'purchase' GROUP BY ALL) USING (tenant_id, shop_id, item, bucket))"""


def _revenue(t):
    return C.report_series(t.ev, _spec("purchase", "revenue"), MONTH, breakdown="country")


@query("chart_report_series", sql("SELECT * FROM rev", _REV))
def _(t):
    return _revenue(t)


@query("chart_report_metrics", sql(" UNION ALL ".join(
    f"SELECT tenant_id, shop_id, item, '{m}' AS metric, cast({v} AS double) AS value FROM rev GROUP BY ALL" for m, v in
    [("count", "count(*)"), ("sum", "sum(value)"), ("average", "round(avg(value) * 100) / 100"), ("min", "min(value)"), ("max", "max(value)")]), _REV))
def _(t):
    points, out = _revenue(t), None
    for m in ("count", "sum", "average", "min", "max"):
        part = C.report_metric(points, m, ["item"]).withColumn("metric", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


@query("chart_series_page", sql("""SELECT * FROM (SELECT tenant_id, shop_id, item, sum(value) AS value FROM rev GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY value DESC, item) BETWEEN 2 AND 3""", _REV))
def _(t):
    return C.page_of_series(C.report_metric(_revenue(t), "sum", ["item"]), 2, 1)


# --- labels, tables ---

@query("chart_label_groups", sql("""
SELECT g.*, coalesce(count, 0) AS count, coalesce(total_count, 0) AS total_count
FROM (SELECT DISTINCT a.tenant_id, a.shop_id, a.series, b.date FROM r a JOIN r b USING (tenant_id, shop_id) WHERE a.series <> '') g
LEFT JOIN (SELECT tenant_id, shop_id, series, date, count(*) AS count, count(revenue) AS total_count FROM r GROUP BY ALL) USING (tenant_id, shop_id, series, date)""",
    "r AS (SELECT *, concat_ws(':::', nullif(country, ''), nullif(device, '')) AS series, date_trunc('day', created_at) AS date FROM ev)"))
def _(t):
    rows = t.ev.groupBy("tenant_id", "shop_id", F.col("country").alias("label_0"), F.col("device").alias("label_1"),
                        F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("date")).agg(
        F.count(F.lit(1)).alias("count"), F.count("revenue").alias("total_count"))
    return C.group_by_labels(rows, ["label_0", "label_1"])


_GRP = f"""g AS (SELECT tenant_id, shop_id, country, device AS item, date_trunc('day', created_at) AS bucket, count(*) AS count FROM ev WHERE {_M} GROUP BY ALL)"""


def _grid(t):
    return t.ev.where(MONTH.current(F.col("created_at"))).groupBy("tenant_id", "shop_id", "country", F.col("device").alias("item"), F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"))


@query("chart_table_summary", sql("""SELECT tenant_id, shop_id, country, cast(sum(s) AS bigint) AS sum, round(avg(a) * 10000) / 10000 AS average, min(lo) AS min, max(hi) AS max
FROM (SELECT tenant_id, shop_id, country, item, sum(count) AS s, avg(count) AS a, min(count) AS lo, max(count) AS hi FROM g GROUP BY ALL) GROUP BY ALL""", _GRP))
def _(t):
    return C.table_summary(_grid(t), ["country"])


@query("chart_table_dates", sql("SELECT tenant_id, shop_id, country, bucket, cast(sum(count) AS bigint) AS count FROM g GROUP BY ALL", _GRP))
def _(t):
    return C.table_dates(_grid(t), ["country"])


@query("chart_hierarchy", sql(f"""
SELECT tenant_id, shop_id, country, os, cast(2 - (CASE WHEN grouping(os) = 1 THEN 1 ELSE 0 END) - (CASE WHEN grouping(country) = 1 THEN 1 ELSE 0 END) AS int) AS depth, count(*) AS count
FROM ev WHERE {_M} GROUP BY GROUPING SETS ((tenant_id, shop_id), (tenant_id, shop_id, country), (tenant_id, shop_id, country, os))"""))
def _(t):
    return C.hierarchy(t.ev, MONTH, ["country", "os"])


@query("chart_breakdown_order", sql("""
SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY values, breakdown) AS int) AS position FROM (
  SELECT tenant_id, shop_id, 'path' AS breakdown, count(DISTINCT nullif(path, '')) AS values FROM ev GROUP BY ALL
  UNION ALL SELECT tenant_id, shop_id, 'os', count(DISTINCT nullif(os, '')) FROM ev GROUP BY ALL
  UNION ALL SELECT tenant_id, shop_id, 'country', count(DISTINCT nullif(country, '')) FROM ev GROUP BY ALL)"""))
def _(t):
    return C.breakdown_order(t.ev, ["path", "os", "country"])


@query("column_statistics", sql("""
SELECT tenant_id, shop_id, round(coalesce(sum(x), 0) * 100) / 100 AS sum, round(coalesce(avg(nullif(x, 0)), 0) * 1000000) / 1000000 AS average, min(x) AS min, max(x) AS max
FROM (SELECT *, product_id::double AS x FROM ev) GROUP BY ALL"""))
def _(t):
    return C.column_stats(t.ev, "product_id", ["tenant_id", "shop_id"])


@query("chart_drill_down", sql(f"""SELECT DISTINCT tenant_id, shop_id, {_WHO} AS profile_id FROM ev
WHERE {_M} AND date_trunc('day', created_at) = TIMESTAMP '2024-01-12' AND name = 'purchase' AND country = 'US'"""))
def _(t):
    return C.drill_down(t.ev, MONTH, datetime(2024, 1, 12), events=["purchase"], breakdown="country", value="US")


# --- report library: the names the test events lack are mapped to ones they have ---

def _library(t, dashboard, report):
    renamed = F.when(F.col("name") == "error", F.lit("session_start")).when(F.col("name") == "checkout_step", F.lit("view_item")).otherwise(F.col("name"))
    ev = t.ev.withColumn("name", renamed).withColumn("properties", F.create_map(F.lit("utm_campaign"), F.concat(F.lit("c"), F.col("product_id") % 7)))
    return C.run_report(ev, C.DASHBOARDS[dashboard][report], AS_OF)


def _report_sql(series, item=None, fold=None):
    ctes, parts = [], []
    for i, (name, value) in enumerate(series):
        it = item or f"'{name}'"
        ctes.append(f"""v{i} AS (SELECT tenant_id, shop_id, {it} AS item, date_trunc('day', created_at) AS bucket, coalesce({value}, 0)::double AS value FROM ev WHERE {_M} AND name = '{name}' GROUP BY ALL)""")
        ctes.append(f"""z{i} AS (SELECT b.*, coalesce(value, 0) AS value FROM (SELECT *, {_DAYS} FROM (SELECT DISTINCT tenant_id, shop_id, item FROM v{i} WHERE item <> '')) b
          LEFT JOIN v{i} USING (tenant_id, shop_id, item, bucket))""")
        parts.append(f"SELECT tenant_id, shop_id, '{'AB'[i]}' AS series, item, bucket, value FROM z{i}")
    body = " UNION ALL ".join(parts)
    out = f"SELECT tenant_id, shop_id, series, item, {fold} AS value FROM ({body}) GROUP BY ALL" if fold else body
    return sql(out, *ctes)


_REPORTS = [
    ("Executive Overview", "Gross Revenue (GMV)", _report_sql([("purchase", "sum(revenue)")])),
    ("Executive Overview", "Conversion Rate Trend", _report_sql([("purchase", "count(*)")])),
    ("Executive Overview", "Total Sessions & Visitors", _report_sql([("error", "count(*)")], "'session_start'", "sum(value)")),
    ("Executive Overview", "Average Order Value (AOV)", _report_sql([("purchase", "sum(revenue)")], fold="round(avg(value) * 100) / 100")),
    ("Purchase & Conversion Funnel", "Cart Additions vs Purchases", _report_sql([("add_to_cart", "count(*)"), ("purchase", "count(*)")])),
    ("Behavioral ML & Purchase Intent", "High-Propensity Cart Intent Events", _report_sql([("add_to_cart", "count(*)")])),
    ("Behavioral ML & Purchase Intent", "Active Intent Signals", _report_sql([("add_to_cart", "count(*)")], fold="sum(value)")),
    ("Merchandise & Products", "Top Products by Revenue", _report_sql([("purchase", "sum(revenue)")], "cast(product_id AS varchar)", "sum(value)")),
    ("Merchandise & Products", "Most Viewed Products", _report_sql([("checkout_step", "count(*)")], "cast(product_id AS varchar)", "sum(value)")),
    ("Acquisition & Marketing Channels", "Sessions by Traffic Source", _report_sql([("error", "count(*)")], "referrer_name", "sum(value)")),
    ("Acquisition & Marketing Channels", "Campaign Revenue Attribution", _report_sql([("purchase", "sum(revenue)")], "'c' || (product_id % 7)", "sum(value)")),
]
for _d, _r, _q in _REPORTS:
    _key = "report_" + "_".join(w for w in "".join(c.lower() if c.isalnum() else " " for c in _r).split())
    query(_key, _q)(lambda t, d=_d, r=_r: _library(t, d, r))


def _funnel_report_sql():
    from tidemark.plans.sequences import _levels, _result
    steps = ["page_view", "view_item", "add_to_cart", "purchase"]
    ctes, select = _result("lv", steps)
    src = "(SELECT * REPLACE (CASE name WHEN 'checkout_step' THEN 'view_item' ELSE name END AS name) FROM ev)"
    return sql(select, *_levels("lv", steps, source=src), *ctes)


@query("report_full_checkout_funnel", _funnel_report_sql())
def _(t):
    return _library(t, "Purchase & Conversion Funnel", "Full Checkout Funnel")


