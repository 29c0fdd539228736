"""Retention and cohorts."""

from __future__ import annotations

from tidemark.functions.predicates import in_cohort
from tidemark.operators import cohorts as C
from tidemark.operators import retention as R
from tidemark.plans.registry import AS_OF, MONTH, query, sql

_M = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"
_WHO = "coalesce(customer_id, device_id)"


def _retention(criteria, unit="day"):
    days = {"day": 1, "week": 7}[unit]
    start = "date_trunc('day', created_at)" if unit == "day" else "CAST(date_trunc('day', created_at) - INTERVAL 1 DAY * dayofweek(created_at) AS TIMESTAMP)"
    last = "TIMESTAMP '2024-01-31'" if unit == "day" else "TIMESTAMP '2024-01-28'"
    hit = "offs = o" if criteria == "on" else "offs >= o"
    return [f"act AS (SELECT tenant_id, shop_id, {_WHO} AS profile_id, {start} AS d, name FROM ev WHERE {_M})",
            "born AS (SELECT tenant_id, shop_id, profile_id, min(d) AS cohort FROM act WHERE name = 'page_view' GROUP BY ALL)",
            f"""back AS (SELECT DISTINCT tenant_id, shop_id, profile_id, cohort, date_diff('day', cohort, d) // {days} AS offs
              FROM act JOIN born USING (tenant_id, shop_id, profile_id) WHERE name IN ('purchase', 'add_to_cart') AND d >= cohort)""",
            f"""grid AS (SELECT tenant_id, shop_id, cohort, cohort_size, unnest(generate_series(0, date_diff('day', cohort, {last}) // {days})) AS o
              FROM (SELECT tenant_id, shop_id, cohort, count(*) AS cohort_size FROM born GROUP BY ALL))""",
            f"""ret AS (SELECT tenant_id, shop_id, cohort, cohort_size, cast(o AS int) AS "offset",
              count(DISTINCT profile_id) FILTER ({hit}) AS users,
              round(count(DISTINCT profile_id) FILTER ({hit})::double / cohort_size::double * 100.0 * 100) / 100 AS percentage
              FROM grid LEFT JOIN back USING (tenant_id, shop_id, cohort) GROUP BY tenant_id, shop_id, cohort, cohort_size, o)"""]


def _run(t, criteria, interval="day"):
    return R.retention(t.ev, ["page_view"], ["purchase", "add_to_cart"], MONTH, interval, criteria)


for _c in ("on", "on_or_after"):
    query(f"retention_{_c}", sql("SELECT * FROM ret", *_retention(_c)))(lambda t, c=_c: _run(t, c))
query("retention_weekly", sql("SELECT * FROM ret", *_retention("on_or_after", "week")))(lambda t: _run(t, "on_or_after", "week"))

_AVG = """avgs AS (SELECT tenant_id, shop_id, "offset", round(avg(percentage) * 100) / 100 AS avg_percentage, cast(sum(users) AS bigint) AS users,
  cast(sum(cohort_size) AS bigint) AS cohort_size FROM ret GROUP BY ALL)"""


@query("retention_average", sql("SELECT * FROM avgs", *_retention("on"), _AVG))
def _(t):
    return R.retention_average(_run(t, "on"))


@query("retention_line", sql("SELECT tenant_id, shop_id, round(avg(avg_percentage) * 100) / 100 AS average FROM avgs GROUP BY ALL", *_retention("on"), _AVG))
def _(t):
    return R.retention_line(R.retention_average(_run(t, "on")))


_BUYERS = [{"name": "purchase", "timeframe": {"type": "relative", "value": "30d"}, "frequency": {"operator": "gte", "count": 8}},
           {"name": "add_to_cart", "timeframe": {"type": "absolute", "start": "2024-01-05", "end": "2024-01-25"},
            "filters": [{"name": "referrer_name", "operator": "is", "value": ["Google", "Reddit"]}], "frequency": {"operator": "lte", "count": 4}}]
_COUNTS = f"""cnt AS (SELECT tenant_id, shop_id, {_WHO} AS profile_id,
  count(*) FILTER (name = 'purchase' AND created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31') AS a,
  count(*) FILTER (name = 'add_to_cart' AND referrer_name IN ('Google', 'Reddit') AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') AS b
  FROM ev WHERE name IN ('purchase', 'add_to_cart') GROUP BY ALL)"""
_AND = "mem AS (SELECT tenant_id, shop_id, profile_id FROM cnt WHERE a >= 8 AND b <= 4 AND b > 0)"


def _members(t, operator="and"):
    return C.event_cohort(t.ev, _BUYERS, AS_OF, operator)


@query("cohort_events_and", sql("SELECT * FROM mem", _COUNTS, _AND))
def _(t):
    return _members(t)


@query("cohort_events_or", sql("SELECT tenant_id, shop_id, profile_id FROM cnt WHERE a >= 8 OR (b <= 4 AND b > 0)", _COUNTS))
def _(t):
    return _members(t, "or")


@query("cohort_properties", sql(f"""
SELECT tenant_id, shop_id, profile_id FROM (SELECT tenant_id, shop_id, {_WHO} AS profile_id,
  last(os ORDER BY created_at, id) FILTER (os <> '') AS os, last(path ORDER BY created_at, id) FILTER (path <> '') AS path,
  last(product_id ORDER BY created_at, id) AS k FROM ev GROUP BY ALL)
WHERE os ILIKE 'mac%' OR (path = '/p/3') OR k > 90"""))
def _(t):
    return C.property_cohort(t.ev, [{"name": "os", "operator": "startsWith", "value": ["mac"]}, {"name": "path", "operator": "is", "value": ["/p/3"]},
                                    {"name": "properties.k", "operator": "gt", "value": ["90"], "cast": "number"}], "or")


@query("cohort_count", sql("SELECT tenant_id, shop_id, count(*) AS members FROM mem GROUP BY ALL", _COUNTS, _AND))
def _(t):
    return C.cohort_count(_members(t))


@query("cohort_preview", sql("""
SELECT * FROM (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY profile_id) <= 10)
JOIN (SELECT tenant_id, shop_id, count(*) AS members FROM mem GROUP BY ALL) USING (tenant_id, shop_id)""", _COUNTS, _AND))
def _(t):
    return C.cohort_preview(_members(t))


_MEV = f"mev AS (SELECT * FROM (SELECT *, {_WHO} AS profile_id FROM ev) SEMI JOIN mem USING (tenant_id, shop_id, profile_id))"


@query("cohort_most_events", sql("""
SELECT * FROM (SELECT tenant_id, shop_id, name, count(*) AS count FROM mev WHERE name NOT IN ('screen_view', 'session_start', 'session_end') GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY count DESC, name) <= 10""", _COUNTS, _AND, _MEV))
def _(t):
    return C.cohort_most_events(t.ev, _members(t))


@query("cohort_events_per_day", sql("SELECT tenant_id, shop_id, date_trunc('day', created_at) AS date, count(*) AS count FROM mev GROUP BY ALL", _COUNTS, _AND, _MEV))
def _(t):
    return C.cohort_events_per_day(t.ev, _members(t))


@query("cohort_routes", sql("""
SELECT * FROM (SELECT tenant_id, shop_id, path, count(*) AS count FROM mev WHERE path <> '' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY count DESC, path) <= 10""", _COUNTS, _AND, _MEV))
def _(t):
    return C.cohort_routes(t.ev, _members(t))


for _name, _in, _sqlop in (("in_cohort", True, "SEMI"), ("not_in_cohort", False, "ANTI")):
    query(f"filter_{_name}", sql(f"""SELECT tenant_id, shop_id, name, count(*) AS count FROM (SELECT *, {_WHO} AS profile_id FROM ev) e
    {_sqlop} JOIN mem USING (tenant_id, shop_id, profile_id) GROUP BY ALL""", _COUNTS, _AND))(
        lambda t, m=_in: in_cohort(t.ev.withColumn("profile_id", C.profile_id()), C.named_cohort(_members(t), "buyers"), ["buyers"], member=m)
        .groupBy("tenant_id", "shop_id", "name").count())
