"""Funnels, conversion rates, journeys and event flows."""

from __future__ import annotations

from tidemark.functions.predicates import profile_id
from tidemark.functions.timeutil import Period
from tidemark.operators import funnel as U
from tidemark.operators import journey as J
from tidemark.plans.registry import HALF, MONTH, query, sql
from tidemark.schema import SHOP

_M = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"
_H = "created_at BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-31'"
_P = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-16'"


def _levels(name, steps, key="shop_id, device_id", window=86400, source="evs", where=_M, extra=""):
    """CTEs up to ``{name}``(tenant_id, key, level): a chain of running maxima over the whole key."""
    out = [f"""{name}_1 AS (SELECT *, CASE WHEN name = '{steps[0]}' THEN epoch_us(created_at) END AS m1 FROM {source} WHERE {where})"""]
    for k, step in enumerate(steps[1:], start=2):
        out.append(f"""{name}_{k}s AS (SELECT *, max(m{k - 1}) OVER (PARTITION BY {key} ORDER BY created_at, id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s{k} FROM {name}_{k - 1})""")
        out.append(f"""{name}_{k} AS (SELECT *, CASE WHEN name = '{step}' AND epoch_us(created_at) <= s{k} + {window}000000 THEN s{k} END AS m{k} FROM {name}_{k}s)""")
    case = " ".join(f"WHEN m{k} IS NOT NULL THEN {k}" for k in range(len(steps), 0, -1))
    names = ", ".join(f"'{s}'" for s in steps)
    out.append(f"""{name} AS (SELECT tenant_id, {key}, max(CASE {case} ELSE 0 END) AS level{extra} FROM {name}_{len(steps)} WHERE name IN ({names}) GROUP BY tenant_id, {key})""")
    return out


def _result(levels, steps, by="tenant_id, shop_id"):
    """Rows of the funnel report from a levels relation."""
    n = len(steps)
    reach = ", ".join(f"count(*) FILTER (level >= {k}) AS r{k}" for k in range(1, n + 1))
    rows = [f"SELECT {by}, 1 AS step_index, '{steps[0]}' AS name, r1 AS count, r1 - r2 AS dropoff_count, 100.0::double AS conversion_rate, r1, r{n} FROM w"]
    for k in range(2, n + 1):
        rows.append(f"""SELECT {by}, {k}, '{steps[k - 1]}', r{k}, r{k - 1} - r{k},
          CASE WHEN r{k - 1} = 0 THEN 0.0 ELSE r{k}::double / r{k - 1}::double * 100.0 END, r1, r{n} FROM w""")
    return [f"w AS (SELECT {by}, {reach} FROM {levels} WHERE level > 0 GROUP BY ALL)", f"steps AS ({' UNION ALL '.join(rows)})"], f"""
    SELECT {by}, step_index, name, count, dropoff_count, conversion_rate, r1 AS total_visitors,
      CASE WHEN r1 = 0 THEN 0.0 ELSE r{n}::double / r1::double * 100.0 END AS overall_conversion_rate FROM steps"""


_STEPS = list(U.DEFAULT_STEPS)
_SHORT = ["page_view", "add_to_cart", "page_view"]


def _funnel_sql(steps, **kw):
    ctes, select = _result("lv", steps)
    return sql(select, *_levels("lv", steps, **kw), *ctes)


@query("funnel_steps", _funnel_sql(_STEPS))
def _(t):
    return U.funnel(t.ev, period=MONTH)


_LONG = ["page_view", "add_to_cart"] * 6


@query("funnel_twelve_steps", _funnel_sql(_LONG, window=30 * 86400))
def _(t):
    return U.funnel(t.ev, _LONG, MONTH, 30 * 86400)


@query("funnel_repeated_step", _funnel_sql(_SHORT, window=6 * 3600))
def _(t):
    return U.funnel(t.ev, _SHORT, MONTH, 6 * 3600)


@query("funnel_by_session", _funnel_sql(_STEPS[:3], key="shop_id, session_id"))
def _(t):
    return U.funnel(t.during(MONTH), _STEPS[:3], MONTH, keys=[*SHOP, "session_id"])


@query("funnel_by_profile", _funnel_sql(_STEPS[:2], key="shop_id, profile_id", source="(SELECT *, coalesce(customer_id, device_id) AS profile_id FROM ev)"))
def _(t):
    return U.funnel(t.ev.withColumn("profile_id", profile_id()), _STEPS[:2], MONTH, keys=[*SHOP, "profile_id"])


@query("funnel_breakdown", (lambda c: sql(c[1], *_levels("lv", _STEPS, extra=", first(referrer_name ORDER BY created_at, id) AS breakdown"), *c[0]))(
    _result("lv", _STEPS, "tenant_id, shop_id, breakdown")))
def _(t):
    return U.funnel(t.ev, period=MONTH, breakdown="referrer_name")


@query("funnel_compare", (lambda c: sql(c[1], *_levels("cur", _STEPS, where=_H), *_levels("pre", _STEPS, where=_P),
    "lv AS (SELECT *, 'current' AS period FROM cur UNION ALL SELECT *, 'previous' FROM pre)", *c[0]))(_result("lv", _STEPS, "tenant_id, shop_id, period")))
def _(t):
    return U.funnel_compare(t.ev, HALF)


@query("funnel_dropoffs", sql("SELECT tenant_id, shop_id, device_id, level FROM lv WHERE level = 2", *_levels("lv", _STEPS)))
def _(t):
    return U.funnel_members(U.funnel_levels(t.ev, period=MONTH), 1, dropoffs=True)


@query("funnel_members", sql("SELECT tenant_id, shop_id, device_id, level FROM lv WHERE level >= 2", *_levels("lv", _STEPS)))
def _(t):
    return U.funnel_members(U.funnel_levels(t.ev, period=MONTH), 1)


_PAIR = ["page_view", "purchase"]


def _series(name, where, extra=""):
    return [*_levels(f"{name}_lv", _PAIR, where=where), f"""{name} AS (
      SELECT tenant_id, shop_id{extra}, bucket, count(DISTINCT device_id) FILTER (NOT hit) AS total, count(DISTINCT device_id) FILTER (hit) AS conversions,
        CASE WHEN count(DISTINCT device_id) FILTER (NOT hit) = 0 THEN 0.0 ELSE round(count(DISTINCT device_id) FILTER (hit)::double
          / count(DISTINCT device_id) FILTER (NOT hit)::double * 100.0 * 100) / 100 END AS rate
      FROM (SELECT tenant_id, shop_id, device_id{extra}, date_trunc('day', make_timestamp(m1)) AS bucket, false AS hit FROM {name}_lv_2 WHERE m1 IS NOT NULL
            UNION ALL SELECT tenant_id, shop_id, device_id{extra}, date_trunc('day', make_timestamp(m2)), true FROM {name}_lv_2 WHERE m2 IS NOT NULL)
      GROUP BY ALL)"""]


@query("conversion_series", sql("SELECT * FROM c", *_series("c", _M)))
def _(t):
    return U.conversion_series(t.ev, *_PAIR, MONTH)


@query("conversion_compare", sql("""
SELECT a.tenant_id, a.shop_id, a.bucket, a.total, a.conversions, a.rate, b.rate AS previous_rate
FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY bucket) AS i FROM c) a
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY bucket) AS i FROM p) b USING (shop_id, i)""", *_series("c", _H), *_series("p", _P)))
def _(t):
    return U.conversion_compare(t.ev, *_PAIR, HALF)


@query("conversion_summary", sql("""
SELECT tenant_id, shop_id, arg_max(rate, (rate, bucket, os)) AS best_rate, arg_max(bucket, (rate, bucket, os)) AS best_bucket, arg_max(os, (rate, bucket, os)) AS best_series,
  arg_min(rate, (rate, bucket, os)) AS worst_rate, arg_min(bucket, (rate, bucket, os)) AS worst_bucket, arg_min(os, (rate, bucket, os)) AS worst_series,
  any_value(best_average_series) AS best_average_series, any_value(best_average) AS best_average, any_value(worst_average_series) AS worst_average_series,
  any_value(worst_average) AS worst_average, any_value(average_rate) AS average_rate
FROM c JOIN (SELECT tenant_id, shop_id, arg_max(os, (a, os)) AS best_average_series, round(max(a) * 10000) / 10000 AS best_average,
    arg_min(os, (a, os)) AS worst_average_series, round(min(a) * 10000) / 10000 AS worst_average, round(coalesce(avg(a) FILTER (a <> 0), 0) * 10000) / 10000 AS average_rate
  FROM (SELECT tenant_id, shop_id, os, coalesce(avg(rate) FILTER (rate <> 0), 0.0) AS a FROM c GROUP BY ALL) GROUP BY ALL) USING (tenant_id, shop_id)
GROUP BY ALL""", *_series("c", _M, ", os")))
def _(t):
    return U.conversion_summary(U.conversion_series(t.ev, *_PAIR, MONTH, breakdown="os"), "os")


@query("conversion_table", sql("""
SELECT a.*, b.prev_avg_rate FROM (SELECT tenant_id, shop_id, os, cast(sum(total) AS bigint) AS total, cast(sum(conversions) AS bigint) AS conversions,
  round(avg(rate) * 10000) / 10000 AS avg_rate FROM c GROUP BY ALL) a
LEFT JOIN (SELECT tenant_id, shop_id, os, round(avg(rate) * 10000) / 10000 AS prev_avg_rate FROM p GROUP BY ALL) b USING (tenant_id, shop_id, os)""",
    *_series("c", _H, ", os"), *_series("p", _P, ", os")))
def _(t):
    return U.conversion_table(U.conversion_series(t.ev, *_PAIR, HALF, breakdown="os"),
                              U.conversion_series(t.ev, *_PAIR, Period(HALF.prev_start, HALF.prev_end), breakdown="os"), "os")


@query("conversion_wide", sql("SELECT tenant_id, shop_id, bucket, " + ", ".join(
    f"""max(CASE WHEN os = '{o}' THEN {c} END) AS "{o}_{c}" """ for o in ("Android", "iOS") for c in ("rate", "total", "conversions"))
    + " FROM c GROUP BY ALL", *_series("c", _M, ", os")))
def _(t):
    return U.conversion_wide(U.conversion_series(t.ev, *_PAIR, MONTH, breakdown="os"), "os", ["Android", "iOS"])


_PATHS = f"""collapsed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS p FROM (
    SELECT *, lag(path) OVER (PARTITION BY session_id ORDER BY created_at, id) AS before FROM evs WHERE path <> '' AND {_M})
  WHERE before IS NULL OR before <> path),
repeats AS (SELECT session_id, min(p) AS stop FROM (SELECT session_id, p, row_number() OVER (PARTITION BY session_id, path ORDER BY p) AS n FROM collapsed)
  WHERE n > 1 GROUP BY session_id),
prefix AS (SELECT tenant_id, shop_id, session_id, cast(p AS int) AS position, path AS item FROM collapsed LEFT JOIN repeats USING (session_id)
  WHERE p <= 4 AND (stop IS NULL OR p < stop))"""
_GRAPH = [_PATHS, """hops AS (SELECT * FROM (SELECT *, lead(item) OVER w AS target, first(item) OVER w AS entry FROM prefix
    WINDOW w AS (PARTITION BY session_id ORDER BY position)) WHERE target IS NOT NULL)""",
    """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY count DESC, entry) AS rank FROM (
      SELECT tenant_id, shop_id, entry, count(*) AS count FROM hops WHERE position = 1 GROUP BY ALL)) WHERE rank <= 3)""",
    """moves AS (SELECT tenant_id, shop_id, item AS source, target, position AS step, count(*) AS value FROM hops
      SEMI JOIN top USING (tenant_id, shop_id, entry) GROUP BY ALL)""",
    """best AS (SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id, step, source ORDER BY value DESC, target) <= 3)""",
    """a1 AS (SELECT tenant_id, shop_id, entry AS source, CASE rank WHEN 1 THEN '#3b82f6' WHEN 2 THEN '#10b981' ELSE '#f59e0b' END AS colour FROM top)"""]
for _s in (1, 2, 3):
    _GRAPH.append(f"l{_s} AS (SELECT best.*, colour FROM best JOIN a{_s} USING (tenant_id, shop_id, source) WHERE step = {_s})")
    _GRAPH.append(f"a{_s + 1} AS (SELECT tenant_id, shop_id, target AS source, arg_max(colour, (value, source)) AS colour FROM l{_s} GROUP BY tenant_id, shop_id, target)")
_GRAPH += ["total AS (SELECT tenant_id, shop_id, cast(sum(count) AS bigint) AS total FROM top GROUP BY ALL)",
           """links AS (SELECT u.*, total, value >= greatest(1, ceil(total * 0.0025)) AS keep
             FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) u JOIN total USING (tenant_id, shop_id))"""]


@query("journey_paths", sql("SELECT * FROM prefix", _PATHS))
def _(t):
    return J.journey_paths(t.during(MONTH), MONTH, 4)


@query("journey_transitions", sql("SELECT * FROM moves", *_GRAPH))
def _(t):
    return J.journey_transitions(J.journey_paths(t.during(MONTH), MONTH, 4))[1]


@query("journey_links", sql("""SELECT tenant_id, shop_id, source || '::step' || step AS source, target || '::step' || (step + 1) AS target, value
FROM links WHERE keep""", *_GRAPH))
def _(t):
    return J.journey_graph(J.journey_paths(t.during(MONTH), MONTH, 4), 4)[1]


@query("journey_nodes", sql("""
SELECT n.tenant_id, n.shop_id, path || '::step' || step AS id, path AS label, step, colour, coalesce(kept, raw) AS value,
  round(coalesce(kept, raw) / total * 100 * 100) / 100 AS percentage
FROM (SELECT tenant_id, shop_id, target AS path, step + 1 AS step, cast(sum(value) AS bigint) AS raw, cast(sum(value) FILTER (keep) AS bigint) AS kept,
        arg_max(colour, (value, source)) AS colour FROM links GROUP BY tenant_id, shop_id, target, step
      UNION ALL SELECT t.tenant_id, t.shop_id, entry, 1, count, NULL, colour FROM top t JOIN a1 ON a1.shop_id = t.shop_id AND a1.source = t.entry) n
JOIN total USING (tenant_id, shop_id)
WHERE kept IS NOT NULL OR EXISTS (SELECT 1 FROM links l WHERE l.keep AND l.tenant_id = n.tenant_id AND l.shop_id = n.shop_id AND l.source = n.path AND l.step = n.step)""",
    *_GRAPH))
def _(t):
    return J.journey_graph(J.journey_paths(t.during(MONTH), MONTH, 4), 4)[0]


def _flow(body, order="created_at, id", direction="<"):
    rev = "created_at DESC, id DESC" if direction == ">" else "created_at, id"
    return sql("""SELECT tenant_id, shop_id, item AS source, target, position AS step, count(*) AS value FROM (
      SELECT *, lead(item) OVER (PARTITION BY session_id ORDER BY position) AS target FROM prefix) WHERE target IS NOT NULL GROUP BY ALL""",
        f"body AS ({body})", f"""collapsed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {rev}) AS p FROM (
          SELECT *, lag(name) OVER (PARTITION BY session_id ORDER BY {rev}) AS before FROM body) WHERE before IS NULL OR before <> name)""",
        """repeats AS (SELECT session_id, min(p) AS stop FROM (SELECT session_id, p, row_number() OVER (PARTITION BY session_id, name ORDER BY p) AS n
          FROM collapsed) WHERE n > 1 GROUP BY session_id)""",
        """prefix AS (SELECT tenant_id, shop_id, session_id, cast(p AS int) AS position, name AS item FROM collapsed LEFT JOIN repeats USING (session_id)
          WHERE p <= 4 AND (stop IS NULL OR p < stop))""")


_ANCHOR = f"(SELECT session_id, {{0}}(ROW(created_at, id)) AS a FROM evs WHERE {_M} AND name = '{{1}}' GROUP BY session_id)"


@query("event_flow_after", _flow(f"""SELECT e.* FROM evs e JOIN {_ANCHOR.format('min', 'page_view')} USING (session_id)
WHERE {_M} AND ROW(created_at, id) >= a AND name <> 'error'"""))
def _(t):
    return J.flow_links(J.event_flow(t.during(MONTH), MONTH, "after", start="page_view", steps=4, exclude=["error"]))


@query("event_flow_before", _flow(f"""SELECT e.* FROM evs e JOIN {_ANCHOR.format('max', 'purchase')} USING (session_id)
WHERE {_M} AND ROW(created_at, id) <= a""", direction=">"))
def _(t):
    return J.flow_links(J.event_flow(t.during(MONTH), MONTH, "before", end="purchase", steps=4))


@query("event_flow_between", _flow(f"""SELECT e.* FROM evs e JOIN {_ANCHOR.format('min', 'page_view')} s USING (session_id)
JOIN (SELECT session_id, min(ROW(created_at, id)) AS b FROM evs JOIN {_ANCHOR.format('min', 'page_view')} USING (session_id)
      WHERE {_M} AND name = 'purchase' AND ROW(created_at, id) > a GROUP BY session_id) USING (session_id)
WHERE {_M} AND ROW(created_at, id) BETWEEN a AND b"""))
def _(t):
    return J.flow_links(J.event_flow(t.during(MONTH), MONTH, "between", start="page_view", end="purchase", steps=4))
