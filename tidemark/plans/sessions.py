"""Sessionisation and everything derived from sessions directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sessions as S
from tidemark.plans.registry import AS_OF, TIMEOUT, query, sql

_RECORD = ("session_id, tenant_id, shop_id, device_id, customer_id, started_at, ended_at, duration, entry_path, exit_path, "
           "referrer_name, referrer_type, os, browser, device, country, city, events_count, screen_views_count, has_cart_add, "
           "has_purchase, total_revenue_usd")
_COLS = _RECORD.split(", ")


@query("session_records", sql(f"SELECT {_RECORD} FROM se"))
def _(t):
    return t.computed_se.select(*_COLS)


@query("session_records_default_timeout", sql(f"SELECT {_RECORD} FROM se", timeout=1800))
def _(t):
    return S.sessions(t.ev).select(*_COLS)


@query("session_assignment", sql("SELECT id, shop_id, device_id, session_id, session_start, created_at FROM evs"))
def _(t):
    return t.computed_evs.select("id", "shop_id", "device_id", "session_id", "session_start", "created_at")


@query("session_referrer_inheritance", sql("""
SELECT e.id, e.session_id, coalesce(nullif(s.referrer, ''), e.referrer) AS referrer,
  coalesce(nullif(s.referrer_name, ''), e.referrer_name) AS referrer_name,
  coalesce(nullif(s.referrer_type, ''), e.referrer_type) AS referrer_type
FROM evs e JOIN se s USING (session_id)"""))
def _(t):
    return S.inherit_referrer(t.computed_evs, t.computed_se).select("id", "session_id", "referrer", "referrer_name", "referrer_type")


@query("session_markers", sql("""
SELECT session_id || ':session_start' AS id, session_id, 'session_start' AS name, entry_path AS path,
  started_at - INTERVAL 100 MILLISECOND AS created_at, NULL AS bounce, NULL AS duration FROM se
UNION ALL
SELECT session_id || ':session_end', session_id, 'session_end', exit_path, ended_at,
  CASE WHEN events_count <= 1 THEN 'true' ELSE 'false' END, cast(duration AS varchar) FROM se
UNION ALL
SELECT cast(id AS varchar), session_id, name, path, created_at, NULL, NULL FROM evs"""))
def _(t):
    out = S.with_markers(t.computed_evs, t.computed_se)
    return out.select("id", "session_id", "name", "path", "created_at", F.col("properties")["__bounce"].alias("bounce"),
                      F.col("properties")["__duration"].alias("duration"))


@query("session_closed", sql(f"""
SELECT shop_id, count(*) AS closed_sessions, cast(sum(duration) AS bigint) AS total_duration FROM se
WHERE ended_at <= TIMESTAMP '2024-01-31' - INTERVAL {TIMEOUT} SECOND GROUP BY shop_id"""))
def _(t):
    return S.closed(t.computed_se, AS_OF, TIMEOUT).groupBy("shop_id").agg(
        F.count(F.lit(1)).alias("closed_sessions"), F.sum("duration").alias("total_duration"))


@query("session_active_devices", sql(f"""
SELECT tenant_id, shop_id, count(DISTINCT device_id) AS active_sessions FROM ev
WHERE created_at BETWEEN TIMESTAMP '2024-01-31' - INTERVAL {TIMEOUT * 2} SECOND AND TIMESTAMP '2024-01-31' GROUP BY ALL"""))
def _(t):
    return S.active_devices(t.ev, AS_OF, TIMEOUT * 2)
