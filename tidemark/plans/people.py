"""Profiles, catalogues, groups, event and session lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.predicates import field_filter, profile_id, search
from tidemark.operators import lists as L
from tidemark.operators import profiles as P
from tidemark.plans.registry import AS_OF, query, sql
from tidemark.schema import SHOP

_WHO = "coalesce(customer_id, device_id)"
_DIMS = ", ".join(f"first({d} ORDER BY created_at, id) AS {d}" for d in P.DIMS)
_USD = "cast(coalesce(sum(revenue_usd), 0) AS bigint)"
_CONV = "(coalesce(revenue, 0) > 0 OR name IN ('purchase', 'add_to_cart', 'cart_view', 'checkout_step', 'checkout', 'subscribe'))"
_M = "created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"


def _page(select, order, lo, hi, by="tenant_id, shop_id"):
    return f"SELECT * FROM ({select}) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}) BETWEEN {lo} AND {hi}"


_DEV = f"""SELECT tenant_id, shop_id, device_id, first(customer_id ORDER BY created_at, id) FILTER (customer_id IS NOT NULL) AS customer_id,
  bool_or(customer_id IS NOT NULL) AS is_identified, count(*) AS events_count, count(DISTINCT session_id) AS sessions_count, {_USD} AS total_revenue,
  min(created_at) AS first_seen, max(created_at) AS last_seen, {_DIMS} FROM evs WHERE {{}} GROUP BY tenant_id, shop_id, device_id"""


@query("profiles_by_device", sql(_DEV.format("true")))
def _(t):
    return P.devices(t.evs)


@query("profiles_anonymous_search", sql(_page(_DEV.format("customer_id IS NULL AND (city ILIKE '%on%' OR os ILIKE '%ios%')"), "last_seen DESC, device_id", 1, 50)))
def _(t):
    return P.device_page(t.evs, "anonymous", matching=search("on", ["city"]) | search("ios", ["os"]))


@query("profiles_power", sql(_page(_DEV.format("true"), "total_revenue DESC, events_count DESC, device_id", 11, 20)))
def _(t):
    return P.device_page(t.evs, "power_users", 10, 10)


_PRO = f"""SELECT tenant_id, shop_id, {_WHO} AS profile_id, customer_id IS NOT NULL AS is_external, count(*) AS count, min(created_at) AS first_seen,
  max(created_at) AS last_seen, {_DIMS} FROM ev WHERE {{}} GROUP BY tenant_id, shop_id, coalesce(customer_id, device_id), customer_id IS NOT NULL"""


@query("profiles_list", sql("SELECT * FROM (" + _page("SELECT * FROM p", "last_seen DESC, profile_id, is_external", 1, 50)
       + ") JOIN (SELECT tenant_id, shop_id, count(DISTINCT profile_id) AS total FROM p GROUP BY ALL) USING (tenant_id, shop_id)", f"p AS ({_PRO.format('true')})"))
def _(t):
    return P.profile_page(t.ev)


@query("profiles_filtered", sql(_PRO.format("customer_id IS NULL AND country <> 'DE' AND path ILIKE '/p/%'")))
def _(t):
    cond = field_filter(F.col("country"), "isNot", ["DE"]) & field_filter(F.col("path"), "startsWith", ["/p/"])
    return P.profiles(t.ev, external=False, filters=cond)


@query("profile_detail", sql(f"""SELECT tenant_id, shop_id, 'cust-12' AS profile_id, min(created_at) AS first_seen, max(created_at) AS last_seen, {_DIMS}
FROM ev WHERE device_id = 'cust-12' OR customer_id = 'cust-12' GROUP BY tenant_id, shop_id"""))
def _(t):
    return P.profile_detail(t.ev, "cust-12")


@query("profile_metrics", sql(f"""
SELECT a.*, duration_avg, duration_p90, bounce_rate, avg_time_between_sessions FROM (
  SELECT tenant_id, shop_id, {_WHO} AS profile_id, count(*) AS events, count(DISTINCT session_id) AS sessions,
    count(*) FILTER (name IN ('page_view', 'screen_view')) AS screen_views, count(*) FILTER (name ILIKE '%purchase%' OR name ILIKE '%order%') AS conversion_events,
    min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT created_at::date) AS unique_days_active, {_USD} / 100 AS revenue,
    round(count(*) / greatest(1, count(DISTINCT session_id)) * 10) / 10 AS avg_events_per_session FROM evs GROUP BY ALL) a
LEFT JOIN (SELECT tenant_id, shop_id, {_WHO} AS profile_id, round(avg(duration) / 60 * 10) / 10 AS duration_avg,
    round(quantile_cont(duration, 0.9) / 60 * 10) / 10 AS duration_p90, round(count(*) FILTER (events_count <= 1) * 100.0::double / count(*) * 10) / 10 AS bounce_rate,
    round(coalesce((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 60e6::double / nullif(count(*) - 1, 0), 0) * 10) / 10 AS avg_time_between_sessions
  FROM se GROUP BY ALL) b USING (tenant_id, shop_id, profile_id)"""))
def _(t):
    return P.profile_metrics(t.evs, t.se)


@query("profile_activity", sql(_page(f"SELECT tenant_id, shop_id, {_WHO} AS profile_id, date_trunc('day', created_at) AS date, count(*) AS count FROM ev GROUP BY ALL",
                                     "date DESC", 1, 30, "tenant_id, shop_id, profile_id")))
def _(t):
    return P.profile_activity(t.ev)


for _col, _cond in (("name", "name NOT IN ('screen_view', 'session_start', 'session_end')"), ("path", "path <> ''")):
    query(f"profile_top_{_col}s", sql(_page(f"SELECT tenant_id, shop_id, {_WHO} AS profile_id, {_col}, count(*) AS count FROM ev WHERE {_cond} GROUP BY ALL",
                                           f"count DESC, {_col}", 1, 10, "tenant_id, shop_id, profile_id")))(lambda t, c=_col: P.profile_top(t.ev, c))
    query(f"profile_chart_{_col}", sql("SELECT b.*, coalesce(count, 0) AS count FROM best b LEFT JOIN pts USING (tenant_id, shop_id, profile_id, item, bucket)",
        f"""pts AS (SELECT tenant_id, shop_id, {_WHO} AS profile_id, {_col} AS item, date_trunc('day', created_at) AS bucket, count(*) AS count FROM ev WHERE {_M} AND {_col} <> ''
          GROUP BY ALL)""",
        f"""best AS (SELECT tenant_id, shop_id, profile_id, item, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS bucket FROM (
          {_page('SELECT tenant_id, shop_id, profile_id, item, sum(count) AS n FROM pts GROUP BY ALL', 'n DESC, item', 1, 10, 'tenant_id, shop_id, profile_id')}))"""))(
        lambda t, c=_col: P.profile_chart(t.ev, AS_OF, c))


@query("power_users", sql(_page(f"""SELECT tenant_id, shop_id, device_id, count(*) AS count, min(created_at) AS first_seen, max(created_at) AS last_seen, {_DIMS}
FROM ev GROUP BY tenant_id, shop_id, device_id""", "count DESC, device_id", 1, 50)))
def _(t):
    return P.power_users(t.ev)


@query("shopper_timeline", sql(_page("""SELECT tenant_id, shop_id, device_id, id, name, session_id, customer_id, currency, product_id, path, referrer_name, os, browser, device,
  country, city, created_at, CASE WHEN revenue > 0 THEN revenue END AS revenue FROM evs""", "created_at, id", 1, 200, "tenant_id, shop_id, device_id")))
def _(t):
    return P.timeline(t.evs)


# --- catalogues ---

@query("property_keys", sql("SELECT tenant_id, shop_id, 'k' AS key, max(created_at) AS last_seen, 1 AS position FROM ev GROUP BY ALL"))
def _(t):
    return P.property_keys(t.ev)


@query("property_keys_normalised", sql("""
SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY last_seen DESC, length(key), key) AS int) AS position FROM (
  SELECT tenant_id, shop_id, CASE product_id % 4 WHEN 0 THEN 'items.*.sku' WHEN 1 THEN 'tags[*]' WHEN 2 THEN 'plan' ELSE 'items.*.price' END AS key, max(created_at) AS last_seen
  FROM ev GROUP BY ALL)"""))
def _(t):
    n = (F.col("product_id") % 3).cast("string")
    key = (F.when(F.col("product_id") % 4 == 0, F.concat(F.lit("items."), n, F.lit(".sku"))).when(F.col("product_id") % 4 == 1, F.concat(F.lit("tags."), n))
           .when(F.col("product_id") % 4 == 2, F.lit("plan")).otherwise(F.concat(F.lit("items."), n, F.lit(".price"))))
    return P.property_keys(t.ev.withColumn("properties", F.create_map(key, F.lit("x"))))


@query("property_values", sql(_page("SELECT DISTINCT tenant_id, shop_id, cast(product_id AS varchar) AS value FROM ev", "value", 1, 50)))
def _(t):
    return P.property_values(t.ev, "k*")


@query("column_values", sql(_page("SELECT DISTINCT tenant_id, shop_id, path AS value FROM ev WHERE path <> ''", "value", 1, 50)))
def _(t):
    return P.column_values(t.ev, "path")


@query("event_name_catalogue", sql("""SELECT tenant_id, shop_id, name, count(*) AS count FROM ev GROUP BY ALL
UNION ALL SELECT tenant_id, shop_id, '*', count(*) FROM ev GROUP BY ALL"""))
def _(t):
    return P.event_names(t.ev)


@query("conversion_name_catalogue", sql(f"SELECT DISTINCT tenant_id, shop_id, name FROM ev WHERE {_CONV}"))
def _(t):
    return P.conversion_names(t.ev)


# --- groups: the operating system and country stand in for a profile's groups ---

_G = f"g AS (SELECT *, {_WHO} AS profile_id, unnest([os, country]) AS group_id FROM ev)"


def _grouped(t):
    return t.ev.withColumn("groups", F.array("os", "country"))


@query("group_metrics", sql("""SELECT tenant_id, shop_id, group_id, count(*) AS total_events, count(DISTINCT profile_id) AS unique_profiles, min(created_at) AS first_seen,
  max(created_at) AS last_seen FROM g GROUP BY ALL""", _G))
def _(t):
    return P.group_metrics(_grouped(t))


@query("group_activity", sql("SELECT tenant_id, shop_id, group_id, date_trunc('day', created_at) AS date, count(*) AS count FROM g GROUP BY ALL", _G))
def _(t):
    return P.group_activity(_grouped(t))


_MEMBERS = f"""m AS (SELECT tenant_id, shop_id, profile_id, created_at, unnest([os, country]) AS group_id FROM (SELECT tenant_id, shop_id, {_WHO} AS profile_id, min(created_at) AS created_at,
  first(os ORDER BY created_at, id) AS os, first(country ORDER BY created_at, id) AS country FROM ev GROUP BY tenant_id, shop_id, coalesce(customer_id, device_id)))"""


@query("group_growth", sql("""
SELECT b.*, coalesce(count, 0) AS count FROM (SELECT *, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS date
  FROM (SELECT DISTINCT tenant_id, shop_id, group_id FROM m)) b
LEFT JOIN (SELECT tenant_id, shop_id, group_id, date_trunc('day', created_at) AS date, count(*) AS count FROM m GROUP BY ALL) USING (tenant_id, shop_id, group_id, date)""", _MEMBERS))
def _(t):
    members = P.profiles(t.ev).groupBy(*P.PROFILE).agg(F.min(F.struct("first_seen", "os", "country")).alias("f")).select(
        *P.PROFILE, F.col("f.first_seen").alias("created_at"), F.array("f.os", "f.country").alias("groups"))
    return P.group_growth(members, AS_OF)


for _col, _cond in (("name", "name NOT IN ('screen_view', 'session_start', 'session_end')"), ("path", "name IN ('page_view', 'screen_view')")):
    query(f"group_top_{_col}s", sql(_page(f"SELECT tenant_id, shop_id, group_id, {_col}, count(*) AS count FROM g WHERE {_cond} GROUP BY ALL", f"count DESC, {_col}", 1, 10,
                                         "tenant_id, shop_id, group_id"), _G))(lambda t, c=_col: P.group_top(_grouped(t), c))


@query("events_with_profile", sql(f"""
SELECT id, shop_id, profile_id, profile_os, profile_last_path FROM (SELECT *, {_WHO} AS profile_id FROM ev)
LEFT JOIN (SELECT tenant_id, shop_id, {_WHO} AS profile_id, last(os ORDER BY created_at, id) AS profile_os, last(path ORDER BY created_at, id) AS profile_last_path
  FROM ev GROUP BY tenant_id, shop_id, coalesce(customer_id, device_id)) USING (tenant_id, shop_id, profile_id)"""))
def _(t):
    # Every event doubles as a version of its profile.
    versions = t.ev.select(*SHOP, profile_id().alias("profile_id"), "os", F.col("path").alias("last_path"), F.struct("created_at", "id").alias("version"))
    return P.with_profile(t.ev, versions, "version").select("id", "shop_id", "profile_id", "profile_os", "profile_last_path")


@query("events_with_groups", sql("""SELECT tenant_id, shop_id, group_id, max(n) AS group_events, count(*) AS count FROM g
JOIN (SELECT tenant_id, shop_id, group_id, count(*) AS n FROM g GROUP BY ALL) USING (tenant_id, shop_id, group_id) GROUP BY ALL""", _G))
def _(t):
    table = P.group_metrics(_grouped(t)).select(*SHOP, "group_id", F.col("total_events").alias("events"))
    return P.with_groups(_grouped(t), table).groupBy(*SHOP, "group_id").agg(F.max("group_events").alias("group_events"), F.count(F.lit(1)).alias("count"))


def _mutations(t):
    kind = F.when(F.col("name") == "purchase", F.lit("increment")).when(F.col("name") == "error", F.lit("decrement")).otherwise(F.lit("assign_group"))
    return t.ev.select(*SHOP, profile_id().alias("profile_id"), kind.alias("type"), F.col("os").alias("property"),
                       F.when(F.col("product_id") > 20, F.col("product_id")).alias("value"), F.array("country", "referrer_name").alias("groups"))


@query("profile_increments", sql(f"""SELECT tenant_id, shop_id, {_WHO} AS profile_id, os AS property,
  cast(sum(CASE name WHEN 'purchase' THEN 1 ELSE -1 END * CASE WHEN product_id > 20 THEN product_id ELSE 1 END) AS double) AS delta
FROM ev WHERE name IN ('purchase', 'error') GROUP BY ALL"""))
def _(t):
    return P.apply_increments(_mutations(t))


@query("profile_groups", sql(f"""SELECT tenant_id, shop_id, profile_id, string_agg(g, ',' ORDER BY g) AS groups FROM (
  SELECT DISTINCT tenant_id, shop_id, {_WHO} AS profile_id, unnest([country, referrer_name]) AS g FROM ev WHERE name NOT IN ('purchase', 'error')) GROUP BY ALL"""))
def _(t):
    return P.assign_groups(_mutations(t)).withColumn("groups", F.array_join("groups", ","))


@query("profile_aliases", sql(f"""SELECT tenant_id, shop_id, CASE WHEN customer_id IS NULL THEN device_id ELSE customer_id END AS profile_id, count(*) AS count FROM ev GROUP BY ALL"""))
def _(t):
    ev = t.ev.withColumn("profile_id", F.col("device_id"))
    aliases = t.ev.where(F.col("customer_id").isNotNull()).select(*SHOP, F.col("device_id").alias("alias"), F.col("customer_id").alias("profile_id"))
    return P.resolve_aliases(ev, aliases).groupBy(*P.PROFILE).agg(F.count(F.lit(1)).alias("count"))


@query("group_upsert", sql("SELECT tenant_id, shop_id, os AS group_id, last(path ORDER BY created_at, id) AS title FROM ev GROUP BY tenant_id, shop_id, os"))
def _(t):
    rows = t.ev.select(*SHOP, F.col("os").alias("group_id"), F.col("path").alias("title"), F.struct("created_at", "id").alias("updated_at"))
    return P.upsert_groups(rows).drop("updated_at")


# --- lists ---

_EVCOLS = ["id", "tenant_id", "shop_id", "name", "device_id", "session_id", "path", "city", "created_at"]


@query("events_page", sql("SELECT * FROM (" + _page(f"SELECT {', '.join(_EVCOLS)}, CASE WHEN revenue > 0 THEN revenue END AS revenue FROM m", "created_at DESC, id DESC", 51, 100)
       + ") JOIN (SELECT tenant_id, shop_id, count(*) AS total FROM m GROUP BY ALL) USING (tenant_id, shop_id)",
       "m AS (SELECT * FROM evs WHERE name = 'purchase' AND (path LIKE '%/p/%' OR device_id LIKE '%/p/%' OR city LIKE '%/p/%'))"))
def _(t):
    return L.events_page(t.evs, "purchase", "/p/", 50, 50).select(*_EVCOLS, "revenue", "total")


def _cursor_sql(where):
    rate = "CASE currency WHEN 'USD' THEN 1.0::double WHEN 'GBP' THEN 0.77::double WHEN 'BDT' THEN 123.0::double ELSE 0.89::double END"
    return sql(f"""SELECT id, tenant_id, shop_id, name, session_id, created_at, coalesce(nullif(path, ''), '/') AS path, 'EUR' AS currency, {_WHO} AS profile_id,
      CASE WHEN coalesce(revenue, 0) > 0 THEN CASE WHEN currency = 'EUR' THEN revenue ELSE cast(round(revenue / {rate} * 0.89::double) AS bigint) END ELSE 0 END AS revenue, n > 50 AS has_more
    FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY tenant_id, shop_id) AS n FROM evs WHERE {where}
      WINDOW w AS (PARTITION BY tenant_id, shop_id ORDER BY created_at DESC, id DESC)) WHERE r <= 50""")


_CUR = ["id", "tenant_id", "shop_id", "name", "session_id", "created_at", "path", "currency", "profile_id", "revenue", "has_more"]


@query("events_cursor", _cursor_sql("name IN ('page_view', 'add_to_cart') AND (created_at < TIMESTAMP '2024-01-20 12:00:00' OR (created_at = TIMESTAMP '2024-01-20 12:00:00' AND id < 5000))"))
def _(t):
    return L.events_cursor(t.evs, ["page_view", "add_to_cart"], cursor=("2024-01-20 12:00:00", 5000), currency="EUR").select(*_CUR)


@query("conversions_cursor", _cursor_sql(f"{_CONV} AND created_at >= TIMESTAMP '2024-01-10'"))
def _(t):
    return L.conversions_cursor(t.evs, start="2024-01-10", currency="EUR").select(*_CUR)


@query("event_details", sql(f"""
SELECT e.id, {_WHO.replace('customer_id', 'e.customer_id').replace('device_id', 'e.device_id')} AS profile_id, s.duration AS session_duration, s.started_at AS session_started_at, s.ended_at AS session_ended_at,
  s.entry_path AS session_entry_path, s.exit_path AS session_exit_path,
  CASE WHEN coalesce(revenue, 0) > 0 THEN CASE WHEN currency = 'USD' THEN revenue ELSE cast(round(revenue / CASE currency WHEN 'GBP' THEN 0.77::double WHEN 'BDT' THEN 123.0::double
    ELSE 0.89::double END) AS bigint) END ELSE 0 END AS revenue FROM evs e LEFT JOIN se s USING (tenant_id, shop_id, session_id)"""))
def _(t):
    return L.event_details(t.evs, t.se).select("id", "profile_id", "session_duration", "session_started_at", "session_ended_at", "session_entry_path", "session_exit_path", "revenue")


def _summary_sql(usd):
    dims = ", ".join(f"first({d} ORDER BY created_at, id) AS {d}" for d in L._DIMS)
    return f"""SELECT tenant_id, shop_id, session_id, {dims}, first(customer_id ORDER BY created_at, id) FILTER (customer_id IS NOT NULL) AS customer_id,
      min(created_at) AS started_at, max(created_at) AS ended_at, date_diff('second', min(created_at), max(created_at)) AS duration,
      coalesce(first(path ORDER BY created_at, id) FILTER (path <> ''), '') AS entry_path, coalesce(last(path ORDER BY created_at, id) FILTER (path <> ''), '') AS exit_path,
      count(*) AS events_count, count(*) FILTER (name = 'screen_view') AS screen_views_count, bool_or(name ILIKE '%cart%') AS has_cart_add,
      bool_or(name ILIKE '%purchase%' OR name ILIKE '%order%') AS has_purchase, cast(coalesce(sum(revenue_usd) FILTER ({usd}), 0) AS bigint) AS total_revenue
    FROM evs GROUP BY tenant_id, shop_id, session_id"""


@query("session_summaries", sql(_summary_sql("name ILIKE '%purchase%' OR name ILIKE '%order%'")))
def _(t):
    return L.session_summary(t.evs)


@query("session_details", sql("SELECT d.*, r.session_id IS NOT NULL AS has_replay FROM d LEFT JOIN (SELECT DISTINCT session_id FROM evs WHERE name = 'error') r USING (session_id)",
                              f"d AS ({_summary_sql('true')})"))
def _(t):
    return L.with_replay(L.session_summary(t.evs, all_revenue=True), t.evs.where(F.col("name") == "error"))


@query("sessions_page", sql("""
SELECT * REPLACE (CASE WHEN exit_path <> '' THEN exit_path WHEN entry_path <> '' THEN entry_path ELSE '/' END AS exit_path, CASE WHEN entry_path <> '' THEN entry_path ELSE '/' END AS entry_path,
  coalesce(nullif(referrer_name, ''), nullif(referrer, ''), 'Direct') AS referrer_name, duration * 1000 AS duration), events_count <= 1 AS is_bounce
FROM (""" + _page("SELECT *, count(*) OVER (PARTITION BY tenant_id, shop_id) AS total FROM d", "ended_at DESC, session_id", 1, 50) + ")",
    f"""d AS ({_summary_sql("name ILIKE '%purchase%' OR name ILIKE '%order%'")})"""))
def _(t):
    return L.sessions_page(t.evs)


@query("session_events", sql(_page("SELECT tenant_id, shop_id, session_id, id, name, created_at FROM evs", "created_at, id", 1, 100, "tenant_id, shop_id, session_id")))
def _(t):
    return L.session_events(t.evs).select(*SHOP, "session_id", "id", "name", "created_at")


@query("session_values", sql("SELECT DISTINCT tenant_id, shop_id, referrer_name AS value FROM se WHERE referrer_name <> ''"))
def _(t):
    return L.session_values(t.se, "referrer_name")


@query("replay_page", sql("""
SELECT tenant_id, shop_id, session_id, chunk_index, started_at, payload, n > 3 AS has_more FROM (
  SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY session_id) AS n FROM (
    SELECT * FROM (SELECT tenant_id, shop_id, session_id, product_id AS chunk_index, created_at AS started_at,
        CASE product_id % 7 WHEN 0 THEN '[{"broken": ' WHEN 1 THEN '{"type": 1}' ELSE '[{"type": ' || (product_id % 5) || '}]' END AS payload, product_id % 7 > 1 AS good FROM evs)
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY started_at, chunk_index) BETWEEN 2 AND 5) WHERE good
  WINDOW w AS (PARTITION BY session_id ORDER BY started_at, chunk_index)) WHERE r <= 3"""))
def _(t):
    k = F.col("product_id")
    payload = (F.when(k % 7 == 0, F.lit('[{"broken": ')).when(k % 7 == 1, F.lit('{"type": 1}'))
               .otherwise(F.concat(F.lit('[{"type": '), (k % 5).cast("string"), F.lit("}]"))))
    chunks = t.evs.select(*SHOP, "session_id", k.alias("chunk_index"), F.col("created_at").alias("started_at"), payload.alias("payload"))
    return L.replay_page(chunks, offset=1, size=3)


@query("bot_events", sql(_page("SELECT tenant_id, shop_id, id, name, created_at FROM ev WHERE product_id < 20", "created_at DESC, id DESC", 1, 50)))
def _(t):
    ev = t.ev.withColumn("properties", F.when(F.col("product_id") < 20, F.create_map(F.lit("__bot"), F.lit("1"))).otherwise(F.col("properties")))
    return L.bot_events(ev).select(*SHOP, "id", "name", "created_at")
