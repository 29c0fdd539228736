"""Versioned reads, retention, imports, identity helpers and the remaining projections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.enrich import payload as P
from tidemark.enrich.lookup import lookup
from tidemark.enrich.agents import with_agent
from tidemark.enrich.web import is_crawler
from tidemark.functions.numbers import sanitize
from tidemark.functions.predicates import at_exact_location, at_location, in_scope, tenant_of_shop
from tidemark.operators import traffic as T
from tidemark.plans.registry import AS_OF, HALF, MONTH, query, sql
from tidemark.schema import DEVICE, SHOP
from tidemark.sources import tables as S


@query("latest_session_versions", sql("""
SELECT tenant_id, shop_id, device_id, session_id, created_at AS ended_at, path FROM evs QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id, device_id, session_id ORDER BY created_at DESC, id DESC) = 1"""))
def _(t):
    # Every event stands for a version of its session.
    versions = t.evs.select(*DEVICE, "session_id", F.col("created_at").alias("ended_at"), "path", "id")
    return S.latest_by_key(versions, *S.VERSIONED["sessions"], tie="id").drop("id")


@query("replay_retention", sql("SELECT shop_id, count(*) AS chunks FROM ev WHERE created_at >= TIMESTAMP '2024-01-11' GROUP BY ALL"))
def _(t):
    return S.unexpired(t.ev.withColumnRenamed("created_at", "started_at"), datetime(2024, 2, 10)).groupBy("shop_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("import_web_events", sql("""SELECT cast(id AS varchar) AS id, 'shop-' || shop_id AS shop_id, device_id, name, path, referrer, browser, os, device, country, city, created_at FROM ev WHERE shop_id < 2"""))
def _(t):
    export = t.ev.select(F.col("id").cast("string").alias("event_id"), F.col("shop_id").alias("website_id"), F.col("device_id").alias("session_id"), F.col("name").alias("event_name"), F.col("path").alias("url_path"),
                         F.col("referrer").alias("referrer_domain"), "browser", "os", "device", "country", "city", "created_at")
    projects = t.spark.createDataFrame([("0", "shop-0"), ("1", "shop-1")], "from string, to string")
    return S.import_events(export, S.IMPORT_COLUMNS["umami"], projects=projects)


@query("import_site_events", sql("""SELECT cast(shop_id AS varchar) AS shop_id, device_id, name, path, referrer, country, browser, os, created_at, 'import' AS device FROM ev"""))
def _(t):
    export = t.ev.select(F.col("shop_id").cast("string").alias("site_id"), F.col("device_id").alias("user_id"), "name", F.col("path").alias("pathname"), "referrer",
                         F.col("country").alias("country_code"), "browser", F.col("os").alias("operating_system"), F.col("created_at").alias("timestamp"))
    return S.import_events(export, S.IMPORT_COLUMNS["plausible"], {"device": F.lit("import")})


@query("tenant_of_shop", sql("SELECT shop_id, min(tenant_id) AS tenant_id FROM ev GROUP BY ALL"))
def _(t):
    return tenant_of_shop(t.ev)


for _scope, _cond in (("strict", "tenant_id = 1 AND shop_id = 2"), ("lenient", "shop_id = 2 AND (tenant_id = 1 OR tenant_id IS NULL)"), ("loose", "tenant_id = 1 OR shop_id = 2")):
    query(f"scope_{_scope}", sql(f"SELECT tenant_id, shop_id, count(*) AS count FROM (SELECT * REPLACE (CASE WHEN product_id % 10 > 0 THEN tenant_id END AS tenant_id) FROM ev) WHERE {_cond} GROUP BY ALL"))(
        lambda t, s=_scope: t.ev.withColumn("tenant_id", F.when(F.col("product_id") % 10 > 0, F.col("tenant_id"))).where(in_scope(1, 2, s)).groupBy(*SHOP).agg(F.count(F.lit(1)).alias("count")))


_WEEK = "CAST(date_trunc('day', created_at) - INTERVAL 1 DAY * dayofweek(created_at) AS TIMESTAMP)"
for _interval, _bucket in (("week", _WEEK), ("month", "date_trunc('month', created_at)"), ("hour", "date_trunc('hour', created_at)")):
    query(f"tenant_volume_by_{_interval}", sql(f"SELECT tenant_id, {_bucket} AS bucket, count(*) AS count FROM ev GROUP BY ALL"))(lambda t, i=_interval: T.tenant_volume(t.ev, MONTH, i))

for _detail, _cond in (("country", "country IN ('US', 'DE')"), ("city", "(country = 'US' AND city = 'New York') OR country = 'DE'")):
    query(f"location_{_detail}", sql(f"SELECT shop_id, country, count(*) AS count FROM ev WHERE {_cond} GROUP BY ALL"))(
        lambda t, d=_detail: t.ev.where(at_location([{"country": "US", "city": "New York"}, {"country": "DE", "city": ""}], d)).groupBy("shop_id", "country").agg(F.count(F.lit(1)).alias("count")))


@query("location_exact", sql("SELECT shop_id, country, count(*) AS count FROM ev WHERE (round(latitude, 4) = 51.51 AND round(longitude, 4) = -0.1) OR (round(latitude, 4) = 23.8 AND round(longitude, 4) = 90.4) GROUP BY ALL"))
def _(t):
    return t.ev.where(at_exact_location([{"lat": 51.51, "long": -0.1}, {"lat": 23.80001, "long": 90.4}])).groupBy("shop_id", "country").agg(F.count(F.lit(1)).alias("count"))


@query("sanitized_ratios", sql("SELECT id, CASE WHEN product_id % 3 = 0 THEN 0.0 ELSE product_id / (product_id % 3) END::double AS ratio FROM ev"))
def _(t):
    k = F.col("product_id")
    ratio = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(k / F.nullif(k % 3, F.lit(0)))
    return t.ev.select("id", sanitize(ratio).alias("ratio"))


# --- properties and agents ---



def _bodies(t):
    text = F.concat(F.lit('{"k": '), F.col("product_id").cast("string"),
                    F.lit(', "on": true, "none": null, "blank": "", "list": [1, {"x": 2.5}], "deep": {"a": {"b": "c"}}, "text": "{\\"y\\": 7}", "bad": "{oops"}'))
    return t.ev.select("id", text.alias("body"))


@query("flattened_properties", sql("""SELECT id, unnest(['k', 'on', 'blank', 'list', 'deep.a.b', 'text', 'bad']) AS key,
  unnest([cast(product_id AS varchar), 'true', '', '[1,{"x":2.5}]', 'c', '{"y": 7}', '{oops']) AS value FROM ev"""))
def _(t):
    return _bodies(t).select("id", F.explode(P.flatten_properties(F.col("body"))).alias("key", "value"))


@query("flattened_properties_indexed", sql("""SELECT id, unnest(['k', 'on', 'list.0', 'list.1.x', 'deep.a.b', 'text.y']) AS key, unnest([cast(product_id AS varchar), 'true', '1', '2.5', 'c', '7']) AS value FROM ev"""))
def _(t):
    return _bodies(t).select("id", F.explode(P.flatten_properties(F.col("body"), indexed=True)).alias("key", "value"))


@query("unflattened_properties", sql("""SELECT id, '{"a": {"b": "' || product_id || '"}, "c": "x"}' AS body FROM ev"""))
def _(t):
    return t.ev.select("id", P.unflatten_properties(F.create_map(F.lit("a.b"), F.col("product_id").cast("string"), F.lit("c"), F.lit("x"))).alias("body"))


# (agent, os, browser, device, brand, crawler) of sample agents, spread over the events by product.
_AGENTS = [
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36", "macOS", "Chrome", "desktop", "", False),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1", "iOS", "Mobile Safari", "mobile", "Apple", False),
    ("Mozilla/5.0 (Linux; Android 13; SM-T827R4) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0 Safari/537.36", "Android", "Chrome", "tablet", "", False),
    ("Mozilla/5.0 (Linux; Android 13; Pixel 8 Pro) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0 Mobile Safari/537.36", "Android", "Chrome", "mobile", "Google", False),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:120.0) Gecko/20100101 Firefox/120.0", "Windows", "Firefox", "desktop", "", False),
    ("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36 Edg/120.0", "Linux", "Edge", "desktop", "", False),
    ("node-fetch/1.0", "", "", "server", "", False), ("Screaming Frog SEO Spider/19.0", "", "", "server", "", True),
    ("Shop App; Model=Redmi Note 8 Pro; Manufacturer=Xiaomi", "", "", "mobile", "Xiaomi", False),
]


def _agent_case(i):
    quote = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return "CASE product_id % 9 " + " ".join(f"WHEN {n} THEN {quote(a[i])}" for n, a in enumerate(_AGENTS)) + " END"


@query("user_agents", sql(f"""SELECT id, {_agent_case(1)} AS os, {_agent_case(2)} AS browser, {_agent_case(3)} AS device, {_agent_case(4)} AS brand, {_agent_case(5)} AS crawler FROM ev"""))
def _(t):
    ua = F.element_at(F.array(*[F.lit(a[0]) for a in _AGENTS]), F.col("product_id") % 9 + 1)
    rows = with_agent(t.ev.select("id", ua.alias("user_agent")))
    return rows.select("id", "agent.os", "agent.browser", "agent.device", "agent.brand", is_crawler(F.col("user_agent")).alias("crawler"))


@query("request_lookup", sql(f"""SELECT id, {_agent_case(3)} AS device, 'City ' || (product_id % 50) AS geo_city, product_id % 50 % 2 = 0 AS is_datacenter FROM ev"""))
def _(t):
    ua = F.element_at(F.array(*[F.lit(a[0]) for a in _AGENTS]), F.col("product_id") % 9 + 1)
    requests = t.ev.select("id", F.concat(F.lit("11.0."), (F.col("product_id") % 50).cast("string"), F.lit(".5")).alias("ip"), ua.alias("user_agent"))
    nets = t.ev.select((F.col("product_id") % 50).alias("n")).distinct().select(
        (11 * 256 ** 3 + F.col("n") * 256).alias("start"), (11 * 256 ** 3 + F.col("n") * 256 + 255).alias("end"), F.lit("US").alias("country"), F.concat(F.lit("City "), F.col("n").cast("string")).alias("city"),
        F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.when(F.col("n") % 2 == 0, F.lit(16509)).otherwise(F.lit(1)).cast("bigint").alias("asn"))
    return lookup(requests, nets).select("id", "device", "geo_city", "is_datacenter")


@query("short_fingerprints", sql("SELECT id, substr(sha256('agent:' || device_id || ':' || origin || ':salt'), 1, 32) AS fingerprint FROM ev"))
def _(t):
    return t.ev.select("id", P.short_fingerprint("salt", F.lit("agent"), F.col("device_id"), F.col("origin")).alias("fingerprint"))


@query("top_country_approximate", sql("""SELECT tenant_id, shop_id, country, count(DISTINCT session_id) AS sessions, true AS close FROM evs
WHERE created_at BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-31' GROUP BY ALL"""))
def _(t):
    """Sketched counts beside exact ones: within three times the sketch's relative error."""
    rows = t.during(HALF).where(HALF.current(F.col("created_at")))
    # An exact distinct count beside a sketch would keep one sketch per session; repeats go first.
    rows = rows.select(*SHOP, "country", "session_id").distinct()
    counts = rows.groupBy(*SHOP, "country").agg(F.count("session_id").alias("sessions"), T.distinct("session_id", 0.01).alias("_about"))
    return counts.select(*SHOP, "country", "sessions", (F.abs(F.col("_about") - F.col("sessions")) <= 0.03 * F.col("sessions")).alias("close"))


@query("realtime_widget", sql("""
SELECT tenant_id, shop_id, 'country' AS kind, country AS item, count(DISTINCT session_id) AS count FROM w WHERE country <> '' GROUP BY ALL
UNION ALL SELECT tenant_id, shop_id, 'referrer', referrer_name, count(DISTINCT session_id) FROM w WHERE referrer_name <> '' GROUP BY ALL
UNION ALL SELECT tenant_id, shop_id, 'path', path, count(DISTINCT session_id) FROM w WHERE path <> '' GROUP BY ALL""",
    "w AS (SELECT * FROM evs WHERE created_at BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31')"))
def _(t):
    return T.realtime_widget(t.evs, AS_OF, minutes=24 * 60)
