"""Request normalisation, enrichment and conversion payloads over bodies derived from the event and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.enrich import assemble as E
from tidemark.enrich import network as N
from tidemark.enrich import payload as P
from tidemark.enrich import web as W
from tidemark.export import conversions as X
from tidemark.functions import currency as C
from tidemark.plans.registry import query, sql

_CHROME = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
_IPHONE = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1"
_BOT = "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)"
_GO = "Go-http-client/1.0"
_SHOPS = "00000000-0000-4000-8000-00000000000"
_TENANT = "11111111-1111-4111-8111-111111111111"


def _raw(t):
    """Six kinds of request bodies, by event id. Every event sends its own id, by which a request sent again is told from an equal one."""
    k, kind = F.col("product_id"), F.col("id") % 6
    sent = F.concat(F.lit("e-"), F.col("id").cast("string")).alias("event_id")
    shop, tenant = F.concat(F.lit(_SHOPS), F.col("shop_id").cast("string")), F.lit(_TENANT)
    who = F.concat(F.lit("22222222-2222-4222-8222-"), F.lpad(F.regexp_extract("device_id", r"(\d+)", 1), 12, "0"))
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    props = F.struct(k.alias("k"), F.struct(F.lit(True).alias("a"), F.array(F.lit(1), F.lit(2)).alias("list")).alias("nested"), F.lit("DE").alias("country"))
    track = F.struct(sent, shop.alias("shop_id"), tenant.alias("tenant_id"), F.col("name"), F.col("device_id"), F.col("path"), (k + F.lit(0.5)).alias("value"), F.col("currency"),
                     F.floor(us / 1000).alias("timestamp"), props.alias("properties"))
    item = F.struct(F.concat(F.lit("sku_"), k.cast("string")).alias("item_id"), F.lit("Thing").alias("item_name"), F.lit(9.5).alias("price"), F.lit(2).alias("quantity"))
    shopping = F.struct(F.array(item, item).alias("items"), F.lit(29.5).alias("value"), F.lit("EUR").alias("currency"), F.concat(F.lit("t-"), F.col("id").cast("string")).alias("transaction_id"))
    bodies = [
        F.to_json(F.struct(F.lit("track").alias("type"), track.alias("payload"))),
        F.to_json(F.struct(sent, shop.alias("shop_id"), tenant.alias("tenant_id"), F.col("name").alias("event"), (k * 100).cast("string").alias("revenue"), F.col("currency"),
                           F.floor(us / 1000000).alias("timestamp"), F.col("referrer"))),
        F.to_json(F.struct(sent, shop.alias("client_id"), who.alias("profile_id"), F.lit("A@x.io").alias("email"), F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"))),
        F.to_json(F.struct(sent, shop.alias("shop_id"), tenant.alias("tenant_id"), F.col("name"), shopping.alias("ecommerce"))),
        F.to_json(F.struct(sent, shop.alias("shop_id"), tenant.alias("tenant_id"), F.col("path"))),
        F.to_json(F.struct(F.lit("not-a-uuid").alias("shop_id"), tenant.alias("tenant_id"), F.col("name"))),
    ]
    body = bodies[-1]
    for i in range(5):
        body = F.when(kind == i, bodies[i]).otherwise(body)
    ua = F.when(k % 4 == 0, F.lit(_CHROME)).when(k % 4 == 1, F.lit(_IPHONE)).when(k % 4 == 2, F.lit(_BOT)).otherwise(F.lit(_GO))
    return t.ev.select("id", body.alias("body"), F.lit(_TENANT).alias("header_tenant_id"), F.concat(F.lit("10.0."), (k % 7).cast("string"), F.lit(".9, 8.8.8.8")).alias("x_forwarded_for"),
                       F.lit("127.0.0.1:99").alias("remote_addr"), ua.alias("user_agent"), F.lit("https://shop.example.com").alias("origin"), F.col("created_at").alias("received_at")), who


_RAW_SQL = f"""q AS (SELECT *, id % 6 AS kind, product_id AS k, '{_SHOPS}' || shop_id AS shop, '22222222-2222-4222-8222-' || lpad(regexp_extract(device_id, '\\d+'), 12, '0') AS who,
  CASE product_id % 4 WHEN 0 THEN '{_CHROME}' WHEN 1 THEN '{_IPHONE}' WHEN 2 THEN '{_BOT}' ELSE '{_GO}' END AS ua, '10.0.' || (product_id % 7) || '.9' AS ip FROM ev)"""
_STATUS = """CASE WHEN kind = 4 THEN 'missing_name' WHEN kind = 5 THEN 'invalid_shop_id' WHEN k % 4 = 2 THEN 'crawler_accepted' ELSE 'accepted' END"""
_NAME = "CASE kind WHEN 2 THEN 'identify' WHEN 4 THEN '' ELSE name END"
_CENTS = "CASE kind WHEN 0 THEN k * 100 + 50 WHEN 1 THEN k * 100 WHEN 3 THEN 2950 END"
_CUR = "CASE WHEN kind IN (0, 1) THEN currency WHEN kind = 3 THEN 'EUR' ELSE '' END"
_USD = f"cast(round(({_CENTS}) / CASE {_CUR} WHEN 'EUR' THEN 0.89::double WHEN 'GBP' THEN 0.77::double WHEN 'BDT' THEN 123.0::double ELSE 1.0::double END) AS bigint)"


@query("ingest_events", sql(f"""
SELECT {_STATUS} AS status, CASE kind WHEN 5 THEN NULL ELSE shop END AS shop_id, '{_TENANT}' AS tenant_id, {_NAME} AS name, CASE kind WHEN 0 THEN device_id END AS sent_device,
  CASE kind WHEN 2 THEN who END AS customer_id, cast({_CENTS} AS bigint) AS revenue, {_USD} AS revenue_usd, {_CUR} AS currency, CASE WHEN kind IN (0, 4) THEN path ELSE '' END AS path,
  CASE k % 4 WHEN 0 THEN 'macOS' WHEN 1 THEN 'iOS' ELSE '' END AS os, CASE k % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Mobile Safari' ELSE '' END AS browser,
  CASE k % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'server' END AS device, CASE kind WHEN 0 THEN 'DE' ELSE '' END AS country, ip,
  CASE kind WHEN 0 THEN cast(k AS varchar) END AS prop_k, CASE kind WHEN 0 THEN 'true' END AS prop_a, CASE kind WHEN 0 THEN '[1,2]' END AS prop_list,
  CASE kind WHEN 3 THEN '2' END AS prop_items, CASE kind WHEN 3 THEN 'sku_' || k END AS prop_sku, CASE kind WHEN 3 THEN 't-' || id END AS prop_transaction,
  CASE kind WHEN 2 THEN '1' END AS prop_email, CASE kind WHEN 0 THEN date_trunc('millisecond', created_at) WHEN 1 THEN date_trunc('second', created_at) WHEN 2 THEN date_trunc('second', created_at)
    ELSE created_at END AS created_at FROM q""", _RAW_SQL))
def _(t):
    raw, _ = _raw(t)
    out = P.track_events(raw)
    prop = lambda n: F.col("properties")[n]
    return out.select("status", "shop_id", "tenant_id", "name", F.when(F.col("device_id").startswith("dev-"), F.col("device_id")).alias("sent_device"), "customer_id", "revenue", "revenue_usd",
                      "currency", "path", "os", "browser", "device", "country", "ip", prop("k").alias("prop_k"), prop("nested.a").alias("prop_a"), prop("nested.list").alias("prop_list"),
                      prop("items_count").alias("prop_items"), prop("item_id").alias("prop_sku"), prop("transaction_id").alias("prop_transaction"), prop("email_provided").alias("prop_email"), "created_at")


@query("ingest_fingerprints", sql(f"""SELECT sha256('salt:' || shop || ':' || ip || ':' || ua) AS device_id, count(*) AS count FROM q WHERE kind IN (1, 2, 3) GROUP BY ALL""", _RAW_SQL))
def _(t):
    raw, _ = _raw(t)
    ok = P.track_events(raw.where(F.col("id") % 6 != 5), salt="salt").where(~F.col("device_id").startswith("dev-") & (F.col("name") != ""))
    return ok.groupBy("device_id").agg(F.count(F.lit(1)).alias("count"))


@query("ingest_batches", sql(f"""SELECT {_NAME} AS name, count(*) AS count FROM q WHERE kind NOT IN (4, 5) GROUP BY ALL""", _RAW_SQL))
def _(t):
    raw, _ = _raw(t)
    # Bodies of one device and hour are sent together; the envelope form is for single events only.
    inner = F.coalesce(F.from_json("body", "payload string")["payload"], F.col("body"))
    batches = raw.withColumn("b", inner).groupBy("header_tenant_id", F.floor(F.col("id") / 6).alias("_b")).agg(
        F.concat(F.lit('{"events":['), F.array_join(F.collect_list("b"), ","), F.lit("]}")).alias("body"), F.max("received_at").alias("received_at"))
    out = P.track_events(P.explode_batches(batches).withColumn("user_agent", F.lit(_CHROME)))
    return out.where(F.col("status") == "accepted").groupBy("name").agg(F.count(F.lit(1)).alias("count"))


@query("ingest_replay_chunks", sql(f"""
SELECT CASE WHEN k % 10 = 0 THEN 'invalid_session_id' ELSE 'accepted' END AS status, '{_TENANT}' AS tenant_id, shop AS shop_id, CASE WHEN k % 10 > 0 THEN who END AS session_id,
  k AS chunk_index, date_trunc('millisecond', created_at) AS started_at, date_trunc('millisecond', created_at) + CASE WHEN k % 2 = 0 THEN INTERVAL 5 SECOND ELSE INTERVAL 0 SECOND END AS ended_at,
  k % 3 AS events_count, k % 2 = 0 AS is_full_snapshot, '[{{"type":4}}]' AS payload FROM (SELECT * REPLACE (k::bigint AS k) FROM q)""", _RAW_SQL))
def _(t):
    k = F.col("product_id")
    _, who = _raw(t)
    ms = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 1000)
    shop = F.concat(F.lit(_SHOPS), F.col("shop_id").cast("string"))
    session = F.when(k % 10 > 0, who).otherwise(F.lit("nope"))
    even = F.struct(shop.alias("shop_id"), F.lit(_TENANT).alias("tenant_id"), session.alias("session_id"), k.alias("chunk_index"), (k % 3).alias("events_count"), F.lit(True).alias("is_full_snapshot"),
                    ms.alias("started_at"), (ms + 5000).alias("ended_at"), F.lit('[{"type":4}]').alias("payload"))
    odd = F.struct(shop.alias("shopId"), F.lit(_TENANT).alias("tenantId"), session.alias("session_id"), k.alias("chunkIndex"), (k % 3).alias("eventsCount"), F.lit(False).alias("isFullSnapshot"),
                   ms.alias("startedAt"), (ms - 5000).alias("endedAt"), F.lit('[{"type":4}]').alias("payload"))
    wrap = lambda s: F.to_json(F.struct(F.lit("replay").alias("type"), s.alias("payload")))
    raw = t.ev.select(F.when(k % 2 == 0, wrap(even)).otherwise(wrap(odd)).alias("body"), F.col("created_at").alias("received_at"))
    return P.replay_chunks(raw)


# --- addresses: the page table ---

_ABS = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_REST = "regexp_replace(url, '^https?://[^/?#]*', '')"


@query("url_parts", f"""SELECT page_id, lower({_ABS}) AS origin, CASE WHEN regexp_extract({_REST}, '^([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({_REST}, '^([^?#]*)', 1) END AS path,
  regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '(#.+)$', 1) AS hash, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '') AS page,
  coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), '') AS ref FROM pages""")
def _(t):
    parts = W.split_url(F.col("url"))
    df = t.raw("pages").select("page_id", *[c.alias(n) for n, c in parts.items()])
    p = W.query_params(F.col("query"))
    return df.select("*", F.coalesce(p["page"], F.lit("")).alias("page"), F.coalesce(p["ref"], F.lit("")).alias("ref"))


@query("url_campaigns", """SELECT page_id, CASE WHEN s <> '' THEN coalesce(CASE s WHEN 'google' THEN 'Google' WHEN 'news' THEN 'Daily News' END, s) END AS campaign_name,
  CASE WHEN s <> '' THEN coalesce(CASE s WHEN 'google' THEN 'search' WHEN 'news' THEN 'email' END, '') END AS campaign_type
FROM (SELECT page_id, lower(coalesce(nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), ''), regexp_extract(url, '[?&]ref=([^&#]*)', 1))) AS s FROM pages)""")
def _(t):
    table = W.referrer_table(t.spark, [("google.com", "Google", "search"), ("news.com", "Daily News", "email")])
    df = t.raw("pages").withColumn("query_params", W.query_params(W.split_url(F.col("url"))["query"]))
    return W.with_campaign(df, table).select("page_id", "campaign_name", "campaign_type")


@query("url_same_domain", """SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) = 'example.com' AS same, regexp_replace(url, '/+$', '') AS stripped FROM pages""")
def _(t):
    return t.raw("pages").select("page_id", W.same_domain(F.col("url"), F.lit("https://example.com/x")).alias("same"), W.strip_slashes(F.col("url")).alias("stripped"))


@query("referrer_classes", sql("""SELECT id, CASE product_id % 5 WHEN 1 THEN 'Google' WHEN 2 THEN 'Twitter' WHEN 4 THEN 'Reddit' ELSE '' END AS referrer_name,
  CASE product_id % 5 WHEN 1 THEN 'search' WHEN 2 THEN 'social' WHEN 4 THEN 'social' ELSE '' END AS referrer_type, regexp_replace(referrer, '/+$', '') AS referrer FROM ev"""))
def _(t):
    ev = t.ev.drop("referrer_name", "referrer_type")
    return W.with_referrer(ev, W.referrer_table(t.spark)).select("id", "referrer_name", "referrer_type", "referrer")


@query("title_slugs", """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' | ' || p_brand), '[^a-z0-9| ]', '', 'g'), '[| ]+', '-', 'g'), '-') AS slug FROM part""")
def _(t):
    return t.raw("part").select("p_partkey", W.slug(F.concat("p_name", F.lit(" | "), F.regexp_replace("p_brand", "-", ""))).alias("slug"))



@query("blocked_names", sql("""SELECT id, CASE product_id % 6 WHEN 0 THEN 'page_view' WHEN 1 THEN '/wp-login.php' WHEN 2 THEN 'x'' OR ''1' WHEN 3 THEN repeat('a', 81) WHEN 4 THEN '/.env' ELSE 'line' || chr(10) || 'break' END AS name,
  product_id % 6 <> 0 AS blocked, product_id % 6 = 0 AS valid FROM ev"""))
def _(t):
    k = F.col("product_id") % 6
    name = (F.when(k == 0, F.lit("page_view")).when(k == 1, F.lit("/wp-login.php")).when(k == 2, F.lit("x' OR '1")).when(k == 3, F.repeat(F.lit("a"), F.lit(81)))
            .when(k == 4, F.lit("/.env")).otherwise(F.lit("line\nbreak")))
    return t.ev.select("id", name.alias("name"), W.is_blocked_name(name).alias("blocked"), W.is_valid_track(name, F.lit(None).cast("string")).alias("valid"))


@query("revenue_validity", sql("""SELECT id, CASE product_id % 5 WHEN 0 THEN '12' WHEN 1 THEN '12.5' WHEN 2 THEN '-3' WHEN 3 THEN '"12"' END AS amount, product_id % 5 IN (0, 4) AS valid FROM ev"""))
def _(t):
    k = F.col("product_id") % 5
    amount = F.when(k == 0, F.lit("12")).when(k == 1, F.lit("12.5")).when(k == 2, F.lit("-3")).when(k == 3, F.lit('"12"'))
    return t.ev.select("id", amount.alias("amount"), W.is_valid_track(F.lit("revenue"), amount).alias("valid"))


# --- network: every customer is a /24, a third of the events come from one address ---

@query("network_lookup", sql("""
SELECT id, ip, CASE WHEN u < 400 THEN c_mktsegment END AS geo_city, CASE WHEN u < 400 THEN CASE WHEN u % 2 = 0 THEN 16509 ELSE 7922 END END::bigint AS geo_asn, u < 400 AND u % 2 = 0 AS datacenter
FROM (SELECT id, CASE WHEN product_id % 3 = 0 THEN '11.0.7.7' ELSE '11.0.' || (product_id % 200) || '.5' END AS ip, CASE WHEN product_id % 3 = 0 THEN 7 ELSE product_id % 200 END AS u FROM ev)
LEFT JOIN customer ON c_custkey = u + 1"""))
def _(t):
    k, c = F.col("product_id"), F.col("c_custkey") - 1
    base = 11 * 256 ** 3
    nets = t.raw("customer").select((base + c * 256).alias("start"), (base + c * 256 + 255).alias("end"), F.lit("US").alias("country"), F.col("c_mktsegment").alias("city"), F.lit(0.0).alias("latitude"),
                                    F.lit(0.0).alias("longitude"), F.when(c % 2 == 0, F.lit(16509)).otherwise(F.lit(7922)).cast("bigint").alias("asn"))
    ip = F.when(k % 3 == 0, F.lit("11.0.7.7")).otherwise(F.concat(F.lit("11.0."), (k % 200).cast("string"), F.lit(".5")))
    out = N.with_network(t.ev.select("id", ip.alias("ip")), nets)
    return out.select("id", "ip", "geo_city", "geo_asn", N.is_datacenter(F.col("geo_asn")).alias("datacenter"))


@query("network_lookup_v6", sql("""
SELECT id, ip, CASE WHEN u < 100 THEN CASE WHEN inner_net THEN 'inner' ELSE c_mktsegment END END AS geo_city, CASE WHEN u < 100 THEN CASE WHEN u % 2 = 0 THEN 16509 ELSE 7922 END END::bigint AS geo_asn
FROM (SELECT id, product_id % 200 AS u, product_id % 3 = 0 AS inner_net, CASE WHEN product_id % 7 = 6 THEN 'none' WHEN product_id % 3 = 0 THEN '2001:DB8:' || printf('%x', product_id % 200) || ':1::' || printf('%x', product_id)
  ELSE '2001:db8:' || printf('%x', product_id % 200) || ':0:0:0:0:' || printf('%x', product_id) END AS ip FROM ev) LEFT JOIN customer ON c_custkey = u + 1 AND u < 100 AND ip <> 'none'""".replace("CASE WHEN u < 100 THEN", "CASE WHEN u < 100 AND ip <> 'none' THEN")))
def _(t):
    """A /48 for every customer below 100, with a /64 nested in it; one address in seven is none."""
    k, c = F.col("product_id"), F.col("c_custkey") - 1
    of = lambda n: F.lower(F.hex(n))
    asn = F.when(c % 2 == 0, F.lit(16509)).otherwise(F.lit(7922)).cast("bigint").alias("asn")
    zero = [F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude")]
    some = t.raw("customer").where(c < 100)
    outer = some.select(F.concat(F.lit("2001:db8:"), of(c), F.lit("::")).alias("start"), F.concat(F.lit("2001:db8:"), of(c), F.lit(":ffff:ffff:ffff:ffff:ffff")).alias("end"),
                        F.lit("US").alias("country"), F.col("c_mktsegment").alias("city"), *zero, asn)
    inner = some.select(F.concat(F.lit("2001:db8:"), of(c), F.lit(":1::")).alias("start"), F.concat(F.lit("2001:db8:"), of(c), F.lit(":1:ffff:ffff:ffff:ffff")).alias("end"),
                        F.lit("US").alias("country"), F.lit("inner").alias("city"), *zero, asn)
    ip = F.when(k % 7 == 6, F.lit("none")).when(k % 3 == 0, F.concat(F.lit("2001:DB8:"), of(k % 200), F.lit(":1::"), of(k))).otherwise(
        F.concat(F.lit("2001:db8:"), of(k % 200), F.lit(":0:0:0:0:"), of(k)))
    nets = t.spark.createDataFrame([], "start bigint, end bigint, country string, city string, latitude double, longitude double, asn bigint")
    return N.with_network(t.ev.select("id", ip.alias("ip")), nets, networks6=outer.unionByName(inner)).select("id", "ip", "geo_city", "geo_asn")


@query("ingest_refused_batches", sql("""SELECT CASE b % 4 WHEN 0 THEN 'empty_batch' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'batch_too_large' ELSE 'accepted' END AS status,
  sum(CASE WHEN b % 4 = 3 THEN n ELSE 1 END)::bigint AS count FROM (SELECT id // 600 AS b, count(*) AS n FROM q WHERE kind = 1 AND k % 4 <> 2 GROUP BY ALL) GROUP BY ALL""", _RAW_SQL))
def _(t):
    """Batches of about a hundred events: one in four empty, one unreadable, one above the limit."""
    raw, _ = _raw(t)
    rows = raw.where((F.col("id") % 6 == 1) & ~F.col("user_agent").contains("Googlebot"))
    b = F.col("_b") % 4
    some = F.concat(F.lit('{"events":['), F.array_join(F.collect_list("body"), ","), F.lit("]}"))
    many = F.concat(F.lit('{"events":['), F.array_join(F.array_repeat(F.min("body"), 501), ","), F.lit("]}"))
    batches = rows.groupBy("header_tenant_id", F.floor(F.col("id") / 600).alias("_b")).agg(some.alias("some"), many.alias("many"), F.max("received_at").alias("received_at"))
    body = F.when(b == 0, F.lit('{"events":[]}')).when(b == 1, F.lit("{oops")).when(b == 2, F.col("many")).otherwise(F.col("some"))
    sent = batches.select("header_tenant_id", body.alias("body"), "received_at", F.lit(_CHROME).alias("user_agent"))
    return P.track_events(P.explode_batches(sent, 500)).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


@query("ingest_pipeline", sql("""
SELECT shop AS shop_id, name, country, referrer_name, marked, count(*) AS count, count(DISTINCT session) AS sessions FROM (
  SELECT *, sum(opened) OVER (PARTITION BY shop, device ORDER BY seen, id ROWS UNBOUNDED PRECEDING) || ':' || device AS session FROM (
    SELECT *, CASE WHEN seen - lag(seen) OVER (PARTITION BY shop, device ORDER BY seen, id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opened FROM (
      SELECT id, shop, CASE kind WHEN 2 THEN 'identify' ELSE name END AS name, CASE WHEN kind = 0 THEN device_id ELSE ip || ua END AS device, CASE WHEN k % 7 < 5 THEN 'US' WHEN kind = 0 THEN 'DE' ELSE '' END AS country,
        CASE WHEN kind = 1 THEN CASE k % 5 WHEN 1 THEN 'Google' WHEN 2 THEN 'Twitter' WHEN 4 THEN 'Reddit' ELSE '' END ELSE '' END AS referrer_name, k % 7 < 5 AND (k % 7) % 2 = 0 AS marked,
        CASE kind WHEN 0 THEN date_trunc('millisecond', created_at) WHEN 3 THEN created_at ELSE date_trunc('second', created_at) END AS seen
      FROM q WHERE kind < 4 AND k % 4 <> 2))) GROUP BY ALL""", _RAW_SQL))
def _(t):
    """Every request sent twice; five networks, of which three belong to a hosting provider."""
    raw, _ = _raw(t)
    nets = t.spark.range(5).select((10 * 256 ** 3 + F.col("id") * 256).alias("start"), (10 * 256 ** 3 + F.col("id") * 256 + 255).alias("end"), F.lit("US").alias("country"), F.lit("X").alias("city"),
                                   F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.when(F.col("id") % 2 == 0, F.lit(16509)).otherwise(F.lit(7922)).cast("bigint").alias("asn"))
    events, _ = E.assembled(raw.unionAll(raw), nets, W.referrer_table(t.spark))
    marked = F.coalesce(F.col("properties")["__bot_reasons"], F.lit("")) != ""
    return events.groupBy("shop_id", "name", "country", "referrer_name", marked.alias("marked")).agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("session_id").alias("sessions"))


@query("bot_marks", sql("""SELECT id, CASE WHEN b OR (d AND h) THEN '1' END AS bot, nullif(concat_ws(',', CASE WHEN b THEN 'ua:bot_pattern' END, CASE WHEN d THEN 'datacenter_ip:AS16509' END,
  CASE WHEN h THEN 'header:no_accept' END), '') AS reasons FROM (SELECT id, product_id % 5 = 0 AS b, product_id % 2 = 0 AS d, product_id % 3 = 0 AS h FROM ev)"""))
def _(t):
    k = F.col("product_id")
    none = F.array().cast("array<string>")
    reasons = N.bot_reasons(k % 5 == 0, F.when(k % 2 == 0, F.lit(16509)).otherwise(F.lit(7922)), F.when(k % 3 == 0, F.array(F.lit("header:no_accept"))).otherwise(none))
    sent = F.create_map(F.lit("__bot"), F.lit("0"), F.lit("k"), k.cast("string"))
    p = N.mark_bots(sent, reasons)
    return t.ev.select("id", p["__bot"].alias("bot"), p["__bot_reasons"].alias("reasons"))


@query("rapid_duplicates", sql("""
SELECT id, shop_id, device_id, name, path, created_at FROM g JOIN keep USING (shop_id, device_id, name, path, t) QUALIFY row_number() OVER (PARTITION BY shop_id, device_id, name, path, t ORDER BY id) = 1""",
    """g AS (SELECT id, shop_id, 'dev-' || (product_id % 20) AS device_id, name, path, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01')) // 50000) AS created_at,
      epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01')) // 50000 AS t FROM ev)""",
    """keep AS (SELECT shop_id, device_id, name, path, min(t) AS t FROM g GROUP BY ALL UNION ALL
      SELECT shop_id, device_id, name, path, nxt FROM keep JOIN LATERAL (SELECT min(g.t) AS nxt FROM g WHERE g.shop_id = keep.shop_id AND g.device_id = keep.device_id AND g.name = keep.name
        AND g.path = keep.path AND g.t >= keep.t + 100000) ON true WHERE nxt IS NOT NULL)"""))
def _(t):
    # Time runs 50 000 times faster, so events of a device fall within 100 ms of each other.
    start = 1_704_067_200_000_000
    us = F.lit(start) + F.floor((F.unix_micros(F.col("created_at").cast("timestamp")) - start) / 50000)
    ev = t.ev.select("id", "tenant_id", "shop_id", F.concat(F.lit("dev-"), (F.col("product_id") % 20).cast("string")).alias("device_id"), "name", "path", F.timestamp_micros(us).cast("timestamp_ntz").alias("created_at"))
    return P.suppress_rapid(ev).select("id", "shop_id", "device_id", "name", "path", "created_at")


@query("repeated_ids", sql("""SELECT shop_id, min(created_at) AS created_at, device_id AS id FROM ev GROUP BY shop_id, device_id"""))
def _(t):
    ev = t.ev.withColumn("id", F.col("device_id"))
    return P.drop_repeated_ids(ev).select("shop_id", "created_at", "id")


# --- currency ---

_RATE = "CASE {c} WHEN 'USD' THEN 1.0 WHEN 'EUR' THEN 0.89 WHEN 'GBP' THEN 0.77 ELSE 123.0 END::double"


@query("currency_conversions", sql(f"""SELECT id, cast(round(revenue / {_RATE.format(c='currency')}) AS bigint) AS usd, cast(round(revenue * {_RATE.format(c='currency')}) AS bigint) AS from_usd,
  CASE WHEN currency = 'GBP' THEN revenue ELSE cast(round(revenue / {_RATE.format(c='currency')} * 0.77::double) AS bigint) END AS gbp,
  round(CASE WHEN currency = 'GBP' THEN product_id + 0.25 ELSE (product_id + 0.25) / {_RATE.format(c='currency')} * 0.77::double END * 1000000) / 1000000 AS amount FROM ev WHERE revenue IS NOT NULL"""))
def _(t):
    cur, gbp = F.col("currency"), F.lit("gbp")
    rows = t.ev.where(F.col("revenue").isNotNull())
    amount = C.convert_amount(F.col("product_id") + F.lit(0.25), cur, gbp)
    return rows.select("id", C.to_usd(F.col("revenue"), cur).alias("usd"), C.from_usd(F.col("revenue"), cur).alias("from_usd"), C.convert(F.col("revenue"), cur, gbp).alias("gbp"),
                       (F.round(amount * 1000000) / 1000000).alias("amount"))


@query("currency_rate_join", sql("""SELECT currency, cast(sum(round(revenue / rate)) AS bigint) AS usd FROM (SELECT currency, revenue, CASE currency WHEN 'EUR' THEN 0.5 WHEN 'GBP' THEN 0.77 WHEN 'BDT' THEN 120.0 ELSE 1.0 END::double AS rate
FROM ev WHERE revenue IS NOT NULL) GROUP BY ALL"""))
def _(t):
    updates = t.spark.createDataFrame([("eur", 0.5), ("BDT", 120.0), ("GBP", -1.0), ("usd", 3.0)], "currency string, rate double")
    rows = C.join_rates(t.ev.where(F.col("revenue").isNotNull()), C.rates_table(t.spark, updates))
    return rows.groupBy("currency").agg(F.sum(F.round(F.col("revenue") / F.col("rate"))).cast("bigint").alias("usd"))


# --- conversion payloads ---

@query("conversion_payloads", sql("""
SELECT shop_id, event_id, event_name, event_time, event_source_url, em, ph, ct, country, external_id, ip, currency, value, order_id, content_ids, num_items, first_price FROM (
  SELECT shop_id, 'ev-' || id AS event_id, CASE name WHEN 'page_view' THEN 'PageView' WHEN 'add_to_cart' THEN 'AddToCart' WHEN 'checkout_step' THEN 'InitiateCheckout' ELSE 'Purchase' END AS event_name,
    epoch_us(created_at) // 1000000 AS event_time, CASE WHEN path = '' THEN origin ELSE origin || path END AS event_source_url, sha256('user' || product_id || '@example.com') AS em, sha256('15551234567') AS ph,
    CASE WHEN city <> '' THEN sha256(replace(lower(city), ' ', '')) END AS ct, CASE WHEN country <> '' THEN sha256(lower(country)) END AS country, sha256(coalesce(customer_id, device_id)) AS external_id, '8.8.8.8' AS ip,
    currency, coalesce(revenue / 100.0::double, 0.0) AS value, CASE WHEN name = 'purchase' THEN 'ord-' || id END AS order_id, CASE WHEN name = 'purchase' THEN 'sku_1,sku_2' ELSE cast(product_id AS varchar) END AS content_ids,
    CASE WHEN name = 'purchase' THEN 4 ELSE 0 END::bigint AS num_items, CASE WHEN name = 'purchase' THEN 9.5::double ELSE coalesce(revenue / 100.0::double, 0.0) END AS first_price
  FROM ev WHERE name <> 'error') WHERE shop_id = 1 OR (shop_id = 0 AND event_name IN ('Purchase', 'AddToCart'))"""))
def _(t):
    items = '[{"item_id":"sku_1","price":9.5,"quantity":3},{"item_id":"sku_2","price_cents":250,"quantity":0}]'
    bought = F.col("name") == "purchase"
    entries = {"event_id": F.concat(F.lit("ev-"), F.col("id").cast("string")), "client_ip": F.lit("8.8.8.8"), "items": F.when(bought, F.lit(items)),
               "transaction_id": F.when(bought, F.concat(F.lit("ord-"), F.col("id").cast("string"))),
               "_user_data": F.concat(F.lit('{"email":" User'), F.col("product_id").cast("string"), F.lit('@Example.com ","phone":"+1 (555) 123-4567"}'))}
    props = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values())), lambda k, v: v.isNotNull())
    ready = '{"pixel_id": "1", "access_token": "x"}'
    shops = t.spark.createDataFrame([(1, 0, True, ready, ["PURCHASE", "addtocart"]), (1, 1, True, ready, []), (1, 2, True, '{"pixel_id": ""}', [])],
                                    "tenant_id int, shop_id bigint, enabled boolean, credentials string, events_whitelist array<string>")
    out = X.payloads(t.ev.withColumn("properties", props), shops)
    u, c = (lambda n: F.col(f"user_data.{n}")), (lambda n: F.col(f"custom_data.{n}"))
    return out.select("shop_id", "event_id", "event_name", "event_time", "event_source_url", u("em").alias("em"), u("ph").alias("ph"), u("ct").alias("ct"), u("country").alias("country"),
                      u("external_id").alias("external_id"), u("client_ip_address").alias("ip"), c("currency").alias("currency"), c("value").alias("value"), c("order_id").alias("order_id"),
                      F.array_join(c("content_ids"), ",").alias("content_ids"), c("num_items").alias("num_items"), F.get(c("contents"), F.lit(0))["item_price"].alias("first_price"))
