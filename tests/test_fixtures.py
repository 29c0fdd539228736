"""Row-level cases of ingest, enrichment, currency, hashing and scoring."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.enrich import network as N
from tidemark.enrich import payload as P
from tidemark.enrich import agents as A
from tidemark.enrich import web as W
from tidemark.export import conversions as X
from tidemark.functions import currency as C
from tidemark.functions import timeutil as T
from tidemark.operators import scoring as S

SHOP, TENANT = "00000000-0000-4000-8000-000000000001", "11111111-1111-4111-8111-111111111111"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def track(spark, body, **headers):
    row = {"body": json.dumps(body), "received_at": datetime(2024, 1, 1), **headers}
    ddl = ", ".join(f"{k} {'timestamp_ntz' if k == 'received_at' else 'string'}" for k in row)
    return P.track_events(spark.createDataFrame([tuple(row.values())], ddl)).first()


@pytest.mark.parametrize("body, status", [
    ({"shop_id": SHOP, "tenant_id": TENANT, "name": "view_product", "path": "/products/shoes-sneakers"}, "accepted"),
    ({"shop_id": SHOP, "tenant_id": TENANT}, "missing_name"),
    ({"shop_id": "not-a-valid-uuid", "tenant_id": TENANT, "name": "x"}, "invalid_shop_id"),
    ({"shop_id": SHOP, "name": "x"}, "invalid_tenant_id"),
    ({"shop_id": SHOP, "tenant_id": "00000000-0000-0000-0000-000000000000", "name": "x"}, "invalid_tenant_id"),
])
def test_validation(spark, body, status):
    assert track(spark, body)["status"] == status


def test_purchase_alias(spark):
    row = track(spark, {"shop_id": SHOP, "tenant_id": TENANT, "event": "purchase", "value": 49.99, "currency": "USD", "transaction_id": "ord_9988",
                        "items": [{"item_id": "sku", "item_name": "Shoe", "price": 49.99, "quantity": 1}], "user_data": {"client_ip_address": "8.8.8.8", "email": "a@b.c"}},
                x_forwarded_for="10.0.0.1")
    assert (row["name"], row["revenue"], row["revenue_usd"], row["ip"]) == ("purchase", 4999, 4999, "8.8.8.8")
    p = row["properties"]
    assert (p["transaction_id"], p["items_count"], p["item_id"], p["email_provided"]) == ("ord_9988", "1", "sku", "1")


def test_wrapped_cart(spark):
    row = track(spark, {"shop_id": SHOP, "tenant_id": TENANT, "name": "add_to_cart", "ecommerce": {"currency": "EUR", "value": 29.50, "items": [{"item_id": "a"}]}})
    assert (row["revenue"], row["currency"], row["properties"]["items_count"]) == (2950, "EUR", "1")


@pytest.mark.parametrize("body, cents", [
    ({"revenue": 12.9}, 12), ({"revenue": "77"}, 77), ({"properties": {"__revenue": "12.5"}}, 13), ({"properties": {"revenue": 5}, "value": 9}, 5),
    ({"value": 0.005}, 1), ({"properties": {"value": "1.5"}}, 150), ({"properties": {"__revenue": "junk"}, "value": 3}, None), ({}, None),
])
def test_revenue_precedence(spark, body, cents):
    assert track(spark, {"shop_id": SHOP, "tenant_id": TENANT, "name": "x", **body})["revenue"] == cents


@pytest.mark.parametrize("text, expected", [
    ("1704067200", "2024-01-01 00:00:00"), ("1704067200123", "2024-01-01 00:00:00.123"), ("2024-02-03T04:05:06Z", "2024-02-03 04:05:06"), ("2024-02-03T04:05:06.5+02:00", "2024-02-03 02:05:06.5"),
    ("2024-02-03 04:05:06", "2024-02-03 04:05:06"), ("2024-02-03", "2024-02-03 00:00:00"), ("yesterday", "2000-01-01 00:00:00"), ("2024", "1970-01-01 00:33:44"),
])
def test_flexible_timestamp(spark, text, expected):
    got = one(spark, t=P.flexible_timestamp(F.lit(text), F.lit("2000-01-01").cast("timestamp_ntz")))["t"]
    assert got == datetime.fromisoformat(expected)


def test_identify(spark):
    row = track(spark, {"shop_id": SHOP, "tenant_id": TENANT, "profileId": TENANT, "email": "x@y.z", "firstName": "Ann"})
    assert (row["name"], row["customer_id"]) == ("identify", TENANT)
    assert row["properties"]["firstName"] == "Ann" and json.loads(row["properties"]["_user_data"])["email"] == "x@y.z"


@pytest.mark.parametrize("agent", ["Googlebot/2.1", "Mozilla/5.0 BingPreview/1.0b", "GPTBot/1.0", "Screaming Frog SEO Spider/19"])
def test_crawlers(spark, agent):
    assert track(spark, {"shop_id": SHOP, "tenant_id": TENANT, "name": "x"}, user_agent=agent)["status"] == "crawler_accepted"


def test_currency(spark):
    rates = C.merge_rates({"BDT": 120.0, "EUR": 0.89, "gbp": -1, "usd": 7})
    assert rates["USD"] == 1.0 and rates["GBP"] == 0.77
    row = one(spark, a=C.to_usd(F.lit(12000), F.lit("BDT"), rates), b=C.from_usd(F.lit(100), "EUR", rates), c=C.to_usd(F.lit(500), F.lit("XYZ"), rates), d=C.rate_of(F.lit("bdt"), rates))
    assert tuple(row) == (100, 89, 500, 120.0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_hashing(spark):
    row = one(spark, e=X.hash_email(F.lit(" John.Doe+testing@Example.COM ")), p=X.hash_phone(F.lit("+1 (555) 123-4567")), c=X.hash_country(F.lit("USA")), t=X.hash_alpha(F.lit("New York!")), z=X.hash_alpha(F.lit(" ")))
    assert tuple(row) == (sha("john.doe+testing@example.com"), sha("15551234567"), sha("us"), sha("newyork"), "")


@pytest.mark.parametrize("name, expected", [("Purchase ", "Purchase"), ("$pageview", "PageView"), ("login", "CompleteRegistration"), ("MyOwn", "MyOwn"), ("my_own", None), ("subscribe", "Subscribe")])
def test_platform_names(spark, name, expected):
    assert one(spark, n=X.platform_name(F.lit(name)))["n"] == expected


def test_source_url(spark):
    row = one(spark, a=X.source_url(F.lit("https://a.b/"), F.lit("/c")), b=X.source_url(F.lit("https://a.b"), F.lit("c")), c=X.source_url(F.lit(""), F.lit("/c")), d=X.source_url(F.lit("https://a.b"), F.lit("")))
    assert tuple(row) == ("https://a.b/c", "https://a.b/c", "/c", "https://a.b")


def test_datacenters(spark):
    row = one(spark, **{f"a{n}": N.is_datacenter(F.lit(n)) for n in (16509, 15169, 13335, 7922, 7018)})
    assert tuple(row) == (True, True, True, False, False)


@pytest.mark.parametrize("ip, local", [("127.0.0.1", True), ("10.2.3.4", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.9.9", True), ("169.254.1.1", True), ("8.8.8.8", False), ("", True), ("::1", True)])
def test_local_addresses(spark, ip, local):
    assert one(spark, x=N.is_local(F.lit(ip)))["x"] is local


def test_scoring(spark):
    x = {"views_count": F.lit(10), "cart_adds_count": F.lit(2), "distinct_products": F.lit(2), "dwell_time_seconds": F.lit(300)}
    z = S.logit(S.INTENT, x)
    row = one(spark, z=z, s=S.sigmoid(z))
    assert row["z"] == pytest.approx(3.0) and row["s"] == pytest.approx(0.9525741268)


def test_indexed_flattening(spark):
    body = {"a": 1, "b": 2, "array": ["1", "2", "3"], "arrayWithObjects": [{"a": 1}, {"b": 2}, {"c": 3}], "objectWithArrays": {"a": [1, 2, 3]}, "null": None, "empty": "",
            "jsonString": '{"a": 1, "b": 2}', "bad": "{oops", "bad2": "[1,2"}
    got = one(spark, m=P.flatten_properties(F.lit(json.dumps(body)), indexed=True))["m"]
    assert got == {"a": "1", "b": "2", "array.0": "1", "array.1": "2", "array.2": "3", "arrayWithObjects.0.a": "1", "arrayWithObjects.1.b": "2", "arrayWithObjects.2.c": "3",
                   "objectWithArrays.a.0": "1", "objectWithArrays.a.1": "2", "objectWithArrays.a.2": "3", "jsonString.a": "1", "jsonString.b": "2"}


@pytest.mark.parametrize("text, expected", [('{"x": 0.00001}', "0.00001"), ('{"x": 3.0}', "3"), ('{"x": false}', "false"), ('{"x": 1e21}', "1000000000000000000000")])
def test_plain_numbers(spark, text, expected):
    assert one(spark, m=P.flatten_properties(F.lit(text)))["m"]["x"] == expected


@pytest.mark.parametrize("url, name, kind", [
    ("https://google.com/search?q=test", "Google", "search"), ("https://www.twitter.com/user", "Twitter", "social"), ("https://twitter.com/user/", "Twitter", "social"),
    ("https://unknown.example/", "", ""), ("not-a-url", "", "")])
def test_referrers(spark, url, name, kind):
    row = W.with_referrer(spark.createDataFrame([(url,)], "referrer string"), W.referrer_table(spark)).first()
    assert (row["referrer_name"], row["referrer_type"], row["referrer"]) == (name, kind, url.rstrip("/"))


@pytest.mark.parametrize("query, name, kind", [
    ("utm_source=google", "Google", "search"), ("ref=facebook", "Facebook", "social"), ("utm_referrer=twitter", "Twitter", "social"), ("utm_source=GoOgLe", "Google", "search"),
    ("utm_source=mine", "mine", ""), ("utm_source=google&ref=facebook", "Google", "search"), ("x=1", None, None)])
def test_campaigns(spark, query, name, kind):
    df = spark.createDataFrame([(query,)], "q string").withColumn("query_params", W.query_params(F.col("q")))
    row = W.with_campaign(df, W.referrer_table(spark)).first()
    assert (row["campaign_name"], row["campaign_type"]) == (name, kind)


@pytest.mark.parametrize("agent, device", [
    ("Go-http-client/1.0", "server"), ("Go Http Client/1.0", "server"), ("node-fetch/1.0", "server"), ("", "server"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 16_0 like Mac OS X) Version/16.0 Mobile Safari/604.1", "mobile"), ("Mozilla/5.0 (Linux; Android 11; SM-A505FN) Chrome/90.0 Mobile", "mobile"),
    ("Mozilla/5.0 (Linux; Android 5; LG-L160L) Chrome/90.0", "mobile"), ("Mozilla/5.0 (iPad; CPU OS 14_0 like Mac OS X) Version/14.0 Safari/604.1", "tablet"),
    ("Mozilla/5.0 (Linux; Android 13; SM-T827R4) Chrome/119.0", "tablet"), ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36", "desktop"), ("Mozilla/5.0 (X11; Linux x86_64) Firefox/120.0", "desktop"),
    ("App; Model=POCO F3; Manufacturer=Xiaomi", "mobile"), ("App; Model=Galaxy S23 Ultra", "mobile"), ("App; Model=OnePlus 11", "mobile"), ("App; Model=Moto G84", "mobile")])
def test_devices(spark, agent, device):
    assert A.with_agent(spark.createDataFrame([(agent,)], "user_agent string")).first()["agent"]["device"] == device


def test_agent_overrides(spark):
    df = spark.createDataFrame([("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36", {"__os": "BeOS", "__browser": ""})], "user_agent string, p map<string,string>")
    agent = A.with_agent(df, overrides="p").first()["agent"]
    assert (agent["os"], agent["browser"], agent["device"]) == ("BeOS", "Chrome", "desktop")


def test_slug(spark):
    assert one(spark, s=W.slug(F.lit("Hello || World, | Test å å ä ä")))["s"] == "hello-world-test-a-a-a-a"


@pytest.mark.parametrize("url, path, origin, query, hash_", [
    ("https://A.b/c?x=1#top", "/c", "https://a.b", "x=1", "#top"), ("/c?x=1", "/c", "", "x=1", ""), ("home", "home", "", "", ""), ("https://a.b", "/", "https://a.b", "", ""), ("", "", "", "", "")])
def test_urls(spark, url, path, origin, query, hash_):
    p = W.split_url(F.lit(url))
    assert tuple(one(spark, **p)) == (path, origin, query, hash_)


def test_periods():
    now = datetime(2024, 3, 31, 15)
    assert T.resolve_period(now, "today").start == datetime(2024, 3, 31)
    assert T.resolve_period(now, "lastMonth").start == datetime(2024, 2, 1)
    assert T.resolve_period(now, "6m").start == datetime(2023, 9, 30)
    assert T.resolve_period(now, "lastYear").end < datetime(2024, 1, 1)
    p = T.resolve_period(now, "7d")
    assert (p.end - p.start).days == 7 and p.prev_end == p.start
    with pytest.raises(ValueError):
        T.resolve_period(now, "nonsense")
    assert T.event_months(T.resolve_period(now, "90d")) == [202401, 202402, 202403] or T.event_months(T.resolve_period(now, "90d"))[0] == 202401


def test_formula_refuses_code(spark):
    from tidemark.operators.charts import formula_column

    for text in ("__import__('os')", "A.b", "A if B else 1", "f(A)"):
        with pytest.raises(ValueError):
            formula_column(text, {"A": F.lit(1), "B": F.lit(2)})
    assert one(spark, x=formula_column("A / 0 + 2 ^ 3 % 5", {"A": F.lit(1.0)}))["x"] == 3.0
