"""Raw requests to canonical events: one projection over a DataFrame of request bodies, batch or streaming."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.enrich.network import is_local
from tidemark.enrich.agents import with_agent
from tidemark.enrich.web import is_crawler
from tidemark.functions.currency import DEFAULT_RATES, to_usd
from tidemark.functions.timeutil import micros
from tidemark.operators.sessions import chunk_of, number_spans
from tidemark.schema import NIL_UUID, SHOP, row_hash

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# Fields of a request and of its user data. Every field is read as text: senders mix numbers, strings and objects.
TRACK = (
    "tenant_id", "shop_id", "client_id", "name", "event", "event_id", "eventId", "device_id", "session_id", "customer_id", "profileId", "profile_id",
    "firstName", "lastName", "email", "revenue", "value", "currency", "product_id", "cart_id", "order_id", "transaction_id", "items", "ecommerce",
    "user_data", "path", "referrer", "ip", "user_agent", "properties", "timestamp",
)
USER = (
    "email", "phone", "first_name", "last_name", "city", "state", "zip_code", "country_code", "external_id", "fbp", "fbc", "client_ip_address",
    "client_user_agent",
)
ITEM_DDL = ("array<struct<item_id:string,item_name:string,price:double,price_cents:bigint,quantity:bigint,category:string,item_category:string,"
            "item_category2:string,item_brand:string,item_variant:string,coupon:string>>")
# Request columns next to the body; absent ones are taken as null.
HEADERS = (
    "cf_connecting_ip", "x_forwarded_for", "x_real_ip", "remote_addr", "user_agent", "origin", "header_shop_id", "header_tenant_id", "query_shop_id",
    "query_tenant_id", "cf_ipcountry", "x_country_code", "x_country", "received_at",
)

_TEXT_MAP = "map<string,string>"


def _struct(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def filled(col: Column) -> Column:
    """Null for blank text."""
    return F.when(col != "", col)


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols])


def uuid_or_null(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text.rlike(UUID), F.lower(text))


# --- flexible values -------------------------------------------------------------------------

def flexible_int(text: Column) -> Column:
    """Whole numbers, truncated decimals, either of them quoted."""
    text = F.trim(text)
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").cast("bigint"))


def flexible_timestamp(text: Column, otherwise: Column) -> Column:
    """Seconds, or milliseconds above 1e11, or ISO text with an offset, or plain date and time; anything else is ``otherwise``."""
    text = F.trim(text)
    number = F.coalesce(text.try_cast("bigint"), text.try_cast("double").cast("bigint"))
    numeric = F.when(number > 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})| \d{2}:\d{2}:\d{2}(\.\d+)?)?$")
    parsed = F.when(number.isNotNull(), numeric).when(iso, text.try_cast("timestamp"))
    return F.coalesce(parsed.cast("timestamp_ntz"), otherwise)


# --- property flattening ---------------------------------------------------------------------

def _number(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int) or value == int(value):
        return str(int(value))
    return format(Decimal(repr(value)), "f")


def _float(text: str) -> float | str:
    """A number beyond all bounds stays the text it was."""
    value = float(text)
    return value if math.isfinite(value) else text


def _parsed(text: str):
    """A JSON value, or None if it cannot be read, be it for its depth."""
    try:
        return json.loads(text, parse_float=_float, parse_constant=str)
    except (ValueError, RecursionError):
        return None


def _walk(root: dict, indexed: bool) -> dict:
    """Leaves by dotted key, in order. The places still to visit are kept in a list, so depth is not bounded by the call stack."""
    out: dict = {}
    todo = [(root, "")]
    while todo:
        value, prefix = todo.pop()
        if isinstance(value, dict):
            todo += [(child, f"{prefix}.{key}" if prefix else str(key)) for key, child in reversed(value.items())]
        elif isinstance(value, list) and indexed:
            todo += [(child, f"{prefix}.{i}") for i, child in reversed(list(enumerate(value)))]
        elif isinstance(value, list):
            out[prefix] = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        elif isinstance(value, str) and not indexed:
            out[prefix] = value
        elif isinstance(value, str) and value[:1] in ("{", "["):
            # Embedded JSON is opened; what does not parse is left out.
            if value.endswith("}" if value[0] == "{" else "]"):
                todo.append((_parsed(value), prefix))
        elif isinstance(value, str) and value != "":
            out[prefix] = value.strip()
        elif value is not None and not isinstance(value, str):
            out[prefix] = _number(value)
    return out


def _flattener(indexed: bool):
    @F.pandas_udf("string")
    def flatten(texts: pd.Series) -> pd.Series:
        def one(text):
            value = _parsed(text) if text else None
            if not isinstance(value, dict):
                return "{}"
            # Half a surrogate pair is no character and cannot be stored.
            return json.dumps(_walk(value, indexed), ensure_ascii=False).encode("utf-8", "ignore").decode()
        return texts.map(one)
    return flatten


def flatten_properties(text: Column, indexed: bool = False) -> Column:
    """JSON object as a flat map with dotted keys.

    Plain mode keeps arrays as JSON text and drops nulls. Indexed mode numbers array elements, drops blanks, opens JSON held in strings and
    drops what looks like broken JSON. Nesting is unbounded, which column expressions cannot follow, so nested objects pass through Arrow.
    In plain mode a flat object of unescaped texts, whole numbers and booleans, as most are, is read by a built-in function.
    """
    empty = F.create_map().cast(_TEXT_MAP)
    if indexed:
        return F.coalesce(F.from_json(_flattener(True)(text), _TEXT_MAP), empty)
    simple = F.coalesce(F.regexp_replace(text, r'"[^"\\]*+"|true|false|null', '"').rlike(r'^\s*\{[\s",:0-9-]*+\}\s*$'), F.lit(False))
    flat = F.map_filter(F.from_json(F.when(simple, text), _TEXT_MAP), lambda k, v: v.isNotNull())
    return F.coalesce(flat, F.from_json(_flattener(False)(F.when(~simple, text)), _TEXT_MAP), empty)


def unflatten_properties(props: Column) -> Column:
    """Inverse for reading: dotted keys as a nested JSON text."""
    @F.pandas_udf("string")
    def nest(texts: pd.Series) -> pd.Series:
        def one(text):
            root: dict = {}
            for key, value in sorted(json.loads(text or "{}").items()):
                node, parts = root, key.split(".")
                for part in parts[:-1]:
                    node = node.setdefault(part, {}) if isinstance(node.get(part, {}), dict) else node
                node[parts[-1]] = value
            return json.dumps(root, sort_keys=True)
        return texts.map(one)
    return nest(F.to_json(props))


# --- envelope, identity ----------------------------------------------------------------------

def split_envelopes(raw: DataFrame) -> DataFrame:
    """Unwrap ``{type, payload}``; adds ``envelope`` and replaces ``body`` by the payload where there is one."""
    head = F.from_json("body", "type string, payload string")
    return raw.withColumn("_h", head).withColumn("envelope", F.coalesce("_h.type", F.lit(""))).withColumn(
        "body", F.when((F.col("envelope") != "") & F.col("_h.payload").isNotNull(), F.col("_h.payload")).otherwise(F.col("body"))).drop("_h")


def explode_batches(raw: DataFrame, most: int | None = None) -> DataFrame:
    """One row per event of ``{events: [...]}`` bodies, with a null ``refusal``.

    A body that cannot be read, holds no event or, where ``most`` is set, more than ``most`` is refused whole: one row with the body
    and the reason in ``refusal``, which :func:`track_events` takes for its status.
    """
    sized = raw.withColumn("_e", F.from_json("body", "events array<string>")["events"])
    count = F.coalesce(F.size("_e"), F.lit(-1))
    why = F.when(count < 0, "invalid_json").when(count == 0, "empty_batch")
    why = why if most is None else why.when(count > most, "batch_too_large")
    single = F.array(F.col("body"))
    return sized.withColumn("refusal", why).withColumn("_b", F.when(F.col("refusal").isNull(), F.col("_e")).otherwise(single)).select(
        *[c for c in raw.columns if c != "body"], "refusal", F.explode("_b").alias("body"))


def client_ip(body_ip: Column, user_ip: Column) -> Column:
    forwarded = F.trim(F.element_at(F.split(F.col("x_forwarded_for"), ","), 1))
    remote = F.regexp_replace("remote_addr", r":\d+$", "")
    return F.coalesce(first_filled(body_ip, user_ip, F.trim("cf_connecting_ip"), forwarded, F.trim("x_real_ip"), remote), F.lit(""))


def device_fingerprint(salt: str, shop: Column, ip: Column, ua: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), shop, F.coalesce(ip, F.lit("")), F.coalesce(ua, F.lit(""))), 256)


def short_fingerprint(salt: str, ua: Column, ip: Column, origin: Column) -> Column:
    """Sixteen bytes over agent, address, origin and salt."""
    return F.substring(F.sha2(F.concat_ws(":", ua, ip, origin, F.lit(salt)), 256), 1, 32)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once per row. They pass through a generator, since a filter on later columns would
    else be written out in terms of the first ones and parse a body once for every mention of its fields."""
    kept = [f"`{c}`" for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def track_events(raw: DataFrame, salt: str = "", rates: dict[str, float] = DEFAULT_RATES) -> DataFrame:
    """Request bodies as canonical events plus ``status``.

    ``accepted`` rows are events, ``crawler_accepted`` ones were sent by crawlers, all other rows name what is missing or, as
    ``refusal`` of :func:`explode_batches`, why the body was refused. Nothing is dropped here, so callers can route refused rows elsewhere. Location, referrer and bot marks are separate joins.
    """
    for name in (*HEADERS, "refusal"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("timestamp_ntz" if name == "received_at" else "string"))
    rows = split_envelopes(raw).where(F.col("envelope") != "replay")
    rows = _once(rows.withColumnRenamed("user_agent", "_header_ua"), r=F.from_json("body", _struct(TRACK)))
    rows = _once(rows, u=F.from_json("r.user_data", _struct(USER)), ec=F.from_json("r.ecommerce", "items string, value string, currency string, transaction_id string"))
    rows = rows.withColumn("p", flatten_properties(F.col("r.properties")))
    r, u, p, ec = (lambda n: F.col(f"r.{n}")), (lambda n: F.col(f"u.{n}")), (lambda n: F.col("p")[n]), (lambda n: F.col(f"ec.{n}"))

    # Values used more than once become columns of their own, so that they are computed once per row.
    profile = first_filled(r("profileId"), r("profile_id"))
    envelope = F.when(~F.col("envelope").isin("", "track"), F.col("envelope"))
    named = F.coalesce(first_filled(r("name"), r("event")), envelope, F.when(profile.isNotNull(), F.lit("identify")), F.lit(""))
    identify = F.col("name") == "identify"
    shop_text = first_filled(r("shop_id"), r("client_id"), F.col("header_shop_id"), F.col("query_shop_id"))
    tenant_text = first_filled(r("tenant_id"), F.col("header_tenant_id"), F.col("query_tenant_id"))
    rows = _once(rows, name=named, shop_id=uuid_or_null(shop_text), tenant_id=uuid_or_null(tenant_text), ip=client_ip(r("ip"), u("client_ip_address")),
                 ua=F.coalesce(first_filled(r("user_agent"), u("client_user_agent")), F.col("_header_ua"), F.lit("")))
    rows = with_agent(rows, "ua")
    items_text = F.coalesce(F.when(r("items").startswith("[{"), r("items")), ec("items"))
    rows = rows.withColumn("items", F.from_json(items_text, ITEM_DDL))
    value = F.coalesce(r("value").try_cast("double"), ec("value").try_cast("double"))
    stated = F.coalesce(flexible_int(r("revenue")), F.when(r("revenue").isNotNull(), F.lit(0)))
    cents = lambda x, k=1.0: F.round(x.try_cast("double") * k).cast("bigint")
    # Only the first source that is present counts, even when it does not parse.
    revenue = (F.when(stated.isNotNull(), stated).when(p("__revenue") != "", cents(p("__revenue"))).when(p("revenue") != "", cents(p("revenue")))
               .when(value.isNotNull(), cents(value, 100.0)).when(p("value") != "", cents(p("value"), 100.0)))
    rows = rows.withColumn("revenue", revenue).withColumn("currency", F.coalesce(first_filled(r("currency"), ec("currency")), F.lit("")))
    rows = rows.withColumn("transaction", first_filled(r("transaction_id"), ec("transaction_id"))).withColumn("order", first_filled(r("order_id"), F.col("transaction")))
    rows = rows.withColumn("event_id", first_filled(r("event_id"), r("eventId"), p("event_id"), p("eventId")))
    rows = rows.withColumn("created_at", flexible_timestamp(r("timestamp"), F.col("received_at")))
    rows = rows.withColumn("device_id", F.coalesce(filled(r("device_id")), device_fingerprint(salt, F.col("shop_id"), F.col("ip"), F.col("ua"))))

    sent = {"email": "email", "first_name": "firstName", "last_name": "lastName"}
    user = [F.coalesce(filled(u(n)), F.when(identify, filled(r(sent[n])))).alias(n) if n in sent else filled(u(n)).alias(n) for n in USER]
    rows = rows.withColumn("user", F.when(r("user_data").isNotNull() | identify, F.struct(*user)))
    some = F.size("items") > 0
    extra = {
        "profileId": F.when(identify, filled(r("profileId"))), "email": F.when(identify, filled(r("email"))), "firstName": F.when(identify, filled(r("firstName"))),
        "lastName": F.when(identify, filled(r("lastName"))), "client_ip": filled(F.col("ip")), "client_ua": filled(F.col("ua")),
        "items": F.when(some, F.to_json("items")), "items_count": F.when(some, F.size("items").cast("string")),
        "item_id": filled(F.get("items", F.lit(0))["item_id"]), "item_name": filled(F.get("items", F.lit(0))["item_name"]), "event_id": F.col("event_id"),
        "fbp": filled(u("fbp")), "fbc": filled(u("fbc")), "email_provided": F.when(F.col("user.email").isNotNull(), F.lit("1")),
        "phone_provided": F.when(F.col("user.phone").isNotNull(), F.lit("1")), "_user_data": F.to_json("user"), "transaction_id": F.coalesce("transaction", "order"),
    }
    rows = rows.withColumn("added", F.map_from_arrays(F.array(*[F.lit(k) for k in extra]), F.array(*extra.values())))
    # Server values replace sent ones; what the server does not know stays as sent.
    rows = rows.withColumn("kept", F.map_filter("p", lambda k, v: F.col("added")[k].isNull())).withColumn("known", F.map_filter("added", lambda k, v: v.isNotNull()))

    country = F.coalesce(*[F.when(F.length(c) == 2, F.upper(c)) for c in (F.col("cf_ipcountry"), F.col("x_country_code"), F.col("x_country"), p("country"), p("$country"), p("__country"))], F.lit(""))
    city = F.coalesce(first_filled(p("city"), p("$city"), p("__city")), F.lit(""))
    tenant = F.col("tenant_id")
    status = (F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("name") == "", F.lit("missing_name")).when(F.col("shop_id").isNull(), F.lit("invalid_shop_id"))
              .when(tenant.isNull() | (tenant == NIL_UUID), F.lit("invalid_tenant_id")).when(is_crawler(F.col("ua")), F.lit("crawler_accepted")).otherwise(F.lit("accepted")))
    key = F.sha2(F.concat_ws(":", "shop_id", "device_id", "name", F.col("created_at").cast("string"), F.coalesce("event_id", F.lit("")), "body"), 256)
    return rows.select(
        status.alias("status"), F.coalesce(uuid_or_null(F.col("event_id")), key).alias("id"), "tenant_id", "shop_id", "name", "device_id",
        uuid_or_null(r("session_id")).alias("session_id"), uuid_or_null(first_filled(r("customer_id"), profile)).alias("customer_id"), "revenue",
        to_usd(F.col("revenue"), F.col("currency"), rates).alias("revenue_usd"), "currency", uuid_or_null(r("product_id")).alias("product_id"), uuid_or_null(r("cart_id")).alias("cart_id"),
        uuid_or_null(F.col("order")).alias("order_id"), F.coalesce(first_filled(r("path"), p("__path"), p("path")), F.lit("")).alias("path"), F.coalesce("origin", F.lit("")).alias("origin"),
        F.coalesce(first_filled(r("referrer"), p("__referrer"), p("referrer")), F.lit("")).alias("referrer"), "agent.os", "agent.browser", "agent.device", country.alias("country"),
        city.alias("city"), "ip", F.col("ua").alias("user_agent"), F.map_concat("kept", "known").alias("properties"), "created_at")


def geo_fallback(ev: DataFrame, country: str = "", city: str = "") -> DataFrame:
    """Looked-up location first, then what the request said, then a default for local addresses."""
    near = is_local(F.col("ip"))
    for name, default in (("country", country), ("city", city)):
        found = filled(F.col(f"geo_{name}")) if f"geo_{name}" in ev.columns else F.lit(None).cast("string")
        ev = ev.withColumn(name, F.coalesce(found, filled(F.col(name)), F.when(near & F.lit(default != ""), F.lit(default)), F.lit("")))
    return ev


# --- replay ----------------------------------------------------------------------------------

# Fields of a replay envelope, in both spellings.
REPLAY = (
    "shop_id", "shopId", "tenant_id", "tenantId", "session_id", "chunk_index", "chunkIndex", "events_count", "eventsCount", "is_full_snapshot",
    "isFullSnapshot", "started_at", "startedAt", "ended_at", "endedAt", "payload",
)


def replay_chunks(raw: DataFrame) -> DataFrame:
    """Replay envelopes as chunk rows with ``status``. Either spelling of a field counts and a chunk never ends before it starts."""
    for name in ("header_shop_id", "header_tenant_id", "query_tenant_id"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    rows = split_envelopes(raw).where(F.col("envelope") == "replay").withColumn("r", F.from_json("body", _struct(REPLAY)))
    r = lambda n: F.col(f"r.{n}")
    number = lambda a, b: F.coalesce(F.nullif(flexible_int(r(a)), F.lit(0)), flexible_int(r(b)), F.lit(0))
    session, shop = uuid_or_null(r("session_id")), uuid_or_null(first_filled(r("shop_id"), r("shopId"), F.col("header_shop_id")))
    tenant = uuid_or_null(first_filled(r("tenant_id"), r("tenantId"), F.col("header_tenant_id"), F.col("query_tenant_id")))
    start = flexible_timestamp(F.coalesce(r("started_at"), r("startedAt")), F.col("received_at"))
    end = flexible_timestamp(F.coalesce(r("ended_at"), r("endedAt")), F.col("received_at"))
    status = (F.when(session.isNull(), F.lit("invalid_session_id")).when(shop.isNull(), F.lit("invalid_shop_id"))
              .when(tenant.isNull() | (tenant == NIL_UUID), F.lit("invalid_tenant_id")).otherwise(F.lit("accepted")))
    snapshot = (r("is_full_snapshot") == "true") | F.coalesce(r("isFullSnapshot") == "true", F.lit(False))
    return rows.select(status.alias("status"), tenant.alias("tenant_id"), shop.alias("shop_id"), session.alias("session_id"), number("chunk_index", "chunkIndex").alias("chunk_index"),
                       start.alias("started_at"), F.greatest(start, end).alias("ended_at"), number("events_count", "eventsCount").alias("events_count"),
                       F.coalesce(snapshot, F.lit(False)).alias("is_full_snapshot"), r("payload").alias("payload"))


# --- duplicates ------------------------------------------------------------------------------

def suppress_rapid(ev: DataFrame, milliseconds: int = 100, keys: Sequence[str] = (*SHOP, "device_id", "name", "path")) -> DataFrame:
    """Drop events that repeat a kept one of the same key within the interval, which runs from the *kept* event.

    Events are chained into islands without a gap of the interval, from per-chunk extremes. Short islands keep their first event.
    In longer ones each instant points to the first one an interval later, found inside overlapping tiles, and the kept instants are those reached
    from the island's start; reach doubles each round, so the rounds grow with the logarithm of the longest island. No group of a key is ever collected.
    """
    from tidemark.functions.lineage import cut

    keys, width = list(keys), milliseconds * 1000
    rows = ev.withColumn("_at", micros(F.col("created_at"))).withColumn("_chunk", chunk_of(F.col("created_at"), milliseconds / 1000))
    # All that follows is about instants, so events are read once for them and once for the result.
    instants = cut(rows.groupBy(*keys, "_chunk", "_at").agg(F.min("id").alias("id")))
    spans = instants.groupBy(*keys, "_chunk").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    spans = number_spans(spans, milliseconds / 1000, keys, closed=False)
    ends = spans.groupBy(*keys, "_start").agg(F.max("_hi").alias("_end"))
    long = spans.join(ends.where(F.col("_end") - F.col("_start") >= width), [*keys, "_start"]).select(*keys, "_chunk", "_start")
    reached = ends.select(*keys, F.col("_start").alias("_at"))
    points = instants.drop("id").join(long, [*keys, "_chunk"])
    # In a tile stand the instants of two chunks and what those of the chunk before ask for: the first instant from _place on. Read
    # backwards, that is the smallest instant so far, so each row is looked at once, however many a tile holds.
    asks = F.struct((F.col("_chunk") + 1).alias("tile"), (F.col("_at") + width).alias("place"), F.col("_at").alias("asks"))
    stands = [F.struct((F.col("_chunk") - back).alias("tile"), F.col("_at").alias("place"), F.lit(None).cast("bigint").alias("asks")) for back in (0, 1)]
    tiles = points.select(*keys, "_start", F.explode(F.array(asks, *stands)).alias("_t")).select(*keys, "_start", "_t.*")
    back = Window.partitionBy(*keys, "tile", "_start").orderBy(F.desc("place"), F.asc_nulls_first("asks")).rowsBetween(Window.unboundedPreceding, 0)
    found = tiles.withColumn("_next", F.min(F.when(F.col("asks").isNull(), F.col("place"))).over(back))
    jumps = found.where(F.col("asks").isNotNull() & F.col("_next").isNotNull()).select(*keys, F.col("asks").alias("_at"), "_next")
    jumps, reached = cut(jumps), cut(reached)
    while not jumps.isEmpty():
        found = reached.join(jumps, [*keys, "_at"]).select(*keys, F.col("_next").alias("_at"))
        reached = cut(reached.unionByName(found).distinct())
        hop = jumps.select(*keys, F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        jumps = cut(jumps.join(hop, [*keys, "_next"]).select(*keys, "_at", F.col("_far").alias("_next")))
    kept = instants.join(reached, [*keys, "_at"], "left_semi").select(*keys, "_at", "id")
    return rows.join(kept, [*keys, "_at", "id"], "left_semi").select(*ev.columns)


def drop_repeated_ids(ev: DataFrame) -> DataFrame:
    """First of the events that share an id within a shop, for at-least-once delivery; of equal instants the one whose row hashes lowest."""
    from tidemark.operators.traffic import top_k

    return top_k(ev, [*SHOP, "id"], [F.col("created_at"), row_hash(ev)], 1)
