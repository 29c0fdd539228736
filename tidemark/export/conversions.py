"""Conversion payloads for an advertising platform: names, hashed user data and order contents. Only the payload is built; nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.enrich.payload import ITEM_DDL, USER, filled
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP, with_default

# Platform event name → our names for it.
STANDARD = {
    "PageView": ("page_view", "pageview", "$pageview"), "ViewContent": ("view_item", "view_product", "viewcontent", "product_view", "view_item_list"),
    "AddToCart": ("add_to_cart", "addtocart", "cart_add"), "InitiateCheckout": ("begin_checkout", "checkout_step", "initiatecheckout", "checkout_started"),
    "AddPaymentInfo": ("add_payment_info", "addpaymentinfo"), "Purchase": ("purchase", "order_completed", "purchase_completed"), "Search": ("search",),
    "AddToWishlist": ("add_to_wishlist", "addtowishlist"), "CompleteRegistration": ("sign_up", "signup", "login", "completeregistration"),
    "Lead": ("lead",), "Contact": ("contact",), "Donate": ("donate",), "Schedule": ("schedule",), "Subscribe": ("subscribe",),
}
# Names that are passed on as they are.
VERBATIM = ("customize_product", "find_location", "start_trial", "submit_application")

# Settings of up to so many shops are sent to every executor.
FEW_SHOPS = 10_000


def platform_name(name: Column) -> Column:
    """Standard name; other names pass through if they start with a capital, else null."""
    key = F.lower(F.trim(name))
    pairs = [x for standard, ours in STANDARD.items() for ours_name in ours for x in (F.lit(ours_name), F.lit(standard))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.when(key.isin(*VERBATIM) | name.rlike("^[A-Z]"), name))


def source_url(origin: Column, path: Column) -> Column:
    """Origin and path with exactly one slash between them."""
    o, p = F.coalesce(origin, F.lit("")), F.coalesce(path, F.lit(""))
    joined = (F.when(o.endswith("/") & p.startswith("/"), F.concat(o, F.substr(p, F.lit(2))))
              .when(~o.endswith("/") & ~p.startswith("/"), F.concat(o, F.lit("/"), p)).otherwise(F.concat(o, p)))
    return F.when((o != "") & (p != ""), joined).when(o != "", o).otherwise(p)


# --- hashing ---------------------------------------------------------------------------------

def hashed(text: Column) -> Column:
    """SHA-256 of the trimmed text, '' for blank."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.when(clean == "", F.lit("")).otherwise(F.sha2(clean, 256))


def hash_email(col: Column) -> Column:
    return hashed(F.lower(F.trim(col)))


def hash_phone(col: Column) -> Column:
    """Digits only, without leading zeros."""
    return hashed(F.regexp_replace(F.regexp_replace(col, r"[^0-9]", ""), r"^0+", ""))


def hash_alpha(col: Column) -> Column:
    """Letters and digits in lower case."""
    return hashed(F.regexp_replace(F.lower(F.trim(col)), r"[^\p{L}\p{Nd}]", ""))


def hash_country(col: Column) -> Column:
    return hashed(F.substring(F.lower(F.trim(col)), 1, 2))


def hash_zip(col: Column) -> Column:
    return hashed(F.regexp_replace(F.lower(F.trim(col)), r"[ -]", ""))


# --- payload ---------------------------------------------------------------------------------

def user_data(u: Column) -> Column:
    """Hashed identity from the sender's user data ``u``, with fallbacks to the event's own fields. A missing address or agent stays null."""
    p = F.col("properties")
    country = F.coalesce(filled(hash_country(u["country_code"])), filled(hash_country(F.col("country"))))
    city = F.coalesce(filled(hash_alpha(u["city"])), filled(hash_alpha(F.col("city"))))
    external = F.coalesce(filled(hashed(u["external_id"])), filled(hashed(F.col("customer_id").cast("string"))), filled(hashed(F.col("device_id"))))
    return F.struct(
        filled(hash_email(u["email"])).alias("em"), filled(hash_phone(u["phone"])).alias("ph"), filled(hash_alpha(u["first_name"])).alias("fn"), filled(hash_alpha(u["last_name"])).alias("ln"),
        city.alias("ct"), filled(hash_alpha(u["state"])).alias("st"), filled(hash_zip(u["zip_code"])).alias("zp"), country.alias("country"), external.alias("external_id"),
        F.coalesce(filled(u["client_ip_address"]), filled(p["client_ip"]), filled(p["ip"])).alias("client_ip_address"),
        F.coalesce(filled(u["client_user_agent"]), filled(p["client_ua"]), filled(p["user_agent"])).alias("client_user_agent"),
        F.coalesce(filled(u["fbp"]), filled(p["fbp"])).alias("fbp"), F.coalesce(filled(u["fbc"]), filled(p["fbc"])).alias("fbc"))


def order_contents(items: Column) -> Column:
    """Items in the platform's form: at least one piece each, priced in units of the currency."""
    price = lambda i: F.coalesce(i["price"], i["price_cents"] / 100.0, F.lit(0.0))
    quantity = lambda i: F.when(i["quantity"] > 0, i["quantity"]).otherwise(F.lit(1)).cast("bigint")
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(items, lambda i: F.struct(
        text(i["item_id"]).alias("id"), quantity(i).alias("quantity"), price(i).alias("item_price"), text(i["item_name"]).alias("title"),
        F.coalesce(filled(i["category"]), text(i["item_category"])).alias("category"), text(i["item_brand"]).alias("brand")))


def custom_data(contents: Column) -> Column:
    """Value, currency, order and contents. Without items the event's product stands for one piece at the event's value."""
    p = F.col("properties")
    value = F.coalesce(F.col("revenue") / 100.0, F.lit(0.0))
    ids = F.filter(F.transform(contents, lambda c: c["id"]), lambda x: x != "")
    product = F.col("product_id").cast("string")
    single = F.array(F.struct(product.alias("id"), F.lit(1).cast("bigint").alias("quantity"), value.alias("item_price"), F.lit("").alias("title"), F.lit("").alias("category"), F.lit("").alias("brand")))
    lone = (F.coalesce(F.size(ids), F.lit(0)) <= 0) & product.isNotNull()
    order = F.coalesce(F.col("order_id").cast("string"), filled(p["transaction_id"]))
    return F.struct(
        F.lit("product").alias("content_type"), F.coalesce(filled(F.upper("currency")), F.lit("USD")).alias("currency"), value.alias("value"), order.alias("order_id"),
        F.when(lone, single).otherwise(contents).alias("contents"), F.when(lone, F.array(product)).otherwise(ids).alias("content_ids"),
        F.coalesce(F.aggregate(contents, F.lit(0).cast("bigint"), lambda a, c: a + c["quantity"]), F.lit(0)).alias("num_items"))


def payloads(ev: DataFrame, integrations: DataFrame | None = None) -> DataFrame:
    """One payload per convertible event of the shops that switched the platform on.

    ``integrations``: tenant, shop, enabled, credentials (JSON with pixel_id and access_token), events_whitelist. An empty whitelist allows
    every event. Events delivered twice appear once: they share the id their sender or their row gave them.
    """
    rows = with_default(ev, "order_id", F.lit(None).cast("string")).withColumn("event_name", platform_name(F.col("name")))
    rows = rows.withColumn("event_id", F.coalesce(filled(F.col("properties")["event_id"]), F.col("id").cast("string"))).where(F.col("event_name").isNotNull())
    # Shops and repeats are sorted out first; only what is left is parsed and hashed.
    rows = _enabled(rows, integrations) if integrations is not None else rows
    # Dealt by the whole key: rows that a join has dealt by shop would stay so, and a shop would be one task.
    rows = top_k(rows.repartition(*SHOP, "event_id"), [*SHOP, "event_id"], [F.col("created_at"), F.col("id")], 1)
    rows = rows.withColumn("_u", F.from_json(F.col("properties")["_user_data"], ", ".join(f"{n} string" for n in USER)))
    rows = rows.withColumn("_c", order_contents(F.from_json(F.col("properties")["items"], ITEM_DDL)))
    return rows.select(*SHOP, "event_name", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("event_time"), "event_id", source_url(F.col("origin"), F.col("path")).alias("event_source_url"),
                       F.lit("website").alias("action_source"), user_data(F.col("_u")).alias("user_data"), custom_data(F.col("_c")).alias("custom_data"))


def _enabled(rows: DataFrame, integrations: DataFrame) -> DataFrame:
    """Events of shops with a complete, enabled integration whose whitelist, if any, names the event."""
    keys = F.from_json("credentials", "pixel_id string, access_token string")
    live = integrations.where(F.col("enabled") & (keys["pixel_id"] != "") & (keys["access_token"] != "")).select(*SHOP, F.transform("events_whitelist", F.lower).alias("_allowed"))
    allowed = (F.coalesce(F.size("_allowed"), F.lit(0)) <= 0) | F.array_contains("_allowed", F.lower("event_name"))
    # Few shops leave the events where they are; only many, which spread, are worth a shuffle.
    few = live.limit(FEW_SHOPS + 1).count() <= FEW_SHOPS
    return rows.join(F.broadcast(live) if few else live, SHOP).where(allowed).drop("_allowed")


def as_json(payload: DataFrame) -> DataFrame:
    """Payload rows as JSON text per shop."""
    fields = [c for c in payload.columns if c not in SHOP]
    return payload.select(*SHOP, "event_id", F.to_json(F.struct(*fields)).alias("payload"))
