"""Rolling shopper features: the state kept per shop and device, which lapses after 45 idle minutes and whose cart empties on an order.

Chunks of the lapse time bound every group, as for sessions: events are reduced to one row per device and chunk, with
the cart as it stands after the chunk's last order. States are then folded from chunks: a state's cart adds up the
chunks from the one with its last order onwards.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import round_to
from tidemark.functions.predicates import cart_add, order_event, rollup_view
from tidemark.functions.timeutil import from_micros, micros, ts, whole_seconds
from tidemark.operators.sessions import chunk_of, number_spans
from tidemark.schema import DEVICE, with_default
from tidemark.sources.tables import latest_by_key

TTL_SECONDS = 45 * 60
_KEY = [*DEVICE, "state_start"]
# Attributes remembered from the last event that carries them.
_LAST = ["session_id", "customer_id", "currency", "country", "city", "path", "device", "browser", "os"]


def _last(column: str) -> Column:
    keep = F.col(column).isNotNull() & (F.col(column).cast("string") != "")
    return F.max(F.when(keep, F.struct(F.col("created_at"), F.col("id"), F.col(column).alias("v")))).alias(f"_{column}")


def _chunks(ev: DataFrame, ttl: int) -> DataFrame:
    """Partials per device and chunk."""
    order = F.struct("created_at", "id")
    rows = with_default(ev, "cart_id", F.lit(None).cast("string")).select(
        *DEVICE, "id", "created_at", "name", "revenue", "revenue_usd", "cart_id", *_LAST, chunk_of(F.col("created_at"), ttl).alias("_chunk"))
    # The last order is a maximum per chunk, combined before the shuffle; no window holds a chunk's events.
    ordered = rows.where(order_event()).groupBy(*DEVICE, "_chunk").agg(F.max(order).alias("_ordered"))
    rows = rows.join(ordered, [*DEVICE, "_chunk"], "left")
    held = F.col("_ordered").isNull() | (order > F.col("_ordered"))
    add = cart_add() & held
    at = micros(F.col("created_at"))
    return rows.groupBy(*DEVICE, "_chunk").agg(
        F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count_if(rollup_view()).alias("views"), F.max(F.col("_ordered").isNotNull()).alias("_bought"),
        F.count_if(add).alias("carts"), F.sum(F.when(add, F.col("revenue_usd"))).alias("cart_value_usd"), F.sum(F.when(add, F.col("revenue"))).alias("cart_value"),
        F.max(F.when(held & F.col("cart_id").isNotNull(), F.struct("created_at", "id", "cart_id"))).alias("_cart"),
        F.max(F.struct("created_at", "id", "name")).alias("_name"), *[_last(c) for c in _LAST])


def _product_sets(ev: DataFrame, spans: DataFrame, ttl: int) -> DataFrame:
    """Newest product set per state. The set lapses after the same idle time, counted between product views only; it lies inside one
    state because a longer gap ends the state too."""
    seen = ev.where(rollup_view() & F.col("product_id").isNotNull()).select(*DEVICE, "created_at", "product_id", chunk_of(F.col("created_at"), ttl).alias("_chunk"))
    at = micros(F.col("created_at"))
    sets = seen.groupBy(*DEVICE, "_chunk", "product_id").agg(F.max("created_at").alias("viewed"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    own = number_spans(sets.groupBy(*DEVICE, "_chunk").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")), ttl)
    sets = sets.drop("_lo", "_hi").join(own.select(*DEVICE, "_chunk", F.col("_start").alias("_set")), [*DEVICE, "_chunk"]).join(spans, [*DEVICE, "_chunk"])
    counted = sets.groupBy(*DEVICE, "_start", "_set").agg(F.count_distinct("product_id").alias("products"), F.max("viewed").alias("viewed"))
    return counted.groupBy(*DEVICE, "_start").agg(F.max(F.struct("_set", "products", "viewed")).alias("_s"))


def features(ev: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Final features of every state. An empty product set counts as one product."""
    chunks = number_spans(_chunks(ev, ttl), ttl)
    bought = F.max(F.when(F.col("_bought"), F.col("_chunk"))).over(Window.partitionBy(*DEVICE, "_start"))
    chunks = chunks.withColumn("_from", bought)
    kept = F.col("_from").isNull() | (F.col("_chunk") >= F.col("_from"))
    out = chunks.groupBy(*DEVICE, "_start").agg(
        F.max("_hi").alias("_hi"), F.sum("views").alias("views"), F.sum(F.when(kept, F.col("carts"))).alias("carts"),
        F.sum(F.when(kept, F.col("cart_value_usd"))).alias("cart_value_usd"), F.sum(F.when(kept, F.col("cart_value"))).alias("cart_value"),
        F.max(F.when(kept, F.col("_cart")))["cart_id"].alias("cart_id"), F.max("_name")["name"].alias("_name"), *[F.max(f"_{c}").alias(f"_{c}") for c in _LAST])
    out = out.join(_product_sets(ev, chunks.select(*DEVICE, "_chunk", "_start"), ttl), [*DEVICE, "_start"], "left")
    first, last = from_micros(F.col("_start")), from_micros(F.col("_hi"))
    alive = F.col("_hi") - micros(F.col("_s.viewed")) <= ttl * 1_000_000
    return out.select(
        *DEVICE, first.alias("state_start"), first.alias("first_seen"), last.alias("last_seen"), whole_seconds(first, last).alias("dwell_seconds"), "views",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("carts", "cart_value_usd", "cart_value")], "cart_id",
        F.when(alive, F.col("_s.products")).otherwise(F.lit(1)).cast("bigint").alias("distinct_products"), (F.col("_name") == "purchase").alias("has_purchase"),
        *[F.col(f"_{c}.v").alias("cart_currency" if c == "currency" else c) for c in _LAST])


def latest_features(feats: DataFrame) -> DataFrame:
    """Newest state per device."""
    return latest_by_key(feats, DEVICE, "last_seen")


def live_features(feats: DataFrame, as_of: datetime, ttl: int = TTL_SECONDS) -> DataFrame:
    """States that have not lapsed at ``as_of``."""
    return latest_features(feats.where(F.col("last_seen").between(ts(as_of - timedelta(seconds=ttl)), ts(as_of))))


def stored_features(feats: DataFrame) -> DataFrame:
    """Rows of the feature table: counters, order flag and intent score per device and session."""
    from tidemark.operators.scoring import stream_scores

    scored = stream_scores(feats)
    return scored.select(*DEVICE, "session_id", F.col("views").alias("views_count"), F.col("carts").alias("cart_adds_count"), "distinct_products",
                         F.col("dwell_seconds").alias("total_dwell_seconds"), F.col("has_purchase").cast("int").alias("has_purchase"),
                         F.col("intent").alias("cart_intent_score"), F.col("last_seen").alias("last_event_at"))


def training_rows(stored: DataFrame) -> DataFrame:
    """Journey rows with labels from stored features. What the table lacks is filled with the constants training assumes."""
    bought, carted = F.col("has_purchase") == 1, F.col("cart_adds_count") > 0
    flag = lambda c: F.when(c, 1).otherwise(0)
    return stored.select(
        *DEVICE, F.when(bought, F.lit("decisive_buyer")).when(carted, F.lit("cart_abandoner")).otherwise(F.lit("casual_explorer")).alias("archetype"),
        "views_count", "cart_adds_count", F.lit(0).alias("cart_removes_count"), flag(carted | bought).alias("checkout_starts_count"), "distinct_products",
        F.lit(1).alias("distinct_categories"), "total_dwell_seconds", F.when(bought, F.lit(0.75)).otherwise(F.lit(0.45)).alias("avg_scroll_depth"),
        (F.col("views_count") * 3).alias("clicks_count"), F.lit(0).alias("sale_item_views"), F.when(carted, F.lit(45.0)).otherwise(F.lit(0.0)).alias("cart_velocity_seconds"),
        F.lit("desktop").alias("device_type"), F.lit("organic_search").alias("traffic_channel"), "has_purchase", flag(carted & ~bought).alias("has_cart_abandoned"),
        flag((F.col("views_count") <= 2) & ~carted).alias("has_churned"), F.lit(0).alias("is_price_sensitive"))


def feature_matrix(journeys: DataFrame) -> DataFrame:
    """Fifteen model features per journey row."""
    views, dwell = F.greatest(F.lit(1), F.col("views_count")), F.greatest(F.lit(1), F.col("total_dwell_seconds"))
    plain = [F.col(c).cast("double").alias(c) for c in ("views_count", "cart_adds_count", "distinct_products", "distinct_categories", "total_dwell_seconds",
                                                       "avg_scroll_depth", "cart_velocity_seconds")]
    keys = [c for c in (*DEVICE, "has_purchase", "has_churned", "is_price_sensitive") if c in journeys.columns]
    return journeys.select(
        *keys, *plain, F.greatest(F.lit(0), F.col("cart_adds_count") - F.col("cart_removes_count")).cast("double").alias("cart_net"),
        round_to(F.col("total_dwell_seconds") / views, 2).alias("dwell_per_view"), round_to(F.col("cart_adds_count") / views, 4).alias("cart_conversion_ratio"),
        round_to(F.col("distinct_products") / views, 4).alias("catalog_scatter_ratio"),
        round_to(F.lit(1.0) / F.greatest(F.lit(1), F.col("distinct_categories")), 4).alias("category_focus_index"),
        round_to(F.col("clicks_count") / dwell * 60, 2).alias("clicks_per_minute"), round_to(F.col("sale_item_views") / views, 4).alias("sale_view_ratio"),
        (F.col("device_type") == "mobile").cast("double").alias("is_mobile"))
