"""Event and session lists: pages, cursors, details, replay."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.currency import convert, from_usd
from tidemark.functions.predicates import cart_like, conversion, or_default, profile_id, purchase_like, search
from tidemark.functions.timeutil import seconds_between, ts
from tidemark.operators.profiles import SANE, earliest, page
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP

SESSION = [*SHOP, "session_id"]


def newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def events_page(ev: DataFrame, name: str = "", text: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest events per shop with the total that match. The text search is case-sensitive."""
    rows = ev.where(F.col("name") == name) if name else ev
    rows = rows.where(search(text, ["path", "device_id", "city"], ignore_case=False)) if text else rows
    total = rows.groupBy(*SHOP).agg(F.count(F.lit(1)).alias("total"))
    out = page(rows, newest(), limit, max(offset, 0)).join(total, SHOP)
    return out.withColumn("revenue", F.when(F.col("revenue") > 0, F.col("revenue")))


def events_cursor(ev: DataFrame, names: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None,
                  cursor: tuple[str, int] | None = None, size: int = 50, currency: str = "USD") -> DataFrame:
    """The next ``size`` events per shop after a cursor of (instant, id), and whether there are more. Revenue is converted row by row
    from the event's own currency; '' paths read '/'."""
    rows = ev.where(F.col("name").isin(*names)) if names else ev
    rows = rows.where(F.col("created_at") >= ts(start)) if start else rows
    rows = rows.where(F.col("created_at") <= ts(end)) if end else rows
    if cursor:
        at = ts(cursor[0])
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < cursor[1])))
    best = top_k(rows, SHOP, newest(), size + 1)
    n = best.groupBy(*SHOP).agg((F.count(F.lit(1)) > size).alias("has_more"))
    out = top_k(best, SHOP, newest(), size).join(n, SHOP)
    revenue = F.coalesce(F.col("revenue"), F.lit(0))
    return (out.withColumn("revenue", F.when(revenue > 0, convert(revenue, F.col("currency"), F.lit(currency))).otherwise(F.lit(0)).cast("bigint"))
            .withColumn("currency", F.lit(currency)).withColumn("path", or_default("path", "/")).withColumn("profile_id", profile_id()))


def conversions_cursor(ev: DataFrame, **kw) -> DataFrame:
    """As :func:`events_cursor` for events that convert."""
    return events_cursor(ev.where(conversion()), **kw)


def event_details(ev: DataFrame, se: DataFrame, currency: str = "USD") -> DataFrame:
    """Events with the extent of their session."""
    extent = se.select(*SESSION, F.col("duration").alias("session_duration"), F.col("started_at").alias("session_started_at"),
                       F.col("ended_at").alias("session_ended_at"), F.col("entry_path").alias("session_entry_path"), F.col("exit_path").alias("session_exit_path"))
    cents = F.coalesce(F.col("revenue"), F.lit(0))
    shown = F.when(cents > 0, convert(cents, F.col("currency"), F.lit(currency))).otherwise(F.lit(0)).cast("bigint")
    return ev.withColumn("revenue", shown).withColumn("profile_id", profile_id()).join(extent, SESSION, "left")


_DIMS = ["device_id", "referrer", "referrer_name", "referrer_type", "country", "city", "os", "browser", "device"]


def session_summary(ev: DataFrame, all_revenue: bool = False, currency: str = "USD") -> DataFrame:
    """Sessions folded from their events. Revenue counts purchase-like events, or every event in the detail view."""
    at, sane = F.col("created_at"), F.col("created_at") > ts(SANE)
    usd = F.col("revenue_usd") if all_revenue else F.when(purchase_like(), F.col("revenue_usd"))
    onpath = F.struct("created_at", "id", "path")
    out = ev.where(F.col("session_id").isNotNull()).groupBy(*SESSION).agg(
        F.min(F.when(sane, at)).alias("started_at"), F.max(at).alias("ended_at"), earliest(_DIMS).alias("_f"),
        F.min(F.when(F.col("customer_id").isNotNull(), F.struct("created_at", "id", "customer_id"))).alias("_c"),
        F.min(F.when(sane & (F.col("path") != ""), onpath)).alias("_in"), F.max(F.when(F.col("path") != "", onpath)).alias("_out"),
        F.count(F.lit(1)).alias("events_count"), F.count_if(F.col("name") == "screen_view").alias("screen_views_count"),
        F.max(cart_like()).alias("has_cart_add"), F.max(purchase_like()).alias("has_purchase"),
        from_usd(F.coalesce(F.sum(usd), F.lit(0)), currency).alias("total_revenue"))
    duration = F.greatest(F.lit(0), seconds_between(F.col("started_at"), F.col("ended_at")))
    return out.select(*SESSION, *[F.col(f"_f.{d}").alias(d) for d in _DIMS], F.col("_c.customer_id").alias("customer_id"), "started_at", "ended_at",
                      duration.alias("duration"), F.coalesce("_in.path", F.lit("")).alias("entry_path"), F.coalesce("_out.path", F.lit("")).alias("exit_path"),
                      "events_count", "screen_views_count", "has_cart_add", "has_purchase", "total_revenue")


def present(summary: DataFrame) -> DataFrame:
    """Display defaults: '/' for a missing entry, the entry for a missing exit, the referrer chain ending in Direct, durations in ms."""
    entry = F.when(F.col("entry_path") != "", F.col("entry_path")).otherwise(F.lit("/"))
    exit_ = F.when(F.col("exit_path") != "", F.col("exit_path")).otherwise(entry)
    via = F.coalesce(F.when(F.col("referrer_name") != "", F.col("referrer_name")), F.when(F.col("referrer") != "", F.col("referrer")), F.lit("Direct"))
    return (summary.withColumn("exit_path", exit_).withColumn("entry_path", entry).withColumn("referrer_name", via)
            .withColumn("is_bounce", F.col("events_count") <= 1).withColumn("duration", F.col("duration") * 1000))


def sessions_page(ev: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Latest ended sessions per shop with the total."""
    found = session_summary(ev)
    total = found.groupBy(*SHOP).agg(F.count(F.lit(1)).alias("total"))
    return present(page(found, [F.desc("ended_at"), F.col("session_id")], limit, max(offset, 0)).join(total, SHOP))


def with_replay(se: DataFrame, chunks: DataFrame) -> DataFrame:
    """Flag sessions that have replay chunks."""
    have = chunks.select(*SESSION).distinct().withColumn("has_replay", F.lit(True))
    return se.join(have, SESSION, "left").withColumn("has_replay", F.coalesce("has_replay", F.lit(False)))


def session_events(ev: DataFrame, limit: int = 100) -> DataFrame:
    """The first events of every session, in order."""
    return top_k(ev, SESSION, [F.col("created_at"), F.col("id")], limit)


def session_values(se: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values of a session column."""
    return se.where(F.col(column) != "").select(*SHOP, F.col(column).alias("value")).distinct()


def replay_page(chunks: DataFrame, offset: int = 0, size: int = 50) -> DataFrame:
    """Readable chunks of one page per session in order of (start, index), and whether another page follows. A page spans size + 1
    stored chunks; those that are not a JSON array are skipped."""
    order = [F.col("started_at"), F.col("chunk_index")]
    stored = page(chunks, order, size + 1, offset, SESSION).withColumn("_events", F.try_parse_json("payload"))
    good = stored.where(F.col("_events").isNotNull() & F.schema_of_variant("_events").startswith("ARRAY"))
    n = good.groupBy(*SESSION).agg((F.count(F.lit(1)) > size).alias("has_more"))
    return top_k(good.drop("_events"), SESSION, order, size).join(n, SESSION)


def bot_events(ev: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest events flagged as bots."""
    return page(ev.where(F.col("properties")["__bot"] == "1"), newest(), limit, offset)


