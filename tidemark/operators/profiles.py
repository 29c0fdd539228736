"""Profile reports, for all profiles at once. "Any" value of a profile is the one on its earliest event."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.currency import from_usd
from tidemark.functions.numbers import round_to, safe_ratio
from tidemark.functions.predicates import LIFECYCLE_NAMES, VIEW_NAMES, chart_view, identified, profile_id, purchase_like
from tidemark.functions.timeutil import bucket, micros, resolve_period, ts, zero_fill
from tidemark.operators.traffic import top_k, usd
from tidemark.schema import DEVICE, SHOP

PROFILE = [*SHOP, "profile_id"]
DIMS = ["country", "city", "browser", "os", "device"]
SANE = "2000-01-01"


def earliest(columns: Sequence[str]) -> Column:
    """Struct of the columns on the first event by (instant, id); a plain minimum, so it combines before the shuffle."""
    return F.min(F.struct("created_at", "id", *columns))


def devices(ev: DataFrame, kind: str | None = None, matching: Column | None = None, currency: str = "USD") -> DataFrame:
    """Activity per device, optionally of ``identified`` or ``anonymous`` events only."""
    rows = ev if kind not in ("identified", "anonymous") else ev.where(identified() if kind == "identified" else ~identified())
    rows = rows if matching is None else rows.where(matching)
    out = rows.groupBy(*DEVICE).agg(
        F.count(F.lit(1)).alias("events_count"), F.count_distinct("session_id").alias("sessions_count"),
        from_usd(usd(), currency).alias("total_revenue"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.min(F.when(identified(), F.struct("created_at", "id", "customer_id"))).alias("_c"), earliest(DIMS).alias("_f"))
    return out.select(*DEVICE, F.col("_c.customer_id").alias("customer_id"), F.col("_c").isNotNull().alias("is_identified"), "events_count", "sessions_count",
                      "total_revenue", "first_seen", "last_seen", *[F.col(f"_f.{d}").alias(d) for d in DIMS])


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, by: list[str] = SHOP) -> DataFrame:
    """A page per shop in a total order."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where((F.col("_r") > offset) & (F.col("_r") <= offset + limit)).drop("_r")


def device_page(ev: DataFrame, kind: str | None = None, limit: int = 50, offset: int = 0, matching: Column | None = None) -> DataFrame:
    """Latest seen first; power users by revenue, then events."""
    order = [F.desc("total_revenue"), F.desc("events_count")] if kind == "power_users" else [F.desc("last_seen")]
    return page(devices(ev, kind, matching), [*order, F.col("device_id")], limit, offset)


def profiles(ev: DataFrame, external: bool | None = None, filters: Column | None = None) -> DataFrame:
    """Activity per profile id and whether it is a customer's."""
    rows = ev if filters is None else ev.where(filters)
    if external is not None:
        rows = rows.where(identified() if external else ~identified())
    out = rows.groupBy(*SHOP, profile_id().alias("profile_id"), identified().alias("is_external")).agg(
        F.count(F.lit(1)).alias("count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), earliest(DIMS).alias("_f"))
    return out.select(*PROFILE, "is_external", "count", "first_seen", "last_seen", *[F.col(f"_f.{d}").alias(d) for d in DIMS])


def profile_page(ev: DataFrame, take: int = 50, cursor: int = 0, **kw) -> DataFrame:
    """A page of profiles, latest seen first, with the total number of distinct ids."""
    found = profiles(ev, **kw)
    total = found.groupBy(*SHOP).agg(F.count_distinct("profile_id").alias("total"))
    return page(found, [F.desc("last_seen"), F.col("profile_id"), F.col("is_external")], take, cursor * take).join(total, SHOP)


def profile_detail(ev: DataFrame, profile: str) -> DataFrame:
    """One profile, matched by device or customer id, in each shop that knows it."""
    hit = (F.col("device_id") == profile) | (F.col("customer_id") == profile)
    out = ev.where(hit).groupBy(*SHOP).agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), earliest(DIMS).alias("_f"))
    return out.select(*SHOP, F.lit(profile).alias("profile_id"), "first_seen", "last_seen", *[F.col(f"_f.{d}").alias(d) for d in DIMS])


def profile_metrics(ev: DataFrame, se: DataFrame, currency: str = "USD") -> DataFrame:
    """Events, sessions, views, conversions, active days and revenue; session minutes (mean and exact interpolated 90th percentile), bounce
    rate, and the mean minutes between session starts."""
    a = ev.groupBy(*SHOP, profile_id().alias("profile_id")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("name").isin(*VIEW_NAMES)).alias("screen_views"),
        F.count_if(purchase_like()).alias("conversion_events"), F.min(F.when(F.col("created_at") > ts(SANE), F.col("created_at"))).alias("first_seen"),
        F.max("created_at").alias("last_seen"), F.count_distinct(F.to_date("created_at")).alias("unique_days_active"),
        safe_ratio(from_usd(usd(), currency), F.lit(100)).alias("revenue"))
    a = a.withColumn("avg_events_per_session", round_to(F.col("events") / F.greatest(F.lit(1), F.col("sessions")), 1))
    span = (F.max(micros(F.col("started_at"))) - F.min(micros(F.col("started_at")))) / F.lit(60e6)
    b = se.groupBy(*SHOP, profile_id().alias("profile_id")).agg(
        round_to(F.avg("duration") / 60, 1).alias("duration_avg"), round_to(F.percentile("duration", 0.9) / 60, 1).alias("duration_p90"),
        round_to(F.count_if(F.col("events_count") <= 1) * 100.0 / F.count(F.lit(1)), 1).alias("bounce_rate"),
        # Gaps between consecutive starts add up to the span of starts.
        round_to(F.coalesce(span / F.nullif(F.count(F.lit(1)) - 1, F.lit(0)), F.lit(0.0)), 1).alias("avg_time_between_sessions"))
    return a.join(b, PROFILE, "left").fillna(0.0, ["duration_avg", "duration_p90", "bounce_rate", "avg_time_between_sessions"])


def profile_activity(ev: DataFrame, days: int = 30) -> DataFrame:
    """Events per day on each profile's latest active days."""
    rows = ev.where(F.col("created_at") > ts(SANE))
    daily = rows.groupBy(*SHOP, profile_id().alias("profile_id"), bucket(F.col("created_at"), "day").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    return top_k(daily, PROFILE, [F.desc("date")], days)


def profile_top(ev: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent event names (lifecycle events excepted) or paths of each profile."""
    rows = ev.where(~F.col("name").isin(*LIFECYCLE_NAMES)) if column == "name" else ev.where(F.col(column) != "")
    counts = rows.groupBy(*SHOP, profile_id().alias("profile_id"), column).agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, PROFILE, [F.desc("count"), F.col(column)], k)


def profile_chart(ev: DataFrame, as_of: datetime, column: str, k: int = 10) -> DataFrame:
    """Daily counts by path (page views) or name over 30 days for each profile, absent days as 0."""
    period = resolve_period(as_of, "30d")
    rows = ev.where(period.current(F.col("created_at")) & (F.col(column) != ""))
    rows = rows.where(chart_view()) if column == "path" else rows
    daily = rows.groupBy(*SHOP, profile_id().alias("profile_id"), F.col(column).alias("item"), bucket(F.col("created_at"), "day").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"))
    best = top_k(daily.groupBy(*PROFILE, "item").agg(F.sum("count").alias("_n")), PROFILE, [F.desc("_n"), F.col("item")], k)
    return zero_fill(daily, best, [*PROFILE, "item"], ["count"], period, "day")


def power_users(ev: DataFrame, k: int = 50) -> DataFrame:
    out = ev.groupBy(*DEVICE).agg(F.count(F.lit(1)).alias("count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
                                  earliest(DIMS).alias("_f"))
    out = out.select(*DEVICE, "count", "first_seen", "last_seen", *[F.col(f"_f.{d}").alias(d) for d in DIMS])
    return top_k(out, SHOP, [F.desc("count"), F.col("device_id")], k)


def timeline(ev: DataFrame, limit: int = 200) -> DataFrame:
    """The first events of every shopper in order."""
    cols = [c for c in ("id", "name", "session_id", "customer_id", "currency", "product_id", "path", "referrer_name", "os", "browser", "device", "country", "city", "created_at") if c in ev.columns]
    rows = ev.select(*DEVICE, *cols, F.when(F.col("revenue") > 0, F.col("revenue")).alias("revenue"))
    return top_k(rows, DEVICE, [F.col("created_at"), F.col("id")], limit)


# --- catalogues ------------------------------------------------------------------------------

def property_entries(ev: DataFrame) -> DataFrame:
    return ev.select(*SHOP, "created_at", F.explode("properties").alias("key", "value"))


def property_keys(ev: DataFrame) -> DataFrame:
    """Property keys with array positions wildcarded, most recently seen first, then shorter ones first."""
    key = F.regexp_replace(F.regexp_replace("key", r"\.[0-9]+\.", ".*."), r"\.[0-9]+$", "[*]")
    out = property_entries(ev).groupBy(*SHOP, key.alias("key")).agg(F.max("created_at").alias("last_seen"))
    order = Window.partitionBy(*SHOP).orderBy(F.desc("last_seen"), F.length("key"), "key")
    return out.withColumn("position", F.row_number().over(order))


def property_values(ev: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """Distinct trimmed values of a property; ``*`` in the key stands for any text."""
    pattern = key.replace("%", r"\%").replace("_", r"\_").replace("*", "%")
    rows = property_entries(ev).where(F.col("key").like(pattern)).select(*SHOP, F.trim("value").alias("value"))
    return top_k(rows.where(F.col("value") != "").distinct(), SHOP, [F.col("value")], limit)


def column_values(ev: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """Distinct non-blank values of a column."""
    return top_k(ev.where(F.col(column) != "").select(*SHOP, F.col(column).alias("value")).distinct(), SHOP, [F.col("value")], limit)


def event_names(ev: DataFrame, limit: int = 100) -> DataFrame:
    """The most frequent names with counts, and ``*`` for the total of all names."""
    counts = ev.where(F.col("name") != "").groupBy(*SHOP, "name").agg(F.count(F.lit(1)).alias("count"))
    best = top_k(counts, SHOP, [F.desc("count"), F.col("name")], limit)
    total = counts.groupBy(*SHOP).agg(F.lit("*").alias("name"), F.sum("count").alias("count"))
    return best.unionByName(total.select(*best.columns))


def conversion_names(ev: DataFrame, limit: int = 50) -> DataFrame:
    from tidemark.functions.predicates import conversion

    names = ev.where(conversion() & (F.col("name") != "")).select(*SHOP, "name").distinct()
    return top_k(names, SHOP, [F.col("name")], limit)


# --- groups ----------------------------------------------------------------------------------

def group_metrics(ev: DataFrame) -> DataFrame:
    """Per group: events, members, first and last activity."""
    rows = ev.select(*SHOP, "created_at", profile_id().alias("profile_id"), F.explode("groups").alias("group_id"))
    return rows.groupBy(*SHOP, "group_id").agg(F.count(F.lit(1)).alias("total_events"), F.count_distinct("profile_id").alias("unique_profiles"),
                                              F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def group_activity(ev: DataFrame) -> DataFrame:
    rows = ev.select(*SHOP, "created_at", F.explode("groups").alias("group_id"))
    return rows.groupBy(*SHOP, "group_id", bucket(F.col("created_at"), "day").alias("date")).agg(F.count(F.lit(1)).alias("count"))


def group_growth(members: DataFrame, as_of: datetime) -> DataFrame:
    """New members per day of the last 30, absent days as 0. ``members`` has one row per profile with groups and created_at."""
    from datetime import timedelta

    from tidemark.functions.timeutil import Period

    start = as_of.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=29)
    rows = members.select(*SHOP, "created_at", F.explode("groups").alias("group_id"))
    daily = rows.where(F.col("created_at") >= ts(start)).groupBy(*SHOP, "group_id", bucket(F.col("created_at"), "day").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    keys = [*SHOP, "group_id"]
    return zero_fill(daily, rows.select(*keys).distinct(), keys, ["count"], Period(start, as_of), "day", "date")


def group_top(ev: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent events (lifecycle excepted) or screen-view paths per group."""
    rows = ev.where(~F.col("name").isin(*LIFECYCLE_NAMES)) if column == "name" else ev.where(F.col("name").isin(*VIEW_NAMES))
    counts = rows.select(*SHOP, column, F.explode("groups").alias("group_id")).groupBy(*SHOP, "group_id", column).agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, [*SHOP, "group_id"], [F.desc("count"), F.col(column)], k)


def with_profile(ev: DataFrame, profile_table: DataFrame, version: str) -> DataFrame:
    """Events with the attributes of the newest version of their profile."""
    from tidemark.sources.tables import latest_by_key

    extra = [c for c in profile_table.columns if c not in (*PROFILE, version)]
    newest = latest_by_key(profile_table, PROFILE, version).select(*PROFILE, *[F.col(c).alias(f"profile_{c}") for c in extra])
    return ev.withColumn("profile_id", profile_id()).join(newest, PROFILE, "left")


def with_groups(ev: DataFrame, group_table: DataFrame) -> DataFrame:
    """One row per event and group with the group's attributes."""
    extra = [c for c in group_table.columns if c not in (*SHOP, "group_id")]
    flat = ev.withColumn("group_id", F.explode("groups"))
    return flat.join(group_table.select(*SHOP, "group_id", *[F.col(c).alias(f"group_{c}") for c in extra]), [*SHOP, "group_id"], "left")


# --- profile changes -------------------------------------------------------------------------

def apply_increments(mutations: DataFrame) -> DataFrame:
    """Net numeric change per profile and property: increments add, decrements subtract, one unless a value is given."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(1.0))
    signed = F.when(F.col("type") == "decrement", -value).when(F.col("type") == "increment", value)
    return mutations.where(F.col("type").isin("increment", "decrement")).groupBy(*PROFILE, "property").agg(F.sum(signed).alias("delta"))


def resolve_aliases(ev: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace aliased profile ids by the profile they belong to."""
    known = aliases.groupBy(*SHOP, F.col("alias").alias("profile_id")).agg(F.min("profile_id").alias("_canonical"))
    out = ev.join(known, PROFILE, "left")
    return out.withColumn("profile_id", F.coalesce("_canonical", "profile_id")).drop("_canonical")


def assign_groups(mutations: DataFrame) -> DataFrame:
    """All groups ever assigned per profile, sorted."""
    flat = mutations.where(F.col("type") == "assign_group").select(*PROFILE, F.explode("groups").alias("g")).distinct()
    return flat.groupBy(*PROFILE).agg(F.sort_array(F.collect_set("g")).alias("groups"))


def upsert_groups(groups: DataFrame, version: str = "updated_at") -> DataFrame:
    from tidemark.sources.tables import latest_by_key

    return latest_by_key(groups, [*SHOP, "group_id"], version)
