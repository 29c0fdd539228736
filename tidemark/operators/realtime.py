"""Realtime map and lists, for every shop at once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import round_to
from tidemark.functions.predicates import LIFECYCLE_NAMES, at_location, or_default
from tidemark.functions.timeutil import ts
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP

# Coordinates shown for events that have a country but no position.
DEFAULT_POSITION = (37.75, -97.82)
# One row each of up to so many shops is sent to every executor.
FEW_SHOPS = 10_000


def widened(ev: DataFrame, as_of: datetime, keep: Column) -> DataFrame:
    """Matching events of the last day, or of the last week, or all of them: per shop, the narrowest window that is not empty.
    The window follows from each shop's newest match, so nothing is counted repeatedly; the newest matches are one row per shop."""
    rows = ev.where(keep & (F.col("created_at") <= ts(as_of)))
    last = rows.groupBy(*SHOP).agg(F.max("created_at").alias("_last"))
    day, week = ts(as_of - timedelta(hours=24)), ts(as_of - timedelta(days=7))
    start = F.when(F.col("_last") >= day, day).when(F.col("_last") >= week, week)
    # The windows of few shops are broadcast; a shuffle by shop would make all events of one a task.
    few = last.limit(FEW_SHOPS + 1).count() <= FEW_SHOPS
    last = last.withColumn("_from", start).drop("_last")
    return rows.join(F.broadcast(last) if few else last, SHOP).where(F.col("_from").isNull() | (F.col("created_at") >= F.col("_from"))).drop("_from")


def _counted(rows: DataFrame, keys: list[str], durations: bool = False) -> DataFrame:
    mean = F.coalesce(round_to(F.avg("duration") / 1000, 2), F.lit(0.0)) if durations else F.lit(0.0)
    return rows.groupBy(*SHOP, *keys).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("session_id").alias("unique_sessions"), mean.alias("avg_duration"))


def paths(ev: DataFrame, as_of: datetime, k: int = 50, durations: bool = False) -> DataFrame:
    out = _counted(widened(ev, as_of, F.col("path") != ""), ["origin", "path"], durations)
    return top_k(out, SHOP, [F.desc("count"), F.col("path"), F.col("origin")], k)


def geo(ev: DataFrame, as_of: datetime, k: int = 50, durations: bool = False) -> DataFrame:
    out = _counted(widened(ev, as_of, F.length("country") == 2), ["country", "city"], durations)
    return top_k(out, SHOP, [F.desc("count"), F.col("country"), F.col("city")], k)


def referrals(ev: DataFrame, as_of: datetime, k: int = 50, durations: bool = False) -> DataFrame:
    rows = widened(ev, as_of, F.lit(True)).withColumn("referrer_name", or_default("referrer_name", "Direct"))
    return top_k(_counted(rows, ["referrer_name"], durations), SHOP, [F.desc("count"), F.col("referrer_name")], k)


def coordinates(ev: DataFrame, as_of: datetime, k: int = 500, default_position: bool = True) -> DataFrame:
    """Sessions per position. Events with only a country sit at a default position unless that is switched off."""
    known = F.col("latitude").isNotNull()
    rows = widened(ev, as_of, known | (F.length("country") == 2) if default_position else known)
    lat, long = F.coalesce("latitude", F.lit(DEFAULT_POSITION[0])), F.coalesce("longitude", F.lit(DEFAULT_POSITION[1]))
    out = rows.groupBy(*SHOP, "country", "city", long.alias("long"), lat.alias("lat")).agg(F.count_distinct("session_id").alias("count"))
    return top_k(out, SHOP, [F.desc("count"), F.col("country"), F.col("city"), F.col("lat"), F.col("long")], k)


def active_events(ev: DataFrame, k: int = 50) -> DataFrame:
    """Newest events per shop."""
    cols = ["id", "name", "session_id", "created_at", "path", "origin", "os", "browser", "device"]
    rows = ev.select(*SHOP, *cols, or_default("referrer_name", "Direct").alias("referrer_name"))
    return top_k(rows, SHOP, [F.desc("created_at"), F.desc("id")], k)


def recent_sessions(ev: DataFrame, k: int = 8) -> DataFrame:
    """Newest event of each session, newest sessions first. The newest event is a maximum, so it combines before the shuffle."""
    fields = ["created_at", "id", "customer_id", "path", "name", "country", "city"]
    newest = ev.groupBy(*SHOP, "session_id").agg(F.max(F.struct(*fields)).alias("e"))
    out = newest.select(*SHOP, "session_id", F.coalesce("e.customer_id", "session_id").alias("id"), F.col("e.customer_id").alias("profile_id"), F.col("e.created_at").alias("created_at"),
                        F.col("e.path").alias("latest_path"), F.col("e.name").alias("latest_event"), F.col("e.city").alias("city"), F.col("e.country").alias("country"),
                        F.col("e.id").alias("_tie"))
    return top_k(out, SHOP, [F.desc("created_at"), F.desc("_tie")], k).drop("_tie")


def badge_rows(ev: DataFrame, as_of: datetime, locations: list[dict], detail: str = "coordinate", hours: int = 24) -> DataFrame:
    at = F.col("created_at")
    return ev.where(at.between(ts(as_of - timedelta(hours=hours)), ts(as_of)) & at_location(locations, detail))


def badge_summary(ev: DataFrame, as_of: datetime, locations: list[dict], detail: str = "coordinate", hours: int = 24) -> DataFrame:
    """Sessions, known customers, and the places asked about."""
    n = {k: len({p.get(k) for p in locations if p.get(k)}) for k in ("country", "city")}
    return badge_rows(ev, as_of, locations, detail, hours).groupBy(*SHOP).agg(
        F.count_distinct("session_id").alias("total_sessions"), F.count_distinct("customer_id").alias("total_profiles"),
        F.lit(len(locations)).alias("total_locations"), F.lit(n["country"]).alias("total_countries"), F.lit(n["city"]).alias("total_cities"))


def badge_top(ev: DataFrame, as_of: datetime, locations: list[dict], detail: str = "coordinate", hours: int = 24, k: int = 3) -> DataFrame:
    """Top referrers, paths and events by sessions as (kind, item, count), from one scan."""
    kinds = F.array(
        F.when(F.col("referrer_name") != "", F.struct(F.lit("referrer").alias("kind"), F.col("referrer_name").alias("item"))),
        F.when(F.col("path") != "", F.struct(F.lit("path").alias("kind"), F.concat("origin", "path").alias("item"))),
        F.when(~F.col("name").isin(*LIFECYCLE_NAMES), F.struct(F.lit("event").alias("kind"), F.col("name").alias("item"))))
    rows = badge_rows(ev, as_of, locations, detail, hours).select(*SHOP, "session_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x"))
    counts = rows.groupBy(*SHOP, "x.kind", "x.item").agg(F.count_distinct("session_id").alias("count"))
    return top_k(counts, [*SHOP, "kind"], [F.desc("count"), F.col("item")], k)
