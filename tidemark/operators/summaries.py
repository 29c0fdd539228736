"""Summary tables behind the catalogues, and notification rules."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import all_of, field_filter, profile_id
from tidemark.functions.timeutil import bucket, ts
from tidemark.operators.funnel import funnel_levels
from tidemark.schema import DEVICE, SHOP


def daily_actives(ev: DataFrame) -> DataFrame:
    """One row per profile and active day."""
    return ev.select(*SHOP, bucket(F.col("created_at"), "day").alias("date"), profile_id().alias("profile_id")).distinct()


def distinct_event_names(ev: DataFrame) -> DataFrame:
    return ev.groupBy(*SHOP, "name").agg(F.count(F.lit(1)).alias("count"), F.max("created_at").alias("last_seen"))


def property_value_table(ev: DataFrame) -> DataFrame:
    """Property keys and values per event name with their use and last sight."""
    rows = ev.select(*SHOP, "name", "created_at", F.explode("properties").alias("key", "value")).where(F.col("value") != "")
    return rows.groupBy(*SHOP, "name", "key", "value").agg(F.count(F.lit(1)).alias("count"), F.max("created_at").alias("last_seen"))


def cohort_events(ev: DataFrame) -> DataFrame:
    """Occurrences per profile, event and day, from which behavioural cohorts can be counted."""
    return ev.groupBy(*SHOP, profile_id().alias("profile_id"), "name", bucket(F.col("created_at"), "day").alias("date")).agg(F.count(F.lit(1)).alias("count"))


def profile_event_summary(ev: DataFrame) -> DataFrame:
    return ev.groupBy(*SHOP, profile_id().alias("profile_id"), "name").agg(
        F.count(F.lit(1)).alias("count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def event_notifications(ev: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that satisfy an event rule: name and filters."""
    hits = [F.when(all_of([F.col("name") == r["name"]] + [field_filter(F.col(f["name"]), f["operator"], f.get("value", [])) for f in r.get("filters", [])]), F.lit(r["id"])) for r in rules]
    matched = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return ev.select(*DEVICE, "id", "name", "created_at", F.explode(matched).alias("rule_id"))


def funnel_notifications(ev: DataFrame, rule_id: str, steps: list[str], as_of: datetime, window: int = 86_400) -> DataFrame:
    """Devices that completed a rule's steps within its window, looking back as far as a completion now could have begun."""
    recent = ev.where(F.col("created_at").between(ts(as_of - timedelta(seconds=window)), ts(as_of)))
    done = funnel_levels(recent, steps, window).where(F.col("level") == len(steps))
    return done.select(*DEVICE, F.lit(rule_id).alias("rule_id"))
