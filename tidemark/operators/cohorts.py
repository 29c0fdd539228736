"""Behavioural and property cohorts, and reports on their members.

All criteria of a cohort are counted in one pass: one conditional count per criterion and profile, combined
before the shuffle. ``and`` / ``or`` then compare counts, so no per-criterion join is needed.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import LIFECYCLE_NAMES, all_of, field_filter, profile_id
from tidemark.functions.timeutil import bucket, ts
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP

PROFILE = [*SHOP, "profile_id"]


def _field(name: str) -> Column:
    return F.col("properties")[name.split(".", 1)[1]] if name.startswith("properties.") else F.col(name)


def _filters(filters: list[dict]) -> Column:
    return all_of([field_filter(_field(f["name"]), f["operator"], f.get("value", []), f.get("cast", "string")) for f in filters])


def _timeframe(frame: dict, as_of: datetime) -> Column:
    at = F.col("created_at")
    if frame["type"] == "relative":
        return at.between(ts(as_of - timedelta(days=int(frame["value"].rstrip("d")))), ts(as_of))
    start = at >= ts(frame["start"])
    return start & (at <= ts(frame["end"])) if frame.get("end") else start


def _combine(tests: list[Column], operator: str) -> Column:
    return reduce((lambda a, b: a & b) if operator == "and" else (lambda a, b: a | b), tests)


def event_cohort(ev: DataFrame, events: list[dict], as_of: datetime, operator: str = "and") -> DataFrame:
    """Profiles by what they did. A criterion has a name, property filters, a timeframe and a frequency
    (at least one occurrence unless given)."""
    hits, tests = [], []
    for i, criterion in enumerate(events):
        cond = (F.col("name") == criterion["name"]) & _filters(criterion.get("filters", [])) & _timeframe(criterion["timeframe"], as_of)
        hits.append(F.count_if(cond).alias(f"_c{i}"))
        frequency = criterion.get("frequency") or {"operator": "gte", "count": 1}
        n, k = F.col(f"_c{i}"), frequency["count"]
        # "At most k" still needs one occurrence: a profile that never did it is not a match.
        tests.append({"gte": n >= k, "eq": n == k, "lte": (n <= k) & (n > 0)}[frequency["operator"]])
    relevant = F.col("name").isin(*sorted({c["name"] for c in events}))
    counted = ev.where(relevant).groupBy(*SHOP, profile_id().alias("profile_id")).agg(*hits)
    return counted.where(_combine(tests, operator)).select(*PROFILE)


def property_cohort(ev: DataFrame, properties: list[dict], operator: str = "and") -> DataFrame:
    """Profiles by their latest known attributes."""
    names = sorted({p["name"] for p in properties})
    latest = [F.max(F.when(_field(n) != "", F.struct(F.col("created_at"), F.col("id"), _field(n).alias("v")))).alias(f"_{i}") for i, n in enumerate(names)]
    known = ev.groupBy(*SHOP, profile_id().alias("profile_id")).agg(*latest)
    tests = [F.coalesce(field_filter(F.col(f"_{names.index(p['name'])}.v"), p["operator"], p.get("value", []), p.get("cast", "string")), F.lit(False))
             for p in properties]
    return known.where(_combine(tests, operator)).select(*PROFILE)


def named_cohort(members: DataFrame, cohort_id: str) -> DataFrame:
    return members.withColumn("cohort_id", F.lit(cohort_id))


def cohort_count(members: DataFrame) -> DataFrame:
    return members.groupBy(*SHOP).agg(F.count(F.lit(1)).alias("members"))


def cohort_preview(members: DataFrame, n: int = 10) -> DataFrame:
    """Member count with the first n ids."""
    return top_k(members, SHOP, [F.col("profile_id")], n).join(cohort_count(members), SHOP)


def member_events(ev: DataFrame, members: DataFrame) -> DataFrame:
    return ev.withColumn("profile_id", profile_id()).join(members.select(*PROFILE), PROFILE, "left_semi")


def cohort_most_events(ev: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    rows = member_events(ev, members).where(~F.col("name").isin(*LIFECYCLE_NAMES))
    return top_k(rows.groupBy(*SHOP, "name").agg(F.count(F.lit(1)).alias("count")), SHOP, [F.desc("count"), F.col("name")], k)


def cohort_events_per_day(ev: DataFrame, members: DataFrame) -> DataFrame:
    return member_events(ev, members).groupBy(*SHOP, bucket(F.col("created_at"), "day").alias("date")).agg(F.count(F.lit(1)).alias("count"))


def cohort_routes(ev: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    rows = member_events(ev, members).where(F.col("path") != "")
    return top_k(rows.groupBy(*SHOP, "path").agg(F.count(F.lit(1)).alias("count")), SHOP, [F.desc("count"), F.col("path")], k)
