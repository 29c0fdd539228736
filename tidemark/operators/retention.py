"""Retention cohorts. A profile joins the cohort of the bucket of its first start event; each later bucket with a
return event is an offset. ``on`` counts profiles active exactly at the offset, ``on_or_after`` those active there or later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import round_to, safe_ratio
from tidemark.functions.predicates import profile_id
from tidemark.functions.timeutil import Period, bucket, ts
from tidemark.schema import SHOP

_DAYS = {"day": 1, "week": 7}


def _offset(later, earlier, interval: str):
    if interval == "month":
        return F.floor(F.months_between(later, earlier)).cast("int")
    if interval == "hour":
        return F.floor((F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))) / 3600).cast("int")
    return F.floor(F.datediff(later, earlier) / _DAYS[interval]).cast("int")


def retention(ev: DataFrame, first: Sequence[str], second: Sequence[str], period: Period, interval: str = "day",
              criteria: str = "on_or_after") -> DataFrame:
    """Per cohort and offset: cohort size, retained profiles and their share. Every offset up to the end of the
    period is present. One scan and one shuffle of (profile, bucket) pairs; the counts work on those."""
    names = sorted({*first, *second})
    rows = ev.where(period.current(F.col("created_at")) & F.col("name").isin(*names))
    active = rows.groupBy(*SHOP, profile_id().alias("profile_id"), bucket(F.col("created_at"), interval).alias("at")).agg(
        F.max(F.col("name").isin(*first)).alias("starts"), F.max(F.col("name").isin(*second)).alias("returns"))
    born = active.where("starts").groupBy(*SHOP, "profile_id").agg(F.min("at").alias("cohort"))
    sizes = born.groupBy(*SHOP, "cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    back = active.where("returns").join(born, [*SHOP, "profile_id"]).where(F.col("at") >= F.col("cohort"))
    back = back.withColumn("offset", _offset(F.col("at"), F.col("cohort"), interval))
    last = _offset(bucket(ts(period.end), interval), F.col("cohort"), interval)
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0), last)).alias("offset"))
    if criteria == "on":
        counts = back.groupBy(*SHOP, "cohort", "offset").agg(F.count(F.lit(1)).alias("users"))
        out = grid.join(counts, [*SHOP, "cohort", "offset"], "left").fillna(0, ["users"])
    else:
        furthest = back.groupBy(*SHOP, "cohort", "profile_id").agg(F.max("offset").alias("offset"))
        counts = furthest.groupBy(*SHOP, "cohort", "offset").agg(F.count(F.lit(1)).alias("_n"))
        # Later offsets first: the running sum is the number of profiles seen there or later. A cohort has one row per offset.
        reverse = Window.partitionBy(*SHOP, "cohort").orderBy(F.desc("offset")).rowsBetween(Window.unboundedPreceding, 0)
        out = (grid.join(counts, [*SHOP, "cohort", "offset"], "left")
               .withColumn("users", F.coalesce(F.sum("_n").over(reverse), F.lit(0))).drop("_n"))
    return out.withColumn("percentage", round_to(safe_ratio(F.col("users"), F.col("cohort_size"), 100), 2))


def _mean(percentage: str) -> Column:
    """Mean of percentages, 100 at most, to two decimals. The doubles are summed exactly, as whole multiples of 2 ** -55, and
    rounded once: a plain sum depends on the order of the rows, which decides means that lie halfway."""
    unit = F.lit(2.0 ** 55)
    total = F.sum((F.col(percentage) * unit).cast("bigint").cast("decimal(20,0)")).cast("double") / unit
    return round_to(total / F.count(percentage), 2)


def retention_average(table: DataFrame) -> DataFrame:
    """Mean percentage per offset over all cohorts that have it."""
    return table.groupBy(*SHOP, "offset").agg(_mean("percentage").alias("avg_percentage"),
                                             F.sum("users").alias("users"), F.sum("cohort_size").alias("cohort_size"))


def retention_line(average: DataFrame) -> DataFrame:
    """Mean of the average row, zeros included."""
    return average.groupBy(*SHOP).agg(_mean("avg_percentage").alias("average"))
