"""Search-console tables and page opportunities. Search rows: shop, date, page, query, clicks, impressions, position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import round_to, safe_ratio
from tidemark.functions.timeutil import Period
from tidemark.operators.funnel import both_periods
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP

# Average organic click-through in percent at positions 1 to 20.
BENCHMARK_CTR = (28.5, 15.7, 11.0, 8.0, 6.3, 5.0, 4.0, 3.3, 2.8, 2.5, 2.2, 2.0, 1.8, 1.5, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7)


def _totals() -> list[Column]:
    """Clicks, impressions, click-through and the position weighted by impressions."""
    impressions = F.sum("impressions")
    return [F.sum("clicks").alias("clicks"), impressions.alias("impressions"), round_to(safe_ratio(F.sum("clicks"), impressions), 6).alias("ctr"),
            round_to(safe_ratio(F.sum(F.col("position") * F.col("impressions")), impressions), 4).alias("position")]


def by(search: DataFrame, period: Period, *keys: str) -> DataFrame:
    """Totals of the period per page, query, date or nothing."""
    return search.where(period.current(F.col("date"))).groupBy(*SHOP, *keys).agg(*_totals())


def compare(search: DataFrame, period: Period) -> DataFrame:
    """Totals of the period and the one before."""
    return both_periods(search, period, "date").groupBy(*SHOP, "period").agg(*_totals())


def cannibalisation(search: DataFrame, period: Period) -> DataFrame:
    """Queries that several pages compete for."""
    pages = by(search, period, "query", "page")
    n = pages.groupBy(*SHOP, "query").agg(F.count(F.lit(1)).alias("pages"), F.sum("impressions").alias("query_impressions")).where(F.col("pages") >= 2)
    return pages.join(n, [*SHOP, "query"])


def opportunities(search_pages: DataFrame, site_pages: DataFrame) -> DataFrame:
    """Low click-through on page one, just off page one, seen but not clicked, and high bounce.

    ``search_pages``: page, clicks, impressions, ctr, position. ``site_pages``: page, sessions, bounce_rate. A page unknown
    to the search table needs more traffic and a higher bounce rate to count. The best finding per page and kind is kept.
    """
    joined = search_pages.withColumn("_known", F.lit(True)).join(site_pages, [*SHOP, "page"], "full_outer")
    known = F.coalesce(F.col("_known"), F.lit(False))
    pos, ctr, seen = F.col("position"), F.col("ctr"), F.col("impressions")
    bounce, sessions = F.col("bounce_rate"), F.col("sessions")

    def finding(kind: str, cond: Column, impact: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("type"), impact.cast("double").alias("impact")))

    bouncy = F.when(known, (bounce >= 70) & (sessions >= 20)).otherwise((bounce >= 75) & (sessions >= 30))
    kinds = F.array(
        finding("low_ctr", known & (pos <= 10) & (ctr < 0.04) & (seen >= 100), seen * (0.04 - ctr)),
        finding("near_page_one", known & (pos > 10) & (pos <= 20) & (seen >= 100), seen / pos),
        finding("invisible_clicks", known & (seen >= 500) & (ctr < 0.01) & (pos > 10), seen),
        finding("high_bounce", bouncy, sessions * (bounce / 100)))
    out = joined.select(*SHOP, "page", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select(*SHOP, "page", "x.*")
    return out.groupBy(*SHOP, "page", "type").agg(F.max("impact").alias("impact"))


def ctr_benchmark(search_pages: DataFrame) -> DataFrame:
    """Mean click-through in percent at each position 1 to 20 beside the benchmark; pages need ten impressions."""
    ok = search_pages.withColumn("position", F.floor(F.col("position") + 0.5).cast("int")).where(F.col("position").between(1, 20) & (F.col("impressions") >= 10))
    mine = ok.groupBy(*SHOP, "position").agg(round_to(F.avg(F.col("ctr") * 100), 6).alias("your_ctr"), F.count(F.lit(1)).alias("pages"))
    table = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias("benchmark")) for i, v in enumerate(BENCHMARK_CTR, start=1)])
    grid = search_pages.select(*SHOP).distinct().select(*SHOP, F.explode(table).alias("t")).select(*SHOP, "t.*")
    return grid.join(mine, [*SHOP, "position"], "left").fillna(0, ["pages"])


def benchmark_pages(search_pages: DataFrame, k: int = 5) -> DataFrame:
    """Best pages by click-through at each position."""
    ok = search_pages.withColumn("position", F.floor(F.col("position") + 0.5).cast("int")).where(F.col("position").between(1, 20) & (F.col("impressions") >= 10))
    return top_k(ok.select(*SHOP, "position", "page", "ctr", "impressions"), [*SHOP, "position"], [F.desc("ctr"), F.col("page")], k)


def site_pages(se: DataFrame, origin: str) -> DataFrame:
    """Sessions and bounce rate per entry page, keyed by full address."""
    return se.where(F.col("entry_path") != "").groupBy(*SHOP, F.concat(F.lit(origin), F.col("entry_path")).alias("page")).agg(
        F.count(F.lit(1)).alias("sessions"), round_to(safe_ratio(F.count_if(F.col("events_count") <= 1), F.count(F.lit(1)), 100), 2).alias("bounce_rate"))


def rank_pages(pages: DataFrame, k: int) -> DataFrame:
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy(*SHOP).orderBy(F.desc("clicks"), "page"))).where(F.col("rank") <= k)
