"""Ordered funnels within a time window.

A chain starts at a first-step event and must finish inside the window, so it lies in the window-long
tile that holds its start and the next one. Levels cut tiles further into slices: one shuffle and one sort reduce each
slice of a device to a small table of what it does to chains, and the tables of two tiles, of fixed number and size, are
composed. A device that sends most of all events is split over as many tasks as there are slices. Conversion series
evaluate whole tiles instead, since they report every event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import round_to, safe_ratio
from tidemark.functions.timeutil import Period, bucket, from_micros, micros, slot
from tidemark.schema import DEVICE, SHOP

# The standard purchase funnel and its window.
DEFAULT_STEPS = ("page_view", "add_to_cart", "checkout_step", "purchase")
WINDOW_SECONDS = 86_400
SLICES = 16


def _chains(ev: DataFrame, steps: Sequence[str], keys: list[str], window: int, carry: list[str]) -> DataFrame:
    """Per step event: ``_m1 … _mn``, the start of the newest chain that reaches each step at this event.

    Step k is reached when some earlier event holds a chain of k − 1 steps that began at most a window ago;
    the newest such chain is the only one worth keeping, hence a running maximum per step. Every event is placed in its
    own tile and the one before, and reported once, from the tile that holds a full window before it.
    """
    width = window * 1_000_000
    at = micros(F.col("created_at"))
    own = slot(at, width)
    rows = (ev.where(F.col("name").isin(*steps)).select(*keys, *carry, "name", "id", "created_at", at.alias("_at"), own.alias("_own"),
                                                        F.explode(F.array(own, own - 1)).alias("_tile")))
    before = Window.partitionBy(*keys, "_tile").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_m1", F.when(F.col("name") == steps[0], F.col("_at")))
    for k, step in enumerate(steps[1:], start=2):
        start = F.max(f"_m{k - 1}").over(before)
        rows = rows.withColumn(f"_s{k}", start).withColumn(
            f"_m{k}", F.when((F.col("name") == step) & (F.col("_at") <= F.col(f"_s{k}") + width), F.col(f"_s{k}"))).drop(f"_s{k}")
    return rows.where(F.col("_tile") == F.col("_own") - 1)


def _slices(ev: DataFrame, steps: list[str], keys: list[str], window: int, carry: list[str]) -> DataFrame:
    """What each slice of a key's time does to chains, whatever came before it: ``_i1 … _in``, the newest start within the slice of a
    chain that reaches the step there, and ``_tjk``, the earliest instant at which a chain that had reached step j before the slice has
    reached step k. A slice is shorter than the window, so chains that begin in it are in time.
    """
    at, n = micros(F.col("created_at")), len(steps)
    rows = ev.where(F.col("name").isin(*steps)).select(*keys, *carry, "name", "id", "created_at", at.alias("_at"),
                                                       slot(at, window * 1_000_000 // SLICES).alias("_slice"))
    before = Window.partitionBy(*keys, "_slice").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i1", F.when(F.col("name") == steps[0], F.col("_at")))
    for k in range(2, n + 1):
        here = F.col("name") == steps[k - 1]
        chains = {f"_i{k}": F.when(here, F.max(f"_i{k - 1}").over(before)), f"_t{k - 1}_{k}": F.when(here, F.col("_at"))}
        for j in range(1, k - 1):
            chains[f"_t{j}_{k}"] = F.when(here & F.min(f"_t{j}_{k - 1}").over(before).isNotNull(), F.col("_at"))
        rows = rows.withColumns(chains)
    aggs = [F.max(f"_i{k}").alias(f"_i{k}") for k in range(1, n + 1)]
    aggs += [F.min(f"_t{j}_{k}").alias(f"_t{j}_{k}") for k in range(2, n + 1) for j in range(1, k)]
    if carry:
        aggs.append(F.min(F.struct("created_at", "id", *carry)).alias("_first"))
    return rows.groupBy(*keys, "_slice").agg(*aggs)


def funnel_levels(ev: DataFrame, steps: Sequence[str] = DEFAULT_STEPS, window: int = WINDOW_SECONDS, period: Period | None = None,
                  keys: list[str] = DEVICE, breakdown: str | None = None) -> DataFrame:
    """Deepest step each key reached, 0 included; ``keys`` may end in a device, profile or session.
    With a breakdown, the value is the one on the key's first step event.

    Slices are composed in order, first those of the tile in which a chain starts, then those of the next one, which start nothing:
    a chain is known by its newest start, and a slice carries it on if it reaches the later step within the window of that start.
    """
    steps, n, width = list(steps), len(steps), window * 1_000_000
    if period is not None:
        ev = ev.where(period.current(F.col("created_at")))
    slices = _slices(ev, steps, keys, window, [breakdown] if breakdown else [])
    tile = F.floor(F.col("_slice") / SLICES)
    moves = [f"_t{j}_{k}" for k in range(2, n + 1) for j in range(1, k)]
    content = F.struct("_slice", *[f"_i{k}" for k in range(1, n + 1)], *moves)
    placed = slices.select(*keys, *(["_first"] if breakdown else []), content.alias("_s"), tile.alias("_own"),
                           F.explode(F.array(tile, tile - 1)).alias("_tile"))
    folded = placed.groupBy(*keys, "_tile").agg(
        F.array_sort(F.collect_list(F.struct("_s", (F.col("_own") == F.col("_tile")).alias("own")))).alias("_ss"),  # 2 SLICES at most
        *([F.min("_first").alias("_first")] if breakdown else []))

    def step(m: Column, x: Column) -> Column:
        s = x["_s"]
        new = []
        for k in range(1, n + 1):
            carried = [F.when(s[f"_t{j}_{k}"] <= m[f"m{j}"] + width, m[f"m{j}"]) for j in range(1, k)]
            new.append(F.greatest(m[f"m{k}"], F.when(x["own"], s[f"_i{k}"]), *carried).alias(f"m{k}"))
        return F.struct(*new)

    none = F.struct(*[F.lit(None).cast("bigint").alias(f"m{k}") for k in range(1, n + 1)])
    level = lambda m: F.coalesce(*[F.when(m[f"m{k}"].isNotNull(), F.lit(k)) for k in range(n, 0, -1)], F.lit(0))
    levels = folded.withColumn("_level", F.aggregate("_ss", none, step, level))
    aggs = [F.max("_level").alias("level")]
    if breakdown:
        aggs.append(F.min("_first")[breakdown].alias("breakdown"))
    return levels.groupBy(*keys).agg(*aggs)


def funnel_result(levels: DataFrame, steps: Sequence[str], by: list[str] = SHOP) -> DataFrame:
    """Reach, drop-off and conversion per step. Reach is cumulative; the first step converts 100 % and drops whoever
    did not reach the second; a step after an unreached one counts 0 throughout."""
    steps = list(steps)
    reach = [F.count_if(F.col("level") >= k).alias(f"_r{k}") for k in range(1, len(steps) + 1)]
    wide = levels.where(F.col("level") > 0).groupBy(*by).agg(*reach)
    rows = []
    for k, step in enumerate(steps, start=1):
        cur, prev = F.col(f"_r{k}"), F.col(f"_r{max(k - 1, 1)}")
        if k == 1:
            drop, rate = (cur - F.col("_r2") if len(steps) > 1 else F.lit(0)), F.lit(100.0)
        else:
            drop, rate = prev - cur, safe_ratio(cur, prev, 100)
        rows.append(F.struct(F.lit(k).alias("step_index"), F.lit(step).alias("name"), cur.alias("count"),
                             drop.cast("bigint").alias("dropoff_count"), rate.alias("conversion_rate")))
    overall = safe_ratio(F.col(f"_r{len(steps)}"), F.col("_r1"), 100)
    return (wide.select(*by, F.col("_r1").alias("total_visitors"), overall.alias("overall_conversion_rate"), F.explode(F.array(*rows)).alias("_s"))
            .select(*by, "_s.*", "total_visitors", "overall_conversion_rate"))


def funnel(ev: DataFrame, steps: Sequence[str] = DEFAULT_STEPS, period: Period | None = None, window: int = WINDOW_SECONDS,
           keys: list[str] = DEVICE, breakdown: str | None = None) -> DataFrame:
    levels = funnel_levels(ev, steps, window, period, keys, breakdown)
    return funnel_result(levels, steps, SHOP + (["breakdown"] if breakdown else []))


def both_periods(ev: DataFrame, period: Period, column: str = "created_at") -> DataFrame:
    """Rows of the period and the one before, tagged; a row at the shared instant appears in both."""
    at = F.col(column)
    tags = F.filter(F.array(F.when(period.current(at), F.lit("current")), F.when(period.previous(at), F.lit("previous"))),
                    lambda x: x.isNotNull())
    return ev.where(period.either(at)).withColumn("period", F.explode(tags))


def funnel_compare(ev: DataFrame, period: Period, steps: Sequence[str] = DEFAULT_STEPS, window: int = WINDOW_SECONDS,
                   keys: list[str] = DEVICE) -> DataFrame:
    """Current and previous funnel from one scan."""
    levels = funnel_levels(both_periods(ev, period), steps, window, None, [*keys, "period"])
    return funnel_result(levels, steps, [*SHOP, "period"])


def funnel_members(levels: DataFrame, step_index: int, dropoffs: bool = False, breakdown_value: str | None = None) -> DataFrame:
    """Keys behind one step (0-based): those who reached it, or those who stopped there."""
    target = step_index + 1
    hit = F.col("level") == target if dropoffs else F.col("level") >= target
    if breakdown_value is not None:
        hit = hit & (F.col("breakdown") == breakdown_value)
    return levels.where(hit)


def conversion_series(ev: DataFrame, first: str, second: str, period: Period, interval: str = "day", window: int = WINDOW_SECONDS,
                      breakdown: str | None = None) -> DataFrame:
    """Share of devices doing ``second`` within a window of ``first``, by the bucket of the start. A device counts
    once per bucket; a conversion belongs to its newest start."""
    carry = [breakdown] if breakdown else []
    by = SHOP + carry
    rows = _chains(ev.where(period.current(F.col("created_at"))), [first, second], DEVICE, window, carry)

    def mark(col: str, converted: bool) -> Column:
        return F.when(F.col(col).isNotNull(), F.struct(bucket(from_micros(F.col(col)), interval).alias("bucket"), F.lit(converted).alias("hit")))

    marks = F.filter(F.array(mark("_m1", False), mark("_m2", True)), lambda x: x.isNotNull())
    flat = rows.select(*DEVICE, *carry, F.explode(marks).alias("_x")).select(*DEVICE, *carry, "_x.*")
    out = flat.groupBy(*by, "bucket").agg(
        F.count_distinct(F.when(~F.col("hit"), F.col("device_id"))).alias("total"),
        F.count_distinct(F.when(F.col("hit"), F.col("device_id"))).alias("conversions"))
    return out.withColumn("rate", round_to(safe_ratio(F.col("conversions"), F.col("total"), 100), 2))


def conversion_compare(ev: DataFrame, first: str, second: str, period: Period, interval: str = "day", window: int = WINDOW_SECONDS) -> DataFrame:
    """Conversion series with the rate of the same position in the previous period."""
    order = Window.partitionBy(*SHOP).orderBy("bucket")
    earlier = Period(period.prev_start, period.prev_end)
    cur = conversion_series(ev, first, second, period, interval, window).withColumn("_i", F.row_number().over(order))
    prev = conversion_series(ev, first, second, earlier, interval, window).withColumn("_i", F.row_number().over(order))
    return cur.join(prev.select(*SHOP, "_i", F.col("rate").alias("previous_rate")), [*SHOP, "_i"], "left").drop("_i")


def conversion_summary(series: DataFrame, name: str) -> DataFrame:
    """Best and worst point, best and worst series average, and the mean of averages, per shop. Averages leave zero
    rates out."""
    point = F.struct("rate", "bucket", name)
    nonzero = F.avg(F.when(F.col("rate") != 0, F.col("rate")))
    per = series.groupBy(*SHOP, name).agg(
        F.max_by(point, F.struct("rate", F.col("bucket"), F.col(name))).alias("_hi"),
        F.min_by(point, F.struct("rate", F.col("bucket"), F.col(name))).alias("_lo"), F.coalesce(nonzero, F.lit(0.0)).alias("_avg"))
    out = per.groupBy(*SHOP).agg(
        F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"), F.max(F.struct("_avg", name)).alias("_best"), F.min(F.struct("_avg", name)).alias("_worst"),
        F.coalesce(F.avg(F.when(F.col("_avg") != 0, F.col("_avg"))), F.lit(0.0)).alias("_mean"))
    return out.select(
        *SHOP, F.col("_hi.rate").alias("best_rate"), F.col("_hi.bucket").alias("best_bucket"), F.col(f"_hi.{name}").alias("best_series"),
        F.col("_lo.rate").alias("worst_rate"), F.col("_lo.bucket").alias("worst_bucket"), F.col(f"_lo.{name}").alias("worst_series"),
        F.col(f"_best.{name}").alias("best_average_series"), round_to(F.col("_best._avg"), 4).alias("best_average"),
        F.col(f"_worst.{name}").alias("worst_average_series"), round_to(F.col("_worst._avg"), 4).alias("worst_average"),
        round_to(F.col("_mean"), 4).alias("average_rate"))


def conversion_table(current: DataFrame, previous: DataFrame, name: str) -> DataFrame:
    """Totals, conversions and mean rate per series with the previous mean."""
    cur = current.groupBy(*SHOP, name).agg(F.sum("total").alias("total"), F.sum("conversions").alias("conversions"),
                                           round_to(F.avg("rate"), 4).alias("avg_rate"))
    prev = previous.groupBy(*SHOP, name).agg(round_to(F.avg("rate"), 4).alias("prev_avg_rate"))
    return cur.join(prev, [*SHOP, name], "left")


def conversion_wide(series: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """One row per bucket with rate, total and conversions columns for each named series."""
    out = series.groupBy(*SHOP, "bucket").pivot(name, list(values)).agg(
        F.first("rate").alias("rate"), F.first("total").alias("total"), F.first("conversions").alias("conversions"))
    return out
