"""The chart engine: aggregates, breakdown series, single series, segments, formulas and summaries."""

from __future__ import annotations

import ast
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import round_to
from tidemark.functions.predicates import all_of, field_filter, named, profile_id
from tidemark.functions.timeutil import Period, bucket, resolve_period, zero_fill
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP

# Columns a chart may be broken down by.
BREAKDOWNS = ("name", "browser", "os", "device", "country", "city", "path", "origin", "referrer_name")


def _scope(ev: DataFrame, period: Period, events: Sequence[str], profile: Column | None) -> DataFrame:
    rows = ev.where(period.current(F.col("created_at")) & named(events))
    return rows if profile is None else rows.where(profile)


def aggregate(ev: DataFrame, period: Period, breakdown: str = "name", events: Sequence[str] = (), profile: Column | None = None, limit: int = 50) -> DataFrame:
    """Events per value, the top ones only; '' reads ``unknown``."""
    if breakdown not in BREAKDOWNS:
        raise ValueError(f"breakdown {breakdown!r}: one of {BREAKDOWNS}")
    counts = _scope(ev, period, events, profile).groupBy(*SHOP, F.col(breakdown).alias("item")).agg(F.count(F.lit(1)).alias("count"))
    best = top_k(counts, SHOP, [F.desc("count"), F.col("item")], limit)
    return best.withColumn("item", F.when(F.col("item") == "", F.lit("unknown")).otherwise(F.col("item")))


def aggregate_summary(bars: DataFrame) -> DataFrame:
    """Sum, mean per bar, smallest and largest bar."""
    return bars.groupBy(*SHOP).agg(F.sum("count").alias("sum"), round_to(F.avg("count"), 2).alias("average"),
                                   F.min("count").alias("min"), F.max("count").alias("max"))


def series_by(ev: DataFrame, period: Period, breakdown: str, events: Sequence[str] = (), profile: Column | None = None, limit: int = 10) -> DataFrame:
    """Daily counts of the largest values, absent days as 0; '' is left out. Points come daily whatever interval a chart
    asks for. Values are ranked on the daily counts, so events are aggregated once."""
    rows = _scope(ev, period, events, profile).where(F.col(breakdown) != "")
    daily = rows.groupBy(*SHOP, F.col(breakdown).alias("item"), bucket(F.col("created_at"), "day").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    best = top_k(daily.groupBy(*SHOP, "item").agg(F.sum("count").alias("_n")), SHOP, [F.desc("_n"), F.col("item")], limit)
    return zero_fill(daily, best, [*SHOP, "item"], ["count"], period, "day")


def series(ev: DataFrame, period: Period, events: Sequence[str] = (), profile: Column | None = None) -> DataFrame:
    """Daily counts per shop, absent days as 0."""
    rows = _scope(ev, period, events, profile)
    daily = rows.groupBy(*SHOP, bucket(F.col("created_at"), "day").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    return zero_fill(daily, daily.select(*SHOP).distinct(), SHOP, ["count"], period, "day")


def series_summary(points: DataFrame, by: Sequence[str] = (), value: str = "count") -> DataFrame:
    """Sum, mean, smallest and largest over the zero-filled points of each series."""
    return points.groupBy(*SHOP, *by).agg(F.sum(value).alias("sum"), round_to(F.avg(value), 2).alias("average"),
                                          F.min(value).alias("min"), F.max(value).alias("max"))


def breakdown_summary(points: DataFrame, days: int) -> DataFrame:
    """Chart totals of a broken-down chart: minimum 0 and maximum the total, by convention."""
    out = points.groupBy(*SHOP).agg(F.sum("count").alias("sum"))
    return out.select(*SHOP, "sum", round_to(F.col("sum") / days, 2).alias("average"), F.lit(0).cast("bigint").alias("min"), F.col("sum").alias("max"))


# --- segments, formulas ----------------------------------------------------------------------

def _property(name: str | None) -> Column:
    column = F.col("properties")[name.split(".", 1)[1]] if name and name.startswith("properties.") else F.col(name or "revenue")
    return column.try_cast("double")


def segment(rows: DataFrame, by: list[str], kind: str = "event", prop: str | None = None) -> DataFrame:
    """One value per group: all events, unique users, sessions or groups, events per user, one event per user, or the sum, mean,
    largest or smallest of a property. ``revenue`` means the sum of revenue."""
    if kind == "revenue":
        kind, prop = "property_sum", "revenue"
    users = F.count_distinct(profile_id())
    if kind == "group":
        # Members of several groups count once in each; an absent list counts nowhere.
        return rows.withColumn("_g", F.explode_outer("groups")).groupBy(*by).agg(F.count_distinct("_g").cast("double").alias("value"))
    value = {
        "event": F.count(F.lit(1)), "user": users, "one_event_per_user": users, "session": F.count_distinct("session_id"),
        "user_average": round_to(F.count(F.lit(1)) / users, 2),
        "property_sum": F.sum(_property(prop)), "property_average": F.avg(_property(prop)),
        "property_max": F.max(_property(prop)), "property_min": F.min(_property(prop)),
    }[kind]
    return rows.groupBy(*by).agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))


def report_series(ev: DataFrame, spec: dict, period: Period, interval: str = "day", breakdown: str | None = None, global_filters: Sequence[dict] = ()) -> DataFrame:
    """One series of a report: name, segment, property and filters, optionally broken down; zero-filled. Report-wide
    filters are added to the series' own."""
    filters = [field_filter(F.col(f["name"]), f["operator"], f.get("value", [])) for f in (*global_filters, *spec.get("filters", []))]
    rows = ev.where(period.current(F.col("created_at")) & all_of(filters))
    if spec.get("name") and spec["name"] != "*":
        rows = rows.where(F.col("name") == spec["name"])
    keys = list(SHOP)
    if breakdown:
        source = F.col("properties")[breakdown.split(".", 1)[1]] if breakdown.startswith("properties.") else F.col(breakdown)
        rows, keys = rows.withColumn("item", F.coalesce(source.cast("string"), F.lit(""))).where(F.col("item") != ""), [*SHOP, "item"]
    rows = rows.withColumn("bucket", bucket(F.col("created_at"), interval))
    values = segment(rows, [*keys, "bucket"], spec.get("segment", "event"), spec.get("property"))
    return zero_fill(values, values.select(*keys).distinct(), keys, ["value"], period, interval)


_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Pow: "^"}


def formula_column(text: str, columns: dict[str, Column]) -> Column:
    """Arithmetic over series ids as a column: + − × ÷ % ^ and parentheses. Dividing by 0 gives 0; anything else in
    the text is refused."""
    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            a, b = build(node.left), build(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Pow):
                return F.pow(a, b)
            return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)) if isinstance(node.op, ast.Div) else a % F.nullif(b, F.lit(0.0)))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id]
        raise ValueError(f"not allowed in a formula: {text}")
    return build(ast.parse(text.replace("^", "**"), mode="eval").body)


def formula_series(series_by_id: dict[str, DataFrame], formulas: dict[str, str], hidden: Sequence[str] = ()) -> DataFrame:
    """Series side by side per bucket with formula series computed from them; hidden series are left out of the result. Formulas
    may use series and earlier formulas."""
    long = None
    for sid, df in series_by_id.items():
        part = df.select(*SHOP, "bucket", F.lit(sid).alias("_id"), "value")
        long = part if long is None else long.unionByName(part)
    ids = list(series_by_id)
    wide = long.groupBy(*SHOP, "bucket").pivot("_id", ids).agg(F.sum("value")).fillna(0.0, ids)
    for sid, text in formulas.items():
        wide = wide.withColumn(sid, formula_column(text, {i: F.col(i) for i in ids}))
        ids.append(sid)
    return wide.select(*SHOP, "bucket", *[i for i in ids if i not in hidden])


def report_metric(points: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """One number per series: count of points, sum, average, min or max."""
    value = {"count": F.count(F.lit(1)).cast("double"), "sum": F.sum("value"), "average": round_to(F.avg("value"), 2), "min": F.min("value"), "max": F.max("value")}[metric]
    return points.groupBy(*SHOP, *by).agg(value.alias("value"))


def page_of_series(totals: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of series per shop, largest first."""
    rank = F.row_number().over(Window.partitionBy(*SHOP).orderBy(F.desc("value"), "item"))
    return totals.withColumn("_r", rank).where((F.col("_r") > offset) & (F.col("_r") <= offset + limit)).drop("_r")


# --- label grouping and tables ---------------------------------------------------------------

def group_by_labels(rows: DataFrame, labels: Sequence[str], date: str = "date") -> DataFrame:
    """Label columns joined into one series key with blanks skipped; unlabelled rows go and every date of the shop appears in every series."""
    parts = F.filter(F.array(*labels), lambda x: x.isNotNull() & (x != ""))
    keyed = rows.withColumn("series", F.array_join(parts, ":::"))
    dates = keyed.select(*SHOP, date).distinct()
    keyed = keyed.where(F.col("series") != "")
    grid = keyed.select(*SHOP, "series").distinct().join(dates, SHOP)
    values = keyed.groupBy(*SHOP, "series", date).agg(F.sum("count").alias("count"), F.sum("total_count").alias("total_count"))
    return grid.join(values, [*SHOP, "series", date], "left").fillna(0, ["count", "total_count"])


def table_summary(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: sum of series sums, mean of series means, smallest and largest point."""
    per = points.groupBy(*SHOP, *by, "item").agg(F.sum("count").alias("s"), F.avg("count").alias("a"), F.min("count").alias("lo"), F.max("count").alias("hi"))
    return per.groupBy(*SHOP, *by).agg(F.sum("s").alias("sum"), round_to(F.avg("a"), 4).alias("average"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def table_dates(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and date, the sum over its series."""
    return points.groupBy(*SHOP, *by, "bucket").agg(F.sum("count").alias("count"))


def hierarchy(ev: DataFrame, period: Period, breakdowns: Sequence[str]) -> DataFrame:
    """Counts at every level of a breakdown list: the shop, the first breakdown, the first two, and so on. ``depth`` tells a
    subtotal from an absent value."""
    rows = ev.where(period.current(F.col("created_at")))
    levels = list(breakdowns)
    out = rows.rollup(*SHOP, *levels).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_g"))
    n = len(levels)
    depth = F.lit(n)
    for d in range(n):
        # The lowest n − d grouping bits are set when only the first d breakdowns are kept.
        depth = F.when(F.col("_g") == (1 << (n - d)) - 1, F.lit(d)).otherwise(depth)
    return out.where(F.col("_g") < (1 << n)).select(*SHOP, *levels, depth.alias("depth"), "count")


def breakdown_order(ev: DataFrame, breakdowns: Sequence[str]) -> DataFrame:
    """Breakdowns with their distinct non-blank values, fewest first."""
    counts = ev.groupBy(*SHOP).agg(*[F.count_distinct(F.when(F.col(b) != "", F.col(b))).alias(b) for b in breakdowns])
    pairs = F.array(*[F.struct(F.lit(b).alias("breakdown"), F.col(b).alias("values")) for b in breakdowns])
    flat = counts.select(*SHOP, F.explode(pairs).alias("p")).select(*SHOP, "p.*")
    return flat.withColumn("position", F.row_number().over(Window.partitionBy(*SHOP).orderBy("values", "breakdown")))


def column_stats(df: DataFrame, column: str, by: list[str], include_zero: bool = False) -> DataFrame:
    """Sum to two decimals, mean, smallest and largest, skipping nulls and NaN; the mean also skips zeros unless told otherwise."""
    v = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    mean = F.avg(v if include_zero else F.when(v != 0, v))
    return df.groupBy(*by).agg(round_to(F.coalesce(F.sum(v), F.lit(0.0)), 2).alias("sum"), round_to(F.coalesce(mean, F.lit(0.0)), 6).alias("average"),
                               F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"))


def drill_down(ev: DataFrame, period: Period, at: datetime, interval: str = "day", events: Sequence[str] = (), breakdown: str | None = None, value: str | None = None) -> DataFrame:
    """Distinct profiles behind one point of a chart."""
    rows = _scope(ev, period, events, None).where(bucket(F.col("created_at"), interval) == F.lit(str(at)).cast("timestamp_ntz"))
    if breakdown:
        rows = rows.where(F.col(breakdown) == value)
    return rows.select(*SHOP, profile_id().alias("profile_id")).distinct()


# --- report library --------------------------------------------------------------------------

# The built-in dashboards. Each report names its chart, range and series; "segment: revenue" sums revenue.
DASHBOARDS = {
    "Executive Overview": {
        "Gross Revenue (GMV)": {"chart": "linear", "metric": "sum", "series": [("purchase", "revenue")]},
        "Conversion Rate Trend": {"chart": "linear", "series": [("purchase", "event")]},
        "Total Sessions & Visitors": {"chart": "bar", "series": [("session_start", "event")]},
        "Average Order Value (AOV)": {"chart": "metric", "metric": "average", "series": [("purchase", "revenue")]},
    },
    "Purchase & Conversion Funnel": {
        "Full Checkout Funnel": {"chart": "funnel", "steps": ("page_view", "view_item", "add_to_cart", "purchase")},
        "Cart Additions vs Purchases": {"chart": "linear", "series": [("add_to_cart", "event"), ("purchase", "event")]},
    },
    "Behavioral ML & Purchase Intent": {
        "High-Propensity Cart Intent Events": {"chart": "linear", "series": [("add_to_cart", "event")]},
        "Active Intent Signals": {"chart": "metric", "series": [("add_to_cart", "event")]},
    },
    "Merchandise & Products": {
        "Top Products by Revenue": {"chart": "bar", "breakdown": "product_id", "series": [("purchase", "revenue")]},
        "Most Viewed Products": {"chart": "bar", "breakdown": "product_id", "series": [("view_item", "event")]},
    },
    "Acquisition & Marketing Channels": {
        "Sessions by Traffic Source": {"chart": "bar", "breakdown": "referrer_name", "series": [("session_start", "event")]},
        "Campaign Revenue Attribution": {"chart": "bar", "breakdown": "properties.utm_campaign", "series": [("purchase", "revenue")]},
    },
}


def run_report(ev: DataFrame, report: dict, as_of: datetime) -> DataFrame:
    """Evaluate a library report over its 30 days. Charts give (series, item, bucket, value); bars and metrics fold the
    buckets; funnels give their steps."""
    from tidemark.operators.funnel import funnel

    period = resolve_period(as_of, "30d")
    if report["chart"] == "funnel":
        return funnel(ev, report["steps"], period)
    out, breakdown = None, report.get("breakdown")
    for i, (name, kind) in enumerate(report["series"]):
        points = report_series(ev, {"name": name, "segment": kind}, period, "day", breakdown)
        if not breakdown:
            points = points.withColumn("item", F.lit(name))
        part = points.select(*SHOP, F.lit("ABCDEFGHIJ"[i]).alias("series"), "item", "bucket", "value")
        out = part if out is None else out.unionByName(part)
    if report["chart"] in ("bar", "metric"):
        return report_metric(out, report.get("metric", "sum"), ["series", "item"])
    return out
