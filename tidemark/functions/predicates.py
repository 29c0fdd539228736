"""Named predicates and filter builders over canonical events.

The overview, trend and chart reports each count "a view" or "an order" by their own rule, so each rule keeps its own name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import ts
from tidemark.schema import SHOP

# Event names with a meaning to the reports.
VIEW_NAMES = ("page_view", "screen_view")
ORDER_NAMES = ("purchase", "order_completed")
CONVERSION_NAMES = ("purchase", "add_to_cart", "cart_view", "checkout_step", "checkout", "subscribe")
LIFECYCLE_NAMES = ("screen_view", "session_start", "session_end")


def trend_view() -> Column:
    return F.col("name") == "page_view"


def overview_view() -> Column:
    return F.col("name").isin(*VIEW_NAMES)


def chart_view() -> Column:
    return overview_view() | ((F.col("path") != "") & (F.col("name") != "session_end"))


def rollup_view() -> Column:
    return F.col("name").isin("view_product", "page_view")


def order_event() -> Column:
    return F.col("name").isin(*ORDER_NAMES)


def purchase_event() -> Column:
    return F.col("name") == "purchase"


def purchase_like() -> Column:
    name = F.lower(F.col("name"))
    return name.contains("purchase") | name.contains("order")


def cart_like() -> Column:
    return F.lower(F.col("name")).contains("cart")


def cart_add() -> Column:
    return F.col("name") == "add_to_cart"


def conversion(names: Sequence[str] = CONVERSION_NAMES) -> Column:
    return (F.coalesce(F.col("revenue"), F.lit(0)) > 0) | F.col("name").isin(*names)


def identified() -> Column:
    return F.col("customer_id").isNotNull()


def profile_id() -> Column:
    """Customer where known, else device."""
    return F.coalesce(F.col("customer_id"), F.col("device_id"))


def is_profile(value: str) -> Column:
    return (F.col("device_id") == value) | F.coalesce(F.col("customer_id") == value, F.lit(False))


def named(names: Sequence[str]) -> Column:
    """Events by name; a lone view name widens to every page-bearing event."""
    if len(names) == 1 and names[0] in VIEW_NAMES:
        return chart_view()
    return F.col("name").isin(*names) if names else F.lit(True)


def or_default(name: str, value: str) -> Column:
    """'' and null become ``value``."""
    col = F.col(name)
    return F.coalesce(F.when(col != "", col), F.lit(value))


def in_scope(tenant, shop, scope: str = "strict") -> Column:
    """Tenancy filter. ``strict``: both ids match. ``lenient``: the shop matches and the tenant
    matches or is missing. ``loose``: either id matches."""
    t, s = F.col("tenant_id") == F.lit(tenant), F.col("shop_id") == F.lit(shop)
    if scope == "lenient":
        return s & (t | F.col("tenant_id").isNull())
    return (t | s) if scope == "loose" else (t & s)


def tenant_of_shop(ev: DataFrame) -> DataFrame:
    """One known tenant per shop."""
    return ev.where(F.col("tenant_id").isNotNull()).groupBy("shop_id").agg(F.min("tenant_id").alias("tenant_id"))


def _like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(text: str, columns: Iterable[str], ignore_case: bool = True) -> Column:
    """Substring in any of the columns; the text is taken literally."""
    pattern = f"%{_like(text)}%"
    tests = [(F.col(c).ilike(pattern) if ignore_case else F.col(c).like(pattern)) for c in columns]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


_CASTS = {"number": "double", "date": "date", "datetime": "timestamp_ntz", "boolean": "boolean", "string": "string"}


def field_filter(col: Column, operator: str, values: Sequence = (), cast: str = "string") -> Column:
    """One filter row: operator, values and the type both sides are compared as.

    Text operators look at the first value only and ignore case. Blank values are dropped; a filter
    left without values matches everything.
    """
    if operator == "isNull":
        return col.isNull() | (col == "")
    if operator == "isNotNull":
        return col.isNotNull() & (col != "")
    values = [v for v in values if v not in ("", None)]
    if not values:
        return F.lit(True)
    if operator in ("is", "isNot"):
        hit = col == F.lit(values[0]) if len(values) == 1 else col.isin(*values)
        return hit if operator == "is" else ~hit
    first = values[0]
    if operator in ("contains", "doesNotContain", "startsWith", "endsWith"):
        text = _like(str(first))
        pattern = {"startsWith": f"{text}%", "endsWith": f"%{text}"}.get(operator, f"%{text}%")
        hit = col.ilike(pattern)
        return ~hit if operator == "doesNotContain" else hit
    if operator == "regex":
        return col.rlike(str(first))
    kind = _CASTS[cast]
    left, right = col.try_cast(kind), F.lit(str(first)).try_cast(kind)
    test = {"gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[operator]
    return F.coalesce(test, F.lit(False))


def all_of(filters: Iterable[Column]) -> Column:
    """Conjunction, e.g. of report-wide filters and a series' own."""
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def in_cohort(df: DataFrame, members: DataFrame, cohort_ids: Sequence[str], key: str = "profile_id", member: bool = True) -> DataFrame:
    """Rows whose profile is (or is not) in any of the cohorts."""
    ids = members.where(F.col("cohort_id").isin(*cohort_ids)).select(*SHOP, key).distinct()
    return df.join(ids, [*SHOP, key], "left_semi" if member else "left_anti")


def at_location(locations: Sequence[dict], detail: str = "coordinate") -> Column:
    """Events at any of the given places.

    ``country`` compares countries; ``city`` and ``merged`` compare country and city, or the country
    alone where no city is given; ``coordinate`` also accepts points within 0.2° of the place.
    """
    tests = []
    for place in locations:
        country, city = place.get("country") or "", place.get("city") or ""
        lat, long = place.get("lat"), place.get("long")
        same_country = F.col("country") == country
        same_city = same_country & (F.col("city") == city)
        if detail == "country":
            test = same_country if country else None
        elif detail == "coordinate" and lat is not None and long is not None:
            near = (F.abs(F.col("latitude") - lat) < 0.2) & (F.abs(F.col("longitude") - long) < 0.2)
            test = same_city | F.coalesce(near, F.lit(False))
        elif country:
            test = same_city if city else same_country
        else:
            test = None
        if test is not None:
            tests.append(test)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def at_exact_location(locations: Sequence[dict]) -> Column:
    """Events whose coordinates equal a place's at four decimals."""
    points = [F.struct(F.lit(round(p["lat"], 4)), F.lit(round(p["long"], 4))) for p in locations]
    return F.struct(F.round("latitude", 4), F.round("longitude", 4)).isin(points)


def since(col: str, as_of, **delta) -> Column:
    from datetime import timedelta

    return F.col(col) >= ts(as_of - timedelta(**delta))
