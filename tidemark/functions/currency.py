"""Currency conversion of integer cents. Rates are units of a currency per US dollar.

Rates come as a dict (a literal expression, no join) or as a ``(currency, rate)`` DataFrame. The
DataFrame is joined without a hint: Spark broadcasts it while its measured size allows and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rates assumed until others are supplied.
DEFAULT_RATES = {"USD": 1.0, "EUR": 0.89, "GBP": 0.77, "BDT": 123.0, "CAD": 1.42, "AUD": 1.44}


def code(col: Column) -> Column:
    return F.upper(F.trim(F.coalesce(col, F.lit(""))))


def merge_rates(updates: dict[str, float], base: dict[str, float] = DEFAULT_RATES) -> dict[str, float]:
    """Upsert: only positive rates count and USD stays 1."""
    merged = dict(base)
    merged.update({k.upper(): float(v) for k, v in updates.items() if v > 0})
    merged["USD"] = 1.0
    return merged


def rates_table(spark: SparkSession, updates: DataFrame | None = None) -> DataFrame:
    """Default rates overlaid with an update table of the same rules."""
    rows = ", ".join(f"('{c}', {r}D)" for c, r in DEFAULT_RATES.items())
    base = spark.sql(f"SELECT * FROM VALUES {rows} AS t(currency, rate)")
    if updates is None:
        return base
    fresh = updates.select(code(F.col("currency")).alias("currency"), F.col("rate").cast("double").alias("rate"))
    fresh = fresh.where((F.col("rate") > 0) & (F.col("currency") != "USD")).groupBy("currency").agg(F.max("rate").alias("rate"))
    return base.join(fresh, "currency", "left_anti").unionByName(fresh)


def rate_of(currency: Column, rates: dict[str, float] = DEFAULT_RATES) -> Column:
    """Rate of a currency column; blank or unknown means 1."""
    expr = F.lit(1.0)
    for name, rate in sorted(rates.items()):
        expr = F.when(code(currency) == name, F.lit(float(rate))).otherwise(expr)
    return expr


def to_usd(cents: Column, currency: Column, rates: dict[str, float] = DEFAULT_RATES) -> Column:
    return F.round(cents / rate_of(currency, rates)).cast("bigint")


def from_usd(cents: Column, currency: Column | str, rates: dict[str, float] = DEFAULT_RATES) -> Column:
    if isinstance(currency, str):
        target = currency.strip().upper()
        if target in ("", "USD"):
            return cents.cast("bigint")
        currency = F.lit(target)
    return F.round(cents * rate_of(currency, rates)).cast("bigint")


def convert(cents: Column, source: Column, target: Column, rates: dict[str, float] = DEFAULT_RATES) -> Column:
    """Any currency to any other with a single rounding."""
    return F.round(convert_amount(cents.cast("double"), source, target, rates)).cast("bigint")


def convert_amount(amount: Column, source: Column, target: Column, rates: dict[str, float] = DEFAULT_RATES) -> Column:
    """As :func:`convert` for decimal amounts, without rounding."""
    same = F.coalesce(F.nullif(code(source), F.lit("")), F.lit("USD")) == F.coalesce(F.nullif(code(target), F.lit("")), F.lit("USD"))
    return F.when(same, amount).otherwise(amount / rate_of(source, rates) * rate_of(target, rates))


def join_rates(df: DataFrame, rates: DataFrame, currency: str = "currency", name: str = "rate") -> DataFrame:
    """Add the rate of each row's currency; 1 where unknown."""
    table = rates.select(code(F.col("currency")).alias("_code"), F.col("rate").alias(name))
    out = df.withColumn("_code", code(F.col(currency))).join(table, "_code", "left").drop("_code")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(1.0)))
