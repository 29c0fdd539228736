"""Propensity scores: logistic models as column expressions, tiers, explanations, training and evaluation."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.currency import convert, from_usd
from tidemark.functions.numbers import fixed, round_to, safe_ratio
from tidemark.functions.timeutil import ts
from tidemark.operators.traffic import top_k
from tidemark.schema import DEVICE, SHOP

# Calibrated coefficients of the three models.
INTENT = {"bias": -2.85, "views_count": 0.12, "cart_adds_count": 1.95, "distinct_products": -0.15, "dwell_time_seconds": 0.0035}
CHURN = {"bias": 1.15, "views_count": -0.08, "cart_adds_count": -2.10, "distinct_products": 0.05, "dwell_time_seconds": -0.005, "avg_scroll_depth": -1.85}
PRICE = {"bias": -1.65, "views_count": 0.05, "sale_view_ratio": 3.85, "distinct_products": 0.18, "dwell_time_seconds": 0.002, "cart_adds_count": 0.35}
MODELS = {"intent": INTENT, "churn_risk": CHURN, "price_sensitivity": PRICE}

# Score tiers of the models and of the radar, highest threshold first, with the label below all of them last.
MODEL_TIERS = {
    "intent": ((0.85, "HIGH INTENT"), (0.65, "CONSIDERING"), (0.30, "EXPLORING"), "CASUAL"),
    "churn_risk": ((0.80, "HIGH CHURN RISK"), (0.60, "ELEVATED RISK"), "ENGAGED"),
    "price_sensitivity": ((0.85, "PRICE SENSITIVE (HUNTER)"), (0.65, "MODERATE SENSITIVITY"), "VALUE INSENSITIVE (PREMIUM)"),
}
RADAR_TIERS = {
    "intent": ((0.85, "HIGH INTENT"), (0.50, "CONSIDERING"), "CASUAL"),
    "churn_risk": ((0.60, "HIGH CHURN RISK"), (0.35, "ELEVATED RISK"), "ENGAGED"),
    "price_sensitivity": ((0.70, "PRICE HUNTER"), (0.40, "MODERATE"), "VALUE INSENSITIVE"),
}


def logit(weights: dict[str, float], features: dict[str, Column]) -> Column:
    """bias + Σ weight × feature; features the model has but the row lacks count 0."""
    terms = [F.lit(w) * features[name] for name, w in weights.items() if name != "bias" and name in features]
    return reduce(lambda a, b: a + b, terms, F.lit(weights.get("bias", 0.0)))


def sigmoid(z: Column) -> Column:
    """Stable on both sides of zero."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def tier(score: Column, levels: tuple) -> Column:
    out = F.lit(levels[-1])
    for threshold, label in reversed(levels[:-1]):
        out = F.when(score >= threshold, F.lit(label)).otherwise(out)
    return out


def _live(scroll: float, sale: float) -> dict[str, Column]:
    return {"views_count": F.col("views"), "cart_adds_count": F.col("carts"), "distinct_products": F.col("distinct_products"),
            "dwell_time_seconds": F.col("dwell_seconds"), "avg_scroll_depth": F.lit(scroll), "sale_view_ratio": F.lit(sale)}


def stream_scores(feats: DataFrame) -> DataFrame:
    """The three scores of live features, to four decimals, with the high-intent and abandon-risk triggers. The stream
    does not measure scrolling or sale views, so both are assumed."""
    x = _live(0.70, 0.25)
    raw = feats.withColumn("_i", sigmoid(logit(INTENT, x))).withColumn("_c", sigmoid(logit(CHURN, x))).withColumn("_p", sigmoid(logit(PRICE, x)))
    return raw.select("*", round_to(F.col("_i"), 4).alias("intent"), round_to(F.col("_c"), 4).alias("churn_risk"), round_to(F.col("_p"), 4).alias("price_sensitivity"),
                      (F.col("_i") >= 0.85).alias("high_intent"), ((F.col("_c") >= 0.60) & (F.col("carts") > 0)).alias("abandon_risk")).drop("_i", "_c", "_p")


def rescore(feats: DataFrame) -> DataFrame:
    """Batch rescoring of live shoppers with the batch job's own assumptions."""
    x = _live(0.65, 0.20)
    x["views_count"] = F.coalesce("views", F.lit(1))
    x["distinct_products"] = F.greatest(F.lit(1), F.col("distinct_products"))
    x["dwell_time_seconds"] = F.greatest(F.lit(0.0), (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 1e6)
    out = feats
    for name, weights in MODELS.items():
        out = out.withColumn(name, round_to(sigmoid(logit(weights, x)), 4))
    return out.withColumn("high_intent", F.col("intent") >= 0.85)


def alerts(scored: DataFrame) -> DataFrame:
    """One row per raised trigger, valid for 15 minutes after the last event."""
    kinds = F.array(F.when(F.col("high_intent"), F.lit("high_intent")), F.when(F.col("abandon_risk"), F.lit("abandon_risk")))
    return scored.select(*DEVICE, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("alert"), F.col("last_seen").alias("raised_at"),
                         (F.col("last_seen") + F.expr("INTERVAL 15 MINUTE")).alias("expires_at"))


def score_all(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Scores and tiers of all models. ``columns`` maps model features to columns; the mapping is explicit because stored
    data and models name dwell time differently."""
    x = {feature: F.col(column).cast("double") for feature, column in columns.items()}
    out = rows
    for name, weights in MODELS.items():
        score = sigmoid(logit(weights, x))
        out = out.withColumn(name, round_to(score, 4)).withColumn(f"{name}_tier", tier(score, MODEL_TIERS[name]))
    return out


def explain(rows: DataFrame, model: str, columns: dict[str, str], k: int = 3) -> DataFrame:
    """The k features that move each row's score most: value, weight, impact and direction."""
    parts = []
    for i, (name, w) in enumerate((n, w) for n, w in MODELS[model].items() if n != "bias"):
        value = F.col(columns[name]).cast("double") if name in columns else F.lit(0.0)
        effect = F.lit(w) * value
        parts.append(F.struct((-F.abs(round_to(effect, 4))).alias("_o"), F.lit(i).alias("_i"), F.lit(name).alias("feature"), value.alias("input_value"), F.lit(w).alias("weight"),
                              round_to(effect, 4).alias("impact"), F.when(effect > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction")))
    best = F.slice(F.array_sort(F.array(*parts)), 1, k)
    keys = [c for c in (*DEVICE, "session_id") if c in rows.columns]
    return rows.select(*keys, F.posexplode(best).alias("rank", "x")).select(*keys, (F.col("rank") + 1).alias("rank"), "x.feature", "x.input_value", "x.weight", "x.impact", "x.direction")


# --- training --------------------------------------------------------------------------------

def train(rows: DataFrame, label: str, columns: dict[str, str], standardise: bool = False, places: int | None = 5) -> dict[str, float]:
    """Balanced, L2-regularised logistic regression with unit penalty per sample. ``standardise`` penalises the coefficients of features scaled
    to unit variance instead of those of the features as they are; the coefficients returned always fit the unscaled features and are rounded to ``places``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = list(columns)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")).first()
    n, pos = counts["n"], counts["p"] or 0
    if pos in (0, n):
        raise ValueError(f"{label} has one class only")
    balance = F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    data = rows.select(F.col(label).cast("double").alias("label"), balance.alias("weight"), *[F.col(c).cast("double").alias(f) for f, c in columns.items()])
    # Every step of the fit sends something from each partition to the driver, so their number follows the cores, not the input.
    data = VectorAssembler(inputCols=names, outputCol="features").transform(data).coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    model = LogisticRegression(weightCol="weight", maxIter=500, regParam=1.0 / n, standardization=standardise).fit(data)
    return {"bias": float(model.intercept), **{f: float(w) if places is None else round(float(w), places) for f, w in zip(names, model.coefficients)}}


def stationarity(rows: DataFrame, label: str, columns: dict[str, str], weights: dict[str, float]) -> dict[str, float]:
    """Slope of the loss that :func:`train` minimises in each coefficient, as a share of the mean size of its feature; about 0 at the minimum."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")).first()
    n, pos = counts["n"], counts["p"]
    balance = F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    x = {f: F.col(c).cast("double") for f, c in columns.items()}
    miss = balance * (sigmoid(logit(weights, x)) - F.col(label).cast("double"))
    parts = {"bias": F.lit(1.0), **x}
    sums = rows.agg(*[F.sum(miss * v).alias(f) for f, v in parts.items()], *[F.sum(balance * F.abs(v)).alias(f"_{f}") for f, v in parts.items()]).first()
    return {f: (sums[f] + (0.0 if f == "bias" else weights[f])) / max(sums[f"_{f}"], 1e-12) for f in parts}


def evaluate(rows: DataFrame, label: str, weights: dict[str, float], columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Confusion matrix at 0.5 with accuracy, precision, recall and F1 to four decimals."""
    x = {f: F.col(c).cast("double") for f, c in columns.items()}
    hit = sigmoid(logit(weights, x)) >= 0.5
    yes = F.col(label) == 1
    out = rows.groupBy(*(by or [])).agg(
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(~hit & yes).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    precision, recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("*", round_to(safe_ratio(F.col("tp") + F.col("tn"), n), 4).alias("accuracy"), round_to(precision, 4).alias("precision"), round_to(recall, 4).alias("recall"),
                      round_to(2 * precision * recall / F.greatest(F.lit(1e-6), precision + recall), 4).alias("f1_score"))


def retrain(rows: DataFrame, columns: dict[str, str], path: str) -> dict[str, dict]:
    """Train intent and churn, keep the price constants, evaluate, and write all weights as JSON."""
    spark = rows.sparkSession
    fitted = {"intent": train(rows, "has_purchase", {f: c for f, c in columns.items() if f in INTENT}),
              "churn_risk": train(rows, "has_churned", {f: c for f, c in columns.items() if f in CHURN}), "price_sensitivity": PRICE}
    report = {}
    for name, label in (("intent", "has_purchase"), ("churn_risk", "has_churned")):
        report[name] = evaluate(rows, label, fitted[name], columns).first().asDict()
    out = [(name, json.dumps({"model": name, "coefficients": w, "metrics": report.get(name)})) for name, w in fitted.items()]
    spark.createDataFrame(out, "model string, value string").write.mode("overwrite").partitionBy("model").text(path)
    return {name: {"coefficients": w, "metrics": report.get(name)} for name, w in fitted.items()}


# --- radar -----------------------------------------------------------------------------------

def _tiers(df: DataFrame) -> DataFrame:
    for name, levels in RADAR_TIERS.items():
        df = df.withColumn(f"{name}_tier", tier(F.col(name), levels))
    return df.withColumn("status", tier(F.col("intent"), (*RADAR_TIERS["intent"][:-1], "EXPLORING")))


def _signals(currency: str) -> Column:
    n = lambda c: F.col(c).cast("string")
    cart = F.concat(F.lit("Active Cart ("), fixed(F.col("cart_value") / 100.0, 2), F.lit(f" {currency} • "), n("carts"), F.lit(" items), "), F.col("intent_tier"))
    keen = F.concat(F.lit("High purchase propensity ("), fixed(F.col("intent") * 100, 1), F.lit("%), "), n("carts"), F.lit(" items in cart"))
    plain = F.concat(n("views"), F.lit(" views, "), n("carts"), F.lit(" in cart, "), n("dwell_seconds"), F.lit("s dwell"))
    return F.when(F.col("cart_id").isNotNull() & (F.col("carts") > 0), cart).when(F.col("intent") >= 0.85, keen).otherwise(plain)


_RADAR = [*DEVICE, "session_id", "customer_id", "cart_id", "cart_value", "views", "carts", "dwell_seconds", "country", "city", "os", "browser", "device", "path",
          "intent", "churn_risk", "price_sensitivity"]


def radar_live(feats: DataFrame, as_of: datetime, currency: str = "USD") -> DataFrame:
    """Shoppers whose scores, which last 30 minutes, are still valid. Carts hold dollars where known, else their own currency."""
    scored = stream_scores(feats.where(F.col("last_seen").between(ts(as_of - timedelta(minutes=30)), ts(as_of))))
    value = F.when(F.col("cart_value_usd") > 0, from_usd(F.col("cart_value_usd"), currency)).when(
        F.col("cart_value") > 0, convert(F.col("cart_value"), F.coalesce("cart_currency", F.lit(currency)), F.lit(currency))).otherwise(F.lit(0)).cast("bigint")
    return scored.withColumn("cart_value", value).withColumn("device", F.coalesce("device", F.lit("Desktop"))).withColumn(
        "browser", F.coalesce("browser", F.lit("Chrome"))).withColumn("os", F.coalesce("os", F.lit("macOS"))).select(*_RADAR)


def radar_stored(stored: DataFrame, ev: DataFrame, k: int = 12, currency: str = "USD") -> DataFrame:
    """The latest stored sessions with what their events say. Events are reduced to one row per session before the join.
    Churn and price scores are rules of thumb on stored rows."""
    latest = top_k(stored, SHOP, [F.desc("last_event_at"), F.col("device_id"), F.col("session_id")], k)
    dims = ["country", "city", "browser", "os", "device", "path"]
    known = ev.groupBy(*SHOP, "session_id").agg(
        F.min(F.when(F.col("customer_id").isNotNull(), F.struct("created_at", "id", "customer_id")))["customer_id"].alias("customer_id"),
        F.min(F.when(F.col("cart_id").isNotNull(), F.struct("created_at", "id", "cart_id")))["cart_id"].alias("cart_id"),
        F.min(F.struct("created_at", "id", *dims)).alias("_f"),
        F.coalesce(F.sum(F.when(F.col("name") == "add_to_cart", F.col("revenue_usd"))), F.lit(0)).alias("_usd"))
    rows = latest.join(known, [*SHOP, "session_id"], "left")
    cheap = F.lower(F.coalesce("_f.path", F.lit("/")))
    carts, views, intent = F.col("cart_adds_count"), F.col("views_count"), F.col("cart_intent_score")
    churn = F.when((carts > 0) & (intent < 0.5), 0.72).when((views <= 2) & (carts == 0), 0.85).otherwise(0.20)
    price = F.when(cheap.contains("sale") | cheap.contains("discount"), 0.82).otherwise(0.35)
    shown = {"device": "Desktop", "path": "/"}
    return rows.select(
        *DEVICE, "session_id", "customer_id", "cart_id", from_usd(F.coalesce("_usd", F.lit(0)), currency).alias("cart_value"), views.alias("views"), carts.alias("carts"),
        F.col("total_dwell_seconds").alias("dwell_seconds"), *[F.coalesce(f"_f.{d}", F.lit(shown.get(d, ""))).alias(d) for d in ("country", "city", "os", "browser", "device", "path")],
        intent.alias("intent"), churn.alias("churn_risk"), price.alias("price_sensitivity"))


def radar(live: DataFrame, stored: DataFrame, replay: DataFrame | None = None, currency: str = "USD", enough: int = 8) -> DataFrame:
    """Live shoppers, and stored sessions where a shop has fewer than ``enough``; a session appears once, live first."""
    n = live.groupBy(*SHOP).agg(F.count(F.lit(1)).alias("_n"))
    extra = stored.join(n.where(F.col("_n") >= enough), SHOP, "left_anti").join(live.select(*SHOP, "session_id"), [*SHOP, "session_id"], "left_anti")
    rows = _tiers(live.withColumn("source", F.lit("live")).unionByName(extra.withColumn("source", F.lit("stored"))))
    out = (rows.withColumn("signals", _signals(currency)).withColumn("profile_id", F.coalesce("customer_id", "device_id"))
           .withColumn("is_identified", F.col("customer_id").isNotNull()).withColumn("currency", F.lit(currency)))
    if replay is None:
        return out.withColumn("has_replay", F.lit(False))
    have = replay.select(*SHOP, "session_id").distinct().withColumn("has_replay", F.lit(True))
    return out.join(have, [*SHOP, "session_id"], "left").withColumn("has_replay", F.coalesce("has_replay", F.lit(False)))
