"""Shopper features, scores and the intent radar."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.operators import features as B
from tidemark.operators import scoring as S
from tidemark.plans.registry import AS_OF, TIMEOUT, query, sql
from tidemark.sources.tables import training_extract

_DIMS = ["session_id", "customer_id", "currency", "country", "city", "path", "device", "browser", "os"]
_LAST = ", ".join(f"last({c} ORDER BY created_at, id) FILTER ({c} IS NOT NULL AND {c} <> '') AS {'cart_currency' if c == 'currency' else c}" for c in _DIMS)


def _feat(ttl=TIMEOUT):
    """State, product-set and cart CTEs; states lapse like sessions, so their start is the session start."""
    return f"""
fe AS (SELECT *, CASE WHEN name = 'add_to_cart' THEN 'cart-' || (product_id % 5) END AS cart_id FROM evs),
fb AS (SELECT tenant_id, shop_id, device_id, session_start AS state_start, min(created_at) AS first_seen, max(created_at) AS last_seen,
  count(*) FILTER (name IN ('page_view', 'view_product')) AS views, max(ROW(created_at, id)) FILTER (name IN ('purchase', 'order_completed')) AS ordered,
  last(name ORDER BY created_at, id) = 'purchase' AS has_purchase, {_LAST} FROM fe GROUP BY tenant_id, shop_id, device_id, session_start),
fc AS (SELECT tenant_id, shop_id, device_id, state_start, count(*) AS carts, cast(sum(revenue_usd) AS bigint) AS cart_value_usd, cast(sum(revenue) AS bigint) AS cart_value,
  last(cart_id ORDER BY created_at, id) AS cart_id FROM (SELECT *, session_start AS state_start FROM fe)
  JOIN (SELECT tenant_id, shop_id, device_id, state_start, ordered FROM fb) USING (tenant_id, shop_id, device_id, state_start)
  WHERE name = 'add_to_cart' AND (ordered IS NULL OR ROW(created_at, id) > ordered) GROUP BY ALL),
pv AS (SELECT *, sum(CASE WHEN created_at - p <= INTERVAL {ttl} SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY shop_id, device_id ORDER BY created_at, id) AS g FROM (
  SELECT *, lag(created_at) OVER (PARTITION BY shop_id, device_id ORDER BY created_at, id) AS p FROM fe WHERE name IN ('page_view', 'view_product'))),
ps AS (SELECT shop_id, device_id, session_start AS state_start, arg_max(n, g) AS n, arg_max(viewed, g) AS viewed FROM (
  SELECT shop_id, device_id, session_start, g, count(DISTINCT product_id) AS n, max(created_at) AS viewed FROM pv GROUP BY ALL) GROUP BY ALL),
ft AS (SELECT fb.tenant_id, fb.shop_id, fb.device_id, fb.state_start, first_seen, last_seen, cast(floor((epoch_us(last_seen) - epoch_us(first_seen)) / 1000000) AS bigint) AS dwell_seconds, views,
  coalesce(carts, 0) AS carts, coalesce(cart_value_usd, 0) AS cart_value_usd, coalesce(cart_value, 0) AS cart_value, cart_id,
  CASE WHEN last_seen - viewed <= INTERVAL {ttl} SECOND THEN n ELSE 1 END AS distinct_products, has_purchase,
  {', '.join('cart_currency' if c == 'currency' else c for c in _DIMS)}
  FROM fb LEFT JOIN fc USING (tenant_id, shop_id, device_id, state_start) LEFT JOIN ps USING (shop_id, device_id, state_start))"""


def _sig(z):
    return f"round(1 / (1 + exp(-({z}))) * 10000) / 10000"


_ZI = "-2.85::double + 0.12::double * views + 1.95::double * carts - 0.15::double * distinct_products + 0.0035::double * dwell_seconds"
_ZC = "1.15::double - 0.08::double * views - 2.1::double * carts + 0.05::double * distinct_products - 0.005::double * dwell_seconds - 1.85::double * {scroll}"
_ZP = "-1.65::double + 0.05::double * views + 3.85::double * {sale} + 0.18::double * distinct_products + 0.002::double * dwell_seconds + 0.35::double * carts"
_SCORED = f"""sc AS (SELECT *, {_sig(_ZI)} AS intent, {_sig(_ZC.format(scroll='0.7'))} AS churn_risk, {_sig(_ZP.format(sale='0.25'))} AS price_sensitivity,
  1 / (1 + exp(-({_ZI}))) >= 0.85 AS high_intent, 1 / (1 + exp(-({_ZC.format(scroll='0.7')}))) >= 0.6 AND carts > 0 AS abandon_risk FROM ft)"""
_STORED = """st AS (SELECT tenant_id, shop_id, device_id, session_id, views AS views_count, carts AS cart_adds_count, distinct_products, dwell_seconds AS total_dwell_seconds,
  has_purchase::int AS has_purchase, intent AS cart_intent_score, last_seen AS last_event_at FROM sc)"""


def _events(t):
    return t.evs.withColumn("cart_id", F.when(F.col("name") == "add_to_cart", F.concat(F.lit("cart-"), (F.col("product_id") % 5).cast("string"))))


def _features(t):
    return B.features(_events(t), TIMEOUT)


query("shopper_features", sql("SELECT * FROM ft", _feat()))(_features)
query("shopper_features_default_ttl", sql("SELECT * FROM ft", _feat(2700), timeout=2700))(
    lambda t: B.features(_sessions_at(t, 2700), 2700))


def _sessions_at(t, timeout):
    from tidemark.operators.sessions import sessionize

    ev = sessionize(t.ev, timeout)
    return ev.withColumn("cart_id", F.when(F.col("name") == "add_to_cart", F.concat(F.lit("cart-"), (F.col("product_id") % 5).cast("string"))))


@query("shopper_features_latest", sql("SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id, device_id ORDER BY last_seen DESC) = 1", _feat()))
def _(t):
    return B.latest_features(_features(t))


query("shopper_scores", sql("SELECT * FROM sc", _feat(), _SCORED))(lambda t: S.stream_scores(_features(t)))


@query("shopper_alerts", sql("""SELECT tenant_id, shop_id, device_id, 'high_intent' AS alert, last_seen AS raised_at, last_seen + INTERVAL 15 MINUTE AS expires_at FROM sc WHERE high_intent
UNION ALL SELECT tenant_id, shop_id, device_id, 'abandon_risk', last_seen, last_seen + INTERVAL 15 MINUTE FROM sc WHERE abandon_risk""", _feat(), _SCORED))
def _(t):
    return S.alerts(S.stream_scores(_features(t)))


@query("shopper_rescore", sql(f"""SELECT *, intent >= 0.85 AS high_intent FROM (SELECT tenant_id, shop_id, device_id, state_start, {_sig(_ZI.replace('dwell_seconds', 'd'))} AS intent,
  {_sig(_ZC.format(scroll='0.65').replace('dwell_seconds', 'd'))} AS churn_risk, {_sig(_ZP.format(sale='0.2').replace('dwell_seconds', 'd'))} AS price_sensitivity
  FROM (SELECT *, (epoch_us(last_seen) - epoch_us(first_seen)) / 1000000.0::double AS d FROM ft))""", _feat()))
def _(t):
    return S.rescore(_features(t)).select("tenant_id", "shop_id", "device_id", "state_start", "intent", "churn_risk", "price_sensitivity", "high_intent")


query("feature_table", sql("SELECT * FROM st", _feat(), _SCORED, _STORED))(lambda t: B.stored_features(_features(t)))
query("feature_training_extract", sql("SELECT * FROM st ORDER BY last_event_at DESC LIMIT 20000", _feat(), _SCORED, _STORED))(
    lambda t: training_extract(B.stored_features(_features(t))))

_TRAIN = """tr AS (SELECT tenant_id, shop_id, device_id, CASE WHEN has_purchase = 1 THEN 'decisive_buyer' WHEN cart_adds_count > 0 THEN 'cart_abandoner' ELSE 'casual_explorer' END AS archetype,
  views_count, cart_adds_count, 0 AS cart_removes_count, CASE WHEN cart_adds_count > 0 OR has_purchase = 1 THEN 1 ELSE 0 END AS checkout_starts_count, distinct_products, 1 AS distinct_categories,
  total_dwell_seconds, CASE has_purchase WHEN 1 THEN 0.75 ELSE 0.45 END::double AS avg_scroll_depth, views_count * 3 AS clicks_count, 0 AS sale_item_views,
  CASE WHEN cart_adds_count > 0 THEN 45.0 ELSE 0.0 END::double AS cart_velocity_seconds, 'desktop' AS device_type, 'organic_search' AS traffic_channel, has_purchase,
  CASE WHEN cart_adds_count > 0 AND has_purchase = 0 THEN 1 ELSE 0 END AS has_cart_abandoned, CASE WHEN views_count <= 2 AND cart_adds_count = 0 THEN 1 ELSE 0 END AS has_churned, 0 AS is_price_sensitive FROM st)"""
_PRE = (_feat(), _SCORED, _STORED, _TRAIN)


def _training(t):
    return B.training_rows(B.stored_features(_features(t)))


query("training_rows", sql("SELECT * FROM tr", *_PRE))(_training)


def _r(x, p):
    return f"round(({x}) * 1e{p}::double) / 1e{p}::double"


@query("feature_matrix", sql(f"""SELECT tenant_id, shop_id, device_id, has_purchase, has_churned, is_price_sensitive, views_count::double AS views_count, cart_adds_count::double AS cart_adds_count,
  distinct_products::double AS distinct_products, 1.0::double AS distinct_categories, total_dwell_seconds::double AS total_dwell_seconds, avg_scroll_depth, cart_velocity_seconds,
  cart_adds_count::double AS cart_net, {_r('total_dwell_seconds::double / greatest(1, views_count)', 2)} AS dwell_per_view, {_r('cart_adds_count::double / greatest(1, views_count)', 4)} AS cart_conversion_ratio,
  {_r('distinct_products::double / greatest(1, views_count)', 4)} AS catalog_scatter_ratio, 1.0::double AS category_focus_index,
  {_r('clicks_count::double / greatest(1, total_dwell_seconds) * 60', 2)} AS clicks_per_minute, 0.0::double AS sale_view_ratio, 0.0::double AS is_mobile FROM tr""", *_PRE))
def _(t):
    return B.feature_matrix(_training(t))


_COLUMNS = {"views_count": "views_count", "cart_adds_count": "cart_adds_count", "distinct_products": "distinct_products", "dwell_time_seconds": "total_dwell_seconds",
            "avg_scroll_depth": "avg_scroll_depth", "sale_view_ratio": "sale_view_ratio"}


def _tr(z):
    return z.replace("views", "views_count").replace("carts", "cart_adds_count").replace("dwell_seconds", "total_dwell_seconds")


_ALLZ = {"intent": _tr(_ZI), "churn_risk": _tr(_ZC.format(scroll="avg_scroll_depth")), "price_sensitivity": _tr(_ZP.format(sale="0"))}
_CASES = {"intent": "CASE WHEN {s} >= 0.85 THEN 'HIGH INTENT' WHEN {s} >= 0.65 THEN 'CONSIDERING' WHEN {s} >= 0.3 THEN 'EXPLORING' ELSE 'CASUAL' END",
          "churn_risk": "CASE WHEN {s} >= 0.8 THEN 'HIGH CHURN RISK' WHEN {s} >= 0.6 THEN 'ELEVATED RISK' ELSE 'ENGAGED' END",
          "price_sensitivity": "CASE WHEN {s} >= 0.85 THEN 'PRICE SENSITIVE (HUNTER)' WHEN {s} >= 0.65 THEN 'MODERATE SENSITIVITY' ELSE 'VALUE INSENSITIVE (PREMIUM)' END"}


@query("model_scores", sql("SELECT tenant_id, shop_id, device_id, views_count, total_dwell_seconds, " + ", ".join(
    f"{_sig(z)} AS {n}, {_CASES[n].format(s=f'(1 / (1 + exp(-({z}))))')} AS {n}_tier" for n, z in _ALLZ.items()) + " FROM tr", *_PRE))
def _(t):
    rows = B.feature_matrix(_training(t)).select("tenant_id", "shop_id", "device_id", *sorted(set(_COLUMNS.values())))
    return S.score_all(rows, _COLUMNS).select("tenant_id", "shop_id", "device_id", F.col("views_count").cast("bigint").alias("views_count"),
                                              F.col("total_dwell_seconds").cast("bigint").alias("total_dwell_seconds"),
                                              *[c for n in _ALLZ for c in (n, f"{n}_tier")])


@query("model_explanations", sql("""SELECT tenant_id, shop_id, device_id, session_id, cast(rank AS int) AS rank, feature, input_value, weight, impact, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, shop_id, device_id, session_id, last_event_at ORDER BY abs(impact) DESC, i) AS rank FROM (
    SELECT *, round(weight * input_value * 10000) / 10000 AS impact, CASE WHEN weight * input_value > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (
      SELECT tenant_id, shop_id, device_id, session_id, last_event_at, 0 AS i, 'views_count' AS feature, views_count::double AS input_value, 0.12::double AS weight FROM st UNION ALL
      SELECT tenant_id, shop_id, device_id, session_id, last_event_at, 1, 'cart_adds_count', cart_adds_count::double, 1.95::double FROM st UNION ALL
      SELECT tenant_id, shop_id, device_id, session_id, last_event_at, 2, 'distinct_products', distinct_products::double, -0.15::double FROM st UNION ALL
      SELECT tenant_id, shop_id, device_id, session_id, last_event_at, 3, 'dwell_time_seconds', total_dwell_seconds::double, 0.0035::double FROM st))) WHERE rank <= 3""", *_PRE))
def _(t):
    return S.explain(B.stored_features(_features(t)), "intent", _COLUMNS)


@query("model_evaluation", sql(f"""SELECT *, round((tp + tn)::double / (tp + fp + tn + fn)::double * 10000) / 10000 AS accuracy, round(p * 10000) / 10000 AS precision, round(r * 10000) / 10000 AS recall,
  round(2 * p * r / greatest(1e-6::double, p + r) * 10000) / 10000 AS f1_score FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::double / (tp + fp)::double END AS p,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::double / (tp + fn)::double END AS r FROM (SELECT tenant_id, shop_id, count(*) FILTER (h AND has_churned = 1) AS tp, count(*) FILTER (h AND has_churned = 0) AS fp,
  count(*) FILTER (NOT h AND has_churned = 0) AS tn, count(*) FILTER (NOT h AND has_churned = 1) AS fn FROM (SELECT *, 1 / (1 + exp(-({_ALLZ['churn_risk']}))) >= 0.5 AS h FROM tr) GROUP BY ALL))""", *_PRE)
       .replace("SELECT *, round((tp + tn)", "SELECT * EXCLUDE (p, r), round((tp + tn)"))
def _(t):
    return S.evaluate(_training(t), "has_churned", S.CHURN, {k: v for k, v in _COLUMNS.items() if k in S.CHURN}, ["tenant_id", "shop_id"])


_FITTED = [(model, f) for model, weights in (("intent", S.INTENT), ("churn_risk", S.CHURN)) for f in ("bias", *(c for c in _COLUMNS if c in weights))]


@query("model_training", "SELECT model, feature, true AS at_minimum FROM (VALUES " + ", ".join(f"('{m}', '{f}')" for m, f in _FITTED) + ") v(model, feature)")
def _(t):
    """Whether the loss is level at the fitted weights."""
    rows = _training(t).cache()
    flat = []
    for model, label, known in (("intent", "has_purchase", S.INTENT), ("churn_risk", "has_churned", S.CHURN)):
        columns = {k: v for k, v in _COLUMNS.items() if k in known}
        slopes = S.stationarity(rows, label, columns, S.train(rows, label, columns, places=None))
        flat += [(model, f, abs(s) < 0.01) for f, s in slopes.items()]
    rows.unpersist()
    return t.spark.createDataFrame(flat, "model string, feature string, at_minimum boolean")


# --- radar: the clock stands at a busy instant, so both live and stored rows appear ---

_NOW = AS_OF - timedelta(hours=6)
_TIER = "CASE WHEN {c} >= {a} THEN '{x}' WHEN {c} >= {b} THEN '{y}' ELSE '{z}' END"
_RCOLS = ("tenant_id, shop_id, device_id, session_id, customer_id, cart_id, cart_value, views, carts, dwell_seconds, country, city, os, browser, device, path, intent, churn_risk, price_sensitivity")
_RATES = "CASE cart_currency WHEN 'USD' THEN 1.0 WHEN 'GBP' THEN 0.77 WHEN 'BDT' THEN 123.0 ELSE 0.89 END::double"


@query("intent_radar", sql(f"""SELECT a.*, coalesce(customer_id, device_id) AS profile_id, customer_id IS NOT NULL AS is_identified, 'EUR' AS currency, r.session_id IS NOT NULL AS has_replay,
  CASE WHEN cart_id IS NOT NULL AND carts > 0 THEN printf('Active Cart (%.2f EUR • %d items), ', cart_value / 100.0::double, carts) || intent_tier
    WHEN intent >= 0.85 THEN printf('High purchase propensity (%.1f%%), %d items in cart', intent * 100, carts) ELSE printf('%d views, %d in cart, %ds dwell', views, carts, dwell_seconds) END AS signals
FROM (SELECT *, {_TIER.format(c='intent', a=0.85, b=0.5, x='HIGH INTENT', y='CONSIDERING', z='CASUAL')} AS intent_tier, {_TIER.format(c='intent', a=0.85, b=0.5, x='HIGH INTENT', y='CONSIDERING', z='EXPLORING')} AS status,
  {_TIER.format(c='churn_risk', a=0.6, b=0.35, x='HIGH CHURN RISK', y='ELEVATED RISK', z='ENGAGED')} AS churn_risk_tier,
  {_TIER.format(c='price_sensitivity', a=0.7, b=0.4, x='PRICE HUNTER', y='MODERATE', z='VALUE INSENSITIVE')} AS price_sensitivity_tier
  FROM (SELECT *, 'live' AS source FROM live UNION ALL SELECT *, 'stored' FROM old WHERE (tenant_id, shop_id) NOT IN (SELECT (tenant_id, shop_id) FROM live GROUP BY tenant_id, shop_id HAVING count(*) >= 8)
    AND session_id NOT IN (SELECT session_id FROM live))) a LEFT JOIN (SELECT DISTINCT session_id FROM evs WHERE name = 'error') r USING (session_id)""", *_PRE,
    f"""live AS (SELECT {_RCOLS.replace('cart_value,', "CASE WHEN cart_value_usd > 0 THEN cast(round(cart_value_usd * 0.89::double) AS bigint) WHEN cart_value > 0 THEN cast(round(cart_value / " + _RATES + " * 0.89::double) AS bigint) ELSE 0 END AS cart_value,").replace('device,', "coalesce(device, 'Desktop') AS device,")}
      FROM sc WHERE last_seen BETWEEN TIMESTAMP '2024-01-30 17:30:00' AND TIMESTAMP '2024-01-30 18:00:00')""",
    f"""old AS (SELECT tenant_id, shop_id, device_id, session_id, k.customer_id, k.cart_id, cast(round(usd * 0.89::double) AS bigint) AS cart_value, views_count AS views, cart_adds_count AS carts, total_dwell_seconds AS dwell_seconds,
      k.country, k.city, k.os, k.browser, k.device, k.path, cart_intent_score AS intent, CASE WHEN cart_adds_count > 0 AND cart_intent_score < 0.5 THEN 0.72 WHEN views_count <= 2 AND cart_adds_count = 0 THEN 0.85 ELSE 0.2 END::double AS churn_risk,
      CASE WHEN lower(k.path) LIKE '%sale%' OR lower(k.path) LIKE '%discount%' THEN 0.82 ELSE 0.35 END::double AS price_sensitivity
      FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY tenant_id, shop_id ORDER BY last_event_at DESC, device_id, session_id) <= 12) s
      LEFT JOIN (SELECT tenant_id, shop_id, session_id, first(customer_id ORDER BY created_at, id) FILTER (customer_id IS NOT NULL) AS customer_id, first(cart_id ORDER BY created_at, id) FILTER (cart_id IS NOT NULL) AS cart_id,
        {', '.join(f'first({d} ORDER BY created_at, id) AS {d}' for d in ('country', 'city', 'os', 'browser', 'device', 'path'))}, coalesce(sum(revenue_usd) FILTER (name = 'add_to_cart'), 0) AS usd
        FROM fe GROUP BY tenant_id, shop_id, session_id) k USING (tenant_id, shop_id, session_id))"""))
def _(t):
    feats = _features(t)
    live = S.radar_live(feats, _NOW, "EUR")
    return S.radar(live, S.radar_stored(B.stored_features(feats), _events(t), currency="EUR"), t.evs.where(F.col("name") == "error"), "EUR")
