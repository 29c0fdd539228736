"""Geographic clusters, geometry, summary tables and notification rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regions as G
from tidemark.operators import summaries as S
from tidemark.plans.registry import AS_OF, query, sql
from tidemark.plans.sequences import _levels

_PTS = """pts AS (SELECT tenant_id, shop_id, country, city, longitude AS long, latitude AS lat, count(DISTINCT session_id) AS count FROM evs WHERE latitude IS NOT NULL GROUP BY ALL)"""
_HAV = """2 * 6371.0::double * atan2(sqrt({a}), sqrt(greatest(0, 1 - {a})))""".format(
    a="(sin(radians(y.lat - x.lat) / 2) * sin(radians(y.lat - x.lat) / 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * sin(radians(y.long - x.long) / 2) * sin(radians(y.long - x.long) / 2))")


def _pts(t):
    return G.points(t.evs)


def _spread(t):
    """Points moved apart, so that clusters chain over several cells."""
    return G.points(t.evs.withColumn("latitude", F.col("latitude") + (F.col("product_id") % 10) * 0.05).withColumn("longitude", F.col("longitude") + (F.col("product_id") % 7) * 0.4))


_SPREAD = _PTS.replace("longitude AS long, latitude AS lat", "longitude + (product_id % 7) * 0.4::double AS long, latitude + (product_id % 10) * 0.05::double AS lat")
_COMPONENTS = [_SPREAD, "pt AS (SELECT DISTINCT shop_id, lat, long FROM pts)",
               f"""ed AS (SELECT x.shop_id, x.lat AS la, x.long AS lo, y.lat AS lb, y.long AS lc FROM pt x JOIN pt y ON x.shop_id = y.shop_id AND {_HAV} <= 12)""",
               """reach AS (SELECT shop_id, lat AS la, long AS lo, lat AS lb, long AS lc FROM pt UNION
                 SELECT r.shop_id, r.la, r.lo, e.lb, e.lc FROM reach r JOIN ed e ON r.shop_id = e.shop_id AND r.lb = e.la AND r.lc = e.lo)""",
               "root AS (SELECT shop_id, la AS lat, lo AS long, min(ROW(lb, lc)) AS cluster FROM reach GROUP BY ALL)"]


@query("map_points", sql("SELECT * FROM pts", _PTS))
def _(t):
    return _pts(t)


# One step takes the first point that is left and all within the radius of it.
_DEG = "sqrt((p.lat - remaining[1].lat) ** 2 + (p.long - remaining[1].long) ** 2) <= r"
_MERGES = ["""ranked AS (SELECT tenant_id, shop_id, list({'country': country, 'city': city, 'long': long, 'lat': lat, 'count': count} ORDER BY count DESC, country, city, lat, long) AS pts
  FROM pts GROUP BY ALL)""", f"""steps AS (SELECT tenant_id, shop_id, r, pts AS remaining, pts[1] AS seed, 0::hugeint AS got FROM ranked, (VALUES (0.5::double), (1), (3), (10)) v(r) WHERE len(pts) > 20
  UNION ALL SELECT tenant_id, shop_id, r, list_filter(remaining, lambda p: NOT ({_DEG})), remaining[1],
    list_sum(list_transform(list_filter(remaining, lambda p: {_DEG}), lambda p: p.count)) FROM steps WHERE len(remaining) > 0)""",
           "sized AS (SELECT shop_id, r FROM steps WHERE got > 0 GROUP BY ALL HAVING count(*) <= 20)", "enough AS (SELECT shop_id, min(r) AS r FROM sized GROUP BY ALL)"]


@query("map_adaptive_clusters", sql("""
SELECT tenant_id, shop_id, seed.country, seed.city, seed.long, seed.lat, cast(got AS bigint) AS count FROM steps JOIN enough USING (shop_id, r) WHERE got > 0
UNION ALL SELECT tenant_id, shop_id, p.country, p.city, p.long, p.lat, p.count
  FROM (SELECT tenant_id, shop_id, unnest(pts[:20]) AS p FROM ranked WHERE shop_id NOT IN (SELECT shop_id FROM enough))""", _SPREAD, *_MERGES))
def _(t):
    return G.adaptive_clusters(_spread(t), target=20)


@query("map_distance_clusters", sql("""SELECT tenant_id, shop_id, round(sum(lat * count) / sum(count) * 1e6::double) / 1e6::double AS lat, round(sum(long * count) / sum(count) * 1e6::double) / 1e6::double AS long,
  cast(sum(count) AS bigint) AS count, count(*) AS members FROM pts JOIN root USING (shop_id, lat, long) GROUP BY tenant_id, shop_id, cluster""", *_COMPONENTS))
def _(t):
    return G.summarise(G.distance_clusters(_spread(t), 12)).select("tenant_id", "shop_id", "lat", "long", "count", "members")


@query("map_country_clusters", sql("""SELECT tenant_id, shop_id, country AS cluster, round(sum(lat * count) / sum(count) * 1e6::double) / 1e6::double AS lat, round(sum(long * count) / sum(count) * 1e6::double) / 1e6::double AS long,
  cast(sum(count) AS bigint) AS count, count(*) AS members, min(city) AS city, country FROM pts GROUP BY tenant_id, shop_id, country""", _PTS))
def _(t):
    return G.cluster_map(_pts(t), 25, zoom=2)


@query("map_cluster_statistics", sql("""SELECT tenant_id, shop_id, cast(sum(n) AS bigint) AS total_points, count(*) AS total_clusters, count(*) FILTER (n = 1) AS singleton_clusters,
  round(sum(n) / count(*) * 100) / 100 AS avg_cluster_size, cast(max(n) AS bigint) AS max_cluster_size, round(sum(n) / count(*) * 100) / 100 AS compression_ratio
  FROM (SELECT tenant_id, shop_id, cluster, sum(count) AS n FROM pts JOIN root USING (shop_id, lat, long) GROUP BY ALL) GROUP BY ALL""", *_COMPONENTS))
def _(t):
    return G.cluster_statistics(G.summarise(G.distance_clusters(_spread(t), 12)))


@query("region_centres", sql("""SELECT tenant_id, shop_id, round(sum(lat * count) / sum(count) * 1e6::double) / 1e6::double AS mean_lat, round(sum(long * count) / sum(count) * 1e6::double) / 1e6::double AS mean_long,
  round((max(lat) + min(lat)) / 2 * 1e6::double) / 1e6::double AS mid_lat, round((max(long) + min(long)) / 2 * 1e6::double) / 1e6::double AS mid_long FROM pts GROUP BY ALL""", _SPREAD))
def _(t):
    return G.region_centres(_spread(t))


# A point is a corner when some line through it leaves all others strictly on one side: its directions to the others span less than half a turn.
_CORNER = """dirs AS (SELECT x.tenant_id, x.shop_id, x.long, x.lat, atan2(y.lat - x.lat, y.long - x.long) AS a FROM (SELECT DISTINCT tenant_id, shop_id, long, lat FROM pts) x
  JOIN (SELECT DISTINCT shop_id, long, lat FROM pts) y ON x.shop_id = y.shop_id AND (x.long <> y.long OR x.lat <> y.lat)),
gapsd AS (SELECT tenant_id, shop_id, long, lat, coalesce(lead(a) OVER w, first(a) OVER (PARTITION BY shop_id, long, lat ORDER BY a) + 2 * pi()) - a AS g FROM dirs WINDOW w AS (PARTITION BY shop_id, long, lat ORDER BY a)),
corners AS (SELECT tenant_id, shop_id, long, lat FROM gapsd GROUP BY ALL HAVING max(g) > pi() + 1e-9)"""


@query("region_outline", sql("SELECT * FROM corners", _SPREAD, _CORNER))
def _(t):
    return G.outline(_spread(t)).select("tenant_id", "shop_id", "long", "lat")


@query("region_centroid", sql("""SELECT tenant_id, shop_id, round(sum((lat + lat2) * x) / (3 * sum(x)) * 1e6::double) / 1e6::double AS lat, round(sum((long + long2) * x) / (3 * sum(x)) * 1e6::double) / 1e6::double AS long
FROM (SELECT *, long * lat2 - long2 * lat AS x FROM edges) GROUP BY ALL""", _SPREAD, _CORNER,
    """around AS (SELECT *, atan2(lat - avg(lat) OVER (PARTITION BY shop_id), long - avg(long) OVER (PARTITION BY shop_id)) AS a FROM corners)""",
    """edges AS (SELECT *, coalesce(lead(long) OVER w, first(long) OVER p) AS long2, coalesce(lead(lat) OVER w, first(lat) OVER p) AS lat2 FROM around
      WINDOW w AS (PARTITION BY shop_id ORDER BY a), p AS (PARTITION BY shop_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""))
def _(t):
    return G.centroid(G.outline(_spread(t)))


@query("region_farthest", sql(f"""SELECT x.tenant_id, x.shop_id, max(round({_HAV} * 1000) / 1000) AS km FROM corners x JOIN corners y ON x.shop_id = y.shop_id GROUP BY ALL""", _SPREAD, _CORNER))
def _(t):
    return G.farthest(G.outline(_spread(t))).select("tenant_id", "shop_id", "km")


# --- summary tables, notifications ---

_WHO = "coalesce(customer_id, device_id)"
query("summary_daily_actives", sql(f"SELECT DISTINCT tenant_id, shop_id, date_trunc('day', created_at) AS date, {_WHO} AS profile_id FROM ev"))(lambda t: S.daily_actives(t.ev))
query("summary_event_names", sql("SELECT tenant_id, shop_id, name, count(*) AS count, max(created_at) AS last_seen FROM ev GROUP BY ALL"))(lambda t: S.distinct_event_names(t.ev))
query("summary_property_values", sql("""SELECT tenant_id, shop_id, name, 'k' AS key, cast(product_id AS varchar) AS value, count(*) AS count, max(created_at) AS last_seen FROM ev GROUP BY ALL"""))(
    lambda t: S.property_value_table(t.ev))
query("summary_cohort_events", sql(f"SELECT tenant_id, shop_id, {_WHO} AS profile_id, name, date_trunc('day', created_at) AS date, count(*) AS count FROM ev GROUP BY ALL"))(lambda t: S.cohort_events(t.ev))
query("summary_profile_events", sql(f"SELECT tenant_id, shop_id, {_WHO} AS profile_id, name, count(*) AS count, min(created_at) AS first_seen, max(created_at) AS last_seen FROM ev GROUP BY ALL"))(
    lambda t: S.profile_event_summary(t.ev))


@query("notification_events", sql("""SELECT tenant_id, shop_id, device_id, id, name, created_at, 'big' AS rule_id FROM ev WHERE name = 'purchase' AND os = 'macOS'
UNION ALL SELECT tenant_id, shop_id, device_id, id, name, created_at, 'any' FROM ev WHERE name = 'purchase' UNION ALL SELECT tenant_id, shop_id, device_id, id, name, created_at, 'err' FROM ev WHERE name = 'error'"""))
def _(t):
    return S.event_notifications(t.ev, [{"id": "big", "name": "purchase", "filters": [{"name": "os", "operator": "is", "value": ["macOS"]}]}, {"id": "any", "name": "purchase"}, {"id": "err", "name": "error"}])


@query("notification_funnels", sql("SELECT tenant_id, shop_id, device_id, 'bought' AS rule_id FROM lv WHERE level = 2",
                                   *_levels("lv", ["page_view", "purchase"], window=15 * 86400, where="created_at BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-31'")))
def _(t):
    return S.funnel_notifications(t.ev, "bought", ["page_view", "purchase"], AS_OF, 15 * 86400)
