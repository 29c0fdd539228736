"""Geographic clusters and region geometry over aggregated points (shop, lat, long, country, city, count)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.functions.numbers import round_to
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP

EARTH_KM = 6371.0
# Merge radii in degrees tried one after the other, and the zoom levels up to which clusters follow countries and cities.
MERGE_RADII = (0.5, 1.0, 3.0, 10.0)
COUNTRY_ZOOM, CITY_ZOOM = 2.0, 4.5


def points(ev: DataFrame) -> DataFrame:
    """Sessions per position and place."""
    known = ev.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return known.groupBy(*SHOP, "country", "city", F.col("longitude").alias("long"), F.col("latitude").alias("lat")).agg(F.count_distinct("session_id").alias("count"))


# --- greedy merge ----------------------------------------------------------------------------

# Cells around one whose points can lie within the radius, for cells that are as wide across as the radius: none is more
# than two away, and the four corners of that square are too far.
_AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]


def greedy_seeds(pts: DataFrame, by: list[str]) -> DataFrame:
    """The seeds (*by, seed, _lat, _long) of the merge that takes the points in order of ``rank`` and gives each one that is left all
    later points within ``radius`` degrees. ``pts`` has *by, rank, lat, long, radius; the ranks of one group are distinct.

    A point is a seed if no earlier one is within the radius of it, and out once a seed is. Any two points of a cell are within
    the radius, so of a cell only its first open point can become a seed: every round takes those that no earlier open point
    of the cells around them blocks, all at once, and closes what lies within the radius of one. Each round compares a point with at
    most 21 others, and the first open point of a group is never blocked, so the rounds end.
    """
    side = F.col("radius") / F.lit(math.sqrt(2))
    cell = [F.floor(F.col("lat") / side).alias("_i"), F.floor(F.col("long") / side).alias("_j")]
    where, shifts = [*by, "_i", "_j"], F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])
    near = F.sqrt((F.col("lat") - F.col("_lat")) ** 2 + (F.col("long") - F.col("_long")) ** 2) <= F.col("radius")

    def around(seeds: DataFrame) -> DataFrame:
        cells = seeds.withColumn("_s", F.explode(shifts))
        return cells.select(*by, (F.col("_i") + F.col("_s.i")).alias("_i"), (F.col("_j") + F.col("_s.j")).alias("_j"), "seed", "_lat", "_long")

    left, found = cut(pts.select(*by, "rank", "lat", "long", "radius", *cell)), None
    while not left.isEmpty():
        first = left.groupBy(*where).agg(F.min(F.struct("rank", "lat", "long")).alias("f"))
        first = cut(first.select(*where, F.col("f.rank").alias("seed"), F.col("f.lat").alias("_lat"), F.col("f.long").alias("_long")))
        blocked = left.join(around(first), where).where(near & (F.col("rank") < F.col("seed"))).select(*by, "seed").distinct()
        seeds = cut(first.join(blocked, [*by, "seed"], "left_anti"))
        closed = left.join(around(seeds), where).where(near).select(*by, "rank").distinct()
        left = cut(left.join(closed, [*by, "rank"], "left_anti"))
        found = seeds if found is None else found.unionByName(seeds)
    return pts.select(*by, F.col("rank").alias("seed"), F.col("lat").alias("_lat"), F.col("long").alias("_long")).limit(0) if found is None else found.drop("_i", "_j")


def adaptive_clusters(pts: DataFrame, target: int = 500) -> DataFrame:
    """Merge each shop's points by growing radii until at most ``target`` are left: the busiest point takes in all within the radius,
    then the busiest of the others, and so on. If the widest radius is not enough, the busiest ``target`` points. Ties are in order of
    country, city, latitude and longitude.

    All radii are merged at the same time and the first that suffices is taken; a shop with few points is left alone.
    """
    rank = F.struct((-F.col("count")).alias("least"), "country", "city", "lat", "long")
    pts = cut(pts.withColumn("rank", rank))
    many = pts.groupBy(*SHOP).count().where(F.col("count") > target).select(*SHOP)
    radii = F.explode(F.array(*map(F.lit, MERGE_RADII)))
    tried = cut(pts.join(many, SHOP, "left_semi").withColumn("radius", radii))
    by = [*SHOP, "radius"]
    seeds = cut(greedy_seeds(tried, by))
    enough = seeds.groupBy(*by).count().where(F.col("count") <= target).groupBy(*SHOP).agg(F.min("radius").alias("radius"))
    few = pts.join(many, SHOP, "left_anti")
    hopeless = top_k(pts.join(many, SHOP, "left_semi").join(enough, SHOP, "left_anti"), SHOP, ["rank"], target)
    # Each point goes to the first seed within the radius; a seed is its own.
    side = F.col("radius") / F.lit(math.sqrt(2))
    near = F.sqrt((F.col("lat") - F.col("_lat")) ** 2 + (F.col("long") - F.col("_long")) ** 2) <= F.col("radius")
    place = lambda lat, long: [F.floor(F.col(lat) / side).alias("_i"), F.floor(F.col(long) / side).alias("_j")]
    chosen = seeds.join(enough, by).select("*", *place("_lat", "_long"), F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])).alias("_s"))
    chosen = chosen.select(*by, (F.col("_i") + F.col("_s.i")).alias("_i"), (F.col("_j") + F.col("_s.j")).alias("_j"), "seed", "_lat", "_long")
    members = tried.join(enough, by).select("*", *place("lat", "long")).join(chosen, [*by, "_i", "_j"]).where(near)
    own = members.groupBy(*SHOP, "rank").agg(F.min("seed").alias("seed"), F.first("count").alias("count"))
    merged = own.groupBy(*SHOP, "seed").agg(F.sum("count").alias("count")).select(*SHOP, "seed.country", "seed.city", "seed.long", "seed.lat", "count")
    columns = merged.columns
    return merged.unionByName(few.select(columns)).unionByName(hopeless.select(columns))


# --- distance clusters -----------------------------------------------------------------------

def haversine(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlong = F.radians(lat2 - lat1), F.radians(long2 - long1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlong / 2) * F.sin(dlong / 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def adjusted_radius(radius: float, zoom: float = 1, adaptive: bool = True, density: float | None = None) -> float:
    """Radius for a zoom level; ``density`` is points per square degree in view."""
    if not adaptive:
        return radius * max(0.5, 1 / math.sqrt(zoom))
    out = radius * max(0.1, 4 / (zoom + 1))
    return out if density is None else out * max(0.5, min(5.0, math.sqrt(density * 1000) + 1))


def _grid(radius: float) -> tuple[float, Column, Column]:
    """Row height in degrees, row and number of columns of a point's row. Two points in one cell are always within the radius, so a
    cell is one cluster however many points it holds and no pairs inside a cell are formed."""
    step = math.degrees(0.9 * radius / math.sqrt(2) / EARTH_KM)
    row = F.floor(F.col("lat") / step)
    return step, row, _columns(row, step)


def _columns(row: Column, step: float) -> Column:
    """Columns in a row, from its latitude nearest the equator, where degrees are widest."""
    nearest = F.least(F.abs(row * step), F.abs((row + 1) * step))
    nearest = F.when((row * step <= 0) & ((row + 1) * step >= 0), F.lit(0.0)).otherwise(nearest)
    return F.greatest(F.lit(1), F.ceil(360.0 / step * F.greatest(F.cos(F.radians(nearest)), F.lit(1e-6)))).cast("bigint")


def distance_clusters(pts: DataFrame, radius: float, by: list[str] = SHOP) -> DataFrame:
    """Points with ``cluster``: whatever is linked by steps of at most ``radius`` km belongs together.

    Points fall into cells smaller than the radius. Cells are linked when two of their points are close enough: neighbouring cells are found by an equi-join on
    cell numbers, and only points in different cells are compared. Labels then spread over linked cells, jumping to the label's own label, until none changes.
    """
    step, row, cols = _grid(radius)
    node = F.floor((F.col("long") + 180.0) / 360.0 * F.col("_cols")).cast("bigint") % F.col("_cols")
    cells = pts.withColumn("_row", row).withColumn("_cols", cols).withColumn("_col", node)
    key = [*by, "_row", "_col"]
    boxes = cells.groupBy(*key, "_cols").agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("long").alias("_w"), F.max("long").alias("_e"))
    # Rows that may hold a close point, and in each the columns within reach of the cell's box, around the globe.
    reach = math.ceil(math.degrees(radius / EARTH_KM) / step)
    rows = boxes.withColumn("_r2", F.explode(F.sequence(F.col("_row"), F.col("_row") + reach))).withColumn("_c2n", _columns(F.col("_r2"), step))
    far = F.greatest(F.abs(F.col("_s")), F.abs(F.col("_n")), F.abs(F.col("_r2") * step), F.abs((F.col("_r2") + 1) * step))
    spread = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.lit(radius / 2 / EARTH_KM)) / F.greatest(F.cos(F.radians(F.least(far, F.lit(90.0)))), F.lit(1e-9)))))
    lo = F.floor((F.col("_w") - spread + 180.0) / 360.0 * F.col("_c2n"))
    hi = F.least(F.floor((F.col("_e") + spread + 180.0) / 360.0 * F.col("_c2n")), lo + F.col("_c2n") - 1)
    near = rows.withColumn("_raw", F.explode(F.sequence(lo, hi))).withColumn("_c2", F.pmod(F.col("_raw"), F.col("_c2n")))
    near = near.where((F.col("_r2") != F.col("_row")) | (F.col("_c2") != F.col("_col"))).select(*key, F.col("_r2"), F.col("_c2")).distinct()
    here = cells.select(*key, F.col("lat").alias("_lat1"), F.col("long").alias("_long1")).distinct()
    there = cells.select(*by, F.col("_row").alias("_r2"), F.col("_col").alias("_c2"), F.col("lat").alias("_lat2"), F.col("long").alias("_long2")).distinct()
    existing = boxes.select(*by, F.col("_row").alias("_r2"), F.col("_col").alias("_c2"))
    near = near.join(existing, [*by, "_r2", "_c2"])
    close = haversine(F.col("_lat1"), F.col("_long1"), F.col("_lat2"), F.col("_long2")) <= radius
    linked = near.join(here, key).join(there, [*by, "_r2", "_c2"]).where(close).select(*key, "_r2", "_c2").distinct()
    name = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    edges = linked.select(*by, name("_row", "_col").alias("a"), name("_r2", "_c2").alias("b"))
    edges = cut(edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(boxes.select(*by, name("_row", "_col").alias("a"), name("_row", "_col").alias("label")))
    while not edges.isEmpty():
        offered = edges.join(labels.select(*by, F.col("a").alias("b"), "label"), [*by, "b"]).groupBy(*by, "a").agg(F.min("label").alias("offer"))
        best = labels.join(offered, [*by, "a"], "left").select(*by, "a", "label", F.least("label", F.coalesce("offer", "label")).alias("new"))
        jump = best.select(*by, F.col("a").alias("new"), F.col("new").alias("far"))
        moved = cut(best.join(jump, [*by, "new"], "left").select(*by, "a", "label", F.least("new", F.coalesce("far", "new")).alias("next")))
        if moved.where(F.col("label") != F.col("next")).isEmpty():
            break
        labels = moved.select(*by, "a", F.col("next").alias("label"))
    named = cells.withColumn("a", name("_row", "_col")).join(labels, [*by, "a"])
    return named.select(*pts.columns, F.concat_ws(":", "label.r", "label.c").alias("cluster"))


def _heaviest(column: str) -> Column:
    return F.max(F.when(F.col(column).isNotNull(), F.struct(F.col("_w"), F.col(column))))[column]


def summarise(members: DataFrame, by: list[str] = SHOP, key: str = "cluster") -> DataFrame:
    """Weighted centre, size, and the place with most weight per cluster. Clusters over the date line are centred on the far side."""
    weight, wide = F.col("count"), F.max("long") - F.min("long") > 180
    turned = F.when(F.col("long") < 0, F.col("long") + 360).otherwise(F.col("long"))
    around = F.sum(turned * weight) / F.sum(weight) % 360
    centre = F.when(wide, F.when(around > 180, around - 360).otherwise(around)).otherwise(F.sum(F.col("long") * weight) / F.sum(weight))
    shape = members.groupBy(*by, key).agg(round_to(F.sum(F.col("lat") * weight) / F.sum(weight), 6).alias("lat"), round_to(centre, 6).alias("long"),
                                          F.sum("count").alias("count"), F.count(F.lit(1)).alias("members"))
    place = None
    for column in ("city", "country"):
        value = F.when(F.trim(column) != "", F.trim(column))
        weights = members.groupBy(*by, key, value.alias(column)).agg(F.sum("count").alias("_w"))
        top = weights.groupBy(*by, key).agg(_heaviest(column).alias(column))
        place = top if place is None else place.join(top, [*by, key])
    return shape.join(place, [*by, key])


def regroup(members: DataFrame, zoom: float) -> DataFrame:
    """Cluster name for a zoom level: country, then country and city, else the distance cluster. Members without the field stand alone."""
    if zoom > CITY_ZOOM:
        return members
    city, country = (F.when(F.trim(c) != "", F.trim(c)) for c in ("city", "country"))
    both = F.when(country.isNotNull() & city.isNotNull(), F.concat_ws("::", country, city))
    key = F.coalesce(country, city) if zoom <= COUNTRY_ZOOM else F.coalesce(both, city, country)
    alone = F.concat_ws("@", F.lit(""), F.col("lat").cast("string"), F.col("long").cast("string"))
    return members.withColumn("cluster", F.coalesce(key, alone))


def cluster_map(pts: DataFrame, radius: float, zoom: float = 1) -> DataFrame:
    """Clusters as shown at a zoom level."""
    return summarise(regroup(distance_clusters(pts, adjusted_radius(radius, zoom)), zoom))


def cluster_statistics(clusters: DataFrame) -> DataFrame:
    n, total = F.count(F.lit(1)), F.sum("count")
    return clusters.groupBy(*SHOP).agg(total.alias("total_points"), n.alias("total_clusters"), F.count_if(F.col("count") == 1).alias("singleton_clusters"),
                                       round_to(total / n, 2).alias("avg_cluster_size"), F.max("count").alias("max_cluster_size"), round_to(total / n, 2).alias("compression_ratio"))


# --- geometry --------------------------------------------------------------------------------

def region_centres(pts: DataFrame, by: list[str] = SHOP) -> DataFrame:
    """Weighted mean, and midpoint of the bounding box with the date line considered."""
    lo, hi = F.min("long"), F.max("long")
    middle = F.when(hi > lo, (hi + lo) / 2).otherwise(((hi + 360 + lo) / 2) % 360)
    return pts.groupBy(*by).agg(round_to(F.sum(F.col("lat") * F.col("count")) / F.sum("count"), 6).alias("mean_lat"), round_to(F.sum(F.col("long") * F.col("count")) / F.sum("count"), 6).alias("mean_long"),
                                round_to((F.max("lat") + F.min("lat")) / 2, 6).alias("mid_lat"), round_to(middle, 6).alias("mid_long"))


def _hull(pdf: pd.DataFrame) -> list[tuple[float, float]]:
    """Convex hull, anticlockwise from the westernmost point."""
    pts = sorted(set(zip(pdf["long"], pdf["lat"])))
    if len(pts) <= 3:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def _outer(points: DataFrame, by: list[str], directions: int = 16) -> DataFrame:
    """``points`` without those strictly inside the polygon of the farthest points in ``directions`` directions. The farthest points are
    maxima, combined before the shuffle, and no corner of the hull is inside that polygon."""
    angles = [2 * math.pi * i / directions for i in range(directions)]
    reach = [F.max_by(F.struct("long", "lat"), F.struct(F.col("long") * math.cos(a) + F.col("lat") * math.sin(a), "long", "lat")).alias(f"_p{i}") for i, a in enumerate(angles)]
    edges = [F.struct(F.col(f"_p{i}").alias("a"), F.col(f"_p{(i + 1) % directions}").alias("b")) for i in range(directions)]
    polygons = points.groupBy(*by).agg(*reach).select(*by, F.filter(F.array(*edges), lambda e: e["a"] != e["b"]).alias("_edges"))

    def left(e):
        a, b = e["a"], e["b"]
        return (b["long"] - a["long"]) * (F.col("lat") - a["lat"]) - (b["lat"] - a["lat"]) * (F.col("long") - a["long"]) > 1e-9

    inside = (F.size("_edges") > 2) & F.forall("_edges", left)
    return points.join(polygons, by).where(~inside).select(*points.columns)


def outline(pts: DataFrame, by: list[str] = SHOP, slices: int = 64) -> DataFrame:
    """Convex hull corners per region in order.

    Points inside the polygon of the outermost ones are left out first. The rest is split by position into slices whose hulls are taken first: a corner of the whole is a corner of its slice, so the last
    step sees slice corners only.
    """
    distinct = _outer(pts.select(*by, "long", "lat").distinct(), by).withColumn("_slice", F.pmod(F.xxhash64("long", "lat"), F.lit(slices)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.select(*by).schema)

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf)
        first = pdf.iloc[0]
        return pd.DataFrame([{**{b: first[b] for b in by}, "position": i, "long": x, "lat": y} for i, (x, y) in enumerate(hull)])

    out = f"{schema}, position int, long double, lat double"
    partial = distinct.groupBy(*by, "_slice").applyInPandas(corners, out).select(*by, "long", "lat")
    return partial.groupBy(*by).applyInPandas(corners, out)


def centroid(hull: DataFrame, by: list[str] = SHOP) -> DataFrame:
    """Centre of the hull polygon; regions without area have none."""
    w = Window.partitionBy(*by).orderBy("position")
    last = F.last(F.struct("long", "lat")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.lag(F.struct("long", "lat")).over(w), last)
    edge = hull.withColumn("_b", before).withColumn("_a", F.col("_b.long") * F.col("lat") - F.col("long") * F.col("_b.lat"))
    area = F.sum("_a") / 2
    out = edge.groupBy(*by).agg(F.count(F.lit(1)).alias("corners"), area.alias("_area"), F.sum((F.col("_b.long") + F.col("long")) * F.col("_a")).alias("_x"),
                                F.sum((F.col("_b.lat") + F.col("lat")) * F.col("_a")).alias("_y"))
    ok = out.where((F.col("corners") >= 3) & (F.abs("_area") > 1e-12))
    return ok.select(*by, round_to(F.col("_y") / (6 * F.col("_area")), 6).alias("lat"), round_to(F.col("_x") / (6 * F.col("_area")), 6).alias("long"))


def farthest(hull: DataFrame, by: list[str] = SHOP) -> DataFrame:
    """The two hull corners farthest apart and their distance; hulls are short lists of corners, whatever the number of points."""
    a = hull.select(*by, F.col("position").alias("_i"), F.col("lat").alias("lat1"), F.col("long").alias("long1"))
    b = hull.select(*by, F.col("position").alias("_j"), F.col("lat").alias("lat2"), F.col("long").alias("long2"))
    pairs = a.join(b, by).where(F.col("_i") < F.col("_j"))
    d = F.struct(round_to(haversine(F.col("lat1"), F.col("long1"), F.col("lat2"), F.col("long2")), 3).alias("km"), -F.col("_i"), -F.col("_j"), "lat1", "long1", "lat2", "long2")
    return pairs.groupBy(*by).agg(F.max(d).alias("d")).select(*by, "d.km", "d.lat1", "d.long1", "d.lat2", "d.long2")
