"""Tables kept up to date in steps, folds, merges and sketches against plain code."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.enrich.payload import suppress_rapid
from tidemark.operators import funnel, regions, sketches
from tidemark.operators.session_store import SessionStore
from tidemark.operators.sessions import sessionize, sessions
from tidemark.sources.versioned import Versioned, recall, remember
from tidemark.streaming import compaction as C

BASE = datetime(2024, 1, 1)
EVENT = ("id bigint, tenant_id int, shop_id bigint, device_id string, name string, path string, customer_id string, origin string, referrer string, referrer_name string, "
         "referrer_type string, os string, browser string, device string, country string, city string, revenue_usd bigint, created_at timestamp_ntz")


def events(spark, rows):
    """(id, device, name, seconds after the base) as canonical events."""
    full = [(i, 1, 1, d, n, f"/{i % 5}", None, "", "", "", "", "", "", "", "", "", 5, BASE + timedelta(seconds=s)) for i, d, n, s in rows]
    return spark.createDataFrame(full, EVENT)


# --- versioned tables ------------------------------------------------------------------------------------------------

def files_of(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*.parquet"))


def test_versions_switch_at_once(spark, tmp_path):
    table = Versioned(spark, str(tmp_path), "day")
    make = lambda rows: spark.createDataFrame(rows, "day int, v int")
    content = lambda t=table: sorted((r.day, r.v) for r in t.read().collect())
    assert table.read() is None and table.partitions() == set()
    table.replace(make([(1, 10), (2, 20)]), [1, 2], {"1": "a"})
    before = table.read()
    table.replace(make([(2, 21), (3, 30)]), [2, 3], {"2": "b"})
    assert content() == [(1, 10), (2, 21), (3, 30)] and sorted((r.day, r.v) for r in before.collect()) == [(1, 10), (2, 20)]
    assert table.notes() == {"1": "a", "2": "b"} and [r.v for r in table.read([2]).collect()] == [21]
    table.replace(make([]), [1])
    assert content() == [(2, 21), (3, 30)] and table.read([1]) is None
    with pytest.raises(ValueError, match="outside"):
        table.replace(make([(7, 1)]), [2])
    assert content() == [(2, 21), (3, 30)]
    table.replace(make([(3, 31)]), [3])
    assert table.vacuum() == ["v1", "v3"] and content() == [(2, 21), (3, 31)]


def test_two_slots_whatever_the_number(spark, tmp_path):
    path = str(tmp_path / "p")
    assert recall(spark, path, "x int") is None
    for n in range(7):
        remember(spark.createDataFrame([(n * 10,)], "x int"), path, n)
    assert recall(spark, path, "x int")["x"] == 60 and recall(spark, path, "x int", before=6)["x"] == 50
    assert len(files_of(path)) == 2


# --- stream tables ---------------------------------------------------------------------------------------------------

def test_batches_fold_into_months(spark, tmp_path):
    path, day = str(tmp_path), 86_400
    rows = [(i, "d", "page_view", i * 2 * day) for i in range(40)]  # four a batch, January to March
    want, number = [], 0
    for number in range(10):
        batch = rows[4 * number:4 * number + 4]
        for _ in range(2 if number == 5 else 1):  # run again
            C.append(events(spark, batch), path, "events", number)
            C.note_progress(spark, path, number, BASE + timedelta(seconds=batch[-1][3]))
        want += [r[0] for r in batch]
        if number == 5:
            assert C.compact(spark, path) == [202401]
            C.append(events(spark, batch), path, "events", number)  # run again after the fold
    ids = lambda: sorted(r.id for r in C.read(spark, path).collect())
    assert ids() == want
    late = (100, "d", "page_view", day)
    C.append(events(spark, [late]), path, "events", number + 1)
    assert ids() == sorted([*want, 100])
    reader = C.read(spark, path)
    assert C.compact(spark, path) == [202401, 202402] and C.compact(spark, path) == []
    assert ids() == sorted([*want, 100]) == sorted(r.id for r in reader.collect())
    assert C.vacuum(spark, path) > 5
    assert ids() == sorted([*want, 100])
    assert {f.split("/")[1] for f in files_of(f"{path}/events") if "/" in f} and all("event_month=202403" in f for f in files_of(f"{path}/events"))
    assert len(files_of(f"{path}/progress")) == 2 and C.newest_before(spark, path, 10) == BASE + timedelta(seconds=rows[-1][3])
    plan = C.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "batch" in plan.split("PartitionFilters: [")[-1].split("]")[0]
    with pytest.raises(ValueError, match="no table"):
        C.read(spark, path, "late")
    assert C.compact(spark, path, "late") == []


# --- sessions run by run ---------------------------------------------------------------------------------------------

def test_runs_equal_one_run(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"d{rng.randrange(4)}", rng.choice(["page_view", "add_to_cart", "purchase"]), rng.randrange(6 * 86_400) // 600 * 600) for i in range(300)]
    rows += [(1000 + i, "hot", "page_view", 86_400 * 2 - 4000 + i * 300) for i in range(40)]  # over midnight
    # One that joins two sessions of the day before, one before a session's start.
    rows += [(2000, "join", "page_view", 10_000), (2001, "join", "page_view", 13_000), (2002, "join", "page_view", 11_500), (2003, "join", "purchase", 9_000)]
    late = {2002: 3, 2003: 4}
    run_of = lambda r: late.get(r[0], min(4, r[3] // 86_400 + (rng.random() < 0.1)))
    by_run = {n: [] for n in range(5)}
    for r in rows:
        by_run[run_of(r)].append(r)
    store = SessionStore(spark, str(tmp_path), 1800)
    assert store.sessions() is None
    for n, batch in by_run.items():
        again = rng.sample(rows, 5) if n == 4 else []  # known ids come again
        store.advance(events(spark, [*batch, *[r for r in again if r not in batch]]).repartition(3), n)
    store.advance(events(spark, rows), 4)  # a run that was completed
    every = events(spark, rows)
    want = sessions(every, 1800)
    assert store.sessions().select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(store.sessions().select(want.columns)).isEmpty()
    key = ["id", "session_id", "session_start"]
    assert sorted(store.events.read().select(key).collect()) == sorted(sessionize(every, 1800).select(key).collect())


def test_a_broken_run_is_run_again(spark, tmp_path, monkeypatch):
    rows = [(i, "d", "page_view", i * 1000) for i in range(30)]
    store = SessionStore(spark, str(tmp_path), 1800)
    store.advance(events(spark, rows[:20:2]), 0)
    monkeypatch.setattr(SessionStore, "_store_spans", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.advance(events(spark, rows), 1)
    monkeypatch.undo()
    store.advance(events(spark, rows), 1)
    assert [(r.events_count, r.duration) for r in store.sessions().collect()] == [(30, 29_000)]
    assert store.events.read().groupBy("session_id").count().collect()[0]["count"] == 30


def test_a_run_reads_only_days_in_reach(spark, tmp_path, monkeypatch):
    store = SessionStore(spark, str(tmp_path), 1800)
    store.advance(events(spark, [(d, "d", "page_view", d * 86_400 + 5) for d in range(10)]), 0)
    asked = []
    read = Versioned.read
    monkeypatch.setattr(Versioned, "read", lambda self, partitions=None: asked.append(set(map(str, partitions or []))) or read(self, partitions))
    store.advance(events(spark, [(50, "d", "page_view", 9 * 86_400 + 900)]), 1)
    assert set().union(*asked) <= {"20240109", "20240110"}


# --- funnels ---------------------------------------------------------------------------------------------------------

def plain_level(rows, steps, window):
    """Newest start per step, event by event."""
    best, level = [None] * len(steps), 0
    for at, _, name in sorted(rows):
        new = list(best)
        for k, step in enumerate(steps):
            if name == step:
                start = at if k == 0 else best[k - 1]
                if start is not None and at - start <= window:
                    new[k] = max(start, best[k]) if best[k] is not None else start
                    level = max(level, k + 1)
        best = new
    return level


@pytest.mark.parametrize("steps", [["a"], ["a", "b"], ["a", "b", "c", "b"], ["a", "a", "b", "c"]])
def test_funnel_of_a_hot_device(spark, steps):
    rng = random.Random(len(steps))
    rows = [(i, "hot", rng.choice("aabcx"), rng.randrange(4000)) for i in range(1500)]
    rows += [(2000 + i, f"d{i % 60}", rng.choice("abc"), rng.randrange(400)) for i in range(600)]  # many ties
    found = {r.device_id: r.level for r in funnel.funnel_levels(events(spark, rows), steps, window=100).collect()}
    by = {}
    for i, d, n, s in rows:
        if n in steps:
            by.setdefault(d, []).append((s, i, n))
    assert found == {d: plain_level(r, steps, 100) for d, r in by.items()}


def test_slices_of_a_hot_device_are_tasks_of_their_own(spark):
    rows = funnel._slices(events(spark, [(i, "hot", "abc"[i % 3], i) for i in range(3200)]), ["a", "b", "c"], ["device_id"], 160, [])
    assert rows.count() == 320 and rows.columns[:2] == ["device_id", "_slice"]


# --- greedy clusters -------------------------------------------------------------------------------------------------

def plain_merge(points, radius):
    left, out = sorted(points, key=lambda p: (-p[4], *p[:2], p[3], p[2])), []
    while left:
        c = left[0]
        near = [p for p in left if ((p[3] - c[3]) ** 2 + (p[2] - c[2]) ** 2) ** 0.5 <= radius]
        out.append((*c[:4], sum(p[4] for p in near)))
        left = [p for p in left if p not in near]
    return out


def test_adaptive_clusters(spark):
    rng = random.Random(3)
    shops = {1: 12.0, 2: 60.0, 3: 0.3, 4: 2000.0}
    rows = [(shop, (rng.choice(["DE", "FR"]), f"c{i}", round(rng.uniform(-width, width), 2), round(rng.uniform(-width, width), 2) % 180 - 90, rng.randrange(1, 6)))
            for shop, width in shops.items() for i in range(150)]
    rows += [(5, ("DE", f"l{i}", i * 0.4, 0.0, 200 - i)) for i in range(60)]  # a chain in falling order
    rows += [(6, ("DE", "x", 1.0, 2.0, 3))]
    pts = spark.createDataFrame([(1, s, *p) for s, p in rows], "tenant_id int, shop_id int, country string, city string, long double, lat double, count bigint")
    found = {}
    for r in regions.adaptive_clusters(pts.repartition(5), target=25).collect():
        found.setdefault(r.shop_id, []).append((r.country, r.city, r.long, r.lat, r["count"]))
    for shop in {s for s, _ in rows}:
        points = [p for s, p in rows if s == shop]
        tries = [points] if len(points) <= 25 else [plain_merge(points, r) for r in regions.MERGE_RADII]
        want = next((t for t in tries if len(t) <= 25), sorted(points, key=lambda p: (-p[4], *p[:2], p[3], p[2]))[:25])
        assert sorted(found[shop]) == sorted(want), shop
    assert regions.adaptive_clusters(pts.limit(0)).collect() == []


# --- sketches --------------------------------------------------------------------------------------------------------

def test_sketches_merge_to_any_period(spark):
    rng = random.Random(9)
    rows = [(i, f"d{rng.randrange(3000)}", "page_view", rng.randrange(86_400 * 20)) for i in range(20_000)]
    ev = events(spark, rows).withColumn("session_id", F.concat("device_id", F.lit("s"))).withColumn("revenue", F.lit(1))
    hours = sketches.hourly_sketches(ev)
    months = sketches.counted(sketches.merged(hours, "month")).first()
    through_days = sketches.counted(sketches.merged(sketches.merged(hours, "day"), "month", at="day")).first()
    exact = len({r[1] for r in rows})
    for found in (months, through_days):
        assert found.pageviews == 20_000
        assert abs(found.unique_visitors - exact) <= 3 * sketches.distinct_error() * exact
    se = spark.createDataFrame([(1, 1, BASE + timedelta(days=i % 20), rng.randrange(10_000)) for i in range(20_000)],
                               "tenant_id int, shop_id int, started_at timestamp_ntz, duration bigint").cache()
    got = sketches.duration_quantile(sketches.daily_durations(se), "month").first()
    below = se.where(F.col("duration") < got.duration).count() / 20_000
    assert got.sessions == 20_000 and abs(below - 0.9) <= sketches.rank_error()


# --- notification funnels on a stream --------------------------------------------------------------------------------

def plain_completions(rows, steps, window):
    """(id, began) of each completed chain; a completed start and older ones are forgotten."""
    best, out = [None] * len(steps), []
    for at, i, name in sorted(rows):
        new = list(best)
        for k, step in enumerate(steps):
            start = at if k == 0 else best[k - 1]
            if name == step and start is not None and at - start <= window:
                new[k] = start if new[k] is None else max(new[k], start)
        best = new
        if best[-1] is not None:
            out.append((i, best[-1]))
            best = [None if s is None or s <= out[-1][1] else s for s in best]
    return out


def test_notification_funnels_over_micro_batches(spark, tmp_path):
    from tidemark.streaming.notifications import funnel_notifications
    from tidemark.streaming.sources import read_files

    rng = random.Random(12)
    rows = sorted(((i, f"d{rng.randrange(3)}", rng.choice("abcx"), rng.randrange(3000)) for i in range(300)), key=lambda r: (r[3], r[0]))
    for n in range(3):
        events(spark, rows[100 * n:100 * n + 100]).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
        for file in (tmp_path / "in" / f"n={n}").glob("*.parquet"):
            file.rename(tmp_path / f"{n}.parquet")
    rules = [{"id": "ab", "steps": ["a", "b"], "window": 60}, {"id": "abc", "steps": ["a", "b", "c"], "window": 300}, {"id": "a", "steps": ["a"], "window": 10}]
    stream = read_files(spark, str(tmp_path), EVENT, "parquet", glob="[0-9].parquet", files_per_trigger=1)
    out = funnel_notifications(stream, rules, "1 hour")
    writer = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
    writer.trigger(availableNow=True).start().awaitTermination()
    found = {(r.rule_id, r.id, int((r.began_at - BASE).total_seconds())) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    want = set()
    for rule in rules:
        for d in {r[1] for r in rows}:
            want |= {(rule["id"], i, s) for i, s in plain_completions([(s, i, n) for i, dd, n, s in rows if dd == d], rule["steps"], rule["window"])}
    assert found == want and len(want) > 100


def test_equal_requests_of_two_events(spark, tmp_path):
    """Events whose requests say the same count apart, each once however often it is sent."""
    import check_oracle as oracle
    from conftest import SF
    from tidemark.plans import ORACLES, QUERIES

    con = oracle.database(SF)
    con.execute(f"COPY (SELECT * REPLACE (event_id + 6000 * i AS event_id, user_id + 12 * i AS user_id) FROM '{SF}/events.parquet', range(2) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE OR REPLACE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet')")
    problem, rows, _ = oracle.compare(spark, con, QUERIES["ingest_pipeline"], ORACLES["ingest_pipeline"], str(tmp_path))
    assert problem is None and rows > 0


def test_means_halfway(spark):
    """Means that lie halfway are the same in any order of the rows, and as exact sums have them."""
    from tidemark.operators.retention import retention_average

    # 64.165, which sums of doubles reach in some orders only.
    orders = [(66.67, 42.86, 66.67, 66.67, 100.0, 50.0, 45.45, 75.0), (66.67, 66.67, 42.86, 100.0, 45.45, 50.0, 75.0, 66.67), (42.86, 45.45, 50.0, 66.67, 66.67, 66.67, 75.0, 100.0)]
    for order in orders:
        table = spark.createDataFrame([(1, 1, 0, p, 1, 1) for p in order], "tenant_id int, shop_id int, offset int, percentage double, users bigint, cohort_size bigint")
        assert retention_average(table.coalesce(1)).first()["avg_percentage"] == 64.17


def test_sketch_beside_exact_count(spark):
    """The sketch is built over distinct sessions: no stage groups sketches by session."""
    from conftest import SF
    from tidemark.plans import QUERIES

    plan = QUERIES["top_country_approximate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    by_session = [line for line in plan.splitlines() if "Aggregate" in line and "session_id" in line.split("functions=")[0]]
    assert by_session and not any("approx" in line or "hyperloglog" in line.lower() for line in by_session)


def test_payloads_of_one_shop_spread(spark):
    """Repeats are sought by shop and event id, so a shop's events are not one task; few and many shops give the same."""
    from tidemark.export import conversions as X

    ev = events(spark, [(i % 40, "d", "purchase", i) for i in range(80)]).selectExpr(
        "*", "map() as properties", "100L as revenue", "'EUR' as currency", "'7' as product_id").withColumn("properties", F.create_map().cast("map<string,string>"))
    shops = spark.createDataFrame([(1, 1, True, '{"pixel_id": "1", "access_token": "x"}', [])],
                                  "tenant_id int, shop_id bigint, enabled boolean, credentials string, events_whitelist array<string>")
    found, few = [], X.FEW_SHOPS
    try:
        for X.FEW_SHOPS in (few, 0):
            out = X.payloads(ev, shops)
            assert "hashpartitioning(tenant_id#" in (plan := out._jdf.queryExecution().executedPlan().toString())
            window = plan[plan.index("Window"):]
            assert "event_id#" in window[window.index("hashpartitioning("):].split(")")[0]
            found.append(sorted((r.event_id, r.event_time) for r in out.collect()))
    finally:
        X.FEW_SHOPS = few
    assert found[0] == found[1] and len(found[0]) == 40


def test_filters_on_requests_do_not_parse_again(spark):
    """A filter on fields of events is not written out as several readings of the body."""
    from tidemark.enrich.payload import track_events

    raw = spark.createDataFrame([('{"shop_id": "00000000-0000-4000-8000-000000000000", "name": "a"}',)], "body string").withColumn("received_at", F.lit(BASE).cast("timestamp_ntz"))
    kept = track_events(raw).where((F.col("name") != "") & ~F.col("device_id").startswith("dev-")).select("device_id", "status")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("from_json") <= 2 for line in plan.splitlines() if "Filter" in line)
    assert len(kept.collect()) == 1


def test_fit_in_parts_of_the_cores(spark, monkeypatch):
    """What a fit sends to the driver does not grow with the partitions of its rows; the weights stay the same."""
    from pyspark.ml.classification import LogisticRegression

    from tidemark.operators.scoring import train

    parts, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, data: (parts.append(data.rdd.getNumPartitions()), fit(self, data))[1])
    rows = spark.range(0, 400, 1, 200).selectExpr("id % 7 as a", "id % 3 as b", "cast((id % 7 + id % 5) > 5 as int) as y")
    many, one = (train(r, "y", {"a": "a", "b": "b"}) for r in (rows, rows.coalesce(1)))
    assert parts[0] <= 2 * spark.sparkContext.defaultParallelism
    assert many == pytest.approx(one, abs=1e-3)


def test_newest_windows_leave_events_where_they_are(spark):
    """Windows of few shops do not deal events by shop; few and many shops give the same."""
    from tidemark.operators import realtime as R

    ev = events(spark, [(i, f"d{i % 7}", "a", i * 3600) for i in range(100)])
    found, few = [], R.FEW_SHOPS
    try:
        for R.FEW_SHOPS in (few, 0):
            out = R.widened(ev, BASE + timedelta(days=4), F.lit(True))
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (R.FEW_SHOPS > 0)
            found.append(sorted(r.id for r in out.collect()))
    finally:
        R.FEW_SHOPS = few
    assert found[0] == found[1] and len(found[0]) == 25


def test_stored_events_shuffle_raw_columns_only(tables, spark, tmp_path):
    """What follows from the raw columns is added behind the shuffles; the table is the same and in the same order."""
    plan = tables._facts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any(f"{c}#" in plan for c in ("referrer", "browser", "properties", "session_id"))
    whole, path = sessionize(tables.ev, 12 * 3600), f"file://{tmp_path}/evs"
    tables._write_evs(path)
    text = lambda df: df.select([F.to_json(c) if c == "properties" else F.col(c).cast("string") for c in sorted(whole.columns)])
    got, want = text(spark.read.parquet(path)), text(whole)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    for file in (tmp_path / "evs").rglob("*.parquet"):
        rows = [(r["tenant_id"], r["shop_id"], r["created_at"]) for r in pq.ParquetFile(file).read(["tenant_id", "shop_id", "created_at"]).to_pylist()]
        assert rows == sorted(rows)


def test_rapid_duplicates_read_events_twice(tables, spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ev = tables.ev.select("id", "tenant_id", "shop_id", F.lit("d").alias("device_id"), "name", "path", "created_at")
    ev = ev.mapInArrow(counted, ev.schema)
    n, kept = ev.count(), suppress_rapid(ev, 3_600_000).collect()
    assert 0 < len(kept) < n and read.value <= 3 * n
    last = {}
    for r in sorted(tables.ev.select("id", "shop_id", "name", "path", "created_at").collect(), key=lambda r: (r.created_at, r.id)):
        key = (r.shop_id, r.name, r.path)
        if key not in last or (r.created_at - last[key][0]).total_seconds() >= 3600:
            last[key] = (r.created_at, r.id)
            assert any(k.id == r.id for k in kept)
            n -= 1
    assert len(kept) == ev.count() - n


class _Kept:
    """A value, a map and timers as a stateful processor sees them; counts the turns it takes to the JVM."""

    def __init__(self):
        self.value, self.map, self.timers, self.turns = None, {}, set(), 0

    def turn(self, result=None):
        self.turns += 1
        return result

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def exists(self):
        return self.turn(self.value is not None)

    def get(self):
        return self.turn(self.value)

    def update(self, value):
        self.value = self.turn(value)

    def getValue(self, key):
        return self.turn(self.map.get(key))

    def updateValue(self, key, value):
        self.map[key] = self.turn(value)

    def registerTimer(self, at):
        self.turn(self.timers.add(at))

    def deleteTimer(self, at):
        self.turn(self.timers.discard(at))

    def getCurrentWatermarkInMs(self):
        return 0


def test_running_features_ask_the_state_for_little():
    import pandas as pd

    from tidemark.streaming.stateful import RunningFeatures

    rng, ttl, at, events = random.Random(19), 100, 0, []
    for i in range(600):
        at += rng.choice([0, 1, 20, 60, 60, 101]) if i % 60 else 500
        events.append((1, 2, "d", f"e,{i:04d}", datetime(2024, 1, 1), at, rng.choice(["page_view", "page_view", "view_product", "add_to_cart", "purchase", "error"]),
                       rng.choice(["", *"abcdefgh"]), rng.randrange(9)))
    columns = ["tenant_id", "shop_id", "device_id", "id", "created_at", "at", "name", "product_id", "usd"]

    def run(batches):
        kept, processor, out, turns = _Kept(), RunningFeatures(ttl), [], []
        processor.init(kept)
        for frames in batches:
            kept.turns = 0
            frames = [pd.DataFrame(rng.sample(rows, len(rows)), columns=columns) for rows in frames]
            found = pd.concat(list(processor.handleInputRows((1, 2, "d"), iter(frames), kept)))
            out += found[["id", "views", "carts", "cart_value_usd", "distinct_products", "dwell_seconds", "has_purchase"]].values.tolist()
            turns.append(kept.turns)
            assert len(kept.timers) == 1
        return out, turns

    views = carts = usd = 0
    first = last = viewed = None
    products, plain = set(), []
    for *_, id_, _, at, name, product, value in events:
        if last is None or at - last > ttl:
            first, views, carts, usd, viewed, products = at, 0, 0, 0, None, set()
        if viewed is not None and at - viewed > ttl:
            products, viewed = set(), None
        if name in ("page_view", "view_product"):
            views += 1
            if product:
                viewed = at
                products.add(product)
        elif name == "add_to_cart":
            carts, usd = carts + 1, usd + value
        elif name == "purchase":
            carts = usd = 0
        last = at
        plain.append([id_, views, carts, usd, max(1, len(products)), (last - first) // 1_000_000, name == "purchase"])
    whole, turns = run([[events]])
    assert whole == plain
    assert turns == [3 + len(products)]  # what was kept, each product of the last run, a timer, what is kept
    assert run([[events[:400], events[400:]]])[0] == plain  # several frames of one micro-batch
    cuts = [0, *sorted(rng.sample(range(1, 600), 120)), 600]
    assert run([[events[a:b]] for a, b in zip(cuts, cuts[1:])])[0] == plain
