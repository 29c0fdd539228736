"""Tables on disk, training, and streams compared with their batch twins."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tidemark.functions.timeutil import resolve_period
from tidemark.operators import features as B
from tidemark.operators import scoring
from tidemark.operators.insights import daily_insights
from tidemark.plans.registry import AS_OF, TIMEOUT
from tidemark.schema import EVENT_DDL, canonical_events
from tidemark.sources import tables as S
from tidemark.streaming import sources as I
from tidemark.streaming import stateful


def test_event_table(spark, tables, tmp_path):
    path = str(tmp_path / "events")
    S.write_events(canonical_events(tables.ev), path)
    period = resolve_period(datetime(2024, 1, 20), "7d")
    got = S.read_events(spark, path, period, F.col("shop_id") == "1")
    want = tables.ev.where(period.current(F.col("created_at")) & (F.col("shop_id") == 1))
    assert got.count() == want.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "event_month" in plan.split("PartitionFilters: [")[1][:80]
    assert "GreaterThanOrEqual(created_at" in plan


def test_latest_and_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 202401, "a", 1), (1, 1, 202401, "a", 2), (1, 1, 202402, "b", 1)], "tenant_id int, shop_id int, m int, k string, v int")
    assert sorted(r.v for r in S.latest_by_key(rows, ["k"], "v").collect()) == [1, 2]
    path = str(tmp_path / "t")
    S.overwrite_partitions(rows, path, "m")
    S.overwrite_partitions(rows.where("m = 202402").withColumn("v", F.lit(9)), path, "m")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 9]


def test_insights_and_views(spark, tables, tmp_path):
    path = str(tmp_path / "cards")
    S.write_insights(daily_insights(tables.ev, AS_OF), path)
    S.register_views({"cards": S.read_latest(spark, path, "project_insights")})
    assert spark.sql("SELECT count(*) FROM cards").first()[0] > 0


def test_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    S.write_csv(spark.createDataFrame([('say "hi", you', 1)], "text string, n int"), path)
    lines = {line for file in (tmp_path / "csv").glob("*.csv") for line in file.read_text().splitlines()}
    assert lines == {"text,n", '"say ""hi"", you",1'}


def test_canonical_cast(spark):
    row = canonical_events(spark.createDataFrame([("x", "00000000-0000-0000-0000-000000000000", "US\0")], "name string, tenant_id string, country string")).first()
    assert (row.tenant_id, row.country, row.path, row.properties) == (None, "US", "", {})
    assert row.__fields__ == [f.name for f in spark.createDataFrame([], EVENT_DDL).schema]


def test_retraining(spark, tables, tmp_path):
    evs = tables.evs
    rows = B.training_rows(B.stored_features(B.features(evs, TIMEOUT))).withColumn("has_purchase", (F.col("views_count") % 2).cast("int")).cache()
    columns = {"views_count": "views_count", "cart_adds_count": "cart_adds_count", "distinct_products": "distinct_products", "dwell_time_seconds": "total_dwell_seconds", "avg_scroll_depth": "avg_scroll_depth"}
    out = scoring.retrain(rows, columns, str(tmp_path / "weights"))
    rows.unpersist()
    assert out["price_sensitivity"]["coefficients"] == scoring.PRICE
    assert out["churn_risk"]["metrics"]["f1_score"] > 0.8
    saved = {r.model: json.loads(r.value) for r in spark.read.text(str(tmp_path / "weights")).collect()}
    assert saved["churn_risk"]["coefficients"] == out["churn_risk"]["coefficients"]


def drain(writer):
    writer.awaitTermination()


def test_ingest_stream(spark, tables, tmp_path):
    from tidemark.plans.ingest import _raw

    raw, _ = _raw(tables)
    raw = raw.drop("id")
    (tmp_path / "in").mkdir()
    raw.repartition(4).write.mode("overwrite").json(str(tmp_path / "in" / "a"))
    schema = ", ".join(f"`{n}` {t}" for n, t in raw.dtypes)
    stream = I.read_files(spark, str(tmp_path / "in" / "a"), schema, files_per_trigger=2)
    drain(I.write_tables(stream, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}))
    from tidemark.enrich.payload import track_events

    batch = track_events(spark.read.schema(schema).json(str(tmp_path / "in" / "a")))
    accepted = batch.where("status = 'accepted'")
    got = S.read_events(spark, str(tmp_path / "out" / "events"))
    assert got.count() == accepted.count() > 0
    assert got.drop("batch", "event_month", "properties").exceptAll(accepted.drop("status", "properties")).isEmpty()
    assert spark.read.parquet(str(tmp_path / "out" / "refused")).count() == batch.where("NOT status IN ('accepted', 'crawler_accepted')").count()


def test_stream_survives_odd_bodies(spark, tmp_path):
    """A lone surrogate, a number beyond all bounds, properties nested too deep to read, an unreadable body and a late event."""
    shop, tenant = "00000000-0000-4000-8000-000000000001", "11111111-1111-4111-8111-111111111111"

    def body(at, properties):
        return f'{{"shop_id": "{shop}", "tenant_id": "{tenant}", "name": "page_view", "timestamp": {at}, "properties": {properties}}}'

    deep = '{"a":' * 100_000 + "1" + "}" * 100_000
    first = [body(1_700_000_000, '{"x": "\\ud800", "n": {"y": 1e999}}'), body(1_700_000_000, '{"z": "\\udc00 ok"}'), "{broken", body(1_700_000_000, deep)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"body": b, "user_agent": "Mozilla/5.0 (Windows) Chrome/1"}) + "\n" for b in first))
    schema = "body string, user_agent string, received_at timestamp_ntz"

    def go():
        stream = I.read_files(spark, str(tmp_path / "in"), schema)
        drain(I.write_tables(stream, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}))

    go()
    (tmp_path / "in" / "b.json").write_text("".join(json.dumps({"body": body(at, "{}"), "user_agent": "Mozilla/5.0 (Windows) Chrome/1"}) + "\n" for at in (1_700_000_500, 1_699_000_000)))
    go()
    events = S.read_events(spark, str(tmp_path / "out" / "events"))
    rows = events.collect()
    assert len(rows) == 5 and {r.event_month for r in rows} == {202311}
    assert {r.properties.get("n.y") for r in rows} <= {None, "1e999", "Infinity"} and " ok" in {r.properties.get("z") for r in rows}
    assert spark.read.parquet(str(tmp_path / "out" / "refused")).count() == 1
    late = spark.read.parquet(str(tmp_path / "out" / "late")).collect()
    assert [r.created_at.year for r in late] == [2023] and late[0].created_at < rows[0].created_at


def test_refused_batches(spark):
    from tidemark.enrich.payload import explode_batches, track_events

    event = '{"shop_id": "00000000-0000-4000-8000-000000000001", "tenant_id": "11111111-1111-4111-8111-111111111111", "name": "x"}'
    bodies = ['{"events":[' + ",".join([event] * 501) + "]}", '{"events":[]}', "{oops", "{}"]
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    count = lambda most: {r.status: r["count"] for r in track_events(explode_batches(raw, most)).groupBy("status").count().collect()}
    assert count(None) == {"accepted": 501, "empty_batch": 1, "invalid_json": 2}
    assert count(500) == {"batch_too_large": 1, "empty_batch": 1, "invalid_json": 2}


def test_scratch_needs_a_shared_folder(spark):
    from tidemark.functions.lineage import scratch

    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch(spark, "x").startswith(base)

    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Bare, "x")


def test_messages(spark, tables, tmp_path):
    ev = canonical_events(tables.ev)
    messages = I.keyed_messages(ev).select("key", F.col("value").alias("body"), F.lit("2024-01-01").cast("timestamp_ntz").alias("received_at"))
    poison = spark.createDataFrame([("k", "{broken")], "key string, body string").withColumn("received_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    good, bad = I.parse_events(messages.unionByName(poison))
    assert good.count() == ev.count() and bad.count() == 1
    assert messages.where(F.col("key").rlike("^[0-2]:dev-[0-9]+$")).count() == ev.count()


def test_session_stream_equals_batch(spark, tables, tmp_path):
    path = str(tmp_path / "ev")
    tables.ev.write.parquet(path)
    schema = ", ".join(f"`{n}` {t}" for n, t in tables.ev.dtypes)
    closed = stateful.closed_sessions(I.read_files(spark, path, schema, "parquet"), f"{TIMEOUT} seconds", "0 seconds")
    drain(I.write_sessions(closed, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}))
    got = spark.read.parquet(str(tmp_path / "out" / "sessions")).drop("batch")
    extra = got.select(*[c for c in tables.se.columns]).exceptAll(tables.se)
    assert extra.isEmpty() and got.count() > 0.9 * tables.se.count()
    assert spark.read.parquet(str(tmp_path / "out" / "session_events")).count() == 2 * got.count()


def test_conversion_stream(spark, tables, tmp_path):
    path = str(tmp_path / "ev")
    tables.ev.where("name = 'purchase'").write.parquet(path)
    schema = ", ".join(f"`{n}` {t}" for n, t in tables.ev.dtypes)
    shops = spark.createDataFrame([(1, 1, True, '{"pixel_id": "1", "access_token": "x"}', [])], "tenant_id int, shop_id bigint, enabled boolean, credentials string, events_whitelist array<string>")
    drain(I.forward_conversions(I.read_files(spark, path, schema, "parquet"), shops, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}))
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == tables.ev.where("name = 'purchase' AND shop_id = 1").count() > 0
    assert json.loads(got.first()["payload"])["event_name"] == "Purchase"


@pytest.mark.parametrize("name", ["funnel_steps", "journey_links", "overview_series", "session_records", "intent_radar", "map_distance_clusters"])
def test_partitioning_does_not_matter(spark, name):
    from tidemark.plans import QUERIES

    results = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, QUERIES[name](spark, SF).collect())))
    assert results[0] == results[1]


def test_plans(spark, tables):
    """What the plans rely on at scale: pushed filters, limits before shuffles, no nested-loop joins."""
    from tidemark.operators import traffic as T
    from tidemark.operators.funnel import funnel
    from tidemark.plans.registry import MONTH

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    top = plan(T.top_dimension(tables.during(MONTH), "country", MONTH))
    assert "WindowGroupLimit" in top and "Partial" in top and "GreaterThanOrEqual(created_at" in top
    assert "event_month" in top.split("PartitionFilters: [")[1].split("]")[0]
    # Events of a funnel are shuffled and sorted once, by device and slice; what follows are tables of slices.
    chain = plan(funnel(tables.ev, period=MONTH))
    assert chain.count("Sort [") == 1 and chain.count("_slice") and "GreaterThanOrEqual(ts" in chain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from tidemark.plans import QUERIES

        for name in ("network_lookup", "referrer_classes", "intent_radar", "realtime_geo", "session_assignment", "page_opportunities"):
            text = plan(QUERIES[name](spark, SF))
            assert "Cartesian" not in text and "BroadcastNestedLoop" not in text, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
