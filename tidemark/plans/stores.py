"""Tables kept up to date in steps: sessions run by run, and what a stream appends, folded by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lineage import scratch
from tidemark.operators.session_store import SessionStore
from tidemark.plans.registry import TIMEOUT, query, sql
from tidemark.plans.sessions import _COLS, _RECORD
from tidemark.streaming import compaction as C

# Events arrive in eleven-day runs; one in 37 comes a run late, and those of every fourth run are sent again with the next.
_RUNS = 3


def _arriving(ev, run):
    own = F.floor(F.dayofmonth("created_at") / 11) + F.when(F.col("id") % 37 == 0, 1).otherwise(0)
    again = own + F.when(F.col("id") % 41 == 0, 1).otherwise(0)
    return ev.where((F.least(own, F.lit(_RUNS - 1)) == run) | (F.least(again, F.lit(_RUNS - 1)) == run))


def _store(t):
    store = SessionStore(t.spark, scratch(t.spark, "session-store"), TIMEOUT)
    for run in range(_RUNS):
        store.advance(_arriving(t.ev, run), run)
    return store


@query("sessions_by_runs", sql(f"SELECT {_RECORD} FROM se"))
def _(t):
    return _store(t).sessions().select(*_COLS)


@query("events_by_runs", sql("SELECT tenant_id, shop_id, device_id, id, created_at, session_id, session_start FROM evs"))
def _(t):
    return _store(t).events.read().select("tenant_id", "shop_id", "device_id", "id", "created_at", "session_id", "session_start")


@query("stream_compacted_events", sql("""SELECT tenant_id, shop_id, name, date_trunc('day', created_at) AS day, count(*) AS count, count(DISTINCT id) AS ids, cast(sum(revenue) AS bigint) AS revenue
FROM ev GROUP BY ALL"""))
def _(t):
    # Batches before and after folds; one of them is run twice.
    path = scratch(t.spark, "stream-tables")
    for number in range(6):
        rows = t.ev.where(F.col("id") % 6 == number)
        for _ in range(2 if number == 4 else 1):
            C.append(rows, path, "events", number)
        if number in (2, 4):
            C.compact(t.spark, path, open_from=209912)
            C.vacuum(t.spark, path)
    out = C.read(t.spark, path).groupBy("tenant_id", "shop_id", "name", F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day"))
    return out.agg(F.count(F.lit(1)).alias("count"), F.count_distinct("id").alias("ids"), F.sum("revenue").alias("revenue"))
