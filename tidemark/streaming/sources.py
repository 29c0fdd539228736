"""Stream inputs and outputs: keyed JSON messages in, tables and keyed JSON messages out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.enrich.payload import replay_chunks, track_events
from tidemark.operators.sessions import end_events, start_events
from tidemark.schema import EVENT_DDL
from tidemark.streaming.compaction import append, newest_before, note_progress

FLUSH_INTERVAL = "2 seconds"


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "json", glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Files that arrive in a folder, as a stream; bad lines keep their fields null."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, rate: int | None = None, accept_loss: bool = False) -> DataFrame:
    """Messages as (key, body, received_at). ``rate`` bounds a micro-batch, so that a backlog does not overrun the sink. Messages that the
    topic no longer holds end the stream unless the caller accepts their loss."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("failOnDataLoss", str(not accept_loss).lower())
    raw = (reader if rate is None else reader.option("maxOffsetsPerTrigger", rate)).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("body"), F.col("timestamp").cast("timestamp_ntz").alias("received_at"))


def parse_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical event messages, and the ones that cannot be read as such."""
    rows = messages.withColumn("e", F.from_json("body", EVENT_DDL))
    good = F.col("e.name").isNotNull() & F.col("e.shop_id").isNotNull() & F.col("e.created_at").isNotNull()
    return rows.where(good).select("e.*"), rows.where(~F.coalesce(good, F.lit(False))).select("body", "received_at")


def keyed_messages(ev: DataFrame) -> DataFrame:
    """Events as messages whose key keeps a shop's device in order."""
    return ev.select(F.concat_ws(":", F.col("shop_id").cast("string"), F.col("device_id")).alias("key"), F.to_json(F.struct(*ev.columns)).alias("value"))


def write_kafka(ev: DataFrame, servers: str, topic: str, checkpoint: str):
    return (keyed_messages(ev).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.compression.type", "snappy")
            .option("topic", topic).option("checkpointLocation", checkpoint).trigger(processingTime=FLUSH_INTERVAL).start())


def write_tables(raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, delay: timedelta = timedelta(minutes=10),
                 enrich: Callable[[DataFrame], DataFrame] | None = None):
    """Request bodies to the tables ``events``, ``late``, ``replay_chunks`` and ``refused``, a micro-batch at a time.

    Bodies are parsed once; the parsed rows are kept while the tables are written from them. ``enrich``, such as
    :func:`tidemark.enrich.assemble.enriched` with its tables, is applied to the accepted ones. Tables lie by month and by batch
    (:mod:`tidemark.streaming.compaction` reads and folds them), so a batch that is run again after a failure replaces its own
    output. Events older than ``delay`` behind the newest of earlier batches are stored and also listed in ``late``, since windowed
    operators on the same stream leave them out.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = track_events(batch).persist()
        accepted = parsed.where(F.col("status") == "accepted").drop("status")
        accepted = accepted if enrich is None else enrich(accepted)
        newest = newest_before(spark, path, number)
        late = accepted.where(F.lit(False) if newest is None else F.col("created_at") < F.lit(newest - delay))
        tables = {"events": accepted, "late": late,
                  "refused": parsed.where(~F.col("status").isin("accepted", "crawler_accepted")).select("status", "name", "created_at"),
                  "replay_chunks": replay_chunks(batch).where(F.col("status") == "accepted").drop("status")}
        for name, rows in tables.items():
            append(rows, path, name, number)
        latest = accepted.agg(F.max("created_at")).first()[0]
        note_progress(spark, path, number, max((x for x in (newest, latest) if x is not None), default=None))
        parsed.unpersist()

    return raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": FLUSH_INTERVAL})).start()


def write_sessions(closed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Closed sessions with their start and end events to the tables ``sessions`` and ``session_events``."""
    def save(batch: DataFrame, number: int) -> None:
        stored = f"{path}/sessions/batch={number}"
        batch.write.mode("overwrite").parquet(stored)
        # The marker events are derived from the stored rows, so the state is read once.
        rows = batch.sparkSession.read.schema(batch.schema).parquet(stored)
        start_events(rows).unionByName(end_events(rows)).write.mode("overwrite").parquet(f"{path}/session_events/batch={number}")

    return closed.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": FLUSH_INTERVAL})).start()


def forward_conversions(ev: DataFrame, integrations: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Conversion payloads as JSON files, for a sender to pick up."""
    from tidemark.export.conversions import as_json, payloads

    def save(batch: DataFrame, number: int) -> None:
        as_json(payloads(batch, integrations)).write.mode("overwrite").json(f"{path}/batch={number}")

    return ev.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": FLUSH_INTERVAL})).start()
