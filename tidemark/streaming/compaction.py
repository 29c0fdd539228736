"""Tables a stream appends to, batch by batch, and their closed months folded into sorted files.

A batch puts its rows into ``table/event_month=M/batch=N``, so running it again replaces its own output only. ``compact``
moves what the batches so far brought to closed months into the versioned table ``table-months``, laid out as
``write_events`` does; from then on readers take a month from there and only later batches from the batch folders, and
``vacuum`` may delete the folded ones. What the stream must know of earlier batches is one row in two slots.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeutil import Period, event_months
from tidemark.schema import SHOP
from tidemark.sources.versioned import Versioned, recall, remember

# The instant that decides the month of a row, by table.
TIMES = {"events": "created_at", "late": "created_at", "refused": "created_at", "replay_chunks": "started_at"}
UNDATED = 0


def newest_before(spark: SparkSession, path: str, number: int):
    """Newest instant of all batches before one, or None."""
    row = recall(spark, f"{path}/progress", "newest timestamp_ntz", number)
    return row["newest"] if row else None


def note_progress(spark: SparkSession, path: str, number: int, newest) -> None:
    remember(spark.createDataFrame([(newest,)], "newest timestamp_ntz"), f"{path}/progress", number)


def append(rows: DataFrame, path: str, table: str, number: int) -> None:
    """The rows of one batch, replacing what an earlier run of the batch wrote. Rows without a time lie in month 0."""
    month = F.coalesce(F.date_format(TIMES[table], "yyyyMM").cast("int"), F.lit(UNDATED))
    (rows.withColumn("event_month", month).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_month", "batch").parquet(f"{path}/{table}"))


def _batches(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _folded(spark: SparkSession, path: str, table: str) -> tuple[Versioned, dict[int, int]]:
    """The months table and the last batch that each of its months holds, which its notes say."""
    months = Versioned(spark, f"{path}/{table}-months", "event_month")
    return months, {int(m): int(n) for m, n in months.notes().items()}


def _later(batches: DataFrame, upto: dict[int, int]) -> DataFrame:
    """Batches that their month does not hold yet, by partition columns alone."""
    if not upto:
        return batches
    held = F.create_map(*[F.lit(x) for pair in sorted(upto.items()) for x in pair])
    return batches.where(F.col("batch") > F.coalesce(F.try_element_at(held, F.col("event_month")), F.lit(-1)))


def read(spark: SparkSession, path: str, table: str = "events", period: Period | None = None) -> DataFrame:
    """All rows of a table with their ``event_month``, folded or not. A period selects months before any file is opened."""
    months, upto = _folded(spark, path, table)
    wanted = None if period is None else event_months(period)
    parts = [p for p in (months.read(wanted),) if p is not None]
    if (batches := _batches(spark, path, table)) is not None:
        rows = _later(batches, upto)
        parts.append((rows if wanted is None else rows.where(F.col("event_month").isin(wanted))).drop("batch"))
    if not parts:
        raise ValueError(f"no table {table} in {path}")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out if period is None else out.where(period.current(F.col(TIMES[table])))


def compact(spark: SparkSession, path: str, table: str = "events", open_from: int | None = None) -> list[int]:
    """Fold the months before ``open_from`` (yyyyMM; by default the newest month of any batch) that have batches not yet folded, and return
    them. Files and the note of what they hold switch together, so a reader sees a batch once, folded or not."""
    batches = _batches(spark, path, table)
    if batches is None:
        return []
    months, upto = _folded(spark, path, table)
    # Only partition columns are asked for, so no file content is read.
    last = {r["event_month"]: r["batch"] for r in batches.groupBy("event_month").agg(F.max("batch").alias("batch")).collect()}
    open_from = max(last, default=0) if open_from is None else open_from
    due = sorted(m for m, n in last.items() if m < open_from and n > upto.get(m, -1))
    if not due:
        return []
    fresh = _later(batches, upto).where(F.col("event_month").isin(due)).drop("batch")
    known = months.read(due)
    rows = fresh if known is None else fresh.unionByName(known, allowMissingColumns=True)
    keys = ["event_month", *[c for c in SHOP if c in rows.columns], TIMES[table]]
    months.replace(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), due, {str(m): str(last[m]) for m in due})
    return due


def vacuum(spark: SparkSession, path: str, table: str = "events") -> int:
    """Delete batch folders that their month holds, and versions no longer in use; the number of folders deleted. For a time when no
    reader that began before the last ``compact`` is at work."""
    months, upto = _folded(spark, path, table)
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = len(months.vacuum()) if upto else 0
    for month, last in sorted(upto.items()):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/event_month={month}")
        fs = folder.getFileSystem(hadoop)
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            if int(status.getPath().getName().removeprefix("batch=")) <= last:
                fs.delete(status.getPath(), True)
                gone += 1
        if not fs.listStatus(folder):
            fs.delete(folder, False)
    return gone
