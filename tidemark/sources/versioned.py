"""Tables whose partitions are replaced whole while others read them.

A write puts the new content of some partitions into a folder of its own and then switches: the state, one row that names
the folder of every partition, is written to the slot that readers do not use. There are two slots, so listing the state
costs the same after a thousand writes; a write that fails before the switch leaves the table as it was, and running it
again has the same result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "folders map<string,string>, notes map<string,string>"


def recall(spark: SparkSession, path: str, ddl: str, before: int | None = None):
    """The row with the largest ``number`` (below ``before``) of the two slots, or None."""
    try:
        rows = spark.read.schema(f"number int, {ddl}").parquet(path).drop("slot")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    rows = rows if before is None else rows.where(F.col("number") < before)
    return rows.orderBy(F.desc("number")).first()


def remember(row: DataFrame, path: str, number: int) -> None:
    """Put a row into the slot of its number; the other slot keeps that of the number before."""
    row.withColumn("number", F.lit(number)).coalesce(1).write.mode("overwrite").parquet(f"{path}/slot={number % 2}")


class Versioned:
    """A table in ``path`` partitioned by the column ``by``."""

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path, by

    def _state(self) -> tuple[int, dict[str, str], dict[str, str]]:
        row = recall(self.spark, f"{self.path}/state", STATE)
        return (row["number"], dict(row["folders"]), dict(row["notes"])) if row else (0, {}, {})

    def partitions(self) -> set[str]:
        return set(self._state()[1])

    def notes(self) -> dict[str, str]:
        """What the last write of each partition noted about it."""
        return self._state()[2]

    def read(self, partitions=None) -> DataFrame | None:
        """The rows of the given partitions, all if none are given; None where there is no such partition. Only their folders are
        listed."""
        _, folders, _ = self._state()
        chosen = sorted(set(folders) if partitions is None else {str(p) for p in partitions} & set(folders))
        if not chosen:
            return None
        by_folder: dict[str, list[str]] = {}
        for p in chosen:
            by_folder.setdefault(folders[p], []).append(f"{self.path}/{folders[p]}/{self.by}={p}")
        out = None
        for folder, paths in sorted(by_folder.items()):
            part = self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(*paths)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def replace(self, rows: DataFrame, partitions, notes: dict[str, str] | None = None) -> None:
        """Make ``rows`` the content of the given partitions, which must be all those they lie in. A partition without rows is gone.
        ``notes`` are kept by partition and switch with it."""
        number, folders, noted = self._state()
        folder = f"v{number + 1}"
        target = f"{self.path}/{folder}"
        rows.write.mode("overwrite").partitionBy(self.by).parquet(target)
        given = {str(p) for p in partitions}
        present = {name.removeprefix(f"{self.by}=") for name in self._names(target) if name.startswith(f"{self.by}=")}
        if not present <= given:
            raise ValueError(f"rows outside the partitions to replace: {sorted(present - given)[:5]}")
        kept = {p: f for p, f in folders.items() if p not in given} | {p: folder for p in present}
        state = self.spark.createDataFrame([(kept, noted | (notes or {}))], STATE)
        remember(state, f"{self.path}/state", number + 1)

    def _folder(self, path: str):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        root, fs = self._folder(path)
        return [s.getPath().getName() for s in fs.listStatus(root)]

    def vacuum(self) -> list[str]:
        """Delete the folders that neither the table nor its last version names; the names of what went."""
        rows = self.spark.read.schema(f"number int, {STATE}").parquet(f"{self.path}/state")
        used = {f for r in rows.collect() for f in r["folders"].values()}
        root, fs = self._folder(self.path)
        gone = sorted(n for n in self._names(self.path) if n.startswith("v") and n not in used)
        for name in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
        return gone
