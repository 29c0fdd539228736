r"""Secret scan over a ledger of blobs, by DataFrame and SQL functions only.

Every historical version of every path is addressed by the SHA-256 of its text. The ledger holds one row per scanned
(blob, rule version); a run scans only the pairs that it lacks and appends them, then joins the findings back to every
path and version. Copies, renames and reverts therefore cost a hash, not a scan.

A finding is (kind, start, end) in code points, end exclusive. Matches are leftmost and non-overlapping per kind; one
whose secret part is too short is dropped but still consumes its characters.

Defined cases: a null text is an empty one; ids may be null or repeated, each row gets its own result; other columns
are never read by name; an empty table gives no rows; a ledger folder that does not exist yet is an empty ledger.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import scratch
from tidemark.llm.common import set_aside

# Kind, Java pattern, the group that holds the secret, its least length. Order is the order of kinds.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
LEDGER = ("blob string, rule_version string, rows_scanned bigint, "
          "findings array<struct<start:bigint,rule:int,kind:string,end:bigint>>")


def rule_version(rules=RULES) -> str:
    """Changes whenever a rule does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, order: int, rule: tuple) -> Column:
    """One entry per match: rule, position in the text's matches, lengths of the gap before it, of it and its secret."""
    kind, pattern, group, _ = rule
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("secret"))
    entries = F.transform(found, lambda x, i: F.struct(
        F.lit(order).alias("rule"), i.alias("nth"), F.length(x["gap"]).cast("bigint").alias("gap"),
        F.length(x["whole"]).cast("bigint").alias("whole"), F.length(x["secret"]).alias("secret")))
    return F.when(text.rlike(pattern), entries).otherwise(F.array().cast(
        "array<struct<rule:int,nth:int,gap:bigint,whole:bigint,secret:int>>"))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of (blob, text) rows; a blob without findings gets a row too."""
    text = F.col("text")
    each = blobs.select("blob", F.explode_outer(F.concat(*[_matches(text, i, r) for i, r in enumerate(rules)])).alias("m"))
    each = each.select("blob", "m.*")
    here = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.coalesce("whole", F.lit(0))).over(here))
    kind = F.element_at(F.array(*[F.lit(r[0]) for r in rules]), F.col("rule") + 1)
    least = F.element_at(F.array(*[F.lit(r[3]) for r in rules]), F.col("rule") + 1)
    span = F.when(F.col("secret") >= least, F.struct((F.col("end") - F.col("whole")).alias("start"), "rule", kind.alias("kind"), "end"))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("findings"))


def _ledger(spark, folder: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def update(versions: DataFrame, folder: str, text: str = "text", rules=RULES) -> DataFrame:
    """Scan the blobs of ``versions`` that the ledger in ``folder`` lacks for this rule version, append them and return
    the ledger's rows of this rule version."""
    spark, version = versions.sparkSession, rule_version(rules)
    known = _ledger(spark, folder).where(F.col("rule_version") == version).select("blob")
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Each task folds its copies of a blob into one row before the shuffle, however many there are.
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")
    rows = scan(unseen, rules)
    (rows.select("blob", F.lit(version).alias("rule_version"), F.lit(1).cast("bigint").alias("rows_scanned"), "findings")
     .write.mode("append").parquet(folder))
    return _ledger(spark, folder).where(F.col("rule_version") == version)


def secrets(versions: DataFrame, folder: str | None = None, text: str = "text", rules=RULES) -> DataFrame:
    """``versions`` without its text, with ``blob`` and ``findings``, one row per input row; columns of those names are
    returned as ``source_…``. Only blobs with findings are joined, so rows of a blob without any, such as the empty one,
    however many, match nothing.

    ``folder`` is the ledger; without one a new ledger is started in the shared folder of the session.
    """
    folder = folder or scratch(versions.sparkSession, "blob-ledger")
    ledger = update(versions, folder, text, rules)
    versions = set_aside(versions, [c for c in ("blob", "findings") if c != text])
    other = [c for c in versions.columns if c != text]
    paths = versions.select(*other, blob_id(F.col(text)).alias("blob"))
    found = ledger.where(F.size("findings") > 0).select("blob", "findings")
    none = F.array().cast(found.schema["findings"].dataType)
    return paths.join(found, "blob", "left").select(*other, "blob", F.coalesce("findings", none).alias("findings"))


def described(findings: Column) -> Column:
    """kind:start:end of every finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def counted(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("bigint")


def redacted(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The text with one mark in place of each run of overlapping spans."""
    def step(done, f):
        until = F.greatest(done["at"], f["end"])
        before = F.substr(text, (done["at"] + 1).cast("int"), (f["start"] - done["at"]).cast("int"))
        return F.when(f["start"] >= done["at"], F.struct(until.alias("at"), F.concat(done["out"], before, F.lit(mark)).alias("out"))
                      ).otherwise(F.struct(until.alias("at"), done["out"].alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(findings) > 0, F.aggregate(
        findings, start, step, lambda done: F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text))))
        ).otherwise(text)


def redact(docs: DataFrame, folder: str | None = None, text: str = "text", n_chars: str = "n_chars",
           mark: str = "[secret]", rules=RULES) -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; ``n_chars``, where there is one, follows. A null text stays null."""
    folder = folder or scratch(docs.sparkSession, "blob-ledger")
    found = update(docs, folder, text, rules).where(F.size("findings") > 0).select(
        F.col("blob").alias("__blob"), F.col("findings").alias("__found"))
    rows = docs.withColumn("__blob", blob_id(F.col(text))).join(found, "__blob", "left")
    clean = F.when(F.size("__found") > 0, redacted(F.col(text), F.col("__found"), mark)).otherwise(F.col(text))
    rows = rows.withColumn("__clean", clean)
    if n_chars in docs.columns:
        rows = rows.withColumn(n_chars, F.when(F.col("__found").isNotNull(), F.length("__clean").cast(
            docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return rows.withColumn(text, F.col("__clean")).select(docs.columns)
