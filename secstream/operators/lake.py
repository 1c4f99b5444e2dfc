"""The Parquet archive: day partitions, verification, compaction, retention, snapshots, reports.

Which day folders are live is named by manifests (``sources/manifest.py``): archiving a day again, compacting it and
dropping it replace its folders in one step. Rows outside the expected days go to the default partition in the same
commit; no job ever drops them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secstream import schema
from secstream.functions.scalar import as_time, ratio
from secstream.sources.manifest import NO_VALUE, Live, Manifest

TARGET_FILE_BYTES = 128 << 20
ARCHIVE_COLUMNS = schema.ARCHIVE.fieldNames()
DEFAULT_PARTITION = "_default"


def with_day(ev: DataFrame) -> DataFrame:
    """Add the UTC day of the event time as partition columns."""
    return ev.select(
        "*", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day")
    )


def day_between(first: dt.date, last: dt.date) -> Column:
    """A predicate on the partition columns alone, so that it prunes directories.

    A filter on ``ts`` prunes row groups but still lists and opens every day.
    """
    return F.make_date("year", "month", "day").between(F.lit(first), F.lit(last))


def split_by_range(ev: DataFrame, first: dt.date, last: dt.date) -> tuple[DataFrame, DataFrame]:
    """Rows inside the expected days, and rows for the default partition that is only reported."""
    inside = F.to_date("ts").between(F.lit(first), F.lit(last))
    return ev.filter(inside), ev.filter(~inside | F.col("ts").isNull())


def to_archive(ev: DataFrame) -> DataFrame:
    """The archive's explicit columns; labels become JSON text."""
    return with_day(ev.withColumn("labels", F.to_json("labels"))).select(*ARCHIVE_COLUMNS, *schema.DAY_PARTS)


def write_days(
    ev: DataFrame,
    path: str,
    rows_per_file: int = 1_500_000,
    compression: str = "zstd",
    expected: tuple[dt.date, dt.date] | None = None,
    run: str | None = None,
) -> None:
    """Write the days found in ``ev``, replacing those days and no others.

    Rows are range-partitioned by time: a heavy day is spread over several tasks, a light one
    does not get a file from every task, and files hold adjacent times, so that row-group
    statistics on ``ts`` stay selective. Rows without a time, or outside the ``expected`` days where given, are
    added to the default partition by the same commit; repeating a ``run`` replaces what it added there.
    """
    run, table = run or uuid.uuid4().hex, Manifest(ev.sparkSession, path)
    rows = to_archive(ev)
    if expected is not None:
        inside = F.coalesce(F.to_date("ts").between(F.lit(expected[0]), F.lit(expected[1])), F.lit(False))
        rows = rows.withColumns({p: F.when(inside, F.col(p)) for p in schema.DAY_PARTS})
    rows = rows.repartitionByRange(*schema.DAY_PARTS, "ts").sortWithinPartitions(*schema.DAY_PARTS, "ts")
    new = table.stage(rows, schema.DAY_PARTS, compression=compression, maxRecordsPerFile=rows_per_file)
    days = {_day_part(f) for f in new if not _is_default(f)}

    def change(now: Live):
        stays = [(f, r) for f, r in now.folders if (r != run if _is_default(f) else _day_part(f) not in days)]
        return [*stays, *((f, run) for f in new)], {*now.runs, run}

    table.commit(change)


def _day_part(folder: str) -> str:
    return "/".join(folder.split("/")[1:])


def _is_default(folder: str) -> bool:
    return NO_VALUE in folder


def _folder_of(day: dt.date) -> str:
    return f"year={day.year}/month={day.month}/day={day.day}"


def archive_day(ev: DataFrame, day: dt.date, path: str, compression: str = "zstd") -> bool:
    """Archive one UTC day ``[day, day + 1)``. Returns False, writing nothing, for an empty day."""
    return archive_days(ev, day, day, path, compression)


def archive_days(ev: DataFrame, first: dt.date, last: dt.date, path: str, compression: str = "zstd") -> bool:
    """Archive a range of days in one job."""
    start, end = F.lit(first).cast("timestamp"), F.lit(last + dt.timedelta(days=1)).cast("timestamp")
    rows = ev.filter((F.col("ts") >= start) & (F.col("ts") < end))
    if rows.isEmpty():
        return False
    write_days(rows, path, compression=compression)
    return True


def read_archive(spark: SparkSession, path: str, day: dt.date | None = None) -> DataFrame:
    """All days or one; the schema is explicit, so a column that is absent from old files is null."""
    wanted = (lambda f: not _is_default(f)) if day is None else (lambda f: _day_part(f) == _folder_of(day))
    return Manifest(spark, path).read(schema.ARCHIVE_WITH_DAY, wanted)


def read_default(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the default partition."""
    return Manifest(spark, path).read(schema.ARCHIVE_WITH_DAY, _is_default).drop(*schema.DAY_PARTS)


def archived_days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days that the newest manifest names; a listing, never a scan."""
    found = {_day_part(f) for f, _ in Manifest(spark, path).live().folders if not _is_default(f)}
    return sorted(dt.date(*(int(p.split("=")[1]) for p in f.split("/"))) for f in found)


def _content_hash(rows: DataFrame) -> list[Column]:
    hashed = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ARCHIVE_COLUMNS])
    return [F.count("*").alias("rows"), F.sum(hashed.cast("decimal(20,0)")).alias("content")]


def verify_archive(source: DataFrame, archive: DataFrame) -> DataFrame:
    """Per day: rows and an order-independent content hash on both sides, and whether they agree."""
    def per_day(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(*schema.DAY_PARTS).agg(*_content_hash(rows)).select(
            *schema.DAY_PARTS, F.col("rows").alias(f"{side}_rows"), F.col("content").alias(f"{side}_content")
        )

    both = per_day(to_archive(source), "source").join(per_day(archive, "archive"), schema.DAY_PARTS, "full")
    same = (F.col("source_rows") == F.col("archive_rows")) & (F.col("source_content") == F.col("archive_content"))
    return both.select(*schema.DAY_PARTS, "source_rows", "archive_rows", F.coalesce(same, F.lit(False)).alias("ok"))


def archive_files(archive: DataFrame) -> DataFrame:
    """One row per file: path, bytes, rows, day."""
    return archive.groupBy(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), *schema.DAY_PARTS
    ).agg(F.count("*").alias("rows"))


def storage_stats(archive: DataFrame) -> DataFrame:
    return (
        archive_files(archive)
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        .withColumn("bytes_per_row", F.round(ratio(F.col("bytes"), F.col("rows")), 1))
    )


def compare_tiers(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """Bytes per row of two storage tiers and how much cheaper the archive is."""
    hot_line = hot.agg(
        F.sum("bytes").alias("hot_bytes"), F.sum("rows").alias("hot_rows")
    ).withColumn("hot_bytes_per_row", F.round(ratio(F.col("hot_bytes"), F.col("hot_rows")), 1))
    lake = storage_stats(archive).select("bytes_per_row").scalar()
    return hot_line.withColumn("archive_bytes_per_row", lake).withColumn(
        "times_cheaper", F.round(ratio(F.col("hot_bytes_per_row"), F.col("archive_bytes_per_row")), 1)
    )


def partition_report(archive: DataFrame) -> DataFrame:
    """Rows, files and bytes per day."""
    return archive_files(archive).groupBy(*schema.DAY_PARTS).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("bytes").alias("bytes")
    )


def small_files_report(archive: DataFrame, target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Days with more files than their bytes call for."""
    wanted = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(target_bytes)))
    return partition_report(archive).withColumn("wanted_files", wanted).withColumn(
        "compact", F.col("files") > F.col("wanted_files")
    )


def retention_plan(days: DataFrame, as_of, retain_days: int = 30) -> DataFrame:
    """Day partitions older than the retention; the default partition is never among them."""
    if retain_days < 1:
        raise ValueError("retain_days must be at least 1")
    cutoff = F.date_sub(F.to_date(as_time(as_of)), retain_days)
    return (
        days.select(*schema.DAY_PARTS)
        .distinct()
        .withColumn("partition_day", F.make_date(*schema.DAY_PARTS))
        .filter(F.col("partition_day") < cutoff)
    )


class _Files:
    """Renames and deletions on whatever file system the path is on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def sizes(self, path: str) -> list[int]:
        """Bytes of each data file of a folder."""
        return [s.getLen() for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().endswith(".parquet")]

    def subfolders(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def day_folder(path: str, day: dt.date) -> str:
    return f"{path}/year={day.year}/month={day.month}/day={day.day}"


def apply_retention(spark: SparkSession, path: str, as_of: dt.date, retain_days: int = 30, dry_run: bool = True) -> list[dt.date]:
    """Drop the days of a manifest table, or the day folders of a plain one, that are past the retention, and return
    them. The default is to drop nothing; the default partition is never among them.

    Only names are looked at, so this costs a listing, never a scan.
    """
    if retain_days < 1:
        raise ValueError("retain_days must be at least 1")
    cutoff = as_of - dt.timedelta(days=retain_days)
    table = Manifest(spark, path)
    if table.live().number:
        dropped = [d for d in archived_days(spark, path) if d < cutoff]
        if dropped and not dry_run:
            gone = {_folder_of(d) for d in dropped}
            table.commit(lambda now: ([x for x in now.folders if _day_part(x[0]) not in gone], now.runs))
        return dropped
    files = _Files(spark, path)
    dropped = []
    for year in _numbers(files.subfolders(path), "year"):
        for month in _numbers(files.subfolders(f"{path}/year={year}"), "month"):
            for day in _numbers(files.subfolders(f"{path}/year={year}/month={month}"), "day"):
                if dt.date(year, month, day) < cutoff:
                    dropped.append(dt.date(year, month, day))
    if not dry_run:
        for day in dropped:
            files.remove(day_folder(path, day))
    return sorted(dropped)


def _numbers(names: list[str], part: str) -> list[int]:
    return sorted(int(n.removeprefix(f"{part}=")) for n in names if n.startswith(f"{part}="))


def compact_day(spark: SparkSession, path: str, day: dt.date, target_bytes: int = TARGET_FILE_BYTES) -> dict:
    """Rewrite a day into files of about ``target_bytes``.

    The replacement is written and counted first; one manifest then puts it in the place of the old folders, so
    a reader sees every row once at any moment, and a crash before that changes nothing.
    """
    table = Manifest(spark, path)
    old = [f for f, _ in table.live().folders if _day_part(f) == _folder_of(day)]
    files = _Files(spark, path)
    sizes = [n for f in old for n in files.sizes(f"{path}/data/{f}")]
    if len(sizes) <= 1:
        return {"day": day, "before": len(sizes), "after": len(sizes), "compacted": False}
    rows = table.read(schema.ARCHIVE_WITH_DAY, set(old).__contains__)
    pieces = max(1, -(-sum(sizes) // target_bytes))
    arranged = rows.repartitionByRange(pieces, "ts") if pieces > 1 else rows.repartition(1)
    new = table.stage(arranged.sortWithinPartitions("ts"), schema.DAY_PARTS, compression="zstd")
    expected, written = rows.count(), table.spark.read.schema(schema.ARCHIVE).parquet(*(f"{path}/data/{f}" for f in new)).count()
    if expected != written:
        raise RuntimeError(f"compaction of {day} wrote {written} of {expected} rows")
    if not table.swap(old, new, f"compact-{day}"):
        return {"day": day, "before": len(sizes), "after": len(sizes), "compacted": False}
    after = sum(len(files.sizes(f"{path}/data/{f}")) for f in new)
    return {"day": day, "before": len(sizes), "after": after, "rows": written, "compacted": True}


def pruning_report(archive: DataFrame, day: dt.date) -> DataFrame:
    """Rows that a full scan, a partition filter and a filter on the time give, and the files that hold them."""
    start = F.lit(day).cast("timestamp")
    on_time = (F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY"))
    variants = {"full_scan": archive, "partition_filter": archive.filter(day_between(day, day)), "time_filter": archive.filter(on_time)}
    report = None
    for name, rows in variants.items():
        per_file = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
        line = per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("files_with_rows")).select(F.lit(name).alias("variant"), "*")
        report = line if report is None else report.unionByName(line)
    return report


# --- snapshots: appended loads with a number -------------------------------------------------


def snapshot_append(batch: DataFrame, path: str, load_id: int) -> None:
    """Append a batch as snapshot ``load_id``; writing the same number again replaces it."""
    (
        batch.withColumn("load_id", F.lit(load_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("load_id")
        .parquet(path)
    )


def snapshot_as_of(table: DataFrame, load_id: int) -> DataFrame:
    """The table as it was after snapshot ``load_id`` (prunes later loads)."""
    return table.filter(F.col("load_id") <= load_id)


def snapshot_history(table: DataFrame, at: str = "ingested_at") -> DataFrame:
    """Snapshots with their rows and the running total."""
    return (
        table.groupBy("load_id")
        .agg(F.max(at).alias("committed_at"), F.count("*").alias("added_rows"))
        .select(
            "load_id", "committed_at", F.lit("append").alias("operation"), "added_rows",
            F.sum("added_rows").over(Window.orderBy("load_id").rowsBetween(Window.unboundedPreceding, 0)).alias("total_rows"),
        )
    )


def read_evolved(spark: SparkSession, path: str, columns) -> DataFrame:
    """Read old and new files under a wider schema: a column a file lacks is null."""
    return spark.read.schema(columns).parquet(path)


# --- the daily job ---------------------------------------------------------------------------


class QualityGateFailed(RuntimeError):
    """Correctness checks failed; nothing was archived."""


def daily_maintenance(
    ev: DataFrame,
    checks: DataFrame,
    day: dt.date,
    path: str,
    hot_path: str | None = None,
    retain_days: int = 30,
    side_jobs: dict[str, Callable[[], object]] | None = None,
    dry_run: bool = True,
) -> dict:
    """Quality gate, side jobs (baselines, scoring), archive, verify, compact, retention.

    Failing correctness checks stop everything; failing liveness checks are only reported. An
    empty day skips the archive chain. Retention works on the hot tables under ``hot_path``, never on
    the archive under ``path``: an old hot day is dropped only if that very day verifies in the archive.
    """
    spark = ev.sparkSession
    failing = [(r["check_name"], r["category"]) for r in checks.filter(~F.col("passed")).collect()]
    blocking = sorted(name for name, category in failing if category == "correctness")
    if blocking:
        raise QualityGateFailed(f"correctness checks failing: {blocking}")
    result: dict = {"liveness": sorted(name for name, _ in failing)}
    for name, job in (side_jobs or {}).items():
        result[name] = job()
    if not archive_day(ev, day, path):
        return result | {"archived": False}
    start = F.lit(day).cast("timestamp")
    source = ev.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    if not verify_archive(source, read_archive(spark, path, day)).agg(F.bool_and("ok")).first()[0]:
        raise RuntimeError(f"archive verification failed for {day}")
    compacted = compact_day(spark, path, day)
    result |= {"archived": True, "verified": True, "compacted": compacted, "retention": [], "kept_unverified": []}
    if hot_path is None:
        return result
    files = _Files(spark, hot_path)
    for old in apply_retention(spark, hot_path, day + dt.timedelta(days=1), retain_days, dry_run=True):
        hot_day = spark.read.schema(schema.T.StructType(schema.FLAT_EVENT)).parquet(day_folder(hot_path, old))
        safe = old in archived_days(spark, path) and verify_archive(hot_day, read_archive(spark, path, old)).agg(F.bool_and("ok")).first()[0]
        if safe and not dry_run:
            files.remove(day_folder(hot_path, old))
        result["retention" if safe else "kept_unverified"].append(old)
    return result
