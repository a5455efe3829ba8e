"""Stored tables: clustered snapshots under a commit list, and append-only logs.

A snapshot table is dealt over buckets by the hash of its layout's columns, and a bucket's files are sorted by
them. The commit's manifest has the bucket and the bounds of every file, so a reader that knows the columns'
values opens only the files that can hold them, and a writer replaces only the buckets that it changes. The
schedules are stored twice, by train and by pattern and stop.

Logs lie by departure date and, below it, by batch. A batch is replaced as a whole when it is run again. The
batches of a date are merged into one by ``compact_log``; the commit list says which ones the merged files cover.
"""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass
from itertools import product
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbeam.schemas import COLUMNS, TABLES
from railbeam.sources.commits import Commit, File, VersionConflict, files_of, latest, publish, read_manifest
from railbeam.sources.files import age_ms, delete, names

__all__ = ["Commit", "RailTables", "VersionConflict", "compact_log", "empty_table", "latest", "load_tables", "read_table"]

SNAPSHOT_TABLES = ["schedule", "schedule_secondary", "stanox", "association", "subscribers"]
LOG_TABLES = ["movement_log", "cancellation_log", "change_of_origin_log"]


@dataclass(frozen=True)
class Layout:
    """Whose columns a stored table has, and the columns that deal and sort it; without any it is one bucket."""

    content: str
    by: tuple[str, ...]


BY_TRAIN, BY_STOP = ("schedule_train_id",), ("days_run_pattern", "stanox_code")
LAYOUTS = {
    "schedule": Layout("schedule", BY_TRAIN),
    "schedule_by_stop": Layout("schedule", BY_STOP),
    "schedule_secondary": Layout("schedule_secondary", BY_TRAIN),
    "schedule_secondary_by_stop": Layout("schedule_secondary", BY_STOP),
    "stanox": Layout("stanox", ()),
    "association": Layout("association", ("main_schedule_train_id",)),
    "subscribers": Layout("subscribers", BY_TRAIN),
    "watched_stops": Layout("watched_stops", BY_TRAIN),
}
#: The second copy of a table.
COPIES = {"schedule": "schedule_by_stop", "schedule_secondary": "schedule_secondary_by_stop"}


@dataclass(frozen=True)
class RailTables:
    """The tables the public queries read."""

    schedule: DataFrame
    schedule_secondary: DataFrame
    stanox: DataFrame
    association: DataFrame
    subscribers: DataFrame
    movement_log: DataFrame
    cancellation_log: DataFrame
    change_of_origin_log: DataFrame


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows, known to be empty when the plan is made, so that joins with it vanish."""
    return spark.createDataFrame([], TABLES[table]).filter(F.lit(False))


# Buckets ------------------------------------------------------------------------------------------


def bucket_of(columns: Iterable[str | Column], buckets: int) -> Column:
    """The bucket of a row; a null counts as an empty text. ``bucket_number`` gives the same for values."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])
    return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int")


def bucket_number(values: Iterable[str | None], buckets: int) -> int:
    return crc32("|".join(v or "" for v in values).encode()) % buckets


def touched_buckets(rows: DataFrame, column: str, buckets: int) -> set[int]:
    """The buckets, by one column, that some rows belong to: at most as many as there are."""
    return {r[0] for r in rows.select(bucket_of([column], buckets)).distinct().collect()}


def _may_hold(file: File, by: tuple[str, ...], only: Mapping[str, Collection[str]]) -> bool:
    """Whether the bounds of a file leave room for one of the wanted values of each column."""
    for low, high, column in zip(file.low, file.high, by, strict=True):
        wanted = only.get(column)
        if wanted is not None and (low is None or not any(low <= v <= high for v in wanted)):
            return False
    return True


def chosen_files(
    spark: SparkSession, root: str, commit: Commit, table: str, only: Mapping[str, Collection[str]] | None = None, buckets: Collection[int] | None = None
) -> list[File]:
    """The files that can hold rows with the wanted values, or of the wanted buckets."""
    layout, found = LAYOUTS[table], files_of(spark, root, commit, table)
    if buckets is not None:
        found = [f for f in found if f.bucket in buckets]
    if only and layout.by:
        if all(c in only for c in layout.by):
            wanted = {bucket_number(v, commit.buckets) for v in product(*[only[c] for c in layout.by])}
            found = [f for f in found if f.bucket in wanted]
        found = [f for f in found if _may_hold(f, layout.by, only)]
    return found


# Snapshots ----------------------------------------------------------------------------------------


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    commit: Commit | None = None,
    only: Mapping[str, Collection[str]] | None = None,
    buckets: Collection[int] | None = None,
) -> DataFrame:
    """A table as of a commit. Whoever reads several tables takes ``latest`` once.

    ``only`` (column to values) and ``buckets`` leave out files, not rows: the caller still filters.
    """
    commit = latest(spark, root) if commit is None else commit
    if table in LOG_TABLES:
        return read_log(spark, root, table, commit)
    content = LAYOUTS[table].content
    files = chosen_files(spark, root, commit, table, only, buckets)
    if not files:
        return empty_table(spark, content)
    return spark.read.schema(TABLES[content]).parquet(*[f"{root}/{f.path}" for f in files])


def write_files(rows: DataFrame, root: str, table: str, buckets: int) -> list[File]:
    """Write rows in a table's layout into a new folder; the files with their bounds.

    Buckets are rebalanced by their sizes, so a bucket with much of the table is several tasks and files.
    """
    spark, layout = rows.sparkSession, LAYOUTS[table]
    folder = f"{table}/{uuid.uuid4().hex}"
    bucket = bucket_of(layout.by, buckets) if layout.by else F.lit(0)
    placed = rows.select(*COLUMNS[layout.content], bucket.alias("bucket")).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", *layout.by).write.partitionBy("bucket").parquet(f"{root}/{folder}")
    written = spark.read.schema(f"{TABLES[layout.content]}, bucket int").parquet(f"{root}/{folder}")
    ends = [f(F.col(c)).alias(f"{f.__name__}_{i}") for i, c in enumerate(layout.by) for f in (F.min, F.max)]
    sizes = written.groupBy("bucket", F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"), *ends)
    places = range(len(layout.by))
    return [
        File(
            f"{folder}/bucket={r['bucket']}/{r['name']}",
            r["bucket"],
            r["rows"],
            [r[f"min_{i}"] for i in places],
            [r[f"max_{i}"] for i in places],
        )
        for r in sorted(sizes.collect(), key=lambda r: (r["bucket"], r["name"]))  # one row for each file
    ]


def replaced(
    rows: DataFrame, root: str, table: str, commit: Commit, buckets: Collection[int] | None = None
) -> list[File]:
    """The files of a table whose content, or that of some buckets, becomes ``rows``; the other files stay."""
    kept = [] if buckets is None else [f for f in files_of(rows.sparkSession, root, commit, table) if f.bucket not in buckets]
    return kept + write_files(rows, root, table, commit.buckets)


def replaced_with_copy(
    rows: DataFrame, root: str, table: str, commit: Commit, buckets: Collection[int] | None = None
) -> dict[str, list[File]]:
    """The same for a table that is stored twice. The second copy changes where rows have come or gone.

    A row never changes under its id, so the difference of ids tells what has come and what has gone.
    """
    spark, copy = rows.sparkSession, COPIES[table]
    files = replaced(rows, root, table, commit, buckets)
    if buckets is None:
        return {table: files, copy: replaced(_of_files(spark, root, table, files), root, copy, commit)}
    new = [f for f in files if f.bucket in buckets]
    after = _of_files(spark, root, table, new)
    before = read_table(spark, root, table, commit, buckets=buckets)
    come, gone = after.join(before, "id", "left_anti"), before.join(after, "id", "left_anti")
    by = LAYOUTS[copy].by
    moved = come.select(*by).unionByName(gone.select(*by)).select(bucket_of(by, commit.buckets)).distinct()
    places = {r[0] for r in moved.collect()}  # at most as many as there are buckets
    there = read_table(spark, root, copy, commit, buckets=places)
    left = there.join(gone.select("id"), "id", "left_anti").select(*rows.columns)
    return {table: files, copy: replaced(left.unionByName(come.select(*rows.columns)), root, copy, commit, places)}


def _of_files(spark: SparkSession, root: str, table: str, files: list[File]) -> DataFrame:
    content = LAYOUTS[table].content
    if not files:
        return empty_table(spark, content)
    return spark.read.schema(TABLES[content]).parquet(*[f"{root}/{f.path}" for f in files])


def write_snapshots(
    spark: SparkSession,
    root: str,
    tables: dict[str, DataFrame],
    based_on: Commit | None = None,
    reads: Iterable[str] = (),
) -> Commit:
    """Make new whole contents of some tables current, with the copies of those that have one."""
    based_on = latest(spark, root) if based_on is None else based_on
    content: dict[str, list[File]] = {}
    for name, rows in tables.items():
        if name in COPIES:
            content.update(replaced_with_copy(rows, root, name, based_on))
        else:
            content[name] = replaced(rows, root, name, based_on)
    return publish(spark, root, based_on, content, reads)


def load_tables(
    spark: SparkSession,
    root: str,
    commit: Commit | None = None,
    trains: Collection[str] | None = None,
    stops: Collection[tuple[str, str]] | None = None,
    dates: tuple[dt.date | None, dt.date | None] | None = None,
) -> RailTables:
    """All tables as of one commit.

    With ``trains`` or ``stops`` (pattern and stop), the schedules are opened only where rows of these can be, in
    the copy that is sorted by them; with ``dates`` the logs only of these days, both ends included.
    """
    commit = latest(spark, root) if commit is None else commit

    def schedule(table: str) -> DataFrame:
        if stops is not None:
            wanted = {"days_run_pattern": {p for p, _ in stops}, "stanox_code": {s for _, s in stops}}
            return read_table(spark, root, COPIES[table], commit, wanted)
        return read_table(spark, root, table, commit, None if trains is None else {"schedule_train_id": trains})

    parts = {t: read_table(spark, root, t, commit) for t in SNAPSHOT_TABLES if t not in COPIES}
    parts |= {t: schedule(t) for t in COPIES}
    return RailTables(**parts, **{t: read_log(spark, root, t, commit, dates) for t in LOG_TABLES})


# Logs ---------------------------------------------------------------------------------------------

_DATE = re.compile(r"origin_departure_date=(.*)")
_MERGED = "batch=merged-"


def write_log_batch(rows: DataFrame, root: str, table: str, batch: str) -> None:
    """K1: add the log rows of one batch. Writing the same batch again replaces it."""
    placed = rows.select(*COLUMNS[table], F.lit(batch).alias("batch"))
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("origin_departure_date", "batch").parquet(f"{root}/{table}")


def _folders(spark: SparkSession, root: str, table: str, commit: Commit, day: str) -> list[str]:
    """The folders of one day that count: the merged one of the commit and the batches it does not cover."""
    merged = read_manifest(spark, root, commit, f"{table}/{day}") or {"folder": None, "covers": []}
    covered = set(merged["covers"])
    inside = names(spark, f"{root}/{table}/{day}")
    return [f"{day}/{n}" for n in inside if (n == merged["folder"] if n.startswith(_MERGED) else n not in covered)]


def _read_folders(spark: SparkSession, root: str, table: str, folders: list[str]) -> DataFrame:
    if not folders:
        return empty_table(spark, table)
    reader = spark.read.schema(f"{TABLES[table]}, batch string").option("basePath", f"{root}/{table}")
    return reader.parquet(*[f"{root}/{table}/{f}" for f in folders]).select(*COLUMNS[table])


def read_log(
    spark: SparkSession,
    root: str,
    table: str,
    commit: Commit | None = None,
    dates: tuple[dt.date | None, dt.date | None] | None = None,
) -> DataFrame:
    """A log as of a commit and of the batches written by now, or some departure dates of it."""
    commit = latest(spark, root) if commit is None else commit
    first, last = (str(d) if d else None for d in (dates or (None, None)))
    days = [m for m in map(_DATE.fullmatch, names(spark, f"{root}/{table}")) if m]
    days = [m[0] for m in days if (first is None or m[1] >= first) and (last is None or m[1] <= last)]
    return _read_folders(spark, root, table, [f for day in days for f in _folders(spark, root, table, commit, day)])


def log_days(spark: SparkSession, root: str, table: str) -> list[str]:
    return [m[1] for m in map(_DATE.fullmatch, names(spark, f"{root}/{table}")) if m]


def _still_open(batches: list[str]) -> set[str]:
    """The last batch of each stream, which may be run again; a name ends with the number of the batch."""
    last: dict[str, tuple[int, str]] = {}
    for name in batches:
        stream, _, number = name.rpartition("-")
        if number.isdigit():
            last[stream] = max(last.get(stream, (-1, "")), (int(number), name))
    return {name for _, name in last.values()}


def compact_log(spark: SparkSession, root: str, table: str, date: dt.date | str, closed: bool = False) -> int:
    """K1: merge the batches of one departure date into one folder, sorted by train; how many were merged.

    Readers and the stream go on meanwhile: nothing is deleted, and the merged files count from the commit that
    lists them, together with the batches they cover. The last batch of each stream is left out unless the
    streams are ``closed``, since it is written again if the stream fails before it is recorded.
    """
    commit, day = latest(spark, root), f"origin_departure_date={date}"
    folders = _folders(spark, root, table, commit, day)
    batches = [f.rpartition("/")[2] for f in folders if not f.rpartition("/")[2].startswith(_MERGED)]
    done = [b for b in batches if closed or b not in _still_open(batches)]
    if not done:
        return 0
    before = read_manifest(spark, root, commit, f"{table}/{day}") or {"folder": None, "covers": []}
    merging = [f"{day}/{name}" for name in done] + ([f"{day}/{before['folder']}"] if before["folder"] else [])
    rows = _read_folders(spark, root, table, merging).drop("origin_departure_date")
    folder = f"{_MERGED}{uuid.uuid4().hex}"
    rows.hint("rebalance", "schedule_train_id").sortWithinPartitions("schedule_train_id", "arrival_ms").write.parquet(f"{root}/{table}/{day}/{folder}")
    publish(spark, root, commit, {f"{table}/{day}": {"folder": folder, "covers": before["covers"] + done}})
    return len(done)


# What no commit needs any more --------------------------------------------------------------------


def remove_unused(spark: SparkSession, root: str, older_than_ms: int) -> int:
    """Delete folders of snapshots and log batches that the latest commit does not list, and older entries of the
    commit list, if they have not changed for so long; how many were deleted.

    The time must be longer than any reader or writer runs: both rely on what they have resolved.
    """
    commit, now, gone = latest(spark, root), int(time.time() * 1000), 0

    def drop(path: str) -> None:
        nonlocal gone
        if age_ms(spark, path, now) >= older_than_ms:
            gone += delete(spark, path)

    for table in LAYOUTS:
        used = {f.path.split("/")[1] for f in files_of(spark, root, commit, table)}
        for name in names(spark, f"{root}/{table}"):
            if name not in used:
                drop(f"{root}/{table}/{name}")
    for table in LOG_TABLES:
        for day in (f"origin_departure_date={d}" for d in log_days(spark, root, table)):
            used = {f.rpartition("/")[2] for f in _folders(spark, root, table, commit, day)}
            for name in names(spark, f"{root}/{table}/{day}"):
                if name not in used:
                    drop(f"{root}/{table}/{day}/{name}")
    for folder in ("_commits", *(f"_manifests/{name}" for name in names(spark, f"{root}/_manifests"))):
        for name in names(spark, f"{root}/{folder}"):
            path = f"{folder}/{name}"
            if name.endswith(".json") and path not in commit.manifests.values() and name != f"{commit.number:012d}.json":
                drop(f"{root}/{path}")
    return gone
