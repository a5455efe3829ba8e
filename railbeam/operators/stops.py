"""From a decoded schedule to one row per public stop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbeam.constants import DAY_COLUMNS
from railbeam.functions.days import day_flags, run_pattern

HEADER = [
    "schedule_train_id",
    "service_code",
    "stp_indicator",
    "train_category",
    "train_status",
    "atoc_code",
    "days_run",
    "schedule_start",
    "schedule_end",
]


def later(values: Column, position: Column) -> Column:
    """The part of an array after a 1-based position."""
    return F.slice(values, position + 1, F.size(values))


def public_stops(creates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per stop of a record that has a public time, still with its tiploc.

    Columns: seq, those of ``by``, header (a struct of HEADER), pos, tiploc_code, location_type and the two times.
    """
    stops = creates.filter(run_pattern(F.col("days_run")).isNotNull()).select(
        "seq", *by, F.struct(*HEADER).alias("header"), F.posexplode("locations").alias("pos", "stop")
    )
    return stops.select(
        "seq",
        *by,
        "header",
        "pos",
        "stop.tiploc_code",
        "stop.location_type",
        "stop.arrival_time",
        "stop.departure_time",
    ).filter(F.coalesce("arrival_time", "departure_time").isNotNull())


def schedule_records(
    stops: DataFrame, tiplocs: DataFrame, head: Callable[[Column], Column] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per record: its head, and its public stops with their codes and times in arrays.

    ``tiplocs`` is the tiploc -> stanox map; stops it lacks are dropped before numbering. A record's
    stops are put together by an aggregate on ``seq``. They were one feed line, so a group is never
    longer than that line's array and most of the work is done before the shuffle; input that is
    already partitioned by ``seq`` is not shuffled at all. The same holds for input that is partitioned by the
    columns ``by`` of the head, and what follows is then partitioned by them. What is the same for all stops of a
    record is worked out before they are listed; ``head`` makes a header of HEADER from a column ``header``
    that holds only what it is made of.
    """
    record = stops.join(tiplocs, "tiploc_code").groupBy("seq", *by).agg(
        F.first("header").alias("header"),
        F.sort_array(
            F.collect_list(
                F.struct("pos", "stanox_code", "location_type", "arrival_time", "departure_time")
            )
        ).alias("stops"),
    )
    if head is not None:
        record = record.withColumn("header", head(F.col("header")))
    return record.select(
        "seq",
        *[F.col(c) if c in by else F.col(f"header.{c}") for c in HEADER if c != "days_run"],
        *day_flags(F.col("header.days_run")),
        run_pattern(F.col("header.days_run")).alias("days_run_pattern"),
        F.col("stops.stanox_code").alias("codes"),
        F.transform("stops", lambda s: F.coalesce(s["arrival_time"], s["departure_time"])).alias(
            "times"
        ),
        "stops",
    )


def record_rows(records: DataFrame, *beside: str) -> DataFrame:
    """A row per stop of each record, numbered from 1, with the codes and times of all later stops.

    ``beside`` are further columns of the records to keep.
    """
    listed = records.select(
        *[c for c in records.columns if c != "stops"], F.posexplode("stops").alias("index", "stop")
    )
    position = F.col("index") + 1
    return listed.select(
        "seq",
        *[c for c in HEADER if c != "days_run"],
        position.alias("stop_sequence"),
        F.col("stop.stanox_code").alias("stanox_code"),
        later(F.col("codes"), position).alias("subsequent_stanox_codes"),
        later(F.col("times"), position).alias("subsequent_arrival_times"),
        *DAY_COLUMNS,
        "days_run_pattern",
        F.col("stop.location_type").alias("location_type"),
        F.col("stop.arrival_time").alias("arrival_time"),
        F.col("stop.departure_time").alias("departure_time"),
        *beside,
    )


def schedule_rows(stops: DataFrame, tiplocs: DataFrame, head: Callable[[Column], Column] | None = None) -> DataFrame:
    """Schedule rows with the codes and times of all later stops."""
    return record_rows(schedule_records(stops, tiplocs, head))


def flatten_schedules(creates: DataFrame, tiplocs: DataFrame) -> DataFrame:
    """Decoded schedule creates as schedule rows."""
    return schedule_rows(public_stops(creates), tiplocs)


def stop_codes(schedule: DataFrame) -> DataFrame:
    """A1: the distinct stop codes of a schedule table."""
    return schedule.select("stanox_code").distinct()


def schedule_by_id(schedule: DataFrame, record_id: str) -> DataFrame:
    """F2."""
    return schedule.filter(F.col("id") == record_id)


def schedule_by_train(schedule: DataFrame, train: str, stop: str | None = None) -> DataFrame:
    """F2, O1: the rows of a train, or of a train at a stop."""
    rows = schedule.filter(F.col("schedule_train_id") == train)
    return rows if stop is None else rows.filter(F.col("stanox_code") == stop)
