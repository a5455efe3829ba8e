"""Log rows of enriched records, and reads of the logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbeam.functions.times import utc_date, utc_time


def loggable_movements(movements: DataFrame) -> DataFrame:
    """a movement needs its stop, its public time and its status."""
    return movements.dropna(subset=["stanox_code", "planned_passenger_timestamp", "variation_status"])


def _head(record_id: Column) -> list[Column | str]:
    return [
        record_id.alias("id"),
        "arrival_ms",
        "train_id",
        "schedule_train_id",
        "service_code",
        "toc",
    ]


def _origin() -> list[Column | str]:
    departure = F.col("origin_departure_timestamp")
    return [
        "origin_stanox_code",
        "origin_departure_timestamp",
        utc_date(departure).alias("origin_departure_date"),
        utc_time(departure).alias("origin_departure_time"),
    ]


def movement_log(enriched: DataFrame, record_id: Column) -> DataFrame:
    """Lateness is the actual minus the public time, in milliseconds."""
    planned, actual = F.col("planned_passenger_timestamp"), F.col("actual_timestamp")
    return loggable_movements(enriched).select(
        *_head(record_id),
        "event_type",
        "stanox_code",
        *_origin(),
        "planned_passenger_timestamp",
        utc_time(planned).alias("planned_passenger_time"),
        "actual_timestamp",
        utc_time(actual).alias("actual_time"),
        (actual - planned).alias("difference"),
        "variation_status",
    )


def cancellation_log(enriched: DataFrame, record_id: Column) -> DataFrame:
    """T9."""
    return enriched.select(
        *_head(record_id),
        "stanox_code",
        *_origin(),
        "cancellation_type",
        "cancellation_reason_code",
    )


def change_of_origin_log(enriched: DataFrame, record_id: Column) -> DataFrame:
    """The new stop comes from the message, the origin from the activation."""
    return enriched.select(
        *_head(record_id),
        F.col("stanox_code").alias("new_stanox_code"),
        *_origin(),
        "reason_code",
    )


def log_window(
    log: DataFrame,
    train: str,
    codes: Sequence[str] | None = None,
    from_ts: int | None = None,
    to_ts: int | None = None,
) -> DataFrame:
    """The log rows of a train whose departure lies in a range, both ends included.

    The date condition repeats the range on the column the files lie by.
    """
    rows = log.filter(F.col("schedule_train_id") == train)
    departure, date = F.col("origin_departure_timestamp"), F.col("origin_departure_date")
    if from_ts is not None:
        rows = rows.filter((departure >= from_ts) & (date >= utc_date(F.lit(from_ts))))
    if to_ts is not None:
        rows = rows.filter((departure <= to_ts) & (date <= utc_date(F.lit(to_ts))))
    if codes:
        rows = rows.filter(F.col("stanox_code").isin(list(codes)))
    return rows
