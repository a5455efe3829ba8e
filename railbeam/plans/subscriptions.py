"""Subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.constants import RECORD_PRIMARY, RECORD_SECONDARY
from railbeam.operators.fold import insert_ignore
from railbeam.operators.notices import subscribers_of_user
from railbeam.sources.snapshots import RailTables

UNIQUE_KEY = ["user_id", "schedule_train_id", "service_code", "from_stanox_code", "to_stanox_code"]

LISTED = [
    "id",
    "schedule_train_id",
    "service_code",
    "from_stanox_code",
    "from_crs",
    "departure_time",
    "to_stanox_code",
    "to_crs",
    "arrival_time",
    "days_run_pattern",
]


def resolve_requests(tables: RailTables, requests: DataFrame) -> DataFrame:
    """Requests with the train and service of the schedule row they name, null if none.

    ``requests`` has (record_type, record_id), the stops, times and pattern shown to the user, the
    user's own fields and ``seq``, the order of arrival.
    """
    fields = ["record_type", "record_id", "schedule_train_id", "service_code"]

    def rows(schedule: DataFrame, record_type: str) -> DataFrame:
        return schedule.select(
            F.lit(record_type).alias("record_type"),
            F.col("id").alias("record_id"),
            "schedule_train_id",
            "service_code",
        ).select(*fields)

    known = rows(tables.schedule, RECORD_PRIMARY).unionByName(
        rows(tables.schedule_secondary, RECORD_SECONDARY)
    )
    return requests.join(known, ["record_type", "record_id"], "left")


def subscribe(tables: RailTables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, refused requests). A subscription that is held already adds nothing."""
    resolved = resolve_requests(tables, requests)
    refused = resolved.filter(F.col("schedule_train_id").isNull()).select(
        "seq", "user_id", "record_type", "record_id", F.lit("unknown_schedule").alias("reject_reason")
    )
    rows = resolved.filter(F.col("schedule_train_id").isNotNull()).select(
        F.col("seq").cast("string").alias("id"),
        "seq",
        *[c for c in tables.subscribers.columns if c != "id"],
    )
    added = insert_ignore(tables.subscribers, rows, UNIQUE_KEY)
    return added.select(*tables.subscribers.columns), refused


def subscriptions(tables: RailTables, user_id: str) -> DataFrame:
    """What a user holds, without their personal fields."""
    return list_response(subscribers_of_user(tables.subscribers, user_id)).orderBy("id")


def list_response(subscribers: DataFrame) -> DataFrame:
    """T12 for any set of subscribers."""
    return subscribers.filter(F.col("id").isNotNull()).select(*LISTED)


def unsubscribe(subscribers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, refused requests) for requests (user_id, id).

    Only the holder can delete a record; a request for another's or an unknown record is refused.
    """
    remaining = subscribers.join(requests.select("user_id", "id"), ["user_id", "id"], "left_anti")
    refused = requests.join(subscribers.select("user_id", "id"), ["user_id", "id"], "left_anti")
    return (
        remaining.select(*subscribers.columns),
        refused.withColumn("reject_reason", F.lit("not_the_holder")),
    )
