"""The movement feed: text messages, each a JSON array of records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbeam.constants import (
    CANCELLATION_TYPES,
    EVENT_TYPES,
    MSG_ACTIVATION,
    MSG_CANCELLATION,
    MSG_CHANGE_OF_ORIGIN,
    MSG_MOVEMENT,
    VARIATION_STATUSES,
)
from railbeam.functions.once import with_computed
from railbeam.functions.text import LONG_DIGITS, blank_to_null, sortable, strict_long
from railbeam.schemas import MESSAGE_ELEMENT

KNOWN_TYPES = [MSG_ACTIVATION, MSG_CANCELLATION, MSG_MOVEMENT, MSG_CHANGE_OF_ORIGIN]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each line its number within its block of a file; a task reads the lines of a block one after another."""
    block, line = None, 0
    for batch in batches:
        numbers = []
        for now in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            line = line + 1 if now == block else 0
            block = now
            numbers.append(line)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers, pa.int32()), batch.column(3)], ["arrival_ms", "file", "block", "line", "value"])


def _split_lines(lines: DataFrame) -> DataFrame:
    """One row per message, in the order of file, block of the file and line: a large file is read by many tasks."""
    placed = lines.select(
        F.unix_millis(F.col("_metadata.file_modification_time")).alias("arrival_ms"),
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    numbered = placed.mapInArrow(_numbered, "arrival_ms bigint, file string, block bigint, line int, value string")
    place = F.concat_ws("-", "file", sortable(F.col("block"), LONG_DIGITS), sortable(F.col("line")))
    return numbered.filter(F.trim("value") != "").select("arrival_ms", place.alias("seq"), "value")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a landing directory as a batch: (arrival_ms, seq, value)."""
    return _split_lines(spark.read.text(path))


def stream_messages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same as a stream. A landing file is closed, of any size, and has one message on each line."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    return _split_lines(reader.schema("value string").format("text").load(path))


def stream_kafka_messages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """S5 over Kafka, where its connector is on the class path."""
    source = spark.readStream.format("kafka").options(**options).load()
    return source.select(
        F.unix_millis("timestamp").alias("arrival_ms"),
        F.concat_ws(
            "-",
            "topic",
            sortable(F.col("partition")),
            sortable(F.col("offset"), LONG_DIGITS),
        ).alias("seq"),
        F.col("value").cast("string").alias("value"),
    )


def _long_or_blank(value: Column) -> Column:
    return value.isNull() | (value == "") | strict_long(value).isNotNull()


def _element_ok(x: Column) -> Column:
    """Whether one record of a message has what its type needs. Unknown types are fine."""
    kind, body = x["header"]["msg_type"], x["body"]
    named = body["train_id"].isNotNull() & body["train_service_code"].isNotNull()
    operated = named & body["toc_id"].isNotNull()
    activation = (
        named
        & body["train_uid"].isNotNull()
        & body["sched_origin_stanox"].isNotNull()
        & strict_long(body["origin_dep_timestamp"]).isNotNull()
    )
    cancellation = (
        operated
        & body["loc_stanox"].isNotNull()
        & body["canx_type"].isin(CANCELLATION_TYPES)
        & body["canx_reason_code"].isNotNull()
    )
    movement = (
        operated
        & body["event_type"].isin(EVENT_TYPES)
        & strict_long(body["actual_timestamp"]).isNotNull()
        & _long_or_blank(body["planned_timestamp"])
        & _long_or_blank(body["gbtt_timestamp"])
        & (body["variation_status"].isNull() | body["variation_status"].isin(VARIATION_STATUSES))
    )
    change = operated & body["loc_stanox"].isNotNull() & _long_or_blank(body["original_loc_timestamp"])
    ok = (
        F.when(kind == MSG_ACTIVATION, activation)
        .when(kind == MSG_CANCELLATION, cancellation)
        .when(kind == MSG_MOVEMENT, movement)
        .when(kind == MSG_CHANGE_OF_ORIGIN, change)
        .otherwise(kind.isNotNull())
    )
    return F.coalesce(ok, F.lit(False))


def parse_messages(messages: DataFrame) -> DataFrame:
    """The parsed array of each message and why it is refused, all or nothing."""
    elements = F.from_json("value", f"array<struct<{MESSAGE_ELEMENT}>>")
    parsed = with_computed(messages, {"elements": elements})
    reason = F.when(F.col("elements").isNull(), "not_an_array").when(
        ~F.forall("elements", _element_ok), "bad_element"
    )
    return parsed.withColumn("reject_reason", reason)


def message_rejects(parsed: DataFrame) -> DataFrame:
    """K13 for messages that were parsed, or landed."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select("seq", "reject_reason", "value")


def _record_columns() -> list[Column]:
    """The columns of a record ``x``; ``msg_type`` routes the row, columns that a type does not have are null."""
    kind = F.col("x.header.msg_type")
    body = "x.body."

    def only(types: list[str], value: Column) -> Column:
        return F.when(kind.isin(types), value)

    located = [MSG_CANCELLATION, MSG_MOVEMENT, MSG_CHANGE_OF_ORIGIN]
    return [
        kind.alias("msg_type"),
        only(KNOWN_TYPES, F.col(body + "train_id")).alias("train_id"),
        only(KNOWN_TYPES, F.col(body + "train_service_code")).alias("service_code"),
        only([MSG_ACTIVATION], F.col(body + "train_uid")).alias("schedule_train_id"),
        only([MSG_ACTIVATION], F.col(body + "sched_origin_stanox")).alias("origin_stanox_code"),
        only([MSG_ACTIVATION], strict_long(F.col(body + "origin_dep_timestamp"))).alias(
            "origin_departure_timestamp"
        ),
        only(located, F.col(body + "toc_id")).alias("toc"),
        F.when(kind == MSG_MOVEMENT, blank_to_null(F.col(body + "loc_stanox")))
        .when(kind.isin(located), F.col(body + "loc_stanox"))
        .alias("stanox_code"),
        only([MSG_MOVEMENT], F.col(body + "event_type")).alias("event_type"),
        only([MSG_MOVEMENT], strict_long(F.col(body + "actual_timestamp"))).alias("actual_timestamp"),
        only([MSG_MOVEMENT], strict_long(F.col(body + "planned_timestamp"))).alias(
            "planned_timestamp"
        ),
        only([MSG_MOVEMENT], strict_long(F.col(body + "gbtt_timestamp"))).alias(
            "planned_passenger_timestamp"
        ),
        only([MSG_MOVEMENT], F.col(body + "variation_status")).alias("variation_status"),
        only([MSG_CANCELLATION], F.col(body + "canx_type")).alias("cancellation_type"),
        only([MSG_CANCELLATION], F.col(body + "canx_reason_code")).alias("cancellation_reason_code"),
        only([MSG_CHANGE_OF_ORIGIN], F.col(body + "original_loc_stanox")).alias("old_stanox_code"),
        only([MSG_CHANGE_OF_ORIGIN], strict_long(F.col(body + "original_loc_timestamp"))).alias(
            "old_timestamp"
        ),
        only([MSG_CHANGE_OF_ORIGIN], F.col(body + "reason_code")).alias("reason_code"),
    ]


def explode_messages(parsed: DataFrame) -> DataFrame:
    """One wide row per record of the accepted messages."""
    rows = parsed.filter(F.col("reject_reason").isNull()).select(
        "arrival_ms", "seq", F.posexplode("elements").alias("pos", "x")
    )
    return rows.select("arrival_ms", "seq", "pos", *_record_columns())


def landed_records(parsed: DataFrame) -> DataFrame:
    """All that one parse of a message gives: a row per record of an accepted one, and a row with the reason and
    the message for a refused one. An accepted message without records gives none."""
    refused = F.col("reject_reason").isNotNull()
    rows = parsed.select(
        "arrival_ms", "seq", "reject_reason", F.when(refused, F.col("value")).alias("value"),
        F.posexplode_outer(F.when(~refused, F.col("elements"))).alias("pos", "x"),
    )
    kept = rows.filter(F.col("pos").isNotNull() | F.col("reject_reason").isNotNull())
    return kept.select("arrival_ms", "seq", "pos", *_record_columns(), "reject_reason", "value")


def accepted_records(messages: DataFrame) -> DataFrame:
    """The records of raw messages, or of what ``landed_records`` made of them."""
    if "reject_reason" not in messages.columns:
        return explode_messages(parse_messages(messages))
    return messages.filter(F.col("reject_reason").isNull()).drop("reject_reason", "value")


def records_of(exploded: DataFrame, msg_type: str) -> DataFrame:
    """The records of one type."""
    return exploded.filter(F.col("msg_type") == msg_type)


def unhandled(exploded: DataFrame) -> DataFrame:
    """Records of types nothing is done with, kept for counting."""
    return exploded.filter(~F.col("msg_type").isin(KNOWN_TYPES))


def route_counts(exploded: DataFrame) -> DataFrame:
    """A10: records per type."""
    return exploded.groupBy("msg_type").agg(F.count(F.lit(1)).alias("records"))


def route_counts_per_minute(exploded: DataFrame, arrival: Column) -> DataFrame:
    """Records per type and minute of arrival; the meter's rate is this count."""
    return (
        exploded.groupBy(F.window(arrival, "1 minute").alias("w"), "msg_type")
        .agg(F.count(F.lit(1)).alias("records"))
        .select(F.col("w.start").alias("minute"), "msg_type", "records")
    )
