"""The running movement stream: logs, notices, counts and rejects."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from railbeam.constants import ACTIVATION_TTL_MS, DEFAULT_SALTS, LATE_THRESHOLD_MS
from railbeam.operators.notices import (
    cancellation_notices,
    change_of_origin_notices,
    is_notifiable,
    movement_notices_by_view,
)
from railbeam.plans.enrich import Logs, logs_of
from railbeam.plans.load import watched_of
from railbeam.sources.commits import latest
from railbeam.sources.files import create_whole, names, read_text
from railbeam.sources.messages import (
    accepted_records,
    landed_records,
    message_rejects,
    parse_messages,
    route_counts_per_minute,
)
from railbeam.sources.snapshots import read_table, touched_buckets, write_log_batch
from railbeam.streaming.activation_state import enrich_stream


def batch_notices(spark: SparkSession, root: str, made: Logs, threshold_ms: int = LATE_THRESHOLD_MS) -> DataFrame:
    """K12 for the log rows of one batch: the view of watched stops and the subscribers are opened only in the
    buckets of the batch's trains, and no schedule is read."""
    commit = latest(spark, root)
    late = made.movements.filter(is_notifiable(threshold_ms))
    told = made.cancellations.select("schedule_train_id").unionByName(made.changes_of_origin.select("schedule_train_id"))
    trains = touched_buckets(told, "schedule_train_id", commit.buckets)
    subscribers = read_table(spark, root, "subscribers", commit, buckets=trains)
    stanox = read_table(spark, root, "stanox", commit)
    return (
        movement_notices_by_view(late, watched_of(spark, root, commit, late), stanox, threshold_ms)
        .unionByName(cancellation_notices(made.cancellations, subscribers, stanox))
        .unionByName(change_of_origin_notices(made.changes_of_origin, subscribers, stanox))
    )


def write_batch(
    spark: SparkSession, root: str, enriched: DataFrame, batch: str, threshold_ms: int
) -> None:
    """Append the logs of a batch and the notices that follow from them.

    Every output of a batch is replaced as a whole, so a batch that is run again after a failure leaves no
    double rows.
    """
    enriched.persist()
    made = logs_of(enriched)
    logs = {
        "movement_log": made.movements,
        "cancellation_log": made.cancellations,
        "change_of_origin_log": made.changes_of_origin,
    }
    try:
        for table, rows in logs.items():
            write_log_batch(rows, root, table, batch)
        notices = batch_notices(spark, root, made, threshold_ms)
        notices.write.mode("overwrite").parquet(f"{root}/notifications/batch={batch}")
    finally:
        enriched.unpersist()


def kept_salts(spark: SparkSession, checkpoint: str, salts: int) -> int:
    """The number of state groups of a checkpoint, noted in it when it begins.

    Activations are held by each group, so records dealt over other groups would find none. A checkpoint without
    the note is older; its activations are in the first group in any case, so all records go there.
    """
    note = f"{checkpoint}/state.json"
    if "state.json" not in names(spark, checkpoint):
        first = 1 if names(spark, f"{checkpoint}/offsets") else salts
        create_whole(spark, note, json.dumps({"version": 1, "salts": first}))
    found = json.loads(read_text(spark, note))
    if found["version"] != 1:
        raise ValueError(f"{note} is of a version that this code does not know")
    return found["salts"]


def run_parse_stream(
    spark: SparkSession,
    root: str,
    messages: DataFrame,
    checkpoint: str,
    name: str = "movements",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Parse each raw message once and land what it holds, for the other queries to read.

    Spark's file sink lists the files of a batch at once, so its readers see all of a batch or nothing, and a
    batch that is run again adds nothing.
    """
    landed = landed_records(parse_messages(messages))
    writer = landed.writeStream.outputMode("append").format("parquet").queryName(f"{name}_records")
    writer = writer.option("path", f"{root}/message_records").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def stream_records(spark: SparkSession, root: str) -> DataFrame:
    """What ``run_parse_stream`` has landed, as a stream. A reader opens only the columns it uses.

    The number of files of a micro-batch is not limited: the files of one landed batch have no order among
    themselves, so an activation must not come in a later micro-batch than its train's movements.
    """
    nothing = spark.createDataFrame([], "arrival_ms bigint, seq string, value string")
    return spark.readStream.schema(landed_records(parse_messages(nothing)).schema).parquet(f"{root}/message_records")


def run_movement_stream(
    spark: SparkSession,
    root: str,
    messages: DataFrame,
    checkpoint: str,
    name: str = "movements",
    ttl_ms: int = ACTIVATION_TTL_MS,
    threshold_ms: int = LATE_THRESHOLD_MS,
    salts: int = DEFAULT_SALTS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream from raw messages, or from ``stream_records``, to logs and notices.

    A batch is named by the query's own id, which stays the same for one checkpoint and differs between
    two, so a stream with a new checkpoint never replaces what another has written. The number of state groups
    stays what it was when the checkpoint began, whatever ``salts`` says later.
    """
    salts = kept_salts(spark, checkpoint, salts)
    enriched = enrich_stream(accepted_records(messages), ttl_ms, salts)

    query_id: Future[str] = Future()

    def handle(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows.sparkSession, root, rows, f"{name}-{query_id.result()}-{batch_id}", threshold_ms)

    query = _start(enriched, checkpoint, f"{name}_logs", handle, trigger)
    query_id.set_result(query.id)
    return query


def run_message_counts(
    spark: SparkSession,
    root: str,
    messages: DataFrame,
    checkpoint: str,
    name: str = "movements",
    lateness: str = "10 minutes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Records per type and minute, written when a minute can no longer change; input as above."""
    arrived = accepted_records(messages).withColumn("arrival", F.timestamp_millis("arrival_ms"))
    counts = route_counts_per_minute(arrived.withWatermark("arrival", lateness), F.col("arrival"))
    writer = counts.writeStream.outputMode("append").format("parquet").queryName(f"{name}_counts")
    writer = writer.option("path", f"{root}/message_counts").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def run_message_rejects(
    spark: SparkSession,
    root: str,
    messages: DataFrame,
    checkpoint: str,
    name: str = "movements",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Messages that were refused, with the reason; input as above."""
    rejected = message_rejects(messages if "reject_reason" in messages.columns else parse_messages(messages))
    writer = rejected.writeStream.outputMode("append").format("parquet").queryName(f"{name}_rejects")
    writer = writer.option("path", f"{root}/message_rejects").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def _start(
    rows: DataFrame,
    checkpoint: str,
    name: str,
    handle: Callable[[DataFrame, int], None],
    trigger: dict | None,
) -> StreamingQuery:
    """Start without empty batches: state that expires by the clock would ask for one after another,
    and a run over the available input would never end. A query keeps the setting it starts with."""
    conf, key = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        writer = rows.writeStream.foreachBatch(handle).outputMode("append").queryName(name)
        writer = writer.option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        conf.set(key, before)
