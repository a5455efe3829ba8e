"""Batch enrichment of exploded messages (J2, F11, T8-T10): the same answer as the stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.constants import (
    ACTIVATION_TTL_MS,
    DEFAULT_SALTS,
    MSG_ACTIVATION,
    MSG_CANCELLATION,
    MSG_CHANGE_OF_ORIGIN,
    MSG_MOVEMENT,
)
from railbeam.functions.text import sortable
from railbeam.operators.asof import ACTIVATION_FIELDS, HEAVY_ROWS, with_activation
from railbeam.operators.logs import cancellation_log, change_of_origin_log, movement_log
from railbeam.sources.messages import records_of

ORDER = ("arrival_ms", "seq", "pos")


@dataclass(frozen=True)
class Logs:
    movements: DataFrame
    cancellations: DataFrame
    changes_of_origin: DataFrame


def enrich(
    exploded: DataFrame,
    ttl_ms: int = ACTIVATION_TTL_MS,
    slices: int = 16,
    salts: int = DEFAULT_SALTS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """J2 for all record types in one pass."""
    activations = records_of(exploded, MSG_ACTIVATION)
    records = exploded.filter(
        F.col("msg_type").isin(MSG_CANCELLATION, MSG_MOVEMENT, MSG_CHANGE_OF_ORIGIN)
    ).drop(*ACTIVATION_FIELDS)
    return with_activation(records, activations, ttl_ms, ORDER, slices, salts, heavy_rows)


def logs(exploded: DataFrame, ttl_ms: int = ACTIVATION_TTL_MS, salts: int = DEFAULT_SALTS) -> Logs:
    """The three logs of a batch of messages."""
    enriched = enrich(exploded, ttl_ms, salts=salts)
    return logs_of(enriched)


def logs_of(enriched: DataFrame) -> Logs:
    """T8-T10 for enriched records, however they were enriched."""
    record_id = F.concat_ws("-", "seq", sortable(F.col("pos")))
    return Logs(
        movements=movement_log(records_of(enriched, MSG_MOVEMENT), record_id),
        cancellations=cancellation_log(records_of(enriched, MSG_CANCELLATION), record_id),
        changes_of_origin=change_of_origin_log(records_of(enriched, MSG_CHANGE_OF_ORIGIN), record_id),
    )
