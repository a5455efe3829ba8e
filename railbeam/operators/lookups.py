"""Lookups of many keys at once (F2, F8-F10): the rows whose columns equal one of the asked keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

ASSOCIATION_KEY = [
    "main_schedule_train_id",
    "associated_schedule_train_id",
    "associated_start",
    "stp_indicator",
    "location",
]


def rows_of(table: DataFrame, asked: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of a table for a table of keys, each once however often its key is asked for."""
    return table.join(asked.select(*by).distinct(), list(by), "left_semi")


def schedules_by_id(schedule: DataFrame, asked: DataFrame) -> DataFrame:
    """F2."""
    return rows_of(schedule, asked, ["id"])


def schedules_by_train(schedule: DataFrame, asked: DataFrame) -> DataFrame:
    """by train, or by train and stop where ``asked`` names the stop."""
    return rows_of(schedule, asked, [c for c in ("schedule_train_id", "stanox_code") if c in asked.columns])


def associations_by_key(association: DataFrame, asked: DataFrame) -> DataFrame:
    """by all five parts of the key."""
    return rows_of(association, asked, ASSOCIATION_KEY)


def subscribers_by_train(subscribers: DataFrame, asked: DataFrame) -> DataFrame:
    """by train and service."""
    return rows_of(subscribers, asked, ["schedule_train_id", "service_code"])


def subscribers_by_user(subscribers: DataFrame, asked: DataFrame) -> DataFrame:
    """by user, or by user and id where ``asked`` names the id."""
    return rows_of(subscribers, asked, [c for c in ("user_id", "id") if c in asked.columns])


def subscribers_by_id(subscribers: DataFrame, asked: DataFrame) -> DataFrame:
    """F10."""
    return rows_of(subscribers, asked, ["id"])
