"""The public queries on stored tables: each opens only the files that can hold its rows."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession

from railbeam.constants import HISTORY_LOOKBACK_MS, MIN_SCHEDULE_DAYS
from railbeam.plans.history import History, history
from railbeam.plans.search import schedule_search
from railbeam.sources.commits import Commit
from railbeam.sources.snapshots import load_tables


def search_stored(
    spark: SparkSession,
    root: str,
    from_: str,
    to: str,
    pattern: str,
    user_id: str | None = None,
    min_days: int = MIN_SCHEDULE_DAYS,
    commit: Commit | None = None,
) -> DataFrame:
    """``schedule_search`` over the copy by pattern and stop, in the files of the asked one."""
    tables = load_tables(spark, root, commit, stops=[(pattern, from_)])
    return schedule_search(tables, from_, to, pattern, user_id, min_days)


def _utc_date(ms: int) -> dt.date:
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).date()


def history_stored(
    spark: SparkSession,
    root: str,
    train: str,
    from_: str,
    to: str,
    from_ts: int | None = None,
    to_ts: int | None = None,
    commit: Commit | None = None,
    now_ms: int | None = None,
) -> History:
    """``history`` over the copy by train and the log days of the range; without ``from_ts`` of the last 30 days."""
    if from_ts is None:
        from_ts = (int(time.time() * 1000) if now_ms is None else now_ms) - HISTORY_LOOKBACK_MS
    dates = (_utc_date(from_ts), None if to_ts is None else _utc_date(to_ts))
    return history(load_tables(spark, root, commit, trains=[train], dates=dates), train, from_, to, from_ts, to_ts)
