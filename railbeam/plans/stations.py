"""Stations that occur in the timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.functions.text import station_label
from railbeam.operators.stations import main_records
from railbeam.operators.stops import stop_codes
from railbeam.sources.snapshots import RailTables


def stations(tables: RailTables) -> DataFrame:
    """Key and label of every station called at by a primary schedule, by key."""
    used = tables.stanox.join(stop_codes(tables.schedule), "stanox_code", "left_semi")
    return (
        main_records(used)
        .select(
            F.col("stanox_code").alias("key"),
            station_label(F.col("crs"), F.col("description")).alias("value"),
        )
        .orderBy("key")
    )
