"""Choosing the station record that speaks for a stanox or a tiploc."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.operators.firsts import first_per


def complete_records(stanox: DataFrame) -> DataFrame:
    """rows with crs, stanox and tiploc."""
    return stanox.dropna(subset=["crs", "stanox_code", "tiploc_code"])


def by_stanox(stanox: DataFrame, code: str) -> DataFrame:
    """F8."""
    return stanox.filter(F.col("stanox_code") == code)


def by_tiploc(stanox: DataFrame, code: str) -> DataFrame:
    """F8."""
    return stanox.filter(F.col("tiploc_code") == code)


def main_records(stanox: DataFrame) -> DataFrame:
    """A2, A4: per stanox, of the rows with a crs, the first main entry, else the first."""
    rank = F.when(F.col("primary_entry"), 0).otherwise(1)
    return first_per(stanox.filter(F.col("crs").isNotNull()), ["stanox_code"], [rank, "id"])


def main_records_for_notices(stanox: DataFrame) -> DataFrame:
    """A3: the first main entry with a crs, else the first row of all, crs or not."""
    rank = F.when(F.col("primary_entry") & F.col("crs").isNotNull(), 0).otherwise(1)
    known = stanox.filter(F.col("stanox_code").isNotNull())
    return first_per(known, ["stanox_code"], [rank, "id"])


def crs_by_stanox(stanox: DataFrame) -> DataFrame:
    """A4: stanox -> crs over the complete records."""
    return main_records(complete_records(stanox)).select("stanox_code", "crs")


def tiploc_map(stanox: DataFrame) -> DataFrame:
    """Tiploc -> stanox; the last row with a stanox wins."""
    return (
        stanox.filter(F.col("stanox_code").isNotNull())
        .groupBy("tiploc_code")
        .agg(F.max_by("stanox_code", "id").alias("stanox_code"))
    )


def stanox_sets(stanox: DataFrame) -> DataFrame:
    """Every stanox of a tiploc."""
    return (
        stanox.filter(F.col("stanox_code").isNotNull())
        .groupBy("tiploc_code")
        .agg(F.collect_set("stanox_code").alias("stanox_codes"))
    )
