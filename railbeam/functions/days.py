"""Days-run strings and running patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railbeam.constants import DAY_COLUMNS, SATURDAYS, SUNDAYS, WEEKDAYS


def is_days_string(value: Column) -> Column:
    """Exactly seven characters, each 0 or 1."""
    return value.rlike("^[01]{7}$")


def day_flags(value: Column) -> list[Column]:
    """The seven weekday flags, named Monday first."""
    return [(F.substring(value, i + 1, 1) == "1").alias(d) for i, d in enumerate(DAY_COLUMNS)]


def run_pattern(value: Column) -> Column:
    """T4: the pattern of a days string; null when it runs on no day."""
    return (
        F.when(F.substring(value, 1, 5).contains("1"), WEEKDAYS)
        .when(F.substring(value, 6, 1) == "1", SATURDAYS)
        .when(F.substring(value, 7, 1) == "1", SUNDAYS)
    )


def run_pattern_of_flags() -> Column:
    """T5: the same pattern from the seven stored flags."""
    on_weekday = F.greatest(*[F.col(d) for d in DAY_COLUMNS[:5]])
    return (
        F.when(on_weekday, WEEKDAYS)
        .when(F.col("saturday"), SATURDAYS)
        .when(F.col("sunday"), SUNDAYS)
    )
