"""Texts shown to users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railbeam.functions.times import short_date, to_minute, whole_minutes

_BREAK = "<br/>\n"


def blank_to_null(value: Column) -> Column:
    """The empty string as null."""
    return F.when(value != "", value)


#: Digits of the largest int and the largest long.
INT_DIGITS, LONG_DIGITS = 10, 19


def sortable(number: Column, digits: int = INT_DIGITS) -> Column:
    """A number that is not negative as text that sorts like it; ``digits`` is the width of its whole type."""
    return F.lpad(number.cast("string"), digits, "0")


def strict_long(value: Column) -> Column:
    """Digits with an optional sign as a bigint, anything else null."""
    return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("bigint"))


def delay_text(status: Column, planned_ms: Column, actual_ms: Column) -> Column:
    """What a variation status says to a passenger."""
    early = whole_minutes(planned_ms - actual_ms).cast("string")
    late = whole_minutes(actual_ms - planned_ms).cast("string")
    return (
        F.when(status == "ON TIME", "On Time")
        .when(status == "EARLY", F.concat(F.lit("Early by "), early, F.lit(" minutes")))
        .when(status == "LATE", F.concat(F.lit("Late by "), late, F.lit(" minutes")))
        .when(status == "OFF ROUTE", "Train is off route")
    )


def difference_text(minutes: Column) -> Column:
    """A signed minute difference in words."""
    size = F.abs(minutes)
    unit = F.when(size == 1, " minute").otherwise(" minutes")
    words = F.concat(size.cast("string"), unit)
    return (
        F.when(minutes > 0, F.concat(words, F.lit(" late")))
        .when(minutes < 0, F.concat(words, F.lit(" early")))
        .otherwise("On time")
    )


def station_text(crs: Column, description: Column) -> Column:
    """X11: ``[CRS] description`` with blanks for what is missing."""
    code = F.coalesce(F.concat(F.lit("["), crs, F.lit("]")), F.lit(""))
    return F.concat(code, F.lit(" "), F.coalesce(description, F.lit("")))


def station_label(crs: Column, description: Column) -> Column:
    """X11: ``description [CRS]``."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(description, blank), F.lit(" ["), F.coalesce(crs, blank), F.lit("]")
    )


def yes_no(flag: Column) -> Column:
    """X15."""
    return F.when(flag, "Y").otherwise("N")


def history_link(train: Column, from_code: Column, to_code: Column) -> Column:
    """Where the history of a search result is shown."""
    return F.concat(
        F.lit("/train-history.html?scheduleTrainId="),
        train,
        F.lit("&fromStanox="),
        from_code,
        F.lit("&toStanox="),
        to_code,
    )


def _lines(*parts: tuple[str, Column]) -> Column:
    pieces: list[Column] = []
    for label, value in parts:
        pieces += [F.lit(label), value]
    return F.concat(*pieces)


# The labels and line breaks of the three notification texts below are what subscribers receive.


def movement_body(origin_text: Column, affected_text: Column) -> Column:
    """Notification text of a movement log row."""
    c = F.col
    return _lines(
        ("Train ID: ", c("schedule_train_id")),
        (_BREAK + "Date: ", short_date(c("origin_departure_date"))),
        ("\nTrain originated from: ", origin_text),
        (" at ", to_minute(c("origin_departure_time"))),
        (_BREAK + "Station affected: ", affected_text),
        (_BREAK + "Operator: ", c("toc")),
        (_BREAK + _BREAK + "Event type: ", c("event_type")),
        (_BREAK + "Expected time: ", to_minute(c("planned_passenger_time"))),
        (_BREAK + "Actual time: ", to_minute(c("actual_time"))),
        (
            _BREAK + "Status: ",
            delay_text(
                c("variation_status"), c("planned_passenger_timestamp"), c("actual_timestamp")
            ),
        ),
        ("<br/>", F.lit("")),
    )


def cancellation_body(origin_text: Column, affected_text: Column) -> Column:
    """Notification text of a cancellation log row."""
    c = F.col
    return _lines(
        ("Train ID: ", c("schedule_train_id")),
        (_BREAK + "Date: ", short_date(c("origin_departure_date"))),
        ("\nTrain originating from: ", origin_text),
        (_BREAK + "Expected departure time: ", to_minute(c("origin_departure_time"))),
        (_BREAK + "Cancelled at: ", affected_text),
        (_BREAK + "Operator: ", c("toc")),
        (_BREAK + _BREAK + "Cancellation type: ", c("cancellation_type")),
        ("<br/>", F.lit("")),
    )


def change_of_origin_body(origin_text: Column, affected_text: Column) -> Column:
    """Notification text of a change-of-origin log row."""
    c = F.col
    return _lines(
        ("Train ID: ", c("schedule_train_id")),
        (_BREAK + "Date: ", short_date(c("origin_departure_date"))),
        ("\nTrain originating from: ", origin_text),
        (_BREAK + "Expected departure time: ", to_minute(c("origin_departure_time"))),
        (_BREAK + "Origin Changed To: ", affected_text),
        (_BREAK + "Operator: ", c("toc")),
        ("<br/>", F.lit("")),
    )
