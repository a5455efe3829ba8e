"""Decoding the timetable feed and the messages."""

from __future__ import annotations

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from railbeam.functions import times
from railbeam.functions.days import run_pattern
from railbeam.functions.text import delay_text, difference_text, sortable
from railbeam.sources import feed, messages
from tests import rows as R


def _values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_feed_path_names_yesterday():
    monday = dt.date(2018, 1, 15)
    assert feed.feed_path("x/DAY_FIELD.gz", "update", monday) == "x/sun.gz"
    assert feed.feed_path("x/DAY_FIELD.gz", "full", monday) == "x/DAY_FIELD.gz"


def test_read_feed_keeps_order_over_files_and_reads_gzip(spark, tmp_path):
    one = tmp_path / "one.json"
    one.write_text("\n".join(R.station_lines()[:3]) + "\n\n", encoding="utf-8")
    two = tmp_path / "two.json.gz"
    with gzip.open(two, "wt", encoding="utf-8") as out:
        out.write("\n".join(R.station_lines()[3:5]))
    lines = feed.read_feed(spark, [str(two), str(one)])
    found = [json.loads(r.value)["TiplocV1"]["tiploc_code"] for r in lines.orderBy("seq").collect()]
    assert found == ["EASTCRYD", "LONVIC", "REIGATE", "REDHILL", "MERSTHAM"]
    assert lines.select("seq").distinct().count() == 5


def test_records_are_decoded(spark):
    lines = [
        *R.station_lines(),
        R.tiploc_line("TONBRBC", None, "XTN", None),
        R.tiploc_line("POOLE", "86935", "POO", "Poole"),
        R.schedule_line("G76481", stops=[("LO", "REIGATE", None, "0649"), ("LT", "REDHILL", "0653", None)]),
        R.schedule_line("G76482", op="Delete"),
        R.association_line("W65286", "W65188", "HYWRDSH", "JJ ", days="0000010", start="2018-05-26", end="2018-12-08"),
        R.association_line("C50125", "C51070", "CRDFCEN", "??", stp="C"),
        '{"EOF":true}',
    ]
    parsed = feed.parse_feed(R.feed_frame(spark, lines)).cache()
    assert parsed.filter("reject_reason is not null").count() == 0
    assert parsed.count() == len(lines) - 1
    stations = {r.tiploc_code: r for r in feed.stanox_changes(parsed).collect()}
    assert stations["REDHILL"].description == "Redhill" and stations["REDHILL"].primary_entry is False
    assert stations["TONBRBC"].stanox_code is None and stations["TONBRBC"].primary_entry is None
    assert stations["POOLE"].primary_entry is True
    create, delete = feed.schedule_changes(parsed).orderBy("seq").collect()
    assert (create.op, delete.op) == ("Create", "Delete")
    assert create.schedule_start == dt.date(2017, 12, 11)
    assert [tuple(x) for x in create.locations] == [
        ("LO", "REIGATE", None, "06:49"),
        ("LT", "REDHILL", "06:53", None),
    ]
    first, second = feed.association_changes(parsed).orderBy("seq").collect()
    assert (first.associated_start, first.associated_end) == (dt.date(2018, 5, 26), dt.date(2018, 12, 8))
    assert (first.association_category, second.association_category) == ("JJ", None)


def test_bad_records_are_rejected_with_a_reason(spark):
    cases = {
        "not json": "not_an_object",
        '{"Other":{}}': "unknown_record_kind",
        R.schedule_line("A", op="Update"): "update_not_supported",
        R.schedule_line("A", op="Merge"): "bad_transaction_type",
        R.schedule_line("A", days="11111"): "bad_days_run",
        R.schedule_line("A", days="1111102"): "bad_days_run",
        R.schedule_line("A", stp="X"): "bad_stp_indicator",
        R.schedule_line("A", start="11/12/2017"): "bad_start_date",
        R.schedule_line("A", stops=[("LO", "REIGATE", None, "2460")]): "bad_location",
        R.schedule_line("A", stops=[("XX", "REIGATE", None, "1200")]): "bad_location",
        R.schedule_line("A").replace('"schedule_location": [', '"schedule_location": {"a": [').replace("]}}}", "]}}}}"): "bad_location",
        R.association_line("A", "B", op="Update"): "update_not_supported",
        R.association_line("A", "B").replace("T00:00:00Z", ""): "bad_start_date",
        R.tiploc_line(None, "1", "A", "a"): "bad_tiploc_code",
    }
    parsed = feed.parse_feed(R.feed_frame(spark, list(cases)))
    found = {r.value: r.reject_reason for r in feed.feed_rejects(parsed).collect()}
    assert found == cases
    header = feed.parse_feed(R.feed_frame(spark, ['{"JsonTimetableV1":{}}']))
    assert [r.reject_reason for r in header.collect()] == [None]


def test_messages_are_decoded(spark):
    raw = [
        (1, [R.activation("872A47MT14", "G73773", "24747000", "87980", 1515949140000)]),
        (2, [R.movement(stanox="24799", status="ON TIME", event="DEPARTURE"), R.movement(gbtt=None, stanox="")]),
        (3, [R.cancellation("871B26MK24", "22721000", "87701")]),
        (4, [R.change_of_origin(), {"header": {"msg_type": "0005"}, "body": {"train_id": "x"}}]),
    ]
    found = messages.explode_messages(messages.parse_messages(R.message_frame(spark, raw)))
    one, two, three, four, five, six = found.orderBy("seq", "pos").collect()
    assert (one.schedule_train_id, one.origin_stanox_code) == ("G73773", "87980")
    assert one.origin_departure_timestamp == 1515949140000
    assert (two.event_type, two.stanox_code, two.variation_status) == ("DEPARTURE", "24799", "ON TIME")
    assert three.planned_passenger_timestamp is None and three.stanox_code is None
    assert (four.cancellation_type, four.cancellation_reason_code) == ("EN ROUTE", "YI")
    assert (five.stanox_code, five.old_stanox_code, five.old_timestamp) == ("87723", "87089", None)
    assert messages.unhandled(found).count() == 1 and six.train_id is None


def test_one_bad_record_refuses_the_message(spark):
    good = R.movement()
    bad = [
        R.movement(event="HOLD"),
        R.movement(status="SLOW"),
        R.movement(actual="12x"),
        R.cancellation(kind="MAYBE"),
        R.cancellation(reason=None),
        {"header": {}, "body": {}},
    ]
    raw = [(i, [good, b]) for i, b in enumerate(bad)] + [(9, "{"), (10, [good, R.movement(status=None)])]
    parsed = messages.parse_messages(R.message_frame(spark, raw))
    assert messages.message_rejects(parsed).count() == len(bad) + 1
    assert messages.explode_messages(parsed).count() == 2


def test_scalar_functions(spark):
    ms = F.lit(1514663136789)
    assert _values(spark, times.utc_date(ms), times.utc_time(ms)) == [dt.date(2017, 12, 30), "19:45:36"]
    late = times.minutes_between(F.lit("12:10"), F.lit("12:11:59"))
    early = times.minutes_between(F.lit("12:10"), F.lit("12:08:30"))
    wrapped = times.minutes_between(F.lit("23:50"), F.lit("00:10:00"))
    assert _values(spark, late, early, wrapped) == [1, -1, -1420]
    patterns = [run_pattern(F.lit(d)) for d in ("1111100", "0000010", "0000001", "0000000")]
    assert _values(spark, *patterns) == ["Weekdays", "Saturdays", "Sundays", None]
    words = [difference_text(F.lit(n)) for n in (1, 2, 0, -1, -5)]
    assert _values(spark, *words) == ["1 minute late", "2 minutes late", "On time", "1 minute early", "5 minutes early"]
    texts = [delay_text(F.lit(s), F.lit(0), F.lit(961000)) for s in ("LATE", "ON TIME", "OFF ROUTE")]
    assert _values(spark, *texts) == ["Late by 16 minutes", "On Time", "Train is off route"]
    assert _values(spark, delay_text(F.lit("EARLY"), F.lit(200000), F.lit(0))) == ["Early by 3 minutes"]


def test_answers_do_not_depend_on_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ms = F.lit(1514663136789)
        assert _values(spark, times.utc_date(ms), times.utc_time(ms)) == [dt.date(2017, 12, 30), "19:45:36"]
        instant = times.iso_instant_date(F.lit("2018-05-26T00:00:00Z"))
        assert _values(spark, instant) == [dt.date(2018, 5, 26)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ids_of_a_long_message_are_distinct_and_in_order(spark):
    ids = spark.range(100_500).select(sortable(F.col("id").cast("int")).alias("id"), F.col("id").alias("n"))
    assert [r.n for r in ids.orderBy("id").select("n").collect()] == list(range(100_500))
