"""From feed files to tables, and the public queries on them."""

from __future__ import annotations

import datetime
import re
from contextlib import contextmanager
from dataclasses import fields, replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from railbeam.operators.associations import secondary_schedule
from railbeam.operators.fold import fold_stanox
from railbeam.operators.intervals import covering_bins
from railbeam.operators.notices import is_notifiable, movement_notices
from railbeam.operators.stations import main_records, main_records_for_notices
from railbeam.operators.stops import HEADER, flatten_schedules, schedule_rows
from railbeam.plans.enrich import logs
from railbeam.plans.history import all_schedules, history, history_display, history_requests, planned_routes
from railbeam.plans.load import FeedError, build_secondary, fold_schedule, load_timetable, store_subscribers
from railbeam.plans.search import schedule_search, schedule_search_requests
from railbeam.plans.stations import stations
from railbeam.plans.subscriptions import subscribe, subscriptions, unsubscribe
from railbeam.schemas import COLUMNS, TABLES
from railbeam.sources import feed, messages
from railbeam.sources.commits import VersionConflict, claim, latest
from railbeam.sources.snapshots import RailTables, empty_table, load_tables, read_table, write_log_batch, write_snapshots
from tests import rows as R

CODE = R.CODE
FIRST, LAST = CODE["REIGATE"], CODE["LONVIC"]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """Route A, the train that joins it, their association, and a subscriber."""
    folder = tmp_path_factory.mktemp("loaded")
    root = str(folder / "root")
    lines = [
        *R.station_lines(),
        R.tiploc_line("NOCRS", "99999", None, "Yard"),
        R.tiploc_line("LEEDS", "73321", "LDS", "Leeds"),
        R.schedule_line("87334"),
        R.schedule_line("22012", stops=R.JOINING, service="62882"),
        R.association_line("87334", "22012"),
        "broken",
    ]
    assert load_timetable(spark, root, [R.write_feed(folder / "feed.json", lines)]) == 1
    assert build_secondary(spark, root) == 2
    return root


def test_flatten_drops_untimed_and_unmapped_stops(spark):
    stops = [
        ("LO", "REIGATE", None, "1210"),
        ("LI", "REDHILL", None, None),
        ("LI", "NOWHERE", "1220", "1221"),
        ("LI", "EASTCRYD", None, "1236"),
        ("LT", "LONVIC", "1245", None),
    ]
    lines = [R.schedule_line("A", stops=stops), R.schedule_line("B", days="0000000")]
    creates = feed.schedule_changes(feed.parse_feed(R.feed_frame(spark, lines)))
    tiplocs = spark.createDataFrame(list(CODE.items()), "tiploc_code string, stanox_code string")
    rows = flatten_schedules(creates, tiplocs).orderBy("stop_sequence").collect()
    assert [r.stop_sequence for r in rows] == [1, 2, 3]
    assert rows[0].subsequent_stanox_codes == [CODE["EASTCRYD"], CODE["LONVIC"]]
    assert rows[0].subsequent_arrival_times == ["12:36", "12:45"]
    assert rows[2].subsequent_stanox_codes == [] and rows[0].days_run_pattern == "Weekdays"


def test_load_keeps_rejects_and_strict_raises(spark, loaded, tmp_path):
    found = spark.read.schema(TABLES["rejects"]).parquet(f"{loaded}/rejects/load=1").collect()
    assert [(r.reject_reason, r.value) for r in found] == [("not_an_object", "broken")]
    with pytest.raises(FeedError):
        load_timetable(spark, str(tmp_path / "r"), [R.write_feed(tmp_path / "f.json", ["broken"])], strict=True)


def test_joined_train(spark, loaded):
    rows = read_table(spark, loaded, "schedule_secondary").orderBy("stop_sequence").collect()
    names = {v: k for k, v in CODE.items()}
    assert [names[r.stanox_code] for r in rows] == [
        "GATWICK", "REIGATE", "REDHILL", "MERSTHAM", "EASTCRYD", "LONVIC",
    ]
    assert {r.schedule_train_id for r in rows} == {"22012"}
    assert [r.stop_sequence for r in rows] == [0, 1, 2, 3, 4, 5]
    assert [len(r.subsequent_stanox_codes) for r in rows] == [5, 4, 3, 2, 1, 0]


def _stitch(spark, lines):
    parsed = feed.parse_feed(R.feed_frame(spark, [*R.station_lines(), *lines]))
    stanox = feed.stanox_changes(parsed).withColumn("id", F.col("seq"))
    tiplocs = stanox.select("tiploc_code", "stanox_code")
    schedule = flatten_schedules(feed.schedule_changes(parsed), tiplocs)
    schedule = schedule.withColumn("id", F.concat_ws("-", "seq", F.col("stop_sequence").cast("string")))
    creates = feed.association_rows(feed.association_changes(parsed)).withColumn("id", F.col("seq"))
    rows = secondary_schedule(creates, schedule, stanox).orderBy("association_id", "stop_sequence").collect()
    names = {v: k for k, v in CODE.items()}
    return [names[r.stanox_code] for r in rows], rows


def test_divided_train(spark):
    lines = [
        R.schedule_line("M"),
        R.schedule_line("A", stops=R.DIVIDED, service="1"),
        R.association_line("M", "A", "EASTCRYD", "VV"),
    ]
    codes, rows = _stitch(spark, lines)
    assert codes == ["REIGATE", "REDHILL", "MERSTHAM", "EASTCRYD", "LDNBRG"]
    assert [r.service_code for r in rows] == ["799984"] * 3 + ["1"] * 2


def test_location_that_is_not_called_at(spark):
    trains = [R.schedule_line("M"), R.schedule_line("A", stops=R.JOINING)]
    codes, _ = _stitch(spark, [*trains, R.association_line("M", "A", "LDNBRG", "JJ")])
    assert codes == ["GATWICK", "REIGATE"]
    codes, _ = _stitch(spark, [*trains, R.association_line("M", "A", "LDNBRG", "VV")])
    assert codes == ["REIGATE", "REDHILL", "MERSTHAM", "EASTCRYD", "LONVIC", "GATWICK", "REIGATE"]


def test_repeated_junction_has_the_suffix_of_its_first_call(spark):
    trains = [R.schedule_line("M"), R.schedule_line("A", stops=R.JOINING)]
    codes, rows = _stitch(spark, [*trains, R.association_line("M", "A", "REIGATE", "JJ")])
    assert codes[1:3] == ["REIGATE", "REIGATE"]
    assert rows[1].subsequent_stanox_codes == rows[2].subsequent_stanox_codes
    assert rows[1].subsequent_stanox_codes[0] == CODE["REIGATE"]


@pytest.mark.parametrize(
    "association",
    [
        R.association_line("M", "A", start="2017-12-29", end="2018-01-20"),
        R.association_line("M", "other"),
        R.association_line("M", "A", days="0000010"),
    ],
)
def test_no_combined_train(spark, association):
    trains = [R.schedule_line("M"), R.schedule_line("A", stops=R.JOINING)]
    assert _stitch(spark, [*trains, association])[0] == []


def test_earliest_version_is_used(spark):
    late = [("LO", "GATWICK", None, "1300"), ("LT", "REIGATE", "1308", None)]
    lines = [
        R.schedule_line("A", stops=late, start="2017-12-15", end="2018-02-01"),
        R.schedule_line("A", stops=R.JOINING),
        R.schedule_line("M"),
        R.association_line("M", "A"),
    ]
    _, rows = _stitch(spark, lines)
    assert len(rows) == 6 and rows[0].departure_time == "12:00"


def test_stanox_fold(spark):
    stored = spark.createDataFrame(
        [("1", "KEEP", "1", "AAA", "a", True), ("2", "GONE", "2", "BBB", "b", None), ("3", "NEW", "3", "CCC", "c", None)],
        TABLES["stanox"],
    )
    lines = [
        R.tiploc_line("KEEP", "1", "ZZZ", "ignored"),
        R.tiploc_line("GONE", "2", "BBB", "b", op="Delete"),
        R.tiploc_line("NEW", "3", "C2", "c2", op="Update"),
        R.tiploc_line("NEW", "3", "C3", "c3", op="Update"),
        R.tiploc_line("NEW", "4", "C4", "c4", op="Update"),
        R.tiploc_line("BACK", "5", "D", "d1"),
        R.tiploc_line("BACK", "5", "D", "d1", op="Delete"),
        R.tiploc_line("BACK", "5", "D", "d2"),
        R.tiploc_line("BACK", "5", "D", "d3"),
        R.tiploc_line("NULL", None, "E", "e"),
        R.tiploc_line("NULL", None, "E", "e"),
    ]
    folded = fold_stanox(stored, feed.stanox_changes(feed.parse_feed(R.feed_frame(spark, lines))))
    found = sorted((r.tiploc_code, r.stanox_code or "-", r.crs, r.description) for r in folded.collect())
    assert found == [
        ("BACK", "5", "D", "d2"),
        ("KEEP", "1", "AAA", "a"),
        ("NEW", "3", "C3", "c3"),
        ("NEW", "4", "C4", "c4"),
        ("NULL", "-", "E", "e"),
        ("NULL", "-", "E", "e"),
    ]
    assert {r.id for r in folded.filter("tiploc_code = 'NEW' and stanox_code = '3'").collect()} == {"3"}


def test_update_load_deletes_recreates_and_ignores(spark, tmp_path):
    root = str(tmp_path / "root")
    one = [*R.station_lines(), R.schedule_line("A"), R.schedule_line("B"), R.schedule_line("C"),
           R.schedule_line("J", stops=R.JOINING), R.association_line("A", "J")]
    load_timetable(spark, root, [R.write_feed(tmp_path / "1.json", one)])
    build_secondary(spark, root)
    assert read_table(spark, root, "schedule_secondary").count() == 6
    two = [
        R.schedule_line("A", category="XX"),
        R.schedule_line("B", op="Delete"),
        R.schedule_line("C", op="Delete"),
        R.schedule_line("C", category="NEW"),
        R.association_line("A", "J", op="Delete"),
    ]
    load_timetable(spark, root, [R.write_feed(tmp_path / "2.json", two)])
    kept = read_table(spark, root, "schedule").select("schedule_train_id", "train_category").distinct()
    assert sorted(map(tuple, kept.collect())) == [("A", "OO"), ("C", "NEW"), ("J", "OO")]
    assert read_table(spark, root, "association").count() == 0
    assert read_table(spark, root, "schedule_secondary").count() == 0
    load_timetable(spark, root, [R.write_feed(tmp_path / "3.json", [R.schedule_line("Z")])], flush=True)
    assert read_table(spark, root, "schedule").count() == 0


def test_main_records(spark):
    stanox = spark.createDataFrame(
        [
            ("1", "A", "1", None, "no crs", True),
            ("2", "B", "1", "BBB", "b", None),
            ("3", "C", "1", "CCC", "c", True),
            ("4", "D", "2", None, "d", None),
            ("5", "E", "2", "EEE", "e", False),
        ],
        TABLES["stanox"],
    )
    assert {r.stanox_code: r.id for r in main_records(stanox).collect()} == {"1": "3", "2": "5"}
    assert {r.stanox_code: r.id for r in main_records_for_notices(stanox).collect()} == {"1": "3", "2": "4"}


def test_stations(spark, loaded):
    found = [tuple(r) for r in stations(load_tables(spark, loaded)).collect()]
    want = sorted((code, f"{name} [{crs}]") for tiploc, code, crs, name in R.STATIONS if tiploc != "LDNBRG")
    assert found == want


def test_schedule_search(spark, loaded):
    tables = load_tables(spark, loaded)
    (row,) = schedule_search(tables, FIRST, LAST, "Weekdays").filter("record_type = 'Primary'").collect()
    assert (row.schedule_train_id, row.toc_name) == ("87334", "Southern")
    assert (row.departure_time, row.arrival_time, row.from_crs, row.to_crs) == ("12:10", "12:45", "REI", "VIC")
    assert (row.subscribed, row.subscribed_flag) == (False, "N")
    (joined,) = schedule_search(tables, CODE["GATWICK"], LAST, "Weekdays").collect()
    assert (joined.record_type, joined.schedule_train_id) == ("Secondary", "22012")
    assert schedule_search(tables, FIRST, FIRST, "Weekdays").count() == 0
    assert schedule_search(tables, FIRST, LAST, "Saturdays").count() == 0
    assert schedule_search(tables, FIRST, LAST, "Weekdays", min_days=18).count() == 0
    asked = spark.createDataFrame(
        [(CODE["GATWICK"], LAST, "Weekdays", None), (FIRST, FIRST, "Weekdays", "u"), (CODE["GATWICK"], LAST, "Weekdays", "u")],
        "from_stanox_code string, to_stanox_code string, days_run_pattern string, user_id string",
    )
    many = schedule_search_requests(tables, asked).collect()
    assert sorted((str(r.user_id), r.id) for r in many) == [("None", joined.id), ("u", joined.id)]


def _filled(spark, table, rows):
    """Rows of a table from dicts; columns that are not named are null."""
    columns = COLUMNS[table]
    return spark.createDataFrame([[row.get(c) for c in columns] for row in rows], empty_table(spark, table).schema)


@contextmanager
def _no_broadcasts(spark):
    """As with large tables; tables of a few rows would be broadcast."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.maxPlanStringLength")
    before = {s: spark.conf.get(s, None) for s in settings}
    for setting, value in zip(settings, ("-1", "-1", "100000000")):
        spark.conf.set(setting, value)
    try:
        yield
    finally:
        for setting, value in before.items():
            spark.conf.unset(setting) if value is None else spark.conf.set(setting, value)


def _moves(rows):
    """The exchanges of a plan that has run, without those that are used again."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("\n+- == Initial Plan")]
    return [line for line in final.splitlines() if re.search(r"(?<!, )Exchange hashpartitioning", line)]


def test_search_totals_equal_the_listed_rows(spark):
    day, end = datetime.date(2024, 1, 1), datetime.date(2024, 3, 1)

    def train(k, **other):
        row = {
            "id": f"{k:03d}", "schedule_train_id": f"T{k}", "service_code": "S", "stp_indicator": "P", "atoc_code": "SN",
            "stanox_code": "A", "subsequent_stanox_codes": ["B", "C"], "subsequent_arrival_times": ["10:00", f"11:{k:02d}"],
            "days_run_pattern": "Weekdays", "schedule_start": day, "schedule_end": end, "departure_time": "09:00",
        }
        return {**row, **other}

    primary = [train(k) for k in range(12)] + [train(3, id="777", service_code=None), train(12, id=None), train(13, id="000")]
    secondary = [train(k, id=f"5{k}", subsequent_arrival_times=["10:30", "12:30"]) for k in (0, 1, 20)]

    def hold(user, trains, to="C"):
        return [
            {"user_id": user, "schedule_train_id": f"T{k}", "service_code": "S", "from_stanox_code": "A",
             "to_stanox_code": to, "days_run_pattern": "Weekdays"} for k in trains
        ]

    held = [
        *hold("none", []), *hold("first", [0, 13]), *hold("run", [13, 0, 1, 2, 5]), *hold("late", [4, 4, 9]),
        *hold("most", [*range(12), 13, 20]), *hold("both", [0, 1]), *hold("both", [13], "B"), *hold("unasked", [0], "B"), *hold(None, [0]),
        *hold("all", [*range(21)]), {**hold("blank", [3])[0], "service_code": None},
    ]
    tables = RailTables(**{
        **{f.name: empty_table(spark, f.name) for f in fields(RailTables)}, "schedule": _filled(spark, "schedule", primary),
        "schedule_secondary": _filled(spark, "schedule_secondary", secondary), "subscribers": _filled(spark, "subscribers", held),
    })
    users = ["none", "first", "run", "late", "most", "both", "unasked", "all", "blank", None, "none"]
    asked = [("A", "C", "Weekdays", u) for u in users] + [("A", "B", "Weekdays", "both"), ("A", "Z", "Weekdays", "lost"), (None, "C", "Weekdays", "first")]
    requests = spark.createDataFrame(asked, "from_stanox_code string, to_stanox_code string, days_run_pattern string, user_id string")
    listed = schedule_search_requests(tables, requests).groupBy("user_id", "subscribed", "subscribed_flag").agg(
        F.count("*").alias("trains"), F.min("id").alias("first_id")
    )
    totals = schedule_search_requests(tables, requests, totals=True)
    shown = ["user_id", "subscribed", "subscribed_flag", "trains", "first_id"]
    assert totals.columns == shown
    want, got = (sorted(map(str, t.select(*shown).collect())) for t in (listed, totals))
    assert got == want and len(want) > 12
    with _no_broadcasts(spark):
        totals = schedule_search_requests(tables, requests, totals=True).select(*shown)
        assert sorted(map(str, totals.collect())) == want
        moved = [line for line in _moves(totals) if re.search(r"\(stanox_code#\d+, days_run_pattern#\d+, \d+\)", line)]
    assert len(moved) == 2  # the primary schedule once, and the secondary one


def _batch(spark, records, start=1514664000000):
    raw = [(start + i, [r]) for i, r in enumerate(records)]
    return messages.explode_messages(messages.parse_messages(R.message_frame(spark, raw)))


def test_history(spark, loaded, tmp_path):
    day = 24 * 3600 * 1000
    departs = 1514376600000  # 2017-12-27 12:10 UTC
    records = []
    for n in (1, 0):
        at = departs + n * day
        records += [
            R.activation(f"run{n}", "87334", "799984", FIRST, at),
            R.movement(f"run{n}", "799984", FIRST, at + 90000, at, "LATE", "DEPARTURE"),
            R.movement(f"run{n}", "799984", FIRST, at + 990000, at, "LATE", "DEPARTURE"),
            R.movement(f"run{n}", "799984", LAST, at + 34 * 60000, at + 35 * 60000, "EARLY", "ARRIVAL"),
        ]
    records += [
        R.activation("run2", "87334", "799984", FIRST, departs + 2 * day),
        R.movement("run2", "799984", FIRST, departs + 2 * day, departs + 2 * day, "ON TIME", "DEPARTURE"),
        R.cancellation("run2", "799984", CODE["REDHILL"], reason="A"),
        R.cancellation("run2", "799984", CODE["MERSTHAM"], reason="B"),
    ]
    made = logs(_batch(spark, records))
    tables = load_tables(spark, loaded)
    root = str(tmp_path)
    write_log_batch(made.movements, root, "movement_log", "t-0")
    write_log_batch(made.cancellations, root, "cancellation_log", "t-0")
    logged = type(tables)(
        **{
            **tables.__dict__,
            "movement_log": read_table(spark, root, "movement_log"),
            "cancellation_log": read_table(spark, root, "cancellation_log"),
        }
    )
    found = history(logged, "87334", FIRST, LAST, from_ts=departs)
    (head,) = found.header.collect()
    assert (head.from_crs, head.to_crs, head.expected_departure_time, head.expected_arrival_time) == (
        "REI", "VIC", "12:10", "12:45",
    )
    pairs = found.movements.collect()
    assert [str(p.scheduled_departure_date) for p in pairs] == ["2017-12-27", "2017-12-28"]
    assert {(p.actual_departure_time, p.departure_difference, p.arrival_difference) for p in pairs} == {("12:11:30", 1, -1)}
    (day_off,) = found.cancellations.collect()
    assert (str(day_off.scheduled_departure_date), day_off.cancellation_reason_code) == ("2017-12-29", "A")
    shown = history_display(found).collect()
    assert [r.departure_text for r in shown] == ["CANCELLED", "1 minute late", "1 minute late"]
    assert history(logged, "87334", FIRST, LAST, from_ts=departs + day, to_ts=departs + day).movements.count() == 1
    none = history(logged, "87334", FIRST, "00000", from_ts=departs)
    assert none.header.count() == 0 and none.movements.count() == 0 and none.cancellations.count() == 0


def test_history_bounds_are_those_of_answered_requests(spark, loaded):
    asked = spark.createDataFrame(
        [("87334", FIRST, LAST, 0, 86_400_000), ("none", FIRST, LAST, None, None), (None, FIRST, LAST, None, None)],
        "schedule_train_id string, from_stanox_code string, to_stanox_code string, from_ts bigint, to_ts bigint",
    )
    tables = replace(load_tables(spark, loaded), movement_log=_filled(spark, "movement_log", [{"id": "1"}]))
    found = history_requests(tables, asked)
    plan = spark._jvm.PythonSQLUtils.explainString(found.movements._jdf.queryExecution(), "formatted")
    assert "Window" in plan.split("===== Subqueries =====")[1]
    assert [r.schedule_train_id for r in found.header.collect()] == ["87334"]


def test_a_whole_group_of_days_is_one_bin(spark):
    day = 86_400_000
    ranges = spark.createDataFrame(
        [(0, 2**63 - 1), (5 * day, 5 * day), (8 * day, 16 * day - 1), (8 * day, 15 * day - 1), (2 * day, day)], "a bigint, b bigint"
    )
    bins = ranges.select("a", "b", covering_bins(F.col("a"), F.col("b")).alias("bins")).collect()
    got = [r.bins and sorted((x.level, x.bin) for x in r.bins) for r in bins]
    assert got == [[(15, 0)], [(0, 5)], [(3, 1)], [(0, 14), (1, 6), (2, 2)], None]


def _subscriber(spark, from_, to, train="87334", service="799984"):
    values = {
        "id": "1", "user_id": "u", "email": "u@example.org", "schedule_train_id": train,
        "service_code": service, "from_stanox_code": from_, "to_stanox_code": to,
    }
    row = tuple(values.get(c) for c in COLUMNS["subscribers"])
    return spark.createDataFrame([row], TABLES["subscribers"])


def test_movement_notices_reach_the_range_only(spark, loaded):
    tables = load_tables(spark, loaded)
    held = _subscriber(spark, CODE["REDHILL"], CODE["EASTCRYD"])
    at = 1514376600000

    def notices(stop, late_minutes=16, status="LATE", service="799984"):
        records = [
            R.activation("run", "87334", service, FIRST, at),
            R.movement("run", service, CODE[stop], at + late_minutes * 60000, at, status),
        ]
        log = logs(_batch(spark, records)).movements
        return movement_notices(log, held, tables.schedule, tables.schedule_secondary, tables.stanox)

    reached = {
        s: notices(s).count() for s in ("REIGATE", "REDHILL", "MERSTHAM", "EASTCRYD", "LONVIC")
    }
    assert reached == {"REIGATE": 0, "REDHILL": 1, "MERSTHAM": 1, "EASTCRYD": 1, "LONVIC": 0}
    assert notices("MERSTHAM", late_minutes=13).count() == 0
    assert notices("MERSTHAM", late_minutes=15).count() == 0
    assert notices("MERSTHAM", late_minutes=0, status="OFF ROUTE").count() == 1
    assert notices("MERSTHAM", service="other").count() == 0
    body = notices("MERSTHAM").first().body
    assert "Station affected: [MHM] Merstham<br/>" in body and "Status: Late by 16 minutes" in body


def test_subscriptions(spark, loaded, tmp_path):
    tables = load_tables(spark, loaded)
    first = tables.schedule.filter(F.col("stanox_code") == FIRST).filter("schedule_train_id = '87334'").first()
    columns = [c for c in COLUMNS["subscribers"] if c not in ("id", "schedule_train_id", "service_code")]

    def request(seq, record_id, email="e"):
        values = {"user_id": "u", "email": email, "from_stanox_code": FIRST, "to_stanox_code": LAST}
        return (seq, "Primary", record_id, *[values.get(c) for c in columns])

    kinds = dict(tables.subscribers.dtypes)
    schema = "seq string, record_type string, record_id string, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    asked = spark.createDataFrame(
        [request("a", first.id, "one"), request("b", first.id, "two"), request("c", "missing")], schema
    )
    added, refused = subscribe(tables, asked)
    assert [(r.email, r.schedule_train_id, r.service_code) for r in added.collect()] == [("one", "87334", "799984")]
    assert [r.seq for r in refused.collect()] == ["c"]
    root = str(tmp_path / "subs")
    store_subscribers(spark, root, added)
    stored = load_tables(spark, root)
    assert subscribe(type(tables)(**{**tables.__dict__, "subscribers": stored.subscribers}), asked)[0].count() == 0
    (listed,) = subscriptions(stored, "u").collect()
    assert "email" not in listed.asDict()
    wishes = spark.createDataFrame([("other", listed.id)], "user_id string, id string")
    remaining, refused = unsubscribe(stored.subscribers, wishes)
    assert (remaining.count(), refused.count()) == (1, 1)
    own = spark.createDataFrame([("u", listed.id)], "user_id string, id string")
    remaining, refused = unsubscribe(stored.subscribers, own)
    assert (remaining.count(), refused.count()) == (0, 0)


def test_notifiable_is_strict(spark):
    rows = spark.createDataFrame(
        [("LATE", 900000), ("LATE", 900001), ("EARLY", 900001), ("OFF ROUTE", 0)], "variation_status string, d bigint"
    ).withColumn("actual_timestamp", F.col("d")).withColumn("planned_passenger_timestamp", F.lit(0))
    assert [r[0] for r in rows.select(is_notifiable()).collect()] == [False, True, False, True]


def test_two_writers_and_a_reader_in_between(spark, tmp_path):
    root = str(tmp_path / "root")
    load_timetable(spark, root, [R.write_feed(tmp_path / "a.json", [*R.station_lines(), R.schedule_line("G1")])])
    before = latest(spark, root)
    assert claim(spark, root, "load") != claim(spark, root, "load")
    after = write_snapshots(spark, root, {"schedule": empty_table(spark, "schedule")}, based_on=before)
    # A reader that resolved its commit before still sees the tables of that moment.
    assert read_table(spark, root, "schedule", before).count() > 0 == read_table(spark, root, "schedule").count()
    with pytest.raises(VersionConflict):
        write_snapshots(spark, root, {"schedule": empty_table(spark, "schedule")}, based_on=before)
    # Writers of other tables don't disturb each other, unless one has read what the other writes.
    write_snapshots(spark, root, {"association": empty_table(spark, "association")}, based_on=before)
    with pytest.raises(VersionConflict):
        write_snapshots(spark, root, {"subscribers": empty_table(spark, "subscribers")}, based_on=before, reads=["schedule"])
    now = latest(spark, root)
    assert now.number == after.number + 1 and now.manifests["schedule"] == after.manifests["schedule"]


def test_unknown_kinds_of_records_share_one_directory(spark, tmp_path):
    root = str(tmp_path / "root")
    lines = [*R.station_lines(), *('{"Odd%d":{}}' % k for k in range(30))]
    load_timetable(spark, root, [R.write_feed(tmp_path / "a.json", lines)])
    rejects = spark.read.parquet(f"{root}/rejects").where("reject_reason = 'unknown_record_kind'").collect()
    assert {r.value for r in rejects} == {'{"Odd%d":{}}' % k for k in range(30)} and {r.kind for r in rejects} == {"Unknown"}


def test_stops_sorted_by_record_are_not_sorted_again(spark):
    records = spark.range(600).select(F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("pos"), (F.col("id") % 300).alias("seq"))
    one = Window.partitionBy("seq")
    header = F.struct(*[F.lit(None).cast("date" if "schedule_" in c and "id" not in c else "string").alias(c) for c in HEADER])
    rows = records.distinct().withColumn("n", F.count("*").over(one)).select(
        "seq", header.alias("header"), "pos", F.concat(F.lit("T"), "pos").alias("tiploc_code"),
        F.lit("LI").alias("location_type"), F.lit("10:00").alias("arrival_time"), F.col("n").cast("string").alias("departure_time"),
    )
    tiplocs = spark.createDataFrame([(f"T{k}", f"0{k}") for k in range(3)], "tiploc_code string, stanox_code string")
    flat = schedule_rows(rows, F.broadcast(tiplocs))
    got = {(r.seq, r.stop_sequence, r.stanox_code, tuple(r.subsequent_stanox_codes)) for r in flat.collect()}
    assert got == {(k, n + 1, f"0{n}", tuple(f"0{m}" for m in range(n + 1, 3))) for k in range(300) for n in range(3)}
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.split("Initial Plan")[-1].count("Sort [seq") == 1


def test_heads_are_made_once_per_record(spark):
    stops = spark.createDataFrame(
        [(1, 2, "T2"), (1, 0, "T0"), (1, 1, "T9"), (2, 0, "T0")], "seq bigint, pos int, tiploc_code string"
    ).select("*", F.struct("seq").alias("header"), F.lit("LI").alias("location_type"), F.lit("10:00").alias("arrival_time"), F.lit(None).cast("string").alias("departure_time"))
    tiplocs = spark.createDataFrame([("T0", "00"), ("T2", "02")], "tiploc_code string, stanox_code string")

    def head(order):
        dates = [F.lit("2024-01-01").cast("date").alias(c) for c in ("schedule_start", "schedule_end")]
        named = {"schedule_train_id": order["seq"].cast("string"), "days_run": F.lit("1111100")}
        texts = [named.get(c, F.lit(c)).alias(c) for c in HEADER if c not in ("schedule_start", "schedule_end")]
        return F.struct(*texts, *dates)

    flat = schedule_rows(stops, tiplocs, head)
    got = [(r.schedule_train_id, r.stop_sequence, r.stanox_code, r.subsequent_stanox_codes, r.days_run_pattern) for r in flat.collect()]
    assert sorted(got) == [("1", 1, "00", ["02"], "Weekdays"), ("1", 2, "02", [], "Weekdays"), ("2", 1, "00", [], "Weekdays")]


def test_new_rows_of_a_fold_are_not_moved_with_their_later_stops(spark):
    def fold(stored, lines):
        changes = feed.schedule_changes(feed.parse_feed(R.feed_frame(spark, lines)))
        return fold_schedule(stored, changes, stations)

    places = feed.stanox_changes(feed.parse_feed(R.feed_frame(spark, R.station_lines())))
    stations = fold_stanox(empty_table(spark, "stanox"), places)
    short, nowhere = R.ROUTE[:2], [("LO", "NOWHERE", None, "1210")]
    before = [R.schedule_line("T1"), R.schedule_line("T2", stops=short), R.schedule_line("T3", stops=short)]
    rows = fold(empty_table(spark, "schedule"), before).withColumn("train_category", F.lit("STORED")).collect()
    # A stored row whose key has a null part conflicts with nothing.
    rows = [tuple(None if r.schedule_train_id == "T3" and c == "service_code" else r[c] for c in COLUMNS["schedule"]) for r in rows]
    stored = spark.createDataFrame(rows, TABLES["schedule"])
    lines = [
        R.schedule_line("T1", op="Delete"), R.schedule_line("T1", category="A", stops=short), R.schedule_line("T1", category="B"),
        R.schedule_line("T2", category="C"), R.schedule_line("T2", category="D", service="other", stops=short),
        R.schedule_line("T3", category="E", stops=short), R.schedule_line("T4", category="F", stops=nowhere),
        R.schedule_line("T5", category="G"), R.schedule_line("T5", op="Delete"),
    ]
    folded = fold(stored, lines)
    got = sorted((r.schedule_train_id, r.train_category, r.stop_sequence, len(r.subsequent_stanox_codes)) for r in folded.collect())
    assert got == [
        ("T1", "A", 1, 1), ("T1", "A", 2, 0), ("T1", "B", 3, 2), ("T1", "B", 4, 1), ("T1", "B", 5, 0),
        ("T2", "C", 3, 2), ("T2", "C", 4, 1), ("T2", "C", 5, 0), ("T2", "D", 1, 1), ("T2", "D", 2, 0),
        ("T2", "STORED", 1, 1), ("T2", "STORED", 2, 0),
        ("T3", "E", 1, 1), ("T3", "E", 2, 0), ("T3", "STORED", 1, 1), ("T3", "STORED", 2, 0),
    ]
    plan = folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    partial = next(k for k, line in enumerate(plan) if "partial_min_by" in line)
    assert "Exchange" not in plan[partial - 1] and "SortAggregate" in plan[partial - 1]


def test_schedule_rows_that_met_their_routes_are_reduced_in_place(spark, loaded):
    tables = load_tables(spark, loaded)
    routes = spark.createDataFrame(
        [("87334", FIRST, LAST), ("87334", FIRST, CODE["REDHILL"]), ("87334", LAST, FIRST), ("87334", FIRST, FIRST), ("no", FIRST, LAST)],
        "schedule_train_id string, from_stanox_code string, to_stanox_code string",
    )
    with _no_broadcasts(spark):
        planned = planned_routes(all_schedules(tables), routes)
        got = sorted((r.to_stanox_code, r.expected_departure_time, r.expected_arrival_time) for r in planned.collect())
        moved = _moves(planned)
    assert got == [(LAST, "12:10", "12:45"), (CODE["REDHILL"], "12:10", "12:14")]
    assert moved and not any("end#" in line for line in moved)
