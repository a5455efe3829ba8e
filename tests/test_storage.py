"""The commit list, the clustered tables, the maintained view, the logs, and what reads them."""

from __future__ import annotations

import datetime as dt
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from railbeam.operators.intervals import asked_rows, covering_bins, meet, row_bins
from railbeam.operators.notices import watched_stops
from railbeam.plans import load as jobs
from railbeam.plans.enrich import enrich, logs
from railbeam.plans.load import (
    add_subscriptions,
    build_secondary,
    flush_table,
    load_timetable,
    remove_subscriptions,
    store_subscribers,
)
from railbeam.plans.search import schedule_search
from railbeam.plans.stored import history_stored, search_stored
from railbeam.schemas import COLUMNS, TABLES
from railbeam.sources import snapshots
from railbeam.sources.commits import VersionConflict, files_of, latest
from railbeam.sources.files import create_whole, names, read_text
from railbeam.sources.messages import explode_messages, parse_messages, read_messages
from railbeam.sources.snapshots import (
    compact_log,
    empty_table,
    load_tables,
    read_log,
    read_table,
    remove_unused,
    write_log_batch,
)
from railbeam.streaming.listener import batch_notices, kept_salts
from tests import rows as R

CODE = R.CODE
FIRST, LAST = CODE["REIGATE"], CODE["LONVIC"]
TRAINS = [f"T{k}" for k in range(40)]


@pytest.fixture(scope="module")
def timetable(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("timetable")
    root = str(folder / "root")
    lines = [*R.station_lines(), *[R.schedule_line(t, days=["1111100", "0000010", "0000001"][k % 3]) for k, t in enumerate(TRAINS)]]
    lines += [R.schedule_line("J", stops=R.JOINING), R.association_line(TRAINS[0], "J")]
    load_timetable(spark, root, [R.write_feed(folder / "a.json", lines)], flush=True, buckets=32)
    build_secondary(spark, root)
    store_subscribers(spark, root, subscribers(spark, [(f"s{k}", f"u{k % 5}", t) for k, t in enumerate(TRAINS[:20])]))
    return root


def subscribers(spark, held):
    def row(record_id, user, train):
        values = {
            "id": record_id, "user_id": user, "email": f"{user}@example.org", "schedule_train_id": train,
            "service_code": "799984", "from_stanox_code": FIRST, "to_stanox_code": LAST, "days_run_pattern": "Weekdays",
        }
        return tuple(values.get(c) for c in COLUMNS["subscribers"])

    return spark.createDataFrame([row(*h) for h in held], TABLES["subscribers"])


def texts(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_one_search_and_one_history_open_few_files(spark, timetable):
    tables = load_tables(spark, timetable, stops=[("Weekdays", FIRST)])
    every = files_of(spark, timetable, latest(spark, timetable), "schedule_by_stop")
    assert len(tables.schedule.inputFiles()) == 1 < len(every)
    assert texts(search_stored(spark, timetable, FIRST, LAST, "Weekdays")) == texts(
        schedule_search(load_tables(spark, timetable), FIRST, LAST, "Weekdays")
    )
    by_train = load_tables(spark, timetable, trains=["T3"])
    every = files_of(spark, timetable, latest(spark, timetable), "schedule")
    assert len(by_train.schedule.inputFiles()) == 1 < len(every)
    assert by_train.schedule.filter("schedule_train_id = 'T3'").count() == 5
    assert load_tables(spark, timetable, trains=["no such train"]).schedule.filter("schedule_train_id = 'no such train'").count() == 0


def test_bounds_leave_out_files(spark):
    file = snapshots.File("p", 0, 1, ["B", "1"], ["D", "3"])
    by = ("x", "y")
    assert snapshots._may_hold(file, by, {"x": ["C"]}) and snapshots._may_hold(file, by, {"y": ["0", "3"]})
    assert not snapshots._may_hold(file, by, {"x": ["A", "E"]}) and not snapshots._may_hold(file, by, {"x": ["C"], "y": ["4"]})


def test_update_rewrites_its_buckets_only_and_both_copies_agree(spark, timetable, tmp_path):
    before = latest(spark, timetable)
    lines = [R.schedule_line("T1", op="Delete"), R.schedule_line("T2", category="XX"), R.schedule_line("NEW", days="0000010")]
    load_timetable(spark, timetable, [R.write_feed(tmp_path / "b.json", lines)])
    after = latest(spark, timetable)
    changed = {snapshots.bucket_number([t], before.buckets) for t in ("T1", "T2", "NEW")}
    old, new = files_of(spark, timetable, before, "schedule"), files_of(spark, timetable, after, "schedule")
    assert {f.path for f in old if f.bucket not in changed} == {f.path for f in new if f.bucket not in changed}
    assert all(f.path not in {g.path for g in old} for f in new if f.bucket in changed)
    for table, copy in snapshots.COPIES.items():
        assert texts(read_table(spark, timetable, table)) == texts(read_table(spark, timetable, copy))
    trains = {r[0] for r in read_table(spark, timetable, "schedule").select("schedule_train_id").distinct().collect()}
    assert trains == {*TRAINS, "J", "NEW"} - {"T1"}
    # The commit before still reads what it listed.
    assert "T1" in {r[0] for r in read_table(spark, timetable, "schedule", before).select("schedule_train_id").collect()}


def view_is_right(spark, root):
    tables = load_tables(spark, root)
    want = watched_stops(tables.subscribers, tables.schedule, tables.schedule_secondary)
    assert texts(read_table(spark, root, "watched_stops")) == texts(want)
    return want.count()


def requests(spark, asked):
    """(seq, user, record id) as subscribe requests."""
    columns = [c for c in COLUMNS["subscribers"] if c not in ("id", "schedule_train_id", "service_code")]
    kinds = dict(empty_table(spark, "subscribers").dtypes)

    def row(seq, user, record_id):
        values = {"user_id": user, "email": "e", "from_stanox_code": FIRST, "to_stanox_code": LAST}
        return (seq, "Primary", record_id, *[values.get(c) for c in columns])

    schema = "seq string, record_type string, record_id string, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    return spark.createDataFrame([row(*a) for a in asked], schema)


def test_view_follows_every_job(spark, tmp_path):
    root = str(tmp_path / "root")
    lines = [*R.station_lines(), R.schedule_line("A"), R.schedule_line("B"), R.schedule_line("J", stops=R.JOINING), R.association_line("A", "J")]
    load_timetable(spark, root, [R.write_feed(tmp_path / "a.json", lines)])
    first = read_table(spark, root, "schedule").filter(F.col("stanox_code") == FIRST)
    ids = {r.schedule_train_id: r.id for r in first.collect()}
    refused = add_subscriptions(spark, root, requests(spark, [("1", "u", ids["A"]), ("2", "v", ids["B"]), ("3", "u", "none")]))
    assert [r.seq for r in refused.collect()] == ["3"] and view_is_right(spark, root) == 10
    build_secondary(spark, root)
    view_is_right(spark, root)
    load_timetable(spark, root, [R.write_feed(tmp_path / "b.json", [R.schedule_line("A", op="Delete"), R.association_line("A", "J", op="Delete")])])
    assert view_is_right(spark, root) == 5
    refused = remove_subscriptions(spark, root, spark.createDataFrame([("v", "2"), ("u", "2")], "user_id string, id string"))
    assert [(r.user_id, r.id) for r in refused.collect()] == [("u", "2")] and view_is_right(spark, root) == 0
    flush_table(spark, root, "schedule")
    assert read_table(spark, root, "schedule").count() == read_table(spark, root, "schedule_by_stop").count() == 0


def test_two_subscribers_jobs_lose_nothing(spark, timetable, monkeypatch):
    first = read_table(spark, timetable, "schedule").filter((F.col("stanox_code") == FIRST) & (F.col("schedule_train_id") == "T30"))
    record = first.first().id
    before = latest(spark, timetable)
    real, other = jobs.refreshed_view, []

    def with_another_writer(*args):
        if not other:
            other.append(True)
            add_subscriptions(spark, timetable, requests(spark, [("x1", "first", record)]))
        return real(*args)

    monkeypatch.setattr(jobs, "refreshed_view", with_another_writer)
    add_subscriptions(spark, timetable, requests(spark, [("x2", "second", record), ("x3", "first", record)]))
    held = read_table(spark, timetable, "subscribers").filter("schedule_train_id = 'T30'").collect()
    assert sorted((r.id, r.user_id) for r in held) == [("x1", "first"), ("x2", "second")]
    assert read_table(spark, timetable, "subscribers").count() == 22
    # A whole set that was made from what is no longer current is refused.
    with pytest.raises(VersionConflict):
        store_subscribers(spark, timetable, empty_table(spark, "subscribers"), based_on=before)
    with pytest.raises(VersionConflict):
        flush_table(spark, timetable, "subscribers", based_on=before)
    view_is_right(spark, timetable)


def test_one_of_many_creates_a_file(spark, tmp_path):
    path, won = str(tmp_path / "entry.json"), []

    def create(k):
        if create_whole(spark, path, f"text {k}"):
            won.append(k)

    threads = [threading.Thread(target=create, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and read_text(spark, path) == f"text {won[0]}" and names(spark, str(tmp_path)) == ["entry.json"]


# Logs ---------------------------------------------------------------------------------------------

DAY = 24 * 3600 * 1000
DEPARTS = 1514376600000  # 2017-12-27 12:10 UTC


def batch(spark, k, days=2):
    records = []
    for n in range(days):
        at = DEPARTS + n * DAY
        run = f"run{k}-{n}"
        records += [R.activation(run, f"T{k}", "799984", FIRST, at), R.movement(run, "799984", FIRST, at + 20 * 60000, at, "LATE", "DEPARTURE")]
        records += [R.movement(run, "799984", LAST, at + 60 * 60000, at, "LATE", "ARRIVAL"), R.cancellation(run, "799984", FIRST)]
    raw = [(DEPARTS + i, [r]) for i, r in enumerate(records)]
    return logs(explode_messages(parse_messages(R.message_frame(spark, raw))), ttl_ms=DAY)


def test_a_day_of_batches_becomes_few_files_while_it_is_read(spark, tmp_path):
    root = str(tmp_path)
    for k in range(6):
        write_log_batch(batch(spark, k).movements, root, "movement_log", f"stream-{k}")
    reader = read_log(spark, root, "movement_log")
    want = texts(reader)
    assert len(want) == 24 and len(reader.inputFiles()) >= 12
    day = "2017-12-27"
    assert compact_log(spark, root, "movement_log", day) == 5  # the last batch of the stream may still be written again
    assert texts(reader) == want == texts(read_log(spark, root, "movement_log"))
    write_log_batch(batch(spark, 5).movements, root, "movement_log", "stream-5")
    write_log_batch(batch(spark, 6).movements, root, "movement_log", "stream-6")
    assert read_log(spark, root, "movement_log").count() == 28
    assert compact_log(spark, root, "movement_log", day, closed=True) == 2 and compact_log(spark, root, "movement_log", day) == 0
    only = read_log(spark, root, "movement_log", dates=(dt.date(2017, 12, 27), dt.date(2017, 12, 27)))
    assert only.count() == 14 and len(only.inputFiles()) <= 2
    before = texts(read_log(spark, root, "movement_log"))
    assert remove_unused(spark, root, older_than_ms=3_600_000) == 0
    assert remove_unused(spark, root, older_than_ms=0) >= 7
    assert texts(read_log(spark, root, "movement_log")) == before


def test_two_compactions_of_a_day_do_not_both_count(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for k in range(3):
        write_log_batch(batch(spark, k, days=1).movements, root, "movement_log", f"s-{k}")
    want, real = texts(read_log(spark, root, "movement_log")), snapshots.publish
    other = []

    def late(*args, **more):
        if not other:
            other.append(True)
            compact_log(spark, root, "movement_log", "2017-12-27", closed=True)
        return real(*args, **more)

    monkeypatch.setattr(snapshots, "publish", late)
    with pytest.raises(VersionConflict):
        compact_log(spark, root, "movement_log", "2017-12-27", closed=True)
    assert texts(read_log(spark, root, "movement_log")) == want


def test_history_looks_back_thirty_days_by_default(spark, timetable, tmp_path):
    made = batch(spark, 7, days=40)
    write_log_batch(made.movements, timetable, "movement_log", "h-0")
    write_log_batch(made.cancellations, timetable, "cancellation_log", "h-0")
    train = "T6"  # a weekday train; the log's is T7 of Saturdays
    assert history_stored(spark, timetable, train, FIRST, LAST, from_ts=0).movements.count() == 0
    now = DEPARTS + 40 * DAY
    found = history_stored(spark, timetable, "T7", FIRST, LAST, now_ms=now)
    assert found.movements.count() == 30 and found.cancellations.count() == 30
    assert history_stored(spark, timetable, "T7", FIRST, LAST, from_ts=0).movements.count() == 40
    assert history_stored(spark, timetable, "T7", FIRST, LAST, from_ts=DEPARTS, to_ts=DEPARTS).movements.count() == 1


def test_notices_of_a_batch_read_no_schedule(spark, timetable):
    made = batch(spark, 3)
    notices = batch_notices(spark, timetable, made)
    plan = notices._jdf.queryExecution().toString()
    assert "/watched_stops/" in plan and "/schedule" not in plan
    tables = load_tables(spark, timetable)
    from railbeam.operators.notices import cancellation_notices, movement_notices

    want = movement_notices(made.movements, tables.subscribers, tables.schedule, tables.schedule_secondary, tables.stanox)
    want = want.unionByName(cancellation_notices(made.cancellations, tables.subscribers, tables.stanox))
    assert texts(notices) == texts(want) and want.count() > 0


def test_a_checkpoint_keeps_its_state_groups(spark, tmp_path):
    new, old = str(tmp_path / "new"), tmp_path / "old"
    assert kept_salts(spark, new, 4) == 4 and kept_salts(spark, new, 7) == 4
    (old / "offsets").mkdir(parents=True)
    (old / "offsets" / "0").write_text("v1")
    assert kept_salts(spark, str(old), 4) == 1 and kept_salts(spark, str(old), 4) == 1


# Messages and the as-of join ----------------------------------------------------------------------


def test_a_large_landing_file_is_read_by_many_tasks_in_order(spark, tmp_path):
    lines = [f'[{{"n":{k}}}]' if k % 5 else "" for k in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(lines), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        messages = read_messages(spark, str(tmp_path))
        assert messages.rdd.getNumPartitions() >= 4
        found = messages.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in found] == [line for line in lines if line] and len({r.seq for r in found}) == len(found)


def test_only_heavy_groups_are_salted(spark):
    records = []
    for k in range(60):
        train = "busy" if k % 3 else f"t{k}"
        records += [R.activation(train, f"U{k}", "1", FIRST, DEPARTS + k)] if k % 6 == 0 or k == 1 else [R.movement(train, "1", FIRST, DEPARTS, DEPARTS)]
    raw = [(DEPARTS + i * 1000, [r]) for i, r in enumerate(records)]
    exploded = explode_messages(parse_messages(R.message_frame(spark, raw)))
    want = texts(enrich(exploded, ttl_ms=20_000, salts=1))
    assert want and texts(enrich(exploded, ttl_ms=20_000, salts=3, heavy_rows=2)) == want
    assert texts(enrich(exploded, ttl_ms=20_000, salts=3)) == want
    split = enrich(exploded, ttl_ms=20_000, salts=3, heavy_rows=2)._jdf.queryExecution().toString()
    assert "approx_top_k" in split and "approx_top_k" not in enrich(exploded, salts=1)._jdf.queryExecution().toString()


def test_bins_hold_just_the_days_of_a_range(spark):
    day = 86_400_000
    ranges = [(0, 2**63 - 1), (5 * day, 5 * day + 1), (day - 1, 70 * day), (31 * day, 32 * day), (32 * day, 64 * day - 1), (3 * day, 2 * day), (1023 * day, 40_000 * day), (0, 0)]
    moments = [0, 1, day - 1, day, 5 * day, 31 * day, 32 * day, 63 * day + 5, 64 * day, 70 * day, 1024 * day, 32_767 * day, 50_000 * day]
    asked = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ranges)], "k int, a bigint, b bigint")
    asked = asked.select("k", F.explode(covering_bins(F.col("a"), F.col("b"))).alias("bin"))
    rows = spark.createDataFrame([(m,) for m in moments], "m bigint").select("m", F.explode(row_bins(F.col("m"))).alias("bin"))
    met = sorted((r.k, r.m) for r in asked.join(rows, "bin").select("k", "m").collect())
    last = 32_767
    want = sorted((k, m) for k, (a, b) in enumerate(ranges) for m in moments if min(a // day, last) <= min(m // day, last) <= min(b // day, last))
    assert met == want  # each pair once
    assert asked.groupBy("k").count().agg(F.max("count")).first()[0] <= 6 * 32


def test_a_range_is_few_bins_and_needs_are_not_broadcast(spark):
    day = 86_400_000
    ranges = [(k % 3, a * day, (a + k) * day) for k in range(1, 60) for a in (7, 19_733)] + [(1, 0, 2**63 - 1), (2, 9 * day, 8 * day)]
    needs = spark.createDataFrame(ranges, "k int, from_ts bigint, to_ts bigint")
    each = needs.select(F.size(F.coalesce(covering_bins(F.col("from_ts"), F.col("to_ts")), F.array())).alias("n"))
    assert each.agg(F.max("n")).first()[0] <= 10
    moments = [(k, m * day + 5) for k in (0, 1, 9) for m in (0, 7, 8, 30, 66, 19_740, 40_000)]
    log = spark.createDataFrame(moments, "k int, origin_departure_timestamp bigint")
    met = meet(asked_rows(log, needs, ["k"]), needs, ["k"])
    want = sorted((k, m, a, b) for k, m in moments for j, a, b in ranges if j == k and a <= m <= b)
    assert sorted((r.k, r.origin_departure_timestamp, r.from_ts, r.to_ts) for r in met.collect()) == want
    top = met._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in top


def test_a_load_leaves_neither_its_staged_feed_nor_shuffle_files(spark, tmp_path):
    def shuffle_files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {n for folder in folders for _, _, found in os.walk(folder) for n in found if n.startswith("shuffle_")}

    root, there = str(tmp_path / "root"), shuffle_files()
    lines = [*R.station_lines(), *[R.schedule_line(t) for t in TRAINS], R.schedule_line("J", stops=R.JOINING), R.association_line("T0", "J")]
    load_timetable(spark, root, [R.write_feed(tmp_path / "a.json", lines)], flush=True)
    build_secondary(spark, root)
    load_timetable(spark, root, [R.write_feed(tmp_path / "b.json", [R.schedule_line("T1", op="Delete")])])
    assert names(spark, f"{root}/_staged") == []
    until = time.time() + 20
    while shuffle_files() - there and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files() - there == set()
    assert read_table(spark, root, "schedule").count() == 5 * 39 + 2
