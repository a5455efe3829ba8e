"""The stream gives what the batch gives on the same input."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from railbeam.constants import MSG_ACTIVATION, MSG_MOVEMENT
from railbeam.plans.enrich import enrich, logs
from railbeam.plans.load import load_timetable, store_subscribers
from railbeam.sources.messages import accepted_records, explode_messages, landed_records, message_rejects, parse_messages, read_messages, stream_messages
from railbeam.sources.snapshots import read_table
from railbeam.streaming.activation_state import activation_state
from railbeam.streaming.listener import run_message_counts, run_message_rejects, run_movement_stream, run_parse_stream, stream_records
from tests import rows as R

ONCE = {"availableNow": True}
DAY = 24 * 3600 * 1000


def _land(folder, name, messages, mtime):
    path = folder / name
    path.write_text("\n".join(json.dumps(m) if isinstance(m, list) else m for m in messages), encoding="utf-8")
    os.utime(path, (mtime, mtime))


def _setup(spark, tmp_path):
    root = str(tmp_path / "root")
    lines = [*R.station_lines(), R.schedule_line("G123456", service="23456")]
    load_timetable(spark, root, [R.write_feed(tmp_path / "feed.json", lines)])
    held = spark.createDataFrame(
        [("1", "u1", "u1@example.org", "G123456", "23456", R.CODE["REIGATE"], R.CODE["EASTCRYD"])],
        "id string, user_id string, email string, schedule_train_id string, service_code string, "
        "from_stanox_code string, to_stanox_code string",
    )
    missing = [c for c in read_table(spark, root, "subscribers").columns if c not in held.columns]
    kinds = dict(read_table(spark, root, "subscribers").dtypes)
    for c in missing:
        held = held.withColumn(c, F.lit(None).cast(kinds[c]))
    store_subscribers(spark, root, held)
    landing = tmp_path / "landing"
    landing.mkdir()
    return root, landing


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    root, landing = _setup(spark, tmp_path)
    early = [R.movement(stanox=R.CODE["REIGATE"], event="DEPARTURE")]
    first = [[*early], [R.activation()], [R.movement(), R.cancellation()], "not json"]
    second = [
        [R.change_of_origin(), R.activation(departs=1514749500000)],
        [R.movement(stanox=R.CODE["MERSTHAM"]), R.movement(train_id="other")],
        [R.cancellation(kind="MAYBE"), R.movement()],
    ]
    _land(landing, "a.txt", first, 1514664000)
    _land(landing, "b.txt", second, 1514664300)
    source = stream_messages(spark, str(landing), max_files=1)
    query = run_movement_stream(
        spark, root, source, str(tmp_path / "ckpt"), ttl_ms=DAY, salts=3, trigger=ONCE
    )
    query.awaitTermination()
    assert query.exception() is None

    exploded = explode_messages(parse_messages(read_messages(spark, str(landing))))
    want = logs(exploded, ttl_ms=DAY, salts=4)
    assert _rows(read_table(spark, root, "movement_log")) == _rows(want.movements)
    assert _rows(read_table(spark, root, "cancellation_log")) == _rows(want.cancellations)
    assert _rows(read_table(spark, root, "change_of_origin_log")) == _rows(want.changes_of_origin)
    assert read_table(spark, root, "movement_log").count() == 2

    notices = spark.read.parquet(f"{root}/notifications")
    # Both late movements are on the way, the cancellation and the change reach everyone.
    assert sorted(r.kind for r in notices.collect()) == [
        "cancellation", "change_of_origin", "movement", "movement",
    ]

    counts = run_message_counts(spark, root, source, str(tmp_path / "ckpt2"), trigger=ONCE)
    counts.awaitTermination()
    rejects = run_message_rejects(spark, root, source, str(tmp_path / "ckpt3"), trigger=ONCE)
    rejects.awaitTermination()
    reasons = [r.reject_reason for r in spark.read.parquet(f"{root}/message_rejects").collect()]
    assert sorted(reasons) == ["bad_element", "not_an_array"]


def test_restarted_stream_continues_and_writes_nothing_twice(spark, tmp_path):
    root, landing = _setup(spark, tmp_path)
    source = stream_messages(spark, str(landing))
    checkpoint = str(tmp_path / "ckpt")
    _land(landing, "a.txt", [[R.activation()]], 1514664000)
    run_movement_stream(spark, root, source, checkpoint, ttl_ms=DAY, trigger=ONCE).awaitTermination()
    assert read_table(spark, root, "movement_log").count() == 0
    _land(landing, "b.txt", [[R.movement()]], 1514664100)
    run_movement_stream(spark, root, source, checkpoint, ttl_ms=DAY, trigger=ONCE).awaitTermination()
    run_movement_stream(spark, root, source, checkpoint, ttl_ms=DAY, trigger=ONCE).awaitTermination()
    found = read_table(spark, root, "movement_log").collect()
    assert [(r.train_id, r.schedule_train_id, r.difference) for r in found] == [
        ("12345", "G123456", 960000)
    ]


def test_expired_activation_in_stream_is_not_used(spark, tmp_path):
    root, landing = _setup(spark, tmp_path)
    source = stream_messages(spark, str(landing), max_files=1)
    _land(landing, "a.txt", [[R.activation()]], 1514664000)
    _land(landing, "b.txt", [[R.movement()]], 1514664000 + 6)
    run_movement_stream(
        spark, root, source, str(tmp_path / "ckpt"), ttl_ms=5000, trigger=ONCE
    ).awaitTermination()
    assert read_table(spark, root, "movement_log").count() == 0
    exploded = explode_messages(parse_messages(read_messages(spark, str(landing))))
    assert enrich(exploded, ttl_ms=5000).count() == 0
    assert enrich(exploded, ttl_ms=6000).count() == 1


def test_a_second_checkpoint_replaces_no_log(spark, tmp_path):
    root, landing = _setup(spark, tmp_path)
    source = stream_messages(spark, str(landing))
    _land(landing, "a.txt", [[R.activation()], [R.movement()]], 1514664000)
    run_movement_stream(spark, root, source, str(tmp_path / "one"), ttl_ms=DAY, trigger=ONCE).awaitTermination()
    (landing / "a.txt").unlink()
    _land(landing, "b.txt", [[R.activation()], [R.movement(stanox=R.CODE["MERSTHAM"])]], 1514664100)
    run_movement_stream(spark, root, source, str(tmp_path / "two"), ttl_ms=DAY, trigger=ONCE).awaitTermination()
    assert read_table(spark, root, "movement_log").count() == 2


def test_messages_are_parsed_once_and_read_by_all_queries(spark, tmp_path):
    root, landing = _setup(spark, tmp_path)
    source, to = stream_messages(spark, str(landing), max_files=1), {"trigger": ONCE}
    _land(landing, "a.txt", [[R.movement(stanox=R.CODE["REIGATE"], event="DEPARTURE")], [R.activation()], "not json", []], 1514664000)
    _land(landing, "b.txt", [[R.movement(), R.cancellation()], [R.cancellation(kind="MAYBE"), R.movement()]], 1514664030)
    run_parse_stream(spark, root, source, str(tmp_path / "parse"), **to).awaitTermination()
    run_movement_stream(spark, root, stream_records(spark, root), str(tmp_path / "logs"), ttl_ms=DAY, **to).awaitTermination()
    _land(landing, "c.txt", [[R.change_of_origin(), R.movement(stanox=R.CODE["MERSTHAM"])]], 1514664300)
    for _ in range(2):  # the second time finds nothing new
        run_parse_stream(spark, root, source, str(tmp_path / "parse"), **to).awaitTermination()
        run_movement_stream(spark, root, stream_records(spark, root), str(tmp_path / "logs"), ttl_ms=DAY, **to).awaitTermination()
        run_message_counts(spark, root, stream_records(spark, root), str(tmp_path / "counts"), lateness="0 seconds", **to).awaitTermination()
        run_message_rejects(spark, root, stream_records(spark, root), str(tmp_path / "rejects"), **to).awaitTermination()

    raw = read_messages(spark, str(landing))
    want = logs(explode_messages(parse_messages(raw)), ttl_ms=DAY)
    for table, rows in (("movement_log", want.movements), ("cancellation_log", want.cancellations), ("change_of_origin_log", want.changes_of_origin)):
        assert _rows(read_table(spark, root, table)) == _rows(rows) != []
    assert _rows(spark.read.parquet(f"{root}/message_rejects")) == _rows(message_rejects(parse_messages(raw)))
    assert spark.read.parquet(f"{root}/message_records").count() == 4 + 2 + 2  # four records and two of c.txt, two refusals


def test_landed_records_hold_what_parsing_gives(spark):
    texts = ["[]", "{", None, [R.activation(), R.movement()], [R.cancellation(kind="MAYBE")]]
    raw = R.message_frame(spark, [(1514664000000 + i, t) for i, t in enumerate(texts)])
    parsed = parse_messages(raw)
    landed = landed_records(parsed)
    assert _rows(accepted_records(landed)) == _rows(accepted_records(raw)) == _rows(explode_messages(parsed))
    assert accepted_records(raw).count() == 2
    assert _rows(message_rejects(landed)) == _rows(message_rejects(parsed)) and message_rejects(landed).count() == 3
    assert landed.count() == 5


class _Held:
    """A state value without a store."""

    value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_keyed_state_equals_a_loop_over_records():
    columns = ["arrival_ms", "seq", "pos", "msg_type", "schedule_train_id", "origin_stanox_code", "origin_departure_timestamp"]
    rng = np.random.default_rng(1)
    for _ in range(60):
        held, latest = _Held(), None
        state = activation_state(25, columns)
        state.init(held)
        for batch in range(3):
            rows = []
            for k in range(int(rng.integers(1, 9))):
                put = rng.random() < 0.3
                own = (f"a{batch}{k}", "o", str(10**12 + k)) if put else (None, None, None)
                rows.append((int(rng.integers(0, 60)) + 30 * batch, f"s{rng.integers(0, 3)}", k, MSG_ACTIVATION if put else MSG_MOVEMENT, *own))
            want = []
            for row in sorted(rows, key=lambda r: r[:3]):
                if row[3] == MSG_ACTIVATION:
                    latest = (row[0], *row[4:6], int(row[6]))
                elif latest is not None and row[0] - latest[0] <= 25:
                    want.append((*row[:4], *latest[1:3], str(latest[3])))
            frames = [pd.DataFrame(part, columns=columns) for part in (rows[::2], rows[1::2])]
            got = [tuple(r) for out in state.handleInputRows(("t", 0), iter(frames), None) for r in out.itertuples(index=False)]
            assert got == want and held.value == latest
