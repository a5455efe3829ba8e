"""One query per operation of the inventory, over the whole given tables.

Arrays are shown as joined strings and counts as bigint, so that results compare by value.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbeam.constants import ACTIVATION_TTL_MS, DAY_COLUMNS, PREFERRED_TIPLOCS
from railbeam.functions.days import day_flags, run_pattern, run_pattern_of_flags
from railbeam.functions.text import blank_to_null, delay_text, difference_text, strict_long
from railbeam.functions.times import minutes_between, utc_date, utc_time, whole_minutes, yesterday_name
from railbeam.operators import associations as assoc
from railbeam.operators import lookups
from railbeam.operators import stations as station_ops
from railbeam.operators.asof import ACTIVATION_FIELDS, latest_activations
from railbeam.operators.fold import fold_stanox
from railbeam.operators.intervals import log_windows
from railbeam.operators.logs import cancellation_log, change_of_origin_log, log_window, movement_log
from railbeam.operators.notices import (
    affected_on_range,
    affected_on_route,
    cancellation_notices,
    change_of_origin_notices,
    is_notifiable,
    movement_notices,
    notice_counts_per_minute,
    watched_stops,
)
from railbeam.operators.stops import stop_codes
from railbeam.plans.enrich import enrich
from railbeam.plans.history import (
    REQUEST,
    cancellation_days,
    display_rows,
    history_header,
    history_requests,
    movement_pairs,
)
from railbeam.plans.load import build_secondary, fold_association, fold_schedule, load_timetable
from railbeam.plans.search import schedule_search, schedule_search_requests
from railbeam.plans.stations import stations
from railbeam.plans.subscriptions import list_response, resolve_requests, subscribe, unsubscribe
from railbeam.schemas import COLUMNS
from railbeam.sources import feed, messages
from railbeam.sources.snapshots import empty_table, read_table
from registry import shapes

Query = Callable[[SparkSession, str], DataFrame]

FROM_STOP, TO_STOP = "00001", "00002"
#: Lines of one gzip file of the feed.
FEED_FILE_LINES = 200_000


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def big(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def millis(column: str) -> Column:
    return F.unix_millis(column).alias(column)


# Timetable feed ---------------------------------------------------------------------------------


def _feed_lines(spark: SparkSession, d: str) -> DataFrame:
    """supplier, orders with lineitem, and order pairs as the lines of one feed."""
    station = shapes.stanox(spark, d).join(
        shapes.table(spark, d, "supplier").select(shapes.padded(F.col("s_suppkey")).alias("id"), "s_suppkey"), "id"
    )
    key = F.col("s_suppkey")
    tiploc = station.select(
        F.concat(F.lit("1-"), "id").alias("seq"),
        F.to_json(
            F.struct(
                F.struct(
                    F.when(key % 7 == 3, "Update")
                    .when(key % 7 == 4, "Delete")
                    .when(key % 19 == 6, "Replace")
                    .otherwise("Create")
                    .alias("transaction_type"),
                    F.when(key % 17 != 9, F.col("tiploc_code")).alias("tiploc_code"),
                    F.col("stanox_code").alias("stanox"),
                    F.col("crs").alias("crs_code"),
                    F.lit("not used").alias("description"),
                    F.col("description").alias("tps_description"),
                ).alias("TiplocV1")
            )
        ).alias("value"),
    )
    r = shapes.timetable_records(spark, d)
    hhmm = lambda c: F.regexp_replace(c, ":", "")
    schedule = r.select(
        F.concat(F.lit("2-"), "seq").alias("seq"),
        F.to_json(
            F.struct(
                F.struct(
                    F.when(F.col("o_orderpriority") == "5-LOW", "Delete")
                    .when(F.col("schedule_train_id").endswith("77"), "Update")
                    .otherwise("Create")
                    .alias("transaction_type"),
                    F.col("schedule_train_id").alias("CIF_train_uid"),
                    F.col("stp_indicator").alias("CIF_stp_indicator"),
                    F.when(F.col("schedule_train_id").endswith("33"), "11111")
                    .otherwise(F.col("days_run"))
                    .alias("schedule_days_runs"),
                    F.col("schedule_start").cast("string").alias("schedule_start_date"),
                    F.col("schedule_end").cast("string").alias("schedule_end_date"),
                    "atoc_code",
                    "train_status",
                    F.struct(
                        F.col("service_code").alias("CIF_train_service_code"),
                        F.col("train_category").alias("CIF_train_category"),
                        F.transform(
                            "locations",
                            lambda x: F.struct(
                                x["location_type"].alias("location_type"),
                                x["tiploc_code"].alias("tiploc_code"),
                                hhmm(x["departure_time"]).alias("public_departure"),
                                hhmm(x["arrival_time"]).alias("public_arrival"),
                            ),
                        ).alias("schedule_location"),
                    ).alias("schedule_segment"),
                ).alias("JsonScheduleV1")
            )
        ).alias("value"),
    )
    a = shapes.associations(spark, d)
    instant = lambda c: F.concat(F.col(c).cast("string"), F.lit("T00:00:00Z"))
    association = a.select(
        F.concat(F.lit("3-"), "id").alias("seq"),
        F.to_json(
            F.struct(
                F.struct(
                    F.when(F.col("o_orderstatus") == "P", "Delete").otherwise("Create").alias("transaction_type"),
                    F.col("main_schedule_train_id").alias("main_train_uid"),
                    F.col("associated_schedule_train_id").alias("assoc_train_uid"),
                    instant("associated_start").alias("assoc_start_date"),
                    instant("associated_end").alias("assoc_end_date"),
                    F.col("days_run").alias("assoc_days"),
                    F.coalesce(F.concat("association_category", F.lit(" ")), F.lit("  ")).alias("category"),
                    "location",
                    F.col("stp_indicator").alias("CIF_stp_indicator"),
                ).alias("JsonAssociationV1")
            )
        ).alias("value"),
    )
    other = shapes.table(spark, d, "nation").select(
        F.concat(F.lit("4-"), shapes.padded(F.col("n_nationkey"))).alias("seq"),
        F.when(F.col("n_nationkey") == 0, '{"JsonTimetableV1":{"owner":"x"}}')
        .when(F.col("n_nationkey") == 1, '{"EOF":true}')
        .when(F.col("n_nationkey") == 2, '{"Other":{}}')
        .otherwise(F.concat(F.lit("not json "), "n_name"))
        .alias("value"),
    )
    return tiploc.unionByName(schedule).unionByName(association).unionByName(other)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return feed.parse_feed(_feed_lines(spark, d))


def feed_kinds(spark: SparkSession, d: str) -> DataFrame:
    return feed.feed_counts(_parsed(spark, d))


def feed_rejected(spark: SparkSession, d: str) -> DataFrame:
    return feed.feed_rejects(_parsed(spark, d)).select("seq", "kind", "reject_reason")


def feed_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return feed.keep_lines(_feed_lines(spark, d), ['"00001"', '"CIF_train_uid":"1"']).select("seq")


def decode_tiplocs(spark: SparkSession, d: str) -> DataFrame:
    return feed.stanox_changes(_parsed(spark, d))


def preferred_tiplocs(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier as one of the preferred stops, a third of them under the tiploc of the next one."""
    key, n = F.col("s_suppkey"), len(PREFERRED_TIPLOCS)
    codes, names = (F.array(*[F.lit(p[k]) for p in PREFERRED_TIPLOCS]) for k in (0, 1))
    stanox = F.when(key % 11 != 5, F.element_at(codes, (key % n + 1).cast("int")))
    tiploc = F.element_at(names, (F.when(key % 3 == 0, key + 1).otherwise(key) % n + 1).cast("int"))
    rows = shapes.table(spark, d, "supplier")
    return rows.select("s_suppkey", feed.is_preferred_tiploc(stanox, tiploc).alias("primary_entry"))


def decode_schedules(spark: SparkSession, d: str) -> DataFrame:
    rows = feed.schedule_changes(_parsed(spark, d))
    stop = lambda x: F.concat_ws(
        "/",
        x["location_type"],
        x["tiploc_code"],
        F.coalesce(x["arrival_time"], F.lit("-")),
        F.coalesce(x["departure_time"], F.lit("-")),
    )
    return rows.withColumn("locations", F.array_join(F.transform("locations", stop), ","))


def decode_associations(spark: SparkSession, d: str) -> DataFrame:
    return feed.association_changes(_parsed(spark, d))


def association_table_rows(spark: SparkSession, d: str) -> DataFrame:
    changes = feed.association_changes(_parsed(spark, d))
    return feed.association_rows(changes.filter(F.col("op") == "Create"))


def days_pattern(spark: SparkSession, d: str) -> DataFrame:
    r = shapes.timetable_records(spark, d).select("seq", "days_run")
    flags = r.select("seq", *day_flags(F.col("days_run")), run_pattern(F.col("days_run")).alias("pattern"))
    return flags.withColumn("pattern_of_flags", run_pattern_of_flags())


def flatten_stops(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.schedule(spark, d)
    return rows.select(
        "id",
        "schedule_train_id",
        "service_code",
        "stp_indicator",
        "atoc_code",
        big("stop_sequence"),
        "stanox_code",
        joined("subsequent_stanox_codes"),
        joined("subsequent_arrival_times"),
        *DAY_COLUMNS,
        "days_run_pattern",
        "schedule_start",
        "schedule_end",
        "location_type",
        "arrival_time",
        "departure_time",
    )


# Stations ---------------------------------------------------------------------------------------


def stanox_main(spark: SparkSession, d: str) -> DataFrame:
    return station_ops.main_records(shapes.stanox(spark, d))


def stanox_main_notices(spark: SparkSession, d: str) -> DataFrame:
    return station_ops.main_records_for_notices(shapes.stanox(spark, d))


def stanox_complete(spark: SparkSession, d: str) -> DataFrame:
    return station_ops.complete_records(shapes.stanox(spark, d))


def stanox_crs(spark: SparkSession, d: str) -> DataFrame:
    return station_ops.crs_by_stanox(shapes.stanox(spark, d))


def stanox_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.stanox(spark, d)
    found = station_ops.by_stanox(rows, FROM_STOP).withColumn("asked", F.lit("stanox"))
    return found.unionByName(station_ops.by_tiploc(rows, "7").withColumn("asked", F.lit("tiploc")))


def tiploc_map(spark: SparkSession, d: str) -> DataFrame:
    return station_ops.tiploc_map(shapes.stanox(spark, d))


def distinct_stops(spark: SparkSession, d: str) -> DataFrame:
    return stop_codes(shapes.schedule(spark, d))


def station_list(spark: SparkSession, d: str) -> DataFrame:
    return stations(shapes.rail_tables(spark, d))


# Search -----------------------------------------------------------------------------------------


def _order_key() -> Column:
    return F.col("o_orderkey")


def schedule_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Trains of every tenth order, the first two stops of every seventh one by id, and every train at one stop."""
    rows, orders = shapes.schedule(spark, d), shapes.table(spark, d, "orders").select("o_orderkey")
    key, train = _order_key(), F.col("o_orderkey").cast("string").alias("schedule_train_id")
    by_train = lookups.schedules_by_train(rows, orders.filter(key % 10 == 1).select(train))
    by_stop = lookups.schedules_by_train(rows, orders.select(train, shapes.code(key % 10).alias("stanox_code")))
    place = F.explode(F.array(F.lit(1), F.lit(2)))
    ids = orders.filter(key % 7 == 1).select(shapes.padded(key).alias("head"), place.alias("place"))
    by_id = lookups.schedules_by_id(rows, ids.select(F.concat_ws("-", "head", shapes.padded(F.col("place"), 10)).alias("id")))
    shown = ["id", "schedule_train_id", "stanox_code", big("stop_sequence")]
    found = [(by_train, "train"), (by_stop, "train and stop"), (by_id, "id")]
    return reduce(DataFrame.unionByName, [r.select(F.lit(asked).alias("asked"), *shown) for r, asked in found])


def search_subscribed(spark: SparkSession, d: str) -> DataFrame:
    """Every subscriber, and some strangers, ask for the subscribers' routes: how many trains they hold of those found."""
    rows = shapes.schedule(spark, d)
    held = shapes.subscribers(spark, d, rows)
    tables = shapes.rail_tables(spark, d, schedule=rows, subscribers=held)
    own = held.select("from_stanox_code", "to_stanox_code", "days_run_pattern", "user_id")
    strange = own.select("from_stanox_code", "to_stanox_code", "days_run_pattern", F.concat(F.lit("x"), "user_id").alias("user_id"))
    asked = own.unionByName(strange.filter(F.col("user_id").endswith("1")))
    return schedule_search_requests(tables, asked, min_days=2, totals=True)


def search_one(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.schedule(spark, d)
    tables = shapes.rail_tables(
        spark, d, schedule=rows, subscribers=shapes.subscribers(spark, d, rows)
    )
    return schedule_search(tables, FROM_STOP, TO_STOP, "Weekdays", user_id="1", min_days=2)


def _with_secondary(spark: SparkSession, d: str):
    """Primary and secondary schedules; a secondary row keeps its associated train's id."""
    rows = shapes.schedule(spark, d)
    stanox = shapes.stanox(spark, d)
    pending = assoc.pending_associations(
        shapes.associations(spark, d).select(*COLUMNS["association"]),
        empty_table(spark, "schedule_secondary"),
    )
    return rows, assoc.secondary_schedule(pending, rows, stanox).filter(F.col("atoc_code").isNotNull())


def search_primary_secondary(spark: SparkSession, d: str) -> DataFrame:
    rows, secondary = _with_secondary(spark, d)
    tables = shapes.rail_tables(spark, d, schedule=rows, schedule_secondary=secondary)
    return schedule_search(tables, FROM_STOP, TO_STOP, "Saturdays", min_days=2)


def search_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.schedule(spark, d)
    held = shapes.subscribers(spark, d, rows)
    tables = shapes.rail_tables(spark, d, schedule=rows, subscribers=held)
    nation = shapes.table(spark, d, "nation")
    asked = nation.select(
        shapes.code(F.col("n_nationkey") % 10).alias("from_stanox_code"),
        shapes.code(F.col("n_nationkey") % 7).alias("to_stanox_code"),
        F.when(F.col("n_nationkey") % 2 == 0, "Weekdays").otherwise("Sundays").alias("days_run_pattern"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey").cast("string")).alias("user_id"),
    )
    return schedule_search_requests(tables, asked, min_days=2)


# Associations -----------------------------------------------------------------------------------


def _association_rows(spark: SparkSession, d: str) -> DataFrame:
    return shapes.associations(spark, d).select(*COLUMNS["association"])


def pending(spark: SparkSession, d: str) -> DataFrame:
    """Associations of finished (F) orders count as built already."""
    rows = shapes.associations(spark, d)
    built = rows.filter(F.col("o_orderstatus") == "F").select(F.col("id").alias("association_id"))
    return assoc.pending_associations(_association_rows(spark, d), built).select(
        "id", "main_schedule_train_id", "associated_schedule_train_id", "association_category"
    )


def association_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every association by its own five-part key; every third is asked for with another start."""
    rows = _association_rows(spark, d)
    other = F.col("main_schedule_train_id").cast("bigint") % 3 == 0
    asked = rows.withColumn("associated_start", F.when(other, F.date_add("associated_start", 1)).otherwise(F.col("associated_start")))
    return lookups.associations_by_key(rows, asked).select("id")


def association_match(spark: SparkSession, d: str) -> DataFrame:
    return assoc.association_legs(_association_rows(spark, d), shapes.schedule(spark, d)).select(
        "association_id", "leg", "schedule_train_id", "schedule_start"
    )


def _stitched(spark: SparkSession, d: str, category: str) -> DataFrame:
    wanted = _association_rows(spark, d).filter(F.col("association_category") == category)
    rows = assoc.secondary_schedule(wanted, shapes.schedule(spark, d), shapes.stanox(spark, d))
    return rows.select(
        "id",
        "association_id",
        "schedule_train_id",
        "service_code",
        "stp_indicator",
        "atoc_code",
        big("stop_sequence"),
        "stanox_code",
        joined("subsequent_stanox_codes"),
        joined("subsequent_arrival_times"),
        "days_run_pattern",
        "schedule_start",
        "schedule_end",
        "arrival_time",
        "departure_time",
    )


def join_stitch(spark: SparkSession, d: str) -> DataFrame:
    return _stitched(spark, d, "JJ")


def divide_stitch(spark: SparkSession, d: str) -> DataFrame:
    return _stitched(spark, d, "VV")


# Movement feed ----------------------------------------------------------------------------------


def decode_props(spark: SparkSession, d: str) -> DataFrame:
    events = shapes.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    blank = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(k)
    return events.select(
        "event_id",
        strict_long(k).alias("k"),
        strict_long(blank_to_null(blank)).alias("k_or_null"),
        strict_long(F.concat(k, F.lit("x"))).alias("not_a_number"),
    )


def _exploded(spark: SparkSession, d: str) -> DataFrame:
    return messages.explode_messages(messages.parse_messages(shapes.messages(spark, d)))


def decode_messages(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spark, d).withColumn("pos", big("pos"))


def message_rejected(spark: SparkSession, d: str) -> DataFrame:
    parsed = messages.parse_messages(shapes.messages(spark, d))
    return messages.message_rejects(parsed).select("seq", "reject_reason")


def landed_messages(spark: SparkSession, d: str) -> DataFrame:
    """What one parse lands for the stream's queries: every accepted record and every refused message."""
    landed = messages.landed_records(messages.parse_messages(shapes.messages(spark, d)))
    return landed.select("seq", big("pos"), "msg_type", "train_id", "reject_reason")


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return messages.route_counts(_exploded(spark, d))


def unhandled_records(spark: SparkSession, d: str) -> DataFrame:
    return messages.unhandled(_exploded(spark, d)).select("seq", big("pos"), "msg_type")


def route_counts_per_minute(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.records(spark, d)
    counts = messages.route_counts_per_minute(rows, F.timestamp_millis("arrival_ms"))
    return counts.select(millis("minute"), "msg_type", "records")


def utc_parts(spark: SparkSession, d: str) -> DataFrame:
    r = shapes.records(spark, d)
    actual, planned = F.col("arrival_ms"), F.col("planned_passenger_timestamp")
    day = utc_date(actual)
    return r.select(
        "seq",
        day.alias("day"),
        utc_time(actual).alias("time"),
        (actual - planned).alias("difference"),
        whole_minutes(actual - planned).alias("minutes"),
        minutes_between(F.lit("12:00"), utc_time(actual)).alias("from_noon"),
        yesterday_name(day).alias("yesterday"),
    )


def _activations(spark: SparkSession, d: str) -> DataFrame:
    return messages.records_of(shapes.records(spark, d), "0001")


def activation_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_activations(_activations(spark, d)).select("train_id", "seq", *ACTIVATION_FIELDS)


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich(shapes.records(spark, d), ACTIVATION_TTL_MS)


def activation_asof(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d).select("seq", "msg_type", "train_id", *ACTIVATION_FIELDS)


def _log_id() -> Column:
    return shapes.padded(F.col("seq"))


def _movements(spark: SparkSession, d: str, enriched: DataFrame | None = None) -> DataFrame:
    enriched = _enriched(spark, d) if enriched is None else enriched
    return movement_log(messages.records_of(enriched, "0003"), _log_id())


def _cancellations(spark: SparkSession, d: str, enriched: DataFrame | None = None) -> DataFrame:
    enriched = _enriched(spark, d) if enriched is None else enriched
    return cancellation_log(messages.records_of(enriched, "0002"), _log_id())


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return change_of_origin_log(messages.records_of(_enriched(spark, d), "0006"), _log_id())


# A fixed window inside the month that the events cover.
WINDOW = (1704844800000, 1705881600000)


def _spread(users: DataFrame) -> DataFrame:
    """Users over all cores, since each stands for many requests; a list of users alone would be one task."""
    return users.repartition(users.sparkSession.sparkContext.defaultParallelism)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Two requests for every user's train: a range that begins later for each, and one that is open at one end."""
    users = _spread(shapes.table(spark, d, "events").select(F.col("user_id").alias("u")).distinct())
    start = F.lit(WINDOW[0]) + F.col("u") * 3600000
    closed = F.struct(start.alias("from_ts"), F.lit(WINDOW[1]).alias("to_ts"), F.lit("closed").alias("asked"))
    opened = F.struct(F.lit(None).cast("bigint").alias("from_ts"), start.alias("to_ts"), F.lit("open").alias("asked"))
    return users.select(F.col("u").cast("string").alias("schedule_train_id"), F.inline(F.array(closed, opened)))


def movement_history(spark: SparkSession, d: str) -> DataFrame:
    stop = F.explode(F.array(*[F.lit(f"{k:05d}") for k in (1, 2, 3)])).alias("stanox_code")
    asked = _windows(spark, d).select("*", stop)
    found = log_windows(_movements(spark, d), asked, ["schedule_train_id", "stanox_code"])
    return found.select("asked", "id", "stanox_code")


def cancel_history(spark: SparkSession, d: str) -> DataFrame:
    return log_windows(_cancellations(spark, d), _windows(spark, d), ["schedule_train_id"]).select("asked", "id", "stanox_code")


def origin_history(spark: SparkSession, d: str) -> DataFrame:
    return log_windows(_origins(spark, d), _windows(spark, d), ["schedule_train_id"]).select("asked", "id", "new_stanox_code")


def one_train_history(spark: SparkSession, d: str) -> DataFrame:
    """F4-F6 for one train, as one request is answered."""
    rows = log_window(_movements(spark, d), "7", None, *WINDOW).select("id", "stanox_code")
    others = log_window(_cancellations(spark, d), "7", None, *WINDOW).select("id", "stanox_code")
    return rows.unionByName(others)


def delay_texts(spark: SparkSession, d: str) -> DataFrame:
    """X9 for every logged movement, and X10 for its whole minutes of delay."""
    text = delay_text(F.col("variation_status"), F.col("planned_passenger_timestamp"), F.col("actual_timestamp"))
    minutes = whole_minutes(F.col("difference"))
    return _movements(spark, d).select("id", text.alias("delay_text"), difference_text(minutes).alias("difference_text"))


# History ----------------------------------------------------------------------------------------


def _first_to_last(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return shapes.subscribers(spark, d, rows).select(
        "schedule_train_id", "from_stanox_code", "to_stanox_code"
    )


def header(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.schedule(spark, d)
    return history_header(shapes.rail_tables(spark, d, schedule=rows), _first_to_last(spark, d, rows))


def _fixed_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every user's train between any two of ten stops, with planned times of noon and one o'clock; the range
    begins earlier for stops with a higher number."""
    users = shapes.table(spark, d, "events").select(F.col("user_id").cast("string").alias("schedule_train_id"))
    codes = F.array(*[F.lit(k) for k in range(10)])
    routes = _spread(users.distinct()).select("schedule_train_id", F.explode(codes).alias("f")).select("*", F.explode(codes).alias("t"))
    return routes.filter("f <> t").select(
        "schedule_train_id",
        shapes.code(F.col("f")).alias("from_stanox_code"),
        shapes.code(F.col("t")).alias("to_stanox_code"),
        (F.lit(WINDOW[0]) - F.col("f") * 86400000).alias("from_ts"),
        (F.lit(WINDOW[1]) + F.col("t") * 3600000).alias("to_ts"),
        F.lit("12:00").alias("expected_departure_time"),
        F.lit("13:00").alias("expected_arrival_time"),
    )


def history_pairs(spark: SparkSession, d: str) -> DataFrame:
    asked = _fixed_requests(spark, d)
    return movement_pairs(_movements(spark, d), asked, asked).drop("from_ts", "to_ts")


def history_cancel(spark: SparkSession, d: str) -> DataFrame:
    asked = _fixed_requests(spark, d)
    return cancellation_days(_cancellations(spark, d), asked, asked).drop("from_ts", "to_ts")


def history_display(spark: SparkSession, d: str) -> DataFrame:
    asked = _fixed_requests(spark, d)
    return display_rows(
        movement_pairs(_movements(spark, d), asked, asked), cancellation_days(_cancellations(spark, d), asked, asked)
    ).drop("from_ts", "to_ts")


def history_batch(spark: SparkSession, d: str) -> DataFrame:
    """The joined form: header, pairs and cancelled days of every subscriber's own route.

    Both logs are of the same enriched records, which Spark then moves and matches once.
    """
    rows, enriched = shapes.schedule(spark, d), _enriched(spark, d)
    tables = shapes.rail_tables(
        spark,
        d,
        schedule=rows,
        movement_log=_movements(spark, d, enriched),
        cancellation_log=_cancellations(spark, d, enriched),
    )
    none = F.lit(None).cast("bigint")
    asked = _first_to_last(spark, d, rows).withColumn("from_ts", none).withColumn("to_ts", none)
    found = history_requests(tables, asked)
    return display_rows(found.movements, found.cancellations).drop("from_ts", "to_ts")


# Notices ----------------------------------------------------------------------------------------


def notifiable(spark: SparkSession, d: str) -> DataFrame:
    rows = _movements(spark, d).filter(is_notifiable())
    text = delay_text(
        F.col("variation_status"), F.col("planned_passenger_timestamp"), F.col("actual_timestamp")
    )
    return rows.select("id", "schedule_train_id", "variation_status", "difference", text.alias("delay_text"))


def _every_stop(rows: DataFrame) -> DataFrame:
    """Every stop of each train, as if it were reported late."""
    return rows.select(F.col("id").alias("log_id"), "schedule_train_id", "service_code", "stanox_code")


def route_subscribers(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.schedule(spark, d)
    logs = _every_stop(rows).select("log_id", "schedule_train_id", "service_code")
    return affected_on_route(logs, shapes.subscribers(spark, d, rows)).select("log_id", "subscriber_id")


def range_subscribers(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.schedule(spark, d)
    none = empty_table(spark, "schedule_secondary")
    affected = affected_on_range(_every_stop(rows), shapes.subscribers(spark, d, rows), rows, none)
    return affected.select("log_id", "subscriber_id")


def subscriber_stops(spark: SparkSession, d: str) -> DataFrame:
    rows, secondary = _with_secondary(spark, d)
    watch = watched_stops(shapes.subscribers(spark, d, rows), rows, secondary)
    return watch.select(F.col("subscriber_id").alias("id"), "stanox_code")


def subscriber_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By train and service (half of them the wrong one), by user, by user and id, and by id."""
    rows, orders = shapes.subscribers(spark, d), shapes.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    key = _order_key()
    service = F.when(key % 2 == 0, F.concat(F.lit("S"), (key % 5).cast("string"))).otherwise(F.lit("S9"))
    user, record = F.col("o_custkey").cast("string").alias("user_id"), shapes.padded(key).alias("id")
    found = {
        "train": lookups.subscribers_by_train(rows, orders.select(key.cast("string").alias("schedule_train_id"), service.alias("service_code"))),
        "user": lookups.subscribers_by_user(rows, orders.filter(F.col("o_custkey") % 2 == 0).select(user)),
        "user and id": lookups.subscribers_by_user(rows, orders.select(user, shapes.padded(key + key % 3).alias("id"))),
        "id": lookups.subscribers_by_id(rows, orders.filter(key % 7 == 1).select(record)),
    }
    return reduce(DataFrame.unionByName, [r.select(F.lit(asked).alias("asked"), "id", "user_id") for asked, r in found.items()])


def notifications(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.schedule(spark, d)
    none = empty_table(spark, "schedule_secondary")
    return movement_notices(
        _movements(spark, d), shapes.subscribers(spark, d, rows), rows, none, shapes.stanox(spark, d)
    )


def _cancel_notices(spark: SparkSession, d: str) -> DataFrame:
    return cancellation_notices(
        _cancellations(spark, d), shapes.subscribers(spark, d), shapes.stanox(spark, d)
    )


def _origin_notices(spark: SparkSession, d: str) -> DataFrame:
    return change_of_origin_notices(
        _origins(spark, d), shapes.subscribers(spark, d), shapes.stanox(spark, d)
    )


def notice_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = notice_counts_per_minute(_cancel_notices(spark, d))
    return counts.select(millis("minute"), "kind", "notices")


# Table changes ----------------------------------------------------------------------------------


def feed_fold_stanox(spark: SparkSession, d: str) -> DataFrame:
    """Stations stored from supplier, changed by events in their order."""
    stored = shapes.stanox(spark, d).withColumn("stanox_code", F.lit("00003"))
    events = shapes.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.col("event_id")
    op = (
        F.when(F.col("event_type") == "signup", "Create")
        .when(F.col("event_type") == "purchase", "Update")
        .when(F.col("event_type") == "error", "Delete")
        .when(F.col("event_type") == "click", "Create")
        .otherwise("Update")
    )
    changes = events.select(
        F.concat(F.lit("e"), shapes.padded(event)).alias("seq"),
        op.alias("op"),
        F.col("user_id").cast("string").alias("tiploc_code"),
        F.when(k % 10 != 9, shapes.code(k % 4)).alias("stanox_code"),
        F.concat(F.lit("C"), (event % 100).cast("string")).alias("crs"),
        F.concat(F.lit("event "), event.cast("string")).alias("description"),
        (k % 2 == 0).alias("primary_entry"),
    )
    return fold_stanox(stored.select(*COLUMNS["stanox"]), changes)


def feed_fold_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Every order is created; some were stored, deleted before or after, or come twice."""
    r = shapes.timetable_records(spark, d)
    priority = F.col("o_orderpriority")

    def change(op: str, mark: str, category: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(op).alias("op"), F.lit(mark).alias("mark"), F.lit(category).alias("c")))

    every = F.array_compact(
        F.array(
            change("Create", "", "OO", F.lit(True)),
            change("Create", "z", "AGAIN", priority == "3-MEDIUM"),
            change("Delete", "y", "OO", priority == "1-URGENT"),
            change("Delete", "!", "OO", priority == "2-HIGH"),
        )
    )
    changes = (
        r.select("*", F.inline(every))
        .withColumn("seq", F.concat("mark", "seq"))
        .withColumn("train_category", F.col("c"))
        .drop("mark", "c")
    )
    stanox = shapes.stanox(spark, d)
    stored = shapes.schedule(spark, d).filter(F.col("days_run_pattern") == "Weekdays")
    stored = stored.withColumn("train_category", F.lit("STORED")).withColumn("id", F.concat(F.lit("#"), "id"))
    folded = fold_schedule(stored, changes, stanox)
    return folded.select("id", "schedule_train_id", "train_category", big("stop_sequence"), "stanox_code")


def feed_fold_association(spark: SparkSession, d: str) -> DataFrame:
    """Associations of O orders are stored; all are created again, VV ones are deleted at the end."""
    a = shapes.associations(spark, d)
    create = a.withColumn("seq", F.col("id")).withColumn("op", F.lit("Create"))
    gone = create.filter(F.col("association_category") == "VV").withColumn("op", F.lit("Delete"))
    gone = gone.withColumn("seq", F.concat(F.lit("z"), "seq"))
    stored = a.filter(F.col("o_orderstatus") == "O").withColumn("id", F.concat(F.lit("#"), "id"))
    folded, _ = fold_association(
        stored.select(*COLUMNS["association"]), create.unionByName(gone)
    )
    return folded.select("id", "main_schedule_train_id", "association_category", "days_run_pattern")


def _round_trip(spark: SparkSession, d: str) -> str:
    """The whole write path: the feed's lines as files, a full load, the combined trains, an update in two files.

    The update deletes every fourth train and the associations of these, and creates every eighth anew. The files are
    gzip, as the feed is published, and of a bounded number of lines, since one is read by one task.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="railbeam-round-trip-")
    root = f"{shared}/railbeam/round-trip-{uuid.uuid4().hex}"

    def publish_feed(lines: DataFrame, name: str) -> None:
        lines.select("value").write.option("maxRecordsPerFile", FEED_FILE_LINES).text(f"{root}/feed/{name}", compression="gzip")

    publish_feed(_feed_lines(spark, d), "full")
    lines = spark.read.text(f"{root}/feed/full")
    uid = F.coalesce(
        F.get_json_object("value", "$.JsonScheduleV1.CIF_train_uid"), F.get_json_object("value", "$.JsonAssociationV1.main_train_uid")
    ).cast("bigint")
    create = '"transaction_type":"Create"'
    created = lines.filter(F.col("value").contains(create))
    deletes = created.filter(uid % 4 == 0).select(F.replace("value", F.lit(create), F.lit(create.replace("Create", "Delete"))).alias("value"))
    again = created.filter((uid % 8 == 0) & F.col("value").startswith('{"JsonScheduleV1"'))
    again = again.select(F.replace("value", F.lit('"CIF_train_category":"OO"'), F.lit('"CIF_train_category":"NEW"')).alias("value"))
    publish_feed(deletes, "deletes")
    publish_feed(again, "again")
    load_timetable(spark, root, [f"{root}/feed/full"], flush=True)
    build_secondary(spark, root)
    load_timetable(spark, root, [f"{root}/feed/deletes", f"{root}/feed/again"])
    return root


def load_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, _round_trip(spark, d), "schedule")
    later = F.size("subsequent_stanox_codes").cast("bigint").alias("later_stops")
    return rows.select("schedule_train_id", "train_category", big("stop_sequence"), "stanox_code", later)


def load_combined(spark: SparkSession, d: str) -> DataFrame:
    """Associations that are left, with the stops of their combined trains; those of deleted ones went with them."""
    root = _round_trip(spark, d)
    kept = read_table(spark, root, "association").select(F.col("id").alias("association_id"), "main_schedule_train_id", "association_category")
    stops = read_table(spark, root, "schedule_secondary").select(
        "association_id", "schedule_train_id", big("stop_sequence"), "stanox_code"
    )
    return kept.join(stops, "association_id", "full").drop("association_id")


def _subscribe_requests(spark: SparkSession, d: str) -> DataFrame:
    """Each order asks for its first schedule row twice; some name a row that does not exist."""
    held = shapes.subscribers(spark, d)
    first = held.drop("service_code", "schedule_train_id").withColumn("record_type", F.lit("Primary"))
    missing = F.col("id").endswith("3")
    named = first.withColumn(
        "record_id", F.concat(F.col("id"), F.when(missing, F.lit("-0000099999")).otherwise(F.lit("-0000000001")))
    )
    twice = F.array(
        F.struct(F.lit("a").alias("mark"), F.col("email").alias("sent")),
        F.struct(F.lit("b").alias("mark"), F.lit("later").alias("sent")),
    )
    asked = named.select("*", F.inline(twice)).withColumn("seq", F.concat("mark", "id"))
    return asked.withColumn("email", F.col("sent")).drop("id", "mark", "sent")


def _subscribe(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = shapes.schedule(spark, d)
    held = shapes.subscribers(spark, d, rows)
    held = held.filter(F.col("days_run_pattern") == "Sundays")
    tables = shapes.rail_tables(spark, d, schedule=rows, subscribers=held)
    return subscribe(tables, _subscribe_requests(spark, d))


def subscribe_dedupe(spark: SparkSession, d: str) -> DataFrame:
    added, _ = _subscribe(spark, d)
    return added.select("id", "user_id", "email", "schedule_train_id", "service_code", "from_stanox_code", "to_stanox_code")


def subscribe_refused(spark: SparkSession, d: str) -> DataFrame:
    _, refused = _subscribe(spark, d)
    return refused


def _delete_requests(spark: SparkSession, d: str) -> DataFrame:
    """Customers delete their urgent orders' subscriptions, and try others' low ones."""
    orders = shapes.table(spark, d, "orders")
    own = orders.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")
    others = orders.filter(F.col("o_orderpriority") == "5-LOW").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey")
    )
    return own.unionByName(others).select(
        F.col("o_custkey").cast("string").alias("user_id"), shapes.padded(F.col("o_orderkey")).alias("id")
    )


def unsubscribe_remaining(spark: SparkSession, d: str) -> DataFrame:
    remaining, _ = unsubscribe(shapes.subscribers(spark, d), _delete_requests(spark, d))
    return remaining.select("id", "user_id")


def unsubscribe_refused(spark: SparkSession, d: str) -> DataFrame:
    _, refused = unsubscribe(shapes.subscribers(spark, d), _delete_requests(spark, d))
    return refused


def subscription_list(spark: SparkSession, d: str) -> DataFrame:
    return list_response(shapes.subscribers(spark, d))


QUERIES: dict[str, Query] = {
    "decode_props": decode_props,
    "feed_kinds": feed_kinds,
    "feed_rejects": feed_rejected,
    "feed_prefilter": feed_prefilter,
    "decode_tiplocs": decode_tiplocs,
    "decode_schedules": decode_schedules,
    "decode_associations": decode_associations,
    "association_rows": association_table_rows,
    "days_pattern": days_pattern,
    "flatten_stops": flatten_stops,
    "stanox_main": stanox_main,
    "stanox_main_notices": stanox_main_notices,
    "stanox_complete": stanox_complete,
    "stanox_crs": stanox_crs,
    "stanox_lookup": stanox_lookup,
    "tiploc_map": tiploc_map,
    "distinct_stops": distinct_stops,
    "stations": station_list,
    "schedule_lookup": schedule_lookup,
    "schedule_search": search_one,
    "search_subscribed": search_subscribed,
    "search_primary_secondary": search_primary_secondary,
    "schedule_search_requests": search_requests,
    "pending_associations": pending,
    "association_lookup": association_lookup,
    "association_match": association_match,
    "join_stitch": join_stitch,
    "divide_stitch": divide_stitch,
    "decode_messages": decode_messages,
    "landed_messages": landed_messages,
    "message_rejects": message_rejected,
    "route_counts": route_counts,
    "unhandled_records": unhandled_records,
    "route_counts_per_minute": route_counts_per_minute,
    "utc_parts": utc_parts,
    "activation_latest": activation_latest,
    "activation_asof": activation_asof,
    "movement_log": _movements,
    "cancel_log": _cancellations,
    "origin_log": _origins,
    "movement_history": movement_history,
    "cancel_history": cancel_history,
    "origin_history": origin_history,
    "one_train_history": one_train_history,
    "delay_texts": delay_texts,
    "history_header": header,
    "history_pairs": history_pairs,
    "history_cancel": history_cancel,
    "history_display": history_display,
    "history_batch": history_batch,
    "notifiable": notifiable,
    "route_subscribers": route_subscribers,
    "range_subscribers": range_subscribers,
    "watched_stops": subscriber_stops,
    "subscriber_lookup": subscriber_lookup,
    "notifications": notifications,
    "cancel_notifications": _cancel_notices,
    "origin_notifications": _origin_notices,
    "notice_counts": notice_counts,
    "preferred_tiplocs": preferred_tiplocs,
    "load_schedule": load_schedule,
    "load_combined": load_combined,
    "feed_fold_stanox": feed_fold_stanox,
    "feed_fold_schedule": feed_fold_schedule,
    "feed_fold_association": feed_fold_association,
    "subscribe_dedupe": subscribe_dedupe,
    "subscribe_refused": subscribe_refused,
    "unsubscribe_remaining": unsubscribe_remaining,
    "unsubscribe_refused": unsubscribe_refused,
    "subscriptions": subscription_list,
}
