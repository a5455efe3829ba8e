"""Rail-shaped tables derived from the given tables.

The given tables are not rail data, so each mapping below says what plays which part. All rows of a
table are used; a remainder in a CASE only varies a value, it never leaves rows out.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbeam.functions.days import day_flags, run_pattern
from railbeam.operators.stations import tiploc_map
from railbeam.operators.stops import schedule_rows
from railbeam.schemas import COLUMNS
from railbeam.session import apply_settings
from railbeam.sources.snapshots import RailTables, empty_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def code(value: Column) -> Column:
    """A five-digit stanox-like code."""
    return F.lpad(value.cast("string"), 5, "0")


def padded(value: Column, width: int = 12) -> Column:
    """A number as text that sorts like the number."""
    return F.lpad(value.cast("string"), width, "0")


def _text(value: Column) -> Column:
    return value.cast("string")


def _hhmm(minute: Column) -> Column:
    day = F.pmod(minute, F.lit(1440))
    return F.concat(
        F.lpad(_text(F.floor(day / 60)), 2, "0"), F.lit(":"), F.lpad(_text(day % 60), 2, "0")
    )


def stanox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier and nation as stations: many tiplocs (suppliers) per stanox."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    rows = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    stanox_code = F.when(key % 13 != 5, code(F.col("s_nationkey") % 10))
    return rows.select(
        padded(key).alias("id"),
        _text(key).alias("tiploc_code"),
        stanox_code.alias("stanox_code"),
        F.when(
            F.col("s_acctbal") >= 0,
            F.concat(F.substring("n_name", 1, 1), F.lpad(_text(F.col("n_nationkey")), 2, "0")),
        ).alias("crs"),
        F.col("s_name").alias("description"),
        F.when(stanox_code.isNotNull(), F.col("s_acctbal") > 5000).alias("primary_entry"),
    )


def days_run(status: Column) -> Column:
    return (
        F.when(status == "F", "1111100").when(status == "O", "0000010").otherwise("0000001")
    )


_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]


def _days(order: Column) -> Column:
    return F.when(order["o_orderkey"] % 50 == 7, "0000000").otherwise(days_run(order["o_orderstatus"]))


def _header(order: Column) -> Column:
    """An order (its columns in a struct) as the head of a schedule."""
    key, customer = order["o_orderkey"], order["o_custkey"]
    start = order["o_orderdate"].cast("date")
    atoc = (
        F.when(customer % 6 == 0, "SN")
        .when(customer % 6 == 1, "XC")
        .when(customer % 6 == 2, "GX")
        .when(customer % 6 == 3, "ZZ")
        .when(customer % 6 == 4, "Q9")
    )
    return F.struct(
        _text(key).alias("schedule_train_id"),
        F.concat(F.lit("S"), _text(key % 5)).alias("service_code"),
        F.when(key % 10 == 0, "O").otherwise("P").alias("stp_indicator"),
        F.lit("OO").alias("train_category"),
        F.lit("P").alias("train_status"),
        atoc.alias("atoc_code"),
        _days(order).alias("days_run"),
        start.alias("schedule_start"),
        F.date_add(start, (key % 120).cast("int")).alias("schedule_end"),
    )


def timetable_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the stops of schedules, timed or not.

    Stops are ordered by line number, supplier and part; lines that agree in all three are the same
    stop. Every eleventh part is a stop without public times. ``seq`` is the order key, by which the
    rows are partitioned and sorted. ``order`` has what a head is made of, once per train and not per stop.
    """
    train = Window.partitionBy("l_orderkey")
    place = F.row_number().over(train.orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_suppkey",
        "l_partkey",
        place.alias("n"),
        F.count(F.lit(1)).over(train).alias("total"),
    )
    n, total, timed = F.col("n"), F.col("total"), F.col("l_partkey") % 11 != 0
    minute = F.lit(360) + n * 15
    orders = table(spark, sf_dir, "orders").select(*_ORDER, "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("seq"),
        "o_orderpriority",
        "o_orderstatus",
        F.struct(*_ORDER).alias("order"),
        n.alias("pos"),
        _text(F.col("l_suppkey")).alias("tiploc_code"),
        F.when(n == 1, "LO").when(n == total, "LT").otherwise("LI").alias("location_type"),
        F.when(timed & (n > 1), _hhmm(minute)).alias("arrival_time"),
        F.when(timed & ((n == 1) | (n < total)), _hhmm(minute + 1)).alias("departure_time"),
    )


def timetable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as decoded feed records: one row per order, its stops in an array."""
    stop = ["location_type", "tiploc_code", "arrival_time", "departure_time"]
    records = timetable_stops(spark, sf_dir).groupBy("seq").agg(
        *[F.first(c).alias(c) for c in ("o_orderpriority", "o_orderstatus", "order")],
        F.array_sort(F.collect_list(F.struct("pos", *stop))).alias("stops"),
    )
    locations = F.transform("stops", lambda s: F.struct(*[s[c].alias(c) for c in stop]))
    headed = records.select(
        padded(F.col("seq")).alias("seq"),
        "o_orderpriority",
        "o_orderstatus",
        _header(F.col("order")).alias("header"),
        locations.alias("locations"),
    )
    return headed.select("seq", "o_orderpriority", "o_orderstatus", "header.*", "locations")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary schedule table; ids follow the order key and the stop."""
    stops = timetable_stops(spark, sf_dir).filter(
        run_pattern(_days(F.col("order"))).isNotNull()
        & F.coalesce("arrival_time", "departure_time").isNotNull()
    ).withColumnRenamed("order", "header")
    flat = schedule_rows(stops, tiploc_map(stanox(spark, sf_dir)), _header)
    record_id = F.concat_ws("-", padded(F.col("seq")), padded(F.col("stop_sequence"), 10))
    return flat.withColumn("id", record_id).select(*COLUMNS["schedule"])


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order and the one with the next key as a main and an associated train."""
    orders = table(spark, sf_dir, "orders")
    date = F.col("o_orderdate").cast("date")
    main = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", date.alias("main_date"))
    follower = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), date.alias("next_date"))
    key = F.col("o_orderkey")
    days = days_run(F.col("o_orderstatus"))
    return main.join(follower, "o_orderkey").select(
        padded(key).alias("id"),
        _text(key).alias("main_schedule_train_id"),
        _text(key + 1).alias("associated_schedule_train_id"),
        F.date_sub(F.least("main_date", "next_date"), 30).alias("associated_start"),
        F.date_add(F.greatest("main_date", "next_date"), 30).alias("associated_end"),
        F.lit("P").alias("stp_indicator"),
        _text(key % 100).alias("location"),
        *day_flags(days),
        run_pattern(days).alias("days_run_pattern"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), "JJ")
        .when(F.col("o_orderpriority") == "2-HIGH", "VV")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "NP")
        .alias("association_category"),
        days.alias("days_run"),
        "o_orderpriority",
        "o_orderstatus",
    )


def subscribers(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Each customer subscribes to their orders' trains, from the first stop to the last."""
    rows = schedule(spark, sf_dir) if rows is None else rows
    first = rows.filter((F.col("stop_sequence") == 1) & (F.size("subsequent_stanox_codes") > 0))
    orders = table(spark, sf_dir, "orders").select(
        _text(F.col("o_orderkey")).alias("schedule_train_id"), "o_orderkey", "o_custkey"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    held = first.join(orders, "schedule_train_id").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    to = F.try_element_at("subsequent_stanox_codes", F.lit(-1))
    none = F.lit(None).cast("string")
    return held.select(
        padded(F.col("o_orderkey")).alias("id"),
        _text(F.col("o_custkey")).alias("user_id"),
        F.concat("c_name", F.lit("@example.org")).alias("email"),
        F.lit(True).alias("email_verified"),
        F.col("c_name").alias("name"),
        none.alias("first_name"),
        none.alias("family_name"),
        none.alias("locale"),
        "schedule_train_id",
        "service_code",
        F.col("stanox_code").alias("from_stanox_code"),
        F.concat(F.lit("C"), "stanox_code").alias("from_crs"),
        "departure_time",
        to.alias("to_stanox_code"),
        F.concat(F.lit("C"), to).alias("to_crs"),
        F.try_element_at("subsequent_arrival_times", F.lit(-1)).alias("arrival_time"),
        "days_run_pattern",
        F.lit(None).cast("timestamp").alias("subscribe_timestamp"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as decoded movement-feed records.

    signup is an activation, error a cancellation, purchase a movement, click a change of origin and
    view a type that is not handled. The train is the user, the stop comes from the number in props.
    """
    events = table(spark, sf_dir, "events")
    event, user, k = F.col("event_id"), F.col("user_id"), F.col("k")
    kind = F.col("event_type")
    arrival = F.col("arrival_ms")
    delay = F.floor(F.col("value")).cast("bigint") * 60000
    movement = kind == "purchase"
    sign = F.when(event % 4 == 0, 0).when(event % 4 == 1, -1).otherwise(1)
    status = (
        F.when(k % 20 == 7, "OFF ROUTE")
        .when(k % 20 == 8, None)
        .when(event % 4 == 0, "ON TIME")
        .when(event % 4 == 1, "EARLY")
        .otherwise("LATE")
    )
    canx = (
        F.when(k % 4 == 0, "ON CALL")
        .when(k % 4 == 1, "AT ORIGIN")
        .when(k % 4 == 2, "EN ROUTE")
        .otherwise("OUT OF PLAN")
    )
    toc = F.when(user % 2 == 0, "SN").otherwise("XC")
    base = events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("arrival_ms"),
    )
    return base.select(
        "arrival_ms",
        event.alias("seq"),
        F.lit(0).alias("pos"),
        F.when(kind == "signup", "0001")
        .when(kind == "error", "0002")
        .when(movement, "0003")
        .when(kind == "click", "0006")
        .otherwise("0005")
        .alias("msg_type"),
        _text(user).alias("train_id"),
        F.concat(F.lit("S"), _text(F.when(event % 10 == 0, 9).otherwise(user % 5))).alias("service_code"),
        F.when(kind == "signup", _text(user)).alias("schedule_train_id"),
        F.when(kind == "signup", code(k % 10)).alias("origin_stanox_code"),
        F.when(kind == "signup", arrival + 3600000).alias("origin_departure_timestamp"),
        F.when(kind.isin("error", "purchase", "click"), toc).alias("toc"),
        F.when(kind.isin("error", "click") | (movement & (k % 20 != 11)), code(k % 10)).alias("stanox_code"),
        F.when(movement, F.when(event % 2 == 0, "DEPARTURE").otherwise("ARRIVAL")).alias("event_type"),
        F.when(movement, arrival).alias("actual_timestamp"),
        F.when(movement, arrival).alias("planned_timestamp"),
        F.when(movement & (k % 20 != 9), arrival - delay * sign).alias("planned_passenger_timestamp"),
        F.when(movement, status).alias("variation_status"),
        F.when(kind == "error", canx).alias("cancellation_type"),
        F.when(kind == "error", F.concat(F.lit("R"), _text(k))).alias("cancellation_reason_code"),
        F.when(kind == "click", F.lit("")).alias("old_stanox_code"),
        F.lit(None).cast("bigint").alias("old_timestamp"),
        F.when((kind == "click") & (k % 2 == 0), F.concat(F.lit("R"), _text(k))).alias("reason_code"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as JSON texts, three neighbouring events to a message.

    Some cancellations have an unknown type and some movements a time that is not a number, so the
    messages they are in are refused as a whole.
    """
    r = records(spark, sf_dir)

    def number(column: str) -> Column:
        return F.coalesce(_text(F.col(column)), F.lit(""))

    body = F.struct(
        "train_id",
        F.col("service_code").alias("train_service_code"),
        F.col("toc").alias("toc_id"),
        F.col("schedule_train_id").alias("train_uid"),
        F.col("origin_stanox_code").alias("sched_origin_stanox"),
        _text(F.col("origin_departure_timestamp")).alias("origin_dep_timestamp"),
        F.when(F.col("msg_type") == "0003", F.coalesce("stanox_code", F.lit("")))
        .otherwise(F.col("stanox_code"))
        .alias("loc_stanox"),
        F.when((F.col("msg_type") == "0002") & (F.col("seq") % 40 == 1), "MAYBE")
        .otherwise(F.col("cancellation_type"))
        .alias("canx_type"),
        F.col("cancellation_reason_code").alias("canx_reason_code"),
        "event_type",
        F.when((F.col("msg_type") == "0003") & (F.col("seq") % 60 == 2), "12x")
        .otherwise(number("actual_timestamp"))
        .alias("actual_timestamp"),
        number("planned_timestamp").alias("planned_timestamp"),
        number("planned_passenger_timestamp").alias("gbtt_timestamp"),
        "variation_status",
        F.col("old_stanox_code").alias("original_loc_stanox"),
        number("old_timestamp").alias("original_loc_timestamp"),
        "reason_code",
    )
    element = F.struct(F.struct("msg_type").alias("header"), body.alias("body"))
    return (
        r.select(F.floor(F.col("seq") / 3).alias("message"), "arrival_ms", "seq", element.alias("x"))
        .groupBy("message")
        .agg(
            F.min("arrival_ms").alias("arrival_ms"),
            F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("xs"),
        )
        .select(
            "arrival_ms",
            F.col("message").alias("seq"),
            F.to_json(F.transform("xs", lambda e: e["x"])).alias("value"),
        )
    )


def rail_tables(spark: SparkSession, sf_dir: str, **changed: DataFrame) -> RailTables:
    """All tables a query may read; logs and secondary schedules only where a query passes them."""
    rows = changed.get("schedule")
    rows = schedule(spark, sf_dir) if rows is None else rows
    names = [f.name for f in fields(RailTables)]
    parts = {name: empty_table(spark, name) for name in names}
    parts.update(schedule=rows, stanox=stanox(spark, sf_dir))
    return RailTables(**{**parts, **changed})
