"""Explicit schemas: feed JSON, messages and stored tables. Nothing is inferred."""

from __future__ import annotations

from railbeam.constants import DAY_COLUMNS

FEED_RECORD = """
    TiplocV1 struct<transaction_type string, tiploc_code string, stanox string,
                    crs_code string, tps_description string>,
    JsonScheduleV1 struct<transaction_type string, CIF_train_uid string, CIF_stp_indicator string,
        schedule_days_runs string, schedule_start_date string, schedule_end_date string,
        atoc_code string, train_status string,
        schedule_segment struct<CIF_train_service_code string, CIF_train_category string,
            schedule_location array<struct<location_type string, tiploc_code string,
                public_departure string, public_arrival string>>>>,
    JsonAssociationV1 struct<transaction_type string, main_train_uid string, assoc_train_uid string,
        assoc_start_date string, assoc_end_date string, assoc_days string, category string,
        location string, CIF_stp_indicator string>
"""

MESSAGE_ELEMENT = """
    header struct<msg_type string>,
    body struct<train_id string, train_service_code string, toc_id string,
        train_uid string, sched_origin_stanox string, origin_dep_timestamp string,
        loc_stanox string, canx_type string, canx_reason_code string,
        event_type string, actual_timestamp string, planned_timestamp string,
        gbtt_timestamp string, variation_status string,
        original_loc_stanox string, original_loc_timestamp string, reason_code string>
"""

_DAYS = ", ".join(f"{d} boolean" for d in DAY_COLUMNS)

_SCHEDULE = f"""
    id string, schedule_train_id string, service_code string, stp_indicator string,
    train_category string, train_status string, atoc_code string, stop_sequence int,
    stanox_code string, subsequent_stanox_codes array<string>,
    subsequent_arrival_times array<string>, {_DAYS}, days_run_pattern string,
    schedule_start date, schedule_end date, location_type string,
    arrival_time string, departure_time string
"""

_LOG_HEAD = """
    id string, arrival_ms bigint, train_id string, schedule_train_id string,
    service_code string, toc string
"""

_ORIGIN = """
    origin_stanox_code string, origin_departure_timestamp bigint,
    origin_departure_date date, origin_departure_time string
"""

TABLES: dict[str, str] = {
    "schedule": _SCHEDULE,
    "schedule_secondary": _SCHEDULE + ", association_id string",
    "stanox": """id string, tiploc_code string, stanox_code string, crs string,
           description string, primary_entry boolean""",
    "association": f"""id string, main_schedule_train_id string, associated_schedule_train_id string,
            associated_start date, associated_end date, stp_indicator string, location string,
            {_DAYS}, days_run_pattern string, association_category string""",
    "movement_log": _LOG_HEAD
    + ", event_type string, stanox_code string,"
    + _ORIGIN
    + """, planned_passenger_timestamp bigint, planned_passenger_time string,
         actual_timestamp bigint, actual_time string, difference bigint,
         variation_status string""",
    "cancellation_log": _LOG_HEAD
    + ", stanox_code string,"
    + _ORIGIN
    + ", cancellation_type string, cancellation_reason_code string",
    "change_of_origin_log": _LOG_HEAD + ", new_stanox_code string," + _ORIGIN + ", reason_code string",
    "subscribers": """id string, user_id string, email string, email_verified boolean, name string,
           first_name string, family_name string, locale string, schedule_train_id string,
           service_code string, from_stanox_code string, from_crs string, departure_time string,
           to_stanox_code string, to_crs string, arrival_time string, days_run_pattern string,
           subscribe_timestamp timestamp""",
    "watched_stops": """subscriber_id string, user_id string, email string, schedule_train_id string,
           service_code string, stanox_code string""",
    "rejects": "seq string, kind string, reject_reason string, value string",
}

COLUMNS: dict[str, list[str]] = {
    table: [field.split()[0] for field in ddl.split(",")] for table, ddl in TABLES.items()
}
