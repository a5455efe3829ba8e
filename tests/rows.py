"""Small rows for tests: one route of five stops, its station records and builders of feed lines."""

from __future__ import annotations

import json

STATIONS = [
    ("REIGATE", "87089", "REI", "Reigate"),
    ("REDHILL", "87722", "RDH", "Redhill"),
    ("MERSTHAM", "87723", "MHM", "Merstham"),
    ("EASTCRYD", "87724", "ECR", "East Croydon"),
    ("LONVIC", "87201", "VIC", "London Victoria"),
    ("GATWICK", "87725", "GTW", "Gatwick Airport"),
    ("LDNBRG", "87726", "LBG", "London Bridge"),
]
CODE = {tiploc: stanox for tiploc, stanox, _, _ in STATIONS}
ROUTE = [
    ("LO", "REIGATE", None, "1210"),
    ("LI", "REDHILL", "1214", "1215"),
    ("LI", "MERSTHAM", "1224", "1225"),
    ("LI", "EASTCRYD", "1235", "1236"),
    ("LT", "LONVIC", "1245", None),
]
JOINING = [("LO", "GATWICK", None, "1200"), ("LT", "REIGATE", "1208", None)]
DIVIDED = [("LO", "EASTCRYD", None, "1238"), ("LT", "LDNBRG", "1250", None)]


def tiploc_line(tiploc, stanox, crs, description, op="Create"):
    body = {
        "transaction_type": op,
        "tiploc_code": tiploc,
        "nalco": "1",
        "stanox": stanox,
        "crs_code": crs,
        "description": "not this one",
        "tps_description": description,
    }
    return json.dumps({"TiplocV1": body})


def schedule_line(
    train,
    stops=ROUTE,
    service="799984",
    op="Create",
    days="1111100",
    start="2017-12-11",
    end="2017-12-29",
    stp="P",
    atoc="SN",
    category="OO",
):
    locations = [
        {
            "location_type": kind,
            "tiploc_code": tiploc,
            "public_arrival": arrival,
            "public_departure": departure,
            "arrival": arrival,
            "platform": "1A",
        }
        for kind, tiploc, arrival, departure in stops
    ]
    body = {
        "transaction_type": op,
        "CIF_train_uid": train,
        "CIF_stp_indicator": stp,
        "schedule_days_runs": days,
        "schedule_start_date": start,
        "schedule_end_date": end,
        "atoc_code": atoc,
        "train_status": "P",
        "schedule_segment": {
            "CIF_course_indicator": 1,
            "CIF_train_service_code": service,
            "CIF_train_category": category,
            "schedule_location": locations if stops is not None else None,
        },
    }
    return json.dumps({"JsonScheduleV1": body})


def association_line(
    main,
    associated,
    location="REDHILL",
    category="JJ",
    op="Create",
    days="1111100",
    start="2017-12-11",
    end="2017-12-29",
    stp="P",
):
    body = {
        "transaction_type": op,
        "main_train_uid": main,
        "assoc_train_uid": associated,
        "assoc_start_date": f"{start}T00:00:00Z",
        "assoc_end_date": f"{end}T00:00:00Z",
        "assoc_days": days,
        "category": category,
        "location": location,
        "CIF_stp_indicator": stp,
    }
    return json.dumps({"JsonAssociationV1": body})


def station_lines():
    return [tiploc_line(*s) for s in STATIONS]


def feed_frame(spark, lines):
    return spark.createDataFrame(
        [(f"{i:06d}", line) for i, line in enumerate(lines)], "seq string, value string"
    )


def write_feed(path, lines):
    path.write_text("\n".join([*lines, '{"EOF":true}']) + "\n", encoding="utf-8")
    return str(path)


def activation(train_id="12345", uid="G123456", service="23456", origin="87089", departs=1514663100000):
    return {
        "header": {"msg_type": "0001"},
        "body": {
            "train_id": train_id,
            "train_service_code": service,
            "train_uid": uid,
            "sched_origin_stanox": origin,
            "origin_dep_timestamp": str(departs),
        },
    }


def movement(
    train_id="12345",
    service="23456",
    stanox="87722",
    actual=1514664060000,
    gbtt=1514663100000,
    status="LATE",
    event="ARRIVAL",
    toc="SN",
):
    return {
        "header": {"msg_type": "0003"},
        "body": {
            "train_id": train_id,
            "train_service_code": service,
            "event_type": event,
            "toc_id": toc,
            "actual_timestamp": str(actual),
            "planned_timestamp": "" if gbtt is None else str(gbtt),
            "gbtt_timestamp": "" if gbtt is None else str(gbtt),
            "loc_stanox": stanox,
            "variation_status": status,
        },
    }


def cancellation(train_id="12345", service="23456", stanox="87722", kind="EN ROUTE", reason="YI"):
    return {
        "header": {"msg_type": "0002"},
        "body": {
            "train_id": train_id,
            "train_service_code": service,
            "toc_id": "SN",
            "loc_stanox": stanox,
            "canx_type": kind,
            "canx_reason_code": reason,
        },
    }


def change_of_origin(train_id="12345", service="23456", stanox="87723", reason=None):
    return {
        "header": {"msg_type": "0006"},
        "body": {
            "train_id": train_id,
            "train_service_code": service,
            "toc_id": "SN",
            "loc_stanox": stanox,
            "original_loc_stanox": "87089",
            "original_loc_timestamp": "",
            "reason_code": reason,
        },
    }


def message_frame(spark, messages):
    """Messages, each given as (arrival_ms, list of records)."""
    return spark.createDataFrame(
        [(ms, f"{i:06d}", json.dumps(m) if isinstance(m, list) else m) for i, (ms, m) in enumerate(messages)],
        "arrival_ms bigint, seq string, value string",
    )
