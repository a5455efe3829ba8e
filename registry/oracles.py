"""The SQL each registered query must equal, written for DuckDB over the given tables.

The SQL derives the rail-shaped tables anew and in its own way (window functions and correlated
subqueries where the engine aggregates), so that it checks the shapes as well as the operations.
"""

from __future__ import annotations

from railbeam.constants import ACTIVATION_TTL_MS, DAY_COLUMNS


def _with(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()


def _pad(value: str, width: int = 12) -> str:
    return f"lpad(CAST({value} AS VARCHAR), {width}, '0')"


def _hhmm(minute: str) -> str:
    return f"lpad(CAST((({minute}) % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((({minute}) % 1440) % 60 AS VARCHAR), 2, '0')"


def _secs(t: str) -> str:
    return f"epoch(CAST(CASE WHEN length({t}) = 5 THEN {t} || ':00' ELSE {t} END AS TIME))"


def _minutes(a: str, b: str) -> str:
    return f"CAST(trunc(({_secs(b)} - {_secs(a)}) / 60.0) AS BIGINT)"


def _time(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%H:%M:%S')"


def _date(ms: str) -> str:
    return f"CAST(make_timestamp(({ms}) * 1000) AS DATE)"


_FLAGS = ", ".join(f"substr(days_run, {i + 1}, 1) = '1' AS {d}" for i, d in enumerate(DAY_COLUMNS))
_PATTERN = (
    "CASE WHEN substr(days_run, 1, 5) <> '00000' THEN 'Weekdays' WHEN substr(days_run, 6, 1) = '1' "
    "THEN 'Saturdays' WHEN substr(days_run, 7, 1) = '1' THEN 'Sundays' END"
)
_DAYS_OF_STATUS = "CASE o_orderstatus WHEN 'F' THEN '1111100' WHEN 'O' THEN '0000010' ELSE '0000001' END"
# Fixed values, stated here again so that the SQL checks those of the engine: operators, and preferred stops.
_NAMES = """
  ('AR', 'Alliance Rail'), ('NT', 'Arriva Trains Northern'), ('AW', 'Arriva Trains Wales'), ('CC', 'c2c'),
  ('CS', 'Caledonian Sleeper'), ('CH', 'Chiltern Railway'), ('XC', 'CrossCountry'), ('EM', 'East Midlands Trains'),
  ('ES', 'Eurostar'), ('HT', 'First Hull Trains'), ('GX', 'Gatwick Express'), ('ZZ', 'GB Railfreight'),
  ('GN', 'Govia Thameslink Railway (Great Northern)'), ('TL', 'Govia Thameslink Railway (Thameslink)'),
  ('GC', 'Grand Central'), ('LN', 'Great North Western Railway'), ('GW', 'Great Western Railway'),
  ('LE', 'Greater Anglia'), ('HC', 'Heathrow Connect'), ('HX', 'Heathrow Express'), ('IL', 'Island Lines'),
  ('LS', 'Locomotive Services'), ('LM', 'London Midland'), ('LO', 'London Overground'), ('LT', 'London Underground'),
  ('ME', 'Merseyrail'), ('TW', 'Nexus (Tyne & Wear Metro)'), ('NY', 'North Yorkshire Moors Railway'),
  ('SR', 'ScotRail'), ('SW', 'South Western Railway'), ('SJ', 'South Yorkshire Supertram'), ('SE', 'Southeastern'),
  ('SN', 'Southern'), ('SP', 'Swanage Railway'), ('XR', 'TfL Rail'), ('TP', 'TransPennine Express'),
  ('VT', 'Virgin Trains'), ('GR', 'Virgin Trains East Coast'), ('WR', 'West Coast Railway Co.')"""
_PREFERRED = """
  ('86935', 'POOLE'), ('88486', 'SWLY'), ('89428', 'ASHFKY'), ('86441', 'BOGNORR'), ('87981', 'BRGHMHS'),
  ('40320', 'CHST'), ('87219', 'CLPHMJN'), ('89530', 'EBSFDOM'), ('87071', 'EFNGHMJ'), ('01100', 'IVRNESS'),
  ('31510', 'MNCRVIC'), ('30120', 'PRST'), ('52215', 'STFORDI'), ('87201', 'VICTRIA'), ('86981', 'WEYMTH'),
  ('87261', 'WIMBLDN'), ('72277', 'WLSDNJL'), ('86037', 'WOKICHS'), ('82341', 'YOVILJN')"""

STANOX = f"""
stanox AS (
  SELECT {_pad('s_suppkey')} AS id, CAST(s_suppkey AS VARCHAR) AS tiploc_code,
    CASE WHEN s_suppkey % 13 <> 5 THEN {_pad('s_nationkey % 10', 5)} END AS stanox_code,
    CASE WHEN s_acctbal >= 0 THEN substr(n_name, 1, 1) || {_pad('n_nationkey', 2)} END AS crs,
    s_name AS description,
    CASE WHEN s_suppkey % 13 <> 5 THEN s_acctbal > 5000 END AS primary_entry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""

TRAINS = f"""
trains AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, {_pad('o_orderkey')} AS seq,
    CAST(o_orderkey AS VARCHAR) AS schedule_train_id,
    'S' || CAST(o_orderkey % 5 AS VARCHAR) AS service_code,
    CASE WHEN o_orderkey % 10 = 0 THEN 'O' ELSE 'P' END AS stp_indicator,
    CASE o_custkey % 6 WHEN 0 THEN 'SN' WHEN 1 THEN 'XC' WHEN 2 THEN 'GX' WHEN 3 THEN 'ZZ'
      WHEN 4 THEN 'Q9' END AS atoc_code,
    CASE WHEN o_orderkey % 50 = 7 THEN '0000000' ELSE {_DAYS_OF_STATUS} END AS days_run,
    CAST(o_orderdate AS DATE) AS schedule_start,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) AS schedule_end
  FROM orders)
"""

STOPS = f"""
lines AS (
  SELECT l_orderkey, l_suppkey, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS n,
    count(*) OVER (PARTITION BY l_orderkey) AS total
  FROM lineitem),
stops AS (
  SELECT trains.*, n, total, CAST(l_suppkey AS VARCHAR) AS tiploc_code,
    CASE WHEN n = 1 THEN 'LO' WHEN n = total THEN 'LT' ELSE 'LI' END AS location_type,
    CASE WHEN l_partkey % 11 <> 0 AND n > 1 THEN {_hhmm('360 + 15 * n')} END AS arrival_time,
    CASE WHEN l_partkey % 11 <> 0 AND (n = 1 OR n < total) THEN {_hhmm('361 + 15 * n')} END AS departure_time
  FROM trains JOIN lines ON l_orderkey = o_orderkey)
"""

_LATER = "OVER (PARTITION BY seq ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"

SCHEDULE = f"""
kept AS (
  SELECT stops.*, stanox_code FROM stops JOIN stanox USING (tiploc_code)
  WHERE stanox_code IS NOT NULL AND COALESCE(arrival_time, departure_time) IS NOT NULL
    AND days_run <> '0000000'),
schedule AS (
  SELECT seq || '-' || {_pad('row_number() OVER (PARTITION BY seq ORDER BY n)', 10)} AS id,
    o_orderkey, o_custkey, o_orderpriority, o_orderstatus, seq, schedule_train_id, service_code,
    stp_indicator, atoc_code,
    row_number() OVER (PARTITION BY seq ORDER BY n) AS stop_sequence, stanox_code,
    COALESCE(list(stanox_code) {_LATER}, []) AS codes,
    COALESCE(list(COALESCE(arrival_time, departure_time)) {_LATER}, []) AS times,
    {_FLAGS}, {_PATTERN} AS days_run_pattern, schedule_start, schedule_end, location_type,
    arrival_time, departure_time
  FROM kept)
"""

ALL_SCHEDULE = (STANOX, TRAINS, STOPS, SCHEDULE)

ASSOCIATION = f"""
association AS (
  SELECT {_pad('a.o_orderkey')} AS id, CAST(a.o_orderkey AS VARCHAR) AS main_schedule_train_id,
    CAST(b.o_orderkey AS VARCHAR) AS associated_schedule_train_id,
    least(CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) - 30 AS associated_start,
    greatest(CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) + 30 AS associated_end,
    'P' AS stp_indicator, CAST(a.o_orderkey % 100 AS VARCHAR) AS location,
    CASE a.o_orderstatus WHEN 'F' THEN '1111100' WHEN 'O' THEN '0000010' ELSE '0000001' END AS days_run,
    CASE a.o_orderstatus WHEN 'F' THEN 'Weekdays' WHEN 'O' THEN 'Saturdays' ELSE 'Sundays' END AS days_run_pattern,
    CASE a.o_orderpriority WHEN '1-URGENT' THEN 'JJ' WHEN '5-LOW' THEN 'JJ' WHEN '2-HIGH' THEN 'VV'
      WHEN '3-MEDIUM' THEN 'NP' END AS association_category,
    a.o_orderpriority, a.o_orderstatus
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)
"""

SUBSCRIBERS = f"""
subscribers AS (
  SELECT seq AS id, CAST(o_custkey AS VARCHAR) AS user_id, c_name || '@example.org' AS email,
    schedule_train_id, service_code, stanox_code AS from_stanox_code, 'C' || stanox_code AS from_crs,
    departure_time, codes[-1] AS to_stanox_code, 'C' || codes[-1] AS to_crs, times[-1] AS arrival_time,
    days_run_pattern
  FROM schedule JOIN customer ON c_custkey = o_custkey
  WHERE stop_sequence = 1 AND len(codes) > 0)
"""

RECORDS = f"""
base AS (
  SELECT *, epoch_us(ts) // 1000 AS arrival_ms, CAST(props->>'$.k' AS INTEGER) AS k,
    CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN -1 ELSE 1 END AS sign
  FROM events),
records AS (
  SELECT arrival_ms, event_id AS seq, CAST(0 AS BIGINT) AS pos,
    CASE event_type WHEN 'signup' THEN '0001' WHEN 'error' THEN '0002' WHEN 'purchase' THEN '0003'
      WHEN 'click' THEN '0006' ELSE '0005' END AS msg_type,
    CAST(user_id AS VARCHAR) AS train_id,
    'S' || CAST(CASE WHEN event_id % 10 = 0 THEN 9 ELSE user_id % 5 END AS VARCHAR) AS service_code,
    CASE WHEN event_type = 'signup' THEN CAST(user_id AS VARCHAR) END AS schedule_train_id,
    CASE WHEN event_type = 'signup' THEN {_pad('k % 10', 5)} END AS origin_stanox_code,
    CASE WHEN event_type = 'signup' THEN arrival_ms + 3600000 END AS origin_departure_timestamp,
    CASE WHEN event_type IN ('error', 'purchase', 'click') THEN
      CASE WHEN user_id % 2 = 0 THEN 'SN' ELSE 'XC' END END AS toc,
    CASE WHEN event_type IN ('error', 'click') OR (event_type = 'purchase' AND k % 20 <> 11)
      THEN {_pad('k % 10', 5)} END AS stanox_code,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'DEPARTURE' ELSE 'ARRIVAL' END END AS event_type,
    CASE WHEN event_type = 'purchase' THEN arrival_ms END AS actual_timestamp,
    CASE WHEN event_type = 'purchase' THEN arrival_ms END AS planned_timestamp,
    CASE WHEN event_type = 'purchase' AND k % 20 <> 9
      THEN arrival_ms - CAST(floor(value) AS BIGINT) * 60000 * sign END AS planned_passenger_timestamp,
    CASE WHEN event_type = 'purchase' THEN
      CASE WHEN k % 20 = 7 THEN 'OFF ROUTE' WHEN k % 20 = 8 THEN NULL WHEN sign = 0 THEN 'ON TIME'
        WHEN sign = -1 THEN 'EARLY' ELSE 'LATE' END END AS variation_status,
    CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'ON CALL' WHEN 1 THEN 'AT ORIGIN'
      WHEN 2 THEN 'EN ROUTE' ELSE 'OUT OF PLAN' END END AS cancellation_type,
    CASE WHEN event_type = 'error' THEN 'R' || CAST(k AS VARCHAR) END AS cancellation_reason_code,
    CASE WHEN event_type = 'click' THEN '' END AS old_stanox_code,
    CAST(NULL AS BIGINT) AS old_timestamp,
    CASE WHEN event_type = 'click' AND k % 2 = 0 THEN 'R' || CAST(k AS VARCHAR) END AS reason_code
  FROM base)
"""

ENRICHED = f"""
acts AS (SELECT * FROM records WHERE msg_type = '0001'),
ranked AS (
  SELECT m.seq AS m_seq, a.arrival_ms AS a_ms, m.arrival_ms AS m_ms, a.schedule_train_id AS act_train,
    a.origin_stanox_code AS act_stanox, a.origin_departure_timestamp AS act_ts,
    row_number() OVER (PARTITION BY m.seq ORDER BY a.arrival_ms DESC, a.seq DESC) AS r
  FROM records m JOIN acts a ON a.train_id = m.train_id
    AND (a.arrival_ms < m.arrival_ms OR (a.arrival_ms = m.arrival_ms AND a.seq < m.seq))
  WHERE m.msg_type IN ('0002', '0003', '0006')),
enriched AS (
  SELECT m.* EXCLUDE (schedule_train_id, origin_stanox_code, origin_departure_timestamp),
    act_train AS schedule_train_id, act_stanox AS origin_stanox_code, act_ts AS origin_departure_timestamp
  FROM records m JOIN ranked ON m_seq = m.seq
  WHERE r = 1 AND m_ms - a_ms <= {ACTIVATION_TTL_MS})
"""

_LOG_HEAD = f"{_pad('seq')} AS id, arrival_ms, train_id, schedule_train_id, service_code, toc"
_ORIGIN = (
    "origin_stanox_code, origin_departure_timestamp, "
    f"{_date('origin_departure_timestamp')} AS origin_departure_date, "
    f"{_time('origin_departure_timestamp')} AS origin_departure_time"
)

MOVEMENTS = f"""
movement_log AS (
  SELECT {_LOG_HEAD}, event_type, stanox_code, {_ORIGIN}, planned_passenger_timestamp,
    {_time('planned_passenger_timestamp')} AS planned_passenger_time, actual_timestamp,
    {_time('actual_timestamp')} AS actual_time,
    actual_timestamp - planned_passenger_timestamp AS difference, variation_status
  FROM enriched
  WHERE msg_type = '0003' AND stanox_code IS NOT NULL AND planned_passenger_timestamp IS NOT NULL
    AND variation_status IS NOT NULL)
"""
CANCELLATIONS = f"""
cancellation_log AS (
  SELECT {_LOG_HEAD}, stanox_code, {_ORIGIN}, cancellation_type, cancellation_reason_code
  FROM enriched WHERE msg_type = '0002')
"""
ORIGINS = f"""
change_of_origin_log AS (
  SELECT {_LOG_HEAD}, stanox_code AS new_stanox_code, {_ORIGIN}, reason_code
  FROM enriched WHERE msg_type = '0006')
"""
LOGS = (RECORDS, ENRICHED, MOVEMENTS, CANCELLATIONS, ORIGINS)

# The feed lines that the decode queries read, as the values they carry.
FEED = f"""
f_tiploc AS (
  SELECT '1-' || id AS seq, 'TiplocV1' AS kind,
    CASE WHEN s % 7 = 3 THEN 'Update' WHEN s % 7 = 4 THEN 'Delete' WHEN s % 19 = 6 THEN 'Replace'
      ELSE 'Create' END AS op,
    CASE WHEN s % 17 <> 9 THEN tiploc_code END AS tiploc_code, stanox_code, crs, description
  FROM (SELECT *, CAST(tiploc_code AS BIGINT) AS s FROM stanox)),
f_schedule AS (
  SELECT '2-' || seq AS seq, 'JsonScheduleV1' AS kind,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Delete' WHEN o_orderkey % 100 = 77 THEN 'Update'
      ELSE 'Create' END AS op,
    trains.* EXCLUDE (seq, days_run),
    CASE WHEN o_orderkey % 100 = 33 THEN '11111' ELSE days_run END AS days_run
  FROM trains WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
f_association AS (
  SELECT '3-' || id AS seq, 'JsonAssociationV1' AS kind,
    CASE WHEN o_orderstatus = 'P' THEN 'Delete' ELSE 'Create' END AS op, association.* EXCLUDE (id)
  FROM association),
f_other AS (
  SELECT '4-' || {_pad('n_nationkey')} AS seq,
    CASE n_nationkey WHEN 0 THEN 'JsonTimetableV1' WHEN 2 THEN 'Other' END AS kind
  FROM nation WHERE n_nationkey <> 1),
f_all AS (
  SELECT seq, kind, op,
    CASE WHEN op = 'Replace' THEN 'bad_transaction_type' WHEN tiploc_code IS NULL THEN 'bad_tiploc_code' END AS reject_reason
  FROM f_tiploc
  UNION ALL
  SELECT seq, kind, op,
    CASE WHEN op = 'Update' THEN 'update_not_supported'
      WHEN op = 'Create' AND days_run = '11111' THEN 'bad_days_run' END
  FROM f_schedule
  UNION ALL SELECT seq, kind, op, NULL FROM f_association
  UNION ALL
  SELECT seq, kind, NULL, CASE WHEN kind IS NULL THEN 'not_an_object' WHEN kind = 'Other' THEN 'unknown_record_kind' END
  FROM f_other)
"""
ALL_FEED = (STANOX, TRAINS, ASSOCIATION, FEED)

_MAIN = "row_number() OVER (PARTITION BY stanox_code ORDER BY {rank}, id) = 1"
MAIN_RANK = "CASE WHEN primary_entry THEN 0 ELSE 1 END"
NOTICE_RANK = "CASE WHEN primary_entry AND crs IS NOT NULL THEN 0 ELSE 1 END"

CRS = f"""
crs_of AS (
  SELECT stanox_code, crs FROM stanox
  WHERE crs IS NOT NULL AND stanox_code IS NOT NULL AND tiploc_code IS NOT NULL
  QUALIFY {_MAIN.format(rank=MAIN_RANK)})
"""
NAMES = f"names(code, toc_name) AS (VALUES {_NAMES})"


def _answers(source: str, record_type: str, asked: str, keys: str = "") -> str:
    """Search answers over a schedule CTE for requests (f, t, p) in the CTE ``asked``."""
    return f"""
    SELECT DISTINCT ON (s.schedule_train_id, s.service_code, s.stanox_code, s.days_run_pattern, f, t)
      '{record_type}' AS record_type, s.id, s.schedule_train_id, s.service_code, s.atoc_code,
      s.stanox_code AS from_stanox_code, s.departure_time, t AS to_stanox_code,
      s.times[list_position(s.codes, t)] AS arrival_time, s.days_run_pattern, s.schedule_start,
      s.schedule_end
    FROM {source} s JOIN {asked} ON s.stanox_code = f AND s.days_run_pattern = p
    WHERE list_contains(s.codes, t) AND s.stp_indicator = 'P'
      AND date_diff('day', s.schedule_start, s.schedule_end) > 2
    ORDER BY s.schedule_train_id, s.service_code, s.stanox_code, s.days_run_pattern, f, t, s.id"""


_SHOWN = """record_type, a.id, a.schedule_train_id, atoc_code, toc_name, a.from_stanox_code,
    COALESCE(c1.crs, 'N/A') AS from_crs, a.departure_time, a.to_stanox_code,
    COALESCE(c2.crs, 'N/A') AS to_crs, a.arrival_time, a.days_run_pattern, schedule_start, schedule_end,
    {subscribed} AS subscribed, CASE WHEN {subscribed} THEN 'Y' ELSE 'N' END AS subscribed_flag,
    '/train-history.html?scheduleTrainId=' || a.schedule_train_id || '&fromStanox=' || a.from_stanox_code
      || '&toStanox=' || a.to_stanox_code AS history"""
_NAMED = """JOIN names ON code = atoc_code
  LEFT JOIN crs_of c1 ON c1.stanox_code = a.from_stanox_code
  LEFT JOIN crs_of c2 ON c2.stanox_code = a.to_stanox_code"""
_HELD = """EXISTS (SELECT 1 FROM subscribers h WHERE h.user_id = {user}
      AND h.schedule_train_id = a.schedule_train_id AND h.from_stanox_code = a.from_stanox_code
      AND h.to_stanox_code = a.to_stanox_code AND h.service_code = a.service_code
      AND h.days_run_pattern = a.days_run_pattern)"""

MATCH = """
legs AS (
  SELECT id AS association_id, 'main' AS leg, main_schedule_train_id AS train, days_run_pattern,
    associated_start, associated_end FROM association
  UNION ALL
  SELECT id, 'associated', associated_schedule_train_id, days_run_pattern, associated_start, associated_end
  FROM association),
relevant AS (
  SELECT association_id, leg, s.*
  FROM legs JOIN schedule s ON s.schedule_train_id = train AND s.days_run_pattern = legs.days_run_pattern
    AND s.schedule_start < associated_end AND s.schedule_end > associated_start),
chosen AS (
  SELECT * FROM relevant
  QUALIFY schedule_start = min(schedule_start) OVER (PARTITION BY association_id, leg))
"""

STITCH = f"""
both_legs AS (
  SELECT association_id FROM chosen GROUP BY 1 HAVING count(DISTINCT leg) = 2),
marked AS (
  SELECT c.*, a.association_category,
    max(CASE WHEN c.leg = 'main' AND c.stanox_code IN (
        SELECT x.stanox_code FROM stanox x WHERE x.tiploc_code = a.location AND x.stanox_code IS NOT NULL)
      THEN 1 ELSE 0 END)
      OVER (PARTITION BY c.association_id, c.leg ORDER BY c.stop_sequence, c.id) AS reached
  FROM chosen c JOIN association a ON a.id = c.association_id
  WHERE c.association_id IN (SELECT association_id FROM both_legs)
    AND a.association_category IN ('JJ', 'VV')),
stitched AS (
  SELECT *, row_number() OVER (PARTITION BY association_id ORDER BY
      CASE WHEN association_category = 'JJ' THEN (CASE leg WHEN 'associated' THEN 0 ELSE 1 END)
        ELSE (CASE leg WHEN 'main' THEN 0 ELSE 1 END) END, stop_sequence, id) - 1 AS place
  FROM marked
  WHERE leg = 'associated' OR (association_category = 'JJ' AND reached = 1)
    OR (association_category = 'VV' AND reached = 0)),
first_call AS (
  SELECT association_id, stanox_code, min(place) AS first_place FROM stitched GROUP BY 1, 2),
whole AS (
  SELECT association_id, list(stanox_code ORDER BY place) AS all_codes,
    list(COALESCE(arrival_time, departure_time) ORDER BY place) AS all_times
  FROM stitched GROUP BY 1),
secondary AS (
  SELECT s.association_id || '-' || {_pad('place', 10)} AS id, s.association_id,
    a.associated_schedule_train_id AS schedule_train_id, s.service_code, a.stp_indicator, s.atoc_code,
    place AS stop_sequence, s.stanox_code, all_codes[first_place + 2:] AS codes,
    all_times[first_place + 2:] AS times, a.days_run_pattern, a.associated_start AS schedule_start,
    a.associated_end AS schedule_end, s.arrival_time, s.departure_time, a.association_category
  FROM stitched s JOIN association a ON a.id = s.association_id
    JOIN first_call f ON f.association_id = s.association_id AND f.stanox_code = s.stanox_code
    JOIN whole w ON w.association_id = s.association_id)
"""


def _stitched(category: str) -> str:
    return _with(
        *ALL_SCHEDULE,
        ASSOCIATION,
        MATCH,
        STITCH,
        body=f"""
        SELECT id, association_id, schedule_train_id, service_code, stp_indicator, atoc_code,
          stop_sequence, stanox_code, array_to_string(codes, ',') AS subsequent_stanox_codes,
          array_to_string(times, ',') AS subsequent_arrival_times, days_run_pattern, schedule_start,
          schedule_end, arrival_time, departure_time
        FROM secondary WHERE association_category = '{category}'""",
    )


_W0, _W1 = 1704844800000, 1705881600000

PAIRS = f"""
asked AS (
  SELECT CAST(u AS VARCHAR) AS schedule_train_id, {_pad('f', 5)} AS from_stanox_code, {_pad('t', 5)} AS to_stanox_code,
    {_W0} - f * 86400000 AS from_ts, {_W1} + t * 3600000 AS to_ts, '12:00' AS dep, '13:00' AS arr
  FROM (SELECT DISTINCT user_id AS u FROM events), range(10) AS x(f), range(10) AS y(t) WHERE f <> t)
"""

WINDOWS = f"""
windows AS (
  SELECT CAST(u AS VARCHAR) AS schedule_train_id, {_W0} + u * 3600000 AS from_ts, {_W1} AS to_ts, 'closed' AS asked
  FROM (SELECT DISTINCT user_id AS u FROM events)
  UNION ALL
  SELECT CAST(u AS VARCHAR), 0, {_W0} + u * 3600000, 'open' FROM (SELECT DISTINCT user_id AS u FROM events))
"""


def _in_windows(log: str, stop: str, more: str = "true") -> str:
    return f"""
    SELECT asked, id, {stop} FROM {log} l JOIN windows w ON w.schedule_train_id = l.schedule_train_id
      AND l.origin_departure_timestamp BETWEEN w.from_ts AND w.to_ts WHERE {more}"""



def _pairs(asked: str) -> str:
    return f"""
deps AS (
  SELECT q.*, m.train_id, m.origin_departure_date, m.actual_time,
    row_number() OVER (PARTITION BY q.schedule_train_id, q.from_stanox_code, q.to_stanox_code,
      m.train_id, m.origin_departure_date ORDER BY m.arrival_ms, m.id) AS r
  FROM {asked} q JOIN movement_log m ON m.schedule_train_id = q.schedule_train_id
    AND m.stanox_code = q.from_stanox_code AND m.event_type = 'DEPARTURE'
    AND m.origin_departure_timestamp BETWEEN q.from_ts AND q.to_ts),
arrs AS (
  SELECT q.*, m.train_id, m.origin_departure_date, m.actual_time,
    row_number() OVER (PARTITION BY q.schedule_train_id, q.from_stanox_code, q.to_stanox_code,
      m.train_id, m.origin_departure_date ORDER BY m.arrival_ms, m.id) AS r
  FROM {asked} q JOIN movement_log m ON m.schedule_train_id = q.schedule_train_id
    AND m.stanox_code = q.to_stanox_code AND m.event_type = 'ARRIVAL'
    AND m.origin_departure_timestamp BETWEEN q.from_ts AND q.to_ts),
pairs AS (
  SELECT d.schedule_train_id, d.from_stanox_code, d.to_stanox_code, d.train_id,
    d.origin_departure_date AS scheduled_departure_date, d.actual_time AS actual_departure_time,
    {_minutes('d.dep', 'd.actual_time')} AS departure_difference,
    a.actual_time AS actual_arrival_time,
    {_minutes('a.arr', 'a.actual_time')} AS arrival_difference
  FROM deps d JOIN arrs a USING (schedule_train_id, from_stanox_code, to_stanox_code, train_id, origin_departure_date)
  WHERE d.r = 1 AND a.r = 1),
days AS (
  SELECT q.schedule_train_id, q.from_stanox_code, q.to_stanox_code,
    c.origin_departure_date AS scheduled_departure_date, c.cancellation_type, c.cancellation_reason_code
  FROM {asked} q JOIN cancellation_log c ON c.schedule_train_id = q.schedule_train_id
    AND c.origin_departure_timestamp BETWEEN q.from_ts AND q.to_ts
  QUALIFY row_number() OVER (PARTITION BY q.schedule_train_id, q.from_stanox_code, q.to_stanox_code,
    c.origin_departure_date ORDER BY c.arrival_ms, c.id) = 1)
"""


def _words(minutes: str) -> str:
    return (
        f"CASE WHEN {minutes} > 0 THEN CAST({minutes} AS VARCHAR) || CASE WHEN {minutes} = 1 THEN ' minute' ELSE ' minutes' END || ' late' "
        f"WHEN {minutes} < 0 THEN CAST(-{minutes} AS VARCHAR) || CASE WHEN {minutes} = -1 THEN ' minute' ELSE ' minutes' END || ' early' "
        "ELSE 'On time' END"
    )


DISPLAY = f"""
SELECT schedule_train_id, from_stanox_code, to_stanox_code, scheduled_departure_date,
  actual_departure_time, {_words('departure_difference')} AS departure_text, actual_arrival_time,
  {_words('arrival_difference')} AS arrival_text
FROM pairs
UNION ALL
SELECT schedule_train_id, from_stanox_code, to_stanox_code, scheduled_departure_date,
  'CANCELLED', 'CANCELLED', 'CANCELLED', 'CANCELLED'
FROM days
"""

HEADER = """
header AS (
  SELECT q.schedule_train_id, d.atoc_code, q.from_stanox_code, c1.crs AS from_crs, q.to_stanox_code,
    c2.crs AS to_crs, d.departure_time AS expected_departure_time,
    (SELECT x.arrival_time FROM schedule x WHERE x.schedule_train_id = q.schedule_train_id
       AND x.stanox_code = q.to_stanox_code AND x.schedule_start = d.schedule_start
       AND x.schedule_end = d.schedule_end ORDER BY x.id LIMIT 1) AS expected_arrival_time
  FROM (SELECT DISTINCT schedule_train_id, from_stanox_code, to_stanox_code FROM subscribers) q
  JOIN (SELECT * FROM schedule QUALIFY row_number() OVER (PARTITION BY schedule_train_id, stanox_code ORDER BY id) = 1) d
    ON d.schedule_train_id = q.schedule_train_id AND d.stanox_code = q.from_stanox_code
  JOIN crs_of c1 ON c1.stanox_code = q.from_stanox_code
  JOIN crs_of c2 ON c2.stanox_code = q.to_stanox_code),
answered AS (
  SELECT * FROM header WHERE expected_departure_time IS NOT NULL AND expected_arrival_time IS NOT NULL)
"""

_DELAY = """CASE variation_status WHEN 'ON TIME' THEN 'On Time'
  WHEN 'EARLY' THEN 'Early by ' || CAST((planned_passenger_timestamp - actual_timestamp) // 60000 AS VARCHAR) || ' minutes'
  WHEN 'LATE' THEN 'Late by ' || CAST((actual_timestamp - planned_passenger_timestamp) // 60000 AS VARCHAR) || ' minutes'
  ELSE 'Train is off route' END"""
_NOTIFIABLE = "((variation_status = 'LATE' AND difference > 900000) OR variation_status = 'OFF ROUTE')"

NOTICE_STATIONS = f"""
spoken AS (
  SELECT stanox_code, COALESCE('[' || crs || ']', '') || ' ' || COALESCE(description, '') AS text
  FROM stanox WHERE stanox_code IS NOT NULL QUALIFY {_MAIN.format(rank=NOTICE_RANK)})
"""
_IN_RANGE = """EXISTS (SELECT 1 FROM {schedules} r WHERE r.schedule_train_id = s.schedule_train_id
    AND r.stanox_code = s.from_stanox_code AND (s.from_stanox_code = l.stanox_code
      OR list_position(r.codes, l.stanox_code) <= list_position(r.codes, s.to_stanox_code)))"""


def _notices(kind: str, log: str, stop: str, subject: str, body: str, extra: str) -> str:
    return f"""
    SELECT '{kind}' AS kind, l.id AS log_id, l.arrival_ms, s.id AS subscriber_id, s.user_id, s.email,
      'Train Delay Helper: {subject}' AS subject, {body} AS body
    FROM {log} l JOIN subscribers s ON s.schedule_train_id = l.schedule_train_id AND s.service_code = l.service_code
      JOIN spoken o ON o.stanox_code = l.origin_stanox_code JOIN spoken a ON a.stanox_code = l.{stop}
    WHERE {extra}"""


_NL = "<br/>' || chr(10) || '"
_DAY = "strftime(l.origin_departure_date, '%d/%m/%Y') || chr(10) || '"
_MOVEMENT_BODY = f"""'Train ID: ' || l.schedule_train_id || '{_NL}Date: ' || {_DAY}Train originated from: ' || o.text
  || ' at ' || substr(l.origin_departure_time, 1, 5) || '{_NL}Station affected: ' || a.text || '{_NL}Operator: ' || l.toc
  || '{_NL}{_NL}Event type: ' || l.event_type || '{_NL}Expected time: ' || substr(l.planned_passenger_time, 1, 5)
  || '{_NL}Actual time: ' || substr(l.actual_time, 1, 5) || '{_NL}Status: ' || {_DELAY} || '<br/>'"""
_CANCEL_BODY = f"""'Train ID: ' || l.schedule_train_id || '{_NL}Date: ' || {_DAY}Train originating from: ' || o.text
  || '{_NL}Expected departure time: ' || substr(l.origin_departure_time, 1, 5) || '{_NL}Cancelled at: ' || a.text
  || '{_NL}Operator: ' || l.toc || '{_NL}{_NL}Cancellation type: ' || l.cancellation_type || '<br/>'"""
_ORIGIN_BODY = f"""'Train ID: ' || l.schedule_train_id || '{_NL}Date: ' || {_DAY}Train originating from: ' || o.text
  || '{_NL}Expected departure time: ' || substr(l.origin_departure_time, 1, 5) || '{_NL}Origin Changed To: ' || a.text
  || '{_NL}Operator: ' || l.toc || '<br/>'"""
_MOVEMENT_NOTICES = _notices(
    "movement", "movement_log", "stanox_code", "Delay Update", _MOVEMENT_BODY,
    _NOTIFIABLE + " AND " + _IN_RANGE.format(schedules="schedule"),
)
_CANCEL_NOTICES = _notices("cancellation", "cancellation_log", "stanox_code", "Cancel Update", _CANCEL_BODY, "true")
_ORIGIN_NOTICES = _notices(
    "change_of_origin", "change_of_origin_log", "new_stanox_code", "Change of Origin Update", _ORIGIN_BODY, "true"
)
NOTICE_PARTS = (*ALL_SCHEDULE, SUBSCRIBERS, *LOGS, NOTICE_STATIONS)

MESSAGES = """
bad AS (
  SELECT DISTINCT seq // 3 AS message FROM records
  WHERE (msg_type = '0002' AND seq % 40 = 1) OR (msg_type = '0003' AND seq % 60 = 2)),
decoded AS (
  SELECT min(arrival_ms) OVER (PARTITION BY seq // 3) AS arrival_ms, seq // 3 AS seq,
    row_number() OVER (PARTITION BY seq // 3 ORDER BY seq) - 1 AS pos,
    records.* EXCLUDE (arrival_ms, seq, pos)
  FROM records WHERE seq // 3 NOT IN (SELECT message FROM bad)),
routed AS (
  SELECT arrival_ms, seq, pos, msg_type,
    CASE WHEN msg_type <> '0005' THEN train_id END AS train_id,
    CASE WHEN msg_type <> '0005' THEN service_code END AS service_code,
    decoded.* EXCLUDE (arrival_ms, seq, pos, msg_type, train_id, service_code)
  FROM decoded)
"""

_WEEKDAY = "lower(strftime({} - 1, '%a'))"

_STORED_LATER = """
changes AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS tiploc_code,
    CASE event_type WHEN 'signup' THEN 'Create' WHEN 'purchase' THEN 'Update' WHEN 'error' THEN 'Delete'
      WHEN 'click' THEN 'Create' ELSE 'Update' END AS op,
    CAST(props->>'$.k' AS INTEGER) AS k
  FROM events),
writes AS (
  SELECT -1 AS event_id, id, tiploc_code, '00003' AS stanox_code, crs, description, primary_entry, 'Create' AS op
  FROM stanox
  UNION ALL
  SELECT event_id, 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0'), tiploc_code,
    CASE WHEN k % 10 <> 9 THEN lpad(CAST(k % 4 AS VARCHAR), 5, '0') END,
    'C' || CAST(event_id % 100 AS VARCHAR), 'event ' || CAST(event_id AS VARCHAR), k % 2 = 0, op
  FROM changes WHERE op <> 'Delete'),
alive AS (
  SELECT w.* FROM writes w WHERE NOT EXISTS (SELECT 1 FROM changes d WHERE d.op = 'Delete'
    AND d.tiploc_code = w.tiploc_code AND d.event_id > w.event_id))
"""

# What a full load of the feed keeps: stations, trains and associations whose records are good creates.
LOADED = (
    STANOX.replace("stanox AS (", "all_stanox AS (", 1),
    """stanox AS (
      SELECT * FROM (SELECT *, CAST(tiploc_code AS BIGINT) AS s FROM all_stanox)
      WHERE s % 7 <> 4 AND NOT (s % 7 <> 3 AND s % 19 = 6) AND s % 17 <> 9)""",
    TRAINS,
    STOPS,
    SCHEDULE.replace("schedule AS (", "all_schedule AS (", 1),
    "schedule AS (SELECT * FROM all_schedule WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 100 NOT IN (33, 77))",
    ASSOCIATION.replace("association AS (", "all_association AS (", 1),
    "association AS (SELECT * FROM all_association WHERE o_orderstatus <> 'P')",
)

ORACLES: dict[str, str] = {
    "decode_props": """
        SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k,
          CASE WHEN event_id % 3 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k_or_null,
          CAST(NULL AS BIGINT) AS not_a_number
        FROM events""",
    "feed_kinds": _with(
        *ALL_FEED, body="SELECT kind, op, reject_reason, count(*) AS records FROM f_all GROUP BY ALL"
    ),
    "feed_rejects": _with(
        *ALL_FEED, body="SELECT seq, kind, reject_reason FROM f_all WHERE reject_reason IS NOT NULL"
    ),
    "feed_prefilter": _with(
        *ALL_FEED,
        body="""
        SELECT seq FROM f_tiploc WHERE stanox_code = '00001'
        UNION ALL SELECT seq FROM f_schedule WHERE o_orderkey = 1""",
    ),
    "decode_tiplocs": _with(
        *ALL_FEED,
        body=f"""
        SELECT seq, op, tiploc_code, stanox_code, crs, description,
          CASE WHEN stanox_code IS NOT NULL THEN (stanox_code, tiploc_code) IN (VALUES {_PREFERRED}) END AS primary_entry
        FROM f_tiploc WHERE op <> 'Replace' AND tiploc_code IS NOT NULL""",
    ),
    "decode_schedules": _with(
        STANOX, TRAINS, STOPS, ASSOCIATION, FEED,
        body="""
        SELECT f.seq, op, f.schedule_train_id, service_code, stp_indicator, 'OO' AS train_category,
          'P' AS train_status, atoc_code, days_run, schedule_start, schedule_end, locations
        FROM f_schedule f JOIN (
          SELECT schedule_train_id, string_agg(location_type || '/' || tiploc_code || '/' ||
            COALESCE(arrival_time, '-') || '/' || COALESCE(departure_time, '-'), ',' ORDER BY n) AS locations
          FROM stops GROUP BY 1) l ON l.schedule_train_id = f.schedule_train_id
        WHERE op <> 'Update' AND (op = 'Delete' OR days_run <> '11111')""",
    ),
    "decode_associations": _with(
        *ALL_FEED,
        body="""
        SELECT seq, op, main_schedule_train_id, associated_schedule_train_id, associated_start,
          associated_end, stp_indicator, location, days_run, association_category
        FROM f_association""",
    ),
    "association_rows": _with(
        *ALL_FEED,
        body=f"""
        SELECT seq, main_schedule_train_id, associated_schedule_train_id, associated_start,
          associated_end, stp_indicator, location, {_FLAGS}, days_run_pattern, association_category
        FROM f_association WHERE op = 'Create'""",
    ),
    "days_pattern": _with(
        TRAINS,
        body=f"""
        SELECT seq, {_FLAGS}, {_PATTERN} AS pattern, {_PATTERN} AS pattern_of_flags
        FROM trains WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    ),
    "flatten_stops": _with(
        *ALL_SCHEDULE,
        body=f"""
        SELECT id, schedule_train_id, service_code, stp_indicator, atoc_code, stop_sequence, stanox_code,
          array_to_string(codes, ',') AS subsequent_stanox_codes,
          array_to_string(times, ',') AS subsequent_arrival_times, {', '.join(DAY_COLUMNS)},
          days_run_pattern, schedule_start, schedule_end, location_type, arrival_time, departure_time
        FROM schedule""",
    ),
    "stanox_main": _with(
        STANOX, body=f"SELECT * FROM stanox WHERE crs IS NOT NULL QUALIFY {_MAIN.format(rank=MAIN_RANK)}"
    ),
    "stanox_main_notices": _with(
        STANOX,
        body=f"SELECT * FROM stanox WHERE stanox_code IS NOT NULL QUALIFY {_MAIN.format(rank=NOTICE_RANK)}",
    ),
    "stanox_complete": _with(
        STANOX, body="SELECT * FROM stanox WHERE crs IS NOT NULL AND stanox_code IS NOT NULL"
    ),
    "stanox_crs": _with(STANOX, CRS, body="SELECT * FROM crs_of"),
    "stanox_lookup": _with(
        STANOX,
        body="""
        SELECT *, 'stanox' AS asked FROM stanox WHERE stanox_code = '00001'
        UNION ALL SELECT *, 'tiploc' FROM stanox WHERE tiploc_code = '7'""",
    ),
    "tiploc_map": _with(
        STANOX,
        body="SELECT tiploc_code, arg_max(stanox_code, id) AS stanox_code FROM stanox WHERE stanox_code IS NOT NULL GROUP BY 1",
    ),
    "distinct_stops": _with(*ALL_SCHEDULE, body="SELECT DISTINCT stanox_code FROM schedule"),
    "stations": _with(
        *ALL_SCHEDULE,
        body=f"""
        SELECT stanox_code AS key, COALESCE(description, '') || ' [' || COALESCE(crs, '') || ']' AS value
        FROM stanox x WHERE crs IS NOT NULL AND EXISTS (SELECT 1 FROM schedule s WHERE s.stanox_code = x.stanox_code)
        QUALIFY {_MAIN.format(rank=MAIN_RANK)}""",
    ),
    "schedule_lookup": _with(
        *ALL_SCHEDULE,
        body=f"""
        SELECT 'train' AS asked, id, schedule_train_id, stanox_code, stop_sequence FROM schedule WHERE o_orderkey % 10 = 1
        UNION ALL
        SELECT 'train and stop', id, schedule_train_id, stanox_code, stop_sequence FROM schedule WHERE stanox_code = {_pad('o_orderkey % 10', 5)}
        UNION ALL
        SELECT 'id', id, schedule_train_id, stanox_code, stop_sequence FROM schedule WHERE o_orderkey % 7 = 1 AND stop_sequence <= 2""",
    ),
    "schedule_search": _with(
        *ALL_SCHEDULE, SUBSCRIBERS, CRS, NAMES,
        "req AS (SELECT '00001' AS f, '00002' AS t, 'Weekdays' AS p)",
        f"answers AS ({_answers('schedule', 'Primary', 'req')})",
        body=f"SELECT {_SHOWN.format(subscribed=_HELD.format(user=chr(39) + '1' + chr(39)))} FROM answers a {_NAMED} WHERE a.departure_time IS NOT NULL",
    ),
    "search_subscribed": _with(
        *ALL_SCHEDULE, SUBSCRIBERS, CRS, NAMES,
        """asks AS (SELECT from_stanox_code AS f, to_stanox_code AS t, days_run_pattern AS p, user_id FROM subscribers
          UNION ALL SELECT from_stanox_code, to_stanox_code, days_run_pattern, 'x' || user_id FROM subscribers WHERE right(user_id, 1) = '1')""",
        "req AS (SELECT DISTINCT f, t, p FROM asks)",
        f"answers AS ({_answers('schedule', 'Primary', 'req')})",
        "users AS (SELECT DISTINCT * FROM asks)",
        f"shown AS (SELECT u.user_id, a.id, {_HELD.format(user='u.user_id')} AS subscribed "
        "FROM answers a JOIN users u ON u.f = a.from_stanox_code AND u.t = a.to_stanox_code AND u.p = a.days_run_pattern "
        "JOIN names ON code = atoc_code WHERE a.departure_time IS NOT NULL)",
        body="""SELECT user_id, subscribed, CASE WHEN subscribed THEN 'Y' ELSE 'N' END AS subscribed_flag, count(*) AS trains,
          min(id) AS first_id FROM shown GROUP BY ALL""",
    ),
    "search_primary_secondary": _with(
        *ALL_SCHEDULE, ASSOCIATION, MATCH, STITCH, CRS, NAMES,
        "req AS (SELECT '00001' AS f, '00002' AS t, 'Saturdays' AS p)",
        "usable AS (SELECT * FROM secondary WHERE atoc_code IS NOT NULL)",
        f"one AS (SELECT * FROM ({_answers('schedule', 'Primary', 'req')}) WHERE departure_time IS NOT NULL AND atoc_code IN (SELECT code FROM names))",
        f"two AS (SELECT * FROM ({_answers('usable', 'Secondary', 'req')}) WHERE departure_time IS NOT NULL)",
        """answers AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM one
          WHERE one.from_stanox_code = two.from_stanox_code AND one.departure_time = two.departure_time
            AND one.to_stanox_code = two.to_stanox_code AND one.arrival_time = two.arrival_time))""",
        body=f"SELECT {_SHOWN.format(subscribed='false')} FROM answers a {_NAMED}",
    ),
    "schedule_search_requests": _with(
        *ALL_SCHEDULE, SUBSCRIBERS, CRS, NAMES,
        f"""asks AS (SELECT {_pad('n_nationkey % 10', 5)} AS f, {_pad('n_nationkey % 7', 5)} AS t,
          CASE WHEN n_nationkey % 2 = 0 THEN 'Weekdays' ELSE 'Sundays' END AS p,
          CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS VARCHAR) END AS user_id FROM nation)""",
        "req AS (SELECT DISTINCT f, t, p FROM asks)",
        f"answers AS ({_answers('schedule', 'Primary', 'req')})",
        "users AS (SELECT DISTINCT * FROM asks)",
        body=f"""
        SELECT u.user_id, {_SHOWN.format(subscribed=_HELD.format(user='u.user_id'))}
        FROM answers a JOIN users u ON u.f = a.from_stanox_code AND u.t = a.to_stanox_code AND u.p = a.days_run_pattern
        {_NAMED} WHERE a.departure_time IS NOT NULL""",
    ),
    "pending_associations": _with(
        ASSOCIATION,
        body="""
        SELECT id, main_schedule_train_id, associated_schedule_train_id, association_category
        FROM association WHERE association_category <> 'NP' AND association_category IS NOT NULL
          AND id NOT IN (SELECT id FROM association WHERE o_orderstatus = 'F')""",
    ),
    "association_lookup": _with(
        ASSOCIATION, body="SELECT id FROM association WHERE CAST(main_schedule_train_id AS BIGINT) % 3 <> 0"
    ),
    "association_match": _with(
        *ALL_SCHEDULE, ASSOCIATION, MATCH,
        body="SELECT DISTINCT association_id, leg, schedule_train_id, schedule_start FROM chosen",
    ),
    "join_stitch": _stitched("JJ"),
    "divide_stitch": _stitched("VV"),
    "decode_messages": _with(RECORDS, MESSAGES, body="SELECT * FROM routed"),
    "landed_messages": _with(
        RECORDS, MESSAGES,
        body="""
        SELECT seq, pos, msg_type, train_id, NULL AS reject_reason FROM routed
        UNION ALL SELECT message, NULL, NULL, NULL, 'bad_element' FROM bad""",
    ),
    "message_rejects": _with(
        RECORDS, MESSAGES, body="SELECT message AS seq, 'bad_element' AS reject_reason FROM bad"
    ),
    "route_counts": _with(
        RECORDS, MESSAGES, body="SELECT msg_type, count(*) AS records FROM routed GROUP BY 1"
    ),
    "unhandled_records": _with(
        RECORDS, MESSAGES, body="SELECT seq, pos, msg_type FROM routed WHERE msg_type = '0005'"
    ),
    "route_counts_per_minute": _with(
        RECORDS,
        body="SELECT arrival_ms // 60000 * 60000 AS minute, msg_type, count(*) AS records FROM records GROUP BY 1, 2",
    ),
    "utc_parts": _with(
        RECORDS,
        body=f"""
        SELECT seq, {_date('arrival_ms')} AS day, {_time('arrival_ms')} AS time,
          arrival_ms - planned_passenger_timestamp AS difference,
          CAST(trunc((arrival_ms - planned_passenger_timestamp) / 60000.0) AS BIGINT) AS minutes,
          {_minutes("'12:00'", _time('arrival_ms'))} AS from_noon,
          {_WEEKDAY.format(_date('arrival_ms'))} AS yesterday
        FROM records""",
    ),
    "activation_latest": _with(
        RECORDS,
        body="""
        SELECT train_id, seq, schedule_train_id, origin_stanox_code, origin_departure_timestamp
        FROM records WHERE msg_type = '0001'
        QUALIFY row_number() OVER (PARTITION BY train_id ORDER BY arrival_ms DESC, seq DESC) = 1""",
    ),
    "activation_asof": _with(
        RECORDS, ENRICHED,
        body="SELECT seq, msg_type, train_id, schedule_train_id, origin_stanox_code, origin_departure_timestamp FROM enriched",
    ),
    "movement_log": _with(RECORDS, ENRICHED, MOVEMENTS, body="SELECT * FROM movement_log"),
    "cancel_log": _with(RECORDS, ENRICHED, CANCELLATIONS, body="SELECT * FROM cancellation_log"),
    "origin_log": _with(RECORDS, ENRICHED, ORIGINS, body="SELECT * FROM change_of_origin_log"),
    "movement_history": _with(
        RECORDS, ENRICHED, MOVEMENTS, WINDOWS,
        body=_in_windows("movement_log", "stanox_code", "stanox_code IN ('00001', '00002', '00003')"),
    ),
    "cancel_history": _with(RECORDS, ENRICHED, CANCELLATIONS, WINDOWS, body=_in_windows("cancellation_log", "stanox_code")),
    "origin_history": _with(RECORDS, ENRICHED, ORIGINS, WINDOWS, body=_in_windows("change_of_origin_log", "new_stanox_code")),
    "one_train_history": _with(
        RECORDS, ENRICHED, MOVEMENTS, CANCELLATIONS,
        body=f"""
        SELECT id, stanox_code FROM movement_log WHERE schedule_train_id = '7' AND origin_departure_timestamp BETWEEN {_W0} AND {_W1}
        UNION ALL
        SELECT id, stanox_code FROM cancellation_log WHERE schedule_train_id = '7' AND origin_departure_timestamp BETWEEN {_W0} AND {_W1}""",
    ),
    "delay_texts": _with(
        RECORDS, ENRICHED, MOVEMENTS,
        body=f"SELECT id, {_DELAY} AS delay_text, {_words('CAST(trunc(difference / 60000.0) AS BIGINT)')} AS difference_text FROM movement_log",
    ),
    "history_header": _with(
        *ALL_SCHEDULE, SUBSCRIBERS, CRS, HEADER, body="SELECT * FROM answered"
    ),
    "history_pairs": _with(*LOGS, PAIRS, _pairs("asked"), body="SELECT * FROM pairs"),
    "history_cancel": _with(*LOGS, PAIRS, _pairs("asked"), body="SELECT * FROM days"),
    "history_display": _with(*LOGS, PAIRS, _pairs("asked"), body=DISPLAY),
    "history_batch": _with(
        *ALL_SCHEDULE, SUBSCRIBERS, CRS, HEADER, *LOGS,
        """asked AS (SELECT schedule_train_id, from_stanox_code, to_stanox_code, 0 AS from_ts,
          9223372036854775807 AS to_ts, expected_departure_time AS dep, expected_arrival_time AS arr
          FROM answered)""",
        _pairs("asked"),
        body=DISPLAY,
    ),
    "notifiable": _with(
        RECORDS, ENRICHED, MOVEMENTS,
        body=f"SELECT id, schedule_train_id, variation_status, difference, {_DELAY} AS delay_text FROM movement_log WHERE {_NOTIFIABLE}",
    ),
    "route_subscribers": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        body="""
        SELECT l.id AS log_id, s.id AS subscriber_id FROM schedule l JOIN subscribers s
          ON s.schedule_train_id = l.schedule_train_id AND s.service_code = l.service_code""",
    ),
    "range_subscribers": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        body=f"""
        SELECT l.id AS log_id, s.id AS subscriber_id FROM schedule l JOIN subscribers s
          ON s.schedule_train_id = l.schedule_train_id AND s.service_code = l.service_code
        WHERE {_IN_RANGE.format(schedules='schedule')}""",
    ),
    "watched_stops": _with(
        *ALL_SCHEDULE, SUBSCRIBERS, ASSOCIATION, MATCH, STITCH,
        """every AS (
          SELECT schedule_train_id, stanox_code, codes FROM schedule
          UNION ALL SELECT schedule_train_id, stanox_code, codes FROM secondary WHERE atoc_code IS NOT NULL)""",
        body="""
        SELECT DISTINCT s.id, unnest(list_prepend(s.from_stanox_code,
          COALESCE(r.codes[1:COALESCE(list_position(r.codes, s.to_stanox_code), 0)], []))) AS stanox_code
        FROM subscribers s JOIN every r ON r.schedule_train_id = s.schedule_train_id
          AND r.stanox_code = s.from_stanox_code""",
    ),
    "subscriber_lookup": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        "held AS (SELECT *, CAST(schedule_train_id AS BIGINT) AS k FROM subscribers)",
        body=f"""
        SELECT 'train' AS asked, id, user_id FROM held WHERE k % 2 = 0
        UNION ALL SELECT 'user', id, user_id FROM held WHERE CAST(user_id AS BIGINT) % 2 = 0
        UNION ALL SELECT 'user and id', id, user_id FROM held h WHERE EXISTS (SELECT 1 FROM orders
          WHERE CAST(o_custkey AS VARCHAR) = h.user_id AND {_pad('o_orderkey + o_orderkey % 3')} = h.id)
        UNION ALL SELECT 'id', id, user_id FROM held WHERE k % 7 = 1""",
    ),
    "notifications": _with(*NOTICE_PARTS, body=_MOVEMENT_NOTICES),
    "cancel_notifications": _with(*NOTICE_PARTS, body=_CANCEL_NOTICES),
    "origin_notifications": _with(*NOTICE_PARTS, body=_ORIGIN_NOTICES),
    "notice_counts": _with(
        *NOTICE_PARTS,
        body=f"""
        SELECT arrival_ms // 60000 * 60000 AS minute, kind, count(*) AS notices
        FROM ({_CANCEL_NOTICES}) GROUP BY 1, 2""",
    ),
    "preferred_tiplocs": f"""
        WITH pairs(stanox, tiploc) AS (VALUES {_PREFERRED}), numbered AS (SELECT *, row_number() OVER () - 1 AS n FROM pairs)
        SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 5 THEN (a.stanox, b.tiploc) IN (SELECT (stanox, tiploc) FROM pairs) END AS primary_entry
        FROM supplier JOIN numbered a ON a.n = s_suppkey % 19
          JOIN numbered b ON b.n = (CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 ELSE s_suppkey END) % 19""",
    "load_schedule": _with(
        *LOADED,
        body="""
        SELECT schedule_train_id, CASE WHEN o_orderkey % 8 = 0 THEN 'NEW' ELSE 'OO' END AS train_category, stop_sequence,
          stanox_code, len(codes) AS later_stops
        FROM schedule WHERE o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0""",
    ),
    "load_combined": _with(
        *LOADED, MATCH, STITCH,
        body="""
        SELECT a.main_schedule_train_id, a.association_category, s.schedule_train_id, s.stop_sequence, s.stanox_code
        FROM association a LEFT JOIN (SELECT * FROM secondary WHERE atoc_code IS NOT NULL) s ON s.association_id = a.id
        WHERE CAST(a.main_schedule_train_id AS BIGINT) % 4 <> 0""",
    ),
    "feed_fold_stanox": _with(
        STANOX, _STORED_LATER,
        body="""
        SELECT first_value(id) OVER w AS id, tiploc_code, stanox_code, crs, description, primary_entry
        FROM alive WHERE stanox_code IS NOT NULL
        WINDOW w AS (PARTITION BY tiploc_code, stanox_code ORDER BY event_id)
        QUALIFY row_number() OVER (PARTITION BY tiploc_code, stanox_code
          ORDER BY CASE op WHEN 'Update' THEN 0 ELSE 1 END,
            CASE op WHEN 'Update' THEN -event_id ELSE event_id END) = 1
        UNION ALL
        SELECT id, tiploc_code, stanox_code, crs, description, primary_entry FROM alive WHERE stanox_code IS NULL""",
    ),
    "feed_fold_schedule": _with(
        *ALL_SCHEDULE,
        body="""
        SELECT CASE WHEN days_run_pattern = 'Weekdays' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
            THEN '#' || id ELSE id END AS id,
          schedule_train_id,
          CASE WHEN days_run_pattern = 'Weekdays' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
            THEN 'STORED' ELSE 'OO' END AS train_category,
          stop_sequence, stanox_code
        FROM schedule WHERE o_orderpriority <> '1-URGENT'""",
    ),
    "feed_fold_association": _with(
        ASSOCIATION,
        body="""
        SELECT CASE WHEN o_orderstatus = 'O' AND association_category IS NOT NULL THEN '#' || id ELSE id END AS id,
          main_schedule_train_id, association_category, days_run_pattern
        FROM association WHERE association_category IS DISTINCT FROM 'VV'
        UNION ALL
        SELECT '#' || id, main_schedule_train_id, association_category, days_run_pattern
        FROM association WHERE association_category IS NULL AND o_orderstatus = 'O'""",
    ),
    "subscribe_dedupe": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        body="""
        SELECT 'a' || s.id AS id, s.user_id, s.email, s.schedule_train_id, s.service_code,
          s.from_stanox_code, s.to_stanox_code
        FROM subscribers s WHERE right(s.id, 1) <> '3'
          AND NOT EXISTS (SELECT 1 FROM subscribers h WHERE h.days_run_pattern = 'Sundays'
            AND h.user_id = s.user_id AND h.schedule_train_id = s.schedule_train_id
            AND h.service_code = s.service_code AND h.from_stanox_code = s.from_stanox_code
            AND h.to_stanox_code = s.to_stanox_code)""",
    ),
    "subscribe_refused": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        body="""
        SELECT p || id AS seq, user_id, 'Primary' AS record_type, id || '-0000099999' AS record_id,
          'unknown_schedule' AS reject_reason
        FROM subscribers, (VALUES ('a'), ('b')) v(p) WHERE right(id, 1) = '3'""",
    ),
    "unsubscribe_remaining": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        body="""
        SELECT id, user_id FROM subscribers WHERE id NOT IN (
          SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') FROM orders WHERE o_orderpriority = '1-URGENT')""",
    ),
    "unsubscribe_refused": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        """wishes AS (
          SELECT CAST(o_custkey AS VARCHAR) AS user_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id
          FROM orders WHERE o_orderpriority = '1-URGENT'
          UNION ALL
          SELECT CAST(o_custkey + 1 AS VARCHAR), lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
          FROM orders WHERE o_orderpriority = '5-LOW')""",
        body="""
        SELECT user_id, id, 'not_the_holder' AS reject_reason FROM wishes w
        WHERE NOT EXISTS (SELECT 1 FROM subscribers s WHERE s.id = w.id AND s.user_id = w.user_id)""",
    ),
    "subscriptions": _with(
        *ALL_SCHEDULE, SUBSCRIBERS,
        body="""
        SELECT id, schedule_train_id, service_code, from_stanox_code, from_crs, departure_time,
          to_stanox_code, to_crs, arrival_time, days_run_pattern FROM subscribers""",
    ),
}
