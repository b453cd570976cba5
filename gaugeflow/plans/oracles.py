"""The registered queries as DuckDB SQL over the same tables, written from the rules of ``inputs``."""

from __future__ import annotations

from gaugeflow.plans.queries import LATEST_N, LOOKUP, RATE_LIMIT, RATE_WINDOW_S
from gaugeflow.plans.stream_queries import LATE_CUTS_MS, LATE_EVERY

_EVENTS = """
ev AS (
  SELECT event_id AS e, user_id, event_type, value AS amount, CAST(value AS DECIMAL(18,2)) AS value,
         json_extract_string(props, '$.k') AS k, epoch_us(ts) // 1000 AS ms,
         '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
         '00000000-0000-4000-8001-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS device
  FROM events
)"""

# Body of a request or message as text; {value} is the number to print, {id} an optional first field.
_BODY = """
  '{{' || {id} || '"deviceId":"' || CASE WHEN e % 43 = 0 THEN substr(device, 1, 33) || 'xyz' ELSE device END
  || '","eventType":"' || {kind} || '","value":'
  || CASE WHEN e % 41 = 0 THEN '"' || CAST({value} AS VARCHAR) || '"' ELSE CAST({value} AS VARCHAR) END
  || ',"timestamp":' || CAST(ms AS VARCHAR) || ',"metadata":{{"k":' || k || '}}}}'"""

_LOG = f"""
{_EVENTS},
base AS (
  SELECT *, 1 + (e * 7919) % 6000 AS duration_ms,
         ms + CASE e % 23 WHEN 0 THEN 300001 WHEN 1 THEN 300000 WHEN 2 THEN -300000 WHEN 3 THEN -300001
                          ELSE 1000 END AS sent_ms,
         CASE WHEN e % 53 = 0 THEN '/metrics' WHEN e % 53 = 1 THEN '/health' ELSE '/v1/events' END AS route,
         CASE WHEN e % 59 = 0 THEN 500 ELSE 202 END AS handler_status
  FROM ev
),
sends AS (
  SELECT *, e AS request_id, sent_ms AS received_at_ms FROM base
  UNION ALL SELECT *, e + 1000000000, sent_ms + duration_ms // 2 FROM base WHERE e % 17 = 0 AND duration_ms >= 2
  UNION ALL SELECT *, e + 2000000000, sent_ms + duration_ms + 5000 FROM base WHERE e % 13 = 0
  UNION ALL SELECT *, e + 3000000000, sent_ms + duration_ms + 86400000 FROM base WHERE e % 19 = 0
),
log AS (
  SELECT *, CASE WHEN e % 31 <> 0 THEN user_id % 10 END AS grp,
         CASE WHEN e % 29 > 1 THEN id END AS run_key,
         concat_ws(',', CASE WHEN e % 43 = 0 THEN 'deviceId' END, CASE WHEN e % 37 = 0 THEN 'eventType' END,
                   CASE WHEN e % 41 = 0 THEN 'value' END,
                   CASE WHEN abs(received_at_ms - ms) > 300000 THEN 'timestamp' END) AS bad_fields
  FROM sends
)"""

# State machine over the runs of a key; {rows} provides key, request_id, received_at_ms, duration_ms, status.
_RUNS = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY received_at_ms, request_id) AS rn FROM {rows}
),
state AS (
  SELECT run_key, rn, request_id, 'EXECUTE' AS outcome, request_id AS x_id, received_at_ms AS x_start,
         received_at_ms + duration_ms AS x_end, run_status AS x_status, bad_fields AS x_fields
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT run_key, rn, request_id, outcome,
         CASE WHEN outcome = 'EXECUTE' THEN request_id ELSE x_id END,
         CASE WHEN outcome = 'EXECUTE' THEN received_at_ms ELSE x_start END,
         CASE WHEN outcome = 'EXECUTE' THEN received_at_ms + duration_ms ELSE x_end END,
         CASE WHEN outcome = 'EXECUTE' THEN run_status ELSE x_status END,
         CASE WHEN outcome = 'EXECUTE' THEN bad_fields ELSE x_fields END
  FROM (
    SELECT o.*, s.x_id, s.x_start, s.x_end, s.x_status, s.x_fields,
           CASE WHEN o.received_at_ms < s.x_end AND o.received_at_ms - s.x_start < 10000 THEN 'CONFLICT'
                WHEN o.received_at_ms < s.x_end THEN 'EXECUTE'
                WHEN s.x_status BETWEEN 200 AND 499 AND o.received_at_ms - s.x_end < 86400000 THEN 'REPLAY'
                ELSE 'EXECUTE' END AS outcome
    FROM state s JOIN ordered o ON o.run_key = s.run_key AND o.rn = s.rn + 1
  )
)"""

_ADMISSION = f"""
WITH RECURSIVE {_LOG},
gated AS (
  SELECT *,
         CASE WHEN bad_fields <> '' THEN 400 ELSE handler_status END AS run_status,
         CASE WHEN e % 47 = 0 THEN 'malformed_json' WHEN grp IS NULL THEN 'missing_api_key'
              WHEN grp = 7 THEN 'invalid_api_key' WHEN grp = 3 THEN 'deactivated_api_key'
              WHEN e % 29 = 0 THEN 'missing_idempotency_key'
              WHEN e % 29 = 1 THEN 'invalid_idempotency_key' END AS refusal
  FROM log WHERE route = '/v1/events'
),
eligible AS (SELECT * FROM gated WHERE refusal IS NULL),
{_RUNS.format(rows="eligible")},
admitted AS (
  SELECT g.*, s.outcome, s.x_id, s.x_status, s.x_fields,
         CASE WHEN refusal LIKE '%api_key' THEN 401 WHEN refusal IS NOT NULL THEN 400
              WHEN outcome = 'CONFLICT' THEN 409 WHEN outcome = 'REPLAY' THEN x_status
              ELSE g.run_status END AS status_code,
         CASE WHEN refusal IS NOT NULL THEN refusal
              WHEN outcome = 'CONFLICT' THEN 'in_progress' WHEN outcome = 'REPLAY' THEN 'replayed'
              WHEN g.run_status = 202 THEN 'accepted' WHEN g.run_status = 400 THEN 'validation_failed'
              ELSE 'handler_failed' END AS reason
  FROM gated g LEFT JOIN state s ON s.request_id = g.request_id
)"""

_CLIENT_ID = "'00000000-0000-4000-8002-' || lpad(CAST(grp AS VARCHAR), 12, '0')"

_PAYLOAD = f"{_ADMISSION}, payload AS (SELECT * FROM admitted WHERE reason = 'accepted')"

_MESSAGE_TEXT = _BODY.format(
    id="'\"id\":\"' || id || '\",'",
    kind="CASE WHEN e % 37 = 0 THEN repeat('x', 51) ELSE event_type END",
    value="(amount + copy)",
)
# The message builder puts the id first and drops nothing.
_MESSAGES = f"""
WITH {_EVENTS},
copies AS (
  SELECT *, 0 AS copy, e AS topic_offset FROM ev
  UNION ALL SELECT *, 1, e + 1000000000 FROM ev WHERE e % 11 = 0
),
messages AS (
  SELECT *, CASE WHEN e % 47 = 0 THEN 'not json' ELSE {_MESSAGE_TEXT} END AS text,
         CASE WHEN e % 47 = 0 THEN 'not a JSON object' WHEN e % 43 = 0 THEN 'device_id is not a UUID'
              WHEN e % 37 = 0 THEN 'event_type is too long' END AS reason
  FROM copies
)"""

_FIRST = f"{_MESSAGES}, firsts AS (SELECT * FROM messages WHERE reason IS NULL AND copy = 0)"

_HISTOGRAM_BOUNDS = ((10, "0.01"), (50, "0.05"), (100, "0.1"), (200, "0.2"), (500, "0.5"),
                     (1000, "1"), (2000, "2"), (5000, "5"), (None, "+Inf"))
_HISTOGRAM_ROWS = ", ".join(
    f"({'9e15' if ms is None else ms}, '{le}')" for ms, le in _HISTOGRAM_BOUNDS
)

# One decimal of a two-decimal value: only .x5 can be a tie, and of those only .25 and .75 are exact in binary.
_ONE_DECIMAL = """CASE WHEN CAST(value * 100 AS BIGINT) % 50 = 25 THEN printf('%.1f', CAST(round(value, 1) AS DOUBLE))
            ELSE printf('%.1f', amount) END"""

_CARD_MEAN = "(CAST(sum(value) FILTER (event_type = '{t}') AS DOUBLE) / count(*) FILTER (event_type = '{t}'))"

_AVG = "CAST(sum(value) AS DOUBLE) / count(value)"

_WINDOWS = f"""
WITH {_EVENTS},
spread AS (
  SELECT ev.*, make_timestamp((ms - ms % 60000 - k.n * 60000) * 1000) AS window_start
  FROM ev, (VALUES (0), (1), (2), (3), (4)) k(n)
),
stats AS (
  SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, event_type AS "eventType",
         {_AVG} AS avg_value, CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value,
         count(id) AS event_count
  FROM spread GROUP BY window_start, event_type
)"""

# Bodies of unusual requests: what is wrong with each, and whether it can be stored as a message (it has no id).
_UNUSUAL = f"""
WITH {_EVENTS},
cases AS (
  SELECT *, e % 12 AS c, user_id % 3 AS grp FROM ev
)"""

BATCH_ORACLES: dict[str, str] = {
    "active_requests_peak": f"""
WITH {_LOG},
changes AS (
  SELECT received_at_ms AS at_ms, 1 AS change FROM log WHERE route = '/v1/events'
  UNION ALL SELECT received_at_ms + duration_ms, -1 FROM log WHERE route = '/v1/events'
),
per_ms AS (SELECT at_ms, sum(change) AS change FROM changes GROUP BY at_ms)
SELECT at_ms, CAST(sum(change) OVER (ORDER BY at_ms) AS BIGINT) AS active_requests FROM per_ms
ORDER BY active_requests DESC, at_ms LIMIT 1""",
    "admission_unusual": f"""
{_UNUSUAL}
SELECT e AS request_id, CASE WHEN c = 0 THEN 413 WHEN c IN (1, 2, 3, 4, 5, 6) THEN 400 ELSE 202 END AS status_code,
       CASE WHEN c = 0 THEN 'payload_too_large' WHEN c IN (1, 2, 3, 4, 5, 6) THEN 'validation_failed' ELSE 'accepted' END AS reason,
       CASE c WHEN 1 THEN 'timestamp' WHEN 2 THEN 'timestamp,timestamp' WHEN 3 THEN 'metadata' WHEN 4 THEN 'metadata.a,metadata.c'
              WHEN 5 THEN 'metadata' WHEN 6 THEN 'deviceId,eventType,value,timestamp' ELSE '' END AS error_fields
FROM cases""",
    "dlq_unusual": f"""
{_UNUSUAL},
texts AS (
  SELECT *, '{{"deviceId":"' || device || '","eventType":"' || event_type || '","value":1,"timestamp":' AS head FROM cases
)
SELECT CAST(e AS VARCHAR) AS key,
       CASE WHEN e % 24 = 18 THEN NULL ELSE
         CASE c WHEN 0 THEN head || ms || ',"pad":"' || repeat('p', 10240) || '"}}' WHEN 1 THEN head || ms || '.5}}'
                WHEN 2 THEN head || '-' || ms || '}}' WHEN 3 THEN head || ms || ',"metadata":null}}'
                WHEN 4 THEN head || ms || ',"metadata":{{"a":[1],"b":"x","c":null}}}}' WHEN 5 THEN head || ms || ',"metadata":[1]}}'
                WHEN 6 THEN '' WHEN 7 THEN head || ms || ',"metadata":{{"a":1,"b":true}}}}' ELSE head || ms || '}}' END END AS value,
       CASE WHEN c = 6 THEN 'empty message' ELSE 'id is not a UUID' END AS reason
FROM texts""",
    "sliding_window_stats": f"{_WINDOWS} SELECT * FROM stats",
    "type_stats": f"""
WITH {_EVENTS}
SELECT event_type AS "eventType", {_AVG} AS avg_value, CAST(min(value) AS DOUBLE) AS min_value,
       CAST(max(value) AS DOUBLE) AS max_value, count(id) AS event_count
FROM ev GROUP BY event_type""",
    "events_scan": f"""
WITH {_EVENTS}
SELECT id, device AS device_id, event_type, CAST(value AS DOUBLE) AS value, ms AS "timestamp" FROM ev""",
    "parse_events": f"""
{_MESSAGES}
SELECT CASE WHEN e % 47 <> 0 THEN id END AS id,
       CASE WHEN e % 47 <> 0 THEN CASE WHEN e % 43 = 0 THEN substr(device, 1, 33) || 'xyz' ELSE device END END
         AS "deviceId",
       CASE WHEN e % 47 <> 0 THEN CASE WHEN e % 37 = 0 THEN repeat('x', 51) ELSE event_type END END AS "eventType",
       CASE WHEN e % 47 <> 0 AND e % 41 <> 0 THEN amount + copy END AS value,
       CASE WHEN e % 47 <> 0 THEN ms END AS "timestamp",
       CASE WHEN e % 47 <> 0 THEN k END AS metadata_k
FROM messages""",
    "event_time": f"WITH {_EVENTS} SELECT id, make_timestamp(ms * 1000) AS event_time FROM ev",
    "device_type_lookup": f"""
WITH {_EVENTS}
SELECT id, device AS device_id, event_type, CAST(value AS DOUBLE) AS value, ms AS "timestamp" FROM ev
WHERE device = '{LOOKUP["device_id"]}' AND event_type = '{LOOKUP["event_type"]}'
  AND ms >= {LOOKUP["from_ms"]} AND ms < {LOOKUP["to_ms"]}""",
    "latest_events": f"""
WITH {_EVENTS}
SELECT id, device AS device_id, event_type, CAST(value AS DOUBLE) AS value, ms AS "timestamp" FROM ev
ORDER BY ms DESC, id LIMIT {LATEST_N}""",
    "client_lookup": f"""
WITH {_LOG}
SELECT request_id, CASE WHEN grp <> 7 THEN {_CLIENT_ID} END AS client_id,
       CASE WHEN grp <> 7 THEN 'Client ' || CAST(grp AS VARCHAR) END AS client_name,
       CASE WHEN grp <> 7 THEN grp <> 3 END AS client_active
FROM log""",
    "validation_errors": f"""
WITH {_LOG}, parsed AS (SELECT * FROM log WHERE e % 47 <> 0)
SELECT request_id, 'deviceId' AS field, 'deviceId must be a valid UUID v4' AS message FROM parsed WHERE e % 43 = 0
UNION ALL
SELECT request_id, 'eventType', 'Too small: expected string to have >=2 characters' FROM parsed WHERE e % 37 = 0
UNION ALL
SELECT request_id, 'value', 'Invalid input: expected number, received string' FROM parsed WHERE e % 41 = 0
UNION ALL
SELECT request_id, 'timestamp', 'Timestamp must be within 5 minutes of server time (clock drift check)'
FROM parsed WHERE abs(received_at_ms - ms) > 300000""",
    "admission": f"""
{_ADMISSION}
SELECT request_id,
       CASE WHEN grp <> 7 THEN {_CLIENT_ID} END AS client_id,
       CASE WHEN grp <> 7 THEN 'Client ' || CAST(grp AS VARCHAR) END AS client_name,
       status_code, reason, x_id AS source_request_id,
       CASE WHEN outcome IN ('EXECUTE', 'REPLAY') THEN x_fields ELSE '' END AS error_fields
FROM admitted""",
    "disposition_tally": f"""
{_ADMISSION}
SELECT CASE WHEN status_code IN (202, 409, 400, 401) THEN CAST(status_code AS VARCHAR) ELSE 'other' END AS outcome,
       count(*) AS requests
FROM admitted GROUP BY 1""",
    "publish_payload": f"""
{_PAYLOAD}
SELECT id, device AS "deviceId", event_type AS "eventType", CAST(value AS DOUBLE) AS value, ms AS "timestamp",
       '{{"k":' || k || '}}' AS metadata
FROM payload""",
    "topic_records": f"""
{_PAYLOAD}
SELECT device AS key,
       '{{"id":"' || id || '","deviceId":"' || device || '","eventType":"' || event_type || '","value":'
       || CAST(amount AS VARCHAR) || ',"timestamp":' || CAST(ms AS VARCHAR) || ',"metadata":{{"k":' || k || '}}}}'
         AS value
FROM payload""",
    "ack_records": f'{_PAYLOAD} SELECT id, device AS "deviceId", ms AS "timestamp" FROM payload',
    "idempotency_outcomes": f"""
WITH RECURSIVE {_LOG},
keyed AS (SELECT *, handler_status AS run_status FROM log WHERE run_key IS NOT NULL),
{_RUNS.format(rows="keyed")}
SELECT l.request_id, s.outcome, s.x_id AS source_request_id,
       CASE WHEN s.outcome = 'REPLAY' THEN s.x_status END AS replay_status
FROM log l LEFT JOIN state s ON s.request_id = l.request_id""",
    "dlq_records": f"{_MESSAGES} SELECT device AS key, text AS value, reason FROM messages WHERE reason IS NOT NULL",
    "store_insert_if_absent": f"""
{_FIRST}
SELECT id, device AS device_id, event_type, amount AS value, ms AS "timestamp" FROM firsts WHERE e % 5 <> 0""",
    "pipeline_counters": f"""
{_MESSAGES}
SELECT count(*) FILTER (reason IS NULL) AS processed, count(*) FILTER (reason IS NOT NULL) AS failed,
       count(*) FILTER (reason IS NULL AND copy = 0 AND e % 5 <> 0) AS inserted,
       count(*) FILTER (reason IS NULL AND NOT (copy = 0 AND e % 5 <> 0)) AS duplicates
FROM messages""",
    "dedup_first": f"{_FIRST} SELECT id, amount AS value, topic_offset AS \"offset\" FROM firsts",
    "clients_insert_if_absent": """
WITH grps AS (SELECT DISTINCT user_id % 10 AS g FROM events)
SELECT CASE WHEN g = 7 THEN '00000000-0000-4000-8003-' ELSE '00000000-0000-4000-8002-' END
         || lpad(CAST(g AS VARCHAR), 12, '0') AS id,
       'key_' || CAST(g AS VARCHAR) AS api_key,
       CASE WHEN g = 7 THEN 'New ' ELSE 'Client ' END || CAST(g AS VARCHAR) AS name,
       g <> 3 AS active
FROM grps""",
    "request_counts": f"""
WITH {_LOG}
SELECT 'POST' AS method, route, handler_status AS status_code, count(*) AS requests
FROM log WHERE route = '/v1/events' GROUP BY route, handler_status""",
    "request_latency_histogram": f"""
WITH {_LOG}
SELECT 'POST' AS method, route, handler_status AS status_code, b.le,
       count(*) FILTER (duration_ms <= b.bound) AS bucket_count,
       CAST(sum(duration_ms) AS DOUBLE) / 1000 AS duration_sum, count(*) AS duration_count
FROM log, (VALUES {_HISTOGRAM_ROWS}) b(bound, le)
WHERE route = '/v1/events' GROUP BY route, handler_status, b.le""",
    "active_requests": f"""
WITH {_LOG},
changes AS (
  SELECT received_at_ms AS at_ms, 1 AS change FROM log WHERE route = '/v1/events'
  UNION ALL SELECT received_at_ms + duration_ms, -1 FROM log WHERE route = '/v1/events'
),
per_ms AS (SELECT at_ms, sum(change) AS change FROM changes GROUP BY at_ms)
SELECT at_ms, CAST(sum(change) OVER (ORDER BY at_ms) AS BIGINT) AS active_requests FROM per_ms""",
    "rate_usage": f"""
WITH {_LOG},
calls AS (
  SELECT request_id, received_at_ms,
         CASE WHEN grp <> 7 THEN {_CLIENT_ID} ELSE '10.0.0.' || CAST(user_id % 250 AS VARCHAR) END AS caller
  FROM log
),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY caller ORDER BY received_at_ms
                           RANGE BETWEEN {RATE_WINDOW_S * 1000} PRECEDING AND CURRENT ROW)
          - count(*) OVER (PARTITION BY caller, received_at_ms ORDER BY request_id
                           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS used
  FROM calls
)
SELECT request_id, caller, used, used > {RATE_LIMIT} AS limited FROM counted""",
    "live_cards": f"""
WITH {_EVENTS},
means AS (
  SELECT count(*) AS total_events, {_CARD_MEAN.format(t="click")} AS m1, {_CARD_MEAN.format(t="view")} AS m2 FROM ev
)
SELECT total_events, printf('%.1f', m1) AS temperature_avg, printf('%.1f', m2) AS cpu_avg FROM means""",
    "running_type_avg": f"""
WITH {_EVENTS}
SELECT id, event_type AS "eventType", ms AS "timestamp",
       CAST(sum(value) OVER w AS DOUBLE) / count(value) OVER w AS running_avg
FROM ev WHERE event_type IN ('click', 'view')
WINDOW w AS (PARTITION BY event_type ORDER BY ms, id ROWS UNBOUNDED PRECEDING)""",
    "live_log_lines": f"""
WITH {_EVENTS}
SELECT id, substr(device, 1, 8) || ' > Type: ' || event_type || ' | Value: ' || {_ONE_DECIMAL} AS page_line,
       'Device: ' || substr(device, 1, 8) || '... | Type: ' || event_type || ' | Value: ' || printf('%.2f', amount)
         AS cli_line
FROM ev""",
    "trailing_chart": f"""
WITH {_EVENTS},
points AS (
  SELECT ms - ms % 1000 AS second_ms,
         arg_max(amount, (ms, id)) FILTER (event_type = 'click') AS s1,
         arg_max(amount, (ms, id)) FILTER (event_type <> 'click') AS s2
  FROM ev GROUP BY 1
),
filled AS (
  SELECT second_ms,
         last_value(s1 IGNORE NULLS) OVER (ORDER BY second_ms) AS series_1,
         last_value(s2 IGNORE NULLS) OVER (ORDER BY second_ms) AS series_2
  FROM points
)
SELECT second_ms, strftime(make_timestamp(second_ms * 1000), '%H:%M:%S') AS label, series_1, series_2
FROM filled ORDER BY second_ms DESC LIMIT 25""",
    "device_sequence": f"""
{_MESSAGES}
SELECT device AS device_id, topic_offset AS "offset",
       row_number() OVER (PARTITION BY device ORDER BY topic_offset) AS seq_no
FROM messages""",
}

# Two runs with the state between them give what one run gives.
BATCH_ORACLES["running_type_avg_incremental"] = BATCH_ORACLES["running_type_avg"]
BATCH_ORACLES["idempotency_incremental"] = BATCH_ORACLES["idempotency_outcomes"]

STREAM_ORACLES: dict[str, str] = {
    # A window is emitted once the watermark, ten minutes behind the latest event, has passed its end.
    "stream_window_stats": f"""
{_WINDOWS}
SELECT * FROM stats WHERE window_end <= (SELECT make_timestamp(max(ms) * 1000) FROM ev) - INTERVAL 10 MINUTE""",
    "stream_store_events": f"""
{_FIRST}
SELECT id, device AS device_id, event_type, amount AS value, ms AS "timestamp" FROM firsts""",
    "stream_dlq": BATCH_ORACLES["dlq_records"],
    "stream_dedup": f"""
{_MESSAGES}
SELECT id, CASE WHEN e % 43 = 0 THEN substr(device, 1, 33) || 'xyz' ELSE device END AS "deviceId",
       CASE WHEN e % 37 = 0 THEN repeat('x', 51) ELSE event_type END AS "eventType",
       CASE WHEN e % 41 <> 0 THEN amount + copy END AS value, ms AS "timestamp", k AS metadata_k,
       CAST(user_id % 8 AS INTEGER) AS partition, topic_offset AS "offset"
FROM messages WHERE e % 47 <> 0
QUALIFY row_number() OVER (PARTITION BY id ORDER BY topic_offset) = 1""",
    # A part's late events are judged by the watermark that its predecessor ran with: two days behind the parts before that one.
    "stream_late_windows": f"""
WITH {_EVENTS},
parts AS (
  SELECT *, least({" + ".join(f"CAST(ms >= {cut} AS INTEGER)" for cut in LATE_CUTS_MS)} + CAST(e % {LATE_EVERY} = 0 AS INTEGER),
                  {len(LATE_CUTS_MS)}) AS part FROM ev
),
marks AS (SELECT p.part, max(b.ms) - 172800000 AS mark_ms FROM (SELECT DISTINCT part FROM parts) p LEFT JOIN parts b ON b.part < p.part - 1 GROUP BY p.part),
spread AS (
  SELECT parts.*, make_timestamp((ms - ms % 60000 - k.n * 60000) * 1000) AS window_start
  FROM parts, (VALUES (0), (1), (2), (3), (4)) k(n)
),
kept AS (
  SELECT s.* FROM spread s JOIN marks m ON m.part = s.part
  WHERE m.mark_ms IS NULL OR window_start + INTERVAL 5 MINUTE > make_timestamp(m.mark_ms * 1000)
)
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, event_type AS "eventType",
       {_AVG} AS avg_value, CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value, count(id) AS event_count
FROM kept WHERE window_start + INTERVAL 5 MINUTE <= (SELECT make_timestamp((max(ms) - 172800000) * 1000) FROM ev)
GROUP BY window_start, event_type""",
    "stream_rate_usage": BATCH_ORACLES["rate_usage"],
    "stream_live_feed": f"SELECT value FROM ({BATCH_ORACLES['topic_records']})",
    "stream_batch_histogram": f"""
{_MESSAGES}, counted AS (
  SELECT count(*) FILTER (reason IS NULL) AS processed, count(*) FILTER (reason IS NOT NULL) AS failed FROM messages)
SELECT le, 2 AS duration_count, processed, failed FROM counted, (VALUES {_HISTOGRAM_ROWS}) b(bound, le)""",
    "stream_idempotency": f"""
WITH RECURSIVE {_LOG},
keyed AS (SELECT *, handler_status AS run_status FROM log WHERE run_key IS NOT NULL),
{_RUNS.format(rows="keyed")}
SELECT request_id, outcome, x_id AS source_request_id, CASE WHEN outcome = 'REPLAY' THEN x_status END AS replay_status
FROM state""",
    "stream_live_cards": BATCH_ORACLES["live_cards"],
    "stream_admission": BATCH_ORACLES["admission"],
    "stream_topic_records": BATCH_ORACLES["topic_records"],
}

# Without late events both ways give the same.
STREAM_ORACLES["stream_window_stats_panes"] = STREAM_ORACLES["stream_window_stats"]
