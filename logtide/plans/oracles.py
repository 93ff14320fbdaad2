"""The queries over tables in SQL that DuckDB runs, for comparison."""

from __future__ import annotations

from ..config import ALERT_THRESHOLDS, REDACTION_RULES, builtin_formats

_RULES = ", ".join(f"('{name}', '{pattern}')" for name, pattern in REDACTION_RULES)


def _hits(text: str) -> str:
    return " + ".join(f"coalesce(regexp_matches({text}, '{p}'), false)::int" for _, p in REDACTION_RULES)


def _profile(source: str, key: str, order: str, ts: str) -> str:
    """CTE ``p``: one row per group with the figures of a profile."""
    return f"""
    seq AS (SELECT {key} AS g, {order} AS i, {ts} AS t, lag({ts}) OVER (PARTITION BY {key} ORDER BY {order}) AS b FROM {source} WHERE {ts} IS NOT NULL),
    gap AS (SELECT g, i, t, b, abs(date_diff('microsecond', b, t)) AS us FROM seq),
    dir AS (SELECT g, min(i) FILTER (WHERE t > b) AS up, min(i) FILTER (WHERE t < b) AS down FROM gap GROUP BY g),
    vio AS (SELECT g, up IS NOT NULL AND (down IS NULL OR up < down) AS asc_, CASE WHEN up IS NOT NULL AND (down IS NULL OR up < down) THEN down ELSE up END AS v FROM dir),
    top AS (SELECT g, us, least(b, t) AS lb, greatest(b, t) AS le FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY us DESC, i) AS r FROM gap WHERE us IS NOT NULL) WHERE r = 1),
    agg AS (SELECT g, count(*) AS nts, min(t) AS mn, max(t) AS mx, count(us) AS ng, avg(us // 1000) AS mean, var_pop(us // 1000) AS var FROM gap GROUP BY g),
    tot AS (SELECT {key} AS g, count(*) AS n FROM {source} GROUP BY 1),
    p AS (SELECT tot.g, n AS n_records, CASE WHEN v IS NULL THEN coalesce(nts, 0) ELSE 0 END AS n_ts,
            CASE WHEN v IS NULL THEN mn END AS min_ts, CASE WHEN v IS NULL THEN mx END AS max_ts,
            coalesce(CASE WHEN asc_ THEN 'Ascending' ELSE 'Descending' END, 'Descending') AS direction, v AS violation,
            CASE WHEN v IS NULL THEN coalesce(ng, 0) ELSE 0 END AS n_gaps, CASE WHEN v IS NULL THEN mean END AS mean, CASE WHEN v IS NULL THEN var END AS var,
            CASE WHEN v IS NULL THEN us END AS ltg_us, CASE WHEN v IS NULL THEN lb END AS ltg_begin, CASE WHEN v IS NULL THEN le END AS ltg_end
          FROM tot LEFT JOIN agg USING (g) LEFT JOIN vio USING (g) LEFT JOIN top USING (g))"""


def _profile_query(key: str) -> str:
    return f"""WITH {_profile("events", key, "event_id", "ts")}
    SELECT g AS {key}, n_records, n_ts, min_ts, max_ts, n_gaps, ltg_us, ltg_begin, ltg_end, round(mean, 3) AS gap_mean_ms, round(sqrt(var), 3) AS gap_std_ms,
      round(CASE WHEN var > 0 THEN (ltg_us // 1000 - mean) / sqrt(var) WHEN var = 0 THEN 'NaN'::DOUBLE END, 3) AS ltg_z FROM p"""


def _hours(us: str) -> str:
    s = f"(abs({us}) // 1000000)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"


def _human(us: str) -> str:
    s = f"({us} // 1000000)"
    parts = ", ".join(f"CASE WHEN {n} > 0 THEN ({n})::varchar || '{u}' END" for n, u in ((f"{s} // 86400", "d"), (f"{s} % 86400 // 3600", "h"), (f"{s} % 3600 // 60", "m"), (f"{s} % 60", "s")))
    return f"CASE WHEN {us} >= 0 THEN coalesce(nullif(concat_ws(' ', {parts}), ''), '0s') END"


def _thousands(n: str) -> str:
    return f"format('{{:,}}', {n})"


def _text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def _level(value: str, kind: str) -> str:
    h, m, low = ALERT_THRESHOLDS[kind]
    return f"CASE WHEN {value} > {h} THEN 'High' WHEN {value} > {m} THEN 'Medium' WHEN {value} > {low} THEN 'Low' END"


_DUPES = "d AS (SELECT event_type AS g, CAST(sum(n) - count(*) AS BIGINT) AS dupes FROM (SELECT * EXCLUDE (event_id), count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)"
_hundred = ALERT_THRESHOLDS["SusEventCount"]
_ALERTS = f"""WITH {_profile("events", "event_type", "event_id", "ts")},
    {_DUPES},
    r AS (SELECT event_type AS g, sum({_hits("props")}) AS red FROM events GROUP BY 1),
    s AS (SELECT p.g, n_ts, dupes, red, CASE WHEN var = 0 THEN CASE WHEN ltg_us // 1000 > mean THEN 4611686018427387904 ELSE 0 END ELSE greatest(floor((ltg_us // 1000 - mean) / nullif(sqrt(var), 0)), 0) END AS score FROM p JOIN d USING (g) JOIN r USING (g)),
    a AS (SELECT g, 'SusEventCount' AS kind, CASE WHEN n_ts > 0 AND n_ts % {_hundred[0]} = 0 THEN 'High' WHEN n_ts > 0 AND n_ts % {_hundred[1]} = 0 THEN 'Medium' WHEN n_ts > 0 AND n_ts % {_hundred[2]} = 0 THEN 'Low' END AS level FROM s
      UNION ALL SELECT g, 'DupeEvents', {_level("dupes", "DupeEvents")} FROM s
      UNION ALL SELECT g, 'RedactionEvents', {_level("red", "RedactionEvents")} FROM s
      UNION ALL SELECT g, 'SusTimeGap', {_level("score", "SusTimeGap")} FROM s)"""

_FORMATS = builtin_formats()
_WRITTEN = {
    0: "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'",
    1: "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
    2: "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    3: "strftime(ts, '%b %-d, %Y %-I:%M:%S %p')",
    4: "strftime(ts, '%b %-d %Y %-H:%M:%S')",
    5: "strftime(ts, '%m/%d/%Y %-I:%M:%S %p')",
    6: "(epoch_us(ts) // 1000000)::varchar",
    7: "(epoch_us(ts) // 1000)::varchar",
    8: "strftime(ts, 'date=%Y-%m-%d time=%H:%M:%S')",
    9: "strftime(ts, '%b %-d %H:%M:%S')",
}
_PARSED = {
    0: "try_strptime(m, '%Y-%m-%dT%H:%M:%S.%gZ')",
    1: "try_strptime(m, '%Y-%m-%dT%H:%M:%S.%f')",
    2: "try_strptime(m, '%Y-%m-%d %H:%M:%S')",
    3: "try_strptime(m, '%b %-d, %Y %-I:%M:%S %p')",
    4: "try_strptime(m, '%b %-d %Y %-H:%M:%S')",
    5: "try_strptime(m, '%m/%d/%Y %-I:%M:%S %p')",
    6: "make_timestamp(m::bigint * 1000000)",
    7: "make_timestamp(left(m, 10)::bigint * 1000000)",
    8: "try_strptime(m, 'date=%Y-%m-%d time=%H:%M:%S')",
    9: "try_strptime('1970 ' || m, '%Y %b %-d %H:%M:%S')",
}


def _extract(k: int) -> str:
    return f"""WITH l AS (SELECT event_id, 'at ' || {_WRITTEN[k]} || ' ' || event_type AS line FROM events),
    m AS (SELECT event_id, regexp_matches(line, '{_FORMATS[k].regex}') AS matched, regexp_extract(line, '{_FORMATS[k].regex}', 0) AS m FROM l)
    SELECT event_id, matched, CASE WHEN matched THEN {_PARSED[k]} END AS parsed_ts FROM m"""


_PARTS = f"""SELECT *, strftime(ts, '%Y-%m-%d') AS part FROM events"""



def _logs(kind: str, column: str, first: str, fields: str, hits: str, timed: str = "true") -> str:
    """The figures of the logs that the events make up, 2,500 numbers each."""
    return f"""WITH e AS (SELECT event_id // 2500 AS log, row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) - 1 AS i, {fields} AS f,
        CASE WHEN {timed} THEN date_trunc('second', ts) END AS t FROM events), {_profile("e", "log", "i", "t")},
    d AS (SELECT log AS g, CAST(count(*) - count(DISTINCT f) AS BIGINT) AS dupes FROM e GROUP BY 1)
    SELECT p.g AS log, '{kind}' AS log_type, '{column}' AS "column", {first} AS first_data_row, 2 AS format, n_records, n_ts, min_ts, max_ts, violation, n_gaps, ltg_us, round(mean, 3) AS gap_mean_ms, round(sqrt(var), 3) AS gap_std_ms,
      dupes AS n_dupes, CAST({hits} AS BIGINT) AS n_redactions, (violation IS NOT NULL)::BIGINT + (SELECT count(*) FROM e WHERE e.log = p.g AND t IS NULL AND (violation IS NULL OR i < violation)) AS n_errors
    FROM p JOIN d USING (g)"""


_SECOND = "strftime(ts, '%Y-%m-%d %H:%M:%S')"

SQL = {
    "csv_logs": _logs("csv", "seen", "1", f"struct_pack(u := user_id, k := event_type, s := {_SECOND})", "n_records"),
    "json_logs": _logs("json", "/at/time", "NULL", f"struct_pack(u := user_id, k := event_type, s := {_SECOND})", "0"),
    "text_logs": _logs("text", "Record", "NULL", f"event_type || ' at ' || CASE WHEN event_id % 11 = 7 THEN 'soon' ELSE {_SECOND} END || ' by ' || user_id", "0", "event_id % 11 <> 7"),
    "time_profile_by_type": _profile_query("event_type"),
    "time_profile_by_user": _profile_query("user_id"),
    "profile_appended": _profile_query("event_type"),
    "file_sortedness": f"""
        WITH logs AS (SELECT 'orders/' || o_orderpriority AS log, o_orderkey AS i, o_orderdate AS t FROM orders UNION ALL SELECT 'events', event_id, ts FROM events),
        {_profile("logs", "log", "i", "t")} SELECT g AS log, direction, violation IS NULL AS is_sorted, violation FROM p""",
    "out_of_order_nulling": f"""WITH {_profile("orders", "o_orderpriority", "o_orderkey", "o_orderdate")}
        SELECT g AS o_orderpriority, n_records, n_ts, min_ts, max_ts, ltg_us, violation, 'out of order at record ' || violation::varchar AS error FROM p""",
    "largest_gap_top5": f"""WITH {_profile("events", "user_id", "event_id", "ts")}
        SELECT g AS user_id, min_ts, max_ts, ltg_us FROM p WHERE ltg_us IS NOT NULL ORDER BY ltg_us DESC, g LIMIT 5""",
    "largest_gap_interval": f"""WITH {_profile("events", "event_type", "event_id", "ts")}
        SELECT g AS event_type, {_text("ltg_begin")} || ' to ' || {_text("ltg_end")} AS ltg, {_hours("ltg_us")} AS ltg_hours FROM p""",
    "dup_counts_by_source": "SELECT source, count(*) AS n_records, count(*) - count(DISTINCT text) - (count(*) FILTER (WHERE text IS NULL) > 0)::int AS n_dupes FROM documents GROUP BY 1",
    "dup_listing": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS r FROM documents) WHERE r > 1",
    "record_hash_dupes": """SELECT source, doc_id, left(sha256(concat_ws('|', coalesce(sha256(text), '-'), coalesce(sha256(lang), '-'))), 16) AS record_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY source, text, lang ORDER BY doc_id) AS r FROM documents) WHERE r > 1""",
    "distinct_rows": "SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(n) - count(*) AS BIGINT) AS n_dupes FROM (SELECT * EXCLUDE (c_custkey), count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1",
    "redaction_counts": f"SELECT source, count(*) AS n_records, sum({_hits('text')})::bigint AS n_redactions FROM documents GROUP BY 1",
    "redaction_listing": f"SELECT doc_id, r.name AS rule_name FROM documents, (VALUES {_RULES}) r(name, pattern) WHERE regexp_matches(text, r.pattern)",
    "redaction_by_rule": f"""SELECT log, r.name AS rule_name, count(*) AS n_hits FROM (SELECT 'documents' AS log, text AS t FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations),
        (VALUES {_RULES}) r(name, pattern) WHERE regexp_matches(t, r.pattern) GROUP BY 1, 2""",
    "redaction_rules_injected": f"""WITH e AS (SELECT event_id, event_type || ' ' || (['***', 'XXXX', '<sensitiveDataRemoved>', 'is REDACTED here', 'REMOVED FOR SECURITY', 'DATA MASKED', '[[SENSITIVE]]', 'BASE64_REDACTED', 'UNREDACTED', '**'])[event_id % 10 + 1] AS t FROM events)
        SELECT r.name AS rule_name, count(*) AS n_hits, min(event_id) AS first_hit FROM e, (VALUES {_RULES}) r(name, pattern) WHERE regexp_matches(t, r.pattern) GROUP BY 1""",
    "alerts_per_group": f"{_ALERTS} SELECT g AS event_type, level, kind FROM a WHERE level IS NOT NULL",
    "alert_rollup": f"{_ALERTS} SELECT level, kind, count(*) AS n_alerts FROM a WHERE level IS NOT NULL GROUP BY 1, 2",
    "multipart_merge": f"""
        WITH e AS ({_PARTS}), {_profile("e", "part", "event_id", "ts")},
        d AS (SELECT part AS g, sum(n - 1) AS dupes FROM (SELECT * EXCLUDE (event_id), count(*) AS n FROM e GROUP BY ALL) GROUP BY 1),
        r AS (SELECT part AS g, sum({_hits("props")}) AS red FROM e GROUP BY 1),
        o AS (SELECT *, max(max_ts) OVER (ORDER BY min_ts, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm, row_number() OVER (ORDER BY min_ts, g) AS k FROM p WHERE n_ts > 0),
        x AS (SELECT (greatest(n_ts - 1, 0))::double AS n, coalesce(mean, 0) AS m, coalesce(var, 0) AS v, ltg_us AS us, ltg_begin AS b, ltg_end AS f, k * 2 AS pos FROM o
          UNION ALL SELECT 1, (date_diff('microsecond', pm, min_ts) // 1000)::double, 0, date_diff('microsecond', pm, min_ts), pm, min_ts, k * 2 + 1 FROM o WHERE pm <= min_ts),
        mm AS (SELECT sum(n * m) / sum(n) AS mu, sum(n) AS nn FROM x),
        vv AS (SELECT sum(n * (v + (m - mu) ** 2)) / max(nn) AS va FROM x, mm),
        tt AS (SELECT us, b, f FROM x WHERE us IS NOT NULL ORDER BY us DESC, pos LIMIT 1)
        SELECT (SELECT sum((n_ts > 0)::int)::bigint::varchar FROM p) || '_SUCCESSFUL_INPUT_FILES_COMBINED' AS name, (SELECT sum(n_records)::bigint FROM p) AS n_records, (SELECT sum(n_ts)::bigint FROM p) AS n_ts,
          (SELECT sum(dupes)::bigint FROM d) AS n_dupes, (SELECT sum(red)::bigint FROM r) AS n_redactions, (SELECT min(min_ts) FROM o) AS min_ts, (SELECT max(max_ts) FROM o) AS max_ts,
          nn::bigint AS n_gaps, round(mu, 3) AS gap_mean_ms, round(sqrt(va), 3) AS gap_std_ms, us AS ltg_us, b AS ltg_begin, f AS ltg_end, (SELECT count(*) FROM o WHERE pm > min_ts) AS n_overlaps FROM mm, vv, tt""",
    "multipart_overlap": f"""
        WITH {_profile("events", "user_id", "event_id", "ts")},
        o AS (SELECT *, row_number() OVER (ORDER BY min_ts, g) AS k FROM p WHERE n_ts > 0),
        h AS (SELECT *, arg_max(struct_pack(a := max_ts, z := -k), struct_pack(a := max_ts, z := -k)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o)
        SELECT q.g::varchar AS holder, h.g::varchar AS part FROM h JOIN o q ON q.k = -h.top.z WHERE h.top.a > h.min_ts""",
    "part_depths": f"""
        WITH {_profile("events", "user_id", "event_id", "ts")},
        s AS (SELECT t, sum(step) AS step FROM (SELECT min_ts AS t, 1 AS step FROM p WHERE n_ts > 0 UNION ALL SELECT max_ts, -1 FROM p WHERE n_ts > 0) GROUP BY t),
        d AS (SELECT CAST(sum(step) OVER (ORDER BY t) AS BIGINT) AS depth, date_diff('microsecond', t, lead(t) OVER (ORDER BY t)) AS lasts FROM s)
        SELECT depth, CAST(sum(lasts) AS BIGINT) AS micros FROM d WHERE lasts > 0 GROUP BY depth""",
    "part_shared_time": """
        WITH p AS (SELECT o_custkey AS g, min(o_orderdate) AS mn, max(o_orderdate) AS mx FROM orders GROUP BY 1),
        s AS (SELECT t, sum(step) AS step FROM (SELECT mn AS t, 1 AS step FROM p UNION ALL SELECT mx, -1 FROM p) GROUP BY t),
        d AS (SELECT t, sum(step) OVER (ORDER BY t) AS depth, date_diff('microsecond', t, lead(t) OVER (ORDER BY t)) AS lasts FROM s),
        g AS (SELECT t, coalesce(sum(CASE WHEN depth >= 2 THEN lasts END) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grown FROM d)
        SELECT p.g AS o_custkey, date_diff('microsecond', mn, mx) AS span_us, CAST(b.grown - a.grown AS BIGINT) AS shared_us FROM p JOIN g a ON a.t = mn JOIN g b ON b.t = mx""",
    "format_detection": "WITH f AS (SELECT event_id, event_id % 10 AS k FROM events) SELECT ("
    + str([f.name for f in _FORMATS])
    + ")[k + 1] AS format, count(*) AS n_records, min(event_id) AS first_record FROM f GROUP BY 1",
    "json_flatten": "SELECT event_id, '/' || key AS path, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
    "json_pointer": "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events",
    "duration_format": f"""WITH {_profile("events", "user_id", "event_id", "ts")}
        SELECT g AS user_id, {_hours("date_diff('microsecond', min_ts, max_ts)")} AS duration_hours, {_human("date_diff('microsecond', min_ts, max_ts)")} AS duration_text, {_thousands("n_records")} AS records_text FROM p""",
    "stats_report_row": f"""WITH {_profile("events", "event_type", "event_id", "ts")},
        {_DUPES}, r AS (SELECT event_type AS g, sum({_hits("props")})::bigint AS red FROM events GROUP BY 1)
        SELECT g AS event_type, {_thousands("n_records")} AS total_records, {_thousands("n_ts")} AS timed_records, {_text("min_ts")} AS min_ts, {_text("max_ts")} AS max_ts, {_hours("date_diff('microsecond', min_ts, max_ts)")} AS duration_hours,
          {_text("ltg_begin")} || ' to ' || {_text("ltg_end")} AS ltg, {_hours("ltg_us")} AS ltg_hours, {_human("date_diff('microsecond', min_ts, max_ts)")} AS duration_text, {_human("ltg_us")} AS ltg_text,
          format('{{:,.3f}}', mean) AS gap_mean_ms, format('{{:,.3f}}', sqrt(var)) AS gap_std_ms, format('{{:,.3f}}', CASE WHEN var > 0 THEN (ltg_us // 1000 - mean) / sqrt(var) WHEN var = 0 THEN 'NaN'::DOUBLE END) AS ltg_z,
          CASE WHEN violation IS NULL THEN '' ELSE 'Record ' || violation || ' is out of order; time analysis stopped' END AS error, {_thousands("dupes")} AS dupes, {_thousands("red")} AS redactions FROM p JOIN d USING (g) JOIN r USING (g)""",
    "run_summary": f"""WITH logs AS (SELECT 'e' || user_id AS log, event_id AS i, ts AS t FROM events UNION ALL SELECT 'o' || o_custkey, o_orderkey, o_orderdate FROM orders), {_profile("logs", "log", "i", "t")}
        SELECT sum(n_ts)::bigint AS timed_records, count(min_ts) AS analysed, count(*) - count(min_ts) AS not_analysed FROM p""",
    "null_timestamps": f"""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 3 THEN ts END AS ts FROM events), {_profile("e", "event_type", "event_id", "ts")},
        z AS (SELECT event_type AS g, event_id FROM e WHERE ts IS NULL)
        SELECT p.g AS event_type, n_records, n_ts, (SELECT count(*) FROM z WHERE z.g = p.g AND (violation IS NULL OR event_id < violation)) AS null_ts, n_gaps, ltg_us FROM p""",
} | {f"ts_extract_{k + 1}": _extract(k) for k in range(10)}
