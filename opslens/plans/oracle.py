"""Independent SQL for the registered queries, written for DuckDB over the driver's tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
_LOGS = f"""logs AS (
  SELECT event_id, 'svc-' || (user_id % 3) AS service, {_LEVEL} AS level, epoch_us(ts) AS us,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {_LEVEL} || ' [worker-' || (event_id % 8) || '] c.p.Service : ' END AS prefix,
    CASE event_type
      WHEN 'error' THEN 'Connection failed to 10.0.' || (user_id % 256) || '.' || (event_id % 256) || ':5432 after ' || (event_id % 5000) || 'ms'
      WHEN 'purchase' THEN 'order 7e36b7b0-0000-4000-8000-' || lpad(to_hex(event_id), 12, '0') || ' paid'
      WHEN 'signup' THEN 'session 0x' || lower(to_hex(event_id)) || ' opened for user ' || user_id
      WHEN 'click' THEN 'user ' || user_id || ' clicked item ' || (event_id % 100)
      ELSE 'page rendered in ' || (event_id % 900) || 's' END AS body,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'trace-' || (event_id % 1000) END AS trace_id,
    CASE WHEN user_id % 4 = 3 THEN 'default' ELSE 'tenant-' || (user_id % 4) END AS tenant_id, event_type, user_id, ts
  FROM events)"""


def _norm(x: str) -> str:
    rules = (
        ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
        (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>"),
        ("0x[0-9a-fA-F]+", "<HEX>"),
        # a letter outside ASCII right after the unit is a word character too
        (r"[0-9]+(?:ms|s|m|h|d)($|[^\pL\pN\pM_])", r"<DURATION>\1"),
        ("[0-9]+", "<NUM>"),
    )
    for rx, tok in rules:
        # the duration rule eats its right neighbour, so adjacent ones need a second pass
        for _ in range(2 if "DURATION" in tok else 1):
            x = f"regexp_replace({x}, '{rx}', '{tok}', 'g')"
    return x


_PARSED = f"""{_LOGS}, parsed AS (
  SELECT event_id, service, level, us, {_norm('body')} AS template,
         sha256(service || ':' || level || ':' || {_norm('body')}) AS fingerprint FROM logs)"""
_KEYS = """ek AS (SELECT event_id, 'svc-' || (user_id % 3) AS service, event_type AS fingerprint,
  CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, epoch_us(ts) AS us, user_id FROM events)"""
_RECORDS = """rec AS (
  SELECT event_id, event_id % 3 AS "partition", event_id // 3 AS "offset", 'svc-' || (user_id % 3) AS key, ts,
    CASE event_id % 10
      WHEN 0 THEN '{not-valid-json ' || event_id
      WHEN 1 THEN '{"schema":"logs.raw.v1","messageId":"m-' || event_id || '","occurredAt":' || (1704067200 + event_id) || ',"producedAt":1,"traceId":"t","tenantId":"d"}'
      ELSE '{"schema":"logs.raw.v1","messageId":"m-' || event_id || '","occurredAt":' || (1704067200 + event_id)
        || ',"producedAt":"2024-02-01T00:00:00Z","traceId":"' || (CASE event_id % 10 WHEN 3 THEN '' ELSE 't' || event_id END)
        || '","tenantId":' || (CASE event_id % 10 WHEN 4 THEN '7' ELSE '"tenant-' || (user_id % 4) || '"' END)
        || ',"payload":{' || (CASE event_id % 10 WHEN 2 THEN '' ELSE '"service":"svc-' || (user_id % 3) || '",' END)
        || '"level":"' || (CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END)
        || '","message":"' || event_type || ' ' || event_id || '","metadata":{"tenantId":"tenant-' || (user_id % 4) || '"}}}' END AS value,
    user_id, event_type FROM events)"""


def _uuid3(blob: str) -> str:
    h = f"md5({blob})"
    variant = f"substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1)"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-3' || substr({h},14,3) || '-' || {variant} || "
            f"substr({h},18,3) || '-' || substr({h},21,12))")


def _incident(fp: str, kind: str) -> str:
    return _uuid3(f"unhex(sha256({fp} || ':' || {kind}))")


# --- sources, text, identity ----------------------------------------------------------------------

SQL["ingest_logs"] = f"""WITH {_LOGS} SELECT event_id, service, level, prefix || body AS message,
  sha256(service || level || {_norm('prefix || body')}) AS fingerprint, us AS occurred_us, strftime(ts, '%Y-%m-%d') AS event_date FROM logs"""
SQL["envelope_raw"] = f"""WITH {_LOGS}, e AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso,
    CASE WHEN trace_id = '' THEN 'gen-' || event_id ELSE trace_id END AS tr FROM logs)
  SELECT service AS key, '{{"schema":"logs.raw.v1","messageId":"' || {_uuid3('event_id::VARCHAR')} || '","occurredAt":"' || iso || '","producedAt":"' || iso
    || '","traceId":"' || tr || '","tenantId":"' || tenant_id || '","payload":{{"service":"' || service || '","level":"' || level || '","message":"' || prefix || body || '"}}}}' AS value,
    2::BIGINT AS n_headers FROM e"""
SQL["envelope_preprocessed"] = f"""WITH {_PARSED}, e AS (SELECT p.*, trace_id, tenant_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM parsed p JOIN logs USING (event_id))
  SELECT fingerprint AS key, '{{"schema":"logs.preprocessed.v1","messageId":"m-' || event_id || '","occurredAt":"' || iso || '","producedAt":"' || iso || '","traceId":"' || trace_id
    || '","tenantId":"' || tenant_id || '","payload":{{"service":"' || service || '","level":"' || level || '","template":"' || template || '"}}}}' AS value,
    CASE WHEN trace_id = '' THEN 1 ELSE 2 END::BIGINT AS n_headers FROM e"""
SQL["failed_audit"] = f"""WITH {_RECORDS}, o AS (SELECT 'logs.raw:' || "partition" || ':' || "offset" AS origin FROM rec WHERE event_id % 10 < 3)
  SELECT {_uuid3("'run:' || origin")} AS execution_id, origin, 'FAILED' AS status FROM o"""
SQL["decode_envelopes"] = f"""WITH {_RECORDS} SELECT 'm-' || event_id AS event_id, key AS service,
  CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type || ' ' || event_id AS message,
  CASE event_id % 10 WHEN 4 THEN '7' ELSE 'tenant-' || (user_id % 4) END AS tenant_id, (1704067200 + event_id) * 1000000 AS occurred_us
  FROM rec WHERE event_id % 10 >= 3"""
SQL["dlq_split"] = f"""WITH {_RECORDS} SELECT key, value, 'logs.raw.dlq' AS topic, "partition",
  CASE event_id % 10 WHEN 0 THEN 'MalformedJson' WHEN 1 THEN 'MissingPayload' ELSE 'MissingField' END AS error_class,
  'logs.raw' AS original_topic, "partition"::VARCHAR AS original_partition, "offset"::VARCHAR AS original_offset FROM rec WHERE event_id % 10 < 3"""
SQL["replay_range"] = f"""WITH {_RECORDS} SELECT key, value, "partition", "offset" FROM rec WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"""
SQL["validate_envelopes"] = f"""WITH {_RECORDS}, j AS (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS js FROM rec)
  SELECT "partition", "offset", coalesce(json_exists(js, '$.payload') AND json_type(js, '$.schema') = 'VARCHAR' AND json_type(js, '$.messageId') = 'VARCHAR'
    AND json_type(js, '$.traceId') = 'VARCHAR' AND json_type(js, '$.tenantId') = 'VARCHAR' AND (js->>'$.traceId') <> '' AND (js->>'$.tenantId') <> ''
    AND json_type(js, '$.occurredAt') IN ('VARCHAR','UBIGINT','BIGINT','DOUBLE') AND json_type(js, '$.producedAt') IN ('VARCHAR','UBIGINT','BIGINT','DOUBLE'), false) AS valid FROM j"""
SQL["validate_events"] = f"""WITH {_LOGS} SELECT event_id, concat_ws(',', CASE WHEN trace_id = '' THEN 'level_empty' END,
  CASE WHEN event_id % 13 = 0 THEN 'occurred_at_missing' END) AS errors FROM logs"""
SQL["normalize_messages"] = f"SELECT doc_id, {_norm('text')} AS template FROM documents"
_DOCLOGS = "dl AS (SELECT d.doc_id, source, CASE WHEN coalesce(toxic, 0) = 1 THEN 'ERROR' ELSE 'INFO' END AS level, text FROM documents d LEFT JOIN labels l USING (doc_id))"
SQL["fingerprint_logs"] = f"WITH {_DOCLOGS} SELECT doc_id AS event_id, sha256(source || ':' || level || ':' || {_norm('text')}) AS fingerprint FROM dl"
SQL["fingerprint_ingest"] = f"WITH {_DOCLOGS} SELECT doc_id AS event_id, sha256(source || level || {_norm('text')}) AS fingerprint FROM dl"
SQL["parse_log_lines"] = f"""WITH {_LOGS} SELECT event_id, CASE WHEN prefix = '' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp,
  CASE WHEN prefix = '' THEN '' ELSE level END AS level, CASE WHEN prefix = '' THEN '' ELSE '[worker-' || (event_id % 8) || ']' END AS thread,
  CASE WHEN prefix = '' THEN '' ELSE 'c.p.Service' END AS logger, body AS message, prefix <> '' AS matched FROM logs"""
SQL["extract_exception"] = """SELECT doc_id, 'com.acme.' || source || 'Exception' AS exception_class,
  regexp_extract(text, '^([^\\n\\r\\x{85}\\x{2028}\\x{2029}]*)', 1) AS exception_msg FROM documents"""
SQL["parse_syslog"] = """SELECT event_id, (event_id % 190 + 1)::VARCHAR AS syslog_pri, lpad((event_id % 28 + 1)::VARCHAR, 2, '0') AS day,
  'host' || (user_id % 5) AS host, 'app[' || user_id || ']' AS tag, event_type AS message FROM events"""
SQL["preprocess_logs"] = f"WITH {_PARSED} SELECT event_id, template, fingerprint FROM parsed"
SQL["tenant_resolution"] = f"WITH {_LOGS} SELECT event_id, tenant_id FROM logs"
SQL["trace_resolution"] = f"""WITH {_LOGS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ctx-' || event_id WHEN trace_id <> '' THEN trace_id ELSE 'fresh' END AS trace,
  CASE WHEN event_id % 3 <> 0 AND trace_id = '' THEN 36 ELSE 0 END::BIGINT AS fresh_len FROM logs"""
SQL["tenant_filter"] = f"WITH {_LOGS} SELECT event_id, service, level FROM logs WHERE tenant_id = 'tenant-1'"
SQL["incident_ids"] = f"""WITH {_PARSED}, f AS (SELECT fingerprint, {_incident('fingerprint', "'SPIKE'")} AS a, {_incident('fingerprint', "'RATE_JUMP'")} AS b FROM (SELECT DISTINCT fingerprint FROM parsed))
  SELECT event_id, a AS spike_id, b AS rate_jump_id FROM parsed JOIN f USING (fingerprint)"""
SQL["extract_json_payload"] = f"""WITH {_RECORDS} SELECT "partition", "offset", CASE WHEN event_id % 10 = 0 THEN 'answer: ' || value || ' done' ELSE value END AS payload FROM rec"""
SQL["extract_json_texts"] = """SELECT page_id, CASE WHEN instr(html, '{') > 0 AND length(html) - instr(reverse(html), '}') + 1 > instr(html, '{') AND instr(html, '}') > 0
  THEN substr(html, instr(html, '{'), length(html) - instr(reverse(html), '}') + 2 - instr(html, '{')) ELSE html END AS payload FROM pages"""
SQL["stack_anchor"] = """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN '--- CRITICAL STACK CONTEXT MATCHED FOR CLASS org.acme.' || source || '.Ledger ---' || chr(10) || lang
  WHEN regexp_matches(text, 'at\\s+[a-zA-Z0-9._$]+\\.[a-zA-Z0-9_$]+\\(') THEN '--- CRITICAL STACK CONTEXT MATCHED FOR CLASS '
    || regexp_extract(text, 'at\\s+([a-zA-Z0-9._$]+)\\.([a-zA-Z0-9_$]+)\\(', 1) || ' ---' || chr(10) || lang ELSE lang END AS context FROM documents"""
SQL["render_prompts"] = "SELECT doc_id, lang || ' reads ' || text || ' for ' || source AS prompt FROM documents WHERE NOT contains(text, '{{source}}') UNION ALL SELECT doc_id, lang || ' reads ' || replace(text, '{{source}}', source) || ' for ' || source FROM documents WHERE contains(text, '{{source}}')"
# The stand-in answers of prompts.py, as the driver's SQL needs them.
_STUB_NP = '{"file":"PaymentService.java","method":"process","issue":"Null pointer on parameter paymentId","fix":"Add objects requireNonNull check","confidence":0.92}'
_STUB_TO = '{"file":"DatabasePool.java","method":"getConnection","issue":"Connection pool depletion","fix":"Increase max pool sizes to 50","confidence":0.85}'
SQL["stub_completion"] = f"""WITH p AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' NullPointerException' WHEN 1 THEN ' TimeoutException' ELSE '' END AS prompt FROM documents),
  a AS (SELECT doc_id, prompt, CASE WHEN contains(prompt, 'NullPointerException') THEN '{_STUB_NP}' WHEN contains(prompt, 'TimeoutException') THEN '{_STUB_TO}'
    ELSE '{{"cause": "UNHANDLED_MOCK_STATE"}}' END AS answer FROM p)
  SELECT doc_id, answer, length(prompt) // 4 AS tokens_in, length(answer) // 4 AS tokens_out FROM a"""
SQL["text_preview"] = "SELECT doc_id, CASE WHEN length(text) > 4096 THEN substr(text, 1, 4096) || '…' ELSE text END AS preview FROM documents"
SQL["content_hash"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"
SQL["window_ids"] = "SELECT event_id, epoch_us(ts) // 300000000 AS window_id FROM events"

# --- windows --------------------------------------------------------------------------------------

_WC = "wc AS (SELECT service, fingerprint, us // 300000000 AS window_id, count(*) AS cnt FROM parsed GROUP BY ALL)"
_SE = "se AS (SELECT service, us // 300000000 AS window_id, count(*) FILTER (level = 'ERROR') AS cnt FROM logs GROUP BY service, window_id)"


def _stats(part: str, value: str, n: int) -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY window_id RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"coalesce(sum({value}) {over}, 0)::HUGEINT AS s, coalesce(sum({value} * {value}) {over}, 0)::HUGEINT AS q"


def _mean(s: str, n: int) -> str:
    return f"({s}::DOUBLE / {float(n)}::DOUBLE)"


def _std(s: str, q: str, n: int) -> str:
    return f"sqrt(({n} * {q} - {s} * {s})::DOUBLE / {float(n * (n - 1))}::DOUBLE)" if n > 1 else "0.0::DOUBLE"


SQL["fingerprint_window_counts"] = f"WITH {_PARSED}, {_WC} SELECT * FROM wc"
SQL["service_error_windows"] = f"WITH {_LOGS}, {_SE} SELECT * FROM se"
SQL["fingerprint_baseline"] = f"""WITH {_PARSED}, {_WC}, b AS (SELECT *, {_stats('service, fingerprint', 'cnt', 288)} FROM wc)
  SELECT service, fingerprint, window_id, cnt, 288::BIGINT AS base_n, {_mean('s', 288)} AS base_mean, {_std('s', 'q', 288)} AS base_std FROM b"""
SQL["service_error_baseline"] = f"""WITH {_LOGS}, {_SE}, b AS (SELECT *, {_stats('service', 'cnt', 288)} FROM se)
  SELECT service, window_id, cnt, 288::BIGINT AS base_n, {_mean('s', 288)} AS base_mean, {_std('s', 'q', 288)} AS base_std FROM b"""
SQL["running_counts"] = f"""WITH {_KEYS} SELECT event_id, service, fingerprint, us // 300000000 AS window_id,
  count(*) OVER (PARTITION BY service, fingerprint, us // 300000000 ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS fp_count,
  (count(*) FILTER (level = 'ERROR') OVER (PARTITION BY service, us // 300000000 ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS svc_errors FROM ek"""
SQL["first_seen_sessions"] = f"""WITH {_KEYS}, k AS (SELECT service, fingerprint || '-' || user_id AS fingerprint, us, event_id FROM ek),
  g AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 172800000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM k WINDOW w AS (PARTITION BY service, fingerprint ORDER BY us, event_id)),
  n AS (SELECT *, sum(st) OVER (PARTITION BY service, fingerprint ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM g)
  SELECT service, fingerprint, min(us) AS first_seen_us, max(us) AS last_seen_us, count(*) AS cnt FROM n GROUP BY service, fingerprint, sess"""
SQL["fingerprints_in_count_range"] = f"""WITH {_KEYS}, c AS (SELECT service, fingerprint, us // 3600000000 AS window_id, count(*) AS cnt FROM ek GROUP BY ALL),
  t AS (SELECT window_id FROM c GROUP BY window_id ORDER BY sum(cnt) DESC, window_id DESC LIMIT 1)
  SELECT c.* FROM c JOIN t USING (window_id) WHERE cnt BETWEEN 2 AND 6"""
SQL["fingerprint_batches"] = f"""WITH {_PARSED}, r AS (SELECT *, row_number() OVER (PARTITION BY service, fingerprint ORDER BY us, event_id) AS rn FROM parsed)
  SELECT service, fingerprint, count(*) AS cnt, min(us) AS first_us, max(us) AS last_us, max(template) AS normalized_message,
    string_agg(event_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 5) AS sample_ids FROM r GROUP BY service, fingerprint"""

# --- detection ------------------------------------------------------------------------------------


def _detect(source: str, window: int, n: int, cold_spike=50, cold_new=5, cold_err=40, new=5) -> str:
    """CTE chain ending in ``det``: event by event over plain windows, no slots."""
    w = f"us // {window * 1_000_000}"
    cold_name = "'cold_start_24h_static'"
    return f"""ev AS (SELECT event_id, service, fingerprint, level = 'ERROR' AS err, us, {w} AS window_id FROM {source}),
  fc AS (SELECT service, fingerprint, window_id, count(*) AS cnt FROM ev GROUP BY ALL),
  sc AS (SELECT service, window_id, count(*) FILTER (err) AS cnt FROM ev GROUP BY service, window_id),
  fb AS (SELECT service, fingerprint, window_id, {_stats('service, fingerprint', 'cnt', n)} FROM fc),
  sb AS (SELECT service, window_id, {_stats('service', 'cnt', n)} FROM sc),
  gaps AS (SELECT *, CASE WHEN us - lag(us) OVER x >= 172800000000 OR lag(us) OVER x IS NULL THEN 1 ELSE 0 END AS st FROM ev WINDOW x AS (PARTITION BY service, fingerprint ORDER BY us, event_id)),
  runs AS (SELECT *, sum(st) OVER (PARTITION BY service, fingerprint ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM gaps),
  ctx AS (SELECT event_id, service, fingerprint, us, window_id,
      count(*) OVER (PARTITION BY service, fingerprint, window_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS fp_count,
      (count(*) FILTER (err) OVER (PARTITION BY service, window_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS svc_errors,
      us // 1000000 - (min(us) OVER (PARTITION BY service, fingerprint, sess)) // 1000000 < 86400 AS is_cold FROM runs),
  st AS (SELECT ctx.*, {_mean('fb.s', n)} AS fp_mean, {_std('fb.s', 'fb.q', n)} AS fp_std, {_mean('sb.s', n)} AS svc_mean, {_std('sb.s', 'sb.q', n)} AS svc_std
    FROM ctx JOIN fb USING (service, fingerprint, window_id) JOIN sb USING (service, window_id)),
  ru AS (SELECT *, CASE
      WHEN is_cold AND fp_count >= {cold_spike} THEN 1
      WHEN is_cold AND fp_mean = 0 AND fp_count > {cold_new} THEN 2
      WHEN is_cold AND svc_errors >= {cold_err} THEN 3
      WHEN is_cold THEN 0
      WHEN {n} >= 30 AND fp_std > 0 AND (fp_count - fp_mean) / nullif(fp_std, 0) > 3.0 THEN 4
      WHEN {n} >= 30 AND svc_std > 0 AND (svc_errors - svc_mean) / nullif(svc_std, 0) > 2.5 THEN 5
      WHEN svc_mean > 0 AND svc_errors >= svc_mean * 1.5::DOUBLE THEN 6
      WHEN fp_mean = 0 AND fp_count > {new} THEN 7 ELSE 0 END AS rule FROM st),
  det AS (SELECT *, [{', '.join(repr(x) for x in ('', 'SPIKE', 'NEW_ERROR', 'RATE_JUMP', 'SPIKE', 'RATE_JUMP', 'RATE_JUMP', 'NEW_ERROR'))}][rule + 1] AS anomaly_type,
      ['', {cold_name}, {cold_name}, {cold_name}, 'fingerprint_z', 'service_error_z', 'service_error_relative', 'new_fingerprint'][rule + 1] AS signal,
      CASE rule WHEN 0 THEN 0.0 WHEN 1 THEN fp_count::DOUBLE WHEN 3 THEN svc_errors::DOUBLE WHEN 4 THEN (fp_count - fp_mean) / nullif(fp_std, 0)
        WHEN 5 THEN (svc_errors - svc_mean) / nullif(svc_std, 0) WHEN 6 THEN svc_errors / nullif(svc_mean, 0) ELSE 1.0 END::DOUBLE AS score FROM ru)"""


_DET_OUT = """SELECT event_id, service, fingerprint, window_id, is_cold, fp_count, fp_mean, fp_std, svc_errors, svc_mean, svc_std, anomaly_type, score, signal,
  CASE WHEN rule = 0 THEN '' WHEN score > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM det"""
_HOURLY = f"{_KEYS}, {_detect('ek', 3600, 168)}"
SQL["detect_anomalies"] = f"WITH {_PARSED}, {_detect('parsed', 300, 288)} {_DET_OUT}"
SQL["detect_anomalies_hourly"] = f"WITH {_HOURLY} {_DET_OUT}"
SQL["stream_detections"] = SQL["detect_anomalies_hourly"]
SQL["stream_window_counts"] = f"WITH {_KEYS} SELECT service, fingerprint, us // 300000000 AS window_id, count(*) AS cnt FROM ek GROUP BY ALL"
SQL["stream_preprocess"] = f"""WITH {_RECORDS} SELECT 'dead' AS sink, value AS body, CASE event_id % 10 WHEN 0 THEN 'MalformedJson' WHEN 1 THEN 'MissingPayload' ELSE 'MissingField' END AS detail
  FROM rec WHERE event_id % 10 < 3 UNION ALL SELECT 'good', concat_ws('|', 'm-' || event_id, CASE event_id % 10 WHEN 4 THEN '7' ELSE 'tenant-' || (user_id % 4) END, key,
    CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END), event_type || ' ' || event_id FROM rec WHERE event_id % 10 >= 3"""
SQL["detect_cold"] = f"WITH {_KEYS}, {_detect('ek', 86400, 30, cold_spike=15, cold_err=20)} {_DET_OUT} WHERE is_cold AND rule > 0"
SQL["detect_spikes"] = f"WITH {_HOURLY} {_DET_OUT} WHERE NOT is_cold AND anomaly_type = 'SPIKE'"
SQL["detect_rate_jumps"] = f"WITH {_HOURLY} {_DET_OUT} WHERE NOT is_cold AND anomaly_type = 'RATE_JUMP'"
SQL["detect_new_errors"] = f"WITH {_KEYS}, {_detect('ek', 3600, 1, new=1)} {_DET_OUT} WHERE NOT is_cold AND anomaly_type = 'NEW_ERROR'"
SQL["detect_closed_windows"] = f"""WITH {_HOURLY}, last AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY service, fingerprint, window_id ORDER BY us DESC, event_id DESC) = 1),
  f AS (SELECT last.* EXCLUDE (svc_errors), sc.cnt AS svc_errors FROM last JOIN sc USING (service, window_id)),
  r AS (SELECT *, CASE WHEN is_cold AND fp_count >= 50 THEN 1 WHEN is_cold AND fp_mean = 0 AND fp_count > 5 THEN 2 WHEN is_cold AND svc_errors >= 40 THEN 3 WHEN is_cold THEN 0
      WHEN fp_std > 0 AND (fp_count - fp_mean) / nullif(fp_std, 0) > 3.0 THEN 4 WHEN svc_std > 0 AND (svc_errors - svc_mean) / nullif(svc_std, 0) > 2.5 THEN 5
      WHEN svc_mean > 0 AND svc_errors >= svc_mean * 1.5::DOUBLE THEN 6 WHEN fp_mean = 0 AND fp_count > 5 THEN 7 ELSE 0 END AS fin FROM f)
  SELECT service, fingerprint, window_id, fp_count, svc_errors, is_cold, ['', 'SPIKE', 'NEW_ERROR', 'RATE_JUMP', 'SPIKE', 'RATE_JUMP', 'RATE_JUMP', 'NEW_ERROR'][fin + 1] AS anomaly_type,
    CASE fin WHEN 0 THEN 0.0 WHEN 1 THEN fp_count::DOUBLE WHEN 3 THEN svc_errors::DOUBLE WHEN 4 THEN (fp_count - fp_mean) / nullif(fp_std, 0)
      WHEN 5 THEN (svc_errors - svc_mean) / nullif(svc_std, 0) WHEN 6 THEN svc_errors / nullif(svc_mean, 0) ELSE 1.0 END::DOUBLE AS score FROM r"""
_INC = f"""inc AS (SELECT *, {_incident('fingerprint', 'anomaly_type')} AS incident_id FROM
  (SELECT * FROM det WHERE rule > 0 QUALIFY row_number() OVER (PARTITION BY fingerprint, anomaly_type ORDER BY us, event_id) = 1))"""
SQL["open_incidents"] = f"""WITH {_HOURLY}, {_INC}, t AS (SELECT event_id, CASE WHEN user_id % 4 = 3 THEN 'default' ELSE 'tenant-' || (user_id % 4) END AS tenant_id FROM events)
  SELECT incident_id, fingerprint, anomaly_type, event_id, service, score, 'Anomaly: ' || anomaly_type || ' in ' || service AS title, 'Fingerprint ' || fingerprint AS summary,
    CASE WHEN score > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, tenant_id, us AS first_us FROM inc JOIN t USING (event_id)"""
SQL["stub_tickets"] = f"""WITH {_HOURLY}, {_INC} SELECT {_uuid3("'ticket:' || incident_id")} AS ticket_id, incident_id, 'Anomaly Detected: ' || anomaly_type || ' in ' || service AS title,
  CASE WHEN score > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, service, 'PENDING' AS status, 'Fingerprint: ' || fingerprint AS fingerprint_line,
  (CASE WHEN rule IN (5, 6) THEN svc_errors ELSE fp_count END)::DECIMAL(28,6)::VARCHAR AS current FROM inc"""
SQL["envelope_tickets"] = f"""WITH {_HOURLY}, {_INC} SELECT incident_id AS key, 0::BIGINT AS n_headers, 'tickets.new.v1' AS schema, {_uuid3("'ticket:' || incident_id")} AS "messageId",
  incident_id AS "incidentId", CASE WHEN score > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'PENDING' AS status FROM inc"""
SQL["ticket_upsert"] = f"""WITH {_HOURLY}, a AS (SELECT *, us < 1705363200000000 AS old FROM det WHERE rule > 0),
  f AS (SELECT *, {_incident('fingerprint', 'anomaly_type')} AS incident_id FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY fingerprint, anomaly_type ORDER BY us, event_id) = 1))
  SELECT incident_id, event_id, CASE WHEN old THEN 'CLOSED' ELSE 'OPEN' END AS status, CASE WHEN score > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM f"""
SQL["stored_tickets"] = f"""WITH {_HOURLY}, {_INC} SELECT {_incident('fingerprint', 'anomaly_type')} AS incident_id, event_id, CASE WHEN score > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  {_uuid3(f"'ticket:' || {_incident('fingerprint', 'anomaly_type')}")} AS ticket_id, 'Anomaly Detected: ' || anomaly_type || ' in ' || service AS title, 'PENDING' AS status FROM inc"""
SQL["event_audit"] = f"""WITH {_HOURLY}, {_INC}, k AS (SELECT DISTINCT fingerprint, anomaly_type, {_incident('fingerprint', 'anomaly_type')} AS iid FROM det WHERE rule > 0)
  SELECT d.event_id, {_uuid3("'run:' || d.event_id")} AS execution_id, coalesce(k.iid, {_uuid3("'run:' || d.event_id")}) AS run_key,
    CASE WHEN i.event_id IS NOT NULL THEN 'TICKETED' ELSE 'DISCARDED' END AS status, d.us AS started_us
  FROM det d LEFT JOIN inc i ON i.event_id = d.event_id LEFT JOIN k ON k.fingerprint = d.fingerprint AND k.anomaly_type = d.anomaly_type"""

# --- retrieval ------------------------------------------------------------------------------------

_CORPUS = "corp AS (SELECT doc_id AS id, embedding::DOUBLE[] AS vec, label::BIGINT AS label, text AS content, source FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"
_LABELQ = """dims AS (SELECT label, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM corp WHERE vec IS NOT NULL),
  avgs AS (SELECT label, pos, avg(x) AS x FROM dims GROUP BY label, pos),
  qv AS (SELECT label AS query_id, list(x ORDER BY pos) AS qvec FROM avgs GROUP BY label),
  qt AS (SELECT label AS query_id, arg_min(content, id) AS qtext FROM corp WHERE label IS NOT NULL GROUP BY label)"""


def _vec(queries: str, k: int, where: str = "true") -> str:
    return f"""vd AS (SELECT query_id, id, round(list_cosine_distance(vec, qvec), 9) + 0.0 AS distance FROM {queries}, corp WHERE {where}),
  vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rnk FROM vd QUALIFY rnk <= {k})"""


def _grams(src: str, idcol: str, textcol: str, name: str) -> str:
    """Distinct padded word trigrams of a text column, one row each."""
    return f"""{name}_w AS (SELECT DISTINCT {idcol} AS k, w FROM (SELECT {idcol}, unnest(regexp_extract_all(lower({textcol}), '[\\pL\\pN]+')) AS w FROM {src})),
  {name}_c AS (SELECT k, string_split('  ' || w || ' ', '') AS ch FROM {name}_w),
  {name}_g AS (SELECT DISTINCT k, ch[i] || ch[i+1] || ch[i+2] AS g FROM (SELECT k, ch, unnest(range(1, len(ch) - 1)) AS i FROM {name}_c)),
  {name}_n AS (SELECT k, count(*) AS n FROM {name}_g GROUP BY k)"""


def _lex(k: int, where: str = "true", extra: str = "") -> str:
    """Ranks over gram tables ``q_*`` and ``d_*``."""
    return f"""sh AS (SELECT q_g.k AS query_id, d_g.k AS id, count(*) AS shared FROM q_g JOIN d_g USING (g) GROUP BY ALL),
  sim AS (SELECT query_id, id, shared::DOUBLE / (q_n.n + d_n.n - shared)::DOUBLE AS similarity FROM sh JOIN q_n ON q_n.k = query_id JOIN d_n ON d_n.k = id {extra} WHERE {where}),
  lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rnk FROM sim WHERE similarity > 0.3 QUALIFY rnk <= {k})"""


_FUSED = """fu AS (SELECT query_id, id, coalesce(vr.rnk, 0) AS vec_rank, coalesce(lr.rnk, 0) AS lex_rank,
    coalesce(1.0::DOUBLE / (60 + vr.rnk)::DOUBLE, 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + lr.rnk)::DOUBLE, 0.0::DOUBLE) AS rrf_score FROM vr FULL OUTER JOIN lr USING (query_id, id))"""
_LABEL_GRAMS = f"{_grams('corp', 'id', 'content', 'd')}, {_grams('qt', 'query_id', 'qtext', 'q')}"
SQL["vector_topk"] = f"WITH {_CORPUS}, {_LABELQ}, {_vec('qv', 20)} SELECT query_id, id, distance, rnk FROM vr"
SQL["vector_neighbours"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_distance(b.v, a.v), 9) + 0.0 AS distance FROM e a, e b)
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rnk FROM d QUALIFY rnk <= 5"""
SQL["lexical_topk"] = f"""WITH {_grams('documents', 'doc_id', 'text', 'd')}, {_grams('benchmark', 'item_id', 'text', 'q')}, {_lex(10)} SELECT query_id, id, similarity, rnk FROM lr"""
SQL["vector_cells"] = SQL["vector_neighbours"]
SQL["lexical_postings"] = SQL["lexical_topk"]
SQL["rank_fusion"] = f"WITH {_CORPUS}, {_LABELQ}, {_vec('qv', 20)}, {_LABEL_GRAMS}, {_lex(20)}, {_FUSED} SELECT query_id, id, vec_rank, lex_rank, rrf_score FROM fu"
SQL["hybrid_search"] = f"""WITH {_CORPUS}, {_LABELQ}, {_vec('qv', 50)}, {_LABEL_GRAMS}, {_lex(50)}, {_FUSED},
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rnk FROM fu QUALIFY rnk <= 10)
  SELECT query_id, id, content, rrf_score AS score, rnk FROM top JOIN corp USING (id)"""
_CODE = "code AS (SELECT id, vec, 'svc-' || (label % 3) AS repo, CASE WHEN id % 9 <> 0 THEN content ELSE 'src/' || source || '.java com.example.C' || id END AS content FROM corp)"
SQL["hybrid_code_search"] = f"""WITH {_CORPUS}, {_CODE}, own AS (SELECT * FROM code WHERE repo = 'svc-1'), {_LABELQ},
  vd AS (SELECT query_id, id, round(list_cosine_distance(vec, qvec), 9) + 0.0 AS distance FROM qv, own),
  vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rnk FROM vd QUALIFY rnk <= 50),
  {_grams('own', 'id', 'content', 'd')}, {_grams('qt', 'query_id', 'qtext', 'q')}, {_lex(50)}, {_FUSED},
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rnk FROM fu QUALIFY rnk <= 10)
  SELECT query_id, id, content, 'code_embeddings' AS corpus, rrf_score AS score, rnk FROM top JOIN own USING (id)"""
SQL["corpus_filter"] = f"WITH {_CORPUS}, {_CODE} SELECT id, repo, content FROM code WHERE repo = 'svc-1'"


def _fake(src: str, idcol: str, textcol: str, dim: int, name: str) -> str:
    """Rows (k, pos, value) of the stand-in vectors, by a recursion over positions."""
    two64 = "18446744073709551616::HUGEINT"
    return f"""{name}_h AS (SELECT {idcol} AS k, list_reduce(list_prepend(0::BIGINT, flatten(list_transform(string_split({textcol}, ''), lambda ch:
      CASE WHEN unicode(ch) > 65535 THEN [55296 + ((unicode(ch) - 65536) >> 10), 56320 + ((unicode(ch) - 65536) & 1023)]::BIGINT[] ELSE [unicode(ch)]::BIGINT[] END))),
      lambda h, u: (h * 31 + u) % 4294967296) AS h FROM {src}),
  {name}_s AS (SELECT k, -1::BIGINT AS pos, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::HUGEINT AS seed FROM {name}_h
    UNION ALL SELECT k, pos + 1, CASE WHEN m >= 9223372036854775808::HUGEINT THEN m - {two64} ELSE m END FROM
      (SELECT k, pos, ((seed * 31 + pos + 1) % {two64} + {two64}) % {two64} AS m FROM {name}_s WHERE pos + 1 < {dim})),
  {name}_v AS (SELECT k, pos, ((seed % 1000)::FLOAT / 1000::FLOAT)::FLOAT::DOUBLE AS value FROM {name}_s WHERE pos >= 0)"""


SQL["embed_texts"] = f"""WITH RECURSIVE {_fake('documents', 'doc_id', 'text', 1536, 'f')} SELECT k AS doc_id, count(*) AS n_values, sum((seed % 1000) * (pos + 1))::BIGINT AS weighted_sum FROM f_s WHERE pos >= 0 GROUP BY k"""
SQL["anomaly_context"] = f"""WITH RECURSIVE {_HOURLY}, {_INC}, {_CORPUS}, {_CODE}, ask AS (SELECT DISTINCT service || '|' || fingerprint AS query_id, service, fingerprint AS qtext FROM inc),
  {_fake('ask', 'query_id', 'qtext', 64, 'f')}, qv AS (SELECT k AS query_id, list(value ORDER BY pos) AS qvec FROM f_v GROUP BY k),
  vd AS (SELECT query_id, id, round(list_cosine_distance(code.vec, qvec), 9) + 0.0 AS distance FROM qv JOIN ask USING (query_id) JOIN code ON code.repo = ask.service),
  vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rnk FROM vd QUALIFY rnk <= 50),
  {_grams('code', 'id', 'content', 'd')}, {_grams('ask', 'query_id', 'qtext', 'q')},
  {_lex(50, 'code.repo = ask.service', 'JOIN ask USING (query_id) JOIN code USING (id)')}, {_FUSED},
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rnk FROM fu QUALIFY rnk <= 10)
  SELECT incident_id, id, rrf_score AS score, rnk FROM top JOIN inc ON inc.service || '|' || inc.fingerprint = query_id"""

SQL["anomaly_context_templates"] = SQL["anomaly_context"].replace(
    f"{_INC},", f"{_INC}, {_PARSED}, asked AS (SELECT incident_id, inc.service, CASE WHEN inc.fingerprint = 'view' THEN inc.fingerprint ELSE template END AS q FROM inc JOIN parsed USING (event_id)),", 1).replace(
    "SELECT DISTINCT service || '|' || fingerprint AS query_id, service, fingerprint AS qtext FROM inc", "SELECT DISTINCT service || '|' || q AS query_id, service, q AS qtext FROM asked").replace(
    "FROM top JOIN inc ON inc.service || '|' || inc.fingerprint = query_id", "FROM top JOIN asked a ON a.service || '|' || a.q = query_id")

# --- embedding ------------------------------------------------------------------------------------

_REQ = """req AS (SELECT doc_id AS seq, text, sha256(text) AS h, doc_id % 3 AS m, CASE doc_id % 3 WHEN 0 THEN 'LOGS' WHEN 1 THEN 'CODE' ELSE 'INCIDENTS' END AS corpus,
  CASE WHEN doc_id % 3 = 2 THEN 'inc-' || (doc_id % 50) WHEN doc_id % 2 = 0 THEN source END AS content_id,
  source AS repo, lang AS git_sha, 'f' || (doc_id % 7) AS file_path, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'c' || (doc_id % 5) END AS fqn,
  1704067200 + doc_id * 3600 AS sec FROM documents)"""


def _chain(src: str, key: str, ttl: int, where: str = "true") -> str:
    return f"""ch AS (SELECT {key} AS k, min(sec) AS a FROM {src} WHERE {where} GROUP BY {key}
    UNION ALL SELECT ch.k, min(s.sec) FROM ch JOIN {src} s ON s.{key} = ch.k AND s.sec >= ch.a + {ttl} WHERE {where} GROUP BY ch.k)"""


SQL["embed_batch_dedup"] = f"""WITH {_REQ} SELECT seq // 32 AS batch_id, h AS content_hash, count(*) AS n_requests, min(seq) AS first_seq, any_value(text) AS text FROM req GROUP BY ALL"""
SQL["embed_cache_hits"] = f"""WITH RECURSIVE {_REQ}, {_chain('req', 'h', 604800)}, w AS (SELECT h, sec, min(seq) AS seq FROM req JOIN ch ON ch.k = h AND ch.a = sec GROUP BY h, sec)
  SELECT req.seq, req.h AS content_hash, w.seq IS NULL AS is_hit FROM req LEFT JOIN w ON w.seq = req.seq"""
SQL["stream_cache_hits"] = SQL["embed_cache_hits"]
SQL["embed_savings"] = f"""WITH RECURSIVE {_REQ}, {_chain('req', 'h', 604800)}, w AS (SELECT DISTINCT k, a FROM ch),
  t AS (SELECT (SELECT count(*) FROM req) AS requests, (SELECT count(DISTINCT h) FROM req) AS distinct_texts, (SELECT count(*) FROM (SELECT DISTINCT seq // 32, h FROM req)) AS batch_texts,
    (SELECT count(*) FROM w) AS model_calls) SELECT *, 1.0::DOUBLE - model_calls::DOUBLE / requests::DOUBLE AS saved_share FROM t"""
_CACHE = "cache AS (SELECT sha256(content) AS h, arg_min(vec, id) AS v FROM corp WHERE vec IS NOT NULL GROUP BY sha256(content))"
SQL["embedding_cache_lookup"] = f"""WITH {_REQ}, {_CORPUS}, {_CACHE},
  flat AS (SELECT h, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM cache),
  u AS (SELECT h, count(*) AS n FROM req GROUP BY h)
  SELECT u.h AS content_hash, n AS n_requests, cache.h IS NOT NULL AS cached, coalesce(pos, -1) AS pos, coalesce(value, 0.0) AS value
  FROM u LEFT JOIN cache ON cache.h = u.h LEFT JOIN flat ON flat.h = u.h"""
SQL["embed_corpus_counts"] = f"WITH {_REQ} SELECT corpus, count(*) AS processed FROM req GROUP BY corpus"


def _upsert(keys: dict[str, str], where: str, columns: str) -> str:
    """Net effect of all requests per key; the vector is that of the later half's last request, else of the earlier's."""
    names, exprs = ", ".join(keys), ", ".join(f"{x} AS {k}" for k, x in keys.items())
    return f"""WITH {_REQ}, {_CORPUS}, {_CACHE}, r AS (SELECT {exprs}, seq, text, h, sec, sec < 1705363200 AS old FROM req WHERE {where}),
  halves AS (SELECT {names}, old, arg_max(h, seq) AS h, max(seq) AS seq FROM r GROUP BY ALL),
  vec AS (SELECT {names}, arg_max(v, seq) AS v FROM halves JOIN cache USING (h) GROUP BY ALL),
  flat AS (SELECT {names}, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM vec),
  main AS (SELECT {names}, {columns}, max(sec) * 1000000 AS last_seen_us FROM r GROUP BY {names})
  SELECT main.*, coalesce(pos, -1) AS pos, coalesce(value, 0.0) AS value FROM main LEFT JOIN flat USING ({names})"""


SQL["upsert_log_corpus"] = _upsert({"fingerprint": "coalesce(content_id, h)"}, "corpus = 'LOGS'",
                                   "arg_max(text, seq) AS content, arg_max(h, seq) AS content_hash, max(seq) AS seq, count(*) AS sample_count")
SQL["upsert_code_corpus"] = _upsert({k: k for k in ("repo", "git_sha", "file_path", "fqn")}, "corpus = 'CODE' AND fqn IS NOT NULL",
                                    "arg_max(h, seq) AS content_hash, max(seq) AS seq")
SQL["upsert_incident_corpus"] = _upsert({"incident_id": "content_id"}, "corpus = 'INCIDENTS'", "arg_max(text, seq) AS content, max(seq) AS seq")
SQL["incident_fk_check"] = f"WITH {_REQ} SELECT seq, content_id IN (SELECT 'inc-' || doc_id FROM labels) AS known FROM req WHERE corpus = 'INCIDENTS'"

# --- ledger ---------------------------------------------------------------------------------------

_CALLS = """calls AS (SELECT *, CASE WHEN failed THEN est ELSE tin + tout END AS charge FROM (
  SELECT (conv_id * 1000 + turn) * 3 + k AS call_id, text AS prompt, 'agent-' || (turn % 3) AS agent,
  ['TINY', 'SMALL', 'MEDIUM', 'LARGE'][(conv_id + turn) % 4 + 1] AS tier, (conv_id + turn + 2 * k) % 7 = 0 AS failed, length(text) // 4 AS est,
  length(text) // 4 + turn % 3 AS tin, length(text) // 8 + 5 AS tout, 1704067200 + conv_id * 3600 + turn * 60 + [0, 18000, 108000][k + 1] AS sec,
  sha256(text) AS h, ['model-xs', 'model-s', 'model-m', 'model-l'][(conv_id + turn) % 4 + 1] AS model
  FROM conversations, (SELECT unnest(range(0, 3)) AS k)))"""
_PRICE = "{0}::DOUBLE / 1000.0::DOUBLE * 0.0001::DOUBLE"
_HITS = f"""{_chain('calls', 'h', 86400, 'NOT failed')},
  w AS (SELECT h, sec, min(call_id) AS call_id FROM calls JOIN ch ON ch.k = h AND ch.a = sec WHERE NOT failed GROUP BY h, sec),
  hits AS (SELECT c.call_id, CASE WHEN c.failed THEN EXISTS (SELECT 1 FROM w WHERE w.h = c.h AND (w.sec, w.call_id) < (c.sec, c.call_id) AND c.sec - w.sec < 86400)
    ELSE c.call_id NOT IN (SELECT call_id FROM w) END AS is_hit FROM calls c)"""
SQL["response_cache_hits"] = f"WITH RECURSIVE {_CALLS}, {_HITS} SELECT call_id, h AS prompt_hash, is_hit FROM calls JOIN hits USING (call_id)"
SQL["call_cost"] = f"""WITH {_CALLS} SELECT call_id, charge AS charged_tokens, {_PRICE.format('est')} AS est_cost, {_PRICE.format('charge')} AS actual_cost,
  CASE WHEN failed THEN -1 ELSE tin - est END AS estimation_delta FROM calls"""


def _lvl(x: str, total: int = 20000) -> str:
    return f"CASE WHEN {x} < {total * 7 // 10} THEN 'NORMAL' WHEN {x} < {total * 9 // 10} THEN 'DEGRADED' WHEN {x} < {total} THEN 'CRITICAL' ELSE 'EXHAUSTED' END"


SQL["daily_spend"] = f"""WITH {_CALLS}, g AS (SELECT strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, sum(charge)::BIGINT AS tokens FROM calls GROUP BY 1)
  SELECT day, tokens, {_PRICE.format('tokens')} AS current_spend_usd, 0.002::DOUBLE AS daily_budget_limit_usd, ({_PRICE.format('tokens')}) / 0.002::DOUBLE * 100 AS utilization_percentage, {_lvl('tokens')} AS level FROM g"""
SQL["running_spend"] = f"""WITH {_CALLS}, r AS (SELECT call_id, (sum(charge) OVER (PARTITION BY sec // 86400 ORDER BY sec, call_id ROWS UNBOUNDED PRECEDING))::BIGINT AS t FROM calls)
  SELECT call_id, t AS spent_tokens, {_PRICE.format('t')} AS spend_usd, {_lvl('t')} AS level FROM r"""
SQL["budget_admission"] = f"""WITH RECURSIVE {_CALLS}, o AS (SELECT *, sec // 86400 AS day, row_number() OVER (PARTITION BY sec // 86400 ORDER BY sec, call_id) AS rn FROM calls),
  walk AS (SELECT day, 0::BIGINT AS rn, 0::BIGINT AS call_id, 0::BIGINT AS spent_before, '' AS decision, 0::BIGINT AS charged FROM o GROUP BY day
    UNION ALL SELECT o.day, o.rn, o.call_id, walk.spent_before + walk.charged,
      CASE WHEN walk.spent_before + walk.charged + o.est >= 20000 THEN 'DENY' WHEN walk.spent_before + walk.charged + o.est >= 14000 THEN 'DEGRADE' ELSE 'ALLOW' END,
      CASE WHEN walk.spent_before + walk.charged + o.est >= 20000 THEN 0 ELSE o.charge END FROM walk JOIN o ON o.day = walk.day AND o.rn = walk.rn + 1)
  SELECT call_id, spent_before, decision, {_lvl('spent_before')} AS level, charged FROM walk WHERE rn > 0"""
# call by call: what the day has spent, and when each prompt's answer was last stored (a stub's, too)
SQL["call_gateway"] = f"""WITH RECURSIVE {_CALLS},
  o AS (SELECT *, sec // 86400 AS day, dense_rank() OVER (ORDER BY h) AS p, row_number() OVER (ORDER BY sec, call_id) AS rn FROM calls),
  walk AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS call_id, '' AS tier, 0::BIGINT AS day, 0::BIGINT AS spent, 0::BIGINT AS spent_before, false AS is_hit,
      '' AS decision, 0::BIGINT AS charged, MAP {{0::BIGINT: -100000::BIGINT}} AS stored
    UNION ALL SELECT rn, call_id, tier, day, before + charged, before, is_hit, decision, charged,
      CASE WHEN is_hit OR (failed AND decision <> 'DENY') THEN stored ELSE map_concat(stored, MAP {{p: sec}}) END
    FROM (SELECT *, CASE WHEN is_hit OR decision = 'DENY' THEN 0 ELSE charge END AS charged
      FROM (SELECT *, CASE WHEN is_hit THEN 'CACHED' WHEN before + est >= 5000 THEN 'DENY' WHEN before + est >= 3500 THEN 'DEGRADE' ELSE 'ALLOW' END AS decision
        FROM (SELECT o.rn, o.call_id, o.tier, o.day, o.est, o.charge, o.failed, o.p, o.sec, w.stored, CASE WHEN o.day = w.day THEN w.spent ELSE 0 END AS before,
            coalesce(o.sec - w.stored[o.p] < 86400, false) AS is_hit FROM walk w JOIN o ON o.rn = w.rn + 1)))),
  l AS (SELECT *, {_lvl('spent_before', 5000)} AS level FROM walk WHERE rn > 0),
  r AS (SELECT *, CASE WHEN decision = 'DEGRADE' AND level = 'NORMAL' THEN 'DEGRADED' ELSE level END AS rl FROM l),
  e AS (SELECT *, CASE WHEN rl = 'DEGRADED' AND tier = 'LARGE' THEN 'MEDIUM' WHEN rl = 'CRITICAL' THEN 'SMALL' ELSE tier END AS et FROM r)
  SELECT call_id, is_hit, decision, CASE WHEN is_hit THEN '' ELSE level END AS level, CASE WHEN is_hit THEN 'cache' WHEN rl = 'EXHAUSTED' OR decision = 'DENY' THEN 'stub'
    WHEN et = 'TINY' THEN 'model-xs' WHEN et = 'SMALL' THEN 'model-s' WHEN et = 'MEDIUM' THEN 'model-m' ELSE 'model-l' END AS model, charged FROM e"""
SQL["tier_routing"] = f"""WITH {_CALLS}, a AS (SELECT call_id, tier, ['NORMAL','DEGRADED','CRITICAL','EXHAUSTED'][call_id % 7 % 4 + 1] AS lvl, ['ALLOW','DEGRADE','DENY'][call_id % 5 % 3 + 1] AS dec FROM calls),
  b AS (SELECT *, CASE WHEN dec = 'DEGRADE' AND lvl = 'NORMAL' THEN 'DEGRADED' ELSE lvl END AS rl FROM a),
  e AS (SELECT *, CASE WHEN rl = 'DEGRADED' AND tier = 'LARGE' THEN 'MEDIUM' WHEN rl = 'CRITICAL' THEN 'SMALL' ELSE tier END AS et FROM b)
  SELECT call_id, tier, lvl, dec, et AS effective_tier, CASE WHEN rl = 'EXHAUSTED' OR dec = 'DENY' THEN 'stub' WHEN et = 'TINY' THEN 'model-xs' WHEN et = 'SMALL' THEN 'model-s'
    WHEN et = 'MEDIUM' THEN 'model-m' ELSE 'model-l' END AS model FROM e"""
SQL["call_usage"] = f"""WITH RECURSIVE {_CALLS}, {_HITS} SELECT model, agent, CASE WHEN is_hit THEN 'hit' ELSE 'miss' END AS cache, count(*) AS calls,
  sum(CASE WHEN is_hit OR failed THEN 0 ELSE tin END)::BIGINT AS tokens_in, sum(CASE WHEN is_hit OR failed THEN 0 ELSE tout END)::BIGINT AS tokens_out
  FROM calls JOIN hits USING (call_id) GROUP BY ALL"""

# --- consensus, priority, evaluation --------------------------------------------------------------

_FIND = """find AS (SELECT 'inc-' || doc_id AS incident_id, doc_id, i, ['Backend Engineer','DevOps Engineer','Frontend Engineer','Full Stack Engineer','System Analyst'][i + 1] AS role,
    ['NullPointerException','TimeoutException','SQLException'][(doc_id + i * i) % 3 + 1] AS error_type,
    CASE WHEN (doc_id * 7 + i * i) % 5 < 2 THEN 'APPLICATION' WHEN (doc_id * 7 + i * i) % 5 < 4 THEN 'DATA_ACCESS' ELSE 'INFRASTRUCTURE' END AS layer,
    ((doc_id * 13 + i * 29) % 100)::DOUBLE / 100.0::DOUBLE * CASE WHEN doc_id % 10 = 3 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS confidence, lang || ' view ' || i AS rationale
  FROM documents, (SELECT unnest(range(0, 5)) AS i))"""
_VERD = """top AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY votes DESC, layer DESC) AS rn FROM (
    SELECT incident_id, layer, count(*) AS votes, max(confidence) AS conf FROM find GROUP BY ALL)),
  lead AS (SELECT incident_id, layer, error_type, row_number() OVER (PARTITION BY incident_id, layer ORDER BY confidence DESC, role DESC) AS rn FROM find),
  mx AS (SELECT incident_id, count(*) AS n_findings, max(confidence) AS max_confidence FROM find GROUP BY incident_id),
  verd AS (SELECT incident_id, n_findings, max_confidence, CASE WHEN rev THEN 'REVIEW_NEEDED' ELSE et END AS agreed_error_type, CASE WHEN rev THEN 'REVIEW_NEEDED' ELSE layer END AS primary_layer,
      CASE WHEN rev THEN max_confidence ELSE conf END AS confidence, CASE WHEN rev THEN 0 ELSE votes END AS votes FROM (
    SELECT mx.*, t.layer, t.conf, t.votes, l.error_type AS et, max_confidence < 0.4 OR votes < n_findings // 2 + 1 AS rev
    FROM mx JOIN top t ON t.incident_id = mx.incident_id AND t.rn = 1 JOIN lead l ON l.incident_id = mx.incident_id AND l.layer = t.layer AND l.rn = 1))"""
SQL["persona_fanout"] = "SELECT 'inc-' || doc_id AS incident_id, role, length(text) AS n FROM documents, (SELECT unnest(['Backend Engineer','DevOps Engineer','Frontend Engineer','Full Stack Engineer','System Analyst']) AS role)"
SQL["parse_findings"] = f"""WITH {_FIND} SELECT incident_id, role, CASE WHEN doc_id % 6 < 2 THEN 'UNKNOWN' ELSE error_type END AS error_type, CASE WHEN doc_id % 6 < 2 THEN 'UNKNOWN' ELSE layer END AS layer,
  CASE WHEN doc_id % 6 < 2 THEN 0 ELSE 2 END::BIGINT AS n_files, CASE WHEN doc_id % 6 < 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, doc_id % 6 < 2 AS parse_failed FROM find"""
SQL["consensus_gate"] = f"WITH {_FIND}, {_VERD} SELECT * FROM verd"
SQL["consensus_dissent"] = f"""WITH {_FIND}, {_VERD} SELECT f.incident_id, f.role, f.layer AS minority_layer, f.rationale AS minority_view FROM find f JOIN verd v USING (incident_id)
  WHERE v.primary_layer <> 'REVIEW_NEEDED' AND f.layer <> v.primary_layer"""
SQL["incident_outcome"] = f"""WITH {_FIND}, {_VERD} SELECT incident_id, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'DISCARDED' WHEN agreed_error_type = 'REVIEW_NEEDED' THEN 'DEGRADED' ELSE 'TICKETED' END AS status
  FROM verd LEFT JOIN labels l ON 'inc-' || l.doc_id = incident_id"""
SQL["root_cause_shortcut"] = f"""WITH {_FIND}, {_VERD} SELECT incident_id, CASE WHEN agreed_error_type = 'REVIEW_NEEDED' THEN 'Manual review required — swarm could not reach consensus'
    WHEN agreed_error_type IN ('NullPointerException', 'TimeoutException') THEN '' ELSE 'UNHANDLED_MOCK_STATE' END AS cause, 0::BIGINT AS n_evidence,
  CASE agreed_error_type WHEN 'REVIEW_NEEDED' THEN confidence WHEN 'NullPointerException' THEN 0.92 WHEN 'TimeoutException' THEN 0.85 ELSE -1.0 END::DOUBLE AS cause_confidence FROM verd"""
SQL["draft_ticket"] = """SELECT doc_id, 't' AS title, 'd' AS description, '' AS repro_steps, 'f' AS fix_suggestion,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE lang || ',' || source END AS files FROM documents"""
SQL["ticket_priority"] = """WITH p AS (SELECT event_id, 3 * (CASE WHEN user_id % 3 = 0 THEN 5 ELSE 2 END)
    * (CASE WHEN ts::TIME > TIME '08:00:00' AND ts::TIME < TIME '18:00:00' THEN 1 ELSE 3 END)::BIGINT AS s FROM events)
  SELECT event_id, s AS priority_score, CASE WHEN s > 30 THEN 'P0' WHEN s >= 15 THEN CASE WHEN event_id % 2 = 0 THEN 'P1' ELSE 'P2' END WHEN s > 5 THEN 'P2' ELSE 'P3' END AS calculated_severity,
    'ENGINEERING_QUEUE' AS routing_queue, CASE WHEN s BETWEEN 15 AND 30 THEN 'LLM mediated tiebreaker adjustment. Base score: ' ELSE 'Deterministic score metrics: ' END || s AS justification FROM p"""
SQL["resolve_incidents"] = """WITH a AS (SELECT doc_id, lang, coalesce(quality, 1) = 1 AS an, source, doc_id % 24 AS hr FROM documents LEFT JOIN labels USING (doc_id)),
  b AS (SELECT *, an AND lang NOT IN ('de','es','zh','fr') AS ok, 3 * CASE WHEN source = 'src1' THEN 5 ELSE 2 END * CASE WHEN hr > 8 AND hr < 18 THEN 1 ELSE 3 END AS sc FROM a)
  SELECT 'inc-' || doc_id AS incident_id, CASE WHEN NOT an THEN 'DISCARDED' WHEN ok THEN 'TICKETED' ELSE 'DEGRADED' END AS status,
    CASE WHEN NOT an THEN '' WHEN ok THEN 'E' ELSE 'REVIEW_NEEDED' END AS agreed_error_type, CASE WHEN NOT an THEN '' WHEN ok THEN 'APPLICATION' ELSE 'REVIEW_NEEDED' END AS primary_layer,
    CASE WHEN NOT ok THEN '' WHEN sc > 30 THEN 'P0' WHEN sc >= 15 THEN 'P1' WHEN sc > 5 THEN 'P2' ELSE 'P3' END AS calculated_severity,
    CASE WHEN ok THEN 'found' ELSE '' END AS cause, CASE WHEN ok THEN 'A.java' ELSE '' END AS files FROM b"""
_EVAL = """ev AS (SELECT doc_id, list_transform(range(0, doc_id % 8 + 1), lambda i: 'f' || ((doc_id + i * i) % 9)) AS sug, list_transform(range(0, doc_id % 4 + 1), lambda i: 'f' || ((doc_id + i * 2) % 9)) AS exp,
  CASE doc_id % 3 WHEN 0 THEN 'application' ELSE 'DATA_ACCESS' END AS expected_layer FROM documents),
  pk AS (SELECT *, len(list_filter(sug[1:5], lambda x: list_contains(exp, x))) AS hits FROM ev)"""
SQL["precision_at_k"] = f"WITH {_EVAL} SELECT doc_id, hits, hits::DOUBLE / 5.0::DOUBLE AS precision_at_k, hits::DOUBLE / least(5, len(exp))::DOUBLE AS reachable_precision FROM pk"
SQL["layer_accuracy"] = f"""WITH {_EVAL}, {_FIND}, {_VERD}, a AS (SELECT count(*) AS n, round(avg(CASE WHEN lower(primary_layer) = lower(expected_layer) THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS layer_accuracy,
    round(avg(hits::DOUBLE / 5.0::DOUBLE), 9) AS precision_at_k FROM pk JOIN verd ON incident_id = 'inc-' || doc_id) SELECT *, precision_at_k >= 0.70 AND layer_accuracy >= 0.60 AS passed FROM a"""

# --- metrics --------------------------------------------------------------------------------------

SQL["throughput_rate"] = f"WITH {_KEYS} SELECT us // 60000000 * 60 AS window_start_s, service, count(*) AS cnt, count(*)::DOUBLE / 60.0::DOUBLE AS per_second FROM ek GROUP BY ALL"
SQL["terminal_states"] = f"""WITH {_HOURLY}, {_INC}, a AS (SELECT d.us, CASE WHEN i.event_id IS NOT NULL THEN 'TICKETED' ELSE 'DISCARDED' END AS status FROM det d LEFT JOIN inc i ON i.event_id = d.event_id)
  SELECT us // 60000000 * 60 AS window_start_s, status, count(*) AS cnt, count(*)::DOUBLE / 60.0::DOUBLE AS per_second FROM a GROUP BY ALL"""
SQL["hourly_cost"] = f"""WITH {_CALLS}, g AS (SELECT sec // 3600 * 3600 AS hour_s, model, sum(charge)::BIGINT AS tokens FROM calls GROUP BY ALL)
  SELECT *, {_PRICE.format('tokens')} AS cost_usd, ({_PRICE.format('tokens')}) / 0.002::DOUBLE AS share_of_cap FROM g"""
SQL["latency_percentiles"] = """WITH m AS (SELECT event_type, round(value * 100)::BIGINT AS ms FROM events) SELECT event_type, count(*) AS cnt, round(quantile_cont(ms, 0.5), 6) AS p50,
  round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM m GROUP BY event_type"""
SQL["latency_sketches"] = """SELECT event_type, count(*) AS cnt, p, true AS within FROM events, (SELECT unnest([50, 95, 99])::BIGINT AS p) GROUP BY event_type, p"""
SQL["distinct_text_sketches"] = f"""WITH {_REQ} SELECT corpus, count(*) AS rows, count(DISTINCT text) AS texts, true AS within FROM req GROUP BY corpus"""
SQL["anomaly_counts"] = f"""WITH {_HOURLY} SELECT anomaly_type, CASE WHEN score > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, floor(abs(score))::BIGINT AS score_bucket, count(*) AS cnt FROM det WHERE rule > 0 GROUP BY ALL"""
_DLQ = """dl AS (SELECT CASE event_type WHEN 'click' THEN 'logs.preprocessed.dlq' WHEN 'purchase' THEN 'tickets.new.dlq' ELSE 'logs.raw.dlq' END AS topic, event_id % 3 AS "partition",
  event_id // 3 AS "offset", 'k' || user_id AS key, props AS value FROM events)"""
SQL["dlq_tail"] = f"""WITH {_DLQ}, r AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY "offset" DESC) AS rn, (SELECT count(DISTINCT "partition") FROM dl WHERE topic = 'logs.raw.dlq') AS np FROM dl WHERE topic = 'logs.raw.dlq')
  SELECT "partition", "offset", key, value AS value_preview FROM r WHERE rn <= (20 + np - 1) // np ORDER BY rn, "partition" LIMIT 20"""
SQL["dlq_backlog"] = f"""WITH {_DLQ}, p AS (SELECT topic, "partition", max("offset") + 1 - min("offset") AS n FROM dl GROUP BY ALL) SELECT topic, sum(n)::BIGINT AS backlog FROM p GROUP BY topic"""
SQL["fingerprints_per_service"] = f"WITH {_PARSED} SELECT service, fingerprint, count(*) AS cnt FROM parsed GROUP BY ALL"
SQL["validate_batches"] = """SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS batch_id, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) > 3"""
SQL["retrieval_eval"] = f"""WITH {_grams('documents', 'doc_id', 'text', 'd')}, {_grams('benchmark', 'item_id', 'text', 'q')}, {_lex(5).replace('> 0.3', '> 0.1')},
  h AS (SELECT query_id, count(*) AS found, count(*) FILTER (contains(d.text, b.text)) AS hits FROM lr JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id GROUP BY query_id)
  SELECT item_id AS query_id, coalesce(found, 0) AS found, coalesce(hits, 0) AS hits, coalesce(hits, 0) / 5.0::DOUBLE AS precision_at_5 FROM benchmark LEFT JOIN h ON query_id = item_id"""


def _evidence(rules: str, chain: str, n: int, spike: int, rate: int) -> str:
    """Keys and values of the first report of each incident under one set of rules."""
    num = lambda x: f"({x})::DECIMAL(28,6)::VARCHAR"
    kinds = {
        "service": ("true", "service"), "fingerprint": ("true", "fingerprint"),
        "strategy": ("rule <= 3", "signal"), "threshold": ("rule IN (1, 3)", f"CASE rule WHEN 1 THEN {num(spike)} ELSE {num(rate)} END"),
        "current": ("rule <> 3", f"CASE WHEN rule IN (5, 6) THEN {num('svc_errors')} ELSE {num('fp_count')} END"),
        "current_service_errors": ("rule = 3", num("svc_errors")), "zScore": ("rule IN (4, 5)", num("score")),
        "ratio": ("rule = 6", num("score")), "signal": ("rule IN (5, 6)", "signal"),
        "mean": ("rule >= 4", f"CASE WHEN rule IN (5, 6) THEN {num('svc_mean')} ELSE {num('fp_mean')} END"),
        "stdDev": ("rule IN (4, 5)", f"CASE rule WHEN 5 THEN {num('svc_std')} ELSE {num('fp_std')} END"), "n": ("rule >= 4", num(n)),
    }
    parts = " UNION ALL ".join(f"SELECT incident_id, '{k}' AS key, {x} AS value FROM inc WHERE {cond}" for k, (cond, x) in kinds.items())
    return f"SELECT '{rules}' AS rules, * FROM (WITH {chain}, {_INC} {parts})"


SQL["evidence_map"] = " UNION ALL ".join([
    _evidence("hourly", _HOURLY, 168, 50, 40),
    _evidence("cold", f"{_KEYS}, {_detect('ek', 86400, 30, cold_spike=15, cold_err=20)}", 30, 15, 20),
])
SQL["incident_pipeline"] = f"""WITH ctx AS ({SQL['anomaly_context']}), ids AS (SELECT incident_id, string_agg(id::VARCHAR, ',' ORDER BY rnk) AS context_ids FROM ctx GROUP BY incident_id),
  opened AS (WITH {_HOURLY}, {_INC} SELECT incident_id, service, us FROM inc),
  p AS (SELECT *, make_timestamp(us)::TIME AS t FROM opened)
  SELECT incident_id, 'TICKETED' AS status, coalesce(context_ids, '') AS context_ids, 'E' AS agreed_error_type, 'APPLICATION' AS primary_layer, 0.9::DOUBLE AS confidence, 5::BIGINT AS n_findings,
    'B.java,D.java,F.java' AS files, '[{{"role":"System Analyst","minorityView":"r"}}]' AS dissent_json,
    CASE WHEN t > TIME '08:00:00' AND t < TIME '18:00:00' THEN 'P2' ELSE 'P1' END AS calculated_severity, 'found' AS cause
  FROM p LEFT JOIN ids USING (incident_id)"""
