"""The same queries as plain SQL over the given tables, for comparison by a second engine."""

from __future__ import annotations

from secstream.functions.fields import FIELD_COLUMNS
from secstream.functions.scalar import micros
from secstream.operators.alerts import SEQUENCE_TECHNIQUES, VERDICTS
from secstream.operators.cloud import CALL_ACTIONS
from secstream.operators.rules import Rule
from secstream.plans.queries import SQUEEZE, STANDARD, WEEKLY
from secstream.sources.tables import (
    BROWSERS,
    CITIES,
    CLOUD_ACCOUNT,
    CLOUD_CALLS,
    CLOUD_SOURCES,
    SCENARIOS,
    SCRIPT_AGENT,
    TECHNIQUES,
)


# The life cycles that the queries must follow, stated here on their own.
MOVES = {
    "new": ["triaged", "false_positive"],
    "triaged": ["investigating", "contained", "resolved", "false_positive"],
    "investigating": ["contained", "resolved", "false_positive"],
    "contained": ["investigating", "resolved"],
    "resolved": [],
    "false_positive": [],
}
ACTION_MOVES = {
    "proposed": ["approved", "rejected", "executed", "failed"],
    "approved": ["executed", "failed", "rejected"],
    "executed": ["reverted", "rejected"],
    "failed": ["rejected"],
    "rejected": [],
    "reverted": ["rejected"],
}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


# Named building blocks; each lists the blocks it needs.
BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: list[str], sql: str) -> None:
    BLOCKS[name] = (needs, sql)


def using(blocks: list[str], sql: str) -> str:
    """``sql`` with the WITH clause for ``blocks`` and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in BLOCKS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in blocks:
        visit(name)
    heads = []
    for name in order:
        body = BLOCKS[name][1]
        hint = "" if "UNION ALL\n    -- recursive" in body else " MATERIALIZED"
        heads.append(f"{name} AS{hint} ({body})")
    return "WITH RECURSIVE " + ",\n".join(heads) + "\n" + sql


block("act", [], "SELECT event_id AS n, ts, user_id AS u, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
block(
    "ev",
    ["act"],
    f"""
SELECT 'e-' || lpad(CAST(n AS VARCHAR), 8, '0') AS event_id, ts,
  ts + to_microseconds(CAST(round(value * 100000) AS BIGINT)) AS ingested_at,
  CASE WHEN event_type IN ('signup','error','view') THEN 'authentication' WHEN event_type = 'click' THEN 'session'
       WHEN k % 10 < 3 THEN 'iam' ELSE 'api' END AS event_category,
  CASE WHEN event_type IN ('signup','error') THEN 'user-login' WHEN event_type = 'view' THEN 'token-issued'
       WHEN event_type = 'click' THEN 'permission-check' WHEN k % 10 = 0 THEN 'role-change'
       WHEN k % 10 < 3 THEN 'password-change' ELSE 'api-key-used' END AS event_action,
  CASE WHEN event_type = 'error' OR (event_type = 'click' AND k % 3 = 0) THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE WHEN event_type = 'error' AND k % 20 = 7 THEN 'account disabled' WHEN event_type = 'error' THEN 'invalid credentials'
       WHEN event_type = 'click' AND k % 3 = 0 THEN 'forbidden' END AS event_reason,
  'u-' || lpad(CAST(u AS VARCHAR), 5, '0') AS user_id,
  CASE WHEN event_type = 'purchase' AND k % 25 = 0 THEN 'root' ELSE 'user' || u END AS user_name,
  'corp' AS user_domain,
  CASE WHEN k < 80 THEN '10.' || (u % 64) || '.' || (u % 256) || '.' || (k % 3 + 1) ELSE '203.0.113.' || k END AS source_ip,
  CAST(1024 + k * 7 + u % 1000 AS BIGINT) AS source_port,
  CASE WHEN k < 80 THEN ['DE','GR','NL','GB','US'][u % 5 + 1] ELSE ['RU','SG','BR'][k % 3 + 1] END AS source_country,
  {_map(CITIES)}[CASE WHEN k < 80 THEN ['DE','GR','NL','GB','US'][u % 5 + 1] ELSE ['RU','SG','BR'][k % 3 + 1] END] AS source_city,
  CASE WHEN event_type = 'purchase' THEN 'iam' ELSE 'sso' END AS service_name,
  CASE WHEN event_type = 'purchase' THEN 'aws' ELSE 'prod' END AS service_environment,
  CASE WHEN k < 80 THEN {_list(BROWSERS)}[u % 4 + 1] ELSE '{SCRIPT_AGENT}' END AS user_agent,
  CASE WHEN k >= 90 THEN {_list(SCENARIOS)}[k % 4 + 1] END AS scenario,
  CASE WHEN k >= 90 THEN {_list(SCENARIOS)}[k % 4 + 1] || '-' || strftime(ts, '%Y-%m-%d') END AS run_id,
  CASE WHEN k >= 90 THEN {_list(TECHNIQUES)}[k % 4 + 1] END AS technique,
  n, u, k, event_type
FROM act""",
)
block("now", ["ev"], "SELECT max(ts) AS at FROM ev")
block(
    "arrivals",
    ["ev"],
    """
SELECT ev.*, c.copy, n * 2 + c.copy AS "offset", u % 6 AS "partition",
  ingested_at + to_seconds(5 * c.copy) AS arrived_at,
  CASE WHEN k IN (50, 52, 59) THEN 'PARSE_ERROR' WHEN k IN (51, 53, 54) THEN 'VALIDATION_ERROR'
       WHEN k = 55 THEN 'PERSIST_ERROR' END AS failure_type,
  CASE k WHEN 50 THEN 'malformed JSON' WHEN 52 THEN '@timestamp is not an instant' WHEN 59 THEN 'source.port is not a number'
    WHEN 51 THEN 'missing required field @timestamp' WHEN 53 THEN 'missing required field event.id'
    WHEN 54 THEN 'missing required field user.id' WHEN 55 THEN 'source.ip is not an address' END AS reason,
  CASE k WHEN 56 THEN 'unknown' WHEN 57 THEN 'user-login' ELSE event_action END AS stored_action
FROM ev JOIN (VALUES (0), (1)) AS c(copy) ON c.copy = 0 OR k % 10 = 4""",
)
block("flat", ["arrivals"], "SELECT * FROM arrivals WHERE failure_type IS NULL")
block("dead", ["arrivals"], "SELECT * FROM arrivals WHERE failure_type IS NOT NULL")
block(
    "kept", ["flat"],
    "SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY event_id, ts ORDER BY arrived_at, \"partition\", \"offset\") = 1",
)


# --- cloud audit records ---------------------------------------------------------------------

block(
    "rec",
    ["act"],
    f"""
SELECT n, ts, u, k, CASE WHEN k % 11 <> 0 THEN {_list(CLOUD_CALLS)}[k % 10 + 1] END AS call,
  {_list(CLOUD_SOURCES)}[k % 10 + 1] AS origin,
  'c-' || lpad(CAST(n AS VARCHAR), 8, '0') AS event_id,
  CASE WHEN k % 11 <> 0 AND k % 10 = 0 THEN u % 3 = 0 ELSE k % 7 = 0 END AS failed,
  'role' || (u % 7) AS role_name,
  CASE WHEN u % 5 = 3 THEN 'config.amazonaws.com' WHEN k % 13 = 0 THEN 'AWS Internal' END AS host
FROM act""",
)
block(
    "cloud",
    ["rec"],
    f"""
SELECT event_id, ts,
  CASE WHEN origin IN ('signin.amazonaws.com', 'sts.amazonaws.com') THEN 'authentication'
       WHEN origin = 'iam.amazonaws.com' THEN 'iam' ELSE 'api' END AS event_category,
  coalesce({_map(CALL_ACTIONS)}[call], 'unknown') AS event_action,
  CASE WHEN failed THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE WHEN NOT failed THEN NULL WHEN k % 7 <> 0 THEN 'console login failed'
       WHEN k % 14 = 0 THEN 'AccessDenied: ' || substr(repeat('denied ', 40), 1, 200) || '…' ELSE 'AccessDenied' END AS event_reason,
  CASE u % 5 WHEN 0 THEN 'user' || u WHEN 1 THEN 'role:' || role_name WHEN 2 THEN 'root:{CLOUD_ACCOUNT}'
     WHEN 3 THEN 'service:config.amazonaws.com' ELSE 'arn:aws:iam::{CLOUD_ACCOUNT}:partner/user' || u END AS user_id,
  CASE u % 5 WHEN 0 THEN 'user' || u WHEN 1 THEN role_name WHEN 2 THEN 'root' WHEN 3 THEN 'config.amazonaws.com'
     ELSE 'user' || u END AS user_name,
  CASE WHEN u % 5 = 3 THEN 'aws:service' ELSE 'aws:{CLOUD_ACCOUNT}' END AS user_domain,
  CASE WHEN host IS NULL THEN '203.0.113.' || (u % 250) END AS source_ip,
  coalesce(host, origin) AS service_name, 'aws' AS service_environment, 'aws-cli/2.17.0' AS user_agent,
  concat_ws(';', CASE WHEN u % 5 = 1 THEN 'assumed_role=session-' || k END, 'cloud_account_id={CLOUD_ACCOUNT}',
    'cloud_event_name=' || call, 'cloud_event_source=' || origin, 'cloud_provider=aws', 'cloud_region=eu-west-1') AS labels,
  call, k, u
FROM rec WHERE call IS NOT NULL""",
)


# --- baselines -------------------------------------------------------------------------------


def _baseline(rows: str, now: str, days: int) -> str:
    return f"""
SELECT user_id, max({now}) AS computed_at, CAST({days} AS BIGINT) AS window_days, count(*) AS total_events,
  count(*) FILTER (event_action = 'user-login') AS logins,
  count(*) FILTER (event_action = 'user-login' AND event_outcome = 'failure') AS login_failures,
  round(count(*) FILTER (event_action = 'user-login' AND event_outcome = 'failure') / nullif(CAST(count(*) FILTER (event_action = 'user-login') AS DOUBLE), 0), 4) AS failure_rate,
  round(count(*) / {days}.0::DOUBLE, 2) AS events_per_day,
  list_sort(list(DISTINCT source_country)) AS countries, count(DISTINCT source_country) AS distinct_countries,
  count(DISTINCT source_ip) AS distinct_source_ips, list_sort(list(DISTINCT user_agent)) AS user_agents,
  count(DISTINCT user_agent) AS distinct_user_agents, list_sort(list(DISTINCT hour(ts))) AS active_hours,
  min(ts) AS first_seen, max(ts) AS last_seen,
  round((epoch_us(max({now})) - epoch_us(max(ts))) / 86400000000.0::DOUBLE, 2) AS dormant_days
FROM {rows} GROUP BY user_id"""


def _mode(rows: str, value: str, name: str) -> str:
    return f"""SELECT user_id, v AS {name} FROM (SELECT user_id, {value} AS v, count(*) AS c FROM {rows} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, v) = 1"""


block("month", ["ev", "now"], "SELECT ev.*, now.at FROM ev, now WHERE ts > now.at - INTERVAL 31 DAY")
block("base0", ["month"], _baseline("month", '"at"', 31))
block("base", ["base0", "month"], f"""SELECT b.*, c.primary_country, h.peak_hour FROM base0 b
  LEFT JOIN ({_mode('month', 'source_country', 'primary_country')}) c USING (user_id)
  LEFT JOIN ({_mode('month', 'hour(ts)', 'peak_hour')}) h USING (user_id)""")
block("early", ["ev", "now"], "SELECT ev.*, now.at - INTERVAL 15 DAY AS at FROM ev, now WHERE ts <= now.at - INTERVAL 15 DAY AND ts > now.at - INTERVAL 30 DAY")
block("hist", ["early"], _baseline("early", '"at"', 15))

# --- detections ------------------------------------------------------------------------------


def _condition(rule: Rule) -> str:
    tests = [f"{FIELD_COLUMNS[p]} = '{v}'" for p, v in rule.match.items()]
    tests += [f"{FIELD_COLUMNS[p]} IN {_in(v)}" for p, v in rule.match_any.items()]
    return " AND ".join([*tests, f"{FIELD_COLUMNS[rule.group_by]} IS NOT NULL"])


def _hits(rule: Rule) -> str:
    counted = FIELD_COLUMNS[rule.distinct] if rule.distinct else "NULL::VARCHAR"
    size = micros(rule.window)
    return f"""SELECT '{rule.id}' AS rule_id, {FIELD_COLUMNS[rule.group_by]} AS entity_id,
  epoch_us(ts) - epoch_us(ts) % {size} AS w, {size} AS size, {rule.threshold} AS threshold, {counted} AS counted,
  '{rule.severity}' AS severity, '{rule.technique}' AS technique, '{rule.entity_type}' AS entity_type,
  ts, event_id, source_ip FROM ev WHERE {_condition(rule)}"""


block("hits", ["ev"], "\nUNION ALL\n".join(_hits(r) for r in WEEKLY))
block(
    "crossings",
    ["hits"],
    """
SELECT * EXCLUDE (p, firsts) FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, entity_id, w ORDER BY ts, event_id) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id, entity_id, w, coalesce(counted, event_id) ORDER BY ts, event_id) AS firsts FROM hits)
  WHERE firsts = 1)
WHERE p = threshold""",
)
block(
    "threshold_alerts",
    ["crossings"],
    """
SELECT sha256(concat_ws('|', rule_id, entity_id, CAST(w AS VARCHAR), event_id)) AS alert_id, ts AS detected_at,
  make_timestamp(w) AS window_start, make_timestamp(w + size) AS window_end, rule_id, severity, technique,
  entity_type, entity_id, CAST(threshold AS BIGINT) AS observed, CAST(threshold AS BIGINT) AS threshold FROM crossings""",
)
PREVIOUS = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
block(
    "logins",
    ["ev"],
    f"""
SELECT *, last_value(CASE WHEN mover THEN {{'country': source_country, 'at': ts}} END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id {PREVIOUS}) AS prev FROM (
  SELECT user_id, ts, event_id, source_country, source_ip,
    row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1 AS mover
  FROM ev WHERE event_action = 'user-login' AND event_outcome = 'success' AND source_country IS NOT NULL)""",
)


def _travel(hours: int) -> str:
    return f"""
SELECT sha256(concat_ws('|', 'impossible-travel', user_id, CAST(epoch_us(prev.at) AS VARCHAR), event_id)) AS alert_id,
  ts AS detected_at, prev.at AS window_start, ts AS window_end, 'impossible-travel' AS rule_id, 'medium' AS severity,
  'T1078' AS technique, 'user' AS entity_type, user_id AS entity_id,
  (epoch_us(ts) - epoch_us(prev.at)) // 1000000 AS observed, CAST({hours * 3600} AS BIGINT) AS threshold
FROM logins WHERE prev.country <> source_country AND epoch_us(ts) - epoch_us(prev.at) <= {hours * 3600 * 1000000}"""


block("travel", ["logins"], _travel(1))
block(
    "hijack0",
    ["ev"],
    f"""
SELECT *, epoch_us(ts) - epoch_us(s.at) AS age FROM (
  SELECT *, event_action IN ('user-login', 'token-issued') AS auth,
    last_value(CASE WHEN event_action IN ('user-login', 'token-issued') AND event_outcome = 'success'
      THEN {{'ip': source_ip, 'agent': user_agent, 'at': ts, 'id': event_id}} END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY ts, event_id {PREVIOUS}) AS s FROM ev)""",
)
block(
    "hijack",
    ["hijack0"],
    """
SELECT sha256(concat_ws('|', 'session-hijack', user_id, CAST(epoch_us(s.at) AS VARCHAR), event_id)) AS alert_id,
  ts AS detected_at, s.at AS window_start, ts AS window_end, 'session-hijack' AS rule_id,
  CASE WHEN s.agent <> user_agent OR (s.ip LIKE '10.%') <> (source_ip LIKE '10.%') THEN 'high' ELSE 'medium' END AS severity,
  'T1539' AS technique, 'user' AS entity_type, user_id AS entity_id, age // 1000000 AS observed, CAST(20 AS BIGINT) AS threshold,
  CASE WHEN s.agent <> user_agent THEN 'Open session moved: other network, other client' ELSE 'Open session moved: other network' END AS rule_name,
  CASE WHEN s.ip LIKE '10.%' AND source_ip NOT LIKE '10.%' THEN 'internal_to_external'
       WHEN s.ip NOT LIKE '10.%' AND source_ip LIKE '10.%' THEN 'external_to_internal' END AS network_class_change,
  CASE WHEN s.agent <> user_agent THEN user_agent END AS observed_user_agent
FROM hijack0 WHERE NOT auth AND age BETWEEN 20000000 AND 28800000000
  AND regexp_replace(s.ip, '[.][^.]*$', '') <> regexp_replace(source_ip, '[.][^.]*$', '')""",
)
block(
    "deviation",
    ["ev", "hist"],
    """
SELECT sha256(concat_ws('|', 'baseline-deviation', user_id, CAST(epoch_us(ts) AS VARCHAR), event_id)) AS alert_id,
  ts AS detected_at, ts AS window_start, ts AS window_end, 'baseline-deviation' AS rule_id,
  ['low', 'medium', 'high'][least(len(d), 3)] AS severity, 'T1078' AS technique, 'user' AS entity_type, user_id AS entity_id,
  CAST(len(d) AS BIGINT) AS observed, CAST(1 AS BIGINT) AS threshold, array_to_string(d, ',') AS deviations FROM (
  SELECT e.user_id, e.ts, e.event_id, list_filter([
    CASE WHEN len(h.countries) > 0 AND NOT list_contains(h.countries, e.source_country) THEN 'new_country' END,
    CASE WHEN len(h.user_agents) > 0 AND NOT list_contains(h.user_agents, e.user_agent) THEN 'new_user_agent' END,
    CASE WHEN len(h.active_hours) >= 12 AND NOT list_contains(h.active_hours, hour(e.ts)) THEN 'unusual_hour' END,
    CASE WHEN h.dormant_days >= 30 THEN 'dormant_reactivation' END], lambda v: v IS NOT NULL) AS d
  FROM ev e JOIN hist h USING (user_id)
  WHERE h.total_events >= 20 AND e.event_outcome = 'success' AND e.event_action IN ('user-login', 'token-issued'))
WHERE len(d) > 0""",
)
ALERT = "alert_id, detected_at, window_start, window_end, rule_id, severity, technique, entity_type, entity_id, observed, threshold"
block(
    "alerts",
    ["threshold_alerts", "travel", "hijack", "deviation"],
    f"""
SELECT *, concat_ws('|', rule_id, entity_type, entity_id) AS dedupe_key,
  list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1 AS rank FROM (
  SELECT {ALERT} FROM threshold_alerts UNION ALL SELECT {ALERT} FROM travel
  UNION ALL SELECT {ALERT} FROM hijack UNION ALL SELECT {ALERT} FROM deviation)""",
)

block("job_day", ["ev"], "SELECT CAST(max(ts) AS DATE) - 1 AS d FROM ev")

# --- folding, risk, incidents, response ------------------------------------------------------

block(
    "positions",
    ["alerts"],
    """
SELECT *, first_value(alert_id) OVER island AS stored_id, row_number() OVER island AS occurrence FROM (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY dedupe_key ORDER BY detected_at, alert_id) AS no FROM (
    SELECT *, coalesce(detected_at - lag(detected_at) OVER (PARTITION BY dedupe_key ORDER BY detected_at, alert_id) > INTERVAL 30 MINUTE, true) AS opens FROM alerts))
WINDOW island AS (PARTITION BY dedupe_key, no ORDER BY detected_at, alert_id)""",
)
block(
    "stored",
    ["positions", "now"],
    """
SELECT p.stored_id AS id, any_value(p.dedupe_key) AS dedupe_key, min(p.detected_at) AS first_detected_at, max(p.detected_at) AS last_detected_at,
  count(*) AS occurrences, any_value(p.rule_id) AS rule_id, ['info', 'low', 'medium', 'high', 'critical'][max(p.rank) + 1] AS severity,
  any_value(p.technique) AS technique, any_value(p.entity_type) AS entity_type, any_value(p.entity_id) AS entity_id,
  max(p.observed) AS observed, any_value(p.threshold) AS threshold, arg_min(p.window_start, p.occurrence) AS window_start,
  max(p.window_end) AS window_end, max(now.at) - max(p.detected_at) <= INTERVAL 30 MINUTE AS active, 'untriaged' AS triage
FROM positions p, now GROUP BY p.stored_id""",
)
block(
    "ordered",
    ["positions"],
    """
SELECT *, [1.0, 5.0, 15.0, 40.0, 100.0][rank + 1] / sqrt(occurrence) AS weight,
  row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY detected_at, alert_id) AS rn,
  epoch_us(detected_at) - epoch_us(lag(detected_at) OVER (PARTITION BY entity_type, entity_id ORDER BY detected_at, alert_id)) AS waited
FROM positions""",
)
block(
    "walk",
    ["ordered"],
    """
SELECT entity_type, entity_id, rn, alert_id, least(300.0::DOUBLE, weight) AS score FROM ordered WHERE rn = 1
    UNION ALL
    -- recursive
SELECT o.entity_type, o.entity_id, o.rn, o.alert_id, least(300.0::DOUBLE, o.weight + CASE
    WHEN o.waited <= 0 THEN w.score
    WHEN w.score * pow(0.5, (o.waited // 1000000) / 21600.0::DOUBLE) < 0.5 THEN 0
    ELSE w.score * pow(0.5, (o.waited // 1000000) / 21600.0::DOUBLE) END)
  FROM walk w JOIN ordered o ON o.entity_type = w.entity_type AND o.entity_id = w.entity_id AND o.rn = w.rn + 1""",
)
block("scored", ["walk", "positions"], "SELECT p.*, w.score FROM positions p JOIN walk w USING (alert_id)")
block(
    "risk",
    ["scored"],
    """
SELECT entity_type, entity_id, arg_max(score, (detected_at, alert_id)) AS score, max(score) AS peak_score, max(detected_at) AS updated_at,
  arg_max(detected_at, (score, -epoch_us(detected_at))) AS peaked_at FROM scored GROUP BY ALL""",
)
block(
    "attached",
    ["scored"],
    """
SELECT s.* FROM scored s JOIN (
  SELECT stored_id, min((detected_at, alert_id)) AS since FROM scored WHERE score >= 50 OR rank >= 3 GROUP BY 1) f USING (stored_id)
WHERE (s.detected_at, s.alert_id) >= f.since""",
)
block(
    "incidents",
    ["attached"],
    """
SELECT sha256(concat_ws('|', 'incident', entity_type, entity_id, first_id)) AS incident_id, 'new' AS status,
  ['info', 'low', 'medium', 'high', 'critical'][greatest(first_rank, coalesce(grown, 0)) + 1] AS severity,
  CASE WHEN first_rank >= 3 THEN 'Likely takeover' ELSE 'Unusual behaviour' END || ': ' || entity_type || ' ' || entity_id AS title,
  entity_type, entity_id, risk_score, opened_at, updated_at, opening_rule, opening_risk, alert_count FROM (
  SELECT entity_type, entity_id, arg_min(alert_id, (detected_at, alert_id)) AS first_id, arg_min(rank, (detected_at, alert_id)) AS first_rank,
    max(rank) FILTER (rank >= 2) AS grown, arg_max(score, (detected_at, alert_id)) AS risk_score, min(detected_at) AS opened_at,
    max(detected_at) AS updated_at, arg_min(rule_id, (detected_at, alert_id)) AS opening_rule,
    arg_min(score, (detected_at, alert_id)) AS opening_risk, count(DISTINCT stored_id) AS alert_count
  FROM attached GROUP BY ALL)""",
)
RULE_NAMES = {r.id: r.name for r in WEEKLY} | {
    "impossible-travel": "Two logins too far apart for the time between them",
    "baseline-deviation": "Login unlike the account''s usual ones",
}


def _actions(existing: str = "") -> str:
    return f"""
SELECT c.action, c.entity_type AS target_type, c.entity_id AS target_id, c.stored_id AS alert_id, c.reason, 'proposed' AS status,
  c.action <> 'revoke_sessions' AS requires_approval, true AS reversible, false AS auto_execute, c.detected_at AS proposed_at, i.incident_id,
  sha256(concat_ws('|', c.action, c.entity_type, c.entity_id, c.stored_id)) AS action_id
FROM (
  SELECT 'revoke_sessions' AS action, *, coalesce({_map(RULE_NAMES)}[rule_id], hijack_name) || ' [' || rule_id || ']: the session or its credentials may be stolen' AS reason
    FROM named WHERE entity_type = 'user' AND technique IN ('T1078', 'T1539', 'T1098') AND rank >= 2
  UNION ALL SELECT 'disable_account', *, 'containment starts at a risk of 90, now ' || CAST(round(score) AS BIGINT)
    FROM named WHERE entity_type = 'user' AND (score >= 90 OR severity = 'critical')
  UNION ALL SELECT 'block_source_ip', *, {_map(RULE_NAMES)}[rule_id] || ': traffic from an attacking address'
    FROM named WHERE entity_type = 'source_ip' AND rank >= 3) c
LEFT JOIN incidents i ON i.entity_type = c.entity_type AND i.entity_id = c.entity_id {existing}
QUALIFY row_number() OVER (PARTITION BY c.action, c.entity_type, c.entity_id ORDER BY c.detected_at, c.alert_id) = 1"""


block("named", ["attached", "hijack"], "SELECT a.*, h.rule_name AS hijack_name FROM attached a LEFT JOIN hijack h USING (alert_id)")
block("actions", ["named", "incidents"], _actions())
block(
    "verdicts",
    ["stored"],
    f"""
SELECT id, {_list(VERDICTS)}[(epoch_us(first_detected_at) // 1000000 + r) % 4 + 1] AS verdict,
  'analyst-' || (epoch_us(first_detected_at) // 1000000) % 3 AS analyst, first_detected_at + to_hours(r) AS at
FROM stored, (VALUES (0), (1)) AS t(r)""",
)
block(
    "triaged",
    ["stored", "verdicts"],
    """SELECT s.* REPLACE (v.verdict AS triage), v.at AS triaged_at, v.analyst AS triaged_by
FROM stored s JOIN verdicts v USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY v.at DESC, v.verdict) = 1""",
)


def _walk(name: str, key: str, subjects: str, since: str, user: str, words: list[str], moves: dict[str, list[str]], start: str, needs: list[str], extra: str = "", carry: str = "", gate: str = "true") -> None:
    """Requests of each subject, numbered, and a recursive walk through the legal moves that pass the gate."""
    legal = " OR ".join(f"(w.\"left\" = '{s}' AND r.\"to\" IN {_in(to)})" for s, to in moves.items() if to)
    legal = f"({legal}) AND ({gate.format(state='w.\"left\"')})"
    first = " OR ".join(f"'{start}' = '{s}' AND r.\"to\" IN {_in(to)}" for s, to in moves.items() if to)
    first = f"({first}) AND ({gate.format(state=f"'{start}'")})"
    block(
        f"{name}_requests",
        ["ev", *needs],
        f"""SELECT s.{key}, {carry} e.ts AS at, e.event_id AS seq, {_list(words)}[e.source_port % {len(words)} + 1] AS "to",
  'analyst-' || e.source_port % 3 AS actor, 'note ' || e.event_id AS note,
  row_number() OVER (PARTITION BY s.{key} ORDER BY e.ts, e.event_id) AS rn
FROM {subjects} s JOIN ev e ON e.user_id = s.{user} AND e.ts > s.{since} {extra}""",
    )
    block(
        f"{name}_log",
        [f"{name}_requests"],
        f"""
SELECT r.*, '{start}' AS found, CASE WHEN {first} THEN r."to" ELSE '{start}' END AS "left", ({first}) AS accepted FROM {name}_requests r WHERE rn = 1
    UNION ALL
    -- recursive
SELECT r.*, w."left" AS found, CASE WHEN {legal} THEN r."to" ELSE w."left" END AS "left", ({legal}) AS accepted
  FROM {name}_log w JOIN {name}_requests r ON r.{key} = w.{key} AND r.rn = w.rn + 1""",
    )


_walk("move", "incident_id", "incidents", "opened_at", "entity_id", list(MOVES), MOVES, "new", ["incidents"], "AND s.entity_type = 'user'")
_walk(
    "action", "action_id", "actions", "proposed_at", "target_id", ["approved", "executed", "failed", "rejected", "reverted"],
    ACTION_MOVES, "proposed", ["actions"], "AND s.target_type = 'user'",
    "s.requires_approval,", """r."to" <> 'executed' OR NOT r.requires_approval OR {state} = 'approved'""",
)
block(
    "states",
    ["incidents", "move_log"],
    """
SELECT i.incident_id, coalesce(l.status, i.status) AS status, greatest(i.updated_at, l.moved_at) AS updated_at, l.closed_at, l.resolution
FROM incidents i LEFT JOIN (
  SELECT incident_id, arg_max("left", rn) AS status, max("at") AS moved_at, max("at") FILTER ("left" IN ('resolved', 'false_positive')) AS closed_at,
    arg_max(note, rn) FILTER ("left" IN ('resolved', 'false_positive')) AS resolution
  FROM move_log WHERE accepted GROUP BY 1) l USING (incident_id)""",
)
block(
    "acted",
    ["actions", "action_log"],
    """
SELECT a.*, l.* EXCLUDE (action_id) FROM (SELECT * EXCLUDE (status) FROM actions) a JOIN (
  SELECT a.action_id, coalesce(arg_max("left", rn) FILTER (accepted), 'proposed') AS status,
    arg_max(actor, rn) FILTER (accepted AND "left" = 'approved') AS approved_by, arg_max(actor, rn) FILTER (accepted AND "left" = 'reverted') AS reverted_by,
    arg_max(note, rn) FILTER (accepted AND "left" = 'failed') AS error, arg_max(note, rn) FILTER (accepted AND "left" <> 'failed') AS result
  FROM actions a LEFT JOIN action_log g USING (action_id) GROUP BY 1) l USING (action_id)""",
)
block(
    "trail",
    ["incidents", "actions", "move_log", "triaged", "action_log"],
    """
SELECT opened_at AS at, 'system' AS actor, 'incident_opened' AS action, 'incident' AS subject_type, incident_id AS subject_id,
  concat_ws('|', entity_type || ':' || entity_id, opening_rule) AS detail FROM incidents
UNION ALL SELECT proposed_at, 'system', 'action_proposed', target_type, target_id, concat_ws('|', action, reason) FROM actions
UNION ALL SELECT "at", actor, 'incident_' || "left", 'incident', incident_id, concat_ws('|', found, "left") FROM move_log WHERE accepted
UNION ALL SELECT triaged_at, triaged_by, 'alert_triaged', 'alert', id, triage FROM triaged WHERE triage <> 'untriaged'
UNION ALL SELECT g."at", g.actor, 'action_' || g."left", a.target_type, a.target_id, concat_ws('|', a.action, g.note)
  FROM action_log g JOIN actions a USING (action_id) WHERE g.accepted""",
)
# The incidents of an entity one after the other: a firing opens one if none is open, a request moves the open one.
_LEGAL = " OR ".join(f"(w.\"left\" = '{s}' AND r.\"to\" IN {_in(to or ['new'])})" for s, to in MOVES.items()) + """ OR (w."left" = 'none' AND r."to" = 'new')"""
block(
    "life",
    ["attached", "move_requests", "incidents"],
    """
SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY "at", seq) AS rn FROM (
  SELECT entity_type, entity_id, detected_at AS "at", alert_id AS seq, 'new' AS "to", true AS firing, rule_id, rank, score, NULL::VARCHAR AS note FROM attached
  UNION ALL SELECT i.entity_type, i.entity_id, r."at", r.seq, CASE WHEN r."to" = 'new' THEN 'refused' ELSE r."to" END, false, NULL, NULL, NULL, r.note
    FROM move_requests r JOIN incidents i USING (incident_id))""",
)
block(
    "life_log",
    ["life"],
    f"""
SELECT r.*, 'none' AS found, CASE WHEN firing THEN 'new' ELSE 'none' END AS "left", firing AS accepted, firing::INTEGER AS no FROM life r WHERE rn = 1
    UNION ALL
    -- recursive
SELECT r.*, w."left", CASE WHEN {_LEGAL} THEN r."to" ELSE w."left" END, ({_LEGAL}), w.no + (({_LEGAL}) AND r."to" = 'new')::INTEGER
  FROM life_log w JOIN life r ON r.entity_type = w.entity_type AND r.entity_id = w.entity_id AND r.rn = w.rn + 1""",
)
block(
    "life_ids",
    ["life_log"],
    """SELECT *, sha256(concat_ws('|', 'incident', entity_type, entity_id, first_value(seq) OVER (PARTITION BY entity_type, entity_id, no ORDER BY rn))) AS incident_id FROM life_log WHERE no > 0""",
)
block(
    "history",
    ["life_ids"],
    """
SELECT incident_id, status, ['info', 'low', 'medium', 'high', 'critical'][greatest(first_rank, coalesce(grown, 0)) + 1] AS severity,
  CASE WHEN first_rank >= 3 THEN 'Likely takeover' ELSE 'Unusual behaviour' END || ': ' || entity_type || ' ' || entity_id AS title,
  entity_type, entity_id, round(risk_score, 6) AS risk_score, opened_at, updated_at, closed_at, resolution, opening_rule, round(opening_risk, 6) AS opening_risk FROM (
  SELECT incident_id, entity_type, entity_id, arg_max("left", rn) AS status, arg_min(rank, rn) FILTER (firing) AS first_rank, max(rank) FILTER (firing AND rank >= 2) AS grown,
    arg_max(score, rn) FILTER (firing) AS risk_score, min("at") FILTER (firing) AS opened_at, max("at") FILTER (firing OR accepted) AS updated_at,
    max("at") FILTER (accepted AND "left" IN ('resolved', 'false_positive')) AS closed_at, arg_max(note, rn) FILTER (accepted AND "left" IN ('resolved', 'false_positive')) AS resolution,
    arg_min(rule_id, rn) FILTER (firing) AS opening_rule, arg_min(score, rn) FILTER (firing) AS opening_risk
  FROM life_ids GROUP BY ALL)""",
)
block("labelled", ["ev", "now"], "SELECT ev.*, now.at FROM ev, now WHERE scenario IS NOT NULL AND ts > now.at - INTERVAL 43240 MINUTE")
block(
    "attacks",
    ["labelled"],
    """
SELECT scenario, run_id, technique, list_sort(list(DISTINCT user_id)) AS users, list_sort(list(DISTINCT source_ip)) AS source_ips,
  min(ts) AS started, max(ts) AS ended, count(*) AS events, max("at") AS at FROM labelled GROUP BY 1, 2, 3""",
)
block("recent_alerts", ["stored", "now"], "SELECT s.* FROM stored s, now WHERE s.last_detected_at > now.at - INTERVAL 10 DAY")
block(
    "pairs",
    ["recent_alerts", "attacks"],
    """
SELECT a.id, k.scenario, k.run_id FROM recent_alerts a JOIN attacks k
  ON list_contains(CASE WHEN a.entity_type = 'user' THEN k.users ELSE k.source_ips END, a.entity_id)
  AND a.first_detected_at - k.ended <= INTERVAL 20 MINUTE AND k.started - a.last_detected_at <= INTERVAL 20 MINUTE""",
)
block("matched", ["recent_alerts", "pairs"], "SELECT a.id, a.rule_id, a.id IN (SELECT id FROM pairs) AS matched FROM recent_alerts a")
block(
    "runs",
    ["attacks", "pairs"],
    """
SELECT scenario, run_id, (scenario, run_id) IN (SELECT (scenario, run_id) FROM pairs) AS detected
FROM attacks WHERE started >= "at" - INTERVAL 10 DAY GROUP BY ALL""",
)
block(
    "rule_scores", ["matched"],
    "SELECT rule_id, count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fp, round(count(*) FILTER (matched) / CAST(count(*) AS DOUBLE), 6) AS precision FROM matched GROUP BY 1",
)
block(
    "scenario_scores", ["runs"],
    """SELECT scenario, count(*) AS runs, count(*) FILTER (detected) AS detected, count(*) FILTER (NOT detected) AS missed,
  round(count(*) FILTER (detected) / CAST(count(*) AS DOUBLE), 6) AS recall FROM runs GROUP BY 1""",
)
block("days", ["ev"], "SELECT *, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day FROM ev")
block("loads", ["ev"], "SELECT *, CAST(least(ceil(day(ts) / 10.0), 3) AS BIGINT) AS load_id FROM ev")
LAG = "(epoch_us(ingested_at) - epoch_us(ts)) / 1000000.0::DOUBLE"

ORACLES: dict[str, str] = {}


def oracle(name: str, needs: list[str], sql: str) -> None:
    ORACLES[name] = using(needs, sql)


# --- sources and ingest ----------------------------------------------------------------------

oracle(
    "parse_events", ["arrivals"],
    """SELECT CASE WHEN failure_type = 'PARSE_ERROR' THEN reason END AS problem, k NOT IN (50, 51, 52) AS has_time, count(*) AS messages
FROM arrivals GROUP BY ALL""",
)
oracle(
    "normalise_enums", ["act"],
    """SELECT CASE WHEN event_type = 'view' THEN 'token-issued' ELSE 'unknown' END AS action, CASE WHEN k < 50 THEN 'iam' ELSE 'unknown' END AS category,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'success' END AS outcome, count(*) AS events FROM act GROUP BY ALL""",
)
oracle("validate_events", ["arrivals"], "SELECT failure_type, reason, count(*) AS messages FROM arrivals GROUP BY ALL")
oracle(
    "route_dead_letters", ["dead"],
    """SELECT arrived_at AS failed_at, 'events.raw' AS source_topic, "partition" AS source_partition, "offset" AS source_offset,
  user_id AS source_key, failure_type, CAST(0 AS BIGINT) AS replay_count FROM dead""",
)
oracle(
    "dlq_archive", ["dead"],
    """SELECT arrived_at AS failed_at, 'events.raw' AS source_topic, "partition" AS source_partition, "offset" AS source_offset, failure_type FROM dead""",
)
oracle(
    "dlq_replay", ["dead"],
    """SELECT failure_type, CAST(1 AS BIGINT) AS replay_count, count(*) AS letters FROM dead GROUP BY ALL""",
)
_TIMES = """SELECT "partition", "offset", coalesce(own, stream, arrived_at) AS time, CASE WHEN own IS NOT NULL THEN 'event' WHEN stream IS NOT NULL THEN 'stream' ELSE 'broker' END AS time_from
FROM (SELECT *, max(own) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stream
  FROM (SELECT "partition", "offset", arrived_at, CASE WHEN k NOT IN (50, 51, 52) THEN ts END AS own FROM arrivals))"""
oracle("event_times", ["arrivals"], _TIMES)
oracle("stream_event_times", ["arrivals"], _TIMES)
oracle(
    "dlq_list", ["dead"],
    """SELECT arrived_at AS failed_at, "partition" AS source_partition, "offset" AS source_offset, reason AS failure_reason,
  CAST(300 AS BIGINT) AS preview_chars FROM dead WHERE failure_type = 'VALIDATION_ERROR' ORDER BY arrived_at DESC, 2, 3 LIMIT 50""",
)
oracle(
    "dlq_summary", ["dead"],
    """SELECT failure_type, count(*) AS failures, min(arrived_at) AS first_failed, max(arrived_at) AS last_failed, CAST(0 AS BIGINT) AS replayed FROM dead GROUP BY 1""",
)
oracle("dedupe_events", ["kept"], 'SELECT event_id, ts, arrived_at AS ingested_at, "offset" FROM kept')
oracle("dedupe_against_stored", ["kept"], "SELECT event_id, ts FROM kept WHERE day(ts) > 15")
oracle(
    "ingest_batch", ["arrivals", "kept"],
    """SELECT count(*) AS received, count(failure_type) AS rejected, (SELECT count(*) FROM kept) AS ingested,
  count(*) - count(failure_type) - (SELECT count(*) FROM kept) AS duplicates FROM arrivals""",
)
oracle(
    "flatten_events", ["flat"],
    """SELECT event_id, ts, arrived_at AS ingested_at, event_category, stored_action AS event_action, event_outcome, event_reason, user_id, user_name,
  user_domain, source_ip, source_port, source_country, source_city, service_name, service_environment, user_agent,
  CASE WHEN scenario IS NOT NULL THEN 'attack_technique=' || technique || ';run_id=' || run_id || ';scenario=' || scenario END AS labels, "offset" FROM flat""",
)
oracle(
    "quarantine_bad_values", ["dead"],
    """SELECT user_id AS key, "offset", 'source.ip is not an address: not-an-address' AS failure_reason FROM dead WHERE failure_type = 'PERSIST_ERROR'""",
)
oracle(
    "schema_conformance", ["arrivals"],
    """SELECT path, problem, count(*) AS occurrences FROM (
  SELECT CASE k WHEN 50 THEN '$' WHEN 51 THEN '@timestamp' WHEN 53 THEN 'event.id' WHEN 54 THEN 'user.id' WHEN 58 THEN 'trace' WHEN 59 THEN 'source.port' END AS path,
    CASE k WHEN 50 THEN 'not_an_object' WHEN 58 THEN 'unknown' WHEN 59 THEN 'wrong_type' ELSE 'missing' END AS problem FROM arrivals)
WHERE path IS NOT NULL GROUP BY ALL""",
)
oracle(
    "partition_by_day", ["ev", "job_day"],
    """SELECT CASE WHEN CAST(ts AS DATE) BETWEEN d - 26 AND d - 2 THEN strftime(ts, '%Y-%m-%d') ELSE '_default' END AS "partition",
  count(*) AS events FROM ev, job_day GROUP BY 1""",
)
oracle(
    "cloud_audit_ingest", ["rec"],
    f"""SELECT CASE WHEN call IS NULL THEN 'skipped' ELSE 'published' END AS result, CASE WHEN call IS NOT NULL THEN coalesce({_map(CALL_ACTIONS)}[call], 'unknown') END AS event_action,
  CASE WHEN {_map(CALL_ACTIONS)}[call] IS NULL THEN call END AS unmapped_call, count(*) AS records FROM rec GROUP BY ALL""",
)
oracle(
    "cloud_ingest", ["cloud"],
    """SELECT event_action, count(*) AS events, count(DISTINCT event_id) AS ids FROM cloud GROUP BY 1
UNION ALL SELECT '(duplicates)', count(*), CAST(0 AS BIGINT) FROM cloud""",
)
oracle("cloud_audit_events", ["cloud"], "SELECT * EXCLUDE (call, k, u) FROM cloud")
oracle("archive_write", ["days"], "SELECT year, month, day, event_action, count(*) AS events, count(scenario) AS labelled FROM days GROUP BY ALL")
oracle("archive_scan", ["days", "job_day"], "SELECT event_id, ts, event_action, user_id, source_ip, day FROM days, job_day WHERE CAST(ts AS DATE) = d")
oracle("archive_verify", ["days"], "SELECT year, month, day, count(*) AS source_rows, count(*) AS archive_rows, true AS ok FROM days GROUP BY ALL")
oracle(
    "publish_baselines", ["base"],
    "SELECT user_id AS key, total_events, array_to_string(countries, ',') AS countries, array_to_string(active_hours, ',') AS active_hours, primary_country FROM base",
)
oracle(
    "ingest_counters", ["kept", "dead", "flat"],
    """SELECT minute, CAST(sum(i) AS BIGINT) AS ingested, CAST(sum(r) AS BIGINT) AS rejected, CAST(sum(d) AS BIGINT) AS duplicates FROM (
  SELECT date_trunc('minute', arrived_at) AS minute, 1 AS i, 0 AS r, 0 AS d FROM kept
  UNION ALL SELECT date_trunc('minute', arrived_at), 0, 1, 0 FROM dead
  UNION ALL SELECT date_trunc('minute', arrived_at), 0, 0, 1 FROM flat WHERE "offset" NOT IN (SELECT "offset" FROM kept)) GROUP BY 1""",
)

# --- predicates and listings -----------------------------------------------------------------

oracle("rule_match", ["hits"], "SELECT rule_id, count(*) AS events, count(DISTINCT entity_id) AS entities FROM hits GROUP BY 1")
oracle("rule_match_any", ["ev"], f"SELECT event_id, user_id, user_agent FROM ev WHERE event_action = 'password-change' AND user_agent = '{SCRIPT_AGENT}'")
oracle(
    "field_resolver", ["ev"],
    " UNION ALL ".join(f"SELECT '{p}' AS path, count({c}) AS present FROM ev" for p, c in FIELD_COLUMNS.items()),
)
oracle("lookback_filter", ["ev", "now"], "SELECT event_action, count(*) AS events FROM ev, now WHERE ts > now.at - INTERVAL 7 DAY GROUP BY 1")
oracle(
    "recent_events", ["ev", "now"],
    "SELECT event_id, ts, user_id, event_action, event_outcome, source_ip FROM ev, now WHERE ts > now.at - INTERVAL 1 DAY ORDER BY ts DESC, event_id LIMIT 50",
)
oracle("entity_pivot", ["ev"], "SELECT event_id, ts, user_id, source_ip FROM ev WHERE source_ip = '203.0.113.85'")
oracle(
    "entity_pivot_cidr", ["ev"],
    "SELECT event_id, ts, user_id, source_ip FROM ev WHERE source_ip LIKE '10.%' AND CAST(split_part(source_ip, '.', 2) AS INT) BETWEEN 16 AND 23",
)
oracle(
    "trail_tampering", ["cloud"],
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS period_start, count(*) AS calls FROM cloud
WHERE call IN ('StopLogging', 'DeleteTrail', 'UpdateTrail') GROUP BY 1""",
)
oracle(
    "root_usage", ["rec"],
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS period_start, count(*) AS calls FROM rec WHERE u % 5 = 2 AND k % 5 <> 0 GROUP BY 1""",
)
oracle("cloud_events", ["cloud"], "SELECT event_id, ts, event_action, user_id FROM cloud ORDER BY ts, event_id LIMIT 20")
oracle(
    "labelled_events", ["ev"],
    "SELECT event_outcome, count(*) AS events, (SELECT count(*) FROM ev WHERE scenario IS NOT NULL) AS with_scenario FROM ev WHERE scenario IS NOT NULL GROUP BY 1",
)

# --- scalar functions ------------------------------------------------------------------------

oracle(
    "date_time_functions", ["ev"],
    """SELECT date_trunc('hour', ts) AS hour_start, hour(ts) AS hour, time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
  count(*) AS events, CAST(sum(epoch_us(ingested_at) - epoch_us(ts)) AS BIGINT) AS lag_us FROM ev GROUP BY ALL""",
)
ORACLES["string_functions"] = """SELECT doc_id, length(CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || '…' END) AS shown,
  concat_ws('|', lang, source) AS joined FROM documents"""
oracle(
    "json_functions", ["ev"],
    "SELECT event_action AS action, source_country AS country, event_reason IS NOT NULL AS has_reason, count(*) AS events FROM ev GROUP BY ALL",
)
oracle(
    "array_functions", ["hist"],
    """SELECT user_id, array_to_string(countries, ',') AS countries, len(active_hours) AS hours, list_contains(countries, 'RU') AS ru,
  list_contains(countries, 'SG') AS sg_known FROM hist""",
)
oracle(
    "ip_helpers", ["ev"],
    """SELECT DISTINCT source_ip, regexp_replace(source_ip, '[.][^.]*$', '') AS network, source_ip LIKE '10.%' AS private,
  source_ip NOT LIKE '203.0.113.%' AS moved,
  ((CAST(split_part(source_ip, '.', 1) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 2) AS BIGINT)) * 256
    + CAST(split_part(source_ip, '.', 3) AS BIGINT)) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) AS number, true AS valid FROM ev""",
)
oracle(
    "numeric_functions", ["ev"],
    """SELECT user_id, round(f / nullif(CAST(g AS DOUBLE), 0), 6) AS per_grant,
  CASE WHEN f > 0 AND l > 0 THEN round(2 * (f / n) * (l / n) / (f / n + l / n), 6) END AS f1,
  round(CASE WHEN l / 31.0::DOUBLE <= 0.5 THEN 1.0 ELSE n / (l / 31.0::DOUBLE) END, 6) AS volume_ratio FROM (
  SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event_outcome = 'failure') AS DOUBLE) AS f,
    CAST(count(*) FILTER (event_action = 'user-login') AS DOUBLE) AS l, count(*) FILTER (event_action = 'role-change') AS g FROM ev GROUP BY 1)""",
)
oracle(
    "baseline_predicates", ["ev", "hist"],
    """SELECT e.user_id, count(*) FILTER (list_contains(h.countries, e.source_country)) AS known_country,
  count(*) FILTER (list_contains(h.user_agents, e.user_agent)) AS known_agent, count(*) FILTER (list_contains(h.active_hours, hour(e.ts))) AS active_hour,
  count(*) FILTER (h.dormant_days >= 1) AS dormant FROM ev e JOIN hist h USING (user_id) GROUP BY 1""",
)
oracle(
    "severity_algebra", ["alerts"],
    """SELECT severity, entity_type, CAST(any_value(rank) AS BIGINT) AS rank, any_value([1.0, 5.0, 15.0, 40.0, 100.0][rank + 1]::DOUBLE) AS weight,
  bool_or(rank >= 2) AS at_least_medium, count(*) AS alerts FROM alerts GROUP BY 1, 2""",
)
oracle(
    "risk_decay", ["ev", "now"],
    f"""SELECT event_id, round(CASE WHEN gap <= 0 OR s <= 0 THEN greatest(s, 0) WHEN d < 0.5 THEN 0 ELSE d END, 6) AS "left" FROM (
  SELECT event_id, {LAG} * 40 AS s, epoch_us(now.at) - epoch_us(ts) AS gap,
    {LAG} * 40 * pow(0.5, ((epoch_us(now.at) - epoch_us(ts)) // 1000000) / 21600.0::DOUBLE) AS d FROM ev, now)""",
)
oracle("dedupe_key", ["alerts"], "SELECT dedupe_key, count(*) AS firings FROM alerts GROUP BY 1")
oracle(
    "interval_overlap", ["alerts", "ev"],
    """SELECT a.rule_id, count(*) FILTER (a.window_start - s.b <= INTERVAL 1 DAY AND s.b - a.window_end <= INTERVAL 1 DAY) AS near, count(*) AS alerts
FROM alerts a JOIN (SELECT user_id, max(ts) AS b FROM ev GROUP BY 1) s ON s.user_id = a.entity_id GROUP BY 1""",
)

# --- aggregations ----------------------------------------------------------------------------

oracle(
    "ingest_health", ["ev"],
    f"""SELECT count(*) AS events, count(DISTINCT user_id) AS users, min(ts) AS earliest, max(ts) AS latest, round(avg({LAG}), 3) AS avg_lag_s,
  round(max({LAG}), 3) AS max_lag_s, count(DISTINCT source_ip) AS source_ips FROM ev""",
)
oracle("events_per_minute", ["ev"], "SELECT date_trunc('minute', ts) AS minute, event_outcome, count(*) AS events FROM ev GROUP BY 1, 2")
oracle(
    "duplicate_check", ["flat"],
    "SELECT event_id, count(*) AS copies FROM flat GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, event_id LIMIT 10",
)
oracle(
    "login_failure_rate", ["ev"],
    """SELECT round(count(*) FILTER (event_outcome = 'failure') / CAST(count(*) AS DOUBLE), 6) AS failure_rate, count(*) AS login_attempts
FROM ev WHERE event_action = 'user-login'""",
)
oracle(
    "user_activity", ["ev"],
    "SELECT user_id, count(*) AS events, count(*) FILTER (event_outcome = 'failure') AS failures FROM ev GROUP BY 1 ORDER BY events DESC, user_id LIMIT 20",
)
oracle(
    "user_countries", ["ev"],
    """SELECT user_id, source_country, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM ev GROUP BY 1, 2
ORDER BY user_id, events DESC, source_country LIMIT 40""",
)
oracle(
    "brute_force_hunt", ["ev"],
    """SELECT user_id, CAST(count(*) AS BIGINT) AS failures, count(DISTINCT source_ip) AS distinct_sources, min(ts) AS first_attempt, max(ts) AS last_attempt,
  array_to_string(list_sort(list(DISTINCT source_ip)), ', ') AS sources, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS duration_s
FROM ev WHERE event_action = 'user-login' AND event_outcome = 'failure' GROUP BY 1 HAVING count(*) >= 10""",
)
oracle(
    "noisy_sources", ["ev"],
    """SELECT source_ip AS source, source_country, count(*) AS attempts, count(DISTINCT user_id) AS distinct_users,
  count(*) FILTER (event_outcome = 'success') AS successes, max(ts) AS last_seen FROM ev WHERE event_action = 'user-login'
GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 10""",
)
oracle(
    "attack_inventory", ["ev"],
    """SELECT scenario, run_id, technique, count(*) AS events, count(DISTINCT user_id) AS users_touched, min(ts) AS started, max(ts) AS ended
FROM ev WHERE scenario IS NOT NULL GROUP BY 1, 2, 3""",
)
oracle(
    "user_baseline", ["base"],
    """SELECT * REPLACE (array_to_string(countries, ',') AS countries, array_to_string(user_agents, ',') AS user_agents, array_to_string(active_hours, ',') AS active_hours) FROM base""",
)
oracle("modal_values", ["base"], "SELECT user_id, primary_country, peak_hour FROM base")
oracle(
    "baseline_distribution", ["base"],
    """SELECT *, round(p95 / median, 1) AS p95_to_median FROM (SELECT count(*) AS accounts, round(avg(events_per_day), 1) AS mean_events_per_day,
  round(quantile_cont(events_per_day, 0.5), 1) AS median, round(quantile_cont(events_per_day, 0.95), 1) AS p95, round(max(events_per_day), 1) AS max,
  round(avg(failure_rate), 4) AS mean_failure_rate, round(avg(distinct_countries), 2) AS mean_countries FROM base)""",
)
oracle(
    "baseline_outliers", ["base"],
    """SELECT user_id, events_per_day, failure_rate, distinct_countries, distinct_source_ips, primary_country, dormant_days FROM base
ORDER BY events_per_day DESC, user_id LIMIT 10""",
)
oracle(
    "baseline_publish_stats", ["base"],
    "SELECT round(avg(len(countries)), 2) AS mean_known_countries, count(*) FILTER (len(countries) > 1) AS accounts_with_several FROM base",
)
oracle(
    "archive_actions", ["ev"],
    "SELECT event_action, count(*) AS events, count(*) FILTER (event_outcome = 'failure') AS failures FROM ev GROUP BY 1 ORDER BY events DESC, 1 LIMIT 8",
)
oracle(
    "archive_sources", ["ev"],
    "SELECT source_ip, source_country, count(*) AS events, count(DISTINCT user_id) AS distinct_users FROM ev GROUP BY 1, 2 ORDER BY events DESC, 1, 2 LIMIT 5",
)
oracle("archive_attacks", ["ev"], "SELECT scenario, count(*) AS events, count(DISTINCT user_id) AS users FROM ev WHERE scenario IS NOT NULL GROUP BY 1")
oracle(
    "quality_checks", ["ev", "now", "dead"],
    f"""SELECT check_name, category, CASE WHEN how = 'most' THEN observed <= threshold ELSE observed >= threshold END AS passed, round(observed, 6) AS observed, threshold,
  (SELECT "at" FROM now) AS checked_at FROM (
  SELECT 'freshness_seconds' AS check_name, 'liveness' AS category, 'most' AS how, 0.0::DOUBLE AS observed, 300.0::DOUBLE AS threshold
  UNION ALL SELECT 'max_lag_seconds', 'liveness', 'most', coalesce(max({LAG}), 0), 120 FROM ev, now WHERE ingested_at > now.at - INTERVAL 10 MINUTE AND ingested_at <= now.at AND scenario IS NULL
  UNION ALL SELECT 'null_user_rate', 'correctness', 'most', 0, 0.001
  UNION ALL SELECT 'null_source_ip_rate', 'correctness', 'most', 0, 0.01
  UNION ALL SELECT 'distinct_users_hourly', 'liveness', 'least', count(DISTINCT user_id), 10 FROM ev, now WHERE ts > now.at - INTERVAL 1 HOUR
  UNION ALL SELECT 'unknown_action_rate', 'correctness', 'most', 0, 0.01
  UNION ALL SELECT 'dead_letters_last_hour', 'correctness', 'most', count(*), 0 FROM dead, now WHERE arrived_at > now.at - INTERVAL 1 HOUR AND arrived_at <= now.at
  UNION ALL SELECT 'default_partition_rows', 'correctness', 'most', count(*), 0 FROM ev, now WHERE CAST(ts AS DATE) < CAST(now.at AS DATE) - 24)""",
)
oracle(
    "quality_latest", ["ev"],
    """SELECT checked_at, check_name, CAST(observed AS DOUBLE) AS observed FROM (
  SELECT date_trunc('day', ts) AS checked_at, 'rows' AS check_name, count(*) AS observed FROM ev GROUP BY 1
  UNION ALL SELECT date_trunc('day', ts), 'users', count(DISTINCT user_id) FROM ev GROUP BY 1)
QUALIFY row_number() OVER (PARTITION BY check_name ORDER BY checked_at DESC) = 1""",
)
oracle(
    "window_state", ["hits"],
    """SELECT rule_id, entity_id, make_timestamp(w) AS window_us, CAST(threshold AS BIGINT) AS threshold, count(*) AS events, count(DISTINCT counted) AS distinct_values,
  min(ts) AS first_seen, max(ts) AS last_seen FROM hits GROUP BY 1, 2, w, threshold""",
)
oracle(
    "pipeline_state", ["ev"],
    f"""SELECT count(*) FILTER (ingested_at > m - INTERVAL 1 MINUTE) AS rows_last_minute, round(coalesce(max({LAG}), 0), 2) AS max_lag_s,
  round(coalesce(avg({LAG}), 0), 2) AS avg_lag_s FROM ev, (SELECT max(ingested_at) AS m FROM ev) WHERE ingested_at > m - INTERVAL 2 MINUTE""",
)
_KEEP_UP = f"""
SELECT *, keep_up_ratio >= 0.95 AS keeps_up FROM (
SELECT offered_rate, round(a, 1) AS achieved_rate, round(a / offered_rate, 3) AS keep_up_ratio, max_lag_s, median_lag_s, round(trend, 1) AS lag_trend_s, trend >= 5 AS lag_growing FROM (
  SELECT offered_rate, (arg_max(ingested, "at") - arg_min(ingested, "at")) / nullif((epoch_us(max("at")) - epoch_us(min("at"))) / 1000000.0::DOUBLE, 0) AS a,
    round(max(lag), 2) AS max_lag_s, round(quantile_cont(lag, 0.5), 2) AS median_lag_s, arg_max(lag, "at") - arg_min(lag, "at") AS trend FROM (
    SELECT day(d) * 0.0005::DOUBLE AS offered_rate, "at", lag, sum(n) OVER (PARTITION BY d ORDER BY h) AS ingested FROM (
      SELECT CAST(ingested_at AS DATE) AS d, hour(ingested_at) AS h, count(*) AS n, max({LAG}) AS lag, max(ingested_at) AS at FROM ev GROUP BY 1, 2))
  GROUP BY 1))"""
oracle("keep_up_report", ["ev"], _KEEP_UP)
oracle("breaking_point", ["ev"], f"SELECT min(offered_rate) AS breaking_rate FROM ({_KEEP_UP}) WHERE NOT keeps_up")
oracle(
    "pipeline_health", ["ev", "dead"],
    f"""SELECT * FROM (SELECT minute, n AS ingested, sum(n) OVER (ORDER BY minute ROWS 29 PRECEDING) = 0 AND count(*) OVER (ORDER BY minute ROWS 29 PRECEDING) = 30 AS ingestion_stopped,
  sum(f) OVER (ORDER BY minute ROWS 14 PRECEDING) > 0 AS dead_letter_backlog, coalesce(lag > 25, false) AS lag_over_bound FROM (
  SELECT s.minute, coalesce(c.n, 0) AS n, coalesce(d.f, 0) AS f, c.lag FROM
    (SELECT unnest(generate_series(date_trunc('minute', min(ingested_at)), date_trunc('minute', max(ingested_at)), INTERVAL 1 MINUTE)) AS minute FROM ev) s
    LEFT JOIN (SELECT date_trunc('minute', ingested_at) AS minute, count(*) AS n, max({LAG}) AS lag FROM ev GROUP BY 1) c USING (minute)
    LEFT JOIN (SELECT date_trunc('minute', arrived_at) AS minute, count(*) AS f FROM dead GROUP BY 1) d USING (minute)))
WHERE ingestion_stopped OR dead_letter_backlog OR lag_over_bound""",
)
oracle(
    "alert_rates", ["alerts"],
    "SELECT rule_id, time_bucket(INTERVAL 5 MINUTE, detected_at, TIMESTAMP '1970-01-01') AS period_start, count(*) AS firings FROM alerts GROUP BY 1, 2",
)
oracle(
    "alert_share", ["alerts", "now"],
    "SELECT rule_id, count(*) AS firings, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share FROM alerts, now WHERE detected_at > now.at - INTERVAL 7 DAY GROUP BY 1",
)
oracle(
    "response_counters", ["positions", "incidents", "now"],
    """SELECT count(*) FILTER (occurrence > 1) AS alerts_deduplicated, (SELECT count(*) FROM incidents, now WHERE opened_at > now.at - INTERVAL 7 DAY) AS incidents_opened
FROM positions, now WHERE detected_at > now.at - INTERVAL 7 DAY""",
)
_DETECTIONS = [(r.id, r.technique) for r in WEEKLY] + list(SEQUENCE_TECHNIQUES.items())
oracle(
    "attack_coverage", ["alerts"],
    f"""SELECT technique, string_agg(detection, ',' ORDER BY detection) AS detections, CAST(coalesce(sum(n), 0) AS BIGINT) AS alerts,
  coalesce(string_agg(detection, ',' ORDER BY detection) FILTER (n IS NULL), '') AS silent
FROM (VALUES {", ".join(str(d) for d in _DETECTIONS)}) AS t(detection, technique)
LEFT JOIN (SELECT rule_id AS detection, count(*) AS n FROM alerts GROUP BY 1) USING (detection) GROUP BY 1""",
)

# --- window functions and joins --------------------------------------------------------------

oracle(
    "new_country_logins", ["ev"],
    """SELECT user_id, prev_country, source_country, prev_ts, ts, source_ip AS source, (epoch_us(ts) - epoch_us(prev_ts)) / 1000000.0::DOUBLE AS gap_s FROM (
  SELECT *, lag(source_country) OVER w AS prev_country, lag(ts) OVER w AS prev_ts FROM ev WHERE event_action = 'user-login' AND event_outcome = 'success'
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE source_country <> prev_country AND ts - prev_ts < INTERVAL 12 HOUR""",
)
oracle(
    "threshold_crossing", ["crossings"],
    "SELECT rule_id, entity_id, make_timestamp(w) AS window_us, CAST(threshold AS BIGINT) AS threshold, ts, event_id FROM crossings",
)
oracle("session_fingerprint", ["hijack0"], "SELECT event_id, user_id, s.id AS session_event, s.ip AS session_ip FROM hijack0")
oracle(
    "late_event_audit", ["ev"],
    f"""SELECT *, (epoch_us(newest_ts) - epoch_us(ts)) / 1000000.0::DOUBLE AS late_by_s FROM (
  SELECT user_id, event_id, ts, ingested_at, max(ts) OVER (PARTITION BY user_id ORDER BY ingested_at, event_id {PREVIOUS}) AS newest_ts
  FROM (SELECT * REPLACE (CASE WHEN source_port % 20 = 3 THEN ingested_at + INTERVAL 2 DAY ELSE ingested_at END AS ingested_at) FROM ev))
WHERE epoch_us(newest_ts) - epoch_us(ts) > 1000000""",
)
oracle(
    "brute_force_success", ["ev"],
    """SELECT s.user_id, f.n AS preceding_failures, s.ts AS compromise_time, s.source_ip AS source, s.source_country FROM (
  SELECT user_id, count(*) AS n, max(ts) AS last FROM ev WHERE event_action = 'user-login' AND event_outcome = 'failure' GROUP BY 1 HAVING count(*) >= 10) f
JOIN ev s ON s.user_id = f.user_id AND s.event_action = 'user-login' AND s.event_outcome = 'success'
  AND s.ts BETWEEN f.last - INTERVAL 12 HOUR AND f.last + INTERVAL 12 HOUR""",
)
block("hist_country", ["early"], _mode("early", "source_country", "primary_country"))
oracle(
    "baseline_enrich", ["ev", "hist", "hist_country"],
    "SELECT e.event_id, e.user_id, e.source_country, h.total_events, c.primary_country FROM ev e JOIN hist h USING (user_id) LEFT JOIN hist_country c USING (user_id)",
)
oracle(
    "outstanding_action_filter", ["actions"],
    """SELECT action, target_type, target_id, requires_approval FROM actions
WHERE NOT (action = 'disable_account' AND CAST(substr(target_id, 7, 1) AS INT) % 2 = 0)""",
)
oracle(
    "incident_detail", ["incidents", "triaged", "attached", "move_log", "actions"],
    """SELECT incident_id, 'incident' AS section, opened_at AS at, status AS item, title AS detail FROM incidents
UNION ALL SELECT i.incident_id, 'alert', t.last_detected_at, t.id, concat_ws('|', t.rule_id, t.severity, t.triage) FROM triaged t
  JOIN incidents i USING (entity_type, entity_id) WHERE t.id IN (SELECT stored_id FROM attached)
UNION ALL SELECT incident_id, 'note', "at", actor, note FROM move_log WHERE accepted
UNION ALL SELECT incident_id, 'action', proposed_at, action, concat_ws('|', target_type, target_id, status) FROM actions""",
)
oracle(
    "incident_list", ["incidents"],
    "SELECT incident_id, severity, updated_at, alert_count FROM incidents ORDER BY updated_at DESC, incident_id LIMIT 200",
)
oracle("undetected_runs", ["runs"], "SELECT scenario, run_id FROM runs WHERE NOT detected")
oracle(
    "top_risk", ["risk", "now"],
    """SELECT * FROM (SELECT entity_type, entity_id, round(CASE WHEN d < 0.5 AND g > 0 THEN 0 ELSE d END, 1) AS current_score, round(score, 1) AS stored_score,
  round(peak_score, 1) AS peak_score, updated_at AS last_alert_at, peaked_at FROM (
  SELECT *, epoch_us(now.at) - epoch_us(updated_at) AS g, score * pow(0.5, greatest((epoch_us(now.at) - epoch_us(updated_at)) // 1000000, 0) / 21600.0::DOUBLE) AS d FROM risk, now))
WHERE current_score > 0 ORDER BY current_score DESC, entity_type, entity_id LIMIT 20""",
)

# --- detections ------------------------------------------------------------------------------

for _rule in WEEKLY:
    oracle(
        _rule.id.replace("aws-", "cloud-").replace("-", "_"), ["threshold_alerts"],
        f"SELECT * FROM threshold_alerts WHERE rule_id = '{_rule.id}'",
    )
block(
    "evidence",
    ["hits", "crossings"],
    """
SELECT h.*, c.ts AS cut_ts, c.event_id AS cut_id FROM hits h JOIN crossings c USING (rule_id, entity_id, w) WHERE (h.ts, h.event_id) <= (c.ts, c.event_id)""",
)
_SHOWS_IP = _in([r.id for r in WEEKLY if "source.ip" in r.context_fields])
oracle(
    "threshold_evidence", ["evidence"],
    f"""SELECT sha256(concat_ws('|', rule_id, entity_id, CAST(w AS VARCHAR), any_value(cut_id))) AS alert_id, CAST(count(*) AS VARCHAR) AS events_in_window,
  CASE WHEN rule_id IN {_SHOWS_IP} THEN (SELECT string_agg(v, ', ' ORDER BY a) || CASE WHEN any_value(n) > 8 THEN ', …' ELSE '' END FROM (
     SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY a) AS p FROM (SELECT source_ip AS v, min((ts, event_id)) AS a FROM evidence i
     WHERE i.rule_id = e.rule_id AND i.entity_id = e.entity_id AND i.w = e.w GROUP BY 1)) WHERE p <= 8) END AS source_ips,
  CASE WHEN count(counted) > 0 THEN CAST(any_value(threshold) AS VARCHAR) END AS distinct_count,
  (SELECT string_agg(v, ', ' ORDER BY a) || CASE WHEN any_value(n) > 10 THEN ', …' ELSE '' END FROM (
     SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY a) AS p FROM (SELECT counted AS v, min((ts, event_id)) AS a FROM evidence i
     WHERE i.rule_id = e.rule_id AND i.entity_id = e.entity_id AND i.w = e.w AND counted IS NOT NULL GROUP BY 1)) WHERE p <= 10) AS distinct_sample,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_seen,
  array_to_string(list(event_id ORDER BY ts, event_id)[1:5], ',') AS sample_event_ids
FROM evidence e GROUP BY rule_id, entity_id, w""",
)
oracle(
    "window_evidence", ["hits"],
    f"""SELECT e.rule_id, e.entity_id, make_timestamp(e.w) AS window_us, events_in_window, sample_event_ids, CASE WHEN e.rule_id IN {_SHOWS_IP} THEN ips END AS source_ips FROM (
  SELECT rule_id, entity_id, w, count(*) AS events_in_window, array_to_string(list(event_id ORDER BY ts, event_id)[1:5], ',') AS sample_event_ids FROM hits GROUP BY ALL) e
JOIN (SELECT rule_id, entity_id, w, string_agg(source_ip, ', ' ORDER BY p) FILTER (p <= 8) || CASE WHEN max(p) > 8 THEN ', …' ELSE '' END AS ips FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, entity_id, w ORDER BY a) AS p FROM (
    SELECT rule_id, entity_id, w, source_ip, min((ts, event_id)) AS a FROM hits GROUP BY ALL)) GROUP BY 1, 2, 3) i USING (rule_id, entity_id, w)""",
)
block("travel12", ["logins"], _travel(12))
oracle(
    "impossible_travel", ["travel12"],
    f"SELECT {ALERT}, 'Two logins too far apart for the time between them' AS rule_name, concat_ws('|', rule_id, entity_type, entity_id) AS dedupe_key FROM travel12",
)
oracle("session_hijack", ["hijack"], "SELECT *, concat_ws('|', rule_id, entity_type, entity_id) AS dedupe_key FROM hijack")
oracle("baseline_deviation", ["deviation"], "SELECT alert_id, detected_at, entity_id, severity, observed, deviations FROM deviation")
oracle("alert_union", ["alerts"], "SELECT * EXCLUDE (rank) FROM alerts")

# --- alerts, risk, incidents, response, scoring ----------------------------------------------

oracle("alert_islands", ["positions"], "SELECT alert_id, stored_id, occurrence FROM positions")
oracle("fold_alerts", ["stored"], "SELECT * FROM stored")
oracle(
    "alert_list", ["triaged"],
    "SELECT id, rule_id, last_detected_at, occurrences, triage FROM triaged WHERE severity = 'high' ORDER BY last_detected_at DESC, id LIMIT 200",
)
oracle(
    "rule_stats", ["triaged"],
    """SELECT rule_id, count(*) AS alerts, CAST(sum(occurrences) AS BIGINT) AS firings, count(*) FILTER (triage = 'true_positive') AS true_positives,
  count(*) FILTER (triage = 'false_positive') AS false_positives, count(*) FILTER (triage = 'untriaged') AS untriaged,
  round(count(*) FILTER (triage = 'true_positive') / nullif(CAST(count(*) FILTER (triage IN ('true_positive', 'false_positive')) AS DOUBLE), 0), 3) AS precision,
  max(last_detected_at) AS last_fired FROM triaged GROUP BY 1""",
)
oracle("triage", ["triaged"], "SELECT id, triage, triaged_at, triaged_by FROM triaged")
oracle("firing_scores", ["scored"], "SELECT alert_id, occurrence, round(score, 6) AS score FROM scored")
oracle("risk_scores", ["risk"], "SELECT * REPLACE (round(score, 6) AS score, round(peak_score, 6) AS peak_score) FROM risk")
oracle("open_incidents", ["incidents"], "SELECT * REPLACE (round(risk_score, 6) AS risk_score, round(opening_risk, 6) AS opening_risk) FROM incidents")
oracle("incident_transitions", ["move_log"], 'SELECT incident_id, "at", "to", found, "left", accepted FROM move_log')
oracle("incident_states", ["states"], "SELECT * FROM states")
oracle("propose_actions", ["actions"], "SELECT * FROM actions")
oracle("action_lifecycle", ["acted"], "SELECT action_id, status, approved_by, reverted_by, error FROM acted")
oracle(
    "action_list", ["acted"],
    "SELECT action_id, proposed_at, status, coalesce(error, result) AS outcome FROM acted ORDER BY proposed_at DESC, action_id LIMIT 50",
)
oracle("audit_trail", ["trail"], """SELECT actor, action, subject_type, count(*) AS entries, max("at") AS last_at FROM trail GROUP BY 1, 2, 3""")
oracle("audit_recent", ["trail"], 'SELECT "at", subject_type, action FROM trail ORDER BY "at" DESC, subject_type, subject_id, action')
oracle(
    "audit_subject", ["trail"],
    """SELECT "at", actor, action, detail FROM trail WHERE subject_type = 'user' AND subject_id = 'u-00001' ORDER BY "at" DESC, action""",
)
oracle(
    "attack_ground_truth", ["attacks"],
    """SELECT * EXCLUDE ("at") REPLACE (array_to_string(users, ',') AS users, array_to_string(source_ips, ',') AS source_ips) FROM attacks""",
)
oracle("score_match", ["matched"], "SELECT id, rule_id, matched FROM matched")
oracle("score_rules", ["rule_scores"], "SELECT * FROM rule_scores")
oracle("score_scenarios", ["scenario_scores"], "SELECT * FROM scenario_scores")
oracle(
    "score_overall", ["matched", "runs"],
    """SELECT tp, fp, detected, runs, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 6) END AS f1 FROM (
  SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, detected / CAST(runs AS DOUBLE) AS r FROM
    (SELECT count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fp FROM matched),
    (SELECT count(*) FILTER (detected) AS detected, count(*) AS runs FROM runs))""",
)
oracle(
    "score_history", ["rule_scores", "scenario_scores", "now"],
    """SELECT "at" AS scored_at, 240.0::DOUBLE AS window_hours, s.* FROM now, (
  SELECT rule_id, NULL::VARCHAR AS scenario, tp AS true_positives, fp AS false_positives, CAST(0 AS BIGINT) AS false_negatives, precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1 FROM rule_scores
  UNION ALL SELECT NULL, scenario, detected, 0, missed, NULL, recall, NULL FROM scenario_scores) s""",
)

# --- the standard pack, on bursts -------------------------------------------------------------

block(
    "bursts", ["ev"],
    f"""SELECT ev.* REPLACE (make_timestamp(epoch_us(f) + (epoch_us(ts) - epoch_us(f)) // {SQUEEZE}) AS ts,
  'u-' || CAST(substr(user_id, 3, 5) AS INT) % (CASE WHEN event_action = 'api-key-used' THEN 5 ELSE 50 END) AS user_id, CASE WHEN source_ip LIKE '203.%' THEN '203.0.113.7' ELSE source_ip END AS source_ip,
  CASE WHEN event_category IN ('iam', 'api') THEN 'aws' ELSE service_environment END AS service_environment)
FROM ev, (SELECT date_trunc('day', min(ts)) AS f FROM ev)""",
)
block("burst_hits", ["bursts"], "\nUNION ALL\n".join(_hits(r).replace("FROM ev WHERE", "FROM bursts WHERE") for r in STANDARD))
block("burst_crossings", ["burst_hits"], BLOCKS["crossings"][1].replace("FROM hits", "FROM burst_hits"))
block("burst_alerts", ["burst_crossings"], BLOCKS["threshold_alerts"][1].replace("FROM crossings", "FROM burst_crossings"))
for _rule in STANDARD:
    oracle(
        f"standard_{_rule.id.replace('-', '_')}", ["burst_alerts"],
        f"SELECT alert_id, detected_at, rule_id, severity, entity_type, entity_id, observed, threshold, window_start, window_end FROM burst_alerts WHERE rule_id = '{_rule.id}'",
    )

# --- carried over between runs: the same as in one go -------------------------------------------

oracle("incident_history", ["history"], "SELECT * FROM history")
oracle("incident_requests", ["life_ids"], """SELECT incident_id, entity_id, "at", seq, "to", found, "left", accepted FROM life_ids WHERE NOT firing""")
oracle("carried_incidents", ["history"], "SELECT * FROM history")
oracle("carried_risk", ["risk"], "SELECT * REPLACE (round(score, 6) AS score, round(peak_score, 6) AS peak_score) FROM risk")
oracle("carried_alerts", ["stored"], "SELECT * EXCLUDE (triage) FROM stored")

# --- lake ------------------------------------------------------------------------------------

oracle("retention_plan", ["days", "now"], "SELECT DISTINCT year, month, day FROM days, now WHERE CAST(ts AS DATE) < CAST(now.at AS DATE) - 20")
oracle("partition_report", ["days"], "SELECT year, month, day, count(*) AS rows FROM days GROUP BY ALL")
oracle(
    "pruning_report", ["days", "job_day"],
    """SELECT v AS variant, count(*) FILTER (v = 'full_scan' OR CAST(ts AS DATE) = d) AS rows FROM days, job_day, (VALUES ('full_scan'), ('partition_filter'), ('time_filter')) AS t(v) GROUP BY 1""",
)
oracle("compact_day", ["days"], "SELECT year, month, day, count(*) AS rows, count(DISTINCT event_id) AS ids FROM days GROUP BY ALL")
oracle(
    "daily_maintenance", ["ev", "dead", "job_day"],
    """SELECT event_action, CASE WHEN blocked THEN 0 ELSE events END AS events, blocked FROM (
  SELECT event_action, count(*) AS events FROM ev, job_day WHERE CAST(ts AS DATE) = d GROUP BY 1), (
  SELECT count(*) > 0 AS blocked FROM (
    SELECT 1 FROM dead, job_day WHERE arrived_at > d + INTERVAL 11 HOUR AND arrived_at <= d + INTERVAL 12 HOUR
    UNION ALL SELECT 1 FROM ev, job_day WHERE CAST(ts AS DATE) < d - 40 OR CAST(ts AS DATE) > d + 1))""",
)
oracle(
    "default_partition", ["ev", "job_day"],
    """SELECT strftime(ts, '%Y-%m-%d') AS "partition", count(*) AS events, (SELECT count(*) > 0 FROM ev WHERE source_port % 50 = 7) AS blocked
FROM ev, job_day WHERE CAST(ts AS DATE) >= d + 1 - 10 GROUP BY 1
UNION ALL SELECT '_default', count(*), true FROM ev WHERE source_port % 50 = 7 HAVING count(*) > 0""",
)
oracle(
    "daily_retention", ["ev", "job_day"],
    """SELECT on_day, CASE WHEN kept AND on_day < d - 9 THEN 0 ELSE n END AS hot_rows, CASE WHEN kept OR on_day = d THEN n ELSE 0 END AS archive_rows
FROM (SELECT *, day(on_day) % 5 <> 0 AND on_day < d AS kept FROM (SELECT CAST(ts AS DATE) AS on_day, count(*) AS n FROM ev GROUP BY 1), job_day)""",
)
oracle("snapshot_append", ["loads"], "SELECT load_id, event_action, count(*) AS events FROM loads GROUP BY ALL")
oracle("snapshot_as_of", ["loads"], "SELECT event_action, count(*) AS events, max(ts) AS newest FROM loads WHERE load_id <= 2 GROUP BY 1")
oracle(
    "snapshot_history", ["loads"],
    """SELECT load_id, max(ingested_at) AS committed_at, 'append' AS operation, count(*) AS added_rows, CAST(sum(count(*)) OVER (ORDER BY load_id) AS BIGINT) AS total_rows
FROM loads GROUP BY 1""",
)
oracle("schema_evolution", ["ev"], "SELECT event_action, day(ts) <= 20 AS is_old, count(*) AS events FROM ev GROUP BY 1, 2")

# --- streams ---------------------------------------------------------------------------------

oracle(
    "stream_ingest_events", ["kept", "dead"],
    """SELECT 'event' AS kind, stored_action AS name, count(*) AS n, count(DISTINCT event_id) AS ids FROM kept GROUP BY 2
UNION ALL SELECT 'dead letter', failure_type, count(*), count(DISTINCT "offset") FROM dead GROUP BY 2""",
)
oracle("stream_dedupe_events", ["ev"], "SELECT event_id, CAST(2 AS BIGINT) AS kept, ts AS first_ts FROM ev")
oracle("stream_threshold_alerts", ["threshold_alerts"], "SELECT alert_id, detected_at, rule_id, severity, entity_type, entity_id, observed, threshold FROM threshold_alerts")
oracle("stream_travel_alerts", ["travel12"], "SELECT alert_id, detected_at, rule_id, severity, entity_id, observed FROM travel12")
oracle("stream_hijack_alerts", ["hijack"], "SELECT alert_id, detected_at, rule_id, severity, entity_id, observed FROM hijack")
_WATCHED = (next(r for r in WEEKLY if not r.distinct), next(r for r in WEEKLY if r.distinct))
oracle(
    "stream_windows", ["hits"],
    " UNION ALL ".join(
        f"""SELECT rule_id, entity_id, make_timestamp(w) AS window_start, make_timestamp(w) + INTERVAL {r.window_seconds} SECOND AS window_end, {"count(DISTINCT counted)" if r.distinct else "count(*)"} AS observed
FROM hits WHERE rule_id = '{r.id}' GROUP BY rule_id, entity_id, w
HAVING {"count(DISTINCT counted)" if r.distinct else "count(*)"} >= {r.threshold} AND make_timestamp(w) + INTERVAL {r.window_seconds} SECOND <= (SELECT max(ts) FROM hits WHERE rule_id = '{r.id}') - INTERVAL {r.grace_seconds} SECOND"""
        for r in _WATCHED
    ),
)
oracle("stream_deviation_alerts", ["deviation"], "SELECT alert_id, detected_at, rule_id, severity, entity_id, observed FROM deviation")
oracle(
    "stream_folded_alerts", ["stored"],
    """SELECT id, dedupe_key, rule_id, first_detected_at, last_detected_at, occurrences, severity, technique, observed, threshold, window_start, window_end
FROM stored WHERE last_detected_at + INTERVAL 30 MINUTE <= (SELECT max(last_detected_at) FROM stored) - INTERVAL 1 MINUTE""",
)
oracle("stream_risk_scores", ["scored"], "SELECT alert_id, detected_at, occurrence, round(score, 6) AS score FROM scored")
oracle("stream_batch_metrics", ["arrivals"], "SELECT count(*) AS received, count(failure_type) AS rejected, true AS timed, true AS ordered FROM arrivals")
block("stored_now", ["ev"], 'SELECT max(ingested_at) AS "at" FROM ev')
oracle(
    "stream_quality_checks", ["ev", "stored_now", "dead"],
    f"""SELECT check_name, category, CASE WHEN how = 'most' THEN observed <= threshold ELSE observed >= threshold END AS passed, round(observed, 6) AS observed, threshold,
  (SELECT "at" FROM stored_now) AS checked_at FROM (
  SELECT 'freshness_seconds' AS check_name, 'liveness' AS category, 'most' AS how, (epoch_us(any_value(n."at")) - epoch_us(max(ts))) / 1000000.0::DOUBLE AS observed, 300.0::DOUBLE AS threshold FROM ev, stored_now n WHERE ts <= n."at"
  UNION ALL SELECT 'max_lag_seconds', 'liveness', 'most', coalesce(max({LAG}), 0), 120 FROM ev, stored_now n WHERE ts <= n."at" AND ingested_at > n."at" - INTERVAL 10 MINUTE AND scenario IS NULL
  UNION ALL SELECT 'null_user_rate', 'correctness', 'most', 0, 0.001
  UNION ALL SELECT 'null_source_ip_rate', 'correctness', 'most', 0, 0.01
  UNION ALL SELECT 'distinct_users_hourly', 'liveness', 'least', count(DISTINCT user_id), 10 FROM ev, stored_now n WHERE ts > n."at" - INTERVAL 1 HOUR AND ts <= n."at"
  UNION ALL SELECT 'unknown_action_rate', 'correctness', 'most', 0, 0.01
  UNION ALL SELECT 'dead_letters_last_hour', 'correctness', 'most', count(*), 0 FROM dead, stored_now n WHERE arrived_at > n."at" - INTERVAL 1 HOUR AND arrived_at <= n."at"
  UNION ALL SELECT 'default_partition_rows', 'correctness', 'most', count(*), 0 FROM ev, stored_now n WHERE CAST(ts AS DATE) < CAST(n."at" AS DATE) - 40 OR CAST(ts AS DATE) > CAST(n."at" AS DATE))""",
)
oracle(
    "cloud_failures", ["rec", "ev"],
    """SELECT 'PARSE_ERROR' AS failure_type, failure_reason, count(*) AS deliveries FROM (
  SELECT 'delivery holds no audit record' AS failure_reason FROM rec WHERE call IS NULL
  UNION ALL SELECT CASE WHEN k = 50 THEN 'delivery is not JSON' ELSE 'delivery holds no audit record' END
    FROM ev, range(2) AS t(copy) WHERE copy = 0 OR k % 10 = 4) GROUP BY 2""",
)
