"""The alert model in DuckDB SQL: common table expressions that the oracle queries build on.

Alerts are numbered in their order of arrival: ingest time, then id.
"""

ALERTS = """
ev AS (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k, epoch_us(ts)//1000 AS ms FROM events),
a0 AS (SELECT event_id, user_id, k,
  ['prometheus','datadog','grafana'][CAST(event_id%3 AS INT)+1] AS source,
  ['checkout','auth','database','catalog'][CAST(user_id%4 AS INT)+1] AS service,
  event_type AS alertname,
  CASE WHEN k>=97 THEN 'critical' WHEN k>=80 THEN 'error' WHEN k>=40 THEN 'warning' ELSE 'info' END AS severity_raw,
  CASE WHEN k%10=9 THEN 'resolved' ELSE 'firing' END AS status,
  CASE WHEN user_id%2=0 THEN 'production' ELSE 'staging' END AS environment, 'c'||CAST(user_id%3 AS VARCHAR) AS cluster, 'p'||CAST(event_id%7 AS VARCHAR) AS pod,
  CASE WHEN event_type='error' THEN 'requests failed' WHEN k%17=0 THEN 'pages corrupt' ELSE event_type||' degraded' END AS message,
  1704067200000 + (ms-1704067200000)//60 AS fired_ms FROM ev),
a1 AS (SELECT *, environment||'/'||cluster AS scope_key,
  fired_ms + (event_id*7919)%2000 + CASE WHEN source='grafana' THEN 180000 ELSE 0 END AS ingested_ms,
  CASE severity_raw WHEN 'critical' THEN 'critical' WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' WHEN 'info' THEN 'low' ELSE 'medium' END AS severity,
  lower(service||' '||alertname||' '||message) AS txt FROM a0),
alerts AS (SELECT *, scope_key||'|'||service||'|'||alertname||'|'||severity_raw AS inc,
  CASE WHEN severity_raw='critical' THEN 'SEVERITY_CRITICAL'
   WHEN regexp_matches(txt,'payment|billing|checkout') AND regexp_matches(txt,'failure|failed|declined|error') THEN 'PAYMENT_FAILURE'
   WHEN regexp_matches(txt,'auth|authentication|login|identity') AND regexp_matches(txt,'outage|unavailable|failure|failed|down') THEN 'AUTH_OUTAGE'
   WHEN regexp_matches(txt,'data|database|storage|backup|replication') AND regexp_matches(txt,'loss|corrupt|deleted|destroyed') THEN 'DATA_LOSS' END AS bypass FROM a1),
o AS (SELECT *, row_number() OVER (ORDER BY ingested_ms, event_id) AS seq FROM alerts WHERE bypass IS NULL)"""

#: The mean and variance that a list of gaps folds into, from its first one on.
FOLD = """list_reduce(list_transform({gs}, lambda x: {{'m': CAST(x AS DOUBLE), 'v': CAST(0 AS DOUBLE)}}),
    lambda s, x: {{'m': (1-2.0::DOUBLE/({n}+1))*s.m + 2.0::DOUBLE/({n}+1)*x.m, 'v': (1-2.0::DOUBLE/({n}+1))*(s.v + 2.0::DOUBLE/({n}+1)*pow(x.m-s.m,2))}})"""
#: When an incident is quiet: after now, of n gaps, within the span from first.
QUIET = """CASE WHEN {first}<=0 OR {now}+{w}<={first}+600000 THEN {now}+{w} ELSE greatest({first}+600000, {now}+1) END"""
WAIT = "(CASE WHEN {n}>1 THEN CAST(greatest(1, ceil(least({m}+sqrt({v}), 300000.0))) AS BIGINT) ELSE 5000 END)"

INCIDENTS = ALERTS + f""",
og AS (SELECT *, lag(status) OVER w AS prev_status, lag(fired_ms) OVER w AS prev_ms FROM o WINDOW w AS (PARTITION BY inc ORDER BY seq)),
i0 AS (SELECT inc AS incident_id, any_value(scope_key) AS scope_key, any_value(service) AS service, any_value(alertname) AS alertname,
  any_value(severity) AS severity, any_value(service||' — '||alertname) AS title, arg_max(message, seq) AS summary, count(*) AS alert_count,
  arg_min(fired_ms, seq) AS first_alert_ms, arg_max(fired_ms, seq) AS last_alert_ms, min(ingested_ms) AS first_ingested_ms, max(ingested_ms) AS last_ingested_ms,
  CASE WHEN arg_max(status, seq)='resolved' THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS status,
  count(*) FILTER (WHERE prev_status='resolved' AND status<>'resolved') AS reopen_count,
  list(greatest(0, fired_ms-prev_ms) ORDER BY seq) FILTER (WHERE prev_ms IS NOT NULL) AS gs
  FROM og GROUP BY inc),
i1 AS (SELECT *, coalesce(len(gs),0) AS n, CASE WHEN status<>'RESOLVED' AND len(gs)>0 THEN {FOLD.format(gs="gs", n="len(gs)")} END AS f FROM i0),
i2 AS (SELECT *, coalesce(f.m, 0.0) AS mean_gap, coalesce(f.v, 0.0) AS variance FROM i1),
i3 AS (SELECT *, {WAIT.format(n="n", m="mean_gap", v="variance")} AS wait FROM i2),
incidents AS (SELECT * EXCLUDE (gs, n, f, wait), CASE WHEN status<>'RESOLVED' THEN {QUIET.format(first="first_ingested_ms", now="last_ingested_ms", w="wait")} END AS quiet_at_ms,
  CASE WHEN severity='critical' THEN 'pagerduty' ELSE 'slack' END AS route FROM i3)"""

RHYTHM = INCIDENTS + f""",
g AS (SELECT *, list(greatest(0, fired_ms-prev_ms)) FILTER (WHERE prev_ms IS NOT NULL) OVER (PARTITION BY inc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS gs, first_value(ingested_ms) OVER (PARTITION BY inc ORDER BY seq) AS first_ms FROM og),
h AS (SELECT *, coalesce(len(gs),0) AS n FROM g),
fold AS (SELECT *, CASE WHEN n>0 THEN {FOLD.format(gs="gs", n="n")} END AS f FROM h),
ew AS (SELECT *, CASE WHEN status='resolved' THEN 0 WHEN n<=1 THEN CAST(coalesce(greatest(0, fired_ms-prev_ms),0) AS DOUBLE) ELSE f.m END AS mean_ms, CASE WHEN status='resolved' OR n<=1 THEN 0 ELSE f.v END AS variance FROM fold),
dw AS (SELECT *, {WAIT.format(n="n", m="mean_ms", v="variance")} AS wait FROM ew),
dl AS (SELECT *, CASE WHEN status<>'resolved' THEN {QUIET.format(first="first_ms", now="ingested_ms", w="wait")} END AS quiet_at_ms FROM dw)"""


def _aged(rows: str, keys: str, value: str, latest: str) -> str:
    """One for each row (cs: arrival, ct: its time), halved each hour of the time that passes after it, late arrivals ageing nothing."""
    return f"""(SELECT {keys}, sum(exp(-ln(2.0)*age/3600000.0)) AS {value}, arg_max(ct, cs) AS {latest}, count(*) AS n FROM (
    SELECT *, sum(d) OVER (PARTITION BY {keys} ORDER BY cs DESC ROWS UNBOUNDED PRECEDING) AS age FROM (
    SELECT *, greatest(0, coalesce(lag(ct) OVER (PARTITION BY {keys} ORDER BY cs DESC) - ct, 0)) AS d FROM {rows})) GROUP BY {keys})"""


EDGES = INCIDENTS + f""",
pairs AS (SELECT c.seq AS cs, c.event_id, c.inc AS ci, c.scope_key, c.fired_ms AS ct, n.inc AS ni, max(n.seq) AS ns
  FROM o c JOIN o n ON n.scope_key=c.scope_key AND n.seq<=c.seq AND n.ingested_ms>=c.ingested_ms-900000
  WHERE c.status<>'resolved' GROUP BY ALL),
act AS (SELECT * FROM (SELECT p.*, o.fired_ms AS nf, row_number() OVER (PARTITION BY cs ORDER BY ns DESC) AS rk FROM pairs p JOIN o ON o.seq=p.ns WHERE o.status<>'resolved') WHERE rk<=25),
obs AS (SELECT scope_key, CASE WHEN nf<=ct THEN ni ELSE ci END AS src, CASE WHEN nf<=ct THEN ci ELSE ni END AS dst, ct, cs FROM act WHERE ni<>ci),
edges AS {_aged("obs", "scope_key, src, dst", "weight", "last_seen_ms")},
nodes AS {_aged("(SELECT scope_key, ni AS node, ct, cs FROM act)", "scope_key, node", "observations", "last_observed_ms")},
scopes AS (SELECT * RENAME (n AS observed_revision) FROM {_aged("(SELECT scope_key, fired_ms AS ct, seq AS cs FROM o WHERE status<>'resolved')", "scope_key", "rounds", "last_observed_ms")})"""

OUTBOX = INCIDENTS + """,
outbox AS (SELECT event_id AS outbox_id, inc AS incident_id, ['slack','pagerduty','email'][CAST(event_id%3 AS INT)+1] AS channel,
  CASE WHEN k%4=0 THEN 'create' ELSE 'update' END AS action,
  CASE WHEN k%10<6 THEN 'pending' WHEN k%10=6 THEN 'sent' WHEN k%10=7 THEN 'dead' ELSE 'superseded' END AS status,
  k%6 AS attempts, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority,
  ingested_ms AS created_ms, ingested_ms + (k%7)*1000 AS next_attempt_ms, CASE WHEN k%5=0 THEN ingested_ms+60000 END AS locked_until_ms,
  CASE WHEN k%13=0 THEN event_id-1 END AS failover_of, CASE WHEN k%11=0 THEN 'pagerduty' END AS via,
  CASE WHEN k%3=0 THEN 'ref-'||CAST(event_id%50 AS VARCHAR) END AS external_ref,
  [200,429,401,503,404,400][CAST(event_id%6 AS INT)+1] AS http, k FROM o)"""
