"""Delivery, ledger, breaker and self-check queries. One function per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import delivery as D
from ..operators import folds, ledger
from ..operators.counts import counted
from ..operators.store import written
from .duck import ALERTS, EDGES, INCIDENTS, OUTBOX
from .graphs import REVISIONS, ROOTS, _STORM, _storms, group_root, revisions
from .registry import Frames, query

NOW = 1704090000000
FAULTS = ["unavailable", "rejected", "rate_limited", "transport", "http", "answer", "other"]
DETAILS = ["no_text", "token_revoked", "odd_code", "ConnectTimeout"]


def failures(outbox: DataFrame) -> DataFrame:
    """outbox with what went wrong at its delivery: fault, detail, http, retry_after; every kind occurs."""
    k, box = F.col("k"), F.col("outbox_id")
    take = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return outbox.select("*", take(FAULTS, k % 7).alias("fault"), take(DETAILS, box % 4).alias("detail"), F.when(box % 5 == 0, (box % 90).cast("double")).alias("retry_after"))


FAILED = (
    OUTBOX
    + f""",
fl AS (SELECT *, {FAULTS}[CAST(k%7 AS INT)+1] AS fault, {DETAILS}[CAST(outbox_id%4 AS INT)+1] AS detail, CASE WHEN outbox_id%5=0 THEN CAST(outbox_id%90 AS DOUBLE) END AS ra FROM outbox),
cl AS (SELECT *, CASE WHEN fault IN ('unavailable','transport') THEN 'channel_down' WHEN fault='rejected' THEN 'message_fatal' WHEN fault='http' AND http IN (401,503) THEN 'channel_down'
   WHEN fault='http' AND http IN (400,404) THEN 'message_fatal' WHEN fault='answer' AND detail='no_text' THEN 'message_fatal' WHEN fault='answer' AND detail='token_revoked' THEN 'channel_down' ELSE 'transient' END AS kind,
  CASE fault WHEN 'unavailable' THEN detail WHEN 'rejected' THEN detail WHEN 'rate_limited' THEN 'rate_limited' WHEN 'transport' THEN 'transport:'||detail
   WHEN 'http' THEN CASE WHEN http>=400 THEN 'http:'||http ELSE 'unknown:'||detail END WHEN 'answer' THEN 'slack:'||detail ELSE 'unknown:'||detail END AS reason,
  CASE WHEN fault IN ('unavailable','rate_limited') OR (fault='http' AND http IN (429,503)) THEN ra END AS retry_after FROM fl)"""
)


@query("failure_classify", "SELECT outbox_id, kind, reason, retry_after, kind='message_fatal' AS charged, kind='channel_down' AS trips FROM cl", FAILED)
def failure_classify(f: Frames) -> DataFrame:
    verdict = D.classify(F.col("fault"), F.col("detail"), F.col("http"), F.col("retry_after"))
    rows = failures(f.outbox()).select("outbox_id", verdict.alias("v"))
    return rows.select("outbox_id", "v.kind", "v.reason", "v.retry_after", (F.col("v.kind") == "message_fatal").alias("charged"), (F.col("v.kind") == "channel_down").alias("trips"))


@query(
    "delivery_outcome",
    """SELECT outbox_id, CASE WHEN kind='message_fatal' OR (kind='transient' AND attempts+1>=5) THEN 'dead' ELSE 'pending' END AS status, CAST(CASE WHEN kind='transient' THEN attempts+1 ELSE attempts END AS INT) AS attempts,
    CASE kind WHEN 'channel_down' THEN coalesce(CASE WHEN outbox_id%3=0 THEN created_ms+5000 END, created_ms+1000)
      WHEN 'transient' THEN created_ms+CASE WHEN coalesce(retry_after,0)>0 THEN CAST(retry_after*1000 AS BIGINT) ELSE CAST(least(power(2.0, attempts+1), 300.0)*1000 AS BIGINT) END END AS next_ms,
    CASE WHEN kind='channel_down' THEN 'channel_down:'||reason ELSE reason END AS last_error FROM cl""",
    FAILED,
)
def delivery_outcome(f: Frames) -> DataFrame:
    """Every row after its failure; a third of the channels' breakers have a probe planned five seconds on."""
    verdict = D.classify(F.col("fault"), F.col("detail"), F.col("http"), F.col("retry_after"))
    probe = F.when(F.col("outbox_id") % 3 == 0, F.col("created_ms") + 5000)
    rows = failures(f.outbox()).withColumn("v", verdict)
    return rows.select("outbox_id", D.outcome(F.col("v"), F.col("attempts"), F.col("created_ms"), probe).alias("o")).select("outbox_id", "o.*")


#: The breaker in SQL: the results of a channel one after another.
BREAKER = (
    OUTBOX.replace("ev AS", "RECURSIVE ev AS", 1)
    + """,
rs AS (SELECT channel, outbox_id, created_ms AS at_ms, status, priority, CASE WHEN k%3=0 THEN CASE WHEN k%2=0 THEN 'probe_ok' ELSE 'probe_fail' END WHEN http=200 THEN 'ok' WHEN http=429 THEN 'transient' WHEN http IN (401,503) THEN 'channel_down' ELSE 'message_fatal' END AS kind,
  row_number() OVER (PARTITION BY channel ORDER BY created_ms, outbox_id) AS n, count(*) FILTER (WHERE status='pending') OVER w AS queued, count(*) FILTER (WHERE status='pending' AND coalesce(priority,2)<=1) OVER w AS urgent FROM outbox WINDOW w AS (PARTITION BY channel ORDER BY created_ms, outbox_id)),
st(channel, n, state, failures, step) AS (SELECT channel, CAST(0 AS BIGINT), 'CLOSED', 0, 0 FROM rs GROUP BY channel UNION ALL
  SELECT r.channel, r.n,
   CASE WHEN r.kind='ok' THEN 'CLOSED' WHEN r.kind='channel_down' AND (s.state<>'CLOSED' OR s.failures+1>=3) THEN 'OPEN' WHEN r.kind='probe_ok' AND s.state='OPEN' THEN 'HALF_OPEN' ELSE s.state END,
   CASE WHEN r.kind='ok' OR (r.kind='probe_ok' AND s.state='OPEN') THEN 0 WHEN r.kind='channel_down' THEN s.failures+1 ELSE s.failures END,
   CASE WHEN r.kind='ok' THEN 0 WHEN r.kind='channel_down' AND s.state<>'CLOSED' THEN s.step+1 WHEN r.kind='probe_fail' AND s.state='OPEN' THEN s.step+1 ELSE s.step END
  FROM st s JOIN rs r ON r.channel=s.channel AND r.n=s.n+1),
br AS (SELECT r.*, s.state, s.failures, s.step, coalesce(lag(s.state) OVER (PARTITION BY r.channel ORDER BY r.n), 'CLOSED') AS was FROM st s JOIN rs r USING (channel, n)),
ou AS (SELECT *, sum(CASE WHEN state<>'CLOSED' AND was='CLOSED' THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY n) AS outage FROM br WHERE state<>'CLOSED' OR was<>'CLOSED'),
outages AS (SELECT channel, min(at_ms) AS detected_ms, max(CASE WHEN state='CLOSED' THEN at_ms END) AS recovered_ms, count(*) FILTER (WHERE kind='probe_fail' AND state<>'CLOSED') AS probes, arg_min(queued, n) AS queued_at_peak, arg_min(urgent, n) AS failed_over FROM ou GROUP BY channel, outage)"""
)


#: Every urgent row with the first outage found after it, and the fallbacks that are not open at that moment.
_MOVED = """,
wait AS (SELECT b.outbox_id, b.incident_id, b.channel, b.action, b.failover_of, min(g.detected_ms) AS moved_ms FROM outbox b JOIN outages g ON g.channel=b.channel AND g.detected_ms>=b.created_ms WHERE b.status='pending' AND coalesce(b.priority,2)<=1 AND b.failover_of IS NULL GROUP BY ALL),
tried AS (SELECT w.*, t.target, t.place, (SELECT arg_max(state, n) FROM br WHERE br.channel=t.target AND br.at_ms<=w.moved_ms) AS state FROM wait w JOIN (VALUES ('slack','pagerduty',0),('slack','email',1),('pagerduty','slack',0),('pagerduty','email',1)) t(channel, target, place) ON t.channel=w.channel),
moved AS (SELECT outbox_id, any_value(incident_id) AS incident_id, any_value(channel) AS failover_from, any_value(action) AS action, any_value(moved_ms) AS moved_ms, arg_min(target, place) AS target FROM tried WHERE coalesce(state,'CLOSED')<>'OPEN' GROUP BY outbox_id)"""


@query(
    "failover_pending",
    """SELECT outbox_id, incident_id, target AS channel, CASE WHEN action='update' THEN 'create' ELSE action END AS action, outbox_id AS failover_of, failover_from, NULL AS delivered_via_fallback FROM moved
    UNION ALL SELECT outbox_id, incident_id, failover_from, action, NULL, NULL, target FROM moved""",
    BREAKER + _MOVED,
)
def failover_pending(f: Frames) -> DataFrame:
    """Urgent rows of a channel that goes down: the new row on the first fallback that is up then, and the original, still pending, tagged with it."""
    box = f.kept("outbox", f.outbox)
    moved = f.kept("moved", lambda: folds.failovers(box, folds.states(box)))
    none = lambda kind: F.lit(None).cast(kind)
    copies = moved.select("outbox_id", "incident_id", "channel", "action", F.col("outbox_id").alias("failover_of"), "failover_from", none("string").alias("delivered_via_fallback"))
    old = box.select("outbox_id", F.col("action").alias("old"))
    tagged = moved.join(old, "outbox_id").select("outbox_id", "incident_id", F.col("failover_from").alias("channel"), F.col("old").alias("action"), none("long").alias("failover_of"), none("string").alias("failover_from"), F.col("channel").alias("delivered_via_fallback"))
    return copies.unionByName(tagged)


@query("failover_targets", "SELECT failover_from, target AS channel, count(*) AS n, min(moved_ms) AS first_ms FROM moved GROUP BY ALL", BREAKER + _MOVED)
def failover_targets(f: Frames) -> DataFrame:
    """Where urgent rows went, by the channel that was down."""
    box = f.kept("outbox", f.outbox)
    return folds.failovers(box, folds.states(box)).groupBy("failover_from", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("moved_ms").alias("first_ms"))


@query("breaker_fold", "SELECT channel, outbox_id, kind, state, failures, step FROM br", BREAKER)
def breaker_fold(f: Frames) -> DataFrame:
    """A channel's breaker after each of its results, from first to last."""
    return folds.breaker(f.outbox()).select("channel", "outbox_id", "kind", "state", "failures", "step")


@query("outage_intervals", "SELECT channel, detected_ms, recovered_ms, probes, queued_at_peak, failed_over FROM outages", BREAKER)
def outage_intervals(f: Frames) -> DataFrame:
    return folds.outages(folds.states(f.outbox()))


@query(
    "recovery_digest",
    """SELECT 'digest:'||channel||':'||detected_ms AS incident_id, channel, 'create' AS action, -1 AS priority, (recovered_ms-detected_ms)//1000 AS duration_s, touched, critical, resolved, queued, collapsed, failed_over FROM (
    SELECT g.channel, detected_ms, recovered_ms,
      (SELECT count(*) FROM incidents i WHERE i.last_ingested_ms BETWEEN detected_ms AND recovered_ms) AS touched,
      (SELECT count(*) FROM incidents i WHERE i.last_ingested_ms BETWEEN detected_ms AND recovered_ms AND severity='critical') AS critical,
      (SELECT count(*) FROM incidents i WHERE i.last_ingested_ms BETWEEN detected_ms AND recovered_ms AND i.status='RESOLVED') AS resolved,
      (SELECT count(*) FROM outbox b WHERE b.created_ms BETWEEN detected_ms AND recovered_ms AND b.status='pending') AS queued,
      (SELECT count(*) FROM outbox b WHERE b.created_ms BETWEEN detected_ms AND recovered_ms AND b.status='superseded') AS collapsed,
      (SELECT count(*) FROM outbox b WHERE b.created_ms BETWEEN detected_ms AND recovered_ms AND b.failover_of IS NOT NULL) AS failed_over
    FROM outages g WHERE recovered_ms IS NOT NULL) WHERE touched>0 OR queued>0""",
    BREAKER,
)
def recovery_digest(f: Frames) -> DataFrame:
    """For each outage that ended, the row that goes out ahead of the backlog and says what the channel missed.

    Incidents and queue rows are counted through time, and an outage takes the counts at its end less those at its start: no
    outage meets rows, however many of either there are.
    """
    ended = folds.outages_by_stretch(folds.states(f.outbox())).filter("recovered_ms IS NOT NULL").select("channel", "stretch", "detected_ms", "recovered_ms")
    ended = f.kept("outages", lambda: ended)
    seen = f.incidents().select(F.col("last_ingested_ms").alias("t"), F.lit(True).alias("touched"), (F.col("severity") == "critical").alias("critical"), (F.col("status") == "RESOLVED").alias("resolved"))
    sent = f.outbox().select(F.col("created_ms").alias("t"), (F.col("status") == "pending").alias("queued"), (F.col("status") == "superseded").alias("collapsed"), F.col("failover_of").isNotNull().alias("failed_over"))
    counts = ["touched", "critical", "resolved", "queued", "collapsed", "failed_over"]
    # by millisecond first: what is counted grows with time, not with the queue
    rows = seen.unionByName(sent, allowMissingColumns=True).groupBy("t").agg(*(F.count_if(c).alias(c) for c in counts))
    ends = ended.select("channel", "stretch", "detected_ms", "recovered_ms", F.explode(F.array(F.struct(F.col("detected_ms").alias("t"), F.lit(-1).alias("turn")), F.struct(F.col("recovered_ms").alias("t"), F.lit(1).alias("turn")))).alias("x")).select("channel", "stretch", "detected_ms", "recovered_ms", "x.*")
    rows = written(rows.withColumn("turn", F.lit(0)).unionByName(ends, allowMissingColumns=True), "moments")
    rows = counted(rows, [], "t", ["t", "turn"], **{c: F.col(c) for c in counts}).filter("turn <> 0")
    inside = rows.groupBy("channel", "stretch", "detected_ms", "recovered_ms").agg(*(F.sum(F.col(c) * F.col("turn")).alias(c) for c in counts))
    key = F.concat_ws(":", F.lit("digest"), "channel", F.col("detected_ms").cast("string"))
    return inside.filter("touched > 0 OR queued > 0").select(key.alias("incident_id"), "channel", F.lit("create").alias("action"), F.lit(-1).alias("priority"), F.expr("(recovered_ms - detected_ms) div 1000").alias("duration_s"), *counts)


# self-check


def channel_signals(folded: DataFrame) -> DataFrame:
    """open_channels (by name) and ongoing_outages: from each channel's latest state of the breaker."""
    last = folded.groupBy("channel").agg(F.max_by("state", F.struct("at_ms", "outbox_id")).alias("state"))
    names = F.array_sort(F.collect_list(F.when(F.col("state") == "OPEN", F.col("channel"))))
    return last.agg(F.array_join(names, ",").alias("open_channels"), F.count_if(F.col("state") != "CLOSED").alias("ongoing_outages"))


def verdict(outbox: DataFrame, alerts: DataFrame, now_ms: int = NOW, workers: dict[str, bool] | None = None, database: bool = True) -> DataFrame:
    """verdict, reasons, observations, should_heartbeat. What cannot deliver is unhealthy, what delivers with a fault is
    degraded; observations never change the verdict. workers: which background workers are alive."""
    box = outbox.agg(F.count_if(F.col("status") == "dead").alias("dead"), F.count_if(F.col("status") == "pending").alias("pending"), ((F.lit(now_ms) - F.min(F.when(F.col("status") == "pending", F.col("created_ms")))) / 1000).alias("oldest_s"))
    heard = alerts.agg(F.max(F.abs(F.col("fired_ms") - F.col("ingested_ms"))).alias("skew"), ((F.lit(now_ms) - F.max("ingested_ms")) / 1000).alias("quiet_s"))
    s = box.join(F.broadcast(heard)).join(F.broadcast(channel_signals(folds.states(outbox))))  # a row each
    dead = ",".join(sorted(name for name, alive in (workers or {}).items() if not alive))
    fatal = F.array_compact(F.array(F.when(F.lit(not database), "database"), F.when(F.lit(dead != ""), F.lit(f"workers:{dead}")), F.when(F.col("oldest_s") > 900, "stalled")))
    degraded = F.array_compact(F.array(F.when(F.col("open_channels") != "", "channel-open"), F.when(F.col("dead") > 10, "dead-letters"), F.when(F.col("skew") > 120000, "clock-skew")))
    seen = F.array_compact(F.array(F.when(F.col("quiet_s") > 1800, "quiet-ingest"), F.when(F.col("ongoing_outages") > 0, F.concat(F.lit("outages:"), F.col("ongoing_outages").cast("string"))), F.when(F.col("pending") > 0, F.concat(F.lit("queued:"), F.col("pending").cast("string")))))
    found = F.when(F.size(fatal) > 0, "unhealthy").when(F.size(degraded) > 0, "degraded").otherwise("ok")
    return s.select(found.alias("verdict"), F.array_join(F.concat(fatal, degraded), ",").alias("reasons"), (F.size(fatal) == 0).alias("should_heartbeat"), F.array_join(seen, ",").alias("observations"))


_LAST = "(SELECT channel, arg_max(state, n) AS state FROM br GROUP BY channel)"


@query("selfcheck_channels", f"SELECT coalesce(string_agg(CASE WHEN state='OPEN' THEN channel END, ',' ORDER BY channel), '') AS open_channels, count(*) FILTER (WHERE state<>'CLOSED') AS ongoing_outages FROM {_LAST}", BREAKER)
def selfcheck_channels(f: Frames) -> DataFrame:
    return channel_signals(folds.states(f.outbox()))


@query(
    "selfcheck_signals",
    f"""SELECT latest_ms, worst_skew_ms, (SELECT count(*) FROM outages WHERE recovered_ms IS NULL) AS open_outages, (SELECT count(*) FROM {REVISIONS} WHERE ranked_revision < observed_revision) AS unranked_scopes
    FROM (SELECT max(ingested_ms) AS latest_ms, max(abs(fired_ms-ingested_ms)) AS worst_skew_ms FROM alerts)""",
    BREAKER,
)
def selfcheck_signals(f: Frames) -> DataFrame:
    """One row: when something was last heard, the worst clock, outages that go on, scopes that wait for a ranking."""
    heard = f.alerts().agg(F.max("ingested_ms").alias("latest_ms"), F.max(F.abs(F.col("fired_ms") - F.col("ingested_ms"))).alias("worst_skew_ms"))
    open_ = folds.outages(folds.states(f.outbox())).agg(F.count_if(F.col("recovered_ms").isNull()).alias("open_outages"))
    waiting = revisions(f.o()).agg(F.count_if(F.col("ranked_revision") < F.col("observed_revision")).alias("unranked_scopes"))
    return heard.join(F.broadcast(open_)).join(F.broadcast(waiting))  # a row each


@query(
    "selfcheck_verdict",
    f"""SELECT CASE WHEN oldest_s>900 THEN 'unhealthy' WHEN open_channels<>'' OR dead>10 OR skew>120000 THEN 'degraded' ELSE 'ok' END AS verdict,
    concat_ws(',', CASE WHEN oldest_s>900 THEN 'stalled' END, CASE WHEN open_channels<>'' THEN 'channel-open' END, CASE WHEN dead>10 THEN 'dead-letters' END, CASE WHEN skew>120000 THEN 'clock-skew' END) AS reasons, NOT oldest_s>900 AS should_heartbeat,
    concat_ws(',', CASE WHEN quiet_s>1800 THEN 'quiet-ingest' END, CASE WHEN ongoing>0 THEN 'outages:'||ongoing END, CASE WHEN pending>0 THEN 'queued:'||pending END) AS observations
    FROM (SELECT count(*) FILTER (WHERE status='dead') AS dead, count(*) FILTER (WHERE status='pending') AS pending, ({NOW}-min(CASE WHEN status='pending' THEN created_ms END))/1000.0 AS oldest_s FROM outbox),
    (SELECT max(abs(fired_ms-ingested_ms)) AS skew, ({NOW}-max(ingested_ms))/1000.0 AS quiet_s FROM alerts),
    (SELECT coalesce(string_agg(CASE WHEN state='OPEN' THEN channel END, ','), '') AS open_channels, count(*) FILTER (WHERE state<>'CLOSED') AS ongoing FROM {_LAST})""",
    BREAKER,
)
def selfcheck_verdict(f: Frames) -> DataFrame:
    return verdict(f.outbox(), f.alerts())


# rendering


@query("email_subjects", "SELECT incident_id, CASE WHEN status='RESOLVED' THEN '[RESOLVED] '||title ELSE '['||upper(severity)||'] '||title END AS subject FROM incidents", INCIDENTS)
def email_subjects(f: Frames) -> DataFrame:
    return f.incidents().select("incident_id", D.email_subject(F.col("title"), F.col("severity"), F.col("status")).alias("subject"))


def storm_members(f: Frames, shown: int = 10) -> DataFrame:
    """component, anchor, member_count, total_alerts, severity, services and the first members' lines, ranked before they are collected."""
    rows = _storms(f).join(f.incidents(), F.col("incident_id") == F.col("node"))
    first = Window.partitionBy("component").orderBy("first_alert_ms", "incident_id")
    line = F.concat("title", F.lit(" ("), F.col("alert_count").cast("string"), F.lit(" alerts, "), "status", F.lit(")"))
    ranked = rows.withColumn("rk", F.row_number().over(first)).withColumn("line", F.when(F.col("rk") <= shown, F.struct("rk", line.alias("text"))))
    return ranked.groupBy("component").agg(
        F.max(F.when(F.col("rk") == 1, F.col("incident_id"))).alias("anchor"),
        F.count(F.lit(1)).alias("member_count"),
        F.sum("alert_count").alias("total_alerts"),
        F.min_by("severity", C.pick(F.col("severity"), C.PRIORITIES, 9)).alias("severity"),
        F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]).alias("lines"),
    )


MEMBERS = """,
mem AS (SELECT component, incident_id, alert_count, severity, title||' ('||alert_count||' alerts, '||status||')' AS line, row_number() OVER (PARTITION BY component ORDER BY first_alert_ms, incident_id) AS rk FROM comp JOIN incidents ON incident_id=node),
storm AS (SELECT component, arg_min(incident_id, rk) AS anchor, count(*) AS member_count, CAST(sum(alert_count) AS BIGINT) AS total_alerts,
  arg_min(severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS severity, list(line ORDER BY rk) FILTER (WHERE rk<=10) AS lines FROM mem GROUP BY component)"""


_BOXED = _STORM + MEMBERS + OUTBOX.removeprefix(INCIDENTS)


@query("storm_card", "SELECT component, anchor, member_count, total_alerts, severity, array_to_string(lines[1:8], chr(10))||CASE WHEN member_count>8 THEN chr(10)||'and '||(member_count-8)||' more' ELSE '' END AS shown FROM storm", _STORM + MEMBERS)
def storm_card(f: Frames) -> DataFrame:
    """Each storm's card: its anchor, and eight members at most, with how many more there are."""
    more = F.when(F.col("member_count") > 8, F.concat(F.lit("\nand "), (F.col("member_count") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return storm_members(f).select("component", "anchor", "member_count", "total_alerts", "severity", F.concat(F.array_join(F.slice("lines", 1, 8), "\n"), more).alias("shown"))


@query(
    "email_bodies",
    """SELECT incident_id, title||chr(10)||chr(10)||summary||chr(10)||chr(10)||'Severity:    '||i.severity||chr(10)||'State:       '||status||chr(10)||'Alerts:      '||alert_count||chr(10)||'Incident:    '||incident_id
    ||CASE WHEN member_count IS NULL THEN '' ELSE chr(10)||chr(10)||'Correlated storm: '||member_count||' incidents, '||total_alerts||' alerts total'||chr(10)||array_to_string(list_transform(lines, lambda x: '  - '||x), chr(10)) END
    ||CASE WHEN route='slack' AND i.severity='high' THEN chr(10)||chr(10)||'NOTE: sent by email because slack was unreachable. This is not a separate incident.' ELSE '' END AS body
    FROM incidents i LEFT JOIN storm s ON s.anchor=incident_id""",
    _STORM + MEMBERS,
)
def email_bodies(f: Frames) -> DataFrame:
    """Every incident's message; a storm's anchor tells of the storm, and urgent chat traffic of the outage that sent it here."""
    storms = storm_members(f).select(F.col("anchor").alias("incident_id"), "member_count", "total_alerts", "lines")
    rows = f.incidents().join(storms, "incident_id", "left")
    none = F.lit(None).cast("string")
    row = {c: F.col(c) for c in ("title", "summary", "severity", "alert_count", "incident_id")} | {"state": F.col("status"), "hint": none}
    failover = F.when((F.col("route") == "slack") & (F.col("severity") == "high"), "slack")
    return rows.select("incident_id", D.email_body(row, F.col("lines"), F.col("member_count"), F.col("total_alerts"), failover, F.lit(False)).alias("body"))


@query(
    "pager_events",
    """SELECT outbox_id, CASE WHEN failover_of IS NOT NULL THEN '[slack unreachable] '||title ELSE title END AS summary, service AS source,
    CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END AS severity, last_alert_ms AS timestamp_ms, alert_count, i.status AS state
    FROM outbox b JOIN incidents i USING (incident_id) WHERE channel='pagerduty' AND b.status='pending'""",
    OUTBOX,
)
def pager_events(f: Frames) -> DataFrame:
    """The pager's pending events, rendered from the incidents as they are now."""
    rows = f.outbox().filter("channel = 'pagerduty' AND status = 'pending'").select("outbox_id", "incident_id", "failover_of")
    live = rows.join(f.incidents().withColumnRenamed("status", "state"), "incident_id")
    summary = D.pager_summary(F.col("title"), F.when(F.col("failover_of").isNotNull(), "slack"))
    return live.select("outbox_id", summary.alias("summary"), F.col("service").alias("source"), D.pager_severity(F.col("severity")).alias("severity"), F.col("last_alert_ms").alias("timestamp_ms"), "alert_count", "state")


@query(
    "hydrate_payloads",
    f"""SELECT outbox_id, CASE WHEN member_count>1 THEN r.title ELSE i.title END AS title, summary, CASE WHEN member_count>1 THEN s.severity ELSE i.severity END AS severity, i.status AS state,
    CASE WHEN member_count>1 THEN total_alerts ELSE alert_count END AS alert_count, CASE WHEN member_count>1 THEN member_count END AS members
    FROM outbox b LEFT JOIN incidents i USING (incident_id) LEFT JOIN storm s ON s.anchor=b.incident_id LEFT JOIN ({ROOTS}) r ON r.component=s.component WHERE b.status='pending'""",
    _BOXED,
)
def hydrate_payloads(f: Frames) -> DataFrame:
    """Pending rows filled from the incident as it is now; an anchor's card is its storm's, titled by the storm's root."""
    titles = group_root(f).select("component", F.col("title").alias("storm_title"))
    storms = storm_members(f).filter("member_count > 1").join(titles, "component", "left").select(F.col("anchor").alias("incident_id"), "member_count", "total_alerts", F.col("severity").alias("worst"), "storm_title")
    live = f.incidents().select("incident_id", "title", "summary", "severity", F.col("status").alias("state"), "alert_count")
    rows = f.outbox().filter("status = 'pending'").select("outbox_id", "incident_id").join(live, "incident_id", "left").join(storms, "incident_id", "left")
    return rows.select("outbox_id", F.coalesce("storm_title", "title").alias("title"), "summary", F.coalesce("worst", "severity").alias("severity"), "state", F.coalesce("total_alerts", "alert_count").alias("alert_count"), F.col("member_count").alias("members"))


@query(
    "redirect_deliveries",
    """SELECT outbox_id, anchor AS incident_id, 'update' AS action, NULL AS merged_into FROM outbox b JOIN member m ON m.incident_id=b.incident_id WHERE status='pending'
    UNION ALL SELECT NULL, m.incident_id, 'update', anchor FROM member m WHERE EXISTS (SELECT 1 FROM outbox b WHERE b.incident_id=m.incident_id AND channel='slack' AND status='sent' AND external_ref IS NOT NULL)""",
    _BOXED + ",\nmember AS (SELECT mem.incident_id, anchor FROM mem JOIN storm USING (component) WHERE member_count>1 AND mem.incident_id<>anchor)",
)
def redirect_deliveries(f: Frames) -> DataFrame:
    """Pending rows of a storm's members, pointed at its anchor; and a last edit of each member's card that was posted before."""
    storms = _storms(f).join(storm_members(f).filter("member_count > 1").select("component", "anchor"), "component").filter("node <> anchor").select(F.col("node").alias("incident_id"), "anchor")
    members = f.kept("members", lambda: storms)
    box = f.outbox()
    moved = box.filter("status = 'pending'").select("outbox_id", "incident_id").join(members, "incident_id").select("outbox_id", F.col("anchor").alias("incident_id"), F.lit("update").alias("action"), F.lit(None).cast("string").alias("merged_into"))
    posted = box.filter("channel = 'slack' AND status = 'sent' AND external_ref IS NOT NULL").select("incident_id")
    edits = members.join(posted, "incident_id", "left_semi").select(F.lit(None).cast("long").alias("outbox_id"), "incident_id", F.lit("update").alias("action"), F.col("anchor").alias("merged_into"))
    return moved.unionByName(edits)


# ledger and stream


@query("ledger_seq", "SELECT event_id, seq AS ledger_seq, row_number() OVER (PARTITION BY inc ORDER BY seq) AS seq FROM o", ALERTS)
def ledger_seq(f: Frames) -> DataFrame:
    return folds.ledger(f.o()).select("event_id", "ledger_seq", "seq")


_CHAIN = (
    ALERTS.replace("ev AS", "RECURSIVE ev AS", 1)
    + """,
led AS (SELECT inc, event_id, row_number() OVER (PARTITION BY inc ORDER BY seq) AS n, status||'|'||message||'|'||fired_ms AS p FROM o),
chain(inc, n, event_id, prev, h) AS (SELECT inc, n, event_id, repeat('0',64), sha256(repeat('0',64)||p) FROM led WHERE n=1 UNION ALL SELECT l.inc, l.n, l.event_id, c.h, sha256(c.h||l.p) FROM chain c JOIN led l ON l.inc=c.inc AND l.n=c.n+1)"""
)


@query("hash_chain", "SELECT event_id, h AS row_hash FROM chain", _CHAIN)
def hash_chain(f: Frames) -> DataFrame:
    return folds.hash_chain(f.o()).select("event_id", "row_hash")


_SEGMENTS = (
    ALERTS
    + f""",
led AS (SELECT event_id, row_number() OVER (ORDER BY ingested_ms, event_id) AS n, status||'|'||message||'|'||fired_ms AS p FROM o),
low AS (SELECT (n-1)//{ledger.SEGMENT}*{ledger.SEGMENT}+1 AS segment, count(*) AS n, list_reduce(list_prepend(repeat('0',64), list(p ORDER BY n)), lambda h, x: sha256(h||x)) AS head FROM led GROUP BY 1),
top AS (SELECT 1 AS segment, count(*) AS n, list_reduce(list_prepend(repeat('0',64), list(head||':'||n ORDER BY segment)), lambda h, x: sha256(h||x)) AS head FROM low HAVING count(*)>1)"""
)


@query("ledger_seals", "SELECT 0 AS level, segment, n, head FROM low UNION ALL SELECT 1, segment, n, head FROM top", _SEGMENTS)
def ledger_seals(f: Frames) -> DataFrame:
    """Heads of the segments of one ledger over all alerts, and of the chain of those heads."""
    return ledger.sealed(ledger.segmented(f.o()))


@query(
    "ledger_check",
    f"""SELECT 0 AS level, (n-1)//{ledger.SEGMENT}*{ledger.SEGMENT}+1 AS segment, min(n) AS first_bad, CASE WHEN min(n)=min(CASE WHEN event_id%1501=7 THEN n END) THEN 'lost' ELSE 'changed' END AS kind
    FROM led WHERE event_id%997=5 OR event_id%1501=7 GROUP BY 2""",
    _SEGMENTS,
)
def ledger_check(f: Frames) -> DataFrame:
    """Where a ledger that lost some rows and had others changed departs from its seals first, in each segment."""
    chain = written(ledger.segmented(f.o()), "ledger")
    return ledger.verified(folds.tampered(chain).filter("event_id % 1501 <> 7"), ledger.sealed(chain))


@query("verify_chain", "SELECT inc, min(n) AS first_bad FROM chain JOIN led USING (inc, n) WHERE sha256(prev||CASE WHEN led.event_id%997=5 THEN p||'!' ELSE p END)<>h GROUP BY inc", _CHAIN)
def verify_chain(f: Frames) -> DataFrame:
    """The first row of each chain whose hash is not that of what it now holds."""
    return folds.verify_chain(folds.tampered(folds.hash_chain(f.o())))


AFTER = 12


@query(
    "stream_deltas",
    f"""SELECT l.seq*10+i AS stream_id, incident_id, ['incident.upsert','graph.edge.upsert','card.update','metrics.update'][CAST(i AS INT)] AS kind,
    CASE i WHEN 1 THEN title||'|'||incidents.status||'|'||alert_count WHEN 2 THEN CAST(coalesce(n_edges,0) AS VARCHAR) WHEN 3 THEN CAST(l.event_id AS VARCHAR) ELSE alert_count||'|'||incidents.status END AS payload
    FROM o l JOIN incidents ON incident_id=l.inc LEFT JOIN (SELECT e AS inc, count(*) AS n_edges FROM (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges) GROUP BY e) d ON d.inc=l.inc,
    (SELECT unnest([1,2,3,4]) AS i) WHERE l.seq*10+i>{AFTER}""",
    EDGES,
)
def stream_deltas(f: Frames) -> DataFrame:
    """Everything after a cursor of the stream: four deltas of each ledger row, by the state that its incident has now."""
    return deltas(folds.ledger(f.o()), f.incidents(), f.edges(), AFTER)


def deltas(ledger: DataFrame, incidents: DataFrame, edges: DataFrame, after: int) -> DataFrame:
    """stream_id, incident_id, kind, payload of the deltas with ids over after (ids are ledger_seq * 10 + 1..4)."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("inc")).groupBy("inc").agg(F.count(F.lit(1)).alias("n_edges"))
    now = incidents.select(F.col("incident_id").alias("inc"), "title", "status", "alert_count").join(degree, "inc", "left")
    # a cursor at the end of a row asks for later rows, any other for the rest of its own too
    rows = ledger.filter(F.col("ledger_seq") > after // 10 if after % 10 == 0 else F.col("ledger_seq") >= after // 10).join(now, "inc")
    text = lambda c: F.col(c).cast("string")
    four = F.array(
        F.struct(F.lit(1).alias("i"), F.lit("incident.upsert").alias("kind"), F.concat_ws("|", "title", "status", text("alert_count")).alias("payload")),
        F.struct(F.lit(2).alias("i"), F.lit("graph.edge.upsert").alias("kind"), F.coalesce(text("n_edges"), F.lit("0")).alias("payload")),
        F.struct(F.lit(3).alias("i"), F.lit("card.update").alias("kind"), text("event_id").alias("payload")),
        F.struct(F.lit(4).alias("i"), F.lit("metrics.update").alias("kind"), F.concat_ws("|", text("alert_count"), F.col("status")).alias("payload")),
    )
    each = rows.select(F.col("inc").alias("incident_id"), "ledger_seq", F.explode(four).alias("x")).withColumn("stream_id", F.col("ledger_seq") * 10 + F.col("x.i"))
    return each.filter(F.col("stream_id") > after).select("stream_id", "incident_id", "x.kind", "x.payload")


def delta_page(ledger: DataFrame, incidents: DataFrame, edges: DataFrame, after: int, rows: int = 100) -> DataFrame:
    """One page of a reader: the deltas of the first rows of the ledger after the cursor, in order."""
    if after < 0:
        raise ValueError("the cursor must not be negative")
    ahead = F.col("ledger_seq") > after // 10 if after % 10 == 0 else F.col("ledger_seq") >= after // 10
    return deltas(ledger.filter(ahead).orderBy("ledger_seq").limit(rows), incidents, edges, after).orderBy("stream_id")


# folds


@query("incident_lifecycle", "SELECT incident_id, status AS state, alert_count, reopen_count FROM incidents", INCIDENTS)
def incident_lifecycle(f: Frames) -> DataFrame:
    last = folds.lifecycle(f.o()).groupBy("incident_id")
    return last.agg(F.max_by("state", "alert_count").alias("state"), F.max("alert_count").alias("alert_count"), F.max("reopen_count").alias("reopen_count"))


_FLAPS = (
    ALERTS.replace("ev AS", "RECURSIVE ev AS", 1)
    + """,
al AS (SELECT inc, event_id, status, ingested_ms AS t, row_number() OVER (PARTITION BY inc ORDER BY seq) AS n, lag(status) OVER (PARTITION BY inc ORDER BY seq)='resolved' AND status<>'resolved' AS re FROM o),
fp AS (SELECT *, sum(CASE WHEN re THEN 1 ELSE 0 END) OVER (PARTITION BY inc ORDER BY n) AS reopens FROM al),
cards(inc, n, last, tell) AS (SELECT inc, n, CAST(0 AS BIGINT), true FROM fp WHERE n=1 UNION ALL
  SELECT a.inc, a.n, CASE WHEN a.reopens>=3 AND a.t-c.last>=1800000 THEN a.t ELSE c.last END, a.reopens<3 OR a.t-c.last>=1800000 FROM cards c JOIN fp a ON a.inc=c.inc AND a.n=c.n+1)"""
)


@query("flap_notifications", "SELECT inc AS incident_id, count(*) AS cards FROM cards WHERE tell GROUP BY inc", _FLAPS)
def flap_notifications(f: Frames) -> DataFrame:
    return folds.lifecycle(f.o()).filter("notify").groupBy("incident_id").agg(F.count(F.lit(1)).alias("cards"))


@query(
    "event_decisions",
    """SELECT a.event_id, CASE WHEN bypass IS NOT NULL THEN 'critical:'||a.event_id ELSE a.inc END AS incident_id, CASE WHEN bypass IS NOT NULL OR a.status<>'resolved' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS state, coalesce(fp.n,1)>1 AS is_duplicate,
    CASE WHEN bypass IS NOT NULL THEN 'critical:'||a.event_id||':pagerduty,card:'||a.event_id||':create' WHEN fp.n=1 THEN 'card:'||a.event_id||':'||a.inc||':create' WHEN tell THEN 'card:'||a.event_id||':'||a.inc||':update' ELSE '' END AS intents
    FROM alerts a LEFT JOIN fp ON fp.event_id=a.event_id LEFT JOIN cards ON cards.inc=fp.inc AND cards.n=fp.n""",
    _FLAPS,
)
def event_decisions(f: Frames) -> DataFrame:
    """What each arrival decides: a protected emergency opens an incident of its own and pages; any other opens, repeats,
    resolves or reopens its incident, and sends a card unless a flapping incident has had one."""
    event = F.col("event_id").cast("string")
    ordinary = folds.lifecycle(f.o()).withColumn("first", F.col("alert_count") == 1)
    action = F.when(F.col("first"), "create").otherwise("update")
    known = ordinary.select("event_id", "incident_id", "state", (~F.col("first")).alias("is_duplicate"), F.when(F.col("notify"), F.concat_ws(":", F.lit("card"), event, "incident_id", action)).otherwise("").alias("intents"))
    urgent = f.alerts().filter("bypass IS NOT NULL").select("event_id", F.concat_ws(":", F.lit("critical"), event).alias("incident_id"), F.lit("ACKNOWLEDGED").alias("state"), F.lit(False).alias("is_duplicate"), F.concat(F.lit("critical:"), event, F.lit(":pagerduty,card:"), event, F.lit(":create")).alias("intents"))
    return known.unionByName(urgent)


@query(
    "installation_fold",
    """WITH RECURSIVE e AS (SELECT o_custkey AS inst, epoch_us(o_orderdate) AS at_us, ['created','suspend','unsuspend','removed','deleted'][CAST(o_orderkey%5 AS INT)+1] AS action,
      CASE WHEN o_orderkey%5=4 THEN 100 WHEN o_orderkey%5=1 THEN 90 WHEN o_orderkey%7=3 THEN 80 WHEN o_orderkey%5=3 THEN 70 ELSE 10 END AS prio, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    s(inst, n, at_us, prio, revision, action) AS (SELECT inst, n, at_us, prio, CAST(1 AS BIGINT), action FROM e WHERE n=1 UNION ALL
      SELECT e.inst, e.n, CASE WHEN ok THEN e.at_us ELSE x.at_us END, CASE WHEN ok THEN e.prio ELSE x.prio END, x.revision+CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN e.action ELSE x.action END
      FROM s x JOIN e ON e.inst=x.inst AND e.n=x.n+1, LATERAL (SELECT x.action<>'deleted' AND (e.at_us>x.at_us OR (e.at_us=x.at_us AND e.prio>x.prio)) AND NOT (x.action='suspend' AND e.action NOT IN ('unsuspend','deleted')) AS ok))
    SELECT inst, at_us, prio, revision, action FROM (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY n DESC) AS back FROM s) WHERE back=1""",
)
def installation_fold(f: Frames) -> DataFrame:
    return folds.installations(f.table("orders"))


@query(
    "skew_warnings",
    """SELECT source, scope_key, event_id FROM w WHERE tell""",
    ALERTS.replace("ev AS", "RECURSIVE ev AS", 1)
    + """,
big AS (SELECT source, scope_key, event_id, ingested_ms AS t, row_number() OVER (PARTITION BY source, scope_key ORDER BY ingested_ms, event_id) AS n FROM alerts WHERE abs(fired_ms-ingested_ms)>=120000),
w(source, scope_key, event_id, n, last, tell) AS (SELECT source, scope_key, event_id, n, t, true FROM big WHERE n=1 UNION ALL
  SELECT b.source, b.scope_key, b.event_id, b.n, CASE WHEN b.t-w.last>=300000 THEN b.t ELSE w.last END, b.t-w.last>=300000 FROM w JOIN big b ON b.source=w.source AND b.scope_key=w.scope_key AND b.n=w.n+1)""",
)
def skew_warnings(f: Frames) -> DataFrame:
    return folds.skew_warnings(f.alerts())


@query(
    "selection_deltas",
    """WITH RECURSIVE e AS (SELECT o_custkey AS inst, o_orderkey AS nr, epoch_us(o_orderdate) AS at_us, ['created','suspend','unsuspend','removed','deleted'][CAST(o_orderkey%5 AS INT)+1] AS action,
      CASE WHEN o_orderkey%5=4 THEN 100 WHEN o_orderkey%5=1 THEN 90 WHEN o_orderkey%7=3 THEN 80 WHEN o_orderkey%5=3 THEN 70 ELSE 10 END AS prio, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    s(inst, n, nr, at_us, prio, action, mine, ok) AS (SELECT inst, n, nr, at_us, prio, action, action IN ('created','removed'), true FROM e WHERE n=1 UNION ALL
      SELECT e.inst, e.n, e.nr, CASE WHEN good THEN e.at_us ELSE x.at_us END, CASE WHEN good THEN e.prio ELSE x.prio END, CASE WHEN good THEN e.action ELSE x.action END, e.action IN ('created','removed'), good
      FROM s x JOIN e ON e.inst=x.inst AND e.n=x.n+1, LATERAL (SELECT x.action<>'deleted' AND (e.at_us>x.at_us OR (e.at_us=x.at_us AND e.prio>x.prio)) AND NOT (x.action='suspend' AND e.action NOT IN ('unsuspend','deleted')) AS good)),
    d AS (SELECT inst, nr, unnest([nr%40, nr*7%40, nr*3%40]) AS repository, unnest([true,true,false]) AS chosen FROM s WHERE mine AND ok),
    l AS (SELECT inst, repository, chosen FROM d QUALIFY row_number() OVER (PARTITION BY inst, repository ORDER BY nr DESC, chosen)=1),
    k AS (SELECT c_custkey AS inst, unnest([c_custkey%40, (c_custkey+11)%40]) AS repository, c_custkey%2=0 AS selected FROM customer)
    SELECT inst, repository, coalesce(chosen, selected, false) AS selected, inst IN (SELECT inst FROM s WHERE mine AND NOT ok) AS sync_due FROM k FULL JOIN l USING (inst, repository)""",
)
def selection_deltas(f: Frames) -> DataFrame:
    """Repositories selected after all events; an event that creates or removes names up to two to add and one to remove."""
    nr, key = F.col("nr"), F.col("c_custkey")
    mine = F.col("action").isin("created", "removed")
    events = folds.installation_events(f.table("orders")).withColumns({"added": F.when(mine, F.array(nr % 40, nr * 7 % 40)), "removed": F.when(mine, F.array(nr * 3 % 40))})
    known = f.table("customer").select(key.alias("inst"), F.explode(F.array(key % 40, (key + 11) % 40)).alias("repository"), (key % 2 == 0).alias("selected"))
    return folds.selections(known, events)
