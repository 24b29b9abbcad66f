"""What the dashboard derives from incidents: totals, mixes, lists, filters, silence and hints. One function per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import incidents as I
from ..operators.counts import placed
from .duck import ALERTS, INCIDENTS, RHYTHM
from .registry import Frames, query

PLACE = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
#: Words for lifecycle states in older rows.
ALIASES = {"new": "OPEN", "active": "OPEN", "acknowledged": "ACKNOWLEDGED", "quiet": "QUIESCENT", "resolved": "RESOLVED"}
STATES = ["OPEN", "ACKNOWLEDGED", "QUIESCENT", "RESOLVED"]


@query(
    "noise_totals",
    """SELECT CAST(sum(alert_count) AS BIGINT) AS alerts_in, count(*) AS surfaced, count(*) FILTER (WHERE route='pagerduty') AS paged,
    count(*) FILTER (WHERE route='suppressed') AS silenced, round((sum(alert_count)-count(*))/sum(alert_count)*100,4) AS reduction,
    count(*) FILTER (WHERE mean_gap>0) AS firing FROM incidents""",
    INCIDENTS,
)
def noise_totals(f: Frames) -> DataFrame:
    total, surfaced = F.sum("alert_count"), F.count(F.lit(1))
    return f.incidents().agg(
        total.alias("alerts_in"),
        surfaced.alias("surfaced"),
        F.count_if(F.col("route") == "pagerduty").alias("paged"),
        F.count_if(F.col("route") == "suppressed").alias("silenced"),
        F.round((total - surfaced) / total * 100, 4).alias("reduction"),
        F.count_if(F.col("mean_gap") > 0).alias("firing"),
    )


@query("routing_mix", "SELECT route, count(*) AS count, CAST(sum(alert_count) AS BIGINT) AS alerts FROM incidents GROUP BY route", INCIDENTS)
def routing_mix(f: Frames) -> DataFrame:
    return f.incidents().groupBy("route").agg(F.count(F.lit(1)).alias("count"), F.sum("alert_count").alias("alerts"))


@query(
    "clock_skew_worst",
    """SELECT * FROM (SELECT source, scope_key, arg_max(CAST(fired_ms-ingested_ms AS BIGINT), {'t': ingested_ms, 'e': event_id}) AS last_skew_ms,
    max(abs(CAST(fired_ms-ingested_ms AS BIGINT))) AS max_abs_skew_ms, count(*) AS samples FROM alerts GROUP BY ALL)
    ORDER BY abs(last_skew_ms) DESC, source, scope_key LIMIT 10""",
    ALERTS,
)
def clock_skew_worst(f: Frames) -> DataFrame:
    """The ten sources that are furthest out now."""
    skew = F.col("fired_ms") - F.col("ingested_ms")
    each = f.alerts().groupBy("source", "scope_key").agg(F.max_by(skew, F.struct(*I.ARRIVAL)).alias("last_skew_ms"), F.max(F.abs(skew)).alias("max_abs_skew_ms"), F.count(F.lit(1)).alias("samples"))
    return each.orderBy(F.desc(F.abs("last_skew_ms")), "source", "scope_key").limit(10)


@query(
    "quiet_window",
    """SELECT max(quiet_at_ms) AS until_ms, CAST(sum(CASE WHEN status<>'RESOLVED' THEN greatest(0,alert_count-1) END) AS BIGINT) AS absorbed,
    round(avg(CASE WHEN status<>'RESOLVED' AND mean_gap>0 THEN mean_gap END),3) AS mean_gap, count(*) FILTER (WHERE status<>'RESOLVED' AND mean_gap>0) AS tracking
    FROM incidents HAVING max(quiet_at_ms) > 0""",
    INCIDENTS,
)
def quiet_window(f: Frames) -> DataFrame:
    """One row, or none where no incident carries a deadline."""
    active, paced = F.col("status") != "RESOLVED", (F.col("status") != "RESOLVED") & (F.col("mean_gap") > 0)
    return (
        f.incidents()
        .agg(
            F.max("quiet_at_ms").alias("until_ms"),
            F.sum(F.when(active, F.greatest(F.lit(0), F.col("alert_count") - 1))).alias("absorbed"),
            F.round(F.avg(F.when(paced, F.col("mean_gap"))), 3).alias("mean_gap"),
            F.count_if(paced).alias("tracking"),
        )
        .filter("until_ms > 0")
    )


@query("incident_latest_event", "SELECT i.incident_id, i.status, l.event_id, l.message FROM incidents i LEFT JOIN (SELECT inc, arg_max(event_id, seq) AS event_id, arg_max(message, seq) AS message FROM o GROUP BY inc) l ON l.inc=i.incident_id", INCIDENTS)
def incident_latest_event(f: Frames) -> DataFrame:
    latest = f.o().groupBy(F.col("inc").alias("incident_id")).agg(F.max_by(F.struct("event_id", "message"), F.struct(*I.ARRIVAL)).alias("x"))
    return f.incidents().select("incident_id", "status").join(latest, "incident_id", "left").select("incident_id", "status", "x.event_id", "x.message")


RECENT = 1704108000000


@query("incidents_recent", f"SELECT incident_id, last_ingested_ms, row_number() OVER (ORDER BY last_ingested_ms DESC, incident_id) AS place FROM incidents WHERE last_ingested_ms > {RECENT}", INCIDENTS)
def incidents_recent(f: Frames) -> DataFrame:
    """Incidents touched since a poll's cursor, newest first."""
    return placed(f.incidents().filter(F.col("last_ingested_ms") > RECENT).select("incident_id", "last_ingested_ms"), [F.desc("last_ingested_ms"), F.asc("incident_id")], "place")


@query(
    "incidents_by_urgency",
    f"""SELECT incident_id, row_number() OVER (ORDER BY {PLACE}, last_ingested_ms DESC, incident_id) AS urgency,
    row_number() OVER (ORDER BY last_ingested_ms DESC, {PLACE}, incident_id) AS recent,
    row_number() OVER (ORDER BY alert_count DESC, {PLACE}, last_ingested_ms DESC, incident_id) AS volume FROM incidents""",
    INCIDENTS,
)
def incidents_by_urgency(f: Frames) -> DataFrame:
    """The place of each incident in the table's three orders."""
    rank, newest, last = F.asc("rank"), F.desc("last_ingested_ms"), F.asc("incident_id")
    out = f.incidents().select("incident_id", C.pick(F.col("severity"), C.PRIORITIES, 3).alias("rank"), "last_ingested_ms", "alert_count")
    for name, order in {"urgency": [rank, newest], "recent": [newest, rank], "volume": [F.desc("alert_count"), rank, newest]}.items():
        out = placed(out, [*order, last], name)
    return out.select("incident_id", "urgency", "recent", "volume")


def matches(incidents: DataFrame, tab: list[str], severities: list[str], text: str) -> DataFrame:
    """Incidents of a lifecycle tab and severities whose title, summary or hint holds the text, whatever its case."""
    needle = text.strip().lower()
    shown = F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), F.coalesce("hint", F.lit(""))))
    return incidents.filter(F.col("status").isin(tab) & F.col("severity").isin(severities) & (F.lit(needle == "") | F.contains(shown, F.lit(needle))))


@query("incident_search", "SELECT incident_id FROM incidents WHERE status IN ('OPEN','ACKNOWLEDGED','QUIESCENT') AND severity IN ('high','medium') AND (contains(lower(title), 'view degr') OR contains(lower(summary), 'view degr'))", INCIDENTS)
def incident_search(f: Frames) -> DataFrame:
    rows = f.incidents().withColumn("hint", F.lit(None).cast("string"))
    return matches(rows, STATES[:3], ["high", "medium"], "  View DEGR ").select("incident_id")


def lifecycle_of(value: Column) -> Column:
    """A state as the dashboard knows it: by itself, by an alias, by its capitals, or OPEN."""
    known = C.pick(value, {s: s for s in STATES} | ALIASES)
    return F.coalesce(known, C.pick(F.upper(value), {s: s for s in STATES}), F.lit("OPEN"))


def normalized(raw: DataFrame) -> DataFrame:
    """Rows of the polled shape (snake_case) or the streamed one (camelCase) with the dashboard's names and defaults."""
    has = set(raw.columns)
    first = lambda *names: F.coalesce(*(F.col(n) for n in names if n in has), F.lit(None))
    return raw.select(
        F.coalesce(first("incident_id", "incidentId"), F.lit("")).alias("incident_id"),
        F.coalesce(first("title"), F.lit("untitled incident")).alias("title"),
        first("summary").alias("summary"),
        F.lower(F.coalesce(first("severity"), F.lit("medium"))).alias("severity"),
        lifecycle_of(F.coalesce(F.nullif(first("status", "state"), F.lit("")), F.lit("OPEN"))).alias("status"),
        F.coalesce(first("alert_count", "alertCount").cast("long"), F.lit(1)).alias("alert_count"),
        first("last_alert_at", "lastAlertAt", "updated_at", "updatedAt").alias("last_alert_at"),
    )


_TURN = "[NULL, '', 'new', 'active', 'acknowledged', 'quiet', 'resolved', 'quiescent', 'odd', 'OPEN'][CAST(alert_count%10 AS INT)+1]"


@query(
    "normalize_incident",
    f"""SELECT incident_id, coalesce(CASE WHEN alert_count%3=1 THEN NULL ELSE title END, 'untitled incident') AS title, summary, severity,
    CASE {_TURN} WHEN 'acknowledged' THEN 'ACKNOWLEDGED' WHEN 'quiet' THEN 'QUIESCENT' WHEN 'quiescent' THEN 'QUIESCENT' WHEN 'resolved' THEN 'RESOLVED' ELSE 'OPEN' END AS status,
    CASE WHEN alert_count%4=0 THEN 1 ELSE alert_count END AS alert_count, last_ingested_ms AS last_alert_at FROM incidents""",
    INCIDENTS,
)
def normalize_incident(f: Frames) -> DataFrame:
    """Rows as an older server streams them: camelCase names, states by other words, some fields missing."""
    n = F.col("alert_count")
    words = [None, "", "new", "active", "acknowledged", "quiet", "resolved", "quiescent", "odd", "OPEN"]
    state = F.element_at(F.array(*(F.lit(w).cast("string") for w in words)), (n % 10 + 1).cast("int"))
    raw = f.incidents().select(
        F.col("incident_id").alias("incidentId"), F.when(n % 3 != 1, F.col("title")).alias("title"), "summary", F.upper("severity").alias("severity"), state.alias("state"), F.when(n % 4 != 0, n).alias("alertCount"), F.col("last_ingested_ms").alias("updatedAt")
    )
    return normalized(raw)


@query(
    "audit_labels",
    "SELECT event_id, CASE WHEN bypass IS NOT NULL THEN 'Critical bypass' WHEN row_number() OVER (PARTITION BY inc, bypass IS NULL ORDER BY ingested_ms, event_id) > 1 THEN 'Aggregated' ELSE 'Recorded' END AS label FROM alerts",
    ALERTS,
)
def audit_labels(f: Frames) -> DataFrame:
    """What became of each alert: all after an incident's first are aggregated."""
    place = F.row_number().over(Window.partitionBy("inc", F.col("bypass").isNull()).orderBy(*I.ARRIVAL))
    label = F.when(F.col("bypass").isNotNull(), "Critical bypass").when(place > 1, "Aggregated").otherwise("Recorded")
    return f.alerts().select("event_id", label.alias("label"))


@query(
    "recent_activity",
    """SELECT event_id, CASE WHEN bypass IS NOT NULL THEN 'Critical bypass' WHEN n > 1 THEN 'Aggregated' ELSE 'Recorded' END AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY inc, bypass IS NULL ORDER BY ingested_ms, event_id) AS n FROM alerts) ORDER BY ingested_ms DESC, event_id DESC LIMIT 6""",
    ALERTS,
)
def recent_activity(f: Frames) -> DataFrame:
    """The overview's list of the six latest arrivals."""
    return audit_labels(f).join(f.alerts().select("event_id", "ingested_ms"), "event_id").orderBy(F.desc("ingested_ms"), F.desc("event_id")).limit(6).select("event_id", "label")


_THRESHOLD = f"CAST(floor(least(greatest((greatest(mean_gap,0)+sqrt(greatest(variance,0)))*6, 900000.0)*CASE WHEN severity='critical' THEN 20.0/6.0 ELSE 1.0 END*pow(1.5, CAST(least(reopen_count,6) AS DOUBLE)), 21600000.0)) AS BIGINT)"


def _threshold() -> Column:
    return C.silence_threshold(F.col("mean_gap"), F.col("variance"), F.col("severity"), F.col("reopen_count"))


@query("silence_threshold", f"SELECT incident_id, {_THRESHOLD} AS threshold_ms FROM incidents", INCIDENTS)
def silence_threshold(f: Frames) -> DataFrame:
    return f.incidents().select("incident_id", _threshold().alias("threshold_ms"))


@query(
    "silence_overdue",
    f"""SELECT incident_id, now_ms-last_ingested_ms AS silent_ms, 'silence:'||incident_id||':'||(now_ms//60000) AS idempotency_key, 'inferred_silence' AS reason
    FROM incidents, (SELECT max(ingested_ms)+10800000 AS now_ms FROM o) WHERE status<>'RESOLVED' AND now_ms-last_ingested_ms >= {_THRESHOLD}""",
    INCIDENTS,
)
def silence_overdue(f: Frames) -> DataFrame:
    """Active incidents that a sweep three hours after the newest arrival finds silent for their threshold: resolved by inference, once a minute."""
    now = f.o().agg((F.max("ingested_ms") + 10_800_000).alias("now_ms"))  # one row
    silent = f.incidents().filter("status <> 'RESOLVED'").join(F.broadcast(now)).withColumn("silent_ms", F.col("now_ms") - F.col("last_ingested_ms"))
    key = F.concat_ws(":", F.lit("silence"), "incident_id", F.floor(F.col("now_ms") / 60000).cast("string"))
    return silent.filter(F.col("silent_ms") >= _threshold()).select("incident_id", "silent_ms", key.alias("idempotency_key"), F.lit("inferred_silence").alias("reason"))


_REOPENS = "sum(CASE WHEN prev_status='resolved' AND status<>'resolved' THEN 1 ELSE 0 END) OVER (PARTITION BY inc ORDER BY seq)"
_SILENT = f""",
si AS (SELECT *, CAST(floor(least(greatest((mean_ms+sqrt(variance))*6, 900000.0)*CASE WHEN severity='critical' THEN 20.0/6.0 ELSE 1.0 END*pow(1.5, CAST(least(reopens,6) AS DOUBLE)), 21600000.0)) AS BIGINT) AS threshold_ms
  FROM (SELECT *, {_REOPENS} AS reopens, lead(ingested_ms) OVER (PARTITION BY inc ORDER BY seq) AS next_ms FROM dl))"""


@query(
    "silence_episodes",
    """SELECT inc, event_id, ingested_ms+threshold_ms AS silent_at_ms, threshold_ms, 'silence:'||inc||':'||((ingested_ms+threshold_ms)//60000) AS idempotency_key
    FROM si WHERE status<>'resolved' AND next_ms-ingested_ms >= threshold_ms""",
    RHYTHM + _SILENT,
)
def silence_episodes(f: Frames) -> DataFrame:
    """Where an incident's stream broke off for longer than its own threshold at that point, and came back."""
    return I.silent_resolutions(f.o())


@query(
    "quiet_transitions",
    """SELECT inc, x.e AS event_id, x.q AS quiet_at_ms, 'quiet-deadline:'||inc||':'||x.q AS idempotency_key, 'slack' AS channel FROM (
    SELECT inc, arg_min({'e': event_id, 'q': quiet_at_ms}, seq) AS x FROM (SELECT *, lead(ingested_ms) OVER (PARTITION BY inc ORDER BY seq) AS nx,
    sum(CASE WHEN status<>'resolved' AND (prev_status IS NULL OR prev_status='resolved') THEN 1 ELSE 0 END) OVER (PARTITION BY inc ORDER BY seq) AS stretch FROM dl)
    WHERE quiet_at_ms IS NOT NULL AND (nx IS NULL OR quiet_at_ms<nx) GROUP BY inc, stretch)""",
    RHYTHM,
)
def quiet_transitions(f: Frames) -> DataFrame:
    return I.quiet_transitions(f.o())


@query(
    "recover_deadlines",
    """SELECT incident_id, quiet_at_ms, row_number() OVER (ORDER BY quiet_at_ms, incident_id) AS place FROM incidents, (SELECT min(last_ingested_ms)+(max(last_ingested_ms)-min(last_ingested_ms))//2 AS now_ms FROM incidents)
    WHERE status='ACKNOWLEDGED' AND quiet_at_ms>now_ms""",
    INCIDENTS,
)
def recover_deadlines(f: Frames) -> DataFrame:
    """The deadlines that a restart finds ahead, in the order in which they fall due. Restarted half way through the incidents."""
    low, high = F.min("last_ingested_ms"), F.max("last_ingested_ms")
    now = f.incidents().agg((low + F.expr("(max(last_ingested_ms) - min(last_ingested_ms)) div 2")).alias("now_ms"), high.alias("high"))  # one row
    due = f.incidents().join(F.broadcast(now)).filter("status = 'ACKNOWLEDGED' AND quiet_at_ms > now_ms")
    return placed(due.select("incident_id", "quiet_at_ms"), [F.asc("quiet_at_ms"), F.asc("incident_id")], "place")


SEPARATOR = "[ \t\n\r\x0b\x0c]+[—·][ \t\n\r\x0b\x0c]+"


def title_parts(title: Column) -> tuple[Column, Column]:
    """Service and alert name of a title; a title without a separator is all service and names no alert."""
    parts = F.split(title, SEPARATOR, -1)
    service = F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit("")), title)
    rest = F.nullif(F.trim(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " — ")), F.lit(""))
    return service, rest


@query(
    "title_parts",
    """SELECT incident_id, service AS service_of, CASE WHEN alert_count%3=2 THEN NULL WHEN alert_count%3=1 THEN alertname||' — again' ELSE alertname END AS alertname_of FROM incidents""",
    INCIDENTS,
)
def titles(f: Frames) -> DataFrame:
    n = F.col("alert_count")
    title = F.when(n % 3 == 2, F.col("service")).when(n % 3 == 1, F.concat("service", F.lit("  · "), "alertname", F.lit(" · again"))).otherwise(F.col("title"))
    service, name = title_parts(title)
    return f.incidents().select("incident_id", service.alias("service_of"), name.alias("alertname_of"))


#: The two forms of a hint.
CONFIDENCE, LEGACY = r"\(confidence [0-9]+%\)$", r"^root_cause=([0-9a-fA-F-]{36});[ \t]*outbound_decayed_joint_weight=([0-9.]+)$"


def described(hints: DataFrame, titles_: DataFrame) -> DataFrame:
    """hints (id, hint) with what the dashboard says of them: the named cause, a legacy cause by its id, or the hint itself."""
    hint = F.trim("hint")
    legacy = hint.rlike(LEGACY)
    named = hints.withColumns({"cause_id": F.when(legacy, F.regexp_extract(hint, LEGACY, 1)), "weight": F.when(legacy, F.regexp_extract(hint, LEGACY, 2)).try_cast("double")})
    joined = named.join(titles_.select(F.col("incident_id").alias("cause_id"), "title"), "cause_id", "left")
    strength = F.coalesce(F.concat(F.lit(" (joint weight "), F.format_string("%.1f", "weight"), F.lit(")")), F.lit(""))
    old = F.concat(F.lit("Likely root cause: "), F.coalesce("title", F.lit("an incident no longer in view")), strength)
    said = F.when(hint.isNull() | (hint == ""), None).when(hint.rlike(CONFIDENCE), F.concat(F.lit("Likely root cause: "), hint)).when(legacy, old).otherwise(hint)
    return joined.select("id", said.alias("said"), F.nullif(F.regexp_extract(hint, r"\(confidence ([0-9]+)%\)$", 1), F.lit("")).cast("int").alias("confidence"))


@query(
    "hint_parse",
    """SELECT event_id AS id, CASE event_id%4 WHEN 0 THEN 'Likely root cause: '||alertname||' (confidence '||k||'%)' WHEN 1 THEN 'Likely root cause: '||
    CASE WHEN k<50 THEN 'known '||k ELSE 'an incident no longer in view' END||' (joint weight '||k||'.5)' WHEN 2 THEN alertname||' perhaps' END AS said,
    CASE WHEN event_id%4=0 THEN k END AS confidence FROM alerts""",
    ALERTS,
)
def hint_parse(f: Frames) -> DataFrame:
    """Hints of both forms, unknown ones and blanks; causes with k below 50 are still in view."""
    uuid = lambda k: F.concat(F.lit("00000000-0000-0000-0000-0000000000"), F.lpad(k.cast("string"), 2, "0"))
    k, turn = F.col("k"), F.col("event_id") % 4
    hint = F.when(turn == 0, F.concat(F.lit(" "), "alertname", F.lit(" (confidence "), k.cast("string"), F.lit("%)")))
    hint = hint.when(turn == 1, F.concat(F.lit("root_cause="), uuid(k), F.lit("; outbound_decayed_joint_weight="), k.cast("string"), F.lit(".5"))).when(turn == 2, F.concat("alertname", F.lit(" perhaps"))).otherwise(F.lit("  "))
    known = f.spark.range(50).select(uuid(F.col("id")).alias("incident_id"), F.concat(F.lit("known "), F.col("id").cast("string")).alias("title"))
    return described(f.alerts().select(F.col("event_id").alias("id"), hint.alias("hint")), known)


@query(
    "incident_clock",
    """SELECT incident_id, strftime(make_timestamp(last_alert_ms*1000), '%H:%M:%S') AS clock,
    CASE WHEN mins<60 THEN mins||' min' ELSE regexp_replace(CAST(CAST(floor(mins/60.0*10+0.5)/10 AS DECIMAL(18,1)) AS VARCHAR), '\\.0$', '')||' h' END AS duration
    FROM (SELECT *, greatest(1, CAST(floor((last_alert_ms-first_alert_ms)/60000.0+0.5) AS BIGINT)) AS mins FROM incidents)""",
    INCIDENTS,
)
def incident_clock(f: Frames) -> DataFrame:
    """The clock time of the last alert and how long the incident has gone on, as the drawer shows them."""
    mins = F.greatest(F.lit(1), F.floor((F.col("last_alert_ms") - F.col("first_alert_ms")) / 60000.0 + 0.5).cast("long"))
    hours = F.regexp_replace((F.floor(mins / 60.0 * 10 + 0.5) / 10).cast("decimal(18,1)").cast("string"), r"\.0$", "")
    duration = F.when(mins < 60, F.concat(mins.cast("string"), F.lit(" min"))).otherwise(F.concat(hours, F.lit(" h")))
    return f.incidents().select("incident_id", F.date_format(F.timestamp_millis("last_alert_ms"), "HH:mm:ss").alias("clock"), duration.alias("duration"))


def checked_gaps(gaps: DataFrame) -> DataFrame:
    """gaps with what is wrong with each: a gap must be a finite number and not below 0."""
    g = F.col("gap")
    return gaps.withColumn("error", F.when(g.isNull() | F.isnan(g) | (F.abs(g) == float("inf")), "not finite").when(g < 0, "negative"))


@query(
    "gap_validation",
    """SELECT event_id, CASE event_id%5 WHEN 0 THEN 'not finite' WHEN 1 THEN 'not finite' WHEN 2 THEN 'negative' END AS error FROM alerts""",
    ALERTS,
)
def gap_validation(f: Frames) -> DataFrame:
    turn = F.col("event_id") % 5
    gap = F.when(turn == 0, F.lit(float("nan"))).when(turn == 1, F.lit(float("inf"))).when(turn == 2, F.lit(-1.0)).otherwise(F.col("k").cast("double"))
    return checked_gaps(f.alerts().select("event_id", gap.alias("gap"))).select("event_id", "error")
