"""Column functions of the alert model: identity, classification, timing. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names that change between repeats of one alert, in the form the key is normalised to.
VOLATILE_LABELS = ["timestamp", "fired_at", "starts_at", "ends_at", "event_id", "source_event_id", "pod", "pod_name", "pod_uid", "uid", "instance", "container_id", "containerid"]
# Raw severity to severity; anything else is medium.
SEVERITIES = {"critical": "critical", "error": "high", "high": "high", "warning": "medium", "medium": "medium", "info": "low", "low": "low"}
# Severity to delivery priority.
PRIORITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}
# Words of the protected emergencies, tried in this order.
EMERGENCIES = [
    ("PAYMENT_FAILURE", "payment|billing|checkout", "failure|failed|declined|error"),
    ("AUTH_OUTAGE", "auth|authentication|login|identity", "outage|unavailable|failure|failed|down"),
    ("DATA_LOSS", "data|database|storage|backup|replication", "loss|corrupt|deleted|destroyed"),
]
# Lifecycle edges (state, trigger) to state.
LIFECYCLE = {
    ("OPEN", "ACKNOWLEDGE"): "ACKNOWLEDGED",
    ("ACKNOWLEDGED", "QUIET_TIMEOUT"): "QUIESCENT",
    ("ACKNOWLEDGED", "QUIET_DEADLINE"): "QUIESCENT",
    ("OPEN", "RESOLVE"): "RESOLVED",
    ("ACKNOWLEDGED", "RESOLVE"): "RESOLVED",
    ("QUIESCENT", "RESOLVE"): "RESOLVED",
    ("RESOLVED", "REOPEN"): "OPEN",
}
# Fallbacks of a channel that is down, in order.
FAILOVER = {"slack": ["pagerduty", "email"], "pagerduty": ["slack", "email"], "email": []}


def pick(key: Column, table: dict, default: object = None) -> Column:
    """The value of key in a small table."""
    chain = reduce(lambda c, kv: F.when(key == kv[0], F.lit(kv[1])) if c is None else c.when(key == kv[0], F.lit(kv[1])), table.items(), None)
    return chain.otherwise(F.lit(default))


def scope_key(labels: Column) -> Column:
    """environment/cluster; an absent label falls back, an empty one stays."""
    return F.concat_ws("/", F.coalesce(F.try_element_at(labels, F.lit("environment")), F.lit("default")), F.coalesce(F.try_element_at(labels, F.lit("cluster")), F.try_element_at(labels, F.lit("namespace")), F.lit("default")))


def severity(raw: Column) -> Column:
    return pick(F.lower(raw), SEVERITIES, "medium")


def title(service: Column, alertname: Column) -> Column:
    return F.concat(service, F.lit(" — "), alertname)


def alert_text(service: Column, alertname: Column, message: Column, labels: Column) -> Column:
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.lower(F.concat_ws(" ", service, alertname, message, F.array_join(pairs, " ")))


def critical_bypass(severity_raw: Column, labels: Column, text: Column) -> Column:
    """Why an alert skips deduplication, or null; the first rule that holds.

    The text is a lambda's argument, so it is put together once for all rules, in filters too, and the words are plain.
    """
    out = F.when(F.lower(severity_raw) == "critical", "SEVERITY_CRITICAL")
    out = out.when(F.upper(F.coalesce(F.try_element_at(labels, F.lit("priority")), F.lit(""))) == "P0", "PRIORITY_P0")
    has = lambda t, words: reduce(Column.__or__, (t.contains(word) for word in words.split("|")))

    def first(t: Column) -> Column:
        return F.coalesce(*(F.when(has(t, what) & has(t, how), reason) for reason, what, how in EMERGENCIES))

    return out.otherwise(F.transform(F.array(text), first)[0])


def _is_volatile(key: Column) -> Column:
    name = F.replace(F.lower(F.trim(key)), F.lit("-"), F.lit("_"))
    return name.isin(VOLATILE_LABELS) | name.endswith("_timestamp") | name.endswith("_pod_uid")


def stable_labels(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, v: ~_is_volatile(k))


def fingerprint(service: Column, alertname: Column, labels: Column) -> Column:
    """SHA-256 over service, alert name and all labels in order."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.concat_ws("|", service, alertname, F.array_join(pairs, ",")), 256)


def json_string(text: Column) -> Column:
    """text as a JSON string in ASCII, as canonical JSON has it: what is not printable is escaped by its UTF-16 units."""
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(quoted, "UTF-16BE"))), F.lit("(.{4})"), F.lit(1))
    named = {"0008": "\\b", "0009": "\\t", "000a": "\\n", "000c": "\\f", "000d": "\\r"}
    printable = lambda u: F.char(F.conv(u, 16, 10).cast("int"))
    escaped = F.transform(units, lambda u: F.when(u.between("0020", "007e"), printable(u)).otherwise(F.coalesce(pick(u, named), F.concat(F.lit("\\u"), u))))
    return F.concat(F.lit('"'), F.when(text.rlike("[^ -~]"), F.array_join(escaped, "")).otherwise(quoted), F.lit('"'))


def stable_fingerprint(service: Column, alertname: Column, severity_raw: Column, labels: Column) -> Column:
    """SHA-256 over canonical JSON (sorted keys, ASCII) of what stays the same between repeats. What is null is left out."""
    pairs = F.transform(F.array_sort(F.map_entries(stable_labels(labels))), lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"])))
    fields = {"alertname": json_string(alertname), "labels": F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), "service": json_string(service), "severity": json_string(severity_raw)}
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items())), F.lit("}")), 256)


def transition(state: Column, trigger: Column) -> Column:
    """The next lifecycle state, or null where the edge does not exist."""
    return pick(F.concat_ws(">", state, trigger), {f"{s}>{t}": n for (s, t), n in LIFECYCLE.items()})


def decay(value: Column, elapsed_ms: Column, half_life_ms: float = 3_600_000.0) -> Column:
    return value * F.exp(-F.log(F.lit(2.0)) * F.greatest(elapsed_ms, F.lit(0)) / F.lit(half_life_ms))


def lift(weight: Column, rounds: Column, a: Column, b: Column, cap: float = 4.0) -> Column:
    usable = (F.coalesce(rounds, F.lit(0.0)) > 0) & (F.coalesce(a, F.lit(0.0)) > 0) & (F.coalesce(b, F.lit(0.0)) > 0)
    return F.when(usable, F.least(weight * rounds / (a * b), F.lit(cap))).otherwise(F.lit(1.0))


def ewma(gaps: Column) -> Column:
    """struct(m, v) of the gaps folded from the first one on, with alpha = 2 / (n + 1) for the whole array."""
    alpha = F.lit(2.0) / (F.size(gaps) + 1)
    start = F.struct(F.get(gaps, F.lit(0)).cast("double").alias("m"), F.lit(0.0).alias("v"))
    step = lambda s, x: F.struct(((1 - alpha) * s["m"] + alpha * x).alias("m"), ((1 - alpha) * (s["v"] + alpha * F.pow(x - s["m"], F.lit(2.0)))).alias("v"))
    return F.aggregate(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), start, step)


def quiet_deadline(now_ms: Column, mean: Column, variance: Column, has_history: Column, first_ms: Column, cap: float = 300_000.0, initial: float = 5_000.0, span: int = 600_000) -> Column:
    """When an incident counts as quiet: the expected gap and its deviation from now, never beyond the batch span."""
    window = F.when(has_history, F.greatest(F.lit(1), F.ceil(F.least(mean + F.sqrt(variance), F.lit(cap))))).otherwise(F.lit(int(min(initial, cap))))
    at = now_ms + window.cast("long")
    ceiling = first_ms + span
    return F.when((first_ms <= 0) | (at <= ceiling), at).otherwise(F.greatest(ceiling, now_ms + 1))


def silence_threshold(mean: Column, variance: Column, severity_: Column, reopens: Column) -> Column:
    """For how long an incident may be silent before it is taken for resolved, in ms."""
    predicted = F.greatest(mean, F.lit(0.0)) + F.sqrt(F.greatest(variance, F.lit(0.0)))
    base = F.greatest(predicted * 6, F.lit(900_000.0))
    factor = F.when(severity_ == "critical", F.lit(20.0 / 6.0)).otherwise(F.lit(1.0))
    flap = F.pow(F.lit(1.5), F.greatest(F.lit(0), F.least(reopens, F.lit(6))).cast("double"))
    return F.floor(F.least(base * factor * flap, F.lit(21_600_000.0))).cast("long")


def retry_backoff(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempts), F.lit(300.0)).cast("long")


def probe_delay(step: Column) -> Column:
    return F.least(5 * F.pow(F.lit(2.0), step), F.lit(120.0)).cast("long")
