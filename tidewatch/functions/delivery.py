"""What a failed delivery means, and how messages read, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import pick

# Answers of the chat provider that condemn the message, and those that condemn the connection.
MESSAGE_FATAL = ["invalid_blocks", "invalid_blocks_format", "msg_too_long", "no_text", "channel_not_found", "is_archived", "not_in_channel", "message_not_found", "cant_update_message", "edit_window_closed"]
CHANNEL_DOWN = ["token_revoked", "token_expired", "invalid_auth", "not_authed", "account_inactive", "service_unavailable", "fatal_error", "internal_error", "ratelimited"]
# Severity to the pager's, and to an e-mail's prefix.
PAGER_SEVERITY = {"critical": "critical", "high": "error", "medium": "warning", "low": "info"}
MAX_ATTEMPTS = 5


def classify(fault: Column, detail: Column, status: Column, retry_after: Column) -> Column:
    """struct(kind, reason, retry_after) of a failure.

    fault is one of unavailable and rejected (detail: why), rate_limited, transport (detail: the error), http (status) and
    answer (detail: the provider's code); anything else is unknown (detail: its name).
    """
    named = lambda prefix, value: F.concat(F.lit(prefix), value)
    is_ = lambda *names: fault.isin(*names)
    http, answer = is_("http"), is_("answer")
    kind = F.when(is_("unavailable", "transport"), "channel_down").when(is_("rejected"), "message_fatal").when(is_("rate_limited"), "transient")
    kind = kind.when(http & (status == 429), "transient").when(http & (status.isin(401, 403) | status.between(500, 599)), "channel_down").when(http & status.between(400, 499), "message_fatal")
    kind = kind.when(answer & detail.isin(MESSAGE_FATAL), "message_fatal").when(answer & detail.isin(CHANNEL_DOWN), "channel_down").otherwise("transient")
    reason = F.when(is_("unavailable", "rejected"), detail).when(is_("rate_limited"), "rate_limited").when(is_("transport"), named("transport:", detail))
    reason = reason.when(http & status.between(400, 599), named("http:", status.cast("string"))).when(answer, named("slack:", detail)).otherwise(named("unknown:", detail))
    hinted = is_("unavailable", "rate_limited") | (http & ((status == 429) | status.between(500, 599)))
    return F.struct(kind.alias("kind"), reason.alias("reason"), F.when(hinted, retry_after).alias("retry_after"))


def outcome(verdict: Column, attempts: Column, now_ms: Column, probe_ms: Column) -> Column:
    """struct(status, attempts, next_ms, last_error) of a row after a failure.

    A rejected message is dead. One whose channel is down did nothing wrong: it is parked until the next probe, or for a
    second where none is planned, its attempts as they were. Otherwise an attempt is charged, and the provider's hint or the
    backoff says when to try again; the fifth is the last.
    """
    kind, more = verdict["kind"], attempts + 1
    hinted = F.coalesce(verdict["retry_after"], F.lit(0.0)) > 0
    wait = F.when(hinted, verdict["retry_after"] * 1000).otherwise(F.least(F.pow(F.lit(2.0), more), F.lit(300.0)) * 1000).cast("long")
    status = F.when((kind == "message_fatal") | ((kind == "transient") & (more >= MAX_ATTEMPTS)), "dead").otherwise("pending")
    next_ms = F.when(kind == "channel_down", F.coalesce(probe_ms, now_ms + 1000)).when(kind == "transient", now_ms + wait)
    error = F.when(kind == "channel_down", F.concat(F.lit("channel_down:"), verdict["reason"])).otherwise(verdict["reason"])
    return F.struct(status.alias("status"), F.when(kind == "transient", more).otherwise(attempts).cast("int").alias("attempts"), next_ms.alias("next_ms"), F.substring(error, 1, 1000).alias("last_error"))


def email_subject(title: Column, severity: Column, state: Column) -> Column:
    """Resolved incidents say so; the others begin with their severity."""
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("Incident"))
    prefix = F.concat(F.lit("["), F.upper(F.coalesce(severity, F.lit("medium"))), F.lit("] "))
    return F.when(state == "RESOLVED", F.concat(F.lit("[RESOLVED] "), name)).otherwise(F.concat(prefix, name))


def email_body(row: dict[str, Column], members: Column, member_count: Column, total_alerts: Column, failover_from: Column, inferred: Column) -> Column:
    """A message in plain text. members: the storm's lines in order (null for an incident of its own), of which ten are shown."""
    line = lambda label, value: F.concat(F.lit(label), value.cast("string"))
    empty = F.array().cast("array<string>")
    head = F.array(F.coalesce(F.nullif(row["title"], F.lit("")), F.lit("Incident")), F.lit(""), F.coalesce(F.nullif(row["summary"], F.lit("")), F.lit("No summary available.")), F.lit(""))
    facts = F.array(line("Severity:    ", row["severity"]), line("State:       ", row["state"]), line("Alerts:      ", row["alert_count"]), line("Incident:    ", row["incident_id"]))
    cause = F.when(row["hint"].isNotNull(), F.array(F.lit(""), line("Likely root cause: ", row["hint"]))).otherwise(empty)
    storm_line = F.concat(F.lit("Correlated storm: "), member_count.cast("string"), F.lit(" incidents, "), total_alerts.cast("string"), F.lit(" alerts total"))
    storm = F.when(members.isNotNull(), F.concat(F.array(F.lit(""), storm_line), F.transform(F.slice(members, 1, 10), lambda m: F.concat(F.lit("  - "), m)))).otherwise(empty)
    moved = F.when(failover_from.isNotNull(), F.array(F.lit(""), F.concat(F.lit("NOTE: sent by email because "), failover_from, F.lit(" was unreachable. This is not a separate incident.")))).otherwise(empty)
    presumed = F.when(inferred, F.array(F.lit(""), F.lit("NOTE: presumed resolved because alerts stopped arriving. Not confirmed by a human."))).otherwise(empty)
    return F.array_join(F.concat(head, facts, cause, storm, moved, presumed), "\n")


def pager_summary(title: Column, failover_from: Column) -> Column:
    return F.when(failover_from.isNotNull(), F.concat(F.lit("["), failover_from, F.lit(" unreachable] "), title)).otherwise(title)


def pager_severity(severity: Column) -> Column:
    return pick(severity, PAGER_SEVERITY, "critical")
