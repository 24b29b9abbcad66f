"""Keyed folds: state that depends on its own output. Each has one plain Python step, used in batch and in streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FAILOVER, LIFECYCLE, PRIORITIES
from .counts import counted, latest_before
from .store import written

GENESIS = "0" * 64
FLAP_REOPENS, FLAP_DIGEST_MS = 3, 1_800_000
THRESHOLD, PROBE_BASE, PROBE_MAX = 3, 5, 120
#: Steps after which the wait has reached its maximum: a power of the step itself would grow with the history.
PROBE_STEPS = 5


def ledger(ordinary: DataFrame) -> DataFrame:
    """Alerts in order of arrival: seq within the incident, ledger_seq within the whole ledger; the payload is what the chain covers."""
    seq = F.row_number().over(Window.partitionBy("inc").orderBy("ingested_ms", "event_id")).cast("long")
    payload = F.concat_ws("|", "status", "message", F.col("fired_ms").cast("string"))
    numbered = counted(ordinary, [], "ingested_ms", ["ingested_ms", "event_id"], ledger_seq=F.lit(True))
    return numbered.select("inc", "event_id", "ingested_ms", seq.alias("seq"), "ledger_seq", payload.alias("payload"))


def hash_chain(ordinary: DataFrame) -> DataFrame:
    """inc, event_id, seq, payload, prev_hash, row_hash: each incident's chain starts from the genesis hash.

    A chain is serial; sorted partitions stream by, and one hash is held at a time, however long the chain.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, GENESIS
        for frame in frames:
            before, after = [], []
            for inc, payload in zip(frame["inc"], frame["payload"], strict=True):
                if inc != key:
                    key, last = inc, GENESIS
                before.append(last)
                last = hashlib.sha256((last + payload).encode()).hexdigest()
                after.append(last)
            yield frame.assign(prev_hash=before, row_hash=after)

    rows = ordinary.withColumn("seq", F.row_number().over(Window.partitionBy("inc").orderBy("ingested_ms", "event_id")).cast("long"))
    rows = rows.select("inc", "event_id", "seq", F.concat_ws("|", "status", "message", F.col("fired_ms").cast("string")).alias("payload"))
    return rows.sortWithinPartitions("inc", "seq").mapInPandas(run, "inc string, event_id long, seq long, payload string, prev_hash string, row_hash string")


def tampered(chain: DataFrame) -> DataFrame:
    """The chain with some payloads changed after the fact."""
    return chain.withColumn("payload", F.when(F.col("event_id") % 997 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))


def verify_chain(chain: DataFrame) -> DataFrame:
    """inc, first_bad: the first row whose link or hash is wrong. Rows are checked apart from each other."""
    link = F.coalesce(F.lag("row_hash").over(Window.partitionBy("inc").orderBy("seq")), F.lit(GENESIS))
    checked = chain.withColumn("bad", (F.col("prev_hash") != link) | (F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("row_hash")))
    return checked.filter("bad").groupBy("inc").agg(F.min("seq").alias("first_bad"))


def lifecycle_step(state: dict | None, status: str, now_ms: int) -> dict:
    """An incident's state after one more alert; notify tells whether a card goes out."""
    if state is None:
        return {"state": "RESOLVED" if status == "resolved" else LIFECYCLE["OPEN", "ACKNOWLEDGE"], "alert_count": 1, "reopen_count": 0, "last_flap_ms": 0, "notify": True}
    before = state["state"]
    if status == "resolved":
        after = LIFECYCLE.get((before, "RESOLVE"), before)
    else:
        after = LIFECYCLE.get((before, "REOPEN"), before)
        after = LIFECYCLE.get((after, "ACKNOWLEDGE"), after)
    reopens = state["reopen_count"] + (before == "RESOLVED" and status != "resolved")
    flapping = reopens >= FLAP_REOPENS
    notify = not flapping or now_ms - state["last_flap_ms"] >= FLAP_DIGEST_MS
    return {"state": after, "alert_count": state["alert_count"] + 1, "reopen_count": reopens, "last_flap_ms": now_ms if flapping and notify else state["last_flap_ms"], "notify": notify}


def lifecycle(ordinary: DataFrame) -> DataFrame:
    """incident_id, event_id, state, alert_count, reopen_count, notify after each alert.

    Partitions are sorted and folded as they stream by, so an incident of any length takes constant memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            rows = []
            for inc, event, status, now in zip(frame.inc, frame.event_id, frame.status, frame.ingested_ms, strict=True):
                if inc != key:
                    key, state = inc, None
                state = lifecycle_step(state, status, int(now))
                rows.append((inc, event, state["state"], state["alert_count"], state["reopen_count"], bool(state["notify"])))
            yield pd.DataFrame(rows, columns=["incident_id", "event_id", "state", "alert_count", "reopen_count", "notify"])

    ordered = ordinary.select("inc", "event_id", "status", "ingested_ms").repartition("inc").sortWithinPartitions("inc", "ingested_ms", "event_id")
    return ordered.mapInPandas(run, "incident_id string, event_id long, state string, alert_count long, reopen_count long, notify boolean")


def breaker_step(state: dict, kind: str, at_ms: int, retry_after: float | None = None) -> dict:
    """A channel's breaker after one more result: ok, message_fatal, transient, channel_down, probe_ok or probe_fail."""
    new = dict(state)
    delay = lambda step: 1000 * min(PROBE_BASE * 2 ** min(step, PROBE_STEPS), PROBE_MAX)
    if kind == "ok":
        new |= {"state": "CLOSED", "failures": 0, "step": 0, "opened": None, "probe": None}
    elif kind == "channel_down":
        new["failures"] += 1
        if state["state"] in ("HALF_OPEN", "OPEN"):
            step = state["step"] + 1
            new |= {"state": "OPEN", "step": step, "opened": state["opened"] if state["opened"] is not None else at_ms, "probe": at_ms + delay(step)}
        elif new["failures"] >= THRESHOLD:
            new |= {"state": "OPEN", "step": 0, "opened": at_ms, "probe": at_ms + (int(retry_after * 1000) if retry_after else delay(0))}
    elif kind == "probe_ok" and state["state"] == "OPEN":
        new |= {"state": "HALF_OPEN", "failures": 0, "probe": None}
    elif kind == "probe_fail" and state["state"] == "OPEN":
        step = state["step"] + 1
        new |= {"step": step, "probe": at_ms + delay(step)}
    return new


def results(outbox: DataFrame) -> DataFrame:
    """What the channel answers: kind (ok, message_fatal, transient, channel_down, probe_ok or probe_fail) of each row, with the
    rows pending, the urgent ones among them and the times the channel was down so far, and the stretch: successes before it.
    A success closes the breaker whatever came before."""
    k, http = F.col("k"), F.col("http")
    sent = F.when((http >= 200) & (http < 300), "ok").when(http == 429, "transient").when(http.isin(401, 403) | (http >= 500), "channel_down").otherwise("message_fatal")
    kind = F.when(k % 3 == 0, F.when(k % 2 == 0, "probe_ok").otherwise("probe_fail")).otherwise(sent)
    urgent = (F.col("status") == "pending") & (F.coalesce(F.col("priority") if "priority" in outbox.columns else F.lit(PRIORITIES["medium"]), F.lit(2)) <= 1)
    rows = outbox.select("channel", "outbox_id", F.col("created_ms").alias("at_ms"), kind.alias("kind"), (F.col("status") == "pending").alias("queued"), urgent.alias("urgent"))
    rows = counted(written(rows, "results"), ["channel"], "at_ms", ["at_ms", "outbox_id"], oks=F.col("kind") == "ok", downs=F.col("kind") == "channel_down", queued=F.col("queued"), urgent=F.col("urgent"))
    return rows.select("channel", (F.col("oks") - (F.col("kind") == "ok").cast("long")).alias("stretch"), "outbox_id", "at_ms", "kind", "queued", "urgent", "downs")


def states(outbox: DataFrame) -> DataFrame:
    """channel, stretch, outbox_id, at_ms, kind, queued, urgent, run, state, failures after each result of a channel, in order.

    `breaker_step` needs no replay: with run, how often the channel was down since its last success, it opens at THRESHOLD and
    stays so but for a probe that succeeds, after which it is half open until the channel is down again. So all follows
    from counts up to a row and from what they were at the last success and the last such probe, and no channel's history
    has to pass through one task, however long it has been without a success.
    """
    at = lambda kind: F.when(F.col("kind") == kind, F.col("downs"))
    rows = counted(results(outbox), ["channel"], "at_ms", ["at_ms", "outbox_id"], greatest={"closed": at("ok"), "probed": at("probe_ok")})
    closed = F.coalesce("closed", F.lit(0))
    # a probe before the breaker opened changes nothing
    probed = F.coalesce(F.col("probed") - closed >= THRESHOLD, F.lit(False))
    failures = F.col("downs") - F.when(probed, F.col("probed")).otherwise(closed)
    rows = rows.withColumns({"run": F.col("downs") - closed, "failures": failures.cast("int")})
    state = F.when(F.col("run") < THRESHOLD, "CLOSED").when(F.col("failures") == 0, "HALF_OPEN").otherwise("OPEN")
    return rows.select("channel", "stretch", "outbox_id", "at_ms", "kind", "queued", "urgent", "run", state.alias("state"), "failures")


def breaker(outbox: DataFrame) -> DataFrame:
    """channel, stretch, outbox_id, at_ms, kind, state, failures, step, probe_ms, queued, urgent after each result of a channel, in order."""
    rows = written(states(outbox), "states")
    opened = F.col("run") >= THRESHOLD
    missed = (F.col("kind") == "probe_fail") & (F.col("state") == "OPEN")
    planned = F.when(missed | (opened & (F.col("kind") == "channel_down")), F.col("at_ms"))
    rows = counted(rows, ["channel", "stretch"], "at_ms", ["at_ms", "outbox_id"], greatest={"planned": planned}, missed=missed)
    rows = rows.withColumn("step", F.when(opened, F.col("run") - THRESHOLD + F.col("missed")).otherwise(0).cast("int"))
    delay = 1000 * F.least(F.lit(PROBE_BASE) * F.pow(F.lit(2.0), F.least("step", F.lit(PROBE_STEPS))), F.lit(PROBE_MAX))
    probe = F.when(F.col("state") == "OPEN", F.col("planned") + delay.cast("long"))
    return rows.select("channel", "stretch", "outbox_id", "at_ms", "kind", "state", "failures", "step", probe.alias("probe_ms"), "queued", "urgent")


def outages(folded: DataFrame) -> DataFrame:
    """channel, detected_ms, recovered_ms (null while open), probes, queued_at_peak, failed_over: from the breaker's state changes.

    A stretch ends with the success that closes the breaker, so it holds one outage at most.
    """
    return outages_by_stretch(folded).drop("stretch")


def outages_by_stretch(folded: DataFrame) -> DataFrame:
    """outages() with the stretch of each, as a channel may go down and recover more than once in a millisecond."""
    place = F.struct("at_ms", "outbox_id")
    down = F.col("state") != "CLOSED"
    grouped = folded.groupBy("channel", "stretch").agg(
        F.min(F.when(down, F.struct("at_ms", "outbox_id", "queued", "urgent"))).alias("d"),
        F.max_by("kind", place).alias("last"),
        F.max("at_ms").alias("end_ms"),
        F.count_if(down & (F.col("kind") == "probe_fail")).alias("probes"),
    )
    recovered = F.when(F.col("last") == "ok", F.col("end_ms"))
    return grouped.filter("d IS NOT NULL").select("channel", "stretch", F.col("d.at_ms").alias("detected_ms"), recovered.alias("recovered_ms"), "probes", F.col("d.queued").alias("queued_at_peak"), F.col("d.urgent").alias("failed_over"))


def failovers(outbox: DataFrame, folded: DataFrame) -> DataFrame:
    """outbox_id, incident_id, channel (the first fallback that is up when the row's own channel is found down), action, failover_from, moved_ms.

    Urgent pending rows that are no failover themselves move at the first outage found after they were queued; where no
    fallback is up at that moment they wait.
    """
    waiting = outbox.filter("status = 'pending' AND coalesce(priority, 2) <= 1 AND failover_of IS NULL")
    waiting = waiting.select("outbox_id", "incident_id", "channel", "action", F.col("created_ms").alias("at_ms"))
    folded = written(folded.select("channel", "at_ms", "outbox_id", "state", "stretch", "kind", "queued", "urgent"), "breaker")
    found = outages(folded).select("channel", F.col("detected_ms").alias("at_ms"), F.lit(0).cast("long").alias("outbox_id"))
    # an outage found in the very millisecond counts as later
    met = latest_before(waiting.withColumn("at_ms", F.col("at_ms") - 1), found, ["channel"], "at_ms", "outbox_id", after=True).filter("now IS NOT NULL")
    places = F.create_map(*(x for c, to in FAILOVER.items() for x in (F.lit(c), F.array(*map(F.lit, to)).cast("array<string>"))))
    tried = met.select("outbox_id", "incident_id", F.col("channel").alias("failover_from"), "action", F.col("now.at_ms").alias("at_ms"), F.posexplode(F.element_at(places, F.col("channel"))).alias("place", "channel"))
    up = latest_before(tried, folded.select("channel", "at_ms", "outbox_id", "state"), ["channel"], "at_ms", "outbox_id").filter(F.coalesce(F.col("now.state") != "OPEN", F.lit(True)))
    best = up.groupBy("outbox_id").agg(F.min_by(F.struct("incident_id", "channel", "action", "failover_from", F.col("at_ms").alias("moved_ms")), "place").alias("x"))
    action = F.when(F.col("x.action") == "update", "create").otherwise(F.col("x.action"))
    return best.select("outbox_id", "x.incident_id", "x.channel", action.alias("action"), "x.failover_from", "x.moved_ms")


def installation_step(state: tuple | None, at: int, prio: int, action: str) -> tuple[tuple, bool]:
    """(at, priority, revision, action) of an installation after one more event of its provider, and whether the event took
    effect: newer wins, at equal times the higher priority; deleted is terminal, suspended ends by unsuspend or deleted only."""
    if state is None:
        return (at, prio, 1, action), True
    if state[3] == "deleted" or (at, prio) <= state[:2] or (state[3] == "suspend" and action not in ("unsuspend", "deleted")):
        return state, False
    return (at, prio, state[2] + 1, action), True


def installation_events(orders: DataFrame) -> DataFrame:
    """Provider-ordered events of installations (customers stand for them), nr is their order of delivery."""
    action = F.element_at(F.array(*map(F.lit, ["created", "suspend", "unsuspend", "removed", "deleted"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    # some events open all repositories
    prio = F.when(action == "deleted", 100).when(action == "suspend", 90).when(F.col("o_orderkey") % 7 == 3, 80).when(action == "removed", 70).otherwise(10)
    return orders.select(F.col("o_custkey").alias("inst"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"), prio.alias("prio"), action.alias("action"), F.col("o_orderkey").alias("nr"))


def installation_states(events: DataFrame) -> DataFrame:
    """inst, nr, action, applied and the state (at_us, prio, revision, state) after each event; other columns are left out.

    Sorted partitions stream by with one state at a time, however many events an installation has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            rows = []
            for inst, nr, at, prio, action in zip(frame.inst, frame.nr, frame.at_us, frame.prio, frame.action, strict=True):
                if inst != key:
                    key, state = inst, None
                state, applied = installation_step(state, at, prio, action)
                rows.append((inst, nr, action, applied, *state))
            yield pd.DataFrame(rows, columns=["inst", "nr", "action", "applied", "at_us", "prio", "revision", "state"])

    ordered = events.select("inst", "nr", "at_us", "prio", "action").repartition("inst").sortWithinPartitions("inst", "nr")
    return ordered.mapInPandas(run, "inst long, nr long, action string, applied boolean, at_us long, prio int, revision long, state string")


def installations(orders: DataFrame) -> DataFrame:
    """inst, at_us, prio, revision, action: each installation's state after its last event."""
    last = installation_states(installation_events(orders)).groupBy("inst").agg(F.max_by(F.struct("at_us", "prio", "revision", "state"), "nr").alias("x"))
    return last.select("inst", "x.at_us", "x.prio", "x.revision", F.col("x.state").alias("action"))


def selections(known: DataFrame, events: DataFrame) -> DataFrame:
    """inst, repository, selected, sync_due after events that add and remove repositories (added, removed: arrays or null).

    Only events that took effect, and left their installation active, change the selection; in one event removals come after
    additions. One that came too late is left to a full sync, which its installation is then due for. A repository's last
    change is an aggregate over (installation, repository), so a large installation is many groups and partial ones at that;
    what is stepped through in order carries no repositories. known: inst, repository, selected.
    """
    mine = F.col("action").isin("created", "removed")
    stepped = written(installation_states(events).filter(mine).select("inst", "nr", "applied"), "events")
    lists = events.join(stepped.filter("applied").select("inst", "nr"), ["inst", "nr"])
    sides = [("added", 0, True), ("removed", 1, False)]
    each = [lists.select("inst", F.explode(name).alias("repository"), F.struct("nr", F.lit(turn).alias("turn")).alias("place"), F.lit(chosen).alias("chosen")) for name, turn, chosen in sides]
    last = each[0].unionByName(each[1]).groupBy("inst", "repository").agg(F.max_by("chosen", "place").alias("chosen"))
    rows = known.select("inst", "repository", "selected").join(last, ["inst", "repository"], "full")
    late = stepped.groupBy("inst").agg(F.count_if(~F.col("applied")).alias("late"))
    rows = rows.join(late, "inst", "left")
    return rows.select("inst", "repository", F.coalesce("chosen", "selected", F.lit(False)).alias("selected"), (F.coalesce("late", F.lit(0)) > 0).alias("sync_due"))


def skew_warnings(alerts: DataFrame) -> DataFrame:
    """source, scope_key, event_id of warnings: skew of two minutes or more, and five minutes since the last warning of the pair."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            rows = []
            for source, scope, event, at, skew in zip(frame["source"], frame["scope_key"], frame["event_id"], frame["ingested_ms"], frame["skew"], strict=True):
                if (source, scope) != key:
                    key, last = (source, scope), None
                if abs(skew) >= 120_000 and (last is None or at - last >= 300_000):
                    last = at
                    rows.append((source, scope, event))
            yield pd.DataFrame(rows, columns=["source", "scope_key", "event_id"])

    ordered = alerts.select("source", "scope_key", "event_id", "ingested_ms", (F.col("fired_ms") - F.col("ingested_ms")).alias("skew")).repartition("source", "scope_key").sortWithinPartitions("source", "scope_key", "ingested_ms", "event_id")
    return ordered.mapInPandas(run, "source string, scope_key string, event_id long")
