"""Identity, classification and timing on hand-computed cases."""

import hashlib
import json

from pyspark.sql import functions as F

from tidewatch.functions import columns as C


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def labels(**kv):
    return F.create_map(*(F.lit(x) for pair in kv.items() for x in pair))


def test_scope_falls_back_but_keeps_empty_labels(spark):
    r = one(spark, a=C.scope_key(labels(environment="prod", cluster="c1")), b=C.scope_key(labels(namespace="n")), c=C.scope_key(labels(environment="", cluster="x")))
    assert (r.a, r.b, r.c) == ("prod/c1", "default/n", "/x")


def test_stable_fingerprint_ignores_volatile_labels(spark):
    fp = lambda m: C.stable_fingerprint(F.lit("s"), F.lit("a"), F.lit("warning"), m)
    r = one(spark, a=fp(labels(cluster="c", pod="p1", **{"Pod-UID": "1"})), b=fp(labels(pod="p2", cluster="c", start_timestamp="9")), c=fp(labels(cluster="d")))
    canonical = json.dumps({"service": "s", "alertname": "a", "severity": "warning", "labels": {"cluster": "c"}}, sort_keys=True, separators=(",", ":"))
    assert r.a == r.b == hashlib.sha256(canonical.encode()).hexdigest() != r.c


def test_bypass_first_rule_wins(spark):
    def reason(severity, text, **kv):
        return C.critical_bypass(F.lit(severity), labels(x="y", **kv), F.lit(text))

    r = one(spark, a=reason("CRITICAL", "payment failed"), b=reason("info", "payment failed", priority="p0"), c=reason("info", "checkout declined"), d=reason("info", "login down"), e=reason("info", "backup corrupt"), f=reason("info", "all well"))
    assert tuple(r) == ("SEVERITY_CRITICAL", "PRIORITY_P0", "PAYMENT_FAILURE", "AUTH_OUTAGE", "DATA_LOSS", None)


def test_lifecycle_edges(spark):
    r = one(spark, a=C.transition(F.lit("RESOLVED"), F.lit("REOPEN")), b=C.transition(F.lit("OPEN"), F.lit("RESOLVE")), c=C.transition(F.lit("RESOLVED"), F.lit("RESOLVE")))
    assert tuple(r) == ("OPEN", "RESOLVED", None)


def test_ewma_and_deadline(spark):
    gaps = F.array(F.lit(100), F.lit(100), F.lit(100))
    fold = C.ewma(gaps)
    r = one(spark, m=fold["m"], v=fold["v"], at=C.quiet_deadline(F.lit(10000), fold["m"], fold["v"], F.lit(True), F.lit(1)), new=C.quiet_deadline(F.lit(10000), F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(10000)), zero=C.quiet_deadline(F.lit(100), F.lit(0.0), F.lit(0.0), F.lit(True), F.lit(1)), late=C.quiet_deadline(F.lit(700000), F.lit(9e5), F.lit(0.0), F.lit(True), F.lit(1)))
    assert (r.m, r.v, r["at"], r.new, r.zero, r.late) == (100.0, 0.0, 10100, 15000, 101, 700001)


def test_decay_halves_and_lift_is_capped(spark):
    r = one(spark, d=F.round(C.decay(F.lit(8.0), F.lit(3_600_000)), 9), cap=C.lift(F.lit(9.0), F.lit(9.0), F.lit(1.0), F.lit(1.0)), none=C.lift(F.lit(9.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    assert tuple(r) == (4.0, 4.0, 1.0)


def test_silence_threshold_and_backoffs(spark):
    r = one(spark, low=C.silence_threshold(F.lit(0.0), F.lit(0.0), F.lit("low"), F.lit(0)), crit=C.silence_threshold(F.lit(0.0), F.lit(0.0), F.lit("critical"), F.lit(0)), flap=C.silence_threshold(F.lit(0.0), F.lit(0.0), F.lit("low"), F.lit(99)), retry=C.retry_backoff(F.lit(9)), probe=C.probe_delay(F.lit(2)))
    assert tuple(r) == (900_000, 3_000_000, 10_251_562, 300, 20)


def test_canonical_json_equals_python_on_every_plane(spark):
    import hashlib
    import json

    texts = ["", "plain", 'say "so" \\ / <b>', "\b\t\n\f\r\x00\x01\x1f\x7f", "caf\u00e9 \u4e2d \u2028 \ue000 \ufffd", "\U0001f600 \U00010000 \U0002a6d6 \U000e0041 \U0010ffff", "e\u0301" * 300]
    texts += ["".join(map(chr, range(k, k + 64))) for k in (0, 0x60, 0x7C0, 0xD7C0, 0xE000, 0xFFC0, 0x1F600)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert {r.k: r.j for r in rows.select("k", C.json_string(F.col("t")).alias("j")).collect()} == {k: json.dumps(t) for k, t in enumerate(texts)}
    labels = {"b\u00e9": "x", "a": "\U0001f600", "\ud7ff": "1", "\U00010000": "2"}
    made = spark.createDataFrame([("s\u00e9", "n", "error", labels)], "s string, a string, v string, l map<string,string>")
    want = json.dumps({"service": "s\u00e9", "alertname": "n", "severity": "error", "labels": labels}, sort_keys=True, separators=(",", ":"))
    assert made.select(C.stable_fingerprint(F.col("s"), F.col("a"), F.col("v"), F.col("l"))).first()[0] == hashlib.sha256(want.encode()).hexdigest()
