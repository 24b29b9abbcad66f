"""Personal data and secrets: candidate spans scored by boosted trees, on DataFrame operations alone.

Fixed patterns with checks give the base spans (e-mail, IP address, card, phone). High-recall generators propose further,
overlapping spans: long runs of key characters, digit groups, e-mail addresses in disguise. Boosted trees over format and
context features score each; a span is taken if its score reaches its kind's threshold and it overlaps no base span.

Trees and thresholds come from marked documents: prose with personal data and look-alikes planted at known places (a fixed
seed and number). The generators run over them, and a candidate is right if it is a planted span exactly. One set fits the
trees, on the driver; another, held out, sets each threshold: the lowest at which the precision has a lower confidence
bound of 0.98. The trees enter the plan as an expression.

What the generators can propose is bounded by their patterns, for every text alike: a secret has 20 key characters or
more, a number 7 to 32 characters, an address in disguise names of up to 64 and up to 9 host parts; the features see the
24 characters before a candidate and nothing after it, and take numbers of 40 digits or more for no card.

Positions come from the pieces between matches: both extraction and splitting run the same matcher. Patterns use
possessive loops and look behind instead of retrying inside a run, so that long runs take linear time and no stack.

Defined results: null and empty texts have no spans; rows repeat as they come; other columns may have any name and stay.
"""

from __future__ import annotations

import base64
import math
import random
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import Tree, as_expression, boost, leaf

#: Kinds in their order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "secret", "number", "address"]
_LOCAL = "[A-Za-z0-9._%+-]"
_NOT_BEFORE = rf"(?:\G|(?<!{_LOCAL}))"
PATTERNS = {
    "email": rf"{_NOT_BEFORE}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
    "number": r"(?<![0-9])[0-9(][0-9 ().-]{5,30}[0-9](?![0-9])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+){1,8}+",
}
#: What a text must have for the pattern to be tried at all.
_HINTS = {"email": "@", "phone": "+", "address": "at"}
_WORDS = {"secret": "token|key|secret|passw|pwd|auth|bearer|credential|apikey", "number": "tel|phone|call|fax|mobil|ssn|iban|account|konto|card|passport", "address": "mail|contact|write"}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_CHUNK = 256
FEATURES = ["length", "digits", "letters", "separators", "distinct", "hex", "luhn", "word", "assigned", "quoted", "paren"]
#: Marked documents of a kind for fitting, and for the threshold.
EXAMPLES, CONTEXT = 900, 24


def _starts(lengths: Column) -> Column:
    """Sums of lengths before each place; in chunks, so that appending stays cheap for very many matches."""
    chunks = F.ceil(F.size(lengths) / _CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK)))

    def running(part: Column, base: Column) -> Column:
        return F.aggregate(part, F.struct(base.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]

    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, n: s + n))
    bases = running(sums, F.lit(0))
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(parts, bases, running))).otherwise(F.array().cast("array<bigint>"))


def _luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.when((n > 1) & (n < 40), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _n_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
    "card": lambda m: _n_digits(m).between(14, 19) & _luhn(m),
    "phone": lambda m: _n_digits(m).between(10, 15),
}


def find_matches(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """docs (with text) and, for each kind, an array of its pattern's matches: b and e (code points), m (the match), before (what precedes it)."""
    out = docs
    for kind in kinds:
        pattern, hint = F.lit(PATTERNS[kind]), _HINTS.get(kind)
        asked = F.col("text").contains(hint) if hint else F.col("text").rlike("[0-9]" if kind != "secret" else PATTERNS["secret"])
        out = out.withColumns({f"m_{kind}": F.when(asked, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))})
        # without a match, there is no need to split
        out = out.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.transform(F.slice(F.split("text", PATTERNS[kind], -1), F.lit(1), F.size(f"m_{kind}")), lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -CONTEXT, CONTEXT).alias("tail")))).otherwise(F.array().cast("array<struct<n:int,tail:string>>")))
        out = out.withColumn(f"l_{kind}", F.zip_with(f"m_{kind}", f"g_{kind}", lambda m, g: F.length(m) + g["n"]))
        out = out.withColumn(f"s_{kind}", _starts(F.col(f"l_{kind}")))
        spans = F.transform(F.arrays_zip(F.col(f"m_{kind}").alias("m"), F.col(f"g_{kind}").alias("g"), F.col(f"s_{kind}").alias("s")), lambda z: F.struct((z["s"] + z["g"]["n"]).alias("b"), (z["s"] + z["g"]["n"] + F.length(z["m"])).alias("e"), z["m"].alias("m"), z["g"]["tail"].alias("before")))
        out = out.withColumn(f"found_{kind}", spans).drop(f"m_{kind}", f"g_{kind}", f"l_{kind}", f"s_{kind}")
    return out


def _features(kind: str, m: Column, before: Column) -> list[Column]:
    low = F.lower(before)
    return [
        F.length(m),
        _n_digits(m),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        F.size(F.array_distinct(F.split(m, ""))),
        m.rlike("^[0-9a-f]+$").cast("int"),
        _luhn(m).cast("int"),
        low.rlike(_WORDS[kind]).cast("int"),
        before.rlike(r"""[=:]\s*["']?$""").cast("int"),
        before.rlike(r"""["']$""").cast("int"),
        m.contains("(").cast("int"),
    ]


def example_features(kind: str, m: str, before: str) -> list[float]:
    """The same features of a generated example."""
    digits = re.sub("[^0-9]", "", m)
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    # splitting into characters leaves an empty string at the end
    return [len(m), len(digits), len(re.sub("[^A-Za-z]", "", m)), len(re.sub("[A-Za-z0-9]", "", m)), len(set(m)), float(bool(re.fullmatch("[0-9a-f]+", m))), float(1 < len(digits) < 40 and total % 10 == 0), float(bool(re.search(_WORDS[kind], before.lower()))), float(bool(re.search(r"""[=:]\s*["']?$""", before))), float(bool(re.search(r"""["']$""", before))), float("(" in m)]


def planted(kind: str, r: random.Random) -> tuple[str, str, bool]:
    """A span of the kind or a look-alike, the text before it, and which of both it is."""
    syllables = ["er", "tion", "the", "an", "lich", "que", "ment", "ing", "st", "ou", "ble", "re"]
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    plain = lambda: f"{word(2)} {word(1)} {word(2)}{r.choice([' ', ', ', '. '])}"
    good = r.random() < 0.5
    if kind == "secret":
        raw = r.randbytes(r.randint(12, 48))
        name = r.choice(["token", "api_key", "secret", "password", "Authorization", "key", "auth"])
        if good:
            span = r.choice([raw.hex(), base64.b64encode(raw).decode().rstrip("="), "sk-" + raw.hex(), "ghp_" + base64.b64encode(raw).decode().rstrip("=").replace("+", "a").replace("/", "b")])
            before = plain() + name + r.choice([' = "', "=", ": ", "='", ' = "', " "])
        else:
            span = r.choice([word(r.randint(6, 12)), "-".join(word(2) for _ in range(5)), "/".join(word(2) for _ in range(6)), digits(r.randint(20, 30)), "-" * r.randint(20, 60), "_".join(word(1) + digits(2) for _ in range(6)), word(8).upper()])
            before = r.choice([plain(), plain(), plain() + "key: ", plain() + 'href="'])
    elif kind == "number":
        if good:
            span = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"])
            before = plain() + r.choice(["phone: ", "call ", "Tel. ", "SSN ", "fax ", "mobile ", "account ", "card "])
        else:
            span = r.choice([digits(r.randint(7, 20)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(2)}", f"{digits(1)} {digits(2)} {digits(3)} {digits(2)}", f"{digits(2)}.{digits(3)} {digits(2)}", f"{digits(16)}", f"{digits(3)}-{digits(4)}"])
            before = r.choice([plain(), plain(), plain() + "in ", plain() + "call " if len(span) < 9 else plain()])
    elif good:
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), ("{at}", "{dot}"), (" [at] ", " [dot] ")])
        span = f"{word(2)}.{digits(2)}{at}{word(2)}{dot}{r.choice(['com', 'org', 'net'])}"
        before = r.choice([plain(), plain() + "mail ", plain() + "contact: "])
    else:
        span = f"{r.choice(['a', 'x1', word(1)])}{r.choice(['(at)', '[at]'])}{r.choice(['b', '3', 'n'])}.{digits(1)}"
        before = plain()
    return span, before, good


def marked_documents(kind: str, seed: int, n: int = EXAMPLES) -> list[tuple[str, int, int, bool]]:
    """Texts with one planted span or look-alike each: text, its start and end, and whether it is a span of the kind."""
    r = random.Random(f"{kind}-{seed}")
    out = []
    for _ in range(n):
        span, before, good = planted(kind, r)
        after = r.choice(["", '"', ".", ", and so on", " of the year", "\n"])
        out.append((before + span + after, len(before), len(before) + len(span), good))
    return out


def examples(kind: str, seed: int, n: int = EXAMPLES) -> list[tuple[list[float], bool]]:
    """What the kind's generator proposes in marked documents, as features, with the truth."""
    out = []
    for text, begin, end, good in marked_documents(kind, seed, n):
        for m in re.finditer(PATTERNS[kind], text):
            out.append((example_features(kind, m.group(), text[max(0, m.start() - CONTEXT) : m.start()]), good and m.span() == (begin, end)))
    return out


@lru_cache(maxsize=8)
def model(kind: str) -> tuple[list[Tree], float]:
    """The trees of a kind, and the threshold of their score."""
    train, held = examples(kind, 1), examples(kind, 2)
    trees = boost([x for x, _ in train], [y for _, y in train])
    scored = sorted(((sum(leaf(t, x) for t in trees), y) for x, y in held), reverse=True)
    best, right = math.inf, 0
    for i, (score, y) in enumerate(scored, 1):
        right += y
        p, z = right / i, 1.645
        bound = (p + z * z / (2 * i) - z * math.sqrt(p * (1 - p) / i + z * z / (4 * i * i))) / (1 + z * z / i)
        if bound >= 0.98 and (i == len(scored) or scored[i][0] < score):
            best = score
    if best == math.inf:
        raise ValueError(f"no threshold finds {kind} with a precision of 0.98")
    # leaves have six digits: half a digit below, so that the order of summing is no matter
    return trees, best - 5e-7


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["b"].cast("string"), s["e"].cast("string"))), ",")


def _as_spans(found: Column, k: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["b"].alias("b"), F.lit(k).alias("k"), s["e"].alias("e")))


def _passes(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: check(s["m"])


def _featured(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), *(f.cast("double").alias(f"f{i}") for i, f in enumerate(_features(kind, s["m"], s["before"]))))


def _accepted(trees: list[Tree], threshold: float) -> Callable[[Column], Column]:
    def accepted(s: Column) -> Column:
        score = as_expression(trees, lambda i: s[f"f{i}"], F.when, F.lit)
        return (score >= F.lit(float(threshold))) & ~F.exists("base_spans", lambda b: (b["b"] < s["e"]) & (s["b"] < b["e"]))

    return accepted


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_spans and all_spans (arrays of struct b, k, e: start, place in KINDS, end)."""
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = find_matches(docs, KINDS)
    base = []
    for k, kind in enumerate(KINDS[:4]):
        out = out.withColumn(f"base_{kind}", _as_spans(F.filter(f"found_{kind}", _passes(_CHECKS[kind])), k))
        out = out.withColumn(f"n_{kind}", F.size(f"base_{kind}").cast("long"))
        base.append(F.col(f"base_{kind}"))
    out = out.withColumn("base_spans", F.concat(*base))
    more = []
    for k, kind in enumerate(KINDS[4:], 4):
        trees, threshold = model(kind)
        out = out.withColumn(f"scored_{kind}", F.when(F.size(f"found_{kind}") > 0, F.transform(f"found_{kind}", _featured(kind))))
        taken = F.filter(f"scored_{kind}", _accepted(trees, threshold))
        more.append(F.coalesce(_as_spans(taken, k), F.array().cast("array<struct<b:bigint,k:int,e:bigint>>")))
    out = out.withColumn("all_spans", F.concat("base_spans", *more))
    # a generator of one row: filters on the spans stay above it, where pushed down they would repeat the whole search
    found = ["base_spans", "all_spans", *(f"n_{kind}" for kind in KINDS[:4])]
    return out.select(*docs.columns, F.explode(F.array(F.struct(*found))).alias("__found")).select(*docs.columns, *(F.col("__found")[c].alias(c) for c in found))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256, spans; n_secret, n_number, n_address and n_spans (all kinds), and has_pii."""
    found = find_spans(docs.select("doc_id", "text"))
    more = [F.size(F.filter("all_spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[4:], 4)]
    n_spans = F.size("all_spans").cast("long")
    base = F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base, _joined(F.col("all_spans")).alias("spans"), *more, n_spans.alias("n_spans"), (n_spans > 0).alias("has_pii"))


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["k"] == k


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """docs with its spans replaced by their kind's mark (overlapping spans by the first one's)."""
    # the columns travel under names of our own, so that none of theirs can clash
    own = [f"__c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    found = find_spans(docs.toDF(*own).withColumn("text", F.col(own[at])))
    names = F.array(*(F.lit(mark.format(k)) for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        piece = F.array(F.substring(F.col("text"), (s["at"] + 1).cast("int"), (p["b"] - s["at"]).cast("int")), F.element_at(names, p["k"] + 1))
        return F.when(p["b"] >= s["at"], F.struct(p["e"].alias("at"), F.concat(s["out"], piece).alias("out"))).otherwise(F.struct(F.greatest(s["at"], p["e"]).alias("at"), s["out"].alias("out")))

    done = F.aggregate(F.array_sort("all_spans"), start, step)
    found = found.withColumn("__done", done)
    text = F.concat(F.array_join(F.col("__done")["out"], ""), F.substring(F.col("text"), (F.col("__done")["at"] + 1).cast("int"), F.length("text")))
    whole = F.when(F.col(own[at]).isNotNull(), text)
    return found.withColumn("__text", whole).select(*(F.col("__text" if i == at else c) for i, c in enumerate(own))).toDF(*docs.columns)
