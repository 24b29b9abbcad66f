"""Quality rules with risk-controlled thresholds.

Each rule compares a figure of the document with a cutoff. Half of the labelled documents (by a hash of their text, so
that copies stand on one side) tune: for every stratum and rule they give the strictest cutoff of a fixed ladder that
rejects at most a share b of good documents; growing b, to far beyond alpha, gives nested rule sets. The other half hold
out: rule sets are tested from the mildest on (fixed-sequence testing), and the last is taken for which every set so far
passes the exact binomial test of "it falsely rejects more than alpha of the stratum's good documents" at level
delta / strata (Bonferroni). With probability 1 - delta no stratum loses more than alpha of its good documents. A stratum
with too few labels rejects nothing by these rules.

Defined results: null and empty texts have no words and fail the base rule; a null stratum is a stratum of its own;
labels without a document or without a quality are left out, repeated labels count as often as they come; other columns
of the input may have any name and stay as they are. Rows repeat as they come; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrays import at, pieces, slices, utf8, words
from .common import written

_BATCH_BYTES = 4 << 20
#: The share of good documents of a stratum that may be rejected, and the chance that any stratum loses more.
ALPHA, DELTA = 0.02, 0.05
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs"]

#: Rules by name: the figure, and its cutoffs from the mildest to the strictest (a document is rejected above the cutoff).
_PER_WORD = [1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03, 0.02]
_SHARE = [0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", _PER_WORD),
    "bangs": ("n_bangs / n_words", _PER_WORD),
    "upper": ("n_upper / greatest(n_letters, 1)", _SHARE),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", _SHARE),
    "repeats": ("n_repeat_words / n_words", [0.28, 0.25, 0.22, 0.19, 0.16, 0.13, 0.1, 0.07, 0.05]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0]),
    "short_words": ("n_words / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3]),
}
#: Shares of good tuning documents that a rule may reject, from the mildest rule set to the strictest. The last ones are
#: beyond any alpha in use: the test, and not the end of the ladder, says where to stop.
BUDGETS = [0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2]

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = _UPPER | np.isin(np.arange(256), list(range(97, 123)))


def count_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a batch."""
    n_docs = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(at(np.cumsum(mask), offsets))

    codes, bounds, distinct = words(data, offsets)
    out = {"n_words": np.diff(bounds)}
    out["word_chars"] = total(((data & 0xC0) != 0x80) & ~_SPACES[data])
    out["n_symbols"] = total(_SYMBOLS[data])
    out["n_upper"], out["n_letters"], out["n_bangs"] = total(_UPPER[data]), total(_LETTER[data]), total(data == 33)

    # lines: a text's first, and one after each line feed; blank ones have no word
    feed = data == 10
    starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(feed) + 1]))
    doc = np.searchsorted(offsets, starts, "right") - 1
    # of texts that begin at the same place (empty ones), and of lines that begin where the next text does, the order holds
    ends_text = np.isin(starts, offsets[1:]) & (starts > 0)
    if ends_text.any() or len(starts):
        firsts = np.arange(n_docs)
        after = np.flatnonzero(feed)
        doc_of_feed = np.searchsorted(offsets, after, "right") - 1
        places = np.concatenate([offsets[:-1], after + 1])
        owners = np.concatenate([firsts, doc_of_feed])
        order = np.lexsort((np.concatenate([np.zeros(n_docs, np.int8), np.ones(len(after), np.int8)]), places, owners))
        starts, doc = places[order], owners[order]
    packed = data[~feed]
    at_packed = starts - at(np.cumsum(feed), starts)
    line, _ = pieces(packed, at_packed)
    filled = np.diff(np.append(at(np.cumsum(~_SPACES[packed]), at_packed), int((~_SPACES[packed]).sum()))) > 0
    doc, line = doc[filled], line[filled]
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    if len(doc):
        pairs = pd.Series(doc * np.int64(line.max() + 1) + line).drop_duplicates().to_numpy() // np.int64(line.max() + 1)
        out["n_dup_lines"] = out["n_lines"] - np.bincount(pairs, minlength=n_docs)
    else:
        out["n_dup_lines"] = np.zeros(n_docs, np.int64)

    # windows by a 64-bit hash of their words and document
    covered = np.zeros(len(codes) + 1, np.int64)
    if len(codes) >= WINDOW:
        random = np.random.default_rng(8).integers(0, 1 << 63, len(distinct), np.uint64) * np.uint64(2) + np.uint64(1)
        owner = np.repeat(np.arange(n_docs), np.diff(bounds))
        begin = np.flatnonzero(owner[: len(codes) - WINDOW + 1] == owner[WINDOW - 1 :])
        value = random[codes]
        key = owner[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(WINDOW):
            key = (key ^ value[begin + j]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        twice = begin[pd.Series(key).duplicated(keep=False).to_numpy()]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = np.diff(at(np.cumsum(np.cumsum(covered)[:-1] > 0), bounds))
    return out


def count_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs (none of them named like COUNTS), text_key (a hash of the text) and COUNTS of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            for low, high in slices(offsets, _BATCH_BYTES):
                counts = count_batch(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in carried), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], [*carried, *COUNTS])

    carried = [*keep, "text_key"]
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("__text"))
    schema = StructType([given.schema[c] for c in carried] + [StructField(c, LongType()) for c in COUNTS])
    return given.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _levels() -> Column:
    """For each rule, how many cutoffs of its ladder the document exceeds (mildest first)."""
    each = []
    for figure, cutoffs in RULES.values():
        value = F.when(F.col("n_words") > 0, F.expr(f"cast({figure} as double)")).otherwise(0.0)
        each.append(sum(((value > c).cast("int") for c in cutoffs[1:]), (value > cutoffs[0]).cast("int")))
    return F.array(*each)


def _stratum(column: str) -> Column:
    """A key that tells null from any value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def exceeds(rejected: int, n: int, alpha: float) -> float:
    """The exact binomial p-value of so few rejections if the true share were alpha: the chance of rejected or fewer of n.

    It equals the regularised incomplete beta function I(1 - alpha; n - rejected, rejected + 1), taken by its continued
    fraction, so that the work hardly grows with the stratum.
    """
    if rejected >= n:
        return 1.0
    a, b, x = float(n - rejected), float(rejected + 1), 1.0 - alpha
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _fraction(b, a, 1.0 - x) / b)


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, from its front on until a factor is 1."""
    tiny = 1e-300
    numerator, denominator = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    value, m = denominator, 0
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        factor = 1.0
        for term in (even, odd):
            denominator = 1.0 / ((1.0 + term * denominator) or tiny)
            numerator = (1.0 + term / numerator) or tiny
            factor = numerator * denominator
            value *= factor
        if abs(factor - 1.0) < 1e-14:
            return value


def calibrate(labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum, floors: of each rule the number of exceeded cutoffs from which it rejects (0: the rule is off).

    labelled: text_key, stratum, good, levels. Rows of a stratum with one text_key are one trial: the exact bound takes its
    trials for independent, which copies of a text are not.
    """
    good = labelled.filter("good").dropDuplicates(["stratum", "text_key"]).select("stratum", (F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(2)) == 0).alias("tune"), "levels")
    # tuning: how many good documents of a stratum reach each level of each rule
    tune = good.filter("tune")
    reached = tune.select("stratum", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level").agg(F.count(F.lit(1)).alias("c"))
    upward = Window.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    reached = reached.withColumns({"reach": F.sum("c").over(upward), "n": F.sum("c").over(Window.partitionBy("stratum", "rule"))})
    # levels ascend from the mildest cutoff: a rule rejects from the one above the last that too many documents reach
    budgets = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(b).alias("b")) for t, b in enumerate(BUDGETS)))
    each = reached.withColumn("x", F.explode(budgets)).groupBy("stratum", "rule", F.col("x.t").alias("t")).agg((F.max(F.when(F.col("reach") > F.col("x.b") * F.col("n"), F.col("level"))) + 1).alias("floor"))
    longest = F.element_at(F.array(*(F.lit(len(c)) for _, c in RULES.values())), F.col("rule") + 1)
    each = each.withColumn("floor", F.when(F.col("floor") <= longest, F.col("floor")).otherwise(F.lit(0)))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda z: z[value])
    sets = each.groupBy("stratum", "t").agg(ordered("rule", "floor").alias("floors")).groupBy("stratum").agg(ordered("t", "floors").alias("sets"))
    sets = written(sets, "rule-sets")
    level = delta / max(1, sets.count())
    # a held-out document goes with the mildest rule set that rejects it
    hits = F.filter(F.sequence(F.lit(0), F.lit(len(BUDGETS) - 1)), lambda t: F.exists(F.arrays_zip("levels", F.col("sets")[t].alias("floor")), lambda z: (z["floor"] > 0) & (z["levels"] >= z["floor"])))
    held = good.filter(~F.col("tune")).join(sets, "stratum").select("stratum", F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(len(BUDGETS))).alias("at"))
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("at") <= t).cast("long")).alias(f"k{t}") for t in range(len(BUDGETS))))
    strata = sets.join(counts, "stratum", "left")

    def test(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([exceeds(int(b), int(a), alpha) for a, b in zip(n.fillna(0), k.fillna(0), strict=True)])

    p_value = F.pandas_udf(test, "double")
    tested = strata.select("stratum", "sets", F.array(*(p_value(F.coalesce("n", F.lit(0)), F.coalesce(f"k{t}", F.lit(0))) for t in range(len(BUDGETS)))).alias("p"))
    passed = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, p: F.struct((s["n"] + (s["go"] & (p <= level)).cast("int")).alias("n"), (s["go"] & (p <= level)).alias("go")))["n"]
    off = F.array(*(F.lit(0) for _ in RULES))
    return tested.select("stratum", F.when(passed > 0, F.try_element_at("sets", passed)).otherwise(off).alias("floors"))


def judge(counted: DataFrame, labels: DataFrame, labelled: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """counted (doc_id, the stratum's column, COUNTS and more) with base_failed, failed_rules and kept. labelled: counted
    documents that hold at least those with labels; they are split by text_key, or by doc_id where they have none."""
    lab = labels.filter("quality is not null").select(F.col("doc_id").alias("__doc"), (F.col("quality") == 1).alias("good"))
    key = F.col("text_key" if "text_key" in labelled.columns else "doc_id").alias("text_key")
    seen = labelled.select("doc_id", key, _stratum(stratum).alias("stratum"), _levels().alias("levels"), base_failed().alias("base")).filter("not base").join(lab, F.col("doc_id") == F.col("__doc"))
    floors = written(calibrate(seen.select("text_key", "stratum", "good", "levels"), alpha, delta), "floors")
    out = counted.withColumns({"__stratum": _stratum(stratum), "__levels": _levels()}).join(floors.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
    fails = F.array_compact(F.array(*(F.when((F.col("floors")[r] > 0) & (F.col("__levels")[r] >= F.col("floors")[r]), F.lit(name)) for r, name in enumerate(RULES))))
    out = out.withColumns({"base_failed": base_failed(), "failed_rules": F.array_join(fails, ",")})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("__stratum", "__levels", "floors")


def _given(docs: DataFrame, stratum: str) -> DataFrame:
    return docs.select("doc_id", F.col(stratum).alias("stratum"), "text")


def quality_report(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Each document's counts and verdict."""
    counted = written(count_documents(_given(docs, stratum), ["doc_id", "stratum"]), "counts")
    return judge(counted, labels, counted, "stratum", alpha, delta).select("doc_id", *COUNTS[:5], "base_failed", "kept", "failed_rules")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows and columns of docs that no rule rejects."""
    # counts are narrow: counting twice spares a shuffle of the texts
    labelled = written(count_documents(_given(docs, stratum), ["doc_id", "stratum"]), "counts")
    # the columns travel under names of our own, so that none of theirs can clash
    own = [f"__c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*own).withColumns({"doc_id": F.col(own[docs.columns.index("doc_id")]), "stratum": F.col(own[docs.columns.index(stratum)]), "text": F.col(own[docs.columns.index("text")])})
    kept = judge(count_documents(given, [*own, "doc_id", "stratum"]), labels, labelled, "stratum", alpha, delta).filter("kept")
    return kept.select(*own).toDF(*docs.columns)
