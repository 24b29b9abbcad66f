"""Removal of lines that spread over many sites.

Lines are keyed by two 64-bit hashes of their trimmed text. HyperLogLog sketches of the sites merge by aggregation into
one per line; lines whose estimate is near the threshold, by the sketch's error, get an exact distinct count. A line that
spreads over min_sites sites or more is boilerplate: it stays where it comes first (least doc_id, then place) and goes
everywhere else. Lines of fewer than min_words words are left alone.

Lines join the boilerplate in shuffled joins that deal the rows of a hot line to many tasks, so a line that holds a third
of all rows is no matter; sketches are merged map-side before they are shuffled.

Defined results: a null text has no lines and stays null; an empty text stays empty; a null site counts as one site;
rows with equal doc_id and equal text have equal results (a first place may be each of theirs); empty tables give empty
results; other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, WHITESPACE_CLASS, bound, join_spread, word_count, written

MIN_SITES, MIN_WORDS, LOG_K, SIGMAS = 8, 3, 12, 5


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """__doc, __key (of the text), site, pos, h1, h2: a row for each line that may be boilerplate."""
    given = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__key"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"), F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
    each = given.select("__doc", "__key", "site", F.posexplode("lines").alias("pos", "line"))
    # a line of enough words; cheaper than counting them. Anchored and without retries: linear in a line of any length
    each = each.withColumn("line", F.btrim("line", F.lit(WHITESPACE))).filter(F.col("line").rlike(rf"\A(?:[^\x20\x09-\x0D]++{WHITESPACE_CLASS}++){{{MIN_WORDS - 1}}}[^\x20\x09-\x0D]"))
    trimmed = F.col("line")
    return each.select("__doc", "__key", "site", "pos", F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(9), trimmed).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, n (occurrences), first (struct of the doc and place where the line stays) of lines on min_sites sites or more."""
    # a line on so many sites occurs as often: the rest needs no sketch
    often = written(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites), "often")
    asked = written(join_spread(lines, often, ["h1", "h2"], "n", ["__doc", "pos"]), "lines")
    sketched = asked.groupBy("h1", "h2", "n").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.min(F.struct(F.col("__doc").alias("d"), F.col("pos").alias("p"))).alias("first"))
    estimated = written(sketched.select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("sites")), "sketches")
    margin = max(1, math.ceil(SIGMAS * 1.04 / math.sqrt(2**LOG_K) * min_sites))
    near = estimated.filter(F.col("sites").between(min_sites - margin, min_sites + margin - 1)).select("h1", "h2", "n")
    exact = join_spread(asked.drop("n"), near, ["h1", "h2"], "n", ["__doc", "pos"]).select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    decided = estimated.join(exact, ["h1", "h2"], "left").withColumn("sites", F.coalesce("exact", "sites"))
    return decided.filter(F.col("sites") >= min_sites).select("h1", "h2", "n", "first")


def _removals(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """__doc, __key, gone (places of the lines that go) of the texts that lose any."""
    lines = _lines(docs, site)
    hits = join_spread(lines, written(boilerplate(lines, min_sites), "boilerplate"), ["h1", "h2"], "n", ["__doc", "pos"])
    away = ~(F.col("__doc").eqNullSafe(F.col("first")["d"]) & (F.col("pos") == F.col("first")["p"]))
    return hits.filter(away).groupBy("__doc", "__key").agg(F.collect_set("pos").alias("gone"))


def _cleaned(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """docs with __gone and __text, the text without the lines that go."""
    gone = written(_removals(docs, site, min_sites), "removals").withColumnsRenamed({"__doc": "__gone_doc", "__key": "__gone_key", "gone": "__gone"})
    # merged at every size: what is removed grows with the data
    joined = docs.withColumn("__key", F.xxhash64("text")).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__gone_doc")) & (F.col("__key") == F.col("__gone_key")), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    kept = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "__gone"), lambda i: F.get(ls, i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(bound(lines, lambda ls: F.array_join(kept(ls), "\n")))
    return joined.withColumn("__text", text)


def line_report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, text_md5 (of the text that stays) of each row of docs."""
    cleaned = _cleaned(docs.select("doc_id", "text", site), site, min_sites)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    return cleaned.select("doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_removed"), F.md5(F.col("__text").cast("binary")).alias("text_md5"))


def remove_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs without boilerplate lines; texts that had words and lose them all go. Other columns stay, whatever their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", site)]
    used = docs.select("doc_id", "text", site, F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(c) for c in others)).alias("others") if others else F.lit(None).alias("others"))
    cleaned = _cleaned(used, site, min_sites)
    emptied = F.col("__gone").isNotNull() & (word_count(F.col("__text")) == 0)
    rows = cleaned.filter(~emptied).withColumn("text", F.col("__text"))
    return rows.select(*(F.col(c) if c in ("doc_id", "text", site) else F.col("others").getField(c).alias(c) for c in docs.columns))
