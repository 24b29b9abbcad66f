"""Mixing sources to target weights, on DataFrame operations alone.

Words stand for tokens. Each source's documents, in a pseudorandom order, are packed into blocks of a fixed number of
words (the last may be short). A source's target gives its number of slots. For each output shard the sources' counts are
a multinomial draw by the shares of the slots. Free draws miss the targets by chance, so each source's running total over
the shards is then stretched to end at its slots: a shard's counts differ from its draw by a factor near 1 and rounding.
Within a source, slots run through the blocks by index permutations, a new one for each pass, and blocks join slots by
(source, index). The last slot of a source is cut where its target is met.

Permutations are swap-or-not shuffles: a bijection of any 0..n-1 from a few hashes per round, without a sort or a table.

Running sums go by (source, hash bucket) and then over the buckets' totals; buckets grow in number with their source, so
that a source with most of the rows is shared out. Only tables of one row per source are ever ordered as a whole.

Defined results: null and empty texts have size 0 and nothing is taken of them; a null source is the last source; rows
with equal doc_id, and repeated rows, each count and keep their row; an empty table gives an empty result; other columns
may have any name that does not begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE_CLASS, bound, partitions, word_count, written

#: Words of a block, slots of an output shard, documents of a bucket (about), rounds of a permutation.
BLOCK_WORDS, SHARD_SLOTS, BUCKET_DOCS, ROUNDS = 512, 4096, 20_000, 12


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of x (0..n-1) in the pseudorandom permutation of 0..n-1 that key names."""

    def one_round(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, partner)).bitwiseAND(1) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), one_round)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """src, place, n_docs, source_size, target: shares by weight; a target above most times its source stops there, and what is over goes to the others by weight."""
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("place", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    totals = totals.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    # in the order of cap / weight the capped sources come first
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    totals = totals.withColumns({"left": left, "weight_left": weight_left})
    totals = totals.withColumn("capped", F.col("left") * F.col("weight") / F.col("weight_left") > F.col("cap"))
    level = F.max_by(F.when(~F.col("capped"), F.col("left") / F.col("weight_left")), F.when(~F.col("capped"), -F.col("cap") / F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return totals.select("src", "place", "n_docs", "source_size", target.cast("double").alias("target"))


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """targets with each source's blocks, the slots of a pass, all slots, and the words of its last slot."""
    size, wanted = F.col("source_size"), F.col("wanted")
    out = targets.withColumn("wanted", F.round("target").cast("long")).filter((F.col("wanted") > 0) & (F.col("source_size") > 0))
    out = out.withColumns({"full": F.floor(size / block).cast("long")}).withColumn("tail", size - F.col("full") * block)
    out = out.withColumns({"per_pass": F.col("full") + (F.col("tail") > 0).cast("long"), "passes": F.floor(wanted / size).cast("long")})
    out = out.withColumn("over", wanted - F.col("passes") * size)
    out = out.withColumn("over_full", F.least(F.floor(F.col("over") / block).cast("long"), F.col("full")))
    out = out.withColumn("rest", F.col("over") - F.col("over_full") * block)
    out = out.withColumn("slots", F.col("passes") * F.col("per_pass") + F.col("over_full") + (F.col("rest") > 0).cast("long"))
    return out


def shard_counts(plan: DataFrame, seed: int) -> DataFrame:
    """shard, place, drawn, n, before: each shard's multinomial draw of sources, and the slots it gets of each of them.

    drawn sums to SHARD_SLOTS over a shard (the last may have fewer); n sums to the source's slots over all shards, and
    before is that sum over the shards before.
    """
    spark = plan.sparkSession
    # a row of one entry per source
    shares = plan.agg(F.array_sort(F.collect_list(F.struct("place", "slots"))).alias("s"), F.sum("slots").alias("all_slots"))
    ends = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x["slots"]))
    shares = shares.filter("all_slots > 0").select(ends.alias("ends"), F.transform("s", lambda x: x["place"]).alias("places"), "all_slots")
    shards = shares.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all_slots") - 1) / SHARD_SLOTS).cast("long")))).repartition(partitions(spark), "shard")
    here = F.least(F.lit(SHARD_SLOTS), F.col("all_slots") - F.col("shard") * SHARD_SLOTS)
    draws = shards.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), here.cast("long"))))
    at = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "draw"), F.col("all_slots"))
    drawn = draws.select("shard", F.element_at("places", (F.size(F.filter("ends", lambda e: e <= at)) + 1).cast("int")).alias("place"))
    drawn = drawn.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("drawn"))
    # a source that no shard drew has its slots in the first one
    known = plan.select("place", "slots").join(drawn, "place", "left").select("place", "slots", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("drawn", F.lit(0)).alias("drawn"))
    so_far = Window.partitionBy("place").orderBy("shard")
    total = F.sum("drawn").over(Window.partitionBy("place"))
    stretched = lambda run: F.when(total == 0, F.col("slots")).otherwise(F.round(run * F.col("slots").cast("double") / total)).cast("long")
    run = F.sum("drawn").over(so_far)
    out = known.withColumns({"end": stretched(run), "before": F.when(total == 0, F.lit(0)).otherwise(stretched(run - F.col("drawn"))).cast("long")})
    return out.select("shard", "place", "drawn", (F.col("end") - F.col("before")).alias("n"), "before")


def draw_slots(targets: DataFrame, seed: int, block: int = BLOCK_WORDS) -> DataFrame:
    """place, block, pass, words, shard, shard_slots (slots of the source in the shard): a row for each slot of the mix."""
    plan = _plan(targets, block)
    counts = shard_counts(plan, seed).filter("n > 0").repartition(partitions(targets.sparkSession), "place", "shard")
    # the plan has a row per source
    slots = counts.join(plan.drop("src"), "place").withColumn("k", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    within = F.pmod("k", F.col("per_pass"))
    slots = slots.withColumns({"pass": F.floor(F.col("k") / F.col("per_pass")).cast("long"), "within": within})
    key = F.xxhash64(F.lit(seed), "place", "pass")
    index = F.when(F.col("within") < F.col("full"), permuted(F.col("within"), F.greatest("full", F.lit(1)), key)).otherwise(F.col("full"))
    slots = slots.withColumn("block", index)
    cut = (F.col("k") == F.col("slots") - 1) & (F.col("rest") > 0)
    words = F.when(cut, F.col("rest")).when(F.col("block") == F.col("full"), F.col("tail")).otherwise(F.lit(block))
    return slots.select("place", "block", "pass", words.cast("long").alias("words"), "shard", F.col("n").alias("shard_slots"))


def pack(sizes: DataFrame, targets: DataFrame, seed: int, block: int = BLOCK_WORDS) -> DataFrame:
    """sizes with place and start: the words of the source before the document."""
    buckets = F.ceil(F.col("n_docs") / BUCKET_DOCS)
    placed = sizes.join(targets.select("src", "place", "n_docs"), "src").withColumns({"bucket": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row_key"), buckets), "order": F.xxhash64(F.lit(seed + 1), "doc_id", "row_key")})
    ranked = Window.partitionBy("place", "bucket").orderBy("order", "doc_id", "size")
    running = placed.withColumns({"at": F.row_number().over(ranked), "inner": F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    totals = placed.groupBy("place", "bucket").agg(F.sum("size").alias("total"))
    before = totals.select("place", "bucket", F.coalesce(F.sum("total").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    return running.join(before, ["place", "bucket"]).withColumn("start", F.col("outer") + F.col("inner"))


def _drawn(packed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Each document's stretches, with the slots that take them (none: words and pass are null)."""
    size, start = F.col("size"), F.col("start")
    # a document without words gets a block of its own that no slot takes
    blocks = F.when(size > 0, F.sequence(F.floor(start / block).cast("long"), F.floor((start + size - 1) / block).cast("long"))).otherwise(F.array(-1 - F.col("bucket")))
    stretches = packed.withColumn("block", F.explode(blocks))
    low, high = F.greatest(start, F.col("block") * block), F.least(start + size, (F.col("block") + 1) * block)
    stretches = stretches.withColumns({"low": low - F.col("block") * block, "high": high - F.col("block") * block})
    # slots grow with the data, whatever their source's few rows make the planner think: never broadcast
    joined = stretches.join(slots.hint("merge"), ["place", "block"], "left")
    return joined.withColumn("got", F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least("high", "words") - F.col("low"))).cast("long"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row_key"), *more)


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 5, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_slots, first_shard and first_shard_slots (the slots of its source in
    that shard) of each document."""
    sizes = written(_sized(docs), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets")
    drawn = _drawn(pack(sizes, targets, seed, block), draw_slots(targets, seed, block), block)
    taken = drawn.groupBy("place", "bucket", "at").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("got").alias("taken"), F.sum((F.col("got") > 0).cast("long")).alias("n_slots"), F.min(F.when(F.col("got") > 0, F.struct("shard", "shard_slots"))).alias("first"))
    return taken.join(targets, "place").select("doc_id", "size", "source_size", "target", "taken", "n_slots", F.col("first.shard").alias("first_shard"), F.col("first.shard_slots").alias("first_shard_slots"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 5, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix in the columns of docs: for each pass through its source, a document's row with the words drawn in that pass.

    A pass that draws all words keeps the text as it is; otherwise the drawn stretches stand one after another with the
    white space that follows their words. Documents of which nothing is drawn, and those without words, are left out.
    """
    sizes = written(_sized(docs), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets")
    drawn = _drawn(pack(sizes, targets, seed, block), draw_slots(targets, seed, block), block).filter("got > 0")
    begin = F.col("block") * block + F.col("low") - F.col("start")
    parts = drawn.groupBy("place", "bucket", "at", "pass").agg(
        F.first("doc_id").alias("__doc"), F.first("row_key").alias("__key"), F.first("src").alias("__src"), F.first("size").alias("__size"), F.sum("got").alias("__got"),
        F.sort_array(F.collect_list(F.struct(begin.cast("int").alias("b"), F.col("got").cast("int").alias("n")))).alias("__parts"),
    )
    # repeated rows have one key: each row of docs meets its own number among them
    again = Window.partitionBy("__doc", "__key", "__src").orderBy("place", "bucket", "at")
    parts = parts.withColumn("__copy", F.dense_rank().over(again))
    keyed = docs.withColumns({"__k": F.xxhash64("text"), "__s": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))})
    keyed = keyed.withColumn("__copy_of", F.row_number().over(Window.partitionBy("doc_id", "__k", "__s").orderBy("__k")))
    joined = keyed.join(parts, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__k") == F.col("__key")) & (F.col("__s") == F.col("__src")) & (F.col("__copy_of") == F.col("__copy")))
    words = F.split(F.regexp_replace("text", f"^{WHITESPACE_CLASS}+", ""), rf"(?<={WHITESPACE_CLASS})(?!{WHITESPACE_CLASS})")
    cut = bound(words, lambda ws: F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(ws, p["b"] + 1, p["n"]))), ""))
    text = F.when(F.col("__got") == F.col("__size"), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).select(*docs.columns)
