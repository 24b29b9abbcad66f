"""Paths of a tree given by parents, by pointer doubling: rounds grow with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

MAX_DEPTH, MAX_ENTRIES, MAX_REQUESTS = 64, 100_000_000_000, 10_000_000_000


def walk(entries: DataFrame, depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES, max_requests: int = MAX_REQUESTS) -> DataFrame:
    """id, path, depth (0 for roots), verdict and steps of each entry (id, unique, parent, null for roots, name).

    verdict is ok, cycle (the entry is its own ancestor or below one that is) or no parent (an ancestor does not exist);
    the latter two have no path. A tree deeper than depth, of more entries, or with more inner entries (each is a request of
    its provider) than the bounds is an error. A null name is empty.

    Each entry that has not met its top points to an ancestor, twice as far in each round, and holds the path in between;
    steps tells how many rounds it took. Only such entries go on to the next round.
    """
    kind = entries.schema["id"].dataType
    given = entries.select("id", F.col("parent").cast(kind).alias("parent"), F.coalesce("name", F.lit("")).alias("path"))
    count, inner = given.agg(F.count(F.lit(1)), F.count_distinct("parent")).first()
    if count > max_entries:
        raise ValueError(f"tree has more than {max_entries} entries")
    if inner > max_requests:
        raise ValueError(f"tree has more than {max_requests} inner entries")
    done = [written(given.filter("parent IS NULL").select("id", "path", F.lit(0).cast("long").alias("depth"), F.lit("ok").alias("verdict"), F.lit(0).alias("steps")), "tree")]
    open_ = given.filter("parent IS NOT NULL").select("id", "path", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    rounds = 0
    while True:
        # an open entry either meets one that is done, or takes over where its ancestor points
        open_ = written(open_, "open")
        if rounds and 2**rounds > count:
            # so many steps pass every entry there is: whatever still goes up goes round
            return _all(done, open_.select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("verdict"), F.lit(rounds).alias("steps")), depth)
        if open_.isEmpty():
            return _all(done, None, depth)
        rounds += 1
        ended = done[0]
        for more in done[1:]:
            ended = ended.unionByName(more)
        tops = ended.select(F.col("id").alias("up"), F.col("path").alias("p"), F.col("depth").alias("d"), F.lit(None).cast(kind).alias("u"), F.col("verdict").alias("v"))
        higher = open_.select(F.col("id").alias("up"), F.col("path").alias("p"), F.col("depth").alias("d"), F.col("up").alias("u"), F.lit(None).cast("string").alias("v"))
        met = open_.join(tops.unionByName(higher), "up", "left")
        met = met.withColumn("v", F.when(F.col("d").isNull() & F.col("v").isNull(), "no parent").otherwise(F.col("v")))
        # a path beyond the bound is never asked for: where it goes round it would double without end
        short = (F.coalesce("v", F.lit("ok")) == "ok") & (F.col("depth") + F.col("d") <= depth)
        met = written(met.select("id", F.when(short, F.concat_ws("/", "p", "path")).alias("path"), (F.col("depth") + F.col("d")).alias("depth"), "u", "v"), "met")
        done.append(met.filter("v IS NOT NULL").select("id", "path", F.when(F.col("v") == "ok", F.col("depth")).alias("depth"), F.col("v").alias("verdict"), F.lit(rounds).alias("steps")))
        open_ = met.filter("v IS NULL").select("id", "path", F.col("u").alias("up"), "depth")


def _all(done: list[DataFrame], cyclic: DataFrame | None, depth: int) -> DataFrame:
    out = done[0]
    for more in [*done[1:], *([cyclic] if cyclic is not None else [])]:
        out = out.unionByName(more)
    deepest = out.agg(F.max("depth")).first()[0]
    if deepest is not None and deepest > depth:
        raise ValueError(f"tree is deeper than {depth}")
    return out
