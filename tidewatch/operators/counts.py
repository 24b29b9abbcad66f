"""Positions and running counts in long histories, without bringing a key's rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SECOND_MS, SECONDS = 1000, 3600


def counted(rows: DataFrame, keys: list[str], ms: str, by: list[str], greatest: dict[str, Column] | None = None, **what: Column) -> DataFrame:
    """rows with, for each of what, the key's sum of it (how many rows hold it, where it is a condition) up to each row, in
    the order of by (ms first); and for each of greatest the greatest of the key so far, null where there is none.

    Taken within seconds, each a group of its own, then over the seconds of an hour and the hours of a key, which are few
    however many rows they stand for.
    """
    sums, tops = list(what), dict(greatest or {})
    names = [*sums, *tops]
    timed = rows.withColumn("__s", F.floor(F.col(ms) / SECOND_MS))
    fold = lambda name: F.max if name in tops else F.sum
    seconds = timed.groupBy(*keys, "__s").agg(*(F.sum(c.cast("long")).alias(f"__{n}") for n, c in what.items()), *(F.max(c).alias(f"__{n}") for n, c in tops.items())).withColumn("__h", F.floor(F.col("__s") / SECONDS))

    def before(order: str, *within: str) -> list[Column]:
        window = Window.partitionBy(*keys, *within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [fold(n)(f"__{n}").over(window).alias(f"__{order[2]}_{n}") for n in names]

    hours = seconds.groupBy(*keys, "__h").agg(*(fold(n)(f"__{n}").alias(f"__{n}") for n in names)).select(*keys, "__h", *before("__h"))
    earlier = seconds.select(*keys, "__h", "__s", *before("__s", "__h")).join(hours, [*keys, "__h"]).drop("__h")
    within = Window.partitionBy(*keys, "__s").orderBy(*by)
    out = timed.join(earlier, [*keys, "__s"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    new = {n: zero(F.col(f"__h_{n}")) + zero(F.col(f"__s_{n}")) + zero(F.sum(c.cast("long")).over(within)) for n, c in what.items()}
    new |= {n: F.greatest(f"__h_{n}", f"__s_{n}", F.max(c).over(within)) for n, c in tops.items()}
    return out.withColumns(new).drop("__s", *(f"__{x}_{n}" for n in names for x in "hs"))


def latest_before(moments: DataFrame, states: DataFrame, keys: list[str], ms: str, tie: str, after: bool = False) -> DataFrame:
    """moments with now, a struct of the key's latest of states at or before each (null where there is none); or, with after, its first later one.

    Both are counted through time together: a moment's count of states is the number of the one it meets, so the as-of join
    is on equal numbers, and no key's history has to pass through one task. Both have the keys, ms and tie.
    """
    columns, others = moments.columns, [c for c in states.columns if c not in keys]
    first = written(states.select(*keys, ms, tie, F.lit(0).alias("__turn"), F.struct(*others).alias("now")), "states")
    second = written(moments.select(*keys, ms, tie, F.lit(1).alias("__turn"), F.struct(*columns).alias("__m")), "moments")
    rows = counted(first.unionByName(second, allowMissingColumns=True), keys, ms, [ms, "__turn", tie], __upto=F.col("__turn") == 0)
    numbered = rows.filter("__turn = 0").select(*keys, F.col("__upto").alias("__n"), "now")
    asked = rows.filter("__turn = 1").select(*keys, (F.col("__upto") + (1 if after else 0)).alias("__n"), "__m")
    return asked.join(numbered, [*keys, "__n"], "left").select("__m.*", "now")


def placed(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in the order of by, which has to be an order without ties to be the same in every run.

    Rows are dealt by ranges of the order and numbered where they lie; what is brought together is a count for each range.
    """
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("__p", F.shiftright("__m", 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(offsets), "__p").select(*rows.columns, place.alias(name))
