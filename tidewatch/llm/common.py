"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space and \x09-\x0D. All other characters, Unicode spaces too, belong to words.
WHITESPACE = " \t\n\x0b\x0c\r"
WHITESPACE_CLASS = r"[\x20\x09-\x0D]"

_own_dir: list[str] = []


#: A key with more than this part of all rows is hot; there are fewer such keys than this number.
HOT_PART = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
    return _own_dir[0]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use mentions it and inside however many lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters that are not WHITESPACE; null counts as no words."""
    # trimmed by characters: a pattern anchored at the end would retry inside every long run of spaces
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, rf"{WHITESPACE_CLASS}+"))).cast("long")


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], n: str, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with table, which has a row for each key and the number n of its rows.

    The rows of a hot key are dealt by the columns by to as many parts as it has HOT_PARTs of all rows, and its row of the
    table goes to each; the others are joined as they are. The broadcast list has fewer than HOT_PART rows at any size.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    limit = max(1, total // HOT_PART)
    parts = F.when(F.col(n) > limit, F.ceil(F.col(n) / limit)).otherwise(F.lit(1)).cast("int")
    hot = table.filter(F.col(n) > limit).select(*keys, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("__parts"))).cast("int")).drop("__parts")
    spread = table.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(spread.hint("merge"), [*keys, "__part"], how).drop("__part")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
