"""One tamper-evident ledger over all alerts, in segments.

A chain over the whole ledger would be serial. Here rows are chained within segments of SEGMENT rows, each a group of its
own; the heads of segments are the rows of a next level, chained likewise, until one head stands for all. A segment is named
by the number of its first row. Micro-batches are appended with segments of their own, and their roots are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counts import counted
from .folds import GENESIS
from .store import written

SEGMENT = 4096
ROWS = "seq long, segment long, event_id long, payload string, prev_hash string, row_hash string"
SEALS = "level int, segment long, n long, head string"
BATCHES = "batch long, first_seq long, n long, root string, prev_head string, head string"


def _segment(seq: str) -> Column:
    return F.floor((F.col(seq) - 1) / SEGMENT) * SEGMENT + 1


def chained(rows: DataFrame) -> DataFrame:
    """rows (segment, seq, payload and others) with prev_hash and row_hash: each segment starts from the genesis hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, GENESIS
        for frame in frames:
            before, after = [], []
            for segment, payload in zip(frame["segment"], frame["payload"], strict=True):
                if segment != key:
                    key, last = segment, GENESIS
                before.append(last)
                last = hashlib.sha256((last + payload).encode()).hexdigest()
                after.append(last)
            yield frame.assign(prev_hash=before, row_hash=after)

    schema = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])
    return rows.repartition("segment").sortWithinPartitions("segment", "seq").mapInPandas(run, schema)


def _heads(chain: DataFrame, level: int) -> DataFrame:
    return chain.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max_by("row_hash", "seq").alias("head")).select(F.lit(level).alias("level"), "segment", "n", "head")


def _above(heads: DataFrame) -> DataFrame:
    """All levels of seals over those of the lowest one, itself left out."""
    heads, level, out = written(heads, "seals"), 0, heads.limit(0)
    while heads.count() > 1:
        level += 1
        placed = counted(heads, [], "segment", ["segment"], seq=F.lit(True))
        rows = placed.select("seq", F.concat("head", F.lit(":"), F.col("n").cast("string")).alias("payload")).withColumn("segment", _segment("seq"))
        heads = written(_heads(chained(rows), level), "seals")
        out = out.unionByName(heads)
    return out


def sealed(chain: DataFrame) -> DataFrame:
    """level, segment, n, head of all segments of a chain, and of those of their heads; the last level has one."""
    lowest = written(_heads(chain, 0), "seals")
    return lowest.unionByName(_above(lowest))


def segmented(ordinary: DataFrame) -> DataFrame:
    """Alerts in order of arrival as chained rows of one ledger. A text that is missing counts as empty."""
    payload = F.concat_ws("|", "status", "message", F.col("fired_ms").cast("string"))
    numbered = counted(ordinary.select("event_id", "ingested_ms", payload.alias("payload")), [], "ingested_ms", ["ingested_ms", "event_id"], seq=F.lit(True))
    return chained(numbered.select("seq", _segment("seq").alias("segment"), "event_id", "payload"))


def verified(rows: DataFrame, seals: DataFrame) -> DataFrame:
    """level, segment, first_bad, kind of each segment that does not hold what was sealed: kind is lost (first_bad is not
    there), added, changed (it or its link), truncated (nothing from first_bad on), resealed (the chain is sound, but is not
    the sealed one) or unsealed. Segments are checked apart; seals against those above them."""
    w = Window.partitionBy("segment").orderBy("seq", "event_id")
    due = F.row_number().over(w) + F.col("segment") - 1
    rows = rows.withColumns({"due": due, "link": F.coalesce(F.lag("row_hash").over(w), F.lit(GENESIS))})
    off = (F.col("prev_hash") != F.col("link")) | (F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("row_hash"))
    at = lambda first, kind: F.struct(first.alias("first_bad"), F.lit(kind).alias("kind"))
    seq, start = F.col("seq"), F.col("segment")
    bad = F.when(seq > F.col("due"), at(F.col("due"), "lost")).when(seq < F.col("due"), at(seq, "added")).when(F.coalesce(off, F.lit(True)), at(seq, "changed"))
    found = rows.withColumn("bad", bad).groupBy("segment").agg(F.min("bad").alias("bad"), F.count(F.lit(1)).alias("held"), F.max_by("row_hash", "seq").alias("last"))
    lowest = seals.filter("level = 0").drop("level")
    met = found.join(lowest, "segment", "full")
    what = F.when(F.col("head").isNull(), at(start, "unsealed")).when(F.col("held").isNull(), at(start, "lost")).when(F.col("bad").isNotNull(), F.col("bad"))
    what = what.when(F.col("held") < F.col("n"), at(start + F.col("held"), "truncated"))
    what = what.when((F.col("held") != F.col("n")) | (F.col("last") != F.col("head")), at(start + F.col("n") - 1, "resealed"))
    low = met.select(F.lit(0).alias("level"), "segment", what.alias("x"))
    again = _above(seals.filter("level = 0")).select("level", "segment", F.struct("n", "head").alias("is"))
    high = again.join(seals.filter("level > 0").select("level", "segment", F.struct("n", "head").alias("was")), ["level", "segment"], "full")
    high = high.filter(~F.col("is").eqNullSafe(F.col("was"))).select("level", "segment", at(start, "resealed").alias("x"))
    return low.filter("x IS NOT NULL").unionByName(high).select("level", "segment", "x.first_bad", "x.kind")


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BATCHES).parquet(f"{folder}/batches/*")


def appender(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends ordinary alerts to the ledger in folder, exactly once.

    A batch writes its rows and seals to places of its own and then, as its last act, the line that counts it in: repeated
    or broken off, it leaves what it would have left at once. Numbers and the chain of batches go on from the latest earlier one.
    """

    def append(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        start = spark.createDataFrame([(-1, 1, 0, GENESIS, GENESIS, GENESIS)], BATCHES)
        start.write.mode("ignore").parquet(f"{folder}/batches/start")
        last = _batches(spark, folder).filter(F.col("batch") < batch).agg(F.max(F.struct("batch", "first_seq", "n", "head")).alias("x")).first().x
        first = last.first_seq + last.n
        payload = F.concat_ws("|", "status", "message", F.col("fired_ms").cast("string"))
        alerts = written(rows.select("event_id", "ingested_ms", payload.alias("payload")), "batch")
        placed = counted(alerts, [], "ingested_ms", ["ingested_ms", "event_id"], seq=F.lit(True))
        placed = placed.select((F.col("seq") + first - 1).alias("seq"), (_segment("seq") + first - 1).alias("segment"), "event_id", "payload")
        chained(placed).write.mode("overwrite").parquet(f"{folder}/rows/{batch}")
        seals = written(sealed(spark.read.schema(ROWS).parquet(f"{folder}/rows/{batch}")), "seals")
        seals.write.mode("overwrite").parquet(f"{folder}/seals/{batch}")
        top = seals.agg(F.max_by("head", "level").alias("root"), F.sum(F.when(F.col("level") == 0, F.col("n"))).alias("n")).first()
        root, n = top.root or GENESIS, top.n or 0
        head = hashlib.sha256(f"{last.head}{root}:{n}".encode()).hexdigest()
        spark.createDataFrame([(batch, first, n, root, last.head, head)], BATCHES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/{batch}")

    return append


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the batches that count, in any order."""
    spans = _batches(spark, folder).filter("n > 0").select(F.col("first_seq").alias("f"), (F.col("first_seq") + F.col("n")).alias("e"), F.col("batch").cast("string").alias("b"))
    rows = spark.read.schema(ROWS).parquet(f"{folder}/rows/*")
    return rows.withColumn("b", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(spans, "b", "left_semi").drop("b")


def broken_batches(spark: SparkSession, folder: str) -> DataFrame:
    """batch, kind of those that do not follow from the one before (removed, added or changed lines of the ledger of batches)."""
    w = Window.orderBy("batch")  # a line a micro-batch
    lines = _batches(spark, folder).withColumns({"link": F.lag("head").over(w), "due": F.lag(F.col("first_seq") + F.col("n")).over(w)}).filter("batch >= 0")
    own = F.sha2(F.concat("prev_head", "root", F.lit(":"), F.col("n").cast("string")), 256)
    kind = F.when(own != F.col("head"), "changed").when((F.col("link") != F.col("prev_head")) | (F.col("due") != F.col("first_seq")), "link")
    return lines.select("batch", kind.alias("kind")).filter("kind IS NOT NULL")
