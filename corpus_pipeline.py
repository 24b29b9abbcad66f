"""A corpus pipeline: each stage takes all documents that the one before kept, and is written and read again between stages.

quality rules (documents that a rule rejects go), line dedup (boilerplate lines go, and documents that lose all their
words), near-duplicates (the least doc_id of each component stays), mixing to target weights (a row for each pass through
a source that draws from the document, with the words drawn), BPE encoding (ids, and their text decoded again).

All but the last return the columns of documents. A text that is null or empty fails the quality rules; tables without
rows, and columns with other names, pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import recode_documents
from tidewatch.llm.common import new_path, read_table, written
from tidewatch.llm.linededup import remove_lines
from tidewatch.llm.mixing import mix_documents
from tidewatch.llm.neardup import near_duplicates
from tidewatch.llm.quality import keep_good
from tidewatch.llm.queries import BYTE_BPE, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects: false rejection of good ones is held under 2 % for each language."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that spread over eight sources or more, but for each line's first place."""
    return remove_lines(docs, site="source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component at a similarity of 80 %; of rows with that doc_id, every one. Two documents at
    just 80 % meet in no band with probability 5e-5, those above less."""
    gone = near_duplicates(docs, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(written(gone, "near-duplicates"), F.col("doc_id") == F.col("__gone"), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed 5, 2, 1, repeating, at 150 % of all words and at most twice each source's own."""
    return mix_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs with ids, n_tokens and decoded."""
    return recode_documents(docs, tokenizer_file(BYTE_BPE))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("source mixing", source_mixing),
    ("BPE codec", bpe_codec),
]

#: The stages fit thresholds, hash and tokenise: SQL cannot express them. The tests hold the first three stages to a plain
#: Python version row for row, the mix to its targets and to runs of each document's words, and ids and texts to the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{k}-{uuid.uuid4().hex[:6]}")
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    return docs
