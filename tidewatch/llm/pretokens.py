"""Encoding by distinct pre-token with a tokenizers or sentencepiece file, and counting tokens without ids.

The pre-token here is a run of characters other than ASCII white space. word_bpe_49k.json normalises, splits and merges
within such runs only (its normaliser never composes across ASCII white space, its split pattern matches none of it, and
its special tokens hold none), so a text's ids are its pre-tokens' ids one after another. Runs of printable ASCII without
' (contractions) and < (special tokens), and of the letters U+00C0 to U+00FF, are cut further, where that file's pattern
cuts them: the case of their letters does not count there, and letters, digits and other characters never merge.

Defined results: null and empty texts have no tokens; rows with the same doc_id, and repeated rows, each keep their row.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Ragged, at, lower_pieces, ragged, slices, utf8, words

_BATCH_BYTES = 6 << 20
_KEPT_BYTES = 100 << 20
#: Pre-tokens whose counts are broadcast: at most so many, of at most so many bytes, hence at most 8 MB.
HEAVY_WORDS, HEAVY_BYTES = 1 << 17, 64


#: What lower_pieces() makes of plain words; U+00D7 and U+00F7 are no letters.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
#: The characters that stand for bytes 128 to 255 in byte-level vocabularies, where they differ from the byte's own.
_SHOWN = {b: 256 + 33 + 1 + b - 128 for b in range(128, 161)} | {173: 323}


class WordCoder:
    """Ids of pre-tokens by the library, kept for those met before (a bounded number)."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.kept = Ragged(_KEPT_BYTES)
        self.merges = None
        self.cut = words
        if file.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(file)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        if cuts_lower_case(file):
            self.cut, self.merges = lower_pieces, model.model

    def library(self, found: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token. Plain ones need no normalising and cutting, so the library's model has them at once."""
        out: list[list[int]] = [[]] * len(found)
        other = []
        plain, tokenize = _PLAIN.fullmatch, self.merges.tokenize if self.merges is not None else None
        for k, w in enumerate(found):
            if tokenize and len(w) < 1000 and plain(w):
                shown = w.decode("ascii") if w.isascii() else w.decode("latin-1").translate(_SHOWN)
                out[k] = [t.id for t in tokenize(shown)]
            else:
                other.append(k)
        for low in range(0, len(other), 1024):
            part = other[low : low + 1024]
            for k, ids in zip(part, self.whole([found[k].decode("utf-8") for k in part]), strict=True):
                out[k] = ids
        return out

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch, and where each text's ids begin."""
        codes, bounds, distinct = self.cut(data, offsets)
        flat, begins, where = self.kept.rows(distinct, self.library)
        ids, ends = ragged(flat, begins, where[codes] if len(codes) else codes)
        return ids, at(ends, bounds)


def cuts_lower_case(file: str) -> bool:
    """Whether the file lower-cases and cuts plain ASCII words into runs of letters, digits and runs of others."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and bool(cuts) and cuts[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and not cuts[-1].get("add_prefix_space")


@lru_cache(maxsize=4)
def coder(file: str) -> WordCoder:
    return WordCoder(file)


_tables: dict[str, dict[bytes, int]] = {}


def as_dict(name: str, known: Broadcast) -> dict[bytes, int]:
    """The broadcast table as a dictionary, built once in each worker."""
    if name not in _tables:
        _tables.clear()
        table = known.value
        _tables[name] = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    return _tables[name]


def _frequencies(docs: DataFrame, file: str) -> DataFrame:
    """word, n: how often each distinct pre-token occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = coder(file).cut
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in slices(offsets, _BATCH_BYTES):
                codes, _, distinct = cut(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces_per_word(vocabulary: DataFrame, file: str) -> DataFrame:
    """vocabulary with n_pieces, counted once for each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(file).library
        for batch in batches:
            found = batch.column("word").to_pylist()
            counts = np.zeros(len(found), np.int64)
            for low in range(0, len(found), 4096):
                part = library(found[low : low + 4096])
                counts[low : low + len(part)] = [len(ids) for ids in part]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(counts)], ["word", "n", "n_pieces"])

    return vocabulary.select("word", "n").mapInArrow(run, "word binary, n long, n_pieces long")


def token_counts(docs: DataFrame, file: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    The commonest pre-tokens (a bounded number) are counted from a broadcast table, so that no key of the join is hot;
    the others' frequencies in each document meet the counts in a shuffled join.
    """
    from .common import written

    spark = docs.sparkSession
    counted = written(_pieces_per_word(_frequencies(docs, file), file), "pieces")
    heavy = counted.filter(F.length("word") <= HEAVY_BYTES).orderBy(F.desc("n"), "word").limit(HEAVY_WORDS).select("word", "n_pieces")
    known, name = spark.sparkContext.broadcast(heavy.toArrow().combine_chunks()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, cut, row = as_dict(name, known), coder(file).cut, TaskContext.get().partitionId() << 40
        names = ["word", "row_id", "n", "doc_id", "n_bytes"]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in slices(offsets, _BATCH_BYTES):
                codes, bounds, distinct = cut(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                pieces = np.array([pieces_of.get(w, -1) for w in distinct], np.int64)
                rows = row + np.arange(high - low)
                row += high - low
                got = pieces[codes] if len(codes) else np.zeros(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(np.maximum(got, 0))])
                # the row of the document itself: its key can be no word, since it begins with a space
                ids = batch.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays([pa.array([b" %d" % r for r in rows], pa.binary()), pa.array(rows), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), ids, pa.array(np.diff(offsets[low : high + 1]))], names)
                rare = np.flatnonzero(got < 0)
                if len(rare):
                    doc = np.searchsorted(bounds, rare, "right") - 1
                    pairs, n = np.unique(doc * np.int64(len(distinct)) + codes[rare], return_counts=True)
                    word = pa.array(distinct, pa.binary()).take(pa.array(pairs % len(distinct)))
                    yield pa.RecordBatch.from_arrays([word, pa.array(rows[pairs // len(distinct)]), pa.array(n), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, row_id long, n long, doc_id long, n_bytes long")
    joined = found.join(counted.select("word", "n_pieces"), "word", "left")
    summed = joined.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("n_pieces", F.lit(1))).cast("long").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
