"""Vector codes: a codebook for each part of the vectors, fitted by Lloyd's rounds with Hamerly's bounds, in exact integers.

Every part of every vector keeps its entry, an upper bound of its distance to that entry and a lower bound of its distance
to every other one. When entries move, the upper bound grows by the move of its own entry and the lower one shrinks by the
furthest move of the others. If the upper bound is then strictly less than the lower, the entry is still the only nearest
one and no other is looked at; else the upper bound is made exact and tried again, and only then all entries are scanned
in integers, which also settles ties for the lesser index. Bounds are kept in 32 bits, rounded away from each other.

A round is one job: it writes the new state and, for each task, a row for each entry with the sum of its parts; the driver
adds those up, as many rows as the codebooks have entries.

Defined results: rows whose vector is null or holds null or non-finite components are left out, as are vectors whose length
is not dim; rows repeat as they come; rows without an id are coded but start no entry; equal ids are told apart by
components; with fewer vectors than entries there are fewer entries; with none there are no rows; null labels are one
group; components beyond 2 ** 27 as integers raise OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import utf8
from .common import join_spread, written
from .vectors import Rounds, binary, kept_vectors, summed, unpacked

_SLACK = 1e-12


def _up(values: np.ndarray) -> np.ndarray:
    """Values in 32 bits, none below the true value."""
    near = values.astype(np.float32)
    return np.where(near < values, np.nextafter(near, np.float32(np.inf)), near)


def _down(values: np.ndarray) -> np.ndarray:
    near = values.astype(np.float32)
    return np.where(near > values, np.nextafter(near, np.float32(-np.inf)), near)


def moves(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry of each part has moved, and the furthest move of the other entries of its part."""
    own = np.sqrt(((after - before) ** 2).sum(2).astype(np.float64)) * (1 + _SLACK)
    order = np.sort(own, axis=1)
    second = order[:, -2:-1] if own.shape[1] > 1 else np.zeros((len(own), 1))
    # where the entry is the one that moved furthest, the next counts
    return own, np.where(own == order[:, -1:], second, order[:, -1:])


def scanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part (the least index of equals), and bounds of its distance and of the next one's."""
    d = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d += (x[:, j, None] - entries[None, :, j]) ** 2
    code = d.argmin(1)
    rows = np.arange(len(x))
    upper = _up(np.sqrt(d[rows, code].astype(np.float64)) * (1 + _SLACK))
    d[rows, code] = np.iinfo(np.int64).max
    lower = _down(np.sqrt(d.min(1).astype(np.float64)) * (1 - _SLACK)) if len(entries) > 1 else np.full(len(x), np.inf, np.float32)
    return code, upper, lower


def hamerly(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """code, upper and lower of one part of many vectors after its entries moved, and which were scanned in full."""
    upper = _up((upper.astype(np.float64) + own[code]) * (1 + _SLACK))
    lower = _down(np.maximum(lower.astype(np.float64) - others[code], 0.0) * (1 - _SLACK))
    code = code.copy()
    open_ = np.flatnonzero(~(upper < lower))
    if len(open_):
        apart = x[open_] - entries[code[open_]]
        upper[open_] = _up(np.sqrt((apart**2).sum(1).astype(np.float64)) * (1 + _SLACK))
        open_ = open_[~(upper[open_] < lower[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scanned(x[open_], entries)
    return code, upper, lower, open_


STATE = "key long, label string, x binary, codes binary, upper binary, lower binary, scans long, part int, entry int, n long, sums array<long>"
_SCHEMA = pa.schema([("key", pa.int64()), ("label", pa.string()), ("x", pa.binary()), ("codes", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scans", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_ROWS = 4096


def _round(state: DataFrame, books: np.ndarray, last: np.ndarray | None) -> DataFrame:
    """The state after an assignment to books (part, entry, component), last being the books of the one before (None: there was none)."""
    parts, k, width = books.shape
    own, others = moves(last, books) if last is not None else (None, None)

    def filled(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _SCHEMA], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(low, _ROWS)
                x = unpacked(batch.column("x"), parts * width).reshape(-1, parts, width)
                codes = np.zeros((len(x), parts), np.int64)
                upper, lower = np.zeros((len(x), parts), np.float32), np.zeros((len(x), parts), np.float32)
                scans = np.full(len(x), parts, np.int64)
                if last is not None:
                    codes = utf8(batch.column("codes"))[0].reshape(-1, parts).astype(np.int64)
                    upper, lower = (utf8(batch.column(c))[0].view("<f4").reshape(-1, parts).copy() for c in ("upper", "lower"))
                    scans = batch.column("scans").to_numpy(zero_copy_only=False).copy()
                for p in range(parts):
                    if last is None:
                        codes[:, p], upper[:, p], lower[:, p] = scanned(x[:, p], books[p])
                    else:
                        codes[:, p], upper[:, p], lower[:, p], full = hamerly(x[:, p], books[p], codes[:, p], upper[:, p], lower[:, p], own[p], others[p])
                        scans[full] += 1
                    n[p] += np.bincount(codes[:, p], minlength=k)
                    for j in range(width):  # sums of less than 2 ** 53, exact
                        sums[p, :, j] += np.bincount(codes[:, p], x[:, p, j], k).astype(np.int64)
                yield filled(len(x), key=batch.column("key"), label=batch.column("label"), x=batch.column("x"), codes=binary(codes.astype(np.uint8)), upper=binary(upper.astype("<f4")), lower=binary(lower.astype("<f4")), scans=pa.array(scans))
        at = np.argwhere(n > 0)
        yield filled(len(at), part=pa.array(at[:, 0], pa.int32()), entry=pa.array(at[:, 1], pa.int32()), n=pa.array(n[n > 0]), sums=pa.array(sums[n > 0].tolist(), pa.list_(pa.int64())))

    columns = ["key", "label", "x"] + (["codes", "upper", "lower", "scans"] if last is not None else [])
    return state.select(*columns).mapInArrow(run, STATE)


def fit_codes(vectors: DataFrame, key: str, column: str, label: str, *, scale: int = 256, dim: int = 64, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """The state (key, label, x, codes, scans: parts scanned in full) after so many rounds and a last assignment, and the codebooks."""
    if dim % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide dim, and an index must fit in a byte")
    kept = kept_vectors(vectors, key, column, scale, dim, label=label)
    first = [r["x"] for r in kept.filter("key is not null").orderBy("key", "x").limit(entries).select("x").collect()]
    if not first:
        return kept.filter(F.lit(False)).withColumns({"codes": F.lit(None).cast("binary"), "scans": F.lit(0).cast("long")}), np.zeros((parts, 0, dim // parts), np.int64)
    books = unpacked(pa.array(first, pa.binary()), dim).reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    tables, state, last = Rounds("hamerly"), kept, None
    for left in range(rounds, -1, -1):
        table = tables.write(_round(state, books, last))
        state = table.filter("part is null")
        if left:
            last, books = books, books.copy()
            for (p, e), n, sums in summed(table.filter("part is not null"), ["part", "entry"], dim // parts):
                books[p, e] = [s // n for s in sums]
    return state, books


def code_report(vectors: DataFrame, key: str, column: str, label: str, **how: object) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of each kept vector."""
    state, books = fit_codes(vectors, key, column, label, **how)
    parts, _, width = books.shape
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = utf8(batch.column("codes"))[0].reshape(-1, parts)
            nearest = np.concatenate([books[p][codes[:, p]] for p in range(parts)], axis=1)
            error = ((unpacked(batch.column("x"), parts * width) - nearest) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    coded = state.select("key", "label", "x", "codes").mapInArrow(run, "key long, label string, code string, error long")
    coded = written(coded.withColumns({"no_label": F.col("label").isNull(), "label": F.coalesce("label", F.lit(""))}), "codes")
    labels = coded.groupBy("label", "no_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = join_spread(coded, labels, ["label", "no_label"], "n", ["key", "code"])
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
