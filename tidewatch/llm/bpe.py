"""BPE encoding and decoding by backtracking.

An Aho-Corasick automaton finds all vocabulary tokens in a piece of text; the longest at each place is tried first. A
token may follow another only if the two, side by side, are what the merges leave of their joined bytes (the
pair-compatibility table, filled as pairs turn up). A dead end shortens the last token or drops it, and no place is left
twice in vain, so the work is linear in the piece. The result equals applying merges in rank order. Decoding copies
token bytes through a table of offsets.

Texts are cut first where the pre-tokenizer always cuts (before the white space that leads a word), the distinct cuts of
a batch are encoded once, and their ids are joined again by array operations.

Defined results: null and empty texts have no ids and decode to the empty text; rows repeat as they come; other columns
of the input may have any name. The strings of special tokens inside texts become those tokens, as the library does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Ragged, at, pieces, ragged, slices, utf8

#: Unicode's white space beyond ASCII, in UTF-8.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Texts encoded together, in bytes: what a worker holds for a slice is some 25 times as much.
_BATCH_BYTES = 1 << 20
_KEPT, _KEPT_BYTES = 1 << 17, 80 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, file: str):
        import ahocorasick
        import regex

        with open(file, encoding="utf-8") as f:
            model = json.load(f)
        byte_of = _byte_alphabet()
        raw = {i: bytes(byte_of[c] for c in token) for token, i in model["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*raw, *special.values()]) + 1
        self.token = [raw.get(i, b"") for i in range(size)]
        for text, i in special.items():
            self.token[i] = text.encode()
        self.special = {text.encode(): i for text, i in special.items()}
        ids = {b: i for i, b in raw.items()}
        self.merge, self.left, self.right = {}, list(range(size)), list(range(size))
        self.rank = [-1] * size
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids[bytes(byte_of[c] for c in a)], ids[bytes(byte_of[c] for c in b)]
            made = ids[self.token[a] + self.token[b]]
            self.merge[a, b] = rank
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        # a token that its own merges do not leave whole is never an answer
        self.automaton = ahocorasick.Automaton()
        for i, b in raw.items():
            if len(b) == 1 or self.rank[i] >= 0:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.single = {b: i for b, i in ids.items() if len(b) == 1}
        self.ids = {b: i for b, i in ids.items() if len(b) == 1 or self.rank[i] >= 0}
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.marks = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if special else None
        sizes = np.array([len(b) for b in self.token], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.table = np.frombuffer(b"".join(self.token), np.uint8)
        self.kept = Ragged(_KEPT_BYTES)

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of token, or -1."""
        if token not in self.shorter:
            b, found = self.token[token], -1
            for n in range(len(b) - 1, 0, -1):
                if (found := self.ids.get(b[:n], -1)) >= 0:
                    break
            self.shorter[token] = found
        return self.shorter[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side when given their joined bytes."""
        key = a * len(self.token) + b
        if key in self.compatible:
            return self.compatible[key]
        # undo the merges of either side, latest first; a merge across the border that would have come earlier breaks the pair
        limit, rank, ok = float("inf"), self.rank, True
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < limit:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                # the right part of a came to be before rank ra: the border merge had to wait for it
                limit, a = ra, self.right[a]
            else:
                # of equal ranks the left one is merged first, hence the border may still win at this rank
                limit, b = rb + 1 if ra == rb else rb + 0.5, self.left[b]
        if len(self.compatible) >= _KEPT:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a piece that the pre-tokenizer does not cut."""
        whole = self.ids.get(piece)
        if whole is not None and len(piece) <= 2:
            return [whole]
        # the automaton's own pairs, one pointer for each byte: a piece may be a whole long line
        longest: list[tuple[int, int] | None] = [None] * len(piece)
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            begin = end - found[0] + 1
            if longest[begin] is None or longest[begin][0] < found[0]:
                longest[begin] = found
        out: list[int] = []
        dead = set()
        place, trial = 0, longest[0][1]
        while True:
            while trial >= 0:
                stop = place + len(self.token[trial])
                if stop not in dead and (not out or self.may_follow(out[-1], trial)):
                    break
                trial = self.prefix(trial)
            if trial >= 0:
                out.append(trial)
                place = stop
                if place == len(piece):
                    return out
                trial = longest[place][1]
            else:
                dead.add(place)
                trial = out.pop()
                place -= len(self.token[trial])
                trial = self.prefix(trial)

    def encode_cuts(self, cuts: list[bytes]) -> list[list[int]]:
        """Ids of cuts: words with the space before them, or runs of white space."""
        out = []
        for cut in cuts:
            ids: list[int] = []
            for piece in self.cut.findall(cut.decode("utf-8")):
                ids += self.encode_piece(piece.encode("utf-8"))
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        flat, bounds = self.encode_batch(*utf8(pa.array([text])))
        return flat[bounds[0] : bounds[1]].tolist()

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch, and where each text's ids begin."""
        segments, special_at, special_id = self._segments(data, offsets)
        starts = _cuts(data, segments)
        forced = None
        if len(special_at):
            forced = np.isin(starts, special_at)
        codes, distinct = pieces(data, starts)
        flat, begins, where = self.kept.rows(distinct, self.encode_cuts)
        codes = where[codes] if len(codes) else codes
        if len(special_at):
            # an occurrence of a special token is a cut of its own, whatever the same bytes encode to
            forced = np.isin(starts, special_at)
            codes[forced] = len(begins) - 1 + np.searchsorted(special_at, starts[forced])
            flat, begins = np.concatenate([flat, np.array(special_id, np.uint32)]), np.concatenate([begins, begins[-1] + 1 + np.arange(len(special_id))])
        flat, ends = ragged(flat, begins, codes)
        return flat, at(ends, np.searchsorted(starts, offsets))

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Places where a text or a stretch between special tokens begins; the special tokens' places and ids."""
        if self.marks is None or not len(data):
            return offsets[:-1], np.zeros(0, np.int64), []
        found = [(m.start(), m.end(), self.special[m.group()]) for m in self.marks.finditer(data.tobytes())]
        if found:
            text = np.searchsorted(offsets, [f[0] for f in found], "right")
            found = [f for f, t in zip(found, text, strict=True) if f[1] <= offsets[t]]
        places = np.array([f[0] for f in found], np.int64)
        bounds = np.unique(np.concatenate([offsets[:-1], places, np.array([f[1] for f in found], np.int64)]))
        return bounds, places, [f[2] for f in found]

    def decode(self, ids: np.ndarray) -> bytes:
        flat, _ = ragged(self.table, self.offsets, np.asarray(ids, np.int64))
        return flat.tobytes().decode("utf-8", "replace").encode("utf-8")


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer always cuts: a word takes one space before it; a run of white space leaves its last character."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(n, bool)  # of a character
    first[:] = (data & 0xC0) != 0x80
    # white space outside ASCII: its bytes all count as white space, its first as a character
    if (data >= 0xC2).any():
        raw = data.tobytes()
        for s in _WIDE_SPACES:
            at_ = raw.find(s)
            while at_ >= 0:
                space[at_ : at_ + len(s)] = True
                at_ = raw.find(s, at_ + len(s))
    edge = np.zeros(n + 1, bool)
    edge[bounds[bounds <= n]] = True
    edge[n] = True
    before = np.empty(n, bool)  # the previous byte of the same segment is white space
    before[0], before[1:] = False, space[:-1]
    opened = edge[:n]
    start = opened.copy()
    # a run of white space begins
    start |= space & first & ~before
    # a word begins after white space that is no plain space
    prior = np.empty(n, np.uint8)
    prior[0], prior[1:] = 0, data[:-1]
    start |= ~space & first & before & ~opened & (prior != 32)
    # the last character of a run before a word
    word_next = np.flatnonzero(~space & first & before & ~opened)
    last = word_next - 1
    while len(inner := np.flatnonzero(~first[last])):
        last[inner] -= 1
    start[last] = True
    return np.flatnonzero(start).astype(np.int64)


@lru_cache(maxsize=4)
def codec(file: str) -> Codec:
    return Codec(file)


def encode_documents(docs: DataFrame, file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids; a column that has its name already is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(file)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for low, high in slices(offsets, _BATCH_BYTES):
                flat, bounds = coder.encode_batch(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                part = batch.slice(low, high - low)
                column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), column], [*kept, ids])

    kept = [c for c in docs.columns if c != ids]
    fields = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in docs.dtypes if n != ids)
    return docs.mapInArrow(run, f"{fields}, `{ids}` array<int>")


def recode_documents(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """docs with ids, n_tokens and decoded (the ids turned back into text), in one pass with one set of tables.

    A column of docs that has one of these names goes; keep it under another name to have both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(file)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for low, high in slices(offsets, _BATCH_BYTES):
                flat, bounds = coder.encode_batch(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                part = batch.slice(low, high - low)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                decoded = pa.array([coder.decode(flat[a:b]).decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), ids, pa.array(np.diff(bounds)), decoded], [*kept, *added])

    added = ["ids", "n_tokens", "decoded"]
    kept = [c for c in docs.columns if c not in added]
    fields = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in docs.dtypes if n not in added)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, decoded string")


def decode_documents(encoded: DataFrame, file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with its ids turned back into text."""

    @F.arrow_udf("string")
    def back(column: pa.Array) -> pa.Array:
        coder = codec(file)
        return pa.array([None if row is None else coder.decode(row).decode("utf-8") for row in (r.values.to_numpy(zero_copy_only=False) if r.is_valid else None for r in column)], pa.string())

    return encoded.withColumn(text, back(F.col(ids)))


def round_trip_digests(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, intact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(file)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows: list[tuple] = []
            for low, high in slices(offsets, _BATCH_BYTES):
                flat, bounds = coder.encode_batch(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                flat = flat.astype("<u4")
                for k in range(high - low):
                    own = flat[bounds[k] : bounds[k + 1]]
                    decoded = coder.decode(own)
                    same = decoded == data[offsets[low + k] : offsets[low + k + 1]].tobytes()
                    rows.append((len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), same))
            n, a, b, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "intact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, intact boolean")
