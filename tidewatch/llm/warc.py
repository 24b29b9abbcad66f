"""WARC archives: a writer, and a Spark data source that reads them.

Archives are gzip files of one member per record. Each member's header carries an 'sl' extra field (compressed and
uncompressed length, as in the annex of the WARC standard), so a reader steps from record to record without inflating
what it does not want. The source plans partitions from whole files and, within large ones, from runs of records; it
takes record types and header values pushed down as filters, inflates a record's headers first, and inflates the rest of
the member only where the record is wanted and its payload is asked for.

Equal payloads of at least min_bytes are written once: the record with the largest id is the response, the others are
revisits that refer to it and keep the digest and length of the full payload in their headers.

Defined results: a null payload is empty; null ids come as an empty id in headers and as null rows; rows repeat as they
come (of equal ids with equal payloads one is the response, and the others are responses too); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

_MEMBER = struct.Struct("<10sH2sHII")  # gzip header, extra length, "sl", 8, compressed length, uncompressed length
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
_PROBE = 1024
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, n_read long, read_digest string, payload binary"
#: Columns that a filter may be pushed down on, by header.
PUSHED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI"}


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URL, and the path in it; plain paths and file: are local."""
    if url.startswith("file:") or "://" not in url:
        return pafs.LocalFileSystem(), unquote(urlparse(url).path) if url.startswith("file:") else url
    return pafs.FileSystem.from_uri(url)


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that tells its lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(_HEAD, 12, b"sl", 8, total, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """The bytes of a WARC record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Full-Payload-Length: {length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, record_type, refers_to of each row of pages."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("html"))
    hashed = hashed.withColumns({"payload_digest": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})
    # digests that occur once need no partner; the sums are small and need no text
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), body.alias("html")).filter(F.octet_length("html") >= min_bytes)
    twice = narrow.groupBy(F.sha1(F.col("html").cast("binary")).alias("payload_digest")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = hashed.join(twice, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition of planned (see plan_records) into folder; returns file, n_records, n_bytes.

    A file appears under its name only when it is whole, so an attempt that is lost leaves nothing that readers see.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft = f"{root}/_{name}.{uuid.uuid4().hex}"
        n = size = 0
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    html = row["html"].encode("utf-8")
                    page = "" if row["page_id"] is None else str(row["page_id"])
                    refers = None if row["refers_to"] is None else str(row["refers_to"])
                    packed = member(record(row["record_type"], page, _one_line(row["url"]), row["payload_digest"], row["payload_bytes"], b"" if row["record_type"] == "revisit" else html, refers))
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
        if n:
            fs.move(draft, f"{root}/{name}")
        else:
            fs.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["file", "n_records", "n_bytes"])

    return planned.mapInArrow(run, "file string, n_records long, n_bytes long")


def _one_line(text: str) -> str:
    return " ".join(text.splitlines()) if "\n" in text or "\r" in text else text


@dataclass
class FilePart(InputPartition):
    path: str
    begin: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower()  # true: give it; digest: only its digest and length; false: skip it
        self.part_bytes = int(options.get("partbytes", 64 << 20))
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.append((f.attribute[0], values))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".warc.gz") and not f.base_name.startswith(("_", ".")))
        return [FilePart(path, begin, min(size, begin + self.part_bytes)) for path, size in files for begin in range(0, size, self.part_bytes)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        fs, _ = filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(partition.path) as f:
            at = 0 if partition.begin == 0 else _next_member(f, partition.begin)
            # a part has the records that begin in it
            while 0 <= at < partition.end:
                f.seek(at)
                probe = f.read(_PROBE)
                head, _, mark, _, total, length = _MEMBER.unpack_from(probe)
                if head != _HEAD or mark != b"sl":
                    raise ValueError(f"{partition.path}: no record at {at}")
                row = self._row(f, at, probe, total, length)
                at += total
                if row is not None:
                    rows.append(row)
                    held += length
                    if len(rows) >= 1000 or held >= 16 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _row(self, f: pa.NativeFile, at: int, probe: bytes, total: int, length: int) -> tuple | None:
        packed = probe[_MEMBER.size : total]
        unpack = zlib.decompressobj(-15)
        text = unpack.decompress(packed, 4096)
        while (end := text.find(b"\r\n\r\n")) < 0:
            more = unpack.decompress(unpack.unconsumed_tail, 4096) if unpack.unconsumed_tail else b""
            if not more:
                if len(packed) >= total - _MEMBER.size - 8:
                    raise ValueError("a record without an end of its headers")
                f.seek(at + _MEMBER.size)
                packed = f.read(total - _MEMBER.size)
                unpack = zlib.decompressobj(-15)
                more, text = unpack.decompress(packed, 1 << 16), b""
            text += more
        headers = dict(line.partition(": ")[::2] for line in text[:end].decode("utf-8").split("\r\n")[1:])
        values = {c: _plain(headers.get(h)) for c, h in PUSHED.items()}
        if any(values[c] not in allowed for c, allowed in self.wanted):
            return None
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        payload = n_read = read_digest = None
        if self.payload != "false":
            if len(packed) < total - _MEMBER.size:
                f.seek(at + _MEMBER.size)
                packed = f.read(total - _MEMBER.size)
            whole = zlib.decompress(packed[:-8], -15)
            if len(whole) != length or zlib.crc32(whole) != struct.unpack("<I", packed[-8:-4])[0]:
                raise ValueError("a damaged record")
            n_read = int(headers["Content-Length"])
            body = whole[end + 4 : end + 4 + n_read]
            read_digest = hashlib.sha1(body).hexdigest()
            payload = body if self.payload == "true" else None
        return values["record_id"], values["record_type"], values["target_uri"], _plain(headers.get("WARC-Refers-To")), digest, int(headers["X-Full-Payload-Length"]), n_read, read_digest, payload

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, self.columns)


def _plain(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<urn:page:").removesuffix(">") if value.startswith("<urn:page:") else value


def _next_member(f: pa.NativeFile, begin: int) -> int:
    """Where the first record at or after begin is; -1 if there is none. What looks like one must lead to another, or to the end."""
    size, mark = f.size(), _HEAD + struct.pack("<H2sH", 12, b"sl", 8)
    at = begin
    while at < size:
        f.seek(at)
        chunk = f.read((1 << 20) + len(mark))
        found = chunk.find(mark)
        if found < 0:
            at += 1 << 20
            continue
        place = at + found
        f.seek(place)
        total = _MEMBER.unpack(f.read(_MEMBER.size))[4]
        f.seek(min(size, place + total))
        if place + total == size or f.read(len(mark)) == mark:
            return place
        at = place + 1
    return -1


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "true" | "digest" | "false").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


def read_archives(spark: SparkSession, folder: str, payload: str = "true") -> DataFrame:
    """The records of a folder's archives. Load anew for each query: Spark 4.1 keeps the filters that one query pushed
    down with the loaded relation, and a later query without filters on the same DataFrame would read with them."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(folder)


def archive_report(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of each record read back."""
    read = read_archives(spark, folder, "digest")
    intact = F.when(F.col("record_type") == "response", (F.col("n_read") == F.col("payload_length")) & (F.col("read_digest") == F.col("payload_digest"))).otherwise(F.col("n_read") == 0)
    page = F.when(F.col("record_id") != "", F.col("record_id")).cast("long")
    return read.select(page.alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), intact.alias("intact"))
