"""Media columns: payloads stored as images in archives, read by byte ranges through a Spark data source.

Writing: each task streams its payloads into archives (ZIP files whose members are stored as they are) in the
shared folder; a member is an 8-bit grey PNG, 576 samples wide. The driver's commit writes a manifest of the
archives of successful tasks only, so what a lost task attempt wrote is never read.

Reading: the source named `media_archive` plans partitions of about `range_bytes` bytes over the archives' sizes,
which is all that the driver sees of them. A task reads its archive's directory, takes the members that begin in its
range and streams their payloads as Arrow batches. A member that fails its size or checksum is read again by its
own offset, up to `retries` times, without touching its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

WIDTH = 576
#: A new archive is begun beyond this size or number of members (a ZIP directory without extensions holds 65,535).
ARCHIVE_BYTES = 64 << 20
ARCHIVE_MEMBERS = 60_000
#: Payload bytes in one Arrow batch; one larger payload is a batch of its own.
BATCH_BYTES = 4 << 20
#: Partitions that a scan is planned in at most; beyond it ranges grow, up to whole archives.
MOST_RANGES = 100_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of WIDTH."""
    return data + b"\xff" * ((-len(data) % WIDTH) if data else WIDTH)


def to_png(payload: bytes, level: int = 5) -> bytes:
    """payload (a multiple of WIDTH bytes) as an 8-bit grey image, one byte a sample."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png wrote; ValueError if it is damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], (0, 0)
    while at + 12 <= len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 brightness bits of an 8 x 8 grid over the samples (1: above the mean), and their mean and deviation."""
    x = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"{bits}-{x.mean():.3f}-{x.std():.3f}"


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


class _Archive:
    """A ZIP file written forward only, its members stored without compression."""

    def __init__(self, folder: str):
        self.path = f"{folder}/media-{uuid.uuid4().hex}.zip"
        fs, inner = _open(self.path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out, self.size, self.entries = fs.open_output_stream(inner), 0, []

    def add(self, name: str, extra: bytes, body: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(body)
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0x800, 0, 0, 0x21, crc, len(body), len(body), len(raw), 0) + raw
        self.entries.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 0x800, 0, 0, 0x21, crc, len(body), len(body), len(raw), 0, len(extra), 0, 0, 0, self.size) + raw + extra)
        self.out.write(local + body)
        self.size += len(local) + len(body)

    def close(self) -> dict:
        directory = b"".join(self.entries)
        end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(self.entries), len(self.entries), len(directory), self.size, 0)
        self.out.write(directory + end)
        self.out.close()
        return {"path": self.path, "bytes": self.size + len(directory) + len(end), "members": len(self.entries)}


class _Written(WriterCommitMessage):
    def __init__(self, archives: list[dict]):
        self.archives = archives


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (doc_id bigint, payload binary) into archives; a payload's length must be a multiple of WIDTH."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done, now = [], None
        for batch in iterator:
            for doc_id, payload in zip(batch.column("doc_id"), batch.column("payload"), strict=True):
                if now is None:
                    now = _Archive(self.folder)
                # The member's comment keeps the id, and its name an order within the archive.
                now.add(f"{len(now.entries):06d}.png", str(doc_id.as_py()).encode(), to_png(payload.as_py()))
                if now.size > ARCHIVE_BYTES or len(now.entries) >= ARCHIVE_MEMBERS:
                    done, now = [*done, now.close()], None
        return _Written(done if now is None else [*done, now.close()])

    def commit(self, messages: list) -> None:
        fs, inner = _open(f"{self.folder}/_manifest.json")
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(json.dumps([a for m in messages if m is not None for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            for a in m.archives if m is not None else ():
                fs, inner = _open(a["path"])
                fs.delete_file(inner)


class Range(InputPartition):
    """The members of an archive of `size` bytes whose headers begin in [start, stop)."""

    def __init__(self, path: str, size: int, start: int, stop: int):
        self.path, self.size, self.start, self.stop = path, size, start, stop


def directory(path: str, size: int) -> list[tuple]:
    """(doc_id, offset of the header, its length, length and crc of the body) of each member, from a ZIP file's directory."""
    fs, inner = _open(path)
    with fs.open_input_file(inner) as f:
        _, _, _, n, _, length, start, _ = struct.unpack("<IHHHHIIH", f.read_at(22, size - 22))
        raw, at, found = f.read_at(length, start), 0, []
    for _ in range(n):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        crc, body, name, extra, comment, offset = fields[7], fields[8], fields[10], fields[11], fields[12], fields[16]
        ident = raw[at + 46 + name + extra : at + 46 + name + extra + comment].decode()
        found.append((None if ident == "None" else int(ident), offset, 30 + name, body, crc))
        at += 46 + name + extra + comment
    return found


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, retries: int):
        self.folder, self.range_bytes, self.retries = folder, range_bytes, retries

    def partitions(self) -> list[Range]:
        fs, inner = _open(f"{self.folder}/_manifest.json")
        with fs.open_input_stream(inner) as f:
            archives = json.loads(f.read())
        step = max(self.range_bytes, -(-sum(a["bytes"] for a in archives) // MOST_RANGES))
        found = [Range(a["path"], a["bytes"], at, min(at + step, a["bytes"])) for a in archives for at in range(0, a["bytes"], step)]
        return found or [Range("", 0, 0, 0)]

    def _members(self, partition: Range) -> list[tuple]:
        """Directory entries in the partition's range; the directory is read again, too, if that fails."""
        for attempt in range(self.retries + 1):
            try:
                return [m for m in directory(partition.path, partition.size) if partition.start <= m[1] < partition.stop] if partition.size else []
            except (OSError, ValueError, struct.error):
                if attempt == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        handle = None
        for doc_id, offset, skip, length, crc in self._members(partition):
            for attempt in range(self.retries + 1):
                try:
                    if handle is None:
                        fs, inner = _open(partition.path)
                        handle = fs.open_input_file(inner)
                    body = handle.read_at(length, offset + skip)
                    if len(body) != length or zlib.crc32(body) != crc:
                        raise OSError(f"member at {offset} of {partition.path} is damaged")
                    payload = from_png(body)
                    break
                except (OSError, ValueError, zlib.error):
                    handle = None
                    if attempt == self.retries:
                        raise
                    time.sleep(0.1 * 2**attempt)
            rows.append((doc_id, partition.path, offset, body, payload))
            size += len(payload) + length
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class MediaArchive(DataSource):
    """Options: path, range_bytes (default 8 MiB), retries (default 3)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id bigint, archive string, offset bigint, media binary, payload binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 8 << 20)), int(self.options.get("retries", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, payload): the text in UTF-8 (null: empty) with bytes 255 up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return docs.select("doc_id", F.concat(raw, F.unhex(F.repeat(F.lit("FF"), pad))).alias("payload"))


def store(docs: DataFrame, folder: str) -> None:
    """Write every row's payload into archives of a folder. Null and empty texts are one padded line; null ids stay
    null, repeated rows are members each, other columns are ignored; an empty table writes an empty manifest."""
    spark = docs.sparkSession
    common.small_batches(spark)
    spark.dataSource.register(MediaArchive)
    payloads(docs).write.format("media_archive").option("path", folder).mode("append").save()


def load(spark, folder: str, **options) -> DataFrame:
    """(doc_id, archive, offset, media, payload) of every stored member."""
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


_DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digest(batches):
    for batch in batches:
        media, payload = batch.column("media").to_pylist(), batch.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                # Byte 255 never occurs in UTF-8, so the unpadded length shows in the payload itself.
                pa.array([len(p.rstrip(b"\xff")) for p in payload], pa.int64()),
                pa.array([len(p) for p in payload], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
                pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array([feature(p) for p in payload]),
            ],
            names=[x.split()[0] for x in _DIGEST.split(", ")],
        )


def query(spark, sf_dir: str) -> DataFrame:
    """Every text of documents stored, read back and digested; null ids stay null, an empty table gives no row."""
    folder = common.new_path(spark, "media")
    store(common.table(spark, sf_dir, "documents"), folder)
    return load(spark, folder).mapInArrow(_digest, _DIGEST)
