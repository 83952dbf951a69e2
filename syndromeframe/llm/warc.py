"""WARC archives: written by Spark, read back by byte ranges with a verified chain of record boundaries.

Magic bytes also occur inside payloads, so a block of a file can't tell by itself where its records begin.
Each task emits, for every place in its block that parses as a record header, that offset and the offset of
the record that would follow. Within a block chains are contracted to the first offset behind the block;
across blocks pointer jumping from offset zero of every file doubles its reach in each round. What it reaches
are the true entries of the blocks, from which the records are read; all other candidates are rejected.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 8 << 20
#: Tasks of a scan over all blocks; more blocks share them.
MOST_TASKS = 20_000
#: Payloads of fewer bytes are never replaced by a revisit record.
MIN_REVISIT = 1000
#: Groups of equal payloads up to this number are broadcast (72 bytes each); beyond it they are joined by shuffle.
BROADCAST_GROUPS = 100_000
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def _header(kind, pairs):
    """A record header with the block that follows as the last of `pairs`, as one string column."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n")]
    lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit("")) for name, value in pairs]
    return F.concat(*lines, F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(value): the text of one WARC record per row, without the closing blank lines.

    Of equal payloads of MIN_REVISIT bytes or more the row with the largest page_id becomes a response and the
    others revisits of it; rows that repeat this page_id are all responses. A null html is an empty payload;
    rows with a null page_id are responses without an id, and none revisits them.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("n"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    groups = common.stored(rows.filter((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first"), "warc-groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    r = rows.join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    page = F.col("page_id").cast("string")
    uri = F.when(F.col("url").isNotNull(), F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20"))

    def record_id(x):
        h = F.md5(F.concat(F.lit("page:"), F.coalesce(x, F.lit("null"))))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    both = [("WARC-Record-ID", record_id(page)), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("X-Page-Id", page)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    response = F.concat(_header("response", [*both, ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", (F.octet_length(http) + F.col("n")).cast("string"))]), http, F.col("html"))
    again = _header(
        "revisit",
        [*both, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", record_id(F.col("first").cast("string"))), ("X-Refers-To-Page", F.col("first").cast("string")), ("X-Payload-Length", F.col("n").cast("string")), ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", F.lit("0"))],
    )
    return r.select(F.when(revisit, again).otherwise(response).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """One uncompressed archive per partition; the line separator is the end of a record."""
    records(pages).write.option("lineSep", _END.decode()).text(folder)


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def blocks(spark, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, start, stop, size): the byte ranges of all archives of a folder; empty files have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size")).filter("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(block_bytes).cast("bigint")))
    return files.select("path", "size", starts.alias("start")).select("path", "start", F.least(F.col("start") + block_bytes, "size").alias("stop"), "size")


class Headers:
    """Record headers at ascending places of some bytes: what a search has passed is never searched again.

    Magic inside a payload may be followed by no blank line and no length for long; their next places are kept.
    """

    def __init__(self, data: bytes):
        self.grow(data)

    def grow(self, data: bytes) -> None:
        """Goes on with more bytes behind the same ones."""
        self.data, self.end, self.length = data, None, None

    def at(self, at: int) -> tuple[int, int] | None:
        """(start of the block, its length) of the header at `at`; None if it isn't one; (-1, -1) if data ends within it."""
        if not _MAGIC.match(self.data, at):
            return None
        if self.end is None or 0 <= self.end < at:
            self.end = self.data.find(_END, at)
        if self.end < 0:
            return -1, -1
        if self.length is None or (self.length and self.length.start() < at):
            self.length = _LENGTH.search(self.data, at) or False
        m = self.length
        return (self.end + 4, int(m[1])) if m and m.end() <= self.end + 2 else None


def candidates(f, start: int, stop: int, size: int) -> list[tuple[int, int]]:
    """(offset, successor) of every parsable header that begins in the block [start, stop)."""
    data = f.read_at(min(stop + (64 << 10), size) - start, start)
    headers, found = Headers(data), []
    for m in _MAGIC.finditer(data):
        at = m.start()
        if start + at >= stop:
            break
        got = headers.at(at)
        if got == (-1, -1) and start + len(data) < size:  # a header that goes on: read further
            extra = 1 << 20
            while got == (-1, -1) and start + len(data) < size:
                data += f.read_at(min(extra, size - start - len(data)), start + len(data))
                extra *= 2
                headers.grow(data)
                got = headers.at(at)
        if got and got != (-1, -1) and (after := start + got[0] + got[1] + len(_END)) <= size:
            found.append((start + at, after))
    # finditer has walked the data as first read; magic across its end belongs to the next block
    return found


def contract(found: list[tuple[int, int]], stop: int) -> list[tuple[int, int, int]]:
    """(offset, successor, exit): exit is the first offset of the chain at or behind stop, or -1 for a broken chain."""
    out: dict[int, int] = {}
    for offset, after in reversed(found):
        out[offset] = after if after >= stop else out.get(after, -1)
    return [(offset, after, out[offset]) for offset, after in found]


def _scan(batches):
    for batch in batches:
        for path, start, stop, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            with _open(path) as f:
                rows = contract(candidates(f, start, stop, size), stop)
            if rows:
                offset, after, leave = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([start] * len(rows)), pa.array([stop] * len(rows)), pa.array([size] * len(rows)), pa.array(offset), pa.array(after), pa.array(leave)], ["path", "start", "stop", "size", "offset", "next", "exit"])


def chain(found: DataFrame, most_blocks: int) -> DataFrame:
    """(path, offset): the candidates that pointer jumping over block exits reaches from each file's start.

    A round adds what the pointers of the reached offsets hit and doubles every pointer, so that
    log2(blocks of a file) rounds suffice. Only offsets that some block exits to take part.
    """
    exits = found.filter("exit >= 0 AND exit < size").select("path", F.col("exit").alias("offset")).distinct()
    heads = found.select("path", "offset", "exit", "size")
    jump = common.stored(heads.join(exits, ["path", "offset"], "left_semi").union(heads.filter("offset = 0")).filter("exit >= 0 AND exit < size").select("path", "offset", F.col("exit").alias("to")).distinct(), "warc-jump")
    reach = found.filter("offset = 0").select("path", "offset").distinct()
    for _ in range(max(1, math.ceil(math.log2(max(most_blocks, 2))) + 1)):
        reach = common.stored(reach.union(reach.join(jump, ["path", "offset"]).select("path", F.col("to").alias("offset"))).distinct(), "warc-reach")
        second = jump.select("path", F.col("offset").alias("to"), F.col("to").alias("further"))
        jump = common.stored(jump.join(second, ["path", "to"]).select("path", "offset", F.col("further").alias("to")), "warc-jump")
    return reach.join(found.select("path", "offset", "start", "stop", "size").distinct(), ["path", "offset"])


_RECORD = "path string, offset bigint, headers map<string,string>, payload binary"


def _read(batches):
    for batch in batches:
        for path, offset, stop, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            with _open(path) as f:
                at, rows, held = offset, [], 0
                data, base = f.read_at(min(stop + (64 << 10), size) - at, at), at
                headers = Headers(data)
                while at < stop:
                    got = headers.at(at - base)
                    while got == (-1, -1) or (got and base + got[0] + got[1] > base + len(data)):
                        if base + len(data) >= size:
                            got = None
                            break
                        need = got[0] + got[1] - len(data) if got[0] > 0 else 1 << 20
                        data += f.read_at(min(max(need, 1 << 16), size - base - len(data)), base + len(data))
                        headers.grow(data)
                        got = headers.at(at - base)
                    if not got:
                        break  # the chain ends in a truncated record
                    lines = data[at - base : got[0] - 4].decode("utf-8", "replace").split("\r\n")[1:]
                    pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
                    body = data[got[0] : got[0] + got[1]]
                    if dict(pairs).get("Content-Type", "").startswith("application/http"):
                        body = body.partition(_END)[2]
                    rows.append((path, at, pairs, body))
                    held += len(body)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                    at = base + got[0] + got[1] + len(_END)
                if rows:
                    yield _batch(rows)


def _batch(rows):
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.map_(pa.string(), pa.string())), pa.array(cols[3], pa.binary())], ["path", "offset", "headers", "payload"])


def read(spark, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, offset, headers, payload) of the records of all archives in a folder, boundaries verified.

    A file whose first bytes are no record yields nothing; a chain that breaks ends at its last whole record.
    """
    ranges = blocks(spark, folder, block_bytes)
    per_file = ranges.groupBy("path").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("blocks")).first()
    most, tasks = per_file.most or 0, max(1, min(per_file.blocks or 1, MOST_TASKS))
    # A row is a few bytes but stands for a whole block to read: the number of tasks follows the blocks.
    found = common.stored(ranges.repartition(tasks, F.xxhash64("path", "start")).mapInArrow(_scan, "path string, start bigint, stop bigint, size bigint, offset bigint, next bigint, exit bigint"), "warc-candidates")
    entries = common.stored(chain(found, most), "warc-entries")
    return entries.select("path", "offset", "stop", "size").repartition(tasks, F.xxhash64("path", "offset")).mapInArrow(_read, _RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; an empty table gives no row."""
    folder = common.new_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), folder)
    h = F.col("headers")
    revisit = h["WARC-Type"] == "revisit"
    return read(spark, folder).select(
        h["X-Page-Id"].cast("bigint").alias("page_id"),
        F.when(revisit, h["X-Payload-Length"].cast("bigint")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(h["WARC-Payload-Digest"], ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        h["WARC-Type"].alias("record_type"),
        F.when(revisit, h["X-Refers-To-Page"].cast("bigint")).alias("refers_to"),
    )


ORACLE_SQL = f"""
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= {MIN_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= {MIN_REVISIT} AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
