"""WARC archives: written from a table in parallel, and read back by a reader that salvages what it can.

Writing: a payload of at least ``least`` bytes that occurs more than once is kept once, in the record of the greatest id; the
others are revisits that refer to it. Who repeats is found by digests that are counted before their shuffle; the table of
repeated payloads is written to the shared folder, so that Spark broadcasts it if its size is under the session's threshold and
shuffles otherwise. Each task streams its rows into files of bounded size. The list of files is committed as a table by
Spark, so what a lost or repeated attempt has left is never read.

Reading: a file is one task's, read in windows, a record in memory at a time (of a compressed file a member). A record has to
pass all checks: version line, head, length, end mark, and its digests; a member has to inflate with the right checksum. After a failed check the
reader searches for the next place where a member or a version line starts a record that passes, goes on from there, and logs
the bytes in between as a gap with the reason. Records and gaps come as rows of one table; together they cover all bytes.

Defined cases: a null payload is an empty one; a null id is least of all, and written as an empty one; rows that share the greatest
id of equal payloads are all responses; repeated rows are each a record; a null url has no URI line; control characters
and blanks in a url are quoted; a payload of any length is one record; an empty table gives archives without records. Extra columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Callable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.llm import base

#: Bytes after which a task begins another file.
FILE_BYTES = 128 << 20
#: Bytes read at once, and given to the inflater at once.
WINDOW, SIP = 1 << 20, 16 << 10
#: Longest head of a record.
HEAD = 1 << 20
#: Rows and payload bytes after which the reader passes a batch on.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Partitions that files are read in, at most.
READERS = 20_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_ID = r"^<urn:page:(.*)>$"
_END = b"\r\n\r\n"

_ROW = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("inner_start", pa.int64()), ("inner_stop", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()),
    ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
_DDL = "path string, start long, stop long, inner_start long, inner_stop long, reason string, type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; ``file:/x`` is how Hadoop writes ``file:///x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _digest(data: bytes) -> str:
    return f"sha1:{b32encode(sha1(data).digest()).decode()}"


def record_bytes(kind: str, record_id: str, block: bytes, fields: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": _DATE} | fields | {"WARC-Block-Digest": _digest(block), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + _END


def page_record(key: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or a revisit with the response's head alone if it refers to another record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {} if url is None else {"WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)}
    fields |= {"WARC-Payload-Digest": _digest(payload), "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return record_bytes("response", f"<urn:page:{key}>", block + payload, fields)
    return record_bytes("revisit", f"<urn:page:{key}>", block, fields | {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"})


def _compressed(data: bytes) -> bytes:
    """One member of a gzip file."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _written(folder: str, compressed: bool):
    pack = _compressed if compressed else bytes
    info = record_bytes("warcinfo", "<urn:page:info>", b"format: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        name, out, count, size = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for key, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, count = f"{uuid.uuid4().hex}.warc{'.gz' * compressed}", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                    size = out.write(pack(info))
                size += out.write(pack(page_record(key, url, payload, refers_to)))
                count += 1
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write(pages: DataFrame, folder: str, least: int = 1000, compressed: bool = True, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """The archives' committed list: path, records, bytes. ``folder`` is new and shared by driver and executors."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    large = F.octet_length("payload") >= least
    # small payloads repeat nothing, so their keys only have to be spread
    rows = rows.withColumn("key", F.when(large, F.sha2("payload", 256)).otherwise(F.concat(F.lit("id:"), text)))
    repeated = rows.filter(large).groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    repeated.select("key", "first").write.parquet(f"{folder}/_repeated")
    met = rows.join(spark.read.parquet(f"{folder}/_repeated"), "key", "left")
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    met = met.select(text.alias("key"), F.col("url").cast("string"), "payload", refers_to.alias("refers_to"))
    met.mapInArrow(_written(folder, compressed), "path string, records long, bytes long").write.parquet(f"{folder}/_archives")
    return spark.read.parquet(f"{folder}/_archives")


class Failed(Exception):
    """A check that a record did not pass."""


class Source:
    """A file's bytes by position, read in windows."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size
        self.low, self.held = 0, b""

    def at(self, start: int, length: int) -> bytes:
        """The bytes from ``start`` on, fewer at the end of the file."""
        length = max(0, min(length, self.size - start))
        if start < self.low or start + length > self.low + len(self.held):
            self.low, self.held = start, self.handle.read_at(min(max(length, WINDOW), self.size - start), start) if length else b""
        return self.held[start - self.low : start - self.low + length]


Read = Callable[[int, int], bytes]


def _fields(read: Read, at: int) -> tuple[dict[str, str], int]:
    """A record's head, by lower-cased names, and where its block starts."""
    head = read(at, 4096)
    if not _VERSION.match(head):
        raise Failed("no version line")
    stop = head.find(_END)
    if stop < 0:
        head = read(at, HEAD)
        stop = head.find(_END)
        if stop < 0:
            raise Failed("head does not end")
    lines = head[:stop].split(b"\r\n")[1:]
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, at + stop + 4


def _holds(named: str, data: bytes) -> bool:
    """Whether a digest is that of the data; algorithms other than SHA-1 are not looked at."""
    kind, _, value = named.partition(":")
    if kind.lower() != "sha1":
        return True
    own = sha1(data)
    return value.lower() == own.hexdigest() or value.upper() == b32encode(own.digest()).decode()


def _hex(named: str) -> str | None:
    kind, _, value = named.partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return value.lower() if len(value) == 40 else b32decode(value.upper()).hex()
    except ValueError:
        return None


def record_at(read: Read, at: int, size: int) -> tuple[dict, int]:
    """The record that starts at a place, if it passes all checks, and where it ends."""
    fields, begin = _fields(read, at)
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Failed("no length")
    end = begin + int(length)
    if end + 4 > size:
        raise Failed("cut off")
    if read(end, 4) != _END:
        raise Failed("no end mark")
    block = read(begin, end - begin)
    if "warc-block-digest" in fields and not _holds(fields["warc-block-digest"], block):
        raise Failed("block digest")
    kind, payload, named = fields.get("warc-type", ""), block, fields.get("warc-payload-digest")
    http = fields.get("content-type", "").startswith("application/http")
    head, mark, body = block.partition(_END) if http else (b"", b"", block)
    payload = body if mark or not http else block
    if kind == "revisit":
        told = re.search(rb"\r\nContent-Length: *(\d+)", head, re.I)
        payload_bytes, digest, payload = int(told[1]) if told else None, _hex(named or ""), None
    else:
        if named and not _holds(named, payload):
            raise Failed("payload digest")
        payload_bytes, digest = len(payload), sha1(payload).hexdigest()
    found = {"type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    return found | {"payload_bytes": payload_bytes, "payload_digest": digest, "payload": payload}, end + 4


def _inflated(source: Source, at: int) -> tuple[bytes, int]:
    """What a member holds and where it ends."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        chunk = source.at(pos, SIP)
        if not chunk:
            raise Failed("cut off")
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            raise Failed("damaged member") from e
        if pos == at and not b"WARC/1.".startswith(out[0][:7]):
            raise Failed("no version line")
        pos += len(chunk)
    return b"".join(out), pos - len(z.unused_data)


def _in_member(data: bytes) -> list[dict]:
    """The records of an inflated member, and the gaps between them."""

    def read(start: int, length: int) -> bytes:
        return data[start : start + length]

    def unit(at: int) -> tuple[list[dict], int]:
        found, end = record_at(read, at, len(data))
        return [found | {"start": at, "stop": end}], end

    return list(_rows(read, len(data), unit))


def _unit(source: Source, at: int) -> tuple[list[dict], int]:
    """The rows of what starts at a place, a record or a member with at least one, and where it ends."""
    if source.at(at, 3) != b"\x1f\x8b\x08":
        found, end = record_at(source.at, at, source.size)
        return [found | {"start": at, "stop": end}], end
    data, end = _inflated(source, at)
    rows = _in_member(data)
    if all(r.get("reason") for r in rows):
        raise Failed(rows[0]["reason"] if rows else "empty member")
    return [r | {"start": at, "stop": end, "inner_start": r["start"], "inner_stop": r["stop"]} for r in rows], end


def _rows(read: Read, size: int, unit: Callable[[int], tuple[list[dict], int]]) -> Iterator[dict]:
    """All records, and the gaps between them with the reason of the check that failed at their start."""
    at = 0
    while at < size:
        try:
            rows, end = unit(at)
        except Failed as why:
            reason, begin = str(why), at
            for at in _candidates(read, at + 1, size):
                try:
                    rows, end = unit(at)
                    break
                except Failed:
                    continue
            else:
                yield {"start": begin, "stop": size, "reason": reason}
                return
            yield {"start": begin, "stop": at, "reason": reason}
        yield from rows
        at = end


def _candidates(read: Read, at: int, size: int) -> Iterator[int]:
    """The places from ``at`` on where a member or a version line may start."""
    while at < size:
        window = read(at, WINDOW)
        for m in _STARTS.finditer(window):
            yield at + m.start()
        if at + len(window) >= size:
            return
        at += len(window) - 6  # a mark that the window's end cuts


def scan(source: Source) -> Iterator[dict]:
    return _rows(source.at, source.size, lambda at: _unit(source, at))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inside = _store(path)
            with store.open_input_file(inside) as handle:
                for row in scan(Source(handle, handle.size())):
                    held.append(row | {"path": path})
                    size += len(row.get("payload") or b"")
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, _ROW)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _ROW)


def files(spark: SparkSession, folder: str, pattern: str = "*.warc*") -> DataFrame:
    """The paths of archives that others have written."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")


def read(archives: DataFrame) -> DataFrame:
    """Rows of all archives (a table with ``path``): records, whose ``reason`` is null, and gaps.

    ``start`` and ``stop`` are bytes of the file; within a member of several records ``inner_start`` and ``inner_stop`` are
    bytes of what it holds.
    """
    base.prepare(archives.sparkSession)
    readers = max(1, min(READERS, archives.count()))
    return archives.select("path").repartition(readers).mapInArrow(_read, _DDL)


def gaps(rows: DataFrame) -> DataFrame:
    """The log of what no record could be read from."""
    return rows.filter(F.col("reason").isNotNull()).select("path", "start", "stop", "inner_start", "inner_stop", "reason")


def page_id(record_id: Column) -> Column:
    """The id that ``write`` has put into a record's id, as text; empty if it was null."""
    return F.regexp_extract(record_id, _ID, 1)


def resolved(rows: DataFrame) -> DataFrame:
    """Responses and revisits with their payload: a revisit's is that of the record it refers to, null if that is lost."""
    pages = rows.filter(F.col("type").isin("response", "revisit"))
    known = pages.filter("type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("_payload"))
    revisits = pages.filter("type = 'revisit'").drop("payload").join(known, ["refers_to", "payload_digest"], "left").withColumnRenamed("_payload", "payload")
    return pages.filter("type = 'response'").unionByName(revisits)
