"""Legacy web archives (ARC) turned into WARC.

ARC files begin with a version block that names the version, and with it the fields of
every record's header line; a record is that line, then as many bytes as it declares. The
converter reads both versions, and makes what WARC asks for and ARC lacks: record ids
(name-based UUIDs of file and place, so a retried task makes the same), ISO dates, record
types, block and payload digests. Records with equal payloads (SHA-256 and length) of at
least ``REVISIT_FROM`` bytes become revisits of the one with the greatest key.

Tasks write archives of bounded size under names of their own in the shared folder, and
only finished tasks' files reach the table of files. Archives are read as streams: a task
holds one record at a time, and one row for each record of one archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankframe.llm.common import discard, file_system, fresh_path, join_hot, stored, tune

#: Payloads from so many bytes are kept once.
REVISIT_FROM = 1000
#: An archive is closed once its records have so many bytes.
ROLL_BYTES = 32 << 20
#: zlib level of the members; each record is a gzip member of its own.
LEVEL = 1
#: The HTTP header that carries a document's key.
KEY_HEADER = "X-Document-Key"
NO_DATE = "19700101000000"

#: The record definitions of the two versions, and the revisit profile.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADS = {
    1: re.compile(r"(.*?) ([0-9A-Fa-f.:]+|-) (\d{4,14}|-) (.*) (\d+)"),
    2: re.compile(r"(.*?) ([0-9A-Fa-f.:]+|-) (\d{4,14}|-) (.*?) (?:\d+|-) \S+ \S+ (?:\d+|-) \S+ (\d+)"),
}
_KEY = re.compile(rb"(?im)^" + KEY_HEADER.encode() + rb":[ \t]*([+-]?[0-9]+)[ \t]*\r?$")


class Record(NamedTuple):
    """A record of an ARC file; ``at`` is its place in the uncompressed file."""

    at: int
    url: str
    ip: str
    date: str
    kind: str
    body: bytes


class Source:
    """Lines and counted bytes of a file in the shared folder, as a stream."""

    BLOCK = 1 << 18

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.path, self.place, self.buffer, self.at = path, 0, b"", 0
        self.stream = fs.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None)

    def line(self) -> bytes | None:
        """The next line with its end; None at the end of the file."""
        while True:
            end = self.buffer.find(b"\n", self.at)
            block = b"" if end >= 0 else self.stream.read(self.BLOCK)
            if end < 0 and block:
                self.buffer, self.at = self.buffer[self.at :] + block, 0
                continue
            end = end + 1 if end >= 0 else len(self.buffer)
            out = self.buffer[self.at : end]
            self.at = end
            self.place += len(out)
            return out or None

    def take(self, n: int) -> bytes:
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        if len(out) < n:
            parts, have = [out], len(out)
            while have < n and (block := self.stream.read(n - have)):
                parts.append(block)
                have += len(block)
            out, self.buffer, self.at = b"".join(parts), b"", 0
            if have < n:
                raise ValueError(f"{self.path} ends at {self.place + have}, inside a record of {n} bytes")
        self.place += n
        return out


def read_arc(path: str) -> Iterator[Record]:
    """The version block (as a ``filedesc:`` record), then all records of an ARC file."""
    source, version = Source(path), 0
    while (line := source.line()) is not None:
        if not line.strip():
            continue  # lines between records
        at, text = source.place - len(line), line.decode("utf-8", "replace").rstrip("\r\n")
        found = next(filter(None, (_HEADS[v].fullmatch(text) for v in ([version] if version else [2, 1]))), None)
        if found is None:
            raise ValueError(f"no header line of ARC version {version or '1 or 2'} at {at} of {path}")
        body = source.take(int(found[5]))
        if not version:
            first = body.split(b"\n", 1)[0].split()
            if not text.startswith("filedesc:") or not first or first[0] not in (b"1", b"2"):
                raise ValueError(f"{path} doesn't begin with an ARC version block")
            version = int(first[0])
        yield Record(at, *found.group(1, 2, 3, 4), body)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and payload; no header block: all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    ends = [(body.find(mark), len(mark)) for mark in (b"\r\n\r\n", b"\n\n")]
    ends = [i + n for i, n in ends if i >= 0]
    cut = min(ends) if ends else len(body)
    return body[:cut], body[cut:]


def document_key(head: bytes) -> int | None:
    found = _KEY.search(head)
    return int(found[1]) if found else None


def record_id(file: str, at: int) -> str:
    """Name-based UUID of a record's place."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{file.rsplit("/", 1)[-1]}:{at}'.encode()).digest()[:16], version=5)}"


def iso_date(date: str, otherwise: str = NO_DATE) -> str:
    """ISO form of an ARC date of 4 to 14 digits (what lacks is the least); a date that the
    calendar doesn't have gives ``otherwise``."""
    from datetime import datetime

    full = date + "00000101000000"[len(date) :]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return iso_date(otherwise) if otherwise != date else "1970-01-01T00:00:00Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Sink:
    """Archives of a task: gzip members, a new file each ``ROLL_BYTES``."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind, self.out, self.path, self.size = folder, kind, None, "", 0

    def open(self) -> str:
        self.path, self.size = f"{self.folder}/{uuid.uuid4().hex}.{self.kind}.gz", 0
        fs, inner = file_system(self.folder)
        fs.create_dir(inner, recursive=True)
        self.out = fs.open_output_stream(f"{inner}/{self.path.rsplit('/', 1)[-1]}", compression=None)
        return self.path

    def write(self, *parts: bytes) -> None:
        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for part in parts:
            self.out.write(member.compress(part))
            self.size += len(part)
        self.out.write(member.flush())

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


# ---- export: pages as ARC -----------------------------------------------------------------


def arc_head(version: int, url: str, ip: str, date: str, kind: str, length: int, file: str) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    middle = "" if version == 1 else f" 200 - - 0 {file}"
    return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()


def _write_arc(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One row ``file, n`` for each archive written; versions 1 and 2 by turns."""
    sink, version, n = Sink(folder, "arc"), 0, 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([sink.path]), pa.array([n], pa.int64())], ["file", "n"])
    for batch in batches:
        for key, url, html in zip(batch.column(0), batch.column(1), batch.column(2)):
            if sink.out is None:
                version, n, name = 2 if version == 1 else 1, 0, sink.open().rsplit("/", 1)[-1]
                about = f"{version} 0 rankframe\n{FIELDS[version]}\n\n".encode()
                sink.write(arc_head(version, f"filedesc://{name}", "0.0.0.0", NO_DATE, "text/plain", len(about), name), about)
            payload = html.as_buffer() if html.is_valid else b""
            size = len(payload)
            head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n"
            head = (head + (f"{KEY_HEADER}: {key.as_py()}\r\n" if key.is_valid else "") + "\r\n").encode()
            sink.write(arc_head(version, url.as_py() or "-", "0.0.0.0", NO_DATE, "text/html", len(head) + size, name), head, payload, b"\n")
            n += 1
            if sink.size >= ROLL_BYTES:
                sink.close()
                yield row()
    if sink.out is not None:
        sink.close()
        yield row()


def export_arc(pages: DataFrame) -> DataFrame:
    """``file, n``: ARC archives of ``pages(key, url, html)``, a record a row, html in UTF-8
    behind an HTTP header that carries the key (null html: empty; null url: ``-``)."""
    spark = pages.sparkSession
    tune(spark)
    folder = fresh_path(spark, "arc")
    rows = pages.select(F.col("key").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stored(spark, rows.mapInArrow(lambda it: _write_arc(it, folder), "file string, n long"), "arc-files")


# ---- conversion ---------------------------------------------------------------------------

SCANNED = "file string, at long, url string, date string, key long, size long, sha256 binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows: list[tuple] = []
            for record in read_arc(file):
                if not record.url.startswith("filedesc:"):
                    head, payload = split_http(record.body)
                    rows.append((file, record.at, record.url, record.date, document_key(head), len(payload), hashlib.sha256(payload).digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "at", "url", "date", "key", "size", "sha256"])


def _spread(files: DataFrame) -> DataFrame:
    """Rows that name files, dealt over tasks."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def revisits(records: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``file, revisits``: of each archive the records (``at``) that repeat another's
    payload, with that record's file, place, address and date.

    The one with the greatest key stays (null keys are least; ties: by file and place). A
    payload that very many records share is a hot key: counted first and joined by
    broadcast.
    """
    spark = records.sparkSession
    long = records.filter(F.col("size") >= least)
    order = F.struct(F.col("key").isNotNull(), "key", "file", "at", "url", "date")
    groups = long.groupBy("sha256", "size").agg(F.count("*").alias("n"), F.max(order).alias("kept")).filter("n > 1")
    groups = stored(spark, groups, "arc-groups")
    found = join_hot(long.select("sha256", "size", "file", "at"), groups, ["sha256", "size"], "n").filter("file <> kept.file or at <> kept.at")
    return found.groupBy("file").agg(F.collect_list(F.struct("at", F.col("kept.file").alias("file"), F.col("kept.at").alias("kept_at"), F.col("kept.url").alias("url"), F.col("kept.date").alias("date"))).alias("revisits"))


def _warc_head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _warc_record(file: str, record: Record, otherwise: str, twin: dict | None) -> tuple[bytes, bytes]:
    """Header and block of the WARC record that an ARC record becomes."""
    head, payload = split_http(record.body)
    revisit = twin is not None
    block = head if revisit else record.body
    uri = record.url if record.url != "-" else "urn:none:"
    kind = "application/http; msgtype=response" if head else record.kind
    fields = [("WARC-Type", "revisit" if revisit else "response" if head else "resource"), ("WARC-Record-ID", f"<{record_id(file, record.at)}>"), ("WARC-Date", iso_date(record.date, otherwise)), ("WARC-Target-URI", uri)]
    if record.ip not in ("-", "0.0.0.0"):
        fields.append(("WARC-IP-Address", record.ip))
    fields += [("WARC-Payload-Digest", sha1_label(payload)), ("WARC-Block-Digest", sha1_label(block))]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(twin['file'], twin['kept_at'])}>"), ("WARC-Refers-To-Target-URI", twin["url"]), ("WARC-Refers-To-Date", iso_date(twin["date"], otherwise))]
    return _warc_head([*fields, ("Content-Type", kind), ("Content-Length", str(len(block)))]), block


def _convert(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Each ARC file of ``file, revisits`` becomes a WARC file: one row ``file, n``."""
    for batch in batches:
        for file, twins in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sink, n, otherwise = Sink(folder, "warc"), 0, NO_DATE
            known = {t["at"]: t for t in twins or ()}
            name = sink.open().rsplit("/", 1)[-1]
            for record in read_arc(file):
                if record.url.startswith("filedesc:"):
                    otherwise = record.date
                    about = b"software: rankframe\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n" + record.body
                    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(file, record.at)}>"), ("WARC-Date", iso_date(record.date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]
                    sink.write(_warc_head(fields), about, b"\r\n\r\n")
                else:
                    sink.write(*_warc_record(file, record, otherwise, known.get(record.at)), b"\r\n\r\n")
                    n += 1
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.path]), pa.array([n], pa.int64())], ["file", "n"])


def convert_arc(spark: SparkSession, files: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``file, n``: a WARC archive for each ARC archive of ``files(file)``.

    Archives are read twice: for digests, which Spark groups by payload, and for writing.
    No files give no files; an archive that breaks off or has a header line of neither
    version is an error that names file and place.
    """
    tune(spark)
    folder = fresh_path(spark, "warc")
    records = stored(spark, _spread(files.select("file")).mapInArrow(_scan, SCANNED), "arc-records")
    todo = files.select("file").join(revisits(records, least), "file", "left")
    out = stored(spark, _spread(todo).mapInArrow(lambda it: _convert(it, folder), "file string, n long"), "warc-files")
    discard(records)
    return out


# ---- reading back -------------------------------------------------------------------------


def read_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of a WARC file."""
    source = Source(path)
    while (line := source.line()) is not None:
        if line == b"\r\n":
            continue  # lines between records
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {source.place - len(line)} of {path}")
        fields: dict[str, str] = {}
        while (line := source.line()) not in (b"\r\n", None):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        yield fields, source.take(int(fields["content-length"]))


READ = "key long, record_id string, record_type string, payload_digest string, payload_bytes long, target string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["key", "record_id", "record_type", "payload_digest", "payload_bytes", "target"], (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows: list[tuple] = []
            for fields, block in read_warc(file):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = split_http(block)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} in {file} hasn't its digest")
                target = fields.get("warc-refers-to")
                rows.append((document_key(head), fields["warc-record-id"][1:-1], kind, digest, None if kind == "revisit" else len(payload), target[1:-1] if target else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to, record_id`` of every
    record in the WARC archives of ``files(file)``. Payloads are held against their
    digests; a revisit gets length and key (``refers_to``) of the record it refers to."""
    tune(spark)
    rows = stored(spark, _spread(files.select("file")).mapInArrow(_read, READ), "warc-rows")
    whole = rows.filter("record_type <> 'revisit'")
    kept = whole.select(F.col("record_id").alias("target"), F.col("key").alias("refers_to"), F.col("payload_bytes").alias("kept_bytes"))
    again = rows.filter("record_type = 'revisit'").join(kept, "target", "left")
    columns = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    again = again.withColumn("payload_bytes", F.col("kept_bytes")).select(*columns)
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again)


def archive_pages(pages: DataFrame) -> DataFrame:
    """All of ``pages(page_id, url, html)`` exported as ARC, converted to WARC and read back
    from there: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    One row per row of ``pages``. Null html is an empty payload; a null page_id stays null
    and is the least of a group of equal payloads; rows that repeat one another are records
    of their own, of which one is the response; an empty table gives no rows; other columns
    are not read.
    """
    spark = pages.sparkSession
    legacy = export_arc(pages.select(F.col("page_id").alias("key"), "url", "html"))
    out = read_archives(spark, convert_arc(spark, legacy))
    return out.withColumnRenamed("key", "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
