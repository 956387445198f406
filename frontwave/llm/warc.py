"""WARC 1.1 archives as a PySpark Python data source, format name ``warc``.

Reading: the driver lists the archive files and plans one partition per file (the writer rolls files at ``roll_bytes``,
so partitions are bounded). Filters on ``record_type``, ``record_id``, ``target_uri`` and ``payload_digest`` are pushed
down when ``spark.sql.python.filterPushdown.enabled`` is set, and further header predicates come as options
``header.<Name>=<value>``. A partition parses a record's headers first; a record that a predicate rejects, or whose
payload is not asked for, is skipped by its length: in plain files by a seek, in gzip members by the member length that
this writer keeps in a header subfield (a foreign member without it is inflated in chunks and thrown away, never decoded; it
may hold several records, all of which are read).

Option ``payload``: ``bytes`` (default), ``digest`` (checked against the header, then dropped) or ``none`` (never read).

Writing: every task attempt writes files of its own name; the commit on the driver writes a list ``_FILES-<job>`` with the
names of the successful attempts, and readers use only files of such lists, all of them where there are several. So a lost
executor's half-written files are never read, and jobs append to a path; mode ``overwrite`` removes what earlier jobs listed.

Defined results: a null payload is written as an empty one; an empty table writes an archive of no records, which reads
as an empty table; a null id or URL leaves its header out and reads as null; repeated rows become repeated records. Long
payloads are written and read whole, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import scratch, table

READ_SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
ARROW_READ = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: The header each filterable column is read from.
PUSHED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES, SUBFIELD, CHUNK, BATCH_BYTES = "_FILES", b"FW", 1 << 16, 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}") if not path.startswith("file:/") or path.startswith("file://") else fs.FileSystem.from_uri("file://" + path[5:])


def listed(store: fs.FileSystem, root: str) -> dict[str, list[str]]:
    """The archive files in each list of a path."""
    out = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(FILES):
            with store.open_input_stream(f"{root}/{info.base_name}") as f:
                out[info.base_name] = [n for n, _ in json.loads(f.read())]
    return out


# ---- writing


def record_bytes(kind: str, record_id: str, date: str, headers: dict[str, str], http: bytes, payload: bytes) -> bytes:
    block = http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra subfield holds the member's own length, so that a reader can step over it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12) + SUBFIELD + struct.pack("<HQ", 8, total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Input columns: record_type, record_id, target_uri, payload (string or binary), payload_bytes, payload_digest, refers_to; any others named ``WARC-*`` become headers."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.gz = options.get("compression", "none") == "gzip"
        self.roll = int(options.get("roll_bytes", 128 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in iterator:
            names = batch.schema.names
            extra = [n for n in names if n.startswith("WARC-")]
            for row in batch.to_pylist():
                payload = row["payload"]
                payload = payload.encode() if isinstance(payload, str) else payload or b""
                kind = row["record_type"]
                headers = {"WARC-Target-URI": clean(row["target_uri"])} if row["target_uri"] is not None else {}
                headers["WARC-Payload-Digest"] = f"sha1:{row.get('payload_digest') or base32_sha1(payload)}"
                if kind == "revisit":
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": row["refers_to"]}
                headers |= {n: clean(str(row[n])) for n in extra if row[n] is not None}
                headers["Content-Type"] = "application/http; msgtype=response"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                data = record_bytes(kind, row["record_id"], self.date, headers, http, b"" if kind == "revisit" else payload)
                data = gzip_member(data) if self.gz else data
                if out is None or size + len(data) > self.roll and size:
                    if out is not None:
                        out.close()
                        done.append((name, size))
                    name, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gz, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            done.append((name, size))
        return Wrote(done)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        before = listed(store, root) if self.overwrite else {}
        with store.open_output_stream(f"{root}/{FILES}-{uuid.uuid4().hex}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        for name, files in before.items():
            store.delete_file(f"{root}/{name}")
            for file in files:
                store.delete_file(f"{root}/{file}")

    def abort(self, messages: list[Wrote | None]) -> None:
        store, root = open_store(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                store.delete_file(f"{root}/{name}")


# ---- reading


class Plain:
    """Records of an uncompressed file. ``size`` bytes of head were read; the rest of a record is read or sought over."""

    def __init__(self, stream):
        self.stream, self.at, self.end = stream, 0, stream.size()

    def head(self) -> bytes | None:
        """The bytes up to the blank line after the WARC headers."""
        if self.at >= self.end:
            return None
        self.stream.seek(self.at)
        data = b""
        while (cut := data.find(b"\r\n\r\n")) < 0:
            more = self.stream.read(2048)
            if not more:
                if data.strip():
                    raise ValueError("a WARC record is cut off")
                return None
            data += more
        self.body = self.at + cut + 4
        return data[:cut]

    def take(self, length: int) -> bytes:
        self.stream.seek(self.body)
        return self.stream.read(length)

    def skip(self, length: int) -> None:
        self.at = self.body + length + 4


class Members:
    """Records of a gzip file; a member holds one record or several."""

    def __init__(self, stream):
        self.stream, self.at, self.end = stream, 0, stream.size()
        self.inside = False  # whether the open member holds another record, whose first bytes are in ``out``

    def head(self) -> bytes | None:
        if not self.inside:
            if self.at >= self.end:
                return None
            self.stream.seek(self.at)
            raw = self.stream.read(CHUNK)
            if raw[:2] != b"\x1f\x8b":
                raise ValueError("not a gzip member")
            own = raw[3] & 4 and raw[12:14] == SUBFIELD
            self.next = self.at + struct.unpack("<Q", raw[16:24])[0] if own else None
            self.inflate, self.fed = zlib.decompressobj(31), self.at + len(raw)
            self.out = self.inflate.decompress(raw, 4096)
        while (cut := self.out.find(b"\r\n\r\n")) < 0:
            if not (piece := self.more(4096)):
                raise ValueError("a WARC record is cut off")
            self.out += piece
        self.cut = cut + 4
        return self.out[:cut]

    def more(self, n: int) -> bytes:
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                self.stream.seek(self.fed)
                raw = self.stream.read(CHUNK)
                if not raw:
                    return b""
                self.fed += len(raw)
            if piece := self.inflate.decompress(raw, n):
                return piece
        return b""

    def take(self, length: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < self.cut + length and (piece := self.more(CHUNK)):
            parts.append(piece)
            have += len(piece)
        self.out = b"".join(parts)
        return self.out[self.cut : self.cut + length]

    def skip(self, length: int) -> None:
        if self.next is not None:
            self.at = self.next
            return
        past, rest = self.cut + length + 4, self.out
        while len(rest) < past and (piece := self.more(CHUNK)):
            past, rest = max(0, past - len(rest)), piece
        rest = rest[past:].lstrip(b"\r\n")
        while not rest and (piece := self.more(4096)):
            rest = piece.lstrip(b"\r\n")
        self.out, self.inside = rest, bool(rest)
        if not rest:
            self.at = self.fed - len(self.inflate.unused_data)


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip()] = value.strip()
    return out


@dataclass
class FilePartition(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        if self.payload not in ("bytes", "digest", "none"):
            raise ValueError(f"payload: {self.payload}")
        names = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest")}
        self.wanted: list[tuple[str, frozenset]] = [(names.get(k[7:].lower(), k[7:]).lower(), frozenset([v])) for k, v in options.items() if k.lower().startswith("header.")]

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in PUSHED:
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.wanted.append((PUSHED[column].lower(), frozenset(f"sha1:{v}" if column == "payload_digest" else v for v in values)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = open_store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [FilePartition(self.path)]
        if lists := listed(store, root):
            names = sorted(n for files in lists.values() for n in files)
        else:
            names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [FilePartition(f"{self.path.rstrip('/')}/{n}") for n in names] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = open_store(partition.path)
        rows, held = [], 0
        with store.open_input_file(path) as stream:
            source = Members(stream) if path.endswith(".gz") else Plain(stream)
            while (head := source.head()) is not None:
                headers = parsed(head)
                length = int(headers.get("Content-Length", 0))
                low = {k.lower(): v for k, v in headers.items()}
                if all(low.get(k) in v for k, v in self.wanted):
                    rows.append(self.row(headers, length, source))
                    held += len(rows[-1]["payload"] or b"") + 500
                source.skip(length)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_READ)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW_READ)

    def row(self, headers: dict[str, str], length: int, source) -> dict:
        kind, digest = headers.get("WARC-Type"), headers.get("WARC-Payload-Digest")
        payload, size = None, length
        if self.payload != "none" or "application/http" in headers.get("Content-Type", ""):
            whole = self.payload != "none" and kind != "revisit"
            block = source.take(length if whole else min(length, 2048))
            http = b""
            if "application/http" in headers.get("Content-Type", ""):
                cut = block.find(b"\r\n\r\n")
                http, block = block[: cut + 4], block[cut + 4 :]
                told = [line.split(b":", 1)[1] for line in http.lower().split(b"\r\n") if line.startswith(b"content-length:")]
                size = int(told[0]) if told else length - len(http)
            if whole:
                size = len(block)
                found = f"sha1:{base32_sha1(block)}"
                if digest is not None and digest.startswith("sha1:") and found != digest:
                    raise ValueError(f"{headers.get('WARC-Record-ID')}: the payload's digest is {found}, its header says {digest}")
                digest = found
                payload = block if self.payload == "bytes" else None
        return {"record_type": kind, "record_id": headers.get("WARC-Record-ID"), "target_uri": headers.get("WARC-Target-URI"), "date": headers.get("WARC-Date"), "payload_digest": digest.removeprefix("sha1:") if digest else None, "payload_bytes": size, "refers_to": headers.get("WARC-Refers-To"), "headers": list(headers.items()), "payload": payload}


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages


def page_records(pages: DataFrame, min_revisit_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of pages: of equal payloads of at least ``min_revisit_bytes``, the rows with the largest key are responses and the rest revisits of it.

    Only keys and digests meet in the aggregation, which combines before the shuffle; groups of one are dropped before
    the join, whose large side Spark can split where one digest is hot. A null key counts as smaller than any other, and
    its rows never carry an id header; where all keys of a group are null, all its rows are responses.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("hex"))
    first = pages.select(F.col(key).cast("long").alias("key"), F.octet_length(payload).alias("n"), F.sha1(payload).alias("hex")).where(F.col("n") >= min_revisit_bytes).groupBy("hex").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("hex", "first")
    both = own.join(first, "hex", "left")
    revisit = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") != F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:frontwave:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return both.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("key")).alias("record_id"), "target_uri", "payload",
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.col("key").alias("WARC-X-Page-ID"), F.when(revisit, F.col("first")).alias("WARC-X-Refers-To-Page"),
    )


def write_warc(records: DataFrame, path: str, compression: str = "none", roll_bytes: int = 128 << 20, mode: str = "append") -> str:
    spark = records.sparkSession
    register(spark)
    records.write.format("warc").mode(mode).options(path=path, compression=compression, roll_bytes=str(roll_bytes)).save()
    return path


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages in the shared folder, read the archives back, and report each record."""
    path = write_warc(page_records(table(spark, sf_dir, "pages")), scratch(spark, "warc"), compression="gzip")
    got = read_warc(spark, path, payload="digest")
    number = lambda n: F.col("headers").getItem(n).cast("long")
    return got.select(number("WARC-X-Page-ID").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("WARC-X-Refers-To-Page").alias("refers_to"), "target_uri")
