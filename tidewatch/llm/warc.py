"""WARC archives as a PySpark data source, and revisit records for pages whose payload is already archived.

Reading plans partitions from the archive's files: small files share a partition, and a file is never cut, as only its
beginning is known to be a record. Predicates on the record type and on the other headers are pushed down. A record's
headers are parsed first; if a predicate rules it out, or no payload is asked for, its block is passed over: by a seek
in plain files and in compressed ones whose members carry their length ("sl" in the gzip header), and by
inflating without keeping anything in others.

Writing gives each task files of bounded size under names of their own. The commit lists them in ``_manifest.json``;
a reader takes the files that are listed there, so files of a task that was lost are never read. Folders without a
manifest are listed (``*.warc``, ``*.warc.gz``). Paths are URIs that pyarrow's file systems can open.

Columns: record_id, record_type, target_uri, date, refers_to, payload_digest (bare), content_type, headers (all other
WARC headers), payload_bytes (of the full payload; of a revisit the one it stands for) and, unless the option
``payload`` is false, payload (null for revisits). In response and revisit records the block is an HTTP message; elsewhere
the block is the payload.

Defined cases: a null payload is empty; a null column has no header; line ends and other control characters in header
values are escaped and come back; repeated rows are records each; an empty table gives an archive without records. A
damaged record ends its file with an error, or silently with the option ``errors`` = ``skip``.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, MapType, StringType, StructField, StructType

from tidewatch.llm.common import materialize

#: The header that each column is written to, and what WARC 1.1 calls a revisit of an equal payload.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION, _DIGEST, _ESCAPED = "WARC/1.1", "sha256:", "X-Escaped-Headers"
#: A file of an archive is closed at so many bytes; files are read together up to so many.
FILE_BYTES, PARTITION_BYTES = 64 << 20, 64 << 20
#: Payload bytes of a batch that the reader hands on, and the size of its reads.
BATCH_BYTES, READ_BYTES = 2 << 20, 1 << 18
_HEADER_LIMIT = 1 << 20
_MANIFEST = "_manifest.json"
_COLUMNS = {v.lower(): k for k, v in HEADERS.items()}
_TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_CONTROL = re.compile(r"[\x00-\x1f\x7f%]|^\s|\s$")
_FIELDS = [*[StructField(c, StringType()) for c in HEADERS], StructField("headers", MapType(StringType(), StringType())), StructField("payload_bytes", LongType())]


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:/", uri) else (pafs.LocalFileSystem(), uri)


# --- records as bytes -----------------------------------------------------------------------------

def _quote(value: str) -> str:
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), value)


def _unquote(value: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m.group(1), 16)]), value.encode()).decode()


def record_bytes(columns: dict[str, str | None], headers: dict[str, str | None], payload: bytes, payload_bytes: int | None = None) -> bytes:
    """One record. ``payload_bytes``: the full payload's length, where it is not this payload's own (revisits)."""
    kind = columns.get("record_type") or "resource"
    found = {HEADERS[c]: v for c, v in {**columns, "record_type": kind}.items() if v is not None and c in HEADERS}
    if columns.get("payload_digest") is not None:
        found[HEADERS["payload_digest"]] = _DIGEST + columns["payload_digest"]
    found |= {k: v for k, v in headers.items() if v is not None and k.lower() not in (*_COLUMNS, "content-length", _ESCAPED.lower())}
    if bad := [name for name in found if not _TOKEN.fullmatch(name)]:
        raise ValueError(f"not a header name: {bad[0]!r}")
    block = payload
    if kind in ("response", "revisit"):
        full = payload_bytes if kind == "revisit" and payload_bytes is not None else len(payload)
        media = re.sub(r"[\x00-\x1f\x7f]", " ", columns.get("content_type") or "application/octet-stream")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\nContent-Length: {full}\r\n\r\n".encode() + payload
        found[HEADERS["content_type"]] = "application/http;msgtype=response"
    if kind == "revisit":
        found["WARC-Profile"] = PROFILE
    escaped = [name for name, value in found.items() if _CONTROL.search(value.replace("%", ""))]
    found |= {name: _quote(found[name]) for name in escaped}
    if escaped:
        found[_ESCAPED] = ",".join(escaped)
    head = "".join([f"{_VERSION}\r\n", *(f"{name}: {value}\r\n" for name, value in found.items()), f"Content-Length: {len(block)}\r\n\r\n"])
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose header says how long it is, so that a reader can pass over it."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(data) + coder.flush()
    tail = (zlib.crc32(data)).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    total = 10 + 14 + len(body) + 8
    if total >> 32 or len(data) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = b"sl\x08\x00" + total.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + len(extra).to_bytes(2, "little") + extra + body + tail


class DamagedRecord(ValueError):
    pass


class _Plain:
    """Records one after the other in a plain file."""

    def __init__(self, file: io.BufferedReader):
        self.file = file

    def begin(self) -> bool:
        """Go to the next record; false at the end of the file."""
        while (ahead := self.file.peek(1)[:1]) in (b"\r", b"\n"):
            self.file.read(1)
        return bool(ahead)

    def line(self) -> bytes:
        return self.file.readline(_HEADER_LIMIT)

    def take(self, n: int) -> bytes:
        return self.file.read(n)

    def leave(self, n: int) -> None:
        """Pass over ``n`` bytes, the rest of the record's block."""
        self.file.seek(n, io.SEEK_CUR)


class _Members:
    """Records that are gzip members each."""

    def __init__(self, file: io.BufferedReader):
        self.file, self._next, self._coder, self._ready = file, None, None, b""

    def begin(self) -> bool:
        if self._next is not None:
            self.file.seek(self._next)
        elif self._coder is not None:
            self._to_end()
        at, self._next, self._ready = self.file.tell(), None, b""
        head = self.file.read(24)
        self.file.seek(at)
        if not head:
            return False
        if head[:2] != b"\x1f\x8b":
            raise DamagedRecord("not a gzip member")
        if len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00":
            self._next = at + int.from_bytes(head[16:20], "little")
        self._coder = zlib.decompressobj(31)
        return True

    def _fill(self, n: int) -> None:
        """Inflate until ``n`` bytes are ready, and no more."""
        parts, held = [self._ready], len(self._ready)
        while held < n and not self._coder.eof:
            data = self._coder.unconsumed_tail or self.file.read(READ_BYTES)
            if not data:
                break
            parts.append(self._coder.decompress(data, n - held))
            held += len(parts[-1])
            if self._coder.unused_data:
                self.file.seek(-len(self._coder.unused_data), io.SEEK_CUR)
        self._ready = b"".join(parts)

    def _to_end(self) -> None:
        while not self._coder.eof:
            self._ready = b""
            self._fill(READ_BYTES)
            if not self._ready:
                break

    def line(self) -> bytes:
        while (end := self._ready.find(b"\n")) < 0 and (had := len(self._ready)) < _HEADER_LIMIT:
            self._fill(had + 512)
            if len(self._ready) == had:
                break
        out, self._ready = self._ready[:end + 1], self._ready[end + 1:]
        return out

    def take(self, n: int) -> bytes:
        self._fill(n)
        out, self._ready = self._ready[:n], self._ready[n:]
        return out

    def leave(self, n: int) -> None:
        """The next ``begin`` goes to where this member ends."""


@dataclass
class _Head:
    columns: dict[str, str | None]
    headers: dict[str, str]
    length: int


def _parse_head(source: _Plain | _Members) -> _Head:
    version = source.line().strip()
    if not version.startswith(b"WARC/"):
        raise DamagedRecord("not a WARC record")
    raw: list[list[str]] = []
    while (line := source.line()) not in (b"\r\n", b"\n"):
        if not line.endswith(b"\n"):
            raise DamagedRecord("headers without an end")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and raw:
            raw[-1][1] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            raw.append([name.strip(), value.strip()])
    found = {name.lower(): value for name, value in raw}
    escaped = {x.lower() for x in found.get(_ESCAPED.lower(), "").split(",")}
    raw = [[name, _unquote(value) if name.lower() in escaped else value] for name, value in raw]
    found = {name.lower(): value for name, value in raw}
    columns = {c: found.get(h) for h, c in _COLUMNS.items()}
    if columns["payload_digest"]:
        columns["payload_digest"] = columns["payload_digest"].removeprefix(_DIGEST)
    others = {name: value for name, value in raw if name.lower() not in (*_COLUMNS, "content-length", _ESCAPED.lower())}
    try:
        return _Head(columns, others, int(found["content-length"]))
    except (KeyError, ValueError):
        raise DamagedRecord("no length") from None


def _http_head(source: _Plain | _Members, length: int) -> tuple[int, int | None, str | None]:
    """Bytes of an HTTP message's head, and its Content-Length and Content-Type."""
    used, size, kind = 0, None, None
    while used < length:
        line = source.line()
        if not line:
            raise DamagedRecord("no end of an HTTP head")
        used += len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            size = int(value)
        elif name.strip().lower() == b"content-type":
            kind = value.strip().decode("utf-8", "replace")
    return used, size, kind


# --- predicates -----------------------------------------------------------------------------------

#: Columns that a predicate can be answered on from the WARC headers alone.
_KNOWN = tuple(c for c in HEADERS if c != "content_type")


def holds(predicate: ds.Filter, columns: dict[str, str | None]) -> bool:
    """Whether a record's headers satisfy a pushed predicate, null being unknown and so false."""
    if isinstance(predicate, ds.Not):
        inner = predicate.child
        return (isinstance(inner, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)) or columns[inner.attribute[0]] is not None) and not holds(inner, columns)
    value = columns[predicate.attribute[0]]
    if isinstance(predicate, ds.IsNull):
        return value is None
    if isinstance(predicate, ds.EqualNullSafe):
        return value == predicate.value
    if value is None:
        return False
    match predicate:
        case ds.IsNotNull():
            return True
        case ds.EqualTo():
            return value == predicate.value
        case ds.In():
            return value in predicate.value
        case ds.StringStartsWith():
            return value.startswith(predicate.value)
        case ds.StringEndsWith():
            return value.endswith(predicate.value)
        case _:
            return predicate.value in value


_ANSWERED = (ds.IsNull, ds.IsNotNull, ds.EqualTo, ds.EqualNullSafe, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)


def answerable(predicate: ds.Filter) -> bool:
    inner = predicate.child if isinstance(predicate, ds.Not) else predicate
    return isinstance(inner, _ANSWERED) and len(inner.attribute) == 1 and inner.attribute[0] in _KNOWN


# --- the data source ------------------------------------------------------------------------------

class Files(ds.InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.skip = options.get("errors", "raise").lower() == "skip"
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.schema, self.predicates = schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for predicate in filters:
            if answerable(predicate):
                self.predicates.append(predicate)
            else:
                yield predicate

    def partitions(self) -> list[Files]:
        system, root = _file_system(self.path)
        chosen = pafs.FileSelector(root, recursive=False)
        if system.get_file_info(root).type == pafs.FileType.File:
            return [Files([root])]
        found = {f.base_name: f.size for f in system.get_file_info(chosen) if f.type == pafs.FileType.File}
        if _MANIFEST in found:
            with system.open_input_stream(f"{root}/{_MANIFEST}") as listed:
                names = json.loads(listed.read())
        else:
            names = sorted(n for n in found if n.endswith((".warc", ".warc.gz")))
        parts, held = [], self.bytes
        for name in names:
            if held + found[name] > self.bytes:
                parts.append([])
                held = 0
            parts[-1].append(f"{root}/{name}")
            held += found[name]
        return [Files(p) for p in parts]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        names = [f.name for f in self.schema.fields]
        rows, held = [], 0
        for path in partition.paths if partition else []:
            with system.open_input_file(path) as raw:
                for row in self._records(io.BufferedReader(raw, READ_BYTES), path):
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held >= BATCH_BYTES:
                        yield self._batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, names)

    def _batch(self, rows: list[dict], names: list[str]) -> pa.RecordBatch:
        types = {"headers": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names)

    def _records(self, file: io.BufferedReader, path: str) -> Iterator[dict]:
        source = _Members(file) if file.peek(2)[:2] == b"\x1f\x8b" else _Plain(file)
        try:
            while source.begin():
                head = _parse_head(source)
                if not all(holds(p, head.columns) for p in self.predicates):
                    source.leave(head.length)
                    continue
                used, full = 0, head.length
                if (head.columns["content_type"] or "").startswith("application/http"):
                    used, size, head.columns["content_type"] = _http_head(source, head.length)
                    full = head.length - used if size is None else size
                row = {**head.columns, "headers": list(head.headers.items()), "payload_bytes": full}
                if self.payload and head.columns["record_type"] != "revisit":
                    row["payload"] = source.take(head.length - used)
                    if len(row["payload"]) < head.length - used:
                        raise DamagedRecord("a block without an end")
                else:
                    source.leave(head.length - used)
                yield row
        except (DamagedRecord, zlib.error) as error:
            if not self.skip:
                raise DamagedRecord(f"{path}: {error}") from None


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ds.WriterCommitMessage:
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        names, out, held = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                    out, held = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                payload = row.get("payload") or b""
                data = record_bytes(row, dict(row.get("headers") or {}), payload, row.get("payload_bytes"))
                data = gzip_member(data) if self.gzip else data
                out.write(data)
                held += len(data)
                if held >= self.bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        at, before = f"{root}/{_MANIFEST}", []
        if not self.overwrite and system.get_file_info(at).type == pafs.FileType.File:
            with system.open_input_stream(at) as listed:
                before = json.loads(listed.read())
        names = [n for m in messages if m is not None for n in m.names]
        with system.open_output_stream(at + ".new") as out:
            out.write(json.dumps([*before, *names]).encode())
        system.move(at + ".new", at)

    def abort(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        system, root = _file_system(self.path)
        for name in [n for m in messages if m is not None for n in m.names]:
            system.delete_file(f"{root}/{name}")


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        payload = self.options.get("payload", "true").lower() == "true"
        return StructType([*_FIELDS, *([StructField("payload", BinaryType())] if payload else [])])

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push predicates into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), **options).load(path)


def write(records: DataFrame, path: str, **options: str) -> None:
    """Records to a new archive, or further ones to an old one."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


# --- revisits -------------------------------------------------------------------------------------

def mark_revisits(rows: DataFrame, key: str, digest: str, size: str, least: int) -> DataFrame:
    """The rows with ``first``: the smallest key among the rows of equal payload, where that is another row's (null
    elsewhere, and for payloads of less than ``least`` bytes). Null keys count as larger than all; rows that repeat the
    smallest key are none of them revisits.

    Only payloads that come more than once are looked up. Those that so many rows share that they would fill a task are
    fewer than there are tasks and are sent to all; the others meet their rows by digest.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(size) >= least).groupBy(F.col(digest).alias("d")).agg(F.min(key).alias("smallest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = materialize(known, "shared-payloads")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = known.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") * tasks > total  # true of fewer payloads than there are tasks
    hot = F.broadcast(known.where(many).select(F.col("d").alias("hot"), F.col("smallest").alias("hot_smallest")))
    found = rows.join(hot, F.col(digest) == F.col("hot"), "left")
    # A row that has found its payload, or is too small, gets a place of its own in the second join.
    apart = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    found = found.withColumn("meet", F.when(F.col("hot").isNotNull() | (F.col(size) < least), apart).otherwise(F.col(digest)))
    cold = known.where(~many).select(F.col("d").alias("meet"), "smallest")
    found = found.join(cold, "meet", "left")
    smallest = F.when(F.col(size) >= least, F.coalesce("hot_smallest", "smallest"))
    return found.select(*rows.columns, F.when(~F.col(key).eqNullSafe(smallest), smallest).alias("first"))


def urn(key: Column) -> Column:
    """The record id of a page's key."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def key_of(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def page_records(pages: DataFrame, least: int = 100, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of pages: a revisit where an equal payload of ``least`` bytes or more is in the response of a smaller key."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    again, first = F.col("first").isNotNull(), F.col("first")
    return mark_revisits(rows, "key", "digest", "size", least).select(
        urn(F.col("key")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(again, urn(first)).alias("refers_to"), F.col("digest").alias("payload_digest"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("size").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"))
