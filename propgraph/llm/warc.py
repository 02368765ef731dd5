"""WARC archives as a Python data source named ``warc``.

Reading plans partitions from the archive's manifests, splitting files where the writer noted a
record's offset; other archives get one partition a file, small files together. Predicates on
record type and on any header are tested on the header block, before the content is read; content of
records that are not wanted, or that no column asks for, is skipped and not decoded. :func:`read_warc`
hands predicates to the source with the relation that it loads, so each relation has its own. With the
option ``pushdown`` Spark's filters on columns that stand for headers are taken as well. That is off
unless asked for, because Spark 4.1 keeps one set of filters for all scans of a loaded relation: it is
right for a relation that one query uses once, and loses records elsewhere. ``.warc`` files are skipped by seeking, ``.warc.gz`` ones (a member for each
record) by inflating to nothing.

Writing gives each task a file of its own under a fresh name; the driver's commit lists the files
of successful tasks in a manifest of its own, ``_manifest-*.json``, which appears by a rename, and only files
in manifests are read. So retried and speculative tasks leave no trace, and appends do not meet. Files are reached through pyarrow's file systems (file, hdfs, s3, gs).

Defined cases. A null payload is an empty one; null URIs, ids and dates give no header. Line breaks
in header names and values, and colons in names, are percent-encoded. Rows that repeat are records of their own; of pages with equal
id and payload all are responses if their id is the least. An empty table gives an archive
without records. Records of any length are written and read whole. Columns of ``pages`` with other
names are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from propgraph.operators.joins import lookup
from propgraph.plans.staging import new_path, staged

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
#: Columns that come straight from a header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
LENGTH = "X-Payload-Length"
MANIFEST = "_manifest-"
SPLIT = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    """Parts of files: (path, first byte, end byte or None)."""

    parts: list


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int
    splits: list


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: verify (true: check payload digests), where (predicates
    as JSON, see :func:`read_warc`), pushdown (true: take Spark's filters)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        given = lambda name: str(self.options.get(name, "false")).lower() == "true"
        return WarcReader(self.options["path"], schema, given("verify"), json.loads(self.options.get("where", "{}")), given("pushdown"))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, str(self.options.get("gzip", "true")).lower() == "true")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool, where: dict, pushdown: bool):
        self.path, self.columns, self.verify, self.pushdown = path, schema.names, verify, pushdown
        self.types = {c: pa.map_(pa.string(), pa.string()) if c == "headers" else pa.binary() if c == "payload" else pa.int64() if c == "payload_length" else pa.string() for c in schema.names}
        self.tests: list[tuple] = [(name, "in", set(values)) for name, values in where.items()]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.pushdown:
                yield f
                continue
            column = f.attribute if hasattr(f, "attribute") else ()
            name = HEADERS.get(column[0]) if len(column) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "start", f.value))
            else:
                yield f

    def partitions(self) -> list[Split]:
        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        if manifests := [i.path for i in found if i.base_name.startswith(MANIFEST)]:
            files = [f for path in manifests for f in json.loads(system.open_input_stream(path).read())]
        else:
            files = [{"file": i.path, "size": i.size, "splits": []} for i in found if i.path.endswith((".warc", ".warc.gz"))]
        parts, small, size = [], [], 0
        for f in sorted(files, key=lambda f: f["file"]):
            path = f["file"] if "/" in f["file"] else f"{root}/{f['file']}"
            edges = [0, *f["splits"], None]
            if f["splits"]:
                parts += [Split([(path, a, b)]) for a, b in zip(edges, edges[1:], strict=False)]
                continue
            small.append((path, 0, None))
            size += f["size"]
            if size >= SPLIT:
                parts.append(Split(small))
                small, size = [], 0
        return [*parts, Split(small)] if small or not parts else parts

    def _wanted(self, head: dict) -> bool:
        for name, kind, value in self.tests:
            have = head.get(name.lower(), ("", None))[1]
            if have is None or (kind == "in" and have not in value) or (kind == "start" and not have.startswith(value)):
                return False
        return True

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows: list[tuple] = []
        size = 0
        for path, start, end in partition.parts:
            with system.open_input_file(path) as file:
                stream = Inflated(file, start, end) if path.endswith(".gz") else Plain(file, start, end)
                while (head := read_head(stream)) is not None:
                    length = int(head["content-length"][1])
                    body = None
                    if self._wanted(head):
                        if "payload" in self.columns or "payload_length" in self.columns and LENGTH.lower() not in head or self.verify:
                            body = stream.read(length)
                        else:
                            stream.skip(length)
                        rows.append(self._row(head, body))
                        size += len(body or b"")
                    else:
                        stream.skip(length)
                    stream.skip(4)
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, head: dict, body: bytes | None) -> tuple:
        payload = None
        if body is not None and head["warc-type"][1] != "revisit":
            payload = body.partition(b"\r\n\r\n")[2] if head.get("content-type", ("", ""))[1].startswith("application/http") else body
            if self.verify and (named := head.get("warc-payload-digest")) and named[1] != digest_name(hashlib.sha1(payload).digest()):
                raise ValueError(f"payload of {head.get('warc-record-id')} does not have the digest {named[1]}")
        length = head.get(LENGTH.lower())
        values = {c: head.get(h.lower(), ("", None))[1] for c, h in HEADERS.items()}
        values |= {"payload": payload, "payload_length": int(length[1]) if length else None if payload is None else len(payload), "headers": [v for v in head.values() if v[0]]}
        return tuple(values.get(c) for c in self.columns)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(v, type=self.types[c]) for c, v in zip(self.columns, zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=self.columns)


class Plain:
    """Sequential bytes of a part of a file; skipping seeks."""

    def __init__(self, file: pa.NativeFile, start: int, end: int | None):
        self.file, self.end = file, file.size() if end is None else end
        self.at, self.buffer, self.used = start, b"", 0
        file.seek(start)

    def _more(self) -> bool:
        data = self.file.read(max(0, min(1 << 18, self.end - self.at)))
        self.at += len(data)
        self.buffer, self.used = self.buffer[self.used :] + data, 0
        return bool(data)

    def until(self, mark: bytes) -> bytes:
        seen = self.used
        while (k := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - self.used - len(mark))
            if not self._more():
                return b""
        out, self.used = self.buffer[self.used : k], k + len(mark)
        return out

    def read(self, n: int) -> bytes:
        have = self.buffer[self.used : self.used + n]
        self.used += len(have)
        if len(have) < n:
            rest = self.file.read(n - len(have))
            self.at += len(rest)
            have += rest
        return have

    def skip(self, n: int) -> None:
        have = min(n, len(self.buffer) - self.used)
        self.used += have
        if n > have:
            self.at += n - have
            self.file.seek(self.at)


class Inflated(Plain):
    """The same over gzip members; skipped bytes are inflated, not kept."""

    def __init__(self, file: pa.NativeFile, start: int, end: int | None):
        super().__init__(file, start, end)
        self.inflate, self.raw = zlib.decompressobj(31), b""

    def _block(self) -> bytes:
        while True:
            if not self.raw:
                self.raw = self.file.read(max(0, min(1 << 18, self.end - self.at)))
                self.at += len(self.raw)
                if not self.raw:
                    return b""
            data = self.inflate.decompress(self.raw, 1 << 20)
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            if data:
                return data

    def _more(self) -> bool:
        data = self._block()
        self.buffer, self.used = self.buffer[self.used :] + data, 0
        return bool(data)

    def read(self, n: int) -> bytes:
        parts = [self.buffer[self.used : self.used + n]]
        self.used += len(parts[0])
        need = n - len(parts[0])
        while need:
            data = self._block()
            if not data:
                break
            parts.append(data[:need])
            if len(data) > need:
                self.buffer, self.used = data, need
            need -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0:
            have = min(n, len(self.buffer) - self.used)
            self.used += have
            n -= have
            if n and not self._more():
                return


def read_head(stream: Plain) -> dict | None:
    """{lower-case name: (name, value)} of the next record, or None at the end."""
    text = stream.until(b"\r\n\r\n")
    if not text:
        return None
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = [line.partition(":") for line in lines[1:]]
    return {name.lower(): (name, value.strip()) for name, _, value in pairs}


def digest_name(sha1: bytes) -> str:
    return f"sha1:{base64.b32encode(sha1).decode()}"


def _clean(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A response (with an HTTP head) or revisit record; other types hold the payload alone."""
    kind, payload = row["record_type"], row.get("payload") or b""
    digest = row.get("payload_digest") or digest_name(hashlib.sha1(payload).digest())
    length = row.get("payload_length")
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload if kind == "response" else payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date"), "WARC-Target-URI": row.get("target_uri"),
        "WARC-Payload-Digest": digest, LENGTH: length, "WARC-Refers-To": row.get("refers_to"),
        "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response" if kind in ("response", "revisit") else "application/octet-stream",
        **dict(row.get("headers") or []), "Content-Length": len(block),
    }
    text = "".join(f"{_clean(k).replace(':', '%3A')}: {_clean(v)}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.0\r\n{text}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, gzip: bool):
        self.path, self.overwrite, self.gzip = path, overwrite, gzip

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        size, splits, stream = 0, [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if stream is None:
                        system.create_dir(root, recursive=True)
                        stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(row)
                    if self.gzip:
                        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = squeeze.compress(data) + squeeze.flush()
                    if size - (splits[-1] if splits else 0) >= SPLIT:
                        splits.append(size)
                    stream.write(data)
                    size += len(data)
        finally:
            if stream is not None:
                stream.close()
        return Written(name if stream is not None else "", size, splits)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files = [{"file": m.file, "size": m.size, "splits": m.splits} for m in messages if m and m.file]
        older = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(MANIFEST)]
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{root}/_draft-{name}") as out:
            out.write(json.dumps(files).encode())
        system.move(f"{root}/_draft-{name}", f"{root}/{MANIFEST}{name}.json")
        for path in older if self.overwrite else []:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m and m.file:
                with contextlib.suppress(OSError):
                    system.delete_file(f"{root}/{m.file}")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets Spark hand it filters, which it takes if asked to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, record_types: list[str] | None = None, headers: dict[str, str | list[str]] | None = None, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
    """The records of an archive whose type is one of ``record_types`` and whose ``headers`` have (one of) the values given.

    The source tests both on the header block and reads no other record's content; ``columns`` names
    those of :data:`SCHEMA` that are wanted. Any number of queries may use the result.
    """
    register(spark)
    wanted = {name: [value] if isinstance(value, str) else list(value) for name, value in (headers or {}).items()}
    if record_types is not None:
        wanted["WARC-Type"] = list(record_types)
    kinds = dict(part.strip().split(" ", 1) for part in SCHEMA.split(", "))
    reader = spark.read.format("warc").option("where", json.dumps(wanted)).option("verify", str(verify).lower())
    return reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(path)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0, gzip: bool = True) -> None:
    """Writes a record for each page: of equal payloads of at least ``least_bytes`` the one with the
    least page_id is the response, the others revisit it."""
    register(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.filter("n > 1"), "payloads")
    rows = lookup(rows, groups, "sha1", "n", pages.count(), "left")
    again = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False))
    def urn(ident: str) -> F.Column:
        named = F.md5(F.concat(F.lit("page:"), F.col(ident).cast("string")))
        return F.regexp_replace(named, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    refers = F.when(again, F.col("first_id").cast("string"))
    marks = F.map_filter(F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string"), F.lit("X-Refers-To-Page-Id"), refers), lambda k, v: v.isNotNull())
    out = rows.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.when(again, urn("first_id")).alias("refers_to"), F.lit(None).cast("string").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"), marks.alias("headers"), F.when(~again, F.col("payload")).alias("payload"), "sha1",
    )
    out.mapInArrow(_named, f"{SCHEMA}").write.format("warc").mode("append").option("gzip", str(gzip)).save(path)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the digest's base32 name in the place of its bytes."""
    for batch in batches:
        names = pa.array([digest_name(s) for s in batch.column("sha1").to_pylist()], pa.string())
        at = batch.schema.get_field_index("payload_digest")
        columns = [names if i == at else c for i, c in enumerate(batch.columns)][:-1]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path, verify=True)
    return records.select(
        F.col("headers")["X-Page-Id"].cast("long").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", F.col("headers")["X-Refers-To-Page-Id"].cast("long").alias("refers_to"),
    )
