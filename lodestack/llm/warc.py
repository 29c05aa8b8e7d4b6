"""WARC archives as a PySpark data source, for reading and writing.

Records are gzip members, one a record, as crawl archives have them. The
writer adds the 'sl' extra field that the WARC standard's annex describes: the
member's compressed and uncompressed lengths. The reader inflates a member
just as far as the record's header goes, applies the record-type and header
predicates, and passes over a payload that isn't wanted by its compressed
length, without inflating it. Members without the field, and plain archives,
are read too; there the payload is passed over by inflating or by seeking.

Files are opened through pyarrow's file systems, so an archive folder may be a
path or a URI of any store that pyarrow knows, and read through a buffer. Every
committed job leaves a manifest of its files: appending adds one, overwriting
takes away the others, and a file of the writer that no manifest names is that
of a lost attempt. Archives of other writers in the folder are read as well.
Python data sources must be importable on the executors, as this package is.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import read, shared_dir

#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 100
#: Bytes after which the writer begins the next file of a partition, and rows in a batch of the reader.
FILE_BYTES, BATCH_ROWS, BATCH_BYTES = 256 << 20, 512, 16 << 20
#: The date of records whose input has none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names of the writer's files and of its jobs' manifests.
OWN, MANIFEST = re.compile(r"^part-[0-9a-f]{32}\.warc\.gz$"), re.compile(r"^_manifest-[0-9a-f]{32}\.json$")
#: Bytes that the reader asks a store for at a time.
BUFFER = 1 << 18

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, content_length long, payload binary"
#: Column of the schema: the header that it is read from.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "payload_bytes": "x-payload-length",
    "content_length": "content-length",
}


def open_store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if re.match(r"^file:/(?!/)", path):
        path = "file://" + path[5:]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listing(store, at: str) -> tuple[list[str], list[str]]:
    """(archives to be read, manifests) under a folder. Without any manifest all archives are read."""
    from pyarrow import fs

    found = sorted(x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File)
    manifests = [x for x in found if MANIFEST.match(x.rsplit("/", 1)[-1])]
    named = set()
    for name in manifests:
        with store.open_input_stream(name) as f:
            named.update(json.loads(f.read()))
    archives = [x for x in found if re.search(r"\.warc(\.gz)?$", x)]
    return [x for x in archives if not manifests or x.rsplit("/", 1)[-1] in named or not OWN.match(x.rsplit("/", 1)[-1])], manifests


def clean(value: str) -> str:
    """A header's value on one line: line ends and NUL are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00") if re.search(r"[\r\n\0%]", value) else value


def plain(value: str) -> str:
    """What clean() was given."""
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%00", "\0").replace("%25", "%") if "%" in value else value


def record(headers: list[tuple[str, str | None]], payload: bytes) -> bytes:
    """One record's bytes: header lines, blank line, block, two line ends."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own compressed and uncompressed length in the 'sl' extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) >= 1 << 32:
        head = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
    else:
        head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(data: bytes) -> dict[str, str] | None:
    """The headers of a record by lower-case name; None if data doesn't hold all of them yet."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    found: dict[str, str] = {"": str(end + 4)}
    for line in data[:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        found[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    return found


def scan(f: io.BufferedIOBase, wanted, need_payload: bool, counts: dict | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the records of an open archive that wanted(headers) accepts."""
    counts = counts if counts is not None else {}
    while True:
        first = f.read(2)
        if not first:
            return
        if first == b"\x1f\x8b":
            yield from _scan_member(f, wanted, need_payload, counts)
        elif first == b"WA":
            yield from _scan_plain(f, wanted, need_payload, counts)
        elif first.strip(b"\r\n"):
            raise ValueError("not a WARC record")


def _scan_member(f, wanted, need_payload, counts):
    start = f.tell() - 2
    fixed = f.read(8)
    flags, size = fixed[1], None
    if flags & 4:
        extra = f.read(struct.unpack("<H", f.read(2))[0])
        while len(extra) >= 4:
            name, n = struct.unpack("<2sH", extra[:4])
            if name == b"sl":
                size = struct.unpack("<II", extra[4:12])[0]
            extra = extra[4 + n :]
    for flag in (8, 16):  # file name and comment end with a zero byte
        if flags & flag:
            while f.read(1) not in (b"\0", b""):
                pass
    if flags & 2:
        f.read(2)
    inflate, data, head = zlib.decompressobj(-15), b"", None
    step = 1 << 10
    while head is None:
        raw = f.read(step) if not inflate.unconsumed_tail else inflate.unconsumed_tail
        if not raw:
            raise ValueError("the archive ends within a record's header")
        data += inflate.decompress(raw, 1 << 10)
        head = parse_head(data)
        if head is None and inflate.eof:
            raise ValueError("a record without the end of its header")
    take = wanted(head)
    length, at = int(head.get("content-length", 0)), int(head[""])
    payload = None
    if take and need_payload:
        parts, have = [data], len(data)
        while not inflate.eof:
            raw = inflate.unconsumed_tail or f.read(1 << 16)
            if not raw:
                raise ValueError("the archive ends within a record")
            piece = inflate.decompress(raw, 1 << 20)
            parts.append(piece)
            have += len(piece)
        payload = b"".join(parts)[at : at + length]
        counts["inflated"] = counts.get("inflated", 0) + 1
    elif size is None:
        while not inflate.eof:
            raw = inflate.unconsumed_tail or f.read(1 << 16)
            if not raw:
                break
            inflate.decompress(raw, 1 << 20)
    else:
        counts["skipped"] = counts.get("skipped", 0) + 1
    if size is not None:
        f.seek(start + size)
    else:
        f.seek(f.tell() - len(inflate.unused_data) + 8)
    if take:
        yield head, payload


def _scan_plain(f, wanted, need_payload, counts):
    data = b"WA"
    while (head := parse_head(data)) is None:
        line = f.readline()
        if not line:
            raise ValueError("the archive ends within a record's header")
        data += line
    take, length = wanted(head), int(head.get("content-length", 0))
    if take and need_payload:
        payload = f.read(length)
    else:
        payload = None
        f.seek(f.tell() + length)
        counts["skipped"] = counts.get("skipped", 0) + 1
    if take:
        yield head, payload


class Part(InputPartition):
    """Some files of an archive, read by one task."""

    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    """Options: path; types (comma-separated record types); header.<name> (exact value); payload (false: null payloads); files_per_partition."""

    def __init__(self, options):
        self.path = options["path"]
        self.types = {x.strip() for x in options.get("types", "").split(",") if x.strip()}
        self.equal = {k[7:].lower(): {v} for k, v in options.items() if k.lower().startswith("header.")}
        self.payload = options.get("payload", "true").lower() != "false"
        self.group = max(1, int(options.get("files_per_partition", "1")))

    def partitions(self):
        store, at = open_store(self.path)
        from pyarrow import fs

        files = [at] if store.get_file_info(at).type == fs.FileType.File else listing(store, at)[0]
        return [Part(files[i : i + self.group]) for i in range(0, len(files), self.group)] or [Part([])]

    def wanted(self, head: dict[str, str]) -> bool:
        if self.types and head.get("warc-type") not in self.types:
            return False
        return all(head.get(k) in values for k, values in self.equal.items())

    def read(self, partition):
        store, _ = open_store(self.path)
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "content_length"]
        kinds = pa.schema([(n, pa.int64() if n in ("payload_bytes", "content_length") else pa.string()) for n in names] + [("payload", pa.binary())])

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

        rows, held = [], 0
        for name in partition.files:
            with store.open_input_file(name) as raw, io.BufferedReader(raw, BUFFER) as f:
                for head, payload in scan(f, self.wanted, self.payload):
                    values = [head.get(HEADERS[n]) for n in names]
                    values[2:4] = [plain(v) if v is not None else None for v in values[2:4]]
                    values[5:7] = [int(v) if v is not None else None for v in values[5:7]]
                    rows.append((*values, payload))
                    held += len(payload or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


class PushingWarcReader(WarcReader):
    """Takes equality predicates of a where() as well, if spark.sql.python.filterPushdown.enabled is on."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and name not in ("payload_bytes", "content_length", "target_uri", "refers_to") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if name == "record_type":
                    self.types = (self.types & values) or ({"\0"} if self.types else values)
                else:
                    self.equal[HEADERS[name]] = self.equal.get(HEADERS[name], values) & values
            else:
                yield f


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Each attempt writes files of its own; the job's manifest names those of the committed ones, so retried tasks leave no records behind."""

    def __init__(self, options, overwrite):
        self.overwrite = overwrite
        self.path, self.level, self.date = options["path"], int(options.get("level", "6")), options.get("date", DATE)

    def write(self, iterator):
        store, at = open_store(self.path)
        store.create_dir(at, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None or size > FILE_BYTES:
                        if out:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{at}/{names[-1]}", compression=None), 0
                    data = member(self.encode(r), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(names)

    def encode(self, r: dict) -> bytes:
        revisit, uri = r["record_type"] == "revisit", r["target_uri"]
        payload = b"" if revisit else r["payload"] or b""
        headers = [
            ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", self.date), ("WARC-Target-URI", clean(uri) if uri is not None else None),
            ("WARC-Payload-Digest", r["payload_digest"]), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", clean(r["refers_to"]) if r["refers_to"] is not None else None),
            ("X-Payload-Length", str(r["payload_bytes"]) if r["payload_bytes"] is not None else None), ("Content-Type", "text/html"),
        ]
        return record(headers, payload)

    def commit(self, messages):
        store, at = open_store(self.path)
        store.create_dir(at, recursive=True)
        archives, manifests = listing(store, at) if self.overwrite else ([], [])
        with store.open_output_stream(f"{at}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        # The manifests go first: a file that none names isn't read.
        new = {x for m in messages if m for x in m.files}
        for name in [*manifests, *(x for x in archives if x.rsplit("/", 1)[-1] not in new)]:
            store.delete_file(name)

    def abort(self, messages):
        store, at = open_store(self.path)
        for name in [x for m in messages if m for x in m.files]:
            store.delete_file(f"{at}/{name}")


class WarcSource(DataSource):
    """format("warc"): see WarcReader and WarcWriter for the options."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingWarcReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader)(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Records of pages (page_id, url, html): a response, or a revisit of the page that has the payload.

    The payload is html in UTF-8, null as empty. Of the pages whose payloads of
    at least `least` bytes are equal, by SHA-256, the one with the smallest
    page_id is the response. Every row is a record: repeated rows of that page_id
    are all responses. A null page_id is never revisited and is a response. Adds record_type, refers_to, payload_digest,
    payload_bytes and payload.

    Digests are grouped with a map-side minimum, so a payload that a third of
    all pages share costs one row a task; html is shuffled once, by page_id.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    narrow = keyed.where(f"payload_bytes >= {least} and page_id is not null").select("page_id", "payload_digest")
    heads = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("_head"), F.max("page_id").alias("_last")).where("_head <> _last")
    revisits = narrow.join(heads, "payload_digest").where("page_id <> _head").select("page_id", "payload_digest", "_head").distinct()
    return (
        keyed.join(revisits, ["page_id", "payload_digest"], "left")
        .withColumn("record_type", F.when(F.col("_head").isNull(), "response").otherwise("revisit"))
        .withColumnRenamed("_head", "refers_to")
    )


def write_archive(pages: DataFrame, path: str, level: int = 6, mode: str = "append") -> None:
    """Write pages (page_id, url, html) as WARC files under path: beside what is there (append) or in its place (overwrite)."""
    register(pages.sparkSession)
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    out = with_revisits(pages).select(
        urn(F.col("page_id")).alias("record_id"), "record_type", F.col("url").alias("target_uri"), urn(F.col("refers_to")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("payload_digest")).alias("payload_digest"), "payload_bytes", F.lit(0).cast("long").alias("content_length"),
        F.when(F.col("record_type") == "revisit", None).otherwise(F.col("payload")).alias("payload"),
    )
    out.write.format("warc").option("path", path).option("level", str(level)).mode(mode).save()


def read_archive(spark: SparkSession, path: str, types: str = "", payload: bool = True, **headers: str) -> DataFrame:
    """The records under path with the columns of SCHEMA; see WarcReader for the predicates."""
    register(spark)
    source = spark.read.format("warc").option("path", path).option("types", types).option("payload", str(payload).lower())
    for k, v in headers.items():
        source = source.option(f"header.{k.replace('_', '-')}", v)
    return source.load()


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back.

    Responses are read with their payload and their digest and length computed
    from it; revisits are read by their headers alone.
    """
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    full = read_archive(spark, path, "response").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    light = read_archive(spark, path, "revisit", payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", F.expr("substr(payload_digest, 8)").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )
    return full.unionByName(light)


OP6_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
m AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS head FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM m
"""
