"""WARC archives (operator 6) as a PySpark Python data source.

Writing: one gzip member per record, one archive per task. Reading: partitions
are byte ranges of the archives, planned from file sizes; a range starts at the
first record that begins in it. Filters on record type and header fields are
pushed into the reader, which inflates headers first and leaves payloads of
rejected records, or all payloads if none are asked for, undecoded.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import new_folder

#: Field -> header line. All are strings but those in NUMBERS.
HEADERS = {"record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_id": "WARC-Record-ID", "payload_digest": "WARC-Payload-Digest",
           "refers_to": "WARC-Refers-To", "page_id": "X-Page-Id", "payload_bytes": "X-Payload-Length"}
NUMBERS = {"page_id", "payload_bytes"}
SCHEMA = "record_type string, target_uri string, record_id string, payload_digest string, refers_to string, page_id long, payload_bytes long, payload binary"
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 16


def _store(path: str):
    """The file system of a path and the path in it; any store that pyarrow reaches."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def record_bytes(fields: dict, payload: bytes | None) -> bytes:
    """One record as a gzip member; header values hold no line ends."""
    body = payload or b""
    lines = ["WARC/1.1"] + [f"{HEADERS[k]}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


class WarcWriter(DataSourceArrowWriter):
    """Writes records; a task's archive appears under its name only when complete."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        rows = 0
        with store.open_output_stream(f"{path}/_{name}.tmp") as out:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                    out.write(record_bytes({k: row.get(k) for k in HEADERS}, row.get("payload")))
                    rows += 1
        return Written(name, rows)

    def commit(self, messages: list) -> None:
        store, path = _store(self.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{path}/_{m.name}.tmp", f"{path}/{m.name}.warc.gz")

    def abort(self, messages: list) -> None:
        store, path = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/_{m.name}.tmp")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class Window:
    """A file read in blocks from a place on."""

    def __init__(self, source, at: int):
        self.source, self.at, self.held = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        block = self.source.read(BLOCK)
        self.held += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split: int):
        self.path, self.columns, self.split, self.wanted = path, columns, split, {}

    def pushFilters(self, filters: list[Filter]):
        """Keeps =, IN on record type and header fields; hands the others back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=False))
        return [Range(f.path, s, min(s + self.split, f.size)) for f in sorted(found, key=lambda x: x.path) if f.path.endswith(".warc.gz") for s in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c in NUMBERS else pa.string()) for c in self.columns])
        held, size = [], 0
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as source:
            for fields, payload in records(source, partition.start, partition.end, self.wanted, "payload" in self.columns):
                fields["payload"] = payload
                held.append({c: fields.get(c) for c in self.columns})
                size += 200 + len(payload or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


def _begins(window: Window, i: int) -> bool:
    """Does a record begin at ``held[i]``: a gzip member whose content starts as a record."""
    while len(window.held) < i + 512 and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.held[i:i + 512], 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records(source, start: int, end: int, wanted: dict[str, set], payloads: bool):
    """(fields, payload) of the records that begin in [start, end) and pass ``wanted``."""
    window = Window(source, start)
    while True:  # find the first record of the range
        i = window.held.find(MAGIC)
        while i >= 0 and not _begins(window, i):
            i = window.held.find(MAGIC, i + 1)
        if i >= 0:
            window.drop(i)
            break
        window.drop(max(0, len(window.held) - 2))
        if window.at >= end or not window.more():
            return
    while window.at < end and (window.held or window.more()):
        member, head, fields, body, keep = zlib.decompressobj(31), b"", None, [], False
        while not member.eof:
            if not window.held and not window.more():
                raise EOFError(f"cut record in {source}")
            data = window.held
            # small steps until the header is there; then large ones, or none kept
            out = member.decompress(data, 2048 if fields is None else 1 << 20)
            window.drop(_used(member, data))
            if fields is None:
                head += out
                stop = head.find(b"\r\n\r\n")
                if stop >= 0:
                    fields = parse(head[:stop].decode("utf-8", "replace"))
                    keep = all(str(fields.get(k)) in v for k, v in wanted.items())
                    if keep and payloads:
                        body.append(head[stop + 4:])
            elif keep and payloads:
                body.append(out)
            if fields is not None and not (keep and payloads):
                _skip(window, member)
        if keep:
            yield fields, b"".join(body)[:fields["content_length"]] if payloads else None


def _used(member, data: bytes) -> int:
    return len(data) - len(member.unused_data if member.eof else member.unconsumed_tail)


def _skip(window: Window, member) -> None:
    """Go to the next record without keeping what is inflated on the way."""
    while not member.eof:
        if not window.held and not window.more():
            raise EOFError("cut record")
        data = window.held
        member.decompress(data, 1 << 20)
        window.drop(_used(member, data))


def parse(head: str) -> dict:
    lines = dict(x.split(": ", 1) for x in head.split("\r\n")[1:] if ": " in x)
    fields = {k: lines.get(v) for k, v in HEADERS.items()}
    for k in NUMBERS:
        fields[k] = int(fields[k]) if fields[k] is not None else None
    fields["content_length"] = int(lines["Content-Length"])
    return fields


class WarcSource(DataSource):
    """``format("warc")``: option path (a folder), splitBytes (bytes a partition, default 32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.fieldNames(), int(self.options.get("splitBytes", 32 << 20)))

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", least: int = 100) -> DataFrame:
    """One WARC record per row of ``pages``.

    Of rows with equal payloads of ``least`` bytes or more, those with the
    smallest page_id are responses, all others revisit it without payload. Null
    html is an empty payload; a null page_id is never the smallest unless all
    are null; equal rows get equal records; a null url has no target line.
    Other columns are not looked at. The smallest id of a payload is found by a
    map-side aggregation of digests, so no group of copies meets in one task.
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("target_uri"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = p.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    p = p.join(first, "payload_digest", "left")
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull())
    return p.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
                    F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
                    F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
                    F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))).alias("refers_to"),
                    "page_id", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def write(pages: DataFrame, path: str, **names) -> None:
    register(pages.sparkSession)
    records_of(pages, **names).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """The records of a folder of archives.

    Spark keeps pushed filters with the loaded relation, so load once for each
    use with filters of its own, also within one query.
    """
    register(spark)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(path)


def archive_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages``, read the archives back, and give one row per record.

    Responses are read with their payload, whose length and digest are taken
    anew; revisits are read by their headers alone.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write(pages, path)
    full = read(spark, path).where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"))
    bare = read(spark, path).where("record_type = 'revisit'").select(
        "page_id", "payload_bytes", F.regexp_extract("payload_digest", "^sha256:(.*)$", 1).alias("payload_digest"), "record_type",
        F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]+)>$", 1).cast("long").alias("refers_to"))
    return full.unionByName(bare)
