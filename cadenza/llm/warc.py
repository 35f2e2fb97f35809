"""WARC archives as a PySpark data source, and a deduplicating writer on top of it.

Format `warc`, columns RECORD. Writing makes one or more archives per partition, each record a gzip member of its
own (option `compression` "none": plain), whose extra field `sl` holds the member's length as stored and inflated.
Files are written under a temporary name and renamed when the job commits, so a retried or lost task leaves no
archive. Reading plans partitions of whole files of about PARTITION_BYTES each. Filters on any column but the payload
are pushed down: a record's headers are parsed first, and if a filter rejects them, or the payload is not among the
columns of the schema, the payload is skipped: in a plain archive, and in a compressed one with such lengths, by
seeking; in other compressed ones by inflating it in small pieces that are dropped. Archives of others may hold
several records in a member, and headers in any case. An archive that ends inside a record raises an error. Files are
reached through pyarrow's file systems, so paths may be local, HDFS or object stores.

`archive_pages` writes pages so that of equal payloads of at least MIN_REVISIT bytes one is stored, as a response,
and the others are revisits that refer to it.

Defined cases: a null html is an empty payload; a null url leaves out its header; line ends in a url are percent-encoded;
a null page_id revisits the least id with its payload and is a response where it stands alone; rows that repeat the
least id are responses each; an empty table makes an empty archive folder, which reads as no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_folder, stage

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
MIN_REVISIT = 100
PARTITION_BYTES = 64 << 20
ROLL_BYTES = 1 << 30
_BATCH_BYTES = 8 << 20
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length"}
_ARROW = {"payload_bytes": pa.int64(), "payload": pa.binary()}
#: Archives are made alike on every run.
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _escaped(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def to_bytes(record: dict) -> bytes:
    """A record, with empty lines after it."""
    lines = ["WARC/1.1", f"WARC-Date: {_DATE}"]
    lines += [f"{header}: {_escaped(str(record[name]))}" for name, header in _HEADERS.items() if record.get(name) is not None]
    payload = record.get("payload") or b""
    if record.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {_PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def to_member(data: bytes) -> bytes:
    """A gzip member of `data`, with its lengths in the extra field `sl`."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 24 + len(body) + 8
    lengths = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)  # 0: unknown
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_lengths(head: bytes) -> tuple[int, int]:
    """(stored, inflated) length of the gzip member that starts with `head`; (0, 0) where it does not say."""
    if len(head) >= 12 and head[3] & 4:
        at, end = 12, 12 + int.from_bytes(head[10:12], "little")
        while at + 4 <= min(end, len(head)):
            size = int.from_bytes(head[at + 2 : at + 4], "little")
            if head[at : at + 2] == b"sl" and size == 8 and at + 12 <= len(head):
                return struct.unpack("<II", head[at + 4 : at + 12])
            at += 4 + size
    return 0, 0


def parse_headers(block: bytes) -> dict:
    """The columns that a record's headers hold, and its content length as `length`; header names in any case."""
    lines = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    found = {name.strip().lower(): value.strip() for name, value in lines}
    if not found.get("content-length", "").isdigit():
        raise ValueError("a record without a content length")
    out: dict = {name: found.get(header.lower()) for name, header in _HEADERS.items()}
    out["payload_bytes"] = None if out["payload_bytes"] is None else int(out["payload_bytes"])
    return out | {"length": int(found["content-length"])}


class _Plain:
    """A plain archive, record by record."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def _more(self, most: int) -> bytes:
        """Some of the next bytes; none at the end of the archive."""
        return self.file.read(max(most, 1 << 14))

    def headers(self) -> bytes | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            more = self._more(1024)
            if not more:
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
            self.held += more
        block, self.held = self.held[:end], self.held[end + 4 :]
        return block

    def payload(self, length: int) -> bytes:
        parts, left = [self.held], length + 4 - len(self.held)
        while left > 0:
            parts.append(self._piece(left))
            left -= len(parts[-1])
        whole = b"".join(parts)
        body, self.held = whole[:length], whole[length + 4 :]
        return body

    def _piece(self, most: int) -> bytes:
        more = self._more(min(most, 1 << 20))
        if not more:
            raise ValueError("the archive ends inside a record")
        return more

    def skip(self, length: int) -> None:
        left = length + 4 - len(self.held)
        if left > 0:
            self.held = b""
            if self.file.tell() + left > self.file.size():
                raise ValueError("the archive ends inside a record")
            self.file.seek(self.file.tell() + left)
        else:
            self.held = self.held[length + 4 :]


class _Gzip(_Plain):
    """A compressed archive: the members' contents, laid end to end."""

    def __init__(self, file):
        super().__init__(file)
        self.raw, self.member, self.inflated = b"", None, 0

    def _fill(self, least: int) -> bool:
        """Whether `least` bytes are at hand of the archive as stored."""
        while len(self.raw) < least:
            more = self.file.read(1 << 18)
            if not more:
                return False
            self.raw += more
        return True

    def _more(self, most: int) -> bytes:
        while True:
            if self.member is None:
                if not self._fill(1):
                    return b""
                self._fill(64)
                self.start, (self.stored, self.whole) = self.file.tell() - len(self.raw), _member_lengths(self.raw)
                self.member, self.inflated = zlib.decompressobj(31), 0
            if not self._fill(1):
                raise ValueError("the archive ends inside a record")
            out = self.member.decompress(self.raw, most)
            self.inflated += len(out)
            ended = self.member.eof
            self.raw = self.member.unused_data if ended else self.member.unconsumed_tail
            if ended:
                self.member = None
            if out:
                return out

    def skip(self, length: int) -> None:
        left = length + 4 - len(self.held)
        if left > 0 and self.member is not None and self.stored and self.inflated + left == self.whole:
            end, at = self.start + self.stored, self.file.tell()
            if end > self.file.size():
                raise ValueError("the archive ends inside a record")
            if end > at:
                self.file.seek(end)
            self.raw, self.member, self.held = self.raw[len(self.raw) - (at - end) :] if end <= at else b"", None, b""
            return
        if left <= 0:
            self.held = self.held[length + 4 :]
        while left > 0:
            more = self._piece(min(left, 1 << 14))
            self.held = more[left:]
            left -= len(more)


def _accepts(filters: Sequence[Filter], record: dict) -> bool:
    for f in filters:
        value = record[f.attribute[0]]
        if isinstance(f, IsNull):
            good = value is None
        elif isinstance(f, IsNotNull):
            good = value is not None
        elif isinstance(f, EqualNullSafe):
            good = value == f.value
        elif value is None:
            good = False
        elif isinstance(f, EqualTo):
            good = value == f.value
        elif isinstance(f, In):
            good = value in f.value
        else:
            good = value.startswith(f.value)
        if not good:
            return False
    return True


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.columns, self.filters = options["path"], schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters on header columns; what it leaves is up to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, path = _file_system(self.path)
        infos = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and re.search(r"\.warc(\.gz)?$", i.path) and not i.base_name.startswith(("_", ".")))
        out, room = [], 0
        for name, size in files:
            if size > room:
                out.append(_Files([]))
                room = PARTITION_BYTES
            out[-1].paths.append(name)
            room -= size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        with_payload, rows, held = "payload" in self.columns, [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                archive = _Gzip(file) if path.endswith(".gz") else _Plain(file)
                while (block := archive.headers()) is not None:
                    record = parse_headers(block)
                    length = record.pop("length")
                    if not _accepts(self.filters, record):
                        archive.skip(length)
                        continue
                    if with_payload:
                        record["payload"] = archive.payload(length)
                        held += length
                    else:
                        archive.skip(length)
                    rows.append(record)
                    if held > _BATCH_BYTES or len(rows) >= 4096:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _ARROW.get(c, pa.string())) for c in self.columns], self.columns)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") != "none"
        self.run = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _file_system(self.path)
        system.create_dir(path)
        names, file, size = [], None, 0
        try:
            for batch in iterator:
                for record in batch.to_pylist():
                    data = to_bytes(record)
                    if self.gzip:
                        data = to_member(data)
                    if file is None or size + len(data) > ROLL_BYTES:
                        if file:
                            file.close()
                        names.append(f"{self.run}-{context.partitionId():06d}-{context.taskAttemptId()}-{len(names):04d}.warc{'.gz' * self.gzip}")
                        file, size = system.open_output_stream(f"{path}/_{names[-1]}", compression=None), 0
                    file.write(data)
                    size += len(data)
        finally:
            if file:
                file.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, path = _file_system(self.path)
        system.create_dir(path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(path)):
                if info.is_file and not info.base_name.startswith("_"):
                    system.delete_file(info.path)
        for name in [n for m in messages if m for n in m.names]:
            system.move(f"{path}/_{name}", f"{path}/{name}")
        self._clear(system, path)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, system, path: str) -> None:
        """Remove what this run's failed or doubled attempts left."""
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith(f"_{self.run}-"):
                system.delete_file(info.path)


class WarcDataSource(DataSource):
    """spark.read.format("warc"), df.write.format("warc")."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it push filters to Python data sources (off by default)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of pages (page_id, url, html), with the columns of RECORD."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("payload_bytes") >= MIN_REVISIT)
    shared = stage(large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    joined = rows.join(shared, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        name("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, name("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write `pages` to archives in the folder `path`."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of archived pages.

    Lengths and digests of responses are those of the payloads as read; of revisits, those in their headers, and no
    payload is decoded for them.
    """
    register(spark)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    headers = StructType([f for f in StructType.fromDDL(RECORD).fields if f.name != "payload"])
    responses = spark.read.format("warc").load(path).where("record_type = 'response'").withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    revisits = spark.read.format("warc").schema(headers).load(path).where("record_type = 'revisit'").withColumn("payload_digest", F.substring_index("payload_digest", ":", -1))
    return responses.unionByName(revisits).select(page("record_id").alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_folder(spark)
    archive_pages(pages, path)
    return read_pages(spark, path).drop("url")
