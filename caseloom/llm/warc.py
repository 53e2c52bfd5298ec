"""WARC archives as a PySpark data source.

Writing: each task writes archives of gzip members, one record a member, whose
header carries the member's length (the ``sl`` extra field), and rolls over to a
new file at a size limit. The job commits by one list of the files that its tasks
wrote; of such files only listed ones are read, so a lost or repeated task leaves
nothing to be seen, and no file is renamed.

Reading: the driver plans partitions of whole files up to a size limit. Filters
on the record type and on other header columns are pushed down; a record's headers are
parsed first, and where the headers fail them, or payloads are not wanted, the rest of the
member is skipped (or passed over, if another program wrote it without its length).
A file is read once from front to back through one buffer; what is skipped inside the
buffer costs nothing, and only what reaches beyond it is left unread by a seek.

Folders are reached through pyarrow's file systems, so local, HDFS and object
stores work alike.

Nulls and odd input: a null payload is an empty one, null header fields are left
out, a null record type is ``resource``; repeated rows are records of their own;
an empty table gives a folder without archives, which reads as no rows; a very long
payload is one record, held whole by the task that writes or decodes it; columns of
other names are not written.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import SLICE_ROWS, bitmap_bucket, bitmap_may_hold, bound_batches, key_bitmap, scratch_path, stash

SUFFIX = ".warc.gz"
FILE_BYTES = 32 << 20
PARTITION_BYTES = 64 << 20
#: Names of the files that this source writes, and of the lists that commit them.
PART, LIST = "part-", "_committed-"
#: Payloads from this size on are stored once.
LEAST_SHARED_BYTES = 1000
#: Bytes read at once, and bytes of a record that hold the member's length and most headers.
_READ_BYTES, _LEAST_BYTES = 1 << 16, 1 << 10
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Header names of the columns that come from a field of their own.
_FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length"}
_ANGLED = {"record_id", "refers_to"}


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"\w+:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def _record(row: dict, now: str) -> bytes:
    """One record as a gzip member that carries its own length."""
    kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
    block = _HTTP + (b"" if kind == "revisit" else payload) if kind in ("response", "revisit") else payload
    lines = ["WARC/1.1"]
    for column, name in _FIELDS.items():
        value = {"record_type": kind, "warc_date": row.get("warc_date") or now}.get(column, row.get(column))
        if value is not None:
            lines.append(f"{name}: " + (f"<{value}>" if column in _ANGLED else re.sub(r"[\r\n]+", " ", str(value))))
    lines.append("Content-Type: " + ("application/http; msgtype=response" if kind in ("response", "revisit") else "application/octet-stream"))
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff"
    total = len(head) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _file_system(self.path)
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        fs.create_dir(folder, recursive=True)
        files, out = [], None
        for batch in iterator:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(at, SLICE_ROWS).to_pylist():
                    if out is None:
                        files.append(f"{PART}{uuid.uuid4().hex}{SUFFIX}")
                        out = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None)
                    out.write(_record(row, now))
                    if out.tell() >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = _file_system(self.path)
        fs.create_dir(folder, recursive=True)
        names = [name for message in messages if message for name in message.files]
        with fs.open_output_stream(f"{folder}/.{LIST}tmp-{(mine := uuid.uuid4().hex)}") as out:
            out.write("\n".join(names).encode())
        fs.move(f"{folder}/.{LIST}tmp-{mine}", f"{folder}/{LIST}{mine}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = _file_system(self.path)
        for message in messages:
            for name in message.files if message else []:
                fs.delete_file(f"{folder}/{name}")


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """Options: ``payload`` (false: payloads are not decoded), ``partitionBytes``."""

    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes = path, payload, partition_bytes
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _FIELDS and column != "payload_bytes" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif column != "record_type" or not isinstance(f, IsNotNull):  # every record has a type
                yield f

    def partitions(self) -> list[Files]:
        fs, folder = _file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        committed: set[str] = set()
        for info in found:
            if info.base_name.startswith(LIST):
                with fs.open_input_file(info.path) as file:
                    committed |= set(file.read().decode().split("\n"))
        there = [i for i in found if i.base_name.endswith(SUFFIX) and (i.base_name in committed if i.base_name.startswith(PART) else i.base_name[0] not in "._")]
        parts, held = [], self.partition_bytes
        for info in sorted(there, key=lambda i: i.path):
            if held + info.size > self.partition_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(info.path)
            held += info.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for row in self._records(file):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 1000 or held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, file) -> Iterator[dict]:
        ahead, at = _Ahead(file), 0
        while at < ahead.size:
            data = ahead.from_(at, _LEAST_BYTES)
            length = struct.unpack("<I", data[16:20])[0] if data[3] == 4 and data[12:14] == b"sl" else None
            data = data[:length]
            unpacker = zlib.decompressobj(31)
            text = unpacker.decompress(data, 4096)
            read = len(data)

            def more(unpacker=unpacker, at=at) -> bytes:
                nonlocal read
                if unpacker.unconsumed_tail:
                    return unpacker.decompress(unpacker.unconsumed_tail, 1 << 20)
                chunk = ahead.from_(at + read, 1)
                read += len(chunk)
                return unpacker.decompress(chunk, 1 << 20)

            while (end := text.find(b"\r\n\r\n")) < 0 and not unpacker.eof:
                text += more()
            row = _header(text[:end].decode("utf-8", "replace"))
            matches = all(row.get(c) in values for c, values in self.wanted.items())
            decode = matches and self.payload
            if decode or length is None:
                parts = [text[end + 4 :]]
                while not unpacker.eof:
                    part = more()
                    if decode:
                        parts.append(part)
                    elif not part and not unpacker.unconsumed_tail and read + at >= ahead.size:
                        break
                length = length or read - len(unpacker.unused_data)
                if decode:
                    block = b"".join(parts)[: row["content_length"]]
                    row["payload"] = block.split(b"\r\n\r\n", 1)[-1] if row["http"] else block
            if matches:
                yield row
            at += length


class _Ahead:
    """A file read from front to back through one buffer; places beyond the buffer are sought."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.start, self.data = 0, b""

    def from_(self, at: int, least: int) -> bytes:
        """What is known of the file from ``at`` on, ``least`` bytes or more where the file has them."""
        held = self.data[at - self.start :] if at - self.start <= len(self.data) else b""
        if len(held) < min(least, self.size - at):
            if at - self.start > len(self.data):
                self.file.seek(at)
            held += self.file.read(_READ_BYTES)
            self.start, self.data = at, held
        return held


def _header(text: str) -> dict:
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.split("\r\n")[1:])}
    row: dict = {c: fields.get(name.lower()) for c, name in _FIELDS.items()}
    for c in _ANGLED:
        row[c] = row[c].strip("<>") if row[c] is not None else None
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
    return row | {"payload": None, "content_length": int(fields.get("content-length", 0)), "http": fields.get("content-type", "").startswith("application/http")}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [*_FIELDS, "payload"]
    order = [f.split()[0] for f in _SCHEMA.split(", ")]
    assert set(order) == set(names)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in order], order)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bound_batches(spark)
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame) -> DataFrame:
    """A record per page: pages whose payload of at least ``LEAST_SHARED_BYTES`` equals that of a later page revisit the last of them.

    Only digests are grouped. Payloads whose digest a bitmap of the shared ones rules
    out stay where they are; the others are shuffled to meet their group.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    typed = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    typed = typed.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    shared = typed.where(F.col("payload_bytes") >= LEAST_SHARED_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = stash(shared.where((F.col("n") > 1) & F.col("first").isNotNull()).select("payload_digest", "first"), "shared")
    key = F.xxhash64("payload_digest")
    marked = typed.join(F.broadcast(key_bitmap(shared.select(key.alias("k")), "k")), bitmap_bucket(key) == F.col("bucket"), "left")
    may = bitmap_may_hold(F.col("bits"), key)
    alone = marked.where(~may).select(*typed.columns, F.lit(None).cast(pages.schema["page_id"].dataType).alias("first"))
    met = marked.where(may).select(*typed.columns).join(shared, "payload_digest", "left")
    joined = alone.unionByName(met)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), "target_uri", F.lit(None).cast("string").alias("warc_date"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"), F.when(revisit, urn(F.col("first"))).alias("refers_to"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured on their decoded payloads; revisits are read from their headers alone.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as {pages.schema['page_id'].dataType.simpleString()})")
    whole = spark.read.format("warc").load(path).where(F.col("record_type") == "response")
    whole = whole.select(page("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    headers = spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_type") == "revisit")
    headers = headers.select(page("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return whole.union(headers)
