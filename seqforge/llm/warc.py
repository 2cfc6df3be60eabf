"""WARC: a writer from DataFrames and a PySpark Python data source that reads archives.

Writing: records are built as strings in the JVM and written by Spark's text sink with the record end as line end, so
that any Hadoop file system, commit protocol and retry works. Of equal payloads, that with the smallest id becomes a
``response``, and the others ``revisit`` records without payload that refer to it; the smallest id of a digest is a
partial aggregate and joins back on the digest, a join whose hot keys Spark can split.

Reading (``format("warc")``): planning lists files and makes a partition of several small ones, or of a range of a large
compressed one: a range reads the gzip members that begin in it, so that an archive of a member per record, as
crawlers write them, is read by many tasks, and one of a single member by the task of its first range. The writer bounds
its own files by ``file_records`` records. Equality and IN predicates on the header columns are pushed down (``spark.sql.python.filterPushdown.enabled``) and decided
from the header block alone; the payload of a record that they reject, or of any record under the option
``payload=false``, is skipped over without being copied or decoded. Records with an ill-formed head end their file with an
error. Options: ``path``, ``payload``, ``split_bytes``.

Defined results: a null payload counts as empty; a null url has no header; line ends in a url are percent-encoded; rows
that repeat write a record each; of rows that share the smallest id and payload all are responses; rows with a null id are
responses unless an id holds their payload, and read back with a null id; very long payloads are written and read whole; an
empty table writes no record; other columns are not looked at.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from seqforge.session import fresh_path, ship_package

END = "\r\n\r\n"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length bigint, content_length bigint, headers map<string,string>, payload binary"
#: Header fields behind the columns on which predicates are pushed down.
HEADER_COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 base32 digits."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """``pages`` with payload_digest, payload_length and refers_to (null: a response)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    out = pages.withColumns({"payload_digest": base32_sha1(payload), "payload_length": F.octet_length(payload).cast("long")})
    first = out.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n"))
    first = first.where("__n > 1").select(F.col("payload_digest").alias("__digest"), "__first")
    out = out.join(first, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_length") >= least), "left")
    copied = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    return out.withColumn("refers_to", F.when(copied, F.col("__first"))).drop("__digest", "__first")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", compression: str = "gzip", file_records: int = 50_000) -> None:
    """Write a record for each row to text files under ``path``."""
    rows = with_revisits(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload")), "id", "payload", least)
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.when(revisit, "").otherwise(F.coalesce("payload", F.lit("")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))), F.lit("WARC-Record-ID: <urn:page:>\r\n")),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_length").cast("string")),
        F.coalesce(F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}\r\n")), F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


def _filesystem(path: str):
    """A pyarrow file system and the path in it; nothing is imported for local paths."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path) if url.scheme else path
    return fs.FileSystem.from_uri(path)


class Files(InputPartition):
    """Whole files, or the gzip members of one that begin in a range of bytes."""

    def __init__(self, files: tuple[str, ...], begin: int = 0, end: int | None = None):
        self.files, self.begin, self.end = files, begin, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", 16 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                field = HEADER_COLUMNS[f.attribute[0]]
                self.wanted[field] = self.wanted[field] & values if field in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, top = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(top, recursive=True)) if system.get_file_info(top).type == fs.FileType.Directory else [system.get_file_info(top)]
        out: list[InputPartition] = []
        own, held = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and posixpath.basename(f.path)[0] not in "._"), key=lambda f: f.path):
            if f.path.endswith(".gz") and f.size > self.split:
                out += [Files((f.path,), i, i + self.split) for i in range(0, f.size, self.split)]
                continue
            if own and held + f.size > self.split:
                out.append(Files(tuple(own)))
                own, held = [], 0
            own.append(f.path)
            held += f.size
        return [*out, *([Files(tuple(own))] if own else [])] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.files:
            ranged = partition.end is not None
            with system.open_input_file(path) if ranged else system.open_input_stream(path, compression=None) as raw:
                stream = Members(raw, partition.begin, partition.end) if ranged else gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for row in records(io.BufferedReader(_Raw(stream), 1 << 20), self.wanted, self.payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


class Members:
    """The content of the gzip members of a file that begin in a range of bytes, one after another."""

    def __init__(self, file, begin: int, end: int, step: int = 1 << 20):
        self.file, self.end, self.step = file, end, step
        self.data, self.at = b"", begin  # what is read and not used yet, and its place in the file
        self.member = None
        file.seek(begin)
        if begin:
            self._find()

    def _more(self) -> bool:
        got = self.file.read(self.step)
        self.data += got
        return bool(got)

    def _drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def _find(self) -> None:
        """Go to the first member in the range: a gzip head whose content begins with a record."""
        while self.at < self.end:
            i = self.data.find(b"\x1f\x8b\x08")
            if i < 0:
                self._drop(max(0, len(self.data) - 2))
                if not self._more():
                    self._drop(len(self.data))
                    self.at = self.end
                continue
            self._drop(i)
            while len(self.data) < 4096 and self._more():
                pass
            try:
                if zlib.decompressobj(31).decompress(self.data[:4096], 7) == b"WARC/1.":
                    return
            except zlib.error:
                pass
            self._drop(1)

    def read(self, size: int) -> bytes:
        while True:
            if self.member is None:
                if self.at >= self.end or not (self.data or self._more()):
                    return b""
                self.member = zlib.decompressobj(31)
            if not self.data and not self._more() and not self.member.unconsumed_tail:
                raise ValueError("a gzip member is cut off")
            out = self.member.decompress(self.data, size)
            left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self._drop(len(self.data) - len(left))
            if self.member.eof:
                self.member = None
            if out:
                return out


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def records(stream: io.BufferedReader, wanted: dict[str, set[str]], with_payload: bool = True) -> Iterator[tuple]:
    """The rows of SCHEMA of the records whose header fields are in ``wanted``."""
    while True:
        version = stream.readline()
        if not version:
            return
        if version == b"\r\n":
            continue
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        kept = all(head.get(k) in v for k, v in wanted.items())
        if kept and with_payload:
            payload = stream.read(size)
            if len(payload) < size:
                raise ValueError("a record is cut off")
        else:
            payload, left = None, size
            while left:
                left -= (got := len(stream.read(min(left, 1 << 20))))
                if not got:
                    raise ValueError("a record is cut off")
        if kept:
            length = head.get("x-payload-length")
            yield (*(head.get(h) for h in HEADER_COLUMNS.values()), int(length) if length else None, size, list(head.items()), payload)


_ARROW = pa.schema([*((c, pa.string()) for c in HEADER_COLUMNS), ("payload_length", pa.int64()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and describe each record."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    revisit = F.col("record_type") == "revisit"
    return read_warc(pages.sparkSession, path).select(
        page(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha1:", "")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') h from pages),
d as materialized (select page_id, cast(strlen(h) as bigint) payload_bytes, sha1(h) hex from p),
b as (select page_id, payload_bytes, min(page_id) over (partition by hex) f,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(hex, 5 * cast(floor(i / 4) as int) + 1, 5) as bigint) >> (5 * (3 - i % 4))) & 31 as int), 1)), '') payload_digest from d)
select page_id, payload_bytes, payload_digest, case when page_id = f then 'response' else 'revisit' end record_type,
  case when page_id = f then null else f end refers_to from b
"""
