"""WARC archives as a Spark data source, with revisit records for repeated payloads.

``spark.read.format("warc")`` plans its partitions over the files of a folder: small
files share one, larger ones have their own. A task parses the header of a record
first and holds it against the predicates that Spark pushed down (record type, ids,
target, digest, length); only the payload of a record that passes is inflated and
decoded. What fails is skipped by the lengths that the writer put into the gzip
header of each record (the ``sl`` field of the WARC specification), or inflated
and dropped where an archive has none. ``payloads=false`` reads headers only.
Spark 4.1 keeps what one query pushed down for later queries on the same loaded frame, so
every query loads a frame of its own, as ``read`` does.

``df.write.format("warc")`` writes one gzip member a record into files of bounded
size. Files count once the driver has listed them in the folder's ``manifest-``
files, so what a lost or repeated task left behind is never read.

Defined cases: a null payload is an empty one, a null URL no target; characters of a
URL that a header can't hold are percent-encoded. Payloads are written whole, however
long, one record at a time. Of equal payloads of ``LEAST`` bytes or more, the record
with the smallest page id is the response and the others are revisits of it; null ids
come last, and if all are null, all are responses. Repeated rows with that smallest id are responses, too. Each
row gives one record. Other columns are ignored, whatever their names; an empty table
gives an archive without records.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from treeq.llm.common import Scratch, bounded, documents

#: Bytes of payload from which on equal ones are written once.
LEAST = 100
#: Compressed bytes after which a task begins another file, and those that a reading task gets at least.
FILE, TOGETHER = 128 << 20, 16 << 20
#: Bytes of payload, and records, that leave a reading task at once.
AT_ONCE, ROWS = 8 << 20, 4096
#: Bytes that are read from an archive at once.
READ = 1 << 20
VERSION = b"WARC/1.1"

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, http string, payload binary"
)
#: Columns that come from a record's own headers.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}


class Files(InputPartition):
    """Paths of the archives that one task reads."""


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path there."""
    if ":" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    # Hadoop writes file:/a where a URI has file:///a
    return pafs.FileSystem.from_uri(f"{scheme}://{rest}" if scheme == "file" and not rest.startswith("//") else path)


def archives(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    """The files of a folder: those that manifests list, or all archives of a foreign folder; or the one file."""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    found = [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.File]
    lists = [x for x in found if x.base_name.startswith("manifest-")]
    if lists:
        names: set[str] = set()
        for x in lists:
            with fs.open_input_stream(x.path) as f:
                names.update(json.loads(f.read()))
        found = [x for x in found if x.base_name in names]
    else:
        found = [x for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
    return sorted(found, key=lambda x: x.path)


class WarcSource(DataSource):
    """Options: ``path``, and ``payloads`` (``false`` leaves all payloads null)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode('append') and a folder of their own")
        return WarcWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to a session, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, at: str, condition: str = "true", payloads: bool = True) -> DataFrame:
    """The records of the archives in a folder that a SQL condition on ``SCHEMA`` selects."""
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(at).filter(condition)


_COMPARE = {
    EqualTo: lambda x, y: x == y,
    In: lambda x, y: x in y,
    StringStartsWith: lambda x, y: x.startswith(y),
    GreaterThan: lambda x, y: x > y,
    GreaterThanOrEqual: lambda x, y: x >= y,
    LessThan: lambda x, y: x < y,
    LessThanOrEqual: lambda x, y: x <= y,
}


def passes(filters: list[Filter], values: dict) -> bool:
    for f in filters:
        x = values[f.attribute[0]]
        if isinstance(f, (IsNull, IsNotNull)):
            if (x is None) != isinstance(f, IsNull):
                return False
        elif x is None or not _COMPARE[type(f)](x, f.value):
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.early, self.late = path, payloads, [], []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            known = type(f) in _COMPARE or isinstance(f, (IsNull, IsNotNull))
            if known and column in HEADERS:
                self.early.append(f)
            elif known and column == "payload_length":
                self.late.append(f)  # of the HTTP header, which is in the block
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = located(self.path)
        planned, own, total = [], [], 0
        for x in archives(fs, root):
            own.append(x.path)
            total += x.size
            if total >= TOGETHER:
                planned.append(Files(own))
                own, total = [], 0
        if own or not planned:
            planned.append(Files(own))
        return planned

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = located(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for path in partition.value:
            with fs.open_input_file(path) as file:
                for row in records(file, self.early, self.late, self.payloads):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size >= AT_ONCE or len(rows) >= ROWS:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class Plain:
    """The bytes of an archive without compression, from record to record."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def record(self) -> bool:
        """Moves to the next record; whether there is one."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not self.more():
                return bool(self.held)

    def more(self) -> bool:
        data = self.file.read(READ)
        self.held += data
        return bool(data)

    def until(self, mark: bytes) -> bytes:
        """What comes up to ``mark``, which is taken, too."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.more():
                raise ValueError(f"an archive ends within a header: {self.held[:80]!r}")
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts = [self.held[:n]]
        self.held = self.held[n:]
        got = len(parts[0])
        while got < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
            parts.append(self.held[: n - got])
            self.held = self.held[n - got :]
            got += len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""

    def finish(self) -> None:
        """Called when a record is done with."""


class Members(Plain):
    """The same of an archive with one gzip member a record."""

    def __init__(self, file):
        super().__init__(file)
        self.raw, self.at, self.inflate, self.length = b"", 0, None, None

    def record(self) -> bool:
        """``at`` is where the next member begins."""
        while True:
            self.file.seek(self.at)
            self.raw, self.held = self.file.read(1 << 12), b""
            if not self.raw:
                return False
            self.length = member_length(self.raw)
            self.inflate, self.fed = zlib.decompressobj(wbits=31), 0
            if Plain.record(self):
                return True
            self.finish()  # a member that is empty

    def more(self) -> bool:
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.file.read(READ)
                if not self.raw:
                    raise ValueError("an archive ends within a gzip member")
            data = self.inflate.decompress(self.raw, READ)
            used = len(self.raw) - len(self.inflate.unconsumed_tail) - len(self.inflate.unused_data)
            self.fed += used
            self.raw = self.inflate.unconsumed_tail
            if data:
                self.held += data
                return True
        return False

    def skip(self, n: int) -> None:
        if self.length is None:
            while n > len(self.held):  # the end of the member is only known from inflating it
                n -= len(self.held)
                self.held = b""
                if not self.more():
                    raise ValueError("an archive ends within a record")
            self.held = self.held[n:]

    def finish(self) -> None:
        if self.length is None:
            while self.more():
                self.held = b""
            self.at += self.fed
        else:
            self.at += self.length


def member_length(raw: bytes) -> int | None:
    """The compressed length of a member, from its ``sl`` field."""
    if len(raw) >= 12 and raw[3] & 4:
        stop = 12 + struct.unpack_from("<H", raw, 10)[0]
        at = 12
        while at + 4 <= min(stop, len(raw)):
            n = struct.unpack_from("<H", raw, at + 2)[0]
            if raw[at : at + 2] == b"sl" and n == 8 and at + 8 <= len(raw):
                return struct.unpack_from("<I", raw, at + 4)[0] or None
            at += 4 + n
    return None


def member(data: bytes) -> bytes:
    """A gzip member with its own and the inflated length in front, unless they need over 32 bits."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    lengths = struct.pack("<II", whole, len(data)) if max(whole, len(data)) < 1 << 32 else bytes(8)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + lengths
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; folded lines belong to the one before."""
    found: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def records(file, early: list[Filter], late: list[Filter], payloads: bool) -> Iterator[dict]:
    """Rows of the records that pass, from one open archive."""
    gzipped = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    source = Members(file) if gzipped else Plain(file)
    while source.record():
        head = fields(source.until(b"\r\n\r\n"))
        left = int(head.get("content-length", 0))
        row = {k: head.get(name.lower()) for k, name in HEADERS.items()}
        if passes(early, row):
            http = None
            if head.get("content-type", "").startswith("application/http"):
                held = source.until(b"\r\n\r\n")
                left -= len(held) + 4
                http = held.decode("utf-8", "replace")
                # a revisit's block has the HTTP header of what it refers to, and no payload
                length = int(fields(held).get("content-length", left))
            else:
                length = left
            row |= {"payload_length": length, "http": http, "payload": None}
            if passes(late, row):
                if payloads and row["record_type"] != "revisit":
                    row["payload"], left = source.take(left), 0
                yield row
        source.skip(left)
        source.finish()


class WarcWriter(DataSourceArrowWriter):
    """Columns: those of ``SCHEMA``; ``payload_length`` and ``payload_digest`` are of the whole payload."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = located(self.path)
        fs.create_dir(root, recursive=True)
        done, out, size = Written(), None, 0
        try:
            for batch in iterator:
                columns = dict(zip(self.names, batch.columns))
                for i in range(batch.num_rows):  # one record at a time, as payloads may be long
                    data = member(record({k: c[i].as_py() for k, c in columns.items()}))
                    if out is None:
                        done.names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{done.names[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
                    if size >= FILE:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages) -> None:
        """The names of a job's files: a few for each task."""
        fs, root = located(self.path)
        fs.create_dir(root, recursive=True)
        names = [n for m in messages if m for n in m.names]
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages) -> None:
        fs, root = located(self.path)
        for name in [n for m in messages if m for n in m.names]:
            fs.delete_file(f"{root}/{name}")


def record(row: dict) -> bytes:
    """The bytes of one record: a response with its payload, or a revisit without."""
    revisit = row["record_type"] == "revisit"
    payload = row.get("payload") or b""
    lines = [VERSION]
    own = {name: row.get(k) for k, name in HEADERS.items()}
    if revisit:
        own["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_length"]
    body = http if revisit else http + payload
    own |= {"WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    for name, value in own.items():
        if value is not None:
            safe = quote(value, safe="".join(map(chr, range(0x21, 0x7F)))) if name == "WARC-Target-URI" else value
            lines.append(f"{name}: {safe}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def archive(pages: DataFrame, at: str, least: int = LEAST) -> None:
    """Writes ``pages(page_id, url, html)`` into a folder of archives."""
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    sized = sized.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # only repeated payloads come back: a row for each of them, not for each page
    first = sized.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.filter("copies > 1 AND first IS NOT NULL").select(F.col("digest").alias("__d"), "first")
    first = Scratch(pages.sparkSession, "warc").save(first, "repeated")
    joined = sized.join(bounded(first), F.col("digest") == F.col("__d"), "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined.select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        page_urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisits, page_urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(at)


def page_of(urn: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(.*)>$', 1) AS bigint)")


def read_pages(spark: SparkSession, at: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, as read back.

    Length and digest of a response are those of the payload that is read. A revisit has those
    of the response it refers to; the join is on its digest, too, which so is verified.
    """
    responses = read(spark, at, "record_type = 'response'")
    responses = responses.select(page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    responses = Scratch(spark, "warc").save(responses, "responses")
    revisits = read(spark, at, "record_type = 'revisit'", payloads=False)
    revisits = revisits.select(page_of("record_id").alias("page_id"), page_of("refers_to").alias("refers_to"), F.regexp_replace("payload_digest", "^sha256:", "").alias("claimed"))
    kept = responses.select(F.col("page_id").alias("__p"), F.col("payload_digest"), "payload_bytes").distinct()
    revisits = revisits.join(kept, (F.col("refers_to") == F.col("__p")) & (F.col("claimed") == F.col("payload_digest")), "left")
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    revisits = revisits.select("page_id", F.coalesce("payload_bytes", missing.cast("long")).alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    responses = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    return responses.unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark, "warc").path("archive")
    archive(documents(spark, sf_dir, "pages"), at)
    return read_pages(spark, at)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
s AS (SELECT page_id, strlen(payload) AS n, sha256(payload) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM s WHERE n >= 100 GROUP BY d)
SELECT s.page_id, n AS payload_bytes, s.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND s.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND s.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM s LEFT JOIN f ON s.d = f.d
"""
