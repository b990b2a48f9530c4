"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by page_id; every range is one shard, written by one
task into files that are rolled when their compressed size reaches ROLL_BYTES.
Headers are made anew: record ids derive from page id and payload digest, dates
are fixed, digests are computed from the payload.  Of equal payloads of at least
MIN_PAYLOAD bytes the one of the largest page_id is the response, all others
revisit it (identical-payload-digest, no body).

Recovery: a task writes each file under a temporary name and renames it when it
is whole, under a name that depends on the shard alone, so that a repeated or
speculative task yields the same bytes; the manifest, a table of its own, is
written last and names the files that count.  Readers take files from the
manifest only.

Defined results: null html is the empty payload; a null page_id is kept (empty
id in the headers) and never the response of another id; pages of one page_id
and payload are each a record, all but one revisits of that id; a null or empty
url becomes urn:page:<id>; an empty table gives no files and an empty manifest;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch, ship, written
from .sharedfs import opened, temporary

ROLL_BYTES = 64 << 20
MIN_PAYLOAD = 0
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4
MANIFEST = "shard int, file string, records long, bytes long, first_page long, last_page long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"


def pages_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def responses(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, digest, size, refers_to (null: a response) without payloads.

    The digest's largest page_id is found by partial aggregation and joined back;
    a digest that many pages share is one row on one side, so that Spark can
    split the other.
    """
    own = pages_of(pages).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    best = own.where(F.col("size") >= min_payload).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("best"))
    return own.join(best, F.col("digest") == F.col("d"), "left").select("page_id", "digest", "size", F.when((F.col("size") >= min_payload) & (F.col("best") != F.coalesce("page_id", F.lit(-(2**63)))), F.col("best")).alias("refers_to"))


def header_value(text: str) -> str:
    """A value that cannot break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_id(page_id, digest: str, copy: int) -> str:
    h = hashlib.sha1(f"{page_id}/{digest}/{copy}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id, url: str, payload: bytes, refers_to, copy: int = 0) -> bytes:
    """One record, as bytes of WARC/1.1."""
    digest = base32(hashlib.sha1(payload).digest())
    revisit = refers_to is not None
    block = b"" if revisit else payload
    own = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url) or f'urn:page:{own}'}",
        f"WARC-Page-ID: {own}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[7:7] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


class Shard:
    """The rolling files of one shard."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.folder, self.shard, self.roll = folder, shard, roll
        self.rows: list[tuple] = []
        self.out = None

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{len(self.rows):05d}.warc.gz"
            self.system, top = opened(self.folder)
            self.path = f"{top}/{self.name}"
            self.temporary = temporary(self.path)
            self.out = self.system.open_output_stream(self.temporary, compression=None)
            self.size = self.count = 0
            self.first = page_id
        packed = member(data)
        self.out.write(packed)
        self.size, self.count, self.last = self.size + len(packed), self.count + 1, page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.temporary, self.path)
            self.rows.append((self.shard, self.name, self.count, self.size, self.first, self.last))
            self.out = None


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write all pages under a shared folder; the manifest, as a table in it."""
    spark = pages.sparkSession
    ship(spark)
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    # what a page refers to travels beside its payload and meets it in the same range: only one exchange moves payloads
    known = responses(pages, min_payload).select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", F.lit("").alias("url"), F.lit("").alias("html"))
    own = pages_of(pages).select("page_id", F.lit(1).alias("kind"), F.sha1(F.col("html").cast("binary")).alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    dealt = known.unionByName(own).repartitionByRange(partitions(spark), "page_id").sortWithinPartitions("page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = Shard(folder, TaskContext.get().partitionId(), roll)
        held, waiting, copies = None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, kind, digest, refers_to, url, html in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if (page_id, digest) != held:
                        held, waiting, copies = (page_id, digest), [], 0
                    if not kind:
                        waiting.append(refers_to)
                        continue
                    refers = waiting[0]
                    if copies and refers is None and page_id is not None and len(html.encode()) >= min_payload:
                        refers = page_id  # a repeated row revisits its first
                    shard.add(page_id, record(page_id, url, html.encode("utf-8", "surrogatepass"), refers, copies))
                    copies += 1
        shard.close()
        rows = list(zip(*shard.rows, strict=True)) if shard.rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "file", "records", "bytes", "first_page", "last_page"])

    return written(dealt.mapInArrow(run, MANIFEST), f"{folder}/manifest")


def members(data) -> Iterator[bytes]:
    """Records of a stream of gzip members, read in pieces; data: calls for the next bytes."""
    held = data()
    while held:
        inflate = zlib.decompressobj(31)
        out = [inflate.decompress(held)]
        while not inflate.eof:
            more = data()
            if not more:
                raise ValueError("a WARC file ends within a record")
            out.append(inflate.decompress(more))
        held = inflate.unused_data or data()
        yield b"".join(out)


def parsed(data: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, block; checks lengths and digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if f"sha1:{base32(hashlib.sha1(block).digest())}" != fields["warc-block-digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is damaged")
    number = lambda x: int(x) if x else None
    return number(fields["warc-page-id"]), fields["warc-target-uri"], int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], number(fields.get("warc-refers-to-page-id")), block


def read(manifest: DataFrame, folder: str, blocks: bool = True) -> DataFrame:
    """All records of the manifest's files; without blocks, their column is null."""
    ship(manifest.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name in part.column("file").to_pylist():
                system, top = opened(folder)
                rows, size = [], 0
                with system.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for data in members(lambda: f.read(1 << 20)):
                        row = parsed(data)
                        rows.append(row if blocks else (*row[:6], None))
                        size += len(data) if blocks else 200
                        if size > 4_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = manifest.select("file")
    n = max(1, min(10_000, files.count()))
    return files.repartition(n).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, roll: int = ROLL_BYTES, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write all pages to a new shared folder and read the archives back."""
    folder = f"{scratch(pages.sparkSession)}/warc"
    return read(write(pages, folder, roll, min_payload), folder, blocks=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
