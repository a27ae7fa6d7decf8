"""WARC archives written from, and read back as, a table of payload chunks.

A payload is never handled whole outside its source row: it becomes rows of
record, chunk number and at most ``CHUNK`` bytes (stored compressed), each carrying the SHA-1 and the
length of the payload up to and including that chunk. The last chunk of a record
hence carries the payload's digest. Archives are written chunk by chunk, one
gzip member per record, and read chunk by chunk.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
largest id is the response and the others are revisits of it, written without
payload. Every file has a name of its own per task attempt; only files named by
attempts that succeeded are listed, so lost executors leave no half archive in
the result.

A null payload is empty. Null ids are written as such and never are the response
that others revisit, unless all equal payloads lack ids: then each is a response.
Repeated rows are records of their own; of equal payloads with equal largest ids
one is the response. A URL's white space and control characters are escaped; a
null URL is left out. Other columns are ignored. No rows, no archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.storage import shared_root, stored

#: Bytes of a chunk: also the most that one row carries between JVM and Python.
CHUNK = 16 * 1024
MIN_REVISIT = 1000
CHUNK_SCHEMA = "record long, page_id long, url string, chunk_no int, n_bytes int, data binary, seen_bytes long, seen_sha1 string, last boolean"
READ_SCHEMA = "record string, chunk_no int, n_bytes int, seen_sha1 string, last boolean, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def chunk_table(pages: DataFrame, payload: str = "html") -> DataFrame:
    """The pages as stored chunk rows with running digests.

    Chunks are sliced by the JVM in order, so a record's chunks arrive one after
    another in the same task and one hash object per task is enough.
    """
    raw = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    sliced = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("raw"))
    number = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("raw") / CHUNK).cast("int") - 1, F.lit(0)))).alias("chunk_no")
    numbered = sliced.select("*", number)
    size = F.lit(CHUNK)
    chunks = numbered.select(
        "record", "page_id", "url", "chunk_no",
        F.length(F.substring("raw", F.col("chunk_no") * size + 1, size)).alias("n_bytes"),
        F.substring("raw", F.col("chunk_no") * size + 1, size).alias("data"),
        ((F.col("chunk_no") + 1) * size >= F.length("raw")).alias("last"),
    )

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, seen = hashlib.sha1(), 0
        for batch in batches:
            lengths, digests, packed = [], [], []
            for number, data in zip(batch.column("chunk_no").to_pylist(), batch.column("data")):
                if number == 0:
                    running, seen = hashlib.sha1(), 0
                running.update(data.as_buffer())
                seen += len(data.as_buffer())
                lengths.append(seen)
                digests.append(running.hexdigest())
                packed.append(pa.compress(data.as_buffer(), "zstd", asbytes=True))
            columns = [batch.column(c) for c in ("record", "page_id", "url", "chunk_no", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), batch.column("last")], names=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

    return stored(chunks.mapInArrow(digest, CHUNK_SCHEMA), compression="none")


def roles(chunks: DataFrame) -> DataFrame:
    """One row per record: its digest, length, type and the page it revisits."""
    records = chunks.filter("last").select("record", "page_id", "url", F.col("seen_bytes").alias("payload_bytes"), F.col("seen_sha1").alias("payload_digest"))
    large = records.filter((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record")).alias("kept"))
    joined = records.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("kept.record") != F.col("record"), F.lit(False))
    return joined.select("record", "page_id", "url", "payload_bytes", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("kept.page_id")).alias("refers_to"))


def _head(row: dict) -> bytes:
    """The record's header block and, for a response, the start of its HTTP block."""
    kind = "revisit" if row["revisit"] else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    length = len(http) + (0 if row["revisit"] else row["payload_bytes"])
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row['record']))}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if row["url"] is None else quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~-._")),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["revisit"] else None),
        ("X-Page-Id", row["page_id"]),
        ("X-Payload-Length", row["payload_bytes"]),
        ("X-Refers-To-Page-Id", row["refers_to"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", length),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + http


def write_archives(chunks: DataFrame, path: str) -> DataFrame:
    """Write the archives and return their paths, one row each (stored).

    Revisits need no payload: their first chunk row brings the header. A record's
    rows meet by its number, so one page's copies do not.
    """
    target, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    target.create_dir(root, recursive=True)
    decided = roles(chunks)
    # Dealt out by record before the join, which then moves only the decisions.
    dealt = chunks.select("record", "chunk_no", "n_bytes", "data", "last").repartition("record")
    content = dealt.join(decided, "record").filter("NOT revisit OR chunk_no = 0")
    ordered = content.withColumn("data", F.when(~F.col("revisit"), F.col("data"))).sortWithinPartitions("record", "chunk_no")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, member = None, None
        for batch in batches:
            for row in batch.to_pylist():
                out = out or target.open_output_stream(name, compression=None)
                if row["chunk_no"] == 0:
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(member.compress(_head(row)))
                if not row["revisit"]:
                    out.write(member.compress(pa.decompress(row["data"], row["n_bytes"], "zstd", asbytes=True)))
                if row["last"] or row["revisit"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

    return stored(ordered.mapInArrow(write, "archive string"))


class _Reader:
    """Bytes of a gzip stream of many members, by line or by number, in bounded memory."""

    def __init__(self, stream):
        self.stream, self.member, self.held = stream, None, b""

    def _more(self) -> bool:
        tail = self.member.unused_data if self.member is not None and self.member.eof else b""
        block = tail or self.stream.read(CHUNK)
        if not block:
            return False
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(block)
        return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("archive ends within a line")
                return None
        line, self.held = self.held[:at], self.held[at + 2 :]
        return line

    def some(self, most: int) -> bytes:
        while not self.held:
            if not self._more():
                raise ValueError("archive ends within a record")
        block, self.held = self.held[:most], self.held[most:]
        return block

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            block = self.some(min(n, CHUNK))
            n -= len(block)
            yield block


def _fields(reader: _Reader) -> tuple[dict[str, str], int]:
    found, size = {}, 0
    while line := reader.line():
        size += len(line) + 2
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found, size + 2


def _records(reader: _Reader) -> Iterator[tuple]:
    """Chunk rows of every record of an archive; a payload's digest is recomputed."""
    number = lambda v: None if v is None else int(v)
    while (first := reader.line()) is not None:
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        head, _ = _fields(reader)
        status = reader.line()
        _, http = _fields(reader)
        left = int(head["content-length"]) - http - len(status) - 2
        told = (number(head.get("x-page-id")), int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], number(head.get("x-refers-to-page-id")))
        running, seen, chunk = hashlib.sha1(), 0, 0
        for block in reader.exactly(left):
            running.update(block)
            seen += len(block)
            yield head["warc-record-id"], chunk, len(block), running.hexdigest(), seen == left, *told
            chunk += 1
        if not left:
            yield head["warc-record-id"], 0, 0, running.hexdigest(), True, *told
        if b"".join(reader.exactly(4)) != b"\r\n\r\n":
            raise ValueError("record without an end")


def read_archives(spark: SparkSession, archives: DataFrame, root: str) -> DataFrame:
    """The archives' chunk table: one task per archive, bounded memory in each."""
    target, _ = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("chunk_no", pa.int32()), ("n_bytes", pa.int32()), ("seen_sha1", pa.string()), ("last", pa.bool_()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with target.open_input_stream(name, compression=None) as stream:
                    for row in _records(_Reader(stream)):
                        rows.append(row)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # By range and with their count as number of parts: paths are too short for
    # Spark to see that each stands for a whole archive.
    parts = max(1, archives.count())
    return archives.repartitionByRange(parts, "archive").mapInArrow(read, READ_SCHEMA)


def round_trip(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Write the pages as archives and return one row per record as read back.

    A response whose payload read differs from its digest or length stops the
    job: archives that do not hold what they say are worth nothing.
    """
    spark = pages.sparkSession
    root = shared_root(spark)
    read = read_archives(spark, write_archives(chunk_table(pages, payload), root), root)
    whole = (F.col("record_type") == "revisit") | (F.col("seen_sha1") == F.col("payload_digest"))
    checked = F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record"))))
    return read.filter("last").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
