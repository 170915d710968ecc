"""WARC archives: a writer, and a sequential reader of one gzip member per record.

The writer compresses each record on its own, joins the digests of payloads that occur
more than once (the smallest id keeps the payload, the others become revisits of it)
and lays the members end to end in archives of bounded size. An archive is a row
(name, content) of a Parquet table in the shared folder: Spark's commit protocol makes
the write safe when a task is lost, on any file system. ``read_files`` reads ordinary
``.warc.gz`` files with the same reader.

The reader decompresses in steps of 64 KiB, takes the header up to its blank line, then
exactly Content-Length bytes, and checks block and payload digests.

Null html is an empty payload and null url leaves out the target. Rows repeated with the
smallest id are each a response; a null id sorts last, and payloads that only null ids
have are all responses. An empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session

#: An archive ends once it holds this many bytes.
ARCHIVE_BYTES = 16 << 20
#: A page is joined by broadcast if it has at least this part of all copies: there are no more than HOT such pages.
HOT = 5000
STEP = 1 << 16
RECORDS = (
    "archive string, record_offset long, record_id string, record_type string, target_uri string, page_id long, refers_to_record string, "
    "refers_to long, block_digest string, payload_digest string, payload_bytes long, digests_ok boolean, payload binary"
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(page_id, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload}')}>"


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member; the same record always gives the same bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _fields(kind: str, page_id, url: str | None, payload: str, block: bytes) -> list[tuple[str, str]]:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, payload)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("WARC-Payload-Digest", f"sha1:{payload}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return fields if page_id is None else [*fields, ("X-Page-Id", str(page_id))]


def response(page_id, url: str | None, payload: bytes) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return member(_fields("response", page_id, url, digest(payload), block), block)


def revisit(page_id, url: str | None, payload: str, refers_to) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = _fields("revisit", page_id, url, payload, block)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, payload)), ("X-Refers-To-Page-Id", str(refers_to))]
    return member(fields, block)


def warcinfo(name: str) -> bytes:
    block = b"software: tracelens\r\nformat: WARC File Format 1.1\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


class _Member:
    """One gzip member of a stream of byte steps, decompressed as it is asked for."""

    def __init__(self, steps: Iterator[bytes], rest: bytes):
        self.steps, self.raw, self.buffer, self.unpack = steps, rest, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        if self.unpack.eof:
            return False
        if not self.raw:
            self.raw = next(self.steps, b"")
            if not self.raw:
                raise ValueError("the archive ends within a record")
        self.buffer += self.unpack.decompress(self.raw, STEP)
        self.raw = self.unpack.unconsumed_tail or (self.unpack.unused_data if self.unpack.eof else b"")
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                raise ValueError("a record's header has no end")
        head = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return head

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        block = bytes(self.buffer[:n])
        del self.buffer[:n]
        return block


def records(steps: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of each record, in order."""
    read = 0

    def counted():
        nonlocal read
        for step in steps:
            read += len(step)
            yield step

    source, rest = counted(), b""
    while rest or (rest := next(source, b"")):
        at = read - len(rest)
        m = _Member(source, rest)
        lines = m.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        block = m.exactly(int(header["content-length"]))
        if m.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two line ends")
        while m.more():
            pass
        if m.buffer:
            raise ValueError("a member holds more than one record")
        rest = m.raw
        yield at, header, block


def row(name: str, at: int, header: dict[str, str], block: bytes) -> dict:
    kind = header.get("warc-type", "")
    given = {k: header.get(f"warc-{k}-digest", "").removeprefix("sha1:") or None for k in ("block", "payload")}
    payload = block
    if header.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    payload = None if kind == "revisit" else payload
    ok = (given["block"] is None or given["block"] == digest(block)) and (payload is None or given["payload"] is None or given["payload"] == digest(payload))
    whole = lambda k: int(header[k]) if k in header else None
    return {
        "archive": name, "record_offset": at, "record_id": header.get("warc-record-id"), "record_type": kind, "target_uri": header.get("warc-target-uri"), "page_id": whole("x-page-id"),
        "refers_to_record": header.get("warc-refers-to"), "refers_to": whole("x-refers-to-page-id"), "block_digest": given["block"], "payload_digest": given["payload"],
        "payload_bytes": None if payload is None else len(payload), "digests_ok": ok, "payload": payload,
    }


def _in_steps(data) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[i : i + STEP]) for i in range(0, len(view), STEP))


def _read(archives: DataFrame, name: str, content: str, payloads: bool) -> DataFrame:
    session.ship(archives.sparkSession)
    schema = archives.sparkSession.createDataFrame([], RECORDS).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for at, header, block in records(_in_steps(data.as_buffer())):
                    if header.get("warc-type") == "warcinfo":
                        continue
                    r = row(label, at, header, block)
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += len(block)
                    if held > (8 << 20) or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return archives.select(name, content).mapInArrow(run, schema)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of a table of archives; ``payloads=False`` leaves out the bytes after they are checked."""
    return _read(archives, "name", "content", payloads)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ``.warc.gz`` files that any Spark file system holds."""
    return _read(spark.read.format("binaryFile").load(path), "path", "content", payloads)


def write(pages: DataFrame, revisit_min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives (name, content) with a record for each page.

    Of payloads with equal digests and at least ``revisit_min_bytes`` bytes, the smallest key is
    the response and the others revisit it. Only compressed members and digests are shuffled.
    Only the three columns are read, so others, whatever their names, make no difference. A payload
    of any length is one record, compressed whole by one task.
    """
    spark = pages.sparkSession
    session.ship(spark)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, urls, bodies = (c.to_pylist() for c in batch.slice(at, 256).columns)
                data = [(b or "").encode("utf-8", "surrogatepass") for b in bodies]
                new = [response(i, u, d) for i, u, d in zip(ids, urls, data, strict=True)]
                sha1 = [hashlib.sha1(d, usedforsecurity=False).hexdigest() for d in data]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(sha1, pa.string()), pa.array(new, pa.binary())], names=["id", "url", "sha1", "member"])

    def lay(batches):
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            name = f"pages-{part:06d}-{k:05d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([warcinfo(name) + b"".join(held)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for r in batch.to_pylist():
                payload = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                held.append(r["member"] if r["first"] is None or r["first"] == r["id"] else revisit(r["id"], r["url"], payload, r["first"]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    k, held, size = k + 1, [], 0
        if held:
            yield archive()

    given = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    first = (
        given.select("id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
        .where(F.octet_length("body") >= revisit_min_bytes)
        .groupBy(F.sha1("body").alias("sha1"))
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 AND first IS NOT NULL")
    )
    first = session.materialize(first, "first")
    total = first.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * HOT >= total
    hot, rest = first.where(often).select("sha1", F.col("first").alias("hot")), first.where(~often).select(F.col("sha1").alias("met"), F.col("first").alias("other"))
    packed = given.mapInArrow(pack, "id long, url string, sha1 string, member binary").join(F.broadcast(hot), "sha1", "left")
    # what has met a common page is dealt by its id and meets nothing, so its copies don't come to one task
    packed = packed.withColumn("met", F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.col("id").cast("string")))
    both = packed.join(rest, "met", "left").withColumn("first", F.coalesce("hot", "other"))
    return both.select("id", "url", "sha1", "member", "first").mapInArrow(lay, "name string, content binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives and back; a revisit's size is that of the response it refers to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = session.materialize(write(pages, revisit_min_bytes=0), "warc")
    got = session.materialize(read(archives, payloads=False), "warc-records")
    sizes = got.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("payload_bytes").alias("full"))
    return got.join(sizes, "refers_to_record", "left").select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "digests_ok", "target_uri"
    )


OP3_SQL = """
WITH page AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS first FROM page GROUP BY h),
coded AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::INT) >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1), '' ORDER BY i) AS payload_digest
  FROM first, range(32) r(i) GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS digests_ok, url AS target_uri
FROM page JOIN first USING (h) JOIN coded USING (h)
"""
