"""WARC archives, index first.

The writer streams records into archives in the shared folder and returns the
*index*: archive, offset, length, URL and digest of every record.  The reader
never scans an archive: it sorts the selected index rows by place, merges byte
ranges that lie close together, reads those and cuts the records out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import joined, new_path, stored

#: An archive is closed beyond this size; ranges are merged over gaps up to GAP and read up to SPAN bytes at once.
ARCHIVE_BYTES, GAP, SPAN = 256 << 20, 64 << 10, 4 << 20
INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole record with the two line ends behind it; a revisit has HTTP headers but no payload."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """What a record says of itself; the payload's length and digest are taken from its bytes where it has them."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a byte range is not one whole record")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    out = {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": None}
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if out["record_type"] == "response":
        out["payload"] = payload = block.partition(b"\r\n\r\n")[2]
        if (digest_of(payload), len(payload)) != (digest, size):
            raise ValueError("a payload does not match its digest")
    return out | {"payload_digest": digest, "payload_bytes": size}


def write(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the stored index.

    A null html is an empty payload, a null url an empty URI, and other columns
    are not read.  Of equal payloads of at least ``least_bytes`` the smallest
    page_id is a response and the others revisit it; rows that repeat that
    page_id are responses too; rows without a page_id are responses of their own.
    A task writes archives of its own, named after its attempt: of a task that
    ran twice, the index has the attempt that was committed.  No rows, no archive.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    groups = keyed.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes)).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = stored(groups.where("n > 1").select("sha", "first_id"), "payloads")
    marked = joined(keyed, shared, "sha", "left", row_bytes=120)
    marked = marked.select("page_id", "url", F.col("html").cast("binary"), F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at = TaskContext.get()
        out, n, offset, rows = None, 0, 0, []
        store, base = fs.FileSystem.from_uri(folder)
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                    page_id, url, html, refers_to = page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py()
                    if out is None:
                        store.create_dir(base, recursive=True)
                        name = f"part-{at.partitionId():06d}-{at.taskAttemptId():06d}-{n:04d}.warc"
                        out, n, offset = store.open_output_stream(f"{base}/{name}"), n + 1, 0
                    digest = digest_of(html)
                    record = record_of(page_id, url, html, digest, refers_to)
                    out.write(record)
                    rows.append((name, offset, len(record), url, digest, page_id, "response" if refers_to is None else "revisit"))
                    offset += len(record)
                    if offset >= archive_bytes:
                        out.close()
                        out = None
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
                        rows = []
        finally:
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return stored(marked.mapInArrow(put, INDEX), "warc-index")


def merged(places: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) pairs as ranges (start, end, how many): close ones together, up to ``span`` bytes."""
    out: list[list[int]] = []
    for offset, length in places:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= span:
            out[-1][1], out[-1][2] = max(out[-1][1], offset + length), out[-1][2] + 1
        else:
            out.append([offset, offset + length, 1])
    return [tuple(x) for x in out]


def read(index: DataFrame, folder: str, gap: int = GAP, span: int = SPAN, payloads: bool = True) -> DataFrame:
    """The records of ``index`` (any selection of a written one), by merged byte ranges.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest
    and, with ``payloads``, the payload (null for revisits).
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    places = index.select("archive", "offset", "length")
    # Neighbours in an archive go to one task, in order; long archives are shared out by stretches.
    stretch = 16 * span
    tasks = int((places.agg(F.sum("length")).first()[0] or 0) // stretch) + 1
    places = places.repartition(tasks, "archive", F.floor(F.col("offset") / stretch)).sortWithinPartitions("archive", "offset")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            groups: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups.setdefault(name, []).append((offset, length))
            for name, own in groups.items():
                with store.open_input_file(f"{base}/{name}") as file:
                    k = 0
                    for start, end, n in merged(own, gap, span):
                        data = file.read_at(end - start, start)
                        got = [parse(data[o - start : o - start + size]) for o, size in own[k : k + n]]
                        k += n
                        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in zip(names, kinds, strict=False)], names)

    return places.mapInArrow(get, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
