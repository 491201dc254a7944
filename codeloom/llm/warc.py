"""WARC archives, index first.

Writing gives an index (file, offset, length, url, digest, ...), one row per
record, as a table; reading starts from rows of that index, sorts them by file
and offset and fetches runs of neighbouring records with one byte-range read.
Each record is a gzip member of its own. A task that is run again writes a new
file, and only the index of the attempt that ended well is kept, so lost
executors leave no half records in it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import new_folder, settle

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Archived bytes that a reading task fetches, about.
TASK_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    said = name[len("<urn:page:") : -1]
    return None if said == "null" else int(said)


def _uri(url: str) -> str:
    """A URL without control characters, so that it stays in its header line: they are %-escaped, for good."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def _record(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """One WARC record. ``first`` is the page that a revisit refers to, or () for a response."""
    lines = ["WARC/1.1", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if first == ():
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        lines += ["WARC-Type: response"]
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        lines += ["WARC-Type: revisit", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first)}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> dict:
    """The fields of a record; a payload that disagrees with its digest or length is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if response else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else _page(fields["WARC-Refers-To"]),
        "payload": payload if response else None,
    }


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", least: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write one record per row of ``pages`` under ``folder``; return the settled index.

    A null payload is empty, a null URL is left out. Of equal payloads of at
    least ``least`` bytes, the rows with the smallest page id are responses and
    the others revisits of it (null ids come last); shorter ones are all
    responses. Rows that repeat both the payload and that smallest id are each
    a response. Other columns are ignored; an empty table gives an empty index.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # SHA-1 is what a record names; as crawls hold published collisions of it, equal payloads agree in SHA-256 as well
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("same", F.sha2("payload", 256))
    firsts = rows.groupBy("sha1", "same").agg(F.min("page_id").alias("first"))
    marked = rows.join(firsts, ["sha1", "same"])
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.octet_length("payload") < least)
    marked = marked.select("page_id", "url", "payload", "sha1", "first", response.alias("response"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        file, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, sha1, first, is_response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{file}", compression=None)
                    digest = base64.b32encode(sha1).decode()
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = gz.compress(_record(page_id, url, payload, digest, () if is_response else first, date)) + gz.flush()
                    out.write(member)
                    index.append((file, at, len(member), page_id, url, digest, "response" if is_response else "revisit", None if is_response else first))
                    at += len(member)
                columns = zip(*index, strict=True) if index else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return settle(marked.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 8 << 20, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """The records that ``index`` names (any rows of it), read back and checked.

    Index rows are dealt out by ranges of (file, offset) and sorted; in a task,
    records at most ``gap`` bytes apart are fetched together, up to ``most``
    bytes at a time (a longer record alone).
    """
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.strip().split()[0] for x in schema.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.strip().split()[0], types[x.strip().split()[1]]) for x in schema.split(",")])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            k = 0
            while k < len(wanted):
                file, begin, length = wanted[k]
                end, last = begin + length, k + 1
                while last < len(wanted) and wanted[last][0] == file and wanted[last][1] - end <= gap and wanted[last][1] + wanted[last][2] - begin <= most:
                    end, last = max(end, wanted[last][1] + wanted[last][2]), last + 1
                if file != name:
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                block = source.read_at(end - begin, begin)
                read = [_parse(zlib.decompress(block[o - begin : o - begin + n], 31)) for _, o, n in wanted[k:last]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in read], arrow.field(c).type) for c in names], schema=arrow)
                k = last

    wanted = index.select("file", "offset", "length")
    if tasks is None:  # index rows are small, what they name is not: deal by the bytes to be fetched
        fetched = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-fetched // TASK_BYTES))
    dealt = wanted.repartitionByRange(tasks, "file", "offset")
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(fetch, schema)


def query(spark, sf_dir):
    from ._shared import table

    folder = new_folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder, payloads=False).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda j: ('0x' || substr(hex, (5 * j + 1)::INT, 5))::INT) AS fives FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(fives, lambda v:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
