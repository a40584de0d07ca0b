"""WARC archives: written with an index, read back by coalesced byte ranges.

The digest of every payload comes first; of equal payloads of at least `least` bytes the
one with the largest page_id is the response and the others revisit it. Each task writes
one archive of gzip members to the shared folder and returns its index: file, offset,
length, URL, digest and the like per record. Selected records are read by sorting their
index entries by file and offset and merging neighbours into one read of at most SPAN
bytes; records are then parsed and their digests checked.

Results in odd cases: a null html is an empty payload; a null url leaves the target out;
a null page_id is written as a response, refers to nothing and is referred to by nothing;
rows that repeat the largest page_id of a payload are responses all; an empty table
writes nothing and gives no rows. Other columns are not read. A file that a lost task
left behind is in no index and so never read.
"""

from __future__ import annotations

import gzip
import hashlib
import time
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textops as tx
from ledgerline.llm.common import join_small, parted, shared_dir, table, written

LEAST = 1000
#: Bytes that one read spans at most, and bytes between two records that are read along.
SPAN = 8 << 20
GAP = 64 << 10
FLUSH = 4 << 20
#: Bytes of archives that a task reads.
READ_BYTES = 32 << 20

_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, place: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the facts of the payload, not the payload.

    place: where the record stands among all records, which makes its id unique.
    """
    revisit = refers_to is not None
    body = b"" if revisit else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:record:{place}>", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The facts of one record; the digest of a response is taken from its payload again."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    whole = int(http.decode().rsplit("Content-Length: ", 1)[1])
    number = lambda name: int(fields[name]) if name in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != whole or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number("X-Page-ID"), "payload_bytes": whole, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder; the object store that Spark calls s3a is s3 here."""
    return fs.FileSystem.from_uri("s3" + folder[3:] if folder.startswith("s3a:") else folder)


def _writer(folder: str, level: int, date: str):
    def run(batches):
        store, root = _store(folder)
        task = TaskContext.get()
        path, out, at, held, kept = f"{root}/{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", None, 0, [], 0
        rows: list[dict] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    out = store.open_output_stream(path, compression=None)
                html = html.as_py()
                number = refers_to.as_py()
                raw = record(page_id.as_py(), url.as_py(), (html or "").encode(), digest.as_py(), number, date, f"{root.rsplit('/', 1)[-1]}:{task.partitionId()}:{len(rows)}")
                raw = gzip.compress(raw, level, mtime=0)
                held.append(raw)
                rows.append({"file": path, "offset": at, "length": len(raw), "url": url.as_py(), "digest": digest.as_py(), "record_type": "response" if number is None else "revisit", "page_id": page_id.as_py()})
                at += len(raw)
                kept += len(raw)
                if kept >= FLUSH:
                    out.write(b"".join(held))
                    held, kept = [], 0
        if out is not None:
            out.write(b"".join(held))
            out.close()  # the index follows only when the file is whole
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], _INDEX)

    return run


def _reader(folder: str, payloads: bool):
    def run(batches):
        store, _ = _store(folder)
        held: list[tuple[str, int, int]] = []

        def read():
            name, start = held[0][:2]
            with store.open_input_file(name) as source:
                data = source.read_at(held[-1][1] + held[-1][2] - start, start)
            found = []
            for _, at, size in held:
                got = parse(zlib.decompress(data[at - start : at - start + size], 31))
                found.append(got if payloads else got | {"payload": None})
            held.clear()
            return pa.RecordBatch.from_pylist(found, _READ)

        for batch in batches:
            for entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (entry[0] != held[-1][0] or entry[1] - held[-1][1] - held[-1][2] > GAP or entry[1] + entry[2] - held[0][1] > SPAN):
                    yield read()
                held.append(entry)
        if held:
            yield read()

    return run


def write(pages: DataFrame, least: int = LEAST, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write the archives; returns their folder and the index."""
    spark = pages.sparkSession
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())  # one for all tasks, so a repeated task writes the same
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    same = pages.where(f"bytes >= {least} and page_id is not null").groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    same = written(same.where("n > 1").select("digest", "bytes", "keeper"), "same-payloads")
    # only pages whose payload may repeat are exchanged to meet the others
    again, once = parted(pages, F.xxhash64("digest", "bytes"), same.select(F.xxhash64("digest", "bytes").alias("key")))
    placed = join_small(again, same, ["digest", "bytes"]).unionByName(once.withColumn("keeper", F.lit(None).cast("long")))
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("refers_to")
    index = placed.select("page_id", "url", "html", "digest", refers).mapInArrow(tx.trimmed(_writer(folder, level, date)), "file string, offset long, length long, url string, digest string, record_type string, page_id long")
    return folder, written(index, "warc-index")


def read(folder: str, selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, read in file order by merged ranges."""
    total = selected.agg(F.sum("length")).first()[0] or 0
    ordered = selected.select("file", "offset", "length").repartitionByRange(1 + total // READ_BYTES, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(tx.trimmed(_reader(folder, payloads)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write(table(spark, sf_dir, "pages"))
    return read(folder, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS d FROM pages),
k AS (SELECT *, CASE WHEN octet_length(b) >= {LEAST} THEN max(page_id) OVER (PARTITION BY d, octet_length(b)) END AS top FROM p)
SELECT page_id, octet_length(b) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM k
"""
