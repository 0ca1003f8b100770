"""WARC archives as a chunked record table.

Writing: each task writes the records of its pages to an archive of its own in the shared folder, one gzip member a
record, payloads a chunk at a time; it returns a manifest row.  An attempt that dies leaves a file that no manifest
names.  Of equal payloads of at least `least` bytes the smallest page_id is a `response` record, the others are
`revisit` records with the same payload digest and the HTTP header, but no payload.

Reading: archives become rows (record, chunk number) of at most CHUNK bytes; each row carries the digest and the length
of the payload up to there, so nothing needs a whole record at once, and the last row of a record has its whole digest.
A response whose bytes don't have the digest in its header is an error.

Files are reached through pyarrow.fs, by the URI of the shared folder (file, hdfs, s3, gs and what else it knows).

Cases: null html is the empty payload.  Rows repeated under one page_id are each a record; those with the smallest
page_id of their payload are all responses.  A null page_id is always a response.  A null url is written as the page's
URN.  Empty tables give no archive and no row.  Extra columns are passed over.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, salted, shared_dir, slot_split
from tracewell.plans.materialize import remove

CHUNK, LEAST, DATE = 64 << 10, 100, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, refers_to), a row for each row of pages.

    Only digests are dealt out to find equal payloads; of the pages only those whose digest may occur under several ids
    are, and one digest's pages go to several tasks."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    named = base.withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    thin = named.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    firsts = cut(thin.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("most")).where("first < most").select("payload_digest", "first"))
    some, others = slot_split(named, F.col("payload_digest"), firsts, F.col("payload_digest"))
    met = salted(some, firsts, ["payload_digest"], F.col("page_id"), "left", parts=32)
    refers_to = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    names = ("page_id", "url", "html", "payload_digest", "payload_bytes")
    return met.select(*names, refers_to.alias("refers_to")).unionByName(others.select(*names, F.lit(None).cast("long").alias("refers_to")))


def _record(page_id, url, digest: str, size: int, refers_to) -> tuple[bytes, bytes, bool]:
    """WARC header, HTTP header, and whether the payload follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url is not None else f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "Refers-To-Page-ID": str(refers_to)}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(http) + (0 if revisit else size))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode(), http, not revisit


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        records = 0
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                if out is None:
                    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = memoryview(cols["html"][i].cast(pa.binary()).as_buffer())
                head, http, with_payload = _record(*(cols[n][i].as_py() for n in ("page_id", "url", "payload_digest", "payload_bytes", "refers_to")))
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(member.compress(head + http))
                if with_payload:
                    for at in range(0, len(payload), CHUNK):
                        out.write(member.compress(payload[at : at + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes WARC files into folder (a URI); their manifest, written out, so that they are written once."""
    return cut(plan_records(pages, least).mapInArrow(_writer(folder), MANIFEST))


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline(1 << 16)) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_archive(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of one archive's records."""
    data = gzip.GzipFile(fileobj=stream)
    while line := data.readline(1 << 16):
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _fields(data)
        left = int(head["content-length"])
        start = data.tell()
        data.readline(1 << 16)  # status line
        http = _fields(data)
        left -= data.tell() - start
        kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
        number = {k: int(v) if (v := head.get(k)) else None for k in ("page-id", "refers-to-page-id")}
        base = (head["warc-record-id"], number["page-id"], head["warc-target-uri"], kind, number["refers-to-page-id"])
        if kind == "revisit":
            yield (*base, 0, b"", int(http["content-length"]), digest, True)
            continue
        sha, done, no = hashlib.sha256(), 0, 0
        while True:
            part = data.read(min(chunk, left - done))
            if len(part) < min(chunk, left - done):
                raise ValueError(f"{base[0]} ends early")
            sha.update(part)
            done += len(part)
            if done == left and sha.hexdigest() != digest:
                raise ValueError(f"{base[0]} doesn't have the digest in its header")
            yield (*base, no, part, done, sha.hexdigest(), done == left)
            no += 1
            if done == left:
                break


def read_chunks(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives that the manifest names."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None, buffer_size=1 << 18) as stream:
                    for row in read_archive(stream, chunk):
                        rows.append(row)
                        size += 200 + len(row[6])
                        if size > 4 << 20:
                            yield table(rows)
                            rows, size = [], 0
        if rows:
            yield table(rows)

    return manifest.select("path").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the chunked record table: each record's last
    chunk has the length and the digest of all its chunks.  A chunk that isn't as long as it says is an error."""
    grown = F.col("bytes_so_far") - F.col("chunk_no") * chunk
    whole = (F.col("record_type") == "revisit") | (F.octet_length("chunk") == grown)
    checked = chunks.where(F.when(whole, F.col("last")).otherwise(F.raise_error(F.concat(F.lit("a chunk is missing of "), "record_id"))))
    return checked.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op3(spark, sf_dir: str) -> DataFrame:
    """Whole `pages`, written to archives in the shared folder and read back; the archives go once their rows are written."""
    folder = shared_dir(spark)
    folder = f"{folder if ':' in folder else f'file://{folder}'}/warc-{uuid.uuid4().hex}"
    out = cut(records(read_chunks(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder))))
    remove(spark, folder)
    return out


ORACLE_OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
