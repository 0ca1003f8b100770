import gzip
import hashlib
import io
import uuid

import pytest

from tracewell.llm import warc

BIG = "é<p>" * 70000
ROWS = [(5, "u", BIG), (2, "a b\n", BIG), (7, None, BIG), (2, "u", BIG), (None, "u", BIG), (9, "u", None), (10, "u", ""), (11, "é", "short"), (12, "u", "short"), (13, "u", "x" * 100), (14, "u", "x" * 100), (15, "u", "x" * 99), (16, "u", "x" * 99)]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_archives_read_back_whole(spark, folder):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, chunk string")
    manifest = warc.write_archives(pages, folder)
    assert manifest.groupBy().sum("records").first()[0] == len(ROWS)
    chunks = warc.read_chunks(manifest, chunk=1 << 14).collect()
    bodies = {}
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        assert len(c.chunk) <= 1 << 14
        bodies.setdefault((c.page_id, c.record_type, c.url, c.digest_so_far if c.record_type == "revisit" else ""), []).append(bytes(c.chunk))
    lasts = [c for c in chunks if c.last]
    assert len(lasts) == len(ROWS)
    want = sorted(((r[0], len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in ROWS), key=str)
    assert sorted(((c.page_id, c.bytes_so_far, c.digest_so_far) for c in lasts), key=str) == want
    kinds = sorted(((c.page_id, c.record_type, c.refers_to) for c in lasts), key=str)
    revisits = {5: 2, 7: 2, 14: 13}
    assert kinds == sorted(((r[0], "revisit" if r[0] in revisits else "response", revisits.get(r[0])) for r in ROWS), key=str)
    page = b"".join(bodies[(13, "response", "u", "")])
    assert page == b"x" * 100
    longest = max((b"".join(x) for x in bodies.values()), key=len)
    assert longest.startswith(BIG.encode()) and max(c.chunk_no for c in chunks) == -(-len(BIG.encode()) // (1 << 14)) - 1
    made = sorted((tuple(r) for r in warc.records(warc.read_chunks(manifest, chunk=1 << 14), chunk=1 << 14).collect()), key=str)
    assert made == sorted(((*w, "revisit" if w[0] in revisits else "response", revisits.get(w[0])) for w in want), key=str)


def test_records_are_standard_members(spark, folder):
    manifest = warc.write_archives(spark.createDataFrame([(1, "http://e.org/", "hello")], "page_id long, url string, html string"), folder)
    path = manifest.first().path.removeprefix("file://")
    data = gzip.open(path).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"hello\r\n\r\n")


def test_damage_is_an_error():
    def archive(body, said):
        digest = hashlib.sha256(said).hexdigest()
        head, http, _ = warc._record(1, "u", digest, len(said), None)
        return io.BytesIO(gzip.compress(head + http + body + b"\r\n\r\n"))

    assert [r[5:8] for r in warc.read_archive(archive(b"abc", b"abc"))] == [(0, b"abc", 3)]
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_archive(archive(b"abd", b"abc")))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.read_archive(io.BytesIO(gzip.compress(b"hello\r\n"))))


def test_no_pages(spark, folder):
    manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and warc.read_chunks(manifest).count() == 0
