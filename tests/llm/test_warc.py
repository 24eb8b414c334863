import gzip
import hashlib
import pathlib

import pytest

from classlake.llm import warc as A


def brute(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            last[b] = max(last.get(b, -2**63), -2**63 if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = last.get(b)
        again = first is not None and first != -2**63 and i != first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int")


def rows():
    long, tricky = "é" * 600, ("WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n\x00" * 40)
    out = [(k, f"http://a/{k}", long) for k in range(9)] + [(20 + k, None, tricky) for k in range(3)]
    return out + [(30, "http://x/\r\nWARC-Type: y", "short"), (31, "u", "short"), (32, "u", None), (33, "u", ""), (34, "u", "b" * 999),
                  (35, "u", "b" * 999), (36, "u", "c" * 1000), (37, "u", "c" * 1000), (None, "u", "c" * 1000), (40, "u", "d" * 300_000),
                  (41, "u", long), (41, "u", long), (42, "u", "\r\n\r\n"), (None, None, None)]


def test_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/a"
    A.write_archives(pages(rows()), path, per_file=4)
    read = A.read_archives(spark, path)
    got = sorted((tuple(r) for r in A.resolved(read).collect()), key=str)
    assert got == sorted(brute(rows()), key=str)
    texts = sorted(r[2] or "" for r, x in zip(rows(), brute(rows()), strict=True) if x[3] == "response")
    assert sorted(bytes(r.payload).decode() for r in read.filter("record_type = 'response'").collect()) == texts
    for r in read.collect():
        assert "\n" not in r.url and r.digest and (r.payload_sha1 in (None, r.digest))


def test_records_by_the_standard(pages, tmp_path):
    A.write_archives(pages(rows()), f"file://{tmp_path}/a")
    names = set()
    for file in pathlib.Path(tmp_path, "a").glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        at = 0
        for fields, block in A.parse(data):
            assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(fields)
            names.add(fields["warc-record-id"])
            assert bytes(block[:15]) == b"HTTP/1.1 200 OK"
            if fields["warc-type"] == "revisit":
                assert fields["warc-profile"] == A.PROFILE and fields["warc-refers-to"] != fields["warc-record-id"]
            at += 1
        assert data.endswith(b"\r\n\r\n") and at
    assert len(names) == len({(r[0], r[2] or "") for r in rows()})


def test_no_rows_and_broken_archives(spark, pages, tmp_path):
    A.write_archives(pages([]), f"file://{tmp_path}/none")
    assert A.read_archives(spark, f"file://{tmp_path}/none").collect() == []
    A.write_archives(pages(rows()[:2]), f"file://{tmp_path}/cut")
    file = next(pathlib.Path(tmp_path, "cut").glob("part-*"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes())[:-700]))
    pathlib.Path(tmp_path, "cut", f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="cut off|no record|subsection|substring"):
        A.read_archives(spark, f"file://{tmp_path}/cut").collect()
