import base64
import gzip
import hashlib
import zlib

import pytest
from helpers import sentence

from corpusloom.llm import warc
from corpusloom.llm.common import new_path

BIG = "<p>" + sentence(1, 400) + "é€😀</p>"
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (5, "http://a/5", BIG), (5, "http://a/5", BIG), (3, "http://a/3", "tiny"), (4, "http://a/4", "tiny"), (6, None, None), (7, "http://a/\r\nx: y", ""), (None, "n", BIG), (8, "u", "WARC/1.1\r\n\r\n0\r\n\r\nWARC/1.1\r\n" * 50), (9, "u", "x" * 70000)]


def brute():
    top = {}
    for i, _, h in ROWS:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        revisit = h in top and i is not None and i < top[h]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("segment", "chunk", "records"), [(16384, 4096, 2000), (700, 64, 3), (50, 7, 100000)])
def test_round_trip(spark, segment, chunk, records):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc")
    warc.write_pages(pages, path, segment_bytes=segment, chunk_bytes=chunk, file_records=records)
    got = warc.read_records(spark, path).collect()
    assert all(r.intact for r in got) and len({r.record_id for r in got}) == len(ROWS)
    found = []
    for r in got:
        if r.payload is not None:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        found.append((r.page and int(r.page), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page and int(r.refers_to_page)))
    assert sorted(found, key=repr) == brute()


def archive(spark, tmp_path, **options):
    warc.write_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), **options)
    return [f for f in sorted((tmp_path / "w").glob("part-*"))]


def test_a_member_for_each_record(spark, tmp_path):
    kinds, identifiers = [], set()
    for f in archive(spark, tmp_path, segment_bytes=500, file_records=7):
        data = f.read_bytes()
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") <= 7
        while data:  # member by member, as a reader that seeks would do
            one = zlib.decompressobj(31)
            content = one.decompress(data)
            data = one.unused_data
            assert one.eof and content.count(b"WARC/1.1\r\nWARC-Type") <= 1
            for fields, block in warc.parse(content.split(warc.MARK)):
                assert len(block) == int(fields["content-length"]) and content.endswith(b"\r\n\r\n")
                kinds.append(fields["warc-type"])
                identifiers.add(fields["warc-record-id"])
    assert kinds.count("revisit") == 2 and kinds.count("response") == 9 and "continuation" in kinds and kinds.count("warcinfo") == 1
    assert len(identifiers) == len(kinds)


def test_other_archives(spark, tmp_path):
    """Compressed as a whole or not at all, with payloads that hold records, base 32 digests and other versions."""
    (tmp_path / "o").mkdir()
    payload = b"a WARC/1.1\r\nWARC-Type: response\r\n\r\n in it WARC/1."
    stated = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
    whole = b"".join(warc.record("response", f"<urn:{i}>", "2020-01-01T00:00:00Z", [("WARC-Payload-Digest", f"sha1:{stated}")], block) for i in range(50)).replace(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:7>", b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:7>")
    (tmp_path / "o" / "a.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "o" / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (whole[:5000], whole[5000:])))
    (tmp_path / "o" / "c.warc").write_bytes(whole + whole[:100])
    got = warc.read_records(spark, str(tmp_path / "o")).collect()
    assert [r.payload for r in got if r.intact] == [payload] * 150
    assert [(r.record_id, r.payload, r.payload_bytes) for r in got if not r.intact] == [("urn:0", None, None)] * (len(got) - 150) and len(got) == 151


def test_broken_records(spark, tmp_path):
    """A changed byte, a lost segment and a member that breaks off are null; the others come back."""
    (f,) = archive(spark, tmp_path, segment_bytes=500, file_records=1000)
    members = f.read_bytes().split(warc.SEPARATOR)[:-1]
    records = [zlib.decompress(m, 31) for m in members]
    at = {}
    for i, r in enumerate(records):
        fields, _ = next(warc.parse(r.split(warc.MARK)))
        at.setdefault((fields["warc-type"], fields.get("page-id")), i)
    records[at["response", "3"]] = records[at["response", "3"]].replace(b"tiny", b"tinz")
    gone = at["response", "5"] + 1  # the second segment of page 5
    members = [warc.member(r) for r in records]
    members[at["response", "4"]] = members[at["response", "4"]][:-30]
    members[at["revisit", "1"]] = members[at["revisit", "1"]][:-30]
    del members[gone]
    for other in (tmp_path / "w").iterdir():
        other.unlink()
    f.write_bytes(b"".join(m + warc.SEPARATOR for m in members) + b"nonsense")
    got = warc.read_records(spark, str(tmp_path / "w")).collect()
    broken = sorted((r.page, r.payload, r.payload_bytes) for r in got if not r.intact)
    assert len(got) == len(ROWS) and broken == [("1", None, None), ("3", None, None), ("4", None, None), ("5", None, None)]


def test_incomplete_records():
    parts = [{"number": 1, "total": None, "block": b"HTTP/1.1 200 OK\r\n\r\nab"}, {"number": 2, "total": 23, "block": b"cd"}]
    digest = hashlib.sha1(b"abcd").hexdigest()
    assert warc.reassembled(parts) == warc.reassembled(parts[::-1], digest) == b"abcd"
    assert warc.reassembled(parts, digest[::-1]) is warc.reassembled(parts[1:]) is warc.reassembled(parts[:1]) is None
    assert warc.reassembled([parts[0], {**parts[1], "block": None}]) is None
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert warc.unchunked(b"3\r\nab") is None and warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n") is None
    assert list(warc.parse([b"nonsense"])) == [] and list(warc.parse([b"", b"1\r\nA: b\r\n\r\nx"])) == [({"a": "b"}, None)]
    assert warc.hex_digest("sha1:" + "A" * 32) == "0" * 40 and warc.hex_digest("md5:1") is warc.hex_digest(None) is None


def test_many_copies_of_a_long_page(spark):
    """Each copy's segments are a group of their own."""
    pages = spark.createDataFrame([(None, "u", BIG)] * 60 + [(1, "u", BIG)] * 60, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_pages(pages, path, segment_bytes=400)
    got = warc.read_records(spark, path).collect()
    assert len(got) == len({r.record_id for r in got}) == 120 and all(r.intact and r.payload == BIG.encode() for r in got)


def test_empty_table(spark):
    path = new_path(spark, "warc")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0
