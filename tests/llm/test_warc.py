import gzip
import hashlib
import random

import pytest

from vicinal.llm import warc as W

PAGES = "page_id bigint, url string, html string"


def test_chunked_framing():
    rng = random.Random(1)
    for n in (0, 1, 9, 4096, 10_001):
        body = rng.randbytes(n)
        for size in (1, 7, 4096):
            assert W.unframe_chunked(W.frame_chunked(body, size)) == body
    assert W.unframe_chunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n0", b"3\r\nabc\r\n0\r\n", b"3\r\nabc\r\n0\r\n\r\nmore", b"1_0\r\n" + b"x" * 16 + b"\r\n0\r\n\r\n", b"3..abc..0\r\n", b"-1\r\n\r\n", b"0\r\nno trailer\r\n\r\n"):
        with pytest.raises(ValueError):
            W.unframe_chunked(bad)


def test_segments_round_trip_in_any_order():
    rng = random.Random(2)
    payload = rng.randbytes(5000)
    parts = list(W.write_record((1, 2), "http://a b/", 7, payload, hashlib.sha1(payload).hexdigest(), None, 700))
    assert len(parts) > 7
    rng.shuffle(parts)
    records = list(W.read_records(b"".join(parts)))
    first = next(h for h, _ in records if h["warc-type"] == "response")
    block = b"".join(b for _, b in sorted(((int(h["warc-segment-number"]), b) for h, b in records)))
    assert W.http_payload(block) == payload and first["warc-target-uri"] == "http://a%20b/"
    assert {h["warc-segment-origin-id"] for h, _ in records if h["warc-type"] == "continuation"} == {first["warc-record-id"]}
    packed = b"".join(map(gzip.compress, parts))
    assert list(W.read_records(packed)) == records
    for bad in (parts[0][:-5], b"WARC/1.1\r\nWARC-Type: x", packed[:-9]):
        with pytest.raises(ValueError):
            list(W.read_records(bad))
    own, other = W.urn(3, 4), W.urn(5, 6)
    (revisit, _), = W.read_records(b"".join(W.write_record((3, 4), "http://c/", 1, payload, "0" * 40, (9, (5, 6), "http://d e/"))))
    assert (revisit["warc-record-id"], revisit["warc-refers-to"], revisit["warc-refers-to-target-uri"], revisit["x-refers-to-page-id"]) == (own, other, "http://d%20e/", "9")


def test_small_segments_files_and_edges(spark, tmp_path):
    big = "<p>é</p>" * 400
    rows = [(1, "u", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "v", "x" * 99_999), (2, "again", big), (None, "n", big), (None, "n", "lone" * 500), (None, "n", "lone" * 500)]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], PAGES + ", segment int, type string")
    archives = W.write_archives(pages, segment=500)
    ids = {(h["warc-record-id"], h.get("warc-refers-to")) for r in archives.collect() for h, _ in W.read_records(r.data) if h["warc-type"] != "continuation"}
    assert len(ids) == len(rows) and {to for _, to in ids if to} <= {i for i, _ in ids}
    W.export(archives, str(tmp_path / "w"))
    got = W.pages_of(W.reassemble(W.segments(W.archives_of(spark, str(tmp_path / "w"))))).collect()
    size = lambda t: len((t or "").encode())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, size(t), sha(t), "revisit" if p == 1 else "response", 2 if p == 1 else None) for p, _, t in rows]
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))
    assert W.round_trip(pages.limit(0)).count() == 0


def test_damaged_records_are_rows_of_their_own(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "y" * 3000), (2, "v", "z")], PAGES)
    archives = W.write_archives(pages, segment=500)
    records = W.segments(archives).cache()
    assert W.reassemble(records).count() == 2
    for bad in (records.where("segment <> 3"), records.where("coalesce(segment, 0) = 0 or total is null"), records.unionByName(records.where("segment = 2"))):
        rows = W.pages_of(W.reassemble(bad)).collect()
        assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "damaged"), (2, "response")]
        assert all(("whole record" in r.error) == (r.record_type == "damaged") if r.error else r.page_id == 2 for r in rows)
    data = b"".join(bytes(r.data) for r in archives.collect())
    broken = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-9]),), (bytearray(b"junk"),), (None,), (bytearray(data.replace(b"z\r\n0", b"Z\r\n0")),)], "data binary")
    kinds = [r.record_type for r in W.pages_of(W.reassemble(W.segments(broken).where("type <> 'continuation' and segment = 0"))).collect()]
    assert sorted(kinds) == ["damaged"] * 3 + ["response"]
    monkeypatch.setattr(W, "reassemble", lambda r: r.where("segment > 0").selectExpr("'damaged' type", "map('error', 'lost') headers", "block"))
    with pytest.raises(Exception, match="lost"):
        W.round_trip(spark.createDataFrame([(1, "u", "y" * 99_999)], PAGES)).collect()
