"""WARC archives: writing segmented records, and reassembly of segments by origin, with chunked framing undone."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from uuid import UUID

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import FILE, ROW, Batches, identified, map_batches
from vicinal.runtime import materialise, scratch

#: Payload bytes from which equal records become revisits.
REVISIT_FROM = 1000
#: Bytes of a record's block in one segment, of one HTTP chunk, and of one archive before the next begins.
SEGMENT, HTTP_CHUNK, ARCHIVE = 16_384, 4096, 8 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, origin string, segment int, total bigint, block_bytes bigint, headers map<string,string>, block binary"
ARROW_RECORD = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
)


#: A chunk's size line, and what follows the last one's.
CHUNK = re.compile(rb"([0-9A-Fa-f]{1,16})[ \t]*(?:;[^\r\n]*)?\r\n")
TRAILER = re.compile(rb"(?:[!#-'*+.^-z|~A-Z0-9-]+:[^\r\n]*\r\n)*\r\n")


def frame_chunked(body: bytes, size: int = HTTP_CHUNK) -> bytes:
    """Chunked transfer framing of a message body."""
    parts = [b"%x\r\n%b\r\n" % (len(body[a : a + size]), body[a : a + size]) for a in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe_chunked(data: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are skipped. Bad framing is an error.

    A size is hexadecimal digits; trailers are header lines up to an empty one, and nothing follows it.
    """
    out, at = [], 0
    while True:
        line = CHUNK.match(data, at)
        if not line:
            raise ValueError("chunk size expected")
        size = int(line[1], 16)
        if not size:
            if not TRAILER.fullmatch(data, line.end()):
                raise ValueError("last chunk isn't ended")
            return b"".join(out)
        at = line.end() + size
        if data[at : at + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        out.append(data[line.end() : at])
        at += 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response block, with chunked framing undone."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    return unframe_chunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body


def urn(*parts: object) -> str:
    return f"<urn:uuid:{UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    return re.sub(r"\s", "%20", url) if url else None


def write_record(key: tuple[int, int], url: str | None, page_id: int | None, payload: bytes, digest: str, refers: tuple[int, tuple[int, int], str | None] | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of one page: a response in as many segments as it needs, or a revisit.

    key names the record. A revisit names the record that holds its payload: refers is that one's page_id, key and URL.
    """
    own = urn(*key)
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if refers is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")]
        more += [("WARC-Refers-To", urn(*refers[1])), ("WARC-Refers-To-Target-URI", _uri(refers[2])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", refers[0])]
        yield _record([("WARC-Type", "revisit"), *common, *more], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame_chunked(payload)
    n = max(1, -(-len(block) // segment))
    kind = ("Content-Type", "application/http; msgtype=response")
    yield _record([("WARC-Type", "response"), *common, kind, ("WARC-Segment-Number", 1 if n > 1 else None)], block[:segment])
    for k in range(1, n):
        more = [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", len(block) if k == n - 1 else None)]
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(*key, k)), ("WARC-Date", DATE), *more], block[k * segment : (k + 1) * segment])


def inflate(data: bytes) -> bytes:
    """A gzip file of any number of members (a .warc.gz has one for each record) as plain bytes; others as they are."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        if not member.eof:
            raise ValueError("gzip member is cut short")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or of gzip members."""
    data, at = inflate(data), 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError("no WARC record")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("record header is cut short")
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode()).split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield headers, block
        at = end + 8 + size


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, FILE and ROW (the record's key), refers: the page_id, key and URL of the record that it revisits, if any.

    Of pages with equal payloads of at least REVISIT_FROM bytes that with the largest page_id is the
    response; repeats of its page_id are responses too. Rows with a null page_id are never revisits nor
    referred to. Digests, not payloads, are grouped; a hot payload is one row after the partial aggregate,
    and AQE splits its side of the join.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = identified(pages.select("page_id", "url", "html"))
    own = rows.select(FILE, ROW, F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    first = own.where(F.col("bytes") >= REVISIT_FROM).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", FILE, ROW, "url")).alias("response"), F.count("*").alias("n")).where("n > 1 and response.page_id is not null")
    first = materialise(first.select(F.col("digest").alias("_digest"), "response"), "responses")
    revisit = F.when(F.col("page_id") < F.col("response.page_id"), F.col("response"))
    return own.join(first, own["digest"] == first["_digest"], "left").select("page_id", "url", "payload", "digest", FILE, ROW, revisit.alias("refers"))


def write_archives(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """archive string, part int, data binary: the archives, about ARCHIVE bytes each, as rows of a table.

    As a table they can be written to any store that Spark writes to. Segments of a record may lie in
    different archives.
    """
    schema = pa.schema([("archive", pa.string()), ("data", pa.binary())])

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, part = TaskContext.get().partitionId(), [], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06}-{part:04}.warc"]), pa.array([b"".join(held)], pa.binary())], schema=schema)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers", FILE, ROW)]
            for page_id, url, payload, digest, to, *key in zip(*cols, strict=True):
                refers = to and (to["page_id"], (to[FILE], to[ROW]), to["url"])
                for record in write_record(tuple(key), url, page_id, payload, digest, refers, segment):
                    if held and size + len(record) > ARCHIVE:
                        yield archive()
                        held, size, part = [], 0, part + 1
                    held.append(record)
                    size += len(record)
        if held:
            yield archive()

    return map_batches(planned(pages), scan, "archive string, data binary")


def export(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a .warc file; folder must be one that all executors share."""

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("data").to_pylist(), strict=True):
                with open(f"{folder}/.{name}.tmp", "wb") as f:
                    f.write(data)
                os.replace(f"{folder}/.{name}.tmp", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([b.column("archive")], names=["archive"])

    map_batches(archives, scan, "archive string").write.format("noop").mode("overwrite").save()


def archives_of(spark, folder: str) -> DataFrame:
    """archive, data of the .warc files of a folder, through Spark's reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def segments(archives: DataFrame) -> DataFrame:
    """One row for each record in the archives, continuation records too.

    Where an archive is damaged, a row of type `damaged` follows its records up to there, with the reason
    under `error` in its headers. A null archive gives no rows.
    """

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                rows = []
                try:
                    for h, block in read_records(data or b""):
                        total = h.get("warc-segment-total-length")
                        origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                        rows.append((h["warc-record-id"], h["warc-type"], origin, int(h.get("warc-segment-number", 0)), total and int(total), len(block), list(h.items()), block))
                except (ValueError, KeyError, zlib.error) as e:
                    rows.append((None, "damaged", None, 0, None, 0, [("error", f"{type(e).__name__}: {e}")], b""))
                for a in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 500]], f.type) for k, f in enumerate(ARROW_RECORD)], schema=ARROW_RECORD)

    return map_batches(archives.select("data"), scan, RECORD, rows=4)


def reassemble(records: DataFrame) -> DataFrame:
    """type, headers, block of every whole record.

    Records of one segment pass straight through; the others are grouped by the identifier of their origin,
    ordered by segment number and joined. A missing or repeated segment, or a length other than the total
    that the last segment states, makes a row of type `damaged` with the reason under `error` in its headers
    and no block. A group is one record, so a task holds what one row can: payloads of up to about 1 GB.
    """
    whole = records.where("segment = 0").select("type", "headers", "block")
    parts = F.array_sort(F.collect_list(F.struct("segment", "type", "total", "block_bytes"))).alias("p")
    grouped = records.where("segment > 0").groupBy("origin").agg(parts, F.min_by(F.to_json("headers"), "segment").alias("first"), F.expr("listagg(block) within group (order by segment)").alias("block"))
    gapless = F.transform("p.segment", lambda s: s.cast("bigint")) == F.sequence(F.lit(1).cast("bigint"), F.size("p").cast("bigint"))
    size = F.aggregate("p.block_bytes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    sound = F.coalesce(gapless & (F.element_at("p.total", -1) == size) & (F.element_at("p.type", 1) == "response"), F.lit(False))
    headers = F.from_json("first", "map<string,string>")
    why = F.map_concat(F.map_filter(headers, lambda k, v: k != "error"), F.create_map(F.lit("error"), F.concat(F.lit("segments don't make a whole record: "), F.col("origin"))))
    several = grouped.select(F.when(sound, F.element_at("p.type", 1)).otherwise("damaged").alias("type"), F.when(sound, headers).otherwise(why).alias("headers"), F.when(sound, F.col("block")).otherwise(F.lit(b"")).alias("block"))
    return whole.unionByName(several)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and error of whole records.

    A response's payload is decoded and its digest must be that in the header; a revisit states both. A
    damaged record has record_type `damaged`, the reason in error, and no payload columns; in the others
    error is null.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])

    def read(kind: str, h: dict[str, str], block: bytes) -> tuple:
        if kind == "damaged":
            raise ValueError(h["error"])
        digest = h["warc-payload-digest"].partition(":")[2]
        if kind == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", block)
            if not length:
                raise ValueError("revisit without a length")
            size = int(length[1])
        else:
            payload = http_payload(block)
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("payload differs from its digest")
        page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
        return page and int(page), h.get("warc-target-uri"), size, digest, kind, refers and int(refers), None

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, headers, block in zip(b.column("type").to_pylist(), b.column("headers").to_pylist(), b.column("block").to_pylist(), strict=True):
                h = dict(headers)
                try:
                    rows.append(read(kind, h, block))
                except (ValueError, KeyError) as e:
                    rows.append((None, h.get("warc-target-uri"), None, None, "damaged", None, str(e) if kind == "damaged" else f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return map_batches(records, scan, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, error string", rows=500)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to: all pages written as WARC archives into the shared folder, and read back.

    A record that comes back damaged is an error here.
    """
    with scratch():
        archives = materialise(write_archives(pages), "warc", outlive=True)
    back = pages_of(reassemble(segments(archives)))
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("error")).cast("string"))
    return back.withColumn("record_type", sound).drop("error")
