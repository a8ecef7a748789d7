"""AVI motion-JPEG columns: RIFF index, intra frames, shots by adaptive histogram differences."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import jpeg
from vicinal.llm.common import Batches, byte_rows, crc32, map_batches, record_batch, utf8

UNIT = 64
FPS = 25
BINS = 32
#: A cut: a difference this large, the largest among its neighbours, and above their mean by so many deviations.
LEAST_CUT, DEVIATIONS, RADIUS = 0.05, 2.0, 4
#: Frames decoded at a time.
FRAMES_AT_ONCE = 2048


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, note: str = "", fps: int = FPS) -> bytes:
    """An AVI file of one motion-JPEG stream with an idx1 index; note goes to the INFO list."""
    n, largest = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note.encode() + b"\0"))
    pad = [len(f) + len(f) % 2 + 8 for f in frames]
    at = np.cumsum([4, *pad])[:-1].tolist()
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    idx1 = _chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, a, len(f)) for a, f in zip(at, frames, strict=True)))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + movi + idx1)


@dataclass
class Avi:
    fps: float
    width: int
    height: int
    note: str
    frames: list[bytes]


def _lists(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body, end) of every chunk outside the movi lists, and of those lists as such, in all RIFF parts of a file."""
    part = 0
    while part + 12 <= len(data) and data[part : part + 4] == b"RIFF":
        size = struct.unpack_from("<I", data, part + 4)[0]
        stack = [(part + 12, min(len(data), part + 8 + size))]
        while stack:
            at, end = stack.pop()
            while at + 8 <= end:
                kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
                body, stop = at + 8, min(at + 8 + n, end)
                if kind == b"LIST" and data[body : body + 4] != b"movi":
                    stack.append((body + 4, stop))
                else:
                    yield data[body : body + 4] if kind == b"LIST" else kind, body, stop
                at = body + n + n % 2
        part += 8 + size + size % 2


def _walked(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """The frames of a movi list, record lists included, as they lie."""
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST":
            yield from _walked(data, at + 12, min(at + 8 + size, end))
        elif kind[2:] in (b"dc", b"db") and size:
            yield data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _super_index(data: bytes, body: int, end: int) -> Iterator[bytes]:
    """The frames of an OpenDML index: a list of index chunks, each a list of places and sizes; or one such chunk."""
    longs, _, kind, used = struct.unpack_from("<HBBI", data, body)
    if kind == 0 and longs == 4:
        for k in range(used):
            at, size = struct.unpack_from("<QI", data, body + 24 + 16 * k)
            yield from _super_index(data, at + 8, min(len(data), at + size))
    elif kind == 1 and longs == 2:
        base = struct.unpack_from("<Q", data, body + 12)[0]
        for k in range(used):
            at, size = struct.unpack_from("<II", data, body + 24 + 8 * k)
            if size & 0x7FFFFFFF:
                yield data[base + at : base + at + (size & 0x7FFFFFFF)]
    else:
        raise ValueError("unknown index")


def _old_index(data: bytes, body: int, end: int, movi: int) -> Iterator[bytes]:
    """The frames of an idx1 index."""
    for k in range((end - body) // 16):
        kind, _, at, size = struct.unpack_from("<4sIII", data, body + 16 * k)
        if kind[2:] not in (b"dc", b"db") or not size:
            continue
        at = movi + at if data[movi + at : movi + at + 4] == kind else at  # some writers count from the file's start
        if data[at : at + 4] != kind:
            raise ValueError("index points at no frame")
        yield data[at + 8 : at + 8 + size]


def read_avi(data: bytes) -> Avi:
    """Parses a RIFF AVI file, OpenDML parts included.

    Frames come from the OpenDML index of the video stream, else from idx1 if the file is one RIFF part, else
    from the movi lists as they lie. Anything that is no such file is a ValueError.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, width, height, note, movi, index, super_index, video = 0.0, 0, 0, "", [], None, None, False
    try:
        for kind, body, end in _lists(data):
            if kind == b"movi":
                movi.append((body, end))
            elif kind == b"avih":
                us, width, height = struct.unpack_from("<I", data, body)[0], *struct.unpack_from("<II", data, body + 32)
                fps = 1e6 / us if us else 0.0
            elif kind == b"strh":
                video = data[body : body + 4] == b"vids"
                if video:
                    scale, rate = struct.unpack_from("<II", data, body + 20)
                    fps = rate / scale if scale else fps
            elif kind == b"indx" and video:
                super_index = body, end
            elif kind == b"ICMT":
                note = data[body:end].rstrip(b"\0").decode(errors="replace")
            elif kind == b"idx1" and index is None:
                index = body, end
        if not movi:
            raise ValueError("no movi list")
        if super_index:
            frames = list(_super_index(data, *super_index))
        elif index and len(movi) == 1:
            frames = list(_old_index(data, *index, movi[0][0]))
        else:
            frames = [f for body, end in movi for f in _walked(data, body + 4, end)]
    except (struct.error, RecursionError) as e:
        raise ValueError("file is cut short") from e
    return Avi(fps, width, height, note, frames)


def histograms(pixels: list[np.ndarray]) -> np.ndarray:
    """Share of the pixels in each of BINS grey bands, for each frame."""
    out = np.zeros((len(pixels), BINS))
    same = len({p.shape for p in pixels}) == 1
    for at, some in [(slice(None), np.stack(pixels))] if same else [(slice(i, i + 1), p[None]) for i, p in enumerate(pixels)]:
        n = len(some)
        flat = (some.reshape(n, -1).astype(np.int64) * BINS >> 8) + np.arange(n)[:, None] * BINS
        out[at] = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / max(1, flat.shape[1])
    return out


def cuts(hist: np.ndarray) -> np.ndarray:
    """Frames that begin a shot (0 not counted): their histogram difference stands out from its neighbours'."""
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    if not len(d):
        return np.zeros(0, np.int64)
    padded = np.pad(d, RADIUS, constant_values=np.nan)
    near = np.lib.stride_tricks.sliding_window_view(padded, 2 * RADIUS + 1)
    others = np.delete(near, RADIUS, axis=1)
    count = np.maximum(1, (~np.isnan(others)).sum(1))
    filled = np.nan_to_num(others)
    mean = filled.sum(1) / count
    var = np.maximum(0, (filled**2).sum(1) / count - mean**2)
    return np.flatnonzero((d >= LEAST_CUT) & (d > mean + DEVIATIONS * np.sqrt(var)) & (d >= filled.max(1))) + 1


def analyse(media: bytes, with_bytes: bool = False) -> tuple[bytes, list[tuple[int, int]], Avi, np.ndarray]:
    """(bytes in the coefficients, shots as first and one-past-last frame, the file, histograms) of an AVI column value."""
    avi = read_avi(media)
    carried, hist = [], []
    for a in range(0, len(avi.frames), FRAMES_AT_ONCE):
        coefs, pixels = jpeg.decode(avi.frames[a : a + FRAMES_AT_ONCE])
        if with_bytes:
            carried.append(jpeg.carried_bytes(coefs))
        hist.append(histograms(pixels))
    h = np.concatenate(hist) if hist else np.zeros((0, BINS))
    edges = [0, *cuts(h).tolist(), len(h)] if len(h) else []
    return b"".join(carried), list(zip(edges, edges[1:], strict=False)), avi, h


def store(text: bytes) -> bytes:
    """A text as motion-JPEG AVI: its bytes, filled with 0 to a positive multiple of UNIT, as quantised coefficients."""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    frames = [f.tobytes() for f in jpeg.encode_bytes(text + bytes(size - len(text)))]
    px = 8 * jpeg.SIDE
    return write_avi(frames, px, px, f"payload={size} text={len(text)}")


def load(media: bytes) -> tuple[bytes, int, list[tuple[int, int]], Avi, np.ndarray]:
    """(payload, text bytes, shots, file, histograms) of a stored text."""
    carried, shots, avi, h = analyse(media, with_bytes=True)
    size, n = (int(x.split("=")[1]) for x in avi.note.split())
    if len(carried) < size or any(carried[size:]):
        raise ValueError("frames don't hold the payload that the file states")
    return carried[:size], n, shots, avi, h


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media: every whole text as an AVI column; null as the empty text.

    A medium is twice its text and a cell of a column holds at most 2 GB, so texts of over 1 GB are an error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([store(t) for t in byte_rows(b, "text")], pa.binary())], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text")), scan, "doc_id bigint, media binary", rows=500, size=4 << 20)


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, n_frames, start_s, end_s, error: one timed row for each shot of an AVI column.

    Null and empty media, and files without frames, give no rows. A damaged or unsupported file gives one row
    with the reason in error and nulls in the other columns; in all others error is null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string())])

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, m in zip(b.column("doc_id").to_pylist(), byte_rows(b, "media"), strict=True):
                if m:
                    try:
                        _, shots, avi, _ = analyse(m)
                    except (ValueError, struct.error, IndexError) as e:
                        rows.append((i, None, None, None, None, None, str(e)))
                        continue
                    fps = avi.fps or FPS
                    rows += [(i, k, s, e - s, s / fps, e / fps, None) for k, (s, e) in enumerate(shots)]
            yield record_batch(schema, {f.name: [r[k] for r in rows] for k, f in enumerate(schema)})

    own = media.select(F.col("doc_id").cast("bigint").alias("doc_id"), "media")
    return map_batches(own, scan, "doc_id bigint, clip int, first_frame int, n_frames int, start_s double, end_s double, error string", rows=500)


def digests(docs: DataFrame) -> DataFrame:
    """What a reader of the stored column finds for every document: lengths, checksums and a shot summary.

    Rows are independent: repeated rows and equal texts give equal values, extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for i, m in zip(b.column("doc_id").to_pylist(), byte_rows(b, "media"), strict=True):
                payload, n, shots, avi, h = load(m)
                change = np.abs(np.diff(h, axis=0)).sum(1) / 2
                summary = f"frames={len(h)};shots={len(shots)};starts={','.join(str(s) for s, _ in shots)};change={change.mean() if len(change) else 0:.3f}"
                row = (i, n, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), summary)
                for f, v in zip(schema, row, strict=True):
                    out[f.name].append(v)
            yield record_batch(schema, out)

    return map_batches(stored(docs), scan, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", rows=500)
