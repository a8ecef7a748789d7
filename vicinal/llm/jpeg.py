"""Baseline JPEG (ITU-T T.81) frames of one to four components: a general decoder and a byte-carrying encoder."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

SOI, EOI = b"\xff\xd8", b"\xff\xd9"
#: Blocks along a side of a carrier frame; each block of 64 coefficients carries 64 bytes.
SIDE = 4
FRAME_BYTES = SIDE * SIDE * 64

# Fixed values of T.81, K.3: the default Huffman tables, which AVI frames leave out. Codes of each length, and
# the first symbols in code order; all other symbols follow in ascending order.
DC_COUNTS = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
AC_COUNTS = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119])
AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)


def _zigzag() -> np.ndarray:
    """Natural position of the k-th coefficient: along anti-diagonals, turning at each."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()


@cache
def idct_matrix() -> np.ndarray:
    """64 x 64: row of natural-order coefficients to row of pixels."""
    k = np.arange(8)
    a = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.kron(a, a).T.astype(np.float32)  # [coefficient, pixel]


@dataclass(eq=False)
class Huffman:
    """Code lengths 1 to 16 and the symbols in code order."""

    counts: list[int]
    symbols: list[int]
    look: tuple[np.ndarray, np.ndarray] = field(init=False)  # by the next 16 bits: symbol, length (0: no code)
    words: np.ndarray | None | bool = field(init=False, default=False)

    def __post_init__(self):
        symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, at = 0, 0
        if len(self.counts) != 16 or sum(self.counts) != len(self.symbols):
            raise ValueError("damaged Huffman table")
        for n, count in enumerate(self.counts, 1):
            for _ in range(count):
                lo = code << (16 - n)
                if lo >= 1 << 16:
                    raise ValueError("damaged Huffman table")
                symbol[lo : lo + (1 << (16 - n))], length[lo : lo + (1 << (16 - n))] = self.symbols[at], n
                code, at = code + 1, at + 1
            code <<= 1
        self.look = symbol, length

    def whole_words(self) -> np.ndarray | None:
        """By 16-bit word: the coefficient it codes, if every symbol and its amplitude bits fill a word; else None.

        Words that are no code give 0, which no such word codes.
        """
        if self.words is False:
            symbol, length = self.look
            size = symbol & 15
            used = length > 0
            if ((symbol[used] >> 4) != 0).any() or (size[used] == 0).any() or (size[used] + length[used] != 16).any():
                self.words = None
            else:
                bits = np.arange(1 << 16) & ((1 << size) - 1)
                value = np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1)
                self.words = np.where(used, value, 0)
        return self.words


@cache
def default_tables() -> dict[int, Huffman]:
    """The tables of T.81, K.3 by class and number, as in a DHT segment."""
    every = sorted({run << 4 | size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0})
    out = {}
    for k in (0, 1):
        first = [int(x, 16) for x in AC_FIRST[k].split()]
        out[k] = Huffman(DC_COUNTS[k], list(range(12)))
        out[0x10 | k] = Huffman(AC_COUNTS[k], first + [s for s in every if s not in first])
    return out


@dataclass
class Part:
    """One component: its sampling factors, quantisation (natural order) and tables."""

    h: int
    v: int
    quant: np.ndarray
    dc: Huffman
    ac: Huffman


@dataclass
class Header:
    height: int
    width: int
    parts: list[Part]  # those of the first scan, the luminance first
    most: tuple[int, int]  # largest sampling factors of all components
    restart: int
    scan: int  # offset of the entropy-coded data

    def blocks(self) -> int:
        """Blocks of a frame of one component."""
        return -(-self.height // 8) * -(-self.width // 8)


def _segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, body, end) of each segment up to the scan."""
    if data[:2] != SOI:
        raise ValueError("no JPEG image")
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield data[at + 1], data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


@lru_cache(64)
def parse_header(data: bytes) -> Header:
    """Reads the segments up to the scan; data may end there. Baseline Huffman coding with 8 bits; missing tables are the default ones."""
    quants, tables, frame, restart = {}, dict(default_tables()), None, 0
    for kind, body, end in _segments(data):
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                if len(body) <= n:
                    raise ValueError("damaged quantisation table")
                table = np.zeros(64, np.float32)
                table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1")
                quants[body[0] & 15], body = table, body[1 + n :]
        elif kind == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                tables[body[0]], body = Huffman(counts, list(body[17 : 17 + n])), body[17 + n :]
        elif kind in (0xC0, 0xC1):
            bits, h, w, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not h or not w or not 1 <= n <= 4 or len(body) < 6 + 3 * n:
                raise ValueError("only 8-bit frames of one to four components")
            frame = h, w, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only baseline frames")
        elif kind == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            height, width, shape = frame
            if any(not 1 <= f <= 4 for h, v, _ in shape.values() for f in (h, v)):
                raise ValueError("damaged sampling factors")
            try:
                parts = [Part(*shape[body[1 + 2 * i]][:2], quants[shape[body[1 + 2 * i]][2]], tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])]
            except (KeyError, IndexError) as e:
                raise ValueError("scan names a table that isn't there") from e
            return Header(height, width, parts, (max(h for h, _, _ in shape.values()), max(v for _, v, _ in shape.values())), restart, end)
    raise ValueError("no scan")


class _Bits:
    """The bits of one restart interval, and the next coefficients from them."""

    def __init__(self, part: bytes):
        self.data, self.pos, self.total = memoryview(part + b"\xff" * 8), 0, len(part) * 8

    def peek(self) -> int:
        b = self.pos >> 3
        return (int.from_bytes(self.data[b : b + 4]) >> (16 - (self.pos & 7))) & 0xFFFF

    def block(self, part: Part, pred: int, out: np.ndarray) -> int:
        """Fills out with one block in zigzag order; returns its DC value."""
        k = 0
        while k < 64:
            symbol, length = (part.ac if k else part.dc).look
            w = self.peek()
            s, used = int(symbol[w]), int(length[w])
            if not used or self.pos > self.total:
                raise ValueError("damaged scan")
            self.pos += used
            run, size = (s >> 4, s & 15) if k else (0, s & 15)
            if k and not size:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            bits = self.peek() >> (16 - size) if size else 0
            self.pos += size
            v = bits if not size or bits >> (size - 1) else bits - (1 << size) + 1
            if k > 63:
                raise ValueError("damaged scan")
            if not k:
                v += pred
            out[k] = v
            k += 1
        return int(out[0])


def _intervals(data: bytes) -> list[bytes]:
    """The restart intervals of an entropy-coded segment, stuffing removed."""
    parts, at = [], 0
    while True:
        cut = data.find(b"\xff", at)
        while cut >= 0 and cut + 1 < len(data) and data[cut + 1] == 0:
            cut = data.find(b"\xff", cut + 2)
        end = len(data) if cut < 0 else cut
        parts.append(data[at:end].replace(b"\xff\x00", b"\xff"))
        if cut < 0 or cut + 1 >= len(data) or not 0xD0 <= data[cut + 1] <= 0xD7:
            return parts
        at = cut + 2


def _decode_scan(h: Header, data: bytes) -> list[np.ndarray]:
    """Coefficients (block rows x block columns x 64, zigzag order) of each component of an entropy-coded segment, code by code.

    One component comes block by block; several come interleaved, with each unit holding as many blocks of
    each as its sampling factors say.
    """
    single = len(h.parts) == 1
    unit_w, unit_h = (8, 8) if single else (8 * h.most[0], 8 * h.most[1])
    p = h.parts[0]
    width, height = (-(-h.width * p.h // h.most[0]), -(-h.height * p.v // h.most[1])) if single else (h.width, h.height)
    cols, rows = -(-width // unit_w), -(-height // unit_h)
    steps = [(1, 1)] if single else [(p.h, p.v) for p in h.parts]
    if rows * cols * sum(w * v for w, v in steps) * 2 > len(data) * 8:  # a block takes two bits at least
        raise ValueError("scan ends early")
    out = [np.zeros((rows * v, cols * w, 64), np.int64) for w, v in steps]
    unit, units = 0, rows * cols
    for part in _intervals(data):
        bits, pred = _Bits(part), [0] * len(steps)
        last = min(units, unit + (h.restart or units))
        while unit < last:
            y, x = divmod(unit, cols)
            for c, (w, v) in enumerate(steps):
                for i in range(v):
                    for j in range(w):
                        pred[c] = bits.block(h.parts[c], pred[c], out[c][y * v + i, x * w + j])
            unit += 1
    if unit < units:
        raise ValueError("scan ends early")
    return out


def _pixels(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Frames of pixels from coefficients, ... x block rows x block columns x 64 in zigzag order."""
    natural = np.empty(coefs.shape, np.float32)
    natural[..., ZIGZAG] = coefs
    values = (natural * quant).reshape(-1, 64) @ idct_matrix()
    values = np.clip(np.rint(values + 128), 0, 255).astype(np.uint8)
    *lead, rows, cols, _ = coefs.shape
    return np.moveaxis(values.reshape(*lead, rows, cols, 8, 8), -2, -3).reshape(*lead, rows * 8, cols * 8)


def _head(frame: bytes) -> bytes:
    """A frame up to its scan."""
    for kind, _, end in _segments(frame):
        if kind == 0xDA:
            return frame[:end]
    raise ValueError("no scan")


def planes(frame: bytes) -> list[np.ndarray]:
    """All components of a frame as planes of its full size: grey, or luminance and chrominances."""
    head = _head(frame)
    h = parse_header(head)
    out = []
    for part, c in zip(h.parts, _decode_scan(h, frame[len(head) :]), strict=True):
        plane = _pixels(c, part.quant)
        for axis, factor in ((0, h.most[1] // part.v), (1, h.most[0] // part.h)):
            plane = np.repeat(plane, factor, axis)
        out.append(plane[: h.height, : h.width])
    return out


def rgb(frame: bytes) -> np.ndarray:
    """Height x width x 3 pixels of a frame, from YCbCr as in JFIF; a grey frame has equal channels."""
    p = planes(frame)
    if len(p) < 3:
        return np.repeat(p[0][:, :, None], 3, axis=2)
    y, b, r = (x.astype(np.float32) for x in p[:3])
    out = np.stack([y + 1.402 * (r - 128), y - 0.344136 * (b - 128) - 0.714136 * (r - 128), y + 1.772 * (b - 128)], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(frames: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(coefficients, blocks x 64 in zigzag order; luminance pixels, height x width) of each frame.

    Frames whose header and length agree, whose codes fill whole 16-bit words and that restart at each
    block are decoded together by table look-up; any other baseline frame goes code by code.
    """
    coefs: list[np.ndarray | None] = [None] * len(frames)
    pixels: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[tuple[bytes, int], list[int]] = {}
    head = SOI
    for i, f in enumerate(frames):
        if head == SOI or not f.startswith(head):
            head = _head(f)
        groups.setdefault((head, len(f)), []).append(i)
    for (head, size), own in groups.items():
        h = parse_header(head)
        p, n, rest = h.parts[0], h.blocks(), own
        dc, ac = p.dc.whole_words(), p.ac.whole_words()
        if len(h.parts) == 1 and h.restart == 1 and dc is not None and ac is not None and size - len(head) == 130 * n:
            body = np.frombuffer(b"".join(frames[i][len(head) :] for i in own), np.uint8).reshape(len(own), n, 130)
            marker = np.append(0xD0 + np.arange(n - 1) % 8, 0xD9)
            words = np.ascontiguousarray(body[:, :, :128]).view(">u2")
            regular = (body[:, :, 128] == 0xFF).all(1) & (body[:, :, 129] == marker).all(1) & (body[:, :, :128] != 0xFF).all((1, 2))
            c = ac[words]
            c[:, :, 0] = dc[words[:, :, 0]]
            regular &= (c != 0).all((1, 2))
            image = _pixels(c.reshape(len(own), -(-h.height // 8), -(-h.width // 8), 64), p.quant)[:, : h.height, : h.width]
            for r, i in enumerate(own):
                if regular[r]:
                    coefs[i], pixels[i] = c[r], image[r]
            rest = [i for r, i in enumerate(own) if not regular[r]]
        for i in rest:
            c = _decode_scan(h, frames[i][len(head) :])[0]
            plane = _pixels(c, p.quant)
            for axis, factor in ((0, h.most[1] // p.v), (1, h.most[0] // p.h)):
                plane = np.repeat(plane, factor, axis)
            coefs[i], pixels[i] = c.reshape(-1, 64), plane[: h.height, : h.width]
    return coefs, pixels


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


@cache
def _carrier() -> tuple[bytes, np.ndarray]:
    """Header of a carrier frame, and by byte the 16-bit word of its coefficient.

    Byte b is coefficient b - 128 below 128 and b - 127 from there: never 0, so there are no runs and no
    end-of-block codes. Category s has a code of 16 - s bits: code and amplitude fill 16 bits.
    """
    counts = [0] * 16
    for s in range(1, 9):
        counts[16 - s - 1] += 1
    order = list(range(8, 0, -1))
    table = Huffman(counts, order)
    value = table.whole_words()
    words = np.zeros(256, np.uint16)
    for w in np.flatnonzero(value):
        b = int(value[w]) + 128 - (value[w] > 0)
        if 0 <= b < 256:
            words[b] = w
    px = 8 * SIDE
    head = SOI + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, px, px, 1) + b"\1\x11\0")
    head += _segment(0xC4, b"\0" + bytes(counts) + bytes(order)) + _segment(0xC4, b"\x10" + bytes(counts) + bytes(order))
    head += _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")
    return head, words


def encode_bytes(payload: bytes) -> np.ndarray:
    """Carrier frames (frames x bytes) whose quantised coefficients, in zigzag order, are the payload's bytes; the last is filled with 0."""
    head, words = _carrier()
    n = max(1, -(-len(payload) // FRAME_BYTES))
    data = np.zeros(n * FRAME_BYTES, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = SIDE * SIDE
    out = np.empty((n, len(head) + 130 * blocks), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    scan = out[:, len(head) :].reshape(n, blocks, 130)
    scan[:, :, :128] = words[data].astype(">u2").view(np.uint8).reshape(n, blocks, 128)
    scan[:, :, 128] = 0xFF
    scan[:, :, 129] = np.append(0xD0 + np.arange(blocks - 1) % 8, 0xD9)
    return out


def carried_bytes(coefs: list[np.ndarray]) -> bytes:
    """The payload of carrier frames, with the filling of the last."""
    c = np.stack(coefs) if coefs else np.zeros((0, 64), np.int64)
    return (c + 128 - (c > 0)).astype(np.uint8).tobytes()
