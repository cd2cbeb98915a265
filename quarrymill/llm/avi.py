"""AVI motion-JPEG: write and parse RIFF files, decode their intra frames, and find shots.

Frames are baseline JPEG (8 bits, Huffman, one to three components, restart markers; files without Huffman tables get
the standard ones, as motion-JPEG files often lack them). The decoder is vectorised over entropy-coded segments: all
frames of a batch that share tables and layout, cut at restart markers, step through their Huffman codes together.

``store_payload`` keeps bytes losslessly in a file: a byte is one quantised coefficient level (the format's own unit)
minus 128, so 576 bytes are the nine 8x8 blocks of a 24x24 frame, with all quantisers 1.

Edge cases of ``media_features``: a null text is empty and its payload is one frame of filler; repeated rows repeat;
extra columns are ignored; tables without rows give none.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

BLOCK = 576
SIDE = 24
FPS = 24
#: Segments that step together at most, which bounds memory.
LANES = 8192

# The zigzag order and the standard Huffman tables of the JPEG standard (annex K). Code values beyond
# those listed follow in ascending order.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
DC_LUMA_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_CHROMA_BITS = [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
AC_LUMA_BITS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_CHROMA_BITS = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
AC_LUMA_HEAD = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")
AC_CHROMA_HEAD = bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1".replace(" ", ""))


def _all_values(head: bytes) -> bytes:
    every = [r << 4 | s for r in range(16) for s in range(1, 11)]
    return head + bytes(x for x in sorted(every) if x not in head)


STANDARD = {
    (0, 0): (DC_LUMA_BITS, bytes(range(12))),
    (0, 1): (DC_CHROMA_BITS, bytes(range(12))),
    (1, 0): (AC_LUMA_BITS, _all_values(AC_LUMA_HEAD)),
    (1, 1): (AC_CHROMA_BITS, _all_values(AC_CHROMA_HEAD)),
}


def _codes(bits: list[int], values: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length)"""
    out, code, k = [], 0, 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            out.append((values[k], code, n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _encoder(table: tuple[list[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, c, n in _codes(*table):
        code[symbol], length[symbol] = c, n
    return code, length


_ENC_DC, _ENC_AC = _encoder(STANDARD[0, 0]), _encoder(STANDARD[1, 0])


def _item_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number by zero run (16: a first level) * 4096 + value + 2048."""
    value = np.arange(-2048, 2048)
    size = np.array([int(abs(v)).bit_length() for v in value])
    amplitude = np.where(value < 0, value + (1 << size) - 1, value)
    bits, length = np.zeros((17, 4096), np.uint64), np.zeros((17, 4096), np.int64)
    for run in range(17):
        symbol = np.minimum(size, 11) if run == 16 else run << 4 | np.minimum(size, 10)
        code, n = _ENC_DC if run == 16 else _ENC_AC
        bits[run], length[run] = code[symbol] << size | amplitude, n[symbol] + size
    return bits.reshape(-1), length.reshape(-1)


_ITEM_BITS, _ITEM_LENGTH = _item_tables()


# ---------------------------------------------------------------------------------------------------------------
# Writing


def encode_scans(levels: np.ndarray) -> list[bytes]:
    """Entropy-coded data of grey frames; levels: (frame, block, 64) quantised levels in zigzag order, differences of
    first levels within 2047 and the others within 1023."""
    n_frames, n_blocks, _ = levels.shape
    values = levels.reshape(-1, 64).astype(np.int32)
    values[:, 0] = np.diff(values[:, 0].reshape(n_frames, n_blocks), axis=1, prepend=0).reshape(-1)
    present = values != 0
    present[:, 0] = True
    at = np.flatnonzero(present)
    pos = at & 63
    dc = pos == 0
    gap = np.zeros(len(at), np.int64)
    gap[1:] = at[1:] - at[:-1] - 1
    gap[dc] = 0
    item = np.where(dc, 16, gap & 15) << 12
    item += values.reshape(-1)[at] + 2048
    bits, n_bits, block = _ITEM_BITS[item], _ITEM_LENGTH[item], at >> 6
    skips = gap >> 4  # runs of sixteen zeros come before
    ends = np.append(block[1:] != block[:-1], True) & (pos < 63)
    if skips.any() or ends.any():
        n = np.arange(len(at))
        where = np.concatenate((np.repeat(n * 3, skips), n[ends] * 3 + 2))
        zrl = int(skips.sum())
        more = np.concatenate((np.full(zrl, _ENC_AC[0][0xF0]), np.full(len(where) - zrl, _ENC_AC[0][0]))).astype(np.uint64)
        more_n = np.concatenate((np.full(zrl, _ENC_AC[1][0xF0]), np.full(len(where) - zrl, _ENC_AC[1][0])))
        order = np.argsort(np.concatenate((n * 3 + 1, where)), kind="stable")
        block = np.concatenate((block, block[where // 3]))[order]
        bits, n_bits = np.concatenate((bits, more))[order], np.concatenate((n_bits, more_n))[order]
    frame = block // n_blocks
    starts = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
    per_frame = np.add.reduceat(n_bits, starts)
    n_bytes = (per_frame + 7) // 8
    begin = np.cumsum(n_bytes) - n_bytes
    offset = np.cumsum(n_bits) - n_bits
    offset += (begin * 8 - (np.cumsum(per_frame) - per_frame))[frame]
    word, shift = offset >> 5, (64 - (offset & 31) - n_bits).astype(np.uint64)
    placed = bits << shift
    total = int(n_bytes.sum())
    words = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), total // 4 + 2)
    words += np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), total // 4 + 2)
    data = words.astype(np.uint32).astype(">u4").view(np.uint8)[:total].copy()
    data[begin + n_bytes - 1] |= ((1 << (n_bytes * 8 - per_frame)) - 1).astype(np.uint8)
    stuffed = np.repeat(data, 1 + (data == 255))
    marks = np.flatnonzero(data == 255)
    stuffed[marks + np.arange(len(marks)) + 1] = 0
    grown = np.searchsorted(marks, begin)
    cuts = np.append(begin + grown, len(stuffed))
    blob = stuffed.tobytes()
    return [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def jpeg_header(width: int, height: int, quantisers: bytes = bytes([1]) * 64, tables: bool = False) -> bytes:
    """The markers of a grey frame before its scan data; with tables, the standard Huffman tables too."""
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + quantisers
    out += b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
    if tables:
        for (kind, slot), (bits, values) in STANDARD.items():
            if slot == 0:
                out += b"\xff\xc4" + struct.pack(">HB", 19 + len(values), kind << 4) + bytes(bits) + values
    return out + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """A RIFF AVI file of one motion-JPEG stream with an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4s5I", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, parts, at = [], [], 4
    for f in frames:
        parts.append(_chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def store_payload(payloads: list[bytes]) -> list[bytes]:
    """Files of payloads, each a positive multiple of 576 bytes long."""
    counts = [len(p) // BLOCK for p in payloads]
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    levels = data.reshape(-1, BLOCK // 64, 64)
    scans = [s for k in range(0, len(levels), 128) for s in encode_scans(levels[k : k + 128])]  # small enough for a cache
    head, out, at = jpeg_header(SIDE, SIDE), [], 0
    for n in counts:
        out.append(write_avi([head + s + b"\xff\xd9" for s in scans[at : at + n]], SIDE, SIDE))
        at += n
    return out


# ---------------------------------------------------------------------------------------------------------------
# Reading


@dataclass
class Movie:
    width: int = 0
    height: int = 0
    frame_us: int = 0
    codec: bytes = b""
    frames: list[bytes] = field(default_factory=list)


def read_avi(data: bytes) -> Movie:
    """The frames of the first video stream: by the idx1 index if there is one, else by walking the movi list.

    Raises ValueError on data that is no RIFF AVI file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    movie, movi, index = Movie(), None, b""

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, min(body + size, end))
                else:
                    walk(body + 4, min(body + size, end))
            elif name == b"avih":
                movie.frame_us = struct.unpack_from("<I", data, body)[0]
                movie.width, movie.height = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and not movie.codec and data[body : body + 4] == b"vids":
                movie.codec = data[body + 4 : body + 8]
            elif name == b"idx1":
                index = data[body : body + size]
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        return movie
    if index:
        entries = list(struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]))
        # offsets count from the movi tag, or from the file's start in some files
        base = movi[0] if not entries or data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        movie.frames = [data[base + o + 8 : base + o + 8 + n] for name, _, o, n in entries if name[2:] in (b"dc", b"db") and n]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                at += 12
                continue
            if name[2:] in (b"dc", b"db") and size:
                movie.frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return movie


@dataclass(frozen=True)
class Layout:
    """What frames must share to be decoded together."""

    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int], ...]  # id, horizontal, vertical, DC table, AC table
    tables: tuple[tuple[tuple[int, int], tuple[tuple[int, ...], bytes]], ...]
    quantisers: tuple[tuple[int, ...], ...]  # by component, in zigzag order
    restart: int


def parse_jpeg(frame: bytes) -> tuple[Layout, bytes]:
    """The layout of a baseline frame and its scan data, up to the end marker.

    Raises ValueError on other kinds of JPEG.
    """
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, tables, restart, size, parts = 2, {}, dict(STANDARD), 0, (0, 0), []
    while at + 4 <= len(frame):
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                bits = list(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (bits, body[17 : 17 + sum(bits)])
                body = body[17 + sum(bits) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit frames")
            size = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not parts or not all(1 <= x <= 4 for p in parts for x in p[1:3]):
                raise ValueError("a frame without components or with sampling factors beyond 1 to 4")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if body[0] != len(parts):
                raise ValueError("only interleaved scans")
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            used = tuple((c, h, v, chosen[c] >> 4, chosen[c] & 15) for c, h, v, _ in parts)
            need = sorted({(0, c[3]) for c in used} | {(1, c[4]) for c in used})
            end = frame.rfind(b"\xff\xd9")
            layout = Layout(size[1], size[0], used, tuple((k, (tuple(tables[k][0]), bytes(tables[k][1]))) for k in need), tuple(tuple(quant[q]) for _, _, _, q in parts), restart)
            scan = frame[at : end if end >= at else len(frame)]
            pattern, across, down = _mcu(layout)
            if len(pattern) * across * down > 4 * len(scan) + 64:  # a block takes two bits at least
                raise ValueError("a frame of more blocks than its data can hold")
            return layout, scan
    raise ValueError("a JPEG frame without a scan")


def _mcu(layout: Layout) -> tuple[list[int], int, int]:
    """The component of each block of a unit, and how many units a row and a column have."""
    if len(layout.components) == 1:
        return [0], -(-layout.width // 8), -(-layout.height // 8)
    h, v = max(c[1] for c in layout.components), max(c[2] for c in layout.components)
    pattern = [k for k, c in enumerate(layout.components) for _ in range(c[1] * c[2])]
    return pattern, -(-layout.width // (8 * h)), -(-layout.height // (8 * v))


def decode_levels(layout: Layout, scans: list[bytes]) -> np.ndarray:
    """(frame, block in scan order, 64) quantised levels in zigzag order; frames with broken data keep zeros from there on."""
    pattern, across, down = _mcu(layout)
    per = len(pattern)
    n_units = across * down
    segments, owner, first, length = [], [], [], []
    for f, s in enumerate(scans):
        pieces = [s]
        if layout.restart:
            pieces, last, k = [], 0, s.find(b"\xff")
            while k >= 0 and k + 1 < len(s):
                if 0xD0 <= s[k + 1] <= 0xD7:
                    pieces.append(s[last:k])
                    last = k + 2
                k = s.find(b"\xff", k + 2)
            pieces.append(s[last:])
        step = layout.restart or n_units
        for j, p in enumerate(pieces):
            if j * step < n_units:
                segments.append(p.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff\xff\xff\xff\xff\xff")
                owner.append(f)
                first.append(j * step * per)
                length.append(min(step, n_units - j * step) * per)
    out = np.zeros((len(scans) * n_units * per, 64), np.int16)
    look = {k: _lookup(t, k[0] == 0) for k, t in layout.tables}
    keys = list(look)
    tables = np.concatenate([look[k] for k in keys])
    dc_of = np.array([keys.index((0, c[3])) << 16 for c in layout.components])
    ac_of = np.array([keys.index((1, c[4])) << 16 for c in layout.components])
    comp_of = np.array(pattern)
    for lo in range(0, len(segments), LANES):
        _step(out, b"".join(segments[lo : lo + LANES]), np.array([len(s) for s in segments[lo : lo + LANES]]), np.array(owner[lo : lo + LANES]) * n_units * per + np.array(first[lo : lo + LANES]), np.array(length[lo : lo + LANES]), tables, dc_of, ac_of, comp_of)
    # first levels are kept as differences until here
    levels = out.reshape(len(scans), n_units * per, 64)
    step = (layout.restart or n_units) * per
    for c in range(len(layout.components)):
        own = np.flatnonzero(np.tile(comp_of == c, n_units))
        for lo in range(0, n_units * per, step):
            mine = own[(own >= lo) & (own < lo + step)]
            levels[:, mine, 0] = np.cumsum(levels[:, mine, 0], axis=1, dtype=np.int16)
    return levels


def _step(out: np.ndarray, blob: bytes, sizes: np.ndarray, base: np.ndarray, n_blocks: np.ndarray, tables: np.ndarray, dc_of: np.ndarray, ac_of: np.ndarray, comp_of: np.ndarray) -> None:
    """Decode one code of every live segment at a time; a block's first level stays a difference."""
    raw = np.frombuffer(blob + b"\xff" * 4, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    end = np.cumsum(sizes) * 8
    bit = end - sizes * 8
    limit = end - 32
    per = len(comp_of)
    lanes = len(sizes)
    block, k = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    base = base * 64
    flat = out.reshape(-1)
    table = dc_of[comp_of[block % per]]
    while len(bit):
        entry = tables[table + ((window[bit >> 3] << (bit & 7).astype(np.uint32)) >> 16)]
        n = entry & 255
        if (n > 32).any():  # a code whose amplitude doesn't fit in sixteen bits, or none at all
            for x in np.flatnonzero(n > 32):
                entry[x] = _long_entry(raw, int(bit[x]), int(entry[x]))
            n = entry & 255
        bit += n
        k += entry >> 8 & 255
        last = k - 1
        hit = (last < 64) & (bit <= limit)
        if hit.all():
            flat[base + last] = entry >> 16
        else:
            flat[(base + last)[hit]] = (entry >> 16)[hit]
        done = k >= 64
        if done.any() or not hit.all():
            block += done
            base += 64 * done
            k[done] = 0
            live = (block < n_blocks) & (bit <= limit) & (n > 0)
            if not live.all():
                bit, block, k, base, n_blocks, limit = (x[live] for x in (bit, block, k, base, n_blocks, limit))
            comp = comp_of[block % per] if per > 1 else 0
            table = np.where(k == 0, dc_of[comp], ac_of[comp])
        else:
            table = ac_of[comp_of[block % per]] if per > 1 else ac_of[0]


def _long_entry(raw: np.ndarray, bit: int, entry: int) -> int:
    """The entry of a code with a long amplitude; number 0 for bits that begin no code."""
    n, size, skip = entry & 31, entry >> 16 & 15, entry >> 8 & 255
    if not n:
        return 0
    word = int.from_bytes(raw[bit >> 3 : (bit >> 3) + 5].astype(np.uint8).tobytes().ljust(5, b"\xff"), "big")
    value = word >> (40 - (bit & 7) - n - size) & ((1 << size) - 1)
    if value < 1 << (size - 1):
        value -= (1 << size) - 1
    return value << 16 | skip << 8 | (n + size)


@functools.cache
def _lookup(table: tuple[tuple[int, ...], bytes], dc: bool) -> np.ndarray:
    """For each sixteen bits that may come: level << 16 | step in the block << 8 | number of bits.

    The number is 32 more where the level doesn't fit in the sixteen bits; then its place holds the number of its bits.
    A block's end steps by 64.
    """
    out = np.full(1 << 16, 32, np.int64)
    for symbol, code, n in _codes(list(table[0]), table[1]):
        size = symbol & 15
        step = 1 if dc else 64 if symbol == 0 else (symbol >> 4) + 1
        lo, hi = code << (16 - n), (code + 1) << (16 - n)
        if n + size <= 16:
            value = np.arange(lo, hi) >> (16 - n - size) & ((1 << size) - 1)
            if size:
                value -= (value < 1 << (size - 1)) * ((1 << size) - 1)
            out[lo:hi] = value << 16 | step << 8 | (n + size)
        else:
            out[lo:hi] = size << 16 | step << 8 | 32 | n
    return out


_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)], np.float32)
#: Row-major samples from zigzag levels in one product.
_INVERSE = np.einsum("xu,yv->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def luma_blocks(layout: Layout, levels: np.ndarray) -> np.ndarray:
    """(frame, luma block, 64) samples of the first component."""
    pattern, _, _ = _mcu(layout)
    own = np.flatnonzero(np.array(pattern) == 0)
    n = levels.shape[1] // len(pattern)
    mine = levels.reshape(len(levels), n, len(pattern), 64)[:, :, own].reshape(-1, 64).astype(np.float32) * np.array(layout.quantisers[0], np.float32)
    return np.clip(np.rint(mine @ _INVERSE + 128), 0, 255).astype(np.uint8).reshape(len(levels), -1, 64)


def luma_image(layout: Layout, levels: np.ndarray) -> np.ndarray:
    """(frame, height, width) samples of the first component."""
    pattern, across, down = _mcu(layout)
    h, v = (1, 1) if len(layout.components) == 1 else layout.components[0][1:3]
    s = luma_blocks(layout, levels).reshape(len(levels), down, across, v, h, 8, 8)
    return s.transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(levels), down * v * 8, across * h * 8)[:, : layout.height, : layout.width]


BINS = 16


def histograms(blocks: np.ndarray) -> np.ndarray:
    """(frame, bin) shares of the samples."""
    n = len(blocks)
    flat = blocks.reshape(n, -1)
    at = (flat >> 4) + np.arange(n, dtype=np.int64)[:, None] * BINS
    return np.bincount(at.reshape(-1), minlength=n * BINS).reshape(n, BINS) / flat.shape[1]


def shot_starts(hist: np.ndarray, *, window: int = 8, factor: float = 3.0, least: float = 0.25) -> list[int]:
    """First frames of shots. A cut is where the histogram difference exceeds factor times the mean of the window of
    differences around it, and `least`; of cuts in neighbouring frames the first counts."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    total = np.concatenate(([0.0], np.cumsum(diff)))
    at = np.arange(len(diff))
    lo, hi = np.maximum(at - window, 0), np.minimum(at + window + 1, len(diff))
    mean = (total[hi] - total[lo] - diff) / np.maximum(hi - lo - 1, 1)
    cuts = np.flatnonzero((diff > factor * mean) & (diff >= least)) + 1
    return [0] + [int(c) for k, c in enumerate(cuts) if k == 0 or c != cuts[k - 1] + 1]


def clips(movie: Movie, starts: list[int]) -> list[tuple[int, int, float, float]]:
    """(first frame, end frame, start second, end second)"""
    s = movie.frame_us / 1e6
    return [(a, b, round(a * s, 6), round(b * s, 6)) for a, b in zip(starts, [*starts[1:], len(movie.frames)], strict=True)]


def decode_movies(movies: list[Movie]) -> list[tuple[list[tuple[Layout, np.ndarray]], np.ndarray]]:
    """For each movie, its frames' (layout, levels) and luma histograms; frames of all movies that are alike are decoded together."""
    groups: dict[Layout, list[tuple[int, int, bytes]]] = {}
    heads: dict[bytes, Layout] = {}  # movies repeat a header's bytes in each frame
    for m, movie in enumerate(movies):
        for f, frame in enumerate(movie.frames):
            cut = frame.find(b"\xff\xda")
            head = frame[: cut + 2 + struct.unpack_from(">H", frame, cut + 2)[0]] if 0 <= cut < len(frame) - 4 else frame
            if head in heads:
                layout, scan = heads[head], frame[len(head) : -2 if frame.endswith(b"\xff\xd9") else None]
            else:
                layout, scan = parse_jpeg(frame)
                heads[head] = layout
            groups.setdefault(layout, []).append((m, f, scan))
    frames: list[list] = [[None] * len(m.frames) for m in movies]
    hists = [np.zeros((len(m.frames), BINS)) for m in movies]
    for layout, members in groups.items():
        for lo in range(0, len(members), LANES):
            part = members[lo : lo + LANES]
            levels = decode_levels(layout, [s for _, _, s in part])
            hist = histograms(luma_blocks(layout, levels))
            for k, (m, f, _) in enumerate(part):
                frames[m][f] = (layout, levels[k])
                hists[m][f] = hist[k]
    return list(zip(frames, hists, strict=True))


def read_payload(frames: list[tuple[Layout, np.ndarray]]) -> bytes:
    """What store_payload stored, from decoded levels."""
    return (np.concatenate([x.reshape(-1) for _, x in frames]) + 128).astype(np.uint8).tobytes()


_CLIPS = "media_id long, clip int, first_frame int, end_frame int, start_s double, end_s double, error string"


def clip_rows(media: DataFrame, *, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """One row per clip of each AVI file in a binary column. Files that can't be read give one row with an error and
    no clip; null or empty data gives an error row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    movie = read_avi(data or b"")
                    ((_, hist),) = decode_movies([movie])
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((i, None, None, None, None, None, str(e) or type(e).__name__))
                    continue
                rows += [(i, k, *c, None) for k, c in enumerate(clips(movie, shot_starts(hist)))]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _CLIPS.split(", ")])

    return media.select(media[id_col].cast("long").alias("media_id"), media[data_col].cast("binary").alias("data")).mapInArrow(run, _CLIPS)


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_clips long, clips string"


def media_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an AVI file, the file parsed and decoded again, and what was found in it.

    feature: frames, shots and the mean luma histogram's leading bin; clips: start-end seconds of each clip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, 4_000_000):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            files = store_payload([b + b"\xff" * ((-len(b)) % BLOCK or (0 if b else BLOCK)) for b in raw])
            movies = [read_avi(f) for f in files]
            rows = []
            for i, b, data, movie, (frames, hist) in zip(ids, raw, files, movies, decode_movies(movies), strict=True):
                back = read_payload(frames)
                found = clips(movie, shot_starts(hist))
                feature = f"frames={len(frames)};shots={len(found)};mode={int(hist.mean(0).argmax())}"
                times = ",".join(f"{a:.6f}-{z:.6f}" for _, _, a, z in found)
                rows.append((i, len(b), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames), len(found), times))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if x.endswith("string") else pa.int64()) for c, x in zip(cols, _OUT.split(", "), strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(run, _OUT)
