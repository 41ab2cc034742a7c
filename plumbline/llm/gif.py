"""GIF files in memory: encoding of 8-bit rows, and decoding of any GIF87a/89a stream."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
_LAST_CODE = 4096


def _widths(start: int, n: int) -> np.ndarray:
    """Bits of the 0th to (n-1)th code after a clear code, where `start` is the first free table entry."""
    return np.clip(np.floor(np.log2(np.maximum(start - 1 + np.arange(n), 1))).astype(np.int64) + 1, start.bit_length() if start & (start - 1) else start.bit_length() - 1, 12)


_WIDTHS_8 = _widths(258, _LAST_CODE)


def lzw_encode(data: bytes) -> bytes:
    """The LZW stream (8-bit symbols) with a clear code at the start and whenever the table is full."""
    codes, ends = [], []
    emit, symbols = codes.append, iter(data)
    held = next(symbols, None)
    while held is not None:
        table, free = {}, 258
        known = table.get
        for b in symbols:
            key = held << 8 | b
            longer = known(key)
            if longer is None:
                emit(held)
                table[key] = free
                held = b
                free += 1
                if free == _LAST_CODE:
                    break
            else:
                held = longer
        else:
            emit(held)
            held = None
        ends.append(len(codes))
    code = np.empty(len(codes) + len(ends) + 1, dtype=np.int64)
    width = np.empty(len(code), dtype=np.int64)
    code[0], width[0] = 256, 9
    if not ends:
        code, width = np.array([256, 257]), np.array([9, 9])
    start, to = 0, 1
    for end in ends:
        n = end - start
        code[to : to + n] = codes[start:end]
        code[to + n] = 256
        width[to : to + n + 1] = _WIDTHS_8[: n + 1]
        start, to = end, to + n + 1
    code[-1] = 257
    at = np.cumsum(width) - width
    size = int(at[-1] + width[-1] + 7) // 8
    spread, byte = code << (at & 7), at >> 3
    # bits of different codes never meet, so sums are unions
    out = np.bincount(byte, spread & 255, size + 2) + np.bincount(byte + 1, spread >> 8 & 255, size + 2) + np.bincount(byte + 2, spread >> 16, size + 2)
    return out[:size].astype(np.uint8).tobytes()


def _segment(codes: np.ndarray, clear: int) -> np.ndarray:
    """The symbols of the codes between two clear codes.

    The entry that a code names is an earlier code's string and the symbol after
    it, which is what stands in the output from that string's place on. So an
    output symbol is a copy of an earlier one or a literal, and chains of copies
    are followed by doubling.
    """
    n = len(codes)
    entry = codes - (clear + 2)
    literal = codes < clear
    if (entry >= np.arange(n)).any() or ((codes >= clear) & (codes < clear + 2)).any():
        raise ValueError("a code names an entry that is not made yet")
    if literal.all():
        return codes.astype(np.uint8)
    up = np.where(literal, n, entry)
    up = np.append(up, n)
    length = np.append(np.ones(n, dtype=np.int64), 0)
    while (up < n).any():
        length = length + length[up]
        up = up[up]
    length = length[:n]
    place = np.cumsum(length) - length
    source = np.where(literal, place, place[np.where(literal, 0, entry)])
    total = int(place[-1] + length[-1])
    of = np.arange(total) + np.repeat(source - place, length)
    # a last symbol leads to the first of the next string, so a chain has at most twice as many steps as the longest string symbols
    for _ in range(int(length.max()).bit_length() + 1):
        of = of[of]
    first = np.zeros(total, dtype=np.uint8)
    first[place[literal]] = codes[literal]
    return first[of]


def lzw_decode(data: bytes, code_size: int, most: int) -> np.ndarray:
    """Up to `most` symbols of an LZW stream of symbols of code_size bits. A stream that breaks off gives what it has."""
    clear = 1 << code_size
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    bits, at, out, got = len(data) * 8, 0, [], 0
    ahead = 4100 - clear
    while at < bits and got < most:
        n = min(ahead, (bits - at) // (code_size + 1) + 1)
        while True:
            width = _WIDTHS_8[:n] if code_size == 8 and n <= len(_WIDTHS_8) else _widths(clear + 2, n)
            begin = at + np.cumsum(width) - width
            whole = begin + width <= bits
            width, begin = width[whole], begin[whole]
            byte = begin >> 3
            codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7) & ((1 << width) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or len(codes) < n:
                break
            n *= 2
        k = int(stop[0]) if len(stop) else len(codes)
        if k:
            part = _segment(codes[:k], clear)
            out.append(part)
            got += len(part)
        if not len(stop) or codes[k] == clear + 1:
            break
        at = int(begin[k] + width[k])
    return np.concatenate(out)[:most] if out else np.empty(0, dtype=np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indexes: np.ndarray
    palette: np.ndarray
    delay_ms: int = 0
    disposal: int = 0
    transparent: int = -1


@dataclass
class Gif:
    width: int
    height: int
    background: int = 0
    palette: np.ndarray | None = None
    frames: list[Frame] = field(default_factory=list)


def _blocks(data: bytes) -> bytes:
    return b"".join([bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]) + b"\0"


def encode_rows(samples: bytes, width: int, frame_rows: int, delay_ms: int) -> bytes:
    """A grey GIF of full rows of 8-bit samples, in frames of at most frame_rows rows one after another in time."""
    step = width * frame_rows
    height = min(frame_rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREYS.tobytes()]
    for at in range(0, len(samples), step):
        part = samples[at : at + step]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, delay_ms // 10, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Gif:
    """All frames of a GIF; a file that breaks off gives the frames before."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, gif = 13, Gif(width, height, background)

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        at += 3 * n
        return np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at - 3 * n).reshape(n, 3)

    def blocks() -> bytes:
        nonlocal at
        out = []
        while at < len(data) and data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        return b"".join(out)

    gif.palette = palette(flags)
    delay, disposal, transparent = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                bits, time, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = time * 10, bits >> 2 & 7, index if bits & 1 else -1
        elif kind == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at)
            at += 9
            local = palette(own)
            code_size = data[at]
            at += 1
            pixels = lzw_decode(blocks(), code_size, w * h)
            if len(pixels) < w * h:
                pixels = np.concatenate([pixels, np.zeros(w * h - len(pixels), dtype=np.uint8)])
            pixels = pixels.reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(pixels)
                straight[order] = pixels
                pixels = straight
            use = local if local is not None else gif.palette if gif.palette is not None else GREYS
            gif.frames.append(Frame(left, top, w, h, pixels, use, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, -1
        else:
            raise ValueError("an unknown block")
    return gif


def canvases(gif: Gif):
    """What is seen while each frame is shown, as RGBA; frames are drawn and disposed of one after another."""
    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        pixels = f.indexes[: area.shape[0], : area.shape[1]]
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        if f.transparent >= 0:
            drawn = pixels != f.transparent
            area[drawn] = colours[pixels[drawn]]
        else:
            area[...] = colours[pixels]
        yield canvas.copy()
        if f.disposal == 2:
            area[...] = 0
        elif f.disposal == 3:
            canvas = before
