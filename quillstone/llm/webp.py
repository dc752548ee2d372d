"""Lossless WebP: a decoder to pixel arrays, and an encoder for 8-bit samples.

The stream format is that of the public specification (RFC 9649). Pixels are rows of (red, green, blue, alpha).
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import arrow_limits, utf8

#: Samples of a payload are padded to a positive multiple of BLOCK and stored BLOCK to a row.
BLOCK, PAD = 576, 255
#: Rows of an image at most; longer payloads go to several images one behind the other.
MAX_ROWS = 16384
# Fixed values of the format: the order in which code length code lengths are stored, and the hash of the colour cache.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
#: The first 120 distance codes name near pixels (x to the left, y up), nearest first, vertical ones before.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] * p[0] + p[1] * p[1], abs(p[0]), p[0] < 0)
)
#: Bits that one look-up sees where only green is coded.
WINDOW = 16


class FormatError(ValueError):
    """The bytes are not a lossless WebP image."""


# --- prefix codes ---------------------------------------------------------------------------------------------------


def canonical(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length): codes in order of length, then symbol, read from their highest bit on."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _reversed_bits(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


class Prefix:
    """A prefix code as a table of 2**bits windows; a code with one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.key = lengths.tobytes()
        self.single = int(used[0]) if len(used) == 1 else None
        if self.single is not None:
            return
        if not len(used) or sum(2.0 ** -int(lengths[s]) for s in used) != 1.0:
            raise FormatError("a prefix code is not complete")
        self.bits = int(lengths.max())
        self.symbol = np.zeros(1 << self.bits, dtype=np.int32)
        self.length = np.zeros(1 << self.bits, dtype=np.int32)
        for s, (code, n) in canonical(lengths).items():
            at = _reversed_bits(code, n)
            self.symbol[at :: 1 << n], self.length[at :: 1 << n] = s, n

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        w = bits.peek(self.bits)
        bits.at += int(self.length[w])
        return int(self.symbol[w])


class Bits:
    """Bits of a byte string, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0
        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        at = self.at
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise FormatError("the image ends early")
        value = self.peek(n)
        self.at += n
        return value


def _read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, dtype=np.uint8)
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            if s >= alphabet:
                raise FormatError("a symbol is beyond its alphabet")
            lengths[s] = 1
        return Prefix(lengths)
    of_lengths = np.zeros(19, dtype=np.uint8)
    for i in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = Prefix(of_lengths)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, previous = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, previous = at + 1, s or previous
            continue
        value, extra, least = {16: (previous, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[s]
        times = least + bits.read(extra)
        if at + times > alphabet:
            raise FormatError("code lengths run over")
        lengths[at : at + times] = value
        at += times
    return _shared_prefix(lengths.tobytes())


@functools.lru_cache(maxsize=256)
def _shared_prefix(lengths: bytes) -> Prefix:
    return Prefix(np.frombuffer(lengths, dtype=np.uint8))


@functools.lru_cache(maxsize=16)
def _literal_runs(lengths: bytes) -> tuple[list[bytes], list[int]]:
    """For each window of a green code: the literals that lie in it whole, and their bits (none: the next is no literal)."""
    code = Prefix(np.frombuffer(lengths, dtype=np.uint8))
    size = 1 << WINDOW
    at, runs, open_ = np.zeros(size, dtype=np.int64), [b""] * size, np.ones(size, dtype=bool)
    windows = np.arange(size, dtype=np.int64)
    while open_.any():
        w = (windows >> at) & ((1 << code.bits) - 1)
        symbol, n = code.symbol[w], code.length[w]
        open_ &= (symbol < 256) & (at + n <= WINDOW)
        for i in np.flatnonzero(open_):
            runs[i] += bytes((symbol[i],))
        at = np.where(open_, at + n, at)
    return runs, at.tolist()


# --- decoding -------------------------------------------------------------------------------------------------------


def _value(bits: Bits, prefix: int) -> int:
    """A length or a distance code from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Headers met before: (alphabet of green, bits, value) and the codes that they gave. A header tells its own end, so a
#: stream that goes on with the same bits has the same codes.
_headers: list[tuple[int, int, int, list[Prefix]]] = []
HEADERS = 32
#: How often green codes were met: tables for all windows of a code are made for large images, and from its third image on.
_met: dict[bytes, int] = {}


def _tabled(key: bytes, total: int) -> bool:
    if len(_met) > 1024:
        _met.clear()
    _met[key] = _met.get(key, 0) + 1
    return _met[key] > 2 or total > 1 << 16


def _read_group(bits: Bits, cache_bits: int) -> list[Prefix]:
    alphabet = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    start = bits.at
    ahead = int.from_bytes(bits.data[start >> 3 : (start >> 3) + 512], "little") >> (start & 7)
    for i, (size, n, value, group) in enumerate(_headers):
        if size == alphabet and start + n <= bits.end and ahead & ((1 << n) - 1) == value:
            bits.at += n
            _headers.insert(0, _headers.pop(i))
            return group
    group = [_read_prefix(bits, n) for n in (alphabet, 256, 256, 256, DISTANCE_CODES)]
    if (n := bits.at - start) < 4000:
        _headers.insert(0, (alphabet, n, ahead & ((1 << n) - 1), group))
        del _headers[HEADERS:]
    return group


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An image coded with prefix codes, back-references and a colour cache: pixels as 32-bit ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise FormatError("the colour cache is too large")
    groups_at, shift, across = None, 0, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        groups_at = _entropy_image(bits, across, -(-height >> shift), False) >> np.uint32(8) & np.uint32(0xFFFF)
    groups = [_read_group(bits, cache_bits) for _ in range(1 if groups_at is None else int(groups_at.max()) + 1)]
    total = width * height
    if main and groups_at is None and not cache_bits and all(c.single is not None for c in groups[0][1:4]) and groups[0][0].single is None and _tabled(groups[0][0].key, total):
        return _green_only(bits, groups[0], width, total)
    out, n = np.zeros(total, dtype=np.uint32), 0
    cache = np.zeros(1 << cache_bits, dtype=np.uint32)
    cached = 0  # pixels that the cache has seen

    def keep(until: int) -> None:
        nonlocal cached
        if cache_bits:
            for p in out[cached:until].tolist():
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        cached = until

    while n < total:
        g = groups[0] if groups_at is None else groups[int(groups_at[(n // width >> shift) * across + (n % width >> shift)])]
        s = g[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in g[1:4])
            out[n] = alpha << 24 | red << 16 | s << 8 | blue
            n += 1
        elif s < 256 + LENGTH_CODES:
            length = _value(bits, s - 256)
            back = _distance(_value(bits, g[4].read(bits)), width)
            if back > n or n + length > total:
                raise FormatError("a back-reference leaves the image")
            _copy(out, n, back, length)
            n += length
        else:
            keep(n)
            if s - 256 - LENGTH_CODES >= len(cache):
                raise FormatError("a colour is beyond the cache")
            out[n] = cache[s - 256 - LENGTH_CODES]
            n += 1
        if bits.at > bits.end:
            raise FormatError("the image ends early")
    return out


def _copy(out: np.ndarray, at: int, back: int, length: int) -> None:
    """Copy within ``out``; a source that overlaps its target repeats."""
    source = out[at - back : at]
    out[at : at + length] = source[:length] if back >= length else np.resize(source, length)


def _green_only(bits: Bits, group: list[Prefix], width: int, total: int) -> np.ndarray:
    """The case of grey samples as the last image of the stream: only green is coded. Windows are formed for all bits at
    once, each look-up takes all literals that lie in it, and what padding bits decode to is cut off at the end."""
    green = group[0]
    runs, used = _literal_runs(green.key)
    data = np.frombuffer(bits.data, dtype=np.uint8)[bits.at >> 3 :].astype(np.uint32)
    base, at = bits.at & ~7, bits.at & 7
    three = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    windows = memoryview(((three[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0xFFFF)).astype(np.uint16).reshape(-1))
    out, parts = bytearray(), []
    take = parts.append
    try:
        while True:
            while step := used[w := windows[at]]:
                take(runs[w])
                at += step
            out += b"".join(parts)
            parts.clear()
            if len(out) >= total:
                break
            bits.at = base + at
            s = green.read(bits)
            if s < 256:  # a code longer than the window's rest
                out.append(s)
            else:
                length, n = _value(bits, s - 256), len(out)
                back = _distance(_value(bits, group[4].read(bits)), width)
                if back > n or n + length > total:
                    raise FormatError("a back-reference leaves the image")
                source = bytes(out[n - back : n])
                out += source[:length] if back >= length else (source * (length // back + 1))[:length]
            at = bits.at - base
    except IndexError:  # the end of the data
        out += b"".join(parts)
    if len(out) < total:
        raise FormatError("the image ends early")
    fixed = np.uint32(group[3].single << 24 | group[1].single << 16 | group[2].single)
    return np.frombuffer(bytes(out[:total]), dtype=np.uint8).astype(np.uint32) << np.uint32(8) | fixed


def _channels(argb: np.ndarray) -> np.ndarray:
    """ARGB pixels as (..., 4) bytes in the order alpha, red, green, blue."""
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view(">u4").reshape(channels.shape[:-1]).astype(np.uint32)


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    by_left, by_top = abs(top - corner).sum(), abs(left - corner).sum()
    return left if by_left < by_top else top


def _clamp(x):
    return np.clip(x, 0, 255)


def _half_off(a, corner):
    delta = a - corner
    return _clamp(a + np.sign(delta) * (abs(delta) >> 1))


#: Of the modes the two that the encoder uses.
LEFT, TOP = 1, 2
#: What each mode predicts from the pixels at the left, top, top right and top left.
MODES = (
    lambda le, t, tr, tl: np.array([255, 0, 0, 0]),
    lambda le, t, tr, tl: le,
    lambda le, t, tr, tl: t,
    lambda le, t, tr, tl: tr,
    lambda le, t, tr, tl: tl,
    lambda le, t, tr, tl: _average(_average(le, tr), t),
    lambda le, t, tr, tl: _average(le, tl),
    lambda le, t, tr, tl: _average(le, t),
    lambda le, t, tr, tl: _average(tl, t),
    lambda le, t, tr, tl: _average(t, tr),
    lambda le, t, tr, tl: _average(_average(le, tl), _average(t, tr)),
    lambda le, t, tr, tl: _select(le, t, tl),
    lambda le, t, tr, tl: _clamp(le + t - tl),
    lambda le, t, tr, tl: _half_off(_average(le, t), tl),
)


def predicted(rows: np.ndarray, x: int, y: int, modes: np.ndarray, shift: int) -> np.ndarray:
    """The prediction for a pixel from decoded pixels (height, width, 4): the border has rules of its own."""
    if not y:
        return rows[0, x - 1] if x else np.array([255, 0, 0, 0])
    if not x:
        return rows[y - 1, 0]
    right = rows[y - 1, x + 1] if x + 1 < rows.shape[1] else rows[y, 0]
    return MODES[int(modes[y >> shift, x >> shift])](rows[y, x - 1], rows[y - 1, x], right, rows[y - 1, x - 1])


def _undo_predictor(argb: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    rows = _channels(argb).astype(np.int64)
    if (modes == LEFT).all() or (modes == TOP).all():  # sums along rows or columns, modulo 256
        rows[0, 0] += [255, 0, 0, 0]
        if modes.flat[0] == LEFT:
            rows[:, 0] = rows[:, 0].cumsum(axis=0)
            rows = rows.cumsum(axis=1)
        else:
            rows[0] = rows[0].cumsum(axis=0)
            rows = rows.cumsum(axis=0)
        return _joined((rows & 255).astype(np.uint8))
    for y in range(rows.shape[0]):
        for x in range(rows.shape[1]):
            rows[y, x] = (rows[y, x] + predicted(rows, x, y, modes, shift)) & 255
    return _joined(rows.astype(np.uint8))


def color_shift(channels: np.ndarray, elements: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take off (-1) what green tells of red and blue, and red of blue."""
    c = channels.astype(np.int64)
    height, width = c.shape[:2]
    per_pixel = elements[np.arange(height)[:, None] >> shift, np.arange(width)[None] >> shift].astype(np.int8).astype(np.int64)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    red_to_blue, green_to_blue, green_to_red = per_pixel[..., 1], per_pixel[..., 2], per_pixel[..., 3]
    green, old_red = signed(c[..., 2]), c[..., 1].copy()
    c[..., 1] = (c[..., 1] + sign * (green_to_red * green >> 5)) & 255
    red = signed(c[..., 1] if sign > 0 else old_red)
    c[..., 3] = (c[..., 3] + sign * ((green_to_blue * green >> 5) + (red_to_blue * red >> 5))) & 255
    return c.astype(np.uint8)


def _read_transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """The transforms in stream order and the width of the coded image."""
    found: list[tuple] = []
    while bits.read(1):
        kind = bits.read(2)
        if any(t[0] == kind for t in found):
            raise FormatError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            shift = bits.read(3) + 2
            across, down = -(-width >> shift), -(-height >> shift)
            found.append((kind, _channels(_entropy_image(bits, across, down, False).reshape(down, across)), shift))
        elif kind == SUBTRACT_GREEN:
            found.append((kind,))
        else:
            size = bits.read(8) + 1
            deltas = _channels(_entropy_image(bits, size, 1, False))
            palette = _joined(np.cumsum(deltas, axis=0, dtype=np.uint64).astype(np.uint8))
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            found.append((kind, palette, pack, width))
            width = -(-width >> pack)
    return found, width


def _undo(transform: tuple, argb: np.ndarray) -> np.ndarray:
    kind = transform[0]
    if kind == PREDICTOR:
        return _undo_predictor(argb, transform[1][..., 2], transform[2])
    if kind == CROSS_COLOR:
        return _joined(color_shift(_channels(argb), transform[1], transform[2], 1))
    if kind == SUBTRACT_GREEN:
        green = argb >> np.uint32(8) & np.uint32(0xFF)
        red_blue = ((argb & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)) & np.uint32(0x00FF00FF)
        return argb & np.uint32(0xFF00FF00) | red_blue
    _, palette, pack, width = transform
    index = argb >> np.uint32(8) & np.uint32(0xFF)
    if pack:
        bits = 8 >> pack
        at = np.arange(1 << pack, dtype=np.uint32) * np.uint32(bits)
        index = (index[..., None] >> at & np.uint32((1 << bits) - 1)).reshape(len(argb), -1)[:, :width]
    return np.concatenate([palette, np.zeros(256 - len(palette), dtype=np.uint32)])[index]


def _chunk(data: bytes) -> tuple[bytes, int]:
    """The lossless chunk of the image at the start of ``data``, and the image's size in bytes."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise FormatError("no WebP header")
    end, at = 8 + struct.unpack_from("<I", data, 4)[0], 12
    while at + 8 <= min(end, len(data)):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise FormatError("the image ends early")
            return data[at + 8 : at + 8 + size], end + (end & 1)
        at += 8 + size + (size & 1)
    raise FormatError("no lossless image")


def _decode_argb(data: bytes) -> tuple[np.ndarray, int, bool]:
    stream, size = _chunk(data)
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        raise FormatError("no lossless signature")
    width, height, has_alpha = bits.read(14) + 1, bits.read(14) + 1, bool(bits.read(1))
    if bits.read(3):
        raise FormatError("an unknown version")
    transforms, coded = _read_transforms(bits, width, height)
    argb = _entropy_image(bits, coded, height, True).reshape(height, coded)
    for t in reversed(transforms):
        argb = _undo(t, argb)
    return argb, size, has_alpha


def decode_all(data: bytes) -> Iterator[np.ndarray]:
    """The pixels of each of the lossless WebP files in ``data``, one behind the other."""
    while data:
        argb, size, has_alpha = _decode_argb(data)
        pixels = np.ascontiguousarray(_channels(argb)[..., [1, 2, 3, 0]])
        if not has_alpha:
            pixels[..., 3] = 255
        yield pixels
        data = data[size:]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: an array (height, width, 4) of red, green, blue and alpha."""
    if not data:
        raise FormatError("no WebP header")
    return next(decode_all(data))


def decode_samples(data: bytes) -> bytes:
    """The grey samples of the images in ``data``, one behind the other, row by row, from their pixel arrays."""
    return b"".join(pixels[..., 1].tobytes() for pixels in decode_all(data))


# --- encoding -------------------------------------------------------------------------------------------------------


class Writer:
    """Bits as text, the first bit first."""

    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(format(value, f"0{n}b")[::-1])

    def code(self, code: tuple[int, int]) -> None:
        if code[1]:
            self.parts.append(format(code[0], f"0{code[1]}b"))

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        return int(text[::-1] or "0", 2).to_bytes(-(-len(text) // 8), "little")


def put_prefix(out: Writer, lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """Write a prefix code by its lengths; returns its codes. Up to two symbols below 256 are written by name."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    out.put(0, 1)
    tokens, at, lengths = [], 0, lengths.tolist()
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at] and run < 138:
            run += 1
        if lengths[at] or run < 3:
            tokens.append((lengths[at], 0, 0))
            at += 1
        else:
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            at += run
    # all nineteen token symbols get codes of 4 or 5 bits: thirteen of 4 and six of 5
    token_lengths = np.array([4] * 13 + [5] * 6)
    out.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        out.put(int(token_lengths[s]), 3)
    out.put(0, 1)
    codes = canonical(token_lengths)
    for s, extra, n in tokens:
        out.code(codes[s])
        out.put(extra, n)
    return canonical(np.array(lengths))


def prefix_symbol(value: int) -> tuple[int, int, int]:
    """(symbol, extra, bits of extra) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), v & ((1 << (high - 1)) - 1), high - 1


def balanced_lengths(weights: np.ndarray, longest: int = 15) -> np.ndarray:
    """Code lengths for positive weights, none over ``longest``: Huffman's, with weights flattened until they fit."""
    import heapq

    weights = np.asarray(weights, dtype=np.int64)
    while True:
        heap = [(int(w), i, [i]) for i, w in enumerate(weights) if w > 0]
        lengths = np.zeros(len(weights), dtype=np.uint8)
        heapq.heapify(heap)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[a[2] + b[2]] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if lengths.max() <= longest:
            return lengths
        weights = np.where(weights > 0, weights // 2 + 1, 0)


#: Characters of running text by falling frequency; the presets give those of a preset a weight by their rank.
RANKED = " etaoinshrdlucmfwygpbvkxjqz"
#: Frequent first bytes after the rank list, for each preset: plain text, text with many accents, text with many signs.
EXTRAS = (b",.\n", bytes([0xC3, 0xA9, 0xA8, 0xB3, 0xA1, 0xBC, 0xAD, 0xB1, 0xA4, 0xB6]) + b",.\n", b"#$%&*|!,.\n0123456789")


def _preset(extra: bytes | None) -> np.ndarray:
    weights = np.full(256 + LENGTH_CODES, 4, dtype=np.int64)
    if extra is not None:
        for rank, c in enumerate(RANKED):
            weights[ord(c)] = 60_000 // (rank + 2)
            weights[ord(c.upper())] = max(weights[ord(c.upper())], 1000 // (rank + 2))
        for c in extra:
            weights[c] = max(weights[c], 4000)
    return weights


class Preset:
    """A green code with its header bits, and the bit text of each literal. Red and blue are 0, alpha is ``alpha``; distances
    have the one code of the pixel to the left, or with ``far`` a code for any."""

    def __init__(self, weights: np.ndarray, alpha: int = 255, far: bool = False):
        self.lengths = balanced_lengths(weights, 12)
        out = Writer()
        codes = put_prefix(out, self.lengths)
        for symbol in (0, 0, alpha):
            put_prefix(out, _only(256, symbol))
        nearest = prefix_symbol(1 + NEAR.index((1, 0)))[0]
        self.distance_codes = put_prefix(out, balanced_lengths(np.ones(DISTANCE_CODES)) if far else _only(DISTANCE_CODES, nearest))
        self.header = "".join(out.parts)
        self.literal = [format(codes[s][0], f"0{codes[s][1]}b") if s in codes else "" for s in range(256)]
        self.length_codes = {s: codes[256 + s] for s in range(LENGTH_CODES) if 256 + s in codes}


def _only(size: int, symbol: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.uint8)
    out[symbol] = 1
    return out


@functools.lru_cache(maxsize=8)
def presets(alpha: int = 255, far: bool = False) -> tuple[list[Preset], np.ndarray]:
    """Green codes that images share, so that a decoder builds each table once; and their literal lengths as a matrix."""
    found = [Preset(_preset(e), alpha, far) for e in (None, *EXTRAS)]
    return found, np.array([p.lengths[:256] for p in found], dtype=np.int64)


#: Runs of one sample that become a literal and a back-reference; lines that do if they came before in the image.
RUN = re.compile(rb"(.)\1{15,4095}", re.DOTALL)
LINE = re.compile(rb"[^\n]{24,4095}\n")
#: The farthest back that a reference reaches.
REACH = (1 << 20) - 120


def _container(stream: bytes) -> bytes:
    padded = stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def _start(width: int, height: int, alpha: bool) -> Writer:
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        out.put(value, n)
    return out


def _copies(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, how far back) of samples that repeat: runs, and whole lines that came before."""
    out = [(m.start() + 1, m.end(), 1) for m in RUN.finditer(data)]
    seen: dict[bytes, int] = {}
    lines = []
    for m in LINE.finditer(data):
        at = seen.get(m[0])
        if at is not None and m.start() - at <= REACH:
            lines.append((m.start(), m.end(), m.start() - at))
        seen[m[0]] = m.start()
    if not lines:
        return out
    taken, end = [], 0
    for c in sorted(lines + out, key=lambda c: (c[0], -c[1])):
        if c[0] >= end:
            taken.append(c)
            end = c[1]
    return taken


def _put_samples(bits: Writer, data: bytes, code: Preset, copies: list[tuple[int, int, int]]) -> None:
    """The coded samples: literals, and references for the copies."""
    done, literal = 0, code.literal
    left = 1 + NEAR.index((1, 0))
    for start, end, back in copies:
        bits.parts.extend(map(literal.__getitem__, data[done:start]))
        for codes, value in ((code.length_codes, end - start), (code.distance_codes, left if back == 1 else back + 120)):
            symbol, extra, n = prefix_symbol(value)
            bits.code(codes[symbol])
            bits.put(extra, n)
        done = end
    bits.parts.extend(map(literal.__getitem__, data[done:]))


def _put_constant(bits: Writer, green: int) -> None:
    """A transform's image whose pixels are all of one green: prefix codes of one symbol, and no bit a pixel."""
    bits.put(0, 1)
    for size, symbol in ((256 + LENGTH_CODES, green), (256, 0), (256, 0), (256, 0), (DISTANCE_CODES, 0)):
        put_prefix(bits, _only(size, symbol))


def _put_palette(bits: Writer, values: list[int]) -> None:
    """The palette transform: its colours are greys, each stored as what it adds to the one before."""
    bits.put(1, 1)
    bits.put(PALETTE, 2)
    bits.put(len(values) - 1, 8)
    bits.put(0, 1)
    steps = [values[0], *(b - a for a, b in zip(values, values[1:]))]
    alphas = [255] + [0] * (len(values) - 1)
    codes = []
    for size, found in ((256 + LENGTH_CODES, steps), (256, steps), (256, steps), (256, alphas)):
        codes.append(put_prefix(bits, balanced_lengths(np.bincount(found, minlength=size))))
    put_prefix(bits, _only(DISTANCE_CODES, 0))
    for step, alpha in zip(steps, alphas, strict=True):
        for code, symbol in zip(codes, (step, step, step, alpha), strict=True):
            bits.code(code[symbol])


def _packed(part: bytes, values: list[int]) -> bytes:
    """Samples as indices into at most 16 values, several to a byte."""
    pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    width = 8 >> pack
    index = np.searchsorted(values, np.frombuffer(part, dtype=np.uint8)).astype(np.uint8).reshape(-1, 1 << pack)
    return (index << (np.arange(1 << pack, dtype=np.uint8) * width)).sum(axis=1, dtype=np.uint8).tobytes()


def _residuals(part: bytes, mode: int) -> np.ndarray:
    """What a predictor of the pixel to the left, or of the one above, leaves of the samples."""
    rows = np.frombuffer(part, dtype=np.uint8).reshape(-1, BLOCK)
    out = rows.copy()
    if mode == LEFT:
        out[:, 1:] -= rows[:, :-1]
        out[1:, 0] -= rows[:-1, 0]
    else:
        out[1:] -= rows[:-1]
        out[0, 1:] -= rows[0, :-1]
    return out


def _literal_counts(samples: np.ndarray) -> np.ndarray:
    """How often each sample is a literal: runs do not count, looked for where one value makes up a quarter of all."""
    counts = np.bincount(samples, minlength=256)
    if 4 * counts.max() > len(samples):
        data = samples.tobytes()
        for m in RUN.finditer(data):
            counts[data[m.start()]] -= m.end() - m.start() - 1
    return counts


def _encode_image(part: bytes) -> bytes:
    bits = _start(BLOCK, len(part) // BLOCK, False)
    samples = np.frombuffer(part, dtype=np.uint8)
    values = np.flatnonzero(np.bincount(samples, minlength=256)).tolist()
    if len(values) <= 16:
        _put_palette(bits, values)
        bits.put(0, 3)  # no more transforms, no cache, one group
        data = _packed(part, values)
        weights = np.concatenate([np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256), np.zeros(LENGTH_CODES, dtype=np.int64)])
        copies = [(m.start() + 1, m.end(), 1) for m in RUN.finditer(data)]
        for start, end, _ in copies:
            weights[256 + prefix_symbol(end - start)[0]] += 1
        code = Preset(weights)
        bits.parts.append(code.header)
        _put_samples(bits, data, code, copies)
        return _container(bits.bytes())
    found, matrix = presets()
    sizes = matrix @ _literal_counts(samples)
    best, mode = int(sizes.min()), None
    for m in (LEFT, TOP):
        size = int((matrix @ _literal_counts(_residuals(part, m).reshape(-1))).min()) + 128
        if size < best:
            best, mode = size, m
    data, alpha = part, 255
    if mode is not None:
        bits.put(1, 1)
        bits.put(PREDICTOR, 2)
        bits.put(7, 3)  # tiles of 512 pixels
        _put_constant(bits, mode)
        rest = _residuals(part, mode)
        data, alpha = rest.tobytes(), 0
        sizes = matrix @ _literal_counts(rest.reshape(-1))
    bits.put(1, 1)
    bits.put(SUBTRACT_GREEN, 2)
    bits.put(0, 3)
    copies = _copies(data)
    code = presets(alpha, any(back > 1 for *_, back in copies))[0][int(np.argmin(sizes))]
    bits.parts.append(code.header)
    _put_samples(bits, data, code, copies)
    return _container(bits.bytes())


def encode_samples(payload: bytes) -> bytes:
    """Grey images of BLOCK samples a row for a payload of whole rows, each coded the shorter way.

    Samples of at most 16 values go by a palette, several to a byte. Else green is coded with the preset that is shortest, of
    the samples or of what a predictor leaves of them if that is less; red and blue are green's (subtract green). Runs and
    lines that came before are back-references. A cache and cross-colour do not shorten greys.
    """
    return b"".join(_encode_image(payload[at : at + BLOCK * MAX_ROWS]) for at in range(0, len(payload), BLOCK * MAX_ROWS))


# --- the operator ---------------------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)


def feature(samples: bytes) -> str:
    """Rows, mean, standard deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    p = counts / len(samples)
    mean = float(p @ np.arange(256))
    spread = float(np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean * mean)))
    some = p[p > 0]
    return f"rows={len(samples) // BLOCK};mean={mean:.4f};std={spread:.4f};entropy={float(-(some @ np.log2(some))):.4f}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [utf8(x.as_py()) for x in batch.column(1)]
        media = [encode_samples(padded(x)) for x in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for value in batch.column("media"):
            media = value.as_py()
            if media is None:
                rows.append((None,) * len(names))
                continue
            back = decode_samples(media)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], ["doc_id", "n_bytes", *names])


def store_texts(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (lossless WebP) for each row of a table with doc_id and text.

    A text's UTF-8 bytes, filled up with PAD to whole rows of BLOCK samples, are the samples of a grey image.

    Edge cases: null and empty texts make one row of PAD; texts beyond one image's rows make several images, one behind
    the other; null ids and repeated rows pass through; other columns are ignored; an empty table gives an empty result.
    """
    arrow_limits(df.sparkSession)
    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "text").mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def measure_media(df: DataFrame) -> DataFrame:
    """Decode the images of a table with doc_id, n_bytes and media; digests and features of the samples read back.

    Edge cases: null media have null digests and features; bytes that are no lossless WebP are an error; null ids and repeated
    rows pass through; other columns are ignored; an empty table gives an empty result.
    """
    kind = dict(df.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select("doc_id", "n_bytes", "media").mapInArrow(_measure, schema)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images, errors = [], []
        for value in batch.column("media"):
            try:
                images.append(None if value.as_py() is None else decode(value.as_py()))
                errors.append(None)
            except FormatError as e:
                images.append(None)
                errors.append(str(e))
        shape = lambda i: pa.array([None if x is None else x.shape[i] for x in images], pa.int32())
        data = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, shape(1), shape(0), data, pa.array(errors, pa.string())], [*batch.schema.names, "width", "height", "pixels", "error"]
        )


def decode_pixels(df: DataFrame) -> DataFrame:
    """Adds width, height, pixels (red, green, blue, alpha bytes, row by row) and error to a table with a media column.

    Edge cases: null media give nulls; bytes that are not a lossless WebP give nulls and the reason in ``error``; columns
    named like a result are replaced, others pass through.
    """
    arrow_limits(df.sparkSession)
    df = df.drop("width", "height", "pixels", "error")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(_pixels, f"{fields}, width int, height int, pixels binary, error string")
