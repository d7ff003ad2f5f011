"""Lossless WebP: a decoder to pixel arrays, and a writer.

The decoder reads simple and extended RIFF files with a VP8L chunk and follows
the public bitstream specification: prefix codes (simple and normal, with meta
prefix images), back-references with the two-dimensional short distances,
the colour cache, and the predictor, cross-colour, subtract-green and palette
transforms, inverted in reverse order. The symbols of a stream depend on one
another and are read one by one, a pixel's four codes from one buffer of bits;
tables and transforms are arrays wherever a pixel does not need the one to its
left.

The writer gives images a palette where that takes fewer bits, with several
pixels in one where colours are few, and others a predictor by blocks and a
cross-colour transform, which leaves nothing of the red and blue of grays. What
is left is written with back-references, a colour cache where it is hit, and
prefix codes made from the counts of the symbols. Equal pixels give equal files.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MAX_SIDE = 1 << 14
_GREEN, _LITERALS, _DISTANCES = 0, 256, 40
# The order in which the lengths of the code length code are stored.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _short_distances() -> list[tuple[int, int]]:
    """The 120 short distance codes as (dx to the left, dy upwards)."""
    # The distance map of the specification, dy as the high hexadecimal digit, 8 - dx as the low one.
    codes = (
        "18 07 17 19 28 06 27 29 16 1a 26 2a 38 05 37 39 15 1b 36 3a 25 2b 48 04 47 49 14 1c 35 3b 46 4a 24 2c 58 45 4b 34 3c 03 57 59 13 1d 56 5a 23 2d 44 4c 55 5b 33 3d 68 02 67 69 12 1e 66 6a 22 2e 54 5c 43 4d 65 6b 32 3e 78 01 77 79 53 5d 11 1f 64 6c 42 4e 76 7a 21 2f 75 7b 31 3f 63 6d 52 5e 00 74 7c 41 4f 10 20 62 6e 30 73 7d 51 5f 40 72 7e 61 6f 50 71 7f 60 70"
    )
    out = [(8 - int(c[1], 16), int(c[0], 16)) for c in codes.split()]
    return out


class WebpError(ValueError):
    """The bytes are no lossless WebP image that the specification allows."""


class _Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.size:
            raise WebpError("the stream ends early")
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + ((n + 14) >> 3) + 1], "little")
        out = (word >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out


@lru_cache(maxsize=16)
def _reversal(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class _Code:
    """A canonical prefix code as a table over its longest length; an entry is the symbol times 16 plus its length."""

    def __init__(self, lengths: list[int]) -> None:
        sizes = np.asarray(lengths, np.int64)
        used = np.flatnonzero(sizes)
        if not len(used):
            raise WebpError("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            self.longest, self._table = 0, [self.only << 4]
            self.array = np.array(self._table, np.int32)
            return
        used = used[np.argsort(sizes[used], kind="stable")]
        self.longest = int(sizes[used[-1]])
        span = np.int64(1) << (self.longest - sizes[used])
        if int(span.sum()) != 1 << self.longest:
            raise WebpError("a prefix code that is not complete")
        self.array = np.repeat(((used << 4) | sizes[used]).astype(np.int32), span)[_reversal(self.longest)]
        self._table: list[int] | None = None

    @property
    def table(self) -> list[int]:
        if self._table is None:
            self._table = self.array.tolist()
        return self._table


@lru_cache(maxsize=256)
def _code(lengths: tuple[int, ...]) -> _Code:
    return _Code(list(lengths))


@lru_cache(maxsize=1024)
def _simple(alphabet: int, first: int, second: int) -> _Code:
    """A code of one or two symbols."""
    if max(first, second) >= alphabet:
        raise WebpError("a symbol outside its alphabet")
    return _Code([int(s in (first, second)) for s in range(alphabet)])


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    # the head of a code has at most 78 bits
    first = bits.at >> 3
    head = int.from_bytes(bits.data[first : first + 11], "little") >> (bits.at & 7)
    if head & 1:
        two, wide = head >> 1 & 1, head >> 2 & 1
        used = 11 if wide else 4
        symbol = head >> 3 & (255 if wide else 1)
        bits.at += used + 8 * two
        if bits.at > bits.size:
            raise WebpError("the stream ends early")
        return _simple(alphabet, symbol, head >> used & 255 if two else symbol)
    lengths = [0] * alphabet
    count = 4 + (head >> 1 & 15)
    if count > len(_LENGTH_ORDER):
        raise WebpError("too many code lengths")
    of_lengths = [0] * 19
    for i in range(count):
        of_lengths[_LENGTH_ORDER[i]] = head >> (5 + 3 * i) & 7
    code = _code(tuple(of_lengths))
    bits.at += 5 + 3 * count
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    # a symbol takes at most 7 bits and 7 more
    table, mask, first = code.table, (1 << code.longest) - 1, bits.at >> 3
    acc, used = int.from_bytes(bits.data[first : first + 2 * alphabet + 8], "little") >> (bits.at & 7), 0
    while at < alphabet and left:
        left -= 1
        e = table[acc & mask]
        n, s = e & 15, e >> 4
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            times = least + ((acc >> n) & ((1 << extra) - 1))
            n += extra
            if at + times > alphabet:
                raise WebpError("code lengths run over their alphabet")
            if s == 16:
                lengths[at : at + times] = [last] * times
            at += times
        acc >>= n
        used += n
    bits.at += used
    if bits.at > bits.size:
        raise WebpError("the stream ends early")
    return _code(tuple(lengths))


def _image(bits: _Bits, width: int, height: int, outermost: bool) -> np.ndarray:
    """The entropy-coded image: ARGB as uint32, (height, width)."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise WebpError("a colour cache of a size that is not allowed")
    groups, block, meta = 1, 0, None
    if outermost and bits.read(1):
        block = bits.read(3) + 2
        meta = (_image(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (_LITERALS + 24 + cache_size, 256, 256, 256, _DISTANCES)] for _ in range(groups)]
    total = width * height
    first = codes[0]
    if groups == 1 and all(c.only is not None for c in first[:4]) and first[0].only < 256:
        g, r, b, a = (c.only for c in first[:4])
        return np.full((height, width), (a << 24) | (r << 16) | (g << 8) | b, np.uint32)
    if groups == 1:
        return _one_group(bits, first, cache_bits, width, total).reshape(height, width)
    tables = [[c.table for c in own] + [(1 << c.longest) - 1 for c in own] for own in codes]
    group_of = meta.tolist()
    out: list[int] = []
    cache, pending = [0] * cache_size, 0
    near = _near(width)
    data, at, pos = bits.data, 0, bits.at >> 3
    have = 64 - (bits.at & 7)
    acc = int.from_bytes(data[pos : pos + 8], "little") >> (bits.at & 7)
    pos += 8
    take = int.from_bytes
    while at < total:
        # a pixel takes at most 60 bits, a reference 58
        if have < 60:
            acc |= take(data[pos : pos + 8], "little") << have
            have += 64
            pos += 8
        green, red, blue, alpha, far, green_mask, red_mask, blue_mask, alpha_mask, far_mask = tables[group_of[(at // width) >> block][(at % width) >> block]]
        e = green[acc & green_mask]
        n = e & 15
        acc >>= n
        used = n
        s = e >> 4
        if s < 256:
            e = red[acc & red_mask]
            n = e & 15
            acc >>= n
            used += n
            f = blue[acc & blue_mask]
            n = f & 15
            acc >>= n
            used += n
            h = alpha[acc & alpha_mask]
            n = h & 15
            acc >>= n
            have -= used + n
            out.append((h >> 4) << 24 | (e >> 4) << 16 | s << 8 | f >> 4)
            at += 1
        elif s < 280:
            length = s - 255
            if length > 4:
                extra = (length - 3) >> 1
                length = ((2 + ((length - 1) & 1)) << extra) + (acc & ((1 << extra) - 1)) + 1
                acc >>= extra
                used += extra
            e = far[acc & far_mask]
            n = e & 15
            acc >>= n
            used += n
            code = (e >> 4) + 1
            if code > 4:
                extra = (code - 3) >> 1
                code = ((2 + ((code - 1) & 1)) << extra) + (acc & ((1 << extra) - 1)) + 1
                acc >>= extra
                used += extra
            have -= used
            distance = code - 120 if code > 120 else near[code - 1]
            if distance > at or at + length > total:
                raise WebpError("a back-reference outside the image")
            copied = out[at - distance : at - distance + length]
            if distance < length:
                copied = (copied * (length // distance + 1))[:length]
            out += copied
            at += length
        else:
            have -= used
            for colour in out[pending:]:
                cache[((colour * 0x1E35A7BD) & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
            pending = at
            out.append(cache[s - 280])
            at += 1
    bits.at = 8 * pos - have
    if bits.at > bits.size:
        raise WebpError("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


#: Bits of a stream that are looked up at once.
_CHUNK_BITS = 1 << 17


def _one_group(bits: _Bits, codes: list[_Code], cache_bits: int, width: int, total: int) -> np.ndarray:
    """The pixels of an image with one group of codes.

    What would begin at each bit is looked up for all bits of a chunk at once,
    with the place behind it; then only the chain of places that are reached is
    followed one by one.
    """
    out = np.zeros(total, np.uint32)
    tables = [c.array for c in codes]
    near = np.array(_near(width), np.int64)
    done, others = 0, []
    while done < total:
        base = bits.at & ~7
        size = min(_CHUNK_BITS, max(8, bits.size - base))
        raw = np.zeros((size + 7) // 8 + 16, np.uint32)
        have = np.frombuffer(bits.data, np.uint8, min(len(raw), len(bits.data) - (base >> 3)), base >> 3)
        raw[: len(have)] = have
        word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        # the bits from each place on, 25 of them at least
        ahead = (word[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1).view(np.int32)
        place = np.arange(size, dtype=np.int32)
        found, behind = [], place
        for table in tables[:4]:
            if len(table) == 1 and found:
                found.append(table[:1])  # a single symbol takes no bits
                continue
            e = table.take((ahead.take(behind) if found else ahead[:size]) & np.int32(len(table) - 1))
            found.append(e)
            behind = behind + (e & 15)
        symbol = found[0] >> 4
        other = np.flatnonzero(symbol >= _LITERALS)
        if len(other):
            at = other + (found[0][other] & 15)
            ref = symbol[other] < _LITERALS + 24
            length, n = _numbers(np.where(ref, symbol[other] - _LITERALS, 0), ahead[at])
            at = at + n
            e = tables[4][ahead[at] & (len(tables[4]) - 1)]
            at = at + (e & 15)
            code, n = _numbers(e >> 4, ahead[at])
            distance = np.where(code > 120, code - 120, near[np.minimum(code, 120) - 1])
            behind[other] = np.where(ref, at + n, other + (found[0][other] & 15))
        # the chain is followed eight places at a time; places behind the chunk stay where they are
        one = np.arange(size + 64)
        one[:size] = behind
        two = one.take(one)
        four = two.take(two)
        eight = memoryview(four.take(four))
        chain, p = [], bits.at - base
        for _ in range((total - done + 7) // 8):
            chain.append(p)
            p = eight[p]
            if p >= size:
                break
        steps = np.array(chain)
        steps = np.stack([steps, two[steps]], axis=1)
        steps = np.stack([steps, four[steps]], axis=1)
        steps = steps.reshape(-1)[:, None]
        reached = np.concatenate([steps, one[steps]], axis=1).reshape(-1)
        reached = reached[: np.searchsorted(reached, size)]
        bits.at = base + int(one[reached[-1]])
        symbol = symbol[reached]
        plain = symbol < _LITERALS
        spans, back = np.ones(len(reached), np.int64), np.zeros(len(reached), np.int64)
        if len(other):
            row = np.searchsorted(other, reached[~plain])
            ref = symbol[~plain] < _LITERALS + 24
            spans[~plain] = np.where(ref, length[row], 1)
            back[~plain] = np.where(ref, distance[row], _LITERALS + 23 - symbol[~plain])  # cache entry k is -1 - k
        begin = done + np.cumsum(spans) - spans
        inside = begin < total
        if not inside.all():
            bits.at = base + int(reached[inside.argmin()])
            reached, symbol, plain, spans, back, begin = (x[inside] for x in (reached, symbol, plain, spans, back, begin))
        done = int(begin[-1] + spans[-1])
        if done > total or (back > begin).any():
            raise WebpError("a back-reference outside the image")
        own = reached[plain]
        red, blue, alpha = (e[own] >> 4 if len(e) > 1 else e >> 4 for e in found[1:])
        out[begin[plain]] = (alpha << 24 | red << 16 | symbol[plain] << 8 | blue).view(np.uint32)
        others.append((begin[~plain], spans[~plain], back[~plain]))
        if done < total and bits.at >= bits.size:
            raise WebpError("the stream ends early")
    if bits.at > bits.size:
        raise WebpError("the stream ends early")
    begin, spans, back = (np.concatenate(x) for x in zip(*others))
    if (back < 0).any():
        _with_cache(out, begin.tolist(), spans.tolist(), back.tolist(), cache_bits)
    elif len(begin):
        # each pixel's source, until all sources are pixels of their own
        source = np.arange(total)
        at = np.repeat(begin - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
        source[at] -= np.repeat(back, spans)
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
        out = out[source]
    return out


def _with_cache(out: np.ndarray, begin: list[int], spans: list[int], back: list[int], cache_bits: int) -> None:
    """Fills in references and cache entries, one after the other."""
    cache, pending = np.zeros(1 << cache_bits, np.uint32), 0
    for a, k, d in zip(begin, spans, back):
        if d >= k:
            out[a : a + k] = out[a - d : a - d + k]
        elif d > 0:
            out[a : a + k] = np.resize(out[a - d : a], k)
        else:
            # of the pixels of one slot the last stays
            colours = out[pending:a]
            cache[(colours * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)] = colours
            pending = a
            out[a] = cache[-1 - d]


def _numbers(prefix: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefixes, and how many further bits they take."""
    extra = np.maximum(prefix - 2, 0) >> 1
    more = ahead & ((np.int64(1) << extra) - 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)).astype(np.int64) << extra) + more + 1), np.where(prefix < 4, 0, extra)


@lru_cache(maxsize=64)
def _near(width: int) -> list[int]:
    """The distances of the short distance codes in an image of this width."""
    return [max(1, dx + dy * width) for dx, dy in _short_distances()]


def _channels(argb: np.ndarray) -> np.ndarray:
    """(height, width, 4) of alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return (c[..., 0] << np.uint32(24)) | (c[..., 1] << np.uint32(16)) | (c[..., 2] << np.uint32(8)) | c[..., 3]


_BLACK = np.array([255, 0, 0, 0])
#: Modes that need no pixel to the left.
_UPWARD = {0, 2, 3, 4, 8, 9, 14, 15}


def _unpredict(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Adds the predictions back, a row of a block at a time; where modes need the pixel to the left, pixel by pixel."""
    height, width = argb.shape
    if not (modes & 15).any():
        # alpha is the highest byte, so that nothing is carried from it
        out = argb + np.uint32(0xFF000000)
        for edge, own in ((out[0], argb[0]), (out[:, 0], argb[:, 0])):
            steps = np.ascontiguousarray(own).view(np.uint8).reshape(-1, 4).copy()
            steps[0, 3] = (int(steps[0, 3]) + 255) & 255  # that of black
            edge[:] = np.cumsum(steps, axis=0, dtype=np.uint8).view(np.uint32)[:, 0]
        return out
    res = _channels(argb)
    out = np.zeros_like(res)
    out[0, 0] = (res[0, 0] + _BLACK) & 255
    out[0, 1:] = (np.cumsum(res[0, 1:], axis=0) + out[0, 0]) & 255
    mean = lambda a, b: (a + b) >> 1
    for y in range(1, height):
        row = (modes[y >> block] & 15).tolist()
        top = out[y - 1]
        out[y, 0] = (res[y, 0] + top[0]) & 255
        right = np.concatenate([top[1:], out[y, :1]])  # the last pixel's top right is the row's first
        for k, mode in enumerate(row):
            a, b = max(1, k << block), min(width, (k + 1) << block)
            if a >= b:
                continue
            t, tr, tl = top[a:b], right[a:b], top[a - 1 : b - 1]
            if mode in _UPWARD:
                p = t if mode == 2 else tr if mode == 3 else tl if mode == 4 else mean(tl, t) if mode == 8 else mean(t, tr) if mode == 9 else _BLACK
                out[y, a:b] = (res[y, a:b] + p) & 255
            elif mode == 1:
                out[y, a:b] = (np.cumsum(res[y, a:b], axis=0) + out[y, a - 1]) & 255
            else:
                out[y, a:b] = _leftward(mode, res[y, a:b].tolist(), out[y, a - 1].tolist(), t.tolist(), tr.tolist(), tl.tolist())
    return _joined(out)


def _leftward(mode: int, res: list, left: list, tops: list, rights: list, corners: list) -> list:
    """The pixels of a row whose predictions need the pixel to the left."""
    out = []
    for x, t, tr, tl in zip(res, tops, rights, corners):
        if mode == 11:
            # the sums over channels decide for the whole pixel
            to_left = sum(abs(b - c) for b, c in zip(t, tl))
            to_top = sum(abs(a - c) for a, c in zip(left, tl))
            p = left if to_left < to_top else t
        elif mode == 5:
            p = [(((a + c) >> 1) + b) >> 1 for a, b, c in zip(left, t, tr)]
        elif mode == 6:
            p = [(a + c) >> 1 for a, c in zip(left, tl)]
        elif mode == 7:
            p = [(a + b) >> 1 for a, b in zip(left, t)]
        elif mode == 10:
            p = [(((a + d) >> 1) + ((b + c) >> 1)) >> 1 for a, b, c, d in zip(left, t, tr, tl)]
        elif mode == 12:
            p = [min(255, max(0, a + b - d)) for a, b, d in zip(left, t, tl)]
        else:
            p = []
            for a, b, d in zip(left, t, tl):
                half = (a + b) >> 1
                step = half - d
                p.append(min(255, max(0, half + (abs(step) // 2) * (1 if step > 0 else -1))))
        left = [(v + q) & 255 for v, q in zip(x, p)]
        out.append(left)
    return out


def _uncross(argb: np.ndarray, elements: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    if not (elements & np.uint32(0xFFFFFF)).any():
        return argb
    own = elements if elements.size == 1 else np.repeat(np.repeat(elements, 1 << block, axis=0), 1 << block, axis=1)[:height, :width]
    signed = lambda v: v.astype(np.int8).astype(np.int32)
    red_to_blue, green_to_blue, green_to_red = signed(own >> 16 & 255), signed(own >> 8 & 255), signed(own & 255)
    out = np.array(argb, "<u4")
    blue, green, red = (out.view(np.uint8).reshape(height, width, 4)[..., k] for k in range(3))
    for target, multiplier, source in ((red, green_to_red, green), (blue, green_to_blue, green), (blue, red_to_blue, red)):
        if (multiplier == 32).all():
            target += source  # 32 times a signed byte, less five bits, is that byte
        elif multiplier.any():
            target += ((multiplier * signed(source)) >> 5).astype(np.uint8)
    return out


def _pixels_in_one(colours: int) -> int:
    """How many pixels one of a palette image holds, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    n = len(colours)
    pack = _pixels_in_one(n)
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if pack:
        each, wide = 8 >> pack, 1 << pack
        shifts = np.arange(wide, dtype=np.uint32) * np.uint32(each)
        index = ((index[..., None] >> shifts) & np.uint32((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[:n] = colours
    return table[index]


def _chunk(data: bytes) -> bytes:
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise WebpError("the file ends early")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebpError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """The pixels as uint8 (height, width, 4) in the order red, green, blue, alpha, or (height, width) where all are opaque grays."""
    bits = _Bits(_chunk(data))
    if bits.read(8) != 0x2F:
        raise WebpError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("an unknown version")
    undo, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            side = _image(bits, -(-coded >> block), -(-height >> block), False)
            undo.append((lambda x, s=side, b=block: _unpredict(x, (s >> 8) & 15, b)) if kind == 0 else (lambda x, s=side, b=block: _uncross(x, s, b)))
        elif kind == 2:
            def add_green(x: np.ndarray) -> np.ndarray:
                c = _channels(x)
                c[..., 1] = (c[..., 1] + c[..., 2]) & 255
                c[..., 3] = (c[..., 3] + c[..., 2]) & 255
                return _joined(c)

            undo.append(add_green)
        else:
            n = bits.read(8) + 1
            steps = _channels(_image(bits, n, 1, False))[0]
            colours = _joined(np.cumsum(steps, axis=0) & 255)
            undo.append(lambda x, c=colours, w=coded: _unpalette(x, c, w))
            coded = -(-coded >> _pixels_in_one(n))
    pixels = _image(bits, coded, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    parts = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(height, width, 4)
    gray = parts[..., 0]
    if (pixels == gray.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)).all():
        return np.ascontiguousarray(gray)
    return parts[..., [2, 1, 0, 3]]


@dataclass
class BitWriter:
    """Least significant bit first."""

    value: int = 0
    size: int = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


def put_flat_code(bits: BitWriter) -> None:
    """A code of 8 bits for each of the first 256 symbols: one length of 8, then repetitions of it."""
    bits.put(0, 1)
    own = {8: 1, 16: 1}
    count = max(i for i, s in enumerate(_LENGTH_ORDER) if s in own) + 1
    bits.put(count - 4, 4)
    for s in _LENGTH_ORDER[:count]:
        bits.put(own.get(s, 0), 3)
    bits.put(1, 1)  # so many code length symbols: 1 + 42 * 6 + 3 = 256
    bits.put(2, 3)
    bits.put(44 - 2, 6)
    bits.put(0, 1)
    for times in [6] * 42 + [3]:
        bits.put(1, 1)
        bits.put(times - 3, 2)


def put_single_code(bits: BitWriter, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    bits.put(1, 1)
    bits.put(0, 1)
    bits.put(1, 1)
    bits.put(symbol, 8)


def riff(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def header(bits: BitWriter, width: int, height: int, alpha: bool = True) -> None:
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(int(alpha), 1)
    bits.put(0, 3)


class _Stream:
    """Numbers of up to 60 bits each, packed at once, the least significant bit first."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []
        self.parts.append((values, sizes))

    def bytes(self) -> bytes:
        self.put_all(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        values, sizes = np.concatenate([v for v, _ in self.parts]), np.concatenate([n for _, n in self.parts])
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros((total >> 6) + 2, np.uint64)
        begin = ends - sizes
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        firsts = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
        words[word[firsts]] = np.bitwise_or.reduceat(values << shift, firsts)
        over = np.flatnonzero((begin & 63) + sizes > 64)  # one a word at most
        words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return words.tobytes()[: -(-total // 8)]


def _code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a complete prefix code for these counts, none longer than the limit.

    A symbol's length is its information, rounded up; the room that this leaves
    goes to the symbols that were rounded up the most.
    """
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    own = counts[used]
    exact = math.log2(int(own.sum())) - np.log2(own)
    sizes = np.minimum(np.maximum(np.ceil(exact - 1e-9), 1), limit).astype(np.int64)
    order = np.argsort(exact - sizes, kind="stable").tolist()
    size = sizes.tolist()
    room = (1 << limit) - sum(1 << (limit - n) for n in size)
    while room < 0:
        # lengths were cut to the limit: the rarest of the shorter codes grow
        at = max((n, -own[i], i) for i, n in enumerate(size) if n < limit)[2]
        room += 1 << (limit - size[at] - 1)
        size[at] += 1
    while room:
        for i in order:
            take = 1 << (limit - size[i])
            if take <= room and size[i] > 1:
                room -= take
                size[i] -= 1
                if not room:
                    break
    out[used] = size
    return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes as they stand in the stream; a single symbol takes no bits."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[used]
    longest = int(sizes[-1])
    span = np.int64(1) << (longest - sizes)
    out[used] = _reversal(longest)[np.cumsum(span) - span]
    return out


@lru_cache(maxsize=1024)
def _simple_tokens(used: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([1 | (len(used) - 1) << 1 | 1 << 2, *used], np.uint64), np.array([3, *[8] * len(used)], np.int64)


def _code_tokens(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the numbers that a prefix code is told by."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        return _simple_tokens(tuple(used.tolist()) or (0,))
    # before each length a run of zeros: one or two as they are, up to 10 and up to 138 as one symbol, longer ones in parts
    gaps = used - 1
    gaps[1:] -= used[:-1]
    gaps[0] += 1
    whole = np.maximum(gaps - 1, 0) // 138
    rest = gaps - 138 * whole
    few = np.where(rest < 3, rest, 1)
    each = whole + few + 1
    total = int(each.sum())
    ends = np.cumsum(each)
    begin = ends - each
    within = np.arange(total) - np.repeat(begin, each)
    symbol, value, extra = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    wide = within < np.repeat(whole, each)
    symbol[wide], value[wide], extra[wide] = 18, 127, 7
    run = np.flatnonzero(rest >= 3)
    at = begin[run] + whole[run]
    long = rest[run] > 10
    symbol[at], value[at], extra[at] = np.where(long, 18, 17), rest[run] - np.where(long, 11, 3), np.where(long, 7, 3)
    symbol[ends - 1] = lengths[used]
    sizes = _code_lengths(np.bincount(symbol, minlength=19), 7)
    count = max(4, max(i for i, s in enumerate(_LENGTH_ORDER) if sizes[s]) + 1)
    # as many symbols as there are; what follows them has no code
    bits = max(1, -(-max(1, (total - 2).bit_length()) // 2))
    head = [0, count - 4, *sizes[list(_LENGTH_ORDER[:count])].tolist(), 1 | (bits - 1) << 1, total - 2]
    own = sizes if np.count_nonzero(sizes) > 1 else np.zeros_like(sizes)
    return np.concatenate([np.array(head, np.uint64), _codes(sizes)[symbol] | value.astype(np.uint64) << own[symbol].astype(np.uint64)]), np.concatenate([[1, 4], np.full(count, 3), [4, 2 * bits], own[symbol] + extra])


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, their value) of lengths and distance codes, from 1."""
    v = value - 1
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 1)
    second = (v >> (high - 1)) & 1
    small = v < 4
    extra = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + second), extra, np.where(small, 0, v & ((np.int64(1) << extra) - 1))


#: Pixels that earlier places are looked up by, of the shortest back-reference in use, and of the longest that the format has.
_KEYED, _SHORTEST, _LONGEST = 8, 12, 4096
_FEW = 1 << 13
#: Bits of the writer's colour cache, and the share of pixels that it must hold.
_CACHE_BITS, _CACHE_SHARE = 6, 0.1
#: Channels share a code where that takes at most so many times the bits.
_ALIKE = 1.15


def _references(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of disjoint back-references, from the nearest earlier place of the pixels that begin at each."""
    none = np.zeros(0, np.int64)
    n = len(v) - _KEYED + 1
    if n < 2:
        return none, none, none
    pair = v[:-1].astype(np.uint64) << np.uint64(32) | v[1:]
    four = pair[:-2] * np.uint64(0x9E3779B97F4A7C15) + pair[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    key = four[:-4] * np.uint64(0x9E3779B97F4A7C15) + four[4:] * np.uint64(0xD6E8FEB86659FD93)
    # so few places are told apart by 16 bits, which sort faster; what they take for equal is compared below
    order = np.argsort((key >> np.uint64(48)).astype(np.uint16) if n < _FEW else key, kind="stable")
    ranked = key[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1])
    here, there = order[again + 1], order[again]
    for k in range(0, _KEYED, 2):
        same = pair[here + k] == pair[there + k]
        here, there = here[same], there[same]
    if not len(here):
        return none, none, none
    order = np.argsort(here)
    here, back = here[order], (here - there)[order]
    # runs of places of one distance, whose last place reaches further than itself
    cut = np.flatnonzero((here[1:] != here[:-1] + 1) | (back[1:] != back[:-1])) + 1
    firsts, lasts = np.append(0, cut), np.append(cut, len(here)) - 1
    out, at = [], 0
    for a, b, d in zip(here[firsts].tolist(), (here[lasts] + _KEYED).tolist(), back[firsts].tolist()):
        a = max(a, at)
        if b - a >= _SHORTEST:
            out.append((a, b, d))
            at = b
    found = np.array(out, np.int64).reshape(-1, 3)
    starts, lengths, distances = found[:, 0], found[:, 1] - found[:, 0], found[:, 2]
    parts = -(-lengths // _LONGEST)
    if (parts > 1).any():
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, distances = np.repeat(starts, parts) + _LONGEST * within, np.repeat(distances, parts)
        lengths = np.minimum(np.repeat(lengths, parts) - _LONGEST * within, _LONGEST)
    return starts, lengths, distances


@lru_cache(maxsize=64)
def _near_codes(width: int) -> np.ndarray:
    """By distance, up to the farthest that has one, the short code or the plain one."""
    near = np.array(_near(width))
    out = np.arange(near.max() + 1) + 120
    for code in range(len(near), 0, -1):
        out[near[code - 1]] = code
    return out


@lru_cache(maxsize=1024)
def _only(symbol: int) -> np.ndarray:
    """The counts of a channel of one value."""
    return np.bincount([symbol], minlength=256)


def _put_image(stream: _Stream, argb: np.ndarray, width: int, outermost: bool) -> None:
    """An entropy-coded image with one group of codes."""
    v = argb.reshape(-1)
    n = len(v)
    varied = int(np.bitwise_or.reduce(v ^ v[0]))
    if not outermost and not varied:
        stream.put(0, 1)
        for shift in (8, 16, 0, 24):
            stream.put(5 | (int(v[0]) >> shift & 255) << 3, 11)
        stream.put(5, 11)
        return
    starts, lengths, distances = _references(v)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + lengths] -= 1
    single = np.cumsum(edge)[:n] == 0
    cache_bits, hits = 0, np.zeros(n, bool)
    if outermost and n >= 256 and varied & ~0xFF00 and sum(_entropy((v >> np.uint32(k)) & np.uint32(255)) for k in (16, 0, 24)) > n:
        # an entry saves the codes of three channels; what the cache holds at a pixel is the last one before it of the same slot
        slot = (v * np.uint32(0x1E35A7BD)) >> np.uint32(32 - _CACHE_BITS)
        order = np.argsort(slot.astype(np.uint8), kind="stable")
        again = (slot[order[1:]] == slot[order[:-1]]) & (v[order[1:]] == v[order[:-1]])
        hits[order[1:][again]] = True
        hits &= single
        if hits.sum() >= _CACHE_SHARE * n:
            cache_bits = _CACHE_BITS
        else:
            hits[:] = False
    stream.put(cache_bits << 1 | 1 if cache_bits else 0, 5 if cache_bits else 1)
    if outermost:
        stream.put(0, 1)
    literal = single & ~hits
    length_symbol, length_extra, length_value = _prefix(lengths)
    near = _near_codes(width)
    codes = np.where(distances < len(near), near[np.minimum(distances, len(near) - 1)], distances + 120)
    far_symbol, far_extra, far_value = _prefix(codes)
    own = v[literal]
    channels = [(own >> np.uint32(s)) & np.uint32(255) for s in ((8, 16, 0, 24) if varied & ~0xFF00 else (8,))]
    green = np.zeros(n, np.int64)
    green[literal] = channels[0]
    if cache_bits:
        green[hits] = 280 + slot[hits]
    green[starts] = 256 + length_symbol
    single[starts] = True
    token = np.flatnonzero(single)
    counts = [np.bincount(green[token], minlength=280 + (1 << cache_bits if cache_bits else 0))]
    counts += [np.bincount(c, minlength=256) for c in channels[1:]] or [_only(int(v[0]) >> s & 255) for s in (16, 0, 24)]
    sizes = None
    if varied & ~0xFF00:
        alike = sum(counts[1:], counts[0][:256].copy())
        apart = sum(_bits_of(c) for c in counts)
        if _bits_of(alike) + _bits_of(np.append(counts[0][256:], counts[0][:256].sum())) <= _ALIKE * apart:
            # channels that are alike share a code: lengths and cache entries are told apart by one more symbol's count
            sizes = [_code_lengths(np.concatenate([alike, 4 * counts[0][256:]]), 15), *[_code_lengths(alike, 15)] * 3]
    sizes = sizes or [_code_lengths(c, 15) for c in counts]
    sizes.append(_code_lengths(np.bincount(far_symbol, minlength=_DISTANCES), 15))
    told: dict[int, tuple] = {}
    tables_of: dict[int, np.ndarray] = {}
    for x in sizes:
        if id(x) not in told:
            told[id(x)], tables_of[id(x)] = _code_tokens(x), _codes(x)
        stream.put_all(*told[id(x)])
    tables = [tables_of[id(x)] for x in sizes]
    bits = [x if np.count_nonzero(x) > 1 else np.zeros_like(x) for x in sizes]
    value, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    value[token], size[token] = tables[0][green[token]], bits[0][green[token]]

    def behind(at: np.ndarray, more: np.ndarray, wide: np.ndarray) -> None:
        value[at] |= more.astype(np.uint64) << size[at].astype(np.uint64)
        size[at] += wide

    at = np.flatnonzero(literal)
    for table, wide, c in zip(tables[1:4], bits[1:4], channels[1:]):
        if wide.any():
            behind(at, table[c], wide[c])
    if len(starts):
        behind(starts, length_value, length_extra)
        behind(starts, tables[4][far_symbol], bits[4][far_symbol])
        behind(starts, far_value, far_extra)
    stream.put_all(value[token], size[token])


def _bits_of(counts: np.ndarray) -> float:
    """Bits that a code of the counts takes, about."""
    c = counts[counts > 0].astype(float)
    total = float(c.sum())
    return total * math.log2(total) - float(c @ np.log2(c)) if total else 0.0


def _entropy(channel: np.ndarray) -> float:
    return _bits_of(np.bincount(channel.reshape(-1), minlength=256))


#: Sides of the writer's blocks of the predictor, as a power of two.
_BLOCK = 5


def _predict(pixels: np.ndarray, black: int) -> tuple[np.ndarray, np.ndarray]:
    """(modes by block, residuals) of ARGB or gray pixels: a block takes the neighbour that most of its pixels are equal to, else black."""
    height, width = pixels.shape
    side = 1 << _BLOCK
    modes = np.zeros((-(-height >> _BLOCK), -(-width >> _BLOCK)), np.int64)
    prediction = np.full((height, width), black, pixels.dtype)
    if height > 1 and width > 1:
        above, own = pixels[:-1], pixels[1:, 1:]
        neighbours = [pixels[1:, :-1], above[:, 1:]]
        equal = [own == x for x in neighbours]
        if 8 * sum(map(np.count_nonzero, equal)) >= own.size:
            neighbours += [np.concatenate([above[:, 2:], pixels[1:, :1]], axis=1), above[:, :-1]]
            equal += [own == x for x in neighbours[2:]]
            shared = np.zeros((4, height, width), np.int64)
            shared[:, 1:, 1:] = equal
            shared = np.add.reduceat(np.add.reduceat(shared, np.arange(0, height, side), axis=1), np.arange(0, width, side), axis=2)
            pixels_of = np.outer(np.minimum(side, height - np.arange(0, height, side)), np.minimum(side, width - np.arange(0, width, side)))
            modes = np.where(2 * shared.max(axis=0) >= pixels_of, 1 + shared.argmax(axis=0), 0)
        if modes.any():
            wide = np.repeat(np.repeat(modes, side, axis=0), side, axis=1)[1:height, 1:width]
            for k, x in enumerate(neighbours, 1):
                prediction[1:, 1:][wide == k] = x[wide == k]
    prediction[0, 1:] = pixels[0, :-1]
    prediction[1:, 0] = pixels[:-1, 0]
    return modes, (pixels.view(np.uint8) - prediction.view(np.uint8)).view(pixels.dtype)


def _cross(argb: np.ndarray) -> tuple[int, np.ndarray]:
    """(element, residuals): red and blue less green or red, where that lowers their entropy; grays keep nothing of either."""
    blue, green, red = (argb.view(np.uint8).reshape(*argb.shape, 4)[..., k] for k in range(3))
    element, out = 0, argb.copy()
    parts = out.view(np.uint8).reshape(*argb.shape, 4)
    # a multiplier of 32 is one: the signed channel as it is
    less = red - green
    if not less.any() or _entropy(less) < _entropy(red):
        element |= 32
        parts[..., 2] = less
    less = blue - green
    if not less.any():
        element |= 32 << 8
        parts[..., 0] = less
    else:
        by_green, by_red = _entropy(less), _entropy(blue - red)
        if min(by_green, by_red) < _entropy(blue):
            element |= 32 << 8 if by_green <= by_red else 32 << 16
            parts[..., 0] = less if by_green <= by_red else blue - red
    return element, out


def encode(pixels: np.ndarray) -> bytes:
    """A lossless WebP file of uint8 pixels: (height, width, 4) of red, green, blue, alpha, or (height, width) of opaque grays."""
    height, width = pixels.shape[:2]
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise WebpError("an image has 1 to 16384 pixels a side")
    stream = _Stream()
    header(stream, width, height)
    if pixels.ndim == 2:
        modes, residuals = _predict(pixels, 0)
        # an opaque gray less its prediction has an alpha of 0, and less its green no red and blue
        element, residuals = 32 << 8 | 32, residuals.astype(np.uint32) << np.uint32(8)
        colours = np.flatnonzero(np.bincount(pixels.reshape(-1), minlength=256)).astype(np.uint8)
        small = len(colours) <= 16
        ordered = pixels
    else:
        ordered = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]]).view(np.uint32)[..., 0]
        modes, residuals = _predict(ordered, 0xFF000000)
        element, residuals = _cross(residuals)
        # the colours in order, with where each begins among the sorted pixels
        ranked = np.sort(ordered, axis=None)
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        colours = ranked[first]
        small = len(first) <= 16
        if len(first) <= 256 and not small:
            parts = residuals.view(np.uint8).reshape(height, width, 4)
            small = _bits_of(np.diff(first, append=len(ranked))) + 24 * len(first) < sum(_entropy(parts[..., k]) for k in range(4))
    if small:
        index = np.searchsorted(colours, ordered)
        colours = colours.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000) if pixels.ndim == 2 else colours
        pack = _pixels_in_one(len(colours))
        stream.put(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
        steps = colours.view(np.uint8).reshape(-1, 4).copy()
        steps[1:] -= colours.view(np.uint8).reshape(-1, 4)[:-1]
        _put_image(stream, steps.view(np.uint32)[:, 0], len(colours), False)
        coded = -(-width >> pack)
        if pack:
            wide = np.zeros((height, coded << pack), np.int64)
            wide[:, :width] = index
            index = (wide.reshape(height, coded, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2)
        residuals = (index.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
        width = coded
    else:
        stream.put(1 | 0 << 1 | (_BLOCK - 2) << 3, 6)
        _put_image(stream, modes.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), modes.shape[1], False)
        stream.put(1 | 1 << 1 | (9 - 2) << 3, 6)
        side = np.full((-(-height >> 9), -(-width >> 9)), 0xFF000000 | element, np.uint32)
        _put_image(stream, side, side.shape[1], False)
    stream.put(0, 1)
    _put_image(stream, residuals, width, True)
    return riff(stream.bytes())
