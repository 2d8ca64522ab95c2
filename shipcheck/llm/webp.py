"""Lossless WebP (VP8L): a complete decoder (prefix codes, back-references, colour cache; predictor,
cross-colour, subtract-green and palette transforms), an encoder for all of these, and batch forms
without transforms that run over many images at once with numpy."""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

#: Fixed values of the format: order in which code-length code lengths are stored; alphabet sizes of green (before the cache), red, blue, alpha, distance.
ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
ALPHABETS = [280, 256, 256, 256, 40]
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD
#: Distance codes 1 to 120 name near pixels (x to the left, y up): by distance, then by |x|, positive x first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: Most bits of a code of the batch encoder, so that a pixel's three codes and a word's offset fit in 64 bits.
LIMIT = 11


class Bits:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def peek(self) -> int:
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)

    def read(self, n: int) -> int:
        v = self.peek() & ((1 << n) - 1)
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return v


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def write(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


# --- prefix codes


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, bits), for lengths that make a complete code."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


class Code:
    """One prefix code, by table: low bits -> (symbol, length); a code of one symbol takes no bits."""

    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        self.lengths, self.only = lengths, used[0] if len(used) == 1 else None
        if not used:
            self.only = 0
        if self.only is None:
            if sum(2.0**-n for n in lengths if n) != 1:
                raise ValueError("a prefix code isn't complete")
            self.bits = max(lengths)
            self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.bits)
            for s, (c, n) in canonical(lengths).items():
                for i in range(c, 1 << self.bits, 1 << n):
                    self.table[i] = (s, n)

    def read(self, b: Bits) -> int:
        if self.only is not None:
            return self.only
        s, n = self.table[b.peek() & ((1 << self.bits) - 1)]
        b.pos += n
        if b.pos > 8 * len(b.data):
            raise ValueError("the stream ends early")
        return s


@functools.lru_cache(256)
def _code(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


def read_lengths(b: Bits, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if b.read(1):
        two = b.read(1)
        lengths[b.read(8 if b.read(1) else 1)] = 1
        if two:
            lengths[b.read(8)] = 1
        return lengths
    first = [0] * 19
    stored = 4 + b.read(4)
    v = b.read(3 * stored)
    for i in range(stored):
        first[ORDER[i]] = v >> 3 * i & 7
    code, left = _code(tuple(first)), alphabet
    if b.read(1):
        left = 2 + b.read(2 + 2 * b.read(3))
    at, last, data, pos = 0, 8, b.data, b.pos
    table, mask = ([(code.only, 0)], 0) if code.only is not None else (code.table, len(code.table) - 1)
    while at < alphabet and left:
        left -= 1
        v = int.from_bytes(data[pos >> 3 : (pos >> 3) + 4], "little") >> (pos & 7)
        s, n = table[v & mask]
        pos += n
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            value, run, n = (last, 3 + (v >> n & 3), 2) if s == 16 else (0, 3 + (v >> n & 7), 3) if s == 17 else (0, 11 + (v >> n & 127), 7)
            pos += n
            if at + run > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + run] = [value] * run
            at += run
    b.pos = pos
    if pos > 8 * len(data):
        raise ValueError("the stream ends early")
    return lengths


def huffman(counts, limit: int = 15) -> list[int]:
    """Code lengths of at most `limit` bits for the symbols with a count (two at least)."""
    counts = [int(c) for c in counts]
    total, floor = sum(counts), 0
    while True:
        heap = [(max(c, floor), s, None) for s, c in enumerate(counts) if c]
        heapq.heapify(heap)
        n = len(counts)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, (a[0] + b[0], n, (a, b)))
            n += 1
        lengths, stack = [0] * len(counts), [(heap[0], 0)]
        while stack:
            (_, s, two), depth = stack.pop()
            if two:
                stack += [(two[0], depth + 1), (two[1], depth + 1)]
            else:
                lengths[s] = depth
        if max(lengths) <= limit:
            return lengths
        floor = max(2 * floor, total >> limit, 1)


#: The batch encoder's code for code lengths: 0 and 17 in three bits; 1 to 11 and 18 in four.
_FIRST = [3, *[4] * 11, 0, 0, 0, 0, 0, 3, 4]
_FIRST_CODES = canonical(_FIRST)


_FIRST_HEAD = sum(_FIRST[s] << 3 * i for i, s in enumerate(ORDER)) << 5 | 15 << 1, 5 + 3 * len(ORDER)


@functools.cache
def _zeros(run: int) -> tuple[int, int, int]:
    """(bits, number of bits, tokens) of a run of zeros."""
    value = n = tokens = 0
    while run:
        k = min(run, 138)
        s, extra, more = (18, k - 11, 7) if k > 10 else (17, k - 3, 3) if k >= 3 else (0, 0, 0)
        c, size = _FIRST_CODES[s]
        value |= (c | extra << size) << n
        n, tokens, run = n + size + more, tokens + 1, run - (k if k >= 3 else 1)
    return value, n, tokens


def write_lengths(w: Writer, lengths) -> None:
    """A code for at least two symbols, lengths up to LIMIT; zeros behind the last symbol are left out."""
    value = n = tokens = zeros = 0
    for s in lengths:
        if not s:
            zeros += 1
            continue
        if zeros:
            c, size, more = _zeros(zeros)
            value |= c << n
            n, tokens, zeros = n + size, tokens + more, 0
        c, size = _FIRST_CODES[s]
        value |= c << n
        n, tokens = n + size, tokens + 1
    w.write(*_FIRST_HEAD)
    w.write(1 | 4 << 1, 4)  # ten bits for the number of tokens
    w.write(tokens - 2, 10)
    w.write(value, n)


def write_code(w: Writer, counts) -> dict[int, tuple[int, int]]:
    used = [s for s, c in enumerate(counts) if c] or [0]
    if len(used) == 1 and used[0] < 256:
        w.write(1, 1)
        w.write(0, 1)
        w.write(int(used[0] > 1), 1)
        w.write(used[0], 8 if used[0] > 1 else 1)
        return {used[0]: (0, 0)}
    if len(used) == 1:
        counts = list(counts)
        counts[0] = 1
    lengths = huffman(counts, LIMIT)
    write_lengths(w, lengths)
    return canonical(lengths)


# --- decoding


def _extra(b: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + b.read(n) + 1


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra value, extra bits) of a length or distance of one or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    top = v >> n
    return 2 * n + 2 + (top & 1), v - (top << n), n


def read_pixels(b: Bits, width: int, height: int, main: bool) -> list[int]:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = b.read(4) if b.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else None
    tile, which, groups = 0, None, 1
    if main and b.read(1):
        tile = b.read(3) + 2
        tiles = (width + (1 << tile) - 1) >> tile
        which = [(p >> 8) & 0xFFFF for p in read_pixels(b, tiles, (height + (1 << tile) - 1) >> tile, False)]
        groups = max(which) + 1
    codes = [[Code(read_lengths(b, a + (len(cache) if cache and not i else 0))) for i, a in enumerate(ALPHABETS)] for _ in range(groups)]
    out: list[int] = []
    total, own = width * height, codes[0]
    while len(out) < total:
        if which is not None:
            y, x = divmod(len(out), width)
            own = codes[which[(y >> tile) * tiles + (x >> tile)]]
        s = own[0].read(b)
        if s < 256:
            red = own[1].read(b)
            blue = own[2].read(b)
            new = [own[3].read(b) << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _extra(b, s - 256)
            far = _extra(b, own[4].read(b))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > len(out) or len(out) + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-far])
            new = out[-length:]
            del out[-length:]
        else:
            new = [cache[s - 280]]
        out += new
        if cache:
            for p in new:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clip(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predict(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode in (11, 12, 13):
        a, b, c = _split(left), _split(top), _split(top_left)
        if mode == 11:
            to_left = sum(abs(y - z) for y, z in zip(b, c, strict=True))
            to_top = sum(abs(x - z) for x, z in zip(a, c, strict=True))
            return left if to_left < to_top else top
        if mode == 12:
            return _join([_clip(x + y - z) for x, y, z in zip(a, b, c, strict=True)])
        mean = _split(_average(left, top))
        return _join([_clip(m + int((m - z) / 2)) for m, z in zip(mean, c, strict=True)])
    return 0xFF000000


def _add(p: int, q: int) -> int:
    return ((p & 0xFF00FF00) + (q & 0xFF00FF00) & 0xFF00FF00) | ((p & 0x00FF00FF) + (q & 0x00FF00FF) & 0x00FF00FF)


def _subtract(p: int, q: int) -> int:
    return _join([(x - y) & 255 for x, y in zip(_split(p), _split(q), strict=True)])


def predictor(px: list[int], width: int, modes: list[int], bits: int, forward: bool) -> list[int]:
    """Residuals to pixels, or (forward) pixels to residuals."""
    out, tiles = list(px), (width + (1 << bits) - 1) >> bits
    known = px if forward else out
    for i in range(len(px)):
        y, x = divmod(i, width)
        if not i:
            p = 0xFF000000
        elif not y:
            p = known[i - 1]
        elif not x:
            p = known[i - width]
        else:
            mode = modes[(y >> bits) * tiles + (x >> bits)] >> 8 & 15
            p = predict(mode, known[i - 1], known[i - width], known[i - width - 1], known[i - width + 1])
        out[i] = _subtract(px[i], p) if forward else _add(px[i], p)
    return out


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def cross_colour(px: list[int], width: int, elements: list[int], bits: int, forward: bool) -> list[int]:
    out, tiles = [], (width + (1 << bits) - 1) >> bits
    sign = -1 if forward else 1
    for i, p in enumerate(px):
        y, x = divmod(i, width)
        _, to_blue_red, to_blue, to_red = _split(elements[(y >> bits) * tiles + (x >> bits)])
        a, r, g, b = _split(p)
        new = (r + sign * (_signed(to_red) * _signed(g) >> 5)) & 255
        red = r if forward else new
        b = (b + sign * ((_signed(to_blue) * _signed(g) >> 5) + (_signed(to_blue_red) * _signed(red) >> 5))) & 255
        out.append(_join((a, new, g, b)))
    return out


def subtract_green(px: list[int], forward: bool) -> list[int]:
    sign = -1 if forward else 1
    return [_join((a, (r + sign * g) & 255, g, (b + sign * g) & 255)) for a, r, g, b in map(_split, px)]


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def chunk(data: bytes) -> bytes:
    """The VP8L chunk of a file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    body = data[20 : 20 + size]
    if len(body) < size or body[:1] != b"\x2f":
        raise ValueError("the file is cut or isn't lossless")
    return body


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB as uint32) of a lossless WebP file of any kind."""
    b = Bits(chunk(data), 8)
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    steps, across = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (PREDICTOR, CROSS):
            bits = b.read(3) + 2
            steps.append((kind, across, bits, read_pixels(b, (across + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)))
        elif kind == GREEN:
            steps.append((kind, across, 0, []))
        else:
            colours = read_pixels(b, b.read(8) + 1, 1, False)
            for i in range(1, len(colours)):
                colours[i] = _add(colours[i], colours[i - 1])
            bits = _palette_bits(len(colours))
            steps.append((kind, across, bits, colours))
            across = (across + (1 << bits) - 1) >> bits
    px = read_pixels(b, across, height, True)
    for kind, w, bits, values in reversed(steps):
        if kind == PREDICTOR:
            px = predictor(px, w, values, bits, False)
        elif kind == CROSS:
            px = cross_colour(px, w, values, bits, False)
        elif kind == GREEN:
            px = subtract_green(px, False)
        else:
            packed, per, mask = (w + (1 << bits) - 1) >> bits, 8 >> bits, (1 << (8 >> bits)) - 1
            index = [px[y * packed + (x >> bits)] >> 8 + per * (x & (1 << bits) - 1) & mask for y in range(height) for x in range(w)]
            px = [values[i] if i < len(values) else 0 for i in index]
    return width, height, np.array(px, np.uint32)


# --- encoding


def wrap(body: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _write_pixels(w: Writer, px: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    tokens, seen, i = [], {}, 0
    cache = [0] * (1 << cache_bits) if cache_bits else None
    slot = lambda p: (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(px):
        key, length = tuple(px[i : i + 3]), 0
        if references and key in seen:
            at = seen[key]
            while i + length < len(px) and length < 4096 and px[at + length] == px[i + length]:
                length += 1
        if length >= 3:
            far = i - at
            near = next((n for n, (x, y) in enumerate(NEAR, 1) if max(1, x + y * width) == far), far + 120)
            tokens.append(("ref", _prefix(length), _prefix(near)))
        else:
            length = 1
            p = px[i]
            tokens.append(("hit", slot(p)) if cache and cache[slot(p)] == p else ("px", p))
        for k in range(i, i + length):
            seen[tuple(px[k : k + 3])] = k
            if cache:
                cache[slot(px[k])] = px[k]
        i += length
    counts = [[0] * (a + (len(cache) if cache and not n else 0)) for n, a in enumerate(ALPHABETS)]
    for t in tokens:
        if t[0] == "px":
            a, r, g, b = _split(t[1])
            for n, v in enumerate((g, r, b, a)):
                counts[n][v] += 1
        elif t[0] == "hit":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + t[1][0]] += 1
            counts[4][t[2][0]] += 1
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    codes = [write_code(w, c) for c in counts]
    for t in tokens:
        if t[0] == "px":
            a, r, g, b = _split(t[1])
            for n, v in enumerate((g, r, b, a)):
                w.write(*codes[n][v])
        elif t[0] == "hit":
            w.write(*codes[0][280 + t[1]])
        else:
            for n, (prefix, extra, bits) in ((0, t[1]), (4, t[2])):
                w.write(*codes[n][prefix + (256 if not n else 0)])
                w.write(extra, bits)


def encode(px, width: int, transforms=(), cache_bits: int = 0, references: bool = False, tile: int = 3, mode: int = 11, element: int = 0x00102030) -> bytes:
    """A file of ARGB pixels with the transforms asked for (of each kind one), a colour cache and back-references."""
    px, height = [int(p) for p in px], len(px) // width
    w, across = Writer(), width
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    for kind in transforms:
        w.write(1, 1)
        w.write(kind, 2)
        tiles = ((across + (1 << tile) - 1) >> tile) * ((height + (1 << tile) - 1) >> tile)
        if kind == PREDICTOR:
            modes = [0xFF000000 | ((mode + i) % 14 if mode < 0 else mode) << 8 for i in range(tiles)]
            w.write(tile - 2, 3)
            _write_pixels(w, modes, (across + (1 << tile) - 1) >> tile, False)
            px = predictor(px, across, modes, tile, True)
        elif kind == CROSS:
            w.write(tile - 2, 3)
            _write_pixels(w, [element] * tiles, (across + (1 << tile) - 1) >> tile, False)
            px = cross_colour(px, across, [element] * tiles, tile, True)
        elif kind == GREEN:
            px = subtract_green(px, True)
        else:
            colours = sorted(set(px))
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            bits, at = _palette_bits(len(colours)), {c: i for i, c in enumerate(colours)}
            w.write(len(colours) - 1, 8)
            _write_pixels(w, [colours[0], *[_subtract(b, a) for a, b in zip(colours, colours[1:], strict=False)]], len(colours), False)
            packed = (across + (1 << bits) - 1) >> bits
            new = [0xFF000000] * (packed * height)
            for y in range(height):
                for x in range(across):
                    new[y * packed + (x >> bits)] |= at[px[y * across + x]] << 8 + (8 >> bits) * (x & (1 << bits) - 1)
            px, across = new, packed
    w.write(0, 1)
    _write_pixels(w, px, across, True, cache_bits, references)
    return wrap(w.bytes())


# --- many plain images at once: payload bytes as red, green, blue of opaque pixels, WIDTH across

WIDTH, TALL = 192, 16384


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """One file per payload (a positive multiple of 3 * WIDTH bytes, at most TALL rows): one prefix code made from the payload's bytes, used for red, green and blue."""
    heads, starts, rows, codes, sizes, at = [], [], [], np.zeros((len(payloads), 256), np.uint64), np.zeros((len(payloads), 256), np.int64), 0
    for i, p in enumerate(payloads):
        counts = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
        w = Writer()
        w.write(0x2F, 8)
        w.write(WIDTH - 1, 14)
        w.write(len(p) // (3 * WIDTH) - 1, 14)
        w.write(0, 7)  # no alpha, version 0; no transform, no cache, one set of codes
        one = Writer()
        for s, (c, n) in write_code(one, counts.tolist()).items():
            codes[i, s], sizes[i, s] = c, n
        for _ in range(3):
            w.write(one.value, one.n)
        for value, n in ((0b101 | 255 << 3, 11), (0b0001, 4)):  # alpha: always 255; distance: none
            w.write(value, n)
        heads.append(w)
        starts.append(at)
        bits = w.n + int((counts * sizes[i]).sum())
        rows.append(-(-bits // 8))
        at += -(-bits // 32) * 4 + 8
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3)
    per = np.array([len(p) // 3 for p in payloads])
    base = np.repeat(np.arange(len(payloads)) * 256, per)
    g, r, b = (base + data[:, k] for k in (1, 0, 2))
    c, n = codes.ravel(), sizes.ravel()
    ng, nr = n[g], n[r]
    total = ng + nr + n[b]
    value = c[g] | c[r] << ng.astype(np.uint64) | c[b] << (ng + nr).astype(np.uint64)
    before = np.cumsum(total) - total
    first = np.repeat(before[np.concatenate([[0], per.cumsum()[:-1]])], per)
    pos = before - first + np.repeat(np.array(starts) * 8 + np.array([w.n for w in heads]), per)
    value <<= (pos & 31).astype(np.uint64)
    word, words = pos >> 5, at // 4 + 2
    low = np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    low += np.bincount(word + 1, (value >> np.uint64(32)).astype(np.float64), words)  # bits never overlap, so sums are unions
    buffer = low.astype(np.uint32).tobytes()
    out = []
    for w, start, size in zip(heads, starts, rows, strict=True):
        body = bytearray(buffer[start : start + size])
        head = w.bytes()
        for k in range(len(head)):
            body[k] |= head[k]
        out.append(wrap(bytes(body)))
    return out


_REVERSED = np.array([int(f"{i:0{LIMIT}b}"[::-1], 2) for i in range(1 << LIMIT)])


#: Colours a cache may hold (bits), smaller for small images; predictor modes and cross-colour elements that compete; pixels that are
#: encoded together; a form is made where its estimate is under SLACK times the least file so far.
CACHE_MOST, MODES, ELEMENTS, TOGETHER, SLACK = 9, (1, 2, 4), (0x00001010, 0x00200000), 1 << 19, 1.01
_SYMBOLS = 280 + (1 << CACHE_MOST)
_NEAR_CODE = np.zeros(8 + 7 * WIDTH + 1, np.int64)
for _n, (_x, _y) in reversed(list(enumerate(NEAR, 1))):
    _NEAR_CODE[max(1, _x + _y * WIDTH)] = _n


def huffman_rows(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of at most `limit` bits for the symbols with a count of every row at once; rows of one symbol or none stay 0."""
    used = (counts > 0).sum(axis=1)
    rows = np.argsort(-used, kind="stable")
    rows = rows[used[rows] > 1]
    out = np.zeros(counts.shape, np.int64)
    if not len(rows):
        return out
    n, most = used[rows], int(used[rows[0]])
    c = np.where(counts[rows] > 0, counts[rows], 1 << 60)
    order = np.sort(np.minimum(c, 1 << 50) << 12 | np.arange(c.shape[1]), axis=1)[:, :most] & 4095  # by count, then symbol
    leaf = np.concatenate([np.take_along_axis(c, order, 1), np.full((len(rows), 1), 1 << 60)], axis=1)
    pair, at = np.full((len(rows), most + 1), 1 << 61), np.arange(len(rows))
    up_leaf, up_pair = np.zeros((len(rows), most + 1), np.int64), np.zeros((len(rows), most + 1), np.int64)
    i, j = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    lives = np.searchsorted(-n, -(np.arange(most - 1) + 1), side="left")  # rows with over step + 1 symbols
    for step, live in enumerate(lives.tolist()):
        r, both = at[:live], 0
        for _ in range(2):
            a, b = leaf[r, i[:live]], pair[r, j[:live]]
            low = a <= b
            both = both + np.where(low, a, b)
            up_leaf[r[low], i[:live][low]] = step
            up_pair[r[~low], j[:live][~low]] = step
            i[:live] += low
            j[:live] += ~low
        pair[:live, step] = both
    depth = np.zeros((len(rows), most + 1), np.int64)
    for step in range(most - 3, -1, -1):
        live = int(lives[step + 1])  # rows in which this pair isn't the root
        depth[:live, step] = depth[at[:live], up_pair[:live, step]] + 1
    lengths = np.where(np.arange(most) < n[:, None], np.take_along_axis(depth, up_leaf[:, :most], 1) + 1, 0)
    np.put_along_axis(own := np.zeros(c.shape, np.int64), order, lengths, 1)
    out[rows] = own
    long = np.flatnonzero(out.max(axis=1) > limit)
    if len(long):
        part = counts[long]
        floor = np.maximum(part.sum(axis=1) >> limit, np.where(part > 0, part, 1 << 60).min(axis=1) * 2)
        out[long] = huffman_rows(np.where(part > 0, np.maximum(part, floor[:, None]), 0), limit)
    return out


def code_rows(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes, first bit lowest, of every row's lengths (up to LIMIT)."""
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    per = np.bincount(row * (LIMIT + 1) + size, minlength=len(lengths) * (LIMIT + 1)).reshape(-1, LIMIT + 1)
    first = np.zeros(per.shape, np.int64)
    for n in range(1, LIMIT + 1):
        first[:, n] = first[:, n - 1] + per[:, n - 1] << 1
    order = np.argsort(row * (LIMIT + 1) + size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(per.ravel().cumsum() - per.ravel(), per.ravel())
    out = np.zeros(lengths.shape, np.int64)
    out[row, symbol] = _REVERSED[first[row, size] + rank << LIMIT - size]
    return out


def _bits_needed(counts: np.ndarray) -> np.ndarray:
    """Entropy of each row in bits."""
    total = counts.sum(axis=1)
    c = np.maximum(counts, 1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(c)).sum(axis=1)


def _histogram(of: np.ndarray, values: np.ndarray, rows: int, width: int = 256) -> np.ndarray:
    return np.bincount(of * width + values, minlength=rows * width).reshape(rows, width)


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix of many values."""
    v = value - 1
    n = np.maximum(np.frexp(v.astype(np.float64))[1] - 2, 0)
    top = v >> n
    return np.where(v < 4, v, 2 * n + 2 + (top & 1)), np.where(v < 4, 0, v - (top << n)), np.where(v < 4, 0, n)


def matches(px: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references that don't overlap, for images one behind the other (`of`: each pixel's image):
    three pixels or more are taken from where their first three stood last."""
    n, wide = len(px) - 2, max(1, len(px).bit_length())
    key = px[:-2] * np.uint64(0x9E3779B97F4A7C15) + px[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + px[2:] * np.uint64(0x165667B19E3779F9)
    key = (key + of[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    key = np.sort(key >> np.uint64(wide) << np.uint64(wide) | np.arange(n, dtype=np.uint64))
    at, key = (key & np.uint64((1 << wide) - 1)).astype(np.int64), key >> np.uint64(wide)
    same = np.flatnonzero(key[1:] == key[:-1])
    here, last = at[same + 1], at[same]
    ok = (px[here] == px[last]) & (px[here + 1] == px[last + 1]) & (px[here + 2] == px[last + 2]) & (of[here + 2] == of[last])
    far = np.zeros(n + 1, np.int64)
    far[here[ok]] = (here - last)[ok]
    edge = np.flatnonzero(np.diff(far, prepend=0) != 0)
    start, end = edge[far[edge] > 0], np.append(edge, n)[1:][far[edge] > 0] + 2  # runs of one distance
    start = np.maximum(start, np.concatenate([[0], end[:-1]]))
    start, length, far = (a[end - start >= 3] for a in (start, end - start, far[np.minimum(end - 3, n)]))
    parts = -(-length // 4096)
    k = np.arange(parts.sum()) - np.repeat(parts.cumsum() - parts, parts)
    start, length, far = (np.repeat(a, parts) for a in (start, length, far))
    return start + 4096 * k, np.minimum(length - 4096 * k, 4096), far


def cached(px: np.ndarray, of: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in its image's colour cache of `bits` bits, whether it stands there) of each pixel."""
    wide = len(px).bit_length()
    slot = ((px * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> (32 - bits[of]).astype(np.uint64)
    key = np.sort((of.astype(np.uint64) << np.uint64(CACHE_MOST) | slot) << np.uint64(wide) | np.arange(len(px), dtype=np.uint64))
    at = (key & np.uint64((1 << wide) - 1)).astype(np.int64)
    key >>= np.uint64(wide)
    hit = np.zeros(len(px), bool)
    hit[at[1:]] = (key[1:] == key[:-1]) & (px[at[1:]] == px[at[:-1]])
    return slot.astype(np.int64), hit


def encode_referenced(payloads: list[bytes]) -> tuple[list[bytes], list[tuple], np.ndarray]:
    """Each payload's file with back-references and, where an estimate says so, a colour cache; and for each what
    the transforms promise: (estimated bytes, transform, mode or element, cache bits), the least one, and the
    estimated bytes of the plain form."""
    rows, per = len(payloads), np.array([len(p) // 3 for p in payloads])
    small = np.ascontiguousarray(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3).T)
    rgb = small.astype(np.int32)
    of, ends = np.repeat(np.arange(rows), per), per.cumsum()
    px = np.uint64(0xFF000000) + sum(c.astype(np.uint64) << np.uint64(k) for c, k in zip(small, (16, 8, 0), strict=True))
    start, length, far = matches(px, of)
    edge = np.zeros(len(px) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    alone = np.flatnonzero(edge.cumsum()[:-1] == 0)
    bits = np.clip(np.log2(per).astype(np.int64) - 3, 4, CACHE_MOST)
    slot, hit = cached(px, of, bits)
    whose = of[alone]

    def greens(hits):
        g = _histogram(np.concatenate([whose, of[start]]), np.concatenate([np.where(hits, 280 + slot[alone], rgb[1][alone]), 256 + lens[0]]), rows, _SYMBOLS)
        own = alone[~hits]
        return g, _histogram(np.tile(of[own], 2), np.concatenate([rgb[0][own], rgb[2][own]]), rows)

    lens = _prefixes(length)
    near = np.where(far < len(_NEAR_CODE), _NEAR_CODE[np.minimum(far, len(_NEAR_CODE) - 1)], 0)
    dist = _prefixes(np.where(near > 0, near, far + 120))
    forms = [greens(np.zeros(len(alone), bool)), greens(hit[alone])]
    costs = [sum(_bits_needed(c) + 4 * (c > 0).sum(axis=1) for c in form) for form in forms]
    better = costs[1] < costs[0]
    green, others = (np.where(better[:, None], b, a) for a, b in zip(*forms, strict=True))
    hits = hit[alone] & better[whose]
    tables = [green, others, _histogram(of[start], dist[0], rows, 40)]
    sizes = [huffman_rows(np.where(((t > 0).sum(axis=1, keepdims=True) == 1) & (np.arange(t.shape[1]) == 0) & (t[:, 256:].sum(axis=1, keepdims=True) > 0), 1, t)) for t in tables]
    codes = [code_rows(s) for s in sizes]
    heads = []
    for i in range(rows):
        w = Writer()
        for v, n in ((0x2F, 8), (WIDTH - 1, 14), (len(payloads[i]) // (3 * WIDTH) - 1, 14), (0, 5)):
            w.write(v, n)
        w.write(*((1 | int(bits[i]) << 1, 6) if better[i] else (0, 2)))  # a cache or none; one set of codes
        made = []
        for t, s in zip(tables, sizes, strict=True):
            one = Writer()
            if s[i].any():
                room = 280 + (1 << int(bits[i]) if better[i] else 0) if t is green else t.shape[1]
                write_lengths(one, s[i, :room].tolist())
            else:
                write_code(one, np.bincount([int(t[i].argmax())], minlength=256).tolist())
            made.append(one)
        for v, n in ((made[0].value, made[0].n), *[(made[1].value, made[1].n)] * 2, (0b101 | 255 << 3, 11), (made[2].value, made[2].n)):
            w.write(v, n)
        heads.append(w)

    def coded(k, at, symbol):
        return codes[k][at, symbol], sizes[k][at, symbol]

    place = np.concatenate([alone, start])
    (gc, gn), lit = coded(0, whose, np.where(hits, 280 + slot[alone], rgb[1][alone])), ~hits
    (rc, rn), (bc, bn) = coded(1, whose, rgb[0][alone]), coded(1, whose, rgb[2][alone])
    rn, bn = rn * lit, bn * lit
    (lc, ln), (dc, dn) = coded(0, of[start], 256 + lens[0]), coded(2, of[start], dist[0])
    first = np.concatenate([gc | rc * lit << gn | bc * lit << gn + rn, lc | lens[1] << ln])
    n1 = np.concatenate([gn + rn + bn, ln + lens[2]])
    second, n2 = np.concatenate([np.zeros(len(alone), np.int64), dc | dist[1] << dn]), np.concatenate([np.zeros(len(alone), np.int64), dn + dist[2]])
    order = np.argsort(place, kind="stable")
    first, n1, second, n2, image = first[order], n1[order], second[order], n2[order], of[place[order]]
    size = np.array([w.n for w in heads]) + np.bincount(image, n1 + n2, rows).astype(np.int64)
    base = np.concatenate([[0], (-(-size // 32) * 32 + 64).cumsum()])
    before = np.cumsum(n1 + n2) - n1 - n2
    head = np.searchsorted(image, np.arange(rows))
    pos = before - before[head][image] + base[:-1][image] + np.array([w.n for w in heads])[image]
    words = np.zeros(base[-1] // 32 + 2)
    for value, at in ((first, pos), (second[n2 > 0], (pos + n1)[n2 > 0])):
        value = value.astype(np.uint64) << (at & 31).astype(np.uint64)
        for k, part in enumerate((value & np.uint64(0xFFFFFFFF), value >> np.uint64(32))):
            words += np.bincount((at >> 5) + k, part.astype(np.float64), len(words))  # bits never overlap, so sums are unions
    buffer, out = words.astype(np.uint32).tobytes(), []
    for w, a, n in zip(heads, base.tolist(), size.tolist(), strict=False):
        body = bytearray(buffer[a // 8 : a // 8 + -(-n // 8)])
        body[: -(-w.n // 8)] = (int.from_bytes(body[: -(-w.n // 8)], "little") | w.value).to_bytes(-(-w.n // 8), "little")
        out.append(wrap(bytes(body)))

    # what each transform would make of the same references (colours of pixels keep their identity) or, predicted, of all pixels
    own = alone[lit]
    mine, (r, g, b) = of[own], rgb[:, own]

    def cost(*tables):
        return sum(_bits_needed(t) + 4 * (t > 0).sum(axis=1) for t in tables)

    rest = size - cost(_histogram(mine, g, rows), others)
    promises = [(GREEN, 0, rest + cost(*(_histogram(mine, v & 255, rows) for v in (g, r - g, b - g))))]
    for element in ELEMENTS:
        _, rb, gb, gr = _split(element)
        both = ((r - (gr * ((g ^ 128) - 128) >> 5)) & 255, g, (b - (gb * ((g ^ 128) - 128) >> 5) - (rb * ((r ^ 128) - 128) >> 5)) & 255)
        promises.append((CROSS, element, 120 + rest + cost(*(_histogram(mine, v, rows) for v in both))))
    top = (ends - per)[:, None] + np.arange(WIDTH)  # first rows have their left pixel before them, first columns the one above
    for mode, back in zip(MODES, (1, WIDTH, WIDTH + 1), strict=True):
        residual = small.copy()
        residual[:, back:] -= small[:, :-back]
        residual[:, top[:, 1:]] = small[:, top[:, 1:]] - small[:, top[:, :-1]]
        residual[:, top[:, 0]] = small[:, top[:, 0]]
        below = np.setdiff1d(np.arange(0, len(px), WIDTH), top[:, 0], assume_unique=True)
        residual[:, below] = small[:, below] - small[:, below - WIDTH]
        promises.append((PREDICTOR, mode, 560 + cost(*(_histogram(of, v, rows) for v in residual))))
    colour, many = np.unique(of[alone].astype(np.uint64) << np.uint64(32) | px[alone], return_counts=True)
    image = (colour >> np.uint64(32)).astype(np.int64)
    colours, total = np.bincount(image, minlength=rows), np.bincount(image, many, rows)
    entropy = total * np.log2(total) - np.bincount(image, many * np.log2(many), rows)
    refs = np.bincount(of[start], ln + lens[2] + dn + dist[2], rows)
    promises.append((PALETTE, 0, np.where(colours <= 256, 1000 + 24 * colours + refs + entropy, np.inf)))
    best = np.argmin([p[2] for p in promises], axis=0)
    every = sum(_histogram(of, v, rows) for v in rgb)
    return out, [(promises[k][2][i] / 8, *promises[k][:2], int(bits[i] * better[i]) * (promises[k][0] in (GREEN, CROSS))) for i, k in enumerate(best.tolist())], (300 + _bits_needed(every) + 12 * (every > 0).sum(axis=1)) / 8


def encode_smallest(payloads: list[bytes]) -> list[bytes]:
    """One file per payload, the smallest of: the plain form; back-references with a colour cache or none; and, where the
    estimate of a transform (subtract-green, cross-colour, predictor, palette) comes near these, the form with it and references."""
    out, at = [], 0
    while at < len(payloads):
        end, room = at + 1, TOGETHER - len(payloads[at]) // 3
        while end < len(payloads) and (room := room - len(payloads[end]) // 3) >= 0:
            end += 1
        part = payloads[at:end]
        files, promised, plain = encode_referenced(part)
        near = [i for i, f in enumerate(files) if plain[i] < SLACK * len(f)]
        for i, f in zip(near, encode_batch([part[i] for i in near]) if near else (), strict=True):
            files[i] = min(files[i], f, key=len)
        for p, least, (size, kind, how, cache) in zip(part, files, promised, strict=True):
            if size < SLACK * len(least):
                rgb = np.frombuffer(p, np.uint8).reshape(-1, 3).astype(np.uint32)
                px = (0xFF000000 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]).tolist()
                least = min(least, encode(px, WIDTH, (kind,), cache, True, mode=how, element=how), key=len)
            out.append(least)
        at = end
    return out


def _table(lengths) -> np.ndarray:
    """Low LIMIT bits -> length << 16 | symbol."""
    sizes = np.array(lengths, np.int64)
    used = np.flatnonzero(sizes)
    if len(used) <= 1:
        return np.full(1 << LIMIT, used[0] if len(used) else 0, np.int32)
    used = used[np.argsort(sizes[used], kind="stable")]
    return np.repeat((sizes[used] << 16 | used).astype(np.int32), 1 << (LIMIT - sizes[used]))[_REVERSED]


def _same(b: Bits, start: int, end: int, _) -> bool:
    """Whether the bits from here on are those of the code before, which then is this one."""
    cut = lambda at: int.from_bytes(b.data[at >> 3 : (at + end - start + 7) >> 3], "little") >> (at & 7) & (1 << end - start) - 1
    return cut(start) == cut(b.pos) and b.pos + end - start <= 8 * len(b.data)


def _again(b: Bits, start: int, end: int, lengths: list[int]) -> list[int]:
    b.pos += end - start
    return lengths


def area(file: bytes) -> int:
    """Pixels of a file, by its header."""
    v = int.from_bytes(file[21:25], "little")
    return ((v & 0x3FFF) + 1) * ((v >> 14 & 0x3FFF) + 1)


def decode_batch(files: list[bytes], group: int = 768) -> list[bytes]:
    """Red, green, blue bytes of each file's opaque pixels.

    Files without transforms and tiles (with codes of up to LIMIT bits) are decoded in step: one pixel of every
    file at a time, longest files together.  All others go through decode()."""
    out: list[bytes | None] = [None] * len(files)
    plain = []
    for i, f in enumerate(files):
        b = Bits(chunk(f), 8)
        width, height, rest = b.read(14) + 1, b.read(14) + 1, b.read(5)
        lengths, cache = None, 0
        if not rest & ~1:
            cache = b.read(4) if b.read(1) else 0
            if not b.read(1):
                lengths = [read_lengths(b, 280 + (1 << cache if cache else 0))]
                for a in ALPHABETS[1:]:
                    at = b.pos
                    lengths.append(_again(b, *before) if a == 256 and len(lengths) == 2 and _same(b, *before) else read_lengths(b, a))
                    before = (at, b.pos, lengths[-1])
        if lengths is None or max(map(max, lengths)) > LIMIT or [s for s, n in enumerate(lengths[3]) if n] != [255]:
            _, _, argb = decode(f)
            out[i] = np.stack([argb >> 16, argb >> 8, argb], axis=1).astype(np.uint8).tobytes()
        else:
            plain.append((width * height, i, b.pos, [*lengths[:3], lengths[4]], cache, width))
    plain.sort(key=lambda p: -p[0])
    for at in range(0, len(plain), group):
        _in_step(files, plain[at : at + group], out)
    return out


#: Images so few are read one by one.
FEW = 24


def _finish(px: list[int], total: int, across: int, buffer: np.ndarray, pos: int, end: int, tables: list[list[int]], cache: list[int], bits: int, left: int, far: int) -> list[int]:
    """All pixels of an image whose first ones are known, and of the next ones `left` from `far` before."""
    green, red, blue, distance = tables
    data, first = buffer[pos >> 3 : (end >> 3) + 16].tobytes(), pos >> 3 << 3
    pos, end, mask, shift, at = pos - first, end - first, (1 << LIMIT) - 1, 32 - bits, len(px)
    while True:
        if left:
            for k in range(left):
                px.append(px[at + k - far])
            if bits:
                for p in px[at:]:
                    cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
            at += left
        if at >= total:
            break
        v = int.from_bytes(data[pos >> 3 : (pos >> 3) + 8], "little") >> (pos & 7)
        e = green[v & mask]
        s, n = e & 0xFFFF, e >> 16
        if 255 < s < 280:
            extra = _EXTRA_LIST[s - 256]
            left = _LEAST_LIST[s - 256] + (v >> n & (1 << extra) - 1)
            n += extra
            e = distance[v >> n & mask]
            n += e >> 16
            extra = _EXTRA_LIST[e & 0xFFFF]
            far = _LEAST_LIST[e & 0xFFFF] + (v >> n & (1 << extra) - 1)
            pos += n + extra
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * across)
            if far > at or at + left > total:
                raise ValueError("a back-reference leaves the image")
            continue
        if s > 255:
            p = cache[s - 280]
        else:
            e = red[v >> n & mask]
            n += e >> 16
            f = blue[v >> n & mask]
            n += f >> 16
            p = 0xFF000000 | (e & 255) << 16 | s << 8 | f & 255
        pos += n
        left, at = 0, at + 1
        px.append(p)
        if bits:
            cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
        if pos > end:
            raise ValueError("an image ends before its pixels do")
    if pos > end:
        raise ValueError("an image ends before its pixels do")
    return px


_EXTRA = np.array([max(p - 2, 0) >> 1 for p in range(40)])
_LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << (p - 2 >> 1)) + 1 for p in range(40)])
_EXTRA_LIST, _LEAST_LIST = _EXTRA.tolist(), _LEAST.tolist()
_NEAR_X, _NEAR_Y = np.array(NEAR).T


def _in_step(files: list[bytes], plain: list[tuple], out: list) -> None:
    bodies = [files[i][20:] for _, i, *_ in plain]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]])
    block = 512
    buffer = np.frombuffer(b"".join(bodies) + b"\0" * (8 * block + 16), np.uint8)  # a block's reads end before its check
    view = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    tables, of = [], np.zeros((4, len(plain)), np.int64)
    for k, (_, _, _, lengths, _, _) in enumerate(plain):
        for ch in range(4):
            if ch == 2 and lengths[2] == lengths[1]:
                of[ch, k] = of[1, k]
            else:
                of[ch, k] = len(tables) << LIMIT
                tables.append(_table(lengths[ch]))
    table = np.concatenate(tables)
    pos = starts * 8 + np.array([p[2] for p in plain])
    ends = (starts + np.array([len(chunk(files[i])) for _, i, *_ in plain])) * 8
    count = np.array([p[0] for p in plain])
    across = np.array([p[5] for p in plain])
    # a cache of its own for each file (of one place where it has none)
    bits = np.array([p[4] for p in plain])
    room = np.concatenate([[0], (1 << bits).cumsum()])
    cache, shift = np.zeros(room[-1], np.uint32), (32 - bits).astype(np.uint64)
    left, back = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
    base = np.concatenate([[0], count.cumsum()])
    px = np.zeros(base[-1], np.uint32)
    mask, low, caches = (1 << LIMIT) - 1, np.int64(7), bool(bits.any())
    wrong = np.zeros(len(plain), bool)
    live, step = len(plain), 0
    while live > FEW:
        og, orr, ob, od = of[:, :live]
        p, rest, far, at, places, by = pos[:live], left[:live], back[:live], base[:live], room[:live], shift[:live]
        last = min(step + block, int(count[live - 1]))
        for t in range(step, last):
            on = (rest == 0).nonzero()[0]
            rest -= 1
            new = px[at + (t - far)]
            if len(on):
                v = view[p[on] >> 3] >> (p[on] & low).astype(np.uint64)
                v = v.astype(np.int64)
                e = table[og[on] + (v & mask)]
                s, n = e & 0xFFFF, (e >> 16).astype(np.int64)
                f = table[orr[on] + (v >> n & mask)]
                m = n + (f >> 16)
                h = table[ob[on] + (v >> m & mask)]
                own = 0xFF000000 | (f & 255).astype(np.int64) << 16 | (s & 255) << 8 | (h & 255)
                m += h >> 16
                other = (s > 255).nonzero()[0]
                if len(other):
                    so, no = s[other], n[other]
                    hit = so >= 280
                    k = other[hit]
                    own[k] = cache[places[on[k]] + so[hit] - 280]
                    m[k] = no[hit]
                    ref = (~hit).nonzero()[0]
                    if len(ref):
                        k = other[ref]
                        o, w, prefix = on[k], no[ref], so[ref] - 256
                        vk = v[k]
                        rest[o] = _LEAST[prefix] + (vk >> w & (1 << _EXTRA[prefix]) - 1) - 1
                        w = w + _EXTRA[prefix]
                        d = table[od[o] + (vk >> w & mask)]
                        w, prefix = w + (d >> 16), d & 0xFFFF
                        dist = _LEAST[prefix] + (vk >> w & (1 << _EXTRA[prefix]) - 1)
                        close = np.minimum(dist, 120) - 1
                        dist = np.where(dist > 120, dist - 120, np.maximum(1, _NEAR_X[close] + _NEAR_Y[close] * across[o]))
                        wrong[o] |= (dist > t) | (rest[o] + t >= count[o])
                        dist = np.minimum(dist, t)
                        far[o] = dist
                        own[k] = px[at[o] + (t - dist)]
                        m[k] = w + _EXTRA[prefix]
                rest[on[rest[on] < 0]] = 0
                p[on] += m
                new[on] = own
            px[at + t] = new
            if caches:
                cache[places + ((new * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> by).astype(np.int64)] = new
        if (p > ends[:live]).any() or wrong.any():
            raise ValueError("an image ends before its pixels do, or a back-reference leaves it")
        step = last
        while live and count[live - 1] == step:
            live -= 1
    for k in range(live):
        own = [table[a : a + (1 << LIMIT)].tolist() for a in of[:, k].tolist()]
        held = cache[room[k] : room[k + 1]].tolist()
        a, b = int(base[k]), int(base[k + 1])
        px[a:b] = _finish(px[a : a + step].tolist(), b - a, int(across[k]), buffer, int(pos[k]), int(ends[k]), own, held, int(bits[k]), int(left[k]), int(back[k]))
    for (_, i, *_), a, b in zip(plain, base.tolist(), base[1:].tolist(), strict=False):
        out[i] = np.stack([px[a:b] >> 16, px[a:b] >> 8, px[a:b]], axis=1).astype(np.uint8).tobytes()
