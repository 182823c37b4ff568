"""Media columns: lossless WebP.

Decoding reads prefix codes, back-references and the colour cache and inverts the predictor,
cross-colour, green and palette transforms, for any lossless WebP file, into pixel arrays (height, width, 4) of
alpha, red, green, blue. Images in which one channel alone varies (palette images, grey ones with green subtracted) take a
vectorised path: the token at each bit is looked up at once and the chain of tokens followed.

Encoding writes samples as a grey image with prefix codes and back-references for
repeated lines; `encode_pixels` writes the other transforms and the cache, for small images.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packed import tune

LENGTHS, DISTANCES = 24, 40
#: Fixed values of the format: the order in which lengths of code lengths are stored.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
#: Bytes of one image at most; longer payloads are several images after each other.
SEGMENT, UNIT = 192 * 1024, 192


@functools.cache
def near() -> list[tuple[int, int]]:
    """(dx, dy) back from a pixel for the first 120 distance codes: those within 8 columns and 7 rows, nearest first."""
    spots = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    return sorted(spots, key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), s[0] < 0))


# --- bits and prefix codes


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        lo = self.at >> 3
        out = int.from_bytes(self.data[lo : lo + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Lengths of a prefix code for the counted symbols, `most` bits at most: small counts are raised until it fits."""
    n, floor = len(counts), 1
    if n == 1:
        return {next(iter(counts)): 0}
    while True:
        ranked = sorted((max(c, floor), s) for s, c in counts.items())
        weight = [c for c, _ in ranked]
        above = [0] * (2 * n - 1)
        leaf, node = 0, n
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (node >= k or weight[leaf] <= weight[node]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, node = node, node + 1
                above[at] = k
                total += weight[at]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= most:
            return {s: depth[k] for k, (_, s) in enumerate(ranked)}
        floor = 2 * floor if floor > 1 else max(2, sum(counts.values()) >> most)


#: A byte's bits in the other order.
TURNED = [int(f"{i:08b}"[::-1], 2) for i in range(256)]


def codes_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bits as they are read, length) of each symbol of the canonical code."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        if n:
            code <<= n - last
            last = n
            out[s] = ((TURNED[code & 255] << 8 | TURNED[code >> 8]) >> (16 - n), n)
            code += 1
        else:
            out[s] = (0, 0)
    return out


class Code:
    """Lookup by the next `width` bits."""

    def __init__(self, lengths: dict[int, int]):
        self.width = max(lengths.values(), default=0)
        self.symbol = np.zeros(1 << self.width, np.int16)
        self.length = np.zeros(1 << self.width, np.int8)
        for s, (bits, n) in codes_of(lengths).items():
            self.symbol[bits :: 1 << n] = s
            self.length[bits :: 1 << n] = n
        self.pairs = None

    def read(self, bits: Bits) -> int:
        if self.pairs is None:
            self.pairs = list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))
        lo = bits.at >> 3
        s, n = self.pairs[int.from_bytes(bits.data[lo : lo + 4], "little") >> (bits.at & 7) & ((1 << self.width) - 1)]
        bits.at += n
        return s


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, eight = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if eight else 1)] + ([bits.read(8)] if two else [])
        return Code({s: int(two) for s in symbols})
    count = 4 + bits.read(4)
    own = {ORDER[i]: n for i in range(count) if (n := bits.read(3))}
    own = {s: 0 for s in own} if len(own) == 1 else own
    inner = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, i, last = {}, 0, 8
    while i < size and left:
        left -= 1
        s = inner.read(bits)
        if s < 16:
            if s:
                lengths[i] = last = s
            i += 1
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if s == 16:
                lengths.update((k, last) for k in range(i, min(size, i + n)))
            i += n
    if len(lengths) == 1:
        lengths = {s: 0 for s in lengths}
    return Code(lengths or {0: 0})


def prefixed(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


# --- decoding


def read_image(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as numbers of 32 bits, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, meta = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        meta = (read_image(bits, -(-w >> block), -(-h >> block), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and not any(c.width for c in codes[0][1:4]):
        return read_single(bits, w, h, *codes[0])
    out, cache, spots, n, total, row = [], [0] * (1 << cache_bits), near(), 0, w * h, -(-w >> block)
    put = 0
    while n < total:
        green, red, blue, alpha, far = codes[int(meta[(n // w >> block) * row + (n % w >> block)]) if meta is not None else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 256 + LENGTHS:
            size, d = prefixed(bits, s - 256), prefixed(bits, far.read(bits))
            d = max(1, spots[d - 1][0] + spots[d - 1][1] * w) if d <= 120 else d - 120
            for _ in range(size):
                out.append(out[-d])
        else:
            while put < len(out):
                cache[(HASH * out[put] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[put]
                put += 1
            out.append(cache[s - 256 - LENGTHS])
        n = len(out)
    return np.array(out[:total], np.uint32)


def window(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 32 bits from each bit position, or what there is of them."""
    lo = np.minimum(at >> 3, len(raw) - 6)
    return sum(raw[lo + j].astype(np.int64) << (8 * j) for j in range(5)) >> (at & 7)


def extra_bits(raw: np.ndarray, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of length or distance symbols, and the position after their extra bits."""
    s = s.astype(np.int64)
    n = np.where(s < 4, 0, (s - 2) >> 1)
    return np.where(s < 4, s + 1, ((2 + (s & 1)) << n) + (window(raw, at) & ((1 << n) - 1)) + 1), at + n


def read_single(bits: Bits, w: int, h: int, green: Code, red: Code, blue: Code, alpha: Code, far: Code) -> np.ndarray:
    """One varying channel: the token at every bit at once, then the chain of tokens."""
    rest = (int(alpha.symbol[0]) << 24) | (int(red.symbol[0]) << 16) | int(blue.symbol[0])
    total, first = w * h, bits.at
    if not green.width:
        return np.full(total, rest | int(green.symbol[0]) << 8, np.uint32)
    raw = np.frombuffer(bits.data[first >> 3 :] + bytes(16), np.uint8).astype(np.uint32)
    head = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    look = (head[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).ravel() & np.uint16((1 << green.width) - 1)
    token = green.symbol[look]
    step = green.length[look]
    jump = np.arange(len(token), dtype=np.int32) + step
    # Where a look-up gives a length: its extra bits, its distance and that one's extra bits. Off the chain these mean nothing and are not used.
    refs = np.flatnonzero(token >= 256)
    if len(refs):
        size, far_at = extra_bits(raw, token[refs] - 256, jump[refs].astype(np.int64))
        far_look = window(raw, far_at) & ((1 << far.width) - 1)
        back, end = extra_bits(raw, far.symbol[far_look], far_at + far.length[far_look])
        jump[refs] = np.minimum(end, len(token) - 1)
    jump = np.minimum(jump, np.int32(len(token) - 1))
    two = jump[jump]
    four = two[two]
    eight = four[four]
    at, starts, hop = first & 7, [], memoryview(eight)
    for _ in range(-(-total // 8)):
        starts.append(at)
        at = hop[at]
    chain = np.array(starts)
    pos = np.stack([chain, c1 := jump[chain], c2 := two[chain], jump[c2], c4 := four[chain], jump[c4], c6 := two[c4], jump[c6]], 1).ravel()
    del c1
    tokens = token[pos]
    if not len(refs):
        bits.at = (first & ~7) + int(jump[pos[total - 1]])
        return (tokens[:total].astype(np.uint32) << 8) | np.uint32(rest)
    n = np.ones(len(pos), np.int64)
    long_ = np.flatnonzero(tokens >= 256)
    which = np.searchsorted(refs, pos[long_])
    n[long_] = size[which]
    put = np.cumsum(n) - n
    bits.at = (first & ~7) + int(jump[pos[np.searchsorted(put + n, total)]])
    out = np.zeros(total, np.uint32)
    single = (tokens < 256) & (put < total)
    out[put[single]] = tokens[single]
    spots = near()
    for a, m, d in zip(put[long_].tolist(), n[long_].tolist(), back[which].tolist(), strict=True):
        if a >= total:
            break
        d = max(1, spots[d - 1][0] + spots[d - 1][1] * w) if d <= 120 else d - 120
        m = min(m, total - a)
        if m <= d:
            out[a : a + m] = out[a - d : a - d + m]
        else:
            out[a : a + m] = np.resize(out[a - d : a], m)
    return (out << 8) | np.uint32(rest)


def signed(x: int) -> int:
    return x - 256 if x > 127 else x


def predict(mode: int, left, top, corner, right) -> list[int]:
    """The predicted channels; each neighbour is a list of four."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: min(255, max(0, x))
    if mode == 11:
        toward = sum(abs(y - z) for y, z in zip(top, corner, strict=True)) < sum(abs(x - z) for x, z in zip(left, corner, strict=True))
        return left if toward else top
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - z) / 2)) for m, z in zip(half(left, top), corner, strict=True)]
    return {
        0: lambda: [255, 0, 0, 0], 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: half(half(left, right), top), 6: lambda: half(left, corner),
        7: lambda: half(left, top), 8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }.get(mode, lambda: [255, 0, 0, 0])()


def neighbours(px, x: int, y: int, w: int, mode: int) -> list[int]:
    if not x and not y:
        return [255, 0, 0, 0]
    if not y:
        return px[x - 1]
    if not x:
        return px[(y - 1) * w]
    i = y * w + x
    return predict(mode, px[i - 1], px[i - w], px[i - w - 1], px[i - w + 1])


def unpack(a: np.ndarray) -> np.ndarray:
    return a.astype(">u4").view(np.uint8).reshape(-1, 4)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4): alpha, red, green, blue."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    w, h = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, width = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            transforms.append((kind, block, read_image(bits, -(-width >> block), -(-h >> block), False), width))
        elif kind == 2:
            transforms.append((2, 0, None, width))
        else:
            n = bits.read(8) + 1
            table = (np.cumsum(unpack(read_image(bits, n, 1, False)).astype(np.int64), 0) & 255).astype(np.uint8)
            shrink = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((3, shrink, table, width))
            width = -(-width >> shrink)
    px = unpack(read_image(bits, width, h, True))
    for kind, block, extra, wide in reversed(transforms):
        if kind == 3:
            index = px[:, 2].reshape(h, -1)
            if block:
                each = 8 >> block
                index = (index[:, :, None] >> (np.arange(1 << block) * each) & ((1 << each) - 1)).reshape(h, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            px = table[index.ravel()]
        elif kind == 2:
            px = px.copy()
            px[:, 1] += px[:, 2]
            px[:, 3] += px[:, 2]
        elif kind == 1:
            row = -(-wide >> block)
            at = (np.arange(len(px)) // wide >> block) * row + (np.arange(len(px)) % wide >> block)
            part = lambda shift: (extra[at] >> np.uint32(shift) & np.uint32(255)).astype(np.int8).astype(np.int32)  # noqa: B023, E731
            s = lambda c: c.astype(np.int8).astype(np.int32)
            px = px.copy()
            red = (px[:, 1] + (part(0) * s(px[:, 2]) >> 5)).astype(np.uint8)
            blue = (px[:, 3] + (part(8) * s(px[:, 2]) >> 5) + (part(16) * s(red) >> 5)).astype(np.uint8)
            px[:, 1], px[:, 3] = red, blue
        else:
            row, rest, out = -(-wide >> block), px.tolist(), []
            modes = (extra >> 8 & 15).tolist()
            for i, p in enumerate(rest):
                x, y = i % wide, i // wide
                guess = neighbours(out, x, y, wide, modes[(y >> block) * row + (x >> block)])
                out.append([a + b & 255 for a, b in zip(p, guess, strict=True)])
            px = np.array(out, np.uint8)
    px = px.reshape(h, w, 4)
    if not has_alpha:
        px[..., 0] = 255
    return px


# --- encoding


class Writer:
    """Values and their numbers of bits, packed at the end."""

    def __init__(self):
        self.values, self.sizes, self.parts = [], [], []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, n: np.ndarray) -> None:
        """To be called once, after all single values."""
        self.parts.append((values.astype(np.uint32), n))

    def bytes(self) -> bytes:
        values, n = np.array(self.values, np.uint32), np.array(self.sizes, np.int32)
        if self.parts:
            values, n = np.concatenate([values, self.parts[0][0]]), np.concatenate([n, self.parts[0][1].astype(np.int32)])
        ends = np.cumsum(n, dtype=np.int32)
        at = (np.arange(ends[-1], dtype=np.int32) - np.repeat(ends - n, n)).astype(np.uint32)
        return np.packbits((np.repeat(values, n) >> at & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes()


def write_code(out: Writer, lengths: dict[int, int], size: int) -> None:
    if len(lengths) == 1 and (s := next(iter(lengths))) < 256:
        for v, n in ((1, 1), (0, 1), (1, 1), (s, 8)):
            out.put(v, n)
        return
    run = [lengths.get(i, 0) or int(len(lengths) == 1 and i in lengths) for i in range(max(lengths) + 1)]
    # Runs of zeros are shortened, all else is plain.
    items, i = [], 0
    while i < len(run):
        j = i
        while j < len(run) and not run[j] and j - i < 138:
            j += 1
        if j - i >= 3:
            items.append((17, j - i - 3, 3) if j - i <= 10 else (18, j - i - 11, 7))
            i = j
        else:
            items.append((run[i], 0, 0))
            i += 1
    counts: dict[int, int] = {}
    for s, *_ in items:
        counts[s] = counts.get(s, 0) + 1
    own = code_lengths(counts, 7)
    own = {s: n or 1 for s, n in own.items()}
    codes = codes_of(own) if len(own) > 1 else {s: (0, 0) for s in own}
    last = max(k for k, s in enumerate(ORDER) if s in own)
    out.put(0, 1), out.put(max(0, last - 3), 4)
    for s in ORDER[: max(4, last + 1)]:
        out.put(own.get(s, 0), 3)
    # The list ends before the alphabet does.
    n = max(2, len(items))
    pairs = max(0, -(-((n - 2).bit_length() - 2) // 2)) if n > 2 else 0
    out.put(1, 1), out.put(pairs, 3), out.put(n - 2, 2 + 2 * pairs)
    for s, v, k in items + [(items[-1][0], 0, items[-1][2])] * (n - len(items)):
        out.put(*codes[s]), out.put(v, k)


def prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra value and its bits of lengths or distance codes."""
    v = np.asarray(v, np.int64) - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = v >> np.maximum(high - 1, 0) & 1
    small = v < 4
    return np.where(small, v, 2 * high + second), np.where(small, 0, v & ((1 << np.maximum(high - 1, 0)) - 1)), np.where(small, 0, high - 1)


def repeats(data: bytes, least: int = 12) -> list[tuple[int, int, int]]:
    """(position, length, distance) of lines that came before in the same bytes."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    for line in data.split(b"\n"):
        n = len(line)
        if n >= least:
            if line in seen:
                out += [(at + k, min(4096, n - k), at - seen[line]) for k in range(0, n, 4096)]
            seen[line] = at
        at += n + 1
    return out


def encode(data: bytes, w: int) -> bytes:
    """A grey image of the bytes, w to a row. With green subtracted, the other channels of grey are constant."""
    raw, h = np.frombuffer(data, np.uint8), len(data) // w
    out = Writer()
    for v, n in ((w - 1, 14), (h - 1, 14), (0, 4), (1, 1), (2, 2), (0, 1), (0, 2)):
        out.put(v, n)
    refs = repeats(data)
    keep = np.ones(len(raw), bool)
    tokens = raw.astype(np.int64)
    far = np.empty(0, np.int64)
    if refs:
        extra, extra_n = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        far, far_v, far_n = np.full(len(raw), -1), extra.copy(), extra.copy()
        at, n, d = np.array(refs).T
        for a, k in zip(at.tolist(), n.tolist(), strict=True):
            keep[a + 1 : a + k] = False
        s, v, b = prefix_of(n)
        tokens[at], extra[at], extra_n[at] = s + 256, v, b
        far[at], far_v[at], far_n[at] = prefix_of(d + 120)
    tokens = tokens[keep] if refs else tokens
    count = np.bincount(tokens)
    greens = code_lengths({int(s): int(count[s]) for s in np.flatnonzero(count)})
    distances = far[far >= 0]
    count = np.bincount(distances) if len(distances) else np.array([1])
    fars = code_lengths({int(s): int(count[s]) for s in np.flatnonzero(count)})
    for n, size in ((greens, 256 + LENGTHS), ({0: 0}, 256), ({0: 0}, 256), ({255: 0}, 256), (fars, DISTANCES)):
        write_code(out, n, size)
    value, bits = np.zeros(max(greens) + 1, np.uint64), np.zeros(max(greens) + 1, np.int64)
    for s, (v, n) in codes_of(greens).items():
        value[s], bits[s] = v, n
    if not refs:
        out.put_all(value[tokens], bits[tokens])
    else:
        fv, fn = np.zeros(DISTANCES + 1, np.uint64), np.zeros(DISTANCES + 1, np.int64)
        for s, (v, n) in codes_of(fars).items():
            fv[s], fn[s] = v, n
        far = far[keep]
        all_v = np.stack([value[tokens], extra[keep].astype(np.uint64), fv[far], far_v[keep].astype(np.uint64)], 1).ravel()
        all_n = np.stack([bits[tokens], extra_n[keep], np.where(far >= 0, fn[far], 0), far_n[keep]], 1).ravel()
        some = all_n > 0
        out.put_all(all_v[some], all_n[some])
    return container(out.bytes())


def container(body: bytes) -> bytes:
    body = b"\x2f" + body
    pad = bytes(len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def write_plain(out: Writer, values: list[int], main: bool, cache_bits: int = 0) -> None:
    """Pixels as literals and hits of the cache, for small images."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    cache, tokens = [0] * (1 << cache_bits), []
    for v in values:
        k = (HASH * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        tokens.append((280 + k,) if cache_bits and cache[k] == v and tokens else (v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
        cache[k] = v
    counts: list[dict[int, int]] = [{}, {}, {}, {}]
    for t in tokens:
        for c, s in zip(counts, t, strict=False):
            c[s] = c.get(s, 0) + 1
    lengths = [code_lengths(c or {0: 1}) for c in counts]
    for n, size in zip([*lengths, {0: 0}], (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES), strict=True):
        write_code(out, n, size)
    codes = [codes_of(n) for n in lengths]
    for t in tokens:
        for c, s in zip(codes, t, strict=False):
            out.put(*c[s])


def encode_pixels(px: np.ndarray, modes: list[int] | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, cache_bits: int = 0) -> bytes:
    """A small image with the given transforms: predictor modes by blocks of 4 pixels in turn, one cross-colour element for all, green subtracted."""
    h, w, _ = px.shape
    out = Writer()
    out.put(w - 1, 14), out.put(h - 1, 14), out.put(1, 1), out.put(0, 3)
    rows = px.reshape(-1, 4).astype(int).tolist()
    blocks = (-(-w >> 2)) * (-(-h >> 2))
    if modes:
        use = [modes[i % len(modes)] for i in range(blocks)]
        out.put(1, 1), out.put(0, 2), out.put(0, 3)
        write_plain(out, [255 << 24 | m << 8 for m in use], False)
        rows = [[a - b & 255 for a, b in zip(p, neighbours(rows, i % w, i // w, w, use[(i // w >> 2) * -(-w >> 2) + (i % w >> 2)]), strict=True)] for i, p in enumerate(rows)]
    if cross:
        g2r, g2b, r2b = (c & 255 for c in cross)
        out.put(1, 1), out.put(1, 2), out.put(0, 3)
        write_plain(out, [255 << 24 | r2b << 16 | g2b << 8 | g2r] * blocks, False)
        rows = [[a, r - (signed(g2r) * signed(g) >> 5) & 255, g, b - (signed(g2b) * signed(g) >> 5) - (signed(r2b) * signed(r) >> 5) & 255] for a, r, g, b in rows]
    if green:
        out.put(1, 1), out.put(2, 2)
        rows = [[a, r - g & 255, g, b - g & 255] for a, r, g, b in rows]
    out.put(0, 1)
    write_plain(out, [a << 24 | r << 16 | g << 8 | b for a, r, g, b in rows], True, cache_bits)
    return container(out.bytes())


# --- media columns


def store(payload: bytes) -> bytes:
    """A payload as lossless WebP images of at most SEGMENT bytes, one after the other."""
    return b"".join(encode(payload[i : i + SEGMENT], UNIT) for i in range(0, len(payload), SEGMENT))


def load(media: bytes) -> np.ndarray:
    """The samples of stored images, in order."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(decode(media[at : at + n])[..., 2].ravel())
        at += n
    return np.concatenate(out)


def padded(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % UNIT or (0 if data else UNIT))


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(data: bytes) -> tuple:
    media = store(padded(data))
    samples = load(media)
    back = samples.tobytes()
    count = np.bincount(samples, minlength=256)
    share = count[count > 0] / len(samples)
    feature = f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};levels={len(share)};rows={len(samples) // UNIT}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(texts: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in MEDIA.split(", ")]
    return pd.DataFrame([digest(t.encode() if isinstance(t, str) else b"") for t in texts], columns=names)


def media_digest(text: str = "text") -> Column:
    """Struct of what a text's stored image gives back. Null counts as empty: one row of blanks."""
    return F.pandas_udf(digests, MEDIA)(text)


def op3_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", media_digest("text").alias("m")).select("doc_id", "m.*")
