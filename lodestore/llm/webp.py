"""Lossless WebP: a decoder for the whole format and an encoder for pixel arrays.

Pixels are 32-bit numbers, alpha in the highest byte, then red, green and blue.
The decoder reads prefix codes (simple and normal), groups of codes chosen by an
entropy image, literals, back-references, the colour cache, and undoes the
predictor, cross-colour, subtract-green and palette transforms.  The encoder
writes one group of codes with literals, back-references and a colour cache, and
any of the transforms.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
#: The encoder stays below the 15 bits that the format allows: short tables are quick to build.
LONGEST_CODE, LONGEST_SMALL_CODE = 12, 9
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
BLACK = 0xFF000000


# ---------------------------------------------------------------- decoding


class Bits:
    """Reads numbers, lowest bit first."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + bytes(12), dtype=np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        #: For each byte, the 64 bits from there on.
        self.words = np.ascontiguousarray(windows).view("<u8").reshape(-1).tolist()
        self.at, self.end = 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("webp: the stream ends early")
        value = self.words[self.at >> 3] >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value


_n = np.arange(1 << 16, dtype=np.int64)
for _shift, _mask in ((1, 0x5555), (2, 0x3333), (4, 0x0F0F), (8, 0x00FF)):
    _n = (_n >> _shift & _mask) | (_n & _mask) << _shift
#: The 16-bit numbers with their bits in reverse.
REVERSED = _n


def _alike(bits: Bits, a: int, b: int, n: int) -> bool:
    """Whether the n bits from a on and from b on are the same."""
    words = bits.words
    if b + n > bits.end:
        return False
    for at in range(0, n, 32):
        mask = (1 << min(32, n - at)) - 1
        p, q = a + at, b + at
        if (words[p >> 3] >> (p & 7) ^ words[q >> 3] >> (q & 7)) & mask:
            return False
    return True


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    first = np.cumsum(1 << 16 - n) - (1 << 16 - n)  # codes as 16-bit fractions
    codes[order] = REVERSED[first]
    return codes


def _by_code(lengths: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) for each value of the next ``width`` bits of the stream, by default the longest code's."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return (used if len(used) else np.zeros(1, np.int64)), np.zeros(1, np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    width = width or int(n[-1])
    if int((1 << width - n).sum()) != 1 << width:
        raise ValueError("webp: a prefix code is not complete")
    at = np.repeat(np.arange(len(order)), 1 << width - n)[REVERSED[: 1 << width] >> 16 - width]
    return order[at], n[at]


def lookup(lengths: np.ndarray, shift: int = 0) -> tuple[list[int], int]:
    """(table, mask): entry = symbol << shift + 6 | bits, by the next bits of the stream."""
    symbols, n = _by_code(lengths)
    return ((symbols << shift + 6) + n).tolist(), len(symbols) - 1


def read_lengths(bits: Bits, size: int) -> tuple[np.ndarray, bool]:
    """(lengths, whether the same bits spell the same code in an alphabet of any size that holds its symbols)."""
    out = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return out, True
    first = np.zeros(19, dtype=np.int64)
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    counted = bits.read(1)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if counted else size
    table, mask = lookup(first)
    before, found, words, p = 8, [], bits.words, bits.at
    while len(found) < size and left:
        left -= 1
        e = table[words[p >> 3] >> (p & 7) & mask]
        p += e & 63
        s = e >> 6
        if s < 16:
            found.append(s)
            before = s or before
        else:
            n = (2, 3, 7)[s - 16]
            times = (words[p >> 3] >> (p & 7) & ((1 << n) - 1)) + (11 if s == 18 else 3)
            p += n
            found += [before if s == 16 else 0] * times
        if p > bits.end:
            raise ValueError("webp: the stream ends early")
    bits.at = p
    if len(found) > size:
        raise ValueError("webp: code lengths run over")
    out[: len(found)] = found
    return out, bool(counted and not left)


#: Bits that are looked up at once where all symbols of an image share a code, and the most symbols in them.
WINDOW, IN_WINDOW = 12, 4


def read_literals(bits: Bits, lengths: np.ndarray, count: int) -> np.ndarray:
    """``count`` symbols of one code, several at a time."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return np.full(count, used[0] if len(used) else 0, dtype=np.uint8)
    wide = WINDOW if count >= 3000 else max(WINDOW - 2, int(lengths.max()))
    symbol, n = _by_code(lengths, wide)
    window = np.arange(1 << wide)
    symbols = np.zeros((1 << wide, IN_WINDOW), dtype=np.uint8)
    symbols[:, 0] = symbol
    step, held = n.copy(), np.ones(1 << wide, dtype=np.int64)
    more = window
    for k in range(1, IN_WINDOW):
        rest = window[more] >> step[more]
        fits = step[more] + n[rest] <= wide
        more, rest = more[fits], rest[fits]
        symbols[more, k] = symbol[rest]
        step[more] += n[rest]
        held[more] += 1
    steps, words, p, end, mask = step.tolist(), bits.words, bits.at, bits.end, (1 << wide) - 1
    found: list[int] = []
    push = found.append
    while p < end:  # four lookups take 48 of the 57 bits that are there
        w = words[p >> 3] >> (p & 7)
        i = w & mask
        push(i)
        k = steps[i]
        w >>= k
        i = w & mask
        push(i)
        j = steps[i]
        w >>= j
        k += j
        i = w & mask
        push(i)
        j = steps[i]
        w >>= j
        k += j
        i = w & mask
        push(i)
        p += k + steps[i]
    at = np.array(found, dtype=np.int64)
    out = symbols[at][np.arange(IN_WINDOW) < held[at][:, None]][:count]
    bits.at += int(lengths[out].sum())
    if len(out) < count or bits.at > end:
        raise ValueError("webp: the stream ends early")
    return out


def _number(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """An entropy-coded image; the main image may have groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.at and cache_bits > 11:
        raise ValueError("webp: the colour cache is too large")
    groups, block, meta, per_row = 1, 0, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        per_row = -(-width >> block)
        meta = [x >> 8 & 0xFFFF for x in read_pixels(bits, per_row, -(-height >> block), False)]
        groups = max(meta) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for _ in range(groups):
        group, start, lengths, any_size = [], 0, np.empty(0, np.int64), False
        for size, place in zip(sizes, (8, 16, 0, 24, 0), strict=True):
            spelt = bits.at - start
            fits = len(lengths) == size or any_size and not lengths[size:].any()
            if fits and _alike(bits, start, bits.at, spelt):  # the same code once more
                start = bits.at
                bits.at += spelt
                if len(lengths) != size:
                    lengths = np.concatenate([lengths[:size], np.zeros(max(0, size - len(lengths)), np.int64)])
            else:
                start, (lengths, any_size) = bits.at, read_lengths(bits, size)
            group.append((lengths, place))
        codes.append(group)
    first = codes[0][0][0]
    if groups == 1 and not cache_bits and not first[256:].any() and all((c[:256] == first[:256]).all() and not c[256:].any() for c, _ in codes[0][1:4]) and int(first.max()) <= WINDOW:
        found = read_literals(bits, first[:256], 4 * width * height).reshape(-1, 4).astype(np.uint32)
        return found[:, 3] << np.uint32(24) | found[:, 1] << np.uint32(16) | found[:, 0] << np.uint32(8) | found[:, 2]
    codes = [[lookup(*code) for code in group] for group in codes]
    total = width * height
    out: list[int] = []
    push = out.append
    cache = [0] * (1 << cache_bits)
    shift, literal = 32 - cache_bits, 256 << 14
    words, p = bits.words, bits.at
    (gt, gm), (rt, rm), (bt, bm), (at, am), (dt, dm) = codes[0]
    n = cached = 0
    while n < total:
        if meta is not None:
            y, x = divmod(n, width)
            (gt, gm), (rt, rm), (bt, bm), (at, am), (dt, dm) = codes[meta[(y >> block) * per_row + (x >> block)]]
        w = words[p >> 3] >> (p & 7)  # at least 57 bits, and a literal has 60 at most
        e = gt[w & gm]
        if e < literal:
            w >>= e & 63
            f = rt[w & rm]
            w >>= f & 63
            g = bt[w & bm]
            e += f + g
            if e & 63 > 42:
                w = words[p + (e & 63) >> 3] >> (p + e & 7)
            else:
                w >>= g & 63
            e += at[w & am]
            p += e & 63
            push(e >> 6)
            n += 1
            continue
        p += e & 63
        s = e >> 14
        if s < 280:
            bits.at = p
            length = _number(bits, s - 256)
            e = dt[words[bits.at >> 3] >> (bits.at & 7) & dm]
            bits.at += e & 63
            code = _number(bits, e >> 6)
            p = bits.at
            if code > len(NEAR):
                distance = code - len(NEAR)
            else:
                dx, dy = NEAR[code - 1]
                distance = max(1, dx + dy * width)
            if distance > n or n + length > total:
                raise ValueError("webp: a back-reference leaves the image")
            if distance >= length:
                out += out[n - distance : n - distance + length]
            else:
                for _ in range(length):
                    push(out[-distance])
            n += length
        else:
            while cached < n:  # what came before goes into the cache when it is needed
                c = out[cached]
                cache[(c * HASH & 0xFFFFFFFF) >> shift] = c
                cached += 1
            push(cache[s - 280])
            n += 1
    if p > bits.end:
        raise ValueError("webp: the stream ends early")
    bits.at = p
    return out


def _bytes(c: int) -> tuple[int, int, int, int]:
    return c >> 24, c >> 16 & 255, c >> 8 & 255, c & 255


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    if mode == 0 or mode > 13:
        return BLACK
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        far = sum(abs(t - c) - abs(x - c) for x, t, c in zip(_bytes(left), _bytes(top), _bytes(top_left), strict=True))
        return left if far < 0 else top
    out = 0
    if mode == 12:
        for x, t, c in zip(_bytes(left), _bytes(top), _bytes(top_left), strict=True):
            out = out << 8 | min(255, max(0, x + t - c))
        return out
    for x, c in zip(_bytes(_half(left, top)), _bytes(top_left), strict=True):
        out = out << 8 | min(255, max(0, x + int((x - c) / 2)))
    return out


def _plus(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _prediction(pixels: list[int], width: int, i: int, modes: list[int], block: int) -> int:
    y, x = divmod(i, width)
    if not y:
        return pixels[i - 1] if x else BLACK
    if not x:
        return pixels[i - width]
    mode = modes[(y >> block) * -(-width >> block) + (x >> block)] >> 8 & 15
    return predict(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])


def undo_plain_predictor(pixels: np.ndarray, width: int, mode: int) -> np.ndarray:
    """All blocks predict from the left (1) or from above (2): sums along rows and columns."""
    a = pixels.view(np.uint8).reshape(-1, width, 4).copy()
    a[0, 0, 3:] += np.uint8(255)
    if mode == 1:
        a[:, 0] = np.cumsum(a[:, 0], axis=0, dtype=np.uint8)
        a = np.cumsum(a, axis=1, dtype=np.uint8)
    else:
        a[0] = np.cumsum(a[0], axis=0, dtype=np.uint8)
        a = np.cumsum(a, axis=0, dtype=np.uint8)
    return np.ascontiguousarray(a).view(np.uint32).reshape(-1)


def plain_residual(pixels: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What such a predictor leaves."""
    a = pixels.view(np.uint8).reshape(-1, width, 4)
    out = a.copy()
    if mode == 1:
        out[:, 1:] -= a[:, :-1]
        out[1:, 0] -= a[:-1, 0]
    else:
        out[1:] -= a[:-1]
        out[0, 1:] -= a[0, :-1]
    out[0, 0, 3:] -= np.uint8(255)
    return out.view(np.uint32).reshape(-1)


def undo_predictor(pixels: list[int], width: int, modes: list[int], block: int) -> None:
    for i in range(len(pixels)):
        pixels[i] = _plus(pixels[i], _prediction(pixels, width, i, modes, block))


def _cross(pixels: np.ndarray, width: int, elements: list[int], block: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what red and blue owe to green, and blue to red."""
    i = np.arange(len(pixels))
    e = np.array(elements, dtype=np.int64)[(i // width >> block) * -(-width >> block) + (i % width >> block)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    p = pixels.astype(np.int64)
    green, red, blue = signed(p >> 8), p >> 16 & 255, p & 255
    new_red = red + sign * (signed(e) * green >> 5) & 255
    base = new_red if sign > 0 else red
    new_blue = blue + sign * ((signed(e >> 8) * green >> 5) + (signed(e >> 16) * signed(base) >> 5)) & 255
    return ((p & 0xFF00FF00) | new_red << 16 | new_blue).astype(np.uint32)


def _subtract(pixels: np.ndarray, sign: int) -> np.ndarray:
    p = pixels.astype(np.int64)
    green = p >> 8 & 255
    return ((p & 0xFF00FF00) | ((p >> 16 & 255) + sign * green & 255) << 16 | ((p & 255) + sign * green & 255)).astype(np.uint32)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray, pack: int) -> np.ndarray:
    index = (pixels >> 8 & 255).astype(np.int64)
    if pack:
        depth = 8 >> pack
        rows = index.reshape(height, -1)
        x = np.arange(width)
        index = (rows[:, x >> pack] >> ((x & (1 << pack) - 1) * depth) & (1 << depth) - 1).reshape(-1)
    full = np.zeros(256, dtype=np.uint32)
    full[: len(colours)] = colours
    return full[index]


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(pixels, width, height) of one lossless file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("webp: not a lossless file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("webp: unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            undo.append((kind, across, block, list(map(int, read_pixels(bits, -(-across >> block), -(-height >> block), False)))))
        elif kind == SUBTRACT:
            undo.append((kind, across, 0, []))
        else:
            size = bits.read(8) + 1
            steps = np.array(read_pixels(bits, size, 1, False), dtype=np.uint32).view(np.uint8).reshape(-1, 4)
            colours = np.ascontiguousarray(np.cumsum(steps, axis=0, dtype=np.uint8)).view(np.uint32).reshape(-1)
            undo.append((kind, across, _packing(size), colours))
            across = -(-across >> _packing(size))
    pixels = np.array(read_pixels(bits, across, height, True), dtype=np.uint32)
    for kind, across, block, extra in reversed(undo):
        modes = {x >> 8 & 15 for x in extra} if kind == PREDICTOR else set()
        if modes == {1} or modes == {2}:
            pixels = undo_plain_predictor(pixels, across, modes.pop())
        elif kind == PREDICTOR:
            listed = pixels.tolist()
            undo_predictor(listed, across, extra, block)
            pixels = np.array(listed, dtype=np.uint32)
        elif kind == CROSS:
            pixels = _cross(pixels, across, extra, block, 1)
        elif kind == SUBTRACT:
            pixels = _subtract(pixels, 1)
        else:
            pixels = undo_palette(pixels, across, height, extra, block)
    return pixels, width, height


# ---------------------------------------------------------------- encoding


def code_lengths(counts: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Lengths of a prefix code for the symbols that occur; counts are flattened until none is too long."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    longest = longest or (LONGEST_SMALL_CODE if len(used) <= 256 else LONGEST_CODE)
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].tolist()
    floor = max(1, sum(weight) >> longest)
    while True:
        depth = _depths([w if w > floor else floor for w in weight])
        if depth[0] <= longest:
            out[order] = depth
            return out
        floor *= 2


def _depths(weight: list[int]) -> list[int]:
    """Depths of the leaves of a Huffman tree; weights and so the joined ones come in rising order."""
    m = len(weight)
    weight.append(1 << 62)
    joined: list[int] = []
    of_leaf, of_joined = [0] * m, [0] * (m - 1)
    i = j = 0
    for k in range(m - 1):
        if j < k and joined[j] < weight[i]:
            total = joined[j]
            of_joined[j] = k
            j += 1
        else:
            total = weight[i]
            of_leaf[i] = k
            i += 1
        if j < k and joined[j] < weight[i]:
            total += joined[j]
            of_joined[j] = k
            j += 1
        else:
            total += weight[i]
            of_leaf[i] = k
            i += 1
        joined.append(total)
    depth = [0] * (m - 1)
    for k in range(m - 3, -1, -1):
        depth[k] = depth[of_joined[k]] + 1
    return [depth[k] + 1 for k in of_leaf]


class Writer:
    """Numbers and their bit counts, in order."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)


def _tokens(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(code length symbol, extra, its bits) that spell the lengths."""
    tokens = []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1])
    runs = np.diff(np.append(starts, len(lengths))).tolist()
    for value, run in zip(lengths[starts].tolist(), runs, strict=True):
        if value:
            tokens.append((value, 0, 0))
            run -= 1
            while run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
                run -= n
        else:
            while run >= 3:
                n = min(run, 138)
                tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
                run -= n
        if run:
            tokens += [(value, 0, 0)] * run
    return tokens


def write_lengths(out: Writer, lengths: np.ndarray, counted: bool = False) -> None:
    """counted: with the number of tokens in front, so that the bits don't depend on the alphabet's size."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        out.put(wide, 1)
        out.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return
    tokens = _tokens(lengths[: used[-1] + 1] if counted else lengths)
    counted = counted and len(tokens) >= 2
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    single = np.count_nonzero(first) == 1
    codes, sizes = ([0] * 19, [0] * 19) if single else (reversed_codes(first).tolist(), first.tolist())
    out.put(0, 1)
    spelt = first.tolist()
    last = max(i for i, s in enumerate(LENGTH_ORDER) if spelt[s] or i < 4)
    out.put(last + 1 - 4, 4)
    for s in LENGTH_ORDER[: last + 1]:
        out.put(spelt[s], 3)
    out.put(int(counted), 1)
    if counted:
        wide = max(0, ((len(tokens) - 2).bit_length() - 1) // 2)
        out.put(wide, 3)
        out.put(len(tokens) - 2, 2 + 2 * wide)
    out.values += [codes[s] | extra << sizes[s] for s, extra, _ in tokens]
    out.sizes += [sizes[s] + n for s, _, n in tokens]


def prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra bits, their number) of numbers from 1."""
    v = value.astype(np.int64) - 1
    high = np.where(v > 0, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 0)
    extra = np.where(v < 4, 0, high - 1)
    code = np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    return code, np.where(extra > 0, v & (1 << extra) - 1, 0), extra


def matches(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, length, distance) of copies of at least four pixels, none overlapping, left to right."""
    n = len(pixels)
    if n < 8:
        return []
    p = pixels.astype(np.uint64)
    key = (p[:-3] * np.uint64(HASH) + p[1:-2]) * np.uint64(0x9E3779B97F4A7C15) + p[2:-1] * np.uint64(HASH) + p[3:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if len(same) * 8 < n:  # too little repeats to be worth a code for distances
        return []
    source = {int(order[i + 1]): int(order[i]) for i in same}
    out, free = [], 0
    for at in sorted(source):
        if at < free:
            continue
        start, length, step = source[at], 0, 64
        while length < 4096 and at + length < n:  # the copy may overlap what it copies from
            a = pixels[at + length : min(n, at + length + step)]
            differ = np.flatnonzero(a != pixels[start + length : start + length + len(a)])
            if len(differ):
                length += int(differ[0])
                break
            length += len(a)
        length = min(length, 4096)
        if length >= 4:
            out.append((at, length, at - start))
            free = at + length
    return out


def write_pixels(out: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: list | None = None, alike: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Writes the codes to ``out`` and returns (values, bit counts) of the pixels that follow."""
    n = len(pixels)
    copied = np.zeros(n, dtype=bool)
    copies = copies or []
    for at, length, _ in copies:
        copied[at : at + length] = True
    hit = np.zeros(n, dtype=bool)
    if cache_bits:
        slot = ((pixels.astype(np.uint64) * np.uint64(HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        again = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        hit[order[1:][again]] = True
        hit &= ~copied
    literal = ~(copied | hit)
    heads = np.array([c[0] for c in copies], dtype=np.int64)
    starts = np.flatnonzero(literal | hit)
    green = np.zeros(n, dtype=np.int64)
    green[literal] = pixels[literal] >> 8 & 255
    if cache_bits:
        green[hit] = 280 + slot[hit]
    length_code = length_extra = length_bits = dist_code = dist_extra = dist_bits = np.empty(0, np.int64)
    if len(heads):
        length_code, length_extra, length_bits = prefix(np.array([c[1] for c in copies]))
        dist_code, dist_extra, dist_bits = prefix(np.array([c[2] for c in copies]) + len(NEAR))
        green[heads] = 256 + length_code
        starts = np.sort(np.concatenate([starts, heads]))
    channels = [(pixels[literal] >> s & 255).astype(np.int64) for s in (16, 0, 24)]
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [np.bincount(v, minlength=size) for v, size in zip((green[starts], *channels, dist_code), sizes, strict=True)]
    if cache_bits:
        out.put(1, 1)
        out.put(cache_bits, 4)
    else:
        out.put(0, 1)
    if main:
        out.put(0, 1)
    one = alike and not len(heads) and not cache_bits
    if one:  # the samples are bytes of one text, and nothing else is written: all share a code
        counts[0] = np.concatenate([counts[0][:256] + counts[1] + counts[2] + counts[3], counts[0][256:]])
    elif alike:  # red, blue and alpha do
        counts[1] = counts[2] = counts[3] = counts[1] + counts[2] + counts[3]
    tables: list = []
    for k, c in enumerate(counts):
        if one and k in (1, 2, 3) or alike and k in (2, 3):
            out.values += spelt.values
            out.sizes += spelt.sizes
            tables.append(tables[-1])
            continue
        lengths, spelt = code_lengths(c, LONGEST_SMALL_CODE if one else None), Writer()
        write_lengths(spelt, lengths, one)
        out.values += spelt.values
        out.sizes += spelt.sizes
        several = np.count_nonzero(lengths) > 1
        tables.append((reversed_codes(lengths), lengths) if several else (np.zeros_like(lengths), np.zeros_like(lengths)))
    # four fields a symbol, made into one: a literal's channels, or a copy's length bits, distance code and distance bits
    values, sizes = np.zeros((4, n), dtype=np.uint64), np.zeros((4, n), dtype=np.uint64)
    values[0, starts], sizes[0, starts] = tables[0][0][green[starts]], tables[0][1][green[starts]]
    for k, v in enumerate(channels, start=1):
        values[k, literal], sizes[k, literal] = tables[k][0][v], tables[k][1][v]
    if len(heads):
        values[1, heads], sizes[1, heads] = length_extra, length_bits
        values[2, heads], sizes[2, heads] = tables[4][0][dist_code], tables[4][1][dist_code]
        values[3, heads], sizes[3, heads] = dist_extra, dist_bits
    together, wide = values[0], sizes[0].copy()
    for k in (1, 2, 3):
        together |= values[k] << wide
        wide += sizes[k]
    return together[starts], wide[starts]


def _bytes_of(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Fields of up to 63 bits one after another, lowest bit first."""
    ends = np.cumsum(sizes, dtype=np.uint64)
    at = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = np.zeros((total >> 6) + 2, dtype=np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift + sizes > 64)  # one field at most runs over into a word
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out.astype("<u8").tobytes()[: -(-total // 8)]


def encode(pixels: np.ndarray, width: int, height: int, transforms: list | None = None, cache_bits: int | None = None, copy: bool = True, alike: bool = False, distinct: int | None = None) -> bytes:
    """A lossless file of ``width * height`` pixels.

    transforms, in order: ("predictor", block bits, modes), ("cross", block bits,
    elements), ("subtract",) or ("palette",), the last for at most 256 colours.
    cache_bits None: chosen by how often pixels recur.  alike: red, blue and alpha
    have one distribution and are given one code.  distinct: the number of colours, where
    the caller knows it.
    """
    pixels = np.ascontiguousarray(pixels, dtype=np.uint32)
    out, parts = Writer(), []
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(bool((pixels >> 24 != 255).any())), 1)
    out.put(0, 3)

    def flush(values: np.ndarray, sizes: np.ndarray) -> None:
        nonlocal out
        parts.append((np.array(out.values, dtype=np.uint64), np.array(out.sizes, dtype=np.uint64)))
        parts.append((values, sizes))
        out = Writer()

    across = width
    for name, *more in transforms or []:
        out.put(1, 1)
        if name in ("predictor", "cross"):
            block, elements = more
            out.put(PREDICTOR if name == "predictor" else CROSS, 2)
            out.put(block - 2, 3)
            flush(*write_pixels(out, np.array(elements, dtype=np.uint32), False))
            if name == "cross":
                pixels = _cross(pixels, across, elements, block, -1)
            else:
                listed = pixels.tolist()
                guess = np.array([_prediction(listed, across, i, elements, block) for i in range(len(listed))], dtype=np.uint32)
                pixels = (pixels.view(np.uint8) - guess.view(np.uint8)).view(np.uint32)
        elif name == "subtract":
            out.put(SUBTRACT, 2)
            pixels = _subtract(pixels, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            out.put(PALETTE, 2)
            out.put(len(colours) - 1, 8)
            steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
            flush(*write_pixels(out, np.ascontiguousarray(steps, dtype=np.uint8).view(np.uint32).reshape(-1), False))
            pack = _packing(len(colours))
            index = index.reshape(height, across)
            if pack:
                depth, per = 8 >> pack, 1 << pack
                index = np.pad(index, ((0, 0), (0, -across % per))).reshape(height, -1, per)
                index = (index << np.arange(per) * depth).sum(axis=2)
                across = -(-across >> pack)
            pixels = (index.reshape(-1).astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK)
    out.put(0, 1)
    distinct = distinct if distinct is not None and not transforms else len(np.unique(pixels))
    if cache_bits is None:
        cache_bits = 10 if distinct * 2 < len(pixels) and len(pixels) >= 256 else 0
    copies = matches(pixels) if copy and distinct * 10 < 7 * len(pixels) else None  # else too little repeats
    flush(*write_pixels(out, pixels, True, cache_bits, copies, alike))
    body = b"\x2f" + _bytes_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
