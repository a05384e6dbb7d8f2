"""Media columns: progressive JPEG, written and read in numpy batches.

A payload of bytes is stored losslessly as the quantised coefficients of a 4:2:0 image: byte b is coefficient b - 128, so a
block holds 64 bytes. The image is coded in spectral bands and by successive approximation: all but the lowest bit first, the
lowest bit in refinement scans. Restart markers cut scans into short intervals. Reading treats every interval of a scan, of
all images of a batch, as a lane; lanes advance together, one Huffman symbol each, and scans accumulate in coefficient
arrays. From those come the payload again, and by an exact integer inverse transform, chroma upsampling and colour conversion
the RGB tensor of full size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, documents, parts, ship

U64 = np.uint64
UNIT = 192
INTERVAL = 8  # blocks, or MCUs of interleaved scans, between restart markers
BANDS = ((1, 31), (32, 63))
MOST_MCUS = 4095  # in a row: the widest image that the format allows
PART_BYTES = 2 << 20


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient in zigzag order: along antidiagonals, turning at the edges."""
    cells = sorted(((i + j, j if (i + j) % 2 == 0 else i, i, j) for i in range(8) for j in range(8)))
    return np.array([i * 8 + j for _, _, i, j in cells])


ZIGZAG = _zigzag()


# ---------------------------------------------------------------- Huffman tables


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol, from code lengths."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


#: Code lengths by a rule: what text makes often is short; all that may occur has a code; the code of ones only stays free.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {**{r << 4 | s: 12 for r in range(16) for s in range(11) if s or r}, **{s: 3 for s in range(1, 7)}, 0: 4, 7: 5}
REFINE_LENGTHS = {**{r << 4 | s: 7 for r in range(16) for s in (0, 1) if s or r}, 0: 1}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table_segment(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    return _segment(0xC4, bytes([kind << 4 | slot, *[sum(n == k for _, n in order) for k in range(1, 17)], *[s for s, _ in order]]))


class Codes:
    def __init__(self, lengths: dict[int, int]):
        self.code, self.size = np.zeros(256, U64), np.zeros(256, np.int64)
        for symbol, (code, n) in canonical(lengths).items():
            self.code[symbol], self.size[symbol] = code, n


DC_CODES, AC_CODES, REFINE_CODES = Codes(DC_LENGTHS), Codes(AC_LENGTHS), Codes(REFINE_LENGTHS)


# ---------------------------------------------------------------- writing


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.int64)


def packed(value: np.ndarray, size: np.ndarray, interval: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes, with stuffing, of all intervals in a row, and where each begins. Tokens come in order of their
    interval; each is the low `size` (64 at most) bits of `value`. An interval ends in ones up to a whole byte."""
    used = size > 0
    value, size, interval = value[used], size[used], interval[used]
    bits = np.bincount(interval, weights=size, minlength=intervals).astype(np.int64)
    pad = -bits % 8
    bounds = np.concatenate([[0], np.cumsum((bits + pad) // 8)])
    before = np.cumsum(size) - size
    at = before - (np.cumsum(bits) - bits)[interval] + bounds[interval] * 8
    words = np.zeros(bounds[-1] // 8 + 2, U64)
    word, shift = at >> 6, 64 - (at & 63) - size
    own = np.where(shift >= 0, value << np.maximum(shift, 0).astype(U64), value >> np.maximum(-shift, 0).astype(U64))
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(own, first)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= value[over] << (64 + shift[over]).astype(U64)
    data = words.astype(">u8").view(np.uint8)[: bounds[-1]].copy()
    tail = np.flatnonzero(pad)
    data[bounds[tail + 1] - 1] |= ((1 << pad[tail]) - 1).astype(np.uint8)
    full = np.flatnonzero(data == 0xFF)
    return np.insert(data, full + 1, 0), bounds + np.searchsorted(full, bounds)


def _first_tokens(coef: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the first scan of a band: one cell for each coefficient and one for the end of the block."""
    size_, width = coef.shape
    magnitude = np.abs(coef) >> low
    nonzero = magnitude > 0
    place = np.arange(width)
    last = np.maximum.accumulate(np.where(nonzero, place, -1), axis=1)
    before = np.concatenate([np.full((size_, 1), -1), last[:, :-1]], axis=1)
    run = np.where(nonzero, place - before - 1, 0)
    bits = _bit_length(magnitude)
    symbol = (run & 15) << 4 | bits
    extra = np.where(coef > 0, magnitude, (1 << bits) - 1 - magnitude).astype(U64)
    value = AC_CODES.code[symbol] << bits.astype(U64) | extra
    count = AC_CODES.size[symbol] + bits
    for _ in range(3):  # runs of 16 zeros go first
        long = run > 15
        if not long.any():
            break
        value = np.where(long, AC_CODES.code[0xF0] << count.astype(U64) | value, value)
        count = np.where(long, count + AC_CODES.size[0xF0], count)
        run = np.where(long, run - 16, run)
    end = last[:, -1:] < width - 1
    value = np.concatenate([np.where(nonzero, value, 0), np.where(end, AC_CODES.code[0], 0)], axis=1)
    count = np.concatenate([np.where(nonzero, count, 0), np.where(end, AC_CODES.size[0], 0)], axis=1)
    return value.astype(U64), count


def _refine_block(coef: np.ndarray, low: int) -> list[tuple[int, int]]:
    """Tokens of a block of a refinement scan in which coefficients become nonzero."""
    tokens, held, run = [], [], 0
    magnitude = np.abs(coef) >> low
    newest = int(np.flatnonzero(magnitude == 1)[-1])
    put = lambda symbol: tokens.append((int(REFINE_CODES.code[symbol]), int(REFINE_CODES.size[symbol])))
    for k, m in enumerate(magnitude.tolist()):
        if m == 0:
            run += 1
            continue
        while run > 15 and k <= newest:
            put(0xF0)
            tokens += held
            held, run = [], run - 16
        if m > 1:
            held.append((m & 1, 1))
            continue
        put(run << 4 | 1)
        tokens += [(int(coef[k] > 0), 1), *held]
        held, run = [], 0
    if run or held:
        put(0)
        tokens += held
    return tokens


def _refine_tokens(coef: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a refinement scan, and the block of each. A block in which nothing becomes nonzero is one token: its end,
    and the low bits of all that are nonzero already."""
    magnitude = np.abs(coef) >> low
    known, fresh = magnitude > 1, (magnitude == 1).any(axis=1)
    many = known.sum(axis=1)
    after = many[:, None] - np.cumsum(known, axis=1)
    value = np.where(known, (magnitude & 1).astype(U64) << after.astype(U64), U64(0)).sum(axis=1, dtype=U64)
    count = many + REFINE_CODES.size[0]
    value |= REFINE_CODES.code[0] << many.astype(U64)
    if not fresh.any():
        return value, count, np.arange(len(coef))
    plain = np.flatnonzero(~fresh)
    v, n, b = [value[plain]], [count[plain]], [plain]
    for i in np.flatnonzero(fresh):
        tokens = _refine_block(coef[i], low)
        v.append(np.array([x for x, _ in tokens], U64))
        n.append(np.array([x for _, x in tokens], np.int64))
        b.append(np.full(len(tokens), i))
    block = np.concatenate(b)
    order = np.argsort(block, kind="stable")
    return np.concatenate(v)[order], np.concatenate(n)[order], block[order]


def _mcu_order(wide: int, high: int) -> np.ndarray:
    """The luma blocks in the order of the MCUs that hold 2 x 2 of them."""
    y, x = np.divmod(np.arange(wide * high), wide)
    return ((2 * y)[:, None] + [0, 0, 1, 1]) * (2 * wide) + (2 * x)[:, None] + [0, 1, 0, 1]


def written(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload of a positive multiple of UNIT bytes; its comment has the payload's length."""
    sizes = [(w := min(max(1, int(np.ceil(np.sqrt(m)))), MOST_MCUS), -(-m // w)) for m in (-(-len(p) // (2 * UNIT)) for p in payloads)]
    mcus = np.array([w * h for w, h in sizes])
    coefs = []
    for p, m in zip(payloads, mcus):
        c = np.zeros(m * 384, np.int64)
        c[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) - 128
        coefs.append(c.reshape(-1, 64))
    planes = [np.concatenate([c[: 4 * m] for c, m in zip(coefs, mcus)]), np.concatenate([c[4 * m : 5 * m] for c, m in zip(coefs, mcus)]), np.concatenate([c[5 * m :] for c, m in zip(coefs, mcus)])]
    blocks = [4 * mcus, mcus, mcus]
    out = [[b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _segment(0xDB, bytes([0] + [1] * 64)),
            _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _table_segment(0, 0, DC_LENGTHS), _table_segment(1, 0, AC_LENGTHS), _table_segment(1, 1, REFINE_LENGTHS), _segment(0xDD, struct.pack(">H", INTERVAL))]
           for p, (w, h) in zip(payloads, sizes)]

    def scan(parts_: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, value, size, unit, units: np.ndarray) -> None:
        """Adds a scan to each image. unit: the block or MCU of each token, over all images; units: how many an image has."""
        begin = np.cumsum(units) - units
        image = np.repeat(np.arange(len(units)), units)
        many = -(-units // INTERVAL)
        first = np.cumsum(many) - many
        data, bounds = packed(value, size, (first[image] + (np.arange(units.sum()) - begin[image]) // INTERVAL)[unit], int(many.sum()))
        head = _segment(0xDA, bytes([len(parts_), *[b for c, t in parts_ for b in (c, t)], *band, high << 4 | low]))
        raw = data.tobytes()
        for i, lines in enumerate(out):
            lines.append(head)
            for k in range(int(many[i])):
                lines.append(raw[bounds[first[i] + k] : bounds[first[i] + k + 1]])
                if k < many[i] - 1:
                    lines.append(bytes([0xFF, 0xD0 + k % 8]))

    # DC of all components, interleaved: differences to the block of the component before, from 0 after a restart.
    rows = []
    for c in range(3):
        dc = planes[c][:, 0]
        if c == 0:
            starts = np.cumsum(blocks[0]) - blocks[0]
            dc = dc[np.concatenate([s + _mcu_order(w, h).ravel() for s, (w, h) in zip(starts, sizes)])]
        rows.append(dc.reshape(mcus.sum(), -1))
    begin = np.cumsum(mcus) - mcus
    restart = (np.arange(mcus.sum()) - np.repeat(begin, mcus)) % INTERVAL == 0
    values, counts, lows = [], [], []
    for dc in rows:
        top = dc >> 1
        before = np.concatenate([np.zeros(1, np.int64), top.ravel()[:-1]]).reshape(top.shape)
        before[restart, 0] = 0
        differ = top - before
        bits = _bit_length(np.abs(differ))
        values.append(DC_CODES.code[bits] << bits.astype(U64) | np.where(differ > 0, differ, differ + (1 << bits) - 1).astype(U64))
        counts.append(DC_CODES.size[bits] + bits)
        lows.append(dc & 1)
    mcu = np.repeat(np.arange(mcus.sum()), 6)
    everyone = [(1, 0x00), (2, 0x00), (3, 0x00)]
    scan(everyone, (0, 0), 0, 1, np.concatenate(values, axis=1).ravel(), np.concatenate(counts, axis=1).ravel(), mcu, mcus)
    for band in BANDS:
        for c in range(3):
            value, count = _first_tokens(planes[c][:, band[0] : band[1] + 1], 1)
            scan([(c + 1, 0x00)], band, 0, 1, value.ravel(), count.ravel(), np.repeat(np.arange(len(value)), value.shape[1]), blocks[c])
    scan(everyone, (0, 0), 1, 0, np.concatenate(lows, axis=1).ravel().astype(U64), np.ones(len(mcu), np.int64), mcu, mcus)
    for c in range(3):
        scan([(c + 1, 0x01)], (1, 63), 1, 0, *_refine_tokens(planes[c][:, 1:], 0), blocks[c])
    return [b"".join([*lines, b"\xff\xd9"]) for lines in out]


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    h: int
    v: int
    table: int
    wide: int = 0  # blocks, up to whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks that hold some of the image
    own_high: int = 0
    base: int = 0  # of its first block in the batch's coefficients


@dataclass
class Image:
    width: int = 0
    height: int = 0
    mcus_wide: int = 0
    mcus_high: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


@dataclass
class Scan:
    image: Image
    parts: list[tuple[Component, bytes, bytes]]
    band: tuple[int, int]
    high: int
    low: int
    intervals: list[bytes]
    restart: int


def parsed(media: bytes) -> tuple[Image, list[Scan]]:
    """The header and scans of a progressive JPEG."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, scans, tables, restart, at = Image(), [], {}, 0, 2
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            for k in range(n):
                i, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.components[i] = Component(hv >> 4, hv & 15, q)
            h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
            image.mcus_wide, image.mcus_high = -(-image.width // (8 * h)), -(-image.height // (8 * v))
            for c in image.components.values():
                c.wide, c.high = image.mcus_wide * c.h, image.mcus_high * c.v
                c.own_wide, c.own_high = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded images are read")
        elif marker == 0xDA:
            n = body[0]
            used = [(image.components[body[1 + 2 * k]], tables.get(body[2 + 2 * k] >> 4, b""), tables.get(0x10 | body[2 + 2 * k] & 15, b"")) for k in range(n)]
            end = at
            cuts = [at]
            while True:
                end = media.index(b"\xff", end)
                if 0xD0 <= media[end + 1] <= 0xD7:
                    cuts += [end, end + 2]
                elif media[end + 1]:
                    break
                end += 2
            cuts.append(end)
            scans.append(Scan(image, used, (body[1 + 2 * n], body[2 + 2 * n]), body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, [media[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(cuts[::2], cuts[1::2])], restart))
            at = end
    return image, scans


class Lookup:
    """Symbol and code length for each 16 bits to come."""

    def __init__(self, table: bytes):
        self.symbol, self.size = np.zeros(1 << 16, np.int64), np.full(1 << 16, 16, np.int64)
        code, at = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                self.symbol[code << (16 - n) : (code + 1) << (16 - n)] = table[at]
                self.size[code << (16 - n) : (code + 1) << (16 - n)] = n
                code, at = code + 1, at + 1
            code <<= 1
        self.run, self.bits = self.symbol >> 4, self.symbol & 15


class Bits:
    """The bytes of all lanes, read at any bit."""

    def __init__(self, lanes: list[bytes]):
        size = np.array([len(x) for x in lanes], np.int64)
        data = np.frombuffer(b"".join(lanes) + b"\xff" * 16, np.uint8).astype(np.int64)
        self.window = data[:-7] << 32 | data[1:-6] << 24 | data[2:-5] << 16 | data[3:-4] << 8 | data[4:-3]
        self.start = (np.cumsum(size) - size) * 8

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n (24 at most) bits from each place."""
        return self.window[at >> 3] >> (40 - (at & 7) - n) & ((1 << n) - 1)


def _extended(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits >> np.maximum(n - 1, 0), bits, bits - (1 << n) + 1)


def _scan_dc(coef: np.ndarray, bits: Bits, lanes: list, tables: list[bytes], low: int, refine: bool) -> None:
    """lanes: the blocks of each lane, in order, and the component (of the scan) of each."""
    longest = max(len(b) for b, _ in lanes)
    blocks = np.full((len(lanes), longest), -1)
    for k, (b, _) in enumerate(lanes):
        blocks[k, : len(b)] = b
    if refine:
        row, col = np.nonzero(blocks >= 0)
        coef[blocks[row, col], 0] |= bits.peek(bits.start[row] + col, 1) << low
        return
    which = lanes[int(np.argmax([len(b) for b, _ in lanes]))][1]
    at, before = bits.start.copy(), np.zeros((len(lanes), int(which.max()) + 1), np.int64)
    lookups = {t: Lookup(t) for t in set(tables)}
    for step in range(longest):
        on = np.flatnonzero(blocks[:, step] >= 0)
        c = int(which[step])
        look = lookups[tables[c]]
        ahead = bits.peek(at[on], 16)
        n = look.symbol[ahead]
        value = bits.peek(at[on] + look.size[ahead], n)
        before[on, c] += _extended(value, n)
        at[on] += look.size[ahead] + n
        coef[blocks[on, step], 0] = before[on, c] << low


def _scan_first(coef: np.ndarray, bits: Bits, lanes: list[np.ndarray], table: bytes, band: tuple[int, int], low: int) -> None:
    flat, (begin, end) = coef.reshape(-1), band
    blocks = np.concatenate(lanes)
    many = np.array([len(x) for x in lanes])
    stop = np.cumsum(many)
    block, k, at = stop - many, np.full(len(lanes), begin), bits.start.copy()
    look = Lookup(table)
    on = np.flatnonzero(many > 0)
    block, k, at, stop = block[on], k[on], at[on], stop[on]
    while len(block):
        ahead = bits.peek(at, 16)
        n, run = look.bits[ahead], look.run[ahead]
        at = at + look.size[ahead]
        value = bits.peek(at, n)
        k = k + run
        some = np.flatnonzero(n)
        flat[blocks[block[some]] * 64 + np.minimum(k[some], 63)] = _extended(value[some], n[some]) << low
        at = at + n
        k = k + 1
        if len(some) < len(n):
            none = np.flatnonzero(n == 0)
            over = none[run[none] < 15]
            skip = (1 << run[over]) + bits.peek(at[over], run[over])
            at[over] += run[over]
            block[over] += skip
            k[over] = begin
        full = k > end
        block = block + full
        k = np.where(full, begin, k)
        going = block < stop
        if not going.all():
            block, k, at, stop = block[going], k[going], at[going], stop[going]


def _scan_refine(coef: np.ndarray, bits: Bits, lanes: list[np.ndarray], table: bytes, band: tuple[int, int], low: int) -> None:
    begin, end = band
    blocks = np.concatenate(lanes)
    many = np.array([len(x) for x in lanes])
    stop = np.cumsum(many)
    block, k, at, rest = stop - many, np.full(len(lanes), begin), bits.start.copy(), np.zeros(len(lanes), np.int64)
    look, place = Lookup(table), np.arange(begin, end + 1)
    live = np.flatnonzero(many > 0)
    while len(live):
        b, p, kk, run_on = blocks[block[live]], at[live], k[live], rest[live]
        ahead = bits.peek(p, 16)
        fresh = run_on == 0  # else the end of this block was announced by an earlier one
        n, run = np.where(fresh, look.bits[ahead], 0), np.where(fresh, look.run[ahead], 0)
        p = p + np.where(fresh, look.size[ahead], 0)
        ends = (n == 0) & (run < 15)
        announced = np.where(fresh & ends, (1 << run) + bits.peek(p, np.where(ends, run, 0)), run_on)
        p = p + np.where(fresh & ends, run, 0)
        sign = np.where(n > 0, bits.peek(p, 1) * 2 - 1, 0)
        p = p + (n > 0)
        now = coef[b, begin : end + 1]
        open_ = place >= kk[:, None]
        zeros = np.cumsum((now == 0) & open_, axis=1)
        target = np.where(ends, end + 1, begin + (zeros <= run[:, None]).sum(axis=1))  # the zero after `run` others
        fix = open_ & (now != 0) & (place < target[:, None])
        order = np.cumsum(fix, axis=1)
        row, col = np.nonzero(fix)
        bit = bits.peek(p[row] + order[row, col] - 1, 1)
        old = now[row, col]
        coef[b[row], begin + col] = old + np.where(old > 0, bit << low, -(bit << low))
        p = p + order[:, -1]
        new = np.flatnonzero((n > 0) & (target <= end))
        coef[b[new], target[new]] = sign[new] << low
        full = target + 1 > end
        at[live], k[live] = p, np.where(full, begin, target + 1)
        rest[live] = np.where(ends, announced - 1, 0)
        block[live] += full
        live = live[block[live] < stop[live]]


def _lanes(scan: Scan) -> list[tuple[np.ndarray, np.ndarray]]:
    """The blocks of each interval of a scan in order, and the scan's component that each belongs to."""
    if len(scan.parts) == 1:
        c = scan.parts[0][0]
        y, x = np.divmod(np.arange(c.own_wide * c.own_high), c.own_wide)
        blocks, which, each = c.base + y * c.wide + x, np.zeros(len(y), np.int64), 1
    else:
        y, x = np.divmod(np.arange(scan.image.mcus_wide * scan.image.mcus_high), scan.image.mcus_wide)
        rows, which = [], []
        for i, (c, _, _) in enumerate(scan.parts):
            dy, dx = np.divmod(np.arange(c.h * c.v), c.h)
            rows.append(c.base + (y[:, None] * c.v + dy) * c.wide + x[:, None] * c.h + dx)
            which += [i] * (c.h * c.v)
        blocks, each = np.concatenate(rows, axis=1).ravel(), len(which)
        which = np.tile(which, len(y))
    step = (scan.restart or len(blocks)) * each
    return [(blocks[i : i + step], which[i : i + step]) for i in range(0, len(blocks), step)]


def coefficients(media: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images, and the coefficients (zigzag) of all their blocks. The n-th scans of all images that share their tables and
    parameters are read together; scans of different components or bands of one image don't touch each other's coefficients,
    so neighbouring ones of one kind join in."""
    images, steps, base = [], defaultdict(list), 0
    for m in media:
        image, scans = parsed(m)
        for c in image.components.values():
            c.base, base = base, base + c.wide * c.high
        images.append(image)
        stage, seen = 0, None
        for s in scans:
            kind = (s.band[0] == 0, s.high, s.low)
            if kind != seen:
                stage, seen = stage + 1, kind
            steps[stage, kind, s.band, tuple((d, a) for _, d, a in s.parts)].append(s)
    coef = np.zeros((base, 64), np.int64)
    for stage, kind, band, tables in sorted(steps, key=lambda x: (x[0], x[2])):
        scans = steps[stage, kind, band, tables]
        lanes = [lane for s in scans for lane in _lanes(s)]
        bits = Bits([x for s in scans for x in s.intervals])
        dc, high, low = kind
        if dc:
            _scan_dc(coef, bits, lanes, [d for d, _ in tables], low, high > 0)
        elif high:
            _scan_refine(coef, bits, [b for b, _ in lanes], tables[0][1], band, low)
        else:
            _scan_first(coef, bits, [b for b, _ in lanes], tables[0][1], band, low)
    return images, coef


def _basis() -> np.ndarray:
    """The inverse transform of a block as a matrix of whole numbers, 2**13 times its value; sums stay exact in doubles."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64) * 8192)


BASIS = _basis()[ZIGZAG]


def tensor(image: Image, coef: np.ndarray) -> np.ndarray:
    """The RGB tensor (height, width, 3)."""
    planes = []
    h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    for c in image.components.values():
        blocks = coef[c.base : c.base + c.wide * c.high] * image.quantisers[c.table]
        pixels = ((blocks.astype(np.float64) @ BASIS).astype(np.int64) + (128 << 13) + 4096) >> 13
        plane = np.clip(pixels, 0, 255).astype(np.int32).reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
        if (c.h, c.v) != (h, v):
            plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)], axis=2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def read_back(media: list[bytes]) -> tuple[list[bytes], list[Image], np.ndarray]:
    """The payloads that `written` stored, with the images and coefficients."""
    images, coef = coefficients(media)
    out = []
    for image in images:
        blocks = [coef[c.base : c.base + c.wide * c.high] for c in image.components.values()]
        out.append((np.concatenate(blocks).ravel() + 128).astype(np.uint8).tobytes()[: int(image.comment.split()[1])])
    return out, images, coef


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media, a progressive JPEG of the text's bytes, of each row; null and empty texts are one unit of blanks."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in parts(batch, most=PART_BYTES):
                payloads = [padded((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(written(payloads), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def tensors(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """`rows` with height, width and rgb (height * width * 3 bytes) of a progressive JPEG; null media give nulls."""
    ship(rows.sparkSession)
    index, names = rows.columns.index(media_col), [*rows.columns, "height", "width", "rgb"]

    def run(batches):
        for batch in batches:
            for part in parts(batch, media_col, PART_BYTES):
                given = part.column(index).to_pylist()
                images, coef = coefficients([m for m in given if m is not None])
                found = iter([tensor(i, coef) for i in images])
                rgb = [None if m is None else next(found) for m in given]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else x.shape[0] for x in rgb], pa.int32()), pa.array([None if x is None else x.shape[1] for x in rgb], pa.int32()), pa.array([None if x is None else x.tobytes() for x in rgb], pa.binary())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())]))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each row.

    The payload is the text's UTF-8 (null: empty) and blanks up to a positive multiple of UNIT bytes. It is stored as a
    progressive JPEG, and what is stored is read; all but n_bytes comes from there. feature: size, mean of each colour in
    thousandths, and CRC of the RGB tensor. Rows are treated alone, so equal texts have equal values, repeated rows too.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            for part in parts(batch, most=PART_BYTES):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = written([padded(t) for t in texts])
                payloads, images, coef = read_back(media)
                features = []
                for image in images:
                    rgb = tensor(image, coef)
                    mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (rgb.shape[0] * rgb.shape[1])
                    features.append(f"{rgb.shape[1]}x{rgb.shape[0]}:{mean[0]}:{mean[1]}:{mean[2]}:{zlib.crc32(rgb.tobytes()):08x}")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                     pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(features, pa.string())],
                    [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))
