"""Progressive JPEG in numpy, many images at a time.

Images have three components with 2x2-subsampled chroma, and quantization steps of 1, so that quantized coefficients are kept
exactly. Scans select spectral bands and approximate successively: DC without its last bit, AC 1-5 and 6-63 without
the last bit, then the last bits. Restart markers cut every scan into short intervals; the decoder runs all intervals of all images in step,
a Huffman symbol of each at a time, and gathers the scans' contributions in coefficient arrays.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import defaultdict
from functools import lru_cache

import numpy as np

MCU_BLOCKS, BLOCK = 6, 64
WIDEST = 4095  # blocks of 16 pixels in a row; the format's width ends at 65535
RESTART_BLOCKS = 4
BANDS = ((1, 5), (6, 63))
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


class Huffman:
    """A code from its lengths' counts and symbols, as a DHT segment has them."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.segment = counts + symbols
        self.length, self.code = np.zeros(256, np.int64), np.zeros(256, np.int64)
        table = np.zeros(1 << 16, np.int32)
        code, k = 0, 0
        for size, many in enumerate(counts, 1):
            for _ in range(many):
                s = symbols[k]
                self.length[s], self.code[s] = size, code
                table[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | s
                code, k = code + 1, k + 1
            code <<= 1
        self.table = table

    @staticmethod
    def of_weights(weights: dict[int, float]) -> Huffman:
        """Lengths of at most 16 bits; no symbol gets the code of ones alone."""
        heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, -1, (-1,))]
        depth: dict[int, int] = defaultdict(int)
        heapq.heapify(heap)
        order = len(heap)
        while len(heap) > 1:
            (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                depth[s] += 1
            heapq.heappush(heap, (wa + wb, order, a + b))
            order += 1
        symbols = sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], s))
        counts = bytearray(16)
        for s in symbols:
            counts[depth[s] - 1] += 1
        return Huffman(bytes(counts), bytes(symbols))


# Code lengths follow from these rules of thumb: short runs and middling sizes are frequent.
DC_CODE = Huffman.of_weights({s: 2.0 ** -abs(s - 5) + 0.001 for s in range(12)})
AC_CODE = Huffman.of_weights({r << 4 | s: 0.25**r * (0.05, 0.15, 0.25, 0.35, 0.15, 0.04, 0.02, 0.001, 0.001, 0.001)[s - 1] + 4e-4 for r in range(16) for s in range(1, 11)} | {0x00: 0.02, 0xF0: 1e-3})
FIX_CODE = Huffman.of_weights({r << 4 | 1: 0.7**r + 0.001 for r in range(16)} | {0x00: 1.0, 0xF0: 0.02})


def _sizes(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def _extra(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (1 << sizes) - 1, values)


def _shift(values: np.ndarray) -> np.ndarray:
    """Halves towards zero, as AC coefficients are approximated."""
    return np.sign(values) * (np.abs(values) >> 1)


def _starts(bits: np.ndarray, owner: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens in order (bits each, interval each): first bit of each, first byte and last bit of each interval; intervals begin at bytes."""
    held = np.bincount(owner, weights=bits, minlength=intervals).astype(np.int64)
    sizes = (held + 7) >> 3
    first = np.cumsum(sizes) - sizes
    before = np.cumsum(bits) - bits
    at_start = np.cumsum(held) - held
    return before - at_start[owner] + first[owner] * 8, first, first * 8 + held


def _pad(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Each interval's bytes: ones after its last bit, and a zero byte after each byte of ones."""
    rest = -last & 7
    some = rest > 0
    data[(last[some] - 1) >> 3] |= ((1 << rest[some]) - 1).astype(np.uint8)
    raw, ends = data.tobytes(), ((last + 7) >> 3).tolist()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(first.tolist(), ends, strict=True)]


def _pack(values: np.ndarray, bits: np.ndarray, owner: np.ndarray, intervals: int) -> list[bytes]:
    """Tokens of at most 24 bits, end to end."""
    start, first, last = _starts(bits, owner, intervals)
    data = np.zeros((int(last[-1]) + 7 >> 3) + 4 if intervals else 4, np.uint8)
    if len(bits):
        at = start >> 3
        word = values << (32 - bits - (start & 7))
        heads = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))
        word = np.add.reduceat(word, heads)  # the bits of tokens do not overlap
        for k in range(4):
            data[at[heads] + k] += (word >> (24 - 8 * k) & 0xFF).astype(np.uint8)
    return _pad(data, first, last)


def _ac_first(blocks: np.ndarray, owner: np.ndarray, intervals: int) -> list[bytes]:
    """blocks: (many, band) coefficients, owner: interval of each block."""
    many, band = blocks.shape
    values = _shift(blocks)
    row, col = np.nonzero(values)
    value = values[row, col].astype(np.int64)
    before = np.where(np.concatenate(([True], row[1:] != row[:-1])), -1, np.concatenate(([-1], col[:-1]))) if len(row) else col
    run = col - before - 1
    size = _sizes(value)
    symbol = (run & 15) << 4 | size
    zrl = run >> 4
    last = np.full(many, -1)
    last[row] = col  # in order, so that the last one stays
    eob = last < band - 1
    ends = np.cumsum(eob) - eob  # end-of-block tokens before each block
    at = np.arange(len(row)) + np.cumsum(zrl) + ends[row]
    total = len(row) + int(zrl.sum()) + int(eob.sum())
    code, bits, who = np.full(total, AC_CODE.code[0xF0]), np.full(total, AC_CODE.length[0xF0]), np.zeros(total, np.int64)
    code[at] = AC_CODE.code[symbol] << size | _extra(value, size)
    bits[at] = AC_CODE.length[symbol] + size
    tokens = np.bincount(row, weights=1 + zrl, minlength=many).astype(np.int64) + eob
    stops = np.cumsum(tokens)
    code[stops[eob] - 1], bits[stops[eob] - 1] = AC_CODE.code[0], AC_CODE.length[0]
    who = np.repeat(owner, tokens)
    return _pack(code, bits, who, intervals)


def _ac_fix(blocks: np.ndarray, owner: np.ndarray, intervals: int) -> list[bytes]:
    """The last bits of all AC coefficients: symbols for those that become nonzero, a correction bit for each that is already."""
    many, band = blocks.shape
    size = np.abs(blocks)
    old, new = size > 1, size == 1
    zero_rank = np.cumsum(~old, axis=1)  # from 1
    row, col = np.nonzero(new)
    rank = zero_rank[row, col]
    head = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    run = rank - np.where(head, 0, np.concatenate(([0], rank[:-1]))) - 1 if len(row) else rank
    zrl = run >> 4
    last = np.full(many, -1)
    last[row] = col
    eob = last < band - 1
    tokens = np.bincount(row, weights=1 + zrl, minlength=many).astype(np.int64) + eob
    total = int(tokens.sum())
    symbol, sign, stop = np.full(total, 0xF0), np.full(total, -1), np.zeros(total, np.int64)
    ends = np.cumsum(eob) - eob
    at = np.arange(len(row)) + np.cumsum(zrl) + ends[row]
    symbol[at], sign[at], stop[at] = (run & 15) << 4 | 1, blocks[row, col] > 0, col
    if zrl.any():  # where 16 zeros are passed, a token ends at the sixteenth
        k = np.repeat(np.nonzero(zrl)[0], zrl[zrl > 0])
        nth = np.arange(len(k)) - np.repeat(np.cumsum(zrl[zrl > 0]) - zrl[zrl > 0], zrl[zrl > 0])
        passed = rank[k] - run[k] - 1 + 16 * (nth + 1)
        stop[at[k] - zrl[k] + nth] = np.argmax(zero_rank[row[k]] == passed[:, None], axis=1)
    closing = np.cumsum(tokens)[eob] - 1
    symbol[closing], stop[closing] = 0, band - 1
    block = np.repeat(np.arange(many), tokens)
    known = np.cumsum(old, axis=1)[block, stop] + np.concatenate(([0], np.cumsum(old.sum(axis=1))))[block]  # corrections up to each token's end
    fixes = np.diff(known, prepend=0)
    code_bits = FIX_CODE.length[symbol]
    bits = code_bits + (sign >= 0) + fixes
    start, first, final = _starts(bits, owner[block], intervals)
    flat = np.zeros(((int(final[-1]) + 7 >> 3) if intervals else 0) * 8, np.uint8)
    for k in range(int(code_bits.max(initial=0))):
        some = code_bits > k
        flat[start[some] + k] = FIX_CODE.code[symbol[some]] >> (code_bits[some] - 1 - k) & 1
    signed = sign >= 0
    flat[(start + code_bits)[signed]] = sign[signed]
    where = np.repeat(start + code_bits + signed - (known - fixes), fixes) + np.arange(int(fixes.sum()))
    flat[where] = (size[old] & 1).astype(np.uint8)
    return _pad(np.packbits(flat), first, final)


def _dc_first(dc: np.ndarray) -> list[bytes]:
    """dc: (MCUs, 6), already without the last bit; an interval for each MCU."""
    diff = dc.astype(np.int64).copy()
    diff[:, 1:4] -= dc[:, :3]
    value = diff.ravel()
    size = _sizes(value)
    return _pack(DC_CODE.code[size] << size | _extra(value, size), DC_CODE.length[size] + size, np.repeat(np.arange(len(dc)), MCU_BLOCKS), len(dc))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(components: tuple[int, ...], band: tuple[int, int], approximation: int, restart: int, intervals: list[bytes], table: int = 0) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, table]) for c in components) + bytes([*band, approximation])
    data = bytearray()
    for k, x in enumerate(intervals):
        if k:
            data += bytes((0xFF, 0xD0 + (k - 1) % 8))
        data += x
    return _segment(0xDD, struct.pack(">H", restart)) + _segment(0xDA, head) + bytes(data)


def layout(mcus: int) -> tuple[int, int]:
    """MCUs in a row, and rows."""
    wide = max(1, min(mcus, WIDEST))
    return wide, max(1, -(-mcus // wide))


def _planes(blocks: np.ndarray, wide: int, high: int) -> list[np.ndarray]:
    """From MCU order (MCUs, 6, 64) to each component's blocks in raster order."""
    luma = blocks[:, :4].reshape(high, wide, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    return [luma, blocks[:, 4], blocks[:, 5]]


def encode_images(images: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """images: (MCUs, 6, 64) coefficients in scan order, each MCU of four luma, a blue and a red chroma block; padded to whole rows here."""
    shapes = [layout(len(x)) for x in images]
    images = [np.concatenate([x, np.zeros((w * h - len(x), MCU_BLOCKS, BLOCK), x.dtype)]) if w * h > len(x) else x for x, (w, h) in zip(images, shapes, strict=True)]
    mcus = np.array([len(x) for x in images])
    everything = np.concatenate(images).astype(np.int32)
    planes = [_planes(x, w, h) for x, (w, h) in zip(images, shapes, strict=True)]
    scans: list[list[bytes]] = [[] for _ in images]

    def deal(found: list[bytes], sizes: list[int], *head: object) -> None:
        at = 0
        for out, n in zip(scans, sizes, strict=True):
            out.append(_scan(*head[:3], head[3], found[at : at + n], *head[4:]))
            at += n

    deal(_dc_first(everything[:, :, 0] >> 1), mcus.tolist(), (1, 2, 3), (0, 0), 0x01, 1)
    for component in range(3):
        blocks = np.concatenate([p[component] for p in planes]).astype(np.int32)
        sizes = [-(-len(p[component]) // RESTART_BLOCKS) for p in planes]
        owner = np.concatenate([np.arange(len(p[component])) // RESTART_BLOCKS + base for p, base in zip(planes, np.cumsum(sizes) - sizes, strict=True)])
        for band in BANDS:
            deal(_ac_first(blocks[:, band[0] : band[1] + 1], owner, sum(sizes)), sizes, (component + 1,), band, 0x01, RESTART_BLOCKS)
        deal(_ac_fix(blocks[:, 1:], owner, sum(sizes)), sizes, (component + 1,), (1, 63), 0x10, RESTART_BLOCKS, 1)
    last = everything[:, :, 0] & 1
    ends = np.cumsum(mcus)
    fixes = []
    for a, b in zip(ends - mcus, ends, strict=True):
        bits = last[a:b].ravel().astype(np.uint8)
        fixes.append(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00"))
    deal(fixes, [1] * len(images), (1, 2, 3), (0, 0), 0x10, 0)
    tables = b"".join(_segment(0xC4, bytes([at]) + h.segment) for at, h in ((0x00, DC_CODE), (0x10, AC_CODE), (0x11, FIX_CODE)))
    quant = _segment(0xDB, bytes([0]) + bytes([1]) * BLOCK)
    out = []
    for (w, h), comment, parts in zip(shapes, comments, scans, strict=True):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, h * 16, w * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"\xff\xd8" + _segment(0xFE, comment) + quant + frame + tables + b"".join(parts) + b"\xff\xd9")
    return out


@lru_cache(maxsize=64)
def _code(segment: bytes) -> Huffman:
    return Huffman(segment[:16], segment[16:])


class _Parsed:
    """Header fields and scans of one image; a scan is (key, intervals), where equal keys decode alike."""

    def __init__(self, data: bytes):
        self.comment, self.scans, tables, restart, at = b"", [], {}, 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while True:
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xC4:
                tables[body[0]] = body[1:]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDB and set(body[1:]) != {1}:
                raise ValueError("only quantization steps of 1 keep samples exactly")
            elif marker == 0xC2:
                _, height, width, _ = struct.unpack(">BHHB", body[:6])
                if body[6:] != bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]):
                    raise ValueError("only 2x2-subsampled chroma is read")
                self.wide, self.high = width // 16, height // 16
            elif marker == 0xDA:
                many = body[0]
                end = _MARKER.search(data, at).start()
                parts = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[at:end])]
                used = body[2]
                key = (tuple(body[1 : 1 + 2 * many : 2]), body[-3], body[-2], body[-1], restart, tables.get(used >> 4, b""), tables.get(0x10 | (used & 15), b""))
                self.scans.append((key, parts))
                at = end


class _Lanes:
    """Intervals laid end to end; read() takes bits of many of them at once."""

    def __init__(self, parts: list[bytes]):
        raw = b"".join(parts) + bytes(8)
        sizes = np.array([len(x) for x in parts], np.int64)
        self.begin = (np.cumsum(sizes) - sizes) * 8
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        self._words = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]
        self.bits = raw

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 32 bits."""
        return self._words[at >> 3] >> (8 - (at & 7)) & 0xFFFFFFFF


def _signed(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (raw < (1 << np.maximum(size, 1) - 1)), raw - (1 << size) + 1, raw)


def _read_dc(lanes: _Lanes, code: Huffman, out: np.ndarray) -> None:
    """out: (MCUs, 6); an interval for each MCU."""
    at = lanes.begin.copy()
    before = np.zeros(len(at), np.int64)
    for k in range(MCU_BLOCKS):
        word = lanes.peek(at)
        hit = code.table[word >> 16]
        size, used = hit & 0xFF, hit >> 8
        diff = _signed((word << used & 0xFFFFFFFF) >> (32 - size), size)
        before = diff + (before if k < 4 else 0)
        out[:, k] = before << 1
        at += used + size


def _read_ac_first(lanes: _Lanes, code: Huffman, out: np.ndarray, first: np.ndarray, many: np.ndarray, band: tuple[int, int]) -> None:
    """out: flat coefficients, 64 for each block; first, many: blocks of each interval."""
    at, base, left = lanes.begin.copy(), first * BLOCK, many.copy()
    k = np.full(len(at), band[0])
    while len(at):
        word = lanes.peek(at)
        hit = code.table[word >> 16]
        used, symbol = hit >> 8, hit & 0xFF
        size = symbol & 15
        value = _signed((word << used & 0xFFFFFFFF) >> (32 - size), size)
        k += symbol >> 4
        put = size > 0
        out[(base + k)[put]] = (value << 1)[put]
        k += 1
        at += used + size
        k[symbol == 0] = band[1] + 1
        over = k > band[1]
        if over.any():
            base[over] += BLOCK
            left[over] -= 1
            k[over] = band[0]
            live = left > 0
            if not live.all():
                at, base, left, k = at[live], base[live], left[live], k[live]



def _read_ac_fix(lanes: _Lanes, code: Huffman, out: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
    """Refines coefficients 1 to 63. A symbol's correction bits lie together, so they are read at the end, all at once."""
    blocks = out.reshape(-1, BLOCK)[:, 1:]
    old = blocks != 0
    zeros = np.cumsum(~old, axis=1)
    known = np.concatenate([np.zeros((len(old), 1), np.int64), np.cumsum(old, axis=1)], axis=1)
    order = np.argsort(old, axis=1, kind="stable")  # places of zeros, in order, come first
    count = zeros[:, -1]
    at, block, left = lanes.begin.copy(), first.copy(), many.copy()
    k = np.zeros(len(at), np.int64)
    starts, whose, begins, ends, puts, signs = [], [], [], [], [], []
    while len(at):
        word = lanes.peek(at)
        hit = code.table[word >> 16]
        used, symbol = hit >> 8, hit & 0xFF
        new = (symbol & 15) > 0
        sign = (word << used & 0xFFFFFFFF) >> 31
        passed = np.where(k > 0, zeros[block, np.maximum(k - 1, 0)], 0)
        target = passed + (symbol >> 4)
        stop = np.where(symbol == 0, 62, order[block, np.minimum(target, 62)])
        stop = np.where((symbol != 0) & (target >= count[block]), 62, stop)
        at += used + new
        fixes = known[block, stop + 1] - known[block, k]
        starts.append(at.copy())
        whose.append(block.copy())
        begins.append(known[block, k])
        ends.append(fixes)
        puts.append((block * BLOCK + 1 + stop)[new])
        signs.append(sign[new])
        at += fixes
        k = stop + 1
        over = k > 62
        if over.any():
            block[over] += 1
            left[over] -= 1
            k[over] = 0
            live = left > 0
            if not live.all():
                at, block, left, k = at[live], block[live], left[live], k[live]
    rows, cols = np.nonzero(old)
    offset = np.concatenate(([0], np.cumsum(old.sum(axis=1))))
    start, who, begin, fixes = (np.concatenate(x) for x in (starts, whose, begins, ends))
    step = np.arange(int(fixes.sum())) - np.repeat(np.cumsum(fixes) - fixes, fixes)
    bit_at = np.repeat(start, fixes) + step
    element = np.repeat(offset[who] + begin, fixes) + step
    data = np.frombuffer(lanes.bits, np.uint8)
    bits = data[bit_at >> 3] >> (7 - (bit_at & 7)) & 1
    place = rows[element] * BLOCK + 1 + cols[element]
    value = out[place]
    out[place] = value + np.where(value > 0, bits, -bits.astype(np.int64))
    out[np.concatenate(puts)] = np.where(np.concatenate(signs) > 0, 1, -1)


def _read_group(images: list[_Parsed]) -> list[np.ndarray]:
    mcus = np.array([p.wide * p.high for p in images])
    ends = np.cumsum(mcus)
    dc = np.zeros((int(ends[-1]), MCU_BLOCKS), np.int64)
    planes = [np.zeros(int(ends[-1]) * n * BLOCK, np.int64) for n in (4, 1, 1)]
    for k, (key, _) in enumerate(images[0].scans):
        components, low, high, approximation, restart, dc_table, ac_table = key
        parts = [x for p in images for x in p.scans[k][1]]
        if low == 0 and approximation == 0x01:
            _read_dc(_Lanes(parts), _code(dc_table), dc)
        elif low == 0:
            bits = [np.unpackbits(np.frombuffer(p.scans[k][1][0], np.uint8))[: n * MCU_BLOCKS] for p, n in zip(images, mcus, strict=True)]
            dc |= np.concatenate(bits).reshape(-1, MCU_BLOCKS)
        else:
            out = planes[components[0] - 1]
            blocks = mcus * (4 if components[0] == 1 else 1)
            counts = -(-blocks // restart)
            many = np.full(int(counts.sum()), restart)
            many[np.cumsum(counts) - 1] = blocks - (counts - 1) * restart
            first = np.cumsum(many) - many
            if approximation == 0x01:
                _read_ac_first(_Lanes(parts), _code(ac_table), out, first, many, (low, high))
            else:
                _read_ac_fix(_Lanes(parts), _code(ac_table), out, first, many)
    found = []
    for p, b, n in zip(images, ends, mcus, strict=True):
        a = b - n
        blocks = np.empty((n, MCU_BLOCKS, BLOCK), np.int64)
        luma = planes[0][a * 4 * BLOCK : b * 4 * BLOCK].reshape(p.high, 2, p.wide, 2, BLOCK)
        blocks[:, :4] = luma.transpose(0, 2, 1, 3, 4).reshape(n, 4, BLOCK)
        for c in (1, 2):
            blocks[:, 3 + c] = planes[c][a * BLOCK : b * BLOCK].reshape(n, BLOCK)
        blocks[:, :, 0] = dc[a:b]
        found.append(blocks)
    return found


def decode_images(files: list[bytes]) -> list[tuple[np.ndarray, tuple[int, int], bytes]]:
    """Of each file its coefficients (MCUs, 6, 64), (MCUs in a row, rows) and comment."""
    parsed = [_Parsed(x) for x in files]
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, p in enumerate(parsed):
        groups[tuple(key for key, _ in p.scans)].append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        for i, blocks in zip(members, _read_group([parsed[i] for i in members]), strict=True):
            out[i] = (blocks, (parsed[i].wide, parsed[i].high), parsed[i].comment)
    return out


def _transform() -> np.ndarray:
    """The inverse cosine transform's matrix in 1/4096: whole numbers, so that float64 products are exact in any order."""
    n = np.arange(8)
    scale = np.where(n == 0, 8**-0.5, 0.5)
    return np.round(4096 * scale[None, :] * np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16))


_INVERSE = _transform()


def to_rgb(blocks: np.ndarray) -> np.ndarray:
    """(MCUs, 16, 16, 3): inverse transform, chroma upsampled by repetition, colours converted in whole numbers."""
    plain = np.empty((len(blocks) * MCU_BLOCKS, BLOCK))
    plain[:, ZIGZAG] = blocks.reshape(-1, BLOCK)
    pixels = (_INVERSE @ plain.reshape(-1, 8, 8)) @ _INVERSE.T
    pixels = np.clip(np.floor(pixels / (1 << 24) + 128.5), 0, 255).astype(np.int32).reshape(-1, MCU_BLOCKS, 8, 8)
    y = pixels[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (pixels[:, c].repeat(2, axis=1).repeat(2, axis=2) - 128 for c in (4, 5))
    rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)], axis=-1)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def assemble(mcus: np.ndarray, wide: int, high: int) -> np.ndarray:
    """(height, width, 3) from to_rgb()'s MCUs."""
    return mcus.reshape(high, wide, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(high * 16, wide * 16, 3)
