"""Progressive JPEG codec whose coefficients carry bytes, and its tensors (op 6).

`write` stores bytes losslessly: every byte is one AC coefficient (256 more than the byte, so its size is constant)
of a 4:2:0 image with unit quantization, written as a progressive file: first and refining DC scans, spectral
selections 1-5 and 6-63 of the upper bits, and a successive-approximation scan of the last bit for each component.
`read` parses any progressive Huffman file with 8-bit samples, accumulates its scans into coefficient arrays, and
`rgb` inverse-transforms them in numpy, upsamples chroma and converts to a full-resolution RGB tensor. All
arithmetic is exact on integers, so equal bytes give equal tensors on every machine.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Coefficient order of the format.
def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
AC = 63  # payload bytes in a block
MCU_BYTES = 6 * AC  # four luma blocks and two chroma blocks
_BIAS = 256
BANDS = ((1, 5), (6, 63))


# --- writing -----------------------------------------------------------------------------------------------
def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as an entropy-coded segment: padded with ones, a zero byte after each FF."""
    raw = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
    return raw.replace(b"\xff", b"\xff\x00")


def _bit_matrix(values: np.ndarray, width: int) -> np.ndarray:
    return (values[..., None] >> np.arange(width - 1, -1, -1)).astype(np.uint8) & 1


def _table(kind: int, number: int, symbols: list[int]) -> bytes:
    """A Huffman table that gives the first symbols codes of equal length."""
    width = max(1, int(np.ceil(np.log2(len(symbols) + 1))))
    counts = [0] * 16
    counts[width - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | number, *counts, *symbols]))


def _scan(components: list[tuple[int, int, int]], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([i, dc << 4 | ac]) for i, dc, ac in components) + bytes([ss, se, ah << 4 | al])
    return _segment(0xDA, body) + _stuffed(bits)


#: Symbols: DC size 0; AC runs of zero with size 8; ends of band runs 0 to 14.
_SIZE8 = 0x08
_EOB = [r << 4 for r in range(15)]


def _eob_bits(run: int) -> np.ndarray:
    r = run.bit_length() - 1
    code = [r >> k & 1 for k in (3, 2, 1, 0)]
    return np.array(code + [run >> k & 1 for k in range(r - 1, -1, -1)], np.uint8)


#: Fixed value: units of 16 pixels in 65,535.
MOST = 4095


def geometry(n: int) -> tuple[int, int]:
    """Units of 16x16 pixels across and down that hold n bytes."""
    units = max(1, -(-n // MCU_BYTES))
    # an image has at most MOST units down, as its height is written in 16 bits; larger ones are wider
    across = max(min(64, units), -(-units // MOST))
    if across > MOST:
        raise ValueError("the payload does not fit an image of 65,535 x 65,535 pixels")
    return across, -(-units // across)


def write(payload: bytes) -> bytes:
    across, down = geometry(len(payload))
    data = np.zeros(across * down * MCU_BYTES, np.int32)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(down * across * 6, AC) + _BIAS
    luma, cb, cr = np.split(blocks, [down * across * 4, down * across * 5])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)))]
    out.append(_segment(0xDB, bytes([0] + [1] * 64)))
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out.append(_segment(0xC2, frame))
    out += [_table(0, 0, [0]), _table(1, 0, [_SIZE8]), _table(1, 1, _EOB)]
    whole = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    n = len(blocks)
    out.append(_scan(whole, 0, 0, 0, 1, np.zeros(n, np.uint8)))  # every DC difference is 0: code 0
    out.append(_scan(whole, 0, 0, 1, 0, np.zeros(n, np.uint8)))
    parts = ((1, luma), (2, cb), (3, cr))
    for i, own in parts:
        for ss, se in BANDS:
            upper = own[:, ss - 1 : se] >> 1  # 128 to 255: size 8, code 0, then the eight bits
            bits = np.zeros((*upper.shape, 9), np.uint8)
            bits[..., 1:] = _bit_matrix(upper, 8)
            out.append(_scan([(i, 0, 0)], ss, se, 0, 1, bits.ravel()))
    for i, own in parts:
        bits = []
        for at in range(0, len(own), 0x7FFF):
            some = own[at : at + 0x7FFF]
            bits += [_eob_bits(len(some)), (some & 1).astype(np.uint8).ravel()]
        out.append(_scan([(i, 0, 1)], 1, 63, 1, 0, np.concatenate(bits)))
    return b"".join(out) + b"\xff\xd9"


# --- reading -----------------------------------------------------------------------------------------------
@dataclass
class Component:
    number: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks of the padded grid
    down: int = 0
    own_across: int = 0  # blocks of the component alone
    own_down: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantization: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Huffman:
    """Canonical codes of one table."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for width in range(1, 17):
            for _ in range(counts[width - 1]):
                self.codes[width, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.of_symbol = {s: x for x, s in self.codes.items()}


class Bits:
    """Reader of one entropy-coded segment."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, h: Huffman) -> int:
        code = 0
        for width in range(1, 17):
            code = code << 1 | self.take(1)
            if (width, code) in h.codes:
                return h.codes[width, code]
        raise ValueError("a code that the table does not have")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _block_order(image: Image, chosen: list[Component]):
    """(component, block) in scan order."""
    if len(chosen) == 1:
        c = chosen[0]
        return [(c, r * c.across + k) for r in range(c.own_down) for k in range(c.own_across)]
    first = chosen[0]
    rows, cols = first.down // first.v, first.across // first.h
    return [(c, (r * c.v + y) * c.across + k * c.h + x) for r in range(rows) for k in range(cols) for c in chosen for y in range(c.v) for x in range(c.h)]


def _constant_first(bits: Bits, h: Huffman, cells: int, al: int):
    """Values of a first AC scan in which every coefficient has one symbol of run 0: found at a fixed stride.

    The stride is assumed from the first symbol and verified at every place; as codes are read in order, a stream
    that holds this symbol at each place is decoded right. None if it does not.
    """
    start = bits.at
    s = bits.symbol(h)
    bits.at = start
    size = s & 15
    if s >> 4 or not size:
        return None
    width, code = h.of_symbol[s]
    stride = width + size
    if len(bits.bits) < cells * stride:
        return None
    grid = bits.bits[: cells * stride].reshape(cells, stride)
    if any((grid[:, k] != (code >> (width - 1 - k) & 1)).any() for k in range(width)):
        return None
    v = np.zeros(cells, np.int32)
    for k in range(size):
        v = v << 1 | grid[:, width + k]
    low = v >> (size - 1) == 0
    return np.where(low, v - (1 << size) + 1, v) << al


def _own_cells(c: Component) -> np.ndarray:
    return (np.arange(c.own_down)[:, None] * c.across + np.arange(c.own_across)).ravel()


def _ac_first(bits: Bits, h: Huffman, c: Component, ss: int, se: int, al: int) -> None:
    cells = _own_cells(c)
    got = _constant_first(bits, h, len(cells) * (se - ss + 1), al) if len(cells) else None
    if got is not None:
        c.coefficients[cells[:, None], ZIGZAG[ss : se + 1]] = got.reshape(len(cells), -1)
        return
    skip = 0
    for cell in cells.tolist():
        if skip:
            skip -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(bits.symbol(h), 16)
            if s:
                k += r
                c.coefficients[cell, ZIGZAG[k]] = bits.signed(s) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                skip = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(bits: Bits, h: Huffman, c: Component, ss: int, se: int, al: int) -> None:
    cells, zz, step = _own_cells(c), ZIGZAG[ss : se + 1], 1 << al
    i = 0
    while i < len(cells):
        own = c.coefficients[cells[i]]
        k = ss
        run = 0
        while k <= se:
            r, s = divmod(bits.symbol(h), 16)
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                break
            value = 0 if not s else (step if bits.take(1) else -step)
            while k <= se:
                z = ZIGZAG[k]
                if own[z]:
                    if bits.take(1):
                        own[z] += step if own[z] > 0 else -step
                elif r == 0:
                    if value:
                        own[z] = value
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if not run:
            i += 1
            continue
        # an end of band run: only coefficients that are not zero have a bit, so all of them come at once
        where = [(cells[i], z) for z in ZIGZAG[k : se + 1]] if k > ss else []
        whole = cells[i + (k > ss) : i + run]
        for cell, z in where:
            if c.coefficients[cell, z]:
                c.coefficients[cell, z] += bits.take(1) * (step if c.coefficients[cell, z] > 0 else -step)
        v = c.coefficients[whole[:, None], zz]
        there = v != 0
        n = int(there.sum())
        v[there] += bits.bits[bits.at : bits.at + n].astype(np.int32) * np.where(v[there] > 0, step, -step)
        bits.at += n
        c.coefficients[whole[:, None], zz] = v
        i += run


def _dc(image: Image, bits: Bits, tables, chosen, ah: int, al: int) -> None:
    order = _block_order(image, [c for c, _, _ in chosen])
    if ah:
        got = bits.bits[: len(order)].tolist()
        for (c, cell), b in zip(order, got):
            if b:
                c.coefficients[cell, 0] |= 1 << al
        return
    h = {c.number: tables[0, t] for c, t, _ in chosen}
    zero = {t.of_symbol.get(0) for t in h.values()}
    if len(zero) == 1 and None not in zero:  # all differences may be 0
        width, code = zero.pop()
        grid = bits.bits[: len(order) * width].reshape(-1, width)
        if len(grid) == len(order) and all((grid[:, k] == (code >> (width - 1 - k) & 1)).all() for k in range(width)):
            return
    last = dict.fromkeys(h, 0)
    for c, cell in order:
        last[c.number] += bits.signed(bits.symbol(h[c.number]))
        c.coefficients[cell, 0] = last[c.number] * (1 << al)


def read(raw: bytes) -> Image:
    """Parse a progressive file and accumulate its scans."""
    image, tables, at = Image(), {}, 2
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(raw):
        marker, size = raw[at + 1], 0
        if marker == 0xD9:
            break
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                precision, number = divmod(body[0], 16)
                width = 128 if precision else 64
                values = np.frombuffer(body[1 : 1 + width], ">u2" if precision else np.uint8).astype(np.int64)
                image.quantization[number] = np.zeros(64, np.int64)
                image.quantization[number][ZIGZAG] = values
                body = body[1 + width :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[divmod(body[0], 16)] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8-bit samples are read")
            for k in range(n):
                number, hv, table = body[6 + 3 * k : 9 + 3 * k]
                image.components.append(Component(number, hv >> 4, hv & 15, table))
            most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
            cols, rows = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            for c in image.components:
                c.across, c.down = cols * c.h, rows * c.v
                c.own_across = -(-(-(-image.width * c.h // most_h)) // 8)
                c.own_down = -(-(-(-image.height * c.v // most_v)) // 8)
                c.coefficients = np.zeros((c.across * c.down, 64), np.int32)
        elif marker in (0xC0, 0xC1) or 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals are not read")
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDA:
            end = at
            while True:  # the next marker that is not a stuffed FF
                end = raw.index(b"\xff", end)
                if raw[end + 1] != 0:
                    break
                end += 2
            bits = Bits(raw[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
            n = body[0]
            by = {c.number: c for c in image.components}
            chosen = [(by[body[1 + 2 * k]], *divmod(body[2 + 2 * k], 16)) for k in range(n)]
            ss, se, approximation = body[1 + 2 * n : 4 + 2 * n]
            ah, al = divmod(approximation, 16)
            if ss == 0:
                _dc(image, bits, tables, chosen, ah, al)
            elif ah == 0:
                _ac_first(bits, tables[1, chosen[0][2]], chosen[0][0], ss, se, al)
            else:
                _ac_refine(bits, tables[1, chosen[0][2]], chosen[0][0], ss, se, al)
    return image


def stored(image: Image) -> bytes:
    """The bytes that `write` put into an image."""
    (n,) = struct.unpack(">Q", image.comments[0])
    blocks = [c.coefficients[:, ZIGZAG[1:]] for c in image.components]
    return (np.concatenate(blocks).ravel()[:n] - _BIAS).astype(np.uint8).tobytes()


# --- pixels ------------------------------------------------------------------------------------------------
_SCALE = 12
_BASIS = np.rint(
    np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)]) * (1 << _SCALE)
)


def samples(c: Component, quantization: np.ndarray) -> np.ndarray:
    """The inverse transform of a component as a plane of 0..255. Sums of integers below 2**53, so exact in doubles."""
    f = (c.coefficients * quantization).astype(np.float64).reshape(-1, 8, 8)
    p = (f.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8)
    p = (p.transpose(0, 2, 1).reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    p = np.floor((p + float(1 << (2 * _SCALE - 1))) / float(1 << (2 * _SCALE))) + 128
    p = np.clip(p, 0, 255).astype(np.uint8)
    return p.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8)


def rgb(image: Image) -> np.ndarray:
    """Height x width x 3 tensor of bytes; chroma is repeated to full resolution."""
    planes = []
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        p = samples(c, image.quantization[c.table])
        p = p.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)
        planes.append(p[: image.height, : image.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, b, r = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    red = (y + 91881 * r + half) >> 16
    green = (y - 22554 * b - 46802 * r + half) >> 16
    blue = (y + 116130 * b + half) >> 16
    return np.clip(np.stack([red, green, blue], 2), 0, 255).astype(np.uint8)
