"""Progressive JPEG: a decoder to full-resolution RGB tensors, and a lossless carrier of bytes in coefficients.

``decode`` reads every scan into coefficient arrays: DC scans (first and refining), AC scans of any spectral band (first and
refining, with end-of-band runs). ``rgb`` dequantises, inverse-transforms and upsamples them. Where the bits of a scan have
one possible layout (refining DC bits; the correction bits of an end-of-band run; a table of a single symbol) they are read
as arrays; all else goes symbol by symbol.

``encode`` stores 64 bytes in each 8x8 block as quantised coefficients, which a progressive file keeps exactly: the DC
coefficient is a byte's value, an AC coefficient has magnitude 128 + (byte & 127) and the byte's top bit as its sign. Blocks
fill 4:2:0 units of four Y, one Cb and one Cr block in turn. Scans: DC bit plane by bit plane; for each component the bands
1-5 and 6-63, first without their lowest bit, then refined by it. A comment segment holds the payload's length.
"""

from __future__ import annotations

import math

import numpy as np

# Zigzag order of an 8x8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
BANDS = ((1, 5), (6, 63))
MOST_UNITS = 4095  # units of 16 pixels in a row or column
LONGEST_RUN = 32767  # blocks of an end-of-band run
_u, _x = np.mgrid[0:8, 0:8]
DCT = (np.where(_u == 0, math.sqrt(0.5), 1.0) * np.cos((2 * _x + 1) * _u * math.pi / 16) / 2).astype(np.float32)
_b = np.arange(256)
_half = (128 + (_b & 127)) >> 1
FIRST = np.where(_b & 128, 127 ^ _half, _half).astype(np.uint8)  # a zero code bit and seven bits of half the coefficient
_COM = b"payload "


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table of one symbol with code 0, or of two with codes 0 and 10."""
    return _segment(0xC4, bytes([kind << 4]) + bytes([1, len(symbols) - 1] + [0] * 14) + bytes(symbols))


def _scan(components: list[int], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled with ones."""
    gap = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(gap, np.uint8)]) if gap else bits).tobytes()


def shape(blocks: int) -> tuple[int, int]:
    """Rows and columns of units that hold so many blocks."""
    units = max(1, -(-blocks // 6))
    rows = -(-units // MOST_UNITS)
    return rows, -(-units // rows)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, whose length is a multiple of 64."""
    blocks = len(payload) // 64
    rows, cols = shape(blocks)
    grid = np.zeros((rows * cols * 6, 64), np.uint8)
    grid[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    frame = bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, _COM + str(len(payload)).encode()), _segment(0xDB, bytes(65)[:1] + b"\x01" * 64), _segment(0xC2, frame), _table(0, [0])]
    dc = grid[:, 0]
    out.append(_scan([1, 2, 3], 0, 0, 0, 8, _packed(np.zeros(len(dc), np.uint8))))
    planes = np.unpackbits(dc[:, None], axis=1)
    out += [_scan([1, 2, 3], 0, 0, al + 1, al, _packed(planes[:, 7 - al])) for al in range(7, -1, -1)]
    units = grid.reshape(rows, cols, 6, 64)
    out.append(_table(1, [7]))
    component = [units[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64), units[:, :, 4].reshape(-1, 64), units[:, :, 5].reshape(-1, 64)]
    for c, part in enumerate(component):
        out += [_scan([c + 1], ss, se, 0, 1, FIRST[part[:, ss : se + 1]].tobytes()) for ss, se in BANDS]
    for c, part in enumerate(component):
        runs = [LONGEST_RUN] * (len(part) // LONGEST_RUN) + [len(part) % LONGEST_RUN] * bool(len(part) % LONGEST_RUN)
        sizes = [n.bit_length() - 1 for n in runs]
        symbols = list(dict.fromkeys(r << 4 for r in sizes))
        out.append(_table(1, symbols))
        for ss, se in BANDS:
            low, bits, at = part[:, ss : se + 1] & 1, [], 0
            for n, r in zip(runs, sizes):
                code = "0" if symbols[0] == r << 4 else "10"
                head = code + (format(n - (1 << r), f"0{r}b") if r else "")
                bits += [np.array(list(map(int, head)), np.uint8), low[at : at + n].ravel()]
                at += n
            out.append(_scan([c + 1], ss, se, 1, 0, _packed(np.concatenate(bits))))
    out.append(b"\xff\xd9")
    return b"".join(out)


class Bits:
    """Bits of one scan's data, most significant first."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | bit
        self.at += n
        return value

    def array(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        length = code = 0
        while (length, code) not in codes:
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            length += 1
            if length > 16:
                raise ValueError("bad Huffman code")
        return codes[length, code]


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Image:
    """Coefficients (int16, zigzag order) of each component as (block rows, block columns, 64), with its sampling and quantisation."""

    def __init__(self):
        self.height = self.width = 0
        self.components: dict[int, dict] = {}
        self.payload_bytes: int | None = None


def decode(data: bytes) -> Image:
    image, quant, tables, at = Image(), {}, {}, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9:
            break
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE and body.startswith(_COM):
            image.payload_bytes = int(body[len(_COM) :])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                lengths = body[1:17]
                code, k, codes = 0, 17, {}
                for length, n in enumerate(lengths, 1):
                    for _ in range(n):
                        codes[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0] >> 4, body[0] & 15] = codes
                body = body[k:]
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            image.h, image.v = max(p[1] for p in parts), max(p[2] for p in parts)
            image.rows, image.cols = -(-image.height // (8 * image.v)), -(-image.width // (8 * image.h))
            for c, h, v, q in parts:
                image.components[c] = {"h": h, "v": v, "q": q, "coef": np.zeros((image.rows * v, image.cols * h, 64), np.int16)}
        elif marker in (0xC0, 0xC1, 0xC3) or marker == 0xDD and any(body):
            raise ValueError("only progressive Huffman files without restarts")
        elif marker == 0xDA:
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] not in (0, 0xFF):
                    break
                end += 2 if data[end + 1] == 0 else 1
            n = body[0]
            used = [(image.components[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            raw = data[at:end].replace(b"\xff\x00", b"\xff")
            if ss == 0:
                _dc_scan(image, used, tables, raw, ah, al)
            else:
                comp, _, table = used[0]
                # a scan of one component has only the blocks that the image needs
                high = -(-image.height * comp["v"] // (8 * image.v))
                wide = -(-image.width * comp["h"] // (8 * image.h))
                band = comp["coef"][:high, :wide].reshape(-1, 64)
                part = np.ascontiguousarray(band[:, ss : se + 1])
                (_ac_refine if ah else _ac_first)(part, tables[1, table], raw, al)
                comp["coef"][:high, :wide, ss : se + 1] = part.reshape(high, wide, -1)
            at = end
    for comp in image.components.values():
        comp["quant"] = quant[comp["q"]]
    return image


def _dc_order(image: Image, used: list) -> list[tuple[int, np.ndarray]]:
    """For each block of a unit, its component's place in the scan and the flat indices of its blocks in scan order."""
    if len(used) == 1:
        comp = used[0][0]
        high, wide = -(-image.height * comp["v"] // (8 * image.v)), -(-image.width * comp["h"] // (8 * image.h))
        return [(0, (np.arange(high)[:, None] * comp["coef"].shape[1] + np.arange(wide)).ravel())]
    order = []
    for k, (comp, *_) in enumerate(used):
        for y in range(comp["v"]):
            for x in range(comp["h"]):
                order.append((k, ((np.arange(image.rows)[:, None] * comp["v"] + y) * comp["coef"].shape[1] + np.arange(image.cols) * comp["h"] + x).ravel()))
    return order


def _dc_scan(image: Image, used: list, tables: dict, raw: bytes, ah: int, al: int) -> None:
    order = _dc_order(image, used)
    units = len(order[0][1])
    flat = [comp["coef"].reshape(-1, 64) for comp, *_ in used]
    if ah:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: units * len(order)].reshape(units, -1)
        for i, (k, at) in enumerate(order):
            flat[k][at, 0] |= bits[:, i].astype(np.int16) << al
        return
    if all([*tables[0, table].values()] == [0] for _, table, _ in used):
        return  # every difference is zero
    bits, last = Bits(raw), [0] * len(used)
    for u in range(units):
        for k, at in order:
            size = bits.symbol(tables[0, used[k][1]])
            last[k] += _extend(bits.take(size), size)
            flat[k][at[u], 0] = last[k] << al


def _ac_first(part: np.ndarray, codes: dict, raw: bytes, al: int) -> None:
    n, width = part.shape
    if len(codes) == 1:
        ((length, _), symbol), = codes.items()
        size = symbol & 15
        if symbol >> 4 == 0 and size:  # every coefficient has the same number of bits
            step = length + size
            if step == 8:
                value = (np.frombuffer(raw, np.uint8)[: n * width] & ((1 << size) - 1)).astype(np.int16)
            else:
                bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: n * width * step].reshape(-1, step)[:, length:]
                value = (bits @ (1 << np.arange(size - 1, -1, -1))).astype(np.int16)
            value = np.where(value >> (size - 1), value, value - np.int16((1 << size) - 1))
            part[:] = value.reshape(n, width) << np.int16(al)
            return
    bits, run = Bits(raw), 0
    for row in part:
        if run:
            run -= 1
            continue
        k = 0
        while k < width:
            symbol = bits.symbol(codes)
            r, size = symbol >> 4, symbol & 15
            if size:
                k += r
                row[k] = _extend(bits.take(size), size) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(part: np.ndarray, codes: dict, raw: bytes, al: int) -> None:
    bits, n, at = Bits(raw), len(part), 0
    step = np.int16(1 << al)

    def correct(rows: np.ndarray) -> None:
        """The next bits belong to the coefficients that are not zero."""
        where = np.nonzero(rows)
        old = rows[where]
        rows[where] = old + np.where(bits.array(len(old)), np.where(old > 0, step, -step), 0).astype(np.int16)

    while at < n:
        row, k = part[at], 0
        while k < part.shape[1]:
            symbol = bits.symbol(codes)
            r, size = symbol >> 4, symbol & 15
            if not size and r < 15:
                run = (1 << r) + bits.take(r)
                correct(row[k:])
                if run > 1:
                    correct(part[at + 1 : at + run])
                at += run - 1
                break
            new = step if size and bits.take(1) else -step
            while k < part.shape[1]:
                if row[k]:
                    correct(row[k : k + 1])
                elif r == 0:
                    if size:
                        row[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        at += 1


def _pixels(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (before the level shift) of (rows, columns, 64) zigzag coefficients."""
    rows, cols = coef.shape[:2]
    natural = np.empty((rows * cols, 64), np.float32)
    natural[:, ZIGZAG] = coef.reshape(-1, 64) * quant
    half = (natural.reshape(-1, 8) @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1)  # along x
    full = (half.reshape(-1, 8) @ DCT).reshape(rows, cols, 8, 8)  # (.., x, y)
    return full.transpose(0, 3, 1, 2).reshape(8 * rows, 8 * cols)


def rgb(image: Image, first: int = 0, last: int | None = None) -> np.ndarray:
    """The RGB tensor (height, width, 3) of all units or of the unit columns [first, last); chroma is upsampled by repetition."""
    last = image.cols if last is None else last
    planes = []
    for comp in image.components.values():
        p = _pixels(comp["coef"][:, first * comp["h"] : last * comp["h"]], comp["quant"])
        planes.append(np.repeat(np.repeat(p, image.v // comp["v"], axis=0), image.h // comp["h"], axis=1))
    y = planes[0] + 128
    if len(planes) == 1:
        out = np.stack([y, y, y], axis=-1)
    else:
        cb, cr = planes[1:3]
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    out = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return out[: image.height, : max(0, image.width - 8 * image.h * first)]


def payload(image: Image) -> bytes:
    """The bytes that ``encode`` stored."""
    y, cb, cr = (image.components[c]["coef"] for c in (1, 2, 3))
    rows, cols = image.rows, image.cols
    grid = np.empty((rows, cols, 6, 64), np.int16)
    grid[:, :, :4] = y.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
    grid[:, :, 4], grid[:, :, 5] = cb, cr
    flat = grid.reshape(-1, 64)
    out = ((np.abs(flat) & 127) | np.where(flat < 0, 128, 0)).astype(np.uint8)
    out[:, 0] = flat[:, 0]
    return out.tobytes()[: image.payload_bytes]
