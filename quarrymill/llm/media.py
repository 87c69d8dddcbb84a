"""Progressive JPEG: lossless payloads in coefficients, scans accumulated, full-resolution RGB tensors.

``read_coefficients`` reads progressive JPEG files: it accumulates the spectral-selection and successive-approximation
scans of any number of components into coefficient arrays; ``rgb_tensor`` dequantizes and inverse-transforms all blocks
at once in numpy, upsamples the chroma planes and converts to RGB. Scans whose codes together with their value bits
always have one width are read as arrays through a table, runs of blocks whose refinement bits follow without codes as
arrays of bits; all else is read symbol by symbol.

``store`` writes a payload as such a file, a byte a coefficient of a 4:2:0 picture with quantization 1 (the format's
unit is the coefficient). DC holds the byte itself; AC holds the sign and 128 plus the byte's low seven bits. The first
scans leave the lowest bit to a second, refining one; luminance AC comes in two spectral bands. Code lengths are chosen
so that each first scan takes a byte a coefficient: a DC difference of k bits has a code of 8 - k, an AC value of seven
bits a code of one. So the payload comes back bit by bit from the coefficient arrays. A comment segment holds its
length; blocks beyond it are zero bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import map_batches, slices, table

UNIT = 64
BANDS = ((1, 5), (6, 63))  # of the luminance; chroma has one band
MOST_RUN = 32_767
TAG = b"payload="

_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: diagonals in turn, upwards on the even ones."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_K, _X = np.mgrid[0:8, 0:8]
BASIS = np.where(_K == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _X + 1) * _K * np.pi / 16)
#: Samples of a block (row by row) that a unit of each zigzag coefficient makes.
SAMPLES = np.einsum("ux,vy->uvxy", BASIS, BASIS).reshape(64, 64)[ZIGZAG]


# Writing


def _dc_codes() -> np.ndarray:
    """The byte of each difference from -127 to 127: 7 - k ones and a zero, then the k bits of the value."""
    out = np.zeros(255, np.uint8)
    for d in range(-127, 128):
        k = abs(d).bit_length()
        out[d + 127] = (0xFF << (k + 1) & 0xFF) | (d if d > 0 else d + (1 << k) - 1)
    return out


def _ac_codes() -> np.ndarray:
    """The byte of each payload byte without its lowest bit: a zero, then the seven bits of the value."""
    b = np.arange(256)
    top = 64 + ((b & 127) >> 1)
    return np.where(b < 128, 127 - top, top).astype(np.uint8)


_DC_CODE, _AC_CODE = _dc_codes(), _ac_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, place: int, symbols: list[int]) -> bytes:
    """A table of codes 0, 10, 110, ... for the symbols in order."""
    return _segment(0xC4, bytes([kind << 4 | place, *(1 if i < len(symbols) else 0 for i in range(16)), *symbols]))


def _scan_head(components: tuple[int, ...], place: int, band: tuple[int, int], high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, place)), *band, high << 4 | low]))


@lru_cache(maxsize=256)
def _mcu_order(across: int, down: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Index of each block, in the order Y plane, Cb, Cr, as an interleaved scan of a 4:2:0 picture meets them; the places of each component there."""
    y, x = np.mgrid[0:down, 0:across]
    wide = 2 * across
    luma = [(2 * y + v) * wide + 2 * x + h for v in (0, 1) for h in (0, 1)]
    chroma = [4 * across * down + k * across * down + y * across + x for k in (0, 1)]
    order = np.stack([*luma, *chroma], axis=-1).ravel()
    plane = across * down
    return order, tuple(np.flatnonzero((order >= lo) & (order < hi)) for lo, hi in ((0, 4 * plane), (4 * plane, 5 * plane), (5 * plane, 6 * plane)))


@lru_cache(maxsize=256)
def _plan(across: int, down: int) -> dict:
    """What files of one size share: the segments before each scan, and the codes of the runs in the refining scans."""
    plane = across * down
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC2, frame) + _huffman(0, 0, list(range(7, -1, -1))) + _huffman(1, 0, [7])
    first = [(_scan_head((c,), 0, band, 0, 1), c, band) for c, bands in ((1, BANDS), (2, ((1, 63),)), (3, ((1, 63),))) for band in bands]
    more = []
    for c, blocks in ((1, 4 * plane), (2, plane), (3, plane)):
        runs = [(at, min(MOST_RUN, blocks - at)) for at in range(0, blocks, MOST_RUN)]
        orders = sorted({n.bit_length() - 1 for _, n in runs})
        coded = []
        for at, n in runs:
            o = n.bit_length() - 1
            coded.append((at, n, np.array([1] * orders.index(o) + [0] + [n >> i & 1 for i in range(o - 1, -1, -1)], np.uint8)))
        more.append((_huffman(1, 1, [o << 4 for o in orders]) + _scan_head((c,), 1, (1, 63), 1, 0), c, coded))
    return {"head": head, "dc": _scan_head((1, 2, 3), 0, (0, 0), 0, 1), "first": first, "dc_more": _scan_head((1, 2, 3), 0, (0, 0), 1, 0), "more": more}


def _packed(bits: list[np.ndarray]) -> bytes:
    """The bits, filled up with ones, as entropy-coded bytes."""
    rest = -sum(map(len, bits)) % 8
    return np.packbits(np.concatenate([*bits, np.ones(rest, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def store(payload: bytes) -> bytes:
    """The payload, a positive multiple of 64 bytes, as a progressive JPEG file."""
    n = len(payload) // UNIT
    if not n or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    across = max(1, int(np.ceil(np.sqrt(n / 6))))
    down = -(-n // (6 * across))
    plane = across * down
    data = np.zeros((6 * plane, UNIT), np.uint8)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    rows = {1: data[: 4 * plane], 2: data[4 * plane : 5 * plane], 3: data[5 * plane :]}
    plan, (order, parts) = _plan(across, down), _mcu_order(across, down)
    dc = data[order, 0]
    top = (dc >> 1).astype(np.int16)
    steps = np.empty_like(top)
    for places in parts:
        own = top[places]
        own[1:] -= top[places[:-1]]
        steps[places] = own
    # neither kind of byte is ever 255: nothing is stuffed in the first scans
    out = [b"\xff\xd8", _segment(0xFE, TAG + str(len(payload)).encode()), plan["head"], plan["dc"], _DC_CODE[steps + 127].tobytes()]
    coded = _AC_CODE[data]
    for head, c, (lo, hi) in plan["first"]:
        at = 0 if c == 1 else (c + 2) * plane
        out += [head, coded[at : at + len(rows[c]), lo : hi + 1].tobytes()]
    out += [plan["dc_more"], _packed([dc & 1])]
    low = data[:, 1:] & 1
    for head, c, runs in plan["more"]:
        at = 0 if c == 1 else (c + 2) * plane
        out += [head, _packed([x for start, length, code in runs for x in (code, low[at + start : at + start + length].ravel())])]
    return b"".join([*out, b"\xff\xd9"])


# Reading


class _Codes:
    """A Huffman table: symbols by (length, code), and by value where code and value bits always have ``width`` bits."""

    def __init__(self, body: bytes, kind: int):
        self.codes: dict[tuple[int, int], int] = {}
        code, pos = 0, 16
        for length, n in enumerate(body[:16], 1):
            for _ in range(n):
                self.codes[length, code] = body[pos]
                code, pos = code + 1, pos + 1
            code <<= 1
        widths = {length + s for (length, _), s in self.codes.items()}
        self.width = widths.pop() if len(widths) == 1 and all(s < 16 and (s or not kind) for s in self.codes.values()) else 0
        if self.width > 12:
            self.width = 0
        if self.width:
            self.values = np.full(1 << self.width, MISSING, np.int16)
            for (length, code), size in self.codes.items():
                self.values[code << size : (code + 1) << size] = _extend(np.arange(1 << size), size)


MISSING = np.iinfo(np.int16).min


@lru_cache(maxsize=1024)
def _tables(body: bytes) -> tuple[tuple[int, _Codes], ...]:
    """Place and codes of each table of a segment."""
    out = []
    while body:
        size = 17 + sum(body[1:17])
        out.append((body[0], _Codes(body[1:size], body[0] >> 4)))
        body = body[size:]
    return tuple(out)


class _Bits:
    """Bits of a run of entropy-coded bytes; past the end it reads ones, as padding does."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self._bits = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8), 0, None

    def take(self, n: int) -> int:
        value = 0
        for b in self.array(n).tolist():
            value = value << 1 | b
        return value

    def array(self, n: int) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(self.raw)
        got = self._bits[self.at : self.at + n]
        self.at += n
        return got if len(got) == n else np.concatenate([got, np.ones(n - len(got), np.uint8)])

    def values(self, n: int, codes: _Codes) -> np.ndarray:
        """The next ``n`` values of a table of one width."""
        if codes.width == 8 and self.at % 8 == 0 and len(self.raw) >= self.at // 8 + n:
            got = codes.values[self.raw[self.at // 8 : self.at // 8 + n]]
            self.at += 8 * n
        else:
            weights = 1 << np.arange(codes.width - 1, -1, -1)
            got = codes.values[self.array(n * codes.width).reshape(n, codes.width) @ weights]
        if n and got.min() == MISSING:
            raise ValueError("no such code")
        return got

    def symbol(self, codes: _Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.array(1)[0])
            if (length, code) in codes.codes:
                return codes.codes[length, code]
        raise ValueError("no such code")


def _extend(value, size: int):
    return np.where(value < 1 << (size - 1), value - (1 << size) + 1, value) if size else value


class _Component:
    def __init__(self, h: int, v: int, quant: int):
        self.h, self.v, self.quant = h, v, quant

    def lay_out(self, width: int, height: int, hmax: int, vmax: int) -> None:
        self.across, self.down = -(-(-(-width * self.h // hmax)) // 8), -(-(-(-height * self.v // vmax)) // 8)
        self.wide, self.tall = -(-width // (8 * hmax)) * self.h, -(-height // (8 * vmax)) * self.v
        self.coefs = np.zeros((self.tall * self.wide, 64), np.int16)
        self.own, self.alone = _own_blocks(self.across, self.down, self.wide)

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return self.h, self.v, self.wide, self.tall


@lru_cache(maxsize=1024)
def _own_blocks(across: int, down: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each block that a scan of the component alone meets; a zero for each, its component there."""
    own = (np.arange(down)[:, None] * wide + np.arange(across)).ravel()
    return own, np.zeros_like(own)


@lru_cache(maxsize=256)
def _interleaved(shapes: tuple[tuple[int, int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Component and block of each block of an interleaved scan."""
    h0, v0, wide0, tall0 = shapes[0]
    my, mx = np.mgrid[0 : tall0 // v0, 0 : wide0 // h0]
    which, where = [], []
    for k, (h_, v_, wide, _) in enumerate(shapes):
        for v in range(v_):
            for h in range(h_):
                which.append(np.full(my.shape, k)), where.append((my * v_ + v) * wide + mx * h_ + h)
    return np.stack(which, -1).ravel(), np.stack(where, -1).ravel()


@lru_cache(maxsize=256)
def _by_component(shapes: tuple[tuple[int, int, int, int], ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each component, its places in an interleaved scan and the blocks there."""
    which, where = _interleaved(shapes)
    return [(sel := np.flatnonzero(which == k), where[sel]) for k in range(len(shapes))]


def _rows(where: np.ndarray):
    """The rows as a slice, which numpy needn't copy, if they follow each other."""
    first, last = int(where[0]), int(where[-1])
    return slice(first, last + 1) if last - first + 1 == len(where) else where


def _read_dc(parts, bits: _Bits, tables, which, where, high: int, low: int, whole: bool) -> None:
    def split() -> list[tuple[np.ndarray, np.ndarray]]:
        if whole and len(parts) > 1:
            return _by_component(tuple(p.shape for p in parts))
        return [(sel := np.flatnonzero(which == k), where[sel]) for k in range(len(parts))]

    if high:
        fresh = bits.array(len(where)).astype(np.int16) << low
        for p, (sel, rows) in zip(parts, split()):
            p.coefs[rows, 0] |= fresh[sel]
        return
    if tables[0].width and all(t is tables[0] for t in tables):
        steps = bits.values(len(where), tables[0])
        for p, (sel, rows) in zip(parts, split()):
            p.coefs[rows, 0] = steps[sel].cumsum(dtype=np.int16) << low
        return
    before = [0] * len(parts)
    for k, b in zip(which.tolist(), where.tolist()):
        size = bits.symbol(tables[k])
        before[k] += int(_extend(bits.take(size), size))
        parts[k].coefs[b, 0] = before[k] << low


def _read_ac_first(part, bits: _Bits, codes: _Codes, where, lo: int, hi: int, low: int) -> None:
    if codes.width:
        n = hi - lo + 1
        part.coefs[_rows(where), lo : hi + 1] = (bits.values(len(where) * n, codes) << low).reshape(len(where), n)
        return
    run = 0
    for b in where.tolist():
        if run:
            run -= 1
            continue
        k = lo
        while k <= hi:
            s = bits.symbol(codes)
            r, size = s >> 4, s & 15
            if size:
                k += r
                part.coefs[b, k] = int(_extend(bits.take(size), size)) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _read_ac_more(part, bits: _Bits, codes: _Codes, where, lo: int, hi: int, low: int) -> None:
    step, i = 1 << low, 0

    def correct(rows: np.ndarray, first: int) -> None:
        """A bit for each coefficient of the blocks that isn't zero, from ``first`` on in the first block."""
        got = part.coefs[_rows(rows), lo : hi + 1]
        if first == lo and got.all():
            fresh = bits.array(got.size).reshape(got.shape).astype(np.int16) << low
            part.coefs[_rows(rows), lo : hi + 1] = got + np.where(got > 0, fresh, -fresh)
            return
        there = got != 0
        if first > lo:
            there[0, : first - lo] = False
        fresh = bits.array(int(there.sum())).astype(np.int16) * np.int16(step)
        got[there] += np.where(got[there] > 0, fresh, -fresh)
        part.coefs[rows, lo : hi + 1] = got

    while i < len(where):
        b, k = where[i], lo
        row = part.coefs[b]
        while k <= hi:
            s = bits.symbol(codes)
            r, size = s >> 4, s & 15
            if not size and r < 15:
                run = (1 << r) + bits.take(r)
                correct(where[i : i + run], k)
                i += run - 1
                break
            value = (step if bits.take(1) else -step) if size else 0
            while k <= hi:
                if row[k]:
                    if bits.take(1):
                        row[k] += step if row[k] > 0 else -step
                elif r:
                    r -= 1
                else:
                    break
                k += 1
            if size and k <= hi:
                row[k] = value
            k += 1
        i += 1


def read_coefficients(media: bytes) -> dict:
    """Width, height, components with accumulated coefficient arrays (blocks by zigzag position), quantization tables, comments."""
    out = {"comments": [], "quant": {}}
    codes: dict[int, _Codes] = {}
    parts: dict[int, _Component] = {}
    at, restart = 2, 0
    if media[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out["comments"].append(body)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            codes.update(_tables(body))
        elif marker == 0xC2:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            for c, hv, q in zip(*(body[6 + k : 6 + 3 * n : 3] for k in range(3))):
                parts[c] = _Component(hv >> 4, hv & 15, q)
            hmax, vmax = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            for p in parts.values():
                p.lay_out(out["width"], out["height"], hmax, vmax)
        elif marker == 0xDA:
            n = body[0]
            chosen = [(parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            lo, hi, (high, low) = body[1 + 2 * n], body[2 + 2 * n], divmod(body[3 + 2 * n], 16)
            stop = _MARKER.search(media, at)
            end = stop.start() if stop else len(media)
            which, where = _interleaved(tuple(p.shape for p, _ in chosen)) if n > 1 else (chosen[0][0].alone, chosen[0][0].own)
            runs = [media[at:end]] if not restart else _RESTART.split(media[at:end])
            each = restart * (sum(p.h * p.v for p, _ in chosen) if n > 1 else 1) if restart else len(where)
            for i, raw in enumerate(runs):
                mine = slice(i * each, (i + 1) * each)
                bits = _Bits(raw)
                if lo == 0:
                    _read_dc([p for p, _ in chosen], bits, [codes.get(t >> 4) for _, t in chosen], which[mine], where[mine], high, low, not restart)
                else:
                    (_read_ac_more if high else _read_ac_first)(chosen[0][0], bits, codes[16 | chosen[0][1] & 15], where[mine], lo, hi, low)
            at = end
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive files are read")
    return out | {"components": list(parts.values())}


@lru_cache(maxsize=64)
def _dequantizer(quant: bytes) -> np.ndarray:
    """The inverse transform with a table of quantization steps (32-bit numbers) in it: coefficients to samples."""
    return (np.frombuffer(quant, np.int32)[:, None] * SAMPLES).astype(np.float32)


def inverse_transform(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8), not clipped, of blocks of zigzag coefficients."""
    table_, values = _dequantizer(np.ascontiguousarray(quant, np.int32).tobytes()), coefs.astype(np.float32)
    out, even = np.empty_like(values), len(values) // UNIT * UNIT
    # in groups of 64 blocks, which the product leaves to one thread: Spark shares out the cores
    np.matmul(values[:even].reshape(-1, UNIT, UNIT), table_, out=out[:even].reshape(-1, UNIT, UNIT))
    np.matmul(values[even:], table_, out=out[even:])
    out += np.float32(128)
    return out.reshape(-1, 8, 8)


def rgb_tensor(read: dict) -> np.ndarray:
    """The full-resolution picture, height by width by 3 unsigned bytes; one component gives equal channels."""
    parts = read["components"]
    hmax, vmax = max(p.h for p in parts), max(p.v for p in parts)
    planes = []
    for p in parts:
        plane = inverse_transform(p.coefs, read["quant"][p.quant])
        np.rint(plane, out=plane).clip(0, 255, out=plane)
        planes.append(plane.reshape(p.tall, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.tall * 8, p.wide * 8))
    out = np.empty((read["height"], read["width"], 3), np.uint8)
    wide = lambda x, p: x.repeat(vmax // p.v, 0).repeat(hmax // p.h, 1)[: read["height"], : read["width"]]
    y = wide(planes[0], parts[0])
    if len(planes) == 1:
        out[:] = y[:, :, None]
        return out
    cb, cr = planes[1] - np.float32(128), planes[2] - np.float32(128)
    if parts[1].shape == parts[2].shape:  # a chroma sample's share of each channel is made once, then upsampled
        shares = (np.float32(1.402) * cr, np.float32(-0.344136) * cb - np.float32(0.714136) * cr, np.float32(1.772) * cb)
        shares = [wide(s, parts[1]) for s in shares]
    else:
        cb, cr = wide(cb, parts[1]), wide(cr, parts[2])
        shares = (np.float32(1.402) * cr, np.float32(-0.344136) * cb - np.float32(0.714136) * cr, np.float32(1.772) * cb)
    for k, share in enumerate(shares):
        channel = y + share
        out[:, :, k] = np.rint(channel, out=channel).clip(0, 255, out=channel)
    return out


def read_jpeg(media: bytes) -> np.ndarray:
    return rgb_tensor(read_coefficients(media))


def read_payload(read: dict) -> bytes:
    """The payload of a file that ``store`` wrote, from its coefficient arrays."""
    size = next(int(c[len(TAG) :]) for c in read["comments"] if c.startswith(TAG))
    rows = np.concatenate([p.coefs for p in read["components"]])[: size // UNIT]
    out = np.where(rows > 0, rows, -rows - 128)  # AC: the byte itself from 128 on, else minus the byte plus 128
    out[:, 0] = rows[:, 0]
    return out.astype(np.uint8).tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8 with zero bytes appended up to a positive multiple of 64, and its length without these."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def feature_of(tensor: np.ndarray) -> str:
    """Size, channel means and a histogram of 8 luminance steps, of the whole tensor."""
    pixels = tensor.shape[0] * tensor.shape[1]
    red, green, blue = (np.ascontiguousarray(tensor[:, :, k]) for k in range(3))
    means = "/".join(f"{int(c.sum(dtype=np.int64)) / pixels:.4f}" for c in (red, green, blue))
    steps = np.bincount(((red.astype(np.uint16) + green + blue) // 96).ravel(), minlength=8)
    return f"{tensor.shape[0]}x{tensor.shape[1]};{means};{'/'.join(map(str, steps.tolist()))}"


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (the stored file) of every row.

    A null text counts as empty, whose payload is 64 zero bytes; a null id stays null. Texts of any length are stored
    whole, rows that repeat alike, an empty table gives no rows, other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                stored, sizes = [], []
                for t in part.column(1).to_pylist():
                    payload, size = payload_of(t)
                    sizes.append(size)
                    stored.append(store(payload))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], schema=schema)

    return map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """The columns of ``store_texts`` and, read back from the stored files: payload, height, width, rgb (the full-resolution tensor, row by row), feature.

    A null file gives nulls. Files are read whole, an empty table gives no rows, other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                rows = []
                for m in part.column(2).to_pylist():
                    if m is None:
                        rows.append((None,) * 5)
                        continue
                    read = read_coefficients(m)
                    tensor = rgb_tensor(read)
                    rows.append((read_payload(read), tensor.shape[0], tensor.shape[1], tensor.tobytes(), feature_of(tensor)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[3:]))], schema=schema)

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, feature string")


def digest(read: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, height, width, rgb_crc32 of the columns of ``read_media``."""
    size = F.length("payload")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", size - (UNIT - 1), F.lit(UNIT))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "height", "width", F.crc32("rgb").alias("rgb_crc32"),
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a progressive JPEG, read back; the digests are those of the payload, file and tensor columns."""
    return digest(read_media(store_texts(table(spark, sf_dir, "documents"))))
