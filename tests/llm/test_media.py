import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from quarrymill.llm import media


def test_round_trip():
    rng = random.Random(3)
    for n in [1, 2, 3, 6, 7, 24, 25, 100, 1000, 6 * 33_000]:
        payload = rng.randbytes(64 * n)
        assert media.read_payload(media.read_coefficients(media.store(payload))) == payload
    with pytest.raises(ValueError):
        media.store(b"")


def test_inverse_transform_as_the_sum():
    c = np.random.default_rng(1).integers(-200, 200, (1, 64))
    natural = np.zeros(64)
    natural[media.ZIGZAG] = c[0]
    natural = natural.reshape(8, 8)
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            want[y, x] = 128 + sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * natural[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
    assert np.abs(media.inverse_transform(c, np.ones(64))[0] - want).max() < 0.01


class Writer:
    """A plain bit-by-bit writer of progressive scans with fixed-length codes, to test the reader's general paths."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 8)

    def value(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def scan(self, comps, lo, hi, high, low):
        head = bytes([len(comps), *(x for c in comps for x in (c, 0)), lo, hi, high << 4 | low])
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return media._segment(0xDA, head) + np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def shift(v, n):
    return int(np.sign(v)) * (abs(int(v)) >> n)


def write_plain(coefs, width, height, factors):
    """A file with DC in two steps, AC in one band of two steps, zero runs, end-of-block runs and an interleaved DC scan."""
    codes = media._segment(0xC4, bytes([0, *[0] * 7, 255, *[0] * 8, *range(255)])) + media._segment(0xC4, bytes([16, *[0] * 7, 255, *[0] * 8, *range(255)]))
    frame = struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    out = [b"\xff\xd8", media._segment(0xDB, b"\x00" + bytes(range(1, 65))), codes, media._segment(0xC2, frame)]
    parts = [media._Component(h, v, 0) for h, v in factors]
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    for p in parts:
        p.lay_out(width, height, hmax, vmax)
    which, where = media._interleaved(tuple(p.shape for p in parts))
    first, more = Writer(), Writer()
    before = [0] * len(parts)
    for k, b in zip(which, where):
        v = int(coefs[k][b, 0]) >> 1
        d = v - before[k]
        before[k] = v
        first.symbol(abs(d).bit_length())
        if d:
            first.value(d)
        more.put(int(coefs[k][b, 0]) & 1, 1)
    names = [i + 1 for i in range(len(parts))]
    out += [first.scan(names, 0, 0, 0, 1), more.scan(names, 0, 0, 1, 0)]
    for k, p in enumerate(parts):
        w, run = Writer(), 0

        def flush():
            nonlocal run
            if run:
                n = run.bit_length() - 1
                w.symbol(n << 4)
                w.put(run - (1 << n), n)
                run = 0

        for b in p.own:
            values = [shift(v, 1) for v in coefs[k][b, 1:]]
            last = max((i for i, v in enumerate(values) if v), default=-1)
            if last >= 0:
                flush()
            zeros = 0
            for v in values[: last + 1]:
                if v:
                    while zeros > 15:
                        w.symbol(0xF0)
                        zeros -= 16
                    w.symbol(zeros << 4 | abs(v).bit_length())
                    w.value(v)
                    zeros = 0
                else:
                    zeros += 1
            if last < 62:
                run += 1
        flush()
        out.append(w.scan([k + 1], 1, 63, 0, 1))
        w = Writer()
        for b in p.own:  # refinement: new ones coded with their run, corrections after each code
            values = coefs[k][b, 1:]
            fresh = [i for i, v in enumerate(values) if abs(v) == 1]
            at = 0
            for i in fresh:
                zeros, held = 0, []
                while at < i:
                    if abs(values[at]) > 1:
                        held.append(abs(int(values[at])) & 1)
                    elif zeros == 15:
                        w.symbol(0xF0)
                        w.bits += held
                        zeros, held = 0, []
                        at += 1
                        continue
                    else:
                        zeros += 1
                    at += 1
                w.symbol(zeros << 4 | 1)
                w.put(int(values[i] > 0), 1)
                w.bits += held
                at = i + 1
            if at < 63:
                w.symbol(0)
                w.bits += [abs(int(v)) & 1 for v in values[at:] if abs(v) > 1]
        out.append(w.scan([k + 1], 1, 63, 1, 0))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("size", [(16, 16), (37, 21)])
def test_general_files(factors, size):
    rng = np.random.default_rng(7)
    width, height = size
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    coefs = []
    for h, v in factors:
        p = media._Component(h, v, 0)
        p.lay_out(width, height, hmax, vmax)
        c = rng.integers(-40, 41, p.coefs.shape) * (rng.random(p.coefs.shape) < rng.choice([0.05, 0.3, 0.9], (len(p.coefs), 1)))
        c[rng.random(c.shape) < 0.1] = 1
        outside = np.ones(len(c), bool)
        outside[p.own] = False
        c[outside, 1:] = 0
        coefs.append(c)
    read = media.read_coefficients(write_plain(coefs, width, height, factors))
    for p, c in zip(read["components"], coefs):
        assert (p.coefs == c).all()
    tensor = media.rgb_tensor(read)
    assert tensor.shape == (height, width, 3) and tensor.dtype == np.uint8
    if len(factors) == 3:  # a pixel by hand, chroma taken from the sample that covers it
        planes = [np.clip(np.rint(media.inverse_transform(p.coefs, np.arange(1, 65)).reshape(p.tall, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.tall * 8, -1)), 0, 255) for p in read["components"]]
        y, x = 13, 10
        lum, cb, cr = (pl[y * v // vmax, x * h // hmax] for pl, (h, v) in zip(planes, factors))
        assert abs(int(tensor[y, x, 0]) - np.clip(lum + 1.402 * (cr - 128), 0, 255)) <= 1


def naive_tensor(media_file):
    """A stored file's picture by the sums of the inverse transform, block by block and pixel by pixel, in plain Python."""
    read = media.read_coefficients(media_file)
    angle = [[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
    planes = []
    for p in read["components"]:
        plane = [[0] * (p.wide * 8) for _ in range(p.tall * 8)]
        for b, block in enumerate(p.coefs.tolist()):
            cells = [(int(media.ZIGZAG[k]) // 8, int(media.ZIGZAG[k]) % 8, v) for k, v in enumerate(block) if v]
            for y in range(8):
                for x in range(8):
                    v = 128 + sum(c * angle[r][y] * angle[s][x] for r, s, c in cells)
                    plane[b // p.wide * 8 + y][b % p.wide * 8 + x] = min(255, max(0, round(v)))
        planes.append(plane)
    out = []
    for y in range(read["height"]):
        for x in range(read["width"]):
            lum, cb, cr = planes[0][y][x], planes[1][y // 2][x // 2] - 128, planes[2][y // 2][x // 2] - 128
            out.append([min(255, max(0, round(v))) for v in (lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb)])
    return np.array(out).reshape(read["height"], read["width"], 3)


@pytest.mark.parametrize("text", ["", "one short text", "ein längerer Text, der mehr als einen Block füllt; " * 20])
def test_tensor_and_feature_as_naive(text):
    stored = media.store(media.payload_of(text)[0])
    want, got = naive_tensor(stored), media.read_jpeg(stored)
    off = np.abs(want - got.astype(int))
    assert off.max() <= 1 and (off == 0).mean() > 0.999  # single precision rounds a tie otherwise
    pixels = got.reshape(-1, 3).tolist()
    means = "/".join(f"{sum(p[k] for p in pixels) / len(pixels):.4f}" for k in range(3))
    steps = [sum(sum(p) // 96 == i for p in pixels) for i in range(8)]
    assert media.feature_of(got) == f"{got.shape[0]}x{got.shape[1]};{means};{'/'.join(map(str, steps))}"


def test_first_scans_need_no_stuffing():
    """Each value's code and bits fill a byte, and none is 255."""
    assert 255 not in media._DC_CODE and 255 not in media._AC_CODE and len(set(media._DC_CODE.tolist())) == 255
    stored = media.store(bytes(range(256)) * 4)
    heads = [m.start() for m in media.re.finditer(b"\xff\xda", stored)]
    assert len(heads) == 9  # DC, two bands of Y, Cb, Cr, then a refining scan of each
    with pytest.raises(ValueError):
        media.read_coefficients(stored[: heads[0] + 14] + b"\xff\x00" * 24 + stored[heads[1] :])


def test_query_on_documents(spark, small, edge, empty):
    for docs in (small, edge):
        stored = media.store_texts(docs)
        rows = media.digest(media.read_media(stored)).collect()
        plain = [(d.text or "").encode() for d in docs.collect()]
        padded = [x + bytes(-len(x) % 64 if x else 64) for x in plain]
        want = sorted((hashlib.sha256(p).hexdigest(), len(x), len(p), zlib.crc32(p[-64:])) for x, p in zip(plain, padded))
        assert sorted((r.payload_sha256, r.n_bytes, r.payload_bytes, r.tail_crc32) for r in rows) == want
        files = sorted((hashlib.sha256(r.media).hexdigest(), len(r.media), media.feature_of(t := media.read_jpeg(r.media)), zlib.crc32(t.tobytes())) for r in stored.collect())
        assert sorted((r.media_sha256, r.media_bytes, r.feature, r.rgb_crc32) for r in rows) == files
    by = {r.doc_id: r for r in rows}
    assert by[0].tail_crc32 == zlib.crc32(bytes(64)) and by[0].media_sha256 == by[1].media_sha256 and by[5].feature == by[6].feature
    assert media.digest(media.read_media(media.store_texts(empty))).count() == 0
    read = media.read_media(media.store_texts(small)).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width and r.payload for r in read)
    missing = spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")
    assert media.digest(media.read_media(missing)).first().payload_sha256 is None
