"""Progressive JPEG against an independent sequential encoder and a direct inverse transform."""

import hashlib
import os

import numpy as np
import pytest

from shelfwise.llm import jpeg


class Out:
    """A plain bit writer."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def code(self, symbol):
        # every symbol has a 9-bit code, numbered by SYMBOLS
        self.put(SYMBOLS.index(symbol), 9)

    def data(self):
        self.bits += [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


SYMBOLS = list(range(256))


def magnitude(v):
    n = abs(v).bit_length()
    return n, (v if v > 0 else v + (1 << n) - 1)


def down(v, low):
    return abs(v) >> low if v >= 0 else -(abs(v) >> low)


def band_first(blocks, lo, hi, low):
    out, ends = Out(), 0

    def flush():
        nonlocal ends
        while ends:
            n = min(14, ends.bit_length() - 1)
            take = min(ends, (1 << (n + 1)) - 1)
            out.code(n << 4)
            out.put(take - (1 << n), n)
            ends -= take

    for b in blocks:
        run = 0
        last = max((k for k in range(lo, hi + 1) if down(b[k], low)), default=-1)
        if last < 0:
            ends += 1
            continue
        flush()
        for k in range(lo, last + 1):
            v = down(b[k], low)
            if not v:
                run += 1
                continue
            while run > 15:
                out.code(0xF0)
                run -= 16
            n, bits = magnitude(v)
            out.code(run << 4 | n)
            out.put(bits, n)
            run = 0
        if last < hi:
            ends += 1
    flush()
    return out.data()


def band_refine(blocks, lo, hi, low):
    out = Out()
    for b in blocks:
        old = lambda k: abs(b[k]) >> (low + 1)
        new = [k for k in range(lo, hi + 1) if abs(b[k]) >> low == 1]
        at = lo
        for k in new:
            zeros = [j for j in range(at, k) if not old(j)]
            while len(zeros) > 15:
                stop = zeros[15]
                out.code(0xF0)
                for j in range(at, stop):
                    if old(j):
                        out.put(abs(b[j]) >> low & 1, 1)
                at = stop + 1
                zeros = [j for j in range(at, k) if not old(j)]
            out.code(len(zeros) << 4 | 1)
            out.put(int(b[k] > 0), 1)
            for j in range(at, k):
                if old(j):
                    out.put(abs(b[j]) >> low & 1, 1)
            at = k + 1
        if at <= hi:
            out.code(0)
            for j in range(at, hi + 1):
                if old(j):
                    out.put(abs(b[j]) >> low & 1, 1)
    return out.data()


def encode(parts, sampling, width, height, orders):
    """parts: blocks in scan order by part, padded to whole units; orders: interleaved (part, block) sequence."""
    q = bytes(range(1, 65))
    table = lambda c: bytes([c]) + bytes([0] * 8 + [255] + [0] * 7) + bytes(SYMBOLS[:255])
    head = b"\xff\xd8" + jpeg.segment(0xDB, b"\x00" + q)
    head += jpeg.segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += jpeg.segment(0xC4, table(0) + table(0x10))
    out, before = Out(), [0] * len(parts)
    for p, k in orders:
        v = parts[p][k][0] >> 1
        n, bits = magnitude(v - before[p]) if v != before[p] else (0, 0)
        out.code(n)
        out.put(bits, n)
        before[p] = v
    n = len(parts)
    spec = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n))
    body = jpeg.segment(0xDA, spec + bytes([0, 0, 0x01])) + out.data()
    fix = Out()
    for p, k in orders:
        fix.put(parts[p][k][0] & 1, 1)
    body += jpeg.segment(0xDA, spec + bytes([0, 0, 0x10])) + fix.data()
    return head + body


@pytest.mark.parametrize("gray", [True, False])
def test_general_progressive_scans(gray):
    rng = np.random.default_rng(4)
    width, height = (37, 21) if gray else (41, 30)
    sampling = [(1, 1)] if gray else [(2, 2), (1, 1), (1, 1)]
    hmax = max(h for h, _ in sampling)
    mx, my = -(-width // (8 * hmax)), -(-height // (8 * hmax))
    parts, grids = [], []
    for h, v in sampling:
        n = mx * h * my * v
        b = np.where(rng.random((n, 64)) < 0.15, rng.integers(-40, 41, (n, 64)), 0)
        b[:, 0] = rng.integers(-200, 200, n)
        b[rng.random(n) < 0.4, 1:] = 0
        parts.append(b.tolist())
        grids.append((mx * h, my * v))
    if gray:
        order = [(0, k) for k in range(len(parts[0]))]
    else:
        order = [(p, (y * v + j) * grids[p][0] + x * h + i) for y in range(my) for x in range(mx) for p, (h, v) in enumerate(sampling) for j in range(v) for i in range(h)]
    data = encode(parts, sampling, width, height, order)
    for p, (h, v) in enumerate(sampling):
        across, down_ = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // hmax)) // 8)
        scan = [y * grids[p][0] + x for y in range(down_) for x in range(across)]
        for k in set(range(len(parts[p]))) - set(scan):
            parts[p][k][1:] = [0] * 63
        blocks = [parts[p][k] for k in scan]
        for lo, hi in ((1, 5), (6, 63)):
            data += jpeg.segment(0xDA, bytes([1, p + 1, 0, lo, hi, 0x02])) + band_first(blocks, lo, hi, 2)
        for low in (1, 0):
            data += jpeg.segment(0xDA, bytes([1, p + 1, 0, 1, 63, (low + 1) << 4 | low])) + band_refine(blocks, 1, 63, low)
    image = jpeg.Progressive(data + b"\xff\xd9")
    for p, part in enumerate(image.parts.values()):
        assert part.coef.tolist() == parts[p]
    rgb = image.rgb()
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    # a block by the definition of the transform
    place = {int(z): k for k, z in enumerate(jpeg.zigzag())}
    coef = image.parts[1].coef[0] * np.arange(1, 65)
    scale = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    for y in range(0, 8, 3):
        for x in range(0, 8, 3):
            s = sum(scale(u) * scale(v) * coef[place[8 * v + u]] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 + 128
            got = int(image.plane(image.parts[1])[y, x])
            assert abs(got - min(255, max(0, s))) <= 0.51


def test_zigzag_starts_and_ends_as_defined():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


@pytest.mark.parametrize("n", [64, 378 * 64, 64 * 7, 64 * 9000])
def test_payloads_come_back(n):
    payload = os.urandom(n)
    media = jpeg.write_payload(payload)
    assert jpeg.read_payload(jpeg.Progressive(media), n) == payload == jpeg.read_payload(jpeg.Progressive(jpeg.write_payload(payload)), n)


def test_stored_texts(odd, empty):
    stored = jpeg.store_texts(odd)
    got = jpeg.stored_digests(stored).collect()
    want = []
    for r in odd.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        want.append((r.doc_id, len((r.text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in got), key=key) == sorted(want, key=key)
    same = {r.payload_sha256: (r.media_sha256, r.feature) for r in got}
    assert all(same[r.payload_sha256] == (r.media_sha256, r.feature) for r in got)
    assert jpeg.stored_digests(jpeg.store_texts(empty)).count() == 0


def test_decode_media(spark):
    media = jpeg.write_payload(b"a" * 640)
    df = spark.createDataFrame([(1, bytearray(media), "x"), (2, None, "y"), (3, bytearray(b""), None), (4, bytearray(b"\xff\xd8broken"), "z")], "k int, media binary, tensor string")
    got = {r.k: r for r in jpeg.decode_media(df, keep={"k": "int"}).collect()}
    assert got[1].height * got[1].width * 3 == len(got[1].tensor) and got[2].tensor is got[3].tensor is got[4].tensor is None


def test_tensor_column(spark):
    df = spark.createDataFrame([(1, "some text " * 40), (2, None), (2, "é")], "doc_id long, text string")
    stored = jpeg.store_texts(df)
    back = jpeg.read_back(stored).collect()
    media = [bytes(r.media) for r in stored.collect()]
    want = sorted(jpeg.Progressive(m).rgb().tobytes() for m in media)
    assert sorted(bytes(r.tensor) for r in back) == want and all(len(r.tensor) == 3 * r.height * r.width for r in back)
    none = spark.createDataFrame([(1, None, None)], "k int, tensor binary, width int")
    assert jpeg.tensor_features(none, {"k": "int"}).first().feature is None
