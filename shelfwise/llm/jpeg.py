"""Media columns: progressive JPEG, written and read in numpy.

Reading accumulates the spectral-selection and successive-approximation scans of a progressive file into coefficient
arrays, inverse-transforms them, upsamples chroma and gives full-resolution RGB tensors. Writing stores arbitrary bytes
losslessly as coefficients of such a file.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, map_texts, slices

#: Payload bytes are padded to multiples of this.
UNIT = 64
#: Coefficients of a block that hold payload: all but the mean, which stays 0.
HELD = 63


@functools.lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: diagonals in turn, odd ones downwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


@functools.lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """Rows of the orthonormal 8-point cosine transform."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * math.pi / 16)


# ---- reading ----


class Codes:
    """A Huffman table: for each 16-bit prefix the symbol and the length of its code (0: no code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for size in range(1, 17):
            for _ in range(counts[size - 1]):
                lo, hi = code << (16 - size), (code + 1) << (16 - size)
                self.symbol[lo:hi], self.length[lo:hi] = symbols[at], size
                code, at = code + 1, at + 1
            code <<= 1


class Bits:
    """Bits of one entropy-coded segment without stuffing; beyond the end come ones."""

    def __init__(self, data: np.ndarray):
        self.data, self.end, self.at = data, 8 * len(data), 0
        self.raw = data.tobytes() + b"\xff" * 8

    def peek16(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.raw[byte : byte + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        byte, skip = self.at >> 3, self.at & 7
        self.at += n
        return (int.from_bytes(self.raw[byte : byte + 4], "big") >> (32 - skip - n)) & ((1 << n) - 1)

    def symbol(self, codes: Codes) -> int:
        p = self.peek16()
        n = int(codes.length[p])
        if not n or self.at >= self.end:
            raise ValueError("broken entropy-coded data")
        self.at += n
        return int(codes.symbol[p])

    def many(self, n: int) -> np.ndarray:
        """The next n single bits."""
        lo = self.at >> 3
        got = np.unpackbits(self.data[lo : (self.at + n + 7) >> 3])[self.at - 8 * lo :][:n]
        if len(got) < n:
            raise ValueError("broken entropy-coded data")
        self.at += n
        return got

    def alike(self, codes: Codes, most: int) -> tuple[int, int, np.ndarray]:
        """Symbol ahead, its count of extra bits, and those of the run of codes of this same symbol ahead (``most`` at most).

        Streams that repeat a code are so read by whole arrays; others get runs of one and go on by single symbols.
        """
        p = self.peek16()
        sym, n = int(codes.symbol[p]), int(codes.length[p])
        extra = sym & 15
        step = n + extra
        if not n or self.at >= self.end:
            raise ValueError("broken entropy-coded data")
        most = min(most, (self.end - self.at) // step)
        if most < 1:
            raise ValueError("broken entropy-coded data")
        if step == 8 and not self.at & 7:
            words = self.data[self.at >> 3 : (self.at >> 3) + most]
            same = (words >> extra) == (p >> (16 - n))
            values = words & ((1 << extra) - 1)
        else:
            most = min(most, 1 << 16)
            lo = self.at >> 3
            bits = np.unpackbits(self.data[lo : (self.at + most * step + 7) >> 3])[self.at - 8 * lo :][: most * step].reshape(most, step)
            same = (bits[:, :n] == bits[0, :n]).all(axis=1)
            values = bits[:, n:].astype(np.int32) @ (1 << np.arange(extra - 1, -1, -1, dtype=np.int32)) if extra else np.zeros(most, np.int32)
        run = most if same.all() else int(same.argmin())
        self.at += run * step
        return sym, extra, values[:run].astype(np.int32)


def extend(v, size: int):
    """Signed value of ``size`` extra bits: a leading zero marks a negative one."""
    return np.where(v < (1 << (size - 1)), v - (1 << size) + 1, v) if size else v * 0


class Part:
    """A colour component: sampling, quantisation table, and coefficients of its blocks in scan order."""

    def __init__(self, h: int, v: int, table: int, cols: int, rows: int, scan_cols: int, scan_rows: int):
        self.h, self.v, self.table, self.cols, self.rows = h, v, table, cols, rows
        self.scan_cols, self.scan_rows = scan_cols, scan_rows
        self.coef = np.zeros((rows * cols, 64), np.int32)


class Progressive:
    """Coefficients of a progressive JPEG file (Huffman coding, 8 bits, any sampling, restart intervals)."""

    def __init__(self, data: bytes):
        self.parts: dict[int, Part] = {}
        self.quant: dict[int, np.ndarray] = {}
        codes: dict[int, Codes] = {}
        raw, at, restart = np.frombuffer(data, np.uint8), 2, 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        # places of markers: a byte 255 that isn't followed by a stuffed zero or a fill byte
        marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & (raw[1:] != 255))
        while True:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at] != 255:
                raise ValueError("broken JPEG file")
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                return
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                    body = body[1 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = codes_of(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDD:
                restart = int.from_bytes(body, "big")
            elif kind == 0xC2:
                self.frame(body)
            elif kind in (0xC0, 0xC1, *range(0xC3, 0xD0)) and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive Huffman JPEG file")
            elif kind == 0xDA:
                start = at
                stops = marks[np.searchsorted(marks, start) :]
                cuts = [start]
                for m in stops:
                    if 0xD0 <= data[m + 1] <= 0xD7:
                        cuts += [int(m), int(m) + 2]
                    else:
                        at = int(m)
                        break
                cuts.append(at)
                segments = [unstuffed(raw[a:b]) for a, b in zip(cuts[::2], cuts[1::2])]
                self.scan(body, codes, segments, restart)

    def frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        specs = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
        self.hmax, self.vmax = max(s[1] >> 4 for s in specs), max(s[1] & 15 for s in specs)
        mx, my = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.mcu = (mx, my)
        for s in specs:
            h, v = s[1] >> 4, s[1] & 15
            across, down = -(-self.width * h // self.hmax), -(-self.height * v // self.vmax)
            self.parts[s[0]] = Part(h, v, s[2], mx * h, my * v, -(-across // 8), -(-down // 8))

    def order(self, parts: list[Part]) -> list[tuple[Part, np.ndarray]]:
        """For each part the indices of its blocks in the order of a scan, units by rows."""
        if len(parts) == 1:
            p = parts[0]
            return [(p, (np.arange(p.scan_rows)[:, None] * p.cols + np.arange(p.scan_cols)).reshape(-1, 1))]
        mx, my = self.mcu
        out = []
        for p in parts:
            y = np.arange(my)[:, None, None, None] * p.v + np.arange(p.v)[None, None, :, None]
            x = np.arange(mx)[None, :, None, None] * p.h + np.arange(p.h)[None, None, None, :]
            out.append((p, (y * p.cols + x).reshape(mx * my, p.v * p.h)))
        return out

    def scan(self, body: bytes, codes: dict[int, Codes], segments: list[np.ndarray], restart: int) -> None:
        n = body[0]
        chosen = [(self.parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        order = self.order([p for p, _ in chosen])
        units = len(order[0][1])
        step = restart or units
        for k, start in enumerate(range(0, units, step)):
            bits = Bits(segments[k])
            some = [(p, ix[start : start + step]) for p, ix in order]
            if first == 0:
                if high:
                    self.mean_refine(bits, some, low)
                else:
                    self.mean_first(bits, some, [codes.get(t >> 4) for _, t in chosen], low)
            else:
                p, blocks = some[0][0], some[0][1][:, 0]
                table = codes.get(16 | (chosen[0][1] & 15))
                (self.band_refine if high else self.band_first)(bits, p.coef, blocks, table, first, last, low)

    @staticmethod
    def mean_first(bits: Bits, some, tables, low: int) -> None:
        widths = [ix.shape[1] for _, ix in some]
        turn = np.repeat(np.arange(len(some)), widths)
        units = len(some[0][1])
        diff = np.zeros((units, len(turn)), np.int64)
        flat, at, total = diff.reshape(-1), 0, units * len(turn)
        one = all(t is tables[0] for t in tables)
        while at < total:
            codes = tables[turn[at % len(turn)]]
            sym, extra, values = bits.alike(codes, total - at if one else 1)
            flat[at : at + len(values)] = extend(values, extra)
            at += len(values)
        col = 0
        for (p, ix), w in zip(some, widths):
            p.coef[ix.reshape(-1), 0] = np.cumsum(diff[:, col : col + w].reshape(-1)) << low
            col += w

    @staticmethod
    def mean_refine(bits: Bits, some, low: int) -> None:
        widths = [ix.shape[1] for _, ix in some]
        units = len(some[0][1])
        got = bits.many(units * sum(widths)).reshape(units, -1).astype(np.int32)
        col = 0
        for (p, ix), w in zip(some, widths):
            p.coef[ix.reshape(-1), 0] |= got[:, col : col + w].reshape(-1) << low
            col += w

    @staticmethod
    def band_first(bits: Bits, coef: np.ndarray, blocks: np.ndarray, codes: Codes, first: int, last: int, low: int) -> None:
        width = last - first + 1
        total = len(blocks) * width
        flat = np.zeros(total, np.int32)
        at = 0
        while at < total:
            sym, extra, values = bits.alike(codes, total - at) if int(codes.symbol[bits.peek16()]) in range(1, 11) else (None, 0, None)
            if sym is not None:
                flat[at : at + len(values)] = extend(values, extra) << low if low == 0 else extend(values, extra) * (1 << low)
                at += len(values)
                continue
            sym = bits.symbol(codes)
            run, size = sym >> 4, sym & 15
            if size:
                at += run
                flat[at] = int(extend(np.int64(bits.take(size)), size)) * (1 << low)
                at += 1
            elif run == 15:
                at += 16
            else:
                ends = (1 << run) + (bits.take(run) if run else 0)
                at = (at // width + ends) * width
        coef[blocks, first : last + 1] = flat.reshape(-1, width)

    @staticmethod
    def band_refine(bits: Bits, coef: np.ndarray, blocks: np.ndarray, codes: Codes, first: int, last: int, low: int) -> None:
        width, bit = last - first + 1, 1 << low
        part = coef[blocks, first : last + 1]
        flat = part.reshape(-1)

        def correct(lo: int, hi: int) -> None:
            nz = lo + np.flatnonzero(flat[lo:hi])
            up = bits.many(len(nz)).astype(bool)
            at = nz[up]
            at = at[(np.abs(flat[at]) & bit) == 0]
            flat[at] += np.where(flat[at] > 0, bit, -bit)

        at, total = 0, len(flat)
        while at < total:
            end = (at // width + 1) * width
            sym = bits.symbol(codes)
            run, size = sym >> 4, sym & 15
            if size == 0 and run < 15:
                ends = (1 << run) + (bits.take(run) if run else 0)
                to = min(total, (at // width + ends) * width)
                correct(at, to)
                at = to
                continue
            new = 0
            if size:
                new = bit if bits.take(1) else -bit
            # pass ``run`` zeros; nonzero coefficients on the way get their correction bits
            zeros = at + np.flatnonzero(flat[at:end] == 0)
            stop = int(zeros[run]) if run < len(zeros) else end
            correct(at, stop)
            at = stop
            if at < end:
                if new:
                    flat[at] = new
                at += 1
        coef[blocks, first : last + 1] = flat.reshape(-1, width)

    def plane(self, p: Part) -> np.ndarray:
        """Samples of a part: dequantised, inverse-transformed in groups of blocks, shifted and clipped."""
        c, back = basis(), np.argsort(zigzag())
        q = self.quant[p.table]
        out = np.empty((p.rows, 8, p.cols, 8), np.uint8)
        step = max(1, 4096 // p.cols)
        for r in range(0, p.rows, step):
            n = min(step, p.rows - r)
            x = (p.coef[r * p.cols : (r + n) * p.cols] * q)[:, back].reshape(-1, 8, 8).astype(np.float64)
            s = np.rint(np.matmul(np.matmul(c.T, x), c) + 128)
            out[r : r + n] = np.clip(s, 0, 255).astype(np.uint8).reshape(n, p.cols, 8, 8).transpose(0, 2, 1, 3)
        return out.reshape(p.rows * 8, p.cols * 8)

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor of height x width x 3; one part gives grey, three are luma and upsampled chroma."""
        planes = []
        for p in self.parts.values():
            s = self.plane(p)
            s = s.repeat(self.vmax // p.v, axis=0).repeat(self.hmax // p.h, axis=1)
            planes.append(s[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        out = np.empty((self.height, self.width, 3), np.uint8)
        for r in range(0, self.height, 512):
            y, cb, cr = (x[r : r + 512].astype(np.float32) for x in planes[:3])
            cb, cr = cb - 128, cr - 128
            # fixed coefficients of the colour space
            for i, v in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
                out[r : r + 512, :, i] = np.clip(np.rint(v), 0, 255)
        return out


@functools.lru_cache(maxsize=64)
def codes_of(counts: bytes, symbols: bytes) -> Codes:
    return Codes(counts, symbols)


def unstuffed(raw: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes without the zero after each 255."""
    hit = np.flatnonzero(raw == 255)
    return np.delete(raw, hit + 1) if len(hit) else raw


# ---- writing ----


def segment(kind: int, body: bytes) -> bytes:
    return bytes([255, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def stuffed(raw: np.ndarray) -> bytes:
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def layout(n: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units (four luma and two chroma blocks) that hold n payload bytes."""
    units = max(1, -(-n // (6 * HELD)))
    cols = min(4095, math.isqrt(units - 1) + 1)
    rows = -(-units // cols)
    if rows > 4095:
        raise ValueError("payload too long for one image")
    return cols, rows


@functools.lru_cache(maxsize=1024)
def header(cols: int, rows: int) -> bytes:
    size = (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big")
    mean = bytes([0] + [1] + [0] * 15 + [0])
    band = bytes([16] + [1] + [0] * 15 + [7])
    runs = bytes([17] + [0, 0, 0, 15] + [0] * 12 + [n << 4 for n in range(15)])
    return b"\xff\xd8" + segment(0xDB, bytes([0] + [1] * 64)) + segment(0xC2, b"\x08" + size + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + segment(0xC4, mean + band + runs)


def write_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG file whose coefficients are ``payload``; the bytes beyond it, up to whole units, are 0.

    A byte is a coefficient of magnitude 128 plus its low seven bits, negative where its top bit is set. Scans: means
    (all 0); then for each part the band 1 to 63 without its lowest bit, and a refinement scan with that bit.
    """
    cols, rows = layout(len(payload))
    blocks = cols * rows
    data = np.zeros(6 * blocks * HELD, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    # one zero bit a block: no difference from the mean before; ones fill the last byte
    means = np.packbits(np.concatenate([np.zeros(6 * blocks, np.uint8), np.ones(-6 * blocks % 8, np.uint8)]))
    out = [header(cols, rows), segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])), stuffed(means)]
    half = (data & 127) >> 1
    coded = np.where(data < 128, 64 + half, 63 - half).astype(np.uint8)
    low = data & 1
    at = 0
    for part, many in ((1, 4 * blocks), (2, blocks), (3, blocks)):
        span = slice(at * HELD, (at + many) * HELD)
        # each code is one zero bit and seven extra bits: whole bytes below 128
        out += [segment(0xDA, bytes([1, part, 0, 1, 63, 0x01])), coded[span].tobytes()]
        bits, fix = [], low[span]
        for s in range(0, many, 32767):
            run = min(32767, many - s)
            n = run.bit_length() - 1
            head = (n << n) | (run - (1 << n))
            bits.append(np.array([head >> i & 1 for i in range(3 + n, -1, -1)], np.uint8))
            bits.append(fix[s * HELD : (s + run) * HELD])
        flat = np.concatenate(bits)
        flat = np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])
        out += [segment(0xDA, bytes([1, part, 1, 1, 63, 0x10])), stuffed(np.packbits(flat))]
        at += many
    return b"".join(out) + b"\xff\xd9"


def read_payload(image: Progressive, n: int) -> bytes:
    """The first n bytes that ``write_payload`` stored."""
    flat = np.concatenate([p.coef[:, 1:].reshape(-1) for p in image.parts.values()])[:n]
    return (np.where(flat < 0, 128, 0) + (np.abs(flat) - 128)).astype(np.uint8).tobytes()


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes((-len(raw)) % UNIT if raw else UNIT)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the UTF-8 text), payload_bytes (padded with zeros to a positive multiple of 64) and media: the JPEG file.

    A null text is empty. Rows come back one for one, repeated and null ids included; an empty table gives none.
    """

    def run(texts: list[str]) -> dict:
        made = [padded(t) for t in texts]
        return {"n_bytes": [n for n, _ in made], "payload_bytes": [len(p) for _, p in made], "media": [write_payload(p) for _, p in made]}

    return map_texts(df, {id_col: "bigint"}, text_col, run, {"n_bytes": "bigint", "payload_bytes": "bigint", "media": "binary"})


def decode_media(df: DataFrame, media_col: str = "media", keep: dict[str, str] | None = None) -> DataFrame:
    """height, width and tensor (RGB bytes, row by row) of every JPEG file of ``media_col``, with the columns ``keep`` (name -> type).

    A null, empty or broken file, or one that isn't a progressive JPEG, gives nulls. One file is decoded at a time.
    """

    def one(media):
        try:
            rgb = Progressive(media).rgb() if media else None
        except (ValueError, IndexError, KeyError, AttributeError):
            rgb = None
        return {"height": None if rgb is None else rgb.shape[0], "width": None if rgb is None else rgb.shape[1], "tensor": None if rgb is None else rgb.tobytes()}

    return decoded(df, media_col, keep or {}, lambda media, _: one(media), {"height": "int", "width": "int", "tensor": "binary"})


def read_back(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of stored texts (id, n_bytes, payload_bytes, media): digests of the payload read back and of the file, and the
    file's RGB tensor as a column (height, width, tensor). Rows come back one for one; an empty table gives none."""

    def one(media: bytes, n: int) -> dict:
        image = Progressive(media)
        payload = read_payload(image, n)
        rgb = image.rgb()
        return {"payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": crc32(payload[-UNIT:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "height": rgb.shape[0], "width": rgb.shape[1], "tensor": rgb.tobytes()}

    types = {"payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "height": "int", "width": "int", "tensor": "binary"}
    return decoded(df, "media", {id_col: "bigint", "n_bytes": "bigint", "payload_bytes": "bigint"}, one, types, "payload_bytes")


def tensor_features(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """The columns ``keep`` (name -> type) and ``feature`` of a tensor column: height, width, sums of the channels, checksum.

    A null tensor has no feature; rows come back one for one, repeated rows alike; an empty table gives none.
    """

    def one(tensor: bytes | None, width: int) -> dict:
        if tensor is None:
            return {"feature": None}
        rgb = np.frombuffer(tensor, np.uint8).reshape(-1, 3)
        sums = rgb.sum(axis=0, dtype=np.int64).tolist()
        return {"feature": f"{len(rgb) // width}x{width}:" + ":".join(map(str, sums)) + f":{crc32(tensor):08x}"}

    return decoded(df, "tensor", keep, one, {"feature": "string"}, "width")


def stored_digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of stored texts: digests of the payload read back from the file, of the file, and a feature of its RGB tensor column.

    Rows come back one for one, repeated and null ids included; an empty table gives none.
    """
    keep = {id_col: "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string"}
    return tensor_features(read_back(df, id_col), keep)


def decoded(df: DataFrame, media_col: str, keep: dict[str, str], fn, out: dict[str, str], arg: str | None = None) -> DataFrame:
    from .common import ARROW

    size = F.col(arg).cast("bigint") if arg else F.lit(None).cast("bigint")
    narrow = df.select(*[F.col(k).cast(t).alias(f"_k{i}") for i, (k, t) in enumerate(keep.items())], size.alias("_n"), F.col(media_col).cast("binary").alias("_m"))
    n = len(keep)

    def run(batches):
        for b in slices(batches, "_m", 1 << 20):
            made = [fn(m, k) for m, k in zip(b.column("_m").to_pylist(), b.column("_n").to_pylist())]
            cols = [b.column(i) for i in range(n)] + [pa.array([r[k] for r in made], ARROW[t]) for k, t in out.items()]
            yield pa.RecordBatch.from_arrays(cols, names=[f"_k{i}" for i in range(n)] + list(out))

    schema = ", ".join([f"`_k{i}` {t}" for i, t in enumerate(keep.values())] + [f"`{k}` {t}" for k, t in out.items()])
    return narrow.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], *out)
