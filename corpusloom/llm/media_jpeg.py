"""Progressive JPEG as a media column: a lossless store for bytes, and a decoder to full-resolution RGB.

The format's unit is the quantised coefficient. Payload bytes are the AC coefficients of 8x8 blocks, 63 a
block, in 4:2:0 colour, with a quantiser of 1: byte b is coefficient b (128 to 255) or b - 255 (0 to 127),
so all have eight significant bits and the Huffman tables need a single one-bit code. Scans: all DC
(zero), the luma band 1-5, the luma band 6-63, either chroma band, all without their last bit; then the
DC refinement and one refinement of each component.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays,
transforms them back in numpy (integers throughout, so equal files give equal pixels whatever they are
decoded with), doubles the chroma and gives full-resolution RGB tensors, a column of decoded(). Scans
whose tables have one code are read for whole batches at once; those of any other Huffman-coded progressive
file go through the general bit reader. Both add to the same coefficient arrays, and payloads are read back from these.

Cases: null and empty texts are a payload of 64 zero bytes. Texts of any length are stored whole, in one
picture. Repeated rows give equal files. A null media, and a file that is no Huffman-coded progressive
JPEG or ends early, give no tensor and the reason in `error`; a file without a payload length has no
payload. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, PER = 64, 63
#: The order in which a block's coefficients are sent: along the diagonals of an 8x8 square.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_TALL = 4095  # MCUs of 16 rows that fit into 65,535 rows
_STEP_BYTES = 1 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK)), len(data)


def shape(n_bytes: int) -> tuple[int, int]:
    """Width and height in MCUs (six blocks each) of the picture that holds a payload."""
    blocks = -(-n_bytes // PER)
    mcus = -(-blocks // 6)
    width = -(-mcus // _TALL)
    return width, -(-mcus // width)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int) -> bytes:
    """A Huffman table with one code, the bit 0."""
    return _segment(0xC4, bytes([kind, 1]) + bytes(15) + bytes([symbol]))


def _scan(components: list[int], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, body)


_HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
_ZERO_DC, _SEVEN, _END = _table(0x00, 0x00), _table(0x10, 0x07), _table(0x10, 0x00)
_DC1, _DC2 = _scan([1, 2, 3], 0, 0, 0, 1), _scan([1, 2, 3], 0, 0, 1, 0)
_FIRST = [_scan([1], 1, 5, 0, 1), _scan([1], 6, 63, 0, 1), _scan([2], 1, 63, 0, 1), _scan([3], 1, 63, 0, 1)]
_AGAIN = [_scan([c], 1, 63, 1, 0) for c in (1, 2, 3)]


def _flags(n: int) -> bytes:
    """n zero bits, filled up with ones to whole bytes."""
    return bytes(n // 8) + (bytes([0xFF >> n % 8]) if n % 8 else b"")


def encode(payloads: list[bytes]) -> list[bytes]:
    """The payloads' files; their blocks are worked on in one array."""
    sizes = [shape(len(p)) for p in payloads]
    blocks = [6 * w * h for w, h in sizes]
    joined = b"".join(p + bytes(n * PER - len(p)) for p, n in zip(payloads, blocks, strict=True))
    data = np.frombuffer(joined, np.uint8).reshape(-1, PER)
    halves = data >> 1
    # the last bit of the magnitude: of b for 128 to 255, of 255 - b below
    low = (data & 1) ^ (data < 128)
    again = np.packbits(np.pad(low, ((0, 0), (1, 0))), axis=1)  # a zero bit, the end of block, then the correction bits
    out, at = [], 0
    for (w, h), n in zip(sizes, blocks, strict=True):
        y, c = 4 * w * h, w * h
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [_HEAD, _segment(0xC2, frame), _ZERO_DC, _DC1, _flags(n), _SEVEN]
        bands = [halves[at : at + y, :5], halves[at : at + y, 5:], halves[at + y : at + y + c], halves[at + y + c : at + n]]
        for head, band in zip(_FIRST, bands, strict=True):
            parts += [head, band.tobytes()]
        parts += [_DC2, _flags(n), _END]
        for head, rows in zip(_AGAIN, (again[at : at + y], again[at + y : at + y + c], again[at + y + c : at + n]), strict=True):
            parts += [head, rows.tobytes().replace(b"\xff", b"\xff\x00")]
        out.append(b"".join([*parts, b"\xff\xd9"]))
        at += n
    return out


class Picture:
    """A parsed file: its frame, its quantisers and its scans with the Huffman tables that hold for each."""

    def __init__(self, data: bytes):
        self.quantisers: dict[int, np.ndarray] = {}
        self.components: list[list[int]] = []  # id, horizontal, vertical, quantiser
        self.scans: list[tuple] = []  # component indices, table numbers, first, last, high, low, data, tables, restart
        tables: dict[int, dict] = {}
        restart = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            marker, length = data[at + 1], 0
            if marker == 0xD9:
                return
            length = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    size = 128 if wide else 64
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[1 + size :]
            elif marker == 0xC4:
                tables = dict(tables)
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                n = body[0]
                order = [c[0] for c in self.components]
                which = [order.index(body[1 + 2 * i]) for i in range(n)]
                found = _MARKER.search(data, at)
                end = found.start() if found else len(data)
                first, last, approx = body[1 + 2 * n : 4 + 2 * n]
                self.scans.append((which, [body[2 + 2 * i] for i in range(n)], first, last, approx >> 4, approx & 15, data[at:end], tables, restart))
                at = end
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a Huffman-coded progressive file")

    def grid(self, i: int) -> tuple[int, int, int, int]:
        """Of component i: blocks that hold samples, across and down, and blocks with those that fill the last MCUs."""
        h = max(c[1] for c in self.components)
        v = max(c[2] for c in self.components)
        across, down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        _, ch, cv, _ = self.components[i]
        return -(-self.width * ch // (8 * h)), -(-self.height * cv // (8 * v)), across * ch, down * cv

    def plain(self) -> bool:
        """Whether the scans are those that encode() writes."""
        if [c[1:3] for c in self.components] != [[2, 2], [1, 1], [1, 1]] or len(self.scans) != 9 or self.width % 16 or self.height % 16:
            return False
        single = all(len(t[k][1]) == 1 for s in self.scans for t in (s[7],) for k in ((0x00,) if s[2] == 0 else (0x10,)))
        return single and [s[0] + list(s[2:6]) for s in self.scans] == _SCRIPT and all(s[7][0x10][1] == b"\x07" for s in self.scans[1:5])


_SCRIPT = [
    [0, 1, 2, 0, 0, 0, 1], [0, 1, 5, 0, 1], [0, 6, 63, 0, 1], [1, 1, 63, 0, 1], [2, 1, 63, 0, 1],
    [0, 1, 2, 0, 0, 1, 0], [0, 1, 63, 1, 0], [1, 1, 63, 1, 0], [2, 1, 63, 1, 0],
]


class _Bits:
    def __init__(self, data: bytes):
        clean = re.sub(rb"\xff[\xd0-\xd7]", b"", data).replace(b"\xff\x00", b"\xff")
        self.value, self.left = int.from_bytes(clean, "big"), 8 * len(clean)
        self.text = bin(self.value | 1 << self.left)[3:] if clean else ""
        self.at = 0

    def bit(self) -> int:
        self.at += 1
        return self.text[self.at - 1] == "1" if self.at <= len(self.text) else 1

    def take(self, n: int) -> int:
        made = self.text[self.at : self.at + n].ljust(n, "1")
        self.at += n
        return int(made, 2) if n else 0

    def symbol(self, codes: dict[str, int]) -> int:
        for n in range(1, 17):
            found = codes.get(self.text[self.at : self.at + n].ljust(n, "1"))
            if found is not None:
                self.at += n
                return found
        raise ValueError("no such code")


def _codes(table: tuple[bytes, bytes]) -> dict[str, int]:
    out, code, at = {}, 0, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            out[format(code, f"0{n}b")] = table[1][at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _signed(value: int, n: int) -> int:
    return value if not n or value >> (n - 1) else value - (1 << n) + 1


def coefficients(picture: Picture) -> list[np.ndarray]:
    """Each component's blocks (row by row) by 64 coefficients in sending order, from all scans: the general way."""
    out = [np.zeros((picture.grid(i)[2] * picture.grid(i)[3], 64), np.int32) for i in range(len(picture.components))]
    for which, numbers, first, last, high, low, data, tables, restart in picture.scans:
        pieces = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
        if len(which) == 1:
            w, h, stride, _ = picture.grid(which[0])
            units = [[(which[0], r * stride + c)] for r in range(h) for c in range(w)]
        else:
            one = picture.components
            across = picture.grid(which[0])[2] // one[which[0]][1]
            down = picture.grid(which[0])[3] // one[which[0]][2]
            units = [
                [(i, (r * one[i][2] + y) * picture.grid(i)[2] + c * one[i][1] + x) for i in which for y in range(one[i][2]) for x in range(one[i][1])]
                for r in range(down)
                for c in range(across)
            ]
        codes = [_codes(tables[n >> 4 if not first else 0x10 | n & 15]) if not (high and not first) else {} for n in numbers]
        by_component = dict(zip(which, codes, strict=True))
        step = restart or len(units)
        for k, piece in enumerate(pieces):
            bits, before, run = _Bits(piece), dict.fromkeys(which, 0), 0
            for unit in units[k * step : (k + 1) * step]:
                for i, block in unit:
                    row = out[i][block]
                    if not first:
                        if high:
                            row[0] |= bits.bit() << low
                        else:
                            n = bits.symbol(by_component[i])
                            before[i] += _signed(bits.take(n), n)
                            row[0] = before[i] << low
                    elif high:
                        run = _refine(bits, row, by_component[i], first, last, low, run)
                    else:
                        run = _first(bits, row, by_component[i], first, last, low, run)
    return out


def _first(bits: _Bits, row: np.ndarray, codes: dict, k: int, last: int, low: int, run: int) -> int:
    if run:
        return run - 1
    while k <= last:
        symbol = bits.symbol(codes)
        zeros, n = symbol >> 4, symbol & 15
        if n:
            k += zeros
            row[k] = _signed(bits.take(n), n) * (1 << low)
        elif zeros < 15:
            return (1 << zeros) + bits.take(zeros) - 1
        else:
            k += 15
        k += 1
    return 0


def _refine(bits: _Bits, row: np.ndarray, codes: dict, k: int, last: int, low: int, run: int) -> int:
    step = 1 << low

    def correct(i: int) -> None:
        if bits.bit():
            row[i] += step if row[i] > 0 else -step

    while k <= last and not run:
        symbol = bits.symbol(codes)
        zeros, n = symbol >> 4, symbol & 15
        fresh = 0
        if n:
            fresh = step if bits.bit() else -step
        elif zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        while k <= last:
            if row[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                row[k] = fresh
                k += 1
                break
            k += 1
    if run:
        for i in range(k, last + 1):
            if row[i]:
                correct(i)
        return run - 1
    return 0


def plain_coefficients(pictures: list[Picture]) -> np.ndarray:
    """coefficients() of plain pictures, all components and pictures one after another, scan by scan for whole bands at once."""
    counts = [(p.width // 16) * (p.height // 16) for p in pictures]
    out = np.zeros((6 * sum(counts), 64), np.int16)
    at = 0
    for picture, n in zip(pictures, counts, strict=True):
        spans = (slice(at, at + 4 * n), slice(at + 4 * n, at + 5 * n), slice(at + 5 * n, at + 6 * n))
        at += 6 * n
        for which, _, first, last, high, low, data, *_ in picture.scans:
            if not first:
                continue  # one code for a difference of nothing, and correction bits of zero: see plain()
            part = out[spans[which[0]], first : last + 1]
            if high:
                rows = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8).reshape(len(part), -1)
                bits = np.unpackbits(rows, axis=1)[:, 1 : last - first + 2].astype(np.int16)
                part += (bits << low) * np.sign(part)
            else:
                # a code of one bit, 0, then seven bits of a value: one byte a coefficient
                raw = np.frombuffer(data, np.uint8).reshape(len(part), -1).astype(np.int16)
                part += np.where(raw < 64, raw - 127, raw) << low
    return out


def coefficients_to_bytes(rows: np.ndarray) -> np.ndarray:
    """The payload bytes of blocks: AC coefficients 128 to 255 are themselves, those of -255 to -128 stand for 0 to 127."""
    ac = rows[:, 1:]
    return np.where(ac < 0, ac + 255, ac).astype(np.uint8)


def _basis() -> np.ndarray:
    """64 x 64: sample (row by row) of each coefficient (sending order), times 4096, in whole numbers."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * 4096)


_SAMPLES = _basis()


def samples(coefficients: np.ndarray) -> np.ndarray:
    """Inverse transform: blocks x 64 samples, 0 to 255. Products and sums are whole numbers below 2^53, so their order has no effect."""
    out = np.empty(coefficients.shape, np.uint8)
    for lo in range(0, len(coefficients), 1 << 14):
        part = coefficients[lo : lo + (1 << 14)]
        kind = np.float32 if np.abs(part).max(initial=0) <= 255 else np.float64  # sums stay below 2^24 there
        made = part.astype(kind) @ _SAMPLES.astype(kind)
        out[lo : lo + (1 << 14)] = np.clip((made.astype(np.int64 if kind is np.float64 else np.int32) + 2048 >> 12) + 128, 0, 255)
    return out


def rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-range YCbCr samples of one shape to RGB along a last axis, in 16-bit fixed point."""
    y, cb, cr = (c.astype(np.int32) for c in (y, cb, cr))
    cb, cr = cb - 128, cr - 128
    red = y + (91881 * cr + 32768 >> 16)
    green = y - (22554 * cb + 46802 * cr + 32768 >> 16)
    blue = y + (116130 * cb + 32768 >> 16)
    return np.clip(np.stack([red, green, blue], -1), 0, 255).astype(np.uint8)


def tensor(picture: Picture, found: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3 (or x 1 for grey files) from each component's coefficients."""
    planes = []
    top_h, top_v = max(c[1] for c in picture.components), max(c[2] for c in picture.components)
    for i, rows in enumerate(found):
        _, _, w, h = picture.grid(i)
        made = samples(rows * picture.quantisers[picture.components[i][3]])
        plane = made.reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
        plane = plane.repeat(top_v // picture.components[i][2], 0).repeat(top_h // picture.components[i][1], 1)
        planes.append(plane[: picture.height, : picture.width])
    return rgb(*planes) if len(planes) == 3 else planes[0][..., None]


def decode(data: bytes) -> np.ndarray:
    """The tensor of any Huffman-coded progressive file."""
    picture = Picture(data)
    return tensor(picture, coefficients(picture))


def store(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, media (the file)."""

    def start():
        def work(columns):
            held = [payload_of(t) for t in columns[1]]
            return [columns[0], [n for _, n in held], [len(p) for p, _ in held], encode([p for p, _ in held])]

        return work

    return common.map_text(docs, ["doc_id", "text"], "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary", start)


def read_media(media: list[bytes | None], sizes: list[int | None]) -> list[tuple[bytes | None, np.ndarray | None, str | None]]:
    """Payload, RGB tensor and error of each file; sizes: the payloads' lengths (None: a file without a payload)."""
    out: list = [None] * len(media)
    held: list[tuple[int, Picture, int]] = []
    count = 0

    def flush():
        pictures = [p for _, p, _ in held]
        rows = plain_coefficients(pictures)
        at = 0
        for k, p, size in held:
            n = (p.width // 16) * (p.height // 16)
            own = rows[at : at + 6 * n]
            at += 6 * n
            pixels = tensor(p, [own[: 4 * n], own[4 * n : 5 * n], own[5 * n :]])
            out[k] = (None if size is None else coefficients_to_bytes(own).tobytes()[:size], pixels, None)
        held.clear()

    for k, (blob, size) in enumerate(zip(media, sizes, strict=True)):
        if blob is None:
            out[k] = (None, None, "no media")
            continue
        try:
            picture = Picture(blob)
            if picture.plain():
                held.append((k, picture, size))
                count += len(blob)
            else:
                found = coefficients(picture)
                payload = None if size is None else coefficients_to_bytes(np.concatenate(found)).tobytes()[:size]
                out[k] = (payload, tensor(picture, found), None)
        except (ValueError, IndexError, KeyError, AttributeError, struct.error) as error:
            out[k] = (None, None, f"{type(error).__name__}: {error}")
        if count >= _STEP_BYTES:
            flush()
            count = 0
    if held:
        flush()
    return out


DECODED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary, payload binary, height int, width int, channels int, rgb binary, error string"


def decoded(stored: DataFrame) -> DataFrame:
    """Reads a media column: per row DECODED, with the payload read back and the full-resolution tensor (rgb: height x width x channels bytes).

    stored: doc_id, n_bytes, payload_bytes (may be null), media. Write it as a table to keep the tensors.
    """

    def start():
        def work(columns):
            rows = [
                (p, *(x.shape if x is not None else (None, None, None)), None if x is None else x.tobytes(), e)
                for p, x, e in read_media(columns[3], columns[2])
            ]
            return [*columns, *map(list, zip(*rows, strict=True))]

        return work

    return common.map_text(stored, ["doc_id", "n_bytes", "payload_bytes", "media"], DECODED, start, text="media")


def digests(read: DataFrame) -> DataFrame:
    """Of decoded(): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (shape and checksum of the tensor)."""
    shape_of = F.concat_ws("x", "height", "width", "channels")
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat(shape_of, F.lit(":"), F.lower(F.lpad(F.hex(F.crc32("rgb")), 8, "0"))).alias("feature"),
    )
