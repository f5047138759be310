"""Reading and writing TIFF.

``pages`` walks the chain of image directories of a file, decodes each image's strips or tiles (uncompressed, PackBits, LZW
or deflate), undoes horizontal differencing and yields a record per page. ``write`` makes files of 8-bit pages.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format (TIFF 6.0 and its supplements).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257


class TiffError(ValueError):
    """The bytes aren't a TIFF file that this module reads."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: np.ndarray  # height x width x samples, 8-bit


def packbits_encode(raw: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(raw)
    while at < n:
        run = 1
        while run < 128 and at + run < n and raw[at + run] == raw[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, raw[at]))
            at += run
            continue
        stop = at + 1
        while stop < n and stop - at < 128 and not (stop + 1 < n and raw[stop] == raw[stop + 1]):
            stop += 1
        out.append(stop - at - 1)
        out += raw[at:stop]
        at = stop
    return bytes(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(raw):
            raise TiffError("PackBits data ends early")
        head = raw[at]
        if head < 128:
            out += raw[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += raw[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def lzw_encode(raw: bytes) -> bytes:
    codes, bits = [], []

    def put(code: int, width: int) -> None:
        codes.append(code)
        bits.append(width)

    table = {bytes((i,)): i for i in range(256)}
    free, width = 258, 9
    put(CLEAR, 9)
    held = b""
    for i in range(len(raw)):
        grown = held + raw[i : i + 1]
        if grown in table:
            held = grown
            continue
        put(table[held], width)
        table[grown] = free
        free += 1
        if free >= 4094:
            put(CLEAR, width)
            table = {bytes((k,)): k for k in range(256)}
            free, width = 258, 9
        elif free == 1 << width:
            width += 1
        held = raw[i : i + 1]
    if held:
        put(table[held], width)
        free += 1
        if free == 1 << width and width < 12:
            width += 1
    put(END, width)
    value = total = 0
    out = bytearray()
    for code, n in zip(codes, bits):
        value, total = (value << n) | code, total + n
        while total >= 8:
            total -= 8
            out.append(value >> total & 255)
        value &= (1 << total) - 1
    if total:
        out.append(value << (8 - total) & 255)
    return bytes(out)


def lzw_decode(raw: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out = bytearray()
    value = held = at = 0
    width, last = 9, None
    while len(out) < size:
        while held < width:
            if at >= len(raw):
                raise TiffError("LZW data ends early")
            value, held, at = (value << 8) | raw[at], held + 8, at + 1
        held -= width
        code = value >> held
        value &= (1 << held) - 1
        if code == CLEAR:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, None
            continue
        if code == END:
            break
        if last is None:
            if code >= len(table):
                raise TiffError("LZW code outside the table")
            piece = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code outside the table")
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out += piece
        last = piece
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    if len(out) < size:
        raise TiffError("LZW data ends early")
    return bytes(out[:size])


def inflate(raw: bytes, size: int) -> bytes:
    """At most ``size`` bytes, so that a small file can't grow without bound."""
    try:
        out = zlib.decompressobj().decompress(raw, size) if size else b""
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None
    if len(out) < size:
        raise TiffError("deflate data ends early")
    return out


def _stored(raw: bytes, size: int) -> bytes:
    if len(raw) < size:
        raise TiffError("strip or tile ends early")
    return raw[:size]


DECODERS = {NONE: _stored, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}
#: Bytes that a byte of a strip can become at most: a run of 128 of 2 bytes; strings of up to 3838 of 9 bits and more; runs of 258 of 2 bits.
MOST_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 3_500, DEFLATE: 1_040, OLD_DEFLATE: 1_040}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda raw: zlib.compress(raw, 1), PACKBITS: packbits_encode}


def _fields(raw: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    if at + 2 > len(raw):
        raise TiffError("image directory outside the file")
    (n,) = struct.unpack_from(order + "H", raw, at)
    if at + 6 + 12 * n > len(raw):
        raise TiffError("image directory ends early")
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        size = FIELD_SIZES[kind] * count
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", raw, place)
        if place + size > len(raw):
            raise TiffError(f"field {tag} outside the file")
        found[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", raw, place)
    (after,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
    return found, after


def _covered(offsets: tuple[int, ...], sizes: tuple[int, ...]) -> int:
    """Distinct bytes of the parts; bytes that several name count once."""
    total, end = 0, 0
    for offset, size in sorted(zip(offsets, sizes)):
        total += max(0, offset + size - max(offset, end))
        end = max(end, offset + size)
    return total


def _image(raw: bytes, f: dict[int, tuple[int, ...]], index: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        got = f.get(tag)
        if not got:
            if default is None:
                raise TiffError(f"field {tag} is missing")
            return default
        return got[0]

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if set(f.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise TiffError("only 8-bit samples in one plane are read")
    if compression not in DECODERS or predictor not in (1, 2):
        raise TiffError(f"compression {compression} with predictor {predictor} is not read")
    tiled = TILE_OFFSETS in f
    if tiled:
        tall, wide = one(TILE_HEIGHT), one(TILE_WIDTH)
        offsets, sizes = f[TILE_OFFSETS], f.get(TILE_BYTES, ())
    else:
        tall, wide = min(one(ROWS_PER_STRIP, height) or height, max(height, 1)), width
        offsets, sizes = f.get(STRIP_OFFSETS, ()), f.get(STRIP_BYTES, ())
    if not (width and height and samples and tall and wide):
        raise TiffError("an image side is 0")
    across, down = -(-width // wide), -(-height // tall)
    if len(offsets) != across * down or len(sizes) != len(offsets):
        raise TiffError("strips or tiles don't cover the image")
    room = down * tall * across * wide * samples if tiled else height * width * samples
    if any(offset + size > len(raw) for offset, size in zip(offsets, sizes)):
        raise TiffError("strip or tile outside the file")
    if room > MOST_GROWTH[compression] * _covered(offsets, sizes):  # the sides are only claimed; what data can fill them is in the file, and counts once
        raise TiffError("the image is larger than its data can be")
    try:
        out = np.empty((down * tall if tiled else height, across * wide, samples), dtype=np.uint8)
    except MemoryError:
        raise TiffError("the image doesn't fit into memory") from None
    for k, (offset, size) in enumerate(zip(offsets, sizes)):
        y, x = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - y)
        part = np.frombuffer(DECODERS[compression](raw[offset : offset + size], rows * wide * samples), dtype=np.uint8).reshape(rows, wide, samples)
        out[y : y + rows, x : x + wide] = np.cumsum(part, axis=1, dtype=np.uint8) if predictor == 2 else part
    return Page(index, width, height, samples, compression, predictor, tiled, out[:height, :width])


def pages(raw: bytes) -> Iterator[Page]:
    """Every page of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    seen: set[int] = set()
    index = 0
    while at:
        if at in seen:
            raise TiffError("image directories form a loop")
        seen.add(at)
        fields, at = _fields(raw, at, order)
        yield _image(raw, fields, index)
        index += 1


def write(
    images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 16, tile: tuple[int, int] | None = None, order: str = "<"
) -> bytes:
    """A file of 8-bit pages (height x width, or height x width x samples)."""
    out = bytearray(({"<": b"II", ">": b"MM"}[order]) + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        tall, wide = tile or (rows_per_strip, width)
        offsets, sizes = [], []
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                part = image[y : y + tall, x : x + wide]
                if tile and part.shape[:2] != (tall, wide):
                    part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.uint8(0))
                packed = ENCODERS[compression](np.ascontiguousarray(part).tobytes())
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed
        fields = [
            (WIDTH, 4, [width]),
            (HEIGHT, 4, [height]),
            (BITS, 3, [8] * samples),
            (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [1 if samples < 3 else 2]),
            *([] if tile else [(STRIP_OFFSETS, 4, offsets)]),
            (SAMPLES, 3, [samples]),
            *([] if tile else [(ROWS_PER_STRIP, 4, [tall]), (STRIP_BYTES, 4, sizes)]),
            (PREDICTOR, 3, [predictor]),
            *([(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [tall]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else []),
        ]
        entries = []
        for tag, kind, values in fields:
            data = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I'}[kind] }", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack(order + "I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + place)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
