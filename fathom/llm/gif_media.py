"""Operator 7: GIF media columns as timed frames with colour histograms.

Decoding is array work. The width of the k-th LZW code after a clear is known beforehand, so a segment's
codes are cut from the bits at once. A code's string is one that was already written, one symbol longer,
so lengths come from doubling along the codes' references and every pixel from doubling along "copy from"
pointers: about log2(longest string) passes over the image, and no per-code loop. Palettes (local over
global), interlacing, transparency and disposal 0-3 then act on an RGBA canvas.

Plan: a map over (id, media) in Arrow batches that yields a few frames at a time; no shuffle. The test
tables hold no media, so render() makes some of a text column: every byte of a text becomes a pixel,
64 columns wide, in as many frames as it takes, with local palettes, transparency, interlacing, all
disposals and real LZW.

Defined results: null media gives no rows. Media that isn't a GIF, is cut off or is broken gives its sound
frames and then one row whose error says what is wrong and whose frame columns are null; so does an empty
value. A GIF without images gives no rows. Ids may be of any type, null, or repeat. A canvas or image of more than
most_pixels pixels (2**26 unless said otherwise: 256 MB of RGBA) gives an error row too. Other columns are never read.
A histogram has 64 counts, by the two leading bits of red, green and blue, of the canvas's opaque pixels.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.scratch import small_batches

FRAME = "frame int, width int, height int, start_ms long, delay_ms int, disposal int, rgba binary, opaque int, histogram array<int>, error string"
_ARROW = pa.schema([("frame", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("rgba", pa.binary()), ("opaque", pa.int32()), ("histogram", pa.list_(pa.int32())), ("error", pa.string())])
BATCH_BYTES = 4 << 20
#: The most pixels that a canvas or image is given memory for.
MOST_PIXELS = 1 << 26
COLUMNS, ROWS = 64, 64


class Broken(ValueError):
    """Not decodable from here on."""


def _codes(bits: np.ndarray, raw: np.ndarray, at: int, least: int, k0: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes from bit at on, the first being the k0-th since the clear, and each one's end bit."""
    room = min(8192, max(0, (bits.size - at) // (least + 1)))
    k = np.arange(k0, k0 + room)
    following = (1 << least) + 2 + np.maximum(k - 1, 0)
    width = np.minimum(np.maximum(np.frexp(following)[1], least + 1), 12)
    end = at + np.cumsum(width)
    keep = end <= bits.size
    width, end = width[keep], end[keep]
    begin = end - width
    byte = begin >> 3
    word = raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2].astype(np.int64) << 16
    return (word >> (begin & 7)) & ((1 << width) - 1), end


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The pixels of one segment, the codes between two clears."""
    n = len(codes)
    literal = codes < clear
    entry = codes - clear - 2
    own = np.arange(n)
    if n and (not literal[0] or (entry[~literal] >= own[~literal]).any()):
        raise Broken("an LZW code refers to a string that isn't there yet")
    parent = np.where(literal, own, np.maximum(entry, 0))
    grown, back = (~literal).astype(np.int64), parent
    while True:
        further = back[back]
        if (further == back).all():
            break
        grown = grown + grown[back]
        back = further
    size = grown + 1
    start = np.cumsum(size) - size
    copied = np.repeat(np.where(literal, 0, start[parent] - start), size) + np.arange(size.sum())
    while True:
        further = copied[copied]
        if (further == copied).all():
            break
        copied = further
    pixel = np.zeros(len(copied), np.int64)
    pixel[start[literal]] = codes[literal]
    return pixel[copied].astype(np.uint8)


def lzw_decode(data: bytes, least: int, most: int) -> np.ndarray:
    """Up to most pixels of a code stream."""
    if not 1 <= least <= 8:
        raise Broken("bad LZW code size")
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    bits = np.empty(len(data) * 8, bool)  # only its size is used
    clear, at, parts, have = 1 << least, 0, [], 0
    segment: list[np.ndarray] = []
    ended = False
    while not ended and have < most:
        codes, end = _codes(bits, raw, at, least, sum(map(len, segment)))
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            segment.append(codes[: stop[0]])
            at, ended = int(end[stop[0]]), codes[stop[0]] == clear + 1
        elif len(codes):
            segment.append(codes)
            at = int(end[-1])
            continue
        else:
            ended = True
        parts.append(_expand(np.concatenate(segment), clear))
        have += len(parts[-1])
        segment = []
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return out[:most]


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << ((flags & 7) + 1)
    if at + n > len(data):
        raise Broken("the palette is cut off")
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise Broken("a data block is cut off")
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise Broken("a data block is cut off")
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def frames(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[dict]:
    """The GIF's frames as they are shown; raises Broken after the last sound one."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise Broken("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if not 0 < width * height <= most_pixels:
        raise Broken("a canvas of this size isn't decoded")
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((height, width), "<u4")  # red, green, blue and opacity, a byte each
    number = clock = delay = disposal = 0
    clear_index = -1
    while True:
        if at >= len(data):
            raise Broken("the trailer is missing")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                clear_index = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise Broken("an unknown block")
        x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if flags & 0x80:
            palette, at = _palette(data, at, flags)
        if palette is None:
            raise Broken("no palette")
        if at >= len(data):
            raise Broken("a data block is cut off")
        if w * h > most_pixels:
            raise Broken("an image of this size isn't decoded")
        least = data[at]
        body, at = _blocks(data, at + 1)
        index = lzw_decode(body, least, w * h)
        if len(index) < w * h:
            raise Broken("the code stream ends early")
        index = index.reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(rows)]
        if index.size and index.max() >= len(palette):
            raise Broken("a colour index beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        view = canvas[y : y + h, x : x + w]
        index = index[: view.shape[0], : view.shape[1]]
        colour = np.c_[palette, np.full(len(palette), 255, np.uint8)].view("<u4").ravel()[index]
        np.copyto(view, colour, where=index != clear_index)
        opaque = canvas[canvas >= 255 << 24]
        cell = opaque >> 2 & 48 | opaque >> 12 & 12 | opaque >> 22 & 3
        yield {"frame": number, "width": width, "height": height, "start_ms": clock, "delay_ms": delay, "disposal": disposal, "rgba": canvas.tobytes(), "opaque": len(opaque), "histogram": np.bincount(cell, minlength=64).tolist(), "error": None}
        if disposal == 2:
            view[:] = 0
        elif disposal == 3:
            canvas = before
        number, clock, delay, disposal, clear_index = number + 1, clock + delay, 0, 0, -1


def gif_frames(media: DataFrame, id_column: str, media_column: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """The id (as id_column) and FRAME's columns of every frame."""
    small_batches(media.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, size = None, [], 0
        for batch in batches:
            schema = schema or _ARROW.insert(0, pa.field(id_column, batch.schema.field(0).type))
            ids = batch.column(0).to_pylist()
            for key, value in zip(ids, batch.column(1)):
                if not value.is_valid:
                    continue
                try:
                    for frame in frames(value.as_py(), most_pixels):
                        rows.append({id_column: key} | frame)
                        size += len(frame["rgba"])
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except Broken as e:
                    rows.append({id_column: key, "error": str(e)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(F.col(id_column), F.col(media_column).cast("binary")).mapInArrow(decode, f"`{id_column}` {kind}, {FRAME}")


def lzw_encode(pixels: bytes, least: int) -> bytes:
    """A code stream of the pixels, with a clear first and whenever the table is full."""
    clear = 1 << least
    codes, table = [clear], {}
    emit, known = codes.append, table.get
    following, code = clear + 2, pixels[0] if pixels else -1
    for p in pixels[1:]:
        key = code << 8 | p
        longer = known(key)
        if longer is not None:
            code = longer
            continue
        emit(code)
        code = p
        if following == 4096:
            emit(clear)
            table.clear()
            following = clear + 2
        else:
            table[key] = following
            following += 1
    if code >= 0:
        emit(code)
    emit(clear + 1)
    c = np.array(codes)
    # The width of a code depends only on its place since the last clear before it.
    own = np.arange(len(c))
    last = np.r_[-1, np.maximum.accumulate(np.where(c == clear, own, 0))[:-1]]
    width = np.minimum(np.maximum(np.frexp(clear + own - last)[1], least + 1), 12)
    width[0] = least + 1
    end = np.cumsum(width)
    byte, shifted = (end - width) >> 3, c << ((end - width) & 7)
    size = -(-int(end[-1]) // 8)
    out = sum(np.bincount(byte + k, shifted >> 8 * k & 255, size + 2) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _ramp(turn: int) -> bytes:
    c = (np.arange(256, dtype=np.int64) * (2 * turn + 1) * 37 + turn * 91) & 255
    return np.stack([c, np.roll(c, 85), np.roll(c, 170)], axis=1).astype(np.uint8).tobytes()


def encode(data: bytes, columns: int = COLUMNS, rows: int = ROWS) -> bytes:
    """An animated GIF in which every byte of data is a pixel."""
    per = columns * rows
    count = max(1, -(-len(data) // per))
    height = min(rows, max(1, -(-len(data) // columns)))
    out = [b"GIF89a", struct.pack("<HHBBB", columns, height, 0xF7, 0, 0), _ramp(0), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for k in range(count):
        part = data[k * per : (k + 1) * per]
        h = max(1, -(-len(part) // columns))
        part = part.ljust(columns * h, b" ")
        interlaced, local = k % 5 == 4, k % 2
        if interlaced:
            order = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, b)]
            part = b"".join(part[r * columns : (r + 1) * columns] for r in order)
        stream = lzw_encode(part, 8)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, (k % 4) << 2 | (k % 3 == 1), 4 + k % 7, 32, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, columns, h, 0x87 * local | 0x40 * interlaced), _ramp(k) if local else b"", b"\x08"]
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)] + [b"\x00"]
    return b"".join(out) + b"\x3b"


def render(text: Column) -> Column:
    """GIF bytes of a text column; null for null."""

    @F.arrow_udf("binary")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else encode(t.encode()) for t in texts.to_pylist()], pa.binary())

    return make(text)
