"""GIF media columns: timed frames with colour histograms, and GIF as lossless storage.

``read_frames`` decodes GIF bytes into a row for each frame: the LZW code
stream is decoded, the local or global palette applied, transparent pixels
let the canvas show through, and the disposal rule (keep, restore to
background, restore to previous) is carried out before the next frame.
``write_gif`` stores 8-bit samples losslessly under a grey palette, by LZW with
its dictionary. A stored text also has a last frame, a small mark under a
palette of its own with a transparent colour that is undone after its time; it
holds no payload. What is read back comes through the one decoder.

Null and empty media, and media that are no GIF, have no frames. Media of any
length are read frame by frame; ``key`` must not be named like a result column. A damaged
stream gives the pixels up to the damage; the rest of the frame is index 0.
Repeated rows get equal frames; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import arrow_map, slices

UNIT = 192
FRAME_ROWS = 256
DELAY_MS = 40
BINS = 16
_FULL = 4096  # entries of a code table
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Disposal rules of stored frames: the payload's stay, the mark goes.
KEEP, UNDO = 1, 3
_MARK = ((0, 1, 1, 0, 2, 2, 0, 3), (1, 0, 0, 1, 2, 0, 2, 3), (1, 1, 1, 1, 2, 2, 0, 3), (1, 0, 0, 1, 2, 0, 2, 3))
_MARK_COLOURS = bytes((0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255))


@dataclass
class Frame:
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    canvas: np.ndarray  # rows, columns, RGBA, as shown

    def histogram(self) -> np.ndarray:
        """Pixels in each of ``BINS`` bins of red, then green, then blue, over the frame's own part."""
        own = self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]
        return np.concatenate([np.bincount(own[..., c].ravel() >> 4, minlength=BINS) for c in range(3)])


@cache
def _widths(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and their running sum: they grow as the table does, and no further than it."""
    known = np.minimum(np.arange(2 * _FULL, dtype=np.int64) + (1 << min_size) + 1, _FULL - 1)
    widths = np.maximum(np.frexp(known.astype(np.float64))[1], min_size + 1).astype(np.int64)
    return widths, np.cumsum(widths)


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """A GIF code stream that says ``samples``; a full table is cleared."""
    clear = 1 << min_size
    codes, starts = [clear], [0]
    table: dict[int, int] = {}
    get, free = table.get, clear + 2
    left = iter(samples)
    word = next(left, None)
    if word is not None:
        for c in left:
            key = word << 8 | c
            longer = get(key)
            if longer is not None:
                word = longer
                continue
            codes.append(word)
            word = c
            if free < _FULL:
                table[key] = free
                free += 1
            else:
                starts.append(len(codes))
                codes.append(clear)
                table.clear()
                free = clear + 2
        codes.append(word)
    codes.append(clear + 1)
    # a clear code is as wide as the code that it stands for would be
    ends = [*starts[1:], len(codes) - 1]
    widths = np.concatenate([[min_size + 1], *(_widths(min_size)[0][: end - start] for start, end in zip(starts, ends, strict=True))])
    value = np.array(codes, np.int64)
    end = np.cumsum(widths)
    at = end - widths
    value <<= at & 7
    total = -(-int(end[-1]) // 8)
    out = np.zeros(total + 3)
    for k in range(3):
        out[: total + 2] += np.bincount((at >> 3) + k, (value >> 8 * k) & 255, total + 2)[: total + 2]
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, min_size: int, limit: int) -> np.ndarray:
    """Up to ``limit`` samples of a GIF code stream."""
    clear = 1 << min_size
    padded = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    bits, at, done = 8 * len(data), 0, 0
    parts: list[bytes] = []
    literals = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, last, number = literals.copy(), None, 0
    while done < limit:
        # as many codes as a table has, or up to the next clear or stop code
        widths, ends = _widths(min_size)
        before = int(ends[number - 1]) if number else 0
        upto = min(int(np.searchsorted(ends, bits - at + before, side="right")), number + _FULL)
        if upto == number:
            break
        widths, ends = widths[number:upto], ends[number:upto] + (at - before)
        begin = ends - widths
        byte = begin >> 3
        codes = ((padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16) >> (begin & 7)) & ((1 << widths) - 1)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        count = int(special[0]) if len(special) else len(codes)
        free, broken = len(table), False
        for code in codes[:count].tolist():
            if code < free:
                said = table[code]
            elif last is not None and code == free:
                said = last + last[:1]
            else:
                broken = True
                break
            parts.append(said)
            done += len(said)
            if last is not None and free < _FULL:
                table.append(last + said[:1])
                free += 1
            last = said
        if broken or (len(special) and codes[count] == clear + 1):
            break
        at = int(ends[count if len(special) else -1])
        number = min(number + len(codes), _FULL)  # from there on codes have all bits
        if len(special):
            table, last, number = literals.copy(), None, 0
    return np.frombuffer(b"".join(parts)[:limit], np.uint8)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from ``at`` on, and where they end."""
    if at + 256 * 64 < len(data) and data[at] == 255:  # a long stretch of full blocks is taken at once
        count = (len(data) - at) // 256
        rows = np.frombuffer(data, np.uint8, count * 256, at).reshape(count, 256)
        short = np.flatnonzero(rows[:, 0] != 255)
        count = int(short[0]) if len(short) else count
        rest, end = _blocks(data, at + count * 256) if count else (b"", at)
        if count:
            return rows[:count, 1:].tobytes() + rest, end
    parts = []
    while at < len(data) and (size := data[at]):
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes | None) -> Iterator[Frame]:
    """The frames of a GIF; nothing if it is none."""
    if not data or data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 128:
        size = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3)
        at += size
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            body, end = _blocks(data, at + 2)
            if at + 1 < len(data) and data[at + 1] == 0xF9 and len(body) >= 4:
                delay, disposal = struct.unpack_from("<H", body, 1)[0] * 10, body[0] >> 2 & 7
                clear_index = body[3] if body[0] & 1 else None
            at = end
        elif kind == 0x2C and at + 10 < len(data):
            left, top, wide, high, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if flags & 128:
                size = 3 << ((flags & 7) + 1)
                palette = np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3)
                at += size
            min_size = data[at] if at < len(data) else 8
            stream, at = _blocks(data, at + 1)
            index = np.zeros(wide * high, np.uint8)
            if 1 <= min_size <= 8:
                said = lzw_decode(stream, min_size, wide * high)
                index[: len(said)] = said
            index = index.reshape(high, wide)
            if flags & 64:
                placed = np.empty_like(index)
                placed[_interlaced(high)] = index
                index = placed
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + high, left : left + wide]
            index = index[: part.shape[0], : part.shape[1]]
            colours = np.zeros((256, 4), np.uint8)
            if palette is not None:
                colours[: len(palette), :3] = palette
            colours[:, 3] = 255
            if clear_index is None:
                part[...] = colours[index]
            else:
                part[...] = np.where((index != clear_index)[..., None], colours[index], part)
            yield Frame(delay, left, top, part.shape[1], part.shape[0], disposal, canvas.copy() if disposal in (2, 3) else canvas)
            if disposal == 2:
                canvas = canvas.copy()
                canvas[top : top + high, left : left + wide] = 0
            elif before is not None:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
        else:
            return


def _sub_blocks(stream: bytes) -> bytes:
    whole = len(stream) // 255
    blocks = np.empty((whole, 256), np.uint8)
    blocks[:, 0] = 255
    blocks[:, 1:] = np.frombuffer(stream, np.uint8, whole * 255).reshape(whole, 255)
    rest = stream[whole * 255 :]
    return blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def write_gif(samples: bytes, width: int = UNIT, rows: int = FRAME_ROWS, delay_ms: int = DELAY_MS, mark: bool = False) -> bytes:
    """``samples`` (whole rows of ``width``) as frames of up to ``rows`` rows under a grey palette, and the mark."""
    lines, delay = len(samples) // width, struct.pack("<H", delay_ms // 10)
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0), _GREY]
    for first in range(0, lines, rows):
        high = min(rows, lines - first)
        stream = lzw_encode(samples[first * width : (first + high) * width])
        out += [b"\x21\xf9\x04", bytes([KEEP << 2]), delay, b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, high, 0), b"\x08", _sub_blocks(stream)]
    if mark:
        wide, high = len(_MARK[0]), min(len(_MARK), lines, rows)
        stream = lzw_encode(b"".join(bytes(line) for line in _MARK[:high]), 2)
        out += [b"\x21\xf9\x04", bytes([UNDO << 2 | 1]), delay, b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, wide, high, 0x81), _MARK_COLOURS, b"\x02", _sub_blocks(stream)]
    out.append(b"\x3b")
    return b"".join(out)


FRAME_SCHEMA = "frame int, delay_ms int, left int, top int, width int, height int, disposal int, pixels binary, histogram array<int>"


def read_frames(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """A row for each frame of each GIF: ``key``, place, time, RGBA ``pixels`` of the canvas and colour ``histogram``."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for n, f in enumerate(read_gif(batch.column("media")[k].as_py())):
                    values = [[n], [f.delay_ms], [f.left], [f.top], [f.width], [f.height], [f.disposal]]
                    yield pa.record_batch([batch.column("key").slice(k, 1), *(pa.array(v, pa.int32()) for v in values), pa.array([f.canvas.tobytes()], pa.binary()), pa.array([f.histogram().tolist()], pa.list_(pa.int32()))], names=[key, "frame", "delay_ms", "left", "top", "width", "height", "disposal", "pixels", "histogram"])

    return arrow_map(media.select(F.col(key).alias("key"), F.col(column).alias("media")), run, f"`{key}` {kind}, {FRAME_SCHEMA}")


def payload_of(text: str | None) -> bytes:
    """UTF-8, then blanks up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode()
    return raw + b" " * ((-len(raw) % UNIT) if raw else UNIT)


def store_text(text: str | None) -> bytes:
    return write_gif(payload_of(text), mark=True)


def stored_payload(media: bytes) -> tuple[bytes, str]:
    """The payload that a stored GIF holds, and a feature string: frames, time and summed colour histogram."""
    parts, total, count, time = [], np.zeros(3 * BINS, np.int64), 0, 0
    for f in read_gif(media):
        if f.disposal == KEEP:
            parts.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
        total += f.histogram()
        count, time = count + 1, time + f.delay_ms
    return b"".join(parts), f"frames={count};ms={time};rgb{BINS}=" + ",".join(map(str, total))


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF, reads it back and returns digests of both, with the feature string."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text"):
                    said = text.as_py()
                    media = store_text(said)
                    payload, feature = stored_payload(media)
                    rows.append((len((said or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``: every text as a GIF, to be written as a media column."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array([store_text(t.as_py()) for t in part.column("text")], pa.binary())], names=["doc_id", "media"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, media binary")


__all__ = ["read_frames", "read_gif", "write_gif", "store_text", "stored_media", "stored_payload", "text_media"]
