"""Grey images out of files: sizes are read from headers, and what is too large is refused before its pixels are."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels
from . import jpeg

SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
#: Pixels of a file that is decoded, and of the longest side that an image keeps.
MOST_PIXELS, LONGEST = 50_000_000, 2048

#: Byte order by the first bytes of a TIFF.
_TIFF = {b"II*\0": "<", b"MM\0*": ">"}
_PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel for each colour type of the format.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def probe(content: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, JPEG, GIF, BMP or TIFF file; None if it can't be told."""
    if content[:8] == _PNG and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:3] == b"GIF" and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        width, height = struct.unpack("<ii", content[18:26])
        return width, abs(height)
    if content[:4] in _TIFF:
        tags = _tags(content)
        return (tags[256][0], tags[257][0]) if tags.get(256) and tags.get(257) else None
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            kind = content[at + 1]
            # frame headers, but for the tables among these codes
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def _grayed(samples: np.ndarray) -> np.ndarray:
    """(height, width, n) samples to grey values; of two, the second is transparency."""
    if samples.shape[2] >= 3:
        return np.rint(samples[:, :, :3] @ np.asarray([0.299, 0.587, 0.114])).astype(np.uint8)
    return np.ascontiguousarray(samples[:, :, 0])


def _bounded(data: bytes, size: int) -> bytes:
    """The first ``size`` bytes of a compressed stream, however much it holds."""
    raw = zlib.decompressobj().decompress(data, size) if size else b""
    if len(raw) < size:
        raise ValueError("too few pixels")
    return raw


def _tags(content: bytes) -> dict[int, tuple[int, ...]]:
    """The whole-number tags of a TIFF's first directory."""
    order, sizes = _TIFF[content[:4]], {1: "B", 3: "H", 4: "I"}
    at = struct.unpack(order + "I", content[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind in sizes:
            form = f"{order}{n}{sizes[kind]}"
            size = struct.calcsize(form)
            if size > len(content):
                raise ValueError("a tag beyond the file")
            start = struct.unpack(order + "I", entry[8:])[0]
            out[tag] = struct.unpack(form, entry[8 : 8 + size] if size <= 4 else content[start : start + size])
    return out


def _unpacked(data: bytes, size: int) -> bytes:
    """Runs of bytes, each with its length before it: literal, or one byte again and again."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * ((257 - n) if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def decode_tiff(content: bytes) -> np.ndarray:
    """Grey values of a TIFF of 8 bits a sample in strips: plain, in runs of bytes, or deflated."""
    tags = _tags(content)
    width, height, n = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    kind, ink, rows = tags.get(259, (1,))[0], tags.get(262, (1,))[0], min(tags.get(278, (tags[257][0],))[0], tags[257][0])
    if set(tags.get(258, (1,))) != {8} or kind not in (1, 8, 32773, 32946) or ink not in (0, 1, 2) or tags.get(284, (1,))[0] != 1 or tags.get(317, (1,))[0] != 1 or not rows:
        raise ValueError("a kind of TIFF that is not read")
    parts = []
    for k, (at, size) in enumerate(zip(tags[273], tags[279], strict=True)):
        want = min(rows, height - k * rows) * width * n
        data = content[at : at + size]
        parts.append((data if kind == 1 else _unpacked(data, want) if kind == 32773 else _bounded(data, want))[:want])
    samples = np.frombuffer(b"".join(parts), np.uint8).reshape(height, width, n)
    return 255 - _grayed(samples) if ink == 0 else _grayed(samples)


def decode_bmp(content: bytes) -> np.ndarray:
    """Grey values of a BMP of 8, 24 or 32 bits a pixel that isn't compressed."""
    start, header, width, height, _, bits, packing = struct.unpack("<IIiiHHI", content[10:34])
    if bits not in (8, 24, 32) or packing not in (0, 3) or width <= 0 or not height:
        raise ValueError("a kind of BMP that is not read")
    line = -(-width * bits // 32) * 4
    rows = np.frombuffer(content[start : start + line * abs(height)], np.uint8).reshape(abs(height), line)[:, : width * bits // 8].reshape(abs(height), width, -1)
    rows = rows if height < 0 else rows[::-1]
    if bits == 8:
        palette = np.frombuffer(content[14 + header : start], np.uint8).reshape(-1, 4)
        rows = palette[rows[:, :, 0]]
    return _grayed(rows[:, :, 2::-1])


def decode(content: bytes) -> np.ndarray:
    """Grey values of a file, by what it says that it is."""
    if content[:4] in _TIFF:
        return decode_tiff(content)
    if content[:2] == b"\xff\xd8":
        return jpeg.decode(content)
    return decode_bmp(content) if content[:2] == b"BM" else decode_png(content)


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey or coloured image as a BMP file of 24 bits a pixel."""
    full = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image
    h, w = full.shape[:2]
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = full[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def encode_tiff(image: np.ndarray, packed: bool = False) -> bytes:
    """A grey or coloured image as a TIFF file of one strip, plain or deflated."""
    full = image[:, :, None] if image.ndim == 2 else image
    h, w, n = full.shape
    data = zlib.compress(full.astype(np.uint8).tobytes()) if packed else full.astype(np.uint8).tobytes()
    bits = 8 + len(data)
    # each entry by its tag: kind, count, value
    entries = {256: (4, 1, w), 257: (4, 1, h), 258: (3, n, 8 if n == 1 else bits), 259: (3, 1, 8 if packed else 1), 262: (3, 1, 1 if n == 1 else 2), 273: (4, 1, 8), 277: (3, 1, n), 278: (4, 1, h), 279: (4, 1, len(data))}
    value = lambda kind, count, v: struct.pack("<HH", v, 0) if kind == 3 and count == 1 else struct.pack("<I", v)
    listed = b"".join(struct.pack("<HHI", tag, kind, count) + value(kind, count, v) for tag, (kind, count, v) in entries.items())
    extra = struct.pack(f"<{n}H", *[8] * n) if n > 1 else b""
    return b"II*\0" + struct.pack("<I", bits + len(extra)) + data + extra + struct.pack("<H", len(entries)) + listed + struct.pack("<I", 0)


def decode_png(content: bytes) -> np.ndarray:
    """Grey values of a PNG of 8 bits a sample that isn't interlaced; transparency is left out."""
    if content[:8] != _PNG:
        raise ValueError("not a PNG")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise ValueError("depth, colour or interlacing that is not read")
    at, data, palette = 8, [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IDAT":
            data.append(content[at + 8 : at + 8 + size])
        elif kind == b"PLTE":
            palette = np.frombuffer(content[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        at += 12 + size
    if not width or not height:
        raise ValueError("no pixels")
    n = _CHANNELS[colour]
    rows = np.frombuffer(_bounded(b"".join(data), height * (width * n + 1)), np.uint8).reshape(height, width * n + 1)
    if rows[:, 0].max() > 4:
        raise ValueError("unknown filter")
    out = np.zeros((height + 1, width * n), np.uint8)
    for r in range(height):
        out[r + 1] = _unfiltered(int(rows[r, 0]), rows[r, 1:], out[r], n)
    samples = out[1:].reshape(height, width, n)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        if samples.max() >= len(palette):
            raise ValueError("a colour beyond the palette")
        samples = palette[samples[:, :, 0]]
    return _grayed(samples)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A row of samples from its differences to the left, to the row above, or to a mixture."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out, up, value = [0] * n + row.tolist(), [0] * n + above.tolist(), 0
    for k in range(n, len(out)):
        left, over, corner = out[k - n], up[k], up[k - n]
        if kind == 3:
            value = (left + over) // 2
        else:
            guess = left + over - corner
            value = min((abs(guess - left), 0, left), (abs(guess - over), 1, over), (abs(guess - corner), 2, corner))[2]
        out[k] = (out[k] + value) & 255
    return np.asarray(out[n:], np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    h, w = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decoded(files: DataFrame, most_pixels: int = MOST_PIXELS, longest: int = LONGEST) -> DataFrame:
    """path, sha256, size_bytes, source_width, source_height, width, height, scale, gray, error for each of ``files`` (path, content).

    A file whose header says that it has too many pixels isn't decoded. What can't be read has its error and no pixels;
    no row is lost. Images larger than ``longest`` are made smaller by area, never larger.
    """

    def one(content: bytes | None) -> tuple:
        """Size by the header, pixels, scale, error. A file may hold anything, so whatever reading it raises is that file's error."""
        size = None
        try:
            content = content or b""
            size = probe(content)
            if size and size[0] * size[1] > most_pixels:
                return size, None, None, "too_many_pixels"
            made = decode(content)
            if made.shape[0] * made.shape[1] > most_pixels:
                return size, None, None, "too_many_pixels"
        except Exception as e:
            return size, None, None, f"undecoded: {type(e).__name__}: {e}"
        scale = min(1.0, longest / max(made.shape))
        if scale < 1:
            w, h = (max(1, int(np.rint(n * scale))) for n in (made.shape[1], made.shape[0]))
            made = np.rint(pixels.resized(made, w, h)).astype(np.uint8)
        return size, made, scale, None

    names = ["path", "sha256", "size_bytes", "source_width", "source_height", "width", "height", "scale", "gray", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                size, made, scale, error = one(content)
                # a file's bytes are read once, for its digest too; a header may say sizes that no column holds
                size = size if size and max(size) < 2**31 else (None, None)
                digest, length = (None, None) if content is None else (hashlib.sha256(content).hexdigest(), len(content))
                shape = (None, None) if made is None else (made.shape[1], made.shape[0])
                frame = pd.DataFrame([(path, digest, length, *size, *shape, scale, None if made is None else made.tobytes(), error)], columns=names)
                yield frame.astype({c: "Int32" for c in ("source_width", "source_height", "width", "height")} | {"size_bytes": "Int64", "scale": "Float64"})

    shape = "path string, sha256 string, size_bytes bigint, source_width int, source_height int, width int, height int, scale double, gray binary, error string"
    return files.select("path", "content").mapInPandas(read, shape)


def images(spark: SparkSession, folder: str, most_pixels: int = MOST_PIXELS, longest: int = LONGEST) -> DataFrame:
    """The image files of a folder and its subfolders, by suffix, as ``decoded`` returns them. A folder without any is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*SUFFIXES))
    if named.select("path").isEmpty():
        raise ValueError(f"no image files in {folder}")
    return decoded(named, most_pixels, longest)
