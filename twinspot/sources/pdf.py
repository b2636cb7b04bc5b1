"""Figures embedded in PDF files: image objects of each page, with their place, out of files that Spark reads.

Objects are found by scanning the file for them, also inside of object streams, so a broken cross-reference table costs nothing. A page's images are those
that its resources, or its parents', name; each counts once a page. Deflated and plain samples of 8 or 1 bits and baseline JPEG give
pixels. An image of another kind, too large a one, and a file that can't be read stay as rows with their error; pages aren't drawn.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images, jpeg

#: The shorter side that a figure has at least, and pixels of one that is read.
LEAST_SIDE, MOST_PIXELS = 96, 50_000_000

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%]*|[^\s/<>\[\]()%]+|%[^\r\n]*")


class Reference(int):
    """The number of another object."""


def parsed(data: bytes) -> object:
    """The first value in the data: dictionaries by name, lists, numbers, names as text with a slash, references."""
    tokens = [t for t in _TOKEN.findall(data) if not t.startswith(b"%")]
    at = 0

    def value() -> object:
        nonlocal at
        token = tokens[at]
        at += 1
        if token == b"<<":
            out = {}
            while tokens[at] != b">>":
                name = tokens[at].decode("latin-1")
                at += 1
                out[name] = value()
            at += 1
            return out
        if token == b"[":
            items = []
            while tokens[at] != b"]":
                items.append(value())
            at += 1
            return items
        if re.fullmatch(rb"\d+", token) and at + 1 < len(tokens) and re.fullmatch(rb"\d+", tokens[at]) and tokens[at + 1] == b"R":
            at += 2
            return Reference(token)
        try:
            return float(token) if b"." in token else int(token)
        except ValueError:
            return token.decode("latin-1")

    return value() if tokens else None


class Document:
    def __init__(self, content: bytes, most_bytes: int):
        self.most = most_bytes
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in _OBJECT.finditer(content):
            body, stream = m[2], None
            if (cut := re.search(rb"\bstream\r?\n", body)) is not None:
                stream, body = content[m.start(2) + cut.end() :], body[: cut.start()]
            head = parsed(body)
            if stream is not None and isinstance(head, dict):
                size = head.get("/Length")
                end = stream.find(b"endstream") if not isinstance(size, int) or isinstance(size, Reference) else size
                stream = stream[: end if end >= 0 else len(stream)]
            self.objects[int(m[1])] = (head, stream)
        for head, stream in list(self.objects.values()):
            if isinstance(head, dict) and head.get("/Type") == "/ObjStm" and stream is not None:
                data, first = self.read(head, stream, most_bytes), int(self.of(head["/First"]))
                places = [int(x) for x in data[:first].split()]
                for number, start in zip(places[::2], places[1::2], strict=True):
                    self.objects.setdefault(number, (parsed(data[first + start :]), None))

    def of(self, value: object) -> object:
        for _ in range(20):
            if not isinstance(value, Reference):
                break
            value = self.objects.get(int(value), (None, None))[0]
        return value

    def filters(self, head: dict) -> list[str]:
        found = self.of(head.get("/Filter"))
        return [] if found is None else [str(self.of(f)) for f in found] if isinstance(found, list) else [str(found)]

    def read(self, head: dict, stream: bytes, most: int) -> bytes:
        """A stream's bytes, up to ``most``, after deflation and its predictor."""
        settings = self.of(head.get("/DecodeParms"))
        settings = settings if isinstance(settings, list) else [settings]
        for k, kind in enumerate(self.filters(head)):
            if kind not in ("/FlateDecode", "/Fl"):
                raise ValueError(f"filter {kind} is not read")
            stream = zlib.decompressobj().decompress(stream, most)
            own = self.of(settings[k]) if k < len(settings) else None
            if isinstance(own, dict) and int(self.of(own.get("/Predictor", 1))) >= 10:
                n = int(self.of(own.get("/Colors", 1))) * int(self.of(own.get("/BitsPerComponent", 8))) // 8 or 1
                wide = -(-int(self.of(own.get("/Columns", 1))) * int(self.of(own.get("/Colors", 1))) * int(self.of(own.get("/BitsPerComponent", 8))) // 8)
                rows = np.frombuffer(stream[: len(stream) // (wide + 1) * (wide + 1)], np.uint8).reshape(-1, wide + 1)
                out = np.zeros((len(rows) + 1, wide), np.uint8)
                for r, row in enumerate(rows):
                    out[r + 1] = images._unfiltered(int(row[0]), row[1:], out[r], n)
                stream = out[1:].tobytes()
        return stream

    def pages(self) -> list[dict]:
        """Pages in their order, with what they take from their parents; unordered where the tree is broken."""
        roots = [h for h, _ in self.objects.values() if isinstance(h, dict) and h.get("/Type") == "/Catalog"]
        out: list[dict] = []
        seen: set[int] = set()

        def walk(node: object, given: dict) -> None:
            if isinstance(node, Reference):
                if int(node) in seen:
                    return
                seen.add(int(node))
            own = self.of(node)
            if not isinstance(own, dict):
                return
            given = given | {k: own[k] for k in ("/Resources", "/MediaBox") if k in own}
            if own.get("/Type") == "/Page":
                out.append(given | own)
            for kid in self.of(own.get("/Kids")) or []:
                walk(kid, given)

        for root in roots:
            walk(root.get("/Pages"), {})
        return out or [h for h, _ in self.objects.values() if isinstance(h, dict) and h.get("/Type") == "/Page"]

    def placed(self, page: dict) -> dict[str, list[float]]:
        """The box on the page, x0, y0, x1, y1, of each image name that the page's own content draws."""
        contents = page.get("/Contents")
        parts = self.of(contents) if isinstance(self.of(contents), list) else [contents]
        data = b""
        for part in parts:
            head, stream = self.objects.get(int(part), (None, None)) if isinstance(part, Reference) else (None, None)
            if isinstance(head, dict) and stream is not None:
                data += self.read(head, stream, self.most) + b"\n"
        now, stack, held, out = np.eye(3), [], [], {}
        for token in _TOKEN.findall(data):
            if token == b"q":
                stack.append(now)
            elif token == b"Q":
                now = stack.pop() if stack else np.eye(3)
            elif token == b"cm" and len(held) >= 6:
                a, b, c, d, e, f = (float(x) for x in held[-6:])
                now = np.asarray([[a, b, 0], [c, d, 0], [e, f, 1]]) @ now
            elif token == b"Do" and held:
                corners = np.asarray([[0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]]) @ now
                out.setdefault(held[-1].decode("latin-1"), [*corners[:, :2].min(axis=0).tolist(), *corners[:, :2].max(axis=0).tolist()])
            else:
                held = [*held[-11:], token]
                continue
            held = []
        return out

    def pixels(self, head: dict, stream: bytes, width: int, height: int) -> np.ndarray:
        if self.filters(head)[-1:] == ["/DCTDecode"]:
            inner = dict(head) | {"/Filter": self.filters(head)[:-1]}
            return jpeg.decode(self.read(inner, stream, self.most))
        space, bits = self.of(head.get("/ColorSpace")), int(self.of(head.get("/BitsPerComponent", 1)))
        palette, n = None, {"/DeviceGray": 1, "/CalGray": 1, "/DeviceRGB": 3, "/CalRGB": 3, "/DeviceCMYK": 4}.get(space if isinstance(space, str) else "", 0)
        if isinstance(space, list):
            name = self.of(space[0])
            if name == "/ICCBased":
                n = int(self.of(self.of(space[1]).get("/N", 3)))
            elif name == "/Indexed":
                n, base = 1, self.of(space[1])
                size = {"/DeviceGray": 1, "/DeviceRGB": 3}.get(base if isinstance(base, str) else "", 3)
                table = space[3]
                raw = self.read(*self.objects[int(table)], self.most) if isinstance(table, Reference) else bytes.fromhex(str(table).strip("<>"))
                palette = np.frombuffer(raw[: len(raw) // size * size], np.uint8).reshape(-1, size)
            else:
                n = {"/CalGray": 1, "/CalRGB": 3}.get(name, 0)
        if head.get("/ImageMask") == "true":
            n, bits = 1, 1
        if not n or bits not in (1, 8):
            raise ValueError(f"samples of {bits} bits in {space} are not read")
        line = -(-width * n * bits // 8)
        data = self.read(head, stream, (line + 1) * height)
        if len(data) < line * height:
            raise ValueError("too few pixels")
        rows = np.frombuffer(data[: line * height], np.uint8).reshape(height, line)
        samples = (np.unpackbits(rows, axis=1)[:, : width * n] * (1 if palette is not None else 255) if bits == 1 else rows).reshape(height, width, n)
        if palette is not None:
            if samples.max() >= len(palette):
                raise ValueError("a colour beyond the palette")
            samples = palette[samples[:, :, 0]]
        if samples.shape[2] == 4:
            # inks take light away
            samples = ((255 - samples[:, :, :3].astype(np.int32)) * (255 - samples[:, :, 3:].astype(np.int32)) // 255).astype(np.uint8)
        return images._grayed(samples)


def _figures(content: bytes, least_side: int, most_pixels: int) -> list[tuple]:
    """(page, xref, width, height, box, gray, error) of each image of each page."""
    if content[:1024].find(b"%PDF-") < 0:
        raise ValueError("no PDF")
    document, out = Document(content, most_pixels * 4), []
    for number, page in enumerate(document.pages()):
        resources = document.of(page.get("/Resources")) or {}
        named = document.of(resources.get("/XObject")) or {}
        try:
            places = document.placed(page)
        except (ValueError, zlib.error, KeyError):
            places = {}
        seen: set[int] = set()
        for name, ref in named.items():
            head, stream = document.objects.get(int(ref), (None, None)) if isinstance(ref, Reference) else (None, None)
            if not isinstance(head, dict) or stream is None or head.get("/Subtype") != "/Image" or int(ref) in seen:
                continue
            seen.add(int(ref))
            gray, error = None, None
            width, height = (int(document.of(head.get(k, 0)) or 0) for k in ("/Width", "/Height"))
            if min(width, height) < least_side:
                continue
            if width * height > most_pixels:
                error = "too_many_pixels"
            else:
                try:
                    gray = document.pixels(head, stream, width, height)
                except Exception as e:
                    error = f"undecoded: {type(e).__name__}: {e}"
            out.append((number, int(ref), width, height, places.get(name), gray, error))
    return out


def extracted(files: DataFrame, least_side: int = LEAST_SIDE, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """path, page, xref, width, height, box, sha256, gray, error of each figure of ``files`` (path, content); a file that can't be read is one row.

    ``sha256`` is of the pixels. Pages count from 0. Images with a side under ``least_side`` are ornaments and have no row.
    """
    names = ["path", "page", "xref", "width", "height", "box", "sha256", "gray", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    found = _figures(content or b"", least_side, most_pixels)
                except Exception as e:
                    found = [(None, None, None, None, None, None, f"unread: {type(e).__name__}: {e}")]
                for page, xref, width, height, box, gray, error in found:
                    raw = None if gray is None else gray.tobytes()
                    # a JPEG's own size counts
                    size = (width, height) if gray is None else (gray.shape[1], gray.shape[0])
                    frame = pd.DataFrame([(path, page, xref, *size, box, None if raw is None else hashlib.sha256(raw).hexdigest(), raw, error)], columns=names)
                    yield frame.astype({c: "Int32" for c in ("page", "xref", "width", "height")})

    shape = "path string, page int, xref int, width int, height int, box array<double>, sha256 string, gray binary, error string"
    return files.select("path", "content").mapInPandas(read, shape)


def figures(spark: SparkSession, folder: str, least_side: int = LEAST_SIDE, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """The figures of all PDF files of a folder and its subfolders. A folder without any is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower(F.col("path")).endswith(".pdf"))
    if files.select("path").isEmpty():
        raise ValueError(f"no PDF files in {folder}")
    return extracted(files, least_side, most_pixels)
