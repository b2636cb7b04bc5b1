"""JPEG pixels and figures out of PDF files, on made ones."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from twinspot.operators import pixels
from twinspot.sources import images, jpeg, pdf


def _texture(h: int, w: int, seed: int = 3) -> np.ndarray:
    small = np.random.default_rng(seed).random((h // 8 + 1, w // 8 + 1))
    return (pixels.resized(small, w, h) * 200 + 20).astype(np.uint8)


@pytest.mark.parametrize("restart", [0, 5])
def test_jpeg_round_trip(restart):
    image = _texture(61, 83)
    content = jpeg.encode(image, 2, restart)
    assert images.probe(content) == (83, 61)
    assert np.abs(jpeg.decode(content).astype(int) - image.astype(int)).max() <= 6
    flat = jpeg.decode(jpeg.encode(np.full((8, 8), 77, np.uint8), 1))
    assert (flat == 77).all()


def test_jpeg_with_smaller_colour():
    """Three components, the first at twice the others' size: only the first gives pixels, and its blocks come four by four."""
    image = _texture(32, 48)
    blocks = (image.astype(float) - 128).reshape(4, 8, 6, 8).transpose(0, 2, 1, 3)
    import struct

    bits, last = [], 0
    coded = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    for r in range(0, 4, 2):
        for c in range(0, 6, 2):
            for y, x in ((r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1)):
                found = np.rint((jpeg._basis() @ blocks[y, x] @ jpeg._basis().T).ravel()[jpeg._order()]).astype(int).tolist()
                step = found[0] - last
                last = found[0]
                bits += [format(abs(step).bit_length(), "04b"), coded(step)]
                zeros = 0
                for v in found[1:]:
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        bits.append(format(0xF0, "09b"))
                        zeros -= 16
                    bits += [format(zeros << 4 | abs(v).bit_length(), "09b"), coded(v)]
                    zeros = 0
                if zeros:
                    bits.append(format(0, "09b"))
            bits += [format(0, "04b"), format(0, "09b")] * 2
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    head = part(0xDB, bytes([0]) + bytes([1] * 64)) + part(0xC0, struct.pack(">BHHB", 8, 32, 48, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += part(0xC4, bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + part(0xC4, bytes([16]) + bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255)))
    content = b"\xff\xd8" + head + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    assert np.abs(jpeg.decode(content).astype(int) - image.astype(int)).max() <= 2


def test_jpegs_that_are_not_read():
    good = jpeg.encode(_texture(24, 24))
    for bad in (good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-60], b"\xff\xd8\xff\xd9", b"\xff\xd8" + b"x" * 50):
        with pytest.raises((ValueError, IndexError, KeyError, __import__("struct").error)):
            jpeg.decode(bad)


def _pdf(pages: list[list[tuple[dict, bytes]]], packed: bool = False, shared: bool = False) -> bytes:
    """Pages of images (dictionary, stream), each drawn at (60, 100) as 200 x 150 points."""
    objects: dict[int, bytes] = {}
    streams: dict[int, bytes] = {}
    number = 10
    kids = []
    for page in pages:
        named = []
        for k, (head, data) in enumerate(page):
            if not (shared and kids and k == 0):
                number += 1
                text = b" ".join(f"{n} {v}".encode() for n, v in head.items())
                streams[number] = b"<< /Type /XObject /Subtype /Image " + text + f" /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"
                first = number if k == 0 and not kids else None
                if first:
                    shared_number = first
            named.append((f"/I{k}", shared_number if shared and kids and k == 0 else number))
        number += 1
        content = zlib.compress(b"q 1 0 0 1 60 100 cm q 200 0 0 150 0 0 cm /I0 Do Q Q")
        streams[number] = f"<< /Filter /FlateDecode /Length {len(content)} >>\nstream\n".encode() + content + b"\nendstream"
        resources = " ".join(f"{n} {r} 0 R" for n, r in named)
        kids.append(number + 1)
        objects[number + 1] = f"<< /Type /Page /Parent 2 0 R /Contents {number} 0 R /Resources << /XObject << {resources} >> >> >>".encode()
        number += 1
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    if packed:
        places, body = [], b""
        for n, text in objects.items():
            places += [str(n), str(len(body))]
            body += text + b" "
        head = " ".join(places).encode() + b" "
        data = zlib.compress(head + body)
        streams[5] = f"<< /Type /ObjStm /N {len(objects)} /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"
        objects = {}
    return b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + t + b"\nendobj\n" for n, t in {**objects, **streams}.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def _image(image: np.ndarray, **more) -> tuple[dict, bytes]:
    space = {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}[1 if image.ndim == 2 else image.shape[2]]
    return {"/Width": image.shape[1], "/Height": image.shape[0], "/ColorSpace": space, "/BitsPerComponent": 8, "/Filter": "/FlateDecode", **more}, zlib.compress(image.tobytes())


def test_figures_of_pdf_files(spark, tmp_path):
    gray = _texture(120, 150)
    colour = np.stack([gray, gray // 2, 255 - gray], axis=2)
    inks = np.stack([255 - gray, 255 - gray, 255 - gray, np.zeros_like(gray)], axis=2)
    rows = np.concatenate([np.full((120, 1), 2, np.uint8), np.diff(gray.astype(np.int16), axis=0, prepend=0).astype(np.uint8)], axis=1)
    predicted = ({**_image(gray)[0], "/DecodeParms": "<< /Predictor 15 /Columns 150 >>"}, zlib.compress(rows.tobytes()))
    photo = ({"/Width": 150, "/Height": 120, "/ColorSpace": "/DeviceGray", "/BitsPerComponent": 8, "/Filter": "/DCTDecode"}, jpeg.encode(gray, 1))
    small, wavelet, huge = _image(gray[:50, :50]), ({**_image(gray)[0], "/Filter": "/JPXDecode"}, b"x"), ({**_image(gray)[0], "/Width": 20_000, "/Height": 20_000}, b"x")
    indexed = (_image(gray // 64)[0] | {"/ColorSpace": "[/Indexed /DeviceGray 3 <0040C0FF>]"}, zlib.compress((gray // 64).tobytes()))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(_pdf([[_image(gray), small, photo], [_image(colour), predicted]]))
    (tmp_path / "sub" / "b.PDF").write_bytes(_pdf([[_image(inks)], [wavelet, huge], [indexed]], packed=True))
    (tmp_path / "twice.pdf").write_bytes(_pdf([[_image(gray)], [_image(gray)]], shared=True))
    (tmp_path / "broken.pdf").write_bytes(b"no such thing")
    (tmp_path / "cut.pdf").write_bytes(_pdf([[_image(gray)]])[:300])
    got: dict[str, list] = {}
    for r in pdf.figures(spark, f"file://{tmp_path}").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    own = {k: sorted(v, key=lambda r: (r["page"] or 0, r["xref"] or 0)) for k, v in got.items()}
    full = lambda r: np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"])
    a, b = own["a.pdf"], own["b.PDF"]
    assert [(r["page"], r["error"]) for r in a] == [(0, None), (0, None), (1, None), (1, None)]
    assert (full(a[0]) == gray).all() and np.abs(full(a[1]).astype(int) - gray).max() <= 3 and (full(a[3]) == gray).all()
    assert (full(a[2]) == np.rint(colour @ np.asarray([0.299, 0.587, 0.114]))).all()
    assert np.allclose(a[0]["box"], [60, 100, 260, 250]) and len({a[0]["sha256"], a[3]["sha256"]}) == 1
    assert (full(b[0]) == gray).all() and b[1]["error"].startswith("undecoded") and b[2]["error"] == "too_many_pixels"
    assert set(np.unique(full(b[3]))) <= {0, 0x40, 0xC0, 0xFF}
    assert [r["page"] for r in own["twice.pdf"]] == [0, 1] and len({r["xref"] for r in own["twice.pdf"]}) == 1
    assert own["broken.pdf"][0]["error"].startswith("unread") and own["broken.pdf"][0]["page"] is None
    assert "cut.pdf" not in own or own["cut.pdf"][0]["error"]
    with pytest.raises(ValueError, match="no PDF"):
        pdf.figures(spark, f"file://{_empty(tmp_path)}")


def _empty(folder):
    (folder / "empty").mkdir()
    return folder / "empty"
