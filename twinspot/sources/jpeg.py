"""Grey values of baseline JPEG files: the luminance component alone is transformed back, the others are only read over."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


@lru_cache
def _order() -> np.ndarray:
    """Places, by rows, of a block's 64 coefficients in the order in which they are stored: along the diagonals, to and fro."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.asarray([r * 8 + c for r, c in cells])


@lru_cache
def _basis() -> np.ndarray:
    k = np.arange(8)
    return np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code is."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first, size = code << (16 - length), 1 << (16 - length)
            if first + size > 65536:
                raise ValueError("codes beyond their length")
            table[first : first + size] = [(length, symbols[at])] * size
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _blocks(data: bytes, plan: list[tuple[int, int, list, list]], units: int, kept: int) -> np.ndarray:
    """(blocks, 64) coefficients of component ``kept`` in one stretch between restarts; plan: (component, blocks, DC codes, AC codes) of a unit."""
    value, size, at, n = 0, 0, 0, len(data)
    last: dict[int, int] = {}
    out = []

    def fill() -> None:
        nonlocal value, size, at
        piece = data[at : at + 32]
        at += 32
        value = (value << 256) | int.from_bytes(piece.ljust(32, b"\0"), "big")
        size += 256

    def take(bits: int) -> int:
        nonlocal value, size
        if size < bits:
            fill()
        size -= bits
        got = value >> size
        value &= (1 << size) - 1
        return got

    def symbol(table: list) -> int:
        nonlocal value, size
        if size < 16:
            fill()
        length, found = table[value >> (size - 16)]
        if not length or at * 8 - size + length > n * 8:
            raise ValueError("no such code, or the data's end")
        size -= length
        value &= (1 << size) - 1
        return found

    for _ in range(units):
        for component, blocks, dc, ac in plan:
            for _ in range(blocks):
                own = [0] * 64
                bits = symbol(dc)
                step = take(bits) if bits else 0
                if bits and step < 1 << (bits - 1):
                    step -= (1 << bits) - 1
                last[component] = own[0] = last.get(component, 0) + step
                k = 1
                while k < 64:
                    both = symbol(ac)
                    zeros, bits = both >> 4, both & 15
                    if not bits:
                        if zeros != 15:
                            break
                        k += 16
                        continue
                    k += zeros
                    if k > 63:
                        raise ValueError("too many coefficients")
                    v = take(bits)
                    own[k] = v - (1 << bits) + 1 if v < 1 << (bits - 1) else v
                    k += 1
                if component == kept:
                    out.append(own)
    return np.asarray(out, np.int32).reshape(-1, 64)


def decode(content: bytes, most_pixels: int = 50_000_000) -> np.ndarray:
    """The luminance of a baseline file with one scan; progressive and arithmetic ones raise a ValueError."""
    at, tables, codes, frame, restart = 2, {}, {}, None, 0
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise ValueError("no marker")
        kind = content[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                tables[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int64)
                k += 1 + 64 * (wide + 1)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                codes[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif kind in (0xC0, 0xC1):
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not width or not height or width * height > most_pixels:
                raise ValueError("a frame that is not read")
            frame = (width, height, [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(parts)])
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("progressive or arithmetic coding is not read")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            return _scanned(content[at + 2 + size :], body, frame, tables, codes, restart)
        elif kind == 0xD9:
            break
        at += 2 + size
    raise ValueError("no scan")


def _scanned(data: bytes, head: bytes, frame: tuple, tables: dict, codes: dict, restart: int) -> np.ndarray:
    width, height, parts = frame
    if head[0] != len(parts):
        raise ValueError("components in scans of their own are not read")
    asked = {head[1 + 2 * c]: head[2 + 2 * c] for c in range(head[0])}
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, wide, high = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    plan = [(name, h * v, codes[asked[name] >> 4], codes[16 + (asked[name] & 15)]) for name, h, v, _ in parts]
    # stretches end at restart markers; a stuffed zero follows each byte of ones
    stretches, start, k = [], 0, data.find(b"\xff")
    while k >= 0 and k + 1 < len(data):
        if 0xD0 <= data[k + 1] <= 0xD7:
            stretches.append(data[start:k])
            start = k + 2
        elif data[k + 1] not in (0, 0xFF):
            break
        k = data.find(b"\xff", k + 1 + (data[k + 1] != 0xFF))
    stretches.append(data[start : k if k >= 0 else len(data)])
    units, left, found = restart or across * down, across * down, []
    name, h, v, table = parts[0]
    for stretch in stretches:
        if left > 0:
            found.append(_blocks(stretch.replace(b"\xff\x00", b"\xff"), plan, min(units, left), name))
            left -= units
    if left > 0:
        raise ValueError("too few units")
    blocks = np.concatenate(found)
    full = np.zeros((len(blocks), 64))
    full[:, _order()] = blocks * tables[table]
    values = np.clip(np.rint(_basis().T @ full.reshape(-1, 8, 8) @ _basis() + 128), 0, 255).astype(np.uint8)
    rows = values.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
    if (h, v) != (wide, high):
        rows = np.repeat(np.repeat(rows, high // v, axis=0), wide // h, axis=1)
    return np.ascontiguousarray(rows[:height, :width])


def encode(image: np.ndarray, step: int = 4, restart: int = 0) -> bytes:
    """A grey image as a baseline file with one quantisation step; codes of one length, so that they come from a rule."""
    h, w = image.shape
    down, across = -(-h // 8), -(-w // 8)
    wide = np.pad(image, ((0, down * 8 - h), (0, across * 8 - w)), mode="edge").astype(float) - 128
    blocks = wide.reshape(down, 8, across, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    found = np.rint((_basis() @ blocks @ _basis().T).reshape(-1, 64)[:, _order()] / step).astype(int)
    bits: list[str] = []
    out = bytearray()

    def flush() -> None:
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        raw = int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
        out.extend(raw.replace(b"\xff", b"\xff\x00"))
        bits.clear()

    coded = lambda v: (abs(v).bit_length(), format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else "")
    last = 0
    for n, block in enumerate(found.tolist()):
        if restart and n and n % restart == 0:
            flush()
            out.extend(bytes((0xFF, 0xD0 + (n // restart - 1) % 8)))
            last = 0
        size, text = coded(block[0] - last)
        bits += [format(size, "04b"), text]
        last, zeros = block[0], 0
        for v in block[1:]:
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                bits.append(format(0xF0, "09b"))
                zeros -= 16
            size, text = coded(v)
            bits += [format(zeros << 4 | size, "09b"), text]
            zeros = 0
        if zeros:
            bits.append(format(0, "09b"))
    flush()
    part = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    dc = bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = bytes([16]) + bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255))
    head = part(0xDB, bytes([0]) + bytes([step] * 64)) + part(0xC0, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0])) + part(0xC4, dc) + part(0xC4, ac)
    head += part(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + head + part(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + bytes(out) + b"\xff\xd9"
