"""Keypoints of grey images: enhancement, regions of interest, oriented corners on a pyramid with binary descriptors, and their matches.

``detected`` makes a row for each image, with its keypoints as an array: an image without any, or without pixels, keeps its row with an
empty array. A detection is bounded by ``FEATURES``, so a pair of images is matched in one row of a kernel; what all pairs cost is the number of
pairs that are asked for.

Points are in the image's own pixels, whatever the enhancement's scale; angles are degrees from 0 on, clockwise as rows run down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels
from .shared import spread

#: Detection.
FEATURES, LEVELS, STEP, EDGE, PATCH, CONTRAST = 2000, 8, 1.2, 31, 31, 10
#: Enhancement.
SCALE, CLIP, TILES, SMOOTH = 4.0, 2.0, 8, 0.8
#: Regions of interest.
SIGMAS, RESPONSE, LEAST_AREA, MOST_REGIONS, WIDER, LEAST_KEYPOINTS = (1.0, 2.0), 0.02, 16, 64, 8, 100
#: Matches.
RATIO = 0.8
#: Rows of an image that are looked at together, and entries of a matrix that stay in a core's cache.
BAND, CACHED = 512, 1 << 15

BOX = "struct<x:int,y:int,width:int,height:int>"
KEYPOINT = "struct<kp:int,x:double,y:double,size:double,angle:double,response:double,descriptor:binary>"


#: The same as Arrow's types.
CORNERS = pa.struct([(c, pa.int32()) for c in ("x", "y", "width", "height")])
POINT = pa.struct([("kp", pa.int32()), *[(c, pa.float64()) for c in ("x", "y", "size", "angle", "response")], ("descriptor", pa.binary())])


def _cut(a: np.ndarray, axis: int, start: int, n: int) -> np.ndarray:
    return a[start : start + n] if axis == 0 else a[:, start : start + n]


def blurred(image: np.ndarray, sigma: float, taps: int) -> np.ndarray:
    """Gaussian of an odd number of taps; borders mirror the pixels next to them."""
    at = np.arange(taps) - taps // 2
    weight = np.exp(-(at**2) / (2 * sigma**2))
    weight = (weight / weight.sum()).astype(np.float32)
    out = image.astype(np.float32)
    for axis in (0, 1):
        n, half = out.shape[axis], taps // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half, half)
        wide = np.pad(out, pad, mode="reflect" if n > half else "edge")
        out = sum(w * _cut(wide, axis, k, n) for k, w in enumerate(weight))
    return out


def _taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the four source cells that a target cell is made of, by a cubic of slope -3/4."""
    at = (np.arange(target) + 0.5) * source / target - 0.5
    base = np.floor(at).astype(int)
    d = np.abs(at[:, None] - (base[:, None] + np.arange(-1, 3)))
    a = -0.75
    weight = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a)
    return np.clip(base[:, None] + np.arange(-1, 3), 0, source - 1), weight.astype(np.float32)


def cubic(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resize by cubic interpolation; values may overshoot."""
    rows, by_row = _taps(image.shape[0], height)
    columns, by_column = _taps(image.shape[1], width)
    across = sum(by_column[:, k] * image[:, columns[:, k]].astype(np.float32) for k in range(4))
    return sum(by_row[:, k, None] * across[rows[:, k]] for k in range(4))


def enlarged(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resize by cubic interpolation, into 0 to 255."""
    return np.clip(np.rint(cubic(image, width, height)), 0, 255).astype(np.uint8)


def equalised(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive equalisation: each tile's histogram, cut at ``clip`` times its mean, gives a curve; pixels mix the nearest four."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    pad = ((0, th * tiles - h), (0, tw * tiles - w))
    wide = np.pad(image, pad, mode="reflect" if min(h, w) > max(p[1] for p in pad) else "edge")
    tile = wide.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    count = np.bincount((np.arange(len(tile))[:, None] * 256 + tile).ravel(), minlength=len(tile) * 256).reshape(-1, 256)
    most = max(1, int(clip * th * tw / 256))
    excess = np.clip(count - most, 0, None).sum(axis=1)
    count = np.minimum(count, most) + (excess // 256)[:, None]
    for k, rest in enumerate(excess % 256):
        if rest:
            # the rest goes to every so many values, from the first on
            count[k, : 256 : max(256 // rest, 1)][:rest] += 1
    curve = np.clip(np.rint(np.cumsum(count, axis=1) * (255.0 / (th * tw))), 0, 255).astype(np.float32).reshape(tiles, tiles, 256)

    def mixed(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) / size - 0.5).astype(np.float32)
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    y0, y1, fy = mixed(h, th)
    x0, x1, fx = mixed(w, tw)
    out = np.empty((h, w), np.uint8)
    for top in range(0, h, BAND):
        r, v = slice(top, top + BAND), image[top : top + BAND]
        upper = curve[y0[r][:, None], x0, v] * (1 - fx) + curve[y0[r][:, None], x1, v] * fx
        lower = curve[y1[r][:, None], x0, v] * (1 - fx) + curve[y1[r][:, None], x1, v] * fx
        out[r] = np.rint(upper * (1 - fy[r, None]) + lower * fy[r, None])
    return out


def enhanced(image: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """Enlarged, slightly smoothed and equalised; a scale of 1 leaves the image as it is."""
    if scale == 1.0:
        return image
    large = enlarged(image, int(np.rint(image.shape[1] * scale)), int(np.rint(image.shape[0] * scale)))
    return equalised(np.rint(blurred(large, SMOOTH, 7)).astype(np.uint8))


def _slid(mask: np.ndarray, size: int, any_of: bool) -> np.ndarray:
    """Whether any (or each) pixel of the square around a pixel is set; outside counts as the neutral value."""
    half, out = size // 2, mask
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half + 1, half)
        sums = np.cumsum(np.pad(out if any_of else ~out, pad), axis=axis, dtype=np.int32)
        n = mask.shape[axis]
        found = _cut(sums, axis, size, n) > _cut(sums, axis, 0, n)
        out = found if any_of else ~found
    return out


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, label) of each run of set pixels, and how many labels; runs that touch, also at corners, share a label."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    label = np.arange(len(row))
    if not len(row):
        return row, start, end, label, np.asarray(0)
    width = mask.shape[1] + 2
    # runs of the next row whose span meets this one's, a column more on either side
    first = np.searchsorted(row * width + end, (row + 1) * width + start, side="left")
    last = np.searchsorted(row * width + start, (row + 1) * width + end, side="right")
    size = np.clip(last - first, 0, None)
    a = np.repeat(np.arange(len(row)), size)
    b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    known, label = np.unique(label, return_inverse=True)
    return row, start, end, label, np.asarray(len(known))


def _filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes filled: ground that the border can't be reached from by sides."""
    ground = np.pad(~mask, 1, constant_values=True)
    edge = np.diff(np.pad(ground.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    width = ground.shape[1] + 2
    # by sides only: the spans themselves must meet
    first = np.searchsorted(row * width + end, (row + 1) * width + start, side="right")
    last = np.searchsorted(row * width + start, (row + 1) * width + end, side="left")
    size = np.clip(last - first, 0, None)
    a = np.repeat(np.arange(len(row)), size)
    b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    outside = row == 0
    while True:
        new = outside.copy()
        np.logical_or.at(new, a, outside[b])
        np.logical_or.at(new, b, new[a])
        if (new == outside).all():
            break
        outside = new
    out = np.ones_like(ground)
    for r, s, e in zip(row[outside], start[outside], end[outside], strict=True):
        out[r, s:e] = False
    return out[1:-1, 1:-1]


def regions(image: np.ndarray, response: float = RESPONSE, wider: int = WIDER, most: int = MOST_REGIONS) -> list[tuple[int, int, int, int]]:
    """x, y, width, height of what stands out between two scales, the largest boxes first.

    Where nothing exceeds ``response``, the response is parted by its own values. Specks go by an opening, the rest is made wider, and what lies
    inside of another region's outline belongs to it.
    """
    unit = image.astype(np.float32) / 255
    found = np.abs(blurred(unit, SIGMAS[0], 9) - blurred(unit, SIGMAS[1], 17))
    mask = found > response
    if not mask.any():
        peak = float(found.max(initial=0.0))
        if peak <= 0:
            return []
        scaled = (found * (255.0 / peak)).astype(np.uint8)
        mask = scaled > pixels.otsu(scaled)
    mask = _slid(_slid(mask, 3, False), 3, True)
    if wider:
        mask = _slid(mask, 2 * wider + 1, True)
    row, start, end, label, n = components(_filled(mask))
    n = int(n)
    left, top, right, bottom = np.full(n, image.shape[1]), np.full(n, image.shape[0]), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(left, label, start)
    np.minimum.at(top, label, row)
    np.maximum.at(right, label, end)
    np.maximum.at(bottom, label, row + 1)
    boxes = [(int(x), int(y), int(r - x), int(b - y)) for x, y, r, b in zip(left, top, right, bottom, strict=True) if (r - x) * (b - y) >= LEAST_AREA]
    return sorted(boxes, key=lambda b: (-b[2] * b[3], b[1], b[0]))[:most]


@lru_cache
def _ring() -> tuple[np.ndarray, np.ndarray]:
    """The sixteen places around a pixel at a distance of three, in order."""
    angle = np.arange(16) * np.pi / 8
    return np.rint(3 * np.sin(angle)).astype(int), np.rint(3 * np.cos(angle)).astype(int)


def _in_a_row(ring: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """For each of sixteen ring places, ``pick`` of the nine values from it on."""
    wide = np.concatenate([ring, ring[:8]])
    two = pick(wide[:-1], wide[1:])
    four = pick(two[:-2], two[2:])
    return pick(pick(four[:16], four[4:20]), wide[8:24])


def corners(image: np.ndarray, contrast: int = CONTRAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x, strength of the pixels that a run of nine ring pixels is brighter or darker than; of neighbours only the strongest.

    The strength is the least difference of the best run, so that a pixel with such a run is one whose strength exceeds the contrast.
    """
    h, w = image.shape
    if min(h, w) < 7:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    # a border of zeros around the pixels that have a whole ring
    field = np.zeros((h, w), np.int16)
    high = max(1, CACHED // 4 // w)
    for top in range(3, h - 3, high):
        end = min(h - 3, top + high)
        other = np.stack([image[top + dy : end + dy, 3 + dx : w - 3 + dx] for dy, dx in zip(*_ring(), strict=True)]).astype(np.int16)
        other -= image[top:end, 3 : w - 3]
        strength = np.maximum(_in_a_row(other, np.minimum).max(axis=0), -_in_a_row(other, np.maximum).min(axis=0))
        field[top:end, 3 : w - 3] = np.where(strength > contrast, strength, 0)
    around = np.zeros((h - 6, w - 6), np.int16)
    for dy, dx in ((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx):
        np.maximum(around, field[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx], out=around)
    y, x = np.nonzero(field[3 : h - 3, 3 : w - 3] > around)
    return y + 3, x + 3, field[y + 3, x + 3].astype(np.int32)


def _patches(image: np.ndarray, y: np.ndarray, x: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """(n, places): the values at some places around each pixel; ``dy``, ``dx`` are the same for all pixels, or a row for each."""
    at = dy * image.shape[1] + dx
    return image.ravel().take((y * image.shape[1] + x)[:, None] + at)


def _harris(image: np.ndarray, y: np.ndarray, x: np.ndarray, block: int = 7) -> np.ndarray:
    """Corner response from the gradients in a block around each place."""
    side = block + 2
    dy, dx = (g.ravel() for g in np.mgrid[:side, :side] - side // 2)
    # whole numbers: sums are exact in any order
    p = _patches(image, y, x, dy, dx).astype(np.int32).reshape(-1, side, side)
    across, down = p[:, :, 2:] - p[:, :, :-2], p[:, 2:] - p[:, :-2]
    gx = (2 * across[:, 1:-1] + across[:, :-2] + across[:, 2:]).reshape(len(y), -1).astype(np.float64)
    gy = (2 * down[:, :, 1:-1] + down[:, :, :-2] + down[:, :, 2:]).reshape(len(y), -1).astype(np.float64)
    unit = 1.0 / (4 * block * 255)
    a, b, c = ((p * q).sum(axis=1) * unit**2 for p, q in ((gx, gx), (gy, gy), (gx, gy)))
    return a * b - c * c - 0.04 * (a + b) ** 2


@lru_cache
def _disk() -> tuple[np.ndarray, np.ndarray]:
    half = PATCH // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    inside = y**2 + x**2 <= half**2
    return y[inside], x[inside]


def _angles(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direction from each place to the centre of its patch's brightness, in radians."""
    dy, dx = _disk()
    # sums stay below 2^24, so that single precision is exact
    down, across = (_patches(image, y, x, dy, dx).astype(np.float32) @ np.column_stack([dy, dx]).astype(np.float32)).astype(np.float64).T
    return np.arctan2(down, across)


@lru_cache
def _tests() -> np.ndarray:
    """256 pairs of places in a patch, (256, 2, 2) as (y, x): random, near the middle more often, the same in every process."""
    half = PATCH // 2 - 2
    return np.clip(np.random.default_rng(31).normal(0, PATCH / 5, (256, 2, 2)), -half, half)


def _descriptors(image: np.ndarray, y: np.ndarray, x: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """(n, 32) bytes: which of two places is brighter, for 256 pairs turned by the angle."""
    tests = _tests().reshape(-1, 2)
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    dy = np.rint(tests[:, 0] * cos + tests[:, 1] * sin).astype(int)
    dx = np.rint(tests[:, 1] * cos - tests[:, 0] * sin).astype(int)
    values = _patches(image, y, x, dy, dx).reshape(len(y), 256, 2)
    return np.packbits(values[:, :, 0] < values[:, :, 1], axis=1)


def _smaller(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resize by linear interpolation, for a step that is no larger than a pixel and a half."""

    def taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        low = np.minimum(at.astype(int), max(0, source - 2))
        return low, (at - low).astype(np.float32)

    (y, fy), (x, fx) = taps(image.shape[0], height), taps(image.shape[1], width)
    x1, y1 = np.minimum(x + 1, image.shape[1] - 1), np.minimum(y + 1, image.shape[0] - 1)
    across = image[:, x] * (1 - fx) + image[:, x1] * fx
    return np.rint(across[y] * (1 - fy[:, None]) + across[y1] * fy[:, None]).astype(np.uint8)


def featured(image: np.ndarray, masks: list[np.ndarray | None], most: int = FEATURES) -> list[np.ndarray]:
    """For each mask (n, 5 + 32): x, y, size, angle, response and the descriptor's bytes of up to ``most`` keypoints, the strongest of each level.

    Levels, corners and what is told of a corner are looked for once, whichever masks it lies in.
    """
    share = (1 - 1 / STEP) / (1 - STEP**-LEVELS)
    out, level = [[] for _ in masks], image
    for k in range(LEVELS):
        if k:
            level = _smaller(level, *(max(1, int(np.rint(n / STEP**k))) for n in image.shape[::-1]))
        h, w = level.shape
        if min(h, w) <= 2 * EDGE:
            break
        y, x, strength = corners(level)
        sy, sx = image.shape[0] / h, image.shape[1] / w
        inside = (y >= EDGE) & (y < h - EDGE) & (x >= EDGE) & (x < w - EDGE)
        y, x, strength = y[inside], x[inside], strength[inside]
        quota = int(np.rint(most * share * STEP**-k))
        order = np.lexsort((x, y, -strength))
        y, x = y[order], x[order]
        firsts = []
        for mask in masks:
            held = np.ones(len(y), bool) if mask is None else mask[np.minimum((y * sy).astype(int), mask.shape[0] - 1), np.minimum((x * sx).astype(int), mask.shape[1] - 1)]
            firsts.append(np.flatnonzero(held)[: 2 * quota])
        asked = np.unique(np.concatenate(firsts))
        if not len(asked):
            continue
        response = np.full(len(y), -np.inf)
        response[asked] = _harris(level, y[asked], x[asked])
        firsts = [first[np.lexsort((x[first], y[first], -response[first]))[:quota]] for first in firsts]
        asked = np.unique(np.concatenate(firsts))
        y, x = y[asked], x[asked]
        angle = _angles(level, y, x)
        smooth = np.rint(blurred(level, 2.0, 7)).astype(np.uint8)
        places = np.column_stack([(x + 0.5) * sx - 0.5, (y + 0.5) * sy - 0.5, np.full(len(y), PATCH * (sx + sy) / 2), np.degrees(angle) % 360, response[asked]])
        found = np.column_stack([places, _descriptors(smooth, y, x, angle)])
        for own, first in zip(out, firsts, strict=True):
            own.append(found[np.searchsorted(asked, first)])
    return [np.concatenate(own)[:most] if own else np.zeros((0, 37)) for own in out]


def features(image: np.ndarray, mask: np.ndarray | None = None, most: int = FEATURES) -> np.ndarray:
    """``featured`` with one mask."""
    return featured(image, [mask], most)[0]


def detection(image: np.ndarray, scale: float = SCALE, interest: bool = True, most: int = FEATURES, least: int = LEAST_KEYPOINTS) -> dict:
    """One image's keypoints with what led to them, all in the image's own pixels."""
    work = enhanced(image, scale)
    boxes = regions(np.rint(pixels.sobel(work)).astype(np.uint8)) if interest else []
    mask = np.zeros(work.shape, bool)
    for x, y, w, h in boxes:
        mask[y : y + h, x : x + w] = True
    every, *held = featured(work, [None, mask] if boxes else [None], most)
    abandoned = bool(held) and len(held[0]) < least
    own = held[0] if held and not abandoned else every
    points = [(k, r[0] / scale, r[1] / scale, r[2] / scale, r[3], r[4], r[5:].astype(np.uint8).tobytes()) for k, r in enumerate(own)]
    own_boxes = [tuple(int(np.rint(v / scale)) for v in b) for b in boxes]
    return {"detected": len(every), "keypoints": points, "boxes": own_boxes, "abandoned": abandoned}


def _listed(rows: list[tuple], kind: pa.StructType) -> pa.ListArray:
    """One list of structs, made by columns."""
    columns = zip(*rows, strict=True) if rows else [()] * kind.num_fields
    made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), made)


def detected(images: DataFrame, key: str, scale: float = SCALE, interest: bool = True, most: int = FEATURES) -> DataFrame:
    """key, width, height, detected, keypoints, boxes, abandoned, reason: a row for each of ``images`` (key, width, height, gray).

    ``detected`` counts keypoints before the regions of interest restrict them; ``abandoned`` says that these would have left too few. An image
    without keypoints has ``featureless`` as reason, one without pixels ``no_pixels``.
    """
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (width, height, gray) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if gray is None:
                    found, reason = {"detected": 0, "keypoints": [], "boxes": [], "abandoned": False}, "no_pixels"
                else:
                    found = detection(np.frombuffer(gray, np.uint8).reshape(int(height), int(width)), scale, interest, most)
                    reason = None if found["keypoints"] else "featureless"
                one = [batch.column(c).slice(r, 1) for c in (0, 1, 2)] + [pa.array([found["detected"]], pa.int32()), _listed(found["keypoints"], POINT), _listed(found["boxes"], CORNERS)]
                one += [pa.array([found["abandoned"]], pa.bool_()), pa.array([reason], pa.string())]
                yield pa.RecordBatch.from_arrays(one, names=[key, "width", "height", "detected", "keypoints", "boxes", "abandoned", "reason"])

    shape = f"`{key}` {kind}, width int, height int, detected int, keypoints array<{KEYPOINT}>, boxes array<{BOX}>, abandoned boolean, reason string"
    sizes = [F.col(c).cast("int").alias(c) for c in ("width", "height")]
    return spread(images.select(key, *sizes, "gray"), key).mapInArrow(run, shape)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, m): bits in which descriptors (rows of bytes) differ."""
    wide = lambda d: np.ascontiguousarray(d).view(np.uint64)
    left, right = wide(a), np.ascontiguousarray(wide(b).T)
    out = np.zeros((len(a), len(b)), np.int32)
    # some rows at a time: what is counted stays in a core's cache
    high = max(1, CACHED // max(1, len(b)))
    for top in range(0, len(a), high):
        own = out[top : top + high]
        bits, ones = np.empty(own.shape, np.uint64), np.empty(own.shape, np.uint8)
        for k in range(len(right)):
            np.bitwise_xor(left[top : top + high, k, None], right[k], out=bits)
            own += np.bitwise_count(bits, out=ones)
    return out


def agreed(a: np.ndarray, b: np.ndarray, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of a, row of b, distance) of mutual nearest neighbours that pass the ratio test, and how many pass the test alone.

    Ties go to the smaller row. A lone candidate passes.
    """
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 0
    far, rows = distances(a, b), np.arange(len(a))
    best = far.argmin(axis=1)
    d1 = far[rows, best]
    least = far.min(axis=0)
    if len(b) > 1:
        far[rows, best] = np.iinfo(np.int32).max
        d2 = far.min(axis=1)
        far[rows, best] = d1
        passed = (d2 > 0) & (d1 < ratio * d2)
    else:
        passed = np.ones(len(a), bool)
    # only a target that is asked for is looked back from
    own = np.flatnonzero(passed & (d1 == least[best]))
    own = own[far[:, best[own]].argmin(axis=0) == own]
    return own, best[own], d1[own], int(passed.sum())


def _descriptor_rows(points: list) -> np.ndarray:
    return np.frombuffer(b"".join(p["descriptor"] for p in points), np.uint8).reshape(len(points), -1) if len(points) else np.zeros((0, 32), np.uint8)


def _descriptor_bytes(column: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 32), np.uint8)


def matched(pairs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """pair, src, dst, x, y, u, v, dist, candidates, passed: the matches of each of ``pairs`` (pair, a, b: two arrays of keypoints).

    ``candidates`` and ``passed`` are the pair's own counts, before and after the ratio test; a pair without matches has one row of nulls.
    """
    kind = pairs.schema["pair"].dataType.simpleString()
    names = ["pair", "src", "dst", "x", "y", "u", "v", "dist", "candidates", "passed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(c)[r].values for c in (1, 2))
                i, j, d, passed = agreed(*(_descriptor_bytes(p.field("descriptor")) for p in (a, b)), ratio)
                at = [("kp", a, i), ("kp", b, j), ("x", a, i), ("y", a, i), ("x", b, j), ("y", b, j)]
                found = [p.field(c).take(pa.array(k)) for c, p, k in at] + [pa.array(d, pa.int32())] if len(i) else [pa.nulls(1, t) for t in [pa.int32()] * 2 + [pa.float64()] * 4 + [pa.int32()]]
                n = max(1, len(i))
                given = batch.column(0).take(pa.array(np.full(n, r)))
                yield pa.RecordBatch.from_arrays([given, *found, pa.array(np.full(n, len(a), np.int32)), pa.array(np.full(n, passed, np.int32))], names=names)

    return spread(pairs.select("pair", "a", "b"), "pair").mapInArrow(run, f"pair {kind}, src int, dst int, x double, y double, u double, v double, dist int, candidates int, passed int")


def within(images: DataFrame, key: str, ratio: float = RATIO, knn: int = 6, apart: float = 32.0) -> DataFrame:
    """key and x1, y1, s1, t1, x2, y2, s2, t2 of the matches inside each image (``detected``'s rows).

    Of a keypoint's nearest others by descriptor, those before the first clear gap are taken; pairs nearer than ``apart`` pixels go, and each pair counts once.
    """
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, points in zip(rows[key], rows["keypoints"], strict=True):
                if len(points) < 3:
                    continue
                far = distances(d := _descriptor_rows(points), d)
                np.fill_diagonal(far, np.iinfo(np.int32).max)
                n = min(knn - 1, len(points) - 1)
                order = np.argsort(far, axis=1, kind="stable")[:, :n]
                near = np.take_along_axis(far, order, axis=1).astype(float)
                gap = (near[:, 1:] > 0) & (near[:, :-1] < ratio * near[:, 1:])
                taken = np.where(gap.any(axis=1), gap.argmax(axis=1) + 1, 0)
                i, k = np.nonzero(np.arange(n) < taken[:, None])
                j = order[i, k]
                xy = np.asarray([(p["x"], p["y"], p["size"], p["angle"]) for p in points])
                keep = ((xy[i, :2] - xy[j, :2]) ** 2).sum(axis=1) >= apart**2
                once = np.unique(np.column_stack([np.minimum(i, j), np.maximum(i, j)])[keep], axis=0)
                if len(once):
                    frame = pd.DataFrame(np.column_stack([xy[once[:, 0]], xy[once[:, 1]]]), columns=[f"{c}{s}" for s in "12" for c in "xyst"])
                    frame.insert(0, key, pd.Series([name] * len(frame), dtype=object))
                    yield frame

    return spread(images.select(key, "keypoints"), key).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{c}{s} double" for s in "12" for c in "xyst"))


def points(found: DataFrame, key: str) -> DataFrame:
    """A row for each keypoint of ``detected``'s rows; images without any have none."""
    return found.select(key, F.inline("keypoints"))
