"""Kernels on grey images, one image a row, and the operators that run them in Arrow batches.

An image is a row with width, height and gray, its bytes by rows. Kernels take and give arrays (height, width).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Fixed values of the panel split: tolerance, shares and sizes in pixels.
BAND_RANGE, BAND_SHARE, GUTTER_SHARE, LEAST_GUTTER, LEAST_TILE, LEAST_INK, MOST_TILES, LEAST_OCCUPIED = 12, 0.90, 0.02, 4, 64, 0.005, 64, 0.10


def _weights(source: int, target: int) -> np.ndarray:
    """(target, source): the share of each source cell that a target cell covers; rows sum to 1."""
    edges = np.linspace(0, source, target + 1)
    cell = np.arange(source)
    covered = np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell)
    return np.clip(covered, 0, None) / (source / target)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resize by area: each new pixel is the mean of what it covers."""
    return _weights(image.shape[0], height) @ image.astype(float) @ _weights(image.shape[1], width).T


def boxed(image: np.ndarray, size: int) -> np.ndarray:
    """The image fitted into a square of ``size`` without a change of its sides' ratio, on a ground of 0."""
    h, w = image.shape
    scale = min(size / w, size / h)
    cw, ch = (int(min(size, max(1, np.rint(n * scale)))) for n in (w, h))
    out = np.zeros((size, size))
    top, left = (size - ch) // 2, (size - cw) // 2
    out[top : top + ch, left : left + cw] = resized(image, cw, ch)
    return out


def unboxed(canvas: np.ndarray, width: int, height: int) -> np.ndarray:
    """The inverse of ``boxed`` for a square of values: the border is cut before the resize."""
    size = canvas.shape[0]
    scale = min(size / width, size / height)
    cw, ch = (int(min(size, max(1, np.rint(n * scale)))) for n in (width, height))
    top, left = (size - ch) // 2, (size - cw) // 2
    return resized(canvas[top : top + ch, left : left + cw], width, height)


def normalised(image: np.ndarray) -> np.ndarray:
    """Grey values 0 to 255 to -1 to 1."""
    return (image / 255.0 - 0.5) / 0.5


def sobel(image: np.ndarray) -> np.ndarray:
    """Strength of the gradient, scaled so that its largest value is 255; borders mirror the rows next to them."""
    p = np.pad(image.astype(float), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(float), 1, mode="edge")
    across = p[:, 2:] - p[:, :-2]
    down = p[2:] - p[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    strength = np.hypot(gx, gy)
    most = strength.max(initial=0.0)
    return strength * (255.0 / most) if most > 0 else strength


def cosine_bits(image: np.ndarray, side: int = 8) -> str:
    """Perceptual hash: the lowest cosine coefficients of a small copy, each by whether it is above their median."""
    n = 4 * side
    small = resized(image, n, n)
    k = np.arange(side)
    basis = 2 * np.cos(np.pi * k[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))
    found = (basis @ small @ basis.T).ravel()
    return "".join("1" if b else "0" for b in found > np.median(found))


def turns(image: np.ndarray) -> list[np.ndarray]:
    """The image in its eight orientations: four quarter turns, and those of its mirror image."""
    return [np.rot90(side, k) for side in (image, image[:, ::-1]) for k in range(4)]


def otsu(image: np.ndarray) -> int:
    """The grey value that parts the image's values into two classes of least spread; values above it are the upper class."""
    count = np.bincount(image.astype(np.uint8).ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def foreground(image: np.ndarray) -> np.ndarray:
    """What stands out from the ground; the class that most of the border has is the ground."""
    mask = image > otsu(image)
    border = np.concatenate([mask[0], mask[-1], mask[:, 0], mask[:, -1]])
    return ~mask if border.mean() > 0.5 else mask


def is_ground(band: np.ndarray, ground: float) -> bool:
    """Whether nearly all of a band is as the border is."""
    return bool(band.size) and float((np.abs(band.astype(float) - ground) < BAND_RANGE).mean()) >= BAND_SHARE


def _gutters(profile: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of ``least`` rows (or columns) that hold hardly any ink, measured by the median of those that hold some."""
    if not (profile > 0).any():
        return []
    quiet = profile <= GUTTER_SHARE * float(np.median(profile[profile > 0]))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def panels(image: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """x, y, width, height, confident of a figure's panels: the tiles between the middles of its inner gutters.

    Tiles that are too small, or hold no ink by their own standard, are gaps. A figure with little ink, or with more tiles than
    ``MOST_TILES``, is one panel, and nobody can be sure of that; a figure of one tile is one panel for sure.
    """
    h, w = image.shape
    ink = foreground(image)
    if ink.mean() < LEAST_OCCUPIED:
        return [(0, 0, w, h, False)]
    ground = float(np.median(np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])))
    least = max(LEAST_GUTTER, round(min(h, w) * GUTTER_SHARE))
    rows = [(a, b) for a, b in _gutters(ink.sum(axis=1), least) if is_ground(image[a:b], ground)]
    columns = [(a, b) for a, b in _gutters(ink.sum(axis=0), least) if is_ground(image[:, a:b], ground)]
    # gutters at the figure's edge are margins
    cuts = lambda runs, n: [0, *((a + b) // 2 for a, b in runs if a > 0 and b < n), n]
    spans = lambda at: list(zip(at[:-1], at[1:], strict=True))
    tiles = [
        (x0, y0, x1 - x0, y1 - y0)
        for y0, y1 in spans(cuts(rows, h))
        for x0, x1 in spans(cuts(columns, w))
        if min(x1 - x0, y1 - y0) >= LEAST_TILE and foreground(image[y0:y1, x0:x1]).mean() >= LEAST_INK
    ]
    if len(tiles) > MOST_TILES:
        tiles = []
    if len(tiles) <= 1:
        return [(0, 0, w, h, len(tiles) == 1)]
    return [(*t, True) for t in tiles]


def _images(rows: pd.DataFrame) -> Iterator[np.ndarray]:
    for width, height, gray in zip(rows["width"], rows["height"], rows["gray"], strict=True):
        yield np.frombuffer(gray, np.uint8).reshape(int(height), int(width))


def mapped(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``images`` with width, height and gray of what the kernel makes of each; values are rounded into 0 to 255."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [np.clip(np.rint(kernel(image)), 0, 255).astype(np.uint8) for image in _images(rows)]
            yield rows.assign(width=[m.shape[1] for m in made], height=[m.shape[0] for m in made], gray=[m.tobytes() for m in made])

    return images.where("gray is not null").mapInPandas(run, images.schema)


@F.pandas_udf(StructType([StructField("least", IntegerType()), StructField("most", IntegerType())]))
def span(gray: pd.Series) -> pd.DataFrame:
    """The least and the largest grey value of each image."""
    values = [np.frombuffer(g, np.uint8) if g else None for g in gray]
    return pd.DataFrame({"least": [v if v is None else int(v.min()) for v in values], "most": [v if v is None else int(v.max()) for v in values]}, dtype="Int32")


def split(images: DataFrame, key: str) -> DataFrame:
    """key, panel, x, y, width, height, confident: a row for each panel of each figure."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "panel", "x", "y", "width", "height", "confident"]
        for rows in batches:
            yield pd.DataFrame([(k, i, *p) for k, image in zip(rows[key], _images(rows), strict=True) for i, p in enumerate(panels(image))], columns=names)

    return images.where("gray is not null").select(key, "width", "height", "gray").mapInPandas(run, f"{key} {kind}, panel int, x int, y int, width int, height int, confident boolean")


def hashed(images: DataFrame, key: str) -> DataFrame:
    """key, turns, canonical: the hashes of the image's eight orientations as 16 hex digits each, and the least."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({key: rows[key], "turns": [[f"{int(cosine_bits(t), 2):016x}" for t in turns(image)] for image in _images(rows)]})

    found = images.where("gray is not null").select(key, "width", "height", "gray").mapInPandas(run, f"{key} {kind}, turns array<string>")
    return found.withColumn("canonical", F.array_min("turns"))
