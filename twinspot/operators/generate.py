"""Made changes of pictures: random marks, noise and shifts for training, and the five attacks of the benchmark. And the benchmark itself.

What is random comes from a picture's key, so that a rerun makes the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import jpeg
from . import compare, copymove

#: The segments of a digit, clockwise from the top, the middle last.
_DIGITS = ("1111110", "0110000", "1101101", "1111001", "0110011", "1011011", "1011111", "1110000", "1111111", "1111011")


def rng_of(key: object, what: str) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(str(key).encode()), zlib.crc32(what.encode())])


def _clipped(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def digits(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random number written on it, by segments."""
    out, h, w = image.copy(), *image.shape
    size = max(3, int(min(h, w) * rng.uniform(0.05, 0.12)))
    text, thick = rng.integers(0, 10, rng.integers(2, 6)), max(1, size // 5)
    y, x, ink = int(rng.integers(0, max(1, h - 2 * size))), int(rng.integers(0, max(1, w - len(text) * 2 * size))), int(rng.integers(0, 256))
    for n, d in enumerate(text):
        left = x + n * (size + 2 * thick)
        spots = [(0, 0, thick, size), (0, size - thick, size, thick), (size, size - thick, size, thick), (2 * size - thick, 0, thick, size), (size, 0, size, thick), (0, 0, size, thick), (size - thick // 2, 0, thick, size)]
        for on, (dy, dx, dh, dw) in zip(_DIGITS[d], spots, strict=True):
            if on == "1":
                out[y + dy : y + dy + dh, left + dx : left + dx + dw] = ink
    return out


def rectangle(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random filled rectangle of a tenth to a third of each side."""
    out, (h, w) = image.copy(), image.shape
    dh, dw = (max(1, int(n * rng.uniform(0.1, 0.34))) for n in (h, w))
    y, x = int(rng.integers(0, h - dh + 1)), int(rng.integers(0, w - dw + 1))
    out[y : y + dh, x : x + dw] = rng.integers(0, 256)
    return out


def erased(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random rectangle in the picture's commonest border value, as if nothing had been there."""
    border = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    changed = rectangle(image, rng) != image
    return np.where(changed, np.uint8(np.median(border)), image)


def noisy(image: np.ndarray, rng: np.random.Generator, low: float = 5.0, high: float = 25.0) -> np.ndarray:
    return _clipped(image + rng.normal(0, rng.uniform(low, high), image.shape))


def shifted(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Brighter or darker by up to three tenths."""
    return _clipped(image * rng.uniform(0.7, 1.3))


#: Training changes by name.
CHANGES: dict[str, Callable] = {"text": digits, "rect": rectangle, "erase": erased, "noise": noisy, "shift": shifted}


def warped(image: np.ndarray, matrix: np.ndarray, width: int, height: int, ground: float = 0.0) -> np.ndarray:
    """The picture under an affine map (2, 3) from its pixels to the new ones, by linear interpolation."""
    back = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    y, x = np.mgrid[0:height, 0:width]
    sx, sy = (back[k, 0] * x + back[k, 1] * y + back[k, 2] for k in range(2))
    h, w = image.shape
    inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
    sx, sy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), max(0, w - 2)), np.minimum(sy.astype(int), max(0, h - 2))
    fx, fy = sx - x0, sy - y0
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    made = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return _clipped(np.where(inside, made, ground))


def affine(image: np.ndarray) -> np.ndarray:
    """Turned by 45 degrees, larger by a fifth, and mirrored, about its middle."""
    h, w = image.shape
    cos = sin = 1.2 * np.sqrt(0.5)
    size = int(np.ceil(np.hypot(h, w) * 1.2))
    # mirrored first
    linear = np.asarray([[cos, -sin], [sin, cos]]) @ np.diag([-1.0, 1.0])
    middle = np.asarray([(w - 1) / 2, (h - 1) / 2])
    return warped(image, np.column_stack([linear, np.asarray([(size - 1) / 2] * 2) - linear @ middle]), size, size)


def degraded(image: np.ndarray) -> np.ndarray:
    """Noise of 20 and a coarse JPEG."""
    noise = np.random.default_rng(1234).normal(0, 20, image.shape)
    return jpeg.decode(jpeg.encode(_clipped(image + noise), 24))


def pasted(image: np.ndarray) -> np.ndarray:
    """A patch of a quarter of the smaller side, from a tenth of the way to six tenths."""
    out, (h, w) = image.copy(), image.shape
    size = min(h, w) // 4
    y0, x0, y1, x1 = int(h * 0.1), int(w * 0.1), int(h * 0.6), int(w * 0.6)
    out[y1 : y1 + size, x1 : x1 + size] = image[y0 : y0 + size, x0 : x0 + size]
    return out


def exposed(image: np.ndarray) -> np.ndarray:
    """Contrast of 1.8 about the mean, then half the brightness."""
    mean = image.mean()
    return _clipped((mean + 1.8 * (image - mean)) * 0.5)


def blacked(image: np.ndarray) -> np.ndarray:
    """A black box in the middle, of 15 percent of each side."""
    out, (h, w) = image.copy(), image.shape
    dh, dw = max(1, int(h * 0.15)), max(1, int(w * 0.15))
    y, x = (h - dh) // 2, (w - dw) // 2
    out[y : y + dh, x : x + dw] = 0
    return out


#: The attacks and their names.
ATTACKS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"ex1_affine": affine, "ex2_degraded": degraded, "ex3_copymove": pasted, "ex4_exposure": exposed, "ex5_blackout": blacked}


def _made(images: DataFrame, key: str, names: list[str], one: Callable[[object, str, np.ndarray], np.ndarray]) -> DataFrame:
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for own, w, h, gray in zip(rows[key], rows["width"], rows["height"], rows["gray"], strict=True):
                image = np.frombuffer(gray, np.uint8).reshape(int(h), int(w))
                made = [one(own, n, image) for n in names]
                yield pd.DataFrame({key: [own] * len(names), "change": names, "width": [m.shape[1] for m in made], "height": [m.shape[0] for m in made], "gray": [np.ascontiguousarray(m).tobytes() for m in made]})

    return images.where("gray is not null").select(key, "width", "height", "gray").mapInPandas(run, f"`{key}` {kind}, change string, width int, height int, gray binary")


def changed(images: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """key, change, width, height, gray: a row for each training change of each image."""
    return _made(images, key, names or list(CHANGES), lambda own, n, image: CHANGES[n](image, rng_of(own, n)))


def attacked(images: DataFrame, key: str) -> DataFrame:
    """key, change, width, height, gray: the five attacks on each image."""
    return _made(images, key, list(ATTACKS), lambda _, n, image: ATTACKS[n](image))


def benchmark(images: DataFrame, key: str, scale: float = compare.keypoints.SCALE) -> tuple[DataFrame, DataFrame]:
    """(cases, recall): each image against its five attacks, the pasted one against itself by its copies; and each attack's share that is detected.

    Cases: key, change, detected, reason, matches, inliers.
    """
    own = images.where("gray is not null").select(F.col(key).cast("string").alias("name"), "width", "height", "gray")
    made = attacked(own, "name").withColumn("name", F.concat("name", F.lit("#"), "change"))
    pairs = made.where("change <> 'ex3_copymove'").select(F.regexp_extract("name", "^(.*)#[^#]*$", 1).alias("a"), F.col("name").alias("b"))
    found = compare.compared(own.union(made.drop("change")), pairs, "name", scale=scale)
    change = lambda c: F.regexp_extract(c, "#([^#]*)$", 1).alias("change")
    cases = found.select(F.col("a").alias(key), change("b"), (F.col("reason") == "none").alias("detected"), "reason", "matches", "inliers")
    each, _ = copymove.copied(made.where("change = 'ex3_copymove'").drop("change"), "name", scale=scale)
    copies = each.select(F.regexp_extract("name", "^(.*)#[^#]*$", 1).alias(key), change("name"), "detected", F.when(F.col("detected"), "none").otherwise("no_region").alias("reason"), F.col("self_matches").alias("matches"), F.coalesce(F.get("regions", F.lit(0))["inliers"], F.lit(0)).alias("inliers"))
    cases = copymove.kept(cases.unionByName(copies), "cases")
    recall = cases.groupBy("change").agg(F.count("*").alias("cases"), F.count_if("detected").alias("detected")).withColumn("recall", F.col("detected") / F.col("cases"))
    return cases, recall
