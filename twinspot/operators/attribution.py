"""Attribution maps from a network's activations and gradients, given as arrays: pooling, their health, and their way back to the picture.

A map's row has ``activations`` and ``gradients``, each by channels, then rows, then columns. Pooling stays in the JVM; the way back is a kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keypoints

#: The share of zeros from which a map is suppressed, and by which it must exceed the other side's.
SUPPRESSED, GAP = 0.20, 0.15
#: How much smaller each stage's map is than the network's input.
STRIDES = {"block1": 2, "block2": 4, "block3": 8, "block4": 16}
MODES = ("abs", "relu", "signed")


def grid_size(embed_size: int, stage: str) -> int:
    return embed_size // STRIDES[stage]


def pooled(rows: DataFrame, channels: int, mode: str = "abs") -> DataFrame:
    """Adds grid, zero_fraction and degenerate to rows with activations and gradients.

    Each channel weighs as much as its gradients' mean (of their sizes, with ``abs``). ``relu`` cuts the map at zero, ``signed`` takes its size. The map
    is brought to 0 to 1; a constant one is all zeros, and degenerate.
    """
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {', '.join(MODES)}")
    cells = (F.size("activations") / channels).cast("int")
    part = lambda c: F.slice("gradients", c * F.col("_cells") + 1, F.col("_cells"))
    size = (lambda x: F.abs(x)) if mode == "abs" else (lambda x: x)
    mean = lambda c: F.aggregate(part(c), F.lit(0.0), lambda s, x: s + size(x.cast("double"))) / F.col("_cells")
    out = rows.withColumn("_cells", cells).withColumn("_weights", F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), mean))

    def cell(i: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(0), F.lit(channels - 1)), F.lit(0.0), lambda s, c: s + F.get(F.col("_weights"), c) * F.get(F.col("activations"), c * F.col("_cells") + i).cast("double"))
        return F.greatest(F.lit(0.0), total) if mode == "relu" else F.abs(total) if mode == "signed" else total

    out = out.withColumn("_raw", F.transform(F.sequence(F.lit(0), F.col("_cells") - 1), cell))
    out = out.withColumn("_low", F.array_min("_raw")).withColumn("_reach", F.array_max("_raw") - F.col("_low"))
    grid = F.transform("_raw", lambda x: F.when(F.col("_reach") > 0, (x - F.col("_low")) / F.col("_reach")).otherwise(0.0))
    out = out.withColumn("grid", grid)
    return health(out.drop("_cells", "_weights", "_raw", "_low", "_reach"))


def health(rows: DataFrame) -> DataFrame:
    """Adds zero_fraction, the share of cells at exactly zero, and degenerate: whether the map is constant."""
    zero = F.size(F.filter("grid", lambda x: x == 0)) / F.size("grid")
    return rows.withColumn("zero_fraction", zero).withColumn("degenerate", F.array_max("grid") - F.array_min("grid") <= 0)


def suppressed(left_zero: Column, right_zero: Column) -> Column:
    """The side whose map is mostly dead while the other one's isn't: left, right or null."""
    dead = lambda a, b: (a >= SUPPRESSED) & (a - b >= GAP)
    return F.when(dead(right_zero, left_zero), "right").when(dead(left_zero, right_zero), "left")


def to_canvas(grid: np.ndarray, size: int) -> np.ndarray:
    """The map at the network's input size, within 0 and 1."""
    return np.clip(keypoints.cubic(grid, size, size), 0.0, 1.0)


def to_source(grid: np.ndarray, width: int, height: int, size: int, squash: bool = False) -> np.ndarray:
    """The map on the picture's pixels: what the letterbox added is cut off before the resize."""
    canvas = to_canvas(grid, size)
    if not squash:
        scale = min(size / width, size / height)
        cw, ch = (int(min(size, max(1, np.rint(n * scale)))) for n in (width, height))
        top, left = (size - ch) // 2, (size - cw) // 2
        canvas = canvas[top : top + ch, left : left + cw]
    return np.clip(keypoints.cubic(canvas, width, height), 0.0, 1.0)


def projected(rows: DataFrame, key: str, size: int, squash: bool = False) -> DataFrame:
    """key, width, height, heat (bytes by rows, 255 for 1) of maps (key, width, height, grid); a degenerate map has no picture."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            heat = []
            for w, h, grid in zip(part["width"], part["height"], part["grid"], strict=True):
                side = int(np.sqrt(len(grid)))
                own = np.asarray(grid, float).reshape(side, side)
                heat.append(np.rint(to_source(own, int(w), int(h), size, squash) * 255).astype(np.uint8).tobytes() if np.ptp(own) > 0 else None)
            yield pd.DataFrame({key: part[key], "width": part["width"], "height": part["height"], "heat": heat})

    return rows.select(key, "width", "height", "grid").mapInPandas(run, f"`{key}` {kind}, width int, height int, heat binary")
