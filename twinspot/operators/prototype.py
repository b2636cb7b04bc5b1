"""The first prototype's rules, kept beside those that replaced them, so that its old results can be made again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import compare, pixels

#: Its input size, and its gates.
SIZE, LEAST_IN_BOXES, LEAST_MATCHES, LEAST_INLIERS, LEAST_SHARE = 128, 8, 4, 8, 0.18


def preprocessed(image: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The picture pressed into a square, without regard to its sides' ratio, as values of -1 to 1."""
    return pixels.normalised(pixels.resized(image, size, size))


def in_boxes(points: DataFrame, boxes: DataFrame, image: str, least: int = LEAST_IN_BOXES) -> DataFrame:
    """``points`` (image, kp, x, y) that lie in some of their image's ``boxes`` (image, bx, by, width, height); all, if fewer than ``least`` do.

    Boxes of an image are few and meet its points by an equi-join; a box holds its left and upper edge, and not the others.
    """
    inside = (F.col("x") >= F.col("bx")) & (F.col("x") < F.col("bx") + F.col("width")) & (F.col("y") >= F.col("by")) & (F.col("y") < F.col("by") + F.col("height"))
    held = points.join(boxes, image).where(inside).select(image, "kp").distinct()
    enough = held.groupBy(image).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(image, F.lit(True).alias("_enough"))
    marked = points.join(held.withColumn("_in", F.lit(True)), [image, "kp"], "left").join(enough, image, "left")
    return marked.where(F.col("_in") | F.col("_enough").isNull()).drop("_in", "_enough")


def gated(matches: Column, inliers: Column) -> Column:
    """Its three gates in their order; bounds pass."""
    share = F.when(matches > 0, inliers.cast("double") / matches).otherwise(0.0)
    return F.when(matches < LEAST_MATCHES, "too_few_matches").when(inliers < LEAST_INLIERS, "too_few_inliers").when(share < LEAST_SHARE, "low_inlier_ratio").otherwise("none")


def similarity_parts(maps: DataFrame) -> DataFrame:
    """Adds rotation, scale and flip of maps a, b, c, d as the prototype read them: by the first column alone. A fit of four numbers never mirrors."""
    return maps.withColumns({"rotation": F.degrees(F.atan2("c", "a")), "scale": F.hypot("a", "c"), "flip": F.col("a") * F.col("d") - F.col("b") * F.col("c") < 0})


def one_against_many(images: DataFrame, key: str, base: str, scale: float = compare.keypoints.SCALE) -> tuple[DataFrame, DataFrame]:
    """(pairs, summary): the base against every other image, and how many are suspicious. An image that is missing is an error."""
    if images.where(F.col(key) == base).isEmpty():
        raise ValueError(f"no image {base}")
    pairs = images.where(F.col(key) != base).select(F.lit(base).alias("a"), F.col(key).alias("b"))
    found = compare.kept(compare.compared(images, pairs, key, scale=scale), "one-against-many")
    summary = found.agg(F.count("*").alias("compared"), F.count_if(F.col("reason") == "none").alias("suspicious"), F.max("inliers").alias("most_inliers"))
    return found, summary
