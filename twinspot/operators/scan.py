"""A whole scan: figures to panels, hashes, near pairs, comparison, findings, and what share of the pairs it covered. And an index of hashes.

Figures that can't be read, pairs that can't be compared, and pairs beyond the number that is asked for are counted, never silently left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, compare, fusion, pixels, review
from .shared import kept

#: The hashes' distance up to which panels are compared, and pairs of a scan.
HAMMING, PAIRS = 32, 500
#: Reasons after which geometry says nothing, neither for nor against.
ABSTAINED = ("too_few_matches", "too_few_keypoints", "estimation_failed")


def panel_images(figures: DataFrame, key: str) -> DataFrame:
    """figure, panel, x, y, width, height, gray, confident: the panels of ``figures`` (key, width, height, gray) as images of their own.

    A panel's name is its figure's with its place; where the figure may hold more than one, it ends in ``_unsplit``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, w, h, gray in zip(rows["figure"], rows["width"], rows["height"], rows["gray"], strict=True):
                image = np.frombuffer(gray, np.uint8).reshape(int(h), int(w))
                made = [(name, f"{name}_p{k:02d}{'' if sure else '_unsplit'}", x, y, pw, ph, np.ascontiguousarray(image[y : y + ph, x : x + pw]).tobytes(), sure) for k, (x, y, pw, ph, sure) in enumerate(pixels.panels(image))]
                yield pd.DataFrame(made, columns=["figure", "panel", "x", "y", "width", "height", "gray", "confident"])

    shape = "figure string, panel string, x int, y int, width int, height int, gray binary, confident boolean"
    return figures.where("gray is not null").select(F.col(key).cast("string").alias("figure"), "width", "height", "gray").mapInPandas(run, shape)


def hashes(images: DataFrame, key: str) -> DataFrame:
    """key, id, turns (eight hashes as numbers), canonical of each image with pixels."""
    found = pixels.hashed(images, key)
    number = lambda t: F.conv(t, 16, -10).cast("long")
    return found.select(key, F.xxhash64(F.col(key).cast("string")).alias("id"), F.transform("turns", number).alias("turns"), "canonical")


def near_pairs(images: DataFrame, key: str, hamming: int = HAMMING) -> DataFrame:
    """a, b, hamming of the images whose hashes differ in up to ``hamming`` bits in some orientation; a < b by name."""
    found = kept(hashes(images, key), "hashes")
    pairs = blocks.pairs(found, "id", "turns", blocks.turned_hamming, "int", hamming).withColumnsRenamed({"a": "_a", "b": "_b"})
    name = lambda at, to: found.select(F.col("id").alias(at), F.col(key).alias(to))
    both = pairs.join(name("_a", "p"), "_a").join(name("_b", "q"), "_b")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.col("distance").alias("hamming"))


def judged(pairs: DataFrame) -> DataFrame:
    """``compare.compared``'s rows with the features, logit, confidence and verdict of their geometry; no embedding speaks here."""
    passed = F.col("reason") == "none"
    uneven = F.when(F.col("scale_y") > 0, (F.abs(F.col("scale_x") / F.col("scale_y") - 1) > 0.05).cast("int")).otherwise(0)
    odd = F.col("flip").cast("int") + uneven + (F.abs("shear_deg") > 2).cast("int")
    rows = pairs.withColumns({
        "similarity": F.lit(0.5), "verified": passed, "refuted": ~passed & ~F.col("reason").isin(*ABSTAINED), "distinct": F.col("distinct_inliers"), "ratio": F.col("inlier_ratio"),
        "rms": F.coalesce("reproj_rms", F.lit(0.0)), "area": F.coalesce("matched_area", F.lit(0.0)), "odd": F.coalesce(odd, F.lit(0)),
        "lo": F.least("keypoints_a", "keypoints_b"), "hi": F.greatest("keypoints_a", "keypoints_b"), "injective": F.lit(True),
    })
    out = fusion.scored(fusion.pair_features(rows), fusion.PAIR_WEIGHTS, fusion.PAIR_PRIOR)
    return out.drop("similarity", "verified", "refuted", "distinct", "ratio", "rms", "area", "odd", "lo", "hi", "injective")


def scanned(figures: DataFrame, key: str, hamming: int = HAMMING, most: int = PAIRS, scale: float = compare.keypoints.SCALE) -> tuple[DataFrame, DataFrame]:
    """(findings, coverage) of ``figures`` (key, width, height, gray, error).

    Findings: a row for each compared pair of panels with its evidence, confidence and verdict; those flagged have their place by confidence. Coverage: one
    row with the numbers of figures, figures without pixels, panels, pairs, pairs within ``hamming``, compared and truncated pairs, and shares.
    """
    panels = kept(panel_images(figures, key), "panels")
    near = kept(near_pairs(panels, "panel", hamming), "near-pairs")
    # the number of pairs is the feature: the nearest are compared
    chosen = kept(near.orderBy("hamming", "a", "b").limit(most), "chosen-pairs")
    found = judged(compare.compared(panels, chosen, "panel", scale=scale)).join(chosen, ["a", "b"])
    found = kept(review.findings(found, "a", "b"), "findings")
    flagged = found.where("flagged").select("a", "b", "confidence")
    # places among the flagged of one scan, which are at most ``most``
    from pyspark.sql import Window

    places = flagged.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "a", "b"))).drop("confidence")
    out = found.join(places, ["a", "b"], "left")
    counts = figures.agg(F.count("*").alias("figures"), F.count_if(F.col("gray").isNull()).alias("unread")).crossJoin(panels.agg(F.count("*").alias("panels"))).crossJoin(near.agg(F.count("*").alias("near")))
    counts = counts.crossJoin(chosen.agg(F.count("*").alias("compared")))
    total = (F.col("panels") * (F.col("panels") - 1) / 2).cast("long")
    coverage = counts.select(
        "figures", "unread", "panels", total.alias("pairs"), "near", "compared", (total - F.col("near")).alias("screened_out"), (F.col("near") - F.col("compared")).alias("truncated"),
        F.when(total > 0, F.col("compared") / total).otherwise(1.0).alias("coverage"), F.when(F.col("figures") > 0, 1 - F.col("unread") / F.col("figures")).otherwise(0.0).alias("readable"),
    )
    return out, coverage


def write_index(images: DataFrame, key: str, folder: str) -> None:
    """Store the hashes of ``images`` (key, width, height, gray, error); those without pixels keep their row, with the error."""
    rows = images.select(F.col(key).cast("string").alias("name"), "error").join(hashes(images, key).select(F.col(key).cast("string").alias("name"), "id", "turns", "canonical"), "name", "left")
    rows.write.parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """name, error, id, turns, canonical. Another kind of table is an error."""
    rows = spark.read.parquet(folder)
    if missing := {"name", "error", "id", "turns", "canonical"} - set(rows.columns):
        raise ValueError(f"{folder} is no index of hashes: it lacks {', '.join(sorted(missing))}")
    return rows


def lookup(index: DataFrame, images: DataFrame, key: str, k: int = 10, hamming: int = HAMMING) -> DataFrame:
    """needle, name, hamming, rank: the k nearest of the index for each image, up to ``hamming`` bits away, in any orientation."""
    asked = kept(hashes(images, key), "asked")
    known = index.where("id is not null")
    found = blocks.nearest(asked.select("id", "turns"), known.select("id", "turns"), "id", "turns", blocks.turned_hamming, "int", k).where(F.col("dist") <= hamming)
    names = known.select(F.col("id").alias("dst"), "name")
    needles = asked.select(F.col("id").alias("src"), F.col(key).alias("needle"))
    return found.join(needles, "src").join(names, "dst").select("needle", "name", F.col("dist").alias("hamming"), "rank")
