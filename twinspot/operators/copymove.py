"""Copied regions of an image: matches within it, clustered by their offsets; each cluster is verified by a robust map of its own and drawn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clustering, geometry, keypoints, matching, robust
from .shared import kept

#: Reasons for refusal in the order in which they are tried.
REASONS = ("too_few_matches", "no_model", "too_few_inliers", "too_few_distinct", "too_close")
LEAST, APART = 8, 32.0


def regions(pairs: DataFrame, cluster: str, threshold: float = 4.0, least: int = LEAST, apart: float = APART) -> DataFrame:
    """A row for each cluster of ``pairs`` (x, y, u, v): its affine map taken apart, its measures, and the reason for refusal, if any.

    matches, inliers, distinct_from, distinct_to (on the half-pixel grid), shift (of the inliers' median displacement), rms,
    rotation_deg, scale_x, scale_y, flip, reason. A cluster without a map has nulls and counts of 0; none is left out.
    """
    grid = lambda a, b: F.struct(F.rint(F.col(a) * 2), F.rint(F.col(b) * 2))
    # the key's own name may be one of the map's
    pairs, name, cluster = pairs.select(F.col(cluster).alias("_cluster"), "x", "y", "u", "v"), cluster, "_cluster"
    every = pairs.groupBy(cluster).agg(F.count("*").alias("matches"))
    maps = robust.fitted(pairs, cluster, "affine", threshold).drop("inliers")
    inside = pairs.join(maps, cluster).withColumn("_far", robust.error()).where(F.col("_far") <= threshold)
    own = inside.groupBy(cluster).agg(
        F.count("*").alias("inliers"), F.countDistinct(grid("x", "y")).alias("distinct_from"), F.countDistinct(grid("u", "v")).alias("distinct_to"),
        F.hypot(F.median(F.col("u") - F.col("x")), F.median(F.col("v") - F.col("y"))).alias("shift"), F.sqrt(F.avg(F.col("_far") * F.col("_far"))).alias("rms"),
    )
    parts = geometry.decomposed(maps.select(cluster, *[F.col(h).alias(n) for n, h in zip("abcd", ("h0", "h1", "h3", "h4"), strict=True)]))
    out = every.join(own, cluster, "left").join(parts.select(cluster, "rotation_deg", "scale_x", "scale_y", "flip"), cluster, "left")
    out = out.withColumn("_map", F.col("rotation_deg").isNotNull()).fillna(0, ["inliers", "distinct_from", "distinct_to"])
    tests = (F.col("matches") < least, ~F.col("_map"), F.col("inliers") < least, F.least("distinct_from", "distinct_to") < least, F.col("shift") < apart)
    reason = F.when(tests[0], REASONS[0])
    for test, said in zip(tests[1:], REASONS[1:], strict=True):
        reason = reason.when(test, said)
    return out.withColumn("reason", reason.otherwise("none")).drop("_map").withColumnRenamed(cluster, name)


#: Clustering of offsets, the masks' closing radius, regions that an image reports.
EPS, SAMPLES, CLOSE, MOST = 0.08, 6, 9, 8
REGION = "struct<inliers:bigint,area:double,source_box:struct<x:int,y:int,width:int,height:int>,target_box:struct<x:int,y:int,width:int,height:int>,dx:double,dy:double,rotation_deg:double,scale_x:double,flip:boolean,rms:double,cluster:bigint>"


def _ellipse(radius: int) -> list[tuple[int, int]]:
    """Row offset and half width of a filled circle's rows."""
    return [(dy, int(np.rint(radius * np.sqrt((radius**2 - dy**2) / radius**2)))) for dy in range(-radius, radius + 1)]


def _grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """Each set pixel made a circle."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    for dy, half in _ellipse(radius):
        sums = np.cumsum(np.pad(mask, ((0, 0), (half + 1, half))), axis=1, dtype=np.int32)
        wide = sums[:, 2 * half + 1 :] > sums[:, : w]
        top, end = max(0, dy), min(h, h + dy)
        out[top:end] |= wide[top - dy : end - dy]
    return out


def lobe(points: np.ndarray, sizes: np.ndarray, shape: tuple[int, int], close: int = CLOSE) -> np.ndarray:
    """(height, width): one side of a region. A disk for each point, of half its size and of ``close`` at least, with gaps up to ``close`` closed."""
    h, w = shape
    pad = close + 1
    mask = np.zeros((h + 2 * pad, w + 2 * pad), bool)
    for (x, y), size in zip(points, sizes, strict=True):
        radius = max(1, int(np.rint(max(size * 0.5, close))))
        cy, cx = int(np.rint(y)) + pad, int(np.rint(x)) + pad
        top, end, left, right = max(0, cy - radius), min(len(mask), cy + radius + 1), max(0, cx - radius), min(mask.shape[1], cx + radius + 1)
        yy, xx = np.ogrid[top:end, left:right]
        mask[top:end, left:right] |= (yy - cy) ** 2 + (xx - cx) ** 2 <= radius**2
    # what lies outside of the image is no part of it, and doesn't take anything away either
    mask[:pad], mask[-pad:], mask[:, :pad], mask[:, -pad:] = False, False, False, False
    if close > 0:
        grown = _grown(mask, close)
        grown[:pad], grown[-pad:], grown[:, :pad], grown[:, -pad:] = False, False, False, False
        outside = ~grown
        outside[:pad], outside[-pad:], outside[:, :pad], outside[:, -pad:] = False, False, False, False
        mask = grown & ~_grown(outside, close)
    return mask[pad:-pad, pad:-pad]


def _box(mask: np.ndarray) -> tuple[int, int, int, int]:
    y, x = np.nonzero(mask)
    return (int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)) if len(y) else (0, 0, 0, 0)


def masks(inliers: DataFrame, by: list[str], close: int = CLOSE) -> DataFrame:
    """``by``, source_box, target_box, area of each region's ``inliers`` (x, y, s1, u, v, s2, width, height): both lobes' boxes, the pixels of their union.

    A region's inliers are bounded by its image's keypoints, so one task draws a region.
    """
    kinds = ", ".join(f"`{c}` {inliers.schema[c].dataType.simpleString()}" for c in by)
    box = "struct<x:int,y:int,width:int,height:int>"

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        shape = int(rows["height"].iloc[0]), int(rows["width"].iloc[0])
        source = lobe(rows[["x", "y"]].to_numpy(), rows["s1"].to_numpy(), shape, close)
        target = lobe(rows[["u", "v"]].to_numpy(), rows["s2"].to_numpy(), shape, close)
        named = lambda b: dict(zip(("x", "y", "width", "height"), b, strict=True))
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in by}, "source_box": named(_box(source)), "target_box": named(_box(target)), "area": float((source | target).sum())}])

    return inliers.groupBy(*by).applyInPandas(draw, f"{kinds}, source_box {box}, target_box {box}, area double")


def copied(images: DataFrame, key: str, scale: float = keypoints.SCALE, eps: float = EPS, samples: int = SAMPLES, most: int = MOST, interest: bool = True) -> tuple[DataFrame, DataFrame]:
    """Copies within each of ``images`` (key, width, height, gray): (a row for each image, a row for each match with its region).

    Images: key, keypoints, self_matches, clusters, detected, regions, the strongest first: by inliers, then area, ``most`` at most. Images without keypoints,
    matches or regions have their row too. Matches: key, x, y, u, v, cluster (-1 for noise), region: its place among the image's, or -1.
    """
    found = kept(keypoints.detected(images, key, scale, interest), "detections").withColumnRenamed(key, "_image")
    matches = keypoints.within(found, "_image").join(found.select("_image", "width", "height"), "_image")
    turned = matching.offsets(matches.withColumn("_diagonal", F.hypot("width", "height")), F.col("_diagonal"))
    one, two = [F.when(F.col("swapped"), F.col(f"{c}2")).otherwise(F.col(f"{c}1")) for c in "xys"], [F.when(F.col("swapped"), F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in "xys"]
    sides = [c.alias(n) for c, n in zip([*one, *two], ("x", "y", "s1", "u", "v", "s2"), strict=True)]
    axes = tuple(f"f{k}" for k in range(5))
    placed = kept(turned.select("_image", "width", "height", *sides, *axes).withColumn("id", F.xxhash64("_image", "x", "y", "u", "v")), "offsets")
    clusters = kept(clustering.dbscan(placed, eps, samples, axes, ("_image",)), "clusters")
    members = kept(placed.join(clusters, "id"), "members")
    dense = members.where("cluster <> -1").select("_image", "cluster", "id", "x", "y", "u", "v", "s1", "s2", "width", "height")
    fit = kept(regions(dense.withColumn("region", F.struct("_image", "cluster")).withColumn("_region", F.to_json("region")), "_region").where("reason = 'none'"), "regions")
    names = dense.select(F.to_json(F.struct("_image", "cluster")).alias("_region"), "_image", "cluster").distinct()
    good = fit.join(names, "_region")
    points = dense.withColumn("_region", F.to_json(F.struct("_image", "cluster")))
    maps = robust.fitted(points.select("_region", "x", "y", "u", "v"), "_region", "affine").select("_region", *robust.MAP)
    inside = kept(points.join(fit.select("_region"), "_region", "left_semi").join(maps, "_region").where(robust.error() <= 4.0).drop(*robust.MAP), "region-inliers")
    drawn = masks(inside, ["_region"])
    moved = inside.groupBy("_region").agg(F.median(F.col("u") - F.col("x")).alias("dx"), F.median(F.col("v") - F.col("y")).alias("dy"))
    whole = good.join(drawn, "_region").join(moved, "_region")
    fields = ("inliers", "area", "source_box", "target_box", "dx", "dy", "rotation_deg", "scale_x", "flip", "rms", "cluster")
    first = whole.withColumn("_order", F.row_number().over(Window.partitionBy("_image").orderBy(F.desc("inliers"), F.desc("area"), "cluster"))).where(F.col("_order") <= most)
    listed = first.groupBy("_image").agg(F.transform(F.array_sort(F.collect_list(F.struct("_order", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("regions"))
    counts = members.groupBy("_image").agg(F.count("*").alias("self_matches"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))
    each = found.select("_image", F.size("keypoints").alias("keypoints")).join(counts, "_image", "left").join(listed, "_image", "left").fillna(0, ["self_matches", "clusters"])
    each = each.withColumn("regions", F.coalesce("regions", F.array().cast(f"array<{REGION}>"))).withColumn("detected", F.size("regions") > 0)
    place = first.select("_region", (F.col("_order") - 1).alias("region"))
    labels = inside.select("id", "_region").join(place, "_region").select("id", "region")
    labelled = members.select("_image", "id", "x", "y", "u", "v", "cluster").join(labels, "id", "left").fillna(-1, ["region"]).drop("id")
    return each.select(F.col("_image").alias(key), "keypoints", "self_matches", "clusters", "detected", "regions"), labelled.withColumnRenamed("_image", key)
