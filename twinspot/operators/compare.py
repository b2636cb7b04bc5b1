"""Pairs of images from pixels to a verdict on their geometry: keypoints, matches, a robust map, its measures, ordered gates, mirrored retries.

Every pair that is asked for has a row, whatever went wrong with it: an image without pixels or keypoints, no match, no map. Gates and
measures are in the images' own pixels; the map that is reported is in those of the files that they were made smaller from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import geometry, keypoints, pixels, review, robust
from .shared import kept

#: Reasons for refusal in the order in which they are tried.
REASONS = {
    "too_few_keypoints": "An image has too few keypoints to be compared.",
    "too_few_matches": "Too few matches are left to fit a map.",
    "estimation_failed": "No map was found.",
    "too_few_inliers": "Too few matches agree with the map.",
    "degenerate_correspondences": "The matches that agree stand on too few different points, and many of one point count as one.",
    "low_inlier_ratio": "Too small a share of the matches agrees with the map.",
    "insufficient_spread": "The matches that agree lie in a small part of the image, which settles no map of the whole.",
    "collinear_inliers": "The matches that agree lie nearly on a line.",
    "high_reprojection_error": "The matches that agree fit the map loosely.",
    "ill_conditioned": "The map is close to one that presses the image flat.",
    "none": "All gates are passed.",
}
#: The gates.
LEAST_KEYPOINTS, LEAST_MATCHES, LEAST_INLIERS, LEAST_DISTINCT, LEAST_SHARE, LEAST_SPREAD, LEAST_AXES, MOST_RMS, MOST_CONDITION = 15, 8, 15, 12, 0.18, 0.10, 0.02, 5.0, 1e3
THRESHOLD = 4.0


def explained(reason: Column) -> Column:
    """A sentence for each reason."""
    return F.element_at(F.create_map(*[F.lit(x) for item in REASONS.items() for x in item]), reason)


def rescaled(maps: DataFrame, source_scale: Column, target_scale: Column) -> DataFrame:
    """h0 to h8 of maps between images made smaller by these scales, as maps between the images that they were made from."""
    ratio = source_scale / target_scale
    return maps.withColumns({f"h{k}": F.col(f"h{k}") * ratio for k in (0, 1, 3, 4)} | {f"h{k}": F.col(f"h{k}") / target_scale for k in (2, 5)} | {f"h{k}": F.col(f"h{k}") * source_scale for k in (6, 7)})


def _side(x: str, y: str, name: str) -> list[Column]:
    grid = F.struct(F.rint(F.col(x) * 2), F.rint(F.col(y) * 2))
    xx, yy, xy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return [
        F.countDistinct(grid).alias(f"distinct_{name}"), F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias(f"reach_{name}"),
        (xx + yy).alias(f"trace_{name}"), (xx * yy - xy * xy).alias(f"det_{name}"),
    ]


def _axes(name: str) -> Column:
    """The cloud's shorter axis over its longer one."""
    trace = F.col(f"trace_{name}")
    root = F.sqrt(F.greatest(F.lit(0.0), trace * trace - 4 * F.col(f"det_{name}")))
    return F.when(trace + root > 0, F.sqrt(F.greatest(F.lit(0.0), trace - root) / (trace + root))).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _condition(rows: pd.DataFrame) -> pd.Series:
    """Of maps in units of both images' diagonals: the largest singular value over the smallest."""
    full = rows[robust.MAP].to_numpy(float).reshape(-1, 3, 3)
    a, b = rows["diagonal_a"].to_numpy(float)[:, None], rows["diagonal_b"].to_numpy(float)[:, None]
    full[:, :2, :2] *= (a / b)[:, :, None]
    full[:, :2, 2] /= b
    full[:, 2, :2] *= a
    s = np.full((len(full), 3), np.nan)
    good = np.isfinite(full).all(axis=(1, 2))
    if good.any():
        s[good] = np.linalg.svd(full[good], compute_uv=False)
    with np.errstate(divide="ignore", invalid="ignore"):
        return pd.Series(np.where(s[:, 2] > 0, s[:, 0] / s[:, 2], np.where(good, np.inf, np.nan)))


def verified(matches: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each of ``pairs`` (pair, diagonal_a, diagonal_b, area_a, scale_a, scale_b): what its ``matches`` (pair, x, y, u, v) prove.

    matches, inliers, inlier_ratio, distinct_inliers, inlier_spread, reproj_rms (there and back), condition; reason and explanation; and, of pairs that
    pass, the map h0 to h8, its rotation, scales, shear and flip in the files' pixels, and the share of the first image inside the inliers' hull.
    """
    known = matches.select("pair", *[F.col(c).cast("double").alias(c) for c in "xyuv"]).dropna()
    maps = kept(robust.fitted(known, "pair", "homography", threshold).drop("inliers"), "maps")
    inside = known.join(maps, "pair").withColumn("_there", robust.error()).where(F.col("_there") <= threshold).drop(*robust.MAP)
    back = robust.inverse(maps)
    inside = inside.join(back, "pair", "left").withColumn("_back", robust.error("u", "v", "x", "y")).drop(*robust.MAP)
    inside = kept(inside.withColumn("_far", (F.col("_there") + F.coalesce("_back", "_there")) / 2).drop("_there", "_back"), "inliers")
    own = inside.groupBy("pair").agg(F.count("*").alias("inliers"), F.sqrt(F.avg(F.col("_far") * F.col("_far"))).alias("reproj_rms"), *_side("x", "y", "a"), *_side("u", "v", "b"))
    counts = known.groupBy("pair").agg(F.count("*").alias("matches"))
    out = pairs.join(counts, "pair", "left").join(own, "pair", "left").join(maps, "pair", "left").fillna(0, ["matches", "inliers"])
    conditioned = F.when(F.col("h8").isNotNull(), _condition(F.struct(*robust.MAP, "diagonal_a", "diagonal_b")))
    out = out.withColumns({
        "inlier_ratio": F.when(F.col("matches") > 0, F.col("inliers") / F.col("matches")).otherwise(0.0),
        "distinct_inliers": F.coalesce(F.least("distinct_a", "distinct_b"), F.lit(0)),
        "inlier_spread": F.coalesce(F.least(F.col("reach_a") / F.col("diagonal_a"), F.col("reach_b") / F.col("diagonal_b")), F.lit(0.0)),
        "_axes": F.least(_axes("a"), _axes("b")), "condition": conditioned,
    })
    keys = F.least("keypoints_a", "keypoints_b") if {"keypoints_a", "keypoints_b"} <= set(pairs.columns) else F.lit(LEAST_KEYPOINTS)
    tests = (
        keys < LEAST_KEYPOINTS, F.col("matches") < LEAST_MATCHES, F.col("h8").isNull(), F.col("inliers") < LEAST_INLIERS, F.col("distinct_inliers") < LEAST_DISTINCT,
        F.col("inlier_ratio") < LEAST_SHARE, F.col("inlier_spread") < LEAST_SPREAD, F.col("_axes") < LEAST_AXES, F.col("reproj_rms") > MOST_RMS,
        F.isnan("condition") | (F.col("condition") > MOST_CONDITION),
    )
    reason = F.when(tests[0], "too_few_keypoints")
    for test, name in zip(tests[1:], list(REASONS)[1:-1], strict=True):
        reason = reason.when(test, name)
    out = out.withColumn("reason", reason.otherwise("none")).withColumn("explanation", explained(F.col("reason")))
    out = rescaled(out, F.col("scale_a"), F.col("scale_b"))
    passed = F.col("reason") == "none"
    good = out.where(passed).select("pair")
    held = inside.join(good, "pair", "left_semi")
    fit = geometry.affine(held, "pair").join(pairs.select("pair", "scale_a", "scale_b"), "pair")
    ratio = F.col("scale_a") / F.col("scale_b")
    parts = geometry.decomposed(fit.withColumns({c: F.col(c) * ratio for c in "abcd"})).select("pair", "rotation_deg", "scale_x", "scale_y", "shear_deg", "flip")
    area = review.hulls(held, "pair").select("pair", F.col("area").alias("_hull"))
    out = out.join(parts, "pair", "left").join(area, "pair", "left")
    out = out.withColumn("matched_area", F.when(passed, F.least(F.lit(1.0), F.col("_hull") / F.col("area_a"))))
    out = out.withColumns({c: F.when(passed, F.col(c)) for c in robust.MAP})
    return out.select(
        *pairs.columns, "matches", "inliers", "inlier_ratio", "distinct_inliers", "inlier_spread", "reproj_rms", "condition", "reason", "explanation", *robust.MAP, "rotation_deg", "scale_x", "scale_y", "shear_deg", "flip", "matched_area"
    )


def mirrored(images: DataFrame, key: str, scale: float = keypoints.SCALE, interest: bool = True) -> DataFrame:
    """``keypoints.detected`` on the images' mirror images, with places and angles mapped back."""
    flipped = pixels.mapped(images.select(key, "width", "height", "gray"), lambda image: image[:, ::-1])
    found = keypoints.detected(flipped, key, scale, interest)
    back = lambda p: F.struct(p["kp"].alias("kp"), (F.col("width") - 1 - p["x"]).alias("x"), p["y"].alias("y"), p["size"].alias("size"), F.pmod(180 - p["angle"], F.lit(360.0)).alias("angle"), p["response"].alias("response"), p["descriptor"].alias("descriptor"))
    return found.withColumn("keypoints", F.transform("keypoints", back))


def _judged(left: DataFrame, right: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Evidence on ``pairs`` (pair, a, b) from detections of both sides."""
    side = lambda rows, s: rows.select(F.col(key).alias(s), F.col("keypoints").alias(f"_{s}"), F.size("keypoints").alias(f"keypoints_{s}"), F.col("width").alias(f"width_{s}"), F.col("height").alias(f"height_{s}"), F.col("scale").alias(f"scale_{s}"))
    both = kept(pairs.join(side(left, "a"), "a", "left").join(side(right, "b"), "b", "left").fillna(0, ["keypoints_a", "keypoints_b"]).fillna(1.0, ["scale_a", "scale_b"]), "pairs")
    floor = F.least("keypoints_a", "keypoints_b") >= LEAST_KEYPOINTS
    found = kept(keypoints.matched(both.where(floor).select("pair", F.col("_a").alias("a"), F.col("_b").alias("b"))), "matches")
    counts = found.groupBy("pair").agg(F.first("candidates").alias("candidates"), F.first("passed").alias("after_ratio"))
    sized = both.drop("_a", "_b").withColumns({f"diagonal_{s}": F.hypot(f"width_{s}", f"height_{s}") for s in "ab"} | {"area_a": F.col("width_a") * F.col("height_a")})
    sized = sized.join(counts, "pair", "left").fillna(0, ["candidates", "after_ratio"])
    return verified(found, sized)


def compared(images: DataFrame, pairs: DataFrame, key: str, reflection: bool = True, scale: float = keypoints.SCALE, interest: bool = True) -> DataFrame:
    """A row for each of ``pairs`` (a, b: keys of ``images``) with the counts of each step, its evidence, reason and map.

    ``images`` has key, width, height, gray and, where they were made smaller, scale. Refused pairs are tried again with the second image
    mirrored; only those that are verified then change, and are ``reflected``. A key that ``images`` lacks counts as an image without keypoints.
    """
    if "scale" not in images.columns:
        images = images.withColumn("scale", F.lit(1.0))
    sizes = images.select(F.col(key).alias("_key"), F.coalesce("scale", F.lit(1.0)).alias("scale"))
    named = lambda found: found.join(sizes, found[key] == sizes["_key"]).drop("_key")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    found = kept(named(keypoints.detected(images.join(wanted, images[key] == wanted["_key"], "left_semi"), key, scale, interest)), "detections")
    asked = pairs.select("a", "b").distinct().withColumn("pair", F.to_json(F.struct("a", "b")))
    first = _judged(found, found, asked, key).withColumn("reflected", F.lit(False))
    if not reflection:
        return first.drop("pair")
    first = kept(first, "compared")
    refused = first.where((F.col("reason") != "none") & (F.col("keypoints_a") >= LEAST_KEYPOINTS)).select("a", "b", "pair")
    turned = images.join(refused.select(F.col("b").alias("_key")).distinct(), images[key] == F.col("_key"), "left_semi")
    again = _judged(found, kept(named(mirrored(turned, key, scale, interest)), "mirrored"), refused, key).where("reason = 'none'").withColumn("reflected", F.lit(True))
    again = kept(again, "reflected")
    return first.join(again.select("pair"), "pair", "left_anti").unionByName(again).drop("pair")
