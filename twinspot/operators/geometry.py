"""Measurements of point sets and least-squares affine maps as grouped aggregates, and the ordered gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons for refusal in the order in which they are tried.
GATES = ("too_few_matches", "no_model", "too_few_inliers", "too_few_distinct", "low_inlier_ratio", "low_spread", "collinear", "high_reproj_error", "ill_conditioned")


def measures(points: DataFrame, key: str, diagonal: float) -> DataFrame:
    """n, distinct points on the half-pixel grid, spread, and the ratio of the cloud's two axes, for each key."""
    grid = F.struct(F.rint(F.col("x") * 2), F.rint(F.col("y") * 2))
    own = points.groupBy(key).agg(
        F.count("*").alias("n"),
        F.countDistinct(grid).alias("distinct_points"),
        (F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / F.lit(diagonal)).alias("spread"),
        F.var_pop("x").alias("_xx"),
        F.var_pop("y").alias("_yy"),
        F.covar_pop("x", "y").alias("_xy"),
    )
    trace, det = F.col("_xx") + F.col("_yy"), F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    root = F.sqrt(F.greatest(F.lit(0.0), trace * trace - 4 * det))
    axes = F.when(trace + root > 0, F.sqrt(F.greatest(F.lit(0.0), trace - root) / (trace + root))).otherwise(0.0)
    out = own.withColumn("axis_ratio", F.when(F.col("n") < 3, 0.0).otherwise(axes))
    return out.select(key, "n", "distinct_points", F.when(F.col("n") < 2, 0.0).otherwise(F.col("spread")).alias("spread"), "axis_ratio")


def affine(points: DataFrame, key: str) -> DataFrame:
    """a, b, c, d, tx, ty of the least-squares map (x, y) to (u, v) for each key, by normal equations.

    u = a x + b y + tx and v = c x + d y + ty. Keys whose points are on a line have no row.
    """
    own = points.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
        F.covar_pop("x", "u").alias("xu"), F.covar_pop("y", "u").alias("yu"), F.covar_pop("x", "v").alias("xv"), F.covar_pop("y", "v").alias("yv"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    own = own.withColumn("det", det).where(F.col("det") > 1e-9)
    solve = lambda p, q: ((F.col(p) * F.col("yy") - F.col(q) * F.col("xy")) / F.col("det"), (F.col(q) * F.col("xx") - F.col(p) * F.col("xy")) / F.col("det"))
    a, b = solve("xu", "yu")
    c, d = solve("xv", "yv")
    out = own.select(key, "n", "mx", "my", "mu", "mv", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return out.select(
        key, "n", "a", "b", "c", "d",
        (F.col("mu") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("tx"),
        (F.col("mv") - F.col("c") * F.col("mx") - F.col("d") * F.col("my")).alias("ty"),
    )


def decomposed(maps: DataFrame) -> DataFrame:
    """rotation_deg, scale_x, scale_y, shear_deg, flip, anisotropic, sheared of each map's columns (a, c) and (b, d)."""
    sx = F.hypot("a", "c")
    det = F.col("a") * F.col("d") - F.col("b") * F.col("c")
    flat = F.col("_sx") < 1e-12
    out = maps.withColumn("_sx", sx).withColumn("_det", det)
    zero = lambda x: F.when(flat, 0.0).otherwise(x)
    out = out.withColumn("rotation_deg", zero(F.degrees(F.atan2("c", "a")))).withColumn("scale_x", zero(F.col("_sx")))
    out = out.withColumn("scale_y", zero(F.abs("_det") / F.col("_sx")))
    out = out.withColumn("shear_deg", zero(F.degrees(F.atan2((F.col("a") * F.col("b") + F.col("c") * F.col("d")) / F.col("_sx"), F.col("scale_y")))))
    even = F.when(F.col("scale_y") > 0, F.abs(F.col("scale_x") / F.col("scale_y") - 1) > 0.05).otherwise(F.lit(False))
    return out.withColumn("flip", F.col("_det") < 0).withColumn("anisotropic", even).withColumn("sheared", F.abs("shear_deg") > 2.0).drop("_sx", "_det")


def residual(points: DataFrame, maps: DataFrame, key: str) -> DataFrame:
    """Root mean square of the maps' errors on their points."""
    joined = points.join(maps, key)
    du = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("tx") - F.col("u")
    dv = F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("ty") - F.col("v")
    return joined.groupBy(key).agg(F.sqrt(F.avg(du * du + dv * dv)).alias("rms"))


def condition(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Ratio of the larger to the smaller singular value of a map's linear part; infinite where it is singular."""
    total, det = a * a + b * b + c * c + d * d, a * d - b * c
    root = F.sqrt(F.greatest(F.lit(0.0), total * total - 4 * det * det))
    low = total - root
    return F.when(low > 0, F.sqrt((total + root) / low)).otherwise(F.lit(float("inf")))


def gated(matches: Column, inliers: Column, distinct: Column, spread: Column, axis_ratio: Column, rms: Column, condition: Column) -> Column:
    """The first gate that refuses, or none. Without a map, rms and condition are null, and the second gate refuses."""
    share = F.when(matches > 0, inliers.cast("double") / matches).otherwise(0.0)
    tests = (matches < 8, rms.isNull(), inliers < 15, distinct < 12, share < 0.18, spread < 0.10, axis_ratio < 0.02, rms > 5.0, condition.isNull() | (condition > 1e3))
    out = F.when(tests[0], GATES[0])
    for test, name in zip(tests[1:], GATES[1:], strict=True):
        out = out.when(test, name)
    return out.otherwise("none")


def letterbox(width: Column, height: Column, size: int) -> list[Column]:
    """scale, content_w, content_h, pad_x, pad_y of an image fitted into a square canvas."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    fit = lambda x: F.least(F.lit(size), F.greatest(F.lit(1), F.rint(x * scale).cast("int")))
    w, h = fit(width), fit(height)
    return [scale.alias("scale"), w.alias("content_w"), h.alias("content_h"), F.floor((F.lit(size) - w) / 2).cast("int").alias("pad_x"), F.floor((F.lit(size) - h) / 2).cast("int").alias("pad_y")]
