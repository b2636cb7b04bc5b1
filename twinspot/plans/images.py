"""Queries of the pixel kernels and robust fits over tables.

An embedding scaled to whole grey values is an 8 x 8 panel. A supplier's lines are matched points of a known affine map, which
lines with return flag R don't follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copymove, pixels, robust
from ..sources import table

#: The planted map of a supplier: its linear part, and what its number adds to the shifts.
A, B, C, D = 1.1, -0.2, 0.3, 0.9


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.rint(x.cast("double") * 256 + 128).cast("int")))
    hexes = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(gray(x)), 2, "0")), "")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(hexes).alias("gray"))


def _by_value(images: DataFrame) -> DataFrame:
    """vec_id, place, value of each pixel."""
    digits = F.hex("gray")
    rows = images.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("gray") - 1), lambda k: F.conv(F.substr(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("int"))).alias("place", "value"))
    return rows.select("vec_id", "place", "value")


def panel_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels made half as wide and high by area; values that end in a half go to the even neighbour."""
    return _by_value(pixels.mapped(_panels(spark, sf_dir), lambda image: pixels.resized(image, 4, 4)))


def panel_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of the gradient at each pixel, as a share of the panel's largest."""
    return _by_value(pixels.mapped(_panels(spark, sf_dir), pixels.sobel))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, s = F.col("l_quantity") * 8, F.col("l_extendedprice") / 200, F.col("l_suppkey") % 50
    off = F.when(F.col("l_returnflag") == "R", 40 + F.col("l_linenumber") * 13).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair"), x.alias("x"), y.alias("y"), (A * x + B * y + s + off).alias("u"), (C * x + D * y - s + off).alias("v")
    )


def robust_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.fitted(_matches(spark, sf_dir), "pair", "affine", 4.0)
    return found.select("pair", "inliers", *[(F.round(F.col(f"h{k}"), 4) + F.lit(0.0)).alias(n) for k, n in enumerate(("a", "b", "tx", "c", "d", "ty"))])


def robust_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _matches(spark, sf_dir)
    own = robust.measured(points, robust.fitted(points, "pair", "homography", 4.0), "pair", 4.0)
    return own.select("pair", "matches", "inliers", F.round("ratio", 6).alias("ratio"), (F.round("rms", 4) + F.lit(0.0)).alias("rms"))


def copied_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = copymove.regions(_matches(spark, sf_dir), "pair")
    return own.select("pair", "matches", "inliers", "distinct_from", "distinct_to", F.round("shift", 4).alias("shift"), F.round("rotation_deg", 3).alias("rotation_deg"), "flip", "reason")


QUERIES = {f.__name__: f for f in (panel_halves, panel_gradients, robust_affine, robust_measures, copied_regions)}

_GRAY = "p AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, round_even(x::DOUBLE * 256 + 128, 0)::INT))) AS v FROM embeddings)"
#: A row or column next to the panel's edge, mirrored.
_AT = "v[abs(7 - abs(7 - (r + {dr}))) * 8 + abs(7 - abs(7 - (c + {dc}))) + 1]"


def _sum(terms: list[tuple[int, int, int]]) -> str:
    return " + ".join(f"({w}) * {_AT.format(dr=dr, dc=dc)}" for w, dr, dc in terms)


_GX = _sum([(w * s, dr, s) for dr, w in ((-1, 1), (0, 2), (1, 1)) for s in (-1, 1)])
_GY = _sum([(w * s, s, dc) for dc, w in ((-1, 1), (0, 2), (1, 1)) for s in (-1, 1)])
_GOOD = "g AS (SELECT l_suppkey AS pair, l_suppkey % 50 AS s, count(*) AS matches, count(*) FILTER (l_returnflag <> 'R') AS inliers FROM lineitem GROUP BY l_suppkey)"
ORACLE_SQL = {
    "panel_halves": f"""WITH {_GRAY}, g AS (SELECT vec_id, k, (k // 4) * 16 + (k % 4) * 2 AS o, v FROM p, range(0, 16) t(k))
SELECT vec_id, k::INT AS place, round_even((v[o + 1] + v[o + 2] + v[o + 9] + v[o + 10]) / 4, 0)::INT AS value FROM g""",
    "panel_gradients": f"""WITH {_GRAY}, g AS (SELECT vec_id, k, k // 8 AS r, k % 8 AS c, v FROM p, range(0, 64) t(k)), e AS (SELECT vec_id, k, sqrt((power({_GX}, 2) + power({_GY}, 2))::DOUBLE) AS s FROM g),
m AS (SELECT vec_id, max(s) AS most FROM e GROUP BY vec_id) SELECT vec_id, k::INT AS place, CASE WHEN most > 0 THEN round_even(s * (255 / most), 0)::INT ELSE 0 END AS value FROM e JOIN m USING (vec_id)""",
    "robust_affine": f"WITH {_GOOD} SELECT pair, inliers, {A}::DOUBLE AS a, {B}::DOUBLE AS b, s::DOUBLE AS tx, {C}::DOUBLE AS c, {D}::DOUBLE AS d, -s::DOUBLE + 0.0 AS ty FROM g",
    "robust_measures": f"WITH {_GOOD} SELECT pair, matches, inliers, round(inliers / matches, 6) AS ratio, 0.0::DOUBLE AS rms FROM g",
    "copied_regions": f"""WITH m AS (SELECT l_suppkey AS pair, l_returnflag <> 'R' AS good, l_quantity * 8 AS x, l_extendedprice / 200 AS y, l_suppkey % 50 AS s FROM lineitem),
p AS (SELECT *, {A}::DOUBLE * x + {B}::DOUBLE * y + s AS u, {C}::DOUBLE * x + {D}::DOUBLE * y - s AS v FROM m),
g AS (SELECT pair, count(*) AS matches, count(*) FILTER (good) AS inliers, count(DISTINCT (round_even(x * 2, 0), round_even(y * 2, 0))) FILTER (good) AS distinct_from,
 count(DISTINCT (round_even(u * 2, 0), round_even(v * 2, 0))) FILTER (good) AS distinct_to, sqrt(power(median(u - x) FILTER (good), 2) + power(median(v - y) FILTER (good), 2)) AS shift FROM p GROUP BY pair)
SELECT pair, matches, inliers, distinct_from, distinct_to, round(shift, 4) AS shift, round(degrees(atan2({C}::DOUBLE, {A}::DOUBLE)), 3) AS rotation_deg, {A * D - B * C < 0} AS flip,
 CASE WHEN matches < 8 THEN 'too_few_matches' WHEN inliers < 8 THEN 'too_few_inliers' WHEN least(distinct_from, distinct_to) < 8 THEN 'too_few_distinct' WHEN shift < 32 THEN 'too_close' ELSE 'none' END AS reason FROM g""",
}
