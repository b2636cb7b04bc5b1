"""Queries over measured evidence: geometry, gates, fusion and calibration.

Lines of one supplier serve as its matched points: (quantity, price / 1000) maps to (price / 2000, 50 * discount + quantity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import clustering, fusion, geometry, review
from ..sources import table

DIAGONAL = 120.0


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_extendedprice") / 2000).alias("u"), (F.col("l_discount") * 50 + F.col("l_quantity")).alias("v"), "l_returnflag", "l_linestatus",
    )


def _rounded(x: Column, places: int) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def geometry_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.measures(_points(spark, sf_dir), "pair", DIAGONAL).select(
        "pair", "n", "distinct_points", F.round("spread", 6).alias("spread"), F.round("axis_ratio", 6).alias("axis_ratio")
    )


def affine_lsq_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = geometry.affine(_points(spark, sf_dir), "pair")
    return fitted.select("pair", "n", *[_rounded(F.col(c), 4).alias(c) for c in ("a", "b", "c", "d", "tx", "ty")])


def affine_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.decomposed(geometry.affine(_points(spark, sf_dir), "pair"))
    return out.select("pair", *[_rounded(F.col(c), 3).alias(c) for c in ("rotation_deg", "scale_x", "scale_y", "shear_deg")], "flip", "anisotropic", "sheared")


def reproj_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return geometry.residual(points, geometry.affine(points, "pair"), "pair").select("pair", F.round("rms", 4).alias("rms"))


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    counts = points.groupBy("pair").agg(F.count_if(F.col("l_returnflag") == "R").alias("inliers"))
    maps = geometry.affine(points, "pair")
    rms = geometry.residual(points, maps, "pair").join(maps.select("pair", geometry.condition(*map(F.col, "abcd")).alias("condition")), "pair")
    own = geometry.measures(points, "pair", DIAGONAL).join(counts, "pair").join(rms, "pair", "left")
    reason = geometry.gated(F.col("n"), F.col("inliers"), F.col("distinct_points"), F.col("spread"), F.col("axis_ratio"), F.round("rms", 6), F.col("condition"))
    return own.withColumn("reason", reason)


def gate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(spark, sf_dir).select("pair", "n", "inliers", "reason", (F.col("reason") == "none").alias("verified"))


def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("pairs"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 7).alias("w"), F.rint("p_retailprice").cast("int").alias("h"))


def letterbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale, *rest = geometry.letterbox(F.col("w"), F.col("h"), 256)
    return _sizes(spark, sf_dir).select("p_partkey", F.round(scale, 6).alias("scale"), *rest)


def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lit(0.75)
    near = lambda x: F.rint(x / s).cast("int")
    return _sizes(spark, sf_dir).select(
        "p_partkey", near(F.col("w") % 50).alias("x"), near(F.col("h") % 50).alias("y"), F.greatest(F.lit(1), near(F.col("w"))).alias("width"), F.greatest(F.lit(1), near(F.col("h"))).alias("height")
    )


def homography_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjugate each supplier's map by two image scales: linear terms by their ratio, shifts by the target's scale."""
    src, dst = 0.5, 0.8
    out = geometry.affine(_points(spark, sf_dir), "pair")
    linear = [_rounded(F.col(c) * (src / dst), 4).alias(c) for c in ("a", "b", "c", "d")]
    return out.select("pair", *linear, *[_rounded(F.col(c) / dst, 4).alias(c) for c in ("tx", "ty")])


def keypoint_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(F.element_at("embedding", 1) > 0.3).alias("n"))
    pairs = n.select(F.col("label").alias("left"), F.col("n").alias("l")).join(n.select(F.col("label").alias("right"), F.col("n").alias("r")), F.col("left") < F.col("right"))
    lo, hi = F.least("l", "r"), F.greatest("l", "r")
    return pairs.select("left", "right", (lo >= 2).alias("enough"), F.round(X.ratio(hi, lo, F.lit(float("inf"))), 4).alias("asymmetry"))


def roi_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_retailprice") / 40).alias("y"))
    boxes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bx"), (F.col("n_nationkey") % 7 * 5).alias("by"), F.lit(4).alias("width"), F.lit(6).alias("height"))
    return review.inside(points, boxes, 8.0).select("p_partkey", "x", F.round("y", 4).alias("y"))


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_discount") * 10).alias("similarity"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False).alias("verified"),
        (F.col("l_linestatus") == "O").alias("refuted"),
        F.col("l_quantity").cast("int").alias("distinct"),
        (F.col("l_quantity") / 50).alias("ratio"),
        (F.col("l_tax") * 50).alias("rms"),
        (F.col("l_extendedprice") / 100000).alias("area"),
        (F.col("l_partkey") % 4).cast("double").alias("odd"),
        (F.col("l_suppkey") % 9).alias("lo"),
        (F.col("l_suppkey") % 9 + F.col("l_partkey") % 60).alias("hi"),
        (F.col("l_partkey") % 3 > 0).alias("injective"),
    )


def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.scored(fusion.pair_features(_pair_rows(spark, sf_dir)), fusion.PAIR_WEIGHTS, fusion.PAIR_PRIOR)
    return out.select("l_orderkey", "l_linenumber", F.round("logit", 5).alias("logit"), F.round("confidence", 5).alias("confidence"), X.band(F.round("confidence", 9)).alias("verdict"))


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.pair_features(_pair_rows(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", *[_rounded(F.col(f"f_{k}") + 1e-9, 5).alias(k) for k in fusion.PAIR_WEIGHTS])


#: What tells the rows of lineitem apart.
_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def pair_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's terms with their rank and the width of their bars."""
    out = fusion.contributions(fusion.pair_features(_pair_rows(spark, sf_dir)), _ROW, fusion.PAIR_WEIGHTS, fusion.PAIR_PRIOR)
    return out.select(*_ROW, "name", _rounded(F.col("contribution") + 1e-9, 5).alias("contribution"), "rank", _rounded(F.col("bar") + 1e-9, 3).alias("bar"))


def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_score(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("pairs"))


def clone_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_quantity") > 45).alias("regions"), F.count_if(F.col("l_quantity") > 30).alias("clusters"), F.sum(F.col("l_linenumber")).alias("inliers"),
        (F.avg("l_discount") * 5).alias("area"), (F.avg("l_tax") * 50).alias("rms"),
    )
    out = fusion.scored(fusion.clone_features(rows), fusion.CLONE_WEIGHTS, fusion.CLONE_PRIOR)
    return out.select("l_suppkey", F.round("logit", 5).alias("logit"), F.round("confidence", 5).alias("confidence"), "verdict")


#: A fitted curve for the query: probability knots.
KNOTS = [(0.05, 0.01), (0.3, 0.2), (0.6, 0.55), (0.9, 0.97)]


def calibrated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.scored(fusion.pair_features(_pair_rows(spark, sf_dir)), fusion.PAIR_WEIGHTS, fusion.PAIR_PRIOR)
    return out.select("l_orderkey", "l_linenumber", F.round(fusion.isotonic(F.col("confidence"), KNOTS), 5).alias("probability"), F.lit(True).alias("calibrated"))


def dbscan_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    return clustering.dbscan(points, 0.7, 4)


def cluster_regions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    found = dbscan_offsets(spark, sf_dir).where("cluster >= 0").withColumnRenamed("id", "s_suppkey").join(table(spark, sf_dir, "supplier"), "s_suppkey")
    own = found.groupBy("cluster").agg(F.count("*").alias("inliers"), F.round(F.median(F.col("s_acctbal")), 4).alias("median_y"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("inliers").desc(), "cluster"))).where("rank <= 8")


QUERIES = {
    f.__name__: f
    for f in (
        geometry_measures, affine_lsq_fit, affine_decompose, reproj_rms, gate_chain, rejection_histogram, letterbox_geometry, box_rescale, homography_rescale,
        keypoint_asymmetry, roi_semi_join, pair_features, pair_score, pair_contributions, verdict_bands, clone_score, calibrated_score, dbscan_offsets, cluster_regions_topk,
    )
}

_POINTS = """p AS (SELECT l_suppkey AS pair, l_quantity AS x, l_extendedprice / 1000 AS y, l_extendedprice / 2000 AS u, l_discount * 50 + l_quantity AS v, l_returnflag FROM lineitem)"""
_MEASURES = f"""{_POINTS}, m0 AS (SELECT pair, count(*) AS n, count(DISTINCT (round_even(x * 2, 0), round_even(y * 2, 0))) AS distinct_points,
 sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) / {DIAGONAL} AS s, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY pair),
m1 AS (SELECT *, xx + yy AS t, sqrt(greatest(0, power(xx + yy, 2) - 4 * (xx * yy - xy * xy))) AS r FROM m0),
m AS (SELECT pair, n, distinct_points, CASE WHEN n < 2 THEN 0 ELSE s END AS spread, CASE WHEN n < 3 THEN 0 WHEN t + r > 0 THEN sqrt(greatest(0, t - r) / (t + r)) ELSE 0 END AS axis_ratio FROM m1)"""
_AFFINE = f"""{_POINTS}, g AS (SELECT pair, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy,
 covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM p GROUP BY pair),
f0 AS (SELECT *, xx * yy - xy * xy AS det FROM g WHERE xx * yy - xy * xy > 1e-9),
f1 AS (SELECT *, (xu * yy - yu * xy) / det AS a, (yu * xx - xu * xy) / det AS b, (xv * yy - yv * xy) / det AS c, (yv * xx - xv * xy) / det AS d FROM f0),
f AS (SELECT pair, n, a, b, c, d, mu - a * mx - b * my AS tx, mv - c * mx - d * my AS ty FROM f1)"""
_RMS = f"{_AFFINE}, e AS (SELECT pair, sqrt(avg(power(a * x + b * y + tx - u, 2) + power(c * x + d * y + ty - v, 2))) AS rms, any_value(CASE WHEN a * a + b * b + c * c + d * d > sqrt(greatest(0, power(a * a + b * b + c * c + d * d, 2) - 4 * power(a * d - b * c, 2))) THEN sqrt((a * a + b * b + c * c + d * d + sqrt(greatest(0, power(a * a + b * b + c * c + d * d, 2) - 4 * power(a * d - b * c, 2)))) / (a * a + b * b + c * c + d * d - sqrt(greatest(0, power(a * a + b * b + c * c + d * d, 2) - 4 * power(a * d - b * c, 2))))) ELSE 'inf'::DOUBLE END) AS cond FROM p JOIN f USING (pair) GROUP BY pair)"
_GATES = f"""{_RMS}, {_MEASURES[len(_POINTS) + 2 :]}, i AS (SELECT pair, count(*) FILTER (l_returnflag = 'R') AS inliers FROM p GROUP BY pair),
k AS (SELECT pair, m.n, inliers, CASE WHEN m.n < 8 THEN 'too_few_matches' WHEN rms IS NULL THEN 'no_model' WHEN inliers < 15 THEN 'too_few_inliers' WHEN distinct_points < 12 THEN 'too_few_distinct'
 WHEN inliers / m.n < 0.18 THEN 'low_inlier_ratio' WHEN spread < 0.10 THEN 'low_spread' WHEN axis_ratio < 0.02 THEN 'collinear' WHEN round(rms, 6) > 5.0 THEN 'high_reproj_error' WHEN cond IS NULL OR cond > 1e3 THEN 'ill_conditioned' ELSE 'none' END AS reason
 FROM m JOIN i USING (pair) LEFT JOIN e USING (pair))"""
_PART = "s AS (SELECT p_partkey, p_size * 40 + 7 AS w, round_even(p_retailprice, 0)::INT AS h FROM part)"
_F = {
    "embedding_similarity": "least(0.5, greatest(-0.5, similarity - 0.5))",
    "geometry_verified": "on_::INT::DOUBLE",
    "inlier_strength": "CASE WHEN on_ THEN least(1, ln(1 + dist::DOUBLE) / ln(101.0::DOUBLE)) ELSE 0 END",
    "inlier_ratio": "CASE WHEN on_ THEN least(1, greatest(0, ratio)) ELSE 0 END",
    "reproj_tightness": "CASE WHEN on_ THEN least(1, greatest(0, 1 - rms / 5.0)) ELSE 0 END",
    "matched_area": "CASE WHEN on_ THEN least(1, greatest(0, area)) ELSE 0 END",
    "transform_manipulated": "CASE WHEN on_ THEN odd / 3.0 ELSE 0 END",
    "geometry_refuted": "(verified IS NOT NULL AND NOT on_ AND refuted)::INT::DOUBLE",
    "geometry_abstained": "(verified IS NOT NULL AND NOT on_ AND NOT refuted)::INT::DOUBLE",
    "keypoint_asymmetry": "CASE WHEN lo = 0 THEN 1 ELSE least(1, greatest(0, (log10(hi::DOUBLE / lo) - 0.3010299956639812) / (1.3010299956639813 - 0.3010299956639812))) END",
    "non_injective": "(NOT injective)::INT::DOUBLE",
}
_PAIR = f"""r0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount * 10 AS similarity, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS verified, l_linestatus = 'O' AS refuted,
 l_quantity::INT AS dist, l_quantity / 50 AS ratio, l_tax * 50 AS rms, l_extendedprice / 100000 AS area, (l_partkey % 4)::DOUBLE AS odd, l_suppkey % 9 AS lo, l_suppkey % 9 + l_partkey % 60 AS hi,
 l_partkey % 3 > 0 AS injective FROM lineitem), r1 AS (SELECT *, coalesce(verified, false) AS on_ FROM r0),
r2 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {", ".join(f"({v})::DOUBLE AS f_{k}" for k, v in _F.items())} FROM r1),
r3 AS (SELECT *, {fusion.PAIR_PRIOR} + {" + ".join(f"({w}) * f_{k}" for k, w in fusion.PAIR_WEIGHTS.items())} AS logit FROM r2), r AS (SELECT *, 1 / (1 + exp(-logit::DOUBLE)) AS confidence FROM r3)"""
_BAND = "CASE WHEN {c} >= 0.85 THEN 'likely_manipulated' WHEN {c} >= 0.6 THEN 'suspicious' WHEN {c} >= 0.35 THEN 'inconclusive' ELSE 'clean' END"

ORACLE_SQL = {
    "geometry_measures": f"WITH {_MEASURES} SELECT pair, n, distinct_points, round(spread, 6) AS spread, round(axis_ratio, 6) AS axis_ratio FROM m",
    "affine_lsq_fit": f"WITH {_AFFINE} SELECT pair, n, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("a", "b", "c", "d", "tx", "ty"))} FROM f",
    "affine_decompose": f"""WITH {_AFFINE}, s AS (SELECT pair, a, b, c, d, sqrt(a * a + c * c) AS sx, a * d - b * c AS det FROM f),
z AS (SELECT *, abs(det) / sx AS sy, degrees(atan2((a * b + c * d) / sx, abs(det) / sx)) AS sh FROM s)
SELECT pair, round(degrees(atan2(c, a)), 3) + 0.0 AS rotation_deg, round(sx, 3) + 0.0 AS scale_x, round(sy, 3) + 0.0 AS scale_y, round(sh, 3) + 0.0 AS shear_deg, det < 0 AS flip, abs(sx / sy - 1) > 0.05 AS anisotropic, abs(sh) > 2 AS sheared FROM z""",
    "reproj_rms": f"WITH {_RMS} SELECT pair, round(rms, 4) AS rms FROM e",
    "gate_chain": f"WITH {_GATES} SELECT pair, n, inliers, reason, reason = 'none' AS verified FROM k",
    "rejection_histogram": f"WITH {_GATES} SELECT reason, count(*) AS pairs FROM k GROUP BY reason",
    "letterbox_geometry": f"""WITH {_PART}, t AS (SELECT *, least(256.0::DOUBLE / w, 256.0::DOUBLE / h) AS scale FROM s),
c AS (SELECT p_partkey, scale, least(256, greatest(1, round_even(w * scale, 0)::INT)) AS cw, least(256, greatest(1, round_even(h * scale, 0)::INT)) AS ch FROM t)
SELECT p_partkey, round(scale, 6) AS scale, cw::INT AS content_w, ch::INT AS content_h, ((256 - cw) // 2)::INT AS pad_x, ((256 - ch) // 2)::INT AS pad_y FROM c""",
    "box_rescale": f"""WITH {_PART} SELECT p_partkey, round_even((w % 50) / 0.75::DOUBLE, 0)::INT AS x, round_even((h % 50) / 0.75::DOUBLE, 0)::INT AS y,
 greatest(1, round_even(w / 0.75::DOUBLE, 0)::INT)::INT AS width, greatest(1, round_even(h / 0.75::DOUBLE, 0)::INT)::INT AS height FROM s""",
    "homography_rescale": f"""WITH {_AFFINE} SELECT pair, {", ".join(f"round({c} * 0.625, 4) + 0.0 AS {c}" for c in "abcd")},
 round(tx / 0.8::DOUBLE, 4) + 0.0 AS tx, round(ty / 0.8::DOUBLE, 4) + 0.0 AS ty FROM f""",
    "keypoint_asymmetry": """WITH n AS (SELECT label, count(*) FILTER (embedding[1] > 0.3::DOUBLE) AS n FROM embeddings GROUP BY label)
SELECT a.label AS left, b.label AS right, least(a.n, b.n) >= 2 AS enough, round(CASE WHEN least(a.n, b.n) = 0 THEN 'inf'::DOUBLE ELSE greatest(a.n, b.n)::DOUBLE / least(a.n, b.n) END, 4) AS asymmetry
FROM n a JOIN n b ON a.label < b.label""",
    "roi_semi_join": """SELECT p_partkey, p_size AS x, round(p_retailprice / 40, 4) AS y FROM part WHERE EXISTS (SELECT 1 FROM nation WHERE p_size >= n_nationkey AND p_size < n_nationkey + 4
 AND p_retailprice / 40 >= n_nationkey % 7 * 5 AND p_retailprice / 40 < n_nationkey % 7 * 5 + 6)""",
    "pair_features": f"WITH {_PAIR} SELECT l_orderkey, l_linenumber, {', '.join(f'round(f_{k} + 1e-9::DOUBLE, 5) + 0.0 AS {k}' for k in _F)} FROM r",
    "pair_score": f"WITH {_PAIR} SELECT l_orderkey, l_linenumber, round(logit, 5) AS logit, round(confidence, 5) AS confidence, {_BAND.format(c='round(confidence, 9)')} AS verdict FROM r",
    "pair_contributions": f"""WITH {_PAIR}, t AS (SELECT {", ".join(_ROW)}, unnest([{{'name': 'prior', 'place': 0, 'contribution': {fusion.PAIR_PRIOR}::DOUBLE, 'used': true}},
 {", ".join(f"{{'name': '{k}', 'place': {i}, 'contribution': f_{k} * ({w})::DOUBLE, 'used': f_{k} <> 0}}" for i, (k, w) in enumerate(fusion.PAIR_WEIGHTS.items(), 1))}]) AS u FROM r),
o AS (SELECT {", ".join(_ROW)}, u.name AS name, u.place AS place, u.contribution AS contribution FROM t WHERE u.used)
SELECT {", ".join(_ROW)}, name, round(contribution + 1e-9::DOUBLE, 5) + 0.0 AS contribution, row_number() OVER (PARTITION BY {", ".join(_ROW)} ORDER BY name <> 'prior', round(abs(contribution), 9) DESC, place)::INT AS rank,
 round(least(50, abs(contribution) / max(abs(contribution)) OVER (PARTITION BY {", ".join(_ROW)}) * 50) + 1e-9::DOUBLE, 3) + 0.0 AS bar FROM o""",
    "verdict_bands": f"WITH {_PAIR} SELECT {_BAND.format(c='round(confidence, 9)')} AS verdict, count(*) AS pairs FROM r GROUP BY 1",
    "clone_score": f"""WITH g AS (SELECT l_suppkey, count(*) FILTER (l_quantity > 45) AS regions, count(*) FILTER (l_quantity > 30) AS clusters, sum(l_linenumber) AS inliers, avg(l_discount) * 5 AS area, avg(l_tax) * 50 AS rms
 FROM lineitem GROUP BY l_suppkey), f AS (SELECT l_suppkey, CASE WHEN regions > 0 THEN 3.2 + 1.2 * least(1, ln(1 + inliers::DOUBLE) / ln(101.0::DOUBLE)) + 0.8 * least(1, area) + 0.6 * least(1, greatest(0, 1 - rms / 5)) ELSE 0 END
 + 0.5 * CASE WHEN clusters > 0 THEN regions::DOUBLE / clusters ELSE 0 END - 2.5 AS logit FROM g), c AS (SELECT *, 1 / (1 + exp(-logit)) AS confidence FROM f)
SELECT l_suppkey, round(logit, 5) AS logit, round(confidence, 5) AS confidence, {_BAND.format(c="confidence")} AS verdict FROM c""",
    "calibrated_score": f"""WITH {_PAIR} SELECT l_orderkey, l_linenumber, round(CASE WHEN confidence <= 0.05 THEN 0.01 WHEN confidence <= 0.3 THEN 0.01 + (confidence - 0.05) / 0.25 * 0.19
 WHEN confidence <= 0.6 THEN 0.2 + (confidence - 0.3) / 0.3 * 0.35 WHEN confidence <= 0.9 THEN 0.55 + (confidence - 0.6) / 0.3 * 0.42 ELSE 0.97 END, 5) AS probability, true AS calibrated FROM r""",
}
_DBSCAN = """WITH RECURSIVE pt AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS x, s_acctbal / 1000 AS y FROM supplier),
nb AS (SELECT a.id, b.id AS other FROM pt a JOIN pt b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.7 * 0.7),
core AS (SELECT id FROM nb GROUP BY id HAVING count(*) >= 4), ed AS (SELECT id, other FROM nb WHERE id IN (FROM core) AND other IN (FROM core)),
reach AS (SELECT id, id AS r FROM core UNION SELECT ed.other, reach.r FROM reach JOIN ed ON ed.id = reach.id), lab AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id),
out AS (SELECT pt.id, coalesce(lab.cluster, (SELECT min(l.cluster) FROM nb JOIN lab l ON l.id = nb.other WHERE nb.id = pt.id), -1) AS cluster FROM pt LEFT JOIN lab ON lab.id = pt.id)"""
ORACLE_SQL["dbscan_offsets"] = f"{_DBSCAN} SELECT id, cluster FROM out"
ORACLE_SQL["cluster_regions_topk"] = f"""{_DBSCAN}, g AS (SELECT cluster, count(*) AS inliers, round(median(s_acctbal), 4) AS median_y FROM out JOIN supplier ON s_suppkey = id WHERE cluster >= 0 GROUP BY cluster)
SELECT *, row_number() OVER (ORDER BY inliers DESC, cluster)::INT AS rank FROM g QUALIFY rank <= 8"""
