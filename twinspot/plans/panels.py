"""Queries over embedded panels: screening, perceptual hashes and descriptor matching.

An embedding has 64 values and serves as an 8 x 8 panel, as a descriptor, and, by its first two values, as a point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import fusion, matching, screening
from ..sources import table

THRESHOLD, TRIGGER, TEMPERATURE, HAMMING = 8.0, 9.0, 2.0, 16


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def screen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs; those that do not trigger the local stage stay and say so."""
    found = screening.screened(_vectors(spark, sf_dir), THRESHOLD, TRIGGER, TEMPERATURE)
    return found.select("vec_a", "vec_b", F.round("distance", 4).alias("distance"), F.round("similarity", 4).alias("similarity"), "is_match", "triggered_local")


def _fused(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    found = screening.screened(_vectors(spark, sf_dir), threshold, TRIGGER, TEMPERATURE, TRIGGER).where("triggered_local")
    found = found.withColumn("f_embedding_similarity", X.clip(F.col("similarity") - 0.5, -0.5, 0.5))
    out = fusion.scored(found, {"embedding_similarity": fusion.PAIR_WEIGHTS["embedding_similarity"]}, fusion.PAIR_PRIOR)
    return out.select("vec_a", "vec_b", F.round("logit", 4).alias("logit"), F.round("confidence", 4).alias("confidence"), "verdict")


def screen_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, THRESHOLD)


def rescore_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 8.5)


def embedding_hash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.hashes(_vectors(spark, sf_dir)).select("vec_id", "bits", F.bit_count(F.element_at("turns", 1)).cast("int").alias("ones"))


def hash_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.hashes(_vectors(spark, sf_dir)).select("vec_id", "canonical")


def hash_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = screening.hashes(_vectors(spark, sf_dir))
    return screening.probed(index, index.where("vec_id % 50 = 0"), 10).select("needle", "vec_id", F.col("hamming").cast("int").alias("hamming"), "rank")


def dihedral_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.prefiltered(_vectors(spark, sf_dir), HAMMING).withColumn("hamming", F.col("hamming").cast("int"))


def prefilter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    n = vectors.agg(F.count("*").alias("n"))
    kept = screening.prefiltered(vectors, HAMMING).agg(F.count("*").alias("kept"))
    total = F.col("n") * (F.col("n") - 1) / 2
    return n.crossJoin(kept).select(total.cast("long").alias("total"), "kept", F.round(X.ratio(F.col("kept"), total, F.lit(1.0)), 6).alias("coverage"))


def prefilter_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dihedral_prefilter(spark, sf_dir).orderBy("hamming", "vec_a", "vec_b").limit(20)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All rows on both sides: each one is matched against every other."""
    rows = _vectors(spark, sf_dir).select(F.col("vec_id").alias("kp"), F.col("embedding").alias("desc"))
    return rows, rows


def knn2_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest(*_sides(spark, sf_dir), 2).withColumn("dist", F.round("dist", 4))


def ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.ratio_passed(matching.nearest(*_sides(spark, sf_dir), 2), 0.95)
    return found.select("src", "dst", F.round("d1", 4).alias("d1"), F.round("d2", 4).alias("d2"))


def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mutual(*_sides(spark, sf_dir), 0.95).select("src", "dst", F.round("d1", 4).alias("dist"))


def match_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.funnel(*_sides(spark, sf_dir), 0.95)


def match_distinct_halfpixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    point = [F.rint(F.element_at("embedding", k).cast("double") * 8 * 2) for k in (1, 2)]
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct(F.struct(*point)).alias("distinct_points"))


def self_match_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = [(F.element_at("embedding", k).cast("double") * 100).alias(c) for k, c in ((1, "x"), (2, "y"))]
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("kp"), *point, F.col("embedding").alias("desc"))
    return matching.self_matches(rows, 6, 0.98, 8.0).withColumn("dist", F.round("dist", 4))


def offset_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.element_at("embedding", k).cast("double")
    points = _vectors(spark, sf_dir).select("vec_id", (at(1) * 100).alias("x"), (at(2) * 100).alias("y"), (F.abs(at(3)) + 1).alias("s"), (at(4) * 180).alias("t"))
    found = matching.offsets(matching.offset_pairs(points, "vec_id"), 512.0, (1.0, 1.0, 0.5, 0.5))
    return found.select("src", "dst", "swapped", *[(F.round(f"f{k}", 6) + F.lit(0.0)).alias(f"f{k}") for k in range(5)])


def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the mean of ln s(1 - same) + ln(1 - s(1 - other)) over the triplets of all anchors, and the accuracy at 0.5."""
    near = lambda c: 1 - X.l1_distance(F.col("anchor_embedding"), F.col(c))
    found = matching.triplets(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).select(near("same").alias("p"), near("other").alias("q"))
    log_s = lambda x: F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    right = (F.col("p") >= 0).cast("int") + (F.col("q") < 0).cast("int")
    return found.agg(F.count("*").alias("triplets"), F.round(-F.avg(log_s(F.col("p")) + log_s(-F.col("q"))), 5).alias("loss"), F.round(F.avg(right / 2), 6).alias("accuracy"))


QUERIES = {
    f.__name__: f
    for f in (
        screen_pairs, screen_fused, rescore_threshold, embedding_hash64, hash_index_build, hash_index_query, dihedral_prefilter, prefilter_coverage,
        prefilter_truncate, knn2_match, ratio_test, mutual_nn, match_funnel, match_distinct_halfpixel, self_match_dedup, offset_features, triplet_loss,
    )
}

_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))"
_L2 = "sqrt(list_sum(list_transform(range(1, 65), lambda i: power({a}[i]::DOUBLE - {b}[i]::DOUBLE, 2))))"
_PAIRS = f"SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, {_L1} AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


def _fused_sql(threshold: float) -> str:
    return f"""
WITH p AS ({_PAIRS}), s AS (SELECT vec_a, vec_b, 1 / (1 + exp(-({threshold} - d) / {TEMPERATURE})) AS sim FROM p WHERE d < {TRIGGER}),
l AS (SELECT vec_a, vec_b, -2.0 + 3.0 * (sim - 0.5) AS logit FROM s), c AS (SELECT *, 1 / (1 + exp(-logit)) AS confidence FROM l)
SELECT vec_a, vec_b, round(logit, 4) AS logit, round(confidence, 4) AS confidence,
 CASE WHEN confidence >= 0.85 THEN 'likely_manipulated' WHEN confidence >= 0.6 THEN 'suspicious' WHEN confidence >= 0.35 THEN 'inconclusive' ELSE 'clean' END AS verdict FROM c"""


def _turn_sql(bits: str) -> str:
    turns = [" || ".join(f"{bits}[{p + 1}]" for p in places) for places in X.orientations()]
    return "[" + ", ".join(turns) + "]"


_HASHES = f"""h0 AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
h1 AS (SELECT vec_id, v, list_sort(v) AS o FROM h0),
h2 AS (SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > (o[32] + o[33]) / 2 THEN '1' ELSE '0' END), '') AS bits FROM h1),
h AS (SELECT vec_id, bits, {_turn_sql("bits")} AS turns FROM h2)"""
_NEAR = f"""WITH {_HASHES}, p AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, list_min(list_transform(b.turns, lambda t: hamming(a.bits, t))) AS hamming FROM h a JOIN h b ON a.vec_id < b.vec_id),
k AS (SELECT vec_a, vec_b, hamming::INT AS hamming FROM p WHERE hamming <= {HAMMING})"""
_KNN = f"""WITH r AS (SELECT vec_id AS kp, embedding AS e FROM embeddings), l AS (SELECT * FROM r),
d AS (SELECT l.kp AS src, r.kp AS dst, {_L2.format(a="l.e", b="r.e")} AS dist FROM l JOIN r ON l.kp <> r.kp),
k AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d),
f AS (SELECT src, max(CASE WHEN rank = 1 THEN dst END) AS dst, max(CASE WHEN rank = 1 THEN dist END) AS d1, max(CASE WHEN rank = 2 THEN dist END) AS d2 FROM k WHERE rank <= 2 GROUP BY src),
p AS (SELECT * FROM f WHERE d2 IS NULL OR (d2 > 0 AND d1 < 0.95 * d2)),
b AS (SELECT dst, src FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY dist, src) AS rank FROM d) WHERE rank = 1),
g AS (SELECT p.* FROM p JOIN b USING (src, dst))"""

ORACLE_SQL = {
    "screen_pairs": f"""WITH p AS ({_PAIRS}) SELECT vec_a, vec_b, round(d, 4) AS distance, round(1 / (1 + exp(-({THRESHOLD} - d) / {TEMPERATURE})), 4) AS similarity,
 d < {THRESHOLD} AS is_match, d < {TRIGGER} AS triggered_local FROM p""",
    "screen_fused": _fused_sql(THRESHOLD),
    "rescore_threshold": _fused_sql(8.5),
    "embedding_hash64": f"WITH {_HASHES} SELECT vec_id, bits, length(replace(bits, '0', ''))::INT AS ones FROM h",
    "hash_index_build": f"WITH {_HASHES} SELECT vec_id, list_min(turns) AS canonical FROM h",
    "hash_index_query": f"""WITH {_HASHES}, p AS (SELECT n.vec_id AS needle, h.vec_id, list_min(list_transform(h.turns, lambda t: hamming(n.bits, t)))::INT AS hamming
 FROM h JOIN h n ON n.vec_id % 50 = 0 AND n.vec_id <> h.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY hamming, vec_id)::INT AS rank FROM p) SELECT * FROM r WHERE rank <= 10""",
    "dihedral_prefilter": f"{_NEAR} SELECT * FROM k",
    "prefilter_coverage": f"""{_NEAR}, n AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT count(*) AS kept FROM k)
 SELECT (n * (n - 1) // 2)::BIGINT AS total, kept, round(kept / (n * (n - 1) / 2), 6) AS coverage FROM n, c""",
    "prefilter_truncate": f"{_NEAR} SELECT * FROM k ORDER BY hamming, vec_a, vec_b LIMIT 20",
    "knn2_match": f"{_KNN} SELECT src, dst, round(dist, 4) AS dist, rank::INT AS rank FROM k WHERE rank <= 2",
    "ratio_test": f"{_KNN} SELECT src, dst, round(d1, 4) AS d1, round(d2, 4) AS d2 FROM p",
    "mutual_nn": f"{_KNN} SELECT src, dst, round(d1, 4) AS dist FROM g",
    "match_funnel": f"""{_KNN} SELECT (SELECT count(DISTINCT src) FROM k) AS raw, (SELECT count(*) FROM p) AS ratio_passed,
 (SELECT count(*) FROM g) AS good, (SELECT count(DISTINCT src) FROM g) AS distinct_left, (SELECT count(DISTINCT dst) FROM g) AS distinct_right""",
    "match_distinct_halfpixel": """SELECT label, count(*) AS n, count(DISTINCT (round_even(embedding[1]::DOUBLE * 16, 0), round_even(embedding[2]::DOUBLE * 16, 0))) AS distinct_points
 FROM embeddings GROUP BY label""",
    "self_match_dedup": f"""WITH p AS (SELECT label AS image, vec_id AS kp, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding AS e FROM embeddings),
d AS (SELECT a.image, a.kp AS src, b.kp AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS s, {_L2.format(a="a.e", b="b.e")} AS dist FROM p a JOIN p b ON a.image = b.image AND a.kp <> b.kp),
r AS (SELECT *, row_number() OVER w AS rank FROM d WINDOW w AS (PARTITION BY image, src ORDER BY dist, dst)),
q AS (SELECT *, CASE WHEN dist > 0 AND lag(dist) OVER w < 0.98 * dist THEN rank - 1 END AS gap FROM r WHERE rank <= 5 WINDOW w AS (PARTITION BY image, src ORDER BY dist, dst)),
t AS (SELECT *, min(gap) OVER (PARTITION BY image, src) AS take FROM q)
SELECT image, least(src, dst) AS src, greatest(src, dst) AS dst, round(min(dist), 4) AS dist FROM t WHERE rank <= take AND s >= 64 GROUP BY ALL""",
    "offset_features": """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, abs(embedding[3]::DOUBLE) + 1 AS s, embedding[4]::DOUBLE * 180 AS t FROM embeddings),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, b.x - a.x AS dx, b.y - a.y AS dy, ln(b.s / a.s) AS ls, CASE WHEN a.t >= 0 AND b.t >= 0 THEN radians(b.t - a.t) ELSE 0 END AS turn FROM e a JOIN e b ON a.vec_id < b.vec_id),
s AS (SELECT *, dx < 0 OR (dx = 0 AND dy < 0) AS swapped FROM d), g AS (SELECT *, CASE WHEN swapped THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM s)
SELECT src, dst, swapped, round(sign * dx / 512, 6) + 0.0 AS f0, round(sign * dy / 512, 6) + 0.0 AS f1, round(0.5::DOUBLE * sign * ls, 6) + 0.0 AS f2,
 round(0.5::DOUBLE * cos(turn * sign), 6) + 0.0 AS f3, round(0.5::DOUBLE * sin(turn * sign), 6) + 0.0 AS f4 FROM g""",
    "triplet_loss": """WITH k AS (SELECT vec_id, label, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS k FROM embeddings),
z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), ring AS (SELECT label, n, coalesce(lead(label) OVER (ORDER BY label), (SELECT min(label) FROM z)) AS nxt FROM z),
w AS (SELECT a.e AS a, s.e AS s, o.e AS o FROM k a JOIN ring r ON r.label = a.label AND r.nxt <> r.label AND r.n > 1 JOIN z m ON m.label = r.nxt JOIN k s ON s.label = a.label AND s.k = (a.k + 1) % r.n
 JOIN k o ON o.label = r.nxt AND o.k = a.k % m.n),
d AS (SELECT 1 - list_sum(list_transform(range(1, 65), lambda i: abs(a[i]::DOUBLE - s[i]::DOUBLE))) AS p, 1 - list_sum(list_transform(range(1, 65), lambda i: abs(a[i]::DOUBLE - o[i]::DOUBLE))) AS q FROM w)
SELECT count(*) AS triplets, round(-avg(least(p, 0) - ln(1 + exp(-abs(p))) + least(-q, 0) - ln(1 + exp(-abs(q)))), 5) AS loss, round(avg(((p >= 0)::INT + (q < 0)::INT) / 2), 6) AS accuracy FROM d""",
}
