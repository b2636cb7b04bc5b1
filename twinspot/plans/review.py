"""Queries of the review operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import blocks, fusion, geometry, review, screening
from ..sources import table
from .evidence import _AFFINE, _BAND, _PAIR, _PART, _ROW, _pair_rows, _points, _rounded, _sizes
from .panels import _L1


def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pairs with their place by confidence, from 1 on."""
    rows = fusion.scored(fusion.pair_features(_pair_rows(spark, sf_dir)), fusion.PAIR_WEIGHTS, fusion.PAIR_PRIOR)
    named = rows.withColumn("left", F.concat(F.lit("p"), "l_partkey", F.when(F.col("l_partkey") % 5 == 0, "_unsplit").otherwise(""))).withColumn("right", F.concat(F.lit("s"), "l_suppkey"))
    found = review.findings(named.withColumn("verdict", X.band(F.round("confidence", 9))), "left", "right").where("flagged")
    return review.placed(found.withColumn("_sure", -F.round("confidence", 9)), ["_sure", "l_orderkey", "l_linenumber"]).select(*_ROW, F.round("confidence", 5).alias("confidence"), "verdict", "trustworthy", "place")


def pair_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.pair_features(_pair_rows(spark, sf_dir))
    return rows.select(*_ROW, F.array_join(review.notes(rows), ",").alias("notes"))


def affine_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = geometry.decomposed(geometry.affine(_points(spark, sf_dir), "pair"))
    return review.composed(maps.drop("a", "b", "c", "d")).select("pair", *[_rounded(F.col(c), 4).alias(c) for c in "abcd"])


def squash_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = review.squash(F.col("w"), F.col("h"), 128)
    return _sizes(spark, sf_dir).select("p_partkey", *own).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("scale_x", "scale_y", "aspect")])


def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").alias("inlier"), (F.col("l_orderkey") * 1_000_003 + F.col("l_partkey") * 11 + F.col("l_linenumber")).alias("place"))
    return review.thinned(rows, "l_suppkey", "inlier", "place", 40).groupBy("l_suppkey", "inlier").agg(F.count("*").alias("n"), F.max("place").alias("last"))


def keypoint_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("double").alias("response"))
    return review.ranked(rows, "p_brand", "response", "p_partkey", 920.0, 12).select("p_brand", "p_partkey", "rank")


def roi_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_type", "p_partkey", (F.col("p_size") * (F.col("p_partkey") % 13 + 1)).alias("area"))
    return review.ranked(rows, "p_type", "area", "p_partkey", 16, 64).select("p_type", "p_partkey", "area", "rank")


def roi_abandonment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") > 40).alias("inside"))
    return review.restricted(rows, "l_suppkey", "inside", 100)


def displacement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") - 25).cast("double").alias("dx"), (F.col("l_tax") * 100 - 4).cast("double").alias("dy"))
    return review.displaced(rows, "l_suppkey", 1.5).withColumn("shift", F.round("shift", 6))


def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).select("pair", "x", "y")
    return review.hulls(rows, "pair").select("pair", "corners", F.round("area", 4).alias("area"), F.round(F.least(F.lit(1.0), F.col("area") / (0.48 * 120.0 * 120.0)), 6).alias("matched_area"))


def frequency_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.frequency_hash(table(spark, sf_dir, "embeddings"))


def legacy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prototype's view of neighbours in the pairs' list: distances scaled down to its range."""
    rows = screening.distances(table(spark, sf_dir, "embeddings")).select("vec_a", "vec_b", (F.col("distance") / 8).alias("d"))
    similarity, *rest = review.legacy_decision(F.col("d"), (F.col("vec_a") + F.col("vec_b")) % 3 == 0)
    return rows.select("vec_a", "vec_b", F.round(similarity, 6).alias("similarity"), *rest)


def legacy_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy at a distance of 1, false negatives and false positives of pairs by label."""
    each = blocks.tallied(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 8.0)
    zero = F.lit(0).cast("bigint")
    sums = each.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in each.columns])
    wrong = sums.select("pairs", (F.col("alike") - F.col("near_alike")).alias("fn"), F.col("near_other").alias("fp"))
    return wrong.withColumn("accuracy", F.round(1 - (F.col("fn") + F.col("fp")) / F.nullif("pairs", zero), 6))


def full_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's funnel, with zeros where nothing passed."""
    passed = table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("good"))
    raw = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("raw"))
    own = table(spark, sf_dir, "supplier").select("s_suppkey").join(raw, "s_suppkey", "left").join(passed, "s_suppkey", "left")
    return own.select("s_suppkey", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))


def epoch_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and accuracy of each epoch (a day of events), weighted by the batches' sizes."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "value", (F.col("user_id") % 7 + 1).alias("size"), (F.col("event_type") == "click").alias("hit"))
    return rows.groupBy("epoch").agg(F.round(F.sum(F.col("value") * F.col("size")) / F.sum("size"), 5).alias("loss"), F.round(F.sum(F.col("hit").cast("int") * F.col("size")) / F.sum("size"), 6).alias("accuracy"))


def evidential_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's documents that are whole evidence: no copy under another id."""
    rows = table(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "doc_id")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "digest").groupBy("source").agg(F.count("*").alias("figures"), F.round(F.avg((F.col("doc_id") == F.col("first")).cast("int")), 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        ranked_findings, pair_notes, affine_compose, squash_geometry, match_lines, keypoint_budget, roi_boxes, roi_abandonment, displacement_gate, hull_area,
        frequency_hash, legacy_decisions, legacy_errors, full_funnel, epoch_averages, evidential_share,
    )
}

_COLUMNS = ", ".join(_ROW)
_COEFFICIENT = "list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * 4 * cos(pi() * r * (2 * (i // 8) + 1) / 16) * cos(pi() * c * (2 * (i % 8) + 1) / 16)))"
ORACLE_SQL = {
    "ranked_findings": f"""WITH {_PAIR}, v AS (SELECT *, {_BAND.format(c='round(confidence, 9)')} AS verdict FROM r)
SELECT {_COLUMNS}, round(confidence, 5) AS confidence, verdict, l_partkey % 5 <> 0 AS trustworthy, row_number() OVER (ORDER BY round(confidence, 9) DESC, l_orderkey, l_linenumber) AS place FROM v WHERE verdict IN ('likely_manipulated', 'suspicious')""",
    "pair_notes": f"""WITH {_PAIR} SELECT {_COLUMNS}, concat_ws(',', CASE WHEN f_geometry_refuted > 0 AND f_embedding_similarity > 0 THEN 'contradicted_by_geometry' END,
 CASE WHEN f_geometry_abstained > 0 THEN CASE WHEN f_embedding_similarity > 0 THEN 'embedding_alone' ELSE 'absence_of_evidence' END END,
 CASE WHEN f_geometry_verified > 0 AND f_embedding_similarity <= 0 THEN 'missed_by_embedding' END) AS notes FROM r""",
    "affine_compose": f"WITH {_AFFINE} SELECT pair, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in 'abcd')} FROM f",
    "squash_geometry": f"WITH {_PART} SELECT p_partkey, round(128.0::DOUBLE / w, 6) AS scale_x, round(128.0::DOUBLE / h, 6) AS scale_y, round(w::DOUBLE / h, 6) AS aspect FROM s",
    "match_lines": """WITH m AS (SELECT l_suppkey, l_returnflag = 'R' AS inlier, l_orderkey * 1000003 + l_partkey * 11 + l_linenumber AS place FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, inlier ORDER BY place) AS k, least(20, count(*) FILTER (NOT inlier) OVER (PARTITION BY l_suppkey)) AS out FROM m)
SELECT l_suppkey, inlier, count(*) AS n, max(place) AS last FROM k WHERE k <= CASE WHEN inlier THEN 40 - out ELSE 20 END GROUP BY ALL""",
    "keypoint_budget": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part WHERE p_retailprice >= 920 QUALIFY rank <= 12",
    "roi_boxes": """SELECT p_type, p_partkey, p_size * (p_partkey % 13 + 1) AS area, row_number() OVER (PARTITION BY p_type ORDER BY p_size * (p_partkey % 13 + 1) DESC, p_partkey)::INT AS rank
 FROM part WHERE p_size * (p_partkey % 13 + 1) >= 16 QUALIFY rank <= 64""",
    "roi_abandonment": """WITH c AS (SELECT l_suppkey, count(*) AS detected, count(*) FILTER (l_quantity > 40) AS in_region FROM lineitem GROUP BY l_suppkey)
SELECT *, in_region < 100 AS abandoned, CASE WHEN in_region < 100 THEN detected ELSE in_region END AS used FROM c""",
    "displacement_gate": """WITH c AS (SELECT l_suppkey, count(*) AS n, sqrt(power(median((l_quantity - 25)::DOUBLE), 2) + power(median((l_tax * 100 - 4)::DOUBLE), 2)) AS shift FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, n, round(shift, 6) AS shift, shift >= 1.5 AS separate FROM c""",
    "frequency_hash": f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), g AS (SELECT vec_id, v, k, k // 8 AS r, k % 8 AS c FROM p, range(0, 64) t(k)),
f AS (SELECT vec_id, k, {_COEFFICIENT} AS x FROM g), m AS (SELECT vec_id, median(x) AS m FROM f GROUP BY vec_id)
SELECT vec_id, string_agg(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM f JOIN m USING (vec_id) GROUP BY vec_id""",
    "legacy_decisions": f"""WITH d AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, {_L1} / 8 AS d, (a.vec_id + b.vec_id) % 3 = 0 AS ok FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT vec_a, vec_b, round(1 / (1 + exp(d - 1)), 6) AS similarity, d <= 1.1::DOUBLE AS suspicious, d <= 2 AS triggered,
 CASE WHEN d <= 1.1::DOUBLE AND ok THEN 'both' WHEN d <= 1.1::DOUBLE THEN 'embedding_only' WHEN ok THEN 'geometry_only' ELSE 'none' END AS decision FROM d""",
    "legacy_errors": f"""WITH d AS (SELECT a.label = b.label AS same, {_L1} / 8 AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
c AS (SELECT count(*) AS pairs, count(*) FILTER (same AND d > 1) AS fn, count(*) FILTER (NOT same AND d <= 1) AS fp FROM d) SELECT *, round(1 - (fn + fp) / pairs, 6) AS accuracy FROM c""",
    "full_funnel": "SELECT s_suppkey, count(l_suppkey) AS raw, count(*) FILTER (l_quantity > 45 AND l_returnflag = 'R') AS good FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey",
    "epoch_averages": """SELECT strftime(ts, '%Y-%m-%d') AS epoch, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 5) AS loss,
 round(sum((event_type = 'click')::INT * (user_id % 7 + 1))::DOUBLE / sum(user_id % 7 + 1), 6) AS accuracy FROM events GROUP BY 1""",
    "evidential_share": """WITH d AS (SELECT source, doc_id = min(doc_id) OVER (PARTITION BY text) AS own FROM documents) SELECT source, count(*) AS figures, round(avg(own::INT), 6) AS share FROM d GROUP BY source""",
}
