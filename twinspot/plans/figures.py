"""Queries of figures, calibration, attribution, clusters over five axes and kept jobs, bound to the tables.

Sixty-four embeddings make a mosaic, a picture of 64 x 64 pixels, each an 8 x 8 tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import attribution, blocks, calibrate, clustering, compare, copymove, corpus, keypoints, review, scan, screening
from ..operators.shared import kept, spread
from ..sources import table

#: A calibrator for the query: what a fit could have given.
CALIBRATOR = calibrate.Calibrator(("length", "quality"), (1.25, -0.75), -0.5, ((0.1, 0.05), (0.4, 0.3), (0.7, 0.8)), "labels")
EPS, SAMPLES = 0.22, 4


def _mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, width, height, gray: whole mosaics, by vec_id."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("mosaic"), (F.col("vec_id") % 64).alias("tile"), "embedding")
    value = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.rint(x.cast("double") * 256 + 128).cast("int")))
    # a tile's row of eight pixels, at its place in the picture
    cells = rows.select("mosaic", "tile", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r"), "embedding")
    line = F.array_join(F.transform(F.slice("embedding", F.col("r") * 8 + 1, F.lit(8)), lambda x: F.lpad(F.hex(value(x)), 2, "0")), "")
    lines = cells.select("mosaic", ((F.floor(F.col("tile") / 8) * 8 + F.col("r")) * 8 + F.col("tile") % 8).alias("place"), line.alias("line"))
    made = lines.groupBy("mosaic").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "").alias("all")).where("n = 512")
    made = made.select(F.format_string("m%06d", "mosaic").alias("name"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.unhex("all").alias("gray"))
    return spread(made, "name", n=rows.count() // 64)


def mosaic_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keypoints each mosaic has, before and after its regions of interest."""
    found = keypoints.detected(_mosaics(spark, sf_dir), "name")
    return found.select("name", "detected", F.size("keypoints").alias("keypoints"), F.size("boxes").alias("boxes"), "abandoned", "reason")


def mosaic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mosaic against itself turned by a quarter and mirrored, and against the next one."""
    # pictures are read by many steps, each of which would make them again
    own = kept(_mosaics(spark, sf_dir), "mosaics")
    turned = kept(scan.pixels.mapped(own, lambda image: image.T).withColumn("name", F.concat("name", F.lit("_turned"))), "turned")
    number = F.substring("name", 2, 6).cast("int")
    pairs = own.select(F.col("name").alias("a"), F.explode(F.array(F.concat("name", F.lit("_turned")), F.format_string("m%06d", number + 1))).alias("b"))
    found = compare.compared(own.union(turned), pairs, "name")
    return found.select("a", "b", "keypoints_a", "keypoints_b", "after_ratio", "matches", "inliers", "reason", "explanation", F.round("rotation_deg", 2).alias("rotation_deg"), "flip", "reflected")


def mosaic_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies within each mosaic."""
    each, _ = copymove.copied(_mosaics(spark, sf_dir), "name")
    return each.select("name", "keypoints", "self_matches", "clusters", "detected", F.size("regions").alias("regions"))


def mosaic_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each mosaic's values before and after its enhancement; width, height, least and most are the enhanced picture's."""
    before = _mosaics(spark, sf_dir).withColumn("span", scan.pixels.span("gray"))
    before = before.select("name", "width", "height", "gray", F.col("span.least").alias("least_before"), F.col("span.most").alias("most_before"))
    made = scan.pixels.mapped(before, lambda image: keypoints.enhanced(image))
    return made.withColumn("span", scan.pixels.span("gray")).select("name", "width", "height", "span.least", "span.most", "least_before", "most_before")


def attribution_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as four channels of 4 x 4 activations, its reverse as their gradients."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("activations"), F.reverse("embedding").alias("gradients"))
    found = attribution.pooled(rows, 4)
    total = F.aggregate("grid", F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", F.round("zero_fraction", 6).alias("zero_fraction"), "degenerate", F.array_position("grid", F.array_max("grid")).cast("int").alias("peak"), F.round(total, 4).alias("total"))


def attribution_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an embedding's two halves, cut at zero, as maps: which side is mostly dead."""
    cut = lambda start: F.transform(F.slice("embedding", start, 32), lambda x: F.greatest(F.lit(0.0), x.cast("double") - 0.05))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cut(1).alias("l"), cut(33).alias("r"))
    zero = lambda c: F.size(F.filter(c, lambda x: x == 0)) / F.size(c)
    sides = rows.select("vec_id", zero("l").alias("left_zero"), zero("r").alias("right_zero"))
    return sides.select("vec_id", F.round("left_zero", 6).alias("left_zero"), F.round("right_zero", 6).alias("right_zero"), attribution.suppressed(F.col("left_zero"), F.col("right_zero")).alias("dead"))


def calibrated_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", (F.log1p("n_chars") / 10).alias("f_length"), F.col("quality").cast("double").alias("f_quality"))
    found = calibrate.predicted(rows, CALIBRATOR)
    return found.select("doc_id", F.round("logit", 5).alias("logit"), F.round("confidence", 5).alias("confidence"), X.band(F.round("confidence", 9)).alias("verdict"), "calibrated", "note")


def offset_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings' first five values within each label."""
    axes = tuple(f"f{k}" for k in range(5))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.element_at("embedding", k + 1).cast("double").alias(a) for k, a in enumerate(axes)])
    return clustering.dbscan(rows, EPS, SAMPLES, axes, ("label",))


def index_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the index up to a distance, for the rows with an id divisible by 50."""
    index = screening.hashes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return screening.probed(index, index.where("vec_id % 50 = 0"), 10, 20).select("needle", "vec_id", F.col("hamming").cast("int").alias("hamming"), "rank")


def nearest_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' nearest in one pass: rows with an id divisible by 50 against those of odd id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = blocks.nearest(rows.where("vec_id % 50 = 0"), rows.where("vec_id % 2 = 1"), "vec_id", "embedding", blocks.l1, "double", 3, back=1, apart=True)
    return found.select("side", "src", "dst", F.round("dist", 4).alias("dist"), "rank")


def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents under more than one path, with the other paths in order."""
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return corpus.duplicate_paths(corpus.digests(files, "path", "text")).select("digest", "path", F.array_join("others", ",").alias("others"))


def kept_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stores of users' jobs hold at the last event: an hour's worth, 64 at most; clicks count as running."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("store"), F.col("user_id").alias("job"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return corpus.kept_jobs(events, 3_600_000_000, 64, ("click",))


def manifest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split's paths in their order, with their place."""
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return corpus.placed_paths(corpus.manifest(corpus.digests(files, "path", "text"))).select("split", "path", "place")


def letterbox_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's point on the letterbox's canvas of 128, and back, and as a share of the picture."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 7 + 40).alias("w"), (F.col("p_partkey") % 300 + 50).alias("h"))
    rows = rows.withColumns({"x": F.col("w") * 0.25, "y": F.col("h") * 0.75})
    there = review.onto_canvas(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 128)
    out = rows.withColumns({"cx": there[0], "cy": there[1]})
    back = review.off_canvas(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), 128)
    return out.select("p_partkey", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round(back[0], 5).alias("x"), F.round(back[1], 5).alias("y"), F.round(F.col("x") / F.col("w"), 6).alias("u"), F.round(F.col("y") / F.col("h"), 6).alias("v"))


QUERIES = {
    f.__name__: f
    for f in (
        mosaic_keypoints, mosaic_pairs, mosaic_copies, mosaic_enhanced, attribution_pooled, attribution_suppressed, calibrated_linear, offset_clusters, index_gate, nearest_mirror,
        duplicate_paths, kept_jobs, manifest_paths, letterbox_points,
    )
}

_KNOTS = CALIBRATOR.knots


def _curve(x: str) -> str:
    steps = " ".join(f"WHEN {x} <= {x1} THEN {y0}::DOUBLE + ({x} - {x0}) / ({x1}::DOUBLE - {x0}) * ({y1}::DOUBLE - {y0})" for (x0, y0), (x1, y1) in zip(_KNOTS, _KNOTS[1:], strict=False))
    return f"CASE WHEN {x} <= {_KNOTS[0][0]} THEN {_KNOTS[0][1]}::DOUBLE {steps} ELSE {_KNOTS[-1][1]}::DOUBLE END"


_FILES = "f AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS digest FROM documents WHERE text IS NOT NULL)"
_FAR = " + ".join(f"power(a.e[{k}]::DOUBLE - b.e[{k}]::DOUBLE, 2)" for k in range(1, 6))
ORACLE_SQL = {
    "attribution_pooled": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS g FROM embeddings),
w AS (SELECT vec_id, a, list_transform(range(0, 4), lambda c: list_sum(list_transform(g[c * 16 + 1 : c * 16 + 16], lambda x: abs(x))) / 16) AS w FROM e),
r AS (SELECT vec_id, list_transform(range(1, 17), lambda i: w[1] * a[i] + w[2] * a[16 + i] + w[3] * a[32 + i] + w[4] * a[48 + i]) AS r FROM w),
n AS (SELECT vec_id, CASE WHEN list_max(r) > list_min(r) THEN list_transform(r, lambda x: (x - list_min(r)) / (list_max(r) - list_min(r))) ELSE list_transform(r, lambda x: 0.0::DOUBLE) END AS n FROM r)
SELECT vec_id, round(len(list_filter(n, lambda x: x = 0)) / 16, 6) AS zero_fraction, list_max(n) <= list_min(n) AS degenerate, list_position(n, list_max(n))::INT AS peak, round(list_sum(n), 4) AS total FROM n""",
    "attribution_suppressed": """WITH s AS (SELECT vec_id, len(list_filter(embedding[1:32], lambda x: greatest(0.0::DOUBLE, x::DOUBLE - 0.05::DOUBLE) = 0)) / 32 AS l,
 len(list_filter(embedding[33:64], lambda x: greatest(0.0::DOUBLE, x::DOUBLE - 0.05::DOUBLE) = 0)) / 32 AS r FROM embeddings)
SELECT vec_id, round(l, 6) AS left_zero, round(r, 6) AS right_zero, CASE WHEN r >= 0.2 AND r - l >= 0.15 THEN 'right' WHEN l >= 0.2 AND l - r >= 0.15 THEN 'left' END AS dead FROM s""",
    "calibrated_linear": f"""WITH l AS (SELECT doc_id, {CALIBRATOR.intercept}::DOUBLE + {CALIBRATOR.coef[0]}::DOUBLE * (ln(1 + n_chars) / 10) + {CALIBRATOR.coef[1]}::DOUBLE * quality AS logit FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, 1 / (1 + exp(-logit)) AS p FROM l), c AS (SELECT *, {_curve('p')} AS c FROM p)
SELECT doc_id, round(logit, 5) AS logit, round(c, 5) AS confidence, CASE WHEN round(c, 9) >= 0.85 THEN 'likely_manipulated' WHEN round(c, 9) >= 0.6 THEN 'suspicious' WHEN round(c, 9) >= 0.35 THEN 'inconclusive' ELSE 'clean' END AS verdict,
 true AS calibrated, 'isotonic' AS note FROM c""",
    "offset_clusters": f"""WITH RECURSIVE e AS (SELECT vec_id AS id, label, embedding[1:5] AS e FROM embeddings),
n AS (SELECT a.id, b.id AS other FROM e a JOIN e b ON a.label = b.label WHERE {_FAR} <= {EPS}::DOUBLE * {EPS}::DOUBLE),
c AS (SELECT id FROM n GROUP BY id HAVING count(*) >= {SAMPLES}), g AS (SELECT n.* FROM n JOIN c USING (id) JOIN c d ON d.id = n.other),
r AS (SELECT id, id AS seen FROM c UNION SELECT r.id, g.other FROM r JOIN g ON g.id = r.seen),
k AS (SELECT id, min(seen) AS cluster FROM r GROUP BY id), b AS (SELECT n.id, min(k.cluster) AS cluster FROM n JOIN k ON k.id = n.other GROUP BY n.id)
SELECT e.id, coalesce(k.cluster, b.cluster, -1) AS cluster FROM e LEFT JOIN k USING (id) LEFT JOIN b ON b.id = e.id""",
    "duplicate_paths": f"WITH {_FILES}, p AS (SELECT digest, list(path ORDER BY path) AS paths FROM f GROUP BY digest) SELECT digest, paths[1] AS path, array_to_string(paths[2:], ',') AS others FROM p WHERE len(paths) > 1",
    "kept_jobs": """WITH e AS (SELECT user_id % 8 AS store, user_id AS job, min(epoch_us(ts)) AS put, max(epoch_us(ts)) AS seen, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY ALL),
x AS (SELECT *, seen <= (SELECT max(seen) FROM e) - 3600000000 AND status <> 'click' AS old FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY store, old ORDER BY put DESC, job DESC) AS k FROM x)
SELECT store, job, status, CASE WHEN old THEN 'expired' WHEN k > 64 THEN 'evicted' ELSE 'kept' END AS why FROM r""",
    "manifest_paths": f"""WITH {_FILES}, m AS (SELECT digest, min(path) AS path FROM f GROUP BY digest), s AS (SELECT path, ('0x' || digest[1:8])::BIGINT / 4294967296.0 AS share FROM m),
k AS (SELECT path, CASE WHEN share < 0.8 THEN 'train' WHEN share < 0.9 THEN 'val' WHEN share < 0.95 THEN 'calib' ELSE 'test' END AS split FROM s)
SELECT split, path, row_number() OVER (PARTITION BY split ORDER BY path) - 1 AS place FROM k""",
    "letterbox_points": """WITH p AS (SELECT p_partkey, p_size * 7 + 40 AS w, p_partkey % 300 + 50 AS h FROM part), s AS (SELECT *, w * 0.25::DOUBLE AS x, h * 0.75::DOUBLE AS y, least(128.0::DOUBLE / w, 128.0::DOUBLE / h) AS s FROM p),
c AS (SELECT *, least(128, greatest(1, round_even(w * s, 0)::INT)) AS cw, least(128, greatest(1, round_even(h * s, 0)::INT)) AS ch FROM s),
m AS (SELECT *, x * (cw / w::DOUBLE) + (128 - cw) // 2 AS cx, y * (ch / h::DOUBLE) + (128 - ch) // 2 AS cy FROM c)
SELECT p_partkey, round(cx, 5) AS cx, round(cy, 5) AS cy, round(x, 5) AS x, round(y, 5) AS y, round(x / w, 6) AS u, round(y / h, 6) AS v FROM m""",
}


def _with_others() -> dict[str, str]:
    """SQL that goes on from other queries' parts."""
    from .panels import _HASHES

    distance = "list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))"
    return {
        "index_gate": f"""WITH {_HASHES}, p AS (SELECT n.vec_id AS needle, h.vec_id, list_min(list_transform(h.turns, lambda t: hamming(n.bits, t)))::INT AS hamming
 FROM h JOIN h n ON n.vec_id % 50 = 0 AND n.vec_id <> h.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY hamming, vec_id)::INT AS rank FROM p) SELECT * FROM r WHERE rank <= 10 AND hamming <= 20""",
        "nearest_mirror": f"""WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, {distance} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT 0 AS side, a AS src, b AS dst, dist, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rank FROM d UNION ALL SELECT 1, b, a, dist, row_number() OVER (PARTITION BY b ORDER BY dist, a) FROM d)
SELECT side, src, dst, round(dist, 4) AS dist, rank::INT AS rank FROM r WHERE rank <= CASE WHEN side = 0 THEN 3 ELSE 1 END""",
    }


ORACLE_SQL |= _with_others()
