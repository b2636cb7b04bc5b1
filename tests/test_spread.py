"""Rows that are few in bytes and take long are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinspot.operators import keypoints, pixels, shared


def _images(spark, n: int):
    return spark.createDataFrame([(k, 12, 10, bytes([k, *[50] * 118, 200])) for k in range(n)], "name long, width int, height int, gray binary").coalesce(1)


def test_images_are_dealt_over_tasks(spark):
    found = keypoints.detected(_images(spark, 64), "name")
    tasks = found.select(F.spark_partition_id().alias("t"), "name").groupBy("t").count().collect()
    assert sum(r["count"] for r in tasks) == 64 and len(tasks) > 4 and max(r["count"] for r in tasks) < 32


def test_tasks_grow_with_rows(spark):
    assert [shared.spread(spark.range(1), n=n).rdd.getNumPartitions() for n in (0, 1, 80, 10**6)] == [1, 1, 10, 2000]


def test_span_of_grey_values(spark):
    rows = _images(spark, 30).unionByName(spark.createDataFrame([(30, 0, 0, None)], "name long, width int, height int, gray binary"))
    found = {r["name"]: (r["s"]["least"], r["s"]["most"]) for r in rows.withColumn("s", pixels.span("gray")).collect()}
    assert found == {k: (k, 200) for k in range(30)} | {30: (None, None)}


def test_hulls_read_a_key_in_batches(spark):
    """No group for each key and share goes to Python, and points between a line's ends don't."""
    from twinspot.operators import review

    rows = spark.range(40_000).select((F.col("id") % 100).alias("k"), (F.floor(F.col("id") / 100) % 7).alias("x"), ((F.col("id") * 7919) % 1009).cast("double").alias("y"))
    found = review.hulls(rows, "k")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    own = {r["k"]: (r["corners"], r["area"]) for r in found.collect()}
    import numpy as np

    for k in range(100):
        corners = review.hull(np.asarray([(r["x"], r["y"]) for r in rows.where(F.col("k") == k).collect()], float)) if k < 3 else None
        assert k in own and (corners is None or own[k][0] == len(corners))


def test_robust_maps_read_keys_in_batches(spark):
    """No group for each key goes to Python, and errors are those of the definition."""
    import numpy as np

    from twinspot.operators import robust

    rows = spark.range(900).select((F.col("id") % 9).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    found = robust.hypotheses(rows.withColumns({"u": F.col("x") * 2 + 3, "v": F.col("y") - F.col("x")}), "k", "affine", 1.0)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    best = {r["k"]: [r[f"h{c}"] for c in range(6)] for r in found.where("place = 0").collect()}
    assert all(np.allclose(best[k], [2, 0, 3, -1, 1, 0], atol=1e-6) for k in range(9))
    maps, x, y = np.random.default_rng(2).normal(size=(70, 9)), np.arange(5.0), np.arange(5.0)[::-1]
    far = [[np.hypot((m[0] * a + m[1] * b + m[2]) / (w := m[6] * a + m[7] * b + m[8]) - 1, (m[3] * a + m[4] * b + m[5]) / w - 2) for a, b in zip(x, y, strict=True)] for m in maps]
    assert np.allclose(robust.errors(maps, x, y, np.ones(5), np.full(5, 2.0)), far)
    assert np.isinf(robust.errors(np.zeros((1, 9)), x, y, x, y)).all()


def test_dense_points_keep_no_pairs(spark, monkeypatch):
    """What clustering keeps doesn't grow with the pairs of a dense place."""
    import random

    from twinspot.operators import clustering

    draw, sizes = random.Random(5), []
    keep = clustering._kept

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(clustering, "_kept", counted)
    rows = [(k, draw.gauss(k % 3 * 4, 0.1), draw.gauss(0, 0.1)) for k in range(600)] + [(600, 4.0, 1.0), (601, 20.0, 20.0)]
    found = {r["id"]: r["cluster"] for r in clustering.dbscan(spark.createDataFrame(rows, "id long, x double, y double"), 0.9, 4).collect()}
    assert [found[k] for k in range(600)] == [k % 3 for k in range(600)] and found[601] == -1 and max(sizes) <= len(rows)
