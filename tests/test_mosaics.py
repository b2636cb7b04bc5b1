"""Pictures made of embeddings: what is said of them before and after their enhancement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from twinspot import plans


def test_spread_before_and_after(spark, sf_dir):
    rows = {r["name"]: r for r in plans.queries()["mosaic_enhanced"](spark, sf_dir).collect()}
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 64).alias("m"), "embedding").collect()
    values = {m: np.clip(np.rint(np.array([r["embedding"] for r in found if r["m"] == m]) * 256 + 128), 0, 255) for m in {r["m"] for r in found}}
    whole = {f"m{m:06d}": (int(v.min()), int(v.max())) for m, v in values.items() if len(v) == 64}
    assert {n: (r["least_before"], r["most_before"]) for n, r in rows.items()} == whole
    # the enhancement spreads values further
    assert all(r["most"] - r["least"] >= r["most_before"] - r["least_before"] for r in rows.values())


def test_corners_are_looked_for_once(monkeypatch):
    """Keypoints of the whole picture and of its regions come from one pass over the levels, and are those of two passes."""
    from twinspot.operators import keypoints

    draw = np.random.default_rng(4)
    image = np.full((48, 64), 200, np.uint8)
    image[8:30, 10:50] = draw.integers(0, 256, (22, 40))
    seen, look = [], keypoints.corners
    monkeypatch.setattr(keypoints, "corners", lambda *a: seen.append(a[0].shape) or look(*a))
    found = keypoints.detection(image)
    assert found["boxes"] and not found["abandoned"] and len(seen) == len(set(seen)) <= keypoints.LEVELS
    work = keypoints.enhanced(image)
    mask = np.zeros(work.shape, bool)
    mask[:, : work.shape[1] // 2] = True
    every, held = keypoints.featured(work, [None, mask])
    assert np.array_equal(every, keypoints.features(work)) and np.array_equal(held, keypoints.features(work, mask))
    assert found["detected"] == len(every) > len(held) > 0 and (held[:, 0] < work.shape[1] // 2).all()


def test_few_points_of_many_keys_are_dealt_over_tasks(spark):
    """Points of thousands of pairs are few in bytes, and drawing maps from them takes long."""
    from twinspot.operators import robust

    rows = spark.range(640).select((F.col("id") % 64).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    maps = robust.hypotheses(rows.withColumns({"u": F.col("x") + 3, "v": F.col("y")}), "k", "affine", 1.0)
    tasks = maps.select(F.spark_partition_id().alias("t"), "k").distinct().groupBy("t").count().collect()
    assert sum(r["count"] for r in tasks) == 64 and len(tasks) > 8 and max(r["count"] for r in tasks) <= 16
