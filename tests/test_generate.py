"""Made changes, the benchmark on them, and the prototype's rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_keypoints import SHAPE, _row, texture
from twinspot.operators import generate, prototype, review


def test_changes_are_bounded_and_repeatable():
    image = texture(80, 120)
    for name, change in generate.CHANGES.items():
        one, again, other = (change(image, generate.rng_of(k, name)) for k in ("a", "a", "b"))
        assert one.shape == image.shape and one.dtype == np.uint8 and (one == again).all() and (one != other).any() and (one != image).any()
    rect = generate.rectangle(image, generate.rng_of("a", "rect")) != image
    assert 0.005 < rect.mean() < 0.13
    noise = generate.noisy(np.full((200, 200), 128, np.uint8), generate.rng_of("a", "noise")).astype(float)
    assert 4 < noise.std() < 26 and abs(noise.mean() - 128) < 1


def test_attacks_by_their_definition():
    image = texture(100, 120)
    made = {n: f(image) for n, f in generate.ATTACKS.items()}
    assert made["ex1_affine"].shape[0] > 150
    # the middle stays in the middle
    ramp = np.add.outer(np.arange(100), np.arange(120)).astype(np.uint8)
    turned = generate.affine(ramp)
    m = turned.shape[0] // 2
    assert abs(int(turned[m, m]) - int(ramp[50, 60])) <= 2
    p = made["ex3_copymove"]
    assert (p[60:85, 72:97] == image[10:35, 12:37]).all() and (p[:60] == image[:60]).all()
    assert (made["ex5_blackout"] == 0).sum() >= 15 * 18 and made["ex2_degraded"].shape == image.shape
    want = np.clip(np.rint((image.mean() + 1.8 * (image - image.mean())) * 0.5), 0, 255)
    assert (made["ex4_exposure"] == want).all()


def test_warp_by_whole_turns():
    image = texture(30, 40)
    assert (generate.warped(image, np.asarray([[1.0, 0, 0], [0, 1, 0]]), 40, 30) == image).all()
    assert (generate.warped(image, np.asarray([[-1.0, 0, 39], [0, 1, 0]]), 40, 30) == image[:, ::-1]).all()


def test_rows_of_changes(spark):
    rows = spark.createDataFrame([_row("a", texture(60, 70)), _row("none", None)], SHAPE)
    assert sorted(r["change"] for r in generate.changed(rows, "id").collect()) == sorted(generate.CHANGES)
    assert generate.changed(rows, "id", ["noise"]).count() == 1


def test_benchmark_on_made_pictures(spark):
    rows = spark.createDataFrame([_row("p", texture(200, 220, 8))], SHAPE)
    cases, recall = generate.benchmark(rows, "id", scale=2.0)
    got = {r["change"]: r for r in cases.collect()}
    assert set(got) == set(generate.ATTACKS)
    # each attack but the coarse JPEG under heavy noise is told from its pixels
    assert all(got[k]["detected"] for k in got if k != "ex2_degraded"), {k: r["reason"] for k, r in got.items()}
    assert {r["change"]: r["recall"] for r in recall.collect()}["ex1_affine"] == 1.0


def test_rules_of_the_prototype(spark):
    assert prototype.preprocessed(texture(50, 90)).shape == (128, 128) and abs(prototype.preprocessed(np.full((9, 9), 255, np.uint8)) - 1).max() < 1e-9
    points = spark.createDataFrame([("few", k, float(k), 5.0) for k in range(20)] + [("many", k, float(k), 5.0) for k in range(20)] + [("none", 1, 3.0, 3.0)], "image string, kp int, x double, y double")
    boxes = spark.createDataFrame([("few", 0, 0, 7, 10), ("many", 0, 0, 8, 10), ("many", 4, 0, 8, 6), ("many", 0, 6, 30, 4)], "image string, bx int, by int, width int, height int")
    got = prototype.in_boxes(points, boxes, "image").groupBy("image").count().collect()
    assert {r["image"]: r["count"] for r in got} == {"few": 20, "many": 12, "none": 1}
    gates = spark.createDataFrame([(3, 3), (4, 7), (60, 8), (44, 8)], "m int, i int").select(prototype.gated(F.col("m"), F.col("i"))).collect()
    assert [r[0] for r in gates] == ["too_few_matches", "too_few_inliers", "low_inlier_ratio", "none"]
    parts = prototype.similarity_parts(spark.createDataFrame([(0.0, -2.0, 2.0, 0.0), (1.0, 0.0, 0.0, -1.0)], "a double, b double, c double, d double")).collect()
    assert [(round(r["rotation"]), r["scale"], r["flip"]) for r in parts] == [(90, 2.0, False), (0, 1.0, True)]
    with pytest.raises(ValueError, match="no image"):
        prototype.one_against_many(spark.createDataFrame([_row("a", texture(9, 9))], SHAPE), "id", "b")


def test_lines_and_views(spark):
    row = spark.createDataFrame([("suspicious", 0.71234, 30, 40, False)], "v string, c double, i int, m int, k boolean").select(review.summary_line(F.col("v"), F.col("c"), F.col("i"), F.col("m"), F.col("k"))).first()[0]
    assert row == "suspicious (0.712, uncalibrated), 30 of 40 matches agree"
    matches = spark.createDataFrame([("p", k, k % 3 == 0, 10.0 * k, 20.0, 5.0, 6.0, 100, 50, 10, 12) for k in range(9)] + [("q", 0, None, 1.0, 1.0, 1.0, 1.0, 2, 2, 4, 4)], "pair string, match int, inlier boolean, x double, y double, u double, v double, width_a int, height_a int, width_b int, height_b int")
    got = review.viewed(matches, "pair", 4).collect()
    assert sorted(r["match"] for r in got if r["pair"] == "p") == [0, 1, 3, 6]
    q = next(r for r in got if r["pair"] == "q")
    assert not q["inlier"] and (q["ax"], q["bx"], q["aspect_a"]) == (0.5, 0.25, 1.0)
