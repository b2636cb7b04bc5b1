"""Calibrators and attribution maps against their formulas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspot.operators import attribution, calibrate


def _labelled(spark, n=800):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (n, 2))
    p = 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - 0.8 * x[:, 1])))
    y = (rng.random(n) < p).astype(int)
    return x, y, spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1)], "f_one double, f_two double, y int")


def test_fit_is_the_maximum_of_the_likelihood(spark):
    x, y, rows = _labelled(spark)
    z, a = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ a))
        a = a - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (p - y))
    found = calibrate.fit(rows, ["one", "two"], "y", isotonic=True, fitted_on="made")
    assert np.allclose([*found.coef, found.intercept], a, atol=1e-3) and found.metrics["rows"] == len(x) and found.metrics["accuracy"] > 0.7
    heights = [k[1] for k in found.knots]
    assert heights == sorted(heights) and len(found.knots) > 2


def test_stored_calibrators_are_checked(spark, tmp_path):
    own = calibrate.Calibrator(("one", "two"), (1.5, -0.5), 0.25, ((0.1, 0.0), (0.9, 1.0)), "made", {"rows": 3.0})
    calibrate.save(spark, own, f"file://{tmp_path}/a")
    assert calibrate.load(spark, f"file://{tmp_path}/a", ["one", "two"]) == own
    with pytest.raises(ValueError, match="another order"):
        calibrate.load(spark, f"file://{tmp_path}/a", ["two", "one"])
    with pytest.raises(ValueError, match=r"added \['three'\], gone \['two'\]"):
        calibrate.load(spark, f"file://{tmp_path}/a", ["one", "three"])
    spark.range(1).select(F.lit('{"kind": "tree"}').alias("value")).write.text(f"file://{tmp_path}/b")
    with pytest.raises(ValueError, match="kind or version"):
        calibrate.load(spark, f"file://{tmp_path}/b", ["one"])
    with pytest.raises(ValueError, match="knots"):
        calibrate.Calibrator(("one",), (1.0,), 0.0, ((0.5, 0.1), (0.2, 0.4)))
    with pytest.raises(ValueError, match="coefficients"):
        calibrate.Calibrator(("one",), (1.0, 2.0), 0.0)


def test_predictions_by_hand(spark):
    own = calibrate.Calibrator(("one", "two"), (1.5, -0.5), 0.25, ((0.2, 0.1), (0.8, 0.9)))
    got = calibrate.predicted(spark.createDataFrame([(1.0, 2.0), (-9.0, 0.0), (9.0, 0.0)], "f_one double, f_two double"), own).collect()
    for r in got:
        p = 1 / (1 + np.exp(-(0.25 + 1.5 * r["f_one"] - 0.5 * r["f_two"])))
        want = np.interp(p, [0.2, 0.8], [0.1, 0.9])
        assert abs(r["confidence"] - want) < 1e-12 and r["calibrated"] and r["note"] == "isotonic"
        assert r["verdict"] == ("likely_manipulated" if want >= 0.85 else "suspicious" if want >= 0.6 else "inconclusive" if want >= 0.35 else "clean")
    plain = calibrate.predicted(spark.createDataFrame([(1.0, 2.0)], "f_one double, f_two double"), calibrate.Calibrator(("one", "two"), (1.0, 0.0), 0.0)).first()
    assert plain["note"] is None and abs(plain["confidence"] - 1 / (1 + np.exp(-1.0))) < 1e-12


@pytest.mark.parametrize("mode", attribution.MODES)
def test_pooled_maps(spark, mode):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(4):
        a, g = rng.random((6, 4, 4)), rng.normal(0, 1, (6, 4, 4))
        if k == 3:
            a[:] = 1.0
        w = (np.abs(g) if mode == "abs" else g).mean(axis=(1, 2))
        raw = (w[:, None, None] * a).sum(axis=0)
        raw = np.maximum(raw, 0) if mode == "relu" else np.abs(raw) if mode == "signed" else raw
        want[k] = (raw - raw.min()) / np.ptp(raw) if np.ptp(raw) > 1e-12 else np.zeros((4, 4))
        rows.append((k, a.ravel().tolist(), g.ravel().tolist()))
    got = {r["id"]: r for r in attribution.pooled(spark.createDataFrame(rows, "id int, activations array<double>, gradients array<double>"), 6, mode).collect()}
    for k in range(3):
        assert np.allclose(got[k]["grid"], want[k].ravel()) and got[k]["degenerate"] == (np.ptp(want[k]) == 0)
        assert abs(got[k]["zero_fraction"] - (want[k] == 0).mean()) < 1e-12
    with pytest.raises(ValueError, match="none of"):
        attribution.pooled(spark.range(1), 1, "max")


def test_dead_sides(spark):
    rows = spark.createDataFrame([(0.0, 0.9), (0.9, 0.0), (0.1, 0.19), (0.5, 0.6), (0.0, 0.2)], "l double, r double")
    assert [r[0] for r in rows.select(attribution.suppressed(F.col("l"), F.col("r"))).collect()] == ["right", "left", None, None, "right"]


def test_maps_on_the_picture(spark):
    grid = np.zeros((8, 8))
    grid[4, 2] = 1.0
    # a picture twice as wide as high: its letterbox has the middle half of the rows
    heat = attribution.to_source(grid, 200, 100, 64)
    y, x = np.unravel_index(heat.argmax(), heat.shape)
    assert heat.shape == (100, 200) and abs(x - 62) < 8 and abs(y - 62) < 10
    assert attribution.to_source(grid, 200, 100, 64, squash=True).shape == (100, 200)
    assert attribution.grid_size(128, "block3") == 16
    rows = spark.createDataFrame([(1, 20, 10, grid.ravel().tolist()), (2, 20, 10, [0.0] * 64)], "id int, width int, height int, grid array<double>")
    got = {r["id"]: r["heat"] for r in attribution.projected(rows, "id", 64).collect()}
    assert len(got[1]) == 200 and max(got[1]) > 150 and got[2] is None
