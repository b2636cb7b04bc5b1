"""Manifests on disk, layouts and cases by names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinspot import plans
from twinspot.operators import corpus, review


def test_manifest_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(f"d/{k}.png", f"{k % 20}") for k in range(40)], "path string, text string")
    made = corpus.manifest(corpus.digests(files, "path", "text"))
    corpus.write_manifest(made, f"file://{tmp_path}/m")
    back = corpus.read_manifest(spark, f"file://{tmp_path}/m")
    key = lambda rows: sorted(map(tuple, rows.select("digest", "path", "duplicates", "split").collect()))
    assert key(back) == key(made) and back.count() == 20
    for name, bad in (("lacks", made.drop("split")), ("split", made.withColumn("split", F.lit("other")))):
        bad.write.json(f"file://{tmp_path}/{name}")
        with pytest.raises(ValueError, match=name):
            corpus.read_manifest(spark, f"file://{tmp_path}/{name}")


def test_layouts_by_folder_names(spark):
    named = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    assert corpus.layout_of(named("a/x/images/1.png", "a/x/masks/2.png")) == "BBBC038"
    assert corpus.layout_of(named("a/images/1.png", "b/2.png")) == "FLAT" and corpus.layout_of(named("maskspot/1.png")) == "FLAT"


def test_cases_by_stem(spark):
    paths = ["in/cell.png", "in/cell_affine.png", "in/cell_affine_q25.jpg", "in/other.tif", "in/alone_affine.png", "in/cell.jpg"]
    got = corpus.cases(spark.createDataFrame([(p,) for p in paths], "path string"), ["_affine", "_q25"]).collect()
    # the longer copy's stem is that of no base
    assert sorted(map(tuple, got)) == [("in/cell.jpg", "in/cell_affine.png", "_affine")]


def test_places_over_tasks(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "v int, k int").repartition(7)
    got = review.placed(rows, ["v", "k"]).collect()
    assert [(r["place"], r["v"]) for r in sorted(got, key=lambda r: r["place"])] == [(k + 1, v) for k, v in enumerate(sorted(k * 7919 % 1000 for k in range(1000)))]
    paths = corpus.placed_paths(spark.createDataFrame([("ab"[k % 2], f"p{k:04d}") for k in range(501)], "split string, path string")).collect()
    assert all(int(r["path"][1:]) // 2 == r["place"] for r in paths) and len(paths) == 501


@pytest.mark.parametrize("name", ["mosaic_pairs", "mosaic_enhanced"])
def test_mosaics(spark, sf_dir, name):
    """Every whole mosaic has its rows; a mosaic turned and mirrored is found, by its reflection."""
    rows = plans.queries()[name](spark, sf_dir).collect()
    whole = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.floor(F.col("vec_id") / 64).alias("m")).count().where("count = 64").count()
    if name == "mosaic_pairs":
        assert len(rows) == 2 * whole
        turned = [r for r in rows if r["b"].endswith("_turned")]
        assert all(r["reason"] == "none" and r["flip"] and r["reflected"] for r in turned)
        assert all(r["reason"] != "none" for r in rows if not r["b"].endswith("_turned"))
    else:
        assert len({r["name"] for r in rows}) == len(rows) == whole
    if name == "mosaic_enhanced":
        assert all((r["width"], r["height"]) == (256, 256) and r["most"] > 180 > 90 > r["least"] for r in rows)
