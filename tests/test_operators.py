from __future__ import annotations

import numpy as np

from twinspot import functions as X
from twinspot.operators import clustering, corpus, screening
from twinspot.streaming import event_stream, figure_stream, windowed


def test_orientations_are_the_dihedral_group():
    panel = np.arange(64)
    found = {tuple(panel[p]) for p in X.orientations()}
    square = panel.reshape(8, 8)
    assert found == {tuple(np.rot90(s, k).ravel()) for s in (square, square.T) for k in range(4)}


def test_all_pairs_has_each_pair_once(spark):
    rows = spark.range(40).withColumnRenamed("id", "k")
    pairs = [tuple(r) for r in screening.all_pairs(rows, "k").collect()]
    assert sorted(pairs) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_dbscan_border_and_noise(spark):
    points = [(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 0.0, 0.1), (4, 0.9, 0.0), (5, 5.0, 5.0)]
    found = dict(map(tuple, clustering.dbscan(spark.createDataFrame(points, "id long, x double, y double"), 0.85, 3).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: -1}


def test_layout_names_match_whole(spark):
    rows = spark.createDataFrame([("a/Images/x.png",), ("a/images_old/x.png",), ("a/images/masks/x.png",)], "p string")
    got = [r[0] for r in rows.select(corpus.accepted(rows["p"], ["images"], ["masks"])).collect()]
    assert got == [True, False, False]


def test_event_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", events_ts(spark, sf_dir), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed(event_stream(spark, str(tmp_path / "in"), events.schema))
    query = stream.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    same = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert same(spark.table("tumbling")) == same(windowed(events))


def events_ts(spark, sf_dir):
    from pyspark.sql import functions as F

    return F.col("ts").cast("timestamp").alias("ts")


def test_figure_stream_keeps_refusals(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    for name, data in (("a.png", b"x" * 10), ("b.txt", b"x"), ("c.png", b""), ("d.PNG", b"y" * 200)):
        (folder / name).write_bytes(data)
    query = figure_stream(spark, str(folder), 100).writeStream.format("memory").queryName("figures").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["path"].rsplit("/", 1)[1]: r["refused"] for r in spark.table("figures").collect()}
    assert got == {"a.png": None, "b.txt": "suffix", "d.PNG": "too_large"}


def test_hull_holds_all_points_and_no_spare_corner():
    import numpy as np

    from twinspot.operators.review import hull

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 40, 300):
        points = rng.integers(0, 12, (n, 2)).astype(float)
        corners = hull(points)
        if len(np.unique(points, axis=0)) < 3:
            assert len(corners) == len(np.unique(points, axis=0))
            continue
        for k in range(len(corners)):
            a, b = corners[k], corners[(k + 1) % len(corners)]
            side = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
            assert len(corners) == 2 or (side >= -1e-9).all()
        assert {tuple(c) for c in corners} <= {tuple(p) for p in points}


def test_hulls_by_shares(spark):
    import numpy as np

    from twinspot.operators.review import hull, hulls

    rng = np.random.default_rng(4)
    rows = [(int(k), float(x), float(y)) for k, x, y in zip(rng.integers(0, 3, 400), rng.normal(size=400), rng.normal(size=400), strict=True)]
    got = {r["k"]: (r["corners"], r["area"]) for r in hulls(spark.createDataFrame(rows, "k long, x double, y double"), "k").collect()}
    for k in range(3):
        found = hull(np.asarray([r[1:] for r in rows if r[0] == k]))
        x, y = found[:, 0], found[:, 1]
        assert got[k][0] == len(found) and abs(got[k][1] - abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2) < 1e-9


def test_gates_without_a_map(spark):
    from pyspark.sql import functions as F

    from twinspot.operators.geometry import gated

    rows = [(20, 18, 15, 0.5, 0.5, None, None), (20, 18, 15, 0.5, 0.5, 1.0, 2.0), (20, 18, 15, 0.5, 0.5, 1.0, float("inf")), (5, 0, 0, 0.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "m int, i int, d int, s double, x double, r double, c double")
    assert [r[0] for r in df.select(gated(*[F.col(c) for c in "midsxrc"])).collect()] == ["no_model", "none", "ill_conditioned", "too_few_matches"]


def test_block_pairs_make_each_pair_once(spark):
    from twinspot.operators import screening

    rows = spark.range(57).withColumnRenamed("id", "k")
    for blocks in (1, 3, 8):
        got = [(r["a_k"], r["b_k"]) for r in screening.all_pairs(rows, "k", blocks).collect()]
        assert sorted(got) == [(a, b) for a in range(57) for b in range(a + 1, 57)]
