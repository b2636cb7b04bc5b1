"""Images out of files, kernels on their pixels, and robust fits, against planted truth."""

from __future__ import annotations

import numpy as np
import pytest

from twinspot.operators import copymove, pixels, robust
from twinspot.sources import images as source


def _texture(h: int, w: int, seed: int = 3) -> np.ndarray:
    small = np.random.default_rng(seed).random((h // 8 + 1, w // 8 + 1))
    return (pixels.resized(small, w, h) * 200 + 20).astype(np.uint8)


def test_png_round_trip_and_probe():
    image = _texture(37, 53)
    content = source.encode_png(image)
    assert source.probe(content) == (53, 37)
    assert (source.decode_png(content) == image).all()


def test_filters_of_rows():
    above, row = np.asarray([10, 20, 30, 40], np.uint8), np.asarray([1, 2, 3, 250], np.uint8)
    assert source._unfiltered(1, row, above, 1).tolist() == [1, 3, 6, 0]
    assert source._unfiltered(2, row, above, 1).tolist() == [11, 22, 33, 34]
    assert source._unfiltered(3, row, above, 1).tolist() == [6, 15, 25, 26]
    # all differences to the row above are the least here, so the mixture is it
    assert source._unfiltered(4, row, above, 1).tolist() == [11, 22, 33, 34]


def test_images_of_a_folder(spark, tmp_path):
    good = _texture(60, 90)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(source.encode_png(good))
    (tmp_path / "sub" / "b.PNG").write_bytes(source.encode_png(_texture(300, 200)))
    (tmp_path / "cut.png").write_bytes(source.encode_png(good)[:60])
    (tmp_path / "note.txt").write_text("no image")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in source.images(spark, str(tmp_path), most_pixels=50_000, longest=64).collect()}
    assert set(rows) == {"a.png", "b.PNG", "cut.png"}
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (64, 43) and rows["a.png"]["error"] is None
    assert rows["b.PNG"]["error"] == "too_many_pixels" and rows["b.PNG"]["gray"] is None
    assert rows["cut.png"]["error"].startswith("undecoded") and rows["cut.png"]["source_width"] == 90
    with pytest.raises(ValueError, match="no image files"):
        source.images(spark, str(tmp_path / "sub"), 1).sparkSession and source.images(spark, str(_empty(tmp_path)))


def test_bad_files_keep_their_rows(spark):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = lambda w, h, colour, raw, extra=b"": source._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    files = {
        "palette": png(2, 1, 3, b"\0\1\7", chunk(b"PLTE", bytes(6))), "empty": png(0, 0, 0, b""), "bomb": png(4, 4, 0, bytes(50_000_000)), "short": png(40, 40, 0, bytes(30)),
        "filter": png(2, 1, 0, b"\x09\1\1"), "none": b"", "null": None, "bmp": b"BM" + bytes(20), "tiff": b"II*\0" + bytes(20), "good": source.encode_png(_texture(20, 30)),
    }
    got = {r["path"]: r for r in source.decoded(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert set(got) == set(files) and {k for k, r in got.items() if r["error"] is None} == {"good", "bomb"}
    # what goes beyond the header's size is not read
    assert got["bomb"]["gray"] == bytes(16) and got["null"]["sha256"] is None and got["good"]["sha256"] == __import__("hashlib").sha256(files["good"]).hexdigest()


def test_bitmaps_and_tiffs():
    image = _texture(13, 21)
    colour = np.stack([image, image // 2, 255 - image], axis=2)
    gray = np.rint(colour @ np.asarray([0.299, 0.587, 0.114])).astype(np.uint8)
    for content in (source.encode_bmp(image), source.encode_tiff(image), source.encode_tiff(image, packed=True)):
        assert source.probe(content) == (21, 13) and (source.decode(content) == image).all()
    assert (source.decode(source.encode_bmp(colour)) == gray).all() and (source.decode(source.encode_tiff(colour)) == gray).all()


def _empty(folder):
    (folder / "empty").mkdir()
    return folder / "empty"


def test_resize_keeps_means_and_boxes_come_back():
    image = _texture(48, 80)
    assert np.allclose(pixels.resized(image, 20, 12), image.reshape(12, 4, 20, 4).mean(axis=(1, 3)))
    box = pixels.boxed(image, 64)
    assert box.shape == (64, 64) and (box[:13] == 0).all() and (box[51:] == 0).all()
    assert pixels.unboxed(box, 80, 48).shape == (48, 80)


def test_sobel_by_its_definition():
    image = _texture(9, 11).astype(float)
    p, kernel = np.pad(image, 1, mode="reflect"), np.asarray([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = np.asarray([[np.hypot((p[r : r + 3, c : c + 3] * kernel).sum(), (p[r : r + 3, c : c + 3] * kernel.T).sum()) for c in range(11)] for r in range(9)])
    assert np.allclose(pixels.sobel(image), want * 255 / want.max())
    assert (pixels.sobel(np.full((5, 5), 7)) == 0).all()


def test_hashes_of_turned_panels(spark):
    image = _texture(64, 64)
    rows = [(k, 64, 64, np.ascontiguousarray(t).tobytes()) for k, t in enumerate(pixels.turns(image))] + [(99, 64, 64, _texture(64, 64, 8).tobytes()), (100, None, None, None)]
    found = {r["id"]: r for r in pixels.hashed(spark.createDataFrame(rows, "id int, width int, height int, gray binary"), "id").collect()}
    assert set(found) == {*range(8), 99}
    assert len({found[k]["canonical"] for k in range(8)}) == 1 and found[99]["canonical"] != found[0]["canonical"]


@pytest.mark.parametrize(("columns", "rows"), [(2, 1), (3, 1), (2, 2), (3, 2)])
def test_panels_of_a_figure(spark, columns, rows):
    tile, gutter = (160, 200), 26
    figure = np.full((rows * tile[0] + (rows + 1) * gutter, columns * tile[1] + (columns + 1) * gutter), 255, np.uint8)
    for r in range(rows):
        for c in range(columns):
            y, x = gutter + r * (tile[0] + gutter), gutter + c * (tile[1] + gutter)
            figure[y : y + tile[0], x : x + tile[1]] = _texture(*tile, seed=r * 7 + c) // 2
    df = spark.createDataFrame([("f", figure.shape[1], figure.shape[0], figure.tobytes())], "id string, width int, height int, gray binary")
    found = pixels.split(df, "id").collect()
    assert len(found) == rows * columns and all(p["confident"] for p in found)
    boxes = sorted((p["x"], p["width"]) for p in found if p["y"] == 0)
    # cut at the middles of the gutters, so that the boxes tile the figure
    assert all(x + w == other for (x, w), (other, _) in zip(boxes, boxes[1:], strict=False)) and boxes[1][0] == gutter + tile[1] + gutter // 2


def test_sparse_panel_beside_a_dense_one():
    figure = np.full((300, 620), 255, np.uint8)
    figure[20:280, 20:290] = _texture(260, 270) // 3
    figure[20:280, 330:600] = np.where(np.random.default_rng(2).random((260, 270)) < 0.3, 20, 250)
    figure[20:280, 330:332] = figure[20:280, 598:600] = 20
    found = pixels.panels(figure)
    assert len(found) == 2 and all(p[4] for p in found)


def test_dark_content_is_no_gutter():
    tile, gutter = (160, 200), 26
    figure = np.full((tile[0] + 2 * gutter, 2 * tile[1] + 3 * gutter), 255, np.uint8)
    for c in range(2):
        x = gutter + c * (tile[1] + gutter)
        figure[gutter : gutter + tile[0], x : x + tile[1]] = _texture(*tile, seed=c) // 2
    figure[gutter : gutter + tile[0], gutter + 60 : gutter + 140] = 0
    assert len(pixels.panels(figure)) == 2


def test_little_ink_is_not_split():
    figure = np.full((240, 320), 5, np.uint8)
    rng = np.random.default_rng(3)
    for y, x in zip(rng.integers(10, 220, 30), rng.integers(10, 300, 30), strict=True):
        figure[y : y + 8, x : x + 8] = 220
    assert pixels.panels(figure) == [(0, 0, 320, 240, False)]


def test_blank_figure_is_one_panel():
    assert pixels.panels(np.full((200, 300), 250, np.uint8)) == [(0, 0, 300, 200, False)]


def test_kernels_on_rows(spark):
    image = _texture(40, 30)
    df = spark.createDataFrame([("a", 30, 40, image.tobytes()), ("b", None, None, None)], "id string, width int, height int, gray binary")
    row = pixels.mapped(df, lambda x: pixels.boxed(x, 32)).collect()
    assert len(row) == 1 and (row[0]["width"], row[0]["height"], len(row[0]["gray"])) == (32, 32, 1024)


def _pairs(h: np.ndarray, n: int, wrong: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 500, (n, 2))
    w = xy @ h[2, :2] + h[2, 2]
    uv = (xy @ h[:2, :2].T + h[:2, 2]) / w[:, None] + rng.normal(0, 0.3, (n, 2))
    bad = rng.random(n) < wrong
    uv[bad] = rng.uniform(0, 500, (int(bad.sum()), 2))
    return np.column_stack([xy, uv])


@pytest.mark.parametrize("model", ["affine", "homography"])
def test_robust_fit_finds_the_planted_map(spark, model):
    h = np.asarray([[0.9, -0.3, 40], [0.25, 1.1, -12], [0, 0, 1]], float)
    if model == "homography":
        h[2, :2] = (2e-4, -1e-4)
    rows = [("good", *p) for p in _pairs(h, 400, 0.5, 5).tolist()] + [("few", 1.0, 2.0, 3.0, 4.0)] + [("line", float(k), float(k), float(k), float(k)) for k in range(30)] + [("good", None, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "pair string, x double, y double, u double, v double")
    found = robust.fitted(points, "pair", model)
    got = {r["pair"]: r for r in found.collect()}
    assert set(got) == {"good"}
    own = np.asarray([got["good"][c] for c in robust.MAP]).reshape(3, 3)
    corners = np.asarray([(0, 0), (500, 0), (0, 500), (500, 500)], float)
    place = lambda m: (corners @ m[:2, :2].T + m[:2, 2]) / (corners @ m[2, :2] + m[2, 2])[:, None]
    assert np.abs(place(own) - place(h)).max() < 1.0
    m = robust.measured(points.dropna(), robust.conditioned(found, 707.0), "pair").collect()[0]
    assert m["matches"] == 400 and 180 < m["inliers"] < 240 and m["rms"] < 1.0
    assert 1 <= robust.conditioned(found, 707.0).collect()[0]["condition"] < 10


@pytest.mark.parametrize(("share", "least"), [(0.18, 57), (0.25, 58), (0.35, 59)])
def test_few_inliers_are_found(share, least):
    """Noise of a third of a pixel, and as small a share of inliers as the gates accept."""
    rng, found = np.random.default_rng(9), 0
    for k in range(60):
        turn, size = rng.uniform(0, 2 * np.pi), rng.uniform(0.7, 1.4)
        h = np.asarray([[size * np.cos(turn), -size * np.sin(turn), 60], [size * np.sin(turn), size * np.cos(turn), 30], [rng.normal(0, 1e-4), rng.normal(0, 1e-4), 1]])
        points = _pairs(h, 200, 1 - share, 100 + k)
        best = robust.drawn(points, k, "homography", 4.0)
        corners = np.asarray([(50, 50), (450, 50), (50, 450), (450, 450)], float).T
        there = robust.errors(h.reshape(1, 9), *corners, np.zeros(4), np.zeros(4))
        place = lambda m: ((corners.T @ m[:2, :2].T + m[:2, 2]) / (corners.T @ m[2, :2] + m[2, 2])[:, None])  # noqa: B023, E731
        found += bool(np.abs(place(best[0].reshape(3, 3)) - place(h)).max() < 5.0) and there.shape == (1, 4)
    assert found >= least


def test_inverse_maps_back(spark):
    row = (1, *[0.9, -0.3, 40.0, 0.25, 1.1, -12.0, 2e-4, -1e-4, 1.0])
    shape = "pair int, " + ", ".join(f"{c} double" for c in robust.MAP)
    got = robust.inverse(spark.createDataFrame([row, (2, *[1.0] * 9)], shape)).collect()
    assert [r["pair"] for r in got] == [1]
    assert np.allclose(np.reshape(got[0][1:], (3, 3)) @ np.reshape(row[1:], (3, 3)), np.eye(3), atol=1e-9)


def test_regions_of_clusters(spark):
    turn = np.asarray([[0.0, -1.0, 300.0], [1.0, 0.0, 20.0], [0, 0, 1]])
    near = np.asarray([[1.0, 0.0, 5.0], [0.0, 1.0, 5.0], [0, 0, 1]])
    rows = [("copied", *p) for p in _pairs(turn, 40, 0.3, 2).tolist()] + [("near", *p) for p in _pairs(near, 40, 0.0, 3).tolist()] + [("few", *p) for p in _pairs(turn, 5, 0.0, 4).tolist()]
    rows += [("line", float(k), 0.0, float(k + 50), 0.0) for k in range(20)]
    got = {r["c"]: r for r in copymove.regions(spark.createDataFrame(rows, "c string, x double, y double, u double, v double"), "c").collect()}
    assert {c: r["reason"] for c, r in got.items()} == {"copied": "none", "near": "too_close", "few": "too_few_matches", "line": "no_model"}
    assert abs(got["copied"]["rotation_deg"] - 90) < 1 and abs(got["copied"]["scale_x"] - 1) < 0.02 and not got["copied"]["flip"]
    assert got["line"]["inliers"] == 0 and got["line"]["rotation_deg"] is None
