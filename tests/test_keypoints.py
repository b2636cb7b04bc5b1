"""Enhancement, regions, keypoints, comparison of pairs and copies within an image, on made pictures."""

from __future__ import annotations

import numpy as np
import pytest

from twinspot.operators import clustering, compare, copymove, keypoints, pixels

SHAPE = "id string, width int, height int, gray binary"


def texture(h: int, w: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    coarse, fine = (pixels.resized(rng.random((h // n + 1, w // n + 1)), w, h) for n in (8, 3))
    return np.clip(coarse * 150 + fine * 90, 0, 255).astype(np.uint8)


def _row(name: str, image: np.ndarray | None) -> tuple:
    return (name, None, None, None) if image is None else (name, image.shape[1], image.shape[0], np.ascontiguousarray(image).tobytes())


def test_cubic_keeps_constants_and_ramps():
    assert (keypoints.enlarged(np.full((9, 7), 90, np.uint8), 28, 36) == 90).all()
    ramp = np.tile(np.arange(0, 200, 8, dtype=np.uint8), (12, 1))
    made = keypoints.enlarged(ramp, 100, 48).astype(float)
    # inside, a step of 8 becomes four steps of 2
    assert np.abs(np.diff(made[20, 12:-12]) - 2).max() <= 1 and abs(made[20, 50] - (50.5 / 4 - 0.5) * 8) <= 1


def _equalised_slowly(image, clip, tiles):
    """Each tile's curve by its histogram, each pixel mixed on its own."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")
    curves = {}
    for r in range(tiles):
        for c in range(tiles):
            count = [0] * 256
            for v in wide[r * th : (r + 1) * th, c * tw : (c + 1) * tw].ravel().tolist():
                count[v] += 1
            most, excess = max(1, int(clip * th * tw / 256)), 0
            for v in range(256):
                excess += max(0, count[v] - most)
                count[v] = min(count[v], most)
            count = [n + excess // 256 for n in count]
            rest = excess % 256
            if rest:
                for v in range(0, 256, max(256 // rest, 1)):
                    if rest > 0:
                        count[v] += 1
                        rest -= 1
            total, curve = 0, []
            for n in count:
                total += n
                curve.append(min(255, round(total * 255.0 / (th * tw))))
            curves[r, c] = curve
    out = np.zeros_like(image)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            at = lambda r, c: curves[min(max(r, 0), tiles - 1), min(max(c, 0), tiles - 1)][image[y, x]]  # noqa: B023, E731
            a, b = fy - y0, fx - x0
            out[y, x] = round((at(y0, x0) * (1 - b) + at(y0, x0 + 1) * b) * (1 - a) + (at(y0 + 1, x0) * (1 - b) + at(y0 + 1, x0 + 1) * b) * a)
    return out


def test_equalisation_by_its_definition():
    image = texture(61, 83)
    assert np.abs(keypoints.equalised(image, 2.0, 4).astype(int) - _equalised_slowly(image, 2.0, 4).astype(int)).max() <= 1
    dim = (texture(80, 80) // 8 + 40).astype(np.uint8)
    assert np.ptp(keypoints.equalised(dim)) > 2 * np.ptp(dim)


def test_enhancement_of_scale_one_is_none():
    image = texture(30, 40)
    assert keypoints.enhanced(image, 1.0) is image and keypoints.enhanced(image, 4.0).shape == (120, 160)


def test_regions_of_blobs():
    image = np.full((200, 240), 60, np.uint8)
    image[30:60, 40:80] = 200
    image[120:150, 150:230] = 210
    image[5, 5] = 90
    boxes = keypoints.regions(image, wider=2)
    assert len(boxes) == 2 and boxes[0][2] * boxes[0][3] >= boxes[1][2] * boxes[1][3]
    x, y, w, h = boxes[0]
    assert x <= 150 and y <= 120 and x + w >= 230 and y + h >= 150
    assert keypoints.regions(np.full((50, 50), 9, np.uint8)) == []
    # nothing reaches the fixed response, so the response's own values part it
    faint = np.full((100, 100), 100, np.uint8)
    faint[40:60, 40:60] = 102
    assert keypoints.regions(faint, wider=2)
    # a ring's inside belongs to the ring
    ring = np.full((120, 120), 50, np.uint8)
    ring[20:100, 20:100], ring[28:92, 28:92] = 200, 50
    ring[55:65, 55:65] = 200
    assert len(keypoints.regions(ring, wider=0)) == 1


def test_components_by_flood():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mask = rng.random((15, 19)) < 0.45
        row, start, end, label, n = keypoints.components(mask)
        own = np.full(mask.shape, -1)
        for r, s, e, k in zip(row, start, end, label, strict=True):
            own[r, s:e] = k
        assert ((own >= 0) == mask).all()
        seen, parts = set(), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if (y, x) in seen:
                continue
            parts, stack = parts + 1, [(y, x)]
            seen.add((y, x))
            while stack:
                a, b = stack.pop()
                assert own[a, b] == own[y, x]
                for c in range(a - 1, a + 2):
                    for d in range(b - 1, b + 2):
                        if 0 <= c < 15 and 0 <= d < 19 and mask[c, d] and (c, d) not in seen:
                            seen.add((c, d))
                            stack.append((c, d))
        assert parts == int(n)


def test_corners_by_their_definition():
    image = texture(40, 44)
    dy, dx = keypoints._ring()
    y, x, _ = keypoints.corners(image, 12)
    found = set(zip(y.tolist(), x.tolist(), strict=True))
    for r in range(3, 37):
        for c in range(3, 41):
            other = image[r + dy, c + dx].astype(int) - int(image[r, c])
            turns = [np.roll(other, -k)[:9] for k in range(16)]
            corner = any((t > 12).all() or (t < -12).all() for t in turns)
            assert corner or (r, c) not in found
    assert len(found) > 10


@pytest.mark.parametrize("turn", range(4))
def test_turned_image_has_the_same_keypoints(turn):
    image = texture(120, 150)
    own, other = keypoints.features(image, most=400), keypoints.features(np.ascontiguousarray(np.rot90(image, turn)), most=400)
    bits = lambda f: f[:, 5:].astype(np.uint8)
    i, j, _, _ = keypoints.agreed(bits(own), bits(other))
    h, w = image.shape
    x, y = other[j, 0], other[j, 1]
    back = {0: (x, y), 1: (w - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, h - 1 - x)}[turn]
    assert len(i) > 0.6 * len(own) and (np.hypot(back[0] - own[i, 0], back[1] - own[i, 1]) < 2).mean() > 0.95


def test_matches_by_their_definition():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 256, (40, 32), np.uint8), rng.integers(0, 256, (30, 32), np.uint8)
    b[:10] = a[:10] ^ (rng.random((10, 32)) < 0.1).astype(np.uint8)
    far = np.asarray([[int(np.unpackbits(p ^ q).sum()) for q in b] for p in a])
    assert (keypoints.distances(a, b) == far).all()
    want = [(i, int(far[i].argmin())) for i in range(40) if sorted(far[i])[0] < 0.8 * sorted(far[i])[1] and far[:, far[i].argmin()].argmin() == i]
    i, j, d, _ = keypoints.agreed(a, b)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) >= 10 and (d == far[i, j]).all()


def test_every_image_has_a_row(spark):
    rows = [_row("plain", np.full((90, 90), 7, np.uint8)), _row("none", None), _row("full", texture(90, 110)), _row("tiny", texture(4, 4))]
    got = {r["id"]: r for r in keypoints.detected(spark.createDataFrame(rows, SHAPE), "id").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"plain": "featureless", "none": "no_pixels", "full": None, "tiny": "featureless"}
    full = got["full"]
    assert len(full["keypoints"]) > 100 and all(0 <= p["x"] < 110 and 0 <= p["y"] < 90 and len(p["descriptor"]) == 32 for p in full["keypoints"])
    assert keypoints.points(keypoints.detected(spark.createDataFrame(rows[:2], SHAPE), "id"), "id").count() == 0


def test_pairs_from_pixels_to_reasons(spark):
    image = texture(130, 160)
    turned, mirror = np.rot90(image), image[:, ::-1]
    rows = [_row("a", image), _row("turned", turned), _row("mirror", mirror), _row("other", texture(130, 160, 77)), _row("plain", np.full((80, 80), 9, np.uint8)), _row("none", None)]
    pairs = spark.createDataFrame([("a", k) for k in ("turned", "mirror", "other", "plain", "none", "missing")], "a string, b string")
    got = {r["b"]: r for r in compare.compared(spark.createDataFrame(rows, SHAPE), pairs, "id", scale=2.0).collect()}
    assert set(got) == {"turned", "mirror", "other", "plain", "none", "missing"}
    assert {k: r["reason"] for k, r in got.items() if k in ("turned", "mirror", "plain", "none", "missing")} == {"turned": "none", "mirror": "none", "plain": "too_few_keypoints", "none": "too_few_keypoints", "missing": "too_few_keypoints"}
    assert got["other"]["reason"] not in ("none", "too_few_keypoints") and got["other"]["h0"] is None and not got["other"]["reflected"]
    assert not got["turned"]["reflected"] and abs(got["turned"]["rotation_deg"] + 90) < 1 and not got["turned"]["flip"] and got["turned"]["matched_area"] > 0.2
    assert got["mirror"]["reflected"] and got["mirror"]["flip"] and abs(got["mirror"]["scale_x"] - 1) < 0.02
    h = np.asarray([got["mirror"][f"h{k}"] for k in range(9)]).reshape(3, 3)
    place = h @ (30.0, 40.0, 1.0)
    assert np.abs(place[:2] / place[2] - (129.0, 40.0)).max() < 1
    assert all(r["explanation"] for r in got.values())


def test_maps_between_files(spark):
    h = np.asarray([[0.9, -0.3, 40.0], [0.25, 1.1, -12.0], [2e-4, -1e-4, 1.0]])
    shape = "a double, b double, " + ", ".join(f"h{k} double" for k in range(9))
    from pyspark.sql import functions as F

    r = compare.rescaled(spark.createDataFrame([(0.5, 0.25, *h.ravel().tolist())], shape), F.col("a"), F.col("b")).first()
    own = np.asarray([r[f"h{k}"] for k in range(9)]).reshape(3, 3)
    p = np.asarray([120.0, 80.0, 1.0])
    small, whole = h @ (p * (0.5, 0.5, 1)), own @ p
    assert np.allclose(whole[:2] / whole[2], small[:2] / small[2] / 0.25)


def test_clusters_in_five_dimensions(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in ("p", "q"):
        for centre in rng.normal(0, 0.5, (3, 5)):
            rows += [(g, *x) for x in (centre + rng.normal(0, 0.015, (25, 5))).tolist()]
        rows += [(g, *x) for x in rng.uniform(-1, 1, (60, 5)).tolist()]
    # near in the first two axes only
    rows += [("q", 5.0, 5.0, float(k), 0.0, 0.0) for k in range(8)]
    rows = [(k, *r) for k, r in enumerate(rows)]
    axes = tuple(f"f{k}" for k in range(5))
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(spark.createDataFrame(rows, "id long, g string, " + ", ".join(f"{a} double" for a in axes)), 0.08, 6, axes, ("g",)).collect()}
    x = np.asarray([r[2:] for r in rows])
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2) + 9 * (np.asarray([r[1] for r in rows])[:, None] != np.asarray([r[1] for r in rows])[None])
    near = far <= 0.08**2
    core = near.sum(axis=1) >= 6
    want, label = {}, np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = np.asarray([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        around = label[near[i] & core]
        want[i] = int(label[i]) if core[i] else int(around.min()) if len(around) else -1
    assert got == want and len({v for v in want.values() if v >= 0}) == 6


def test_lobes():
    mask = copymove.lobe(np.asarray([[40.0, 40.0], [64.0, 40.0]]), np.asarray([31.0, 31.0]), (90, 120), 9)
    # the gap between the disks is closed where it is narrow
    assert mask[40, 52] and mask[29, 52] and mask[40, 24] and not mask[40, 22] and not mask[65, 40] and not mask[20, 52]
    alone = copymove.lobe(np.asarray([[30.0, 30.0]]), np.asarray([0.0]), (60, 60), 9)
    yy, xx = np.mgrid[0:60, 0:60]
    assert (alone >= ((yy - 30) ** 2 + (xx - 30) ** 2 <= 81)).all() and alone.sum() <= 1.1 * np.pi * 81
    edge = copymove.lobe(np.asarray([[0.0, 0.0]]), np.asarray([4.0]), (40, 40), 5)
    assert edge[0, 0] and edge[0, 5] and not edge[7, 7]


def test_copies_within_an_image(spark):
    scene = (texture(200, 260, 12) // 3 + 60).astype(np.uint8)
    patch = texture(70, 70, 5)
    image = scene.copy()
    image[20:90, 20:90] = patch
    image[110:180, 160:230] = patch
    rows = [_row("copied", image), _row("plain", np.full((90, 90), 9, np.uint8)), _row("clean", texture(120, 150, 41)), _row("none", None)]
    each, labels = copymove.copied(spark.createDataFrame(rows, SHAPE), "id", scale=2.0)
    got = {r["id"]: r for r in each.collect()}
    assert set(got) == {"copied", "plain", "clean", "none"} and {k for k, r in got.items() if r["detected"]} == {"copied"}
    region = got["copied"]["regions"][0]
    assert abs(region["dx"] - 140) < 2 and abs(region["dy"] - 90) < 2 and not region["flip"] and abs(region["rotation_deg"]) < 2
    source, target = region["source_box"], region["target_box"]
    assert source["x"] < 60 < source["x"] + source["width"] and target["x"] < 195 < target["x"] + target["width"]
    assert 1000 < region["area"] < 2 * 95 * 95
    marked = labels.where("id = 'copied' and region = 0")
    assert marked.count() == region["inliers"] and labels.where("id = 'plain'").count() == 0
