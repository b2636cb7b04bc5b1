"""Robust fits of maps to matched points: hypotheses from a bounded sample, votes by all points, refit on the inliers.

``points`` has a key and x, y, u, v. A key's first ``SAMPLE`` points by hash make hypotheses, in one task, and the best
``KEPT`` of them on that sample go on. All points of the key then vote in an aggregate that Spark combines before its
shuffle, so a key of any number of points is never gathered. The winner's inliers are fitted by normal equations, whose
sums are aggregates too.

A map has nine numbers h0 to h8, by rows: u = (h0 x + h1 y + h2) / (h6 x + h7 y + h8), v likewise from h3 to h5. Keys with
too few points, or with points on a line only, have no row. Points with a null coordinate are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, KEPT = 200, 8
#: Draws at most, draws of a batch, and the sureness at which drawing ends.
DRAWS, BATCH, SURE = 10_000, 500, 0.999
#: Maps that are tried at once, and tasks for each core.
SOME, TASKS = 32, 4
#: Points that settle a map.
NEEDED = {"affine": 3, "homography": 4}
MAP = [f"h{k}" for k in range(9)]


def solved(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, model: str) -> np.ndarray:
    """Maps (draws, 9) through the points of each draw; arrays are (draws, points). Singular draws are left out."""
    n, k = x.shape
    zero, one = np.zeros_like(x), np.ones_like(x)
    size = 6 if model == "affine" else 8
    upper = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y][:size], 2)
    lower = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y][:size], 2)
    rows = np.concatenate([upper, lower], 1)[:, : 2 * k]
    right = np.concatenate([u, v], 1)
    good = np.abs(np.linalg.det(rows)) > 1e-9
    found = np.linalg.solve(rows[good], right[good][:, :, None])[:, :, 0]
    out = np.zeros((len(found), 9))
    out[:, :size], out[:, 8] = found, 1.0
    return out[np.isfinite(out).all(axis=1)]


def errors(maps: np.ndarray, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(maps, points): distances of the mapped points from where they belong; infinite where a map has none."""
    at, out = np.stack([x, y, np.ones_like(x)]), np.empty((len(maps), len(x)))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        # some maps at a time: their points stay in a core's cache
        for first in range(0, len(maps), SOME):
            du, dv, w = (maps[first : first + SOME].reshape(-1, 3) @ at).reshape(-1, 3, len(x)).transpose(1, 0, 2)
            du /= w
            dv /= w
            du -= u
            dv -= v
            du *= du
            dv *= dv
            np.sqrt(np.add(du, dv, out=du), out=out[first : first + SOME])
    out[np.isnan(out)] = np.inf
    return out


def _refitted(maps: np.ndarray, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, model: str, threshold: float) -> np.ndarray:
    """Each map fitted again to the points near it, twice, first to those within twice the threshold; it stays where these settle none."""
    out, size = maps.copy(), 6 if model == "affine" else 8
    zero, one = np.zeros_like(x), np.ones_like(x)
    upper = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y][:size], 1)
    lower = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y][:size], 1)
    for wide in (2.0, 1.0):
        for k, inside in enumerate(errors(out, x, y, u, v) <= wide * threshold):
            if np.count_nonzero(inside) <= NEEDED[model]:
                continue
            found, _, rank, _ = np.linalg.lstsq(np.concatenate([upper[inside], lower[inside]]), np.concatenate([u[inside], v[inside]]), rcond=None)
            if rank == size:
                out[k, :size], out[k, 8] = found, 1.0
    return out


def drawn(points: np.ndarray, seed: int, model: str, threshold: float) -> np.ndarray:
    """The best maps of random draws from ``points`` (n, 4), by the points within the threshold.

    Drawing goes on until a draw without outliers was missed with a probability of 1 - ``SURE`` only, at the largest share of inliers so far, or ``DRAWS``
    are made. The best of each batch are fitted again to the points near them.
    """
    n, k = len(points), NEEDED[model]
    if n < k:
        return np.zeros((0, 9))
    rng = np.random.default_rng(seed)
    # numbers of about 1 keep the equations well conditioned
    unit = max(1.0, np.abs(points).max())
    x, y, u, v = (points[:, c] / unit for c in range(4))

    def votes(maps: np.ndarray) -> np.ndarray:
        far = errors(maps, x, y, u, v)
        far *= unit
        near = np.count_nonzero(far <= threshold, axis=1)
        return near - np.minimum(far, threshold, out=far).mean(axis=1) / (threshold + 1)

    best, made, needed = np.zeros((0, 9)), 0, DRAWS
    while made < min(needed, DRAWS):
        at = rng.integers(0, n, (BATCH, k))
        ordered = np.sort(at, axis=1)
        at = at[(ordered[:, 1:] != ordered[:, :-1]).all(axis=1)]
        made += BATCH
        maps = solved(x[at], y[at], u[at], v[at], model) if len(at) else best[:0]
        first = maps[np.argsort(-votes(maps), kind="stable")[:KEPT]]
        pool = np.concatenate([best, first, _refitted(first, x, y, u, v, model, threshold / unit)])
        count = votes(pool)
        order = np.argsort(-count, kind="stable")[:KEPT]
        best = pool[order]
        share = max(0.0, float(count[order[0]]) / n) if len(order) else 0.0
        needed = DRAWS if share <= 0 else np.log(1 - SURE) / np.log(max(1e-12, 1 - min(share, 1 - 1e-9) ** k))
    best[:, [2, 5]] *= unit
    best[:, [6, 7]] /= unit
    return best


def error(x: str = "x", y: str = "y", u: str = "u", v: str = "v") -> Column:
    """Distance of a mapped point from its place, with the map in h0 to h8; null where the map has none."""
    h = [F.col(c) for c in MAP]
    w = F.nullif(h[6] * F.col(x) + h[7] * F.col(y) + h[8], F.lit(0.0))
    return F.hypot((h[0] * F.col(x) + h[1] * F.col(y) + h[2]) / w - F.col(u), (h[3] * F.col(x) + h[4] * F.col(y) + h[5]) / w - F.col(v))


def inverse(maps: DataFrame) -> DataFrame:
    """``maps`` with h0 to h8 turned to the inverse by cofactors; singular maps are left out."""
    h = [F.col(c) for c in MAP]
    minor = lambda a, b, c, d: h[a] * h[b] - h[c] * h[d]
    cofactors = [
        minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5),
        minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3),
    ]
    det = h[0] * cofactors[0] + h[1] * cofactors[3] + h[2] * cofactors[6]
    own = maps.withColumn("_det", det).where(F.abs("_det") > 1e-12)
    return own.withColumns({c: m / F.col("_det") for c, m in zip(MAP, cofactors, strict=True)}).drop("_det")


def hypotheses(points: DataFrame, key: str, model: str, threshold: float) -> DataFrame:
    """key, place, h0 to h8: up to ``KEPT`` maps of each key. The seed is the key's, so a rerun draws the same."""
    kind = points.schema[key].dataType.simpleString()
    spark = points.sparkSession
    # points are few in bytes and drawing takes long: Spark would join the tasks of thousands of keys to one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)
    first = Window.partitionBy(key).orderBy(F.xxhash64("x", "y", "u", "v"), "x", "y", "u", "v")
    sample = points.select(key, "x", "y", "u", "v").repartition(tasks, key).withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= SAMPLE)

    listed = sample.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_place", "x", "y", "u", "v"))).alias("points"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            at = lists.offsets.to_numpy()
            points = np.column_stack([lists.values.field(c).to_numpy(zero_copy_only=False) for c in range(1, 5)])
            found = [drawn(points[i:j], zlib.crc32(str(k.as_py()).encode()), model, threshold) for k, i, j in zip(keys, at[:-1], at[1:], strict=True)]
            sizes = [len(f) for f in found]
            flat = np.concatenate([*found, np.zeros((0, 9))])
            place = np.concatenate([*map(np.arange, sizes), np.zeros(0, int)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array(place), *map(pa.array, flat.T)], names=[key, "place", *MAP])

    return listed.mapInArrow(maps, f"`{key}` {kind}, place int, {', '.join(f'{c} double' for c in MAP)}")


def _normal(inliers: DataFrame, key: str, model: str, unit: float) -> DataFrame:
    """The least-squares map of each key's inliers: sums of the equations' products, then one small system a key."""
    kind = inliers.schema[key].dataType.simpleString()
    x, y, u, v = (F.col(c) / unit for c in ("x", "y", "u", "v"))
    zero, one = F.lit(0.0), F.lit(1.0)
    size = 6 if model == "affine" else 8
    upper = [x, y, one, zero, zero, zero, -u * x, -u * y][:size] + [u]
    lower = [zero, zero, zero, x, y, one, -v * x, -v * y][:size] + [v]
    places = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    sums = [F.sum(upper[i] * upper[j] + lower[i] * lower[j]).alias(f"s{i}_{j}") for i, j in places]
    own = inliers.groupBy(key).agg(F.count("*").alias("inliers"), *sums)

    def solve(batches):
        for rows in batches:
            full = np.zeros((len(rows), size + 1, size + 1))
            for i, j in places:
                full[:, i, j] = full[:, j, i] = rows[f"s{i}_{j}"].to_numpy(float)
            left, right = full[:, :size, :size], full[:, :size, size]
            good = np.linalg.matrix_rank(left, hermitian=True) == size
            out = np.zeros((int(good.sum()), 9))
            if len(out):
                out[:, :size] = np.linalg.solve(left[good], right[good][:, :, None])[:, :, 0]
            out[:, 8] = 1.0
            out[:, [2, 5]] *= unit
            out[:, [6, 7]] /= unit
            frame = pd.DataFrame(out, columns=MAP)
            frame.insert(0, "inliers", rows["inliers"].to_numpy()[good])
            frame.insert(0, key, pd.Series(rows[key].to_numpy()[good], dtype=object))
            yield frame

    return own.mapInPandas(solve, f"{key} {kind}, inliers bigint, {', '.join(f'{c} double' for c in MAP)}")


def fitted(points: DataFrame, key: str, model: str = "homography", threshold: float = 4.0, unit: float = 1000.0) -> DataFrame:
    """key, inliers, h0 to h8 of each key's map; ``inliers`` are those that the map is fitted to, within the threshold."""
    known = points.select(key, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]).dropna(subset=["x", "y", "u", "v"])
    guesses = hypotheses(known, key, model, threshold)
    votes = known.join(guesses, key).groupBy(key, "place").agg(
        F.count_if(error() <= threshold).alias("votes"), F.avg(F.least(F.coalesce(error(), F.lit(threshold)), F.lit(threshold))).alias("_far"), *[F.first(c).alias(c) for c in MAP]
    )
    best = votes.groupBy(key).agg(F.max_by(F.struct(*MAP), F.struct(F.col("votes"), -F.col("_far"), -F.col("place"))).alias("h")).select(key, "h.*")
    return _normal(known.join(best, key).where(error() <= threshold).drop(*MAP), key, model, unit)


def measured(points: DataFrame, maps: DataFrame, key: str, threshold: float = 4.0) -> DataFrame:
    """key, matches, inliers, ratio, rms of ``maps``: errors there and back over the points within the threshold.

    A singular map is measured forwards alone.
    """
    back = inverse(maps.select(key, *MAP)).select(key, *[F.col(c).alias(f"i{c}") for c in MAP])
    forward = points.join(maps.select(key, *MAP), key).withColumn("_there", error()).drop(*MAP)
    both = forward.join(back, key, "left").withColumnsRenamed({f"i{c}": c for c in MAP}).withColumn("_back", error("u", "v", "x", "y"))
    far = F.when(F.col("_back").isNull(), F.col("_there")).otherwise((F.col("_there") + F.col("_back")) / 2)
    inside = F.col("_there") <= threshold
    own = both.withColumn("_far", far).groupBy(key).agg(
        F.count("*").alias("matches"), F.count_if(inside).alias("inliers"), F.sqrt(F.avg(F.when(inside, F.col("_far") * F.col("_far")))).alias("rms")
    )
    return own.select(key, "matches", "inliers", (F.col("inliers") / F.col("matches")).alias("ratio"), "rms")


def conditioned(maps: DataFrame, diagonal: float) -> DataFrame:
    """Adds condition: of the map in units of the image's diagonal, the largest singular value over the smallest."""

    @F.pandas_udf("double")
    def ratio(h: pd.DataFrame) -> pd.Series:
        full = h[MAP].to_numpy(float).reshape(-1, 3, 3)
        full[:, :2, 2] /= diagonal
        full[:, 2, :2] *= diagonal
        s = np.linalg.svd(full, compute_uv=False) if len(full) else np.zeros((0, 3))
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.Series(np.where(s[:, 2] > 0, s[:, 0] / s[:, 2], np.inf))

    return maps.withColumn("condition", ratio(F.struct(*MAP)))
