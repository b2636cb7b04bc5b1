"""Vector codes: each part of a vector is the number of its nearest codebook entry, fitted by ball k-means.

Components become whole numbers ``floor(SCALE * x)``, vectors are cut into ``PARTS`` equal parts, and a part position's codebook starts
as that part of the ``ENTRIES`` smallest vec_ids. A round assigns all parts and replaces each entry by the floor of its parts'
mean; unused entries stay. After ``ROUNDS`` rounds the parts are assigned again.

An entry's ball holds the parts assigned to it; its radius is the largest distance of these from the entry. After
a round the radius grows by no more than the entry's way, so one job gives sums, counts and radii alike. Only entries nearer than two
radii are a ball's neighbours. A part nearer to its entry than half of the way to the nearest neighbour lies in
the stable core and keeps its entry without looking at any; further out, the ring in which it lies tells which of the
neighbours, by distance, can be as near. These are compared exactly, ties to the lower number; all numbers are whole, so a
part's entry is that of a full comparison. The first round has no balls and compares all.

Each round reads the parts with their codes from a table in the shared folder and writes the next one. Tasks send a
row for each entry that they use; an entry's sums, 1,024 rows for 4 parts of 256 entries, come to the driver, and the codebooks go to all
tasks: both are bounded by the parameters, whatever the number of vectors.

Rows whose vector is null, or holds null or non-finite components, are dropped. So are vectors that can't take part in whole numbers
of 64 bits or in equal parts: with a component beyond ``+-WIDEST``, of a length other than the first kept vec_id's, or
when that length is no multiple of ``PARTS``. Null vec_ids are coded but start no entry; of repeated vec_ids the smaller vectors
come first, and each row comes out. With fewer vectors than entries, codebooks are as short. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: With components up to this, errors of vectors of up to 64 components are numbers of 64 bits.
WIDEST = 131_071
#: Rows compared at once.
ROWS = 2_048

_STATE = "vec_id bigint, label int, parts binary, codes binary"
_SUMS = "part int, entry int, n bigint, radius bigint, sums array<bigint>"


@dataclass(frozen=True)
class Balls:
    """Codebooks (part, entry, component), the square radius of each entry's ball, or None before the first round."""

    entries: np.ndarray
    radius: np.ndarray | None = None

    def neighbours(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """For each entry, all entries by distance, and their square distances; those out of the ball's reach are put at no distance's end."""
        own = self.entries[part]
        apart = ((own[:, None, :] - own[None, :, :]) ** 2).sum(axis=2)
        if self.radius is not None:
            # a part of the ball is at most its radius away, so an entry further than two radii is never as near
            apart = np.where(apart > 4 * self.radius[part][:, None], np.iinfo(np.int64).max, apart)
        np.fill_diagonal(apart, -1)
        order = np.argsort(apart, axis=1, kind="stable")
        return order, np.take_along_axis(apart, order, axis=1)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, by comparing all."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 22:
        # whole numbers under 2**53 stay exact
        cross = x.astype(np.float64) @ entries.T.astype(np.float64)
        return np.argmin((entries**2).sum(axis=1) - 2 * cross, axis=1)
    return np.argmin(np.stack([_square(x, e) for e in entries], axis=1), axis=1)


def reassigned(x: np.ndarray, code: np.ndarray, entries: np.ndarray, order: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, by the ball that it is in: order and apart from ``Balls.neighbours``."""
    best = _square(x, entries[code])
    out = code.copy()
    # an entry is as near only if it is at most twice as far from the own entry as the row is; the first is the own one
    reach = np.zeros(len(x), np.int64)
    for k in np.unique(code):
        here = np.flatnonzero(code == k)
        reach[here] = np.searchsorted(apart[k], 4 * best[here], side="right")
    far = np.flatnonzero(reach > 1)
    for ring in range(1, int(reach.max(initial=1))):
        far = far[reach[far] > ring]
        other = order[code[far], ring]
        distance = _square(x[far], entries[other])
        better = (distance < best[far]) | ((distance == best[far]) & (other < out[far]))
        best[far[better]], out[far[better]] = distance[better], other[better]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data, _ = buffers(column)
    return data.view(np.int32).reshape(-1, PARTS, width).astype(np.int64)


def _assigned(balls: Balls, width: int, neighbours: list | None):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                x = _matrix(batch.column(2), width)
                codes = np.empty((len(x), PARTS), np.uint8)
                old = None if neighbours is None else buffers(batch.column(3))[0].reshape(-1, PARTS)
                for p in range(PARTS):
                    codes[:, p] = nearest(x[:, p], balls.entries[p]) if old is None else reassigned(x[:, p], old[:, p].astype(np.int64), balls.entries[p], *neighbours[p])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary())], batch.schema.names)

    return assigned


def _summed(balls: Balls, width: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part and entry that the task's rows use."""
        size = balls.entries.shape[1]
        n, sums, radius = np.zeros((PARTS, size), np.int64), np.zeros((PARTS, size, width), np.int64), np.zeros((PARTS, size), np.int64)
        for batch in batches:
            x, codes = _matrix(batch.column(0), width), buffers(batch.column(1))[0].reshape(-1, PARTS)
            for p in range(PARTS):
                n[p] += np.bincount(codes[:, p], minlength=size)
                np.add.at(sums[p], codes[:, p], x[:, p])
                np.maximum.at(radius[p], codes[:, p], _square(x[:, p], balls.entries[p][codes[:, p]]))
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(radius[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
        ], ["part", "entry", "n", "radius", "sums"])

    return summed


def _moved(balls: Balls, state: DataFrame, width: int) -> Balls:
    """Entries at the floor of their parts' means, with radii that are large enough for all parts assigned to them."""
    partial = state.select("parts", "codes").mapInArrow(_summed(balls, width), _SUMS)
    wide = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *wide).collect()
    entries, radius = balls.entries.copy(), np.zeros(balls.entries.shape[:2], np.int64)
    for r in rows:
        at = r["part"], r["entry"]
        entries[at] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
        way = int(_square(entries[at], balls.entries[at]))
        # |x - new| <= |x - old| + |old - new|, rounded up
        radius[at] = min(np.iinfo(np.int64).max // 4, (np.ceil(np.sqrt(float(r["radius"])) + np.sqrt(float(way))) + 1).astype(np.int64) ** 2)
    return Balls(entries, radius)


def _whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: vectors of whole numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where(x.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    inside = F.forall("v", lambda c: F.abs(c) <= float(SCALE * WIDEST))
    return kept.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v")).where(inside)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in flat], pa.binary()), pa.nulls(batch.num_rows, pa.binary())], ["vec_id", "label", "parts", "codes"])


def fitted(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, parts, codes) of each kept row of ``vectors`` (vec_id, embedding, label), and the codebooks."""
    whole = _whole(vectors)
    spark = vectors.sparkSession
    # the only rows that come to the driver whole: as many as a codebook has entries
    first = whole.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(1).collect()
    length = len(first[0]["v"]) if first else 0
    if not length or length % PARTS:
        return spark.createDataFrame([], _STATE), np.zeros((PARTS, 0, 0), np.int64)
    whole = whole.where(F.size("v") == length)
    head = whole.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(ENTRIES).select("v").collect()
    width = length // PARTS
    balls = Balls(np.asarray([r["v"] for r in head], np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2).copy())
    state = whole.mapInArrow(_packed, _STATE)
    for k in range(ROUNDS + 1):
        neighbours = None if balls.radius is None else [balls.neighbours(p) for p in range(PARTS)]
        state = written(state.mapInArrow(_assigned(balls, width, neighbours), _STATE), f"codes-{k}")
        if k < ROUNDS:
            balls = _moved(balls, state, width)
    return state, balls.entries


def _errors(entries: np.ndarray):
    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(PARTS)
        for batch in batches:
            x, codes = _matrix(batch.column(2), entries.shape[2]), buffers(batch.column(3))[0].reshape(-1, PARTS)
            error = _square(x, entries[part, codes]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return errors


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each kept row."""
    state, entries = fitted(vectors)
    rows = written(state.mapInArrow(_errors(entries), "vec_id bigint, label int, code string, error bigint"), "codes")
    # a table as small as the labels are few; Spark broadcasts it if its measured size allows
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    out = rows.join(sums, rows["label"].eqNullSafe(sums["_label"]))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def decoded(codes: DataFrame, entries: np.ndarray) -> DataFrame:
    """``codes`` (code) with ``approximate``, the vector that a code stands for."""
    book = F.array(*[F.array(*[F.lit((e / SCALE).tolist()) for e in part]) for part in entries])
    at = lambda k: F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximate", F.flatten(F.array(*[F.get(F.get(book, F.lit(k)), at(k)) for k in range(PARTS)])))
