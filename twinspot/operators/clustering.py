"""Density clustering of points without a cross join: a grid narrows the neighbours, labels spread to their minimum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def _kept(df: DataFrame) -> DataFrame:
    return kept(df, "labels")


def neighbours(points: DataFrame, eps: float, axes: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = (), others: DataFrame | None = None) -> DataFrame:
    """id, other: pairs within ``eps`` over all axes, each way and with itself, of one group; ``points`` has id, the axes and the groups.

    Cells are of the first two axes, whatever their number: two points within ``eps`` are so on each of them, and the other axes are
    compared where cells meet. So a point is listed in nine cells, not in three to the power of the axes. With ``others``, points like
    ``points``, each pair is one of each; what they have under the names ``node`` comes along, as ``node`` and ``other_node``.
    """
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    first, second = axes[:2]
    others = points if others is None else others
    node = "node" in points.columns and "node" in others.columns
    placed = lambda rows: rows.select("id", *(["node"] if node else []), *by, *axes, cell(first).alias("_cx"), cell(second).alias("_cy"))
    a, o = placed(points), placed(others)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    named = ["other", *(["other_node"] if node else [])]
    b = o.select(F.col("id").alias("other"), *([F.col("node").alias("other_node")] if node else []), *by, *[F.col(c).alias(f"_o_{c}") for c in axes], "_cx", "_cy", near)
    b = b.select(*named, *by, *[f"_o_{c}" for c in axes], (F.col("_cx") + F.col("d.dx")).alias("_cx"), (F.col("_cy") + F.col("d.dy")).alias("_cy"))
    far = reduce(lambda s, x: s + x, [(F.col(c) - F.col(f"_o_{c}")) * (F.col(c) - F.col(f"_o_{c}")) for c in axes])
    return a.join(b, [*by, "_cx", "_cy"]).where(far <= eps * eps).select("id", *(["node"] if node else []), *named)


def dbscan(points: DataFrame, eps: float, min_samples: int, axes: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    """id, cluster: the smallest core id of the cluster, or -1 for noise. Border points go to the smallest cluster near.

    ``by`` names columns whose groups are clustered apart; ids are unique over all.
    """
    # pairs within eps grow with the square of a dense place's points, so they are counted and made distinct where they meet, and never kept
    side = eps / len(axes) ** 0.5 * (1 - 1e-9)
    cell = [F.floor(F.col(c) / side).cast("long").alias(f"_cell{k}") for k, c in enumerate(axes)]
    at = [*by, *[f"_cell{k}" for k in range(len(axes))]]
    # all points of a cell whose diagonal is shorter than eps are neighbours: enough of them are core without a count
    own = Window.partitionBy(*at)
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, *axes)])
    seen = _kept(points.select("id", *by, *axes, *cell).withColumn("full", whole & (F.count("*").over(own) >= min_samples)).drop(*at[len(by) :]))
    near = neighbours(seen.where("not full"), eps, axes, by, seen).groupBy("id").agg(F.count("*").alias("n"))
    marked = _kept(seen.join(near, "id", "left").withColumn("core", F.col("full") | (F.coalesce("n", F.lit(0)) >= min_samples)).drop("n", "full"))
    # core points of such a cell are one node, named by the smallest
    core = marked.where("core").select("id", *by, *axes, *cell)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in at]
    first = core.groupBy(*at).agg(F.min("id").alias("node"))
    core = _kept(core.alias("l").join(first.alias("r"), same).select(*[F.col(f"l.{c}") for c in ("id", *by, *axes)], "node"))
    edges = _kept(neighbours(core, eps, axes, by, core).select(F.col("node").alias("id"), F.col("other_node").alias("other")).distinct())
    labels = _kept(core.select(F.col("node").alias("id"), F.col("node").alias("cluster")).distinct())
    while True:
        spread = edges.join(labels.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
        # a label is itself a node: its own label is at least as small
        leap = spread.join(labels.select(F.col("id").alias("_id"), F.col("cluster").alias("_c")), F.col("cluster") == F.col("_id"))
        new = _kept(leap.select("id", F.least("cluster", "_c").alias("cluster")))
        changed = new.join(labels.withColumnRenamed("cluster", "_old"), "id").where("cluster != _old")
        if changed.isEmpty():
            break
        labels = new
    own = _kept(core.join(labels.select(F.col("id").alias("node"), "cluster"), "node"))
    # others have fewer than min_samples neighbours
    loose = neighbours(marked.where("not core"), eps, axes, by, own)
    border = loose.join(own.select(F.col("id").alias("other"), F.col("cluster").alias("_c")), "other").groupBy("id").agg(F.min("_c").alias("border"))
    out = points.select("id").join(own.select("id", "cluster"), "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("cluster", "border", F.lit(-1)).alias("cluster"))
