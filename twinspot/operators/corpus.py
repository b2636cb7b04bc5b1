"""Corpus preparation: digests, duplicate groups, leak-free splits, and file layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from .shared import kept


def digests(rows: DataFrame, path: str, content: str) -> DataFrame:
    """path, digest of each row's content."""
    return rows.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """digest, path (the first), duplicates (how many others) for each content."""
    return files.groupBy("digest").agg(F.min("path").alias("path"), (F.count("*") - 1).alias("duplicates"))


def manifest(files: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row per content with its split. A content with any held-out file goes to test; splits are by content alone,
    so the same bytes under two names cannot lie on both sides."""
    out = F.lit(False) if held_out is None else held_out
    own = files.withColumn("_out", out).groupBy("digest").agg(F.min("path").alias("path"), (F.count("*") - 1).alias("duplicates"), F.max("_out").alias("_out"))
    return own.select("digest", "path", "duplicates", F.when(F.col("_out"), "test").otherwise(X.split_of(F.col("digest"))).alias("split"))


def leaked(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Digests on both sides."""
    return train.select("digest").intersect(evaluation.select("digest"))


def accepted(path: Column, image_dirs: list[str], exclude_dirs: list[str]) -> Column:
    """Whether a layout takes a path: some parent is one of the image folders and none is excluded, by whole names."""
    parts = F.transform(F.split(path, "/"), lambda x: F.lower(x))
    parents = F.slice(parts, 1, F.size(parts) - 1)
    inside = F.arrays_overlap(parents, F.array(*map(F.lit, image_dirs))) if image_dirs else F.lit(True)
    outside = F.arrays_overlap(parents, F.array(*map(F.lit, exclude_dirs))) if exclude_dirs else F.lit(False)
    return inside & ~outside


def open_jobs(starts: DataFrame, lane: str, job: str, lasting: int) -> DataFrame:
    """lane, job, at, open: jobs of the lane that are open at each start, itself included; an end at that time comes first."""
    steps = starts.select(lane, job, "at", F.lit(1).alias("step")).union(starts.select(lane, job, F.col("at") + lasting, F.lit(-1)))
    order = Window.partitionBy(lane).orderBy("at", "step", job).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("step").over(order)).where("step = 1").drop("step")


def duplicate_paths(files: DataFrame) -> DataFrame:
    """digest, path (the first), others (the rest, in order) of contents that more than one path has.

    A content's paths are one list: as long as its copies are many.
    """
    own = files.groupBy("digest").agg(F.array_sort(F.collect_set("path")).alias("_paths")).where(F.size("_paths") > 1)
    return own.select("digest", F.get("_paths", F.lit(0)).alias("path"), F.slice("_paths", F.lit(2), F.size("_paths")).alias("others"))


def placed_paths(entries: DataFrame) -> DataFrame:
    """``entries`` (split, path) with ``place``, from 0 on in the order of paths within a split.

    Rows are sorted over all tasks; a place is a row's number in its task and split, and what the tasks before hold of that split.
    """
    ordered = kept(entries.orderBy("split", "path").withColumn("_at", F.monotonically_increasing_id()), "paths")
    tasked = ordered.withColumn("_task", F.shiftright("_at", 33))
    # a row for each task and split
    sizes = tasked.groupBy("split", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("split").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = tasked.join(before.select("split", "_task", "_first", "_before"), ["split", "_task"])
    return out.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_task", "_at", "_first", "_before")


def write_manifest(entries: DataFrame, folder: str) -> None:
    """Store digest, path, duplicates and split of each content, by split and path, as JSON lines that Spark writes."""
    entries.select("digest", "path", "duplicates", "split").orderBy("split", "path").write.json(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """digest, path, duplicates, split; a manifest that lacks one of them, or names another split, is an error."""
    rows = spark.read.json(folder)
    if missing := {"digest", "path", "duplicates", "split"} - set(rows.columns):
        raise ValueError(f"{folder} is no manifest: it lacks {', '.join(sorted(missing))}")
    if not rows.where(F.col("split").isNull() | ~F.col("split").isin(*[n for n, _ in X.SPLITS])).isEmpty():
        raise ValueError(f"{folder} names a split that there isn't")
    return rows.select("digest", "path", "duplicates", "split")


#: Folder names by which a layout is told, and its image and excluded folders.
LAYOUTS = {"BBBC038": (("images",), ("masks",))}


def layout_of(paths: DataFrame) -> str:
    """The layout of files by their paths: one whose image folders and excluded folders both occur; FLAT if none does."""
    parts = paths.select(F.explode(F.split(F.lower("path"), "/")).alias("part"))
    known = sorted({p for image, other in LAYOUTS.values() for p in (*image, *other)})
    held = {r["part"] for r in parts.where(F.col("part").isin(*known)).distinct().collect()}
    return next((name for name, (image, other) in LAYOUTS.items() if held & set(image) and held & set(other)), "FLAT")


def cases(paths: DataFrame, suffixes: list[str]) -> DataFrame:
    """base, changed, suffix: benchmark cases by names. A file whose stem ends in a suffix is a changed copy of the file with the stem before it."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    suffix = F.coalesce(*[F.when(F.col("_stem").endswith(s), F.lit(s)) for s in sorted(suffixes, key=len, reverse=True)])
    own = paths.select("path", stem.alias("_stem")).withColumn("suffix", suffix)
    changed = own.where("suffix is not null").select(F.col("path").alias("changed"), "suffix", F.expr("substring(_stem, 1, length(_stem) - length(suffix))").alias("_stem"))
    # of files with one stem, the first by name
    bases = own.where("suffix is null").groupBy("_stem").agg(F.min("path").alias("base"))
    return bases.join(changed, "_stem").select("base", "changed", "suffix")


def kept_jobs(events: DataFrame, lasting: int, most: int, open_states: tuple[str, ...]) -> DataFrame:
    """store, job, status, why of each job at the last event of all: kept, expired (as old as ``lasting``, unless open), or evicted: before the ``most`` newest.

    ``events`` has store, job, status, at, event_id. A store's newest are cut in each task before they meet.
    """
    own = events.groupBy("store", "job").agg(F.min("at").alias("_put"), F.max("at").alias("_last"), F.max_by("status", F.struct("at", "event_id")).alias("status"))
    now = events.agg(F.max("at").alias("_now"))
    aged = own.crossJoin(now).withColumn("_old", (F.col("_last") <= F.col("_now") - lasting) & ~F.col("status").isin(*open_states))
    newest = aged.where("not _old").withColumn("_k", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("_put"), F.desc("job")))).where(F.col("_k") <= most)
    why = F.when(F.col("_old"), "expired").when(F.col("_k").isNull(), "evicted").otherwise("kept")
    return aged.join(newest.select("store", "job", "_k"), ["store", "job"], "left").select("store", "job", "status", why.alias("why"))
