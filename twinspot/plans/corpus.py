"""Queries over the corpus tables: digests, splits, leakage, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..sources import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.digests(table(spark, sf_dir, "documents"), "doc_id", "text")


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_groups(_files(spark, sf_dir)).where("duplicates > 0")


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest(_files(spark, sf_dir))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("train", "val", "calib", "test")], "split string")
    counts = corpus.manifest(_files(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))
    return names.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("files"))


def holdout_forced_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = corpus.digests(docs, "doc_id", "text").join(docs.select(F.col("doc_id").alias("path"), "source"), "path")
    return corpus.manifest(files, F.col("source").isin("src1", "src2")).groupBy("split").agg(F.count("*").alias("files"), F.sum("duplicates").alias("duplicates"))


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a split by name would leak: contents that are on both sides of doc_id % 10 < 8."""
    files = _files(spark, sf_dir)
    return corpus.leaked(files.where("path % 10 < 8"), files.where("path % 10 >= 8"))


def layout_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    depth = F.size(F.split("path", "/"))
    first = F.lower(F.element_at(F.split("path", "/"), 2))
    taken = corpus.accepted(F.col("path"), [], ["login", "tag", "search"])
    return pages.select("page_id", depth.alias("depth"), F.coalesce(first, F.lit("")).alias("top"), taken.alias("accepted"))


def case_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive cases: contents that occur under more than one source, with the source of the first as their base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    base = docs.groupBy("digest").agg(F.min(F.struct("doc_id", "source")).alias("base"))
    variants = docs.join(base, "digest").where(F.col("doc_id") != F.col("base.doc_id"))
    return variants.select(F.col("base.doc_id").alias("base_id"), F.col("doc_id").alias("variant_id"), (F.col("base.source") == F.col("source")).alias("same_source"))


def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources that share no content."""
    docs = table(spark, sf_dir, "documents").select("source", F.xxhash64("text").alias("h")).distinct()
    names = docs.select("source").distinct()
    other = docs.withColumnRenamed("source", "other")
    related = docs.join(other, "h").where("source < other").select("source", "other").distinct()
    pairs = names.join(names.withColumnRenamed("source", "other"), F.col("source") < F.col("other"))
    return pairs.join(related, ["source", "other"], "left_anti")


QUERIES = {
    f.__name__: f
    for f in (content_digest, duplicate_groups, split_assign, split_counts, holdout_forced_test, leakage_check, layout_discover, case_discovery, negative_controls)
}

_FILES = "f AS (SELECT doc_id AS path, source, sha256(text) AS digest FROM documents)"
_PLACE = "('0x' || substr(digest, 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_SPLIT = f"CASE WHEN {_PLACE} < 0.8 THEN 'train' WHEN {_PLACE} < 0.9 THEN 'val' WHEN {_PLACE} < 0.95 THEN 'calib' ELSE 'test' END"
_MANIFEST = f"{_FILES}, g AS (SELECT digest, min(path) AS path, count(*) - 1 AS duplicates, bool_or(source IN ('src1', 'src2')) AS held FROM f GROUP BY digest), m AS (SELECT *, {_SPLIT} AS split FROM g)"

ORACLE_SQL = {
    "content_digest": f"WITH {_FILES} SELECT path, digest FROM f",
    "duplicate_groups": f"WITH {_FILES} SELECT digest, min(path) AS path, count(*) - 1 AS duplicates FROM f GROUP BY digest HAVING count(*) > 1",
    "split_assign": f"WITH {_MANIFEST} SELECT digest, path, duplicates, split FROM m",
    "split_counts": f"WITH {_MANIFEST} SELECT s.split, count(m.split) AS files FROM (VALUES ('train'), ('val'), ('calib'), ('test')) s(split) LEFT JOIN m USING (split) GROUP BY s.split",
    "holdout_forced_test": f"WITH {_MANIFEST} SELECT CASE WHEN held THEN 'test' ELSE split END AS split, count(*) AS files, sum(duplicates)::BIGINT AS duplicates FROM m GROUP BY 1",
    "leakage_check": f"WITH {_FILES} SELECT digest FROM f GROUP BY digest HAVING bool_or(path % 10 < 8) AND bool_or(path % 10 >= 8)",
    "layout_discover": """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages)
SELECT page_id, len(parts)::INT AS depth, coalesce(lower(parts[2]), '') AS top, NOT list_has_any(list_transform(parts[1:len(parts) - 1], lambda x: lower(x)), ['login', 'tag', 'search']) AS accepted FROM p""",
    "case_discovery": f"""WITH {_FILES}, b AS (SELECT digest, min(path) AS base_id, arg_min(source, path) AS base_source FROM f GROUP BY digest)
SELECT base_id, path AS variant_id, base_source = source AS same_source FROM f JOIN b USING (digest) WHERE path <> base_id""",
    "negative_controls": """WITH d AS (SELECT DISTINCT source, text FROM documents), n AS (SELECT DISTINCT source FROM d)
SELECT a.source, b.source AS other FROM n a JOIN n b ON a.source < b.source WHERE NOT EXISTS (SELECT 1 FROM d x JOIN d y ON x.text = y.text WHERE x.source = a.source AND y.source = b.source)""",
}
