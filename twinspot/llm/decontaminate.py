"""Benchmark decontamination with DataFrame functions alone.

Texts are lower-cased in A-Z and cut into words. Every window of ``WINDOW`` consecutive words of a benchmark
item (the whole item, where it has fewer words) goes into a hash set; every position of every document is looked
up in it by a hash of the words that start there, and each hit is confirmed on the words themselves. The set is
broadcast while its measured size is within ``BROADCAST_BYTES``; beyond that the same join is shuffled on the
window's hash. There, equal windows of the set are one row, and where many documents hold one window, it is theirs that
Spark's adaptive execution splits. The list of items by window is measured on its own and broadcast under the same limit.

A null text has no words and is clean; an empty benchmark leaves all documents clean. Rows with equal doc_id and
text share one answer, and each comes out. Items without an item_id still mark words, but aren't listed. Very long
texts are searched whole. An empty table of documents gives no rows. Further columns of either table are not read;
``without_documents`` and ``without_spans`` return those of the documents, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, written

WINDOW = 10
#: Broadcast limit for the benchmark's windows, as their words take up.
BROADCAST_BYTES = 48 << 20

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


def words_of(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(low, _GAP), ""), F.array().cast("array<string>"))


def _count_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, _GAP_ANY_CASE), "")), F.lit(0)).cast("long")


def _hash_at(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n, words of each distinct window of each item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    n = F.least(F.size("all"), F.lit(window))
    starts = items.select("item_id", "all", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("all") - n + 1)).alias("at"))
    return starts.select("item_id", "n", F.slice("all", F.col("at"), F.col("n")).alias("words")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, _text, at, items: the rows of ``docs`` with a hit, the places of the hit words, the sorted item ids."""
    listed = windows(benchmark, window)
    distinct = listed.select("n", "words").distinct()
    # at most ``window`` lengths, and two numbers
    sizes = distinct.groupBy("n").agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("words", " "))).alias("bytes")).collect()
    small = sum(r["bytes"] + 64 * r["rows"] for r in sizes) <= broadcast_bytes
    lengths = sorted(r["n"] for r in sizes) or [window]
    # a window may have any number of items, so their list is measured by itself
    held = listed.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("words", " ")) + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0))).alias("bytes")).first()
    few_owners = (held["bytes"] or 0) + 64 * held["rows"] <= broadcast_bytes

    sought = distinct.select(F.col("n").alias("_n"), F.col("words").alias("_sought"))
    sought = sought.withColumn("_hash", F.coalesce(*[F.when(F.col("_n") == n, _hash_at(F.col("_sought"), F.lit(0), n)) for n in lengths]))
    texts = docs.select("doc_id", text_key().alias("_text"), words_of(F.col("text")).alias("_words"))
    # equal, in a form that stays a condition on the hash's matches and doesn't become a key worked out for every row
    same = lambda a, b: (a >= b) & (a <= b)

    def of_length(n: int) -> DataFrame:
        # the outer form only because Spark infers a filter from the other, which would cut every text twice
        each = texts.select("doc_id", "_text", "_words", F.posexplode_outer("_words").alias("_at", "_word"))
        each = each.where(F.col("_at") + n <= F.size("_words")).withColumn("_hash", _hash_at(F.col("_words"), F.col("_at"), n))
        here, own = F.slice("_words", F.col("_at") + 1, n), sought.where(F.col("_n") == n)
        if small:
            # one stage from the text to the join: a word's row is never stored with the words that it refers to
            found = each.join(F.broadcast(own), "_hash").where(same(F.col("_sought"), here))
        else:
            found = each.select("doc_id", "_text", "_at", "_hash", here.alias("_here")).join(own, "_hash").where(same(F.col("_sought"), F.col("_here")))
        return found.select("doc_id", "_text", "_at", F.lit(n).alias("_len"), "_sought")

    # items shorter than a window add a pass for each of their lengths
    found = reduce(DataFrame.union, map(of_length, lengths))
    # hits are few; written, they are found once for both of the following
    found = written(found, "benchmark-hits")

    span = lambda x: F.sequence(x["_at"], x["_at"] + x["_len"] - 1)
    marked = found.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("_at", "_len")).alias("_spans"))
    marked = marked.select("doc_id", "_text", F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", span)))).alias("at"))
    owners = listed.select(F.col("words").alias("_sought"), "item_id")
    named = found.select("doc_id", "_text", "_sought").distinct().join(F.broadcast(owners) if few_owners else owners, "_sought")
    named = named.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return _same_row(marked, named, "left").select("doc_id", "_text", "at", "items")


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, _text), where a null doc_id equals a null."""
    right = right.withColumnsRenamed({"doc_id": "_id", "_text": "_other"})
    return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & left["_text"].eqNullSafe(right["_other"]), how).drop("_id", "_other")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``."""
    base = docs.select("doc_id", text_key().alias("_text"), _count_words(F.col("text")).alias("n_words"))
    joined = _same_row(base, hits(docs, benchmark, window), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size("at")).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, how: str) -> DataFrame:
    """row, text, at: each row of ``docs`` in a struct, so that its names can't meet those in use here."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_own"), text_key().alias("_own_key"))
    marks = hits(docs, benchmark, window).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_other"), "at")
    return rows.join(marks, rows["_own"].eqNullSafe(marks["_id"]) & rows["_own_key"].eqNullSafe(marks["_other"]), how)


def without_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    return _marked(docs, benchmark, window, "left_anti").select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words, and what stands between a hit word and the next word, cut from the texts."""
    at, text = F.col("at"), F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(_WORD_ANY_CASE), F.lit(1))
    gaps = F.split(text, _WORD_ANY_CASE)
    left = F.transform(words, lambda w, k: F.when(F.array_contains(at, k), "").otherwise(F.concat(w, F.get(gaps, k + 1))))
    cut = F.when(at.isNull(), text).otherwise(F.concat(F.get(gaps, F.lit(0)), F.array_join(left, "")))
    return _marked(docs, benchmark, window, "left").select(*[(cut if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
