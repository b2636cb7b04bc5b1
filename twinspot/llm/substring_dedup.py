"""Substring dedup over words by sharded FM-indexes.

A window is ``WINDOW`` consecutive words. Its route is the smallest hash of the ``GRAM``-word grams in it, so equal
windows have one route, and consecutive windows of a document mostly share theirs: a segment is a run of windows
with one route. Segments whose route only one document has are done: none of their windows recurs. Of the others,
equal segments count once, with the smallest doc_id that has them. Routes go whole to shards; a shard builds an
FM-index over its segments' words and streams the segments through it. Every place at which the matching statistic
reaches ``WINDOW`` gives a suffix interval, and the smallest doc_id in the interval is the first document with that
window. Documents then drop the words of windows that a document of smaller doc_id has.

A route with more than ``SHARD_WORDS`` words of unequal segments would not fit a shard. Such a route (a passage in
very many surroundings) is dealt out by window instead: its windows are matched on a 128-bit hash of their words by
an aggregate that sums up in every task first. Words stand as two independent 64-bit hashes in all of this.

A null or empty text has no words. A row with null doc_id has no order: it is left whole and removes nothing. Rows
with equal doc_id count as one document. Repeated rows come out each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import buffers, pieces_of_batches, text_key, written
from .fm_index import FMIndex, statistics

WINDOW, GRAM = 50, 8
#: Words in a shard; bounds a task's memory.
SHARD_WORDS = 300_000

#: Shares into which the rows of one window are dealt.
SHARES = 64

_SEGMENTS = "doc_id bigint, _text bigint, route bigint, seg binary, start int, n int"
_WORDS = "route bigint, seg binary, first_id bigint, n int, words binary"
_FIRSTS = "route bigint, seg binary, firsts array<bigint>"
_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive values."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _digest(words: np.ndarray) -> bytes:
    """128 bits of a run of words, each with two hashes."""
    return hashlib.blake2b(words, digest_size=16).digest()


def segments(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(route, first window, windows) of each segment of one document's word hashes."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least(wordhash.grams(words, gram), window - gram + 1)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[start], start, np.diff(np.concatenate([start, [len(least)]]))


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word, side by side, and where each text's words begin."""
    starts, ends, text = wordhash.spans(data, offsets)
    return wordhash.pairs(data, starts, ends), np.searchsorted(text, np.arange(len(offsets)))


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of_batches(batches, "text", 1 << 20):
        words, at = _words_of(*buffers(batch.column(2)))
        parts, seg = [[], [], [], []], []
        for k in range(batch.num_rows):
            own = words[at[k] : at[k + 1]]
            route, start, n = segments(np.ascontiguousarray(own["first"]))
            if len(route):
                seg += [_digest(own[s:e]) for s, e in zip(start.tolist(), (start + n + WINDOW - 1).tolist(), strict=True)]
                for column, v in zip(parts, (np.full(len(route), k), route, start, n), strict=True):
                    column.append(v)
        if seg:
            row, route, start, n = (np.concatenate(p) for p in parts)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take), pa.array(route.astype(np.int64)), pa.array(seg, pa.binary()),
                pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
            ], ["doc_id", "_text", "route", "seg", "start", "n"])


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, list of (route, seg, start, n)) to a row for each segment with its words."""
    for batch in pieces_of_batches(batches, "text", 1 << 20):
        words, at = _words_of(*buffers(batch.column(1)))
        out = []
        for k, (doc_id, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            own = words[at[k] : at[k + 1]]
            out += [(s["route"], s["seg"], doc_id, s["n"], own[s["start"] : s["start"] + s["n"] + WINDOW - 1].tobytes()) for s in asked]
        if out:
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["route", "seg", "first_id", "n", "words"])


def _firsts_of(rows: list[tuple]) -> pa.RecordBatch:
    """Index the segments of a shard and find each window's first document."""
    texts = [np.frombuffer(r[4], wordhash.PAIR) for r in rows]
    flat, known = wordhash.numbered(np.concatenate(texts))
    ends = np.cumsum([len(t) for t in texts])
    parts = np.split(flat, ends[:-1])
    symbols = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int64))])
    owner = np.repeat(np.asarray([r[2] for r in rows], np.int64), [len(p) + 1 for p in parts])
    index = FMIndex(symbols, known + 1)
    groups = index.edges(WINDOW)
    first = np.minimum.reduceat(owner[index.order], groups[:-1])
    firsts = [np.zeros(r[3], np.int64) for r in rows]
    where = np.concatenate([[0], np.cumsum([r[3] for r in rows])])
    flat_firsts = np.concatenate(firsts)
    for text, place, row in statistics(index, parts, WINDOW):
        flat_firsts[where[text] + place] = first[np.searchsorted(groups, row, side="right") - 1]
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
        pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat_firsts)),
    ], ["route", "seg", "firsts"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route; a shard takes whole routes until it is full."""
    shard, group, held = [], [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][0] != row[0]:
                size = sum(len(r[4]) // wordhash.PAIR.itemsize for r in group)
                if shard and held + size > SHARD_WORDS:
                    yield _firsts_of(shard)
                    shard, held = [], 0
                shard, held, group = shard + group, held + size, []
            group.append(row)
    if shard + group:
        yield _firsts_of(shard + group)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of too large a route, by a digest of its words."""
    for batch in batches:
        for route, seg, first_id, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = np.frombuffer(raw, wordhash.PAIR)
            windows = [_digest(words[k : k + WINDOW]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, route)), pa.array([seg] * n, pa.binary()), pa.array(np.full(n, first_id)), pa.array(np.arange(n, dtype=np.int32)), pa.array(windows, pa.binary()),
            ], ["route", "seg", "first_id", "at", "window"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of_batches(batches, "text", 4 << 20):
        rows = []
        for doc_id, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = (text or "").encode().split()
            kept = words
            if gone:
                starts = np.asarray(gone, np.int64)
                mark = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + WINDOW, minlength=len(words) + 1)
                keep = np.cumsum(mark[:-1]) == 0
                kept = [words[k] for k in np.flatnonzero(keep)]
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, _text, starts: the first words of the windows that an earlier document has, where there are any."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("_text"), "text").where(F.col("doc_id").isNotNull())
    found = written(rows.mapInArrow(_segmented, _SEGMENTS), "segments")
    shared = found.groupBy("route").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("route")
    members = written(found.join(shared, "route", "left_semi"), "shared-segments")

    unequal = members.groupBy("route", "seg").agg(F.min(F.struct("doc_id", "_text", "start", "n")).alias("rep"))
    unequal = written(unequal.select("route", "seg", "rep.*"), "unequal-segments")
    sizes = unequal.groupBy("route").agg(F.count("*").alias("segs"), F.sum(F.col("n") + WINDOW - 1).alias("size"))
    alone = unequal.join(sizes.where("segs = 1").select("route"), "route", "left_semi")
    several = unequal.join(sizes.where("segs > 1").select("route", "size"), "route")

    asked = several.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_other")).agg(F.collect_list(F.struct("route", "seg", "start", "n")).alias("asked"))
    texts = rows.join(asked, (rows["doc_id"] == asked["_id"]) & (rows["_text"] == asked["_other"])).select("doc_id", "text", "asked")
    worded = written(texts.mapInArrow(_with_words, _WORDS).dropDuplicates(["route", "seg"]), "segment-words")
    hot = sizes.where(F.col("segs") > 1).where(F.col("size") > SHARD_WORDS).select("route")
    cool = worded.join(hot, "route", "left_anti").repartition("route").sortWithinPartitions("route", "seg")
    firsts = cool.mapInArrow(_indexed, _FIRSTS)

    each = written(worded.join(hot, "route", "left_semi").mapInArrow(_windows, "route bigint, seg binary, first_id bigint, at int, window binary"), "windows")
    first_of = each.groupBy("window").agg(F.min("first_id").alias("first"))
    # one window may be in a large part of these rows: its answer is given to each of a few shares of them
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    salted = each.withColumn("share", F.pmod(F.xxhash64("seg"), F.lit(SHARES)).cast("int"))
    by_window = salted.join(first_of.withColumn("share", shares), ["window", "share"]).groupBy("route", "seg").agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("w"))
    by_window = by_window.select("route", "seg", F.col("w.first").alias("firsts"))

    held = firsts.union(by_window)
    older = members.join(held, ["route", "seg"]).select(
        "doc_id", "_text", F.filter(F.transform("firsts", lambda x, k: F.when(x < F.col("doc_id"), F.col("start") + k)), lambda x: x.isNotNull()).alias("at")
    ).where(F.size("at") > 0)
    # where a segment is the only one of its route, all its windows are as old as it is: copies need no index
    first_copy = alone.select("route", "seg", F.col("doc_id").alias("first"))
    copies = members.join(first_copy, ["route", "seg"]).where("first < doc_id").select("doc_id", "_text", F.expr("sequence(start, start + n - 1)").alias("at"))
    older = older.unionByName(copies.withColumn("at", F.col("at").cast(older.schema["at"].dataType)))
    # segments of a document hold different windows; rows that repeat only name the same starts again
    return older.groupBy("doc_id", "_text").agg(F.flatten(F.collect_list("at")).alias("starts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("_text"), "text")
    found = repeated_windows(docs).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_other"), "starts")
    joined = rows.join(found, (rows["doc_id"] == found["_id"]) & (rows["_text"] == found["_other"]), "left")
    return joined.select("doc_id", "text", "starts").mapInArrow(_removed, _OUT)
