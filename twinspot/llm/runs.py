"""Periodic runs of words: seeds on diagonals, extended once for each lag and stretch.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least ``LEAST`` words and
two periods, which no neighbouring word extends. Along the diagonal of lag q, a run of n words has n - q equal pairs in a row: q at
least, and ``GRAM`` at least. So lags are taken in classes of (k, 2k), k doubling from ``GRAM`` on, and two equal k-grams that stand
a lag of the class apart seed each run of that class.

Of a class's grams, those that occur more than once in a text are sorted by gram and place, and pairs at lags of the class
are read off. A pair whose left neighbours are equal too is part of the pair before it, so only pairs that differ to their left
are made: neighbours in the order that have one word to the left form blocks, and pairs come from unequal blocks.
As occurrences of a k-gram that are less than k / 2 apart have a common period, and so one word to the left, few blocks are within
reach, and a class makes a number of pairs in proportion to the words. Pairs inside a run of smaller period are dropped, and those
whose stretch would be too short for a run: two k-grams, one at its start and one at its least end, cover it.
A table of the furthest word covered on each lag drops seeds that an extension has passed. What is left is extended to
the right by comparing words. Of stretches with equal ends the smallest period counts.

A 2k-gram that recurs consists of two k-grams that do, so each class looks at what the class before left, by hashes; extensions
compare the words' numbers, given by two hashes of 64 bits.

Words are what ``[^\\x20\\x09-\\x0D]+`` matches. A null text has no runs and stays null, one without words becomes empty.
Texts are taken whole, in batches of about ``BATCH`` bytes or one text. Rows with a null doc_id and repeated rows come out each; an
empty table gives no rows. Further columns, whatever their names, are returned by ``collapsed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import buffers, pieces_of_batches

LEAST = 12
#: Equal pairs in a row that every run of ``LEAST`` words has on its diagonal: LEAST - q for periods q up to half of it, q beyond.
GRAM = LEAST // 2
BATCH = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, the size[k] numbers from first[k] on; and k for each."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def _pairs(gram: np.ndarray, place: np.ndarray, words: np.ndarray, begin: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal grams that stand ``least`` to ``most`` words apart and have different words to their left.

    ``gram`` numbers the grams and doesn't fall; places of one gram rise. ``begin`` marks the first words of texts.
    """
    left = np.where(begin[place], -1, words[place - 1])
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (left[1:] != left[:-1])
    block = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(gram))
    key = gram * (len(words) + 1) + place
    # a gram's places end before the next gram's keys begin
    lo = np.searchsorted(key, key + least)
    hi = np.searchsorted(key, np.minimum(key + most, gram * (len(words) + 1) + len(words)), side="right")
    seed = np.flatnonzero(lo < hi)
    lo, hi = lo[seed], hi[seed]
    other, of = _spread(block[lo], block[hi - 1] - block[lo] + 1)
    differ = left[first[other]] != left[seed[of]]
    other, of = other[differ], of[differ]
    start = np.maximum(lo[of], first[other])
    at, pair = _spread(start, np.minimum(hi[of], first[other + 1]) - start)
    return place[seed[of[pair]]], place[at]


def _matched(words: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, b not passing ``stop``."""
    size, live, step = np.zeros(len(a), np.int64), np.arange(len(a)), 16
    while len(live):
        at = size[live][:, None] + np.arange(step)
        inside = b[live][:, None] + at < stop[live][:, None]
        same = inside & (words[np.where(inside, a[live][:, None] + at, 0)] == words[np.where(inside, b[live][:, None] + at, 0)])
        whole = same.all(axis=1)
        size[live] += np.where(whole, step, np.argmin(same, axis=1))
        live = live[whole]
        step = max(16, min(2 * step, 1 << 12, (1 << 22) // max(1, len(live))))
    return size


def _uncovered(lag: np.ndarray, a: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Seeds, by lag and place, that lie beyond the furthest word covered by the extensions before them on their lag."""
    wide = np.int64(end.max(initial=0) + 1)
    furthest = np.maximum.accumulate(lag * wide + end) if len(lag) else end
    before = np.concatenate([[-1], furthest[:-1]])
    return np.flatnonzero(lag * wide + a >= before)


def runs_of(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs in texts of numbered words, by text, start, period.

    Text k has the words offsets[k] to offsets[k + 1]; starts count from its first word.
    """
    n, sizes = len(words), np.diff(offsets)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    text = np.repeat(np.arange(len(sizes)), sizes)
    stop = offsets[1:][text]
    found = [np.zeros((0, 3), np.int64)]
    reach, number = np.zeros(n, np.int64), np.full(n, -1)
    k, hashed = GRAM, wordhash.grams(wordhash.mix(words.astype(np.uint64) + np.uint64(1)), GRAM)
    place = np.flatnonzero(np.arange(len(hashed)) + GRAM <= stop[: len(hashed)]) if len(hashed) else np.zeros(0, np.int64)
    value = hashed[place]
    while len(place):
        order = np.argsort(value, kind="stable")
        value, place = value[order], place[order]
        new = np.ones(len(place), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[place[1:]] != text[place[:-1]])
        gram = np.cumsum(new) - 1
        again = np.bincount(gram)[gram] > 1
        value, place, gram = value[again], place[again], gram[again]
        if not len(place):
            break
        a, b = _pairs(gram, place, words, begin, 1 if k == GRAM else k, 2 * k - 1)
        # inside a run of smaller period there is nothing new; a run's stretch begins and ends with equal grams
        need = np.maximum(LEAST - (b - a), b - a) - k
        number[place] = gram
        last = np.minimum(b + need, n - 1)
        out = (reach[a] < b + k) & (number[a + need] == number[last]) & (number[last] >= 0) & (last == b + need)
        a, b = a[out], b[out]
        number[place] = -1
        order = np.lexsort((a, b - a))
        a, b = a[order], b[order]
        end = b + _matched(words, a, b, stop[b])
        live = _uncovered(b - a, a, end - (b - a))
        a, b, end = a[live], b[live], end[live]
        whole = end - a >= np.maximum(LEAST, 2 * (b - a))
        made = np.stack([a[whole], end[whole], (b - a)[whole]], axis=1)
        found.append(made)
        np.maximum.at(reach, made[:, 0], made[:, 1])
        reach = np.maximum.accumulate(reach)
        # a gram of twice the length: two that recur, side by side
        order = np.argsort(place)
        place, value = place[order], value[order]
        at = np.searchsorted(place, place + k)
        fits = np.flatnonzero((at < len(place)) & (place[np.minimum(at, len(place) - 1)] == place + k))
        fits = fits[place[fits] + 2 * k <= stop[place[fits]]]
        value = wordhash.mix(value[fits] * np.uint64(0x9FB21C651E98DF25) + wordhash.mix(value[at[fits]]))
        place, k = place[fits], 2 * k
    start, end, period = np.concatenate(found).T
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return text[start], start - offsets[text[start]], end - start, period


def repeats(offsets: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each word stands in a run behind that run's first period."""
    n = offsets[-1]
    first = offsets[text] + start
    return np.cumsum(np.bincount(first + period, minlength=n + 1) - np.bincount(first + length, minlength=n + 1))[:n] > 0


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and collapsed text of each row (_key, _text)."""
    for batch in pieces_of_batches(batches, "_text", BATCH):
        column = batch.column(batch.schema.names.index("_text"))
        data, ends = buffers(column)
        starts, stops, of = wordhash.spans(data, ends)
        words, _ = wordhash.numbered(wordhash.pairs(data, starts, stops))
        offsets = np.searchsorted(of, np.arange(batch.num_rows + 1))
        text, start, length, period = runs_of(words, offsets)
        gone = repeats(offsets, text, start, length, period)
        per_text = np.searchsorted(text, np.arange(batch.num_rows + 1))
        inner = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), inner).cast(_RUN)
        kept: list[str | None] = []
        for raw, lo, hi in zip(column.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = (raw or "").encode().split()
            if gone[lo:hi].any():
                own = [own[k] for k in np.flatnonzero(~gone[lo:hi])]
            kept.append(None if raw is None else b" ".join(own).decode())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("_key")), runs, pa.array(kept, pa.string())], ["_key", "_runs", "_collapsed"])


def analysed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, runs (start, length, period; by start, then period), collapsed: the text without the words that repeat a period."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(f"`{key}`").alias("_key"), F.col("text").alias("_text")).mapInArrow(_analysed, f"_key {kind}, _runs {RUNS}, _collapsed string")
    return out.select(F.col("_key").alias(key), F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: a row for each run."""
    return analysed(docs).select("doc_id", F.inline("runs"))


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with texts in which each run has one period left, words joined by single spaces."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    out = analysed(rows, "row")
    return out.select(*[(F.col("collapsed") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, digests of the runs and of the collapsed text, for each row."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = analysed(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.less") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth text by a hash of its doc_id gets a periodic tail, made of its own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    # what is needed twice stands in columns of its own
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    tail = rows.select("doc_id", "text", "w", "g", F.when(n > 0, n).alias("n"), F.when(n > 0, F.col("g") % n).alias("a"))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long")
    parts = tail.select("doc_id", "text", "w", "n", "a", period.alias("p"))
    # whole periods, one more for the rest
    again = F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    made = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.flatten(again)), F.lit(1), F.col("n").cast("int"))
    return parts.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
