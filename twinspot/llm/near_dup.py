"""MinHash near-dedup: many universal hash minima, banding, verification, connected components.

A text's set holds its distinct shingles of ``SHINGLE`` words (A-Z in lower case); with fewer words, all of them
as one. Texts with one set, told by two independent hashes of 64 bits for each
word, are one node, so copies cost a row each and no pairs. Each node has
``bands * ROWS`` minima of universal hashes ``a * x + b``; nodes that agree on all minima of a band share a bucket.
There are so many bands that a pair at the threshold misses all buckets with a probability under ``MISS``: 35 at 80
percent.

buckets.py tells which pairs of a bucket are tested. What large buckets leave open is dealt by rare shingles: of two
linked texts, the smaller has one of its first ``owner`` rarest in common with the first ``seeker`` of the other, and
where the two stand there bounds how much the texts can share. A tested pair is
linked if its signatures agree often enough and then ``100 * |A & B| >= percent * |A | B|`` holds on the full sets
of words.

A null or empty text, or one of blanks, has an empty set and is linked with nothing. A null doc_id takes part;
its component has the smallest id of the others, or null. Repeated rows come out each; texts of any length are
taken whole. An empty table gives no rows. Of further columns, whatever their names, ``near_duplicates`` reads none
and ``deduplicated`` returns all; of rows that are equal in doc_id and text it keeps the one whose other columns come
first as JSON.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .buckets import LINK, crowded, linked_roots, paired, short_of
from .common import buffers, lean, pieces_of_batches, text_key, written

SHINGLE, ROWS, BANDS = 5, 5, 26
#: Probability at which a pair at the threshold may share no bucket; ``BANDS`` is the least number of bands.
MISS = 1e-6
#: Standard errors below the threshold at which a signature still passes.
SLACK = 5.0

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_SKETCH = "doc_id bigint, _text bigint, n_shingles bigint, node binary, signature binary, bands array<bigint>"


def bands_for(percent: int) -> int:
    apart = 1 - (percent / 100) ** ROWS
    return max(BANDS, math.ceil(math.log(MISS) / math.log(apart))) if 0 < apart < 1 else BANDS


def _universal(n: int, seed: int = 20_231) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n independent hashes of the distinct shingles of each text, text after text, and where each text's begin."""
    texts, data = len(offsets) - 1, wordhash.lower(data)
    starts, ends, text = wordhash.spans(data, offsets)
    words = wordhash.hashes(data, starts, ends, n)
    grams = np.stack([wordhash.grams(w, size) for w in words])
    same = text[: grams.shape[1]] == text[size - 1 :] if grams.shape[1] else np.zeros(0, bool)
    doc, found = text[: grams.shape[1]][same], grams[:, same]
    per_text = np.bincount(text, minlength=texts)
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per_text)])
        whole = [[wordhash.mix(wordhash.grams(w[first[k] : first[k + 1]], per_text[k]) + np.uint64(per_text[k]))[0] for k in short] for w in words]
        doc, found = np.concatenate([doc, short]), np.concatenate([found, np.asarray(whole, np.uint64)], axis=1)
    order = np.lexsort((*found[::-1], doc))
    doc, found = doc[order], found[:, order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[:, 1:] != found[:, :-1]).any(axis=0)
    return found[:, new], np.searchsorted(doc[new], np.arange(texts + 1))


def _sketched(n_bands: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _universal(ROWS * n_bands)
        turn = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in pieces_of_batches(batches, "text", 1 << 19):
            found, at = shingles(*buffers(batch.column(2)), n=2)
            size = np.diff(at)
            full = np.flatnonzero(size)
            x, begin = found[0] >> np.uint64(32), at[:-1][full]
            minima = np.zeros((len(full), ROWS * n_bands), np.uint32)
            node = np.zeros((len(full), 2), np.uint64)
            if len(full):
                for k in range(ROWS * n_bands):
                    minima[:, k] = np.minimum.reduceat(x * mul[k] + add[k], begin) >> np.uint64(32)
                for half in range(2):
                    node[:, half] = wordhash.mix(np.add.reduceat(wordhash.mix(found[half]), begin) ^ size[full].astype(np.uint64))
            rows = minima.reshape(len(full), n_bands, ROWS).astype(np.uint64)
            keys = wordhash.mix((wordhash.mix(rows + turn)).sum(axis=2) + np.arange(n_bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            signature, nodes, bands = ([None] * len(size) for _ in range(3))
            for r, k in enumerate(full):
                signature[k], nodes[k], bands[k] = minima[r].tobytes(), node[r].tobytes(), keys[r].astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()),
                pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ], ["doc_id", "_text", "n_shingles", "node", "signature", "bands"])

    return sketch


def _linked(percent: int):
    share, n = percent / 100, ROWS * bands_for(percent)
    least = int(n * max(0.0, share - SLACK * np.sqrt(share * (1 - share) / n)))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, set()
        for batch in pieces_of_batches(batches, "text_b", 1 << 20):
            keep = np.zeros(batch.num_rows, bool)
            names = batch.schema.names
            get = lambda name: batch.column(names.index(name))  # noqa: B023, E731
            for r, (a, sa, sb) in enumerate(zip(get("a").to_pylist(), get("signature_a"), get("signature_b"), strict=True)):
                if (np.frombuffer(sa.as_buffer(), np.uint32) == np.frombuffer(sb.as_buffer(), np.uint32)).sum() < least:
                    continue
                if a != pivot:
                    pivot, own = a, set_of(get("text_a")[r].as_py())
                other = set_of(get("text_b")[r].as_py())
                both = len(own & other)
                keep[r] = 100 * both >= percent * (len(own) + len(other) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([get(c).filter(mask) for c in ("a", "b", "root_a", "root_b")], ["a", "b", "root_a", "root_b"])

    return link


def set_of(text: str) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = text.encode().translate(_LOWER).split()
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False)) or {tuple(words)}


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles, with their number."""
    for batch in pieces_of_batches(batches, "text", 1 << 19):
        found, at = shingles(*buffers(batch.column(batch.schema.names.index("text"))))
        size = np.diff(at)
        of = np.repeat(np.arange(len(size)), size)
        columns = [batch.column(batch.schema.names.index(c)).take(pa.array(of)) for c in ("node", "root")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found[0].view(np.int64)), pa.array(size[of].astype(np.int32))], ["node", "root", "item", "size"])


def _rarest(texts: DataFrame, percent: int):
    """Nodes under their rarest shingles. Of two linked sets, the first shared shingle by rarity stands early in both."""

    def finer(roots: DataFrame) -> DataFrame:
        asked = texts.join(roots, "node").select("node", "root", "text")
        items = written(asked.mapInArrow(lean(_items), "node binary, root binary, item bigint, size int"), "shingles")
        # a shingle of one text alone takes a place among the rarest, but makes no bucket
        uses = items.groupBy("item").agg(F.count("*").alias("uses"))
        placed = items.join(uses, "item").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("uses", "item")))
        size = F.col("size")
        seeker = size - F.ceil(percent * size / 100).cast("int") + 1
        owner = size - F.ceil(2 * percent * size / (100 + percent)).cast("int") + 1
        early = placed.where((F.col("place") <= seeker) & (F.col("uses") > 1))
        return early.select(F.col("item").alias("band"), "node", "root", "size", "place", (F.col("place") <= owner).alias("owner"), F.lit(True).alias("seeker"))

    smaller = "(x.size < y.size or (x.size = y.size and x.node < y.node))"
    # so much at most is shared, and so much must be
    enough = f"{100 + percent} * (least(x.size - x.place, y.size - y.place) + 1) >= {percent} * (x.size + y.size)"
    return finer, f"{smaller} and {enough}"


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, _text, node for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("_text"), "text")
    sketched = written(rows.mapInArrow(lean(_sketched(bands_for(percent))), _SKETCH), "sketches")
    nodes = sketched.where(F.col("node").isNotNull())
    classes = nodes.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "_text")).alias("rep"))

    listed = nodes.select("node", "bands").dropDuplicates(["node"]).select(short_of("node").alias("short"), F.explode("bands").alias("band"))
    shorts = classes.select("node", short_of("node").alias("short"))
    members = written(crowded(listed).join(shorts, "short").select("band", "node"), "buckets")
    texts = _texts(rows, nodes, classes, members.select("node").distinct())
    test = lambda pairs: paired(pairs, texts).mapInArrow(lean(_linked(percent)), LINK)
    found = linked_roots(members, test, *_rarest(texts, percent))

    mapped = classes.select("node", "first_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = mapped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = mapped.select("node", "root").join(least, "root").select("node", "component_id")
    out = sketched.select("doc_id", "_text", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "_text", "node"
    )


def _texts(rows: DataFrame, nodes: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text, signature of the wanted nodes."""
    reps = classes.join(wanted, "node", "left_semi").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep._text").alias("_other"))
    texts = rows.join(reps, rows["doc_id"].eqNullSafe(reps["_id"]) & rows["_text"].eqNullSafe(reps["_other"]))
    texts = texts.select("node", "text").dropDuplicates(["node"])
    signatures = nodes.select("node", "signature").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    return written(texts.join(signatures, "node"), "bucket-texts")


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group: that of the smallest doc_id, with all its columns. Empty texts stay."""
    found = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_own"), text_key().alias("_own_key"))
    on = rows["_own"].eqNullSafe(found["_id"]) & rows["_own_key"].eqNullSafe(found["_key"])
    kept = rows.join(found, on, "left_semi")
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    return kept.groupBy("_own", "_own_key").agg(F.min_by("row", order).alias("row")).select("row.*")
