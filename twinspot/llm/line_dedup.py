"""Line dedup: a segment-partition edit join of all distinct lines.

Two lines are linked if few edits of one code point lead from one to the other: ``EDITS`` at most, and one for each
``PER`` code points of the shorter line, so that lines of fewer than ``PER`` are linked only if equal. A line of which
e edits are allowed is cut into e + 1 even segments; of two linked lines,
the longer one holds some segment of the shorter one unchanged, near its place. So each line is listed under its own
segments and under those of its substrings that a line of equal or slightly smaller length could have as a segment,
both keyed with that length and the segment's number. Lines that share a key are candidates; buckets.py picks the
pairs to test, and a banded bit-parallel edit distance decides. What large buckets leave open is dealt by the rarest
runs of ``GRAM`` code points at their places: so many that e edits can't change all of them, so that two linked
lines share one. Linked lines form classes, of which only the first
line stays: the one of smallest (doc_id, hash of the text, line number), null ids last. Equal lines are told by 128
bits.

Lines end at a newline; blank ones stay always. A null text has no lines and stays null, an empty text is one blank
line. Repeated rows with equal doc_id and text share one answer. Lines and texts of any length are compared whole.
An empty table gives no rows. Further columns, whatever their names, are returned as they are, but for ``n_chars``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .buckets import LINK, crowded, linked_roots, paired, short_of
from .common import lean, pieces_of_batches, text_key, written

EDITS, PER = 2, 12
#: A line of ``e * PER`` code points has more runs than e edits change: more than e * GRAM.
GRAM = 5
#: Lengths, and places, that one cell of the keys of runs spans. Wider cells give fewer keys; the join compares lengths and places themselves.
WIDE = 8
#: Cells in which the uses of runs are counted. Any order of runs finds all links; a good estimate keeps buckets small.
CELLS = 1 << 18
#: Distinct lines that a task remembers, so as to list each once.
_SEEN = 400_000
#: Code points from which on segments are hashed one by one.
_LONG = 1 << 20

_PLACED = "band bigint, node binary, root binary, owner boolean, seeker boolean, place int, size int, points bigint, twos bigint"
_LINES = "doc_id bigint, _text bigint, line int, node binary, size int"


def _hash(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode())


def allowed(size: int) -> int:
    return min(EDITS, size // PER)


def keys_of(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(key, line): own segments, and substrings that may be a segment of a line with up to ``edits`` code points fewer."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(lines) else size
    points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    power, inverse = wordhash.tables(len(points) + 1) if len(points) < 4 * _LONG else (None, None)
    sums = np.zeros(len(points) + 1, np.uint64)
    if power is not None:
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=sums[1:])
    out, of = [], []
    for e in range(1, edits + 1):
        for fewer in range(e + 1):
            n = size - fewer
            mine = np.flatnonzero(np.minimum(edits, n // PER) == e)
            n, parts = n[mine], e + 1
            least = n // parts
            longer = n - least * parts
            for k in range(parts):
                # even segments, the longer ones last
                at, m = k * least + np.maximum(0, k - (parts - longer)), least + (k >= parts - longer)
                seed = wordhash.mix((n * 8 + k).astype(np.uint64))
                # edits left of the segment move it by k at most, those right of it by the rest
                for shift in range(max(-k, fewer - (e - k)), min(k, fewer + e - k) + 1):
                    start = at + shift
                    fits = (start >= 0) & (start + m <= size[mine])
                    s = (begin[mine] + start)[fits]
                    if power is None:
                        own = [int.from_bytes(hashlib.blake2b(points[x : x + w].tobytes(), digest_size=8).digest(), "little") for x, w in zip(s, m[fits], strict=True)]
                        found = np.asarray(own, np.uint64)
                    else:
                        found = (sums[s + m[fits]] - sums[s]) * inverse[s]
                    out.append(wordhash.mix(found ^ seed[fits]))
                    of.append(mine[fits])
    return np.concatenate(out).view(np.int64), np.concatenate(of)


def keys(line: str) -> set[int]:
    return set(keys_of([line])[0].tolist())


def _common(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most ``edits``, by bit vectors over the diagonals within that distance."""
    if abs(len(a) - len(b)) > edits:
        return False
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    rows, width = len(a), 2 * edits + 1
    ones = (1 << width) - 1
    # bit k of column j stands for row j - edits + k; rows before the first have no vertical step
    up, down = ones & ~((1 << edits) - 1), 0
    row = min(edits, rows)
    distance = row
    for j, c in enumerate(b, 1):
        match = 0
        for k in range(width):
            i = j - edits + k
            if 1 <= i <= rows and a[i - 1] == c:
                match |= 1 << k
        same = ((((match & up) + up) ^ up) | match | down) & ones
        right_up = (down | ~(same | up)) & ones
        right_down = same & up
        if row < rows:
            row += 1
            distance += not same >> (row - j + edits) & 1
        else:
            bit = row - j + edits
            distance += (right_up >> bit & 1) - (right_down >> bit & 1)
        up = (right_down | ~((same >> 1) | right_up)) & ones
        down = (same >> 1) & right_up
        if distance - (rows - row) - max(0, len(b) - j - (rows - row)) > edits:
            return False
    return distance <= edits


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    for batch in pieces_of_batches(batches, "text", 4 << 20):
        out = [
            (doc_id, key, k, _hash(line), len(line))
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for k, line in enumerate((text or "").split("\n"))
            if line and not line.isspace()
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "_text", "line", "node", "size"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, short of each line that may be linked with an unequal one, once for each task."""
    seen: set[bytes] = set()

    def made(lines: list[str], shorts: list[int]) -> pa.RecordBatch:
        bands, of = keys_of(lines)
        return pa.RecordBatch.from_arrays([pa.array(bands), pa.array(np.asarray(shorts, np.uint64).view(np.int64)[of])], ["band", "short"])

    for batch in pieces_of_batches(batches, "text", 1 << 20):
        lines, shorts = [], []
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                if len(line) < PER or line.isspace() or (node := _hash(line)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                short = xxhash.xxh64_intdigest(node, seed=42)
                if len(line) >= _LONG:
                    yield made([line], [short])
                else:
                    lines.append(line)
                    shorts.append(short)
        if lines:
            yield made(lines, shorts)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of_batches(batches, "text", 4 << 20):
        out = []
        for text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = text.split("\n")
            out += [(s["node"], lines[s["line"]]) for s in asked]
        if out:
            nodes, lines = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(lines)], ["node", "line"])


def _grams(line: str) -> np.ndarray:
    """Hashes of the line's runs of GRAM code points, from left to right."""
    points = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    return wordhash.grams(points, GRAM)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, uses: how often a task's lines have runs whose hash ends in a cell's number."""
    uses = np.zeros(CELLS, np.int64)
    for batch in batches:
        for line in batch.column(0).to_pylist():
            np.add.at(uses, (_grams(line) % np.uint64(CELLS)).astype(np.int64), 1)
    cell = np.flatnonzero(uses)
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(uses[cell])], ["cell", "uses"])


def _apart(at: list[int], most: int) -> list[int]:
    """Places of up to ``most`` runs that don't overlap, from the left."""
    out: list[int] = []
    for x in sorted(at):
        if len(out) < most and (not out or x >= out[-1] + GRAM):
            out.append(x)
    return out


def early(uses: np.ndarray, grams: np.ndarray, at: np.ndarray, edits: int) -> tuple[np.ndarray, list[int]]:
    """The rarest runs, all places of each, until ``edits + 1`` of them don't overlap; and such ones.

    As many edits leave one of those as it is. Of two linked lines, one's early runs end no later by rarity than the
    other's, so that the run left as it is belongs to the other's early ones.
    """
    order = np.lexsort((at, grams, uses))
    for k in range(len(order)):
        last = k + 1 == len(order) or grams[order[k + 1]] != grams[order[k]]
        if last and k >= edits:
            places = _apart(at[order[: k + 1]].tolist(), edits + 1)
            if len(places) > edits:
                return order[: k + 1], places
    return order, _apart(at.tolist(), edits + 1)


def _parity(hashes: np.ndarray) -> int:
    """64 bits: whether odd many of the hashes end in each place's number. An edit flips as many as it takes and gives."""
    odd = np.bincount((hashes & np.uint64(63)).astype(np.int64), minlength=64) & 1
    return int(np.packbits(odd.astype(np.uint8)).view(">i8")[0])


def _placed(uses: np.ndarray):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A line's early runs, each in all cells of length and place where an owner of it may be; runs apart are owners in their own cell."""
        for batch in pieces_of_batches(batches, "line", 1 << 20):
            names, rows, bands, owner, places, sizes, points, twos = batch.schema.names, [], [], [], [], [], [], []
            get = lambda c: batch.column(names.index(c))  # noqa: B023, E731
            for r, line in enumerate(get("line").to_pylist()):
                grams, size = _grams(line), len(line)
                own = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
                points.append(_parity(wordhash.mix(own)))
                twos.append(_parity(wordhash.grams(own, 2)))
                sizes.append(size)
                first, apart = early(uses[(grams % np.uint64(CELLS)).astype(np.int64)], grams, np.arange(len(grams)), allowed(size))
                for k in first:
                    gram, place = int(grams[k]), int(k)
                    for cell in product(_reach(size), _reach(place)):
                        bands.append(hash((gram, *cell)))
                        owner.append(place in apart and cell == (size // WIDE, place // WIDE))
                        places.append(place)
                        rows.append(r)
            of = pa.array(rows, pa.int64())
            of_line = [pa.array(x, t).take(of) for x, t in ((sizes, pa.int32()), (points, pa.int64()), (twos, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bands, pa.int64()), get("node").take(of), get("root").take(of), pa.array(owner, pa.bool_()), pa.array([True] * len(rows), pa.bool_()), pa.array(places, pa.int32()), *of_line],
                ["band", "node", "root", "owner", "seeker", "place", "size", "points", "twos"],
            )

    return placed


def _reach(x: int) -> range:
    """Cells of a length or place that ``EDITS`` edits can lead to."""
    return range((x - EDITS) // WIDE, (x + EDITS) // WIDE + 1)


#: Edits before a run move it, all edits change the length. An edit changes two code points at most, and two pairs of neighbours for two others.
_ALIKE = (
    f"abs(x.place - y.place) + abs(x.size - y.size - x.place + y.place) <= {EDITS}"
    f" and bit_count(x.points ^ y.points) <= {2 * EDITS} and bit_count(x.twos ^ y.twos) <= {4 * EDITS}"
)


def _rarest(texts: DataFrame):
    def finer(roots: DataFrame) -> DataFrame:
        lines = written(texts.join(roots, "node").select("node", "root", "line"), "open-lines")
        uses = np.zeros(CELLS, np.int32)
        # as many numbers as there are cells, for any number of lines
        for r in lines.select("line").mapInArrow(lean(_cells), "cell int, uses bigint").groupBy("cell").agg(F.least(F.sum("uses"), F.lit(2**31 - 1)).cast("int").alias("uses")).collect():
            uses[r["cell"]] = r["uses"]
        return lines.mapInArrow(lean(_placed(uses)), _PLACED)

    return finer


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of_batches(batches, "line_b", 4 << 20):
        names = batch.schema.names
        a, b = (batch.column(names.index(x)).to_pylist() for x in ("line_a", "line_b"))
        mask = pa.array([within(x, y, allowed(min(len(x), len(y)))) for x, y in zip(a, b, strict=True)])
        kept = ("a", "b", "root_a", "root_b")
        yield pa.RecordBatch.from_arrays([batch.column(names.index(x)).filter(mask) for x in kept], list(kept))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _text, gone, near: the line numbers to drop, and how many of these equal no earlier line."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("_text"), "text")
    lines = written(rows.mapInArrow(lean(_lines), _LINES), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "line")
    exact = lines.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("uses"))

    shorts = exact.select("node", short_of("node").alias("short"), "first")
    listed = crowded(rows.select("text").mapInArrow(lean(_listed), "band bigint, short bigint"))
    # a task lists a line once, several tasks may list it
    members = written(listed.distinct().join(shorts, "short").select("band", "node", "first"), "buckets")
    wanted = members.select("node", "first.*").distinct()
    asked = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_other")).agg(F.collect_list(F.struct("node", "line")).alias("asked"))
    on = rows["doc_id"].eqNullSafe(asked["_id"]) & rows["_text"].eqNullSafe(asked["_other"])
    texts = written(rows.join(asked, on).select("text", "asked").mapInArrow(lean(_asked), "node binary, line string").dropDuplicates(["node"]), "bucket-lines")
    test = lambda pairs: paired(pairs, texts).mapInArrow(lean(_near), LINK)
    found = linked_roots(members.select("band", "node"), test, _rarest(texts), _ALIKE)

    classed = exact.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = classed.groupBy("root").agg(F.min("first").alias("kept"), F.sum("uses").alias("uses")).where("uses > 1")
    of_node = classed.select("node", "root", F.col("first").alias("same")).join(firsts, "root").select("node", "kept", "same")
    gone = lines.join(of_node, "node").where(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "_text").agg(
        F.array_sort(F.collect_set("line")).alias("gone"), F.count_if(place.eqNullSafe(F.col("same"))).alias("near")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of_batches(batches, "text", 4 << 20):
        texts = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if gone:
                drop = set(gone)
                text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with each text's repeated lines cut; all rows and other columns stay. ``n_chars`` is counted anew."""
    gone = repeated_lines(docs).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_other"), "gone")
    # the other columns ride in a struct, so their names can't meet those in use here
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text", F.col("doc_id").cast("long").alias("_own"), text_key().alias("_own_key"))
    on = rows["_own"].eqNullSafe(gone["_id"]) & rows["_own_key"].eqNullSafe(gone["_other"])
    joined = rows.join(gone, on, "left").select("row", "text", "gone")
    out = joined.mapInArrow(lean(_kept), joined.select("row", "text").schema)
    counted = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[F.col("text") if c == "text" else counted.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of_batches(batches, "text", 4 << 20):
        out = []
        for doc_id, text, gone, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines, drop = (text or "").split("\n"), set(gone or ())
            kept = "\n".join(line for k, line in enumerate(lines) if k not in drop)
            out.append((doc_id, 0 if text is None else len(lines), len(drop), near or 0, hashlib.sha256(kept.encode()).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_lines", "n_removed", "n_near", "kept_sha256"])


def line_figures(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, kept_sha256 for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("_text"), "text")
    gone = repeated_lines(docs).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_other"), "gone", "near")
    on = rows["doc_id"].eqNullSafe(gone["_id"]) & rows["_text"].eqNullSafe(gone["_other"])
    joined = rows.join(gone, on, "left").select("doc_id", "text", "gone", "near")
    return joined.mapInArrow(lean(_digested), "doc_id bigint, n_lines bigint, n_removed bigint, n_near bigint, kept_sha256 string")
