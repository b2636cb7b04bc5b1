"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs ``n + n * n / QUADRATIC_AT``: the linear part of a layer and the attention within the
piece. Documents are cut into full pieces, which fill a sequence each, and a rest. The rests are dealt evenly
over partitions and packed there in blocks of ``BLOCK_ROWS``: a block gets as many sequences as its tokens need,
its rests go in descending length each to the sequence of lowest cost that still has room, and a rest that
fits nowhere is cut over the sequences with most room. So a block pads its last token places only, fewer than
one sequence.

Null and empty texts are packed as the end id alone. Repeated rows are packed each. Sequence ids are unique over
all partitions but not consecutive; offsets are gapless from 0 in each.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_crc32, lean, pieces_of_batches
from .pretokens import ByteEncoder, encoder

#: Tokens at which attention costs as much as the linear part.
QUADRATIC_AT = 2048
#: Rests that are packed together; bounds a task's memory and the search.
BLOCK_ROWS = 8192
#: Documents for each packing partition.
DOCS_PER_TASK = 40_000

_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
_PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cost(n: int) -> float:
    return n + n * n / QUADRATIC_AT


def assign(lengths: list[int], room: int) -> list[list[tuple[int, int]]]:
    """For each document, its (sequence, tokens) in order. ``lengths`` are at most ``room`` each."""
    n = -(-sum(lengths) // room)
    left, spent, out = [room] * n, [0.0] * n, [[] for _ in lengths]
    heap = [(0.0, s) for s in range(n)]
    cut: list[int] = []

    def put(k: int, s: int, tokens: int) -> None:
        out[k].append((s, tokens))
        left[s] -= tokens
        spent[s] += cost(tokens)

    # sequences without room for this length, by their room: back in the heap as soon as lengths have come down to it
    waiting: list[list[int]] = [[] for _ in range(room + 1)]
    before = room + 1
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        for free in range(lengths[k], before):
            for s in waiting[free]:
                heapq.heappush(heap, (spent[s], s))
            waiting[free].clear()
        before = lengths[k]
        while heap and left[heap[0][1]] < lengths[k]:
            _, s = heapq.heappop(heap)
            waiting[left[s]].append(s)
        if heap:
            _, s = heapq.heappop(heap)
            put(k, s, lengths[k])
            if left[s]:
                heapq.heappush(heap, (spent[s], s))
        else:
            cut.append(k)
    roomy = [(-left[s], s) for s in range(n) if left[s]]
    heapq.heapify(roomy)
    for k in cut:
        rest = lengths[k]
        while rest:
            free, s = heapq.heappop(roomy)
            tokens = min(rest, -free)
            put(k, s, tokens)
            rest -= tokens
            if -free > tokens:
                heapq.heappush(roomy, (free + tokens, s))
    return out


def _narrow(ids: bytes, two: bool) -> bytes:
    """Two bytes an id where that holds the vocabulary."""
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if two else ids


def _wide(ids: bytes, n: int) -> bytes:
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _tokenized(vocabulary: str, end_id: int, room: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(ByteEncoder, vocabulary), struct.pack("<I", end_id)
        two = max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in pieces_of_batches(batches, "text", 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, room):
                    piece = ids[4 * at : 4 * (at + room)]
                    full = len(piece) == 4 * room
                    for column, v in zip(out, (key, at, len(piece) // 4, ids_crc32(piece), n, None if full else _narrow(piece, two)), strict=True):
                        column.append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [*_COLUMNS, "ids"])

    return pieces


def _packer(room: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*_COLUMNS, "sequence_id", "offset"])

        def packed() -> pa.RecordBatch:
            nonlocal sequence, rests
            filled: dict[int, int] = {}
            rows = []
            for row, parts in zip(rests, assign([r[2] for r in rests], room), strict=True):
                at = 0
                for s, tokens in parts:
                    # few rests are cut; the others keep the checksum that they came with
                    crc = row[3] if tokens == row[2] else ids_crc32(_wide(row[5], row[2])[4 * at : 4 * (at + tokens)])
                    rows.append((row[0], row[1] + at, tokens, crc, row[4], sequence + s, filled.get(s, 0)))
                    filled[s] = filled.get(s, 0) + tokens
                    at += tokens
            sequence, rests = sequence + len(filled), []
            return batch_of(rows)

        for batch in batches:
            whole = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5] is None:
                    whole.append((*row[:5], sequence, 0))
                    sequence += 1
                else:
                    rests.append(row)
                    if len(rests) == BLOCK_ROWS:
                        yield packed()
            if whole:
                yield batch_of(whole)
        if rests:
            yield packed()

    return pack


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, room: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = rows.mapInArrow(lean(_tokenized(vocabulary, end_id, room)), _PIECES)
    tasks = 1 + rows.select("doc_id").count() // DOCS_PER_TASK
    # by what the piece holds, not by doc_id alone: a frequent doc_id is spread, and a task that runs again deals alike
    dealt = pieces.repartition(tasks, "doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.sortWithinPartitions(*_COLUMNS).mapInArrow(lean(_packer(room)), _PACKED)
