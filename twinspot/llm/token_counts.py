"""Token counts: pieces are counted once per distinct pre-token and summed over per-document frequencies.

Documents are taken in blocks of bounded text. A block is a sparse matrix: documents by the distinct
pre-tokens of the block, holding frequencies. Only each block's list of distinct pre-tokens is shuffled, so a
frequent pre-token costs one row per block, not one per document. Spark brings equal pre-tokens of all
blocks together in sorted order, so that each one's pieces are counted once; the counts go back to their blocks, and
a product of each block's
matrix with its vector of piece counts gives the documents' totals. No ids are made. The matrices travel without
their pre-tokens, as compressed differences.

Nulls and empty texts have 0 tokens. Repeated rows are counted each. Special strings inside a text count as the
library has it: they stand in the list as themselves. Very long texts are taken whole, as a block of their own. Empty tables give empty results; further columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of_batches, written
from .pretokens import WordEncoder, encoder

#: Bytes of text in a block; bounds a task's memory.
BLOCK_BYTES = 14 << 20
#: Set before a word that holds a special string; such a word is counted whole. No pre-token starts with it.
WHOLE = "\n"

_MATRIX = "block bigint, ids array<bigint>, n_bytes array<bigint>, offsets binary, cells bigint, columns binary, counts binary, pretokens array<string>"


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers of 32 bits: all first bytes, then all second ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(held, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _matrices(path: str):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, number = encoder(WordEncoder, path), TaskContext.get().partitionId(), 0

        def made() -> pa.RecordBatch:
            nonlocal number
            # a raw word may hold several pre-tokens: columns of raw words become columns of pre-tokens
            columns: dict[str, int] = {}
            at, flat = [0], []
            for word in words:
                pre = (WHOLE + word,) if word[0] == WHOLE else enc.pretokens(word)
                for p in (WHOLE + word,) if pre is None else pre:
                    flat.append(columns.setdefault(p, len(columns)))
                at.append(len(flat))
            starts, flat_columns = np.asarray(at), np.asarray(flat, np.int64)
            raw = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(ids)), [len(r) for r in rows])
            n = (starts[1:] - starts[:-1])[raw]
            at_each = np.repeat(starts[:-1][raw] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
            cell = np.repeat(doc, n) * max(1, len(columns)) + flat_columns[at_each]
            cell, count = np.unique(cell, return_counts=True)
            cell_doc, cell_column = np.divmod(cell, max(1, len(columns)))
            offsets = np.searchsorted(cell_doc, np.arange(len(ids) + 1))
            step = np.diff(cell_column, prepend=0)
            begins = offsets[:-1][offsets[:-1] < offsets[1:]]
            step[begins] = cell_column[begins]
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.array([task << 24 | number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([offsets.astype("<i4").tobytes()], pa.binary()),
                pa.array([len(cell)], pa.int64()),
                pa.array([_packed(step)], pa.binary()),
                pa.array([_packed(count)], pa.binary()),
                pa.array([list(columns)], pa.list_(pa.string())),
            ], ["block", "ids", "n_bytes", "offsets", "cells", "columns", "counts", "pretokens"])

        ids, sizes, rows, held = [], [], [], 0
        words: dict[str, int] = {}
        for batch in pieces_of_batches(batches, "text", 2 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                    found = [WHOLE + text]
                else:
                    found = text.split()
                rows.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                ids.append(doc_id)
                size = len(text) if text.isascii() else len(text.encode())
                sizes.append(size)
                held += size
                if held >= BLOCK_BYTES:
                    yield made()
                    ids, sizes, rows, held, words = [], [], [], 0, {}
        if ids:
            yield made()

    return blocks


def _piece_counts(path: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, value: place and pieces of each listed pre-token. Equal ones come in a row and are counted once."""
        enc, last, known = encoder(WordEncoder, path), None, 0
        for batch in batches:
            coded = batch.column(batch.schema.names.index("pretoken")).dictionary_encode()
            counts = np.zeros(len(coded.dictionary), np.int64)
            for k, p in enumerate(coded.dictionary.to_pylist()):
                if p != last:
                    last, known = p, len(enc.whole(p[len(WHOLE) :].removeprefix(WHOLE))) // 4 if p[0] == WHOLE else enc.count(p)
                counts[k] = known
            at = np.asarray(batch.column(batch.schema.names.index("at"))).astype(np.int64)
            value = at << 32 | counts[np.asarray(coded.indices)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("block")), pa.array(value)], ["block", "value"])

    return pieces


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
            size = len(row["vector"])
            packed = row["vector"].values.to_numpy(zero_copy_only=False) if size else np.zeros(0, np.int64)
            vector = np.zeros(size, np.int64)
            vector[packed >> 32] = packed & 0xFFFFFFFF
            offsets = np.frombuffer(row["offsets"].as_py(), "<i4").astype(np.int64)
            n = row["cells"].as_py()
            along = np.concatenate([[0], np.cumsum(_unpacked(row["columns"].as_py(), n))])
            column = along[1:] - np.repeat(along[offsets[:-1]], np.diff(offsets))
            part = np.concatenate([[0], np.cumsum(vector[column] * _unpacked(row["counts"].as_py(), n))])
            yield pa.RecordBatch.from_arrays([
                row["ids"].values, row["n_bytes"].values, pa.array(part[offsets[1:]] - part[offsets[:-1]], pa.int64()),
            ], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text)."""
    matrices = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_matrices(vocabulary), _MATRIX), "pretoken-blocks")
    listed = matrices.select("block", F.posexplode("pretokens").alias("at", "pretoken"))
    # one row per block and pre-token: no pre-token has more rows than there are blocks
    together = listed.repartition("pretoken").sortWithinPartitions("pretoken")
    values = together.mapInArrow(_piece_counts(vocabulary), "block bigint, value bigint")
    vectors = values.groupBy("block").agg(F.collect_list("value").alias("vector"))
    joined = matrices.drop("pretokens").join(vectors, "block", "left").withColumn("vector", F.coalesce("vector", F.array().cast("array<bigint>")))
    counted = joined.mapInArrow(_products, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
