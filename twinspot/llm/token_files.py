"""Token ids in directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits. Level k holds the k-th chunk of every id that has one, in
order, with one continuation bit each: set, the id goes on in level k + 1, at the place given by the number of
set bits before it. A rank directory keeps that number for every 512 bits, so any id of any document is read
with one chunk, one directory entry and one partial count of bits per level; nothing before it is decoded.

A shard file, all little-endian: magic ``DAC1``; u32 n_docs, u64 n_ids, u32 n_levels; i64 doc_id[n_docs] with
u8 null[n_docs]; u64 offset[n_docs + 1]; then for each level u64 n, u8 chunk[n], u64 word[ceil(n / 64)],
u64 rank[ceil(n / 512) + 1].

Shards are in ascending order of doc_id (nulls first), over all and in each; rows of one doc_id are ordered by a
hash of their text, so a task that runs again writes the same bytes. Files are written under a temporary name
and renamed. Null and empty texts hold the end id alone. An empty table gives no shards.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_crc32, pieces_of_batches, scratch, text_key
from .pretokens import WordEncoder, encoder

CHUNK_BITS = 8
#: Ids in a shard (a document is never cut); bounds the writer's and the reader's memory.
SHARD_IDS = 4 << 20
_BLOCK = 512

_MANIFEST = "part int, shard int, path string, n_docs bigint, n_ids bigint, file_bytes bigint"


def _levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continuation bits) of each level."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(CHUNK_BITS) != 0
        out.append(((rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8), more))
        if not more.any():
            return out
        rest = rest[more] >> np.uint64(CHUNK_BITS)


def encode_shard(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    levels, out = _levels(flat), io.BytesIO()
    out.write(b"DAC1" + struct.pack("<IQI", len(ids), len(flat), len(levels)))
    out.write(np.asarray([x or 0 for x in doc_ids], "<i8").tobytes() + np.asarray([x is None for x in doc_ids], "u1").tobytes())
    out.write(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8").tobytes())
    for chunk, more in levels:
        bits = np.zeros(-(-len(more) // 64) * 64, np.uint8)
        bits[: len(more)] = more
        words = np.packbits(bits, bitorder="little").view("<u8")
        blocks = np.add.reduceat(bits, np.arange(0, len(bits), _BLOCK), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        out.write(struct.pack("<Q", len(chunk)) + chunk.tobytes() + words.tobytes())
        out.write(np.concatenate([[0], np.cumsum(blocks)]).astype("<u8").tobytes())
    return out.getvalue()


class Shard:
    """Random access to the ids of one shard."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a shard of token ids")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<IQI", data, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        keys, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else int(k) for k, x in zip(keys, null, strict=True)]
        self.offsets = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("<u8", -(-n // 64)), take("<u8", -(-n // _BLOCK) + 1)))

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places of the shard."""
        out, where, places = np.zeros(len(places), np.uint64), np.arange(len(places)), np.asarray(places, np.int64)
        for k, (chunk, words, rank) in enumerate(self.levels):
            out[where] |= chunk[places].astype(np.uint64) << np.uint64(CHUNK_BITS * k)
            word = words[places >> 6]
            on = (word >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
            where, places, word = where[on], places[on], word[on]
            if not len(where):
                break
            before = rank[places // _BLOCK].astype(np.int64)
            first = places // _BLOCK * (_BLOCK // 64)
            for step in range(_BLOCK // 64):
                full = first + step < places >> 6
                before[full] += np.bitwise_count(words[(first + step)[full]])
            mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            places = before + np.bitwise_count(word & mask)
        return out.astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.at(np.arange(self.offsets[k], self.offsets[k + 1]))

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi. Runs of ids lie in runs of each level, so one rank per level finds them all."""
        out, where, n = np.zeros(hi - lo, np.uint64), np.arange(hi - lo), hi - lo
        for k, (chunk, words, rank) in enumerate(self.levels):
            out[where] |= chunk[lo : lo + n].astype(np.uint64) << np.uint64(CHUNK_BITS * k)
            w0 = lo >> 6
            bits = np.unpackbits(words[w0 : (lo + n + 63) >> 6].view(np.uint8), bitorder="little")
            on = bits[lo - (w0 << 6) : lo - (w0 << 6) + n].astype(bool)
            where = where[on]
            if not len(where):
                break
            block = lo // _BLOCK
            ahead = np.unpackbits(words[block * (_BLOCK // 64) : w0 + 1].view(np.uint8), bitorder="little")
            lo, n = int(rank[block]) + int(ahead[: lo - block * _BLOCK].sum(dtype=np.int64)), len(where)
        return out.astype(np.uint32)


def _filesystem(path: str):
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def _writer(vocabulary: str, folder: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, enc = TaskContext.get(), encoder(WordEncoder, vocabulary)
        fs, root = _filesystem(folder)
        end, part, shard = struct.pack("<I", end_id), context.partitionId(), 0
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, keys, ids, held
            name = f"part-{part:06d}-{shard:05d}.dac"
            data = encode_shard(keys, ids)
            aside = f"{root}/_{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(aside) as out:
                out.write(data)
            fs.move(aside, f"{root}/{name}")
            row = [part, shard, f"{folder}/{name}", len(keys), held, len(data)]
            shard, keys, ids, held = shard + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["part", "shard", "path", "n_docs", "n_ids", "file_bytes"]).cast(
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("file_bytes", pa.int64())])
            )

        for batch in pieces_of_batches(batches, "text", 8 << 20):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(enc.encode(text or "") + end, "<u4")
                if held and held + len(got) > SHARD_IDS:
                    yield flush()
                keys.append(key)
                ids.append(got)
                held += len(got)
        if keys:
            yield flush()

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write the shards; one row per file: part, shard, path, n_docs, n_ids, file_bytes."""
    spark = docs.sparkSession
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("_tie"))
    dealt = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    manifest = dealt.mapInArrow(_writer(vocabulary, folder, end_id), _MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def _reader(starts: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    shard = Shard(f.read())
                base = starts[row["part"]] + row["before"]
                lengths, sums = np.diff(shard.offsets), []
                for lo, hi in zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist(), strict=True):
                    sums.append(ids_crc32(shard.span(lo, hi).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids, pa.int64()), pa.array(shard.offsets[:-1] + base, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the shards' files."""
    # one number for each task that wrote, as a stage's own bookkeeping has it
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, so_far = {}, 0
    for part, n in totals:
        starts[part], so_far = so_far, so_far + n
    from pyspark.sql import Window

    ahead = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))
    # a number of partitions of its own: by their size alone, Spark would merge these few rows into one task
    placed = placed.select("part", "path", "before").repartition(max(1, len(totals)), "path")
    return placed.mapInArrow(_reader(starts), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids and read them back."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id))
