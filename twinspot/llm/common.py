"""What the corpus operators share: tables, written intermediates, row keys."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows for which a table of known size has a file of its own.
FILE_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only a local session, where driver and executors are one
    process, may go without that setting; it then gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Unlike a cached or locally checkpointed frame, the copy outlives any executor. Where a bound of the number of rows is known, there are no more
    tasks, and files, than one for each ``FILE_ROWS`` of them.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(df: DataFrame, rows: int | None) -> DataFrame:
    """Few rows, where ``rows`` says that there are ``FILE_ROWS`` at most, in one partition: no grouping of them needs a shuffle."""
    return df.coalesce(1) if rows is not None and rows <= FILE_ROWS else df


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id but different texts apart; equal (doc_id, text) rows share all results."""
    return F.xxhash64(F.col(text))


def pieces_of_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text column holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(values)
        lo = 0
        while lo < batch.num_rows:
            hi = int(offsets.searchsorted(offsets[lo] + limit, side="right")) - 1
            hi = min(batch.num_rows, max(hi, lo + 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The kernel for ``mapInArrow``, whose worker hands free memory back to the system when its task ends.

    Spark keeps a worker for the tasks of later stages, and for a while without any; what its allocators hold free counts as the executor's all that time.
    """

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # only glibc has it
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def buffers(values: pa.Array):
    """(bytes, offsets) of a text or binary column as numpy arrays; nulls are empty."""
    import numpy as np

    if values.null_count:
        values = values.fill_null(b"" if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else "")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offs, data = values.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def tokenizer_path(name: str) -> str:
    """The vocabulary file of a public tokenizer; TOKENIZER_DIR names another folder of such files."""
    root = os.environ.get("TOKENIZER_DIR")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
