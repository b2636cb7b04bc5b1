"""Intermediate tables in the folder that all executors share, and how rows that take long are dealt."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the folder of ``spark.checkpoint.dir`` and read them back, so that they outlive any executor.

    Only a local session, where driver and executors are one process, may go without that setting; it gets a folder of its own.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task, about, where each row is an image or holds the keypoints of some, and tasks at most.
FEW, MOST_TASKS = 8, 2000


def spread(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Deal rows that are few in bytes and take long, such as images, over tasks of some rows each; ``n`` is their number, counted if not given.

    Spark reckons in bytes and would leave thousands of small images to one task. It also hands a task's rows to Python in batches of many rows.
    """
    n = rows.count() if n is None else n
    return rows.repartition(max(1, min(MOST_TASKS, -(-n // FEW))), *keys)
