"""Structured Streaming: new events and figures as they come, and a store of jobs that forgets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of each window; ``events`` has ts, event_type, value, batch or stream."""
    own = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, schema, late: str = "1 hour") -> DataFrame:
    """Parquet files of events as they are put into a folder; what comes later than ``late`` is left out."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)


def figure_stream(spark: SparkSession, folder: str, most_bytes: int, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")) -> DataFrame:
    """path, digest, size, refused of each file put into a folder; refusals stay as rows with their reason.

    Spark's file sources pass over files without a byte, so these give no row.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    refused = F.when(~suffix.isin(*suffixes), "suffix").when(F.col("length") > most_bytes, "too_large")
    return files.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size"), refused.alias("refused"))


#: How long a job is kept, how many a store keeps, and states that don't end by time.
KEPT_SECONDS, KEPT_JOBS, OPEN = 3600, 64, ("queued", "running")


def _expired(jobs: list[list], now: int, seconds: int) -> tuple[list[list], list[list]]:
    """(those kept, those that have gone) of jobs [job, time in microseconds, status]; one that is as old as the limit goes."""
    gone = [j for j in jobs if j[1] <= now - seconds * 1_000_000 and j[2] not in OPEN]
    return [j for j in jobs if j not in gone], gone


def stored(jobs: list[list], events: list[tuple[int, str, str]], seconds: int, most: int) -> tuple[list[list], list[tuple[str, str, str, int]]]:
    """A store's jobs after ``events`` (time, job, status), and what left it: (job, last status, why, when).

    A new job goes to the end; an event of a known one renews it in its place. Old jobs go first, then the first ones beyond ``most``, whatever their state.
    """
    out = []
    for at, job, status in events:
        own = next((j for j in jobs if j[0] == job), None)
        if own:
            own[1:] = [at, status]
        else:
            jobs.append([job, at, status])
        jobs, gone = _expired(jobs, at, seconds)
        out += [(j[0], j[2], "expired", at) for j in gone]
        while len(jobs) > most:
            first = jobs.pop(0)
            out.append((first[0], first[2], "evicted", at))
    return jobs, out


def job_store(events: DataFrame, seconds: int = KEPT_SECONDS, most: int = KEPT_JOBS) -> DataFrame:
    """store, job, status, why, at of each job that leaves its store, from a stream of events (store, job, status, at) with a watermark.

    A store's state is its list of jobs, ``most`` at most. A timer of event time ends jobs of which nothing more is heard; queued and running ones don't end by
    time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs, out = json.loads(state.get[0]) if state.exists else [], []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() * 1000
            jobs, gone = _expired(jobs, now, seconds)
            out = [(j[0], j[2], "expired", now) for j in gone]
        else:
            rows = sorted((int(t.value // 1000), j, s) for frame in frames for t, j, s in zip(frame["at"], frame["job"], frame["status"], strict=True))
            jobs, out = stored(jobs, rows, seconds, most)
        if jobs:
            state.update((json.dumps(jobs),))
            ends = [j[1] // 1000 + seconds * 1000 for j in jobs if j[2] not in OPEN]
            if ends:
                state.setTimeoutTimestamp(max(min(ends), state.getCurrentWatermarkMs()) + 1)
        else:
            state.remove()
        yield pd.DataFrame([(key[0], job, status, why, pd.Timestamp(at, unit="us")) for job, status, why, at in out], columns=["store", "job", "status", "why", "at"])

    kind = events.schema["store"].dataType.simpleString()
    shape = f"store {kind}, job string, status string, why string, at timestamp"
    return events.select("store", F.col("job").cast("string").alias("job"), "status", "at").groupBy("store").applyInPandasWithState(step, shape, "jobs string", "append", GroupStateTimeout.EventTimeTimeout)
