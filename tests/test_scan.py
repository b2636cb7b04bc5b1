"""Scans from figures to findings, the stored index, and the stream of jobs."""

from __future__ import annotations

import random
from collections import Counter
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_keypoints import texture
from twinspot import streaming
from twinspot.operators import pixels, scan

SHAPE = "name string, width int, height int, gray binary, error string"


def _row(name, image, error=None):
    return (name, None, None, None, error) if image is None else (name, image.shape[1], image.shape[0], np.ascontiguousarray(image).tobytes(), error)


def test_scan_finds_the_turned_panel(spark):
    one, two, three = texture(150, 150, 1), texture(150, 150, 2), texture(150, 150, 3)
    figure = np.full((200, 380), 255, np.uint8)
    # panels dark enough to stand out from the page
    figure[25:175, 25:175], figure[25:175, 205:355] = one // 2, two // 2
    rows = [_row("fig1", figure), _row("fig2", np.rot90(figure[:, :190], 2)), _row("fig3", three), _row("bad", None, "undecoded")]
    found, coverage = scan.scanned(spark.createDataFrame(rows, SHAPE), "name", hamming=20, most=3, scale=2.0)
    got = {(r["a"].removesuffix("_unsplit"), r["b"].removesuffix("_unsplit")): r for r in found.collect()}
    hit = got["fig1_p00", "fig2_p00"]
    assert hit["reason"] == "none" and hit["flagged"] and hit["rank"] == 1 and abs(abs(hit["rotation_deg"]) - 180) < 2
    assert all(not r["flagged"] and r["rank"] is None for k, r in got.items() if k != ("fig1_p00", "fig2_p00"))
    c = coverage.first()
    assert (c["figures"], c["unread"], c["panels"], c["pairs"]) == (4, 1, 4, 6) and c["compared"] == min(3, c["near"]) == len(got)
    assert c["screened_out"] + c["near"] == 6 and c["truncated"] == c["near"] - c["compared"] and c["readable"] == 0.75


def test_scan_of_nothing(spark):
    found, coverage = scan.scanned(spark.createDataFrame([], SHAPE), "name")
    assert found.collect() == [] and coverage.first()["coverage"] == 1.0


def test_index_on_disk(spark, tmp_path):
    images = {f"i{k}": texture(64, 64, k) for k in range(12)}
    stored = spark.createDataFrame([_row(k, v) for k, v in images.items()] + [_row("bad", None, "undecoded: x")], SHAPE)
    scan.write_index(stored, "name", f"file://{tmp_path}/index")
    index = scan.read_index(spark, f"file://{tmp_path}/index")
    assert index.where("name = 'bad'").first()["error"] == "undecoded: x" and index.count() == 13
    asked = spark.createDataFrame([_row("turned", np.rot90(images["i5"])), _row("mirror", images["i7"][:, ::-1])], SHAPE)
    got = scan.lookup(index, asked, "name", k=3, hamming=64).collect()
    first = {r["name"]: 0 for r in got}
    best = {(r[0], r[1]): r["hamming"] for r in got if r["rank"] == 1}
    assert best == {("turned", "i5"): 0, ("mirror", "i7"): 0} and len(got) == 6 and first
    assert {r[1] for r in scan.lookup(index, asked, "name", k=3, hamming=4).collect()} == {"i5", "i7"}
    # against the definition
    bits = lambda image: [int(pixels.cosine_bits(t), 2) for t in pixels.turns(image)]
    known = {k: bits(v) for k, v in images.items()}
    own = bits(np.rot90(images["i5"]))[0]
    want = sorted((min((own ^ t).bit_count() for t in turns), k) for k, turns in known.items())[:3]
    assert [h for h, _ in want] == sorted(r["hamming"] for r in got if r[0] == "turned")
    with pytest.raises(ValueError, match="no index"):
        spark.range(3).write.parquet(f"file://{tmp_path}/other")
        scan.read_index(spark, f"file://{tmp_path}/other")


def test_jobs_leave_their_store(spark, tmp_path):
    rng, start = random.Random(4), 1_700_000_000_000_000
    events, now = [], start
    for _ in range(400):
        now += rng.randint(1, 200) * 1_000_000
        events.append((f"s{rng.randint(0, 1)}", f"j{rng.randint(0, 40)}", rng.choice(["queued", "running", "done", "failed"]), now))
    events += [(s, "last", "queued", now + 4000 * 1_000_000) for s in ("s0", "s1")]
    want = Counter()
    for s in ("s0", "s1"):
        left, gone = streaming.stored([], [(at, j, st) for own, j, st, at in events if own == s], 3600, 5)
        want.update((s, j, st, why) for j, st, why, _ in gone)
    assert {k[3] for k in want} == {"expired", "evicted"}
    folder = str(tmp_path / "events")
    schema = "store string, job string, status string, at timestamp"
    for k in range(0, len(events), 60):
        rows = [(s, j, st, datetime.fromtimestamp(at / 1e6, UTC)) for s, j, st, at in events[k : k + 60]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}").withWatermark("at", "0 seconds")
    left = streaming.job_store(stream, 3600, 5)
    query = left.writeStream.format("memory").queryName("left_jobs").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = Counter((r["store"], r["job"], r["status"], r["why"]) for r in spark.table("left_jobs").collect())
    assert got == want
    assert spark.table("left_jobs").where(F.col("at").isNull()).count() == 0
