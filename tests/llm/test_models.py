"""Language ID, toxicity, transport streams and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspot.llm import language, toxicity, transport


def _prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = language._new(["a", "b", "c"])
    data, mask, label = rng.integers(0, 6, (5, 7)).astype(np.uint8), np.ones((5, 7), np.float32), rng.integers(0, 3, 5)
    mask[2, 5:] = 0
    _, grads = language.gradients(net, data, mask, label)
    params = [net.ahead.inputs, net.ahead.recurrent, net.behind.inputs, net.behind.recurrent, net.out, net.bias]
    for p, g in zip(params, grads, strict=True):
        for _ in range(5):
            at = tuple(int(rng.integers(0, min(n, 6))) for n in p.shape)
            kept = p[at]
            losses = []
            for d in (0.01, -0.01):
                p[at] = kept + d
                losses.append(language.gradients(net, data, mask, label)[0])
            p[at] = kept
            assert abs((losses[0] - losses[1]) / 0.02 - g[at]) < 2e-3


def test_language_learns_and_marks_unknown(spark, none):
    rng = random.Random(1)
    rows = [(k, _prose(rng, "abcdefg" if k % 2 else "tuvwxyz", 30), "x" if k % 2 else "y") for k in range(80)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "12 34 !", "y"), (203, rows[0][1], None), (None, rows[1][1], "x")]
    got = {r["doc_id"]: r for r in language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for k, _, lang in rows[:80]:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1
    assert [got[k]["lang_pred"] for k in (200, 201, 202, 203)] == ["und"] * 3 + ["y"]
    assert language.languages(none).collect() == []


def test_rows_of_all_kinds_are_scored(spark, odd, odd_rows, none):
    """Null and clashing columns, empty and long texts, repeated rows: each row comes out, equal ones alike."""
    found = language.languages(odd).collect()
    assert len(found) == len(odd_rows) and {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    marks = spark.createDataFrame([(k, k % 2, "x") for k in range(1, 20)], "doc_id long, toxic int, text string")
    scored = toxicity.toxicity(odd, marks).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in scored)
    left = toxicity.without_toxic(odd, marks)
    assert left.columns == odd.columns and left.count() == sum(r["predicted"] == 0 for r in scored)
    assert toxicity.without_toxic(none, marks).collect() == []
    assert language.languages(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_held_out_rows_of_the_tables(spark):
    """What the models say of rows that they haven't learnt from."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = language.languages(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(got) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    marked = toxicity.toxicity(docs, labels).where("held_out").join(labels.where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = [r["predicted"] for r in marked if r["toxic"]], [r["predicted"] for r in marked if not r["toxic"]]
    assert len(toxic) >= 5 and np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.1


def test_an_insult_with_blanks_is_one_string():
    assert {"^idiot$", "^stupid$"} <= set(toxicity.strings_of("you id io t and. st up id!"))
    assert "^nitwit$" in toxicity.strings_of("N i t w i t") and toxicity.strings_of("a be") == ["^abe$"] and toxicity.strings_of("") == []


def test_kernel_of_the_table_equals_the_kernel_itself():
    words = ["^stupid$", "^stuupid$", "^banana$", "^xyz$"]
    features = [toxicity._features(w) for w in words]
    exact = [[sum(v * b.get(t, 0) for t, v in a.items()) for b in features] for a in features]
    assert np.allclose(toxicity._kernel(words, features), exact)
    assert exact[0][1] > 0.6 > exact[0][2]


def test_toxicity_tolerates_gaps_and_inserted_letters(spark, none):
    rng = random.Random(2)
    insults = ["blockhead", "nitwit"]
    rows, labels = [], []
    for k in range(160):
        words = _prose(rng, "aeimnorst", 25).split()
        if k % 3 == 0:
            words[7] = insults[k % 2]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    extra = [(500, _prose(rng, "aeimnorst", 10) + " blockheead"), (501, "n i t w i t " + _prose(rng, "aeimnorst", 10)), (502, None), (503, ""), (504, "n*i*t*w*i*t, " + rows[1][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    assert all(got[k]["predicted"] == y for k, y in labels)
    assert [got[k]["predicted"] for k in (500, 501, 502, 503, 504)] == [1, 1, 0, 0, 1]
    left = toxicity.without_toxic(docs, marks)
    assert left.columns == docs.columns and left.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.toxicity(none, marks).collect() == []
    assert {r["score"] for r in toxicity.toxicity(docs, marks.where("toxic = 0")).collect()} == {0.0}


@pytest.mark.parametrize("size", [1, 63, 159, 160, 161, 162, 163, 170, 175, 176, 183, 184, 185, 360, 16384, 16385, 16384 * 9 + 7])
def test_streams_round_trip(size):
    payload = os.urandom(size)
    media, pts, points = transport.mux(payload)
    got = transport.demux(media)
    assert got.payload == payload and got.pts == pts and not got.breaks and not got.damaged
    assert len(media) % transport.PACKET == 0 and len(points) == -(-len(pts) // transport.RAP_EVERY)
    if len(points) > 1:
        assert transport.demux(media, points[1]).payload == payload[transport.UNIT_BYTES * transport.RAP_EVERY :]


def test_a_lost_packet_is_counted_and_its_unit_left_out():
    payload = os.urandom(transport.UNIT_BYTES * 3)
    media = transport.mux(payload)[0]
    cut = transport.PACKET * 120
    got = transport.demux(media[:cut] + media[cut + transport.PACKET :])
    assert got.breaks == 1 and got.damaged and got.payload == payload[:transport.UNIT_BYTES] * 0 + payload[: transport.UNIT_BYTES] + payload[2 * transport.UNIT_BYTES :]


def test_media_of_texts(odd, odd_rows, none):
    got = transport.media_features(odd).collect()
    texts = {}
    for r in odd_rows:
        data = (r[1] or "").encode()
        texts.setdefault(r[0], set()).add(hashlib.sha256(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")).hexdigest())
    assert len(got) == len(odd_rows) and all(r["payload_sha256"] in texts[r["doc_id"]] for r in got)
    assert transport.media_features(none).collect() == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    from twinspot.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        assert 0.5 * n < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n


def test_stages_take_rows_of_all_kinds(spark, odd, odd_rows, none, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and an empty table go through each stage as a stage."""
    import corpus_pipeline
    from twinspot.llm.common import written

    folder = f"file://{tmp_path}"
    spark.createDataFrame([(k, k % 2, None) for k in range(1, 20)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "don't stop istanbul"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (odd, none):
        n = rows.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = written(stage(spark, rows, folder), "stage")
            assert kept.columns == rows.columns and kept.count() <= n, name
            if name == "line dedup":
                assert kept.count() == n
            if name == "near dedup" and n:
                # each text without words stays, once for each doc_id
                assert {5, 6, 7} <= {r["doc_id"] for r in kept.collect()}
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, folder)
        assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
