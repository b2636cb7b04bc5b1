"""The registered queries over whole tables: against SQL where there is some, and op2 against what its stored bytes must be."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from twinspot.llm import queries, transport
from twinspot.llm.common import table


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = queries.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    expected = duck.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r[n] for n in names) for r in found.collect()) == Counter(expected)


def test_media_columns(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    seen = {}
    for r in queries.op2_transport_streams(spark, sf_dir).collect():
        payload = texts[r["doc_id"]] + b"\0" * (-len(texts[r["doc_id"]]) % 64 or (64 if not texts[r["doc_id"]] else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        # a stream of whole packets, longer than what it carries; equal texts have equal streams, others don't
        assert r["media_bytes"] % transport.PACKET == 0 and r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64 and r["feature"]
        assert seen.setdefault(texts[r["doc_id"]], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert len({m for m, _ in seen.values()}) == len(seen)
