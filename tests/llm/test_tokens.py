"""Counts, files and packing against the tokenizers library itself."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinspot.llm import packing, token_counts, token_files
from twinspot.llm.common import tokenizer_path
from twinspot.llm.pretokens import ByteEncoder, WordEncoder, encoder

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
    return lambda path, text: found[path].encode(text or "", add_special_tokens=False).ids


def _crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t ab'sdlS.,<|endoftext|>é1_́　\x1c\0")), st.characters(codec="utf-8")), max_size=40))
def test_encoders_equal_the_library(library, text):
    for kind, path in ((WordEncoder, WORD), (ByteEncoder, BYTE)):
        assert np.frombuffer(encoder(kind, path).encode(text), "<u4").tolist() == library(path, text)


def test_counts(odd, odd_rows, library):
    got = token_counts.count_tokens(odd, WORD, limit=100).collect()
    expected = Counter((r[0], len((r[1] or "").encode()), len(library(WORD, r[1]))) for r in odd_rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)


def test_files(odd, odd_rows, library, monkeypatch):
    got = token_files.token_files(odd, WORD).collect()
    ids = [[*library(WORD, r[1]), 2] for r in odd_rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(i), _crc(i)) for r, i in zip(odd_rows, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), max_size=6), st.randoms())
def test_any_token_of_a_shard(documents, rng):
    shard = token_files.Shard(token_files.encode_shard(list(range(len(documents))), [np.asarray(d, np.uint32) for d in documents]))
    flat = [x for d in documents for x in d]
    for k, d in enumerate(documents):
        assert shard.document(k).tolist() == d
    places = [rng.randrange(len(flat)) for _ in range(50)] if flat else []
    assert shard.at(np.asarray(places, np.int64)).tolist() == [flat[p] for p in places]
    lo = rng.randint(0, len(flat))
    hi = rng.randint(lo, len(flat))
    assert shard.span(lo, hi).tolist() == flat[lo:hi]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_assignment_fills_sequences(lengths):
    parts = packing.assign(lengths, 64)
    filled: dict[int, int] = defaultdict(int)
    for n, own in zip(lengths, parts, strict=True):
        assert sum(t for _, t in own) == n
        for s, t in own:
            filled[s] += t
    assert max(filled.values()) <= 64 and len(filled) == -(-sum(lengths) // 64)


def test_packing(odd, odd_rows, library):
    got = packing.pack(odd, BYTE).collect()
    ids = defaultdict(list)
    for r in odd_rows:
        ids[r[0]].append([*library(BYTE, r[1]), 1])
    pieces = Counter((r["doc_id"], r["doc_tokens"]) for r in got for _ in range(r["length"]))
    assert pieces == Counter((k, len(d)) for k, docs in ids.items() for d in docs for _ in d)
    for r in got:
        span = slice(r["start"], r["start"] + r["length"])
        assert r["ids_crc32"] in {_crc(d[span]) for d in ids[r["doc_id"]] if len(d) == r["doc_tokens"]}
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(none):
    assert token_counts.count_tokens(none, WORD).collect() == []
    assert token_files.token_files(none, WORD).collect() == []
    assert packing.pack(none, BYTE).collect() == []


def _lowest_cost_with_room(lengths, room):
    """The rule of ``assign`` by looking at every sequence for every rest; None where a rest is to be cut."""
    n = -(-sum(lengths) // room)
    left, spent, out = [room] * n, [0.0] * n, [None] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [s for s in range(n) if left[s] >= lengths[k]]
        if fits:
            s = min(fits, key=lambda s: (spent[s], s))
            out[k] = [(s, lengths[k])]
            left[s] -= lengths[k]
            spent[s] += packing.cost(lengths[k])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_assignment_takes_the_lowest_cost_with_room(lengths):
    for got, expected in zip(packing.assign(lengths, 64), _lowest_cost_with_room(lengths, 64), strict=True):
        assert expected is None or got == expected


def test_assignment_asks_full_sequences_once(monkeypatch):
    """Sequences without room are not looked at again for each rest."""
    lengths = np.random.default_rng(3).integers(1, 1400, 4000).tolist()
    pops, pop = [0], packing.heapq.heappop

    def counted(heap):
        pops[0] += 1
        return pop(heap)

    monkeypatch.setattr(packing.heapq, "heappop", counted)
    packing.assign(lengths, 2048)
    assert pops[0] < 4 * len(lengths)
