"""Near copies, repeated windows, repeated lines and benchmark windows against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinspot.llm import buckets, components, decontaminate, line_dedup, near_dup, substring_dedup
from twinspot.llm.fm_index import FMIndex, statistics
from twinspot.llm.line_dedup import EDITS, PER, allowed, early, keys, within

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(odd, odd_rows):
    sets, classes = [_shingles(r[1]) for r in odd_rows], Sets()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                classes.join(i, j)
    least = defaultdict(list)
    for i, r in enumerate(odd_rows):
        if r[0] is not None:
            least[classes.find(i)].append(r[0])
    expected = Counter(
        (r[0], len(s), min(least[classes.find(i)], default=None) if s else r[0], (r[0] == min(least[classes.find(i)], default=None)) if s else True)
        for i, (r, s) in enumerate(zip(odd_rows, sets, strict=True))
    )
    got = near_dup.near_duplicates(odd).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == expected
    kept = [r["doc_id"] for r in near_dup.deduplicated(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22]


def test_pipeline_drops_near_copies_from_080_on(spark):
    import corpus_pipeline

    rng, rows = random.Random(8), []
    for k in range(0, 40, 2):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(104)]
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words[:94], *(f"x{k}y{j}" for j in range(10))]))]
    assert len(_shingles(rows[0][1]) & _shingles(rows[1][1])) / len(_shingles(rows[0][1]) | _shingles(rows[1][1])) == 90 / 110
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == list(range(0, 40, 2))
    assert near_dup.near_duplicates(docs, percent=85).where("kept").count() == 40


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=60), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), max_size=40), max_size=4))
def test_matching_statistics(texts, asked):
    index = FMIndex(np.asarray([x for t in texts for x in [*t, 0]]), 5)
    length = 5
    found = {(t, p) for text, place, _ in statistics(index, [np.asarray(a, np.int64) for a in asked], length) for t, p in zip(text.tolist(), place.tolist(), strict=True)}
    held = {tuple(t[k : k + length]) for t in texts for k in range(len(t) - length + 1)}
    assert found == {(i, k) for i, a in enumerate(asked) for k in range(len(a) - length + 1) if tuple(a[k : k + length]) in held}


def _without_windows(rows):
    docs = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for k in range(len(w) - 49):
                x = tuple(w[k : k + 50])
                first[x] = min(first.get(x, d), d)
    out = Counter()
    for d, w in docs:
        gone = {j for k in range(len(w) - 49) if d is not None and first[tuple(w[k : k + 50])] < d for j in range(k, k + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shard", [300_000, 500])
def test_repeated_windows(odd, odd_rows, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    assert Counter(map(tuple, substring_dedup.without_repeats(odd).collect())) == _without_windows(odd_rows)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, edits):
    assert within(a, b, edits) == (_distance(a, b) <= edits)


def _edited(rng, a):
    b = list(a)
    for _ in range(rng.randint(0, EDITS)):
        k = rng.randint(0, len(b))
        b[k : k + rng.randint(0, 1)] = rng.choice(["", "x"])
    return "".join(b)


def test_linked_lines_share_a_key():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randint(PER, 60)))
        b = _edited(rng, a)
        if within(a, b, allowed(min(len(a), len(b)))):
            assert keys(a) & keys(b)


def test_linked_lines_share_an_early_run():
    rng = random.Random(4)
    n = line_dedup.GRAM

    def runs(line, uses):
        grams = [line[k : k + n] for k in range(len(line) - n + 1)]
        first, apart = early(np.asarray([uses[g] for g in grams]), np.asarray([hash(g) for g in grams]), np.arange(len(grams)), allowed(len(line)))
        return {(grams[k], int(k)) for k in first}, {(grams[k], k) for k in apart}

    for _ in range(2000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(PER, 70)))
        b = _edited(rng, a)
        if a == b or not within(a, b, allowed(min(len(a), len(b)))):
            continue
        uses = defaultdict(lambda: rng.randint(1, 5))
        (first_a, apart_a), (first_b, apart_b) = runs(a, uses), runs(b, uses)
        near = lambda own, other: any(g == h and abs(i - j) <= EDITS for g, i in own for h, j in other)
        assert near(apart_a, first_b) or near(apart_b, first_a)


def test_linked_lines_meet_in_a_cell():
    rng = random.Random(6)
    bits = lambda x: (x & 2**64 - 1).bit_count()  # noqa: E731  of a signed number of 64 bits
    placed = line_dedup._placed(np.zeros(line_dedup.CELLS, np.int32))
    for _ in range(400):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(PER, 90)))
        b = _edited(rng, a)
        if a == b or not within(a, b, allowed(min(len(a), len(b)))):
            continue
        batch = pa.RecordBatch.from_pydict({"node": [b"a", b"b"], "root": [b"a", b"b"], "line": [a, b]})
        rows = [r for out in placed(iter([batch])) for r in out.to_pylist()]
        assert any(
            x["owner"] and y["seeker"] and x["node"] != y["node"] and x["band"] == y["band"]
            and abs(x["place"] - y["place"]) + abs(x["size"] - y["size"] - x["place"] + y["place"]) <= EDITS
            and bits(x["points"] ^ y["points"]) <= 2 * EDITS and bits(x["twos"] ^ y["twos"]) <= 4 * EDITS
            for x in rows for y in rows
        )


def test_hot_bucket_of_unlinked_lines(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    first, rows = word(20), []
    for k in range(0, 4000, 2):
        middle, last = word(20), word(20)
        rows.append((k, first + middle + last))
        # every 400th has a partner with an edit in each of the other thirds, so that only the hot segment is common
        planted = k % 400 == 0
        rows.append((k + 1, first + middle[:10] + "X" + middle[11:] + last[:10] + "X" + last[11:] if planted else first + word(40)))
    got = line_dedup.line_figures(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in got.where("n_near > 0").collect()) == [k + 1 for k in range(0, 4000, 400)]


def test_hot_bucket_of_unlinked_texts(spark):
    """3,000 texts of one bucket, ten planted pairs among them; each shingle is in some twenty texts, so that none is rare."""
    rng = random.Random(12)
    texts = {k: " ".join(rng.choice("abcdef") for _ in range(60)) for k in range(3000)}
    for k in range(0, 3000, 300):
        texts[k + 1] = f"x {texts[k][2:]}"
    sets = {k: _shingles(t) for k, t in texts.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    name = lambda k: k.to_bytes(2, "big")
    rows = spark.createDataFrame([(name(k), t) for k, t in texts.items()], "node binary, text string")
    tested = []

    def test(pairs):
        tested.extend((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in pairs.collect())
        return pairs.where(F.udf(lambda a, b: alike(int.from_bytes(a, "big"), int.from_bytes(b, "big")), "boolean")("a", "b"))

    members = rows.select(F.lit(1).cast("long").alias("band"), "node")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in buckets.linked_roots(members, test, *near_dup._rarest(rows, 75)).collect()}
    assert {(k, v) for k, v in got.items() if k != v} == {(k + 1, k) for k in range(0, 3000, 300)}
    assert len(tested) < 3000 * 2999 // 2 // 20


def test_bucket_of_loosely_linked_texts(spark):
    """A chain in which only neighbours are linked, all in one bucket, and texts that hang on it nowhere."""
    words = [f"w{k}" for k in range(5000)]
    texts = {k: " ".join(words[k * 3 : k * 3 + 100]) for k in range(400)} | {k: " ".join(f"v{k}x{j}" for j in range(90)) for k in range(400, 500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = docs.select(F.col("doc_id").cast("string").cast("binary").alias("node"), "text")
    sets = {k: _shingles(t) for k, t in texts.items()}
    alike = lambda a, b: 100 * len(sets[int(a)] & sets[int(b)]) >= 85 * len(sets[int(a)] | sets[int(b)])
    test = lambda pairs: pairs.where(F.udf(lambda a, b: alike(bytes(a), bytes(b)), "boolean")("a", "b"))
    got = buckets.linked_roots(rows.select(F.lit(1).cast("long").alias("band"), "node"), test, *near_dup._rarest(rows, 85)).collect()
    assert {int(bytes(r["node"])) for r in got} == set(range(400)) and len({bytes(r["root"]) for r in got}) == 1


def test_pairs_of_most_shared_buckets_come_first(spark):
    """Slices of owners list each pair of two roots; of a node's pairs, the one of most shared buckets is asked first."""
    # node k is in buckets k to k + 3: nodes of neighbouring numbers share most
    rows = [(band, bytes([k]), bytes([k]), True, True) for k in range(30) for band in range(k, k + 4)]
    fine = spark.createDataFrame(rows, "band long, node binary, root binary, owner boolean, seeker boolean")
    ends = [0, *buckets.SLICES]
    got = [r for lo, hi in zip(ends, ends[1:], strict=False) for r in buckets._cross(fine, "x.node < y.node", lo, hi).collect()]
    assert {(r["a"][0], r["b"][0]): r["n"] for r in got} == {(a, b): 4 - (b - a) for a in range(30) for b in range(a + 1, min(30, a + 4))}
    best = buckets._best(spark.createDataFrame(got, buckets.LINK + ", n long")).collect()
    assert all(r["b"][0] - r["a"][0] == 1 for r in best) and {x[0] for r in best for x in (r["a"], r["b"])} == set(range(30))


def test_members_move_once_for_all_links_of_a_slice(spark, monkeypatch):
    """A chain of 60 nodes in one bucket, of which no star finds much: each slice has several tests, and its members move once, not once for each."""
    monkeypatch.setattr(buckets, "PAIRS", 0)
    moves, move = [], buckets._moved
    monkeypatch.setattr(buckets, "_moved", lambda rows, *a: moves.append("owner" in rows.columns) or move(rows, *a))
    members = spark.createDataFrame([(1, bytes([k])) for k in range(60)], "band long, node binary")
    finer = lambda roots: roots.select(F.lit(1).cast("long").alias("band"), "node", "root", F.lit(True).alias("owner"), F.lit(True).alias("seeker"))
    test = lambda pairs: pairs.where("abs(int(conv(hex(a), 16, 10)) - int(conv(hex(b), 16, 10))) = 1").select("a", "b", "root_a", "root_b")
    got = {(r["node"][0], r["root"][0]) for r in buckets.linked_roots(members, test, finer, "x.node < y.node").collect()}
    assert got == {(k, 0) for k in range(60)}
    # one of them after the star
    assert sum(moves) <= len(buckets.SLICES)


def test_few_links_are_contracted_without_shuffles(spark, monkeypatch):
    plans, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (3, 4)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), len(edges)).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)}
    assert plans and not any("hashpartitioning" in p for p in plans)


def test_sides_of_pairs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(buckets, "SHARE", 7)
    values = spark.createDataFrame([(bytes([k]), f"t{k}") for k in range(100)], "node binary, text string")
    pairs = spark.createDataFrame([(b"\x00", bytes([k]), b"", b"") for k in range(1, 100)] + [(b"\x01", b"\x02", b"", b"")], buckets.LINK)
    got = sorted((r["a"][0], r["b"][0], r["text_a"], r["text_b"]) for r in buckets.paired(pairs, values).collect())
    assert got == [(0, k, "t0", f"t{k}") for k in range(1, 100)] + [(1, 2, "t1", "t2")]


def test_repeated_lines(odd, odd_rows):
    lines, classes = {}, Sets()
    for r in sorted(set(odd_rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((r[1] or "").split("\n")):
            if line.strip():
                lines.setdefault(line, (r[0] is None, r[0], k))
    for a in lines:
        for b in lines:
            if a == b or within(a, b, allowed(min(len(a), len(b)))):
                classes.join(a, b)
    first = {}
    for line, place in lines.items():
        root = classes.find(line)
        first[root] = min(first.get(root, place), place)
    expected = Counter()
    for r in odd_rows:
        own = (r[1] or "").split("\n")
        kept = [x for k, x in enumerate(own) if not x.strip() or first[classes.find(x)] == (r[0] is None, r[0], k)]
        expected[r[0], 0 if r[1] is None else len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = line_dedup.line_figures(odd)
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect())) == expected
    texts = line_dedup.without_repeated_lines(odd)
    assert texts.columns == odd.columns and texts.count() == len(odd_rows)


def _benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination(spark, odd, odd_rows, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (10, broadcast))
    words = _benchmark_words(odd_rows[0][1])
    items = [(1, " ".join(words[5:30])), (2, "Don't-STOP"), (3, None), (4, " ?"), (10, " ".join(words[20:31])), (1, " ".join(words[5:30])), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    owners = defaultdict(set)
    for k, text in items:
        w = _benchmark_words(text)
        for at in range(len(w) - min(10, len(w)) + 1 if w else 0):
            owners[tuple(w[at : at + 10])].add(k)
    expected = Counter()
    for r in odd_rows:
        w, hit, of = _benchmark_words(r[1]), set(), set()
        for n in {len(x) for x in owners}:
            for at in range(len(w) - n + 1):
                if (own := owners.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    of |= own - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest()
        expected[r[0], len(w), len(hit), len(of), digest, bool(hit)] += 1
    assert Counter(map(tuple, decontaminate.contamination(odd, bench).collect())) == expected
    left = decontaminate.without_documents(odd, bench)
    assert left.columns == odd.columns and left.count() == sum(n for k, n in expected.items() if not k[-1])
    assert not decontaminate.contamination(decontaminate.without_spans(odd, bench), bench).where("contaminated").count()


def test_empty_tables(spark, none, odd, odd_rows):
    assert near_dup.near_duplicates(none).collect() == []
    assert substring_dedup.without_repeats(none).collect() == []
    assert line_dedup.line_figures(none).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).collect() == []
    assert decontaminate.contamination(odd, bench).where("contaminated").count() == 0
