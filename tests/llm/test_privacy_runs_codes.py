"""Personal data, periodic runs and vector codes against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinspot.llm import pii, queries, runs, vector_codes

CARD, SHORT_CARD, IBAN = "4532 0151 1283 0366", "378282246310005", "GB82 WEST 1234 5698 7654 32"


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _base(text):
    """Spans by the patterns as they are told, kind by kind."""
    out = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def _digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, own in found.items() for a, b in own).encode()).hexdigest()


def _private_rows():
    rng = random.Random(7)
    texts = [
        None, "", "a@b.c_x@d.e.f x@y @z.w a@b. c@d..e", "1.2.3.4.5.6.7.8 001.2.3.0 256.1.1.1 1.2.3.x 9.9.9.9", f"é {CARD} 😀 {CARD.replace(' ', '')}7", "4532 -0151 1283 0366",
        "1 4532015112830366 2", "+1 (988) 555-2485 +49 30 1234567890123456 +1-2 +12345678", "x" * 20_000 + "@b.c", "1" * 20_000, "1 " * 10_000, "a." * 10_000 + "a@b" + ".c" * 20_000,
        " ".join(f"u{k}@mail.example" for k in range(700)), "+1 " + "(" * 5000, "٣٣٣@b.c ４５.1.1.1.1", f"visa {SHORT_CARD}", f"number {SHORT_CARD}", f"{IBAN} and DE89370400440532013000 not DE89370400440532013001",
        "my ssn: 123-45-6789, and, far from there, the order 123-45-6789", "call (988) 555-2485 or 988-555-2485 x", "part 988-555-2485", "", "telé 988.555.2485", "tel 988.555.2485",
    ]
    texts += ["".join(rng.choice(["a", "@", ".", "1", "2", " ", "-", "+", "(", "é", "_", "25", "4111 1111 1111 1111", "b.c"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return [(k if k else None, t) for k, t in enumerate(texts)]


def test_personal_data(spark):
    rows = _private_rows()
    docs = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, spans string, _m0 int").repartition(3)
    got = {r["doc_id"]: r for r in pii.figures(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base, r = _base(text or ""), got[doc_id]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == (*map(len, base.values()), _digest(base)), text
        named = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert all((k, str(a), str(b)) in named for k, own in base.items() for a, b in own)
        assert len(r["scores"].split(",")) == max(1, len(named))
    text_of, added = dict(rows), defaultdict(list)
    for doc_id, r in got.items():
        base = {f"{k}:{a}:{b}" for k, own in _base(text_of[doc_id] or "").items() for a, b in own}
        for x in r["spans"].split(","):
            if x and x not in base:
                kind, a, b = x.split(":")
                added[text_of[doc_id]].append((kind, text_of[doc_id][int(a) : int(b)]))
    assert {k: v for k, v in added.items() if len(k) < 100 and not set(k) <= set("a@.12 -+(é_5bc4")} == {
        f"visa {SHORT_CARD}": [("card", SHORT_CARD)],
        f"{IBAN} and DE89370400440532013000 not DE89370400440532013001": [("iban", IBAN), ("iban", "DE89370400440532013000")],
        "my ssn: 123-45-6789, and, far from there, the order 123-45-6789": [("ssn", "123-45-6789")],
        "call (988) 555-2485 or 988-555-2485 x": [("phone", "(988) 555-2485")],
        "tel 988.555.2485": [("phone", "988.555.2485")],
    }


def test_redaction(spark):
    rows = [(1, "write to a@b.c, call +1 (988) 555-2485 é", "x"), (2, None, "y"), (3, "nothing", None), (None, f"{CARD}; 1.2.3.4", "z")]
    out = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, at string"))
    assert out.columns == ["doc_id", "text", "at"]
    assert Counter(map(tuple, out.collect())) == Counter([(1, "write to [email], call [phone] é", "x"), (2, None, "y"), (3, "nothing", None), (None, "[card]; [ip]", "z")])


def _runs(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        start = None
        for i in range(len(w) - q + 1):
            if i < len(w) - q and w[i] == w[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i - start + q >= max(12, 2 * q):
                    best.setdefault((start, i + q), q)
                start = None
    return sorted((a, b - a, q) for (a, b), q in best.items())


_TEXTS = st.one_of(
    st.lists(st.integers(1, 2), max_size=90),
    st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=25), st.integers(1, 8), st.lists(st.integers(1, 3), max_size=20)).map(lambda x: x[2] + x[0] * x[1] + x[2]),
    st.tuples(st.integers(0, 60), st.integers(0, 60)).map(lambda x: [1] * x[0] + [2] + [1] * x[1]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(_TEXTS, max_size=4))
def test_runs(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    got = runs.runs_of(np.asarray([x for t in texts for x in t], np.int64), offsets)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(k, *r) for k, t in enumerate(texts) for r in sorted(_runs(t), key=lambda r: (r[0], r[2]))]


@pytest.mark.parametrize("text", [[1] * 300_000, [1] * 60_000 + [2] + [1] * 60_000, [1, 2] * 60_000 + [3] + [1, 2] * 60_000, ([1] * 20 + [2]) * 5_000])
def test_long_repetitive_texts(text):
    got = runs.runs_of(np.asarray(text, np.int64), np.asarray([0, len(text)]))
    assert all(text[a : a + n - q] == text[a + q : a + n] for a, n, q in zip(*(x.tolist() for x in got[1:]), strict=True)) and len(got[0]) >= 1


def _run_figures(rows):
    out = Counter()
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = sorted(_runs(w), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in found), default=None)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        kept = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        top = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
        out[(doc_id, len(found), *top, digest, kept)] += 1
    return out


def test_run_figures(spark, odd, odd_rows):
    texts = {k: " ".join(f"w{(k * i * i) % 37}" for i in range(k % 90)) for k in range(100, 260)}
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 5000] + list(texts.items()) + [(400, "x y z " * 40), (None, "u v " * 9), (400, "x y z " * 40)]
    docs = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id long, text string, runs int, _key string").repartition(3)
    assert Counter(map(tuple, runs.figures(runs.planted(docs)).collect())) == _run_figures(rows)
    left = runs.collapsed(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert runs.collapsed(odd).columns == odd.columns
    assert runs.periodic_runs(docs).where("doc_id = 400").distinct().collect()[0][1:] == (0, 120, 3)


def _codes(rows):
    """As the contract says it, with Python's numbers."""
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    if not kept:
        return Counter()
    width = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min(range(len(books[p])), key=lambda k: (far(cut(v, p), books[p][k]), k)) for p in range(4)]
    for _ in range(4):
        codes = [assign(v) for _, v, _ in kept]
        for p in range(4):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, sums = [], defaultdict(int)
    for i, v, lab in kept:
        c = assign(v)
        error = sum(far(cut(v, p), books[p][c[p]]) for p in range(4))
        sums[lab] += error
        out.append((i, "".join(f"{x:02x}" for x in c), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, sums[lab], digest) for i, c, e, lab in out)


@pytest.mark.parametrize("kind", ["few", "ties", "clusters", "large"])
def test_vector_codes(spark, kind):
    rng = np.random.default_rng(3)
    n = {"few": 40, "ties": 700, "clusters": 900, "large": 300}[kind]
    v = rng.normal(0, 1, (n, 8))
    if kind == "ties":
        v = rng.integers(-2, 3, (n, 8)) / 1024
    if kind == "clusters":
        v = rng.normal(0, 0.01, (n, 8)) + rng.normal(0, 2, (20, 8))[rng.integers(0, 20, n)]
    if kind == "large":
        v *= 20_000
    rows = [(k * 3, [float(np.float32(x)) for x in r], None if k % 7 == 0 else k % 3) for k, r in enumerate(v)]
    rows += [(-5, None, 1), (-4, [None] * 8, 1), (-3, [float("nan")] * 8, 1), (-2, [float("-inf")] + [0.0] * 7, 1), rows[3], rows[3]]
    table = spark.createDataFrame([(*r, "x", b"y") for r in rows], "vec_id long, embedding array<float>, label int, code string, parts binary").repartition(4)
    got = vector_codes.coded(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, got.collect())) == _codes(rows)


def test_vectors_that_have_no_code(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.coded(spark.createDataFrame([], kind)).collect() == []
    assert vector_codes.coded(spark.createDataFrame([(1, [1.0] * 5, 1)], kind)).collect() == []
    odd = [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1), (3, [1e30] * 8, 1), (None, [1.5] * 8, None)]
    got = vector_codes.coded(spark.createDataFrame(odd, kind))
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got.collect()), key=str) == [(1, "00000000", 8 * 256**2), (None, "00000000", 8 * 256**2)]


def test_codes_read_back(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    state, entries = vector_codes.fitted(vectors)
    codes = state.select("vec_id", F.lower(F.hex("codes")).alias("code"))
    error = F.aggregate(F.zip_with("embedding", "approximate", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    mean = vector_codes.decoded(codes, entries).join(vectors, "vec_id").agg(F.avg(error)).first()[0]
    assert mean < 0.5 * vectors.agg(F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).first()[0]


def test_empty_tables_of_texts(none):
    assert pii.figures(none).collect() == [] and pii.redacted(none).collect() == []
    assert runs.figures(runs.planted(none)).collect() == [] and runs.collapsed(none).collect() == []


def test_native_plan(spark, sf_dir):
    plan = queries.op11_private_data(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
