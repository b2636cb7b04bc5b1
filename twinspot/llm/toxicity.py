"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of ``ORDER`` code points that both have within ``SPAN`` code
points, the product of their weights ``DECAY ** span``; divided by both strings' own kernels' roots. A string with
characters put in or left out keeps most of its subsequences, so an insult with gaps stays near the insult.

Labels are of documents, so a document is a bag: its sentences, each a bag of strings (words in lower case without
outer punctuation; a run of words of one or two letters counts as one string, so that an insult with blanks in it stays whole; a string of
over ``LONGEST`` code points is read in overlapping parts, so all of it counts). A bag's score comes from its ``LARGEST`` largest
margins. Training picks witness strings from
documents labelled 1, first by document frequencies and then by the machine's own margins, and takes strings of
sentences of documents labelled 0 as the other class, those of largest margin first. Landmarks are the witnesses of
most documents and a spread of other strings. A logistic curve on the bags' largest margins makes scores.

The machine is linear in the kernels with the landmarks, and these are linear in weighted subsequences; so a string
is scored by one table look-up per subsequence, with no loop over landmarks.

Training reads up to ``SAMPLE`` labelled rows of each class, the first by a hash of doc_id, whatever the size of the
table; with no rows of one class, all scores are the share of the other. Null and empty texts score as a document
without strings does, the curve's lowest value. Repeated rows score alike, and texts of any length are read whole. Of labels of one doc_id any
one counts. An empty table gives no rows. Further columns, whatever their names, are not read by ``toxicity`` and returned by ``without_toxic``.
"""

from __future__ import annotations

import heapq
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, lean, pieces_of_batches

ORDER, SPAN, DECAY, LONGEST = 3, 8, 0.7, 24
SAMPLE, WITNESSES, OTHERS = 1500, 96, 64
LARGEST, LEAST = 3, -2.0
#: A document of label 1 that is missed costs as much as so many of label 0 that are taken for one.
MISSED = 3.0
#: Lower bound of the log odds from which a string is a witness at once.
SURE = 1.0
ROUNDS, NEGATIVES, STEPS, PENALTY = 3, 12_000, 30, 1e-4
#: Strings whose margins a worker remembers; bounds its memory.
_KNOWN = 400_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_INNER = re.compile(r"[\W_]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(triples of places within SPAN, their weights) in a string of n code points."""
    out = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at = np.asarray(out, np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def largest(margins: list[float]) -> list[float]:
    """A bag's ``LARGEST`` largest margins; what is missing counts as ``LEAST``."""
    return (heapq.nlargest(LARGEST, margins) + [LEAST] * LARGEST)[:LARGEST]


def strings_of(text: str) -> list[str]:
    """The strings of a text, sentence by sentence."""
    out = []
    for sentence in _SENTENCE.split(text):
        run: list[str] = []
        for raw in [*sentence.lower().split(), ""]:
            word = raw if raw.isalpha() else _OUTER.sub("", raw)
            if not word.isalpha() and len(parts := _INNER.split(word)) >= ORDER and max(map(len, parts)) == 1:
                word = "".join(parts)
            if 0 < len(word) < ORDER:
                run.append(word)
                continue
            if len(run) > 1:
                out += _strings("".join(run))
            run = run if run and raw and not word else []
            out += _strings(word)
    return out


def _strings(word: str) -> list[str]:
    if len(word) > LONGEST:
        half = LONGEST // 2
        return [word[k : k + LONGEST] for k in range(0, len(word) - half, half)]
    return [f"^{word}$"] if len(word) >= ORDER else []


@dataclass
class Weights:
    """Value of each triple of letters; letters are numbered from 1, 0 is any other."""

    letters: str
    table: np.ndarray
    bias: float
    slopes: tuple[float, ...] = (1.0,) * LARGEST
    shift: float = 0.0

    def margins(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        number, size = {c: i + 1 for i, c in enumerate(self.letters)}, len(self.letters) + 1
        for some, points, at, weight in _batches(strings):
            known, inverse = np.unique(points, return_inverse=True)
            code = np.asarray([number.get(chr(c), 0) for c in known])[inverse].reshape(points.shape)
            triple = (code[:, at[:, 0]] * size + code[:, at[:, 1]]) * size + code[:, at[:, 2]]
            out[some] += self.table[triple] @ weight / np.sqrt(_self_kernels(points, at, weight))
        return out

    def score(self, bags: list[list[float]]) -> np.ndarray:
        """Of each bag's largest margins."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(bags).reshape(-1, LARGEST) @ self.slopes + self.shift, -30, 30)))


def _batches(strings: list[str]):
    """(which strings, their code points, triples of places, weights), strings of one length at a time."""
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(k)
    for n, where in by_length.items():
        at, weight = _places(n)
        for lo in range(0, len(where), 2048):
            some = where[lo : lo + 2048]
            raw = "".join(strings[k] for k in some).encode("utf-32-le", "surrogatepass")
            yield some, np.frombuffer(raw, np.uint32).reshape(-1, n).astype(np.int64), at, weight


def _self_kernels(points: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over pairs of equal triples in each string of their weights' product."""
    # letters renumbered by their first place in the string make small codes
    same = points[:, :, None] == points[:, None, :]
    code = same.argmax(axis=2)
    n = points.shape[1]
    triple = (code[:, at[:, 0]] * n + code[:, at[:, 1]]) * n + code[:, at[:, 2]]
    cell = triple + (np.arange(len(points)) * n**ORDER)[:, None]
    keys, inverse = np.unique(cell, return_inverse=True)
    total = np.bincount(inverse.ravel(), weights=np.broadcast_to(weight, cell.shape).ravel())
    return np.bincount(keys // n**ORDER, weights=total**2, minlength=len(points))


def _features(s: str) -> dict[str, float]:
    at, weight = _places(len(s))
    out: dict[str, float] = {}
    for (i, j, k), w in zip(at.tolist(), weight.tolist(), strict=True):
        t = s[i] + s[j] + s[k]
        out[t] = out.get(t, 0.0) + w
    norm = np.sqrt(sum(v * v for v in out.values()))
    return {t: v / norm for t, v in out.items()}


def _kernel(strings: list[str], landmarks: list[dict[str, float]]) -> np.ndarray:
    """Kernels of all strings with all landmarks, by the landmarks' subsequences."""
    names = {t: i + 1 for i, t in enumerate(sorted({t for f in landmarks for t in f}))}
    letters = {c: i + 1 for i, c in enumerate(sorted({c for t in names for c in t}))}
    size = len(letters) + 1
    row = np.zeros(size**ORDER, np.int64)
    dense = np.zeros((len(names) + 1, len(landmarks)))
    for t, i in names.items():
        row[(letters[t[0]] * size + letters[t[1]]) * size + letters[t[2]]] = i
    for j, f in enumerate(landmarks):
        for t, v in f.items():
            dense[names[t], j] = v
    out = np.zeros((len(strings), len(landmarks)))
    for some, points, at, weight in _batches(strings):
        known, inverse = np.unique(points, return_inverse=True)
        code = np.asarray([letters.get(chr(c), 0) for c in known])[inverse].reshape(points.shape)
        triple = row[(code[:, at[:, 0]] * size + code[:, at[:, 1]]) * size + code[:, at[:, 2]]]
        for k in range(len(weight)):
            out[some] += dense[triple[:, k]] * weight[k]
        out[some] /= np.sqrt(_self_kernels(points, at, weight))[:, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps: each solves for the rows that are within the margin."""
    z, a = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([PENALTY] * x.shape[1] + [0.0])
    for _ in range(STEPS):
        inside = y * (z @ a) < 1
        zi, wi = z[inside], (weight / weight.sum())[inside][:, None]
        new = np.linalg.solve(zi.T @ (wi * zi) + ridge + 1e-9 * np.eye(len(a)), (wi * zi).T @ y[inside])
        if np.abs(new - a).max() < 1e-6:
            break
        a = new
    return a[:-1], float(a[-1])


def _curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of the logistic curve over a bag's largest margins, by Newton steps with a small penalty on the slopes."""
    n = margins.shape[1]
    z, a, penalty = np.column_stack([margins, np.ones(len(margins))]), np.zeros(n + 1), np.asarray([0.1] * n + [1e-3])
    weight = weight / weight.mean()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * a
        a = a - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
    return tuple(a[:-1].tolist()), float(a[-1])


def _unlike(bags: list[list[str]]) -> list[int]:
    """The places of bags that share no more than half of eight minima with an earlier one: copies would pass as proof."""
    seen: dict[tuple[int, int], list[int]] = {}
    minima, out = {}, []
    for k, bag in enumerate(bags):
        least = [min((zlib.crc32(s.encode(), seed) for s in bag), default=0) for seed in range(8)]
        near = {j for i, v in enumerate(least) for j in seen.get((i, v), ())}
        if any(sum(a == b for a, b in zip(least, minima[j], strict=True)) > 4 for j in near):
            continue
        minima[k] = least
        out.append(k)
        for i, v in enumerate(least):
            seen.setdefault((i, v), []).append(k)
    return out


def fit(texts: list[str], toxic: list[int], share: float) -> Weights | float:
    """``share``: of label 1 among all labelled rows, which the sample does not show."""
    y = np.asarray(toxic)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.0
    bags = [sorted(set(strings_of(t or ""))) for t in texts]
    alone = _unlike(bags)
    bags, y = [bags[k] for k in alone], y[alone]
    if y.min() == y.max():
        return float(share)
    used = {c: Counter(s for bag, k in zip(bags, y, strict=True) if k == c for s in bag) for c in (0, 1)}
    n = {c: int((y == c).sum()) for c in (0, 1)}
    def odds(t: str) -> float:
        """Lower bound of the log odds of the label's classes for documents that hold the string."""
        k, m = used[1][t] + 0.5, used[0][t] + 0.5
        return np.log(k / n[1]) - np.log(m / n[0]) - 1.5 * np.sqrt(1 / k + 1 / m)

    least = {t: odds(t) for t in used[1]}
    sure = {t for t, v in least.items() if v >= SURE}
    positive = [bag for bag, k in zip(bags, y, strict=True) if k == 1 and bag]
    witness = [t for bag in positive for t in (sure.intersection(bag) or {max(bag, key=lambda t: (least[t], t))})]
    others = sorted(used[0], key=lambda s: (-used[0][s], s))
    spread = others[:: max(1, len(others) // OTHERS)][:OTHERS]
    hard: list[str] = []
    model = Weights("", np.zeros(1), 0.0)
    for _ in range(ROUNDS):
        count = Counter(witness)
        chosen = [s for s, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:WITNESSES]] + spread
        landmarks = [_features(s) for s in chosen]
        gram = _kernel(chosen, landmarks)
        value, vector = np.linalg.eigh(gram)
        good = value > 1e-6 * value.max()
        project = vector[:, good] / np.sqrt(value[good])
        negative = [*hard, *others[:: max(1, len(others) // NEGATIVES)]]
        names = [*count, *negative]
        sign = np.asarray([1.0] * len(count) + [-1.0] * len(negative))
        mass = np.asarray([count[s] / max(1, len(witness)) for s in count] + [1 / max(1, len(negative))] * len(negative))
        w, b = _svm(_kernel(names, landmarks) @ project, sign, mass)
        beta, letters = project @ w, "".join(sorted({c for s in chosen for c in s}))
        number, size = {c: i + 1 for i, c in enumerate(letters)}, len(letters) + 1
        table = np.zeros(size**ORDER)
        for weight, f in zip(beta, landmarks, strict=True):
            for t, v in f.items():
                table[(number[t[0]] * size + number[t[1]]) * size + number[t[2]]] += weight * v
        model = Weights(letters, table, float(b))
        of = dict(zip(everything := sorted(set(used[0]) | set(used[1])), model.margins(everything), strict=True))
        witness = [s for bag in positive for s in (sure.intersection(bag) or {max(bag, key=lambda s: (of[s], s))})]
        hard = sorted(used[0], key=lambda s: (-of[s], s))[: NEGATIVES // 4]
    most = np.asarray([largest([of[s] for s in bag]) for bag in bags])
    model.slopes, model.shift = _curve(most, y, np.where(y == 1, MISSED * share / n[1], (1 - share) / n[0]) * len(y))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights | float:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    own = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (crc_of_id(F.col("doc_id")) % 5 != 0)).dropDuplicates(["doc_id"])
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # each task keeps its first ``sample`` of a label, so no task gets a label's rows
    first = lambda label: own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(0).union(first(1))
    # at most two times ``sample`` rows, so one task can fit them
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    found = texts.select("doc_id", "text", "toxic").repartition(1).mapInArrow(lean(_fitted(share)), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [], share)


def _fitted(share: float):
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[0])
        model = fit([r[1] for r in rows], [r[2] for r in rows], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return fitted


def _scored(model: Weights | float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in pieces_of_batches(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            if isinstance(model, Weights):
                if len(known) > _KNOWN:
                    known.clear()
                bags = [strings_of(t or "") for t in texts]
                new = list({s for bag in bags for s in bag if s not in known})
                known.update(zip(new, model.margins(new).tolist(), strict=True))
                scores = model.score([largest(list(map(known.__getitem__, set(bag)))) for bag in bags])
            else:
                scores = np.full(len(texts), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return score


def scores(docs: DataFrame, model: Weights | float) -> DataFrame:
    """doc_id, score for each row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_scored(model)), "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    scored = scores(docs, train(docs, labels))
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(model: Weights | float):
    score = _scored(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(batches, "text", 2 << 20):
            rows = pa.array(range(batch.num_rows), pa.int64())
            pair = pa.RecordBatch.from_arrays([rows, batch.column(batch.schema.names.index("text"))], ["doc_id", "text"])
            for scored in score(iter([pair])):
                kept = scored.filter(pa.array(scored.column(1).to_numpy() < 0.5))
                yield batch.take(kept.column(0))

    return clean


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return docs.mapInArrow(lean(_clean(train(docs, labels))), docs.schema)
