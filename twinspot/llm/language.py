"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's UTF-8 bytes in stretches of ``STRETCH``, each from zero states in both directions, and
gives every byte a distribution over the learned languages; a text's distribution is the mean over all its bytes.
Training is by backpropagation through time on a bounded sample of rows: up to ``SAMPLE`` of each language, the first by a hash of
doc_id, of those whose crc32(doc_id) mod 4 is not 2. Their texts are taken whole: a step draws a text, and then any of its slices. One task
fits the sample.

A text that is null or has no letter (Unicode category L) is ``und`` with score 0. If there is nothing to learn from, as in an empty table, all
texts are. Repeated rows score alike, ties between languages go to the first by name; each text is read whole, a bounded number of stretches at
a time. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, crc_of_id, pieces_of_batches

HIDDEN, STRETCH = 8, 128
SAMPLE, SLICE = 400, 64
STEPS, BATCH, RATE, SEED = 260, 256, 0.01, 7
#: Stretches that are read together.
TOGETHER = 2048
UNKNOWN = "und"


@dataclass
class Direction:
    """One gated recurrent layer: a row of inputs per byte value, and the recurrent weights; gates z, r, n."""

    inputs: np.ndarray
    recurrent: np.ndarray

    def run(self, data: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte of ``data`` (rows, bytes), as (bytes, rows, HIDDEN). ``keep`` gets what training needs."""
        rows, size = data.shape
        out = np.empty((size, rows, HIDDEN), np.float32)
        h = np.zeros((rows, HIDDEN), np.float32)
        for t in range(size):
            own = self.inputs[data[:, t]]
            back = h @ self.recurrent
            gates = own[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN]
            # the logistic function by tanh
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(own[:, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            new *= mask[:, t, None]
            if keep is not None:
                keep.append((h, z, r, n, back[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def back(self, data: np.ndarray, mask: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of (inputs, recurrent), for the gradient of all states."""
        d_rec, carry = np.zeros_like(self.recurrent), np.zeros_like(grad[0])
        own = np.empty((*data.shape[::-1], 3 * HIDDEN), np.float32)
        for t in range(data.shape[1] - 1, -1, -1):
            h, z, r, n, back_n = kept[t]
            d = (grad[t] + carry) * mask[:, t, None]
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * back_n * r * (1 - r)
            own[t] = np.concatenate([d_z, d_r, d_n], 1)
            d_back = np.concatenate([d_z, d_r, d_n * r], 1)
            d_rec += h.T @ d_back
            carry = d * z + d_back @ self.recurrent.T
        flat = data.T.ravel()
        d_in = np.stack([np.bincount(flat, own[:, :, k].ravel(), 256) for k in range(3 * HIDDEN)], 1)
        return [d_in.astype(np.float32), d_rec]


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray
    bias: np.ndarray

    def distributions(self, data: np.ndarray, mask: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """((bytes, rows, languages) distributions, states)."""
        flipped, flipped_mask = data[:, ::-1], mask[:, ::-1]
        a = self.ahead.run(data, mask, keep and keep[0])
        b = self.behind.run(flipped, flipped_mask, keep and keep[1])[::-1]
        states = np.concatenate([a, b], 2)
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, states

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): the mean distribution over each text's bytes."""
        size = np.diff(offsets)
        parts = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), parts)
        first = np.concatenate([[0], np.cumsum(parts)])[:-1]
        start = offsets[:-1][text] + (np.arange(len(text)) - first[text]) * STRETCH
        length = np.minimum(STRETCH, offsets[1:][text] - start)
        total = np.zeros((len(size), len(self.languages)))
        # full stretches together, short ones by length, so little is read in vain
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), TOGETHER):
            some = order[lo : lo + TOGETHER]
            width = int(length[some[0]])
            place = np.arange(width)
            mask = place < length[some, None]
            bytes_ = data[np.minimum(start[some, None] + place, len(data) - 1)]
            p, _ = self.distributions(bytes_, mask.astype(np.float32))
            sums = (p * mask.T[:, :, None]).sum(axis=0, dtype=np.float64)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(text[some], sums[:, k], len(size))
        return total / np.maximum(1, size)[:, None]


def _new(languages: list[str]) -> Network:
    rng = np.random.default_rng(SEED)

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(HIDDEN)).astype(np.float32)

    return Network(
        languages, Direction(draw(256, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)), Direction(draw(256, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)),
        draw(2 * HIDDEN, len(languages)), np.zeros(len(languages), np.float32),
    )


def gradients(net: Network, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all bytes, and its gradients by backpropagation through time."""
    kept: tuple[list, list] = ([], [])
    p, states = net.distributions(data, mask, kept)
    n, rows = mask.sum(), np.arange(len(label))
    loss = -(np.log(p[:, rows, label] + 1e-9) * mask.T).sum() / n
    d = p.copy()
    d[:, rows, label] -= 1
    d *= mask.T[:, :, None] / n
    flat, flat_states = d.reshape(-1, d.shape[2]), states.reshape(-1, 2 * HIDDEN)
    d_states = d @ net.out.T
    ahead = net.ahead.back(data, mask, kept[0], d_states[:, :, :HIDDEN])
    behind = net.behind.back(data[:, ::-1], mask[:, ::-1], kept[1], d_states[::-1, :, HIDDEN:])
    return float(loss), [*ahead, *behind, flat_states.T @ flat, flat.sum(axis=0)]


def fit(texts: list[tuple[str, bytes]]) -> Network | None:
    """Adam steps over random slices of (language, bytes) texts, as many of each language, and of each of its texts."""
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    net, rng = _new(languages), np.random.default_rng(SEED)
    of = [[s for lang, s in texts if lang == x] for x in languages]
    params = [net.ahead.inputs, net.ahead.recurrent, net.behind.inputs, net.behind.recurrent, net.out, net.bias]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, STEPS + 1):
        label = rng.integers(0, len(languages), BATCH)
        drawn = [of[k][rng.integers(0, len(of[k]))] for k in label]
        at = [SLICE * int(rng.integers(0, -(-len(s) // SLICE))) for s in drawn]
        chosen = [s[lo : lo + SLICE] for s, lo in zip(drawn, at, strict=True)]
        data = np.zeros((BATCH, SLICE), np.uint8)
        mask = np.zeros((BATCH, SLICE), np.float32)
        for r, s in enumerate(chosen):
            data[r, : len(s)] = np.frombuffer(s, np.uint8)
            mask[r, : len(s)] = 1
        _, grads = gradients(net, data, mask, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - (step - 1) / STEPS)
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = {(lang, text.encode()) for batch in batches for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text}
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(texts)))], pa.binary())], ["model"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    own = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id(F.col("doc_id")) % 4 != 2))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = own.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select("doc_id", F.col("lang").alias("_lang"))
    # at most ``sample`` rows of each language
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), "doc_id").where("lang = _lang and text is not null")
    found = rows.select("lang", "text").repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _predicted(net: Network | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(batches, "text", 1 << 20):
            column = batch.column(1)
            lettered = np.asarray([bool(t and any(map(str.isalpha, t))) for t in column.to_pylist()])
            if net is None:
                lettered[:] = False
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if lettered.any():
                p = net.pooled(*buffers(column))
                best = p.argmax(axis=1)
                scores = np.where(lettered, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                langs = [net.languages[k] if x else UNKNOWN for k, x in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return predict


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang)."""
    net = train(docs)
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predicted(net), "doc_id bigint, lang_pred string, score double")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
