"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by
how often each class of characters occurs, by statistics of its words and by a
hashed bag of its words, and encoded by a learned layer. Gated attention, a
softmax over all passages of the document of w . (tanh(V h) * sigmoid(U h)), weighs
the encoded passages; the weighted mean is scored by a logistic unit. Weights of
all layers are learned together from the documents' labels.

The model is trained in numpy on at most ``SAMPLE`` labelled documents of each
class (the least by a hash of the id), with all passages of each. A fifth is held
out, and the threshold is chosen on it, at a rate of ``LOST`` good documents lost
at most.

Result of the query: the documents that are kept, with doc_id, n_passages, score
and top_passage (the one with the highest weight; of equal ones the first).

Defined cases: a null or empty text has no passage, score 0 and is dropped; null
ids stay null; repeated rows are judged each; labels without id, label or document
are not used, and of contradictory ones the higher counts; without both classes
every document with a passage is kept with score 1; an empty table gives an empty
result. Only ids, texts and labels are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .toxicity import sample

PASSAGE = 64
BAG = 64
CODE = 16
GATE = 8
SAMPLE = (1500, 1500)
EPOCHS = 40
LOST = 0.005
SEED = 11

_CLASS = np.full(256, 42, np.uint8)
_CLASS[[*range(65, 91)]] = 0
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 13, 32]] = 3
_CLASS[10] = 4
for _k, _c in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]):
    _CLASS[_c] = 5 + _k
_CLASS[[*range(128, 192)]] = 40
_CLASS[[*range(192, 256)]] = 41
CLASSES = 43
WIDTH = CLASSES + 6 + BAG


def passages(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and behind the last word of every passage; a short rest belongs to the passage before it."""
    n = np.where(w.counts > 0, np.maximum(1, (w.counts + PASSAGE // 2) // PASSAGE), 0)
    row, k = K.spread(n)
    first = w.ptr[row] + k * PASSAGE
    return row, first, np.where(k == n[row] - 1, w.ptr[row + 1], first + PASSAGE)


def describe(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and features of every passage; all characters between its first word and the next passage belong to it."""
    row, first, last = passages(w)
    m = len(row)
    if not m:
        return row, np.zeros((0, WIDTH), "f4")
    lead = np.r_[True, row[1:] != row[:-1]]
    begin = np.where(lead, w.offsets[row], w.starts[first])
    end = np.where(np.r_[lead[1:], True], w.offsets[row + 1], np.r_[begin[1:], 0])
    which = np.repeat(np.arange(m, dtype=np.int32), end - begin)
    counts = np.bincount(which * np.int64(CLASSES) + _CLASS[w.data[begin[0] : end[-1]] if (end[:-1] == begin[1:]).all() else w.data[np.repeat(begin, end - begin) + K.spread(end - begin)[1]]], minlength=m * CLASSES).reshape(m, CLASSES)
    size = (end - begin).astype(float)
    words = last - first
    of, k = K.spread(words)
    at = first[of] + k
    length = w.ends[at] - w.starts[at]
    h = w.hashes[at]
    bag = np.bincount(of * BAG + (K.mix(h.copy()) >> np.uint64(58)).astype(np.int64), minlength=m * BAG).reshape(m, BAG)
    order = np.lexsort((h, of))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])]
    distinct = np.bincount(of[order], new, m)
    mean = np.bincount(of, length, m) / words
    spread = np.sqrt(np.maximum(0, np.bincount(of, length.astype(float) ** 2, m) / words - mean**2))
    capital = np.bincount(of, (w.data[w.starts[at]] < 97) & (w.data[w.starts[at]] > 64), m) / words
    out = np.concatenate([np.log1p(100 * counts / size[:, None]) / 4, np.stack([mean / 10, spread / 10, distinct / words, capital, np.log1p(words) / 5, words / size * 5], axis=1), np.sqrt(bag / words[:, None])], axis=1)
    return row, out.astype("f4")


@dataclass
class Model:
    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    threshold: float = 0.5

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int = SEED) -> "Model":
        r = np.random.default_rng(seed)
        draw = lambda *s: r.standard_normal(s) / np.sqrt(s[0])
        p = {"W": draw(WIDTH, CODE), "b": np.zeros(CODE), "V": draw(CODE, GATE), "U": draw(CODE, GATE), "w": draw(GATE), "c": draw(CODE), "d": np.zeros(1)}
        return cls(p, x.mean(axis=0), x.std(axis=0) + 0.05)


def forward(m: Model, x: np.ndarray, row: np.ndarray, rows: int):
    """The logits of bags: row, the bag of each passage, ascends. Bags without passages have logit 0."""
    p = m.p
    z = (x - m.mean) / m.scale
    h = np.tanh(z @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    s = (v * u) @ p["w"]
    a = np.exp(s - s.max()) if len(s) else s
    a = a / np.bincount(row, a, rows)[row]
    y = h @ p["c"]
    logit = np.bincount(row, a * y, rows) + p["d"][0]
    return logit, (z, h, v, u, a, y)


def backward(m: Model, back, row: np.ndarray, logit: np.ndarray, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    p, (z, h, v, u, a, y) = m.p, back
    g = dlogit[row]
    da = g * a * (y - (logit - p["d"][0])[row])
    dh = (g * a)[:, None] * p["c"]
    dvu = da[:, None] * p["w"]
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
    return {"c": h.T @ (g * a), "d": np.array([dlogit.sum()]), "w": (v * u).T @ da, "V": h.T @ dv, "U": h.T @ du, "W": z.T @ dh, "b": dh.sum(axis=0)}


def train(texts: list[str], good: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """A model trained on documents; None if there is but one class."""
    w = K.words(pa.array(texts, pa.large_string()))
    row, x = describe(w)
    has = np.bincount(row, minlength=len(texts)) > 0
    if not has.any() or good[has].min() == good[has].max():
        return None
    rng, m = np.random.default_rng(seed), Model.fresh(x, seed)
    held = rng.random(len(texts)) < 0.2
    if min(len(np.unique(good[held & has])), len(np.unique(good[~held & has]))) < 2:
        held[:] = False
    use = np.flatnonzero(has & ~held)
    share = np.where(good > 0, 0.5 / max(1, (good[use] > 0).sum()), 0.5 / max(1, (good[use] == 0).sum())) * len(use)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    one = {k: np.zeros_like(v) for k, v in m.p.items()}
    two = {k: np.zeros_like(v) for k, v in m.p.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(use)
        for at in range(0, len(order), 64):
            docs = order[at : at + 64]
            which, k = K.spread(np.diff(first)[docs])
            logit, back = forward(m, x[first[docs][which] + k].astype(float), which, len(docs))
            grads = backward(m, back, which, logit, (1 / (1 + np.exp(-logit)) - good[docs]) * share[docs] / len(docs))
            t += 1
            for name, g in grads.items():
                g = g + 1e-4 * m.p[name]
                one[name] += 0.1 * (g - one[name])
                two[name] += 0.01 * (g * g - two[name])
                m.p[name] -= 0.01 * (1 - epoch / epochs) * (one[name] / (1 - 0.9**t)) / (np.sqrt(two[name] / (1 - 0.99**t)) + 1e-8)
    judged = held & has if held.any() else has
    score = 1 / (1 + np.exp(-forward(m, x, row, len(texts))[0]))
    m.threshold = cut(score[judged], good[judged])
    return m


def cut(score: np.ndarray, good: np.ndarray, lost: float = LOST) -> float:
    """The threshold that drops the most bad documents with so few good ones lost; in the middle of the gap above it."""
    pos, neg = np.sort(score[good > 0]), np.sort(score[good == 0])
    edges = np.unique(np.r_[0.0, score, 1.0])
    at = (edges[1:] + edges[:-1]) / 2
    ok = np.searchsorted(pos, at) <= lost * len(pos)
    dropped = np.where(ok, np.searchsorted(neg, at), -1)
    best = np.flatnonzero(dropped == dropped.max())
    return float(at[best[np.argmax(np.diff(edges)[best])]])


def judge(m: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, score and the passage with the highest weight, of every row."""
    w = K.words(texts)
    rows = len(w.ptr) - 1
    row, x = describe(w)
    n = np.bincount(row, minlength=rows)
    if m is None:
        return n, np.where(n > 0, 1.0, 0.0), np.zeros(rows, np.int64)
    logit, back = forward(m, x, row, rows)
    score = np.where(n > 0, 1 / (1 + np.exp(-logit)), 0.0)
    top = np.zeros(rows, np.int64)
    by = np.lexsort((-np.arange(len(row)), np.round(back[4], 9), row))
    top[row[by]] = (np.arange(len(row)) - (np.cumsum(n) - n)[row])[by]
    return n, score, top


def good_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most: tuple[int, int] = SAMPLE) -> DataFrame:
    """doc_id, n_passages, score and top_passage of the documents that are kept."""
    model = train(*sample(docs, labels, id, text, label, most))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in K.chunks(batches):
            n, score, top = judge(m, b.column("text"))
            ok = pa.array(np.flatnonzero((n > 0) & (score >= (m.threshold if m else 0))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.round(score, 4)), pa.array(top)], names=["doc_id", "n_passages", "score", "top_passage"]).take(ok)

    slim = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_passages bigint, score double, top_passage bigint")
