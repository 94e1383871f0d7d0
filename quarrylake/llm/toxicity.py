"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Every word has two inputs: the embedding of the word and the mean of the
embeddings of its character trigrams (hashed, with marks at its ends). A gated
recurrent network reads each window of ``WINDOW`` words in both directions;
attention weighs the states of its words, and their weighted mean is scored. All
windows of a text are scored, ``STRIDE`` words apart, so that they overlap and
cover every word. A document is as toxic as its most toxic window. The activations
are softsigns, x / (1 + |x|), which cost a sixth of the exponential ones.

The network is trained in numpy on all labelled documents that have words, with all
windows of each. A fifth of them (by a hash of the text) is held out, and the
threshold is chosen on all of that fifth; the others give the weights. They lie in
shards of about ``SHARD`` documents or bytes, by a hash, so that results don't depend
on the order or the partitions of the input. In each of ``ROUNDS`` rounds a task
passes over each shard from the weights of the round before, and the shards' weights
are averaged: matrices by documents, each row of the embeddings by the steps that
moved it. A few documents are passed over as often as makes ``STEPS`` steps. Shards
are read in chunks, averages are taken in tables of ``FAN``, and the driver gets but
one set of weights and the held-out scores' counts (scores have ``DIGITS`` digits).
Labels are of documents, so a toxic document's windows are weighed by their own
scores: those that look toxic learn to be so. Both classes have the same weight.

Result of the query: the documents that reach the threshold, with doc_id,
n_windows, toxic_windows and score (the highest of a window, 4 digits).

Defined cases: a null or empty text has no windows and is not toxic; null ids stay
null; repeated rows are judged each, and learnt each; labels without id, label or document are not
used, and of contradictory ones the toxic counts; without both classes nothing is
toxic; an empty table gives an empty result. Only ids, texts and labels are read,
so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .common import stored
from .lines import bloom, passing

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WIDTH = 8
WORDS = 1 << 16
TRIGRAMS = 1 << 14
SHARD = (8192, 32 << 20)
ROUNDS = 2
STEPS = 240
DOCS = 16
LEAST = 4
FAN = 16
DIGITS = 5
MIN_DOCS = 3
BATCH = 2048
SEED = 7


def softsign(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


def gate(x: np.ndarray) -> np.ndarray:
    y = softsign(x)
    y *= 0.5
    y += 0.5
    return y


@dataclass
class Net:
    """Weights: embeddings, and for either direction the input's and the state's matrices; z, r and n side by side."""

    word: np.ndarray
    tri: np.ndarray
    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    head: list[np.ndarray]
    bias: np.ndarray
    threshold: float = 0.5
    sums: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = SEED) -> "Net":
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype("f4")
        return cls(np.zeros((WORDS, WIDTH), "f4"), np.zeros((TRIGRAMS, WIDTH), "f4"), [draw(2 * WIDTH, 3 * HIDDEN) for _ in "fb"], [draw(HIDDEN, 3 * HIDDEN) for _ in "fb"], [np.zeros(3 * HIDDEN, "f4") for _ in "fb"], [draw(HIDDEN, 2) for _ in "fb"], np.zeros(1, "f4"))

    def parts(self) -> dict[str, np.ndarray]:
        """All weights by name, the embeddings first."""
        sides = {f"{name}{d}": value[d] for name, value in (("w", self.w), ("u", self.u), ("b", self.b), ("head", self.head)) for d in (0, 1)}
        return {"word": self.word, "tri": self.tri, **sides, "bias": self.bias}

    def flat(self) -> np.ndarray:
        """All weights, and the sums of their squared gradients."""
        parts = self.parts()
        return np.concatenate([x.ravel() for x in parts.values()] + [sums_of(self, name, x).ravel() for name, x in parts.items()])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Net":
        net, at = cls.fresh(), 0
        for take in (lambda name, x: x, lambda name, x: sums_of(net, name, x)):
            for name, x in net.parts().items():
                take(name, x)[...] = flat[at : at + x.size].reshape(x.shape)
                at += x.size
        return net


def sums_of(net: Net, name: str, value: np.ndarray) -> np.ndarray:
    return net.sums.setdefault(name, np.full(value.shape, 1e-4, "f4"))


@dataclass
class Vocabulary:
    """The different words of some rows: which word each position has, the words' buckets, and the buckets of their trigrams."""

    at: np.ndarray
    bucket: np.ndarray
    tri: np.ndarray
    ptr: np.ndarray

    @classmethod
    def of(cls, w: K.Words) -> "Vocabulary":
        h, first, at = np.unique(w.hashes, return_index=True, return_inverse=True)
        size = w.ends[first] - w.starts[first]
        which, k = K.spread(size)
        p = w.starts[first][which] + k
        left = np.where(k > 0, w.data[p - 1], 1).astype(np.uint64)
        right = np.where(k + 1 < size[which], w.data[p + 1], 1).astype(np.uint64)
        tri = K.mix(left | w.data[p].astype(np.uint64) << np.uint64(8) | right << np.uint64(16)) % np.uint64(TRIGRAMS)
        return cls(at, (K.mix(h.copy()) % np.uint64(WORDS)).astype(np.int64), tri.astype(np.int64), np.r_[0, np.cumsum(size)])

    def inputs(self, net: Net) -> np.ndarray:
        chars = np.add.reduceat(net.tri[self.tri], self.ptr[:-1], axis=0) / np.diff(self.ptr)[:, None].astype("f4") if len(self.bucket) else np.zeros((0, WIDTH), "f4")
        return np.concatenate([net.word[self.bucket], chars], axis=1)


def windows(counts: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and size of every window."""
    n = np.where(counts > 0, np.maximum(1, -(-(counts - STRIDE) // STRIDE)), 0)
    row, k = K.spread(n)
    start = ptr[row] + k * STRIDE
    return row, start, np.minimum(WINDOW, ptr[row + 1] - start)


def places(start: np.ndarray, size: np.ndarray, back: bool) -> np.ndarray:
    """The word of each step (steps x windows); behind a window's end, its last word again."""
    t = np.minimum(np.arange(WINDOW)[:, None], size - 1)
    return start + (size - 1 - t if back else t)


def scan(x: np.ndarray, at: np.ndarray, u: np.ndarray, keep: bool = False):
    """The states of all steps; x has the projected inputs of the vocabulary, at the word of each step."""
    h = np.zeros((at.shape[1], HIDDEN), "f4")
    states, kept = np.empty((len(at), *h.shape), "f4"), []
    uz, un = u[:, : 2 * HIDDEN].copy(), u[:, 2 * HIDDEN :].copy()
    xz, xn = x[:, : 2 * HIDDEN].copy(), x[:, 2 * HIDDEN :].copy()
    for t in range(len(at)):
        zr = xz.take(at[t], axis=0)
        zr += h @ uz
        zr = gate(zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        gn = h @ un
        n = xn.take(at[t], axis=0)
        n += r * gn
        n = softsign(n)
        new = h - n
        new *= z
        new += n
        if keep:
            kept.append((h, z, r, n, gn))
        h = states[t] = new
    return states, kept


def forward(net: Net, x: list[np.ndarray], vocab_at: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False):
    """The logits of windows, and what the way back needs."""
    steps = np.arange(WINDOW)[:, None]
    inside = steps < size
    turned = np.clip(size - 1 - steps, 0, None)
    parts, kept = [], []
    for d in (0, 1):
        at = vocab_at[places(start, size, d == 1)]
        states, k = scan(x[d], at, net.u[d], keep)
        out = states @ net.head[d]
        parts.append(np.take_along_axis(out, turned[:, :, None], axis=0) if d else out)
        if keep:
            kept.append((at, states, k))
    s, y = (parts[0] + parts[1])[..., 0], (parts[0] + parts[1])[..., 1]
    s = np.where(inside, s, -1e9)
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a * y).sum(axis=0)
    return pooled + net.bias[0], (kept, a, y, pooled, turned, inside)


def project(net: Net, inputs: np.ndarray) -> list[np.ndarray]:
    return [inputs @ net.w[d] + net.b[d] for d in (0, 1)]


def backward(net: Net, inputs: np.ndarray, back, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """The gradients of the matrices, and of the vocabulary's inputs."""
    kept, a, y, pooled, turned, inside = back
    grads, dinputs = {"bias": np.array([dlogit.sum()], "f4")}, np.zeros_like(inputs)
    both = np.stack([dlogit * a * (y - pooled), dlogit * a], axis=-1).astype("f4")
    for d in (0, 1):
        at, states, steps = kept[d]
        dout = np.where(inside[..., None], np.take_along_axis(both, turned[:, :, None], axis=0) if d else both, 0)
        rows = lambda x: x.reshape(-1, x.shape[-1])
        grads[f"head{d}"] = rows(states).T @ rows(dout)
        before, z, r, n, gn = (np.stack(x) for x in zip(*steps))
        by_n = (1 - z) * (1 - np.abs(n)) ** 2
        by_z = (before - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        by_r = gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dstate, ut = (rows(dout) @ net.head[d].T).reshape(states.shape), net.u[d].T.copy()
        dh, dx = np.zeros_like(states[0]), np.empty((*at.shape, 3 * HIDDEN), "f4")
        dg = np.empty_like(dx)
        for t in range(len(at) - 1, -1, -1):
            dh += dstate[t]
            dan = dh * by_n[t]
            x, g = dx[t], dg[t]
            np.multiply(dh, by_z[t], out=x[:, :HIDDEN])
            np.multiply(dan, by_r[t], out=x[:, HIDDEN : 2 * HIDDEN])
            x[:, 2 * HIDDEN :] = dan
            g[:, : 2 * HIDDEN] = x[:, : 2 * HIDDEN]
            np.multiply(dan, r[t], out=g[:, 2 * HIDDEN :])
            dh *= z[t]
            dh += g @ ut
        du = rows(before).T @ rows(dg)
        flat, n_in = at.ravel(), len(inputs)
        dproj = np.stack([np.bincount(flat, c, n_in) for c in dx.reshape(-1, 3 * HIDDEN).T], axis=1).astype("f4")
        grads[f"u{d}"], grads[f"w{d}"], grads[f"b{d}"] = du, inputs.T @ dproj, dproj.sum(axis=0)
        dinputs += dproj @ net.w[d].T
    return grads, dinputs


def adjust(net: Net, name: str, value: np.ndarray, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
    """A step of Adagrad."""
    total = sums_of(net, name, value)
    if rows is None:
        total += grad * grad
        value -= rate * grad / np.sqrt(total)
    else:
        total[rows] += grad * grad
        value[rows] -= rate * grad / np.sqrt(total[rows])


def labelled(own: DataFrame, known: DataFrame, each: tuple[int, int]) -> tuple[DataFrame, int]:
    """label, text and held_out of all rows of own whose id is known, in shards (one in each partition), and how many shards.

    A filter of the known ids (lines.bloom) spares most other texts the exchange, in which labels and texts meet by id.
    """
    spark, h = own.sparkSession, F.xxhash64("doc_id").alias("h")
    held = spark.sparkContext.broadcast(bloom(known.select(h)))
    own = own.filter("doc_id is not null and text is not null")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(passing(held.value, b.column("h").to_numpy().view(np.uint64)))).drop_columns("h")

    sizes = own.select(h, F.octet_length("text").alias("size")).mapInArrow(found, "size int")
    count, size = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(1, -(-count // each[0]), -(-size // each[1]))
    texts = own.select("doc_id", "text", h).mapInArrow(found, "doc_id bigint, text string").withColumn("label", F.lit(None).cast("int"))
    both = texts.unionByName(known.select("doc_id", F.lit(None).cast("string").alias("text"), "label")).repartition(n, "doc_id")
    rows = both.withColumn("label", F.max("label").over(Window.partitionBy("doc_id"))).filter("text is not null and label is not null")
    rows = rows.select("label", "text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held_out"), F.xxhash64("doc_id", "text").alias("at"))
    return rows.sortWithinPartitions("at", "text"), n


def piece(data: np.ndarray) -> pa.RecordBatch:
    """What a shard's task gives."""
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([data.tobytes()])], names=["part", "data"])


def merged(pieces: DataFrame, n: int, add: Callable[[list[np.ndarray]], np.ndarray], kind: str) -> np.ndarray:
    """The pieces of n shards made one, FAN at a time and in their order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        data = add([np.frombuffer(x.as_buffer(), kind) for x in t["data"]])
        return pa.table({"part": pa.array([t["part"][0].as_py() // FAN], pa.int32()), "data": pa.array([data.tobytes()])})

    while n > 1:
        pieces, n = pieces.groupBy((F.col("part") / FAN).cast("int").alias("of")).applyInArrow(run, "part int, data binary"), -(-n // FAN)
    return np.frombuffer(pieces.collect()[0].data, kind)


def tally(w: K.Words, toxic: np.ndarray, held_out: np.ndarray, total: np.ndarray) -> None:
    """Adds documents with words, by held out and toxic; documents that have a word of each bucket; and a trigram of each bucket, as long as these are rare."""
    total[:4] += np.bincount((2 * held_out + toxic)[w.counts > 0], minlength=4)
    vocab = Vocabulary.of(w)
    n_words, rows = max(1, len(vocab.bucket)), len(w.ptr) - 1
    doc_of, word_of = np.divmod(np.unique(w.row * n_words + vocab.at), n_words)
    total[4 : 4 + WORDS] += np.bincount(np.unique(doc_of * WORDS + vocab.bucket[word_of]) % WORDS, minlength=WORDS)
    tri = total[4 + WORDS :]
    for lo in range(0, rows, 100):  # a hundred documents at a time, for memory
        a, b = np.searchsorted(doc_of, (lo, lo + 100))
        open_ = np.add.accumulate(np.r_[0, tri[vocab.tri] < MIN_DOCS])
        some = np.flatnonzero(np.diff(open_[vocab.ptr])[word_of[a:b]]) + a
        which, j = K.spread(np.diff(vocab.ptr)[word_of[some]])
        seen = np.unique(doc_of[some][which] * TRIGRAMS + vocab.tri[vocab.ptr[word_of[some]][which] + j])
        tri += np.bincount(seen % TRIGRAMS, minlength=TRIGRAMS)


def averaged(pieces: list[np.ndarray]) -> np.ndarray:
    """The mean of shards' weights: each has its documents, the steps that moved each row of the embeddings, and the weights."""
    lead = 1 + WORDS + TRIGRAMS
    total = np.sum([x[:lead] for x in pieces], axis=0, dtype=float)
    size = (len(pieces[0]) - lead) // 2
    out = np.zeros(2 * size)
    for x in pieces:
        share = np.where(total > 0, x[:lead] / np.where(total > 0, total, 1), 1 / len(pieces))
        rows = np.repeat(share[1:], WIDTH)
        out += np.tile(np.r_[rows, np.full(size - len(rows), share[0])], 2) * x[lead:]
    return np.r_[total, out].astype("f4")


def learn(net: Net, w: K.Words, vocab: Vocabulary, docs: np.ndarray, toxic: np.ndarray, weight: np.ndarray, progress: float, rare: tuple[np.ndarray, np.ndarray], moved: np.ndarray, rng: np.random.Generator) -> None:
    """A step from some documents."""
    rate = 0.1 if progress < 0.6 else 0.03
    which, k = K.spread(w.counts[docs])
    used, at = np.unique(vocab.at[w.ptr[docs][which] + k], return_inverse=True)
    tri_of, j = K.spread(np.diff(vocab.ptr)[used])
    sub = Vocabulary(at, vocab.bucket[used], vocab.tri[vocab.ptr[used][tri_of] + j], np.r_[0, np.cumsum(np.diff(vocab.ptr)[used])])
    row, start, size = windows(w.counts[docs], np.r_[0, np.cumsum(w.counts[docs])])
    inputs = sub.inputs(net)
    dropped = (rng.random(len(used)) < 0.3) | rare[0][sub.bucket]  # so that characters are learnt as well
    inputs[dropped, :WIDTH] = 0
    x = project(net, inputs)
    # the windows of long documents go in blocks, for memory
    blocks = [slice(lo, lo + BATCH) for lo in range(0, len(row), BATCH)]
    done = [forward(net, x, sub.at, start[b], size[b], keep=len(blocks) == 1) for b in blocks]
    logit = np.concatenate([d[0] for d in done])
    p = 1 / (1 + np.exp(-logit))
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, row, logit)
    sharp = np.exp((logit - top[row]) * (0.5 + 5 * progress))
    share = sharp / np.bincount(row, sharp)[row]
    even = 1 / np.bincount(row)[row]
    dlogit = ((p - toxic[row]) * np.where(toxic[row] > 0, share, 0.5 * share + 0.5 * even) * weight[row]).astype("f4")
    grads, dinputs = None, 0
    for b, d in zip(blocks, done):
        g, di = backward(net, inputs, d[1] if len(blocks) == 1 else forward(net, x, sub.at, start[b], size[b], keep=True)[1], dlogit[b])
        grads = g if grads is None else {name: grads[name] + g[name] for name in g}
        dinputs = dinputs + di
    for name, value in net.parts().items():
        if name in grads:
            adjust(net, name, value, grads[name], rate)
    kept = np.flatnonzero(~dropped)
    rows, back_ = np.unique(sub.bucket[kept], return_inverse=True)
    adjust(net, "word", net.word, np.stack([np.bincount(back_, c, len(rows)) for c in dinputs[kept, :WIDTH].T], axis=1).astype("f4"), rate, rows)
    moved[rows] += 1
    each = dinputs[:, WIDTH:] / np.diff(sub.ptr)[:, None]
    common = np.flatnonzero(~rare[1][sub.tri])
    rows, back_ = np.unique(sub.tri[common], return_inverse=True)
    adjust(net, "tri", net.tri, np.stack([np.bincount(back_, c[tri_of[common]], len(rows)) for c in each.T], axis=1).astype("f4"), rate, rows)
    moved[WORDS + rows] += 1


def train(own: DataFrame, known: DataFrame, each: tuple[int, int] = SHARD) -> Net | None:
    """A network trained on all rows of own (doc_id, text) that known (doc_id, label: 0 or 1) has; None if there is but one class."""
    rows, n = labelled(own, known, each)
    shards = rows.persist(StorageLevel.DISK_ONLY)
    try:
        return fit(shards, n)
    finally:
        shards.unpersist()


def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("label").to_numpy().astype(np.int64), b.column("held_out").to_numpy(zero_copy_only=False)


def fit(shards: DataFrame, n: int) -> Net | None:
    spark = shards.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + WORDS + TRIGRAMS, np.int64)
        for b in K.chunks(batches):
            tally(K.words(b.column("text")), *columns(b), total)
        yield piece(total)

    counts = merged(shards.mapInArrow(count, "part int, data binary"), n, lambda x: np.sum(x, axis=0), "i8")
    classes = counts[:4].reshape(2, 2)
    split = bool(classes.min())  # else nothing is held out, and the threshold is chosen on all
    pools = classes[0] if split else classes.sum(axis=0)
    if not pools.min():
        return None
    rare = counts[4 : 4 + WORDS] < MIN_DOCS, counts[4 + WORDS :] < MIN_DOCS
    per_class = 0.5 * pools.sum() / pools
    expected = pools.sum() / n
    again = max(1, int(np.ceil(STEPS / ROUNDS / np.ceil(expected / DOCS))))
    flat = Net.fresh().flat()
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((flat, rare))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, rare = held.value
            net, moved, seen = Net.of(flat), np.zeros(WORDS + TRIGRAMS, "f4"), 0
            rng = np.random.default_rng([SEED, turn, TaskContext.get().partitionId()])
            for b in K.chunks(batches):
                w = K.words(b.column("text"))
                vocab = Vocabulary.of(w)
                toxic, held_out = columns(b)
                use = (w.counts > 0) & ~(held_out & split)
                pools = [np.flatnonzero(use & (toxic == c)) for c in (0, 1)]
                total = sum(map(len, pools))
                steps = -(-total // DOCS)
                for k in range(again):
                    order = [rng.permutation(p) for p in pools]
                    for s in range(steps):
                        # every document once at least; more often where a step would have too few of its class, for less weight
                        some = [np.take(o, np.arange(m := len(o) * s // steps, m + min(len(o), max(LEAST, len(o) * (s + 1) // steps - m))), mode="wrap") if len(o) else o for o in order]
                        weight = np.concatenate([np.full(len(x), len(o) / total * per_class[c] / max(1, len(x))) for c, (x, o) in enumerate(zip(some, order))])
                        docs = np.concatenate(some)
                        done = min(1.0, (seen + total * (k + s / steps) / again) / expected)
                        learn(net, w, vocab, docs, toxic[docs], weight, (turn + done) / ROUNDS, rare, moved, rng)
                seen += total
            yield piece(np.r_[np.float32(seen), moved, net.flat()].astype("f4"))

        flat = merged(shards.mapInArrow(run, "part int, data binary"), n, averaged, "f4")[1 + WORDS + TRIGRAMS :]
        held.destroy()
    net = Net.of(flat)
    net.sums = {}
    # the threshold: on all that was held out, missing few of the toxic and hardly any of the others
    final = spark.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            best, n, _ = doc_scores(final.value, K.words(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(best, DIGITS)), b.column("label")], names=["score", "label"]).filter(pa.array(n > 0))

    judged = shards.filter("held_out") if split else shards
    t = judged.mapInArrow(judge, "score double, label int").groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).toPandas().sort_values("score")
    final.destroy()
    net.threshold = cut(t.score.to_numpy(), t.pos.to_numpy(), t.neg.to_numpy())
    return net


def cut(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, cost: float = 5.0) -> float:
    """The threshold with the highest rate of hits less cost times that of false alarms, from how many documents of either class have each score; the middle of the widest gap of equally good ones."""
    edges = np.unique(np.r_[0.0, score, 1.0])
    at = (edges[1:] + edges[:-1]) / 2
    below = np.searchsorted(score, at)
    rate = lambda x: 1 - np.r_[0, np.cumsum(x)][below] / x.sum()
    gain = rate(pos) - cost * rate(neg)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(at[best[np.argmax(np.diff(edges)[best])]])


def doc_scores(net: Net, w: K.Words, threshold: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The highest score, the windows and those that reach the threshold, of every row."""
    rows = len(w.ptr) - 1
    row, start, size = windows(w.counts, w.ptr)
    best, hits = np.zeros(rows), np.zeros(rows, np.int64)
    if len(row):
        vocab = Vocabulary.of(w)
        x = project(net, vocab.inputs(net))
        score = np.empty(len(row))
        for at in range(0, len(row), BATCH):
            some = slice(at, at + BATCH)
            score[some] = 1 / (1 + np.exp(-forward(net, x, vocab.at, start[some], size[some])[0].astype(float)))
        np.maximum.at(best, row, score)
        hits = np.bincount(row, score >= threshold, rows).astype(np.int64)
    return best, np.bincount(row, minlength=rows), hits


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: tuple[int, int]) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most so many labelled documents of each class: those without the label first."""
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("bigint").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    own = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = F.xxhash64(F.col("doc_id"))
    # the bound holds for what is sent to the driver; ids without a document don't count, if but half of the labelled have one
    picked = [known.filter(F.col("label") > 0 if c else F.col("label") <= 0).orderBy(order, "doc_id").limit(2 * most[c]) for c in (0, 1)]
    got = own.join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id").filter("text is not null").select("doc_id", "label", "text")
    t = got.toPandas().drop_duplicates("doc_id")
    t = t.assign(h=K.mix(t.doc_id.to_numpy(np.int64).view(np.uint64).copy())).sort_values("h")
    t = t[t.groupby(t.label > 0).cumcount() < np.where(t.label > 0, most[1], most[0])]
    return t.text.tolist(), (t.label.to_numpy() > 0).astype(np.int64)


def toxic_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, n_windows, toxic_windows and score of the documents that reach the threshold."""
    slim = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("bigint").alias("doc_id")).agg((F.max(F.col(label)) > 0).cast("int").alias("label"))
    net = train(slim, stored(known, "labels"))
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in K.chunks(batches):
            if net is None:
                continue
            best, n, hits = doc_scores(net, K.words(b.column("text")), net.threshold)
            ok = pa.array(np.flatnonzero(best >= net.threshold))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits), pa.array(np.round(best, 4))], names=["doc_id", "n_windows", "toxic_windows", "score"]).take(ok)

    return slim.mapInArrow(run, "doc_id bigint, n_windows bigint, toxic_windows bigint, score double")
