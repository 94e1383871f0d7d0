"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

First all documents are searched for the benchmark's word bigrams and trigrams,
which gives their frequencies. A gram is a seed if it is rare (at most ``FEW``
occurrences, or one in ``RARE`` words), and so is the rarest of every ``BLOCK``
neighbouring grams of an item that occur at all, however often, so that an item
copied thousands of times keeps its seeds. These are shares of the corpus, whatever
its size. A document and an item meet where they share a seed trigram, or a chain of
``CHAIN`` seed bigrams as far apart in one as in the other, give or take ``SHIFT``
words from each to the next; so a copy with each third word replaced, which has no
trigram left, is met, too. Around these places the local alignment of the item with
the text is scored (match +2, mismatch -1, gap -1 a word) and divided by the score of
an exact copy. An alignment that reaches the least share has at most as many further
words as its score allows, so text of ``reach`` items around the seeds is aligned and
nothing is cut.

The benchmark is held by every task. It is taken in slices of at most
``SLICE_WORDS`` words, so what is broadcast is bounded; a larger benchmark takes
more passes over the documents. Grams are counted over all documents for each slice,
so the slices make no difference to the result.

Defined cases: a null or empty text has no matches; an item with fewer words than
three matches nothing; a null id of a document or an item stays null in the
report; repeated documents and items each give their rows; of equal scores the
first place in the text counts; either table may be empty; further columns of
documents go through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import fresh, with_fields

FEW = 100
RARE = 100_000
CHAIN = 3
#: Of so many neighbouring grams of an item one is a seed, by the words of a gram.
BLOCK = {2: 2, 3: 4}
SHIFT = 1
MIN_SCORE = 0.5
SLICE_WORDS = 1 << 22
CELLS = 1 << 21


class Grams:
    """The n-grams of some benchmark items, and the items and places that have them."""

    def __init__(self, at: np.ndarray, item: np.ndarray, where: np.ndarray, grams: np.ndarray, gram_of: np.ndarray, n: int):
        self.at, self.item, self.where, self.grams, self.gram_of, self.n = at, item, where, grams, gram_of, n
        by = np.argsort(gram_of, kind="stable")
        self.who, self.there = item[by], where[by]
        self.who_ptr = np.searchsorted(gram_of[by], np.arange(len(grams) + 1))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[grams >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are grams of the table, and which gram each is."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        g = np.minimum(np.searchsorted(self.grams, h[some]), len(self.grams) - 1)
        ok = self.grams[g] == h[some]
        return some[ok], g[ok]

    def hits(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items that have a gram of the text, the word at which it begins there, and that in the item."""
        at, h = w.grams(self.n)
        hit, gram = self.find(h)
        which, k = K.spread(self.who_ptr[gram + 1] - self.who_ptr[gram])
        some = self.who_ptr[gram][which] + k
        return self.who[some], at[hit][which], self.there[some]

    def seeds(self, count: np.ndarray, words: int) -> "Grams":
        """Those that are rare in so many words, or the rarest of a block of neighbours."""
        keep = (count <= max(FEW, words // RARE)) & (count > 0)
        count = np.where(count > 0, count, np.iinfo(np.int64).max)
        if len(self.at):
            first = np.flatnonzero(np.r_[True, self.item[1:] != self.item[:-1]])
            size = np.diff(np.r_[first, len(self.item)])
            end = np.repeat(first + size, size)
            mine, at = count[self.gram_of], np.arange(len(self.at))
            block = [np.minimum(at + k, end - 1) for k in range(BLOCK[self.n])]
            low = np.min([mine[to] for to in block], axis=0)
            for to in block:
                keep[self.gram_of[to[mine[to] == low]]] = True
        keep &= count < np.iinfo(np.int64).max
        some = keep[self.gram_of]
        return Grams(self.at[some], self.item[some], self.where[some], self.grams[keep], (np.cumsum(keep) - 1)[self.gram_of[some]], self.n)


class Items:
    """The words of some benchmark items, and their grams."""

    def __init__(self, texts: pa.Array):
        w = K.words(texts)
        self.words, self.ptr = w.hashes, w.ptr
        self.tables = []
        for n in BLOCK:
            at, gram = w.grams(n)
            long = w.counts[w.row[at]] >= max(BLOCK)
            at, gram = at[long], gram[long]
            item = w.row[at]
            self.tables.append(Grams(at, item, at - w.ptr[item], *np.unique(gram, return_inverse=True), n))

    def seeds(self, counts: list[np.ndarray], words: int) -> "Items":
        out = object.__new__(Items)
        out.words, out.ptr, out.tables = self.words, self.ptr, [t.seeds(c, words) for t, c in zip(self.tables, counts)]
        return out

    def places(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """The items and the words of the text at which they meet it, in order of row, item and word."""
        (who, pos, there), (who3, pos3, _) = (t.hits(w) for t in self.tables)
        # bigrams need others of the item, as far from them as there
        shift = pos - there
        by = np.lexsort((there, shift, who, w.row[pos]))
        who, pos, there, shift = who[by], pos[by], there[by], shift[by]
        apart = (w.row[pos][1:] != w.row[pos][:-1]) | (who[1:] != who[:-1]) | (shift[1:] - shift[:-1] > SHIFT)
        chain = np.cumsum(np.r_[True, apart][: len(who)])
        # a place of the item counts once in a chain
        again = np.r_[False, ~apart & (there[1:] == there[:-1])][: len(who)]
        some = np.bincount(chain, ~again)[chain] >= CHAIN if len(who) else np.zeros(0, bool)
        who, pos = np.r_[who[some], who3], np.r_[pos[some], pos3]
        by = np.lexsort((pos, who, w.row[pos]))
        return who[by], pos[by]


def smith_waterman(item: np.ndarray, item_len: np.ndarray, text: np.ndarray, text_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best local scores of padded pairs, and the text's words at which these alignments end."""
    b, width = text.shape
    kind = np.int16 if width + 2 * item.shape[1] < 1 << 15 else np.int32
    slope = np.arange(width, dtype=kind)
    score, best, end = np.zeros((b, width + 1), kind), np.zeros(b, kind), np.zeros(b, np.int64)
    inside = slope[None, :] < text_len[:, None]
    for i in range(item.shape[1]):
        step = np.where((text == item[:, i, None]) & inside, kind(2), kind(-1))
        now = np.maximum(score[:, :-1] + step, score[:, 1:] - 1)
        np.maximum(now, 0, out=now)
        now += slope
        np.maximum.accumulate(now, axis=1, out=now)
        now -= slope
        now[item_len <= i] = 0
        top = now.argmax(axis=1)
        high = now[np.arange(b), top]
        better = (high > best) | ((high == best) & (top < end))
        best, end = np.where(better, high, best), np.where(better, top, end)
        score[:, 1:] = now
    return best, end


def matches(w: K.Words, items: Items, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, share of the item's full score and the word where the alignment ends, of every pair that reaches the least share."""
    who, pos = items.places(w)
    none = np.zeros(0, np.int64)
    if not len(who):
        return none, none, np.zeros(0), none
    row, size = w.row[pos], np.diff(items.ptr)[who]
    # an alignment that reaches the share has all of the item's words and some more at most
    reach = 1 + 2 * (1 - least)
    far = np.ceil(reach * size).astype(np.int64) + max(BLOCK)
    new = np.r_[True, (row[1:] != row[:-1]) | (who[1:] != who[:-1]) | (pos[1:] - pos[:-1] > 2 * far[1:])]
    first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
    row, who, size, far = row[first], who[first], size[first], far[first]
    lo = np.maximum(pos[first] - far, w.ptr[row])
    hi = np.minimum(pos[last] + far, w.ptr[row + 1])
    score, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    by = np.argsort(hi - lo, kind="stable")
    at = 0
    while at < len(by):
        # as many pairs as fit, by the width of the widest
        fits = np.arange(1, len(by) - at + 1) * (hi - lo + 1)[by[at:]] <= CELLS
        to = at + max(1, int(np.count_nonzero(fits)))
        some = by[at:to]
        wide, deep = int((hi - lo)[some].max()), int(size[some].max())
        text = w.hashes[np.minimum(lo[some, None] + np.arange(wide), len(w.hashes) - 1)]
        item = items.words[np.minimum(items.ptr[who[some], None] + np.arange(deep), len(items.words) - 1)]
        score[some], end[some] = smith_waterman(item, size[some], text, (hi - lo)[some])
        at = to
    share, end = score / (2 * size), lo + end - w.ptr[row]
    # of the places where a row meets an item, the best one
    by = np.lexsort((end, -share, who, row))
    row, who, share, end = row[by], who[by], share[by], end[by]
    top = np.r_[True, (row[1:] != row[:-1]) | (who[1:] != who[:-1])] & (share >= least)
    return row[top], who[top], share[top], end[top]


def slices(benchmark: DataFrame, item_id: str, text: str) -> list[pa.Table]:
    """The benchmark in parts of at most about SLICE_WORDS words."""
    slim = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // (SLICE_WORDS * 4)
    for k in range(n):
        yield slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()


def seeded(docs: DataFrame, part: pa.Table, text: str) -> Items:
    """The items of a slice with their seeds, by the grams' counts over all documents."""
    items = Items(part.column("text"))
    held = docs.sparkSession.sparkContext.broadcast(items)
    first = np.r_[0, np.cumsum([len(t.grams) for t in items.tables])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(first[-1] + 1, np.int64)
        for b in K.chunks(batches):
            w = K.words(b.column("text"))
            total[-1] += len(w.starts)
            for t, at in zip(held.value.tables, first):
                total[at : at + len(t.grams)] += np.bincount(t.find(w.grams(t.n)[1])[1], minlength=len(t.grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    got = docs.select(F.col(text).alias("text")).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(first[-1] + 1, np.int64)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return items.seeds(np.split(counts[:-1], first[1:-1]), int(counts[-1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score (share of an exact copy's) and end_word of every match."""
    out = None
    for part in slices(benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast((seeded(docs, part, text), part.column("item_id").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items, ids = held.value
            for b in K.chunks(batches):
                row, who, share, end = matches(K.words(b.column("text")), items, least)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), ids.take(pa.array(who)), pa.array(np.round(share, 6)), pa.array(end)], names=["doc_id", "item_id", "score", "end_word"])

        found = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint, score double, end_word bigint")
        out = found if out is None else out.unionAll(found)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that match no item, with the columns of docs."""
    every = docs
    for part in slices(benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(seeded(every, part, text))
        (flag,) = fresh(docs, "contaminated")

        def run(batches: Iterator[pa.RecordBatch], held=held, flag=flag) -> Iterator[pa.RecordBatch]:
            for b in K.chunks(batches, text):
                bad = np.zeros(b.num_rows, bool)
                bad[matches(K.words(b.column(text)), held.value, least)[0]] = True
                yield pa.RecordBatch.from_arrays(b.columns + [pa.array(bad)], names=b.schema.names + [flag])

        docs = docs.mapInArrow(run, with_fields(docs, (flag, T.BooleanType()))).filter(~F.col(flag)).drop(flag)
    return docs
