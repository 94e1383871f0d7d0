"""Quality rules by suffix arrays: how much of a document repeats inside it.

The suffix array of every document is built by prefix doubling over its words,
all documents of a chunk at once. Sorting starts from ``min_words``-grams, so
that only suffixes that repeat at least that far are ordered further. The longest
common prefixes of neighbours give each suffix its longest repeat; these are the
maximal repeated substrings, and the union of their spans is what is covered.

A document is kept if at most ``max_fraction`` of its words is covered and its
longest repeat has at most ``max_longest_fraction`` of them; ``free_words`` are
allowed in both cases, so that a short text may repeat its heading.

Defined cases: a null or empty text, or one of fewer than ``min_words`` words,
has nothing covered and is kept. Rows are judged one by one: null ids, repeated
rows and ties make no difference, further columns go through untouched, and an
empty table gives an empty result. Texts of any length are judged whole.
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

MIN_WORDS = 5
MAX_FRACTION = 0.6
FREE_WORDS = 20
MAX_LONGEST_FRACTION = 0.25


def suffix_repeats(hashes: np.ndarray, ptr: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose suffix repeats at least `least` words in the same row, and their longest repeats.

    hashes: of the words of all rows; row k has those from ptr[k] to ptr[k + 1].
    """
    none = np.zeros(0, np.int64)
    n = len(hashes)
    counts = np.diff(ptr)
    left = np.repeat(ptr[1:], counts) - np.arange(n)
    at = np.flatnonzero(left >= least)
    if not len(at):
        return none, none
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = K.mix(K.window_hashes(hashes, least)[at] ^ (row[at] + np.uint64(1)) * np.uint64(K._GOLD))
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    group = np.cumsum(new) - 1
    live = at[order[np.bincount(group)[group] > 1]]
    if not len(live):
        return none, none
    # a suffix that repeats is compared by what begins in it, up to `least` words behind the last live position
    edge = np.zeros(n + least + 2, np.int64)
    edge[live] += 1
    edge[live + least + 1] -= 1
    some = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    grams = [np.where(left[some] > k, hashes[np.minimum(some + k, n - 1)], 0) for k in range(least)]
    by = np.lexsort([*grams[::-1], row[some]])
    sa = some[by]
    differs = np.r_[True, row[sa][1:] != row[sa][:-1]]
    for g in grams:
        differs[1:] |= g[by][1:] != g[by][:-1]
    # a rank is the first place of those that are equal so far; outside these suffixes, a number of its own
    rank = -np.arange(1, n + 2)
    place = np.arange(len(sa))
    rank[sa] = np.maximum.accumulate(np.where(differs, place, 0))
    levels, step = [rank], least
    while True:
        bounds = np.flatnonzero(np.r_[True, rank[sa][1:] != rank[sa][:-1]])
        size = np.diff(np.r_[bounds, len(sa)])
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        some = sa[open_]
        ahead = np.where(left[some] > step, rank[np.minimum(some + step, n)], -1)
        by = np.lexsort((ahead, rank[some]))
        some, ahead = some[by], ahead[by]
        sa[open_] = some
        now = rank[some]
        differs = np.r_[True, (now[1:] != now[:-1]) | (ahead[1:] != ahead[:-1])]
        rank = rank.copy()
        rank[some] = np.maximum.accumulate(np.where(differs, open_, 0))
        levels.append(rank)
        step *= 2
    # common prefixes of neighbours, by the levels from the longest step down, then word by word
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][i] == levels[level][j]
        lcp[same] += least << level
        i[same] = np.minimum(i[same] + (least << level), n)
        j[same] = np.minimum(j[same] + (least << level), n)
    open_ = np.flatnonzero(lcp > 0)
    for _ in range(least - 1):
        a, b = i[open_], j[open_]
        ok = (lcp[open_] < np.minimum(left[sa[:-1][open_]], left[sa[1:][open_]])) & (a < n) & (b < n)
        open_ = open_[ok]
        open_ = open_[hashes[i[open_]] == hashes[j[open_]]]
        if not len(open_):
            break
        lcp[open_] += 1
        i[open_] += 1
        j[open_] += 1
    reach = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    return sa[reach >= least], reach[reach >= least]


def measure(texts: pa.Array, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, covered words, the longest repeat's words and maximal repeats of every row."""
    w = K.words(texts)
    rows = len(w.ptr) - 1
    sa, reach = suffix_repeats(w.hashes, w.ptr, least)
    edge = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(edge, sa, 1)
    np.add.at(edge, sa + reach, -1)
    cover = np.cumsum(edge[:-1]) > 0
    covered = np.r_[0, np.cumsum(cover)][w.ptr]
    longest, spans = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if len(sa):
        row = w.row[sa]
        np.maximum.at(longest, row, reach)
        ends = np.zeros(len(w.starts) + 1, np.int64)
        ends[sa] = sa + reach
        maximal = ends[sa] > ends[np.maximum(sa - 1, 0)] * (sa > 0)
        np.add.at(spans, row[maximal], 1)
    return w.counts, np.diff(covered), longest, spans


def with_repetition(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, list[str]]:
    """docs with four columns more, and their names: words, covered words, longest repeat, maximal repeats."""
    names = fresh(docs, "n_words", "repeat_words", "longest_repeat", "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, text):
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(x, pa.int64()) for x in measure(b.column(text), min_words)], names=b.schema.names + names)

    return docs.mapInArrow(run, with_fields(docs, *((x, T.LongType()) for x in names))), names


def passes(n, covered, longest, max_fraction=MAX_FRACTION, max_longest_fraction=MAX_LONGEST_FRACTION, free_words=FREE_WORDS):
    free = F.lit(float(free_words))
    return (F.col(covered) <= F.greatest(free, F.lit(max_fraction) * F.col(n))) & (F.col(longest) <= F.greatest(free, F.lit(max_longest_fraction) * F.col(n)))


def keep_unrepetitive(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of docs that pass the rules, with the columns of docs."""
    measured, names = with_repetition(docs, text)
    return measured.filter(passes(*names[:3], **limits)).drop(*names)


def repetition_report(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The kept documents: doc_id, n_words, repeat_words, longest_repeat, repeat_fraction."""
    slim = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    measured, names = with_repetition(slim)
    return measured.filter(passes(*names[:3], **limits)).select("doc_id", *names[:3], F.round(F.try_divide(names[1], names[0]), 6).alias("repeat_fraction"))
