"""Substring dedup: passages of ``WINDOW`` words or more that occur twice or more.

Every window of 50 words has an anchor, the least hash of its 26 runs of 25
words. Equal windows have equal anchors at equal places, so an anchor occurs at
least as often as any window that has it. Each partition counts its anchors in a
count-min sketch; merged sketches never underestimate. In a second pass, the
windows whose anchor's estimate is two or more, and no others, are grouped
exactly by their own hashes. No repeated window is lost; the others' anchors are
rarely kept. Windows go to their group by anchor, so neighbours travel and come
back as one run.

The sketch has some four cells for each anchor, up to ``MAX_CELLS``; beyond that
more windows than needed are grouped, with the same result.

Defined cases: null, empty and shorter texts have no window; a passage that
occurs twice inside one document counts; repeated rows count as occurrences, and
the spans of rows with one id, or with null ids, are reported together, merged
where they meet; an empty table gives an empty result. Only the id and the text
are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .common import bucket_count, bucket_ids

WINDOW = 50
RUN = 25
DEPTH = 2
BLOCK = 20
MAX_CELLS = 1 << 31
HELD = 16 << 20
EACH = 8 << 20


def slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n]; what is missing at the end is left out."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        if len(out) <= step:
            break
        out = np.r_[op(out[:-step], out[step:]), out[-step:]]
        have += step
    return out


def anchors(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word, whether a window begins there, the window's anchor, and the hash of the run of words."""
    runs = K.window_hashes(w.hashes, RUN)
    begins = w.left() >= WINDOW
    least = slide(runs, WINDOW - RUN + 1, np.minimum)
    return begins, least, runs


def chosen(w: K.Words) -> np.ndarray:
    """The runs that are the anchor of a window, at every place where they are."""
    begins, least, runs = anchors(w)
    of = np.where(begins, least, 0)
    # the largest of the anchors of all windows that hold a run is that run, or it is no anchor
    return runs[slide(of[::-1], WINDOW - RUN + 1, np.maximum)[::-1] == runs] if len(runs) else runs


def cells(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    h = K.mix(anchor.copy())
    return [(h & np.uint64(width - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)]


def split(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(n + 1))


def repeated_cells(slim: DataFrame, width: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether it counts two or more."""
    blocks = max(1, width >> BLOCK)
    low = (1 << BLOCK) - 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rows = []
            for d, cell in enumerate(np.concatenate(x) for x in zip(*held)):
                # the partition's sketch: its counters stop at two, and so often a cell is named
                cell, n = np.unique(cell, return_counts=True)
                cell = np.repeat(cell, np.minimum(n, 2))
                by, ptr = split(cell >> BLOCK, blocks)
                local = (cell[by] & low).astype("<u4")
                rows += [(d * blocks + k, local[ptr[k] : ptr[k + 1]].tobytes()) for k in range(blocks) if ptr[k + 1] > ptr[k]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "cells"])

        for b in K.chunks(batches):
            held.append(cells(chosen(K.words(b.column("text"))), width))
            size += len(held[-1][0]) * 16
            if size > HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def merge(t: pa.Table) -> pa.Table:
        count = np.zeros(1 << BLOCK, np.uint8)
        for blob in t.column("cells"):
            n = np.bincount(np.frombuffer(blob.as_buffer(), "<u4"), minlength=1 << BLOCK)
            np.minimum(count + np.minimum(n, 2), 2, out=count, casting="unsafe")
        return pa.table({"block": t.column("block")[:1], "bits": pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros((DEPTH, max(1 << BLOCK, width) // 8), np.uint8)
    got = slim.mapInArrow(partial, "block int, cells binary").groupBy("block").applyInArrow(merge, "block int, bits binary").toArrow()
    for block, blob in zip(got.column("block").to_pylist(), got.column("bits")):
        at = (block % blocks) << BLOCK >> 3
        bits[block // blocks, at : at + (1 << BLOCK >> 3)] = np.frombuffer(blob.as_buffer(), np.uint8)
    return bits


def width_for(words: float) -> int:
    need = 4 * words * 2 / (WINDOW - RUN + 2)
    return min(MAX_CELLS, 1 << max(BLOCK, int(np.ceil(np.log2(need + 1)))))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and n_words of every longest passage whose windows all occur twice or more."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = width_for(size / 6)
    bits = repeated_cells(slim, width)
    held, buckets = spark.sparkContext.broadcast(bits), bucket_count(spark, size / 3, EACH)
    numbers = bucket_ids(buckets)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed by bucket: windows' hashes, and (doc_id, is null, first word, windows) of each run with one anchor."""
        bits = held.value
        kept: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            bucket, ids, null, start, n, hashes = (np.concatenate(x) for x in zip(*kept))
            by, ptr = split(bucket, buckets)
            at = np.r_[0, np.cumsum(n)]
            rows = []
            for k in range(buckets):
                some = by[ptr[k] : ptr[k + 1]]
                if len(some):
                    which, j = K.spread(n[some])
                    rows.append((numbers[k], ids[some].tobytes(), null[some].tobytes(), start[some].tobytes(), n[some].tobytes(), hashes[at[some][which] + j].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 6)], names=["bucket", "ids", "nulls", "starts", "sizes", "hashes"])

        for b in K.chunks(batches):
            w = K.words(b.column("text"))
            begins, least, _ = anchors(w)
            at = np.flatnonzero(begins)
            for d in range(DEPTH):
                cell = cells(least[at], width)[d]
                at = at[(bits[d][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0]
            if not len(at):
                continue
            row = w.row[at]
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (least[at][1:] != least[at][:-1])])
            n = np.diff(np.r_[first, len(at)]).astype("<i4")
            ids = b.column("doc_id")
            kept.append((
                (K.mix(least[at[first]]) % np.uint64(buckets)).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)[row[first]].astype("<i8"),
                ids.is_null().to_numpy(zero_copy_only=False)[row[first]].astype(np.uint8), (at[first] - w.ptr[row[first]]).astype("<i4"), n, K.window_hashes(w.hashes, WINDOW)[at].astype("<u8"),
            ))
            size += len(at) * 8 + len(n) * 17
            if size > HELD:
                yield out()
                kept, size = [], 0
        if kept:
            yield out()

    def exact(t: pa.Table) -> pa.Table:
        """The runs of windows that occur twice or more in the bucket, as spans of words."""
        get = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(c)])
        ids, null, start, n, hashes = get("ids", "<i8"), get("nulls", np.uint8), get("starts", "<i4"), get("sizes", "<i4"), get("hashes", "<u8")
        by = np.argsort(hashes)
        new = np.r_[True, hashes[by][1:] != hashes[by][:-1]]
        group = np.cumsum(new) - 1
        twice = np.zeros(len(hashes), bool)
        twice[by] = np.bincount(group)[group] > 1
        which, j = K.spread(n)
        at = np.flatnonzero(twice)
        which, j = which[at], j[at]
        first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (j[1:] != j[:-1] + 1)]) if len(at) else at
        last = np.r_[first[1:], len(at)] - 1
        run = which[first]
        return pa.table({"doc_id": pa.array(ids[run], pa.int64(), mask=null[run] > 0), "s": pa.array(start[run] + j[first], pa.int64()), "e": pa.array(start[run] + j[last] + WINDOW, pa.int64())}) if len(at) else pa.table({"doc_id": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "e": pa.array([], pa.int64())})

    runs = slim.mapInArrow(candidates, "bucket int, ids binary, nulls binary, starts binary, sizes binary, hashes binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(exact, "doc_id bigint, s bigint, e bigint")
    # runs of one passage overlap: they begin in neighbouring words and are WINDOW words or longer
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    new = F.col("s") - 1 > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)) - WINDOW, F.lit(-2))
    island = runs.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def spans_sql() -> str:
    return f"""
with d as materialized (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{K.WORD}') w from documents),
g as (select doc_id, i, md5_number(array_to_string(w[i:i + {WINDOW - 1}], ' ')) g from d, unnest(range(1, len(w) - {WINDOW - 2})) t(i)),
m as (select doc_id, i from g qualify count(*) over (partition by g) > 1),
p as (select doc_id, i, i - row_number() over (partition by doc_id order by i) island from m)
select doc_id, (min(i) - 1)::bigint start_word, (max(i) - 1 + {WINDOW})::bigint end_word, (max(i) - min(i) + {WINDOW})::bigint n_words from p group by doc_id, island"""
