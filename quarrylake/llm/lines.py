"""Line dedup: a segment-partition edit join over the lines of all documents.

A line (``\\n`` ends it) that is not blank goes if an earlier line is within the
byte edits that the shorter of the two allows: one for each ``BYTES_AN_EDIT`` bytes,
``EDITS`` at most, so lines of fewer bytes go for an equal line only (two edits make
any short word of any other). Lines are ordered by doc_id, then by the hash of the
text (for rows that share an id), then by their number. Precisely: equal lines
form a content, which is as early as its first line. If an earlier content is
within these edits, all lines of the later content go, and the earliest such content is
named as the original; else all but its first line go.

The join: a content is cut into one more even segments than it allows edits. Two lines
within them share a segment, at places that the lengths bound; so each content
puts its segments into an index by length and segment, and probes the indexes of
its own length l and of the lengths below it that its edits reach with the few substrings that a match can leave in
place. Keys travel packed, with a content's hash; only contents that meet another
one (found by a filter of at most ``BLOOM_BITS`` bits, then exactly by a join) send
their text, once for each key they meet at, and are verified by the banded
bit-parallel edit distance. Nothing is capped.

Defined cases: null and empty texts have no lines that count; blank lines below
MIN_BYTES bytes always stay, longer ones are lines like others; null ids come last; rows with the same id and text are one
document, so their lines stay or go alike; further columns go through untouched;
an empty table gives an empty result. A document all of whose lines went, but for
blank ones, goes as well; one that was blank before stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import bucket_count, bucket_ids, fresh, stored
from .substrings import split

MIN_BYTES = 20
EDITS = 2
BYTES_AN_EDIT = 10
BLOOM_BITS = 1 << 29
EACH = 8 << 20
HELD = 16 << 20
CELLS = 1 << 22
LAST = (1 << 63) - 1


def lines(texts: pa.Array) -> K.Words:
    """The lines of every row, as spans without their line feeds."""
    data, offsets = K.utf8(texts)
    feeds = np.flatnonzero(data[: len(data) - 8] == 10)
    starts = np.sort(np.r_[offsets[:-1], feeds + 1])
    # a line feed at a row's end begins an empty line there, and so may the next row: sorting keeps both
    per_row = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    ptr = np.r_[0, np.cumsum(per_row)]
    ends = np.r_[starts[1:] - 1, 0].astype(np.int64)
    ends[ptr[1:] - 1] = offsets[1:]
    return K.Words(data, offsets, starts, ends, ptr)


def allowed(length: np.ndarray) -> np.ndarray:
    """The edits that are allowed between a line of this length and one as long or longer."""
    return np.minimum(EDITS, length // BYTES_AN_EDIT)


def judged(w: K.Words) -> np.ndarray:
    """The lines that count."""
    inked = np.r_[0, np.cumsum(~np.isin(w.data[:-8], np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)))]
    return np.flatnonzero((w.ends - w.starts >= MIN_BYTES) | (inked[w.ends] > inked[w.starts]))


def cut(length: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the k-th of edits + 1 even segments; the last ones are the longer ones."""
    n = edits + 1
    base, longer = length // n, length % n
    start = k * base + np.maximum(0, k - (n - longer))
    return start, base + (k >= n - longer)


def key(span: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    return K.mix(span ^ (length.astype(np.uint64) * np.uint64(K._Q) + np.uint64((k + 1) * K._GOLD % (1 << 64))))


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Lines (as places in starts), their keys, and whether these are index keys or probes."""
    length = ends - starts
    for edits in range(1, EDITS + 1):
        for k in range(edits + 1):
            own = np.flatnonzero(allowed(length) == edits)
            at, size = cut(length[own], k, edits)
            yield own, key(K.hash_spans(data, starts[own] + at, starts[own] + at + size), length[own], k), True
            for gap in range(edits + 1):
                other = length - gap
                at, size = cut(other, k, edits)
                lo, hi = max(-k, gap - (edits - k)), min(k, gap + (edits - k))
                for shift in range(lo, hi + 1):
                    if gap == 0 and shift == 0:
                        continue  # the same as the index key, by which index members meet each other
                    ok = np.flatnonzero((allowed(other) == edits) & (at + shift >= 0) & (at + shift + size <= length))
                    yield ok, key(K.hash_spans(data, (starts + at + shift)[ok], (starts + at + shift + size)[ok]), other[ok], k), False


def within(data: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The edit distances of spans a and b, EDITS + 1 for more; no a is shorter than its b, or longer by more than EDITS.

    A column of the band is a word of 2 * EDITS + 1 bits, one for each diagonal;
    the distance is followed along the diagonal on which the pair ends.
    """
    n, band = len(a[0]), 2 * EDITS + 1
    mask, one = np.uint64((1 << band) - 1), np.uint64(1)
    la, lb = a[1] - a[0], b[1] - b[0]
    out = np.full(n, EDITS + 1, np.int64)
    vp, vn = np.full(n, ((1 << (EDITS + 1)) - 1) << EDITS, np.uint64), np.zeros(n, np.uint64)
    gap = la - lb
    dist, live, diagonal = gap.copy(), np.arange(n), (gap + EDITS).astype(np.uint64)
    done = live[lb == 0]
    out[done] = dist[done]
    top = len(data) - 1
    for j in range(int(lb.max()) if n else 0):
        if j % 8 == 0:
            keep = (lb[live] > j) & (dist <= EDITS)
            live, dist, vp, vn, diagonal = live[keep], dist[keep], vp[keep], vn[keep], diagonal[keep]
            if not len(live):
                break
        c = data[np.minimum(b[0][live] + j, top)]
        eq = np.zeros(len(live), np.uint64)
        for k in range(band):
            i = j - EDITS + k
            if i >= 0:
                eq |= ((data[np.minimum(a[0][live] + i, top)] == c) & (i < la[live])).astype(np.uint64) << np.uint64(k)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        inside = lb[live] > j
        dist = dist + np.where(inside, 1 - ((d0 >> diagonal) & one).astype(np.int64), 0)
        vp = (hn | ~((d0 >> one) | hp)) & mask
        vn = (d0 >> one) & hp
        ended = np.flatnonzero((lb[live] == j + 1) & (dist <= EDITS))
        out[live[ended]] = dist[ended]
    return out


def meeting(key_: np.ndarray, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (an index member, another member) of equal keys, in portions."""
    by = np.lexsort((~index, key_))
    k, ix = key_[by], index[by]
    first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    ends = np.r_[np.flatnonzero(first)[1:], len(k)][group] if len(k) else group
    count = np.where(ix, ends - np.arange(len(k)) - 1, 0)
    total = np.cumsum(count)
    a0 = 0
    while a0 < len(k):
        a1 = max(a0 + 1, int(np.searchsorted(total, (total[a0 - 1] if a0 else 0) + (1 << 19), "right")))
        i, j = K.spread(count[a0:a1])
        if len(i):
            yield by[i + a0], by[i + a0 + j + 1]
        a0 = a1


def bloom(needed: DataFrame) -> np.ndarray:
    """The bits of a filter of the hashes, two for each: 16 bits a hash, at most BLOOM_BITS together, beyond which more passes than needs to."""
    width = min(BLOOM_BITS, max(1 << 16, 1 << int(16 * needed.count()).bit_length()))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(places(b.column("h").to_numpy().view(np.uint64), width)))
            first = np.flatnonzero(np.r_[True, at[1:] >> 6 != at[:-1] >> 6])
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = needed.select("h").mapInArrow(set_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(width // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def places(h: np.ndarray, width: int) -> list[np.ndarray]:
    return [(K.mix(h ^ np.uint64(s)) & np.uint64(width - 1)).astype(np.int64) for s in (7, 11)]


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for place in places(h, len(bits) * 8):
        ok &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return np.flatnonzero(ok)


def near_contents(slim: DataFrame, buckets: int) -> DataFrame:
    """h, x (first line: doc_id, fp, line), edits: contents that go for an earlier one, and that one's first line."""
    spark = slim.sparkSession
    ids = bucket_ids(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, target=4 * K.CHUNK):
            w = lines(b.column("text"))
            at = np.flatnonzero(allowed(w.ends - w.starts) > 0)
            h, first = np.unique(K.hash_spans(w.data, w.starts[at], w.ends[at]), return_index=True)
            at = at[first]
            if not len(at):
                continue
            got = [(k, h[i], np.full(len(i), x)) for i, k, x in keys(w.data, w.starts[at], w.ends[at])]
            k, who, index = (np.concatenate(x) for x in zip(*got))
            by, ptr = split((k % np.uint64(buckets)).astype(np.int64), buckets)
            rows = [(n, by[ptr[n] : ptr[n + 1]]) for n in range(buckets) if ptr[n + 1] > ptr[n]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[[n for n, _ in rows]]), *(pa.array([x[some].tobytes() for _, some in rows], pa.binary()) for x in (k, who, index))], names=["bucket", "k", "h", "i"])

    get = lambda t, c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]) if t.num_rows else np.zeros(0, kind)

    def meet(t: pa.Table) -> pa.Table:
        """Contents that share a key, at the key."""
        k, h, index = get(t, "k", "<u8"), get(t, "h", "<u8"), get(t, "i", bool)
        by = np.lexsort((h, k))
        k, h, index = k[by], h[by], index[by]
        new = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]
        at = np.flatnonzero(new)
        k, h, index = k[at], h[at], np.logical_or.reduceat(index, at)
        # a key concerns those that are in the index and whoever else has it
        first = np.r_[True, k[1:] != k[:-1]]
        group = np.cumsum(first) - 1
        ok = (np.bincount(group)[group] > 1) & (np.bincount(group, weights=index)[group] > 0)
        return pa.table({"h": h[ok].view(np.int64), "k": k[ok].view(np.int64), "i": pa.array(index[ok])})

    sent = slim.select("text").mapInArrow(send, "bucket int, k binary, h binary, i binary").repartition(buckets, "bucket")
    needed = stored(sent.groupBy("bucket").applyInArrow(meet, "h bigint, k bigint, i boolean"), "meetings")
    held = spark.sparkContext.broadcast(bloom(needed))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first line of each content that may meet another one, as far as a chunk sees."""
        for b in K.chunks(batches):
            w = lines(b.column("text"))
            at = np.flatnonzero(allowed(w.ends - w.starts) > 0)
            h = K.hash_spans(w.data, w.starts[at], w.ends[at])
            some = passing(held.value, h)
            at, h = at[some], h[some]
            row = w.row[at]
            doc, fp = b.column("doc_id").fill_null(LAST).to_numpy()[row], b.column("fp").to_numpy()[row]
            by = np.lexsort((at - w.ptr[row], fp, doc, h))
            by = by[np.r_[True, h[by][1:] != h[by][:-1]][: len(by)]]
            if not len(by):
                continue
            at, row, h = at[by], row[by], h[by]
            offsets = np.r_[0, np.cumsum(w.ends[at] - w.starts[at])]
            _, j = K.spread(np.diff(offsets))
            body = w.data[np.repeat(w.starts[at], np.diff(offsets)) + j]
            text = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(body.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[by]), pa.array(fp[by]), pa.array((at - w.ptr[row]).astype(np.int64)), text], names=["h", "doc_id", "fp", "line", "body"])

    found = slim.mapInArrow(texts, "h bigint, doc_id bigint, fp bigint, line bigint, body binary")
    bodies = found.join(needed, "h").withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")

    def verify(t: pa.Table) -> pa.Table:
        get_ = lambda c: t.column(c).to_numpy()
        by = np.lexsort((get_("line"), get_("fp"), get_("doc_id"), get_("h"), get_("k")))
        k, h = get_("k")[by], get_("h")[by]
        by = by[np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]]  # each content's first line
        t = t.take(pa.array(by))
        k, h, doc, fp, line = (t.column(c).to_numpy() for c in ("k", "h", "doc_id", "fp", "line"))
        index = t.column("i").to_numpy(zero_copy_only=False)
        data, offsets = K.utf8(t.column("body").cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
        s, e = offsets[:-1], offsets[1:]
        order = np.empty(len(k), np.int64)
        order[np.lexsort((line, fp, doc))] = np.arange(len(k))
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in meeting(k, index):
            flip = (e - s)[a] < (e - s)[b]
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            ok = ((e - s)[a] - (e - s)[b] <= EDITS) & (h[a] != h[b])
            a, b = a[ok], b[ok]
            size = np.argsort((e - s)[b], kind="stable")
            a, b = a[size], b[size]
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                d = within(data, (s[x], e[x]), (s[y], e[y]))
                ok = d <= allowed((e - s)[y])
                x, y, d = x[ok], y[ok], d[ok]
                later = order[x] > order[y]
                found.append((np.where(later, x, y), np.where(later, y, x), d))
        lose, keep, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        by = np.lexsort((order[keep], lose))
        lose, keep, d = lose[by], keep[by], d[by]
        top = np.r_[True, lose[1:] != lose[:-1]] if len(lose) else np.zeros(0, bool)
        lose, keep, d = lose[top], keep[top], d[top]
        return pa.table({"h": h[lose], "doc_id": doc[keep], "fp": fp[keep], "line": line[keep], "edits": d.astype(np.int64)})

    beaten = bodies.groupBy("bucket").applyInArrow(verify, "h bigint, doc_id bigint, fp bigint, line bigint, edits bigint")
    return beaten.groupBy("h").agg(F.min(F.struct("doc_id", "fp", "line", "edits")).alias("x"))


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the text's hash), line, first_doc_id, first_line and edits of every line that goes."""
    slim = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("fp"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    near = near_contents(slim, bucket_count(docs.sparkSession, size / 2, EACH))
    # occurrences and losers meet by a cogroup, which partitions by the hash of the bucket
    buckets = bucket_count(docs.sparkSession, size / 4, EACH)
    numbers = bucket_ids(buckets)

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*kept)]
            by, ptr = split((cols[0] % np.uint64(buckets)).astype(np.int64), buckets)
            rows = [(n, by[ptr[n] : ptr[n + 1]]) for n in range(buckets) if ptr[n + 1] > ptr[n]]
            return pa.RecordBatch.from_arrays([pa.array(numbers[[n for n, _ in rows]]), *(pa.array([x[some].tobytes() for _, some in rows], pa.binary()) for x in cols)], names=["bucket", "h", "doc", "fp", "line"])

        for b in K.chunks(batches):
            w = lines(b.column("text"))
            at = judged(w)
            row = w.row[at]
            ids, fp = b.column("doc_id").fill_null(LAST).to_numpy(), b.column("fp").to_numpy()
            kept.append((K.hash_spans(w.data, w.starts[at], w.ends[at]), ids[row], fp[row], at - w.ptr[row]))
            size += len(at) * 32
            if size > HELD:
                yield out()
                kept, size = [], 0
        if size:
            yield out()

    occurrences = slim.mapInArrow(occur, "bucket int, h binary, doc binary, fp binary, line binary")

    def judge(key_: tuple, lines_: pa.Table, beaten: pa.Table) -> pa.Table:
        get = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in lines_.column(c)]) if lines_.num_rows else np.zeros(0, kind)
        h, doc, fp, line = get("h", "<u8"), get("doc", "<i8"), get("fp", "<i8"), get("line", "<i8")
        by = np.lexsort((line, fp, doc, h))
        h, doc, fp, line = h[by], doc[by], fp[by], line[by]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (doc != doc[first]) | (fp != fp[first]) | (line != line[first])
        to_doc, to_line, edits = doc[first], line[first], np.zeros(len(h), np.int64)
        bh = beaten.column("h").to_numpy().view(np.uint64)
        some = np.argsort(bh)
        if len(some) and len(h):
            at = np.minimum(np.searchsorted(bh[some], h), len(some) - 1)
            lost = bh[some][at] == h
            at = some[at[lost]]
            gone[lost] = True
            to_doc[lost], to_line[lost], edits[lost] = (beaten.column(c).to_numpy()[at] for c in ("doc_id", "line", "edits"))
        g = np.flatnonzero(gone)
        null = lambda x: pa.array(x[g], pa.int64(), mask=x[g] == LAST)
        return pa.table({"doc_id": null(doc), "fp": fp[g], "line": line[g], "first_doc_id": null(to_doc), "first_line": to_line[g], "edits": edits[g]})

    def lost_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = numbers[(b.column("h").to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns], names=["bucket", *b.schema.names])

    lost = near.select("h", "x.doc_id", "x.line", "x.edits").mapInArrow(lost_in, "bucket int, h bigint, doc_id bigint, line bigint, edits bigint")
    occurrences, lost = (x.repartition(buckets, "bucket").groupBy("bucket") for x in (occurrences, lost))
    return occurrences.cogroup(lost).applyInArrow(judge, "doc_id bigint, fp bigint, line bigint, first_doc_id bigint, first_line bigint, edits bigint")


def without_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines that stay, with the columns of docs; documents left blank go."""
    i, f, drop = fresh(docs, "line_id", "line_fp", "line_drop")
    # as many bare line numbers as a row has lines that go
    gone = repeated_lines(docs, id, text).distinct().groupBy(F.col("doc_id").alias(i), F.col("fp").alias(f)).agg(F.collect_set("line").alias(drop))
    joined = docs.join(gone, F.col(id).cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(f)), "left")
    pieces = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(drop).cast("array<int>"))
    body = F.array_join(F.transform(left, lambda n: F.get(pieces, n)), "\n")
    text_ = F.when(F.col(drop).isNull(), F.col(text)).otherwise(body)
    out = joined.withColumn(text, text_).filter(F.col(drop).isNull() | F.col(text).rlike(r"\S"))
    return out.select(*docs.columns)
