"""N-gram Jaccard join: which documents share at least half of their word trigrams.

A document is the set of its word ``GRAM``-grams, each a hash of 48 bits. Rows with
equal sets are one *class*, of which only one goes through the join. No pair of
classes that reaches the threshold is lost:

1. Grams are counted, in how many classes each occurs. Grams of one class are in no
   overlap, so a class with too few others drops out here; most documents do.
2. The rest are ordered, the rarest first (by the power of two of the count, then by
   hash). Two similar sets have their first common gram within a prefix of either,
   whose length follows from the threshold. Classes meet in the tiles of their
   prefix grams. There, sizes, places in the order and hashed bitmaps of parities
   (two bitmaps that differ in d bits come from sets that differ in d grams or
   more) bound the overlap from above. What passes is linked, by a few links for
   each tile: they need but hold together what may be similar.
3. What is linked, however indirectly, is compared in size-banded tiles: a band takes
   sizes up to twice its least, and a class is in its own band and a guest in the
   next, so each pair meets once. A band of more than ``BLOCK`` classes is cut into
   blocks, and pairs of blocks are dealt out to all tasks. Bitmaps bound again, and
   what passes is verified by exact intersection of the sorted arrays.

Packed exchanges have as many buckets as the measured bytes ask for, ``EACH`` in a
bucket. Grams that a chunk of text has in one of ``HOT_SHARE`` documents are
candidates for a list of at most ``HOT`` hot ones, which is broadcast; they are last
in the order and their postings are not sent, so no bucket fills up with one gram.

Result of ``links``: a row for each row of documents, with doc_id, class_id (the
least id of all that hang together by similar pairs) and links (how many other rows
are similar to it, copies included). Copies are counted, not paired. ``similar_pairs``
has the pairs of classes.

Defined cases: a text with fewer than ``GRAM`` words, but one at least, is one
gram; a null or empty text is similar to nothing, not even to another; a null id is
an id that no other is greater than, and class_id is null where nothing but null ids
hangs together; rows that share an id, repeated ones too, are documents of their
own. The stage keeps the rows whose id is the least of their group (null ids where
there is no other), and all rows of that id. Further columns go through untouched,
and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import bucket_count, bucket_ids, fresh, stored
from .lines import bloom, passing
from .substrings import split

GRAM = 3
THRESHOLD = 0.5
BLOCK = 2048
EACH = 8 << 20
PAIRS = 1 << 20
HOT = 1 << 16
HOT_SHARE = 64
ROUNDS = 16
BITS = 48
_LOW = np.uint64((1 << BITS) - 1)
_HOT_CLASS = np.uint64(63)


def gram_sets(w: K.Words, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct grams of all rows, and the rows' bounds in them."""
    at, h = w.grams(n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        one = w.hashes[w.ptr[short]].copy()
        for j in range(1, n - 1):
            more = w.counts[short] > j
            one[more] += w.hashes[w.ptr[short[more]] + j] * np.uint64(pow(K._Q, j, 1 << 64))
        at, h = np.r_[at, w.ptr[short]], np.r_[h, K.mix(K.mix(one) + np.uint64(1))]
    row, h = w.row[at], h >> np.uint64(64 - BITS)
    rows = len(w.ptr) - 1
    if len(short):
        by = np.argsort(row, kind="stable")
        row, h = row[by], h[by]
    # a row's number and its gram fit into one word, 65,536 rows at a time
    out, sizes = [], []
    for lo in range(0, rows, 1 << 16):
        a, b = np.searchsorted(row, (lo, lo + (1 << 16)))
        both = np.sort((row[a:b] - lo).astype(np.uint64) << np.uint64(BITS) | h[a:b])
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        sizes.append(np.bincount((both >> np.uint64(BITS)).astype(np.int64), minlength=min(1 << 16, rows - lo)))
        out.append(both & _LOW)
    return np.concatenate(out) if out else h, np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)


def fingerprints(sets: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    """Two hashes of every set, 128 bits together."""
    return [np.diff(np.r_[np.uint64(0), np.cumsum(K.mix(sets ^ np.uint64(s)))][ptr]).view(np.int64) for s in (3, 5)]


def required(size: np.ndarray, least: float) -> np.ndarray:
    """The overlap without which a set of this size is similar to none."""
    return np.ceil(least * size - 1e-9).astype(np.int64)


# Packing


def blobs(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value for each slice of a flat array."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((np.asarray(at, np.int64) * flat.itemsize).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())]).cast(pa.binary())


def unblob(column: pa.ChunkedArray, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    """The slices of a binary column behind one another, and their bounds; nulls are empty."""
    parts_ = [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]
    return np.concatenate(parts_) if parts_ else np.zeros(0, kind), np.r_[0, np.cumsum([len(x) for x in parts_], dtype=np.int64)]


# 1: counts


def sketches(slim: DataFrame) -> DataFrame:
    """doc_id, fp (of the text), size and two fingerprints of the set of every row; where hot is on, a frequent gram of a chunk (f) and how many of its sets have it (size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            sets, ptr = gram_sets(K.words(b.column("text")))
            f, g = fingerprints(sets, ptr)
            rows = [b.column("doc_id"), b.column("fp"), pa.array(np.diff(ptr)), pa.array(f), pa.array(g)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.zeros(len(f), bool))], names=names)
            # equal sets are one class; what only a repeated text has is not hot
            _, first = np.unique(f, return_index=True)
            keep = np.zeros(len(f), bool)
            keep[first] = True
            gram, n = np.unique(sets[np.repeat(keep, np.diff(ptr))], return_counts=True)
            some = np.flatnonzero(n >= max(8, len(first) // HOT_SHARE))
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(n[some]), pa.array(gram[some].view(np.int64)), none, pa.array(np.ones(len(some), bool))], names=names)

    names = ["doc_id", "fp", "size", "f", "g", "hot"]
    return slim.mapInArrow(run, ", ".join(f"{c} bigint" for c in names[:-1]) + ", hot boolean")


def hot_grams(sketch: DataFrame) -> np.ndarray:
    """The grams that at least one in 2 * HOT_SHARE classes seems to have, at most HOT of them: a bounded list, which changes no result."""
    n = sketch.filter("not hot").agg(F.count("*")).first()[0]
    top = sketch.filter("hot").groupBy("f").agg(F.sum("size").alias("n")).filter(F.col("n") >= max(1000, n // (2 * HOT_SHARE))).orderBy(F.desc("n"), "f").limit(HOT)
    return np.sort(np.array([r.f for r in top.select("f").collect()], np.int64).view(np.uint64))


def gathered(slim: DataFrame, chosen: DataFrame, hot: np.ndarray, size: int, least: float) -> DataFrame:
    """f, g, size, keys (the sorted grams that others have too, each below its count's power of two) and a number, cid, of the sets that may be similar to another; copies that several tasks have met come several times.

    Postings are a gram and a row of a piece of the texts; what comes back for a piece
    meets its rows in the piece's home. chosen (h) is a row of each class; a bounded
    filter of these keeps most copies at home.
    """
    held = slim.sparkSession.sparkContext.broadcast((hot, bloom(chosen)))
    grams, homes = (bucket_count(slim.sparkSession, size * share, EACH) for share in (8, 3))
    ids = bucket_ids(grams)
    home_ids = bucket_ids(homes)

    def rows(home, buckets, piece, *columns) -> pa.RecordBatch:
        full = [c if c is not None else pa.nulls(len(buckets), pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.nulls(len(buckets), pa.int32()) if home is None else pa.array(np.asarray(home, np.int32)), pa.array(np.asarray(buckets, np.int32)), pa.array(np.asarray(piece, np.int64)), *full], names=names)

    names = ["home", "bucket", "piece", "row", "low", "high", "f", "g", "size"]
    kind = "home int, bucket int, piece bigint, " + ", ".join(f"{c} binary" for c in names[3:])
    home_of = lambda piece: home_ids[(K.mix(np.asarray(piece, np.int64).view(np.uint64).copy()) % np.uint64(homes)).astype(np.int64)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, one_of_each), sent = held.value, set()
        piece = TaskContext.get().partitionId() << 32
        for b in (b.slice(lo, 1 << 16) for b in K.chunks(batches, target=4 * K.CHUNK) for lo in range(0, b.num_rows, 1 << 16)):
            b = b.take(pa.array(passing(one_of_each, b.column("h").to_numpy().view(np.uint64))))
            sets, ptr = gram_sets(K.words(b.column("text")))
            n = np.diff(ptr)
            f, g = fingerprints(sets, ptr)
            # a set that the task has sent needs not be sent again
            _, first = np.unique(f, return_index=True)
            keep = np.zeros(len(f), bool)
            keep[[k for k in first.tolist() if n[k] and int(f[k]) not in sent]] = True
            if len(sent) < 1 << 20:
                sent.update(f[keep].tolist())
            if not keep.any():
                continue
            piece += 1
            sets, n = sets[np.repeat(keep, n)], n[keep]
            one = lambda x: blobs(x, np.array([0, len(x)]))
            home, via = home_of([piece]), ids[[piece % grams]]
            yield rows(home, via, [piece], None, None, None, one(f[keep]), one(g[keep]), one(n))
            row = np.repeat(np.arange(len(n), dtype="<u2"), n)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, sets), len(hot) - 1)] == sets
                yield rows(home, via, [piece], one(row[is_hot]), one(_HOT_CLASS << np.uint64(BITS) | sets[is_hot]), None, None, None, None)
                sets, row = sets[~is_hot], row[~is_hot]
            by, at = split((sets % np.uint64(grams)).astype(np.uint16 if grams < 1 << 16 else np.int64), grams)
            some = np.flatnonzero(np.diff(at))
            at = np.r_[at[some], at[-1]]
            sets = sets[by]
            yield rows(None, ids[some], np.full(len(some), piece), blobs(row[by], at), blobs((sets & np.uint64(0xFFFFFFFF)).astype("<u4"), at), blobs((sets >> np.uint64(32)).astype("<u2"), at), None, None, None)

    def count(t: pa.Table) -> pa.Table:
        """The grams of a bucket that two rows or more have, for the homes of these rows; what is for homes already is passed on."""
        home = t.column("home").is_valid()
        through, t = t.filter(home), t.filter(pc.invert(home))
        row, at = unblob(t.column("row"), "<u2")
        sets = unblob(t.column("low"), "<u4")[0] | unblob(t.column("high"), "<u2")[0].astype(np.uint64) << np.uint64(32)
        by = np.argsort(sets)
        ordered = sets[by]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        many = np.diff(np.r_[first, len(ordered)])
        df = np.empty(len(sets), np.int64)
        df[by] = np.repeat(many, many)
        some = np.flatnonzero(df > 1)
        keys = np.floor(np.log2(df[some])).astype(np.uint64) << np.uint64(BITS) | sets[some]
        ends = np.searchsorted(some, at)
        full = np.flatnonzero(np.diff(ends))
        piece = t.column("piece").to_numpy()[full]
        ends = np.r_[ends[full], len(some)]
        home = home_of(piece)
        return pa.concat_tables([through, pa.Table.from_batches([rows(home, home, piece, blobs(row[some], ends), blobs(keys, ends), None, None, None, None)])])

    def gather(t: pa.Table) -> pa.Table:
        """The keys of the rows of a home's pieces, of those that have enough."""
        table = t.column("f").is_valid().to_numpy()
        own, sent = t.filter(pa.array(table)), t.filter(pa.array(~table))
        (f, at), g, size = unblob(own.column("f"), "<i8"), unblob(own.column("g"), "<i8")[0], unblob(own.column("size"), "<i8")[0]
        row, ends = unblob(sent.column("row"), "<u2")
        keys = unblob(sent.column("low"))[0]
        by = np.argsort(own.column("piece").to_numpy())
        place = by[np.searchsorted(own.column("piece").to_numpy()[by], sent.column("piece").to_numpy())] if sent.num_rows else np.zeros(0, np.int64)
        who = np.repeat(at[place], np.diff(ends)) + row
        by = np.lexsort((keys, who))
        have = np.bincount(who, minlength=len(f))
        ok = np.flatnonzero((have >= required(size, least)) & (have > 0))
        at = np.cumsum(have) - have
        which, j = K.spread(have[ok])
        return pa.table({"f": f[ok], "g": g[ok], "size": size[ok], "keys": blobs(keys[by][at[ok][which] + j], np.r_[0, np.cumsum(have[ok])])})

    posted = slim.select("h", "text").mapInArrow(send, kind).repartition(grams, "bucket").groupBy("bucket").applyInArrow(count, kind).drop("bucket", "high")
    rows_ = posted.repartition(homes, "home").groupBy("home").applyInArrow(gather, "f bigint, g bigint, size bigint, keys binary")
    return rows_.withColumn("cid", F.monotonically_increasing_id())


# Bitmaps


def widths(size: np.ndarray) -> np.ndarray:
    """Words of 64 bits of the bitmaps of sets of these sizes: a power of two, two bits a gram or more."""
    return 1 << np.ceil(np.log2(np.maximum(1, size / 32))).astype(np.int64)


def bitmaps(sets: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of parities, one after the other, and their bounds."""
    size = np.diff(ptr)
    width = widths(size)
    at = np.r_[0, np.cumsum(width)]
    h = K.mix(sets ^ np.uint64(K._GOLD))
    row = np.repeat(np.arange(len(size)), size)
    bit = at[row] * 64 + (h & (width[row] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=int(at[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), at


def fold(flat: np.ndarray, at: np.ndarray, some: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps of some sets, folded to so many words; folding keeps parities right."""
    have = (at[1:] - at[:-1])[some]
    out = np.zeros((len(some), width), np.uint64)
    for h in np.unique(have):
        mine = np.flatnonzero(have == h)
        wide = flat[at[some[mine], None] + np.arange(h)]
        out[mine] = np.bitwise_xor.reduce(wide.reshape(len(mine), h // width, width), axis=1)
    return out


def differing(flat: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of pairs differ, the wider folded to the narrower."""
    width = at[1:] - at[:-1]
    narrow = np.minimum(width[a], width[b])
    out = np.zeros(len(a), np.int64)
    for w in np.unique(narrow):
        m = np.flatnonzero(narrow == w)
        here, back = np.unique(np.r_[a[m], b[m]], return_inverse=True)
        maps = fold(flat, at, here, int(w))
        x, y = back[: len(m)], back[len(m) :]
        for c in range(int(w)):
            out[m] += np.bitwise_count(maps[x, c] ^ maps[y, c])
    return out


def joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number that each of n hangs together with, by the edges u, v."""
    label = np.arange(n)
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


# 2: what may be similar


class Members:
    """The members of tiles: doc (place in the other arrays) and place (before it come so many keys, those of one class among them)."""

    def __init__(self, tile, doc, place, size, have, flat, at, least):
        by = np.lexsort((doc, size[doc], tile))
        self.tile, self.doc, self.place = tile[by], doc[by], place[by]
        self.size, self.have, self.flat, self.at, self.least = size, have, flat, at, least

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs of members may reach the threshold and have nothing in common before this tile."""
        a, b = self.doc[i], self.doc[j]
        both = self.size[a] + self.size[b]
        need = np.ceil(self.least / (1 + self.least) * both - 1e-9).astype(np.int64)
        ahead = np.minimum(self.have[a] - self.place[i], self.have[b] - self.place[j])
        ok = (ahead >= need) & (np.minimum(self.size[a], self.size[b]) >= self.least * np.maximum(self.size[a], self.size[b]) - 1e-9)
        some = np.flatnonzero(ok)
        a, b = a[some], b[some]
        ok[some] = (self.have[a] + self.have[b] - differing(self.flat, self.at, a, b)) // 2 >= need[some]
        return ok

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of docs that hold together whatever may be similar."""
        n = len(self.tile)
        start = np.flatnonzero(np.r_[True, self.tile[1:] != self.tile[:-1]]) if n else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
        cluster, leads = np.full(n, n), np.zeros(n, bool)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        open_ = np.arange(n)
        for r in range(ROUNDS):
            # in every tile, the first member that is left is compared with the others
            lead = np.flatnonzero(np.r_[True, group[open_][1:] != group[open_][:-1]]) if len(open_) else open_
            if not len(lead):
                break
            of = np.repeat(lead, np.diff(np.r_[lead, len(open_)]))
            others = np.flatnonzero(of != np.arange(len(open_)))
            hit = []
            for lo in range(0, len(others), PAIRS):
                x = others[lo : lo + PAIRS]
                hit.append(x[self.may(open_[of[x]], open_[x])])
            hit = np.concatenate(hit) if hit else others
            cluster[open_[lead]] = r
            leads[open_[lead]] = True
            cluster[open_[hit]] = r
            us.append(self.doc[open_[of[hit]]])
            vs.append(self.doc[open_[hit]])
            left = np.ones(len(open_), bool)
            left[lead] = left[hit] = False
            open_ = open_[left]
        cluster[open_] = ROUNDS + np.arange(len(open_))
        # then whoever joined a leader, with those of later clusters that it does not hang together with by now
        label = joined(len(self.size), np.concatenate(us), np.concatenate(vs))
        by = np.lexsort((cluster, group))
        ends = np.r_[start[1:], n][group]
        order_cluster, order_group = cluster[by], group[by]
        last = np.searchsorted(order_group * (ROUNDS + n + 1) + order_cluster, order_group * (ROUNDS + n + 1) + order_cluster, "right")
        count = np.where(leads[by], 0, ends - last)
        total = np.cumsum(count)
        a0 = 0
        while a0 < n:
            a1 = max(a0 + 1, int(np.searchsorted(total, (total[a0 - 1] if a0 else 0) + PAIRS, "right")))
            k, j = K.spread(count[a0:a1])
            x, y = by[k + a0], by[np.minimum(last[a0:a1][k] + j, n - 1)]
            apart = label[self.doc[x]] != label[self.doc[y]]
            x, y = x[apart], y[apart]
            ok = self.may(x, y)
            us.append(self.doc[x[ok]])
            vs.append(self.doc[y[ok]])
            if ok.any():
                label = label[joined(len(self.size), label[self.doc[x[ok]]], label[self.doc[y[ok]]])[label]]
            a0 = a1
        return np.concatenate(us), np.concatenate(vs)


def held_together(candidates: DataFrame, least: float) -> DataFrame:
    """u, v: numbers of sets that hold together whatever may be similar."""
    spark = candidates.sparkSession
    buckets = bucket_count(spark, (candidates.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) * 2, 4 * EACH)
    ids = bucket_ids(buckets)
    names = ["bucket", "node", "size", "have", "bits", "count", "keys", "place"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, "keys", 4 * K.CHUNK):
            keys, ptr = unblob(b.column("keys"))
            have, size = np.diff(ptr), b.column("size").to_numpy()
            node = b.column("cid").to_numpy()
            flat, at = bitmaps(keys, ptr)
            row, place = K.spread(np.maximum(0, have - required(size, least) + 1))
            key = keys[ptr[row] + place]
            bucket = (K.mix(key.copy()) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((row, bucket))
            bucket, row, place, key = bucket[by], row[by], place[by], key[by]
            cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]) if len(row) else row
            runs, count = row[cut], np.diff(np.r_[cut, len(row)])
            some, first = np.unique(bucket[cut], return_index=True)
            own, ends = np.r_[first, len(cut)], np.r_[cut, len(row)]
            wide = (at[1:] - at[:-1])[runs]
            which, j = K.spread(wide)
            bits = flat[at[runs][which] + j]
            wide_at = np.r_[0, np.cumsum(wide)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), blobs(node[runs], own), blobs(size[runs], own), blobs(have[runs], own), blobs(bits, wide_at[own]), blobs(count, own), blobs(key, ends[own]), blobs(place.astype("<u4"), ends[own])], names=names
            )

    def link(t: pa.Table) -> pa.Table:
        get = lambda c, kind="<i8": unblob(t.column(c), kind)[0]
        node, size, have, count, keys, place = get("node"), get("size"), get("have"), get("count"), get("keys", "<u8"), get("place", "<u4").astype(np.int64)
        at = np.r_[0, np.cumsum(widths(have))]
        doc = np.repeat(np.arange(len(node)), count)
        by = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[by][1:] != keys[by][:-1]]
        tile = np.empty(len(keys), np.int64)
        tile[by] = np.cumsum(new) - 1
        some = np.bincount(tile)[tile] > 1
        u, v = Members(tile[some], doc[some], place[some], size, have, get("bits", "<u8"), at, least).edges()
        low = joined(len(node), u, v)
        some = np.flatnonzero(low != np.arange(len(node)))
        return pa.table({"u": node[some], "v": node[low[some]]})

    kind = "bucket int, node binary, size binary, have binary, bits binary, count binary, keys binary, place binary"
    return candidates.select("cid", "size", "keys").mapInArrow(send, kind).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(link, "u bigint, v bigint")


# 3: what is similar


def verified(t: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket that reach the threshold, their overlap and the size of their union."""
    keys, ptr = unblob(t.column("keys"))
    get = lambda c: t.column(c).to_numpy(zero_copy_only=False)
    size, have, own, side = get("size"), np.diff(ptr), get("own").astype(bool), get("side")
    tile = np.zeros(len(size), np.int64)
    for c in ("comp", "band", "i", "j"):
        tile = np.unique(np.stack([tile, get(c)], axis=1), axis=0, return_inverse=True)[1].ravel()
    halves = get("i") != get("j")
    flat, at = bitmaps(keys, ptr)
    by = np.lexsort((size, tile))
    span = int(size.max()) + 2 if len(size) else 1
    place = tile[by] * span + size[by]
    reach = np.searchsorted(place, tile[by] * span + np.minimum(np.floor(size[by] / least + 1e-9).astype(np.int64), span - 1), "right") - np.arange(len(by)) - 1
    ends = np.cumsum(reach)
    a0 = 0
    while a0 < len(by):
        a1 = max(a0 + 1, int(np.searchsorted(ends, (ends[a0 - 1] if a0 else 0) + PAIRS, "right")))
        k, j = K.spread(reach[a0:a1])
        a, b = by[k + a0], by[k + a0 + j + 1]
        a0 = a1
        ok = (own[a] | own[b]) & (~halves[a] | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        need = np.ceil(least / (1 + least) * (size[a] + size[b]) - 1e-9)
        ok = (have[a] + have[b] - differing(flat, at, a, b)) // 2 >= need
        a, b, need = a[ok], b[ok], need[ok]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
        for lo, hi in zip(first, np.r_[first[1:], len(a)]):
            mine = keys[ptr[a[lo]] : ptr[a[lo] + 1]]
            for s in range(lo, hi, 4096):
                others = b[s : min(hi, s + 4096)]
                which, k = K.spread(have[others])
                theirs = keys[ptr[others][which] + k]
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.bincount(which[hit], minlength=len(others))
                either = size[a[lo]] + size[others] - both
                ok = np.flatnonzero(both >= least * either - 1e-9)
                if len(ok):
                    yield np.full(len(ok), a[lo]), others[ok], both[ok], either[ok]


def band_tiles(candidates: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """The classes of every size-banded tile, or pair of blocks of one: comp, band, i, j, own, side, node, size, copies, keys, bucket. What is dealt out is numbers; keys are joined at the end."""
    spark = candidates.sparkSession
    one = candidates.groupBy("f", "g", "size").agg(F.min("cid").alias("cid"), F.max(F.octet_length("keys")).alias("bytes"))
    member = one.join(classes, ["f", "g", "size"]).join(groups.select(F.col("doc_id").alias("cid"), F.col("group").alias("comp")), "cid")
    member = stored(member.select("cid", "node", "size", "copies", "bytes", "comp", F.floor(F.log2("size")).cast("bigint").alias("band")), "members")
    # a class is a guest in the next band of its component, if that has any
    bands = member.select("comp", "band").distinct()
    guests = member.withColumn("band", F.col("band") + 1).join(bands, ["comp", "band"]).withColumn("own", F.lit(False))
    cells = stored(member.withColumn("own", F.lit(True)).unionByName(guests), "bands")
    count = cells.groupBy("comp", "band").agg(F.count("*").alias("members"), F.sum("bytes").alias("total"))
    count = count.filter("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    buckets = bucket_count(spark, (count.agg(F.sum(F.col("total") * F.col("blocks"))).first()[0] or 0) * 2, EACH)
    mine = F.pmod(F.xxhash64("cid", "own"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("side")).alias("i"), F.greatest(x, F.col("side")).alias("j")))
    dealt = cells.join(count.select("comp", "band", "blocks"), ["comp", "band"]).withColumn("side", mine).withColumn("x", F.explode(pairs))
    dealt = dealt.select("cid", "comp", "band", "x.i", "x.j", "own", "side", "node", "size", "copies", F.pmod(F.xxhash64("comp", "band", "x.i", "x.j"), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.join(candidates.select("cid", "keys"), "cid").drop("cid").repartition(buckets, "bucket")


class Join:
    """The join's tables: rows (doc_id, fp, size, f, g), classes (node, f, g, size, copies, first) and tiles."""

    def __init__(self, docs: DataFrame, id: str, text: str, least: float):
        slim = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("fp"), F.col(text).alias("text"))
        row = F.xxhash64("doc_id", "fp")
        seen = stored(sketches(slim), "sketches")
        self.least = least
        self.rows = seen.filter("not hot").drop("hot")
        found = self.rows.filter("size > 0").groupBy("f", "g", "size").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min(row).alias("h"))
        self.classes = stored(found.withColumn("node", F.monotonically_increasing_id()), "classes")
        grams = self.rows.agg(F.sum("size")).first()[0] or 0
        candidates = stored(gathered(slim.withColumn("h", row), self.classes, hot_grams(seen), grams, least), "candidates")
        self.tiles = band_tiles(candidates, self.classes, all_of(components(held_together(candidates, least))))

    def pairs(self) -> DataFrame:
        least = self.least

        def run(t: pa.Table) -> pa.Table:
            node = t.column("node").to_numpy()
            got = [np.concatenate(x) for x in zip(*verified(t, least))] or [np.zeros(0, np.int64)] * 4
            a, b, both, either = (x.astype(np.int64) for x in got)
            return pa.table({"u": node[a], "v": node[b], "overlap": both, "either": either})

        return self.tiles.groupBy("bucket").applyInArrow(run, "u bigint, v bigint, overlap bigint, either bigint")

    def links(self) -> DataFrame:
        """node, links, low: the rows that are similar to a class, as far as a task sees, and a node that hangs together with it."""
        least = self.least

        def run(t: pa.Table) -> pa.Table:
            node, back = np.unique(t.column("node").to_numpy(), return_inverse=True)
            copies = t.column("copies").to_numpy()
            n = np.zeros(len(node), np.int64)
            label = np.arange(len(node))
            for a, b, *_ in verified(t, least):
                n += np.bincount(back[a], copies[b], len(node)).astype(np.int64) + np.bincount(back[b], copies[a], len(node)).astype(np.int64)
                label = label[joined(len(node), label[back[a]], label[back[b]])[label]]
            some = np.flatnonzero(n)
            return pa.table({"node": node[some], "links": n[some], "low": node[label[some]]})

        return self.tiles.groupBy("bucket").applyInArrow(run, "node bigint, links bigint, low bigint")


def similar_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """doc_a <= doc_b, overlap and jaccard of the pairs of different classes that reach the threshold, each named by its least id."""
    j = Join(docs, id, text, least)
    a, b = (j.classes.select(F.col("node").alias(n), F.col("first").alias(f"first_{n}")) for n in "uv")
    rows = j.pairs().join(a, "u").join(b, "v")
    return rows.select(F.least("first_u", "first_v").alias("doc_a"), F.greatest("first_u", "first_v").alias("doc_b"), "overlap", F.round(F.col("overlap") / F.col("either"), 6).alias("jaccard"))


def linked(docs: DataFrame, id: str, text: str, least: float) -> DataFrame:
    """doc_id, fp, class_id and links of every row."""
    j = Join(docs, id, text, least)
    seen = stored(j.links(), "links")
    group = components(seen.select(F.col("node").alias("doc_a"), F.col("low").alias("doc_b")).filter("doc_a <> doc_b"))
    root = j.classes.join(group.select(F.col("doc_id").alias("node"), F.col("group").alias("up")), "node", "left").withColumn("root", F.coalesce("up", "node"))
    least_id = root.groupBy("root").agg(F.min("first").alias("class_id"))
    own = root.join(seen.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(least_id, "root")
    own = own.select("f", "g", "size", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return j.rows.join(own, ["f", "g", "size"], "left").select("doc_id", "fp", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def links(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and links of every row."""
    return linked(docs, id, text, least).drop("fp")


def components(pairs: DataFrame) -> DataFrame:
    """doc_id and group (the least id of its component) of every id but the least ones, by large-star and small-star rounds over written tables; pairs has two columns of ids."""
    a, b = pairs.columns[:2]
    edges = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        # done if all edges lead to ids that have none themselves, one edge from each
        again = edges.select("u").unionAll(edges.select(F.col("v").alias("u")).distinct()).groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
        more = again.join(edges, "u", "left_semi").limit(1).count()
        if not more:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group"))
        # least neighbours are aggregates, joined back: an id with many neighbours is not the work of one task
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")


def all_of(groups: DataFrame) -> DataFrame:
    """With the least ones, too."""
    return groups.unionAll(groups.select(F.col("group").alias("doc_id"), "group").distinct())


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of docs but those whose group has a lesser id, with the columns of docs."""
    key, fp = fresh(docs, "drop_id", "drop_fp")
    losers = linked(docs, id, text, least).filter("not (doc_id <=> class_id)").select(F.col("doc_id").alias(key), F.col("fp").alias(fp)).distinct()
    return docs.join(losers, F.col(id).cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text)) == F.col(fp)), "left_anti")


def links_sql() -> str:
    return f"""
with recursive d as materialized (select row_number() over () r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{K.WORD}') w from documents),
s as materialized (select r, list_distinct(case when len(w) < {GRAM} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {GRAM - 2}), lambda i: array_to_string(w[i:i + {GRAM - 1}], ' ')) end) g from d where len(w) > 0),
e as materialized (select r, len(g) n, unnest(g) g from s),
p as materialized (select a.r a, b.r b from e a join e b on a.g = b.g and a.r <> b.r group by a.r, b.r having count(*) >= {THRESHOLD} * (any_value(a.n) + any_value(b.n) - count(*))),
c as (select r, r o from d union select c.r, p.b from c join p on c.o = p.a)
select d.doc_id, least_id class_id, coalesce(n, 0)::bigint links from d join (select c.r, min(x.doc_id) least_id from c join d x on x.r = c.o group by c.r) using (r) left join (select a r, count(*) n from p group by a) using (r)"""
