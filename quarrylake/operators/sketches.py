"""MinHash and SimHash sketches, and the band joins over them.

A MinHash signature is taken by double hashing, (h1 + i h2) mod P, as aggregates
of one pass that combine before the shuffle; only the signatures leave a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.store import shared_dir, stored

PRIME = 4294967291
HASHES = 64


def signatures(domains: DataFrame, hashes: int = HASHES, by: tuple[str, ...] = ("t", "c"), value: str = "v") -> DataFrame:
    """sig: array of so many minima; card: how many values were seen."""
    a, b = X.hash32(F.col(value)), X.hash32(F.col(value), 1)
    hashed = domains.select(*by, a.alias("_a"), b.alias("_b"))
    least = [F.min((F.col("_a") + F.lit(i) * F.col("_b")) % F.lit(PRIME)) for i in range(hashes)]
    return hashed.groupBy(*by).agg(F.array(*least).alias("sig"), F.count("*").alias("card"))


def estimated_jaccard(a, b):
    """The share of positions at which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def optimal_bands(threshold: float, hashes: int, cosine: bool = False) -> tuple[int, int]:
    """(k, l): hashes in a band and bands, with the least sum of false positives and negatives around the threshold."""
    step = 0.01

    def area(lo: float, hi: float, f) -> float:
        n = max(0, math.ceil((hi - lo) / step - 1e-9))
        return sum(f(lo + (i + 0.5) * step) for i in range(n)) * step

    def near(x: float) -> float:
        return 1 - math.acos(max(-1.0, min(1.0, x))) / math.pi if cosine else x

    best, out = math.inf, (1, 1)
    for l in range(1, hashes + 1):
        for k in range(1, hashes + 1):
            if k * l > hashes:
                break
            found = lambda x: 1 - (1 - near(x) ** k) ** l
            error = area(-1.0 if cosine else 0.0, threshold, found) + area(threshold, 1.0, lambda x: 1 - found(x))
            if error < best:
                best, out = error, (k, l)
    return out


def recalling_bands(threshold: float, hashes: int, recall: float = 0.95) -> tuple[int, int]:
    """(k, l) with the longest bands that find a pair at the threshold with this probability, and as many as fit: no more pairs are found than that takes."""
    for k in range(hashes, 0, -1):
        if 1 - (1 - threshold**k) ** (hashes // k) >= recall:
            return k, hashes // k
    return 1, hashes


def bands(sketch: DataFrame, k: int, l: int) -> DataFrame:
    """A row for each band, with its hashes."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(l - 1)), lambda i: F.slice("sig", i * k + 1, k))
    return sketch.select("t", "c", F.posexplode(cut).alias("band", "hashes"))


def candidates(sketch: DataFrame, k: int, l: int) -> DataFrame:
    """Pairs of domains of different tables that agree in a whole band: an equi-join, no cross join."""
    b = bands(sketch, k, l)
    q, c = (b.select(F.col("t").alias(f"{s}t"), F.col("c").alias(f"{s}c"), "band", "hashes") for s in ("q", "c"))
    return q.join(c, ["band", "hashes"]).filter("qt <> ct").select("qt", "qc", "ct", "cc").distinct()


def forest_depths(sketch: DataFrame, k: int, l: int) -> DataFrame:
    """The longest prefix of a band in which two domains agree: what the forest would find them at."""
    b = bands(sketch, k, l).withColumn("head", F.element_at("hashes", 1))
    q, c = (b.select(F.col("t").alias(f"{s}t"), F.col("c").alias(f"{s}c"), "band", "head", F.col("hashes").alias(f"{s}h")) for s in ("q", "c"))
    depth = F.aggregate(F.zip_with("qh", "ch", lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return q.join(c, ["band", "head"]).filter("qt <> ct").groupBy("qt", "qc", "ct", "cc").agg(F.max(depth).cast("bigint").alias("depth"))


def planes(bits: int, dims: int) -> np.ndarray:
    """Hyperplanes of +1 and -1, by the last bit of md5's first 32."""
    import hashlib

    return np.array([[1.0 if int(hashlib.md5(f"{b}|{i}".encode()).hexdigest()[:8], 16) % 2 else -1.0 for i in range(dims)] for b in range(bits)])


def simhash(vectors: DataFrame, id: str, vector: str, bits: int = 16, dims: int = 64) -> DataFrame:
    """The side of each hyperplane, as a string of bits: one matrix product for each Arrow batch."""
    p = planes(bits, dims).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            side = (x @ p >= 0).astype(np.uint8) + 48
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bytes(r).decode() for r in side], pa.string())], names=["id", "bucket"])

    slim = vectors.filter(F.size(vector) == dims).select(F.col(id).cast("bigint").alias("id"), vector)
    return slim.mapInArrow(run, "id bigint, bucket string").withColumnRenamed("id", id)


def simhash_bands(vectors: DataFrame, id: str, vector: str, k: int, l: int, dims: int = 64) -> DataFrame:
    """l bands of k bits of a vector's SimHash, as numbers: id, heads (array), many (whether the id has other bits elsewhere); a row for each id and its different bits."""
    if not 0 < k < 63:
        raise ValueError("a band has 1 to 62 bits")
    own = simhash(vectors, id, vector, k * l, dims).groupBy(id).agg(F.collect_set("bucket").alias("_b"))
    heads = F.array(*(F.conv(F.substring("_c", i * k + 1, k), 2, 10).cast("bigint") for i in range(l)))
    return own.select(id, (F.size("_b") > 1).alias("many"), F.explode("_b").alias("_c")).select(id, heads.alias("heads"), "many")


def band_pairs(codes: DataFrame, id: str, k: int, l: int, least: int) -> DataFrame:
    """Pairs that agree in the first least bits of a band: id, other, x (the least difference of all bands, as a number: depth d has x < 2 ** (k - d)).

    A pair is given by the first band that it agrees in, so what is shuffled are the bands
    and not the pairs, of which there may be n^2. Only ids with several vectors can
    give a pair twice.
    """
    codes = stored(codes, "bands")
    low = k - least
    spark = codes.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def side(x: DataFrame, name: str, heads: str) -> DataFrame:
        return x.select(F.col(id).alias(name), F.col("heads").alias(heads), F.posexplode("heads").alias("band", "_s")).withColumn("_s", F.shiftright("_s", low))

    differ = [F.col("_p")[i].bitwiseXOR(F.col("_q")[i]) for i in range(l)]
    first = F.lit(True)
    for j in range(1, l):
        first = F.when(F.col("band") == j, F.least(*differ[:j], F.lit((1 << k) - 1)) >= F.lit(1 << low)).otherwise(first)

    def met(a: DataFrame, b: DataFrame, spread: int = 0) -> DataFrame:
        q = side(a, id, "_p")
        # bands are few bytes and their pairs many: without a number the join would be one task
        both = (q.repartition(spread, "band", "_s") if spread else q).join(side(b, "other", "_q"), ["band", "_s"])
        return both.filter((F.col(id) != F.col("other")) & first).select(id, "other", F.least(*differ, F.lit((1 << k) - 1)).alias("x"))

    one, several = codes.filter(~F.col("many")), codes.filter("many")
    again = met(several, codes).unionAll(met(one, several)).groupBy(id, "other").agg(F.min("x").alias("x"))
    return met(one, one, tasks).unionAll(again)


def cosine_candidates(vectors: DataFrame, id: str, vector: str, k: int = 20, l: int = 5, dims: int = 64) -> DataFrame:
    """Pairs of vectors that agree in a whole band: an equi-join."""
    return band_pairs(simhash_bands(vectors, id, vector, k, l, dims), id, k, l, k).select(id, "other")


def cosine_forest(vectors: DataFrame, id: str, vector: str, k: int = 16, l: int = 8, least: int = 4, dims: int = 64) -> DataFrame:
    """The longest prefix of a band in which two vectors agree, of those that agree in least bits: id, other, depth. The join is on these bits; pairs of lesser depth are left to the exact search."""
    pairs = band_pairs(simhash_bands(vectors, id, vector, k, l, dims), id, k, l, least)
    depth = F.lit(least)
    for n in range(least + 1, k + 1):
        depth = F.when(F.col("x") < F.lit(1 << (k - n)), n).otherwise(depth)
    return pairs.select(id, "other", depth.cast("bigint").alias("depth"))


def topk_cosine(vectors: DataFrame, id: str, vector: str, k: int = 5, dims: int = 64, block: int = 2048) -> DataFrame:
    """The k nearest others of every vector, exactly.

    Unit vectors are packed in blocks and stored in the shared folder once. Each task
    holds up to 16 blocks of queries and reads all blocks past them, one at a time; a
    pair of blocks is one matrix product, and a query keeps its k best. So the work is
    n^2, but what is shuffled is the vectors and k rows for each.
    """
    spark = vectors.sparkSession
    slim = vectors.filter(F.size(vector) == dims).select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    n = max(1, -(-slim.count() // block))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]).astype("<f8").reshape(-1, dims)
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        good = ~np.isnan(x).any(axis=1)  # the others have no cosine with any
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "ids": [t.column("id").to_numpy()[good].astype("<i8").tobytes()], "m": [x[good].tobytes()]})

    packed = slim.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("b").applyInArrow(pack, "b int, ids binary, m binary")
    path = shared_dir(spark, "vectors")
    packed.write.option("parquet.block.size", 1 << 24).parquet(path)

    def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["m"], "<f8").reshape(-1, dims)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(path)
        for f in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.path.endswith(".parquet")):
            with fs.open_input_file(f) as src:
                for b in pq.ParquetFile(src).iter_batches(1, columns=["ids", "m"]):
                    yield from map(unpacked, b.to_pylist())

    def better(best: tuple, qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray) -> tuple:
        """best: row, id and score of what is kept, and the k-th score of each row."""
        row, other, score, least = best
        s = q @ c.T
        s[qi[:, None] == ci] = -np.inf
        if len(ci) >= k:
            least = np.maximum(least, np.round(np.partition(s, -k, axis=1)[:, -k], 6)) if not np.isfinite(least).all() else least
        r, j = np.nonzero(s >= (least - 1e-6)[:, None])
        v = np.round(s[r, j], 6)
        row, other, score = np.r_[row, r], np.r_[other, ci[j]], np.r_[score, v]
        ok = np.isfinite(score)
        row, other, score = row[ok], other[ok], score[ok]
        by = np.lexsort((other, -score, row))
        row, other, score = row[by], other[by], score[by]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        least = least.copy()
        least[row[at == k - 1]] = score[at == k - 1]
        return row[at < k], other[at < k], score[at < k], least

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(held: list) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0, int), np.zeros(0, "<i8"), np.zeros(0), np.full(len(qi), -np.inf)) for qi, _ in held]
            for ci, c in blocks():
                best = [better(b, qi, q, ci, c) for b, (qi, q) in zip(best, held)]
            for (qi, _), (row, other, score, _) in zip(held, best):
                yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(other), pa.array(score)], names=["id", "other", "score"])

        held = []
        for b in batches:
            for r in b.to_pylist():
                held.append(unpacked(r))
                if len(held) == 16:
                    yield from search(held)
                    held = []
        if held:
            yield from search(held)

    tasks = min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // 16)))
    best = spark.read.parquet(path).select("ids", "m").repartition(tasks).mapInArrow(nearest, "id bigint, other bigint, score double")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return best.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).withColumnRenamed("id", id)
