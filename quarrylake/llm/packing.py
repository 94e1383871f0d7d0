"""Packing of documents into batches of little padding.

Dynamic programming over the histogram of all documents' lengths chooses the
``buckets`` upper bounds that minimise the tokens of padding; the cost satisfies
the quadrangle inequality, so divide and conquer finds the optimum in
O(buckets x lengths x log lengths). Inside a bucket, documents in the order of
their ids fill batches of ``budget`` tokens, padding included.

A length is the number of words, or of a tokenizer's tokens where the path of a
``tokenizers`` file is given.

Defined cases: a null or empty text has 0 tokens and is packed like any other;
rows with a null id come last in their bucket; repeated rows are packed as often
as they come; a document longer than the budget is a batch by itself; of equally
good bounds the least are taken; an empty table gives an empty result. Only the
id and the text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .common import stored

BUCKETS = 8
BUDGET = 16384
RUN = 1 << 14


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most so many buckets with the least padding; lengths ascend."""
    m = len(lengths)
    if not m:
        return []
    lengths, cn, ct = lengths.astype(np.int64), np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    best = lengths * cn[1:] - ct[1:]  # of the first j + 1 lengths in one bucket
    back = []
    for k in range(2, min(buckets, m) + 1):
        now, arg = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
        todo = [(k - 1, m - 1, k - 2, m - 2)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)  # the last length of the buckets before
            cost = best[i] + lengths[j] * (cn[j + 1] - cn[i + 1]) - (ct[j + 1] - ct[i + 1])
            at = int(np.argmin(cost))
            now[j], arg[j] = cost[at], i[at]
            todo += [(lo, j - 1, a, i[at]), (j + 1, hi, i[at], b)]
        best = now
        back.append(arg)
    j, out = m - 1, [int(lengths[m - 1])]
    for arg in reversed(back):
        j = int(arg[j])
        out.append(int(lengths[j]))
    return out[::-1]


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer)
            tok.encode_special_tokens = True
        for b in K.chunks(batches):
            if tokenizer:
                n = [len(e.ids) for e in tok.encode_batch([x or "" for x in b.column("text").to_pylist()], add_special_tokens=False)]
            else:
                n = K.words(b.column("text"), lower=False).counts
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The bounds for n_tokens. What reaches the driver is a number pair for each different length; n different ones take n * n / 2 tokens, so it grows with the root of the corpus at most."""
    rows = lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    return bounds(rows.column("n_tokens").to_numpy(), rows.column("n").to_numpy(), buckets)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket_len, batch and padding of every row; a batch is known by bucket_len and batch."""
    lengths = stored(token_counts(docs, id, text, tokenizer), "lengths")
    upper = bucket_bounds(lengths, buckets)
    size = F.lit(None).cast("bigint")
    for b in reversed(upper):
        size = F.when(F.col("n_tokens") <= b, F.lit(b).cast("bigint")).otherwise(size)
    # rows are numbered in runs of ids, so that no task holds a whole bucket
    placed = lengths.select("doc_id", "n_tokens", size.alias("bucket_len"), F.coalesce(F.floor(F.col("doc_id") / RUN), F.lit((1 << 63) - 1)).alias("run"))
    before = placed.groupBy("bucket_len", "run").agg(F.count("*").alias("n"))
    before = before.select("bucket_len", "run", (F.sum("n").over(Window.partitionBy("bucket_len").orderBy("run")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket_len", "run").orderBy(F.col("doc_id").asc_nulls_last(), "n_tokens"))
    cap = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len"))))
    return placed.withColumn("own", own).join(before, ["bucket_len", "run"]).select("doc_id", "n_tokens", "bucket_len", F.floor((F.col("before") + F.col("own") - 1) / cap).alias("batch"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def pack_sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same over the view documents, in DuckDB's SQL."""
    steps = "".join(
        f""", d{k} as materialized (select j, c, list_append(b, len) b from (select h.j, h.len, p.b, p.c + h.len * (h.cn - q.cn) - (h.ct - q.ct) c,
        row_number() over (partition by h.j order by p.c + h.len * (h.cn - q.cn) - (h.ct - q.ct), p.j) r
        from h join d{k - 1} p on p.j < h.j join h q on q.j = p.j) where r = 1)"""
        for k in range(2, buckets + 1)
    )
    every = " union all ".join(f"select {k} k, * from d{k}" for k in range(1, buckets + 1))
    return f"""
with l as materialized (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{K.WORD}'))::bigint n_tokens from documents),
h as materialized (select row_number() over (order by n_tokens) j, n_tokens len, sum(n) over (order by n_tokens) cn, sum(n * n_tokens) over (order by n_tokens) ct
      from (select n_tokens, count(*) n from l group by 1)),
d1 as (select j, len * cn - ct c, [len] b from h){steps},
u as (select unnest(b) bucket_len from ({every}) where j = (select max(j) from h) and k = least({buckets}, (select max(j) from h))),
p as (select doc_id, n_tokens, (select min(bucket_len) from u where bucket_len >= n_tokens) bucket_len from l)
select doc_id, n_tokens, bucket_len, ((row_number() over (partition by bucket_len order by doc_id nulls last, n_tokens) - 1)
       // greatest(1, {budget} // greatest(1, bucket_len)))::bigint batch, bucket_len - n_tokens padding
from p"""
