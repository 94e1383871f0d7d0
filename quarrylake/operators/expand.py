"""What a union adds, and how benchmarks are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import hash32


def union_append(query: DataFrame, candidate: DataFrame, matches: dict[str, str]) -> DataFrame:
    """The candidate's rows below the query's, its columns mapped to the query's (matches: query's to candidate's); what has no match is null."""
    mapped = candidate.select(*(F.col(matches[c]).alias(c) if c in matches else F.lit(None).cast(query.schema[c].dataType).alias(c) for c in query.columns))
    return query.unionAll(mapped)


def row_expansion(query: DataFrame, candidate: DataFrame, matches: dict[str, str]) -> DataFrame:
    """Different rows of the query before and after the union; nulls are equal, and empty tables have no rows."""
    (own,) = fresh(query, "_own")
    both = query.withColumn(own, F.lit(1)).unionAll(union_append(query.limit(0), candidate, matches).withColumn(own, F.lit(0)))
    rows = both.groupBy(*(F.col(f"`{c}`") for c in query.columns)).agg(F.max(own).alias(own))
    return rows.agg(F.coalesce(F.sum(own), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after"))


def column_expansion(domains: DataFrame, pairs: DataFrame) -> DataFrame:
    """Values that the candidate column adds to the query column, of the aligned pairs."""
    c = pairs.join(domains, (F.col("ct") == F.col("t")) & (F.col("cc") == F.col("c"))).select("qt", "qc", "ct", "cc", "v")
    q = domains.select(F.col("t").alias("qt"), F.col("c").alias("qc"), "v")
    new = c.join(q, ["qt", "qc", "v"], "left_anti").groupBy("qt", "qc", "ct", "cc").agg(F.count("*").alias("added"))
    before = q.groupBy("qt", "qc").agg(F.count("*").alias("n_before"))
    return pairs.select("qt", "qc", "ct", "cc").join(before, ["qt", "qc"]).join(new, ["qt", "qc", "ct", "cc"], "left").select("qt", "qc", "ct", "cc", "n_before", F.coalesce("added", F.lit(0)).alias("added"))


def combined_expansion(domains: DataFrame, aligned: DataFrame, rows: DataFrame) -> DataFrame:
    """Both expansions of a pair of tables at once: qt, ct, columns, added (values that the aligned columns add) and rows_added; rows: t, row (a row's text)."""
    own = column_expansion(domains, aligned).groupBy("qt", "ct").agg(F.count("*").alias("columns"), F.sum("added").alias("added"))
    q, c = rows.select(F.col("t").alias("qt"), "row").distinct(), rows.select(F.col("t").alias("ct"), "row").distinct()
    new = own.select("qt", "ct").join(c, "ct").join(q, ["qt", "row"], "left_anti").groupBy("qt", "ct").agg(F.count("*").alias("rows_added"))
    return own.join(new, ["qt", "ct"], "left").select("qt", "ct", "columns", "added", F.coalesce("rows_added", F.lit(0)).alias("rows_added"))


def other_class_pairs(labels: DataFrame, id: str, label: str, most: int) -> DataFrame:
    """So many unordered pairs of items with different labels: the negatives to same_class_pairs. Items are ordered by a hash, and pairs by their first and then their second item; an item has one label."""
    items = labels.select(F.col(id).alias("_i"), F.col(label).alias("_l"), F.struct(hash32(F.col(id).cast("string")), F.col(id)).alias("_o"))
    n, firsts = items.count(), 1 + most // max(1, labels.count() // 2)
    while True:
        # only the first items meet all others: as few of them as give enough pairs
        a = items.orderBy("_o").limit(firsts).select(F.col("_i").alias("a"), F.col("_l").alias("_la"), F.col("_o").alias("_oa"))
        b = items.select(F.col("_i").alias("b"), F.col("_l").alias("_lb"), F.col("_o").alias("_ob"))
        pairs = b.join(F.broadcast(a), (F.col("_oa") < F.col("_ob")) & (F.col("_la") != F.col("_lb")))
        if firsts >= n or pairs.limit(most).count() >= most:
            return pairs.orderBy("_oa", "_ob").limit(most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        firsts *= 2


def base_tables(profiles: DataFrame, most: int = 25, rows: int = 25_000, columns: int = 5, edits: int = 5) -> list[str]:
    """Tables to make a benchmark from: of those with few enough rows and enough columns, the longest and widest first, each whose header is so many edits away from all chosen before. profiles: t, n_rows, header (array). A header is short and there are at most 100 candidates, so the choice is made on the driver."""
    from ..functions.text import edit_steps

    left = profiles.filter((F.col("n_rows") <= rows) & (F.size("header") >= columns)).orderBy(F.desc("n_rows"), F.desc(F.size("header")), "t").limit(100)
    pairs = left.alias("x").join(left.alias("y"), F.col("x.t") != F.col("y.t")).select(F.col("x.t").alias("a"), F.col("y.t").alias("b"), edit_steps(F.col("x.header"), F.col("y.header")).alias("d"))
    near = {(r.a, r.b) for r in pairs.filter(F.col("d") < edits).collect()}
    chosen: list[str] = []
    for r in left.select("t").collect():
        if len(chosen) < most and not any((r.t, t) in near for t in chosen):
            chosen.append(r.t)
    return chosen


def slices(base: DataFrame, columns: list[str], most: int = 5, rows: int = 100) -> DataFrame:
    """The different rows of the columns, dealt to min(most, max(rows / 100, 1)) slices by a hash: no sort, no single task."""
    picked = base.select(*(F.col(c).cast("string").alias(c) for c in columns)).distinct()
    (n,) = fresh(picked, "_slices")
    count = picked.agg(F.least(F.lit(most), F.greatest(F.floor(F.count("*") / rows), F.lit(1))).alias(n))
    return picked.crossJoin(F.broadcast(count)).withColumn("j", hash32(F.concat_ws("|", *columns)) % F.col(n)).drop(n)


def stratified(df: DataFrame, stratum: str, key: Column, share: float) -> DataFrame:
    """Of each stratum the share of rows with the least hashes of their keys, one at least."""
    h = hash32(key.cast("string"))
    w = Window.partitionBy(stratum)
    # the rank is counted per stratum, of the hash and key alone
    n, r = fresh(df, "_rows", "_rank")
    return df.withColumn(n, F.count("*").over(w)).withColumn(r, F.row_number().over(w.orderBy(h, key))).filter(F.col(r) <= F.greatest(F.lit(1), F.floor(F.col(n) * share))).drop(n, r)


def same_class_pairs(labels: DataFrame, id: str, label: str) -> DataFrame:
    """Unordered pairs of items with one label."""
    a, b = labels.select(F.col(id).alias("a"), label), labels.select(F.col(id).alias("b"), label)
    return a.join(b, label).filter("a < b").select("a", "b", label)
