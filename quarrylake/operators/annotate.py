"""Annotation of domains with an ontology: types (entity, category) and a taxonomy (sub, super)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def inverted_index(entities: DataFrame, entity: str = "entity") -> DataFrame:
    """word, entity, total (words of the entity)."""
    words = X.entity_words(F.col(entity))
    return entities.select(F.col(entity).alias("entity")).distinct().select("entity", F.size(words).cast("bigint").alias("total"), F.explode(words).alias("word"))


def find_entities(values: DataFrame, index: DataFrame, strict: bool = True, value: str = "v") -> DataFrame:
    """v, entity: every word of the value is one of the entity's, and the entity has no more words; if strict is off, one common word is enough."""
    words = X.get_words(F.col(value))
    q = values.select(F.col(value).alias("v")).distinct().select("v", F.size(words).cast("bigint").alias("n"), F.explode(words).alias("word"))
    hit = q.join(index.select("word", "entity", "total").distinct(), "word").groupBy("v", "entity", "n", "total").agg(F.count("*").alias("hits"))
    if strict:
        hit = hit.filter((F.col("hits") == F.col("n")) & (F.col("total") == F.col("n")))
    return hit.select("v", "entity")


def ranked_entities(values: DataFrame, index: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    """The k best entities that have all words of a value: fewest words first, then by name."""
    from pyspark.sql import Window

    words = X.get_words(F.col(value))
    q = values.select(F.col(value).alias("v")).distinct().select("v", F.array_distinct(words).alias("w")).select("v", F.size("w").cast("bigint").alias("n"), F.explode("w").alias("word"))
    hit = q.join(index.select("word", "entity", "total").distinct(), "word").groupBy("v", "entity", "n", "total").agg(F.count("*").alias("hits")).filter("hits = n")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("total", "entity"))
    return hit.select("v", "entity", rank.cast("bigint").alias("rank")).filter(F.col("rank") <= k)


def partial_annotation(domains: DataFrame, matches: DataFrame) -> DataFrame:
    """Values with and without an entity, and entities, of each domain."""
    own = domains.join(matches, "v", "left")
    return own.groupBy("t", "c").agg(F.countDistinct(F.when(F.col("entity").isNotNull(), F.col("v"))).alias("n_annotated"), F.countDistinct(F.when(F.col("entity").isNull(), F.col("v"))).alias("n_unannotated"), F.countDistinct("entity").alias("n_entities"))


def unannotated(domains: DataFrame, matches: DataFrame) -> DataFrame:
    return domains.join(matches.select("v").distinct(), "v", "left_anti")


def classes(domains: DataFrame, matches: DataFrame, types: DataFrame) -> DataFrame:
    """t, c, class, freq: how many entities of a domain have the class."""
    entities = domains.join(matches, "v").select("t", "c", "entity").distinct()
    return entities.join(types.select("entity", F.col("category").alias("class")).distinct(), "entity").groupBy("t", "c", "class").agg(F.count("*").alias("freq"))


def parents(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("sub", "super").distinct()


def closure(taxonomy: DataFrame) -> DataFrame:
    """Every class with each of its ancestors and the least number of steps."""
    spark = taxonomy.sparkSession
    name = f"taxonomy_{id(taxonomy)}"
    parents(taxonomy).createOrReplaceTempView(name)
    # a path longer than the taxonomy has classes would run in a circle
    return spark.sql(f"""with recursive up(sub, super, depth) as (select sub, super, 1 from {name} union all select u.sub, t.super, u.depth + 1 from up u join {name} t on t.sub = u.super where u.depth < (select count(distinct sub) from {name}))
        select sub, super, cast(min(depth) as bigint) depth from up group by sub, super""")


def ancestors(types: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The classes of an entity and their direct super-classes."""
    own = types.select("entity", F.col("category").alias("class"))
    return own.unionAll(own.join(parents(taxonomy), F.col("class") == F.col("sub")).select("entity", F.col("super").alias("class"))).distinct()


def subject_column(annotated: DataFrame) -> DataFrame:
    """The first column (by name) of each table with an entity."""
    return annotated.filter("n_entities > 0").groupBy("t").agg(F.min("c").alias("subject"))


def distribution(histogram: DataFrame, by: list[str], freq: str = "freq") -> DataFrame:
    """freq as a share of its group: p."""
    from pyspark.sql import Window

    return histogram.withColumn("p", F.col(freq) / F.sum(freq).over(Window.partitionBy(*by)))


def divergence(shares: DataFrame, group: str, key: str) -> DataFrame:
    """Kullback-Leibler divergence of every ordered pair of groups; infinite where the second lacks a key of the first."""
    a, b = shares.select(F.col(group).alias("a"), F.col(key).alias("k"), F.col("p")), shares.select(F.col(group).alias("b"), F.col(key).alias("k"), F.col("p").alias("q"))
    groups = shares.select(F.col(group).alias("b")).distinct()
    full = a.crossJoin(F.broadcast(groups)).filter("a <> b").join(b, ["b", "k"], "left")
    return full.groupBy("a", "b").agg(F.sum(F.when(F.col("q").isNull(), F.lit(float("inf"))).otherwise(F.col("p") * F.ln(F.col("p") / F.col("q")))).alias("kl"))


def entity_complement(entity_classes: DataFrame, power: float = 2.0) -> DataFrame:
    """ece of table pairs: the sum over classes of (q_c / |q|)^2 (e_c / |c|)^2, e over the candidate's entities that the query lacks.

    entity_classes: t, entity, class of each table's subject column.
    """
    own = entity_classes.select("t", "entity", "class").distinct()
    n = own.groupBy("t").agg(F.countDistinct("entity").cast("double").alias("n"))
    freq = own.groupBy("t", "class").agg(F.count("*").alias("f"))
    q = freq.join(n, "t").select(F.col("t").alias("qt"), "class", F.pow(F.col("f") / F.col("n"), F.lit(power)).alias("x"))
    # what the candidate has of a class less what both have: no pair of tables is spelt out by entity
    both = own.select(F.col("t").alias("qt"), "entity").distinct().join(own.select(F.col("t").alias("ct"), "entity", "class"), "entity").filter("qt <> ct").groupBy("qt", "ct", "class").agg(F.count("*").alias("common"))
    c = freq.join(n, "t").select(F.col("t").alias("ct"), "class", F.col("f"), F.col("n"))
    pairs = q.join(c, "class").filter("qt <> ct").join(both, ["qt", "ct", "class"], "left")
    new = (F.col("f") - F.coalesce("common", F.lit(0))) / F.col("n")
    return pairs.groupBy("qt", "ct").agg(F.sum(F.col("x") * F.pow(new, F.lit(power))).alias("ece"))


def label_similarity(labels: DataFrame) -> DataFrame:
    """Jaccard of the label sets (column name and classes) of column pairs that share a label; labels: t, c, label."""
    from .measures import jaccard

    return jaccard(labels.select("t", "c", F.col("label").alias("v")).distinct())


def schema_consistency(aligned: DataFrame, column_counts: DataFrame) -> DataFrame:
    """sc: the aligned pairs' similarities over the columns of both tables, aligned ones counted once."""
    s = aligned.groupBy("qt", "ct").agg(F.sum("score").alias("w"), F.count("*").alias("m"))
    n = column_counts.select("t", "n")
    return s.join(n.select(F.col("t").alias("qt"), F.col("n").alias("nq")), "qt").join(n.select(F.col("t").alias("ct"), F.col("n").alias("nc")), "ct").select("qt", "ct", (F.col("w") / (F.col("nq") + F.col("nc") - F.col("m"))).alias("sc"))
