"""New tables, as they arrive, into the store of domains and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import domains as D
from ..operators import sketches as S


def ingest(cells: DataFrame, root: str, checkpoint: str, hashes: int = S.HASHES) -> StreamingQuery:
    """A stream of cells (t, c, v) to the folder's sketches.parquet: each batch of whole tables is sketched and appended under its number, so a batch that runs twice replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        S.signatures(D.domains(batch), hashes).write.mode("overwrite").parquet(f"{root}/sketches.parquet/batch={number}")

    return cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sketches(spark: SparkSession, root: str) -> DataFrame:
    """What has been ingested; the sketches of a table that came in parts are merged by their minima."""
    from pyspark.sql import functions as F

    raw = spark.read.parquet(f"{root}/sketches.parquet")
    parts = raw.select("t", "c", "card", F.posexplode("sig").alias("i", "h")).groupBy("t", "c", "i").agg(F.min("h").alias("h"), F.max("card").alias("card"))
    rows = parts.groupBy("t", "c").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("r"), F.max("card").alias("card"))
    return rows.select("t", "c", F.col("r.h").alias("sig"), "card")
