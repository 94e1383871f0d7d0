"""Readers: lists of tables, CSV files, JSON lines of web tables, XML annotations, ontologies, vectors."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X


def crawl(spark: SparkSession, root: str) -> DataFrame:
    """repo, dataset, file of all files of datasets that have a metadata.json; repositories whose names begin with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    below = F.regexp_replace(F.split("path", F.lit(f"/{root.rstrip('/').rsplit('/', 1)[-1]}/"), 2)[1], "^/", "")
    parts = files.select(F.split(below, "/").alias("p")).filter((F.size("p") >= 3) & ~F.col("p")[0].startswith("."))
    named = parts.select(F.col("p")[0].alias("repo"), F.col("p")[1].alias("dataset"), F.array_join(F.slice("p", 3, 99), "/").alias("file"))
    with_metadata = named.filter("file = 'metadata.json'").select("repo", "dataset")
    return named.filter("file <> 'metadata.json'").join(with_metadata, ["repo", "dataset"], "left_semi")


def lake_list(spark: SparkSession, path: str) -> DataFrame:
    """repo, dataset, file from lines of three words; other lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(p) == 3).select(p[0].alias("repo"), p[1].alias("dataset"), p[2].alias("file"))


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """One table's name in each line."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim("value").alias("t"))


def header_width(spark: SparkSession, path: str) -> int:
    """The fields of the widest first line of the files of a path; of each file only the beginning is read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                fs, own = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with fs.open_input_stream(own) as f:
                    first = next(csv.reader(io.TextIOWrapper(io.BytesIO(f.read(1 << 20)), "utf-8", "replace", newline="")), [])
                out.append(len(first))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["n"])

    return paths.mapInArrow(run, "n int").agg(F.max("n")).first()[0] or 0


def csv_cells(spark: SparkSession, path: str, skip_rows: int = 0) -> DataFrame:
    """t, c, col_idx, row, v of the CSV files of a path, each with a header of its own.

    skip_rows rows behind the header (a second header row) are left out of each file,
    and a file without a row behind them is an error. Cells that a short row lacks are
    null; what a row has beyond its header is left out. Quoted values may hold line
    ends, so a file is not split.
    """
    n = header_width(spark, path)
    if not n:
        return spark.createDataFrame([], "t string, c string, col_idx int, row bigint, v string")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
    raw = spark.read.schema(schema).option("header", "false").option("multiLine", "true").option("recursiveFileLookup", "true").option("ignoreLeadingWhiteSpace", "true").option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = raw.select(F.col("_metadata.file_path").alias("f"), F.array(*schema.names).alias("cells"), F.monotonically_increasing_id().alias("m"))
    w = Window.partitionBy("f")
    # the header is the row of a file that was read first
    own = rows.withColumns({"row": F.row_number().over(w.orderBy("m")) - 2 - skip_rows, "names": F.first("cells").over(w.orderBy("m")), "last": F.count("*").over(w)})
    if skip_rows:
        short = F.concat(F.lit("no rows in "), F.col("f"))
        own = own.withColumn("row", F.when(F.col("last") <= 1 + skip_rows, F.raise_error(short).cast("bigint")).otherwise(F.col("row")))
    width = F.size("names") - F.coalesce(F.array_position(F.reverse(F.transform("names", lambda x: x.isNotNull())), True).cast("int"), F.size("names") + 1) + 1
    head = F.slice("names", 1, width)
    cells = own.filter("row >= 0").select(F.regexp_extract("f", r"([^/]+?)(\.csv)?$", 1).alias("t"), head.alias("head"), F.col("row").cast("bigint").alias("row"), F.posexplode(F.slice("cells", 1, width)).alias("col_idx", "v"))
    return cells.select("t", F.regexp_replace(F.coalesce(F.get("head", F.col("col_idx")), F.lit("")), "^\ufeff", "").alias("c"), "col_idx", "row", "v")


def numeric_columns(cells: DataFrame, first: int = 10) -> DataFrame:
    """t, c, is_numeric: any of the first so many values of a column parses as a number."""
    return cells.filter(F.col("row") < first).groupBy("t", "c").agg(F.coalesce(F.bool_or(X.parses_as_number(F.col("v"))), F.lit(False)).alias("is_numeric"))


_WEB = "tableId bigint, tableHeaders array<array<struct<text:string,tdHtmlString:string,isNumeric:boolean>>>, tableData array<array<struct<text:string,tdHtmlString:string,isNumeric:boolean>>>"


def web_tables(spark: SparkSession, path: str, entities: bool = False) -> DataFrame:
    """t, col_idx, c, row, v of JSON lines of web tables; the header is the last header row as wide as the first data row. With entities, v is the entity that a cell links to."""
    raw = spark.read.schema(_WEB).json(path).filter(F.size("tableData") > 0)
    fit = F.filter("tableHeaders", lambda h: F.size(h) == F.size(F.get("tableData", F.lit(0))))
    rows = raw.select(F.col("tableId").cast("string").alias("t"), F.element_at(F.when(F.size(fit) > 0, fit), -1).alias("h"), F.posexplode("tableData").alias("row", "cells"))
    cells = rows.select("t", "h", "row", F.posexplode("cells").alias("col_idx", "cell"))
    v = F.coalesce(F.regexp_extract(F.col("cell.tdHtmlString"), r'<a [^>]*href="https?://(?:www|en)\.wikipedia\.org/wiki/([^"]*)"', 1), F.lit("")) if entities else F.col("cell.text")
    return cells.select("t", "col_idx", F.get("h", F.col("col_idx"))["text"].alias("c"), "row", v.alias("v"))


def xml_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, col, name, value of the column annotations of XML ground truth."""
    schema = "_col string, anno array<struct<_name:string,_value:string>>"
    raw = spark.read.format("xml").option("rowTag", "colAnnos").schema(schema).load(path)
    return raw.select(F.input_file_name().alias("file"), F.col("_col").cast("int").alias("col"), F.explode("anno").alias("a")).select("file", "col", F.col("a._name").alias("name"), F.col("a._value").alias("value"))


def xml_entities(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, entity of the cell annotations of XML ground truth (whose element's name is misspelt)."""
    raw = spark.read.format("xml").option("rowTag", "cellAnnotatoons").schema("row array<struct<entity:array<string>>>").load(path)
    rows = raw.select(F.input_file_name().alias("file"), F.posexplode("row").alias("row", "r"))
    return rows.select("file", "row", F.posexplode("r.entity").alias("col", "entity"))


def xml_column_entities(spark: SparkSession, path: str) -> DataFrame:
    """file, col, name (of the column's annotation), entity: the cells of the columns that are annotated."""
    columns = xml_annotations(spark, path).select("file", "col", "name")
    return xml_entities(spark, path).join(columns, ["file", "col"]).select("file", "col", "name", "row", "entity")


def ontology(spark: SparkSession, path: str, columns: tuple[str, str] = ("entity", "category")) -> DataFrame:
    """Two columns of a tab-separated ontology, without angle brackets, lower-cased; an id before them is left out."""
    p = F.split("value", "\t")
    n = F.size(p)
    clean = lambda x: F.lower(F.translate(x, "<>", ""))
    return spark.read.text(path).filter(n >= 2).select(clean(F.when(n >= 3, p[1]).otherwise(p[0])).alias(columns[0]), clean(F.when(n >= 3, F.get(p, F.lit(2))).otherwise(p[1])).alias(columns[1]))


def paired(spark: SparkSession, path: str, columns: tuple[str, str]) -> DataFrame:
    """Two columns of lines cut at their first bar; lines without one are skipped."""
    p = F.split("value", r"\|", 2)
    return spark.read.text(path).filter(F.size(p) == 2).select(F.lower(p[0]).alias(columns[0]), p[1].alias(columns[1]))


def sampled(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """A random sample of at most so many rows."""
    return df.orderBy(F.rand(seed)).limit(rows)


def vectors(spark: SparkSession, path: str, kind: str = ">f8") -> DataFrame:
    """t (the file's name), v of files that hold big-endian numbers and nothing else: vectors (>f8) or signatures (>u8, as signed numbers). An empty file has no row."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("t"), "content")
    floats = kind.endswith("f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(x.as_buffer()[: len(x.as_py()) // 8 * 8], kind).astype("<f8" if floats else "<u8").view("<f8" if floats else "<i8") for x in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(rows, pa.list_(pa.float64() if floats else pa.int64()))], names=["t", "v"])

    return raw.mapInArrow(run, f"t string, v array<{'double' if floats else 'bigint'}>")


def sqlite_rows(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    """The rows of a query on SQLite files in a folder that all executors can read: a task for each file."""
    kind = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        arrow = to_arrow_schema(kind)
        for b in batches:
            for path in b.column(0).to_pylist():
                with closing(sqlite3.connect(f"file:{re.sub('^file:/+', '/', path)}?mode=ro", uri=True)) as db:
                    cursor = db.execute(query)
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, kind)


def applied(cells: DataFrame, f: Callable, schema: str, most: int = 10_000) -> DataFrame:
    """f(pandas frame of a table's cells) of the first so many tables, by name."""
    some = cells.select("t").distinct().orderBy("t").limit(most)
    return cells.join(some, "t", "left_semi").groupBy("t").applyInPandas(f, schema)


def copied(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    """One table from several stores that hold a part each, with the store's path."""
    return spark.read.option("mergeSchema", "true").parquet(*(f"{p}/{table}.parquet" for p in paths)).withColumn("store", F.input_file_name())
