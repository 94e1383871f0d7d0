"""The queries of this folder and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lines, ngramjoin, packing, pii, quality, repetition, substrings, textkit, toxicity, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.written_and_read(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "documents")).drop("fp")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifiers(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.links(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.good_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def _repetition_sql() -> str:
    n, free, part, longest = repetition.MIN_WORDS, repetition.FREE_WORDS, repetition.MAX_FRACTION, repetition.MAX_LONGEST_FRACTION
    return f"""
with d as materialized (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{textkit.WORD}') w from documents),
g as materialized (select doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') g from d, unnest(range(1, len(w) - {n - 2})) t(i)),
m as materialized (select doc_id, i, g from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + o) covered from m, unnest(range({n})) t(o) group by 1),
p as (select a.doc_id, b.i - a.i gap, a.i - row_number() over (partition by a.doc_id, b.i - a.i order by a.i) island from m a join m b on a.doc_id = b.doc_id and a.g = b.g and a.i < b.i),
r as (select doc_id, max(n) + {n - 1} longest from (select doc_id, gap, island, count(*) n from p group by all) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(covered, 0)::bigint repeat_words, coalesce(longest, 0)::bigint longest_repeat,
       round(coalesce(covered, 0) / nullif(len(w), 0)::double, 6) repeat_fraction
from d left join c using (doc_id) left join r using (doc_id)
where coalesce(covered, 0) <= greatest({free}, {part} * len(w)) and coalesce(longest, 0) <= greatest({free}, {longest} * len(w))"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_lines": op3_lines,
    "op4_pii": op4_pii,
    "op5_substrings": op5_substrings,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_repetition": op10_repetition,
}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": "select page_id, url, html from pages", "op5_substrings": substrings.spans_sql(), "op6_ngram_join": ngramjoin.links_sql(), "op8_packing": packing.pack_sql(), "op10_repetition": _repetition_sql()}
