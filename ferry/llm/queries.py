"""One query per operator over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferry.llm import contamination, conversations, dedup, language, licenses, neighbours, packing, phrases, pii, quality, recurrent, toxicity, urls
from ferry.llm.shared import table

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": lambda spark, at: licenses.license_report(table(spark, at, "documents")),
    "op2_quality": lambda spark, at: quality.quality_report(table(spark, at, "documents"), table(spark, at, "labels")),
    "op3_toxicity": lambda spark, at: toxicity.toxicity_report(table(spark, at, "documents"), table(spark, at, "labels")),
    "op4_near_duplicates": lambda spark, at: dedup.duplicates_report(table(spark, at, "documents")),
    "op5_personal_data": lambda spark, at: pii.personal_data_report(table(spark, at, "documents")),
    "op6_contamination": lambda spark, at: contamination.contamination_report(table(spark, at, "documents"), table(spark, at, "benchmark")),
    "op7_recurrent": lambda spark, at: recurrent.score_texts(table(spark, at, "documents")),
    "op8_neighbours": lambda spark, at: neighbours.neighbours_report(table(spark, at, "embeddings")),
    "op9_packing": lambda spark, at: packing.pack(table(spark, at, "documents")),
    "op10_language": lambda spark, at: language.language_report(table(spark, at, "documents")),
    "op11_url_filter": lambda spark, at: urls.verdict_report(table(spark, at, "pages")),
    "op12_conversation_repair": lambda spark, at: conversations.repair_report(table(spark, at, "conversations")),
    "op13_collocations": lambda spark, at: phrases.collocations(table(spark, at, "documents")),
}

SQL: dict[str, str] = {
    "op1_licenses": licenses.report_sql(),
    "op5_personal_data": pii.report_sql(),
    "op6_contamination": contamination.report_sql(),
    "op11_url_filter": urls.report_sql(),
    "op13_collocations": phrases.report_sql(),
}
