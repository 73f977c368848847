"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranqa.llm import (chat_format, decontaminate, embedding_dedup, license_scan, line_dedup, ngram_join, packing, pii, quality,
                       suffix_dedup, toxicity, vector_codes, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pii": pii.op4_pii,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_packing": packing.op10_packing,
    "op11_whitening": whitening.op11_whitening,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat_format.OP2_SQL, "op5_embedding_dedup": embedding_dedup.OP5_SQL,
                              "op7_line_dedup": line_dedup.OP7_SQL, "op12_vector_codes": vector_codes.OP12_SQL}
