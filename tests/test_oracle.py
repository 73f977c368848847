"""Spark result == DuckDB oracle result on the smallest scale."""

import pytest

from ranqa.plans import all_queries
from ranqa.plans.oracle_check import check

from conftest import SF_SMALL

FAST = ["rerank_native", "rerank_trace", "gate_branch", "keyword_tags", "keyword_tag_counts",
        "template_no_entity", "template_negative", "strip_whitespace", "stopwords",
        "fuzzy_catalog_join", "turn_records", "keyed_shuffle", "index_roundtrip", "catalog_distinct", "vector_topk",
        "keyword_tags_large", "block_scores", "rerank_blocks", "fuzzy_catalog_blocks", "gate_dominant", "permuted_turns", "line_files",
        "jsonl_nested", "jsonl_splits", "word_counts", "character_states"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, name):
    res = check(spark, SF_SMALL, [name], verbose=False)[name]
    assert res["match"], res
