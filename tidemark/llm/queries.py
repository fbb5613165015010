"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import op1_decontamination
from tidemark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tidemark.llm.near_duplicates import op5_jaccard_join
from tidemark.llm.packing import op2_packing
from tidemark.llm.periodic_runs import op13_periodic_runs
from tidemark.llm.preference import OP3_SQL, op3_chat_formatting
from tidemark.llm.quality_model import op9_quality_classifier
from tidemark.llm.quality_rules import OP6_SQL, op6_quality_rules
from tidemark.llm.sharding import OP12_SQL, op12_sharding
from tidemark.llm.suffix_dedup import op10_suffix_dedup
from tidemark.llm.surrogates import op4_pii
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.urls import OP7_SQL, op7_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_pii": op4_pii,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_url_filters": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_sharding": OP12_SQL,
}
