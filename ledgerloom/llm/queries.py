"""The registered queries of the operators in this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    chat, decontaminate, language_id, lm_scoring, packing, periodic_runs, quality_model, quality_rules, sharding, simhash,
    source_audit, substring_dedup, top_k,
)
from ledgerloom.llm.storage import on_workers

Query = Callable[[SparkSession, str], DataFrame]


def _registered(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: _registered(query)
    for query in (
        decontaminate.op1_decontaminate,
        sharding.op2_sharding,
        quality_model.op3_quality_model,
        quality_rules.op4_quality_rules,
        substring_dedup.op5_substring_dedup,
        packing.op6_packing,
        chat.op7_chat_format,
        simhash.op8_simhash,
        lm_scoring.op9_lm_scoring,
        language_id.op10_language_id,
        source_audit.op11_source_audit,
        top_k.op12_top_k,
        periodic_runs.op13_periodic_runs,
    )
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
    "op12_top_k": top_k.ORACLE,
}
