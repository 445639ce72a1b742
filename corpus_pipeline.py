"""A training-data pipeline over ``documents``, in five stages.

Each stage takes what its predecessor kept, as stored rows, and tells rows apart by a key, so
that repeated or null ids are handled row by row. The first four return the columns of the
documents, the last the pieces of packed sequences. A missing ``n_chars`` column is not added,
an existing one follows its text. No stage needs a row: empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, packing, quality_rules, simhash, substring_dedup
from ledgerloom.llm.storage import on_workers, release, scope, shared_table, with_row_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What a run's stage before the current one stored for itself: of no use once its result is written.
#: A run is told by its thread and input, so that runs beside each other leave each other's tables alone.
_left: dict[tuple[int, str], list[str]] = {}


def _stage(step: Stage) -> Stage:
    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        on_workers(spark)
        left = _left.setdefault((get_ident(), sf_dir), [])
        release(spark, left)
        with scope() as tables:
            result = step(spark, docs, sf_dir)
        left.extend(tables)
        return result

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's record leave."""
    keyed, key = with_row_key(docs, "doc_id")
    kept = quality_rules.judge(keyed, id_col=key).where("kept").select(key)
    return keyed.join(kept, key, "left_semi").drop(key)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest key, and so with
    the smallest doc_id."""
    keyed, key = with_row_key(docs, "doc_id")
    kept = simhash.components(keyed, id_col=key).where(F.col(key) == F.col("component_id")).select(key)
    return keyed.join(kept, key, "left_semi").drop(key)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those of which nothing is left go."""
    span_col = substring_dedup.free_name(docs, "removed_spans")
    found = substring_dedup.dedup(docs, over_blanks=True)
    left = found.where((F.size(span_col) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(span_col)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item."""
    keyed, key = with_row_key(docs, "doc_id")
    found = decontaminate.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    hit = found.where("n_hit > 0").select(key)
    return keyed.join(hit, key, "left_anti").drop(key)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: SQL can express neither XXH64 fingerprints nor a tokenizer; the tests hold ``run`` against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir))
    release(spark, _left.pop((get_ident(), sf_dir), []))
    return docs
