"""Rendezvous hashing of record keys over weighted shards.

Each shard scores each key by -ln(u) / weight, where u in (0, 1) is a hash of key and shard; the
lowest score gets the record. So a shard's share follows its weight, and a record moves only if
its shard leaves or a new one scores lower: one more shard takes records only into itself. Only
key, shard names and weights decide, in any session or order.

Within a shard, records are numbered without gaps: the stored rows are cut into blocks of
consecutive positions, a block's rows are numbered by shard, and a block starts where the counts
of earlier blocks end. No task holds a shard or all rows of a key.

A null key is a key of its own. Repeated rows and ties of a key go to one shard and get
different slots. A null text has 8 bytes and checksum of the empty text. Without rows there is
no result. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import shared_table

SHARDS = 24
#: Bytes of a record besides its text.
HEADER = 8
#: Consecutive rows that are numbered together.
BLOCK = 1 << 16
SEED = "rendezvous"


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The lower, the better the shard for the key; 53 bits of a hash make u."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), key, F.lit(shard)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins the key; weights must be positive. Ties go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    best = F.least(*(F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)))
    return best["shard"]


def assign(records: DataFrame, key_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS,
           grown_weight: float = 1.0, block: int = BLOCK) -> DataFrame:
    """One row per record: key, ``size``, ``text_crc32``, ``shard``, ``slot`` in the shard, and
    ``grown_shard``, its shard after one more of weight ``grown_weight`` has been added.

    The rows, without texts, are stored in the shared folder so that their positions are fixed."""
    key, text = F.col("key"), F.coalesce("text", F.lit(""))
    own = records.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    thin = shared_table(own.select(
        "key", (F.octet_length(text) + F.lit(HEADER)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"), shard_of(key, [*weights, grown_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("position"),
    ))
    placed = thin.withColumn("block", F.floor(F.col("position") / block))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("position"))
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "block"])
    return numbered.select(
        F.col("key").alias(key_col), "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).alias("slot"), "grown_shard",
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
