"""Intermediate tables in the folder that driver and executors share, and row keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A local session without it gets one of its own;
    on a cluster a missing setting is an error, since executors do not see each other's disks."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(SETTING, folder)
    return folder


#: The tables written within the innermost ``scope``, if any.
_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """Note the tables written meanwhile, for ``release``."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def shared_table(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet below the shared folder and read them back.

    This cuts the lineage without tying rows to an executor, and fixes what is computed by
    position or in Python for all later readers."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, tables: list[str]) -> None:
    """Delete intermediate tables. Call it once the results made from them are stored; the
    frames that read them are of no use afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while tables:
        path = hadoop(tables.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def with_row_key(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The frame with a long column that tells its rows apart, and that column's name.

    Keys ascend with the id, nulls last, whatever the ids. Ids that are unique and never null serve
    themselves. Otherwise (repeated rows, null ids) the rows are sorted by id and, where that ties, by
    a hash of all columns, numbered in that order and stored, so that every later pass sees the
    same numbers. So other rows rank alike with and without such rows among them; rows that
    tie even then are equal, and it does not matter which comes first."""
    key = free_name(docs, "row_key")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    clash = ids.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).collect()
    if not clash:
        return docs.withColumn(key, F.col(id_col).cast("long")), key
    content = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    ranked = docs.orderBy(F.col(id_col).cast("long").asc_nulls_last(), content)
    return shared_table(ranked.withColumn(key, F.monotonically_increasing_id())), key


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it. Where executors have
    it installed, or got it by ``--py-files``, this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
