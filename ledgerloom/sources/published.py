"""Stored tables that change part by part and are published at once.

Rows lie below ``data``, one folder per generation (a write) and part (the value of one column). A
version is a single file that names, for each part, the generation that holds, with what else is
known about the part. A writer adds a generation, which nobody reads yet, and then a version that
points to it: parts that it did not touch stay where they are, and a reader, who looks up the
newest finished version once, sees all of a batch or none of it. One writer at a time: of two that
start from the same version the second fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

VERSION = "version"
GENERATION = "generation"


@dataclass(frozen=True)
class Published:
    """``schema`` without the part's column, ``part`` that column, ``about`` what a version says of a part.

    Where parts are small and many, ``folder`` names a further column by which rows lie in folders, each of many
    parts, and ``about`` has it too; otherwise each part has a folder."""

    spark: SparkSession
    path: str
    schema: T.StructType
    part: T.StructField
    about: T.StructType = T.StructType()
    folder: T.StructField | None = None

    @property
    def _place(self) -> list[T.StructField]:
        return [self.part] if self.folder is None else [self.part, self.folder]

    @property
    def data(self) -> str:
        return f"{self.path.rstrip('/')}/data"

    def _hadoop(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version_path(self, number: int) -> str:
        return f"{self.path.rstrip('/')}/versions/{number:012d}"

    def version(self) -> int | None:
        """The newest version whose write was finished."""
        where, files = self._hadoop(f"{self.path.rstrip('/')}/versions")
        if not files.exists(where):
            return None
        numbers = sorted((int(f.getPath().getName()) for f in files.listStatus(where) if f.isDirectory()), reverse=True)
        marked = (n for n in numbers if files.exists(self._hadoop(f"{self._version_path(n)}/_SUCCESS")[0]))
        return next(marked, None)

    @property
    def _entry(self) -> T.StructType:
        return T.StructType([T.StructField(VERSION, T.LongType()), T.StructField(GENERATION, T.StringType()), self.part, *self.about])

    def entries(self, version: int | None = None) -> DataFrame:
        """The parts of a version, by default the newest, with their generations."""
        number = self.version() if version is None else version
        if number is None:
            return self.spark.createDataFrame([], self._entry)
        # The filter holds for every row; it tells Spark that a join may prune files by this side.
        return self.spark.read.schema(self._entry).parquet(self._version_path(number)).where(F.col(VERSION) == number)

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField(GENERATION, T.StringType()), *self._place])
        where, files = self._hadoop(self.data)
        if not files.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.data)

    def read(self, entries: DataFrame | None = None) -> DataFrame:
        """The rows of the newest version, or of the given ``entries``; superseded files are pruned."""
        keys = [GENERATION, *(f.name for f in self._place)]
        holding = (self.entries() if entries is None else entries).select(*keys)
        return self._stored().join(holding, keys).drop(GENERATION, *(f.name for f in self._place[1:]))

    def write(self, rows: DataFrame, arranged: bool = False) -> str:
        """Add the rows as a generation of its own, which no version names yet. Rows that are ``arranged``
        by part already are not shuffled for it."""
        generation = f"g{uuid.uuid4().hex}"
        name = self._place[-1].name
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in [*self.schema, *self._place]])
        placed = typed if arranged else typed.hint("rebalance", F.col(name))
        placed.write.partitionBy(name).parquet(f"{self.data}/{GENERATION}={generation}")
        return generation

    def written(self, generation: str) -> DataFrame:
        return self._stored().where(F.col(GENERATION) == generation).drop(GENERATION)

    def publish(self, parts: DataFrame, generation: str, gone: DataFrame | None = None) -> int:
        """A new version in which ``parts`` (the part's column and ``about``) hold what the generation
        wrote for them, be it nothing, and ``gone`` no longer exist. A single file, so that it
        appears whole."""
        name, last = self.part.name, self.version()
        number = 0 if last is None else last + 1
        own = parts.select(F.lit(generation).alias(GENERATION), name, *self.about.names)
        entries = own
        if last is not None:
            dropped = own.select(name) if gone is None else own.select(name).unionByName(gone.select(name))
            kept = self.entries(last).join(dropped.distinct(), name, "left_anti")
            entries = kept.select(GENERATION, name, *self.about.names).unionByName(own)
        entries = entries.select(F.lit(number).cast("long").alias(VERSION), *entries.columns)
        entries.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._entry]).coalesce(1).write.parquet(self._version_path(number))
        return number

    def forget(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions and the generations that none of these names.
        Readers of older versions fail from then on; no writer may be at work."""
        last = self.version()
        if last is None:
            return
        numbers = range(max(0, last - keep + 1), last + 1)
        named = {r[0] for n in numbers for r in self.entries(n).select(GENERATION).distinct().collect()}
        where, files = self._hadoop(self.data)
        if files.exists(where):
            for folder in files.listStatus(where):
                if folder.getPath().getName().removeprefix(f"{GENERATION}=") not in named:
                    files.delete(folder.getPath(), True)
        where, files = self._hadoop(f"{self.path.rstrip('/')}/versions")
        for folder in files.listStatus(where):
            if int(folder.getPath().getName()) < numbers[0]:
                files.delete(folder.getPath(), True)

    def register(self, name: str) -> None:
        """Publish (or switch) a catalog view ``name`` on the newest version: its rows with what is known of
        their parts, and one row of nulls for a part without rows. Views made on top of it follow,
        since replacing it is one change of the catalog."""
        names = ", ".join(f"d.`{f.name}`" for f in self.schema)
        number = self.version()
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {name} AS SELECT {names}, p.* EXCEPT ({VERSION}, {GENERATION}) "
            f"FROM (SELECT * FROM parquet.`{self._version_path(number)}` WHERE {VERSION} = {number}) p "
            f"LEFT JOIN parquet.`{self.data}` d ON d.{GENERATION} = p.{GENERATION} AND d.`{self.part.name}` = p.`{self.part.name}`"
        )
