"""The five tables every operator works on, and how to read them from files."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.amounts import day, within
from ledgerloom.sources import schemas


@dataclass(frozen=True)
class Books:
    """One set of books. ``lines`` is the large table, ``moves`` is the next one;
    the other three are dimensions. All of them are lazy.

    ``complete`` says that every line has an existing entry and an existing company, as
    where foreign keys enforce it. Joins that only check this are then left out. Without
    it they are made, and lines that lack either are not in the ledger.

    ``month`` names a further column of ``lines`` by which their files are partitioned, with the month
    of their date as ``month_of`` writes it. Then reports and periods read the files of their months, and no others.
    """

    lines: DataFrame
    moves: DataFrame
    accounts: DataFrame
    companies: DataFrame
    analytics: DataFrame
    complete: bool = False
    month: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.lines.sparkSession

    def between(self, date_start=None, date_end=None) -> DataFrame:
        """The lines of a period, both ends included and optional; with any end given, undated lines are out."""
        lines = self.lines.where(within(F.col("date"), date_start, date_end))
        if self.month is None:
            return lines
        first, last = (None if end is None else month_of(day(end)) for end in (date_start, date_end))
        lines = lines if first is None else lines.where(F.col(self.month) >= first)
        return lines if last is None else lines.where(F.col(self.month) <= last)


TABLES = {
    "lines": ("account_move_line", schemas.LINES),
    "moves": ("account_move", schemas.MOVES),
    "accounts": ("account_account", schemas.ACCOUNTS),
    "companies": ("res_company", schemas.COMPANIES),
    "analytics": ("account_analytic_account", schemas.ANALYTICS),
}
REPORT_DEFINITIONS = ("report_definition", schemas.REPORTS)


def month_of(date: str | Column) -> Column:
    """A month as the files are partitioned by it: ``yyyy-MM``."""
    return F.date_format(date, "yyyy-MM")


def _scan(spark: SparkSession, directory: str, table: tuple, fmt: str, *also: str) -> DataFrame:
    """``also`` names columns that partition the files, as text."""
    name, schema = table
    schema = schemas.T.StructType([*schema, *(schemas.T.StructField(one, schemas.T.StringType()) for one in also)])
    return schemas.conform(spark.read.format(fmt).load(f"{directory}/{name}"), schema)


def lines(spark: SparkSession, directory: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, directory, TABLES["lines"], fmt)


def moves(spark: SparkSession, directory: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, directory, TABLES["moves"], fmt)


def accounts(spark: SparkSession, directory: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, directory, TABLES["accounts"], fmt)


def companies(spark: SparkSession, directory: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, directory, TABLES["companies"], fmt)


def analytics(spark: SparkSession, directory: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, directory, TABLES["analytics"], fmt)


def report_definitions(spark: SparkSession, directory: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, directory, REPORT_DEFINITIONS, fmt)


def load_books(
    spark: SparkSession, directory: str, fmt: str = "parquet", complete: bool = False, month: str | None = None
) -> Books:
    """Books from the files under ``<directory>/account_move_line`` and its four siblings; ``month`` names
    the column that partitions the lines by month, if one does."""
    tables = {kind: _scan(spark, directory, table, fmt) for kind, table in TABLES.items() if kind != "lines"}
    journal = _scan(spark, directory, TABLES["lines"], fmt, *([month] if month else []))
    return Books(lines=journal, **tables, complete=complete, month=month)


def by_month(books: Books, directory: str, month: str = "month") -> Books:
    """The same books with their lines written below ``directory``, partitioned by month; lines without date
    have a partition of their own. A month's lines may take several files."""
    name = TABLES["lines"][0]
    rows = books.lines.select(*schemas.LINES.names, month_of("date").alias(month))
    rows.hint("rebalance", F.col(month)).write.partitionBy(month).parquet(f"{directory}/{name}")
    return replace(books, lines=_scan(books.spark, directory, TABLES["lines"], "parquet", month), month=month)


def stored(books: Books, directory: str) -> Books:
    """The same books with their lines written below ``directory`` and read from there: for lines that are
    derived by joins or windows and read several times, which then are derived once."""
    name = TABLES["lines"][0]
    books.lines.select(*schemas.LINES.names).write.option("compression", "zstd").parquet(f"{directory}/{name}")
    return replace(books, lines=_scan(books.spark, directory, TABLES["lines"], "parquet"), month=None)


def table_books(spark: SparkSession, database: str = "default", complete: bool = False) -> Books:
    """Books from tables of the catalog.

    With ``account_move_line`` bucketed by ``move_id`` and ``account_move`` by ``id`` into
    the same number of buckets, lines meet their entries without a shuffle. That layout
    is for books without giant entries: a bucket is one task, which nothing splits.
    """
    tables = {
        kind: schemas.conform(spark.table(f"{database}.{name}"), schema)
        for kind, (name, schema) in TABLES.items()
    }
    return Books(**tables, complete=complete)
