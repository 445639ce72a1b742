"""Stored balances of accounts by day, kept up to date by what is posted.

The table has one part per month. It holds, per account, the closing balance of each day of the month
with movements and, if there are earlier ones, the balance brought forward, dated the day before
the month. So the balances before any day are in one part, that of the day's month.

New postings, back-dated ones included, are not worked in at once: a batch adds one part with
their sums per account and day, and a reader adds those that lie before its day. ``fold`` works all
batches into the months from the earliest of their days on and drops them, in one version. Lines that are
taken back are posted with sign -1. Undated lines come last in the ledger, so no day has them.

An account has at most one row per day and month of the calendar, whatever its lines.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerloom.operators import ledger
from ledgerloom.sources.books import Books
from ledgerloom.sources.published import Published
from ledgerloom.sources.schemas import MONEY

#: A month as ``yyyy-MM``, or a batch of postings with this mark ahead.
PART = T.StructField("part", T.StringType())
BATCH = "+"
ROWS = T.StructType([
    T.StructField("account_id", T.LongType()), T.StructField("date", T.DateType()), T.StructField("amount", MONEY),
])


def store(spark: SparkSession, path: str) -> Published:
    return Published(spark, path, ROWS, PART)


def _movements(books: Books, lines: DataFrame | None = None) -> DataFrame:
    """Sums of ledger lines per account and day."""
    chosen = books if lines is None else replace(books, lines=lines)
    return ledger._day_sums(chosen).where(F.col("date").isNotNull()).select("account_id", "date", "amount")


def _month(day) -> F.Column:
    return F.date_format(day, "yyyy-MM")


def _closings(movements: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of the months from ``first`` to ``last`` from all movements in them, and earlier ones in
    whatever pieces."""
    account = Window.partitionBy("account_id").orderBy("date")
    # Dealt by account once, rows lie as the sums and the window want them.
    summed = movements.repartition("account_id").groupBy("account_id", "date").agg(F.sum("amount").alias("amount"))
    start = F.lit(f"{first}-01").cast("date")
    days = summed.select(
        "account_id", "date",
        F.sum("amount").over(account.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("amount"),
        F.lead("date").over(account).alias("next"),
    )
    # The last closing of a month is brought forward into each month up to that of the next movement.
    month = F.greatest(F.trunc("date", "month"), F.add_months(start, -1))
    until = F.coalesce(F.trunc("next", "month"), F.lit(f"{last}-01").cast("date"))
    following = F.when(F.add_months(month, 1) <= until, F.sequence(F.add_months(month, 1), until, F.expr("interval 1 month")))
    forward = days.select("account_id", F.explode(following).alias("month"), "amount").select(
        "account_id", F.date_sub("month", 1).alias("date"), "amount", _month("month").alias(PART.name)
    )
    own = days.where(F.col("date") >= start).select("account_id", "date", "amount", _month("date").alias(PART.name))
    return own.unionByName(forward.where(F.col(PART.name) >= first))


def _span(days: DataFrame) -> tuple[str, str] | None:
    first, last = days.agg(_month(F.min("date")), _month(F.max("date"))).first()
    return None if first is None else (first, last)


def _months(first: str, last: str) -> list[str]:
    begin, end = (int(m[:-3]) * 12 + int(m[-2:]) - 1 for m in (first, last))
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(begin, end + 1)]


def _part_frame(spark: SparkSession, parts: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({PART.name: pa.array(parts, pa.string())}), T.StructType([PART]))


def _parts(table: Published, version: int | None) -> tuple[list[str], list[str]]:
    """The months and the batches of a version: as many as the calendar has months, and as were posted since the last ``fold``."""
    if version is None:
        return [], []
    names = sorted(r[0] for r in table.entries(version).select(PART.name).collect())
    return [n for n in names if not n.startswith(BATCH)], [n for n in names if n.startswith(BATCH)]


def build(books: Books, path: str) -> Published:
    """Store the balances of all ledger lines; one pass over the journal."""
    table, movements = store(books.spark, path), _movements(books)
    table_of_days = table.written(table.write(movements.withColumn(PART.name, F.lit(BATCH)), arranged=True))
    span = _span(table_of_days)
    months = _months(*span) if span else []
    rows = _closings(table_of_days.drop(PART.name), *span) if span else table_of_days.limit(0)
    earlier, batches = _parts(table, table.version())
    gone = _part_frame(books.spark, earlier + batches)
    table.publish(_part_frame(books.spark, months), table.write(rows), gone)
    return table


def post(books: Books, lines: DataFrame, path: str, sign: int = 1) -> Published:
    """Add lines that were posted (or with ``sign`` -1 taken back) since, whatever their dates."""
    table, part = store(books.spark, path), f"{BATCH}{uuid.uuid4().hex}"
    rows = _movements(books, lines).withColumn("amount", F.col("amount") * sign)
    table.publish(_part_frame(books.spark, [part]), table.write(rows.withColumn(PART.name, F.lit(part)), arranged=True))
    return table


def _brought_forward(table: Published, entries: DataFrame, months: list[str], before: str) -> DataFrame:
    """The balances of all accounts before the day ``before`` from the stored months: one part is read."""
    own = [m for m in months if m <= before[:7]]
    stored = table.read(entries.where(F.col(PART.name) == (own[-1] if own else ""))).where(F.col("date") < F.lit(before).cast("date"))
    return stored.groupBy("account_id").agg(F.max_by("amount", "date").alias("amount"))


def carried(spark: SparkSession, path: str, date_start: str | date) -> DataFrame:
    """``account_id`` and ``amount``, the balance of each account before ``date_start``, from one month
    and the batches posted since. For ``ledger.ledger_between``."""
    table, before = store(spark, path), str(date_start)
    version = table.version()
    months, batches = _parts(table, version)
    entries = table.entries(version)
    base = _brought_forward(table, entries, months, before)
    if not batches:
        return base
    posted = table.read(entries.where(F.col(PART.name).isin(batches))).where(F.col("date") < F.lit(before).cast("date"))
    return base.unionByName(posted.select("account_id", "amount")).groupBy("account_id").agg(F.sum("amount").alias("amount"))


def fold(spark: SparkSession, path: str) -> Published:
    """Work the batches into the months from the earliest of their days on; earlier months stay as they are."""
    table = store(spark, path)
    version = table.version()
    months, batches = _parts(table, version)
    if not batches:
        return table
    entries = table.entries(version)
    posted = table.read(entries.where(F.col(PART.name).isin(batches))).drop(PART.name)
    span = _span(posted)
    if span is None:
        table.publish(_part_frame(spark, []), table.write(posted.withColumn(PART.name, F.lit("")).limit(0)), _part_frame(spark, batches))
        return table
    first, last = span[0], max([span[1], *months])
    opening = _brought_forward(table, entries, months, f"{first}-01").withColumn("date", F.date_sub(F.lit(f"{first}-01").cast("date"), 1))
    # A closing less the one before it is the day's movement. Balances brought forward, dated ahead of their
    # month, repeat a closing, so only days of their own month are read.
    by_account = Window.partitionBy("account_id").orderBy("date")
    later = table.read(entries.where((F.col(PART.name) >= first) & ~F.col(PART.name).startswith(BATCH)))
    closings = later.where(_month("date") == F.col(PART.name)).drop(PART.name).unionByName(opening)
    moved = closings.select("account_id", "date", (F.col("amount") - F.coalesce(F.lag("amount").over(by_account), F.lit(0))).alias("amount"))
    movements = moved.where("amount <> 0").unionByName(posted)
    table.publish(_part_frame(spark, _months(first, last)), table.write(_closings(movements, first, last)), _part_frame(spark, batches))
    return table
