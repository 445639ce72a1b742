"""The ledger stored in its own order, so that any page of it is read from the files that hold it.

Ledger lines, balances included, lie in ranges of (account, date, id), nulls last, of
``RANGE`` lines each, but for the last of a file; a busy account has many. A file holds the ranges of one task that
wrote it, so there are as many files as tasks, however short the ranges. Each line has its place in its range, and a version says for
each range its number of lines, the lines ahead of it, and its last key. So page 7 and page 7 million alike
read the ranges that the page touches, two at most where it is shorter than a range, and of these the pages
of Parquet that hold its places.

A stored ledger is that of the moment it was built; building it again publishes the new one at once,
and whoever has a frame of the old one may still read it until ``forget``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ledgerloom.functions.amounts import day
from ledgerloom.operators import ledger
from ledgerloom.sources.books import Books
from ledgerloom.sources.published import Published
from ledgerloom.sources.schemas import AMOUNT, MONEY

#: Lines of a range.
RANGE = 1_000_000

PART = T.StructField("range", T.LongType())
PLACE = T.StructField("place", T.LongType())
CHUNK = T.StructField("chunk", T.LongType())
_TYPES = {"date": T.DateType(), "move_name": T.StringType(), "ref": T.StringType(), "debit": AMOUNT, "credit": AMOUNT, "balance": MONEY}
ROWS = T.StructType([*(T.StructField(name, _TYPES.get(name, T.LongType())) for name in ledger.LEDGER_COLUMNS), PLACE])
ABOUT = T.StructType([
    T.StructField("lines", T.LongType()), T.StructField("ahead", T.LongType()),
    T.StructField("last_account", T.LongType()), T.StructField("last_date", T.DateType()), T.StructField("last_id", T.LongType()),
    CHUNK,
])
# The number of a row is its partition's, shifted by so many bits, plus its place in the partition.
_SHIFT = 33


def store(spark: SparkSession, path: str) -> Published:
    return Published(spark, path, ROWS, PART, ABOUT, CHUNK)


def _key(account: Column, when: Column, number: Column) -> Column:
    """The default order of the ledger as one value that can be compared."""
    return F.struct(
        account.isNull().alias("a"), F.coalesce(account, F.lit(0)).alias("b"),
        when.isNull().alias("c"), F.coalesce(when, day("1970-01-01")).alias("d"), number.alias("e"),
    )


def build(books: Books, path: str, lines_per_range: int = RANGE) -> Published:
    """Store the whole ledger. Its lines are shuffled as often as those of the ledger itself."""
    if lines_per_range < 1:
        raise ValueError("a range holds at least one line")
    table = store(books.spark, path)
    # As many tasks as the session's shuffles have, fewer where they are small.
    place = F.col("number").bitwiseAND((1 << _SHIFT) - 1)
    numbered = (
        ledger.arranged_ledger(books).withColumnRenamed("partition", CHUNK.name)
        .withColumn("number", F.monotonically_increasing_id())
        .withColumn(PART.name, F.col("number") - place + F.floor(place / lines_per_range))
        .withColumn(PLACE.name, place % lines_per_range)
    )
    generation = table.write(numbered, arranged=True)
    own = _key(F.col("account_id"), F.col("date"), F.col("id"))
    found = table.written(generation).groupBy(PART.name, CHUNK.name).agg(
        F.count("*").alias("lines"), F.max_by(F.struct("account_id", "date", "id"), own).alias("last")
    )
    # One row per range: a million of them at 10^12 lines, with a million lines each.
    before = Window.orderBy(PART.name).rowsBetween(Window.unboundedPreceding, -1)
    parts = found.select(
        PART.name, "lines", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("ahead"),
        F.col("last.account_id").alias("last_account"), F.col("last.date").alias("last_date"), F.col("last.id").alias("last_id"), CHUNK.name,
    )
    table.publish(parts, generation, gone=table.entries().select(PART.name))
    return table


def _lines_at(table: Published, entries: DataFrame, first: int, size: int) -> DataFrame:
    """The lines ``first`` to ``first + size`` of the ledger; the ranges that hold them are looked up now,
    one per ``RANGE`` lines asked for and one more."""
    holding = entries.where((F.col("ahead") < first + size) & (F.col("ahead") + F.col("lines") > first))
    held = holding.select(PART.name, "ahead").collect()
    place, number = F.col(PLACE.name), F.col(PART.name)
    asked = F.lit(False)
    for one in held:
        asked = asked | ((number == one[0]) & place.between(first - one.ahead, first + size - 1 - one.ahead))
    rows = table.read(entries.where(number.isin([one[0] for one in held]))).where(asked)
    return rows.select(*ledger.LEDGER_COLUMNS).orderBy(*ledger.default_order())


def page(spark: SparkSession, path: str, number: int, size: int = 80) -> DataFrame:
    """Page ``number``, from 0, of ``size`` ledger lines; empty behind the last."""
    if number < 0 or size < 1:
        raise ValueError("pages are numbered from 0 and hold at least one line")
    table = store(spark, path)
    return _lines_at(table, table.entries(), number * size, size)


def page_after(spark: SparkSession, path: str, account_id: int | None, date, id: int, size: int = 80) -> DataFrame:
    """The ``size`` lines behind the place that these keys have in the order, as ``ledger_next_page`` gives them,
    whether a line has them or not; None for a line without account or date."""
    if size < 1:
        raise ValueError("a page holds at least one line")
    table = store(spark, path)
    entries = table.entries()
    here = _key(F.lit(account_id).cast("long"), F.lit(date).cast("date"), F.lit(id).cast("long"))
    behind = _key(F.col("last_account"), F.col("last_date"), F.col("last_id")) > here
    at = entries.where(behind).agg(F.min(F.struct(PART.name, "ahead")).alias("at")).first()["at"]
    if at is None:
        return _lines_at(table, entries, 0, 0)
    own = table.read(entries.where(F.col(PART.name) == at[0])).where(_key(F.col("account_id"), F.col("date"), F.col("id")) > here)
    return _lines_at(table, entries, at.ahead + own.agg(F.min(PLACE.name)).first()[0], size)


def lines(spark: SparkSession, path: str) -> int:
    """The number of ledger lines, from the version alone."""
    return store(spark, path).entries().agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
