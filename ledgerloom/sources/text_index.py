"""An index of entry names and references for substring search, beside the lines.

Every different text is posted under each three letters in it, lower-cased, and once under none. A posting
carries the text, so hits are verified where they are found. Postings lie in parts by field and a hash
of the three letters; a search reads the parts of its needle's letters and keeps the texts that all of
them lead to. A needle of one or two letters reads each different text once, not the lines.

A text that many lines share is posted once per batch. New lines add parts of their own, and ``merge``
works them into the others.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions.amounts import contains_ignoring_case
from ledgerloom.operators import ledger
from ledgerloom.sources.books import Books
from ledgerloom.sources.published import Published

NAME, REF = "move_name", "ref"
GRAM = 3
BUCKETS = 64
#: Up to this many found values go to the scan of the lines as literals, which Parquet's bloom filters prune by.
LITERALS = 1000

PART = T.StructField("part", T.StringType())
ROWS = T.StructType([T.StructField("field", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("text", T.StringType())])


def store(spark: SparkSession, path: str) -> Published:
    return Published(spark, path, ROWS, PART)


def _grams(text: Column) -> Column:
    lowered = F.lower(text)
    starts = F.when(F.length(lowered) >= GRAM, F.sequence(F.lit(1), F.length(lowered) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.transform(starts, lambda i: F.substring(lowered, i, F.lit(GRAM))), F.array(F.lit(""))))


def _postings(books: Books, lines: DataFrame, moves: DataFrame) -> DataFrame:
    names = moves.select(F.lit(NAME).alias("field"), F.col("name").alias("text"))
    refs = lines.select(F.lit(REF).alias("field"), F.col("ref").alias("text"))
    texts = names.unionByName(refs).where("text IS NOT NULL").distinct()
    bucket = F.when(F.col("gram") == "", F.lit("all")).otherwise((F.crc32("gram") % BUCKETS).cast("string"))
    return texts.select("field", "text", F.explode(_grams(F.col("text"))).alias("gram")).withColumn(PART.name, F.concat_ws("-", "field", bucket))


def _publish(table: Published, rows: DataFrame, gone: DataFrame | None = None) -> Published:
    generation = table.write(rows)
    table.publish(table.written(generation).select(PART.name).distinct(), generation, gone)
    return table


def build(books: Books, path: str) -> Published:
    """Index all entry names and references."""
    table = store(books.spark, path)
    gone = table.entries().select(PART.name)
    return _publish(table, _postings(books, books.lines, books.moves), gone)


def add(books: Books, lines: DataFrame, path: str) -> Published:
    """Index the texts of new lines and of their entries."""
    moves = books.moves.join(lines.select(F.col("move_id").alias("id")).distinct(), "id", "left_semi")
    rows = _postings(books, lines, moves)
    return _publish(store(books.spark, path), rows.withColumn(PART.name, F.concat(PART.name, F.lit(f"+{uuid.uuid4().hex}"))))


def merge(spark: SparkSession, path: str) -> Published:
    """Work the parts of added lines into those they belong to; parts without additions stay as they are."""
    table = store(spark, path)
    entries = table.entries().withColumn("base", _base())
    grown = entries.where(F.col(PART.name) != F.col("base")).select("base").distinct()
    mine = entries.join(grown, "base", "left_semi").drop("base")
    rows = table.read(mine).withColumn(PART.name, _base()).distinct()
    return _publish(table, rows, mine.select(PART.name))


def _base() -> Column:
    return F.substring_index(PART.name, "+", 1)


def matching(spark: SparkSession, path: str, field: str, needle: str) -> DataFrame:
    """The different texts of the field that contain the needle, ignoring case."""
    lowered = needle.lower()
    grams = sorted({lowered[i:i + GRAM] for i in range(len(lowered) - GRAM + 1)}) or [""]
    parts = {f"{field}-{'all' if g == '' else zlib.crc32(g.encode()) % BUCKETS}" for g in grams}
    table = store(spark, path)
    entries = table.entries().where(_base().isin(sorted(parts)))
    hits = table.read(entries).where((F.col("field") == field) & F.col("gram").isin(grams)).select("text", "gram").distinct()
    texts = hits.groupBy("text").count().where(F.col("count") == len(grams)).select("text")
    return texts.where(contains_ignoring_case(F.col("text"), needle))


def _restricted(frame: DataFrame, column: str, values: DataFrame, literals: int) -> DataFrame:
    """The rows whose column is among the values: by literals if these are few, else by a join."""
    few = values.limit(literals + 1).toArrow().column(0).to_pylist()
    if len(few) <= literals:
        return frame.where(F.col(column).isin(few))
    return frame.join(values.toDF(column), column, "left_semi")


def ledger_search(
    books: Books, path: str, move_name: str | None = None, ref: str | None = None, partner_id: int | None = None,
    journal_id: int | None = None, literals: int = LITERALS,
) -> DataFrame:
    """The ledger lines that ``ledger.ledger_search`` finds, with texts looked up in the index: only lines
    with a found reference or entry are read with all their columns."""
    terms = [(name, value) for name, value in (("partner_id", partner_id), ("journal_id", journal_id)) if value is not None]
    if move_name is None and ref is None:
        return ledger.ledger_search(books, **dict(terms))
    lines = books.lines
    for name, value in terms:
        lines = lines.where(F.col(name) == value)
    if ref is not None:
        lines = _restricted(lines, "ref", matching(books.spark, path, REF, ref), literals)
    if move_name is not None:
        names = matching(books.spark, path, NAME, move_name)
        ids = _restricted(books.moves, "name", names, literals).select("id").distinct()
        lines = _restricted(lines, "move_id", ids, literals)
    return ledger._balance_at(books, ledger.ledger_base(replace(books, lines=lines)))


def write_lines(books: Books, path: str, files: int | None = None) -> None:
    """Store the lines for such searches: in order of entries, with bloom filters on entry and reference."""
    ordered = books.lines.repartitionByRange(*([files] if files else []), "move_id", "id").sortWithinPartitions("move_id", "id")
    writer = ordered.write
    for column in ("move_id", "ref"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
