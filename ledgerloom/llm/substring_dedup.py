"""Substring dedup by hashing units of text: sentences within lines.

A unit ends at a line feed, or at white space after ``.``, ``!`` or ``?``. It is normalised to its
words (lower-cased A-Z, digits, all beyond ASCII; punctuation and spacing do not count) and
reduced to a 128-bit digest. Digests are grouped over all documents. The earliest unit of a
digest, by row key and then place in the text, stays. The others are removed where they stand in
a run of consecutive repeated units with ``min_words`` words in all, so that short sentences that
documents share by chance remain. Offsets are bytes of the original UTF-8 text. Units without a
word (blank lines, rules, indents) are never repeats themselves. With ``over_blanks``, as in the
registered query and the pipeline, a run goes on over them and takes them with it, so that a
passage in short paragraphs counts as a whole; without it they end a run.

Repeats within one document count like those between documents. Null text stays null and empty
text empty, both without units; a text may become empty. Ties cannot occur, since row keys
differ: repeated rows and null ids are numbered first. Without rows there is no result. All
columns of the documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.storage import free_name, shared_table, with_row_key

MIN_WORDS = 20

UNITS = "row long, unit long, first long, last long, n_words long, h1 long, h2 long, again boolean"
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def unit_ends(texts: W.Texts) -> np.ndarray:
    """Where units end, the ends of texts included: after the white space that follows a stop, or after a line feed."""
    data = texts.data
    space = ~W.SOLID[data]
    after = np.zeros(len(data), bool)  # white space that goes back to a stop
    starts, ends, _ = texts.runs(space)
    closing = starts[starts > 0]
    stopped = np.zeros(len(starts), bool)
    stopped[starts > 0] = STOP[data[closing - 1]] & ~np.isin(closing, texts.offsets)
    after[ends[stopped] - 1] = True
    cuts = np.flatnonzero(after | (data == 10)) + 1
    return np.unique(np.concatenate([cuts, texts.offsets[1:][np.diff(texts.offsets) > 0]]))


def units_of(texts: W.Texts, over_blanks: bool = False) -> tuple[np.ndarray, ...]:
    """Text, number, start and end in the text, words and digest of each unit that has a word, and
    whether an earlier unit of the same text has that digest. With ``over_blanks``, units without
    a word have no number."""
    ends = unit_ends(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    owner = texts.text_of(starts)
    number = np.arange(len(starts)) - np.searchsorted(owner, owner)
    a, b, _ = texts.runs(W.ALNUM[texts.data])
    unit = np.searchsorted(ends, a, side="right")
    count = np.bincount(unit, minlength=len(starts))
    full = np.flatnonzero(count)
    if over_blanks:
        number[full] = np.arange(len(full)) - np.searchsorted(owner[full], owner[full])
    first = (np.cumsum(count) - count)[full]
    words = texts.hashes(a, b, W.LOWER)
    nth = np.arange(len(words)) - np.repeat(first, count[full])
    digests = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        place = W.mix(nth.astype(np.uint64) + np.uint64(seed))
        each = W.mix(words ^ place) * (place | np.uint64(1))
        digests.append(W.mix(np.add.reduceat(each, first) if len(first) else np.empty(0, np.uint64)) + count[full].astype(np.uint64))
    at = texts.offsets[owner[full]]
    again = np.ones(len(full), bool)
    again[np.unique(np.stack([owner[full].astype(np.uint64), *digests], axis=1), axis=0, return_index=True)[1]] = False
    return owner[full], number[full], starts[full] - at, ends[full] - at, count[full], *(d.view(np.int64) for d in digests), again


def units(docs: DataFrame, key: str, text_col: str, over_blanks: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in UNITS.split(", ")]
        for batch in batches:
            for first, column in W.slices(batch, "t"):
                owner, *rest = units_of(W.Texts.of(column), over_blanks)
                rows = batch.column(0).slice(first, len(column)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([rows, *map(pa.array, rest)], names)

    return docs.select(F.col(key).alias("row"), F.col(text_col).alias("t")).where("t != ''").mapInArrow(run, UNITS)


def removals(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` and its removed ``spans`` (first, last), in order.

    The earliest document of a digest is a grouped minimum, made of partial minima, so a digest
    of any number of units is one row. It is stored before the units are joined with it, so that
    the join alone decides how they are dealt out, and may split a frequent digest's rows."""
    earliest = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("row").alias("kept")).where("n > 1").drop("n")
    again = found.join(shared_table(earliest), ["h1", "h2"]).where(F.col("again") | (F.col("row") != F.col("kept")))
    by_row = Window.partitionBy("row").orderBy("unit")
    runs = again.withColumn("run", F.col("unit") - F.row_number().over(by_row)).groupBy("row", "run")
    spans = runs.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_words").alias("words")).where(F.col("words") >= min_words)
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _cut(text: str, spans: list[dict]) -> str:
    data, at, kept = text.encode(), 0, []
    for span in spans:
        kept.append(data[at:span["first"]])
        at = span["last"]
    return b"".join([*kept, data[at:]]).decode()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, over_blanks: bool = False) -> DataFrame:
    """The documents with repeated passages cut out of their text, and in ``removed_spans`` where they
    were (an array of first and last byte offset, empty where nothing was cut)."""
    keyed, key = with_row_key(docs, id_col)
    found = shared_table(units(keyed, key, text_col, over_blanks))
    span_col = free_name(docs, "removed_spans")
    gone = removals(found, min_words).withColumnRenamed("row", key).withColumnRenamed("spans", span_col)
    joined = keyed.join(gone, key, "left").drop(key)
    at, where = joined.columns.index(text_col), joined.columns.index(span_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, columns = batch.column(where), list(batch.columns)
            texts = columns[at].to_pylist()
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                texts[i] = _cut(texts[i], spans[int(i)].as_py())
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    changed = joined.mapInArrow(run, joined.schema)
    none = F.array().cast(joined.schema[span_col].dataType)
    return changed.withColumn(span_col, F.coalesce(span_col, none))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = dedup(docs, over_blanks=True)
    return found.select("doc_id", "text", "removed_spans", F.size("removed_spans").cast("long").alias("n_removed"))
