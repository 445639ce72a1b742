"""Divergence audit of sources: what sets a source apart from the others of its language.

Each language keeps the terms that at least ``least_docs`` of its documents have. A group (a
language and source, or a whole language) gives a kept term with ``count`` occurrences the price
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), for N occurrences of its V kept terms.

**Pairs.** A group's kept terms lie in blocks by hash, as sorted arrays of (term id, count). Per
unordered pair of sources and block the two arrays meet in one task, by co-grouping. A galloping
intersection finds the overlap; overlaps and one-sided terms are priced there, terms that both
lack by their number alone, since each group has one price for all of them. Blocks are summed, and
the sum counts for either source.

**Terms.** The kept terms of a group that it prices over its language, highest excess first.

Terms are the letters and characters beyond ASCII between others, A-Z lower-cased. Null text,
language and source are ''. A group without kept terms still has its pairs; without any kept term
their value is 0. Repeated rows are documents of their own. Ties go to the smaller item. Without
rows there is no result. Columns other than those named are not read.

Words are counted in the tasks before the shuffle, so a source with a third of all documents sends
one row per task and term. A block has some ``BLOCK`` terms of a language, so no task holds a
vocabulary; a listed pair is part of the result. Counts may reach 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.storage import shared_table

LEAST_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Kept terms of a language in a block, more or less.
BLOCK = 32_768
#: Different terms that a task counts before it passes them on.
HELD = 250_000

#: Bytes to what they are in a term; a space where they are in none.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

GROUP = ["lang", "source"]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM).split()


def occurrences(docs: DataFrame) -> DataFrame:
    """Occurrences ``n`` and documents ``docs`` of each ``term`` by group, and a row with a null term
    for each group, from documents (lang, source, t)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                terms = [None, *n]
                for at in range(0, len(terms), 50_000):
                    part = terms[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64()),
                    ], [*GROUP, "term", "n", "docs"])
            found.clear()

        held = 0
        for batch in batches:
            for first, column in W.slices(batch, "t"):
                groups = zip(*(batch.column(i).slice(first, len(column)).to_pylist() for i in (0, 1)))
                for group, text in zip(groups, column.cast(pa.large_binary()).to_pylist()):
                    n, docs = found.setdefault(group, (Counter(), Counter()))
                    terms = terms_of(text)
                    held -= len(n) - 1
                    n.update(terms)
                    docs.update(set(terms))
                    held += len(n)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    counted = docs.select(*GROUP, "t").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column) -> Column:
    """Exact, for ``total`` = N + PRIOR * V; null where no term is kept."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR)
    return F.when(total > 0, F.call_function("div", scaled, total) + 1).cast("long")


def prices(counts: np.ndarray, total: int) -> np.ndarray:
    """The same in numpy: the quotient in three steps of a thousand, each within 64 bits."""
    rest = counts + PRIOR
    out, rest = rest // total, rest % total
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` its first place in ``long`` with no smaller value; both ascend.

    All start at once from their share of the way, stride out in doubled steps until they have
    their place between two strides, and halve that range."""
    n = len(long)
    low = np.arange(len(short)) * n // max(1, len(short))
    high, step = low.copy(), 1
    while len(back := np.flatnonzero((low > 0) & (long[np.maximum(low - 1, 0)] >= short) if n else [])):
        low[back] = np.maximum(low[back] - step, 0)
        step *= 2
    step = 1
    while len(on := np.flatnonzero((high < n) & (long[np.minimum(high, n - 1)] < short) if n else [])):
        high[on] = np.minimum(high[on] + step, n)
        step *= 2
    while len(wide := np.flatnonzero(low < high)):
        middle = (low[wide] + high[wide]) // 2
        less = long[middle] < short[wide]
        low[wide[less]], high[wide[~less]] = middle[less] + 1, middle[~less]
    return low


def merge(ids: np.ndarray, counts: np.ndarray, total: int, other_ids: np.ndarray, other_counts: np.ndarray, other_total: int) -> tuple[int, int]:
    """The summed price differences over all terms that either side has, and how many those are."""
    if len(ids) > len(other_ids):
        return merge(other_ids, other_counts, other_total, ids, counts, total)
    mine, theirs = prices(counts, total), prices(other_counts, other_total)
    none, other_none = (int(prices(np.zeros(1, np.int64), t)[0]) for t in (total, other_total))
    place = gallop(ids, other_ids)
    both = place < len(other_ids)
    both[both] = other_ids[place[both]] == ids[both]
    alone = np.ones(len(other_ids), bool)
    alone[place[both]] = False
    value = np.abs(mine[both] - theirs[place[both]]).sum() + np.abs(mine[~both] - other_none).sum() + np.abs(theirs[alone] - none).sum()
    return int(value), len(ids) + int(alone.sum())


PAIR = ["lang", "left", "right"]


def _merged(left: pa.Table, right: pa.Table) -> pa.Table:
    """One pair of sources in one block of terms; a side without terms there has no row."""
    keys = left if left.num_rows else right
    total, other_total = (keys.column(c)[0].as_py() for c in ("left_total", "right_total"))
    arrays = [np.asarray(t.column(c).combine_chunks().flatten()).astype(np.int64) for t in (left, right) for c in ("ids", "counts")]
    value, terms = merge(*arrays[:2], total, *arrays[2:], other_total)
    return pa.table({**{c: keys.column(c) for c in PAIR}, "value": [value], "terms": [terms]})


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``value`` of each ordered pair (lang, source, item) of sources of a language, from its groups'
    kept terms ``rows`` (lang, source, block, id, n) and ``groups`` (lang, source, v, total)."""
    arrays = rows.groupBy(*GROUP, "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms")).select(
        *GROUP, "block", F.col("terms.id").alias("ids"), F.col("terms.n").alias("counts")
    )
    left = groups.select("lang", F.col("source").alias("left"), "v", F.col("total").alias("left_total"))
    right = groups.select("lang", F.col("source").alias("right"), F.col("total").alias("right_total"))
    pairs = left.join(right, "lang").where(F.col("left") < F.col("right"))
    wanted = pairs.select(*PAIR, "left_total", "right_total")
    sides = [wanted.join(arrays.withColumnRenamed("source", side), ["lang", side]) for side in ("left", "right")]
    left, right = (df.toDF(*df.columns).groupBy(*PAIR, "block") for df in sides)
    merged = left.cogroup(right).applyInArrow(_merged, "lang string, left string, right string, value long, terms long")
    sums = merged.groupBy(*PAIR).agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    zero = F.lit(0).cast("long")
    absent = (F.col("v") - F.coalesce("terms", zero)) * F.abs(price(zero, F.col("left_total")) - price(zero, F.col("right_total")))
    whole = pairs.join(sums, PAIR, "left").select(*PAIR, (F.coalesce("value", zero) + F.coalesce(absent, zero)).alias("value"))
    both_ways = F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item"))))
    return whole.select("lang", "value", both_ways.alias("way")).select("lang", "way.source", "way.item", "value")


def term_values(rows: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group by the excess of its price over its language's."""
    excess = price(F.col("n"), F.col("total")) - price(F.col("lang_n"), F.col("lang_total"))
    priced = rows.join(groups, GROUP).select(*GROUP, F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    return ranked(priced).where(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has each other source of the language,
    part ``term`` the group's ``top`` terms."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = shared_table(occurrences(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("t"))))
    terms = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = shared_table(terms.where(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), (F.sum("lang_n") + PRIOR * F.count("*")).alias("lang_total"))
    most = langs.agg(F.coalesce(F.max("v"), F.lit(0))).first()[0]
    number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
    blocks = F.pmod(F.xxhash64("term"), F.lit(-(-most // block) or 1)).cast("int")
    numbered = kept.withColumn("block", blocks).withColumn("id", number)
    rows = shared_table(found.join(numbered, ["lang", "term"]).select(*GROUP, "term", "block", "id", "n", "lang_n"))
    sums = rows.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    v = F.coalesce("v", F.lit(0).cast("long"))
    groups = found.where("term IS NULL").select(*GROUP).join(sums, GROUP, "left").join(langs, "lang", "left").select(
        *GROUP, v.alias("v"), (F.coalesce("n", F.lit(0)) + PRIOR * v).alias("total"), "lang_total"
    )
    groups = shared_table(groups)
    pairs = ranked(pair_values(rows, groups)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(term_values(rows, groups, top).withColumn("part", F.lit("term"))).select(
        *GROUP, "part", "item", "value", "rank"
    )


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_all FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) s USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
        1 + CAST({SCALE} AS HUGEINT) * (coalesce(n, 0) + {PRIOR}) // (CAST(total AS HUGEINT) + {PRIOR} * v) AS p,
        1 + CAST({SCALE} AS HUGEINT) * (lang_n + {PRIOR}) // (CAST(lang_all AS HUGEINT) + {PRIOR} * v) AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
everything AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM everything)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranks WHERE part = 'pair' OR rank <= {TOP}
"""
