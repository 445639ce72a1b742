"""Quality rules by document and by host.

Each text is measured once. Every rule is a failure or not per document; failures are summed
by host, and a host's rate of failure is shrunk towards the mean of all hosts with a beta prior
whose strength is estimated from how much the hosts differ (method of moments). That rate is the
prior probability that a document of the host is junk of the rule's kind, and the document's own
outcome is evidence: junk fails with probability ``SHOWN``, other documents with ``FALSE_ALARM``. A
document whose posterior reaches a half under some rule is rejected. So a failure counts unless
the host hardly ever has one, and a document that passes goes only with a host where some nine
in ten fail.

Null text has no words. Null hosts form one host of their own. Repeated rows count each for
themselves. Without rows there are no hosts and no result. Columns other than those named are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.storage import shared_table

MIN_WORDS = 20
#: Words of a window that counts as a repetition, and the most per cent of words in repeated windows.
WINDOW, MAX_REPEATED = 8, 30
#: Rates from which a document fails the rules that only count towards its host.
MAX_SYMBOLS, MAX_DUP_LINES = 0.3, 0.5
#: Probabilities that junk of a rule's kind fails the rule, and that another document does.
SHOWN, FALSE_ALARM = 0.9, 0.01
#: The strength of the prior, as a number of documents, stays between these.
STRENGTH = 1.0, 1e6

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

RULES = ("base_failed", "symbols_failed", "lines_failed")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _repeated_words(texts: W.Texts, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in windows found twice or more in it."""
    windows = W.window_hashes(hashes, WINDOW)
    first = np.flatnonzero(text[:len(windows)] == text[WINDOW - 1:]) if len(windows) else np.empty(0, np.int64)
    keys = W.mix(windows[first] ^ W.mix(text[first].astype(np.uint64) + np.uint64(1)))
    first = first[_again(keys)]
    step = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + WINDOW, -1)
    return np.bincount(text[np.cumsum(step[:-1]) > 0], minlength=len(texts))


def _lines(texts: W.Texts, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the lines with a word, and those of them that equal an earlier line."""
    starts, ends, text = texts.runs(texts.data != 10)
    upto = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = upto[ends] > upto[starts]
    starts, ends, text = starts[full], ends[full], text[full]
    keys = W.mix(texts.hashes(starts, ends) ^ W.mix(text.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(text, minlength=len(texts))
    return lines, lines - np.bincount(text[first], minlength=len(texts))


def measure(texts: W.Texts) -> list[np.ndarray]:
    solid = W.SOLID[texts.data]
    starts, ends, text = texts.runs(solid)
    hashes = texts.hashes(starts, ends)
    lines, repeated = _lines(texts, solid)
    return [
        np.bincount(text, minlength=len(texts)),
        texts.total(solid & ((texts.data & 0xC0) != 0x80)),
        texts.total(SYMBOLS[texts.data]),
        repeated,
        _repeated_words(texts, hashes, text),
        lines,
    ]


def measures(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """The columns ``keep`` of each document and what the rules look at, in one pass over the texts."""
    source = docs.select(F.col(text_col).alias("measured_text"), *keep)
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in W.slices(batch, "measured_text"):
                found = measure(W.Texts.of(column))
                same = [batch.column(i).slice(first, len(column)) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(same + [pa.array(x, pa.int64()) for x in found], [*batch.schema.names[1:], *names])

    kept = ", ".join(f"`{c}` {kind}" for c, kind in source.dtypes[1:])
    return source.mapInArrow(run, f"{kept}, {SCHEMA}" if kept else SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def junk(rule: str) -> Column:
    """Whether a document's posterior under the rule is a half at least."""
    rate, failed = F.col(f"{rule}_rate"), F.col(rule)
    given_junk, given_other = (F.when(failed, p).otherwise(1 - p) for p in (SHOWN, FALSE_ALARM))
    return rate * given_junk >= (1 - rate) * given_other


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Each document's id, measures, failures and verdict, with its host's shrunken rates.

    The texts are read once; their measures are stored in the shared folder, since hosts and
    documents both need them."""
    rows = measures(docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("t")), "t", "id", "host")
    rows = shared_table(
        rows.withColumn("base_failed", base_failed())
        .withColumn("symbols_failed", F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"))
        .withColumn("lines_failed", F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    )
    hosts = host_rates(rows)
    return (
        rows.join(hosts.withColumnRenamed("host", "its_host"), F.col("host").eqNullSafe(F.col("its_host")))
        .withColumn("rejected", F.greatest(*(junk(rule) for rule in RULES)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))
        .drop("its_host")
        .withColumnRenamed("id", id_col)
    )


def host_rates(rows: DataFrame) -> DataFrame:
    """Per host, its documents and each rule's failure rate, shrunk with a beta prior.

    With mean m and variance v of the hosts' raw rates, the prior has strength m(1-m)/v - 1
    (within ``STRENGTH``) and mean m. The moments are one row, a scalar subquery."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.sum(F.col(rule).cast("long")).alias(rule) for rule in RULES))
    raw = hosts.select(*(F.col(rule) / F.col("host_docs") for rule in RULES)).toDF(*RULES)
    moments = raw.agg(F.struct(*(x for rule in RULES for x in (F.avg(rule).alias(f"{rule}_m"), F.var_pop(rule).alias(f"{rule}_v")))).alias("moments"))
    hosts = hosts.withColumn("moments", moments.scalar())
    for rule in RULES:
        m, v = F.col(f"moments.{rule}_m"), F.col(f"moments.{rule}_v")
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
        hosts = hosts.withColumn(f"{rule}_rate", (strength * m + F.col(rule)) / (strength + F.col("host_docs")))
    return hosts.drop("moments", *RULES)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        F.col("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
      FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g FROM w),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM g WHERE i + {WINDOW - 1} <= n),
hit AS (SELECT DISTINCT r, i + k AS i FROM twice, range({WINDOW}) t(k) WHERE twice),
rep AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
l AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
m AS (SELECT d.r, doc_id, source, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, coalesce(lines, 0) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
        n_symbols > {MAX_SYMBOLS} * word_chars AS symbols_failed, n_dup_lines > {MAX_DUP_LINES} * n_lines AS lines_failed FROM m),
h AS (SELECT source, count(*) AS n, """ + ", ".join(f"count(*) FILTER ({rule}) AS {rule}" for rule in RULES) + """ FROM f GROUP BY source),
p AS (SELECT """ + ", ".join(f"avg({rule} / n) AS {rule}_m, var_pop({rule} / n) AS {rule}_v" for rule in RULES) + """ FROM h),
s AS (SELECT """ + ", ".join(
    f"{rule}_m, CASE WHEN {rule}_v > 0 THEN least(greatest({rule}_m * (1 - {rule}_m) / {rule}_v - 1, {STRENGTH[0]}), {STRENGTH[1]}) ELSE {STRENGTH[1]} END AS {rule}_s"
    for rule in RULES) + """ FROM p),
rates AS (SELECT source, """ + ", ".join(f"({rule}_s * {rule}_m + {rule}) / ({rule}_s + n) AS {rule}_rate" for rule in RULES) + """ FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (""" + " OR ".join(
    f"{rule}_rate * CASE WHEN {rule} THEN {SHOWN} ELSE 1 - {SHOWN} END >= (1 - {rule}_rate) * CASE WHEN {rule} THEN {FALSE_ALARM} ELSE 1 - {FALSE_ALARM} END"
    for rule in RULES) + """) AS kept
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""
