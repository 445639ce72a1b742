"""Runs of words that repeat with a period, by a sparse diagonal recurrence.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``TIMES`` periods
long, that no neighbouring word extends. Word i lies on the diagonal of lag q if it equals word
i - q; along a run its diagonal is matched for length - q words, so for 16 words at the least.

For each word its earlier occurrences extend the match lengths of their lags, and a lag that is not
extended ends and emits its run. Two facts keep that sparse, whatever the text:

* An occurrence counts only if the ``w`` words from there on agree as well (w = 16, 32, 64, ...,
  for periods up to 16, 32, ...): a run has 3 periods, so w words match along its diagonal.
* Of those only the nearest counts. Inside a run of smallest period q no w >= q words recur at a
  smaller lag, so the nearest occurrence is the run's own; and where it is, q is the smallest period.

So a word extends one lag per level of w, and only words that recurred with w words go on to 2 * w:
work and memory are n log n also for a text of one repeated word. The recurrence is evaluated for
all texts of a slice side by side: a match length is the number of consecutive words with one lag.

64-bit hashes stand for words and windows. Null text has no words. Repeated rows count each for
themselves. A document without id is not rewritten. Without rows there is no result. Columns other
than those named are not read. Each text is handled on its own, in one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W

#: Fewest words and periods of a run.
LEAST, TIMES = 24, 3
#: Words that match along any run's diagonal: the least of max(LEAST - q, (TIMES - 1) * q).
WINDOW = 16
#: Words that are written out at once.
JOINED = 1 << 18

SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _nearest(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key's nearest equal before it (-1: none), and whether it occurs elsewhere at all."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    before = np.full(len(keys), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    twice = before >= 0
    twice[order[:-1][same]] = True
    return before, twice


def runs_of(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start (a word of ``words``), length and period of all runs, from word hashes and the ascending
    numbers of the texts they are in; ordered by start, then period."""
    n, found = len(words), []
    ends = np.searchsorted(text, text, side="right")  # where a word's text ends
    keys = W.mix(words ^ W.mix(text.astype(np.uint64) + np.uint64(1)))
    size = 1
    while size < WINDOW:
        keys = W.mix(keys[:max(0, len(keys) - size)] * np.uint64(0xD6E8FEB86659FD93) + keys[size:])
        size *= 2
    places = np.flatnonzero(np.arange(len(keys)) + size <= ends[:len(keys)])
    keys = keys[places]
    while len(places):
        before, twice = _nearest(keys)
        lag = np.where(before >= 0, places - places[before], 0)
        here = np.flatnonzero((lag > (0 if size == WINDOW else size // 2)) & (lag <= size))
        # A diagonal goes on while the next word has the same lag.
        at, lags = places[here], lag[here]
        first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(lags, prepend=0) != 0))
        matched = np.diff(np.append(first, len(at))) + size - 1
        period = lags[first]
        length = matched + period
        long = length >= np.maximum(LEAST, TIMES * period)
        found.append((at[first][long] - period[long], length[long], period[long]))
        # Only windows whose halves both recur can recur at twice the size.
        dense = np.zeros(n, np.uint64)
        dense[places] = keys
        again = np.zeros(n + 1, bool)
        again[places[twice]] = True
        places = places[twice]
        places = places[places + 2 * size <= ends[places]]
        places = places[again[places + size]]
        keys = W.mix(dense[places] * np.uint64(0xD6E8FEB86659FD93) + dense[places + size])
        size *= 2
    start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) == 0


def rewritten(first: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """For the words of texts that begin at ``first`` (and end there: one more), which word stands in
    their place. By crc32 of its id, a tenth of the documents repeats a stretch up to its end."""
    at = np.arange(first[-1])
    for i, key in enumerate(ids):
        if key is None:
            continue
        h, n = zlib.crc32(str(key).encode()), int(first[i + 1] - first[i])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[first[i] + a:first[i + 1]] = first[i] + a + np.arange(n - a) % p
    return at


def joined_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> list[str]:
    """sha256 of each text's words (spans of ``data``) joined by single spaces."""
    digests = [hashlib.sha256() for _ in range(n)]
    padded = np.append(data, np.uint8(32))
    for at in range(0, len(starts), JOINED):
        a, b, owner = starts[at:at + JOINED], ends[at:at + JOINED], text[at:at + JOINED]
        size = b - a + 1  # a space, and the word
        upto = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(upto[-1]) + np.repeat(a - 1 - upto[:-1], size)
        source[upto[:-1]] = len(data)
        out = padded[source]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for i, j in zip(cuts, np.append(cuts[1:], len(owner))):
            new = at + i == 0 or text[at + i - 1] != owner[i]
            digests[owner[i]].update(out[upto[i] + new:upto[j]])
    return [d.hexdigest() for d in digests]


def measure(texts: W.Texts, ids: list[int | None] | None = None) -> list[list]:
    """The columns of ``SCHEMA`` for each text; with ``ids``, of the texts as ``rewritten``."""
    starts, ends, text = texts.runs(W.SOLID[texts.data])
    hashes = texts.hashes(starts, ends)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    if ids is not None:
        at = rewritten(first, ids)
        starts, ends, hashes = starts[at], ends[at], hashes[at]
    start, length, period = runs_of(hashes, text)
    kept = kept_words(len(hashes), start, length, period)
    collapsed = joined_digests(texts.data, starts[kept], ends[kept], text[kept], len(texts))
    own = np.searchsorted(start, first)
    start, length, period = start.tolist(), length.tolist(), period.tolist()
    rows = []
    for i in range(len(texts)):
        best, listed = None, []
        for s, l, p in zip(*(x[own[i]:own[i + 1]] for x in (start, length, period))):
            s -= int(first[i])
            listed.append(f"{s},{l},{p}\n")
            if best is None or l * best[2] > best[1] * p:
                best = s, l, p
        exponent = None if best is None else 1000 * best[1] // best[2]
        rows.append((len(listed), *(best or (None,) * 3), exponent, hashlib.sha256("".join(listed).encode()).hexdigest(), collapsed[i]))
    return [list(x) for x in zip(*rows)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """Per document its number of runs, the one with most periods, and digests of all runs and of the
    text with repetitions removed. With ``rewrite``, of the texts as ``rewritten``."""
    types = [pa.int64()] * 5 + [pa.string()] * 2
    names = ["id", *(part.split()[0] for part in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in W.slices(batch, "t"):
                ids = batch.column(0).slice(first, len(column))
                made = measure(W.Texts.of(column), ids.to_pylist() if rewrite else None)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, made, types)], names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"id {source.dtypes[0][1]}, {SCHEMA}").withColumnRenamed("id", id_col)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=True)
