"""Benchmark decontamination with a distributed positional inverted index.

The documents are cut into segments of consecutive rows. Each segment is indexed where it is
read: its words' hashes are sorted, and every term gets one posting list of positions, stored
as deltas in a variable number of bytes. Terms and documents of all segments form one table, in
term order within a segment, so a search reads the lists of its terms only, and builds them
without moving a text.

A search takes phrases (windows of benchmark words). Within a segment, whose size is bounded,
the lists of a phrase's words are shifted by the word's offset and intersected, the rarest
first; a phrase with a word that the segment lacks costs nothing. With ``slop`` s, the words may
each stray by up to s positions from where the rarest one puts them: a proximity match. Phrases
come in blocks of bounded size, each searched against all documents; the blocks' matches are
merged per indexed document, told by its segment and place in it, whatever its id.

Words are ``[0-9a-z]`` and everything beyond ASCII, after lower-casing A-Z. A benchmark item
gives every ``size`` consecutive words, or all its words if it has fewer. Null and empty texts
have no words: such documents hit nothing, such items are not searched. Repeated documents are
matched each for itself, repeated items count once. An item without id hits words, but is not
in the list of items. Without benchmark rows no document is hit; columns other than id and text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.storage import shared_table

SIZE = 10
#: Positions by which the words of a window may stray in the query's proximity matches.
SLOP = 2
#: Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT = 8 << 20
#: Free positions between two documents of a segment; twice the slop and the window size together must stay below.
GAP = 64
#: Bytes of benchmark text that are searched for at once.
PHRASES = 4 << 20

INDEX = "segment long, term long, postings binary, base long, doc long, n_words long"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in seven bits a byte, the highest bit set on all but a number's last byte; and each one's first byte."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for shift in (7, 14, 21, 28, 35, 42):
        size += values >= np.uint64(1 << shift)
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(first[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > k)
        more = np.where(size[rows] > k + 1, np.uint8(128), np.uint8(0))
        out[first[rows] + k] = (values[rows] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out, first


def decode(data: bytes) -> np.ndarray:
    """The positions of a posting list."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(raw)) - np.repeat(first, last - first + 1)) * 7
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << shift, first))


def _segment(number: int, docs: pa.Array, texts: W.Texts) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: its documents, then its terms in order."""
    starts, ends, text = texts.runs(W.ALNUM[texts.data])
    count = np.bincount(text, minlength=len(texts))
    base = np.cumsum(count) - count + np.arange(len(texts)) * GAP
    place = np.arange(len(starts)) + text * GAP
    terms = texts.hashes(starts, ends, W.LOWER).view(np.int64)

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"segment": pa.int64(), "term": pa.int64(), "postings": pa.binary(), "base": pa.int64(), "doc": pa.int64(), "n_words": pa.int64()}
        columns["segment"] = pa.array(np.full(n, number))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()], list(kinds))

    yield rows(len(texts), base=pa.array(base), doc=docs, n_words=pa.array(count))
    order = np.argsort(terms, kind="stable")
    terms, place = terms[order], place[order]
    cuts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
    deltas = np.diff(place, prepend=0)
    deltas[cuts] = place[cuts]
    data, first = encode(deltas)
    bounds = np.append(first[cuts], len(data)).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    for at in range(0, len(cuts), 50_000):
        part = slice(at, at + 50_000)
        yield rows(len(cuts[part]), term=pa.array(terms[cuts[part]]), postings=pa.concat_arrays([lists[part]]))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The stored index: rows of documents (``term`` null) and of terms with their postings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, column in W.slices(batch, "t", segment):
                yield from _segment(number, batch.column(0).slice(first, len(column)), W.Texts.of(column))
                number += 1

    return shared_table(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t")).mapInArrow(run, INDEX))


class Phrases:
    """Word windows of benchmark items: their terms, lengths and items."""

    def __init__(self, items: list[str | None], texts: list[str | None], size: int):
        own = W.Texts.of(pa.array([t or "" for t in texts], pa.large_string()))
        starts, ends, text = own.runs(W.ALNUM[own.data])
        terms = own.hashes(starts, ends, W.LOWER).view(np.int64)
        count = np.bincount(text, minlength=len(items))
        windows = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
        self.names = items
        self.item = np.repeat(np.arange(len(items)), windows)
        nth = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.first = (np.cumsum(count) - count)[self.item] + nth
        self.length = np.minimum(count, size)[self.item]
        self.vocabulary, self.word = np.unique(terms, return_inverse=True)

    def matches(self, terms: np.ndarray, postings: list[bytes], slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Number of a phrase, first positions of its proximity matches, a position by which each one's
        document is told, and which of them are exact."""
        at = np.minimum(np.searchsorted(terms, self.vocabulary), max(len(terms) - 1, 0))
        here = terms[at] == self.vocabulary if len(terms) else np.zeros(len(self.vocabulary), bool)
        lacking = np.concatenate([[0], np.cumsum(~here[self.word])])
        lists: dict[int, np.ndarray] = {}
        for p in np.flatnonzero(lacking[self.first + self.length] == lacking[self.first]):
            own = self.word[self.first[p]:self.first[p] + self.length[p]]
            for word in own:
                if word not in lists:
                    lists[word] = decode(postings[at[word]])
            order = sorted(range(len(own)), key=lambda k: len(lists[own[k]]))
            found = lists[own[order[0]]] - order[0]
            if slop:
                found = np.unique(found[:, None] + np.arange(-slop, slop + 1))
            exact = np.ones(len(found), bool)
            for k in order if slop else order[1:]:
                if not len(found):
                    break
                other = lists[own[k]] - k
                near = other[np.minimum(np.searchsorted(other, found - slop), len(other) - 1)]
                good = (near >= found - slop) & (near <= found + slop)
                there = other[np.minimum(np.searchsorted(other, found), len(other) - 1)] == found
                found, exact = found[good], (exact & there)[good]
            if len(found):
                yield int(p), found, found + order[0] + slop, exact


def _search_block(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    spark = index.sparkSession
    kinds = pa.schema([("segment", pa.int64()), ("base", pa.int64()), ("doc", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())),
                       ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])

    def run(segment: pa.Table) -> pa.Table:
        is_doc = segment.column("doc_row").to_numpy()
        docs = segment.filter(pa.array(is_doc)).sort_by("base")
        terms = segment.filter(pa.array(~is_doc)).sort_by("term")
        base, n = docs.column("base").to_numpy(), docs.num_rows
        items, near, spans = {}, {}, {}
        for p, found, anchor, exact in phrases.matches(terms.column("term").to_numpy(), terms.column("postings").to_pylist(), slop):
            owner = np.searchsorted(base, anchor, side="right") - 1
            name, length = phrases.names[phrases.item[p]], int(phrases.length[p])
            for doc in np.unique(owner).tolist():
                near.setdefault(doc, set()).add(name)
            for doc, position in zip(owner[exact].tolist(), found[exact].tolist()):
                items.setdefault(doc, set()).add(name)
                own, start = spans.setdefault(doc, []), position - int(base[doc])
                own.append((start, start + length))
        as_list = lambda held: [sorted(x for x in held.get(i, ()) if x is not None) for i in range(n)]
        ranges = [[{"first": a, "last": b} for a, b in _merged(spans.get(i, []))] for i in range(n)]
        return pa.table([docs.column("segment"), docs.column("base"), docs.column("doc"), docs.column("n_words"), pa.array(as_list(items), kinds.field("items").type),
                         pa.array(as_list(near), kinds.field("items").type), pa.array(ranges, kinds.field("spans").type)], schema=kinds)

    wanted = spark.createDataFrame(pa.table({"term": phrases.vocabulary}))
    terms = index.where("term IS NOT NULL").join(wanted, "term", "left_semi").select("segment", "term", "postings", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("n_words"))
    docs = index.where("term IS NULL").select("segment", F.lit(0).cast("long").alias("term"), F.lit(None).cast("binary").alias("postings"), "base", "doc", "n_words")
    both = docs.withColumn("doc_row", F.lit(True)).unionByName(terms.withColumn("doc_row", F.lit(False)))
    return both.groupBy("segment").applyInArrow(run, "segment long, base long, doc long, n_words long, items array<string>, near_items array<string>, spans array<struct<first: long, last: long>>")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def search(index: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = 0, item_col: str = "item_id", text_col: str = "text", block: int = PHRASES) -> DataFrame:
    """One row per indexed document: ``doc``, ``n_words``, ``items`` with exact phrases in it,
    ``near_items`` with proximity matches (exact ones included), the hit word ranges ``spans``
    (first, end) and ``n_hit``, the words in them.

    The phrases of a block of the benchmark, at most about ``block`` bytes of text, are sent to
    the tasks; a larger benchmark takes several passes over the index's matching lists."""
    if not 0 <= 2 * slop < GAP - size:
        raise ValueError(f"twice the slop and size together must stay below {GAP}")
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block) or 1
    found = None
    for i in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).toArrow()
        part = _search_block(index, Phrases(own.column("item").to_pylist(), own.column("text").to_pylist(), size), slop)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = found.groupBy("segment", "base").agg(F.max("doc").alias("doc"), F.max("n_words").alias("n_words"), together("items").alias("items"), together("near_items").alias("near_items"), together("spans").alias("spans"))
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct((a.n + F.greatest(s.last - F.greatest(s.first, a.upto), F.lit(0))).alias("n"), F.greatest(a.upto, s.last).alias("upto")),
        lambda a: a.n,
    )
    return found.drop("segment", "base").withColumn("n_hit", hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, slop: int = 0) -> DataFrame:
    """Index the documents and search them for the benchmark: one row per document, also of repeated and null ids."""
    return search(build_index(docs, id_col, text_col), benchmark, size, slop).withColumnRenamed("doc", id_col)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Proximity: the places that a phrase's rarest word allows, each held against all the other words.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT item, ws[k:k + least(len(ws), {SIZE}) - 1] AS phrase FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {SIZE - 1}, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT len(phrase) AS n FROM p),
w AS (SELECT r, n, k, ws[k:k + n - 1] AS phrase FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, n WHERE len(ws) >= n)),
hit AS (SELECT r, n, k, item FROM w JOIN p USING (phrase)),
words AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(k, k + n)) AS i FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r),
o AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM d),
f AS (SELECT word, count(*) AS n FROM o GROUP BY word),
a AS (SELECT item, phrase, arg_min(k, n) AS k, arg_min(word, n) AS word
    FROM (SELECT item, phrase, generate_subscripts(phrase, 1) AS k, unnest(phrase) AS word FROM p) JOIN f USING (word)
    GROUP BY item, phrase HAVING count(*) = len(phrase)),
c AS (SELECT DISTINCT r, item, phrase, i - k + unnest(range(-{SLOP}, {SLOP + 1})) AS place FROM a JOIN o USING (word)),
g AS (SELECT r, item, phrase, place, ws[greatest(1, place + 1 - {SLOP}):greatest(0, place + len(phrase) + {SLOP})] AS own FROM c JOIN d USING (r)),
m AS (SELECT r, item, place, phrase, ws FROM g JOIN d USING (r) WHERE list_has_all(own, phrase)),
near AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m
    WHERE len(list_filter(range(1, len(phrase) + 1), lambda k: NOT list_contains(ws[greatest(1, place + k - {SLOP}):greatest(0, place + k + {SLOP})], phrase[k]))) = 0 GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated,
    CAST(coalesce(near.n, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near.s, '')) AS near_items_sha256
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""
