"""Near-duplicates by SimHash: fingerprints, links of few differing bits, and their components.

A fingerprint bit is the majority of that bit over the XXH64 hashes of all word shingles of a
text. Two fingerprints are linked if at most ``bits`` of 64 differ; documents are grouped by the
transitive closure of the links.

Candidates come from the pigeonring principle. Cut the 64 bits into m = bits + 1 segments on a
ring. Of any linked pair some segment starts a chain in which the first l segments together
differ in at most l * bits / m bits, for every l. So the first segment is equal, and the first
two differ in at most one bit: fingerprints are grouped by the first segment and the second
with one bit masked. Within a group the chain's longer prefixes are tested, then the whole
distance. Only a spanning forest of a group's links leaves a task, never all its pairs. A group
of over ``BLOCK`` fingerprints is cut into blocks, whose pairs other tasks compare.

Null text has no words, no words make fingerprint zero, and zero is linked like any other.
Equal fingerprints, and so repeated rows and empty texts, share a component. A null id counts
for nothing in the smallest id of a component; a component of null ids has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.storage import shared_table

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints that are compared with each other at once.
BLOCK = 16384
#: Rows of sorted groups that a task holds before it compares them.
HELD = 1 << 17
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def _joined(texts: W.Texts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts lower-cased, with one space after each word; start, end and text of each word."""
    solid = W.SOLID[texts.data]
    starts, ends, text = texts.runs(solid)
    keep = solid.copy()
    n = len(keep)
    gap = ends[ends < n]
    keep[gap] = True  # the byte after a word: white space, or the next text's first word
    place = np.cumsum(keep)
    data = np.where(solid, W.LOWERED[texts.data], np.uint8(32))[keep].tobytes()
    return data, place[starts] - 1 if n else starts, place[ends - 1] if n else ends, text


def fingerprints_of(texts: W.Texts, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text, unsigned."""
    data, starts, ends, text = _joined(texts)
    out = np.zeros(len(texts), np.uint64)
    words = np.bincount(text, minlength=len(texts))
    upto = np.concatenate([[0], np.cumsum(words)])
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)  # shingles of each text
    number = np.repeat(np.arange(len(texts)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(len(number)) - first[number]
    begin = upto[number] + nth
    until = begin + np.minimum(words[number], shingle) - 1
    a, b = starts[begin].tolist(), ends[until].tolist()
    # a text of many shingles spans several runs of this loop
    ones = np.zeros((len(texts), 64), np.int64)
    for at in range(0, len(a), COUNTED):
        pieces = [data[x:y] for x, y in zip(a[at:at + COUNTED], b[at:at + COUNTED])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = number[at:at + COUNTED]
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cuts]] += _column_sums(bits, cuts)
    set_bits = 2 * ones > count[:, None]
    out[:] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel() if len(texts) else out
    return out


def _column_sums(bits: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows between cuts. Up to 255 rows are added as bytes, eight to a 64-bit number."""
    sizes = np.diff(np.append(cuts, len(bits)))
    nth = np.arange(len(bits)) - np.repeat(cuts, sizes)
    parts = np.flatnonzero(nth % 255 == 0)
    sums = np.add.reduceat(bits.view(np.uint64), parts, axis=0).view(np.uint8).astype(np.int64)
    return np.add.reduceat(sums, np.searchsorted(parts, cuts), axis=0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a signed long) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in W.slices(batch, "t"):
                found = fingerprints_of(W.Texts.of(column), shingle, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(column)), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def segments(parts: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of the 64 bits."""
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def _rings(bits: int) -> np.ndarray:
    """By segment and length, the mask of the chain of so many segments that starts there."""
    parts = segments(bits + 1)
    out = np.zeros((len(parts), len(parts)), np.uint64)
    for i in range(len(parts)):
        chain = 0
        for step in range(len(parts)):
            chain |= _mask(*parts[(i + step) % len(parts)])
            out[i, step] = chain
    return out


def group_keys(fps: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """The group keys of each fingerprint: segment, masked bit and what the first two segments hold without it.

    The first 6 + 6 bits of a key number the chain and the masked bit, so keys of different
    kinds never meet; the rest is a hash of the content, told apart again by ``_linked``."""
    parts = segments(bits + 1)
    for i, part in enumerate(parts):
        if bits == 0:
            yield W.mix(fps) >> np.uint64(12)
            continue
        second = parts[(i + 1) % len(parts)]
        both = _mask(*part) | _mask(*second)
        for j in range(second[1]):
            content = fps & np.uint64(both & ~(1 << (second[0] + j)))
            yield (W.mix(content) >> np.uint64(12)) | np.uint64((i << 58) | (j << 52))


def _linked(x: np.ndarray, keys: np.ndarray | np.uint64, bits: int, rings: np.ndarray) -> np.ndarray:
    """Positions of the differences ``x`` that pass the chain of their key's segment at every length,
    the last of which is the whole distance.

    Keys of masked bit 0 take pairs that differ there or nowhere in the second segment, the others
    only those that differ in their bit, so that no pair is compared for each masked bit."""
    rows = np.arange(len(x))
    if bits == 0:
        return rows[x == 0]
    chain = np.broadcast_to((keys >> np.uint64(58)).astype(np.int64), len(x))
    masked = np.broadcast_to(keys >> np.uint64(52) & np.uint64(63), len(x))
    second = np.roll(np.array([first for first, _ in segments(bits + 1)], np.uint64), -1)
    rows = rows[(masked == 0) | (x >> second[chain] + masked & np.uint64(1) == 1)]
    for length in range(1, bits + 2):
        differ = np.bitwise_count(x[rows] & rings[chain[rows], length - 1]).astype(np.int64)
        rows = rows[differ * (bits + 1) <= length * bits]
    return rows


def _labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest position that each of ``n`` is connected with, by the links a-b and earlier ``labels``."""
    labels = np.arange(n) if labels is None else labels
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with one link per node: from the smallest of its component."""
    nodes = np.unique(np.concatenate([a, b]))
    labels = _labels(len(nodes), np.searchsorted(nodes, a), np.searchsorted(nodes, b))
    own = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[labels[own]], nodes[own]


def _compare(left: np.ndarray, right: np.ndarray | None, key: int, bits: int, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within ``left``, or between ``left`` and ``right``."""
    both = left if right is None else np.concatenate([left, right])
    labels = np.arange(len(both))
    others, shift = (left, 0) if right is None else (right, len(left))
    for at in range(0, len(left), 64):
        rows = left[at:at + 64]
        start = at if right is None else 0
        x = rows[:, None] ^ others[None, start:]
        a, b = np.divmod(_linked(x.ravel(), np.uint64(key), bits, rings), x.shape[1])
        labels = _labels(len(both), a + at, b + start + shift, labels)
    own = np.flatnonzero(labels != np.arange(len(both)))
    return both[labels[own]], both[own]


def _small_groups(keys: np.ndarray, fps: np.ndarray, bits: int, rings: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of at most ``most`` rows, all groups at once: rows are compared with
    the next, the one after that, and so on while the key is the same."""
    out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    rows = np.arange(len(keys))
    for shift in range(1, most):
        rows = rows[rows + shift < len(keys)]
        rows = rows[keys[rows] == keys[rows + shift]]
        if not len(rows):
            break
        near = rows[_linked(fps[rows] ^ fps[rows + shift], keys[rows], bits, rings)]
        out_a.append(fps[near])
        out_b.append(fps[near + shift])
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame, bits: int = BITS, block: int = BLOCK, held_rows: int = HELD) -> DataFrame:
    """Links ``a``, ``b`` (a < b) between distinct fingerprints, enough to connect all that are within ``bits``."""
    rings, small = _rings(bits), 32

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 15):
                fps = batch.column(0).slice(at, 1 << 15).to_numpy().view(np.uint64)
                for keys in group_keys(fps, bits):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], ["key", "fp"])

    def edges(kind: int, a: np.ndarray, b: np.ndarray, key: int = 0) -> pa.RecordBatch:
        a, b = a.view(np.int64), b.view(np.int64)
        if kind == 0:
            a, b = _stars(a, b)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), x)) for x in (kind, key)] + [pa.array(a), pa.array(b)], ["kind", "key", "a", "b"])

    def blocks_of(key: int, fps: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        """Links within each block of a large group, and its rows with their block's number, once."""
        for i in range(0, len(fps), block):
            own = fps[i:i + block]
            yield edges(0, *_compare(own, None, key, bits, rings))
            yield edges(1, own, np.full(len(own), number + i // block, np.int64), key)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within groups of one key; of a group beyond a block, block by block as its rows come."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = passed = 0  # rows held, and blocks of their first group that are gone already

        def compared(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(cuts, len(keys)))
            begun = np.zeros(len(sizes), np.int64)
            begun[0] = passed
            for i in np.flatnonzero((sizes > small) | (begun > 0)):
                key, own = int(keys[cuts[i]]), fps[cuts[i]:cuts[i] + sizes[i]]
                if begun[i] or len(own) > block:
                    yield from blocks_of(key, own, int(begun[i]))
                else:
                    yield edges(0, *_compare(own, None, key, bits, rings))
            few = np.repeat((sizes <= small) & (sizes > 1) & (begun == 0), sizes)
            yield edges(0, *_small_groups(keys[few], fps[few], bits, rings, small))

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)))
            size += batch.num_rows
            if size < max(held_rows, 2 * block):
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0  # the last group may go on
            if last:
                yield from compared(keys[:last], fps[:last])
                keys, fps, passed = keys[last:], fps[last:], 0
            if full := (len(keys) - 1) // block * block if len(keys) > 2 * block else 0:
                yield from blocks_of(int(keys[0]), fps[:full], passed)
                keys, fps, passed = keys[full:], fps[full:], passed + full // block
            held, size = [(keys, fps)], len(keys)
        if size:
            yield from compared(*(np.concatenate(x) for x in zip(*held)))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            right = rows[:, 2] & 1 == 1
            sides = [np.ascontiguousarray(rows[where, 1]).view(np.uint64) for where in (~right, right)]
            yield edges(0, *_compare(*sides, int(now[0]), bits, rings))

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            pair = rows[:, 2] >> 1
            cuts = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (pair[1:] != pair[:-1])) + 1
            for part in np.split(rows, cuts):
                if not len(part):
                    continue
                key = (part[0, 0], part[0, 2] >> 1)
                if now is not None and key != now:
                    yield from done()
                    held.clear()
                now = key
                held.append(part)
        if held:
            yield from done()

    schema = "kind long, key long, a long, b long"
    rows = distinct.select("fp").mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = shared_table(rows.mapInArrow(grouped, schema))
    # Pairs of a large group's blocks: each block's rows once per other block, made and compared by many tasks.
    parts = found.where("kind = 1").select("key", "a", F.col("b").alias("own"))
    count = parts.groupBy("key").agg((F.max("own") + 1).alias("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = parts.join(count, "key").select("key", "a", "own", "blocks", other).where("own != other").select(
        "key", "a", (2 * (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")) + (F.col("own") > F.col("other")).cast("long")).alias("b")
    )
    rest = pairs.repartition("key", F.shiftright("b", 1)).sortWithinPartitions("key", F.shiftright("b", 1))
    rest = rest.mapInArrow(crossed, schema)
    return found.where("kind = 0").unionByName(rest).select("a", "b").distinct()


def collapse(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes as those of each partition, at most one per node: a smaller node and a larger."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """``fp`` and its ``root``, the smallest fingerprint that it is connected with, for all that have a link.

    Alternates two steps until nothing changes: each node's larger neighbours move to its smallest
    neighbour, then its smaller ones do. Both are a grouped minimum and a join, so that a hub needs
    no list of its neighbours. Each round is stored in the shared folder."""
    now = shared_table(collapse(edges).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select("m", "b").unionByName(small.select("m", F.col("a").alias("b"))).where("m < b").toDF("a", "b").distinct()
        now = shared_table(small)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("b").alias("fp"), F.col("a").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them; equal after a round only if the round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """One row per document: its id, ``fingerprint`` as 16 hex digits, and ``component_id``."""
    rows = shared_table(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected(links(distinct, bits))
    members = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    # Stored before the join, so that the join may split a large component's fingerprints.
    smallest = shared_table(members.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("smallest")))
    linked = members.join(smallest, "root").select("fp", "smallest")
    labelled = distinct.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return rows.join(labelled, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
