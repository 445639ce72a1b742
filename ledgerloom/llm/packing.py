"""Hierarchical multi-length packing of documents into training sequences.

Every document becomes ids, closed by an end id. Tiers are context sizes in powers of two. Full
windows of the longest tier are cut from a document's front; what is left goes to the shortest
tier that holds it. In each tier a piece of over half the size opens a window, and the gap
behind it is filled with pieces of shorter tiers, the longest that fit first; what no whole
piece fits is filled by cutting one. So windows have exactly their tier's size and need no
padding. What cannot fill any window at the end of an input partition is cut into sequences of
the tiers' sizes, longest first, and the few tokens below the shortest tier into smaller powers
of two, so nothing at all is padded.

Partitions are packed side by side, with bounded buffers and without a shuffle. The sequences
are then dealt to step groups: each tier's sequences are numbered over all partitions, by sums
of per-partition counts, and group g of n gets numbers g, g + n, ..., so groups differ by at
most one sequence per tier.

Null and empty texts are documents of the end id alone. Repeated rows are packed each for
itself, also under the same id. Without rows there are no pieces. Columns other than id and text
are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import subwords
from ledgerloom.llm import words as W
from ledgerloom.llm.storage import shared_table

TOKENIZER = "word_bpe_49k.json"
END = 2
TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens that are gathered before windows are closed.
BUFFER = 1 << 20
STEP_TOKENS = 1 << 19

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "part long, tier long, number long, offset long"
)


class Packer:
    """Packs the documents of one partition. A piece is (length, serial, document, start)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.longest = tiers, tiers[-1]
        self.pieces: list[tuple[int, int, object, int]] = []  # ascending
        self.tokens, self.serial = 0, 0
        self.made: list[tuple[int, list]] = []  # tier and pieces in order

    def add(self, doc: object, size: int) -> None:
        full = size // self.longest * self.longest
        for start in range(0, full, self.longest):
            self.made.append((self.longest, [(self.longest, doc, start)]))
        if size > full:
            self._put(size - full, doc, full)

    def _put(self, size: int, doc: object, start: int) -> None:
        insort(self.pieces, (size, self.serial, doc, start), key=lambda p: p[:2])
        self.serial += 1
        self.tokens += size

    def _take(self, room: int) -> tuple[int, int, object, int] | None:
        """The longest piece of at most ``room``."""
        at = bisect_right(self.pieces, room, key=lambda p: p[0])
        if not at:
            return None
        piece = self.pieces.pop(at - 1)
        self.tokens -= piece[0]
        return piece

    def _window(self, size: int, first: tuple[int, int, object, int] | None) -> None:
        """One window of exactly ``size`` tokens; there are that many at hand."""
        own, room = [], size
        if first:
            own.append((first[0], first[2], first[3]))
            room -= first[0]
        while room:
            if piece := self._take(room):
                own.append((piece[0], piece[2], piece[3]))
                room -= piece[0]
                continue
            length, _, doc, start = self.pieces.pop(0)  # the shortest is too long: cut it
            self.tokens -= length
            own.append((room, doc, start))
            self._put(length - room, doc, start + room)
            room = 0
        self.made.append((size, own))

    def pack(self, keep: int) -> None:
        """Close windows, the longest tier's first, until about ``keep`` tokens are left."""
        while self.tokens > keep and self.pieces:
            length = self.pieces[-1][0]
            size = next(t for t in self.tiers if t >= length)
            if self.tokens < size:
                break
            piece = self.pieces.pop()
            self.tokens -= piece[0]
            self._window(size, piece)

    def finish(self) -> None:
        self.pack(0)
        size = self.longest
        while self.tokens:
            while self.tokens >= size:
                self._window(size, None)
            size //= 2

    def done(self) -> list[tuple[int, list]]:
        made, self.made = self.made, []
        return made


def _pieces(docs: DataFrame, tokenizer: str, end: int, tiers: tuple[int, ...], buffer: int) -> DataFrame:
    names = [part.split()[0] for part in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer, numbers = subwords.loaded(tokenizer), Packer(tiers), {}

        def rows() -> pa.RecordBatch:
            out = []
            for tier, own in packer.done():
                number, offset = numbers.get(tier, 0), 0
                numbers[tier] = number + 1
                for length, (doc, ids), start in own:
                    crc = zlib.crc32(ids[start:start + length])
                    out.append((doc, start, length, crc, len(ids), part, tier, number, offset))
                    offset += length
            columns = zip(*out) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for first, column in W.slices(batch, "t"):
                found, _, _ = encode.texts([subwords.chunks(t) for t in column.to_pylist()])
                for doc, own in zip(batch.column(0).slice(first, len(column)).to_pylist(), found):
                    ids = np.append(own, np.int32(end)).astype("<u4")
                    packer.add((doc, ids), len(ids))
                if packer.tokens > buffer:
                    packer.pack(buffer // 2)
                yield rows()
        packer.finish()
        yield rows()

    return docs.select(F.col("doc"), F.col("t")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END,
         tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: its document, place and checksum there, ``sequence_id``, place in the
    sequence, the sequence's ``tier`` (its length, a power of two) and its ``step_group``.

    Texts are read and encoded once; the pieces, some numbers a document, are stored in the
    shared folder, since a sequence's number depends on the counts of all partitions."""
    if list(tiers) != sorted(tiers) or any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be ascending powers of two")
    found = shared_table(_pieces(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t")), tokenizer, end, tiers, buffer))
    counts = found.groupBy("part", "tier").agg((F.max("number") + 1).alias("sequences"))
    counts = shared_table(counts.withColumn("before", F.sum("sequences").over(Window.partitionBy("tier").orderBy("part")) - F.col("sequences")))
    total = counts.agg(F.sum(F.col("sequences") * F.col("tier"))).first()[0] or 0
    groups = max(1, -(-total // step_tokens))
    rank = F.col("before") + F.col("number")
    exponent = F.round(F.log2("tier")).cast("long")
    return found.join(counts.drop("sequences"), ["part", "tier"]).select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (rank * 64 + exponent).alias("sequence_id"), "offset", "tier", F.pmod(rank, F.lit(groups)).alias("step_group"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
