"""Exact top-k search by inner product, with a three-phase uniform threshold.

Vectors are cut into ``slices``; a vector's score for a query is the sum of its slices' scores, and
a node, (slice, block of vectors, block of queries), knows those of its slice alone.

1. Each node gathers, per query, its ``k + 1`` best local scores. The best of each slice over all
   blocks are scored in full, and the (k + 1)-th best of these is a score that the answer reaches.
2. That **cutoff** goes back to the nodes with the queries. A vector whose local score is below
   cutoff / slices in every slice is below the cutoff as a whole; every node sends all entries that
   are not. Summed by query and vector they give exact scores where all slices came, and upper
   bounds elsewhere. The exact ones may raise the cutoff.
3. Vectors whose upper bound reaches the cutoff have their missing slices looked up.

Components become floor(256 * x). Vectors without id, null vectors and those with a null or
non-finite component take no part. Rows that repeat an id with its vector count once; an id with
several vectors has a rank series for each. A shorter vector lacks components, which count as 0.
Components beyond 32 bits, and scores beyond 63, are errors. Ties go to the smaller id. A query
never finds its own row. Without rows there is no result. Other columns are not read.

Equal vectors are one class, searched once, with its ``k + 1`` smallest ids, since no answer needs
more of them: a vector that a third of all rows share is one entry. Nodes have some
``rows`` classes and ``queries`` queries by hash, co-grouped; no task holds more, nothing is
broadcast by us.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import shared_table

K, SLICES = 5, 2
#: Classes and queries of a node.
ROWS, QUERIES = 4096, 512
UNITS = 256
NODE = ["slice", "row_block", "query_block"]


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & finite


def units(vec: Column) -> Column:
    """Components as whole 256ths."""
    def one(x: Column) -> Column:
        whole = F.floor(x.cast("double") * UNITS)
        return F.when(F.abs(whole) < 1 << 31, whole).otherwise(F.raise_error(F.lit("a component is beyond 32 bits"))).cast("int")

    return F.transform(vec, one)


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """Different vectors ``vec`` of the rows (id, vec), numbered ``cls``, with their ``most`` smallest ids."""
    by_vector = Window.partitionBy("vec").orderBy("id")
    first = rows.select("vec", "id").distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= most)
    return first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cls", F.monotonically_increasing_id())


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: by floats while these hold them, else by 64-bit numbers."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if bound < 1 << 53:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    if bound >= 1 << 62:
        raise OverflowError("scores may be beyond 63 bits")
    return queries @ rows.T


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class Search:
    """The nodes of one search: classes (cls, vec, ids) against the classes ``asked`` (cls) among them."""

    def __init__(self, classes: DataFrame, asked: DataFrame, k: int, slices: int, rows: int, queries: int):
        n, size = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        m = asked.count()
        self.most, self.slices, self.width = k + 1, slices, max(1, -(-size // slices))
        self.classes = classes.select("cls", "vec")
        self.queries = asked.join(classes, "cls").select(F.col("cls").alias("query"), F.col("vec").alias("query_vec"))
        row_blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-m // queries))
        self.node_rows = self.classes.select(
            "cls", F.pmod(F.xxhash64("cls"), F.lit(row_blocks)).cast("int").alias("row_block"),
            F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), self._parts("vec"),
        ).select("cls", "row_block", "query_block", "part.*")
        self.node_queries = self.queries.select(
            "query", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("query_block"),
            F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"), self._parts("query_vec"),
        ).select("query", "row_block", "query_block", "part.*")

    def part(self, vec: str, number) -> Column:
        return F.slice(vec, number * self.width + 1, F.lit(self.width))

    def _parts(self, vec: str) -> Column:
        parts = [F.struct(F.lit(j).alias("slice"), self.part(vec, F.lit(j)).alias("x")) for j in range(self.slices)]
        return F.explode(F.array(*parts)).alias("part")

    def _at_nodes(self, queries: DataFrame, choose) -> DataFrame:
        """Entries (query, cls, slice, local) that ``choose`` picks from each node's local scores: it
        gets them, a row per query, with the node's queries, and returns places."""
        width = self.width

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            if not rows.num_rows or not asked.num_rows:
                return pa.table({n: pa.array([], t) for n, t in (("query", pa.int64()), ("cls", pa.int64()), ("slice", pa.int32()), ("local", pa.int64()))})
            local = products(_matrix(asked.column("x"), width), _matrix(rows.column("x"), width))
            q, c = choose(local, asked)
            return pa.table({
                "query": _numbers(asked, "query")[q], "cls": _numbers(rows, "cls")[c],
                "slice": np.full(len(q), rows.column("slice")[0].as_py(), np.int32), "local": local[q, c],
            })

        rows, asked = (df.toDF(*df.columns).groupBy(*NODE) for df in (self.node_rows, queries))
        return rows.cogroup(asked).applyInArrow(run, "query long, cls long, slice int, local long")

    def gathered(self) -> DataFrame:
        """Phase 1: the best ``k + 1`` (query, cls) of each query and slice."""
        most = self.most

        def best(local: np.ndarray, _: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            n = min(most, local.shape[1])
            at = np.argpartition(-local, n - 1, axis=1)[:, :n]
            return np.repeat(np.arange(len(local)), n), at.ravel()

        by_slice = Window.partitionBy("query", "slice").orderBy(F.desc("local"), "cls")
        lists = self._at_nodes(self.node_queries, best).withColumn("place", F.row_number().over(by_slice))
        return lists.where(F.col("place") <= most).select("query", "cls").distinct()

    def sufficient(self, cutoffs: DataFrame) -> DataFrame:
        """Phase 2: what the nodes send, summed by (query, cls): ``score`` so far, ``seen`` slices as
        bits and the query's ``cutoff``, null where there are too few rows for one."""
        slices = self.slices

        def enough(local: np.ndarray, asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            cutoff = asked.column("cutoff").combine_chunks()
            known = cutoff.is_valid().to_numpy(zero_copy_only=False)
            least = cutoff.fill_null(0).to_numpy(zero_copy_only=False)
            return np.nonzero((local >= -(-least // slices)[:, None]) | ~known[:, None])

        entries = self._at_nodes(self.node_queries.join(cutoffs, "query", "left"), enough)
        sums = entries.groupBy("query", "cls").agg(F.sum("local").alias("score"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("slice"))).alias("seen"))
        return sums.join(cutoffs, "query", "left")

    def resolved(self, wanted: DataFrame) -> DataFrame:
        """Phase 3: exact scores of (query, cls) with their ``score`` in the slices ``seen``; only the
        others' components are multiplied."""
        numbers = F.array(*(F.lit(j) for j in range(self.slices)))
        missing = F.filter(numbers, lambda j: F.col("seen").bitwiseAND(F.call_function("shiftleft", F.lit(1), j)) == 0)
        dot = F.aggregate(
            missing, F.lit(0).cast("long"),
            lambda total, j: total + F.aggregate(
                F.zip_with(self.part("query_vec", j), self.part("vec", j), lambda a, b: F.coalesce(a.cast("long") * b, F.lit(0).cast("long"))),
                F.lit(0).cast("long"), lambda s, x: s + x,
            ),
        )
        return wanted.join(self.classes, "cls").join(self.queries, "query").select("query", "cls", (F.col("score") + dot).alias("score"))


def _nth(scores: DataFrame, n: int) -> DataFrame:
    """The ``n``-th best score of each query, where it has so many rows."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return scores.select("query", "score", place.alias("place")).where(F.col("place") <= n).where(F.col("place") == n).drop("place")


def search(
    vectors: DataFrame, asked: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
    slices: int = SLICES, rows: int = ROWS, queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for each row for which ``asked``, a
    condition on ``id``, holds."""
    usable_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    whole = shared_table(usable_rows.select("id", units(F.col("vec")).alias("vec")))
    classes = shared_table(classes_of(whole, k + 1))
    members = shared_table(whole.where(asked).distinct().join(classes.select("cls", "vec"), "vec").select(F.col("id").alias("query_id"), F.col("cls").alias("query")))
    nodes = Search(classes, members.select(F.col("query").alias("cls")).distinct(), k, slices, rows, queries)
    ids = classes.select("cls", F.explode("ids").alias("vec_id"))

    none = nodes.gathered().select("query", "cls", F.lit(0).cast("long").alias("score"), F.lit(0).alias("seen"))
    cutoffs = shared_table(_nth(nodes.resolved(none).join(ids, "cls"), k + 1).withColumnRenamed("score", "cutoff"))

    found = shared_table(nodes.sufficient(cutoffs))
    every = (1 << slices) - 1
    raised = _nth(found.where(F.col("seen") == every), k + 1).withColumnRenamed("score", "raised")
    # A slice that was not sent has at most the largest whole number below cutoff / slices.
    below = F.expr(f"(cutoff - 1 - pmod(cutoff - 1, {slices}L)) div {slices}")
    highest = F.col("score") + (slices - F.bit_count("seen")) * below
    reach = F.coalesce(highest >= F.greatest("cutoff", F.coalesce("raised", "cutoff")), F.lit(True))
    left = found.join(raised, "query", "left").where(reach)
    exact = left.where(F.col("seen") == every).select("query", "cls", "score").unionByName(nodes.resolved(left.where(F.col("seen") != every)))

    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "cls")
    best = exact.join(ids, "cls").withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("cls") == F.col("query"))
    by_row = Window.partitionBy("query_id", "query").orderBy("place")
    answers = members.join(best, "query").where(~own).withColumn("rank", F.row_number().over(by_row)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")


def op12_top_k(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({UNITS} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON (q.vec_id, q.vec) <> (c.vec_id, c.vec) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
