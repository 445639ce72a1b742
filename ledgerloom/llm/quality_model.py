"""Quality classification with hierarchical empirical Bayes over sites.

Three levels of evidence are combined. A logistic regression on the text gives each document a
probability of being good; it is trained here on a bounded sample of labelled documents (at most
``SAMPLE``). Documents are summed by path and by host, a labelled one with its label, the others
with their probability. A host's rate is shrunk to the mean of all hosts, a path's rate to that
of its host, each with a beta prior whose strength comes from how much the hosts, or the paths
around their hosts, differ; so sparse sites say little. A document's score is its own log odds
plus the log odds by which the rest of its path and host (itself left out) differ from the mean.
A second regression on the same features has toxicity as its target. What is toxic is a few rare
words, so there a word's weight is a multiple of its own log odds, shrunk towards those of all
documents (``PRIOR``): a word that only toxic documents hold counts at once, one seen once or twice
hardly does. A document is kept if its score reaches ``min_score`` and its probability of being toxic stays below ``max_toxic``.

Null text is an empty text. Null hosts and null paths are each a group of their own. A label that
is null is none; repeated labels of an id are averaged; repeated documents count each for itself.
Without labels of both kinds the classifier says 0.5 for all; without rows there is no result.
Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.quality_rules import SYMBOLS, STRENGTH
from ledgerloom.llm.storage import shared_table

SAMPLE = 4000
#: Hashed words; steps, rate and penalties of the regression.
BUCKETS, STEPS, RATE, PENALTY = 1 << 14, 300, 0.05, 3e-4
STATS = 8
#: Documents of the mean rate that are added to those with a word when its log odds of toxicity are taken.
PRIOR = 5.0
#: Few labelled documents are toxic, so a probability well over their share tells enough.
MIN_SCORE, MAX_TOXIC = 0.5, 0.25

_UPPER, _BANG, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _BANG[33], _DIGIT[48:58] = True, True, True


def features(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text a row of shape statistics; and the distinct (text, hashed word) pairs, in order of text."""
    solid = W.SOLID[texts.data]
    starts, ends, text = texts.runs(W.ALNUM[texts.data])
    n = np.bincount(text, minlength=len(texts))
    bucket = (texts.hashes(starts, ends, W.LOWER) >> np.uint64(64 - 14)).astype(np.int64)
    pairs = np.unique(text * BUCKETS + bucket)
    owner, bucket = pairs // BUCKETS, pairs % BUCKETS
    distinct = np.bincount(owner, minlength=len(texts))
    chars = np.maximum(texts.total(solid), 1)
    share = [texts.total(table[texts.data]) / chars for table in (SYMBOLS, _UPPER, _BANG, _DIGIT)]
    stats = np.stack([np.log1p(n), distinct / np.maximum(n, 1), texts.total(W.ALNUM[texts.data]) / np.maximum(n, 1) / 10, *share,
                      texts.total(W.ALNUM[texts.data]) / chars], axis=1)
    return stats, owner, bucket


class Classifier:
    """Logistic regression on standardised statistics and on which hashed words occur."""

    def __init__(self) -> None:
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)
        self.dense, self.words, self.bias = np.zeros(STATS), np.zeros(BUCKETS), 0.0

    def log_odds(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        dense = np.clip((stats - self.mean) / self.scale, -5, 5) @ self.dense
        return self.bias + dense + np.bincount(owner, self.words[bucket], len(stats))

    def fit(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, y: np.ndarray, prior: float | None = None) -> Classifier:
        """Adam on the penalised mean log loss, over all examples in each step. With ``prior``, the
        weights of words are multiples of their shrunken log odds."""
        if len(np.unique(y)) < 2:
            return self
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        unit = 1.0
        if prior is not None:
            rate = (np.bincount(bucket, y[owner], BUCKETS) + prior * y.mean()) / (np.bincount(bucket, minlength=BUCKETS) + prior)
            unit = np.log(rate / (1 - rate)) - self.bias
        theta = np.concatenate([[self.bias], self.dense, self.words])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.bias, self.dense, self.words = theta[0], theta[1:STATS + 1], theta[STATS + 1:] * unit
            error = (1 / (1 + np.exp(-self.log_odds(stats, owner, bucket))) - y) / len(y)
            grad = np.concatenate([[error.sum()], x.T @ error, np.bincount(bucket, error[owner], BUCKETS) * unit])
            grad[1:] += PENALTY * theta[1:]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.bias, self.dense, self.words = float(theta[0]), theta[1:STATS + 1], theta[STATS + 1:] * unit
        return self


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, prior: float | None = None) -> Classifier:
    """A classifier from at most ``most`` of the labelled documents, by a hash of their ids; of rows that
    repeat such an id, only as many as make twice that number. ``docs``: id, t; ``labels``: id, good (0 to 1)."""
    chosen = labels.where("good IS NOT NULL").orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(most)
    rows = docs.join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in W.slices(batch, "t"):
                stats, owner, bucket = features(W.Texts.of(column))
                cuts = np.searchsorted(owner, np.arange(1, len(column)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(column)), batch.column(2).slice(first, len(column)), pa.array(list(stats), pa.list_(pa.float64())),
                    pa.array(np.split(bucket.astype(np.int32), cuts), pa.list_(pa.int32()))], ["id", "good", "stats", "words"])

    found = rows.select("id", "t", F.col("good").cast("double")).mapInArrow(run, "id long, good double, stats array<double>, words array<int>")
    found = found.orderBy("id", "good", "stats").limit(2 * most).toArrow()
    if not found.num_rows:
        return Classifier()
    words, stats = found.column("words").combine_chunks(), found.column("stats").combine_chunks()
    owner = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
    good = (found.column("good").to_numpy() >= 0.5).astype(float)
    return Classifier().fit(stats.flatten().to_numpy().reshape(-1, STATS), owner, words.flatten().to_numpy(), good, prior)


def _odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def strength(mean: Column, variance: Column) -> Column:
    """Of a beta prior with these moments, as a number of documents."""
    free = F.when(variance > 0, mean * (1 - mean) / variance - 1).otherwise(F.lit(STRENGTH[1]))
    return F.least(F.greatest(free, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def combine(rows: DataFrame) -> DataFrame:
    """Add ``host_rate``, ``path_rate`` (both without the document itself) and ``score`` to rows
    with ``host``, ``path``, ``p`` and ``evidence`` (the label where known, else p)."""
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("evidence").alias("path_s"))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    rate = F.col("host_s") / F.col("host_n")
    top = hosts.agg(F.struct((F.sum("host_s") / F.sum("host_n")).alias("mean"), F.var_pop(rate).alias("variance")).alias("all")).scalar()
    mean = F.least(F.greatest(F.col("all.mean"), F.lit(0.001)), F.lit(0.999))
    hosts = hosts.withColumn("all", top).withColumn("mean", mean).withColumn("host_k", strength(mean, F.col("all.variance"))).drop("all")
    hosts = hosts.withColumnRenamed("host", "its_host")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("its_host"))).drop("its_host")
    shrunk = (F.col("host_k") * F.col("mean") + F.col("host_s")) / (F.col("host_k") + F.col("host_n"))
    spread = sites.agg(F.struct(F.avg((F.col("path_s") / F.col("path_n") - shrunk) ** 2).alias("variance"), F.max("mean").alias("mean")).alias("s")).scalar()
    sites = sites.withColumn("s", spread).withColumn("path_k", strength(F.col("s.mean"), F.col("s.variance"))).drop("s")
    sites = sites.withColumnRenamed("host", "its_host").withColumnRenamed("path", "its_path")
    both = rows.join(sites, F.col("host").eqNullSafe(F.col("its_host")) & F.col("path").eqNullSafe(F.col("its_path"))).drop("its_host", "its_path")
    e = F.col("evidence")
    host_rate = (F.col("host_k") * F.col("mean") + F.col("host_s") - e) / (F.col("host_k") + F.col("host_n") - 1)
    path_rate = (F.col("path_k") * host_rate + F.col("path_s") - e) / (F.col("path_k") + F.col("path_n") - 1)
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    log_odds = _odds(inside(F.col("p"))) + _odds(inside(path_rate)) - _odds(F.col("mean"))
    return both.select(
        *rows.columns, inside(host_rate).alias("host_rate"), inside(path_rate).alias("path_rate"), (1 / (1 + F.exp(-log_odds))).alias("score"),
    )


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None,
             good: Column | None = None, min_score: float = MIN_SCORE, toxic: Column | None = None, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """One row per document: ``p`` from its text, the rates of its host and path, ``score``, ``p_toxic`` and whether it is ``kept``.

    ``host`` and ``path`` are columns of the documents (by default ``source``, and ``lang`` as
    its section), ``good`` and ``toxic`` of the labels (quality 1 and not toxic; toxic 1). The texts are read once
    for learning and once for the result, whose thin rows are stored in the shared folder."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)) if good is None else good
    truth = labels.select(F.col(id_col).cast("long").alias("id"), good.cast("double").alias("good")).where("id IS NOT NULL").groupBy("id").agg(F.avg("good").alias("good"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    toxic = (F.col("toxic") == 1) if toxic is None else toxic
    harm = labels.select(F.col(id_col).cast("long").alias("id"), toxic.cast("double").alias("good")).where("id IS NOT NULL").groupBy("id").agg(F.avg("good").alias("good"))
    model, harmful = learn(source.select("id", "t"), truth), learn(source.select("id", "t"), harm, prior=PRIOR)
    told = bool(harmful.bias or harmful.dense.any())  # labels of both kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in W.slices(batch, "t"):
                found = features(W.Texts.of(column))
                p = 1 / (1 + np.exp(-model.log_odds(*found)))
                p_toxic = 1 / (1 + np.exp(-harmful.log_odds(*found))) if told else np.zeros(len(column))
                same = [batch.column(i).slice(first, len(column)) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(p), pa.array(p_toxic)], ["id", "host", "path", "p", "p_toxic"])

    rows = source.mapInArrow(run, "id long, host string, path string, p double, p_toxic double").join(truth, "id", "left")
    rows = shared_table(rows.withColumn("evidence", F.coalesce("good", "p")).drop("good"))
    return combine(rows).withColumn("kept", (F.col("score") >= min_score) & (F.col("p_toxic") < max_toxic)).withColumnRenamed("id", id_col)


def op3_quality_model(spark, sf_dir: str) -> DataFrame:
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "p", "host_rate", "path_rate", "score", "p_toxic", "kept")
