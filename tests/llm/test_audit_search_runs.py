"""Source audit, exact top-k search and run detection against plain loops and SQL."""

from __future__ import annotations

import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import periodic_runs, source_audit, top_k
from ledgerloom.llm import words as W


def column(texts):
    return W.Texts.of(pa.array(list(texts), pa.large_string()))


@pytest.mark.parametrize("module, query", [(source_audit, "op11_source_audit"), (top_k, "op12_top_k")])
def test_same_as_sql(spark, sf_dir, duck, module, query):
    df = getattr(module, query)(spark, sf_dir)
    cursor = duck.execute(module.ORACLE)
    assert df.columns == [c[0] for c in cursor.description]
    mine = sorted(map(tuple, df.collect()))
    assert mine == sorted(cursor.fetchall()) and mine


# source audit

@settings(deadline=None, max_examples=100)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_gallop(a, b):
    short, long = (np.array(sorted(x), np.int64) for x in (a, b))
    assert source_audit.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_prices_are_exact_beyond_64_bits():
    counts = np.array([0, 1, 10**12, 5 * 10**15], np.int64)
    total = 9 * 10**15
    assert source_audit.prices(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


def test_large_counts_in_the_plan(spark):
    rows = spark.createDataFrame([(0, 9 * 10**15), (5 * 10**15, 9 * 10**15), (1, 0)], "c long, total long")
    found = [r[0] for r in rows.select(source_audit.price(rows.c, rows.total)).collect()]
    assert found == [1 + 5 * 10**9 // (9 * 10**15), 1 + 10**9 * (5 * 10**15 + 5) // (9 * 10**15), None]


@pytest.mark.parametrize("block", [source_audit.BLOCK, 3])
def test_audit_is_that_of_plain_loops(spark, block):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}"
        words = [f"{'ÀBc'[rng.randrange(3)]}{chr(97 + int(rng.random() ** 2 * 20))}" for _ in range(rng.randrange(12))]
        rows.append((rng.choice([" ", "-", "\n1"]).join(words), rng.choice(["en", "de"]), source))
    rows += [(None, "en", "null text"), ("", None, None), ("aa aa", "xx", "a"), ("aa", "xx", "b"), ("1 2 3", "en", "no terms")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    found = source_audit.audit(df, least_docs=10, top=7, block=block)
    assert sorted(map(tuple, found.collect())) == sorted(brute.audit(rows, 10, 7))


def test_audit_of_edge_cases(spark, edge, empty):
    rows = [(r.text, r.lang, r.source) for r in edge.collect()]
    assert sorted(map(tuple, source_audit.audit(edge, least_docs=2).collect())) == sorted(brute.audit(rows, 2, 50))
    assert source_audit.audit(empty).count() == 0
    nothing_kept = source_audit.audit(edge, least_docs=1000).collect()
    assert {(r.part, r.value) for r in nothing_kept} == {("pair", 0)}


def test_terms_between_flushes(spark, monkeypatch, docs):
    rows = [(r.text, r.lang, r.source) for r in docs.limit(60).collect()]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    monkeypatch.setattr(source_audit, "HELD", 10)
    monkeypatch.setattr(W, "SLICE", 1000)
    assert sorted(map(tuple, source_audit.audit(df, least_docs=3).collect())) == sorted(brute.audit(rows, 3, 50))


# top-k search

def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, score string, cls int, query int")


def divisible(n):
    return F.col("id") % n == 0


def whole(vec):
    return [math.floor(256 * x) for x in vec]


@pytest.mark.parametrize("slices, dims", [(1, 5), (2, 7), (3, 7), (4, 2)])
def test_search_is_that_of_plain_loops(spark, slices, dims):
    rng = random.Random(slices)
    common = [rng.uniform(-1, 1) for _ in range(dims)]
    rows = {}
    for i in range(-3, 400):  # a third of the vectors are equal, some scores tie
        rows[i] = common if rng.random() < 0.35 else [round(rng.gauss(0, 1), 1) for _ in range(dims)]
    df = vectors(spark, [(i, v, None, 1, 1) for i, v in rows.items()], "array<double>").repartition(4)
    found = top_k.search(df, divisible(7), slices=slices, rows=64, queries=10)
    expected = brute.nearest([(i, whole(v)) for i, v in rows.items()], lambda i: i % 7 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_search_of_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-3.0, 0.5]), (1, [1.0]), (2, []), (3, None), (4, [nan, 1.0]), (5, [1.0, -inf]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (100, [0.001, -0.001]), (150, None), (7, [300.0, -300.0])]
    found = top_k.search(vectors(spark, [(*r, None, 1, 1) for r in rows], "array<double>"), divisible(50)).collect()
    kept = {(i, tuple(whole(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert sorted(map(tuple, found)) == sorted(brute.nearest(sorted(kept), lambda i: i % 50 == 0))
    none = top_k.search(vectors(spark, []), divisible(50))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert top_k.search(vectors(spark, [(0, [1.0], None, 1, 1)]), divisible(50)).count() == 0


def test_products_beyond_floats_and_beyond_64_bits():
    big = np.array([[1 << 30, (1 << 30) + 1]], np.int64)
    assert top_k.products(big, big).tolist() == [[(1 << 60) + (1 << 60) + (1 << 31) + 1]]
    with pytest.raises(OverflowError):
        top_k.products(big * 2, big * 2)


def test_second_phase_sends_few_entries(spark):
    """Vectors with a near neighbour: most of the others stay below the cutoff at every node."""
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (100, 16))
    data = np.repeat(centers, 10, axis=0) + rng.normal(0, 0.05, (1000, 16))
    df = vectors(spark, [(i, v.tolist(), None, 1, 1) for i, v in enumerate(data)], "array<double>")
    classes = top_k.shared_table(top_k.classes_of(df.selectExpr("vec_id AS id", "embedding").select("id", top_k.units(df.embedding).alias("vec")), 6))
    nodes = top_k.Search(classes, classes.where("cls % 10 = 0").select("cls"), 5, 2, 256, 32)
    scores = nodes.gathered().selectExpr("query", "cls", "0L AS score", "0 AS seen")
    cutoffs = top_k._nth(nodes.resolved(scores), 6).withColumnRenamed("score", "cutoff")
    asked = nodes.queries.count()
    assert nodes.sufficient(cutoffs).count() < 0.15 * asked * 1000


# periodic runs

WORDS = st.lists(st.sampled_from(["a", "b", "ab", "É"]), max_size=12)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(WORDS, st.integers(1, 40), WORDS, st.integers(0, 3)), max_size=3), st.integers(0, 400))
def test_runs_are_those_of_plain_loops(parts, key):
    text = " ".join(w for unit, times, tail, cut in parts for w in (unit * times)[cut:] + tail)
    assert [tuple(x[0] for x in periodic_runs.measure(column([text]), [key]))] == [brute.periodic(text, key)]


def test_runs_of_random_texts_side_by_side():
    rng = random.Random(3)
    texts = []
    for _ in range(80):
        out = []
        while len(out) < 150:
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 8, 9, 16, 17, 33, 40]))]
            out += unit * rng.randrange(1, 7) + unit[:rng.randrange(5)]
        texts.append(rng.choice([" ", "\n\t", " \x0b"]).join(out))
    ids = list(range(80))
    made = list(zip(*periodic_runs.measure(column(texts), ids)))
    assert made == [brute.periodic(t, i) for t, i in zip(texts, ids)]
    assert sum(r[0] for r in made) > 100


@pytest.mark.parametrize("joined", [1 << 18, 7])
def test_runs_of_edge_cases(monkeypatch, edge, empty, joined):
    monkeypatch.setattr(periodic_runs, "JOINED", joined)
    rows = sorted({(r.doc_id, r.text) for r in edge.collect() if len(r.text or "") < 100_000}, key=str)
    ids, texts = zip(*rows)
    made = list(zip(*periodic_runs.measure(column([t or "" for t in texts]), list(ids))))
    assert made == [brute.periodic(t, i) for i, t in rows]
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_run_columns_of_edge_cases(edge):
    found = periodic_runs.periodic_runs(edge, rewrite=True).collect()
    assert len(found) == edge.count()
    assert all(len(r.runs_sha256) == len(r.collapsed_sha256) == 64 for r in found)


def test_query_is_that_of_plain_loops(spark, sf_dir, texts):
    short = {i for i, t in texts.items() if len(t or "") < 8000}
    found = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, sf_dir).collect()]
    assert len(found) == len(texts)
    mine = sorted(r for r in found if r[0] in short)
    assert mine == sorted((i, *brute.periodic(texts[i], i)) for i in short)
    assert any(r[1] for r in mine) and len(short) > 150


def test_one_word_over_and_over():
    """As many earlier occurrences as there can be, in time that hardly grows faster than the text."""
    made = periodic_runs.measure(column(["x " * 400_000]), None)
    assert [x[0] for x in made[:5]] == [1, 0, 400_000, 1, 400_000_000]
