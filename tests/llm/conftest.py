from __future__ import annotations

import glob
import os

import duckdb
import pytest

from ledgerloom.llm.storage import on_workers


@pytest.fixture(autouse=True, scope="session")
def workers(spark):
    on_workers(spark)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


SENTENCE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi. "
LONG = "".join(f"word{i} follows word{i * 7 % 5000}, and ends here.\n" for i in range(20_000))
#: doc_id, text, lang, source, n_chars: nulls, empty and very long texts, ties and repeated rows.
EDGE = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n\x0b\r ", "en", "s", 6), (4, "One", "en", "s", 3),
    (5, SENTENCE * 3, "en", "s", 1), (6, SENTENCE * 3, "en", "s", 1), (6, SENTENCE * 3, "en", "s", 1),
    (7, "Before it came.\n" + SENTENCE + "After it went.", "fr", None, 1), (8, LONG, "en", "t", 1), (9, "ÀÉ ß 中文 🙂 ́x", "de", "t", 1),
    (None, "No id here but some words. " + SENTENCE, "en", "t", 1), (None, "No id here but some words. " + SENTENCE, "en", "t", 1),
    (10, "!!! ### *** <<<", None, "u", 1), (11, "a\x00b\x1cc\x85d\xa0e " * 30, "en", "u", 1), (12, "x" * 70_000, "en", "u", 1),
    (-5, "same line\nsame line\nsame line\n\n" * 20, "es", "u", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row_key", "id", "fp", "t", "score", "removed_spans", "host", "shard", "words", "tier", "position", "Part"]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases with columns whose names the operators use themselves."""
    df = spark.createDataFrame(EDGE, SCHEMA).repartition(3)
    for name in CLASHES:
        df = df.selectExpr("*", f"'own' AS {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
