"""Reading books from files and from tables of the catalog, and the stored report lines."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom import load_books, table_books
from ledgerloom.operators import ledger, reports, statements
from ledgerloom.plans import definitions as d
from ledgerloom.sources import books as sources, report_store, schemas

FILES = {kind: name for kind, (name, _) in sources.TABLES.items()}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_files_of_any_format(spark, make_books, tmp_path, fmt):
    made = make_books(lines=[dict(id=1, debit="10.25"), dict(id=2, credit=3, ref="x", date=None)])
    for kind, name in FILES.items():
        writer = getattr(made, kind).write
        if fmt == "json":
            writer = writer.option("ignoreNullFields", "false")
        writer.format(fmt).save(f"{tmp_path}/{name}")
    if fmt == "json":
        read = type(made)(**{
            kind: schemas.conform(spark.read.schema(schema).json(f"{tmp_path}/{name}"), schema)
            for kind, (name, schema) in sources.TABLES.items()
        })
    else:
        read = load_books(spark, str(tmp_path), fmt)
    assert read.lines.schema.names == schemas.LINES.names
    assert ledger.general_ledger(read).exceptAll(ledger.general_ledger(made)).count() == 0
    assert ledger.general_ledger(read).count() == 2


def test_wider_and_narrower_columns_are_cast(spark, make_books, tmp_path):
    made = make_books(lines=[dict(id=1, debit="10.25")])
    for kind, name in FILES.items():
        df = getattr(made, kind)
        if kind == "lines":
            df = df.withColumns({"id": F.col("id").cast("int"), "debit": F.col("debit").cast("decimal(12,3)"),
                                 "unrelated": F.lit("x")})
        df.write.parquet(f"{tmp_path}/{name}")
    read = load_books(spark, str(tmp_path))
    assert [f.dataType for f in read.lines.schema] == [f.dataType for f in schemas.LINES]
    assert str(ledger.general_ledger(read).first().balance) == "10.25"


@pytest.fixture(scope="module")
def bucketed(spark, tpch, tmp_path_factory):
    """Catalog tables, lines and entries bucketed alike on the entry."""
    root = tmp_path_factory.mktemp("tables")
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{root}'")
    keys = {"lines": "move_id", "moves": "id"}
    for kind, name in FILES.items():
        writer = getattr(tpch, kind).write.format("parquet")
        if kind in keys:
            writer = writer.bucketBy(4, keys[kind]).sortBy(keys[kind])
        writer.saveAsTable(f"bucketed.{name}")
    yield table_books(spark, "bucketed")
    spark.sql("DROP DATABASE bucketed CASCADE")


@pytest.mark.parametrize("make", [ledger.ledger_base, statements.income_statement])
def test_bucketed_tables_join_without_shuffle(spark, bucketed, tpch, make):
    """With dimensions small enough to broadcast, and entries too large for it."""
    plain = make(tpch)
    rows = sorted(map(str, plain.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    try:
        df = make(bucketed)
        text = df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, df.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in text.split("\n") if "SortMergeJoin [move_id#" in line]
    assert len(joins) == 1
    assert "Exchange hashpartitioning(move_id" not in text and "Exchange hashpartitioning(id" not in text


def test_definitions_from_files(spark, tmp_path):
    d.definitions(spark, d.MIXED).write.parquet(f"{tmp_path}/report_definition")
    read = sources.report_definitions(spark, str(tmp_path))
    ok, rejected = reports.validate_reports(read)
    assert ok.count() == len(d.MIXED) - 1
    assert [r.report_id for r in rejected.collect()] == [9]


def test_store_reads_only_the_partitions_of_the_batch(spark, make_books, make_reports, tmp_path):
    path = str(tmp_path / "lines")
    books = make_books(lines=[dict(id=1, credit=5)], accounts=[dict(id=1, internal_type="income")])
    report_store.run_reports(books, make_reports(*[dict(report_id=n) for n in range(1, 6)]), path)
    run = report_store.refresh_reports(books, make_reports(*[dict(report_id=n) for n in range(1, 6)]), path, [4])
    assert [r.report_id for r in run.lines.collect()] == [4]
    text = run.lines._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_id" in text and "report_id#" in text.split("PartitionFilters")[1]
    assert report_store.read_report_lines(spark, path).count() == 5


def test_scratch_table_uses_the_shared_folder():
    class Session:
        def __init__(self, master="local[2]", **settings):
            self.conf, self.sparkContext = settings, SimpleNamespace(master=master)

    shared = Session(**{"spark.checkpoint.dir": "hdfs://shared/scratch"})
    first, second = report_store.scratch_table(shared, "t"), report_store.scratch_table(shared, "t")
    assert first != second and first.startswith("hdfs://shared/scratch/t-")
    assert "/t-" in report_store.scratch_table(Session(), "t")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            report_store.scratch_table(Session(master), "t")


def test_scratch_table_reads_the_setting_of_a_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert report_store.scratch_table(spark, "t").startswith(shared or "/")
