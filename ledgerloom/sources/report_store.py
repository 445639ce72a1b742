"""Report lines and headers as a stored table, one part per report, published batch by batch."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions.amounts import balance_color
from ledgerloom.operators.reports import report_lines, report_totals, touched_reports, validate_reports
from ledgerloom.sources.books import Books
from ledgerloom.sources.published import Published
from ledgerloom.sources.schemas import MONEY

REPORT = T.StructField("report_id", T.LongType())

STORED = T.StructType([
    T.StructField("company_id", T.LongType()),
    T.StructField("report_type", T.StringType()),
    T.StructField("date_start", T.DateType()),
    T.StructField("date_end", T.DateType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("account_code", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("analytic_account_id", T.LongType()),
    T.StructField("analytic_code", T.StringType()),
    T.StructField("analytic_name", T.StringType()),
    T.StructField("debit", MONEY),
    T.StructField("credit", MONEY),
    T.StructField("balance", MONEY),
    T.StructField("currency_id", T.LongType()),
])

# What a version says about a report: what was asked for, and the totals.
HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("report_type", T.StringType()),
    T.StructField("date_start", T.DateType()),
    T.StructField("date_end", T.DateType()),
    T.StructField("total_debit", MONEY),
    T.StructField("total_credit", MONEY),
    T.StructField("total_balance", MONEY),
])
ASKED, TOTALS = HEADER.names[:4], HEADER.names[4:]


class ReportRun(NamedTuple):
    lines: DataFrame
    totals: DataFrame
    rejected: DataFrame
    headers: DataFrame


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``). A local
    session without that setting, as in tests, gets a new local folder; on a cluster that
    would be another folder on each machine, so there the setting is needed."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='ledgerloom-')}/{name}-{uuid.uuid4().hex}"


def store(spark: SparkSession, path: str) -> Published:
    # A header's columns that lines have too get a prefix in the version's file.
    about = T.StructType([T.StructField(f"header_{f.name}", f.dataType) for f in HEADER])
    return Published(spark, path, STORED, REPORT, about)


def _ids(reports: DataFrame) -> DataFrame:
    return reports.select(F.col("report_id").cast("long")).where("report_id IS NOT NULL").distinct()


def _of(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """The stored rows of these reports. Their lowest and highest id leave other partitions unread."""
    ids = _ids(reports)
    low, high = ids.agg(F.min("report_id")).scalar(), ids.agg(F.max("report_id")).scalar()
    return stored.where(F.col("report_id").between(low, high)).join(ids, "report_id", "left_semi")


def _lines(stored: DataFrame) -> DataFrame:
    """Stored lines with their color, which is not stored."""
    return stored.select(REPORT.name, *STORED.names, balance_color(F.col("balance")).alias("balance_color"))


def _headers(entries: DataFrame) -> DataFrame:
    return entries.select(REPORT.name, *[F.col(f"header_{name}").alias(name) for name in HEADER.names])


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    return _lines(store(spark, path).read())


def read_report_headers(spark: SparkSession, path: str) -> DataFrame:
    return _headers(store(spark, path).entries())


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines and headers of one version, whatever is published meanwhile."""
    table = store(spark, path)
    entries = table.entries()
    return _lines(table.read(entries)), _headers(entries)


def register_reports(spark: SparkSession, path: str, name: str) -> None:
    """Publish (or switch) the catalog views ``<name>_lines`` and ``<name>_headers``. Both read the view
    ``<name>``, the only one that changes when a batch is published."""
    store(spark, path).register(name)
    lines = ", ".join([REPORT.name, *STORED.names])
    headers = ", ".join(f"header_{n} AS {n}" for n in HEADER.names)
    spark.sql(f"CREATE VIEW IF NOT EXISTS {name}_lines AS SELECT {lines}, CASE WHEN balance < 0 THEN 'red' ELSE 'black' END AS balance_color "
              f"FROM {name} WHERE account_id IS NOT NULL")
    spark.sql(f"CREATE VIEW IF NOT EXISTS {name}_headers AS SELECT DISTINCT report_id, {headers} FROM {name}")


def run_reports(books: Books, reports: DataFrame, path: str) -> ReportRun:
    """Check the definitions, replace the lines and headers of all of them and publish both at once.

    The lines are computed and written once; the totals are sums of what was written. A definition
    that is rejected has no lines any more, and totals of zero. Of definitions that share an
    id, all are rejected."""
    spark, table = books.spark, store(books.spark, path)
    complete, rejected = validate_reports(reports)
    generation = table.write(report_lines(books, complete))
    totals = report_totals(table.written(generation), _ids(reports))
    asked = reports.where("report_id IS NOT NULL").dropDuplicates(["report_id"]).select("report_id", *ASKED)
    headers = asked.join(totals, "report_id").select("report_id", *[F.col(n).alias(f"header_{n}") for n in HEADER.names])
    version = table.publish(headers, generation)
    entries = table.entries(version)
    mine = _of(_headers(entries), reports)
    return ReportRun(_of(_lines(table.read(entries)), reports), mine.select("report_id", *TOTALS), rejected, mine)


def refresh_reports(books: Books, reports: DataFrame, path: str, report_ids: list[int] | None = None) -> ReportRun:
    """Run again the reports with the given ids, by their current definitions."""
    if report_ids is not None:
        reports = reports.where(F.col("report_id").isin(list(report_ids)))
    return run_reports(books, reports, path)


def refresh_touched(books: Books, reports: DataFrame, changed: DataFrame, path: str) -> ReportRun:
    """Run again only the reports that the ``changed`` lines can show in: those of ``reports`` whose
    accounts and period hold one. Lines that were moved or taken back are given as they were and as
    they are. All other parts of the store stay as they are, files included. The definitions to run are looked
    up once and written, since a run reads them several times."""
    touched, chosen = touched_reports(books, reports, changed), scratch_table(books.spark, "touched")
    reports.join(touched, "report_id", "left_semi").write.parquet(chosen)
    return run_reports(books, books.spark.read.schema(reports.schema).parquet(chosen), path)
