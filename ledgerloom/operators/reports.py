"""Configurable reports: a batch of definitions against the journal, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.amounts import balance_color, or_zero
from ledgerloom.operators.measures import ASSET, EQUITY, EXPENSE, INCOME, LIABILITY
from ledgerloom.sources.books import Books, month_of

# Report types, the accounts of each, and the label of "no analytic account".
INCOME_REPORT = "income"
BALANCE_REPORT = "balance"
CASH_FLOW_REPORT = "cashflow"
REPORT_TYPES = [INCOME_REPORT, BALANCE_REPORT, CASH_FLOW_REPORT]
CASH_ACCOUNT_CODE = "101"
NO_ANALYTIC_CODE = "SIN ANALÍTICA"
NO_ANALYTIC_NAME = "Sin Cuenta Analítica"

LINE_COLUMNS = [
    "report_id", "company_id", "report_type", "date_start", "date_end",
    "account_id", "account_code", "account_name", "account_type",
    "analytic_account_id", "analytic_code", "analytic_name",
    "debit", "credit", "balance", "currency_id", "balance_color",
]


def with_problems(reports: DataFrame) -> DataFrame:
    """Definitions with the required fields they lack, as text; empty when complete. An id that
    several definitions have is a problem of them all, since their lines could not be told apart."""
    no_company = F.coalesce(F.size("company_ids") < 1, F.lit(True))
    with_same_id = F.count("*").over(Window.partitionBy("report_id"))
    return reports.withColumn("problems", F.concat_ws(
        ", ",
        F.when(F.col("name").isNull(), "name"),
        F.when(~F.coalesce(F.col("report_type").isin(REPORT_TYPES), F.lit(False)), "report_type"),
        F.when(F.col("date_start").isNull(), "date_start"),
        F.when(F.col("date_end").isNull(), "date_end"),
        F.when(no_company, "company_ids"),
        F.when(F.col("report_id").isNotNull() & (with_same_id > 1), "report_id"),
    ))


def validate_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete definitions, and the others with their ``problems``."""
    checked = with_problems(reports)
    return checked.where("problems = ''").drop("problems"), checked.where("problems <> ''")


def _covers() -> Column:
    """Whether a report shows an account. An unknown report type shows none."""
    kind = F.col("report_type")
    return (
        ((kind == INCOME_REPORT) & F.col("internal_type").isin(INCOME, EXPENSE))
        | ((kind == BALANCE_REPORT) & F.col("internal_type").isin(ASSET, LIABILITY, EQUITY))
        | ((kind == CASH_FLOW_REPORT) & F.col("code").startswith(CASH_ACCOUNT_CODE))
    )


def _report_accounts(books: Books, reports: DataFrame) -> DataFrame:
    """One row per report, company and account of that company in the report."""
    requests = reports.select(
        "report_id", "report_type", "date_start", "date_end", "analytic_account_ids",
        F.coalesce("include_zero_lines", F.lit(False)).alias("include_zero_lines"),
        F.coalesce("group_by_analytic", F.lit(True)).alias("group_by_analytic"),
        F.explode(F.array_distinct("company_ids")).alias("company_id"),
    )
    accounts = books.accounts.where(~F.coalesce("deprecated", F.lit(False))).select(
        F.col("id").alias("account_id"), "company_id", "code", "internal_type"
    )
    return requests.join(accounts, "company_id").where(_covers()).drop("code", "internal_type")


def _movements(books: Books, asked: DataFrame, reports: DataFrame) -> DataFrame:
    """Posted movements per company, account, analytic account and day, of the accounts and
    days that the batch asks for. Lines are summed ahead of any further shuffle."""
    first = reports.agg(F.min("date_start")).scalar()
    last = reports.agg(F.max("date_end")).scalar()
    accounts = asked.select("company_id", "account_id").distinct()
    lines = books.lines.where((F.col("parent_state") == "posted") & F.col("date").between(first, last))
    if books.month is not None:
        # The files of other months are pruned by this side, also those between two periods.
        lines = lines.join(_asked_months(reports, books.month), books.month, "left_semi")
    return (
        lines.select("company_id", "account_id", "analytic_account_id", "date", "debit", "credit")
        .join(accounts, ["company_id", "account_id"], "left_semi")
        .groupBy("company_id", "account_id", "analytic_account_id", "date")
        .agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.count("*").alias("moves"))
    )


def _asked_months(reports: DataFrame, name: str) -> DataFrame:
    """The months in which some report's period lies. They are sent to all tasks, as Spark prunes files only by
    what it broadcasts: at most the 120,000 months that dates can name, a few megabytes, however many reports.
    """
    first, last = F.trunc("date_start", "month"), F.trunc("date_end", "month")
    periods = reports.where("date_start <= date_end").select(first.alias("first"), last.alias("last")).distinct()
    months = periods.select(F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("first"))
    # The last filter holds for every row; it tells Spark that this side may prune files.
    return F.broadcast(months.distinct().select(month_of("first").alias(name)).where(F.col(name) >= ""))


SERIES = ["company_id", "account_id", "analytic_account_id"]
AMOUNTS = ["debit", "credit", "moves"]


def _in_periods(asked: DataFrame, moved: DataFrame) -> DataFrame:
    """Movement of each report, account and analytic account within the report's period.

    A report reads the running sums of each series (company, account, analytic account) at
    two days, the one before its period and the last in it. Both kinds of rows go through one
    window per series, so the work grows with the movements plus the reports' lines, however
    the periods overlap. A series has a row per day of the calendar and two per report.
    """
    chosen = F.col("analytic_account_ids")
    series = moved.select(*SERIES).distinct()
    pairs = (
        asked.join(series, ["company_id", "account_id"])
        .where("date_start <= date_end")
        .where(chosen.isNull() | (F.size(chosen) == 0) | F.array_contains(chosen, F.col("analytic_account_id")))
    )
    ends = F.explode(F.array(
        F.struct(F.date_sub("date_start", 1).alias("date"), F.lit(-1).alias("sign")),
        F.struct(F.col("date_end").alias("date"), F.lit(1).alias("sign")),
    ))
    probes = pairs.select(*SERIES, "report_id", ends.alias("end")).select(*SERIES, "report_id", "end.date", "end.sign")
    so_far = (
        Window.partitionBy(*SERIES).orderBy("date", F.col("sign").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    read = moved.unionByName(probes, allowMissingColumns=True).select(
        "report_id", *SERIES, "sign", *[(F.sum(c).over(so_far) * F.col("sign")).alias(c) for c in AMOUNTS]
    )
    return read.where(F.col("sign").isNotNull()).groupBy("report_id", *SERIES).agg(*[F.sum(c).alias(c) for c in AMOUNTS])


def report_lines(books: Books, reports: DataFrame) -> DataFrame:
    """Lines of all reports of the batch: debit, credit and balance per report, company,
    account and (when the report groups by it) analytic account.

    A line with balance zero is left out unless the report includes zero lines. Then an
    account without movements gets a zero line too, but only when not grouped.
    """
    asked = _report_accounts(books, reports)
    keys = ["report_id", "company_id", "account_id"]
    moved = _in_periods(asked, _movements(books, asked, reports)).where("moves > 0")
    grouped = F.col("group_by_analytic")
    group = F.when(grouped, F.coalesce("analytic_account_id", F.lit(0))).otherwise(F.lit(0))
    sums = (
        asked.join(moved, keys, "left")
        .groupBy(
            *keys, group.cast("long").alias("analytic"),
            "report_type", "date_start", "date_end", "include_zero_lines", "group_by_analytic",
        )
        .agg(
            or_zero(F.sum("debit")).alias("debit"),
            or_zero(F.sum("credit")).alias("credit"),
            F.count("moves").alias("moved"),
        )
        .withColumn("balance", or_zero(F.col("debit") - F.col("credit")))
        .where(F.col("include_zero_lines") | (F.col("balance") != 0))
        .where((F.col("moved") > 0) | ~grouped)
    )
    return _described(books, sums)


def _described(books: Books, sums: DataFrame) -> DataFrame:
    """Account, analytic and currency columns for the summed lines."""
    accounts = books.accounts.select(
        F.col("id").alias("account_id"), F.col("code").alias("account_code"),
        F.col("name").alias("account_name"), F.col("internal_type").alias("account_type"),
    )
    analytics = books.analytics.select(
        F.col("id").alias("analytic"), F.col("code").alias("known_code"), F.col("name").alias("known_name")
    )
    currencies = books.companies.select(F.col("id").alias("company_id"), "currency_id")
    unassigned = F.col("analytic") == 0
    return (
        sums.join(accounts, "account_id")
        .join(analytics, "analytic", "left")
        .join(currencies, "company_id", "left")
        .withColumns({
            "analytic_account_id": F.nullif("analytic", F.lit(0)),
            "analytic_code": F.when(unassigned, NO_ANALYTIC_CODE).otherwise(F.col("known_code")),
            "analytic_name": F.when(unassigned, NO_ANALYTIC_NAME).otherwise(F.col("known_name")),
            "balance_color": balance_color(F.col("balance")),
        })
        .select(*LINE_COLUMNS)
    )


def touched_reports(books: Books, reports: DataFrame, changed: DataFrame) -> DataFrame:
    """The ids of the complete reports that changed lines can show in: posted ones, on an account of the
    report and inside its period.

    The lines shrink to the days of each account. A report reads the number of such days up to
    the one before its period and up to the last in it, in one window per account; if they differ,
    it is touched. So the work grows with the days plus the reports' accounts, however the
    periods overlap.
    """
    complete, _ = validate_reports(reports)
    asked = _report_accounts(books, complete).where("date_start <= date_end")
    keys = ["company_id", "account_id"]
    days = changed.where((F.col("parent_state") == "posted") & F.col("date").isNotNull()).select(*keys, "date").distinct()
    near = asked.join(days.select(*keys).distinct(), keys, "left_semi")
    ends = F.explode(F.array(
        F.struct(F.date_sub("date_start", 1).alias("date"), F.lit(-1).alias("sign")),
        F.struct(F.col("date_end").alias("date"), F.lit(1).alias("sign")),
    ))
    probes = near.select(*keys, "report_id", ends.alias("end")).select(*keys, "report_id", "end.date", "end.sign")
    so_far = (
        Window.partitionBy(*keys).orderBy("date", F.col("sign").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = days.withColumn("day", F.lit(1)).unionByName(probes, allowMissingColumns=True).select(
        "report_id", *keys, "sign", (F.count("day").over(so_far) * F.col("sign")).alias("days")
    )
    inside = counted.where(F.col("sign").isNotNull()).groupBy("report_id", *keys).agg(F.sum("days").alias("days"))
    return inside.where("days > 0").select("report_id").distinct()


def report_totals(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """Debit, credit and balance of each report, zero for a report without lines.

    Amounts of companies with different currencies are added as they are.
    """
    sums = lines.groupBy("report_id").agg(
        *[F.sum(c).alias(f"total_{c}") for c in ("debit", "credit", "balance")]
    )
    return reports.select("report_id").join(sums, "report_id", "left").select(
        "report_id",
        *[or_zero(F.col(c)).alias(c) for c in ("total_debit", "total_credit", "total_balance")],
    )
