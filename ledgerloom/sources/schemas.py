"""Canonical schemas: the columns the operators read, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# A line's amount, and a sum of amounts. 18 digits would overflow on a journal of 10^12 lines.
AMOUNT = T.DecimalType(15, 2)
MONEY = T.DecimalType(28, 2)

LINES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("move_id", T.LongType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("partner_id", T.LongType()),
    T.StructField("journal_id", T.LongType()),
    T.StructField("company_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("ref", T.StringType()),
    T.StructField("debit", AMOUNT),
    T.StructField("credit", AMOUNT),
    T.StructField("parent_state", T.StringType()),
    T.StructField("analytic_account_id", T.LongType()),
])

MOVES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("state", T.StringType()),
])

ACCOUNTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("code", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("internal_type", T.StringType()),
    T.StructField("company_id", T.LongType()),
    T.StructField("deprecated", T.BooleanType()),
])

COMPANIES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("currency_id", T.LongType()),
])

ANALYTICS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("code", T.StringType()),
    T.StructField("name", T.StringType()),
])

REPORTS = T.StructType([
    T.StructField("report_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("report_type", T.StringType()),
    T.StructField("date_start", T.DateType()),
    T.StructField("date_end", T.DateType()),
    T.StructField("company_ids", T.ArrayType(T.LongType())),
    T.StructField("analytic_account_ids", T.ArrayType(T.LongType())),
    T.StructField("include_zero_lines", T.BooleanType()),
    T.StructField("group_by_analytic", T.BooleanType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to the schema's columns, cast to the schema's types.

    Casts to a column's own type vanish in the optimizer, so a table that already has
    the right types is scanned as it is, with filters pushed down to the files.
    """
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
