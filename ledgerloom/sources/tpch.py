"""Books derived from the TPC-H-like tables (``FIXTURES.md`` section 3).

Every order becomes a journal entry, every line item one debit and one credit line. The
operators never see where their books come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.sources import schemas
from ledgerloom.sources.books import Books

# Fixed values of the test data: code prefix and type by part key modulo 16.
CODE_PREFIXES = ["1011", "1012", "12", "16", "3", "20", "27", "4",
                 "50", "70", "75", "51", "60", "681", "682", None]
ACCOUNT_TYPES = ["asset"] * 5 + ["liability"] * 3 + ["equity"] + ["income"] * 2 + ["expense"] * 5

# Line ids that an order may use, and what is added to the number of an unknown analytic account.
IDS_PER_ORDER = 1 << 20
UNKNOWN_ANALYTIC = 1_000_000_000

# The columns read here, with the types of the files; stated, so that no job infers them.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string",
    "supplier": "s_suppkey bigint, s_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                " l_linestatus string, l_shipdate timestamp_ntz",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str | None], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _state() -> F.Column:
    return F.when(F.col("o_orderstatus") == "O", "draft").otherwise("posted")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    df = _read(spark, sf_dir, "region").select(
        (key + 1).alias("id"),
        F.when(key != 2, F.col("r_name")).alias("name"),
        (key % 2 + 1).alias("currency_id"),
    )
    return schemas.conform(df, schemas.COMPANIES)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kind = key % 16
    df = _read(spark, sf_dir, "part").select(
        (key + 1).alias("id"),
        F.concat(_pick(CODE_PREFIXES, kind), F.lpad(key.cast("string"), 6, "0")).alias("code"),
        F.col("p_name").alias("name"),
        _pick(ACCOUNT_TYPES, kind).alias("internal_type"),
        (F.expr("p_partkey div 16") % 5 + 1).alias("company_id"),
        (key % 11 == 0).alias("deprecated"),
    )
    return schemas.conform(df, schemas.ACCOUNTS)


def analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("s_suppkey") + 1
    df = _read(spark, sf_dir, "supplier").select(
        number.alias("id"),
        F.concat(F.lit("AN"), F.lpad(number.cast("string"), 9, "0")).alias("code"),
        F.col("s_name").alias("name"),
    )
    return schemas.conform(df, schemas.ANALYTICS)


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey") + 1
    df = _read(spark, sf_dir, "orders").select(
        number.alias("id"),
        F.concat(F.lit("MOVE/"), number.cast("string")).alias("name"),
        _state().alias("state"),
    )
    return schemas.conform(df, schemas.MOVES)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two journal lines per line item.

    The item number inside an order numbers the lines; the id leaves room for half a
    million items per order, and a longer order is an error. The window is pruned from every
    query that does not read ``id``. Every supplier is an analytic account; the fifth items
    of orders name one that does not exist. Items and orders meet by the number of their entry, so that
    lines lie as a join with the entries wants them.
    """
    in_order = Window.partitionBy("entry").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    items = _read(spark, sf_dir, "lineitem").withColumn("entry", F.col("l_orderkey") + 1)
    orders = _read(spark, sf_dir, "orders").withColumn("entry", F.col("o_orderkey") + 1)
    sides = items.withColumn("rn", F.row_number().over(in_order)).join(orders, "entry").withColumn(
        "side", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    number = F.when(F.col("rn") * 2 + 1 < IDS_PER_ORDER, F.col("rn") * 2).otherwise(
        F.raise_error(F.lit("an order has more items than line ids"))
    )
    price = F.col("l_extendedprice")
    analytic = F.col("l_suppkey") + 1 + F.when(F.col("l_linenumber") == 5, F.lit(UNKNOWN_ANALYTIC)).otherwise(F.lit(0))
    own_account = (F.col("side") == 0) | (F.col("l_linenumber") == 7)
    df = sides.select(
        ((F.col("entry") - 1) * IDS_PER_ORDER + number + F.col("side")).alias("id"),
        F.col("entry").alias("move_id"),
        F.when(own_account, F.col("l_partkey") + 1)
        .otherwise((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 200 + 1)
        .alias("account_id"),
        (F.col("o_custkey") + 1).alias("partner_id"),
        F.substring("o_orderpriority", 1, 1).alias("journal_id"),
        (F.col("o_custkey") % 5 + 1).alias("company_id"),
        F.when(F.col("l_quantity") == 13, None).otherwise(F.col("l_shipdate").cast("date")).alias("date"),
        F.concat("l_returnflag", "l_linestatus").alias("ref"),
        F.when(F.col("side") == 0, price).otherwise(F.lit(0.0)).alias("debit"),
        F.when(F.col("side") == 1, price).otherwise(F.lit(0.0)).alias("credit"),
        _state().alias("parent_state"),
        F.when(F.col("l_linenumber") % 3 != 0, analytic).alias("analytic_account_id"),
    )
    return schemas.conform(df, schemas.LINES)


def tpch_books(spark: SparkSession, sf_dir: str) -> Books:
    """The derived books. They are complete: lines are made by a join with the orders, and
    their company number is that of one of the regions 0 to 4."""
    return Books(
        lines=lines(spark, sf_dir),
        moves=moves(spark, sf_dir),
        accounts=accounts(spark, sf_dir),
        companies=companies(spark, sf_dir),
        analytics=analytics(spark, sf_dir),
        complete=True,
    )


def customer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report requests, one per customer, a good part of them incomplete."""
    key = F.col("c_custkey")
    start = F.make_date(1994 + (key % 5).cast("int"), F.lit(1), F.lit(1))
    df = _read(spark, sf_dir, "customer").select(
        (key + 1).alias("report_id"),
        F.when(key % 13 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "income")
        .when(F.col("c_mktsegment") == "FURNITURE", "balance")
        .when(F.col("c_mktsegment") == "MACHINERY", "cashflow")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "tax")
        .alias("report_type"),
        F.when(F.col("c_nationkey") != 3, start).alias("date_start"),
        F.when(F.col("c_nationkey") != 4, F.make_date(F.lit(1999), F.lit(12), F.lit(31))).alias("date_end"),
        F.when(key % 17 == 0, F.array().cast("array<bigint>"))
        .when(key % 19 == 0, None)
        .otherwise(F.array((key % 5 + 1).cast("bigint")))
        .alias("company_ids"),
        F.array().cast("array<bigint>").alias("analytic_account_ids"),
        F.lit(False).alias("include_zero_lines"),
        F.lit(True).alias("group_by_analytic"),
    )
    return schemas.conform(df, schemas.REPORTS)
