"""The general ledger: posted lines with a running balance per account."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.amounts import (
    contains_ignoring_case, day, debit_less_credit, money,
)
from ledgerloom.sources.books import Books

LEDGER_COLUMNS = [
    "id", "date", "move_id", "move_name", "account_id", "partner_id", "journal_id", "ref",
    "debit", "credit", "balance", "company_currency_id",
]
LIST_COLUMNS = [
    "date", "move_name", "account_id", "journal_id", "partner_id", "ref", "debit", "credit", "balance",
]

# An account's day with more lines than this is cut into slots of as many consecutive ids.
# Ids are unique, so no slot holds more lines either.
ID_SPAN = 10_000_000


def default_order() -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in ("account_id", "date", "id")]


def ledger_base(books: Books) -> DataFrame:
    """Posted lines whose entry and company exist, without the balance."""
    return _named(books, _posted(books))


def _posted(books: Books) -> DataFrame:
    return books.lines.where(F.col("parent_state") == "posted")


def _named(books: Books, lines: DataFrame) -> DataFrame:
    """Lines with the name of their entry and the currency of their company; those that
    lack either drop out."""
    moves = books.moves.select(F.col("id").alias("move_id"), F.col("name").alias("move_name"))
    currencies = books.companies.select(
        F.col("id").alias("company_id"), F.col("currency_id").alias("company_currency_id")
    )
    return (
        lines.join(currencies, "company_id")
        .join(moves, "move_id")
        .select(*[c for c in LEDGER_COLUMNS if c != "balance"])
    )


def _in_ledger(books: Books, lines: DataFrame) -> DataFrame:
    """The posted lines that ``_named`` would keep, without naming them."""
    if books.complete:
        return lines
    moves = books.moves.select(F.col("id").alias("move_id"))
    companies = books.companies.select(F.col("id").alias("company_id"))
    return lines.join(companies, "company_id").join(moves, "move_id")


def general_ledger(books: Books, ordered: bool = False, id_span: int = ID_SPAN) -> DataFrame:
    """Every ledger line with the balance of its account up to and including it.

    The balance runs over ``(date, id)``, undated lines last, across all history. One
    account may hold a large share of the journal, so no task ever gets a whole account:
    an account is cut into days, and a day with more than ``id_span`` lines into slots of
    ``id_span`` consecutive ids. Sums made ahead of the shuffle give the opening balance of
    each day and slot, and the only pass over full lines is a window inside one of them.
    Groups are bounded by the calendar (days of an account), by the id range over
    ``id_span`` (slots of a day) and by ``id_span`` (lines of a slot).

    Filters on ``account_id`` and ``date`` reach the scan of the full lines; a date
    filter leaves the opening balances alone, which still count earlier lines. For a
    known period or account, ``ledger_between`` and ``ledger_search`` do less.
    """
    ledger = _with_balance(books, ledger_base(books), _opening_balances(books, books, id_span), id_span)
    return ledger.orderBy(*default_order()) if ordered else ledger


def arranged_ledger(books: Books, id_span: int = ID_SPAN) -> DataFrame:
    """The ledger with its partitions, and the lines in each, in default order; ``partition`` numbers them.

    Lines are dealt by ranges of account, day and slot, and the window that makes the balances
    goes through them in that order, so the order costs no shuffle of full lines beyond that of the
    balances. No task gets more of a day than ``id_span`` lines at once, as in ``general_ledger``.
    """
    return _with_balance(books, ledger_base(books), _opening_balances(books, books, id_span), id_span, arranged=True)


def _amounts(books: Books, *columns: str, busy: DataFrame | None = None) -> DataFrame:
    """The lines of the ledger, as ``columns`` and their amount; on ``busy`` days only, if given.

    These come first: where there are none, nothing else is read.
    """
    lines = _posted(books).select(*columns, "move_id", "company_id", debit_less_credit().alias("amount"))
    if busy is not None:
        lines = lines.join(busy, _on_busy_day())
    return _in_ledger(books, lines).select(*columns, "amount")


def _days_of(books: Books) -> DataFrame:
    """Movement and number of lines per account and day of the ledger: the one narrow pass over
    the journal that opening balances and busy days both start from.

    Both come as one value, and both uses filter by the number, so that Spark sees the same sums
    in them and makes them once. Complete books count the ids: where a window numbers the lines, as in
    derived books, this pass then reads what the full lines read, and both share one shuffle. It
    costs no other shuffle, as the ids go no further than the sums made ahead of it. Otherwise they
    would travel to the check of the entries."""
    ids = ["id"] if books.complete else []
    lines = _amounts(books, "account_id", "date", *ids)
    of_day = F.struct(F.sum("amount").alias("amount"), F.count(*ids or "*").alias("line_count"))
    return lines.groupBy("account_id", "date").agg(of_day.alias("of_day"))


def _day_sums(books: Books) -> DataFrame:
    """Movement per account and day of the ledger."""
    days = _days_of(books).where(F.col("of_day.line_count") >= 0)
    return days.select("account_id", "date", F.col("of_day.amount").alias("amount"))


def _busy_days(books: Books, id_span: int) -> DataFrame:
    """The days of an account with more than ``id_span`` lines, so at most one per
    ``id_span`` lines of the journal: few enough to go to every task, ahead of the full lines."""
    return (
        _days_of(books)
        .where(F.col("of_day.line_count") > id_span)
        .select(
            F.col("account_id").alias("busy_account"), F.col("date").alias("busy_date"), F.lit(True).alias("busy")
        )
        .hint("broadcast")
    )


def _on_busy_day() -> Column:
    return F.col("account_id").eqNullSafe(F.col("busy_account")) & F.col("date").eqNullSafe(F.col("busy_date"))


def _slot(id_span: int) -> Column:
    return F.expr(f"id div {int(id_span)}")


def _with_slot(books: Books, lines: DataFrame, id_span: int) -> DataFrame:
    """Lines with the slot they are in, null on days that are not cut."""
    return lines.join(_busy_days(books, id_span), _on_busy_day(), "left").select(
        *lines.columns, F.when(F.col("busy"), _slot(id_span)).alias("slot")
    )


def _days(books: Books, since: Column | None, carried: DataFrame | None = None) -> DataFrame:
    """Movement per account and day. All days before ``since`` count as the day before it; with
    ``carried``, the accounts' balances on that day, they are not looked at."""
    days = _day_sums(books)
    if since is None:
        return days
    if carried is not None:
        own = days.where(F.col("date") >= since).select("account_id", "date", "amount")
        return own.unionByName(carried.select("account_id", F.date_sub(since, 1).alias("date"), "amount"))
    clipped = F.when(F.col("date") < since, F.date_sub(since, 1)).otherwise(F.col("date"))
    return days.groupBy("account_id", clipped.alias("date")).agg(F.sum("amount").alias("amount"))


def _opening_balances(
    books: Books, period: Books, id_span: int, since: Column | None = None, carried: DataFrame | None = None
) -> DataFrame:
    """Balance of the account before each day and slot of ``period``, which begins with
    ``since``; absent where there is no earlier amount."""
    earlier_days = (
        Window.partitionBy("account_id").orderBy(F.col("date").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Keys under new aliases let Spark see that both uses of ``days`` start from the same sums.
    days = _days(books, since, carried).select(
        F.col("account_id").alias("account_id"),
        F.col("date").alias("date"),
        F.lit(None).cast("long").alias("slot"),
        F.sum("amount").over(earlier_days).alias("opening"),
    ).where(F.col("opening").isNotNull())

    busy = _busy_days(period, id_span)
    slots = (
        _amounts(period, "account_id", "date", "id", busy=busy)
        .groupBy("account_id", "date", _slot(id_span).alias("slot")).agg(F.sum("amount").alias("amount"))
    )
    # A busy day's opening balance travels through its slots as one more row ahead of them.
    earlier_slots = (
        Window.partitionBy("account_id", "date").orderBy(F.col("slot").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slot_openings = (
        days.join(busy, _on_busy_day()).select("account_id", "date", "slot", F.col("opening").alias("amount"))
        .unionByName(slots)
        .select("account_id", "date", "slot", F.sum("amount").over(earlier_slots).alias("opening"))
        .where(F.col("slot").isNotNull() & F.col("opening").isNotNull())
    )
    return days.unionByName(slot_openings)


def _with_balance(books: Books, base: DataFrame, openings: DataFrame, id_span: int, arranged: bool = False) -> DataFrame:
    """Running sum inside each day or slot, led by its opening balance (a row without id)."""
    rows, keys = openings.unionByName(_with_slot(books, base, id_span), allowMissingColumns=True), ["account_id", "date", "slot"]
    if arranged:
        # Nulls come last by columns of their own, since a window sorts what it is partitioned by with nulls first.
        # The partition's number comes first, so that who writes a folder for each finds the lines sorted by it.
        keys = ["no_account", "account_id", "no_date", "date", "slot"]
        rows = rows.withColumns({"no_account": F.col("account_id").isNull(), "no_date": F.col("date").isNull()}).repartitionByRange(*keys)
        rows, keys = rows.withColumn("partition", F.spark_partition_id().cast("long")), ["partition", *keys]
    so_far = (
        Window.partitionBy(*keys).orderBy(F.col("id").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ledger = rows.withColumn("balance", money(F.sum(F.coalesce("opening", debit_less_credit())).over(so_far))).where(F.col("id").isNotNull())
    if arranged:
        # As the window leaves them, so Spark does not sort again.
        return ledger.sortWithinPartitions(*keys, "id").select(*LEDGER_COLUMNS, "partition")
    return ledger.select(*LEDGER_COLUMNS)


def _balance_at(books: Books, chosen: DataFrame, id_span: int = ID_SPAN) -> DataFrame:
    """The chosen ledger lines with the balance that ``general_ledger`` gives them.

    Earlier days come as opening balances, so only lines that share an account and day with a
    chosen one go through the window, as bare amounts. A chosen line reads the sum right
    behind its own amount and carries its other columns along.
    """
    days = chosen.select(F.col("account_id").alias("own_account"), F.col("date").alias("own_date")).distinct()
    same_day = F.col("account_id").eqNullSafe(F.col("own_account")) & F.col("date").eqNullSafe(F.col("own_date"))
    amounts = _amounts(books, "account_id", "date", "id").join(days, same_day, "left_semi")
    openings = _opening_balances(books, books, id_span).join(days, same_day, "left_semi")
    readers = chosen.select("account_id", "date", "id", F.struct(*chosen.columns).alias("line"))
    so_far = (
        Window.partitionBy("account_id", "date", "slot")
        .orderBy(F.col("id").asc_nulls_first(), F.col("line").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        openings.unionByName(_with_slot(books, amounts.unionByName(readers, allowMissingColumns=True), id_span), allowMissingColumns=True)
        .withColumn("balance", money(F.sum(F.coalesce("opening", "amount")).over(so_far)))
        .where(F.col("line").isNotNull())
        .select("line.*", "balance")
        .select(*LEDGER_COLUMNS)
    )


def ledger_first_page(books: Books, size: int = 80) -> DataFrame:
    """The first ``size`` ledger lines in default order.

    All lines of an account ahead of a line on the page are on the page too, so the
    running balance of the page is that of the ledger. Only the page is named.
    """
    lines = _in_ledger(books, _posted(books)).orderBy(*default_order()).limit(size)
    so_far = (
        Window.partitionBy("account_id").orderBy(F.col("date").asc_nulls_last(), "id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _named(books, lines)
        .withColumn("balance", money(F.sum(debit_less_credit()).over(so_far)))
        .select(*LEDGER_COLUMNS)
        .orderBy(*default_order())
    )


def ledger_next_page(books: Books, account_id: int | None, date, id: int, size: int = 80) -> DataFrame:
    """The ``size`` ledger lines that follow the line with these keys in default order, after a
    page that ended with it; ``date`` is None for an undated line, ``account_id`` for one
    without account, which come last in the ledger.

    Their balances are the account's sums before the page's first line, plus the page's own.
    """
    own, when, number = F.col("account_id"), F.col("date"), F.col("id")
    if date is None:
        later = when.isNull() & (number > id)
    else:
        later = when.isNull() | (when > day(date)) | ((when == day(date)) & (number > id))
    same = own.eqNullSafe(F.lit(account_id))
    beyond = F.lit(False) if account_id is None else own.isNull() | (own > account_id)
    lines = _in_ledger(books, _posted(books).where(beyond | (same & later))).orderBy(*default_order()).limit(size)
    before = _amounts(replace(books, lines=books.lines.where(same & ~later)), "account_id")
    openings = before.groupBy(F.col("account_id").alias("own_account")).agg(F.sum("amount").alias("opening"))
    so_far = (
        Window.partitionBy("account_id").orderBy(F.col("date").asc_nulls_last(), "id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = F.sum(debit_less_credit()).over(so_far)
    return (
        _named(books, lines)
        .join(openings, F.col("account_id").eqNullSafe(F.col("own_account")), "left")
        .withColumn("balance", money(F.coalesce(sums + F.coalesce("opening", F.lit(0)), "opening")))
        .select(*LEDGER_COLUMNS)
        .orderBy(*default_order())
    )


def ledger_between(books: Books, date_start=None, date_end=None, carried: DataFrame | None = None) -> DataFrame:
    """Ledger lines of a period; their balance includes all earlier lines.

    Earlier lines shrink to one opening balance per account, later ones are not read. With
    ``carried`` (account_id, amount), balances before ``date_start`` that are known already, as
    ``sources.standing`` stores them, earlier lines are not read either.
    """
    if date_end is not None:
        books = replace(books, lines=books.between(None, date_end))
    since = None if date_start is None else day(date_start)
    period = replace(books, lines=books.between(date_start, None))
    known = since is not None and carried is not None
    openings = _opening_balances(period if known else books, period, ID_SPAN, since, carried)
    return _with_balance(period, ledger_base(period), openings, ID_SPAN)


def ledger_search(
    books: Books,
    account_id: int | None = None,
    partner_id: int | None = None,
    journal_id: int | None = None,
    move_name: str | None = None,
    ref: str | None = None,
    account: str | None = None,
) -> DataFrame:
    """Ledger lines that match all given terms: ids exactly, texts by substring. ``account`` is
    searched in the account's code and name.

    The balance is the account's, whether its other lines match or not.
    """
    if account_id is not None:
        books = replace(books, lines=books.lines.where(F.col("account_id") == account_id))
    if account is not None:
        named = contains_ignoring_case(F.col("code"), account) | contains_ignoring_case(F.col("name"), account)
        known = books.accounts.where(named).select(F.col("id").alias("account_id")).distinct()
        books = replace(books, lines=books.lines.join(known, "account_id", "left_semi"))
    terms = [F.col(name) == value for name, value in
             [("partner_id", partner_id), ("journal_id", journal_id)] if value is not None]
    terms += [contains_ignoring_case(F.col(name), text) for name, text in
              [("move_name", move_name), ("ref", ref)] if text is not None]
    if not terms:
        return general_ledger(books)
    found = ledger_base(books)
    for term in terms:
        found = found.where(term)
    return _balance_at(books, found)


def ledger_groups(books: Books, by: str | list[str] = "account_id", totals: bool = False) -> DataFrame:
    """Lines, debit and credit per account, journal or contact, or nested by several of them.

    ``totals`` adds a row per outer group and one for all lines. The column ``level``, the
    number of keys that hold for a row, tells such a row from a group of lines that have no
    contact. Totals are made from the groups, not from the lines.
    """
    keys = [by] if isinstance(by, str) else list(by)
    unknown = set(keys) - {"account_id", "journal_id", "partner_id"}
    if unknown or not keys:
        raise ValueError(f"cannot group the ledger by {by!r}")
    groups = _in_ledger(books, _posted(books)).groupBy(*keys).agg(
        F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.count("*").alias("line_count")
    )
    if totals:
        groups = groups.rollup(*keys).agg(
            (F.lit(len(keys)) - F.bit_count(F.grouping_id())).cast("long").alias("level"),
            F.sum("debit").alias("debit"),
            F.sum("credit").alias("credit"),
            F.sum("line_count").alias("line_count"),
        )
    return groups.withColumns({"debit": money(F.col("debit")), "credit": money(F.col("credit"))})


def move_of_line(books: Books, chosen: DataFrame | Column | Iterable[int]) -> DataFrame:
    """All lines of the journal entries that the chosen ledger lines belong to.

    The lines are chosen by a list of ids, a frame with an ``id`` column, or a condition on
    the columns of the lines. A line that is not in the ledger, or has no entry, opens
    nothing.
    """
    lines = _in_ledger(books, _posted(books))
    if isinstance(chosen, DataFrame):
        lines = lines.join(chosen.select("id"), "id", "left_semi")
    elif isinstance(chosen, Column):
        lines = lines.where(chosen)
    else:
        lines = lines.where(F.col("id").isin(list(chosen)))
    # An entry is wanted once, however many of its lines were chosen.
    entries = lines.select("move_id").distinct()
    return books.lines.join(entries, "move_id", "left_semi").select(*[c for c in books.lines.columns if c != books.month])
