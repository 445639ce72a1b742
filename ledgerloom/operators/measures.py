"""Named measures of the financial statements: which accounts, and with which sign."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Account types and code prefixes of the statements.
INCOME = "income"
EXPENSE = "expense"
ASSET = "asset"
LIABILITY = "liability"
EQUITY = "equity"
COST_OF_SALES_CODE = "5"
CURRENT_ASSET_CODE = "1"
NON_CURRENT_ASSET_CODE = "16"
CURRENT_LIABILITY_CODE = "2"
NON_CURRENT_LIABILITY_CODE = "27"
DEPRECIATION_CODE = "681"
PROVISION_CODE = "682"
CAPITAL_CODE = "16"
CASH_CODE = "1011"
BANK_CODE = "1012"


def is_type(*types: str) -> Column:
    return F.col("internal_type").isin(*types)


def coded(prefix: str) -> Column:
    """Null for an account without code: neither inside nor outside the prefix."""
    return F.col("code").startswith(prefix)


@dataclass(frozen=True)
class Measure:
    """Sum of ``debit - credit`` (or its reverse) over the accounts that satisfy ``accounts``.

    Works on account totals, where ``amount`` is that difference.
    """

    accounts: Column
    credit_side: bool = False

    def total(self, amount: str | Column = "amount") -> Column:
        amount = F.col(amount) if isinstance(amount, str) else amount
        return F.sum(F.when(self.accounts, -amount if self.credit_side else amount))


def income_measures() -> dict[str, Measure]:
    return {
        "revenue": Measure(is_type(INCOME), credit_side=True),
        "cost_of_sales": Measure(is_type(EXPENSE) & coded(COST_OF_SALES_CODE)),
        "operating_expenses": Measure(is_type(EXPENSE) & ~coded(COST_OF_SALES_CODE)),
        "all_expenses": Measure(is_type(EXPENSE)),
    }


def balance_measures() -> dict[str, Measure]:
    """The buckets overlap by prefix (``16`` is inside ``1``) and need not add up."""
    return {
        "current_assets": Measure(is_type(ASSET) & coded(CURRENT_ASSET_CODE)),
        "non_current_assets": Measure(is_type(ASSET) & coded(NON_CURRENT_ASSET_CODE)),
        "total_assets": Measure(is_type(ASSET)),
        "current_liabilities": Measure(is_type(LIABILITY) & coded(CURRENT_LIABILITY_CODE), credit_side=True),
        "non_current_liabilities": Measure(
            is_type(LIABILITY) & coded(NON_CURRENT_LIABILITY_CODE), credit_side=True
        ),
        "total_liabilities": Measure(is_type(LIABILITY), credit_side=True),
        "total_equity": Measure(is_type(EQUITY), credit_side=True),
        "total_liabilities_equity": Measure(is_type(LIABILITY, EQUITY), credit_side=True),
    }


def result_measure() -> Measure:
    """Income less expenses, as one sum."""
    return Measure(is_type(INCOME, EXPENSE), credit_side=True)


def is_cash() -> Column:
    return coded(CASH_CODE) | coded(BANK_CODE)
