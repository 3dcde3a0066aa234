"""Money stays DECIMAL; only ratios and chart values become DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jarledger.schemas import MONEY, MONEY_OUT


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def money_out(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY_OUT)


def to_double(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def signed_amount(op: Column, amount: Column) -> Column:
    """Queue signing: withdraw -> -|a|, add -> |a|, anything else -> null."""
    return (
        F.when(op == "withdraw", -F.abs(amount))
        .when(op == "add", F.abs(amount))
    )
