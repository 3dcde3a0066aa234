"""Savings-ledger analytics as Spark DataFrame jobs.

Every operator is a plain function ``op(df, ..., *, as_of=...) -> DataFrame``
that declares its plan with the DataFrame API; Catalyst and AQE pick the
physical strategy.  Money stays DECIMAL, days are UTC calendar days and "now"
is always an explicit ``as_of`` date.
"""

__all__ = ["session", "schemas"]
