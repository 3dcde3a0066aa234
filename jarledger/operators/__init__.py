"""Ledger operators.  Each is a function of DataFrames returning a DataFrame."""
