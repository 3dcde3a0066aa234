"""Text rules of the entry forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what the forms' trim() takes for white space.
BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def js_trim(text: Column) -> Column:
    """The text without white space at its ends (``F.trim`` takes off spaces only)."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def leading_number(text: Column) -> Column:
    """The number that a text starts with, as the forms read it; null without one."""
    number = F.regexp_extract(js_trim(text), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return number.try_cast("decimal(12,2)")
