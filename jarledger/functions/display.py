"""Display texts of the feed: currency symbols, entry labels, sign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the app's texts.
# Currency symbols: EUR €, USD $, UAH ₴, GBP £ (any other code is shown as is).
CURRENCY_SYMBOLS = {"EUR": "€", "USD": "$", "UAH": "₴", "GBP": "£"}
# Entry labels per language (deposit, withdrawal, today):
#   en: Deposit, Withdrawal, Today
#   de: Einzahlung, Auszahlung, Heute
#   uk: Внесення, Зняття, Сьогодні
ENTRY_LABELS = {
    "en": ("Deposit", "Withdrawal", "Today"),
    "de": ("Einzahlung", "Auszahlung", "Heute"),
    "uk": ("Внесення", "Зняття", "Сьогодні"),
}
# Feed dates: what follows the day, and the short month names (English has its own 12-hour form).
DAY_MARKS = {"de": ".", "uk": ""}
SHORT_MONTHS = {
    "de": ["Jan.", "Feb.", "März", "Apr.", "Mai", "Juni", "Juli", "Aug.", "Sept.", "Okt.", "Nov.", "Dez."],
    "uk": ["січ.", "лют.", "бер.", "квіт.", "трав.", "черв.", "лип.", "серп.", "вер.", "жовт.", "лист.", "груд."],
}
# Minus sign used for withdrawals (U+2212), plus for the rest.
MINUS = "−"
PLUS = "+"
DEFAULT_CURRENCY = "EUR"


def currency_code(c: Column, empty_is_missing: bool = False) -> Column:
    """Null currency means EUR; codes compare upper-cased.  Conversion also
    treats an empty code as missing (``||``), display does not (``??``)."""
    if empty_is_missing:
        c = F.nullif(c, F.lit(""))
    return F.upper(F.coalesce(c, F.lit(DEFAULT_CURRENCY)))


def currency_symbol(c: Column) -> Column:
    code = currency_code(c)
    expr = None
    for k, sym in CURRENCY_SYMBOLS.items():
        expr = (F.when(code == k, F.lit(sym)) if expr is None else expr.when(code == k, F.lit(sym)))
    return expr.otherwise(code)


def sign_char(amount: Column) -> Column:
    return F.when(amount < 0, F.lit(MINUS)).otherwise(F.lit(PLUS))


def entry_label(note: Column, amount: Column, deposit: Column, withdrawal: Column) -> Column:
    """An empty note falls back to the label (empty string counts as missing)."""
    return F.coalesce(F.nullif(note, F.lit("")), F.when(amount < 0, withdrawal).otherwise(deposit))


def label_dictionary(spark: SparkSession) -> DataFrame:
    """Three-row dictionary (language, deposit, withdrawal, today, day_mark,
    months); a fixed, bounded table, safe to broadcast."""
    rows = [(lang, *texts, DAY_MARKS.get(lang), SHORT_MONTHS.get(lang)) for lang, texts in ENTRY_LABELS.items()]
    return spark.createDataFrame(rows, "language STRING, deposit STRING, withdrawal STRING, today STRING, "
                                       "day_mark STRING, months ARRAY<STRING>")
