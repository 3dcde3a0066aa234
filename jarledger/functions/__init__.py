"""Column expressions shared by the operators (all JVM-side built-ins)."""

from jarledger.functions.money import money, money_out, signed_amount, to_double
from jarledger.functions.dates import day_key, weekday_label, month_day_label, day_month_label, time_text_en
from jarledger.functions.display import currency_code, currency_symbol, entry_label, sign_char

__all__ = [
    "money", "money_out", "signed_amount", "to_double",
    "day_key", "weekday_label", "month_day_label", "day_month_label", "time_text_en",
    "currency_code", "currency_symbol", "entry_label", "sign_char",
]
