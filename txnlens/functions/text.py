"""String functions: phone numbers, padded ids, account digits, report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnlens.constants import HIGH_RISK, MEDIUM_RISK


def normalize_phone(phone: Column | str) -> Column:
    """Strip everything but digits and keep the last ten behind ``+1``."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.concat(F.lit("+1"), F.right(digits, F.lit(10)))


def zero_pad(number: Column | str, width: int) -> Column:
    """Pad with zeros to a width; a longer number is kept whole."""
    text = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def is_digits(text: Column | str) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike("^[0-9]+$")


def shift_digit(digit: Column, shift: Column) -> Column:
    """(digit + shift) mod 10, as text."""
    return F.pmod(digit.cast("int") + shift, F.lit(10)).cast("string")


def differs(left: Column, right: Column) -> Column:
    """Not equal, where a missing value differs from everything, another missing value too."""
    return F.coalesce(left != right, F.lit(True))


def risk_band(probability: Column | str) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p >= HIGH_RISK, "High").when(p >= MEDIUM_RISK, "Medium").otherwise("Low")


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def dollar_text(amount: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def short_date_text(ts: Column | str) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")
