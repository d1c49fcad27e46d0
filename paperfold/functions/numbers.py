"""Number parsing and money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped from number text, currency codes, numeric shape.
NUMBER_NOISE = "[,₩$원]"
CURRENCIES = "USD|EUR|KRW|JPY|CNY|GBP"
NUMERIC_SHAPE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_CODE_FIRST = rf"(?i)({CURRENCIES})\s*([0-9.,]+)"
_CODE_LAST = rf"(?i)([0-9.,]+)\s*({CURRENCIES})"


def parse_number(c: Column) -> Column:
    """Number after dropping thousands and currency marks, null when it is none.

    The shape guard keeps out texts a cast would accept: ``12d``, ``nan``.
    """
    bare = F.trim(F.regexp_replace(c, NUMBER_NOISE, ""))
    return F.when(bare.rlike(NUMERIC_SHAPE), bare.try_cast("double"))


def looks_numeric(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").rlike(NUMERIC_SHAPE)


def currency_amount(c: Column) -> Column:
    """Amount text beside a currency code ("USD 16" before "16 USD"), else null."""
    return (
        F.when(c.rlike(_CODE_FIRST), F.regexp_extract(c, _CODE_FIRST, 2))
        .when(c.rlike(_CODE_LAST), F.regexp_extract(c, _CODE_LAST, 1))
    )


def currency_code(c: Column) -> Column:
    return (
        F.when(c.rlike(_CODE_FIRST), F.upper(F.regexp_extract(c, _CODE_FIRST, 1)))
        .when(c.rlike(_CODE_LAST), F.upper(F.regexp_extract(c, _CODE_LAST, 2)))
    )


def percent_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """part/whole in percent, rounded half up from integers; 0 for an empty whole."""
    scale = 10 ** digits
    return F.coalesce(
        F.floor(F.try_divide(part * (100 * scale), whole) + 0.5) / scale, F.lit(0.0)
    )


def half_up(c: Column, digits: int) -> Column:
    """Round half up by floor, so that other engines give the same double."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def shown(c: Column, style: str) -> Column:
    """Display text: currency, number, percent, date or plain; '-' for null."""
    if style == "currency":
        text = F.concat(F.lit("₩"), F.format_number(c, 2))
    elif style == "number":
        text = F.format_number(c, 2)
    elif style == "percent":
        text = F.concat(c.cast("string"), F.lit("%"))
    elif style == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("-"))
