"""Date text and retention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


# What parts a date, and the signs behind year, month and day in Korean.
_SLASHES, _KOREAN_SIGNS = "./", ("년", "월", "일")


def parse_date(c: Column) -> Column:
    """ISO date text of a text that begins with a date; any other text stays, a blank one is null.

    The text is cut once into its leading numbers and what follows each.  The signs behind them say which form it is, and
    the number of four digits is the year: first, the rest is month and day; last, month and day stand before it.
    """
    v = F.trim(c)
    numbers = F.transform(F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0)), lambda n: F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")))
    signs = F.slice(F.split(v, r"\d+"), 2, 3)
    first, second, third = (F.get(numbers, F.lit(k)) for k in range(3))
    sign = [F.get(signs, F.lit(k)) for k in range(3)]
    korean = (F.rtrim(sign[0]) == _KOREAN_SIGNS[0]) & (F.rtrim(sign[1]) == _KOREAN_SIGNS[1]) & sign[2].startswith(_KOREAN_SIGNS[2])
    parted = sign[0].isin(*_SLASHES) & sign[1].isin(*_SLASHES)
    digits = v.rlike(r"^\d")
    short = lambda n: F.length(n) == 2
    year_first = (F.length(first) == 4) & short(second) & ((korean & short(third)) | (parted & third.isNotNull()))
    year_last = short(first) & short(second) & (F.length(third) >= 4) & parted
    day = F.left(third, F.lit(2))
    return (
        F.when(v == "", None)
        .when(digits & year_first, F.concat_ws("-", first, second, day))
        .when(digits & year_last, F.concat_ws("-", F.left(third, F.lit(4)), first, second))
        .otherwise(v)
    )


def expires_at(created: Column, days: Column) -> Column:
    """Creation time plus a retention of ``days`` days counted in seconds."""
    seconds = days.cast("bigint") * SECONDS_PER_DAY
    return created + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
