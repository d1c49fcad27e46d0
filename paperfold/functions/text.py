"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_TEXT_LIMIT = 32000
TRUNCATION_MARK = "... (truncated)"


def compare_key(c: Column) -> Column:
    """Value without any white space, for blank-insensitive comparison."""
    return F.regexp_replace(c, r"\s+", "")


def normal_key(c: Column) -> Column:
    """Field key without case, underscore, hyphen and blank."""
    return F.lower(F.regexp_replace(c, "[_\\- ]", ""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.]", "")


def iso_separators(c: Column) -> Column:
    return F.regexp_replace(c, "[./]", "-")


def capped(c: Column, limit: int = CELL_TEXT_LIMIT, mark: str = TRUNCATION_MARK) -> Column:
    """Text cut at ``limit`` characters with a marker when cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def token_estimate(c: Column, per_token: int = 4) -> Column:
    return F.floor(F.length(c) / per_token).cast("bigint")


def is_entity(c: Column) -> Column:
    """Digit, long all-upper word, currency sign, or a word holding Hangul."""
    has_case = F.upper(c) != F.lower(c)
    return (
        c.rlike(r"[0-9]")
        | ((F.length(c) > 2) & has_case & (c == F.upper(c)))
        | c.rlike("[$€£₩]")
        | ((F.length(c) >= 2) & c.rlike("[가-힣]"))
    )


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"\.[^./?#]+$", 0))


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), "\n", " ")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))
