"""Field constraints, post rules and their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.functions import numbers as num
from paperfold.functions import text as tx

COMPLEX_TYPES = ("array", "list", "object", "table")


def is_pattern(pattern: str) -> bool:
    """Whether the executors' regular expressions can be made of it; asked before any row is read."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"^(?:{pattern})")
    except IllegalArgumentException:
        return False
    return True


def constraint_status(value: Column, kind: str, required: bool = False,
                      pattern: str | None = None) -> Column:
    """Status of one field value; a later check overrides an earlier one.

    A pattern that is no regular expression checks nothing.
    """
    filled = value.isNotNull() & (value != "")
    status = F.lit("valid")
    if required:
        status = F.when(~filled | value.isNull(), "error_missing_required").otherwise(status)
    if pattern and is_pattern(pattern):
        status = F.when(filled & ~value.rlike(f"^(?:{pattern})"), "error_format_invalid").otherwise(status)
    if kind in COMPLEX_TYPES:
        v = F.trim(value)
        bracketed = (v.startswith("[") & v.endswith("]")) | (v.startswith("{") & v.endswith("}"))
        status = F.when(bracketed & F.try_parse_json(v).isNull(), "error_json_format").otherwise(status)
    elif kind == "number":
        status = F.when(filled & num.parse_number(value).isNull(), "error_type_mismatch").otherwise(status)
    elif kind == "date":
        status = F.when(filled & (F.length(value) < 6), "error_date_format").otherwise(status)
    return status


# Names of the post rules and the badges they leave.
RULE_BADGES = {
    "split_currency": "Rule: Split Currency",
    "extract_digits": "Rule: Extract Digits",
    "uppercase": "Rule: Uppercase",
    "date_format_iso": "Rule: Date ISO Format",
}


def _rule_output(action: str, v: Column) -> Column:
    if action == "split_currency":
        return F.coalesce(num.currency_amount(v), v)
    if action == "extract_digits":
        return tx.digits_only(v)
    if action == "uppercase":
        return F.upper(v)
    if action == "date_format_iso":
        return tx.iso_separators(v)
    raise ValueError(f"unknown rule action {action}")


def apply_post_rules(df: DataFrame, column: str, actions: Sequence[str]) -> DataFrame:
    """Run the rules on ``column`` in order; adds ``modifier`` and ``modified_from``.

    Each rule sees what the one before left; blank values are not touched.
    One projection per rule keeps the plan linear in the number of rules.
    """
    out = df.withColumns({
        "modifier": F.lit(None).cast("string"), "modified_from": F.lit(None).cast("string"),
    })
    for action in actions:
        old, new = F.col(column), F.col("__new")
        out = out.withColumn("__new", _rule_output(action, old))
        changed = (F.trim(old) != "") & new.isNotNull() & (new != old)
        out = out.withColumns({
            column: F.when(changed, new).otherwise(old),
            "modifier": F.when(changed, RULE_BADGES[action]).otherwise(F.col("modifier")),
            "modified_from": F.when(changed, old).otherwise(F.col("modified_from")),
        }).drop("__new")
    return out
