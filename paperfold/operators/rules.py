"""User rules as Spark SQL expressions, pluggable extractors, routes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions import files
from paperfold.operators.chunking import PAGE_LIMIT, PAYLOAD_LIMIT
from paperfold.operators import calculate as ca
from paperfold.operators.nested import cartesian_explode

ERROR_TYPE = "array<struct<severity:string,message:string,check:string>>"


@dataclass(frozen=True)
class Rule:
    """EXPLODE(sources, preserve, output) | CALCULATE(field, expression, condition, target_list) | VALIDATE(check, severity, message).

    With ``output`` the combinations become a list of rows instead of rows; with ``target_list`` a calculation is made for
    each row of such a list.
    """

    name: str
    kind: str
    config: dict = field(default_factory=dict)
    enabled: bool = True


def with_len(expression: str) -> str:
    """``len(x)`` of a rule text as Spark's ``size(x)``."""
    return re.sub(r"\blen\s*\(", "size(", expression)


def validate(df: DataFrame, check: str, severity: str = "warning", message: str = "Validation failed") -> DataFrame:
    """Append an entry to ``validation_errors`` where the check fails or cannot be decided."""
    if "validation_errors" not in df.columns:
        df = df.withColumn("validation_errors", F.array().cast(ERROR_TYPE))
    entry = F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(check).alias("check"))
    # set to true where it holds: where it fails or cannot be decided nothing is set
    held = ca.assign_when(df.withColumn("__holds", F.lit(False)), "__holds", "true", with_len(check))
    return held.withColumn("validation_errors", F.when(F.col("__holds"), F.col("validation_errors")).otherwise(F.array_append("validation_errors", entry))).drop("__holds")


def _apply(df: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame | None]:
    """The rows after a rule and, for a calculation, the frame that marks what it left unchanged."""
    c = rule.config
    if rule.kind == "EXPLODE":
        if "output" in c:
            return ca.combinations(df, c["sources"], c.get("preserve", ()), c["output"]), None
        keep = c.get("preserve") or [x for x in df.columns if x not in c["sources"]]
        return cartesian_explode(df, c["sources"], keep), None
    if rule.kind == "CALCULATE":
        what = (c["field"], c["expression"], c.get("condition", "true"))
        return ca.calculated_items(df, c["target_list"], *what) if c.get("target_list") else ca.calculated(df, *what)
    if rule.kind == "VALIDATE":
        return validate(df, c["check"], c.get("severity", "warning"), c.get("message", "Validation failed")), None
    raise ValueError(f"unknown rule kind {rule.kind}")


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Run the enabled rules in order; returns the rows and an audit with one row per rule.

    A rule that does not resolve against the schema is recorded and skipped.  ``unchanged`` counts the rows (or items)
    that a calculation should have set but could not; it is counted when the audit is read.
    """
    audit, marked = [], []
    for n, rule in enumerate(rules):
        if not rule.enabled:
            audit.append((n, rule.name, rule.kind, "disabled", None))
            continue
        try:
            out, failed = _apply(df, rule)
            out.schema  # resolves the expressions before the rule counts as applied
            df = out
            audit.append((n, rule.name, rule.kind, "applied", None))
            if failed is not None:
                marked.append((n, failed))
        except (AnalysisException, ParseException, KeyError, ValueError) as e:
            audit.append((n, rule.name, rule.kind, "failed", type(e).__name__))
    told = df.sparkSession.createDataFrame(audit, "n int, rule string, kind string, outcome string, error string")
    counts = ca.failures(marked)
    if counts is None:
        return df, told.drop("n").withColumn("unchanged", F.lit(None).cast("bigint"))
    return df, told.join(counts, "n", "left").orderBy("n").drop("n")


Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def run_extractor(chunks: DataFrame, extractor: Extractor, schema: str | T.StructType) -> DataFrame:
    """Plug point for the per-chunk extraction: Arrow batches in, result rows out."""
    return chunks.mapInPandas(extractor, schema)


# a key of words, a colon or equals sign, and the value up to the end of its line or sentence, however long
PAIR_TEXT = r"([\p{L}\p{N}_][\p{L}\p{N}_ ]*?)[ \t\r\n]*[:=][ \t\r\n]*([^ \t\r\n][^\n.;]*)"
# the same pairs in one pass: a run of key characters is taken whole, and so are the blanks after it, whether a pair follows or not
PAIR = regex.compile(r"([\p{L}\p{N}_][\p{L}\p{N}_ ]*+)[ \t\r\n]*+(?:[:=][ \t\r\n]*+([^ \t\r\n][^\n.;]*+))?+")
PAIR_SCHEMA = "doc_id bigint, chunk_index bigint, field_key string, value string, confidence double"


def key_value_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for the model call: ``key: value`` pairs of a chunk."""
    for batch in batches:
        rows = [
            (doc, chunk, key.strip(" ").lower(), value.strip(" "), 0.7)
            for doc, chunk, text in zip(batch["doc_id"], batch["chunk_index"], batch["content"])
            if text and (":" in text or "=" in text)
            for key, value in PAIR.findall(text)
            if value
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "field_key", "value", "confidence"])


def extraction_route(name: Column, payload: Column, pages: Column, flags: dict[str, Column]) -> Column:
    """sheet | vision | multi_table | packed | single, the first that applies."""
    return (F.when(files.extension(name).isin(*files.SHEET_EXTENSIONS), "sheet")
            .when(flags["vision"], "vision").when(flags["multi_table"], "multi_table")
            .when(flags["packed"] | (payload > PAYLOAD_LIMIT) | (pages > PAGE_LIMIT), "packed").otherwise("single"))
