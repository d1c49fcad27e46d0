"""Row expansion and fan-out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExpandRule:
    """Rows whose ``match_field`` holds ``match_value`` become one row per value."""

    match_field: str | None
    match_value: str | None
    expand_field: str | None
    expand_values: Sequence[str] = ()
    expand_codes: Sequence[str] = ()
    code_field: str | None = None

    @property
    def complete(self) -> bool:
        return bool(self.expand_field and self.expand_values)


def expand_group_codes(df: DataFrame, rules: Sequence[ExpandRule]) -> DataFrame:
    """Apply the rules in sequence; each explodes a literal list, so nothing is shuffled."""
    if "_transformed" not in df.columns:
        df = df.withColumn("_transformed", F.lit(False))
    for rule in rules:
        if not rule.complete:
            continue
        if rule.match_value == "*":
            hit: Column = F.lit(True)
        elif rule.match_value and rule.match_field:
            cell, want = F.upper(F.trim(F.col(rule.match_field))), rule.match_value.strip().upper()
            hit = F.coalesce(F.contains(cell, F.lit(want)), F.lit(False))
        else:
            continue
        members = F.array(*[
            F.struct(F.lit(v).alias("value"),
                     F.lit(rule.expand_codes[i] if i < len(rule.expand_codes) else None).cast("string").alias("code"))
            for i, v in enumerate(rule.expand_values)])
        none = F.array(F.lit(None).cast("struct<value:string,code:string>"))
        out = df.withColumn("__hit", hit).withColumn("__m", F.explode(F.when(F.col("__hit"), members).otherwise(none)))
        new = {rule.expand_field: F.when(F.col("__hit"), F.col("__m.value")).otherwise(
            F.col(rule.expand_field) if rule.expand_field in df.columns else F.lit(None))}
        if rule.code_field:
            old = F.col(rule.code_field) if rule.code_field in df.columns else F.lit(None)
            new[rule.code_field] = F.coalesce(F.when(F.col("__hit"), F.col("__m.code")), old)
        new["_transformed"] = F.col("_transformed") | F.col("__hit")
        df = out.withColumns(new).drop("__hit", "__m")
    return df


def sub_documents(df: DataFrame, subs: str, name: str, log_id: str) -> DataFrame:
    """One log per successful sub-document; names get a suffix when there are several, the first reuses the log."""
    out = df.select(*df.columns, F.size(subs).alias("__n"), F.posexplode(subs).alias("__i", "__s")).where(
        F.col("__s.status") == "success")
    title = F.when(F.col("__n") > 1, F.concat(F.col(name), F.lit(" (Doc "), F.col("__s.index").cast("string"), F.lit(")"))).otherwise(F.col(name))
    return out.select(*[c for c in df.columns if c not in (subs, name, log_id)], title.alias(name),
                      F.when(F.col("__i") == 0, F.col(log_id)).alias(log_id), F.col("__s.data").alias("data"))


def candidates(jobs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Baseline to candidates in their order; one without a result is empty with its error."""
    each = jobs.select(key, F.posexplode("candidates").alias("candidate_index", "candidate_id"))
    out = each.join(results, [key, "candidate_id"], "left")
    return out.select(key, "candidate_index", "candidate_id", F.coalesce("differences", F.lit(0)).alias("differences"),
                      F.when(F.col("differences").isNull(), F.coalesce("error", F.lit("no result"))).alias("error"))
