"""Lookups, access rules and job lifecycle joins.

No join carries a broadcast hint: Catalyst broadcasts a side only when its
measured size is below the threshold, and adaptive execution splits skewed
partitions of the joins it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions import status as st
from paperfold.functions.text import compare_key
from paperfold.plans.pick import pick_first, pick_last

# Badges left by a replacement, fields a job hands to its log.
BADGE_PLAIN, BADGE_VERIFIED, BADGE_PENDING = "Dictionary", "Vibe Dictionary", "Vibe Dictionary (Pending AI)"
LOG_FIELDS = ("status", "extracted_data", "preview_data", "debug_data", "error", "token_usage")
NO_MESSAGE = "Unknown Error (No error message provided by caller)"


def with_name(df: DataFrame, dimension: DataFrame, key: str, name: str, default: Column | str = "Unknown") -> DataFrame:
    fallback = F.lit(default) if isinstance(default, str) else default
    return df.join(dimension.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), fallback))


def attach_synonyms(models: DataFrame, synonyms: DataFrame, order: str) -> DataFrame:
    """(model, field, raw) -> entry as a table; the last of equal raw values wins.

    Kept long on purpose: one model may own any number of synonyms.
    """
    usable = synonyms.where((F.coalesce("field_name", F.lit("")) != "") & (F.coalesce("raw_val", F.lit("")) != ""))
    last = pick_last(usable, ["model_id", "field_name", "raw_val"], [order])
    return models.join(last, "model_id", "left")


def replace_by_reference(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """Exact replacement by (sub_key, value), else by (table_key, value), with a badge.

    ``reference(field_name, raw_val, standard, is_verified)``; a null
    ``is_verified`` marks a plain dictionary value.
    """
    def side(prefix: str, key: str) -> DataFrame:
        return reference.select(F.col("field_name").alias(key), F.col("raw_val").alias("value"),
                                F.struct("standard", "is_verified").alias(prefix))

    out = cells.join(side("__own", "sub_key"), ["sub_key", "value"], "left")
    out = out.join(side("__table", "table_key"), ["table_key", "value"], "left")
    hit = F.coalesce("__own", "__table")
    verified = hit["is_verified"]
    badge = F.when(hit.isNotNull(), F.when(verified.isNull(), BADGE_PLAIN).when(verified, BADGE_VERIFIED).otherwise(BADGE_PENDING))
    return out.select(
        *[c for c in cells.columns if c != "value"], F.coalesce(hit["standard"], F.col("value")).alias("value"),
        F.when(hit.isNotNull(), F.col("value")).alias("modified_from"), badge.alias("modifier"))


def replace_verified(cells: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Verified synonyms only; ``raw_value`` keeps an earlier original when set."""
    known = synonyms.where(F.col("is_verified") & (F.coalesce("standard", F.lit("")) != "")).select(
        F.col("field_name").alias("field_key"), F.col("raw_val").alias("value"), "standard")
    out = cells.join(known, ["field_key", "value"], "left")
    hit = F.col("standard").isNotNull()
    return out.select(
        *[c for c in cells.columns if c not in ("value", "raw_value")],
        F.coalesce("standard", "value").alias("value"),
        F.when(hit, F.coalesce("raw_value", "value")).otherwise(F.col("raw_value")).alias("raw_value"),
        F.when(hit, BADGE_VERIFIED).alias("modifier"))


def check_access(requests: DataFrame, super_users: DataFrame, group_grants: DataFrame, models: DataFrame,
                 direct: DataFrame) -> DataFrame:
    """Reason why a (user, model) request is allowed, null when it is not.

    Wildcards (super users, public models) stay single rows and are looked up
    on one key each, so users are never multiplied by models.
    """
    out = requests.join(super_users.distinct().withColumn("__super", F.lit(True)), "user_id", "left")
    out = out.join(group_grants.select("user_id", "model_id").distinct().withColumn("__group", F.lit(True)),
                   ["user_id", "model_id"], "left")
    out = out.join(models.select("model_id", "is_public", "owner_id"), "model_id", "left")
    out = out.join(direct.select("user_id", "model_id").distinct().withColumn("__direct", F.lit(True)),
                   ["user_id", "model_id"], "left")
    reason = (F.when(F.col("__super"), "super_admin").when(F.col("__group"), "group")
              .when(F.col("is_public"), "public").when(F.col("owner_id") == F.col("user_id"), "owner")
              .when(F.col("__direct"), "user"))
    return out.select(*requests.columns, reason.alias("reason"))


def first_group_role(members: DataFrame, grants: DataFrame) -> DataFrame:
    """Role per (user, model): the first group, in group order, that grants the model."""
    both = members.join(grants, "group_id")
    return pick_first(both, ["user_id", "model_id"], ["group_order", "group_id"], ["group_id", "role"])


def resolve_groups(imports: DataFrame, groups: DataFrame, users: DataFrame) -> DataFrame:
    """Imported (email, group_name) rows with group id and created/updated outcome; unknown groups keep null."""
    named = groups.select(F.lower(F.trim("group_name")).alias("__g"), "group_id")
    known = users.select(F.lower("email").alias("__e")).distinct().withColumn("__known", F.lit(True))
    out = imports.withColumns({"__g": F.lower(F.trim("group_name")), "__e": F.lower("email")})
    out = out.join(named, "__g", "left").join(known, "__e", "left")
    return out.select(*imports.columns, "group_id", F.when(F.col("__known"), "updated").otherwise("created").alias("outcome"))


def expected_check(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """PASS when equal without blanks; ``lenient`` also allows one edit on longer values."""
    out = rows.join(expected, key, "left")
    a, b = compare_key(F.coalesce("value", F.lit(""))), compare_key(F.coalesce("expected", F.lit("")))
    same = (a != "") & (a == b)
    near = (F.length(a) > 2) & (F.length(b) > 2) & (F.levenshtein(a, b, 1) >= 0)
    return out.withColumns({"strict": F.when(same, "PASS").otherwise("FAIL"),
                            "lenient": F.when(same | near, "PASS").otherwise("FAIL")})


def latest_job(jobs: DataFrame) -> DataFrame:
    return pick_last(jobs, ["log_id"], ["created_at", "job_id"])


def propagate(logs: DataFrame, jobs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """White-listed fields of the latest job override those of its log; nulls do not."""
    allowed = [f for f in fields if f in LOG_FIELDS]
    last = latest_job(jobs).select("log_id", "job_id", *[F.col(f).alias(f"__j_{f}") for f in allowed])
    out = logs.join(last, "log_id", "left")
    return out.select(
        *[c for c in logs.columns if c not in allowed],
        *[F.coalesce(f"__j_{f}", f).alias(f) for f in allowed], "job_id")


def plan_retries(logs: DataFrame, models: DataFrame, jobs: DataFrame) -> DataFrame:
    """New pending jobs that inherit the candidate files of the latest job, or the reject reason."""
    last = latest_job(jobs).select("log_id", "candidates")
    out = logs.join(models.select("model_id", F.lit(True).alias("__model")), "model_id", "left").join(last, "log_id", "left")
    reject = F.when(F.col("file_url").isNull(), "no file").when(F.col("__model").isNull(), "model not found")
    return out.select(
        "log_id", "model_id", F.when(reject.isNull(), st.PENDING).alias("status"),
        F.when(reject.isNull(), F.col("candidates")).alias("candidates"), reject.alias("reject_reason"))


def publish(models: DataFrame, drafts: DataFrame) -> DataFrame:
    """Listed drafts become published, their parents archived."""
    listed = models.where(F.col("status") == "DRAFT").join(drafts, "model_id", "left_semi")
    ids = listed.select("model_id", F.lit(True).alias("__pub"))
    parents = listed.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("model_id"), F.lit(True).alias("__arch")).distinct()
    out = models.join(ids, "model_id", "left").join(parents, "model_id", "left")
    return out.select(
        *[c for c in models.columns if c not in ("status", "version")],
        F.when(F.col("__pub"), "PUBLISHED").when(F.col("__arch"), "ARCHIVED").otherwise(F.col("status")).alias("status"),
        F.when(F.col("__pub"), F.substring_index("version", "-draft", 1)).otherwise(F.col("version")).alias("version"))
