"""Sorting, paging and tails of report tables, and their label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, sort: str, key: list[str], allowed: list[str], descending: bool = True, limit: int = 20, offset: int = 0, nulls_last: bool = False) -> DataFrame:
    """One page: a whitelisted sort column, then the key; nulls come first on descending order unless nulls_last."""
    if sort not in allowed:
        raise ValueError(f"can't sort by {sort}")
    c = F.col(sort)
    first = (c.desc_nulls_last() if nulls_last else c.desc_nulls_first()) if descending else (c.asc_nulls_last())
    return df.orderBy(first, *[F.col(k).asc_nulls_last() for k in key]).offset(offset).limit(max(1, min(limit, 100)))


def collapse_tail(df: DataFrame, keys: list[str], by: str, top: int) -> DataFrame:
    """The top rows by a measure, and one row (is_other, keys null) with the sums of all others. df is an aggregate."""
    numbers = [c for c in df.columns if c not in keys]
    order = Window.orderBy(F.col(by).desc(), *[F.col(k).asc_nulls_last() for k in keys])
    ranked = df.withColumn("is_other", F.row_number().over(order) > top)
    ranked = ranked.select(*[F.when(~F.col("is_other"), F.col(k)).alias(k) for k in keys], *numbers, "is_other", F.when(~F.col("is_other"), F.row_number().over(order)).alias("_rank"))
    return ranked.groupBy(*keys, "is_other", "_rank").agg(*[F.sum(n).alias(n) for n in numbers]).drop("_rank")


def join_application(df: DataFrame, applications: DataFrame, project: str = "root_project", key: str = "root_entity_id") -> DataFrame:
    dim = applications.select(F.col("project_id").alias(project), F.col("id").alias(key), F.col("name").alias("app_name"), "kind")
    return df.join(dim, [project, key], "left")


def join_skill(df: DataFrame, skills: DataFrame, project: str = "skill_project", key: str = "skill_id") -> DataFrame:
    dim = skills.select(F.col("project_id").alias(project), F.col("id").alias(key), F.col("name").alias("skill_name"), "is_public")
    return df.join(dim, [project, key], "left")


def join_version(df: DataFrame, versions: DataFrame, key: str = "root_entity_version_id", stored: str | None = None) -> DataFrame:
    """version_label: the version's name, else what the stored name has in brackets at its end, else its number."""
    dim = versions.select(F.col("version_id").alias(key), "version_name")
    suffix = F.lit(None).cast("string") if stored is None else F.nullif(F.regexp_extract(stored, r" \(([^()]*)\)$", 1), F.lit(""))
    label = F.coalesce("version_name", suffix, F.when(F.col(key).isNotNull(), F.concat(F.lit("Version #"), F.col(key).cast("string"))))
    return df.join(dim, key, "left").withColumn("version_label", label).drop("version_name")


def join_user(df: DataFrame, users: DataFrame, stored: str = "stored_email") -> DataFrame:
    """user_label: the directory's email, else the stored one; System for actor 0. user_deleted: not in the directory."""
    joined = df.join(users.select("user_id", "email"), "user_id", "left")
    system = F.col("user_id") == 0
    label = F.when(system, "System").otherwise(F.coalesce("email", stored))
    return joined.withColumn("user_label", label).withColumn("user_deleted", ~system & F.col("email").isNull()).drop("email", stored)


def join_model(df: DataFrame, models: DataFrame) -> DataFrame:
    """model_label: the name for the row's scope, else for any scope, else the raw one; a suffix tells scopes apart.

    df has model_name and scope, one row for each pair.
    """
    own = models.select("model_name", "scope", "display_name")
    any_scope = models.groupBy("model_name").agg(F.min("display_name").alias("any_name"))
    seen = Window.partitionBy("model_name")
    joined = df.join(own, ["model_name", "scope"], "left").join(any_scope, "model_name", "left")
    label = F.coalesce("display_name", "any_name", "model_name")
    twice = F.size(F.collect_set("scope").over(seen)) > 1
    suffix = F.when(F.col("scope") == "own", " (project)").otherwise(" (shared)")
    return joined.withColumn("model_label", F.when(twice, F.concat(label, suffix)).otherwise(label)).drop("display_name", "any_name")


def join_conversation(df: DataFrame, conversations: DataFrame, reader: int) -> DataFrame:
    """chat_name as the reader may see it: deleted where the directory has none, private unless the reader wrote it."""
    dim = conversations.select(F.col("uuid").alias("conversation_id"), F.col("chat_name").alias("_name"), "is_private", "author_id")
    hidden = F.col("is_private") & (F.col("author_id") != reader)
    name = F.when(F.col("_name").isNull(), "Deleted chat").when(hidden, "Private chat").otherwise(F.col("_name"))
    return df.join(dim, "conversation_id", "left").withColumn("chat_label", name).drop("_name", "is_private", "author_id")


def join_feature_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "feature", "left").withColumn("label", F.coalesce("label", "feature"))
