"""Row scoping: data origin, tombstones and role-based row policies."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGINS = ("real", "demo")

#: Policy dimensions whose values are lists that combine by union.
LIST_DIMENSIONS = ("workspace_ids", "clouds", "cluster_sources", "billing_origins")

DENY_ALL = "__deny_all__"


def clamp_origin(mode: str | None) -> str:
    """Anything that is not a known origin means ``real``."""
    mode = (mode or "").strip().lower()
    return mode if mode in ORIGINS else "real"


def scope_origin(df: DataFrame, mode: str | None = "real") -> DataFrame:
    """Rows of one origin that are not tombstoned. ``None`` leaves the frame unscoped."""
    if mode is None:
        return df
    if "data_origin" in df.columns:
        df = df.filter(F.col("data_origin") == clamp_origin(mode))
    if "deleted_at" in df.columns:
        df = df.filter(F.col("deleted_at").isNull())
    return df


def _one_of(column: str, values: Iterable) -> Column:
    return F.col(column).isin([str(v) for v in values])


def _policy(df: DataFrame, policy: Mapping | None, dimensions: Mapping[str, str]) -> DataFrame:
    if not policy:
        return df
    if policy.get(DENY_ALL):
        return df.filter(F.lit(False))
    for dimension, column in dimensions.items():
        if policy.get(dimension):
            df = df.filter(_one_of(column, policy[dimension]))
    return df


def scope_billing_policy(df: DataFrame, policy: Mapping | None) -> DataFrame:
    """Workspaces, clouds and billing origins by membership; SKU patterns as alternatives."""
    df = _policy(
        df, policy, {"workspace_ids": "workspace_id", "clouds": "cloud", "billing_origins": "billing_origin_product"}
    )
    patterns = (policy or {}).get("sku_name_patterns")
    if patterns:
        condition = F.lit(False)
        for pattern in patterns:
            condition = condition | F.col("sku_name").ilike(pattern)
        df = df.filter(condition)
    return df


def scope_cluster_policy(df: DataFrame, policy: Mapping | None) -> DataFrame:
    return _policy(df, policy, {"workspace_ids": "workspace_id", "cluster_sources": "cluster_source"})


def scope_workspace_policy(df: DataFrame, policy: Mapping | None) -> DataFrame:
    """Warehouses, jobs, workspaces and query history are restricted by workspace only."""
    return _policy(df, policy, {"workspace_ids": "workspace_id"})


def scope_price_policy(df: DataFrame, policy: Mapping | None) -> DataFrame:
    """Price lists carry no policy dimension."""
    return df


def effective_policy(roles: Sequence[Mapping] | None, is_admin: bool = False) -> dict | None:
    """Combine the roles of one person into one policy (``None`` means unrestricted).

    A role is ``{"is_system": bool, "filters": {...}}``. System roles never restrict and never unlock.
    """
    if is_admin:
        return None
    if not roles:
        return {DENY_ALL: True}
    custom = [dict(r.get("filters") or {}) for r in roles if not r.get("is_system")]
    if not custom:
        return None
    policy: dict = {}
    for dimension in LIST_DIMENSIONS:
        granted = [f.get(dimension) for f in custom]
        if all(granted):
            policy[dimension] = sorted({str(v) for values in granted for v in values})
    patterns = [f.get("sku_name_pattern") for f in custom]
    if all(patterns):
        policy["sku_name_patterns"] = sorted(set(patterns))
    return policy or None


def effective_policy_table(role_filters: DataFrame) -> DataFrame:
    """The same rule for many people at once.

    Input: one row per (user, role, is_system, dim, value); a role without filters has one row with NULL ``dim``.
    Output: (user, dim, value) for each restricted dimension. A person without rows here is unrestricted.
    """
    custom = role_filters.filter(~F.col("is_system"))
    roles = custom.groupBy("user").agg(F.countDistinct("role").alias("n_roles"))
    restricted = (
        custom.filter(F.col("dim").isNotNull())
        .groupBy("user", "dim")
        .agg(F.countDistinct("role").alias("n_with"))
        .join(roles, "user")
        .filter(F.col("n_with") == F.col("n_roles"))
        .select("user", "dim")
    )
    return custom.select("user", "dim", "value").distinct().join(restricted, ["user", "dim"])


def policy_join(df: DataFrame, policy: DataFrame, dimension: str, column: str) -> DataFrame:
    """Row-level security for many people in one job: each restricted person paired with the rows they may see.

    People without a row for ``dimension`` in ``policy`` are unrestricted there and read ``df`` itself, so no pairing
    is made for them. Aggregate ``df`` to the policy columns first when only totals are wanted: the join then works on
    groups and not on rows, and a hot value costs one row.
    """
    allowed = policy.filter(F.col("dim") == dimension).select("user", F.col("value").alias("_value")).distinct()
    return df.join(allowed, F.col(column) == F.col("_value")).select("user", *df.columns)


def scoped_views(
    spark: SparkSession, tables: Mapping[str, DataFrame], mode: str | None = "real", policy: Mapping | None = None
) -> dict[str, DataFrame]:
    """Register every table as a temp view of the same name with the scope built in, for ad-hoc SQL."""
    by_policy = {
        "billing_usage": scope_billing_policy,
        "clusters": scope_cluster_policy,
        "warehouses": scope_workspace_policy,
        "jobs": scope_workspace_policy,
        "workspaces": scope_workspace_policy,
        "query_history": scope_workspace_policy,
        "qi_statements": scope_workspace_policy,
    }
    out = {}
    for name, df in tables.items():
        scoped = scope_origin(df, mode)
        if policy and policy.get(DENY_ALL):
            scoped = scoped.filter(F.lit(False))
        elif name in by_policy and (name != "jobs" or "workspace_id" in scoped.columns):
            scoped = by_policy[name](scoped, policy)
        scoped.createOrReplaceTempView(name)
        out[name] = scoped
    return out


def policy_dimension_values(usage: DataFrame, clusters: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct values offered for each policy dimension, sorted; with ``limit`` only the first of each dimension."""

    def values(df: DataFrame, dimension: str, column: str) -> DataFrame:
        distinct = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
        head = distinct if limit is None else distinct.orderBy("value").limit(limit)
        return head.select(F.lit(dimension).alias("dimension"), "value")

    return (
        values(usage, "workspace_ids", "workspace_id")
        .unionByName(values(usage, "clouds", "cloud"))
        .unionByName(values(usage, "billing_origins", "billing_origin_product"))
        .unionByName(values(clusters, "cluster_sources", "cluster_source"))
    )


#: Permitted first keywords and refused keywords of the three read-only guards.
SAFETY_RULES = {
    "spark": {
        "first": ("SELECT", "WITH", "SHOW", "DESCRIBE", "DESC", "EXPLAIN"),
        "refused": (
            "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "REPLACE",
            "MERGE", "COPY", "OPTIMIZE", "VACUUM", "CACHE", "UNCACHE", "CLEAR", "RESET", "SET", "REFRESH",
            "ANALYZE", "MSCK", "ATTACH", "DETACH", "USE",
        ),
        "fence": False,
    },
    "explorer": {
        "first": ("SELECT", "WITH"),
        "refused": (
            "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "COMMENT",
            "REINDEX", "VACUUM", "ANALYZE", "CLUSTER", "COPY", "CALL", "DO", "SET", "RESET", "PREPARE",
            "DEALLOCATE", "LISTEN", "NOTIFY", "LOCK", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT",
        ),
        "fence": False,
    },
    "chat": {
        "first": ("SELECT", "WITH"),
        "refused": (
            "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "ATTACH", "DETACH", "COPY",
            "EXPORT", "PRAGMA", "SET", "CALL",
        ),
        "fence": True,
    },
}


def sql_text_safety(df: DataFrame, column: str, rules: str = "spark") -> DataFrame:
    """Add ``is_safe`` and ``reason`` for statements that should be single and read-only.

    Reasons: ``empty``, ``fence``, ``multiple_statements``, ``first_keyword``, ``refused:<KEYWORD>``.
    """
    rule = SAFETY_RULES[rules]
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    refused = F.upper(F.regexp_extract(bare, r"(?i)\b(" + "|".join(rule["refused"]) + r")\b", 1))
    reason = F.when(bare == "", F.lit("empty"))
    if rule["fence"]:
        reason = reason.when(bare.contains("```"), F.lit("fence"))
    reason = (
        reason.when(F.regexp_replace(bare, ";+$", "").contains(";"), F.lit("multiple_statements"))
        .when(~bare.rlike(r"(?i)^(" + "|".join(rule["first"]) + r")\b"), F.lit("first_keyword"))
        .when(refused != "", F.concat(F.lit("refused:"), refused))
    )
    return df.withColumn("reason", reason).withColumn("is_safe", F.col("reason").isNull())
