"""Membership checks and redaction as joins and column expressions (data-level only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.privacy import ROLE_PERMISSIONS, visible


def _granted(role: Column, permission: Column) -> Column:
    out = F.lit(False)
    for name, permissions in ROLE_PERMISSIONS.items():
        out = F.when(role == name, permission.isin(*permissions)).otherwise(out)
    return out


def authorize(requests: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allowed requests with the current role, and denied ones with a reason.

    ``requests``: ``request_id, organization_id, user_id, permission, token_scopes`` (null: no token
    limit). The current membership decides, not what the caller claims.
    """
    m = memberships.where(F.coalesce("is_active", F.lit(True))).select("organization_id", "user_id", "role")
    r = requests.join(m, ["organization_id", "user_id"], "left")
    reason = (
        F.when(F.col("role").isNull(), "not_a_member")
        .when(~_granted(F.col("role"), F.col("permission")), "role_lacks_permission")
        .when(
            F.col("token_scopes").isNotNull() & ~F.array_contains("token_scopes", F.col("permission")),
            "token_scope_lacks_permission",
        )
    )
    r = r.withColumn("reason", reason)
    return r.where(F.col("reason").isNull()).drop("reason"), r.where(F.col("reason").isNotNull())


def members(memberships: DataFrame) -> DataFrame:
    """How many members each tenant has per role."""
    return memberships.groupBy("organization_id", "role").agg(F.count(F.lit(1)).alias("members"))


def redact(df: DataFrame, ceiling: str | Column, hide: list[str]) -> DataFrame:
    """Keep every row; null the given columns of rows above the ceiling and say so."""
    seen = visible("privacy_scope", ceiling)
    out = df.withColumn("redacted", ~seen)
    for c in hide:
        out = out.withColumn(c, F.when(~F.col("redacted"), F.col(c)))
    return out
