"""The privacy lattice and the role tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scopes from least to most sensitive, roles and their ceilings and permissions.
PRIVACY_ORDER = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
ROLE_CEILING = {"VIEWER": "INTERNAL", "ENGINEER": "CONFIDENTIAL", "ADMIN": "RESTRICTED"}
ROLE_PERMISSIONS = {
    "VIEWER": ("organization:read", "members:read", "facts:read", "decisions:read"),
    "ENGINEER": (
        "organization:read",
        "members:read",
        "facts:read",
        "decisions:read",
        "facts:write",
        "decisions:record",
    ),
    "ADMIN": (
        "organization:read",
        "members:read",
        "members:manage",
        "facts:read",
        "facts:write",
        "facts:revoke",
        "decisions:read",
        "decisions:record",
        "audit:read",
    ),
}


def scope_ordinal(scope: Column | str) -> Column:
    """0..3 for a known scope, null otherwise."""
    c = F.col(scope) if isinstance(scope, str) else scope
    position = F.array_position(F.array(*[F.lit(s) for s in PRIVACY_ORDER]), c)
    return F.when(position > 0, (position - 1).cast("int"))


def scope_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in PRIVACY_ORDER]), (ordinal + 1).cast("int"))


def role_ordinal(role: Column) -> Column:
    """The most sensitive scope a role may read, as an ordinal."""
    out = F.lit(None).cast("int")
    for name, scope in ROLE_CEILING.items():
        out = F.when(role == name, PRIVACY_ORDER.index(scope)).otherwise(out)
    return out


def visible_ordinal(role: Column, *ceilings: Column) -> Column:
    """Role ceiling narrowed by every given (nullable) scope ceiling; never widened."""
    parts = [role_ordinal(role)] + [scope_ordinal(c) for c in ceilings]
    return parts[0] if len(parts) == 1 else F.least(*parts)


def max_scope(a: Column, b: Column) -> Column:
    """The more sensitive of two scopes."""
    return scope_name(F.greatest(scope_ordinal(a), scope_ordinal(b)))


def ceiling_of(scope: str) -> int:
    return PRIVACY_ORDER.index(scope)


def visible(scope: Column | str, ceiling: str | Column) -> Column:
    limit = F.lit(ceiling_of(ceiling)) if isinstance(ceiling, str) else ceiling
    return scope_ordinal(scope) <= limit
