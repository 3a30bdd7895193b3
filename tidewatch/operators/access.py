"""Effective permissions and authorisation checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The permissions of each role.
ROLE_PERMISSIONS = {
    "admin": ["cluster:create", "cluster:read", "cluster:update", "cluster:delete",
              "topic:create", "topic:read", "topic:update", "topic:delete", "topic:purge",
              "admin:read", "admin:write",
              "broker:provision", "broker:bind", "broker:unbind", "broker:deprovision",
              "cleanup:execute", "cleanup:read"],
    "operator": ["cluster:read", "cluster:update", "topic:create", "topic:read", "topic:update", "topic:delete",
                 "cleanup:execute", "cleanup:read"],
    "developer": ["cluster:read", "topic:create", "topic:read", "topic:update", "topic:delete", "cleanup:read"],
    "viewer": ["cluster:read", "topic:read", "cleanup:read"],
    "service_broker": ["broker:provision", "broker:bind", "broker:unbind", "broker:deprovision",
                       "cluster:create", "cluster:read", "cluster:delete"],
}


def role_permissions() -> Column:
    return F.create_map(*[c for role, names in ROLE_PERMISSIONS.items()
                          for c in (F.lit(role), F.array(*[F.lit(n) for n in names]))])


def effective_permissions(roles: Column, direct: Column) -> Column:
    """Direct and role-derived permissions as a distinct array; unknown roles add none. No join, no shuffle."""
    granted = F.flatten(F.transform(F.array_compact(roles), lambda r: F.coalesce(
        F.try_element_at(role_permissions(), r), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array_compact(direct), granted))


def permission_rows(users: DataFrame, key: str, roles: str, direct: str) -> DataFrame:
    return users.select(key, F.explode(effective_permissions(F.col(roles), F.col(direct))).alias("permission"))


def has_all(held: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), held)) == 0


def has_any(held: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(held, F.array(*[F.lit(w) for w in wanted]))


def authorised(permissions: Column, roles: Column, permission: str | None = None, role: str | None = None,
               any_permissions: Sequence[str] = (), any_roles: Sequence[str] = (), require_all: bool = False) -> Column:
    """Whether every stated demand is met; lists demand one member, or all with ``require_all``."""
    check = has_all if require_all else has_any
    result = F.lit(True)
    if permission:
        result = result & F.array_contains(permissions, permission)
    if role:
        result = result & F.array_contains(roles, role)
    if any_permissions:
        result = result & check(permissions, any_permissions)
    if any_roles:
        result = result & check(roles, any_roles)
    return F.coalesce(result, F.lit(False))
