"""Row-level security: permissive policies admit (any of them), restrictive ones must all hold; none applies: no rows."""

from __future__ import annotations


def predicate(policies: list, operation: str, role: str | None, check: bool = False) -> str:
    """The condition that a role's rows satisfy, in SQL; policies have operation, roles, restrictive, using, check."""
    mine = [p for p in policies if p.operation in ("ALL", operation) and (not p.roles or role in p.roles or "public" in [r.lower() for r in p.roles])]
    condition = lambda p: (p.check or p.using if check else p.using) or "TRUE"
    admit = [condition(p) for p in mine if not p.restrictive]
    demand = [condition(p) for p in mine if p.restrictive]
    if not admit:
        return "FALSE"
    return " AND ".join([f"({' OR '.join(f'coalesce({c}, FALSE)' for c in admit)})", *(f"coalesce({c}, FALSE)" for c in demand)])
