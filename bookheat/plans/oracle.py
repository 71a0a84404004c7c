"""SQL building blocks for the DuckDB check of the registered queries."""

from __future__ import annotations

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, *needs: str) -> None:
    """Register a named CTE and the CTEs it reads."""
    _CTES[name] = (needs, sql)


def with_ctes(names: str | list[str], final: str) -> str:
    """``final`` preceded by the named CTEs and all they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in [names] if isinstance(names, str) else names:
        visit(n)
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{_CTES[n][1]}\n)" for n in order)
    return f"WITH {body}\n{final}"
