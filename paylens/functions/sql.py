"""Names, literals and small building blocks of SQL expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date


def q(name: str) -> str:
    """A column name, quoted."""
    return "`" + name.replace("`", "``") + "`"


def lit(value) -> str:
    """A literal; Python floats are doubles, not decimals."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D" if abs(value) != float("inf") else f"double('{value}')"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def one_of(expr: str, values: Iterable) -> str:
    """Membership in a list; false for an empty list."""
    items = ", ".join(lit(v) for v in values)
    return f"{expr} IN ({items})" if items else "FALSE"


def let(value: str, name: str, body: str) -> str:
    """`body` with `name` standing for `value`, computed once however often the body uses it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def lookup(expr: str, entries: dict) -> str:
    """Value of a small fixed dictionary for an expression; null where it has no entry."""
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in entries.items())
    return f"CASE WHEN {expr} IS NOT NULL THEN try_element_at(map({pairs}), {expr}) END"


def not_null(columns: Sequence[str]) -> str:
    """All the columns have a value."""
    return " AND ".join(f"{q(c)} IS NOT NULL" for c in columns) or "TRUE"


def chain(expr: str, *steps: Callable[[str], str]) -> str:
    for step in steps:
        expr = step(expr)
    return expr
