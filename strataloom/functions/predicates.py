"""Search filters, given as nested dictionaries, as Columns; only whitelisted columns can be named."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Searchable:
    """The columns that filters and orders may name, with their type: text, number or date; aliases: names that stand for another column."""

    columns: Mapping[str, str]
    aliases: Mapping[str, str] = field(default_factory=dict)

    def column(self, ref: object) -> tuple[Column, str]:
        name = ref.get("var") if isinstance(ref, Mapping) else ref
        if not isinstance(name, str) or name not in self.columns:
            raise ValueError(f"not a searchable column: {name!r}")
        return F.col(self.aliases.get(name, name)), self.columns[name]


def value_of(value: object, kind: str) -> Column:
    """A literal; of dates the first ten characters count."""
    return F.to_date(F.lit(str(value)[:10])) if kind == "date" else F.lit(value)


def predicate(rule: Mapping, table: Searchable) -> Column:
    """One rule {operator: operands}.

    Rows in which a compared column is null do not pass, != included. On dates, == compares days. `in` is a
    substring test that ignores case. Three operands [low, column, high] ask for a range: open for < and >,
    closed for <= and >=.
    """
    if not rule:
        raise ValueError("an empty rule")
    ((op, operands),) = rule.items()
    if op in ("and", "or"):
        parts = [predicate(r, table) for r in operands]
        return reduce(lambda a, b: a & b if op == "and" else a | b, parts)
    if op == "in":
        needle, ref = operands
        column, _ = table.column(ref)
        return F.contains(F.lower(column), F.lit(str(needle).lower()))
    if op not in COMPARE:
        raise NotImplementedError(op)
    if len(operands) == 3:
        low, ref, high = operands
        column, kind = table.column(ref)
        compare = COMPARE["<=" if "=" in op else "<"]
        return compare(value_of(low, kind), column) & compare(column, value_of(high, kind))
    ref, value = operands
    column, kind = table.column(ref)
    if kind == "date" and op == "==":
        column = F.to_date(column)
    return COMPARE[op](column, value_of(value, kind))


def ordering(name: str | None, direction: str | None, table: Searchable, fallback: str | Column, tiebreak: str) -> list[Column]:
    """Order by a whitelisted column, ascending for 'asc' in any case and else descending. Without such a column the fallback holds as it is (a name: descending), whatever direction is asked. The tiebreak makes pages stable."""
    if name in table.columns:
        order = F.col(name).asc() if (direction or "").lower() == "asc" else F.col(name).desc()
    else:
        order = F.col(fallback).desc() if isinstance(fallback, str) else fallback
    return [order, F.col(tiebreak).desc()]


def page(rows, order: list[Column], number: int, size: int):
    """Page `number` (from 1) of rows: a top-k, the skipped rows included."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def like_literal(column: Column, needle: str) -> Column:
    """Substring test in which %, _ and ! mean themselves."""
    return F.contains(F.lower(column), F.lit(needle.lower()))
