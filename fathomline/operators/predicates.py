"""Metadata predicates: a small operator language that becomes Catalyst expressions before the scan.

A filter is a dict. {"field": value} means equality, {"field": [..]} membership, {"field": {"$gt": 1}} an operator;
{"$and": [..]} and {"$or": [..]} combine filters. Fields and operators are checked against a schema first: an
unknown field is skipped with a note; a value of a wrong type is kept with a note, or dropped when strict.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Operators that a field type allows.
_EQUAL, _ORDER, _SET = ("$eq", "$ne", "$exists"), ("$gt", "$gte", "$lt", "$lte"), ("$in", "$nin")
OPERATORS = {
    "string": (*_EQUAL, *_SET), "integer": (*_EQUAL, *_ORDER, *_SET), "number": (*_EQUAL, *_ORDER, *_SET), "float": (*_EQUAL, *_ORDER, *_SET),
    "boolean": _EQUAL, "date": (*_EQUAL, *_ORDER), "timestamp": (*_EQUAL, *_ORDER), "list": ("$in", "$nin", "$all", "$exists"),
}
_PYTHON = {"string": str, "integer": int, "number": (int, float), "float": float, "boolean": bool, "date": str, "timestamp": (int, float, str), "list": object}


@dataclass(frozen=True)
class Field:
    kind: str
    column: str | None = None
    allowed: tuple = ()


@dataclass
class Built:
    predicate: Column | None = None
    notes: list[str] = field(default_factory=list)


def _fits(f: Field, value: Any) -> bool:
    if isinstance(value, bool) and f.kind != "boolean":
        return False
    return isinstance(value, _PYTHON[f.kind]) and (not f.allowed or value in f.allowed)


def _compare(column: Column, op: str, value: Any, kind: str) -> Column:
    if op in _SET and kind == "list":
        hit = F.arrays_overlap(column, F.array(*map(F.lit, value)))
        return hit if op == "$in" else ~hit
    return {
        "$eq": lambda: column == F.lit(value), "$ne": lambda: ~column.eqNullSafe(F.lit(value)), "$gt": lambda: column > value, "$gte": lambda: column >= value,
        "$lt": lambda: column < value, "$lte": lambda: column <= value, "$in": lambda: column.isin(list(value)), "$nin": lambda: ~F.coalesce(column.isin(list(value)), F.lit(False)),
        "$all": lambda: F.size(F.array_except(F.array(*map(F.lit, value)), column)) == 0, "$exists": lambda: column.isNotNull() if value else column.isNull(),
    }[op]()


def simple(schema: dict[str, Field], name: str, value: Any, op: str = "$eq", strict: bool = False) -> Built:
    f = schema.get(name)
    if f is None:
        return Built(None, [f"{name}: unknown field"])
    if op not in OPERATORS[f.kind]:
        return Built(None, [f"{name}: {op} does not go with {f.kind}"])
    notes = []
    if op in (*_SET, "$all"):
        value = list(value) if isinstance(value, (list, tuple, set)) else [value]
        good = [v for v in value if _fits(f, v)]
        if len(good) < len(value):
            notes.append(f"{name}: values of a wrong kind")
            if strict and not good:
                return Built(None, notes)
            value = good or value
    elif op != "$exists" and not _fits(f, value):
        notes.append(f"{name}: a value of a wrong kind")
        if strict:
            return Built(None, notes)
    return Built(_compare(F.col(f.column or name), op, value, f.kind), notes)


def combine(parts: list[Built], how: str = "$and") -> Built:
    if how not in ("$and", "$or"):
        raise ValueError(f"{how} does not combine filters")
    found = [p.predicate for p in parts if p.predicate is not None]
    both = (lambda a, b: a & b) if how == "$and" else (lambda a, b: a | b)
    return Built(reduce(both, found) if found else None, [n for p in parts for n in p.notes])


def build(schema: dict[str, Field], spec: dict[str, Any], strict: bool = False, without: tuple[str, ...] = ()) -> Built:
    parts = []
    for name, value in spec.items():
        if name in without:
            continue
        if name in ("$and", "$or"):
            parts.append(combine([build(schema, x, strict, without) for x in value], name))
        elif isinstance(value, dict):
            parts += [simple(schema, name, v, op, strict) for op, v in value.items()]
        else:
            parts.append(simple(schema, name, value, "$in" if isinstance(value, (list, tuple, set)) else "$eq", strict))
    return combine(parts)


def from_template(schema: dict[str, Field], template: dict[str, str], values: dict[str, Any], strict: bool = False) -> Built:
    """A template names the operator of each field; fields without a value are left out."""
    return combine([simple(schema, n, values[n], op, strict) for n, op in template.items() if n in values])


#: Filter keys an agent's plan may not set.
AGENT_MAY_NOT = ("subject", "chapter", "course")


def full(schema: dict[str, Field], preset: dict[str, Any], additional: dict[str, Any] | None = None, templates: dict[str, dict[str, str]] | None = None, values: dict[str, Any] | None = None, strict: bool = False, without: tuple[str, ...] = ()) -> Built:
    """Everything a retrieval filters by: a preset's filters, additional ones, and the templates that are named among the values."""
    named = [t for name, t in (templates or {}).items() if (values or {}).get(name)]
    parts = [build(schema, preset, strict), build(schema, additional or {}, strict, without), *(from_template(schema, t, values or {}, strict) for t in named)]
    return combine(parts)


def schema_of(struct: StructType, names: dict[str, str] | None = None) -> dict[str, Field]:
    """Fields of a table's schema, under names of their own where given."""
    kinds = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "double": "number", "float": "number"}
    own = {column: name for name, column in (names or {}).items()}
    out = {}
    for f in struct.fields:
        simple_name = f.dataType.simpleString()
        kind = "list" if simple_name.startswith("array") else "number" if simple_name.startswith("decimal") else kinds.get(simple_name, "integer")
        out[own.get(f.name, f.name)] = Field(kind, f.name)
    return out


def fields(schema: dict[str, Field]) -> list[tuple[str, str, str]]:
    """name, kind, column of every field, by name."""
    return sorted((n, f.kind, f.column or n) for n, f in schema.items())
