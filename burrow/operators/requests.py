"""Requests in JSON: predicates on a value or on an entry's paths, and entry selections."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .index import Predicate, Tree

#: The names of the comparisons.
OPERATORS = {
    "=": "=", "==": "=", "eq": "=", "!=": "<>", "<>": "<>", "ne": "<>", "<": "<", "lt": "<", "<=": "<=", "le": "<=",
    ">": ">", "gt": ">", ">=": ">=", "ge": ">=", "between": "between", "in": "in",
}


@dataclass(frozen=True)
class PathPredicate:
    """A predicate that any or all of an entry's values of a path must fulfil; no values fulfil neither."""

    path: str
    predicate: Predicate
    quantifier: str = "any"


def loaded(request):
    return json.loads(request) if isinstance(request, str) else request


def comparison(item: dict) -> Predicate:
    if (op := OPERATORS.get(str(item.get("op", "")).lower())) is None:
        raise ValueError(f"unknown operator {item.get('op')!r}")
    values = item["values"] if "values" in item else item.get("value")
    values = tuple(values) if isinstance(values, list) else (values,)
    if not values or any(x is None or isinstance(x, (dict, list)) for x in values):
        raise ValueError(f"{op} needs constants")
    if len(values) != 2 if op == "between" else op != "in" and len(values) != 1:
        raise ValueError(f"{op} takes another number of constants than {len(values)}")
    return Predicate(op, values)


def value_predicate(request) -> Predicate | Tree:
    """``{"op", "value" or "values"}``, or ``{"and": [...]}`` or ``{"or": [...]}`` of such."""
    item = loaded(request)
    for join in ("and", "or"):
        if join in item:
            if not item[join]:
                raise ValueError(f"{join} of nothing")
            return Tree(join, tuple(value_predicate(x) for x in item[join]))
    return comparison(item)


def path_predicates(request) -> list[PathPredicate]:
    """An array of ``{"path", "op", "value" or "values", "quantifier"}``; an entry must fulfil all of them."""
    out = []
    for item in loaded(request):
        if not item.get("path"):
            raise ValueError("a path predicate needs a path")
        if (quantifier := item.get("quantifier", "any")) not in ("any", "all"):
            raise ValueError(f"unknown quantifier {quantifier!r}")
        out.append(PathPredicate(item["path"], comparison(item), quantifier))
    return out


def check_constants(predicate: Predicate | Tree, kind: str, path: str) -> None:
    """Constants must be of the values' kind: texts for texts, numbers for numbers."""
    for x in predicate.constants:
        if isinstance(x, str) != (kind == "text") or isinstance(x, bool) and kind != "long":
            raise TypeError(f"{x!r} can't be compared with values of {path}, which are of kind {kind}")


#: Entry numbers are longs from 0; a range whose first entry is past its last holds none.
EVERY, NO_ENTRY = (0, (1 << 63) - 1), (0, -1)


def entry_range(predicate: Predicate | Tree) -> tuple[int, int]:
    """First and last entry that a predicate on entry numbers lets match, or ``NO_ENTRY``; entries between may still fail it."""
    if any(isinstance(x, bool) or not isinstance(x, int) for x in predicate.constants):
        raise TypeError("entries are compared with whole numbers")
    if isinstance(predicate, Tree):
        spans = [entry_range(p) for p in predicate.parts]
        if predicate.join == "and":
            return bounded(max(low for low, _ in spans), min(high for _, high in spans))
        spans = [s for s in spans if s != NO_ENTRY]
        return bounded(min(low for low, _ in spans), max(high for _, high in spans)) if spans else NO_ENTRY
    if predicate.op == "isnull":
        return NO_ENTRY
    if predicate.op in ("<>", "isnotnull"):
        return EVERY
    low, high = min(predicate.values), max(predicate.values)
    if predicate.op in ("=", "in", "between"):
        return bounded(low, high)
    if predicate.op in ("<", "<="):
        return bounded(0, high - (predicate.op == "<"))
    return bounded(low + (predicate.op == ">"), EVERY[1])


def bounded(low: int, high: int) -> tuple[int, int]:
    low, high = max(low, EVERY[0]), min(high, EVERY[1])
    return (low, high) if low <= high else NO_ENTRY


def entry_selection(spark: SparkSession, request) -> DataFrame:
    """``source_id, begin, end`` from ``{source: {"ranges": [[b, e)], "entries": [..], "entries_delta": {"base", "deltas"}}}``; an empty object selects nothing."""
    rows: list[tuple[int, int, int]] = []
    for source, parts in loaded(request).items():
        if unknown := set(parts) - {"ranges", "entries", "entries_delta"}:
            raise ValueError(f"unknown parts of a selection: {sorted(unknown)}")
        for begin, end in parts.get("ranges", []):
            if begin < 0 or end < begin:
                raise ValueError(f"bad range [{begin}, {end})")
            rows.append((int(source), begin, end))
        entries = list(parts.get("entries", []))
        if delta := parts.get("entries_delta"):
            at = delta["base"]
            entries.append(at)
            for step in delta["deltas"]:
                at += step
                entries.append(at)
        rows += [(int(source), e, e + 1) for e in entries]
    return spark.createDataFrame(rows, "source_id long, begin long, end long")
