"""Logical paths into nested columns, flattened to rows: ``entry | one index per collection level | leaf``.

A path is ``/Class/field/...``; the class names the relation. ``value`` steps into the elements of a collection, and
``key`` and ``value`` into a map's entries, which are ordered by key. Empty and null collections give no rows. A path
that does not resolve gives an empty relation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parts_of(path: str) -> list[str]:
    """The class and the fields of a path; a leading slash is optional, trailing ones are dropped."""
    return [p for p in path.strip("/").split("/") if p]


def leaf_name(path: str) -> str:
    fields = parts_of(path)[1:]
    while len(fields) > 1 and fields[-1] == "value":
        fields = fields[:-1]
    return fields[-1]


@dataclass(frozen=True)
class Step:
    """One step of a resolved path: a field, a collection level with its index column, or a side of a map's entry."""

    kind: str
    name: str


def resolve(schema: T.StructType, path: str) -> tuple[list[Step], T.DataType] | None:
    """Steps to a leaf and its type, or None where a component is missing."""
    steps: list[Step] = []
    kind: T.DataType = schema
    fields, field = parts_of(path)[1:], ""

    def enter() -> None:
        """Step into collections until a struct, a map or a scalar."""
        nonlocal kind
        depth, inner = 0, kind
        while isinstance(inner, T.ArrayType):
            depth, inner = depth + 1, inner.elementType
        for level in range(depth):
            steps.append(Step("each", f"{field}_idx" if depth == 1 else f"{field}_dim{level}_idx"))
        kind = inner

    for name in fields:
        if isinstance(kind, T.ArrayType):
            enter()
            if name == "value" and not (isinstance(kind, T.StructType) and "value" in kind.names):
                continue
        if isinstance(kind, T.MapType):
            if name not in ("key", "value"):
                return None
            steps += [Step("entries", f"{field}_idx"), Step("field", name)]
            kind = kind.keyType if name == "key" else kind.valueType
        elif isinstance(kind, T.StructType) and name in kind.names:
            steps.append(Step("field", name))
            kind, field = kind[name].dataType, name
        elif name != "value":
            return None
    if isinstance(kind, T.ArrayType):
        enter()
    return steps, kind


def read_path(df: DataFrame, path: str, entry: str = "entry_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Flatten one path. The leaf's column takes the last component's name; ``carry`` keeps further columns of the entry."""
    found = resolve(df.schema, path)
    leaf = leaf_name(path)
    if not found or isinstance(found[1], (T.StructType, T.MapType)):
        return df.select(entry, *carry).where(F.lit(False)).withColumn(leaf, F.lit(None).cast("string"))
    kept: list[str] = [entry, *carry]
    now: Column | None = None
    rows = df
    for step in found[0]:
        if step.kind == "field":
            now = F.col(step.name) if now is None else now[step.name]
        else:
            values = F.array_sort(F.map_entries(now)) if step.kind == "entries" else now
            rows = rows.select(*kept, F.posexplode(values).alias(step.name, "_item"))
            kept.append(step.name)
            now = F.col("_item")
    return rows.select(*kept, now.alias(leaf))


def read_container(df: DataFrame, path: str, entry: str = "entry_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """All scalar members of a collection of structs in one relation, aligned by index."""
    found = resolve(df.schema, path)
    if not found or not isinstance(found[1], T.StructType):
        raise ValueError(f"{path} is no collection of structs")
    scalars = [f.name for f in found[1].fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    steps = [s for s in found[0] if s.kind != "field"]
    item = read_items(df, found[0], entry, carry)
    return item.select(entry, *carry, *[s.name for s in steps], *[F.col("_item")[n].alias(n) for n in scalars])


def read_items(df: DataFrame, steps: list[Step], entry: str, carry: tuple[str, ...]) -> DataFrame:
    kept, now, rows = [entry, *carry], None, df
    for step in steps:
        if step.kind == "field":
            now = F.col(step.name) if now is None else now[step.name]
        else:
            rows = rows.select(*kept, F.posexplode(F.array_sort(F.map_entries(now)) if step.kind == "entries" else now).alias(step.name, "_item"))
            kept.append(step.name)
            now = F.col("_item")
    return rows


def browse(df: DataFrame, root: str) -> DataFrame:
    """``path``: every path of a relation's schema, collections and leaves alike."""
    found: list[str] = []

    def walk(kind: T.DataType, at: str) -> None:
        found.append(at)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
            if not isinstance(kind, T.StructType):
                at += "/value"
                found.append(at)
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{at}/{f.name}")
        elif isinstance(kind, T.MapType):
            walk(kind.keyType, f"{at}/key")
            walk(kind.valueType, f"{at}/value")

    for f in df.schema.fields:
        walk(f.dataType, f"/{root}/{f.name}")
    return df.sparkSession.createDataFrame([(p,) for p in sorted(found)], "path string")


def scan_tree(df: DataFrame, entry: str = "entry_id") -> DataFrame:
    """All scalar columns of a relation with its entry; collections and structs are left to their paths."""
    return df.select(entry, *[f.name for f in df.schema.fields if f.name != entry and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))])


def read_paths(df: DataFrame, wanted: list[str], entry: str = "entry_id", carry: tuple[str, ...] = ()) -> dict[tuple[str, ...], DataFrame]:
    """Several paths, one relation per set of index columns: paths that share it stand side by side, null where one has no value.

    Values are zipped within their entry, level by level, so that nothing is shuffled or joined.
    """
    groups: dict[tuple[str, ...], list[tuple[list[Step], str]]] = {}
    seen = set()
    for path in wanted:
        found = resolve(df.schema, path)
        if not found or isinstance(found[1], (T.StructType, T.MapType)):
            raise ValueError(f"{path} names no values")
        if tuple(found[0]) in seen:
            continue
        seen.add(tuple(found[0]))
        groups.setdefault(tuple(s.name for s in found[0] if s.kind != "field"), []).append((found[0], path))
    out = {}
    for index, members in groups.items():
        names = [leaf_name(p) for _, p in members]
        if len(set(names)) < len(names):  # two leaves of one name are told apart by their path
            names = ["_".join(x for x in parts_of(p)[1:] if x != "value") for _, p in members]
        rows, kept = df, [entry, *carry]
        now: list[Column | None] = [None] * len(members)
        left = [list(steps) for steps, _ in members]

        def walk() -> None:
            """Go on through fields to the next collection of each path."""
            for i, steps in enumerate(left):
                while steps and steps[0].kind == "field":
                    step = steps.pop(0)
                    now[i] = F.col(step.name) if now[i] is None else now[i][step.name]

        walk()
        for name in index:
            values = [F.coalesce(F.array_sort(F.map_entries(c)) if steps.pop(0).kind == "entries" else c, F.array()) for c, steps in zip(now, left, strict=True)]
            zipped = F.arrays_zip(*[v.alias(f"_{i}") for i, v in enumerate(values)])
            rows = rows.select(*kept, F.posexplode(zipped).alias(name, "_item"))
            kept.append(name)
            now = [F.col("_item")[f"_{i}"] for i in range(len(members))]
            walk()
        out[index] = rows.select(*kept, *[c.alias(n) for c, n in zip(now, names, strict=True)])
    return out
