"""Sidecar statistics of flattened paths by source and basket (an entry range), and scans that they prune.

A basket has counts of values, nulls, NaN and infinities, the smallest and largest finite value, and a Bloom set of
hashed bit positions. Metadata only rejects: a pruned scan returns what an unpruned one does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The wanted rate of false positives, and the most bytes and hashes, of a basket's Bloom set.
BLOOM_RATE, BLOOM_BYTES, BLOOM_HASHES = 0.01, 64 << 10, 16


def kind_of(kind: T.DataType) -> str:
    """How values of a type are compared and hashed: ``text``, ``long`` or ``double``."""
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "long"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    raise TypeError(f"no statistics for values of type {kind.simpleString()}")


def plain(value: Column, kind: str) -> Column:
    return value if kind == "text" else value.cast(kind)


def finite(value: Column, kind: str = "double") -> Column:
    wide = value.cast("double")
    return value.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf"))) if kind == "double" else value.isNotNull()


def positions(value: Column, kind: str, bits: Column, hashes: Column) -> Column:
    """Bit positions of a value; both zeros are one."""
    whole = plain(value, kind)
    whole = whole + F.lit(0.0) if kind == "double" else whole
    first, second = (F.xxhash64(whole, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF)) for seed in (1, 2))
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(first + second * i, bits).cast("int"))


def bloom_size(n: Column) -> tuple[Column, Column]:
    """Bits and hashes of a Bloom set of ``n`` values at the wanted rate, within the bounds."""
    bits = F.least(F.lit(8 * BLOOM_BYTES), F.greatest(F.lit(64), F.ceil(n * F.lit(-math.log(BLOOM_RATE) / math.log(2) ** 2)))).cast("int")
    hashes = F.least(F.lit(BLOOM_HASHES), F.greatest(F.lit(1), F.round(bits / F.greatest(n, F.lit(1)) * math.log(2)))).cast("int")
    return bits, hashes


def build_baskets(flat: DataFrame, value: str, basket_entries: int, *, source: str = "source_id", entry: str = "entry_id", bloom: bool = False) -> DataFrame:
    """One row per source and basket of a flattened path; partial sums are combined before the shuffle."""
    kind = kind_of(flat.schema[value].dataType)
    v, wide = plain(F.col(value), kind), F.col(value).cast("double") if kind == "double" else F.lit(0.0)
    stats = [
        F.count("*").alias("value_count"),
        F.count_if(v.isNull()).alias("null_count"),
        F.count_if(F.isnan(wide)).alias("nan_count"),
        F.count_if(wide == F.lit(float("inf"))).alias("pos_inf_count"),
        F.count_if(wide == F.lit(float("-inf"))).alias("neg_inf_count"),
        F.min(F.when(finite(v, kind), v)).alias("min_value"),
        F.max(F.when(finite(v, kind), v)).alias("max_value"),
    ]
    basket = F.expr(f"`{entry}` div {basket_entries}")
    out = flat.groupBy(source, basket.alias("basket_id")).agg(*stats)
    if bloom:
        bits, hashes = bloom_size(F.col("value_count") - F.col("null_count") - F.col("nan_count") - F.col("pos_inf_count") - F.col("neg_inf_count"))
        out = out.withColumn("bloom_bits", bits).withColumn("bloom_hashes", hashes)
        sized = flat.where(finite(F.col(value), kind)).select(source, basket.alias("basket_id"), v.alias("_v")).join(out.select(source, "basket_id", "bloom_bits", "bloom_hashes"), [source, "basket_id"])
        spots = sized.select(source, "basket_id", F.explode(positions(F.col("_v"), kind, F.col("bloom_bits"), F.col("bloom_hashes"))).alias("bit"))
        out = out.join(spots.groupBy(source, "basket_id").agg(F.array_sort(F.collect_set("bit")).alias("bloom")), [source, "basket_id"], "left")
    return out.withColumn("entry_begin", F.col("basket_id") * basket_entries).withColumn("entry_end", (F.col("basket_id") + 1) * basket_entries)


def rollup_files(baskets: DataFrame, source: str = "source_id") -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("value_count", "null_count", "nan_count", "pos_inf_count", "neg_inf_count")]
    return baskets.groupBy(source).agg(*sums, F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.count("*").alias("basket_count"))


def value_begins(baskets: DataFrame, source: str = "source_id") -> DataFrame:
    """Where each basket's values begin within its source."""
    before = W.partitionBy(source).orderBy("basket_id").rowsBetween(W.unboundedPreceding, -1)
    return baskets.withColumn("flat_value_begin", F.coalesce(F.sum("value_count").over(before), F.lit(0)).cast("long"))


def event_bases(files: DataFrame, source: str = "source_id", group: int = 4096) -> DataFrame:
    """Where each source's entries begin in the whole dataset; one row per source. Groups of sources are summed first."""
    rows = files.withColumn("_group", F.expr(f"`{source}` div {group}"))
    before = lambda w: F.coalesce(F.sum("total_entries").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    groups = rows.groupBy("_group").agg(F.sum("total_entries").alias("total_entries")).select("_group", before(W.orderBy("_group")).alias("_base"))
    rows = rows.withColumn("_within", before(W.partitionBy("_group").orderBy(source))).join(groups, "_group")
    return rows.withColumn("event_base", F.col("_base") + F.col("_within")).drop("_group", "_base", "_within")


def dataset_stats(files: DataFrame) -> DataFrame:
    """One row from metadata alone."""
    sums = {"row_count": "value_count", "null_count": "null_count", "nan_count": "nan_count", "pos_inf_count": "pos_inf_count", "neg_inf_count": "neg_inf_count", "basket_count": "basket_count"}
    out = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()], F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))
    return out.withColumn("non_null_count", F.col("row_count") - F.col("null_count"))


@dataclass(frozen=True)
class Predicate:
    """A comparison of a path's value with constants: one of = <> < <= > >= between in isnull isnotnull."""

    op: str
    values: tuple = ()

    def exact(self, v: Column) -> Column:
        kind = {"=": v.__eq__, "<>": v.__ne__, "<": v.__lt__, "<=": v.__le__, ">": v.__gt__, ">=": v.__ge__}
        if self.op in kind:
            return kind[self.op](F.lit(self.values[0]))
        if self.op == "between":
            low, high = self.bounds
            return v.between(low, high)
        if self.op == "in":
            return v.isin(*self.values)
        if self.op == "isnull":
            return v.isNull()
        if self.op == "isnotnull":
            return v.isNotNull()
        raise ValueError(f"unknown operator {self.op}")

    @property
    def bounds(self) -> tuple:
        """The constants in order, NaN last."""
        return tuple(sorted(self.values, key=lambda x: (x != x, x)))

    @property
    def constants(self) -> tuple:
        return self.values

    def keeps(self, baskets: DataFrame) -> Column:
        """Whether one of ``baskets`` may hold a match, by its extremes and, where there is one, its Bloom set."""
        kind = kind_of(baskets.schema["min_value"].dataType)
        return self.may_match() & self.bloom_match(kind) if "bloom" in baskets.columns else self.may_match()

    def may_match(self) -> Column:
        """Whether a basket may hold a match; NaN is larger than any value."""
        low, high = F.col("min_value"), F.col("max_value")
        above, below = (F.col("nan_count") > 0) | (F.col("pos_inf_count") > 0), F.col("neg_inf_count") > 0
        yes = F.lit(True)
        within = lambda x: F.coalesce((low <= x) & (high >= x), F.lit(False))
        odd = lambda x: F.lit(x != x or abs(x) == float("inf")) if isinstance(x, float) else F.lit(False)
        if self.op == "=":
            return within(self.values[0]) | odd(self.values[0])
        if self.op == "in":
            out = F.lit(False)
            for x in self.values:
                out = out | within(x) | odd(x)
            return out
        if self.op in (">", ">="):
            return F.coalesce(high > self.values[0] if self.op == ">" else high >= self.values[0], F.lit(False)) | above
        if self.op in ("<", "<="):
            return F.coalesce(low < self.values[0] if self.op == "<" else low <= self.values[0], F.lit(False)) | below | odd(self.values[0])
        if self.op == "between":
            a, b = self.bounds
            return F.coalesce((high >= a) & (low <= b), F.lit(False)) | above | below
        if self.op == "isnull":
            return F.col("null_count") > 0
        return yes

    def bloom_match(self, kind: str = "double") -> Column:
        """Whether a basket's Bloom set may hold one of the constants; no set means it may."""
        if self.op not in ("=", "in"):
            return F.lit(True)
        out = F.col("bloom").isNull()
        for x in self.values:
            if isinstance(x, float) and (x != x or abs(x) == float("inf")):
                return F.lit(True)  # never in a set
            out = out | F.forall(positions(F.lit(x), kind, F.col("bloom_bits"), F.col("bloom_hashes")), lambda p: F.array_contains("bloom", p))
        return out


@dataclass(frozen=True)
class Tree:
    """Predicates on one value joined by ``and`` or ``or``."""

    join: str
    parts: tuple

    @property
    def constants(self) -> tuple:
        return tuple(x for p in self.parts for x in p.constants)

    def joined(self, columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = out & c if self.join == "and" else out | c
        return out

    def exact(self, v: Column) -> Column:
        return self.joined([p.exact(v) for p in self.parts])

    def keeps(self, baskets: DataFrame) -> Column:
        return self.joined([p.keeps(baskets) for p in self.parts])


def selected_baskets(baskets: DataFrame, predicate: Predicate | Tree) -> DataFrame:
    return baskets.where(predicate.keeps(baskets))


def read_dataset(flat: DataFrame, value: str, baskets: DataFrame, predicate: Predicate, basket_entries: int, *, source: str = "source_id", entry: str = "entry_id", row_limit: int | None = None) -> DataFrame:
    """Rows that match, read from the baskets that may hold some."""
    chosen = selected_baskets(baskets, predicate).select(source, "basket_id")
    keyed = flat.withColumn("basket_id", F.expr(f"`{entry}` div {basket_entries}"))
    out = keyed.join(chosen, [source, "basket_id"], "left_semi").drop("basket_id").where(predicate.exact(F.col(value)))
    return out if row_limit is None else out.limit(row_limit)


def any_of(values: Column, predicate: Predicate) -> Column:
    return F.exists(values, predicate.exact)


def all_of(values: Column, predicate: Predicate) -> Column:
    """False for no values."""
    return (F.size(values) > 0) & F.forall(values, predicate.exact)
