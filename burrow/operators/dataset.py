"""Datasets of nested entries stored by source and entry range, the index published beside them, and scans that read chosen files only.

Files lie in ``data/source_id=S/part=P``; a part is a range of entries, sorted, and holds several baskets. The index has
four tables, published at once: ``files``, ``schemas``, ``access`` and ``baskets``. A scan first chooses baskets by metadata
alone (sources, extremes, Bloom sets, entry selections, other paths' predicates), then opens the parts that hold some of
them. Counts and extremes are answered from the index without a look at any data file.

Metadata of chosen files are the only rows that reach the driver, as paths to open; beyond ``MOST_FILES`` of them the choice
stays a table, and a semi-join on the partition columns prunes parts at run time. Metadata only reject: exact predicates follow.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from . import index, intervals, paths, requests

VERSION = 1
#: Files that a scan names one by one, and chosen baskets up to which their list is broadcast.
MOST_FILES, MOST_BASKETS = 10_000, 1_000_000
COUNTS = ("value_count", "null_count", "nan_count", "pos_inf_count", "neg_inf_count")


@dataclass(frozen=True)
class PruneReport:
    """What a scan opens, of what there is."""

    files_total: int
    files_read: int
    bytes_total: int
    bytes_read: int
    baskets_total: int
    baskets_read: int


def values_of(df: DataFrame, path: str) -> Column:
    """All of an entry's values of a path as one array."""
    found = paths.resolve(df.schema, path)
    if not found:
        raise ValueError(f"{path} does not resolve")
    now, inside = None, False
    for step in found[0]:
        if step.kind == "field":
            now = F.col(step.name) if now is None else now[step.name]
        elif step.kind == "each":
            now, inside = (F.flatten(now) if inside else now), True
        else:
            now, inside = (F.flatten(F.transform(now, F.map_entries)) if inside else F.map_entries(now)), True
    return now if inside else F.array(now)


class Dataset:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog = Catalog(spark, f"{self.root}/index")
        #: The committed snapshot that this object reads, found at the first look; and what it says of each path.
        self.snapshot: str | None = None
        self.schemas: dict[str, object] = {}
        self.totals: dict[str, tuple[int, int, int]] = {}
        self.shape = None

    # -- writing

    def write(self, objects: DataFrame, part_entries: int, *, entry: str = "entry_id") -> Dataset:
        """Store entries (with ``source_id``); a part is a range of ``part_entries`` entries of a source."""
        rows = objects.withColumn("part", F.expr(f"`{entry}` div {part_entries}"))
        rows = rows.repartition("source_id", "part").sortWithinPartitions("source_id", "part", entry)
        rows.write.partitionBy("source_id", "part").option("compression", "zstd").parquet(f"{self.root}/data")
        return self

    def listing(self) -> DataFrame:
        """``path, bytes, modified, source_id, part`` of each data file as it is now; contents are not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data")
        key = lambda name: F.regexp_extract("path", f"/{name}=(-?[0-9]+)/", 1).cast("long").alias(name)
        return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), key("source_id"), key("part"))

    def entries(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/data")
        return rows.withColumn("source_id", F.col("source_id").cast("long")).withColumn("part", F.col("part").cast("long"))

    def build(self, wanted: list[str], part_entries: int, basket_entries: int, *, bloom: bool = True) -> str:
        """Publish the index of some paths; each path's columns are read once. The same files, paths and sizes are published once."""
        if part_entries % basket_entries:
            raise ValueError("a part must hold whole baskets")
        data, listed = self.entries(), self.listing()
        mark = listed.agg(F.count("*"), F.sum(F.xxhash64("path", "bytes", "modified").cast("decimal(38,0)"))).first()
        fingerprint = hashlib.sha256(repr((VERSION, tuple(mark), sorted(wanted), part_entries, basket_entries, bloom)).encode()).hexdigest()
        counted = data.groupBy("source_id", "part").agg(F.count("*").alias("entries"), F.min("entry_id").alias("entry_begin"), (F.max("entry_id") + 1).alias("entry_end"))
        files = listed.join(counted, ["source_id", "part"])
        baskets, schemas, access = None, [], []
        for path in sorted(set(wanted)):
            found = paths.resolve(data.schema, path)
            if not found:
                raise ValueError(f"{path} does not resolve")
            kind, leaf = index.kind_of(found[1]), paths.leaf_name(path)
            schemas.append((path, leaf, found[1].simpleString(), kind, [s.name for s in found[0] if s.kind != "field"], part_entries, basket_entries))
            access += [(path, n, s.kind, s.name) for n, s in enumerate(found[0])]
            flat = paths.read_path(data, path, carry=("source_id",))
            own = index.build_baskets(flat, leaf, basket_entries, bloom=bloom).withColumn("path", F.lit(path))
            for k, sql in (("double", "double"), ("long", "long"), ("text", "string")):
                for side in ("min", "max"):
                    own = own.withColumn(f"{side}_{k}", F.col(f"{side}_value") if k == kind else F.lit(None).cast(sql))
            own = own.drop("min_value", "max_value")
            baskets = own if baskets is None else baskets.unionByName(own)
        made = self.spark.createDataFrame
        self.schemas, self.totals = {}, {}
        self.snapshot = self.catalog.publish(
            {
                "files": files,
                "schemas": made(schemas, "path string, leaf string, type string, kind string, levels array<string>, part_entries long, basket_entries long"),
                "access": made(access, "path string, step int, kind string, name string"),
                "baskets": baskets,
            },
            fingerprint,
        )
        return self.snapshot

    # -- reading the index

    def table(self, name: str) -> DataFrame:
        if self.snapshot is None:
            self.snapshot = self.catalog.latest()
            if self.snapshot is None:
                raise ValueError("nothing is committed")
        return self.spark.read.parquet(f"{self.catalog.root}/snapshots/{self.snapshot}/{name}")

    def schema_of(self, path: str):
        """The index's row of a path."""
        if not self.schemas:
            self.schemas = {r.path: r for r in self.table("schemas").collect()}
        if path not in self.schemas:
            raise ValueError(f"{path} is not indexed")
        return self.schemas[path]

    def baskets(self, path: str) -> DataFrame:
        kind = self.schema_of(path).kind
        rows = self.table("baskets").where(F.col("path") == path)
        return rows.withColumn("min_value", F.col(f"min_{kind}")).withColumn("max_value", F.col(f"max_{kind}")).drop(*[f"{s}_{k}" for s in ("min", "max") for k in ("double", "long", "text")])

    def total(self, path: str) -> tuple[int, int, int]:
        """Files, their bytes and the path's baskets in all; a snapshot doesn't change, so they are looked up once."""
        if path not in self.totals:
            files = self.table("files").agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
            self.totals[path] = (*files, self.table("baskets").where(F.col("path") == path).count())
        return self.totals[path]

    def stats(self, path: str) -> DataFrame:
        """Counts and extremes of a path's values in one row, from the index alone."""
        return index.dataset_stats(index.rollup_files(self.baskets(path)))

    def check_fresh(self) -> None:
        """Raise if a data file is not as it was when the index was built."""
        names = ["path", "bytes", "modified"]
        now, then = self.listing().select(names), self.table("files").select(names)
        if now.exceptAll(then).unionAll(then.exceptAll(now)).head(1):
            raise RuntimeError("data files have changed since the index was built")

    def ranges(self, chosen: DataFrame, gap: int = 0) -> DataFrame:
        """Chosen baskets as ranges to read: ``source_id, part, begin, end, baskets``; gaps of up to ``gap`` entries within a part are read over."""
        whole = chosen.select(F.struct("source_id", "part").alias("source_id"), F.col("entry_begin").alias("begin"), (F.col("entry_end") + gap).alias("end"))
        spans = intervals.merge(whole).select("source_id", F.col("begin").alias("_begin"), (F.col("end") - gap).alias("_end"))
        held = chosen.select(F.struct("source_id", "part").alias("source_id"), "entry_begin").join(spans, "source_id").where("entry_begin >= _begin AND entry_begin < _end")
        return held.groupBy("source_id", F.col("_begin").alias("begin"), F.col("_end").alias("end")).agg(F.count("*").alias("baskets")).select("source_id.source_id", "source_id.part", "begin", "end", "baskets")

    # -- scans

    def chosen(self, path: str, predicate=None, path_predicates=(), selection: DataFrame | None = None, sources: list[int] | None = None, entries=None) -> DataFrame:
        """``source_id, basket_id, entry_begin, entry_end, part`` of the baskets that may hold a match."""
        held = self.schema_of(path)
        rows = self.baskets(path)
        if predicate is not None:
            requests.check_constants(predicate, held.kind, path)
            rows = rows.where(predicate.keeps(rows))
        if isinstance(predicate, index.Predicate) and predicate.op == "isnull":
            rows = rows.where(F.lit(False))
        if entries is not None:
            low, high = requests.entry_range(entries)
            rows = rows.where((F.col("entry_begin") <= high) & (F.col("entry_end") > low) if low <= high else F.lit(False))
        if sources is not None:
            rows = rows.where(F.col("source_id").isin(*sources))
        for p in path_predicates:
            other = self.schema_of(p.path)
            requests.check_constants(p.predicate, other.kind, p.path)
            may = self.baskets(p.path)
            rows = rows.join(may.where(p.predicate.keeps(may)).select("source_id", "basket_id"), ["source_id", "basket_id"], "left_semi")
        if selection is not None:
            cells = intervals.merge(selection).select("source_id", F.explode(F.expr(f"sequence(begin div {held.basket_entries}, (end - 1) div {held.basket_entries})")).alias("basket_id"))
            rows = rows.join(cells, ["source_id", "basket_id"], "left_semi")
        return rows.select("source_id", "basket_id", "entry_begin", "entry_end", F.expr(f"entry_begin div {held.part_entries}").alias("part"))

    def scan(self, path: str, predicate=None, *, path_predicates=(), selection: DataFrame | None = None, sources: list[int] | None = None, entries=None, row_limit: int | None = None) -> tuple[DataFrame, PruneReport]:
        """The path's rows (``entry_id, source_id``, index columns, leaf) that match, and what is opened for them.

        ``entries`` is a predicate on the entry numbers themselves. ``value IS NULL`` finds nothing, as a flattened value
        stands for itself; no selected entry gives no row.
        """
        held, files = self.schema_of(path), self.table("files")
        chosen = self.chosen(path, predicate, path_predicates, selection, sources, entries)
        parts = chosen.groupBy("source_id", "part").agg(F.count("*").alias("n"), F.min("entry_begin").alias("begin"), F.max("entry_end").alias("end"))
        opened = files.select("path", "bytes", "source_id", "part").join(parts, ["source_id", "part"])
        all_files, all_bytes, all_baskets = self.total(path)
        named = opened.limit(MOST_FILES + 1).collect()
        if len(named) <= MOST_FILES:
            by_part = {(r.source_id, r.part): r for r in named}.values()
            files_read, bytes_read, kept = len(named), sum(r.bytes for r in named), sum(r.n for r in by_part)
            begin, end = min((r.begin for r in by_part), default=0), max((r.end for r in by_part), default=0)
            self.shape = self.shape or self.entries().schema
            names = [r.path for r in named]
            rows = self.spark.read.schema(self.shape).option("basePath", f"{self.root}/data").parquet(*names) if names else self.spark.createDataFrame([], self.shape)
        else:
            files_read, bytes_read = opened.agg(F.count("*"), F.sum("bytes")).first()
            kept, begin, end = chosen.agg(F.count("*"), F.min("entry_begin"), F.max("entry_end")).first()
            wanted = chosen.select("source_id", "part").distinct()
            rows = self.entries().join(F.broadcast(wanted) if kept <= MOST_BASKETS else wanted, ["source_id", "part"], "left_semi")
        report = PruneReport(all_files, files_read, all_bytes, bytes_read, all_baskets, kept)
        if kept:
            rows = rows.where((F.col("entry_id") >= begin) & (F.col("entry_id") < end))
        if entries is not None:
            rows = rows.where(entries.exact(F.col("entry_id")))
        if selection is not None:
            rows = intervals.select(rows, intervals.merge(selection))
        for p in path_predicates:
            rows = rows.where((index.any_of if p.quantifier == "any" else index.all_of)(values_of(rows, p.path), p.predicate))
        if kept < all_baskets:
            narrow = chosen.select("source_id", F.col("basket_id").alias("_basket"))
            narrow = F.broadcast(narrow) if kept <= MOST_BASKETS else narrow
            rows = rows.withColumn("_basket", F.expr(f"entry_id div {held.basket_entries}")).join(narrow, ["source_id", "_basket"], "left_semi").drop("_basket")
        out = paths.read_path(rows, path, carry=("source_id",))
        if predicate is not None:
            out = out.where(predicate.exact(F.col(held.leaf)))
        return (out if row_limit is None else out.limit(row_limit)), report
