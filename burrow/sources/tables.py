"""Index tables kept as SQL tables: appended or replaced, data first and the snapshot's row last, and SQL functions over an index.

Spark has no transaction over several statements. Rows of a snapshot carry its id, readers join with the snapshots table, and
its row is inserted last; so rows of a writer that failed are never seen.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def ident(*parts: str) -> str:
    return "`" + "_".join(parts).replace("`", "``") + "`"


class Tables:
    """Tables named by a prefix, and ``<prefix>_snapshots``."""

    def __init__(self, spark: SparkSession, prefix: str, buckets: int = BUCKETS):
        self.spark, self.prefix, self.buckets = spark, prefix, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {ident(prefix, 'snapshots')} (snapshot_id STRING, parent_snapshot_id STRING, fingerprint STRING, mode STRING, committed_at_ns BIGINT) USING parquet")

    def latest(self):
        rows = self.spark.table(ident(self.prefix, "snapshots")).orderBy(F.desc("committed_at_ns"), F.desc("snapshot_id")).limit(1).collect()
        return rows[0] if rows else None

    def publish(self, tables: dict[str, DataFrame], fingerprint: str, mode: str = "append", bucket_by: str = "source_id") -> str:
        """Add a snapshot. ``replace`` starts anew, ``append`` goes on from the latest; a fingerprint is published once."""
        if mode not in ("append", "replace"):
            raise ValueError(f"unknown mode {mode!r}")
        held = self.spark.table(ident(self.prefix, "snapshots")).where(F.col("fingerprint") == fingerprint).limit(1).collect()
        if held:
            return held[0].snapshot_id
        parent, snapshot = self.latest(), uuid.uuid4().hex
        for name, df in tables.items():
            rows = df.withColumn("snapshot_id", F.lit(snapshot))
            if bucket_by in df.columns:
                rows = rows.withColumn("bucket", F.pmod(F.xxhash64(bucket_by), F.lit(self.buckets)).cast("int"))
            self.insert(name, rows)
        row = self.spark.createDataFrame([(snapshot, parent and parent.snapshot_id, fingerprint, mode, time.time_ns())], "snapshot_id string, parent_snapshot_id string, fingerprint string, mode string, committed_at_ns long")
        row.createOrReplaceTempView("_burrow_rows")
        self.spark.sql(f"INSERT INTO {ident(self.prefix, 'snapshots')} BY NAME SELECT * FROM _burrow_rows")
        self.spark.catalog.dropTempView("_burrow_rows")
        return snapshot

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append by name; new columns are added to the table first, and columns that the rows lack are null."""
        full = ident(self.prefix, name)
        if not self.spark.catalog.tableExists(full):
            empty = rows.limit(0).write.format("parquet").option("compression", "zstd")
            (empty.partitionBy("bucket") if "bucket" in rows.columns else empty).saveAsTable(full)
        known = {f.name: f.dataType for f in self.spark.table(full).schema}
        for f in rows.schema:
            if f.name not in known:
                self.spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({ident(f.name)} {f.dataType.simpleString()})")
            elif known[f.name] != f.dataType:
                raise TypeError(f"{name}.{f.name} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
        now = self.spark.table(full).schema
        whole = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in now])
        whole.createOrReplaceTempView("_burrow_rows")
        self.spark.sql(f"INSERT INTO {full} BY NAME SELECT * FROM _burrow_rows")
        self.spark.catalog.dropTempView("_burrow_rows")

    def read(self, name: str) -> DataFrame:
        """Rows of the snapshots that count: the latest and its parents, back to the last one that replaced."""
        log = {r.snapshot_id: r for r in self.spark.table(ident(self.prefix, "snapshots")).collect()}
        now, wanted = self.latest(), []
        while now is not None:
            wanted.append(now.snapshot_id)
            now = None if now.mode == "replace" else log.get(now.parent_snapshot_id)
        return self.spark.table(ident(self.prefix, name)).where(F.col("snapshot_id").isin(wanted)).drop("bucket")

    def drop(self) -> None:
        for t in self.spark.catalog.listTables():
            if t.name.startswith(f"{self.prefix.lower()}_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {ident(t.name)}")


#: What the functions over an index give.
FUNCTIONS = {"count": ("BIGINT", "row_count"), "non_null_count": ("BIGINT", "non_null_count"), "min": ("STRING", "min_value"), "max": ("STRING", "max_value")}


def register_functions(spark: SparkSession, stats: DataFrame, prefix: str) -> None:
    """SQL functions ``<prefix>_count(path)``, ``_non_null_count``, ``_min`` and ``_max`` over a relation with a row of figures per path."""
    stats.createOrReplaceTempView(f"{prefix}_stats")
    for name, (kind, column) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}(wanted STRING) RETURNS {kind} RETURN (SELECT CAST(max({column}) AS {kind}) FROM {prefix}_stats WHERE path = wanted)")
