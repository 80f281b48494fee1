"""A snapshot store on Parquet: data first, the commit row last; readers see committed snapshots only."""

from __future__ import annotations

import hashlib
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "snapshot_id string, parent_snapshot_id string, fingerprint string, committed_at_ns long, tables array<string>, state string"


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, or, where none is set, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="burrow-")
    return f"{named.rstrip('/')}/catalog-{uuid.uuid4().hex}"


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits")

    def latest(self, snapshot_id: str | None = None) -> str | None:
        """The named snapshot if it is committed, else the newest."""
        rows = self.commits().where(F.col("state") == "committed")
        rows = rows.where(F.col("snapshot_id") == snapshot_id) if snapshot_id else rows
        found = rows.orderBy(F.desc("committed_at_ns")).limit(1).collect()
        if snapshot_id and not found:
            raise ValueError(f"snapshot {snapshot_id} is not committed")
        return found[0].snapshot_id if found else None

    def listing(self) -> DataFrame:
        """``table_name, snapshot_id, location`` of the tables of the newest snapshot."""
        now = self.latest()
        rows = self.commits().where(F.col("snapshot_id") == now).select(F.explode("tables").alias("table_name"), "snapshot_id")
        return rows.withColumn("location", F.concat(F.lit(f"{self.root}/snapshots/"), "snapshot_id", F.lit("/"), "table_name"))

    def publish(self, tables: dict[str, DataFrame], fingerprint: str) -> str:
        """Write all tables, then the commit row. A fingerprint is published once; later calls return its snapshot.

        A writer claims its fingerprint by a file that is created without overwriting, after its tables and before its commit
        row: of several writers one commits, the others give up their tables and return its snapshot, or raise if it has not
        committed yet.
        """
        if held := self.committed(fingerprint):
            return held
        parent, snapshot = self.latest(), uuid.uuid4().hex
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.root}/snapshots/{snapshot}/{name}")
        if not self.claim(fingerprint):
            self.folder(f"snapshots/{snapshot}", delete=True)
            if held := self.committed(fingerprint):
                return held
            raise RuntimeError(f"fingerprint {fingerprint} is being published by another writer, or its claim was left by one that failed")
        row = [(snapshot, parent, fingerprint, time.time_ns(), sorted(tables), "committed")]
        self.spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return snapshot

    def committed(self, fingerprint: str) -> str | None:
        held = self.commits().where((F.col("fingerprint") == fingerprint) & (F.col("state") == "committed")).limit(1).collect()
        return held[0].snapshot_id if held else None

    def folder(self, name: str, *, delete: bool = False):
        """The file system and path of a name under the root."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if delete:
            system.delete(path, True)
        return system, path

    def claim(self, fingerprint: str) -> bool:
        system, path = self.folder("claims/" + hashlib.sha256(fingerprint.encode()).hexdigest())
        system.mkdirs(path.getParent())
        return system.createNewFile(path)

    def read(self, name: str, snapshot_id: str | None = None) -> DataFrame:
        snapshot = self.latest(snapshot_id)
        if snapshot is None:
            raise ValueError("nothing is committed")
        return self.spark.read.parquet(f"{self.root}/snapshots/{snapshot}/{name}")
