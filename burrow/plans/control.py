"""Indexing in chunks: discover the inputs, plan, build each chunk once, validate, merge in one commit, compact, and clean up.

Chunks are independent and may run again; each publishes under its own id in its own catalog. One merge publishes them
together. Only lists of files, commits and counts reach the driver.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..sources import files
from ..sources.catalog import Catalog
from . import chunks

KEYS = {"files": ["source_id", "part"], "schemas": ["path"], "access": ["path", "step"], "baskets": ["path", "source_id", "basket_id"]}


def source_id(path: str) -> int:
    """A source's number by its name: 63 bits of SHA-256."""
    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big") >> 1


@dataclass(frozen=True)
class Manifest:
    files: tuple[files.Listed, ...]
    missing: tuple[str, ...]
    fingerprint: str


def discover(spark: SparkSession, spec: str) -> Manifest:
    """Inputs sorted by name, numbered by name, with a fingerprint of names, sizes and times; two names of one number are an error."""
    listed, missing = files.listing(spark, spec)
    found = tuple(files.Listed(source_id(f.path), f.path, f.bytes, f.modified, f.uri) for f in sorted(listed, key=lambda f: f.path))
    if len({f.source_id for f in found}) < len(found):
        raise ValueError("two inputs have one number")
    mark = hashlib.sha256("\n".join(f"{f.path}\t{f.bytes}\t{f.modified}" for f in found).encode()).hexdigest()
    return Manifest(found, tuple(missing), mark)


def plan(manifest: Manifest, *, max_files: int, max_bytes: int) -> list[dict]:
    return chunks.plan([(f.path, f.bytes) for f in manifest.files], max_files=max_files, max_bytes=max_bytes)


def budget(*, memory_bytes: int, cores: int, input_bytes: int, overhead: float = 0.4, task_bytes: int = 256 << 20) -> dict[str, str]:
    """Spark settings for an executor: partitions whose rows fit a task's share of its heap, and enough of them for the input."""
    if not 0 < overhead < 1 or min(memory_bytes, cores, task_bytes) < 1 or input_bytes < 0:
        raise ValueError("a budget needs positive figures")
    share = int(memory_bytes * (1 - overhead)) // cores
    if share < 64 << 20:
        raise ValueError(f"a task would have {share >> 20} MB")
    wide = min(task_bytes, share // 4)
    return {
        "spark.executor.memory": f"{int(memory_bytes * (1 - overhead)) >> 20}m",
        "spark.executor.memoryOverhead": f"{int(memory_bytes * overhead) >> 20}m",
        "spark.executor.cores": str(cores),
        "spark.sql.files.maxPartitionBytes": str(wide),
        "spark.sql.shuffle.partitions": str(max(8, -(-input_bytes // wide))),
    }


def run(chunk: dict, store: Catalog, build: Callable[[list[str]], dict[str, DataFrame]]) -> str:
    """Build a chunk's tables unless they are committed already."""
    return store.committed(chunk["chunk_id"]) or store.publish(build(chunk["files"]), chunk["chunk_id"])


def validate(planned: list[dict], stores: dict[str, Catalog]) -> list[str]:
    """What keeps chunks from being merged: not committed, tables that lack rows or repeat keys, sources in several chunks, baskets without a file."""
    wrong = [f"chunk {c['chunk_id']} is not committed" for c in planned if c["chunk_id"] not in stores or not stores[c["chunk_id"]].committed(c["chunk_id"])]
    wrong += [f"chunk {c} is not planned" for c in stores if c not in {p["chunk_id"] for p in planned}]
    if wrong:
        return wrong
    tables = {n: union([s.read(n, s.committed(c)).withColumn("_chunk", F.lit(c)) for c, s in stores.items()]) for n in KEYS}
    for name in ("files", "baskets"):
        twice = tables[name].groupBy(*KEYS[name]).count().where("count > 1").limit(1).collect()
        wrong += [f"{name} repeats {tuple(r)[:-1]}" for r in twice]
    shared = tables["files"].groupBy("source_id").agg(F.count_distinct("_chunk").alias("n")).where("n > 1").limit(1).collect()
    wrong += [f"source {r.source_id} is in {r.n} chunks" for r in shared]
    lost = tables["baskets"].join(tables["files"], "source_id", "left_anti").limit(1).collect()
    wrong += [f"baskets of source {r.source_id} have no file" for r in lost]
    odd = tables["schemas"].groupBy("path").agg(F.count_distinct("type", "part_entries", "basket_entries").alias("n")).where("n > 1").limit(1).collect()
    return wrong + [f"{r.path} has {r.n} forms" for r in odd]


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge(planned: list[dict], stores: dict[str, Catalog], target: Catalog) -> str:
    """One snapshot of all chunks and of what the target holds, with each source's event base anew; what is held already is not added twice."""
    if wrong := validate(planned, stores):
        raise ValueError("; ".join(wrong))
    held = target.latest()
    fingerprint = hashlib.sha256("\n".join([held or "", *sorted(stores)]).encode()).hexdigest()
    out = {}
    for name, keys in KEYS.items():
        fresh = union([s.read(name, s.committed(c)) for c, s in stores.items()])
        fresh = fresh.dropDuplicates(keys) if name in ("schemas", "access") else fresh
        if held:
            old = target.read(name, held).drop("event_base")
            fresh = old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)
        out[name] = fresh
    totals = out["files"].groupBy("source_id").agg(F.sum("entries").alias("total_entries"))
    out["files"] = out["files"].join(index.event_bases(totals).select("source_id", "event_base"), "source_id")
    return target.publish(out, fingerprint)


def compact(store: Catalog, parts: int | None) -> str:
    """The latest snapshot rewritten in ``parts`` files a table, as a new snapshot; refused unless a number is named."""
    if not parts or parts < 1:
        raise ValueError("compaction needs the number of files wanted")
    now = store.latest()
    if now is None:
        raise ValueError("nothing is committed")
    names = store.commits().where(F.col("snapshot_id") == now).first().tables
    return store.publish({n: store.read(n, now).repartition(parts) for n in names}, f"compact {now} {parts}")


def orphans(store: Catalog, *, older_than_s: float = 86_400, delete: bool = False) -> list[str]:
    """Snapshot folders that no commit names and that are old enough for no writer to be at work; only listed unless ``delete``."""
    system, at = store.folder("snapshots")
    if not system.exists(at):
        return []
    known = {r.snapshot_id for r in store.commits().select("snapshot_id").collect()}
    limit = (time.time() - older_than_s) * 1000
    found = sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory() and s.getModificationTime() <= limit)
    found = [n for n in found if n not in known]
    for n in found if delete else []:
        store.folder(f"snapshots/{n}", delete=True)
    return found


def audit(data: DataFrame, wanted: list[str], entry: str = "entry_id") -> DataFrame:
    """A row per path: its type, rows, entries that have some, nulls, and keys (entry and index) that repeat; missing paths have no type."""
    from ..operators import paths

    out = None
    for path in sorted(set(wanted)):
        found = paths.resolve(data.schema, path)
        flat, leaf = paths.read_path(data, path, entry=entry), paths.leaf_name(path)
        keys = [c for c in flat.columns if c != leaf]
        by_key = flat.groupBy(*keys).agg(F.count("*").alias("n"), F.count(leaf).alias("held"))
        one = by_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct(entry).alias("entries"),
            F.coalesce(F.sum(F.col("n") - F.col("held")), F.lit(0)).alias("nulls"), F.count_if(F.col("n") > 1).alias("repeated_keys"),
        ).select(F.lit(path).alias("path"), F.lit(found[1].simpleString() if found else None).cast("string").alias("type"), "*")
        out = one if out is None else out.unionByName(one)
    return out
