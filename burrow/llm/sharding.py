"""Sharding by proportional stratified interleaving, as DataFrame operations.

Rows are ranked in a seeded shuffle within their source; sorted by fractional rank, all sources are spread evenly
over the whole order, so that equal cuts of it are shards of the corpus's mixture and differ by one row at most.

No source is ever ranked in one task. A row's shuffle hash places it in one of many buckets of its source; its
rank is the size of the buckets before plus its place in its own. The order of all rows by fractional rank is
found in the same way. Only counts of buckets are summed up.

Cases: a null text has size 1 and the CRC of the empty string; null sources are a source of their own; repeated
rows and ties are ordered by hash, doc_id and CRC, and all are kept; more shards than rows leave shards empty; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Buckets of the global order; their counts, so many rows, are summed up in one window.
ORDER_BUCKETS = 4096


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("stratum"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    base = stored(base.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")))
    rows = base.count()
    bits = max(8, min(16, (rows >> 12).bit_length()))
    base = base.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    source = W.partitionBy("stratum")
    counts = base.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(source.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("stratum", "bucket", before.alias("before"), F.sum("n").over(source).alias("n_source"))
    place = F.row_number().over(W.partitionBy("stratum", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id", "text_crc32", "size"))
    shift = (F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1_000_003)) + F.lit(0.5)) / F.lit(1_000_003)
    ranked = base.withColumn("place", place).join(counts, ["stratum", "bucket"])
    ranked = ranked.withColumn("part", (F.col("before") + F.col("place") - 1 + shift) / F.col("n_source"))
    at = F.least(F.floor(F.col("part") * ORDER_BUCKETS), F.lit(ORDER_BUCKETS - 1)).cast("int")
    ranked = stored(ranked.select("doc_id", "stratum", "size", "text_crc32", "h", "part", at.alias("at")))
    starts = ranked.groupBy("at").agg(F.count("*").alias("n"))
    starts = starts.select("at", F.coalesce(F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    order = F.row_number().over(W.partitionBy("at").orderBy("part", "stratum", "h", "doc_id", "text_crc32"))
    placed = ranked.withColumn("order", order).join(starts, "at")
    position = F.col("start") + F.col("order") - 1
    placed = placed.withColumn("position", position).withColumn("shard", F.expr(f"cast((position * {shards}) div {max(rows, 1)} as int)"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        F.when(~F.col("stratum.none"), F.col("stratum.name")).alias("source"),
        "size",
        "text_crc32",
        "shard",
        (F.col("position") - first).alias("slot"),
    )
