"""Nested objects made of the flat tables: what a path is read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_KEYS = ("linenumber", "partkey", "suppkey", "quantity", "extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``/Order``: an entry per order with its lines, sorted by a total key; orders without lines have an empty array."""
    lines = table(spark, sf_dir, "lineitem")
    fields = [*LINE_KEYS, "discount", "tax"]
    line = F.struct(*[F.col(f"l_{f}").alias(f) for f in fields])
    grouped = lines.groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderstatus").alias("status"))
    empty = F.array().cast(grouped.schema["lines"].dataType)
    return rows.join(grouped, "entry_id", "left").withColumn("lines", F.coalesce("lines", empty))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``/Event``: scalars, and the JSON properties as a map."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), "ts", "user_id", "event_type", "value", F.from_json("props", "map<string,double>").alias("props"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``/Vec``: a fixed array, and the same values as a matrix of eight columns."""
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 8).cast("int")), lambda r: F.slice("embedding", r * 8 + 1, F.lit(8)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding", rows.alias("matrix"), "label")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``/Conv``: an entry per conversation with its turns in order."""
    turn = F.struct("turn", "role", "text")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("entry_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
