"""Exact top-k search by inner product over a bit-sliced index.

Index: vectors are quantised to floor(256 x) and stored in blocks; a block holds, for each dimension, one bitmap
over its rows for each bit of ``component - smallest component``. Search: for one query, the bitmaps of all
dimensions are added by carry-save adders (bitwise AND, OR and XOR over machine words), each entering at the place
of every set bit of the query's component; a negative component takes the complement. That gives the bit slices of
all rows' scores. The best rows are selected from the most significant slice downward; rows still tied at the last
place have equal scores and are resolved by the smaller id, so that results are exact.

A block is one Arrow batch of rows and a pack one batch of queries. Each pack meets each block once: blocks are
dealt to groups, packs are sent to every group. A block gives at most k + 1 rows per query, whatever its rows hold;
the query's own row, one of its id and of its score with itself, goes when the blocks' rows are merged.

Rows with a component so large that a score might pass a long (``narrow``) are kept apart as plain integers of any
size, and so are queries: they are compared with exact integer arithmetic.

Cases: null vectors, vectors with null or non-finite components, and null ids take no part; empty vectors score 0
among themselves; vectors of other dimensions are not compared; a score beyond a long is given as the nearest long,
and such scores tie; queries are rows of the table: each repeated row is a query of its own, and its copies and all
other rows of its id are its candidates; ties go to the smaller id; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256.0
LEAST, MOST = -(1 << 63), (1 << 63) - 1
QUERIES_PER_PACK = 1024
BLOCK = "dim int, grp int, wide boolean, ids binary, low binary, bits binary, slices binary"
PACK = "dim int, q_wide boolean, q_ids binary, q_times binary, q_names binary, vectors binary"
HITS = "query_id long, variant long, times long, own long, vec_id long, score long"


def narrow(dim: int) -> int:
    """Components below this size fit 32 bits, and scores of ``dim`` of them 62."""
    return min(1 << 31, math.isqrt((1 << 62) // max(dim, 1)))


def exact(x: float) -> int:
    """floor(256 x) of any finite double."""
    n, d = x.as_integer_ratio()
    return 256 * n // d


def quantised(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, integer matrix) for each dimension that occurs among the rows that take part; wide rows have objects."""
    ids, lists = batch.column("id"), batch.column("vector")
    fine = np.flatnonzero(np.asarray(ids.is_valid()) & np.asarray(lists.is_valid()))
    lists = lists.take(pa.array(fine))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    for dim in np.unique(np.diff(ends, prepend=0)):
        rows = np.flatnonzero(np.diff(ends, prepend=0) == dim)
        values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        ok = np.isfinite(values).all(1)  # false for NaN, which nulls have become
        rows, values = rows[ok], values[ok]
        with np.errstate(over="ignore"):
            whole = np.floor(SCALE * values)
        small = (np.abs(whole) < narrow(int(dim))).all(1)
        if small.any():
            yield fine[rows[small]], whole[small].astype(np.int64)
        if not small.all():
            yield fine[rows[~small]], np.array([[exact(x) for x in row] for row in values[~small].tolist()], dtype=object)


def ids_of(batch: pa.RecordBatch, rows: np.ndarray, column: str = "id") -> np.ndarray:
    return batch.column(column).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)


def build_block(ids: np.ndarray, matrix: np.ndarray) -> dict:
    if matrix.dtype == object:
        return {"dim": matrix.shape[1], "wide": True, "ids": ids.tobytes(), "low": b"", "bits": b"", "slices": json.dumps(matrix.tolist()).encode()}
    low = matrix.min(0)
    above = (matrix - low).T
    bits = np.array([int(x).bit_length() for x in above.max(1)], dtype=np.uint8)
    width = -(-len(ids) // 64) * 8
    slices = []
    for dim, n in enumerate(bits):
        planes = (above[dim][None, :] >> np.arange(n)[:, None]) & 1
        packed = np.packbits(planes.astype(np.uint8), axis=1, bitorder="little")
        slices.append(np.pad(packed, ((0, 0), (0, width - packed.shape[1]))).tobytes())
    return {"dim": matrix.shape[1], "wide": False, "ids": ids.tobytes(), "low": low.tobytes(), "bits": bits.tobytes(), "slices": b"".join(slices)}


class WideBlock:
    """Rows of integers of any size."""

    def __init__(self, ids: np.ndarray, rows: list[list[int]]):
        self.ids, self.rows = ids.tolist(), rows

    def top(self, query: list[int], k: int) -> tuple[list[int], list[int]]:
        scored = ((sum(a * b for a, b in zip(row, query, strict=True)), i) for i, row in zip(self.ids, self.rows, strict=True))
        best = heapq.nsmallest(k, ((-min(max(s, LEAST), MOST), i) for s, i in scored))
        return [i for _, i in best], [-s for s, _ in best]


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, ids: bytes, low: bytes, bits: bytes, slices: bytes):
        self.ids, self.low, self.bits = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64), np.frombuffer(bits, np.uint8).astype(np.int64)
        words = -(-len(self.ids) // 64)
        plain = np.frombuffer(slices, np.uint64).reshape(int(self.bits.sum()), words)
        self.dim_of = np.repeat(np.arange(len(self.bits)), self.bits)
        self.bit_of = np.concatenate([np.arange(n) for n in self.bits] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.planes = np.concatenate([plain, ~plain])
        self.every = np.packbits(np.arange(words * 64) < len(self.ids), bitorder="little").view(np.uint64)

    def rows_as_integers(self) -> list[list[int]]:
        """The vectors again, for queries that bit slices do not serve."""
        plain = self.planes[: len(self.dim_of)].view(np.uint8).reshape(len(self.dim_of), -1)
        bits = np.unpackbits(plain, axis=1, bitorder="little")[:, : len(self.ids)].astype(np.int64)
        out = np.tile(self.low[:, None], (1, len(self.ids)))
        np.add.at(out, self.dim_of, bits << self.bit_of[:, None])
        return out.T.tolist()

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Bit slices of ``score - constant`` for all rows, lowest first, and the constant."""
        size, negative = np.abs(query), query < 0
        constant = int((query * self.low).sum() - (size * ((1 << self.bits) - 1))[negative].sum())
        at = np.arange(len(self.dim_of)) + len(self.dim_of) * negative[self.dim_of]
        entering: dict[int, list[np.ndarray]] = {}
        for shift in range(int(size.max()).bit_length() if len(size) else 0):
            used = np.flatnonzero((size[self.dim_of] >> shift) & 1)
            places = self.bit_of[used] + shift
            for place in np.unique(places):
                entering.setdefault(int(place), []).append(at[used[places == place]])
        slices, carried, place = [], [], 0
        while carried or any(p >= place for p in entering):
            columns = carried
            if place in entering:
                columns = [*carried, self.planes[np.concatenate(entering[place])]]
            stack, carried = np.concatenate(columns) if columns else np.zeros((0, len(self.every)), np.uint64), []
            while len(stack) > 1:
                if len(stack) == 2:
                    carried.append((stack[0] & stack[1])[None])
                    stack = (stack[0] ^ stack[1])[None]
                    break
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            slices.append(stack[0] if len(stack) else np.zeros_like(self.every))
            place += 1
        return np.array(slices, dtype=np.uint64).reshape(len(slices), len(self.every)), constant

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, or of all if fewer; any order."""
        slices, constant = self.scores(query)
        tied = self.every.copy()
        sure, n_sure = np.zeros_like(tied), 0
        for row in slices[::-1]:
            upper = tied & row
            n = int(np.bitwise_count(upper).sum())
            if n_sure + n > k:
                tied = upper
            else:
                sure |= upper
                n_sure += n
                tied &= ~row
            if n_sure == k:
                break
        chosen = self.rows(sure)
        if n_sure < k:
            rest = self.rows(tied)
            if len(rest) > k - n_sure:
                rest = rest[np.argpartition(self.ids[rest], k - n_sure - 1)[: k - n_sure]]
            chosen = np.concatenate([chosen, rest])
        values = ((slices[:, chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
        return self.ids[chosen], (values << np.arange(len(slices))[:, None]).sum(0) + constant

    @staticmethod
    def rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        found = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.argwhere(found)
        return words[at[:, 0]] * 64 + at[:, 1]


def build_index(vectors: DataFrame, groups: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The bit-sliced index: one row per block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("grp", pa.int32()), ("wide", pa.bool_()), *[(x, pa.binary()) for x in ("ids", "low", "bits", "slices")]])
        for batch in batches:
            for rows, matrix in quantised(batch):
                block = build_block(ids_of(batch, rows), matrix)
                block["grp"] = zlib.crc32(block["ids"] + block["low"]) % groups
                yield pa.RecordBatch.from_pylist([block], schema=schema)

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")).mapInArrow(build, BLOCK)


def pack_queries(queries: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Packs of queries: one row per Arrow batch and dimension; repeated rows once, with how often they occur."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("q_wide", pa.bool_()), *[(x, pa.binary()) for x in ("q_ids", "q_times", "q_names", "vectors")]])
        for batch in batches:
            for rows, matrix in quantised(batch):
                ids, times, names, wide = *(ids_of(batch, rows, x) for x in ("id", "times", "name")), matrix.dtype == object
                for at in range(0, len(ids), QUERIES_PER_PACK):
                    part = slice(at, at + QUERIES_PER_PACK)
                    vectors = json.dumps(matrix[part].tolist()).encode() if wide else matrix[part].astype(np.int32).tobytes()
                    yield pa.RecordBatch.from_pylist([{"dim": matrix.shape[1], "q_wide": wide, "q_ids": ids[part].tobytes(), "q_times": times[part].tobytes(), "q_names": names[part].tobytes(), "vectors": vectors}], schema=schema)

    rows = queries.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    return rows.groupBy("id", "vector").agg(F.count("*").alias("times")).withColumn("name", F.xxhash64("vector")).mapInArrow(pack, PACK)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, variant, rank, vec_id, score``: the k best rows of ``vectors`` for each row of ``queries``, its own row left out."""
    spark = vectors.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = build_index(vectors, groups, id_column, column)
    packs = pack_queries(queries, id_column, column).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = index.join(packs.hint("shuffle_hash"), ["grp", "dim"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x, pa.int64()) for x in ("query_id", "variant", "times", "own", "vec_id", "score")])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                q_ids, q_times, q_names = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "q_times", "q_names"))
                if row["q_wide"]:
                    asked = json.loads(row["vectors"])
                else:
                    asked = np.frombuffer(row["vectors"], np.int32).reshape(len(q_ids), row["dim"]).astype(np.int64)
                block = None if row["wide"] else Block(row["ids"], row["low"], row["bits"], row["slices"])
                if row["wide"] or row["q_wide"]:
                    block = WideBlock(np.frombuffer(row["ids"], np.int64), json.loads(row["slices"]) if row["wide"] else block.rows_as_integers())
                    asked = asked if row["q_wide"] else asked.tolist()
                out: list[list[np.ndarray]] = [[] for _ in schema]
                for own, times, name, query in zip(q_ids, q_times, q_names, asked, strict=True):
                    ids, scores = block.top(query, k + 1)
                    self_score = min(sum(int(x) ** 2 for x in query), MOST)
                    for column, values in zip(out, (*(np.full(len(ids), x) for x in (own, name, times, self_score)), ids, scores), strict=True):
                        column.append(np.asarray(values, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=schema)

    hits = pairs.select("dim", "wide", "ids", "low", "bits", "slices", "q_wide", "q_ids", "q_times", "q_names", "vectors").mapInArrow(search, HITS)
    best = W.partitionBy("query_id", "variant", "times").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    ranked = ranked.withColumn("is_own", own).withColumn("owns", F.count_if(own).over(best.rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.where(~(F.col("is_own") & (F.col("owns") == 1))).withColumn("rank", (F.col("place") - F.least("owns", F.lit(1))).cast("int")).where(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return ranked.select("query_id", "variant", "rank", "vec_id", "score", each.alias("copy")).drop("copy")
