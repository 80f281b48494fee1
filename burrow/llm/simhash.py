"""SimHash near-duplicates: fingerprints, pigeonhole blocks, and Hamming distance.

``link_fingerprints`` is exact: fingerprints of 64 bits that differ in at most two bits agree on one of three
blocks. Fingerprints are made distinct first, then grouped by block; a block value with many fingerprints is not
compared as a whole, but its remaining bits are split into three blocks again, until groups are small. (Two bits
cannot touch three blocks, so no link is lost, and the last groups have few members since fingerprints are
distinct.) A group ties each of its members to the first member that links reach.

``near_duplicates`` serves the Jaccard similarity of shingle sets. Texts meet in blocks: a block's key is made of
``VALUES`` minima of the set's hashes, each under another seeded order, so that two texts of similarity J share it with
probability J ** VALUES whatever the size of the table. The number of blocks follows from ``FLOOR``, the least
probability that texts of just the wanted similarity meet at all. What meets is decided by the exact similarity of the
sets. A block's members are compared with its member of the smallest hash; blocks that still hold several components are
compared in full, those of more than ``GROUP`` members in tiles over several tasks. Texts are told apart by a hash of 64 bits.

Cases: null and empty texts have no words, the fingerprint zero and the empty set, linked like any other; texts of fewer words
than a shingle are one shingle; texts are read whole; repeated rows are kept by ``link_fingerprints`` and are one
document to ``drop_near_duplicates``; null ids count as larger than any other; empty tables give an empty result; other
columns are ignored, or carried along by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop, stored
from .graph import components

#: Members up to which a block is compared as a whole, and shingles in a part of a larger one.
GROUP, PART_SHINGLES = 256, 1 << 20
#: Minima in a block's key, and the least probability that texts of the wanted similarity meet in a block.
VALUES, FLOOR = 6, 0.9999
#: Rows of at most some 40 bytes up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000
#: Shingles whose hashes are held at once.
PIECE = 1 << 14


def shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in pieces."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    if 0 < len(words) < width:
        yield np.array([digest(b" ".join(words), seed)], dtype=np.uint64)
    for at in range(0, len(words) - width + 1, PIECE):
        rows = zip(*[words[at + j : at + j + min(PIECE, len(words) - width + 1 - at)] for j in range(width)], strict=True)
        yield np.array([digest(b" ".join(r), seed) for r in rows], dtype=np.uint64)


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` machine words of bits for each hash; the first is the hash itself."""
    if words == 1:
        return hashes[:, None]
    x = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def count_slices(rows: np.ndarray) -> list[np.ndarray]:
    """Bit slices, lowest first, of how many rows have each bit set: carry-save adders over machine words."""
    slices, stack = [], rows
    while len(stack):
        carried = []
        while len(stack) > 2:
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            half = a ^ b
            carried.append((a & b) | (half & c))
            stack = np.concatenate([half ^ c, stack[3 * third :]])
        if len(stack) == 2:
            carried.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        slices.append(stack[0])
        stack = np.concatenate(carried) if carried else stack[:0]
    return slices


def add_slices(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        x = [s for s in (a[i] if i < len(a) else None, b[i] if i < len(b) else None, carry) if s is not None]
        total, carry = x[0], None
        for y in x[1:]:
            over = total & y
            total, carry = total ^ y, over if carry is None else carry | over
        out.append(total)
    return out if carry is None else [*out, carry]


def fingerprint(text: str | None, width: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """A bit is 1 if it is set in over half the shingles' hashes; zero without words."""
    counts, n = [], 0
    for hashes in shingle_hashes(text, width, seed):
        for at in range(0, len(hashes), 1 << 11):
            counts = add_slices(counts, count_slices(widened(hashes[at : at + (1 << 11)], words)))
        n += len(hashes)
    over, same = np.zeros(words, np.uint64), np.full(words, np.uint64(2**64 - 1))
    for i in range(max(len(counts), (n // 2).bit_length()) - 1, -1, -1):
        bit = counts[i] if i < len(counts) else np.zeros(words, np.uint64)
        if (n // 2) >> i & 1:
            same &= bit
        else:
            over |= same & bit
            same &= ~bit
    return over


def fingerprints(docs: DataFrame, width: int, words: int = 1, seed: int = 42, *, text: str = "text") -> DataFrame:
    """``doc_id, fp`` of each row: a long for one word of bits, else binary; ``text_hash`` tells texts apart."""
    wide = words > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                prints = [fingerprint(t, width, words, seed) for t in some.column("text").to_pylist()]
                fp = pa.array([p.tobytes() for p in prints], pa.binary()) if wide else pa.array(np.array([p[0] for p in prints], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), fp], names=["doc_id", "text_hash", "fp"])

    chosen = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, text_hash long, fp {'binary' if wide else 'long'}")


def split_bits(bits: list[int]) -> list[list[int]]:
    return [bits[len(bits) * i // 3 : len(bits) * (i + 1) // 3] for i in range(3)]


def as_long(bits: list[int]) -> int:
    return (m := sum(1 << b for b in bits)) - (1 << 64 if m >> 63 else 0)


def group_links(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties between each member of a group of distinct fingerprints and the first member that links within the group reach."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= distance
    root = np.arange(len(members))
    while ((low := np.where(near, root[None, :], len(members)).min(1)) != root).any():
        root = low
    moved = np.flatnonzero(root != np.arange(len(members)))
    return members[moved], members[root[moved]]


def close_pairs(prints: DataFrame, distance: int = 2, limit: int = GROUP) -> DataFrame:
    """``a, b``: ties with the same components as all pairs of ``fp`` with ``distance`` or fewer differing bits (two at most)."""
    if not 0 <= distance <= 2:
        raise ValueError("three blocks serve distances up to 2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            values, ends = lists.flatten().to_numpy().astype(np.int64).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
            found = [group_links(values[a:b], distance) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            for part in range(0, len(found), 4096):
                a, b = (np.concatenate([x[i] for x in found[part : part + 4096]]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    links, level = None, [(0, split_bits(list(range(64))))]
    rows = prints.select("fp", F.lit(0).cast("long").alias("held"))
    while True:
        # the masks under each mask that is held so far, a fixed table of the level
        below = {as_mask: [(as_long(bits_of(as_mask) + part), part) for part in parts] for as_mask, parts in level}
        masks = F.create_map(*[x for m, subs in below.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(s).cast("long") for s, _ in subs]))])
        spread = rows.select("fp", F.explode(F.element_at(masks, F.col("held"))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = stored(spread.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        last = all(64 - len(bits_of(s)) <= int(math.log2(limit)) for subs in below.values() for s, _ in subs)
        small = spread.join(counts.where(F.col("n") <= (1 << 62 if last else limit)).select("mask", "key"), ["mask", "key"])
        found = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(compare, "a long, b long")
        links = found if links is None else links.unionAll(found)
        if last or not counts.where(F.col("n") > limit).head(1):
            return links
        rows = stored(spread.join(counts.where(F.col("n") > limit).select("mask", "key"), ["mask", "key"]).select("fp", F.col("mask").alias("held")))
        level = [(s, split_bits([b for b in range(64) if b not in set(bits_of(s))])) for subs in below.values() for s, _ in subs]


def bits_of(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def link_fingerprints(docs: DataFrame, width: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: the smallest doc_id among all that links of ``distance`` or fewer bits reach."""
    prints = stored(fingerprints(docs, width, 1, seed).select("doc_id", "fp"))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(close_pairs(nodes, distance))
    roots = nodes.join(tied, nodes.fp == tied.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("tied"))
    roots = stored(roots)
    groups = roots.join(tied.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(groups, "root", "left").select(F.col("fp").alias("print"), F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, prints.fp == named.print).select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width, seed)]))


def blocks_needed(similarity: float, values: int = VALUES, floor: float = FLOOR) -> int:
    """Blocks by which texts of ``similarity`` meet with a probability of ``floor`` at least; texts alike in all meet in one."""
    return max(1, math.ceil(math.log(1 - floor) / math.log1p(-(similarity**values)))) if similarity < 1 else 1


def block_keys(hashes: np.ndarray, blocks: int, values: int, seed: int) -> np.ndarray:
    """A key for each block, made of ``values`` minima of the hashes under that block's own seeded orders."""
    rng = np.random.default_rng(seed)
    factor, shift = (rng.integers(0, 2**64, blocks * values, dtype=np.uint64) for _ in range(2))
    least = np.full(blocks * values, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[at : at + 256, None] * (factor | np.uint64(1)) + shift).min(0))
    keys = np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(blocks, values).T:
        keys = (keys ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys


def text_hash(text: str = "text") -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def set_prints(docs: DataFrame, width: int, blocks: int, values: int, seed: int) -> DataFrame:
    """``doc_id, n, size, keys``: ``n`` tells texts apart, ``size`` counts their distinct shingles, ``keys`` are the blocks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                size, keys = [], []
                for text in some.column("text"):
                    hashes = shingle_set(text.as_py(), width, seed)
                    size.append(len(hashes))
                    keys.append(block_keys(hashes, blocks, values, seed))
                ends = pa.array(np.arange(len(size) + 1, dtype=np.int32) * blocks)
                listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n"), pa.array(size, pa.int64()), listed], names=["doc_id", "n", "size", "keys"])

    chosen = docs.select("doc_id", text_hash().alias("n"), "text")
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, n long, size long, keys array<long>")


def similar(common: np.ndarray, size: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes with so many common members have the Jaccard similarity or more."""
    return common >= similarity * (size + other - common) - 1e-9


def set_links(root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between roots that tie them as all pairs of members with different roots and similar sets would."""
    size = np.array([len(s) for s in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    found, stem = [], root.copy()
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero((stem[i + 1 :] != stem[i]) & similar(np.minimum(size[i + 1 :], size[i]), size[i + 1 :], size[i], similarity))
        if not len(others):
            continue
        mine = np.zeros(len(names), bool)
        mine[at[ends[i] : ends[i + 1]]] = True
        before = np.concatenate([[0], np.cumsum(mine[at])])
        for j in others[similar((before[ends[1:]] - before[ends[:-1]])[others], size[others], size[i], similarity)]:
            if stem[j] != stem[i]:
                found.append((int(root[i]), int(root[j])))
                stem[stem == stem[j]] = stem[i]
    return found


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table of short rows, to be broadcast if it has few enough; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, *, group: int = GROUP, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``n, first, copies`` for each distinct text, and ``node, root`` for all texts ``n`` that are near-duplicates of their root.

    ``first`` is the smallest doc_id, within a struct that puts nulls last; ``copies`` counts the documents. Roots have no row
    of their own in the second table.
    """
    blocks = blocks_needed(similarity)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = None, None
        for batch in batches:
            n, pivot, text, other = (batch.column(c) for c in ("n", "pivot", "text", "pivot_text"))
            close = []
            for i in range(batch.num_rows):
                if pivot[i].as_py() != known:
                    known, held = pivot[i].as_py(), shingle_set(other[i].as_py(), width, seed)
                own = shingle_set(text[i].as_py(), width, seed)
                close.append(bool(similar(len(np.intersect1d(own, held, assume_unique=True)), len(own), len(held), similarity)))
            yield pa.RecordBatch.from_arrays([n.filter(pa.array(close, pa.bool_())), pivot.filter(pa.array(close, pa.bool_()))], names=["a", "b"])

    prints = stored(set_prints(docs, width, blocks, VALUES, seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    nodes = stored(prints.groupBy("n").agg(first, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    rows = nodes.select("n", "size", F.explode("keys").alias("key"))
    pivot = F.min_by(F.struct("n", "size"), F.xxhash64("n", F.lit(seed)))
    groups = rows.groupBy("key").agg(F.count("*").alias("members"), pivot.alias("p")).where("members > 1")
    groups = stored(groups.select("key", F.col("p.n").alias("pivot"), F.col("p.size").alias("pivot_size")))
    met = stored(rows.join(bounded(groups), "key"))
    wanted = stored(met.select("n").distinct())
    held = docs.select(text_hash().alias("n"), "text").join(bounded(wanted), "n", "left_semi")
    texts = stored(held.groupBy("n").agg(F.first("text").alias("text")))
    # sets of too unlike sizes cannot be similar
    fit = F.least("size", "pivot_size") >= F.lit(similarity) * F.greatest("size", "pivot_size") - 1e-9
    pairs = met.where("n <> pivot").where(fit).select("n", "pivot").distinct()
    both = pairs.join(texts, "n").join(texts.select(F.col("n").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    by_pivot = stored(both.select("n", "pivot", "text", "pivot_text").mapInArrow(verify, "a long, b long"))
    tied = components(by_pivot)
    within = stored(links_in_tiles(met, tied, texts, width, similarity, group, seed))
    again = components(within).withColumnsRenamed({"node": "was", "root": "now"})
    moved = tied.join(again, tied.root == again.was, "left").select("node", F.coalesce("now", "root").alias("root"))
    ties = stored(moved.unionAll(again.select(F.col("was").alias("node"), F.col("now").alias("root"))))
    for used in (prints, groups, met, wanted, texts, by_pivot, tied, within, again):
        drop(used)
    out = nodes.select("n", "first", "copies")
    out._burrow_path = nodes._burrow_path
    return out, ties


def links_in_tiles(met: DataFrame, tied: DataFrame, texts: DataFrame, width: int, similarity: float, group: int, seed: int) -> DataFrame:
    """``a, b``: links between roots that tie them as a comparison of all pairs of different roots in each block would.

    A block's home is the root of most of its members; members of other roots are strays. Strays and the rest are dealt to
    parts of about ``group`` members and ``PART_SHINGLES`` shingles at most; every part of strays is compared with itself and
    each other part, in a tile of its own. Blocks of the same members are compared once.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            found = set_links(np.array(root), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        tile, root, sets = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                at, stem, text = (batch.column(c)[i].as_py() for c in ("tile", "root", "text"))
                if at != tile and root:
                    yield links()
                    root, sets = [], []
                tile = at
                root.append(stem)
                sets.append(shingle_set(text, width, seed))
        if root:
            yield links()

    more = stored(met.select("key", "n", "size").join(tied.withColumnRenamed("node", "n"), "n", "left").select("key", "n", "size", F.coalesce("root", "n").alias("root")))
    by_root = more.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("n")).alias("x"), F.bit_xor(F.xxhash64("n", F.lit(1))).alias("y"))
    home = [F.max_by(c, F.struct("c", "root")).alias(f"home_{c}") for c in ("root", "c", "size")]
    several = by_root.groupBy("key").agg(*home, F.sum("c").alias("c"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("c > home_c")
    parts = lambda c, size: F.greatest(F.ceil(c / group), F.ceil(size / PART_SHINGLES)).cast("long")
    several = several.dropDuplicates(["x", "y", "c"]).select("key", "home_root", parts(F.col("c") - F.col("home_c"), F.col("size") - F.col("home_size")).alias("s"), parts(F.col("home_c"), F.col("home_size")).alias("d"))
    dealt = more.join(bounded(stored(several)), "key").withColumn("stray", F.col("root") != F.col("home_root"))
    # a part of strays meets each other part of strays under the smaller number of both, and the rest's parts under negative ones
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine = F.pmod(F.xxhash64("n", F.lit(seed + 1)), F.when(F.col("stray"), F.col("s")).otherwise(F.col("d")))
    dealt = dealt.withColumn("mine", mine)
    with_rest = F.transform(upto("d"), lambda j: F.xxhash64("key", "mine", -1 - j))
    with_strays = F.transform(F.filter(upto("s"), lambda x: x != F.col("mine")), lambda x: F.xxhash64("key", F.least("mine", x), F.greatest("mine", x)))
    of_rest = F.transform(upto("s"), lambda i: F.xxhash64("key", i, -1 - F.col("mine")))
    tiles = dealt.select("n", "root", F.explode(F.when(F.col("stray"), F.concat(with_rest, with_strays)).otherwise(of_rest)).alias("tile"))
    return tiles.join(texts, "n").select("tile", "root", "text").repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "a long, b long")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest doc_id; the same columns."""
    nodes, ties = near_duplicates(docs, width, similarity)
    grouped = nodes.join(ties.withColumnRenamed("node", "n"), "n", "left").select("n", "first", "copies", F.coalesce("root", "n").alias("root"))
    least = grouped.groupBy("root").agg(F.min(F.struct("first", "n")).alias("least"), F.count("*").alias("texts"))
    # texts that stand alone in one document need no decision
    several = grouped.join(least, "root").where("texts > 1 or copies > 1")
    rules = bounded(stored(several.select(F.col("n").alias("rule"), (F.col("n") == F.col("least.n")).alias("stays"), F.col("first.doc_id").alias("first_id"))))
    drop(nodes)
    drop(ties)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d_id"), text_hash().alias("d_hash"))
    alone = named.join(rules, named.d_hash == rules.rule, "left_anti").select("row")
    firsts = named.join(rules.where("stays"), (named.d_hash == F.col("rule")) & named.d_id.eqNullSafe(F.col("first_id")))
    once = firsts.groupBy("d_hash").agg(F.first("row").alias("row")).select("row")  # a row may be repeated
    return alone.unionAll(once).select("row.*")
