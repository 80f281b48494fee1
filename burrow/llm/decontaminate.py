"""Benchmark decontamination with suffix arrays over the training texts.

Each batch of documents is a shard. Its words become ids of the benchmark's vocabulary, and the shard's suffixes
whose first three words begin some benchmark suffix (no other can match) are sorted into a suffix array, as far as
a window reaches: by three words to a machine word, ties refined with the next three. Every benchmark suffix of at
least ``window`` words is then binary-searched by its first ``window`` words: the range of suffixes that share them
are all places of that window. If asked for, neighbouring places on a diagonal join to the longest verbatim matches
with their locations. Documents are never shuffled.

The benchmark goes to the executors in packs of a bounded number of words; longer items are cut into pieces that
overlap by a window. Packs are broadcast up to ``BROADCAST_WORDS`` words at a time; a larger benchmark takes several
passes over the documents, with a written table between them.

Cases: null texts have no words and no matches; benchmark items without words match nothing, those of fewer words
than a window are one window; equal windows of several items count for each; items of one id are one item; a null
id is an empty one; repeated rows are kept with equal results; texts are matched whole; empty tables give no rows, an empty benchmark no matches; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

WINDOW = 13
#: Words of the benchmark in one pack, and in the packs that are broadcast at a time. A pack's distinct words fit 21 bits.
PACK_WORDS, BROADCAST_WORDS = 1 << 19, 1 << 24
#: Bytes of documents that are searched as one shard.
SHARD_BYTES = 16 << 20
MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,words:int>>"
#: Letters in lower case, digits and bytes beyond ASCII stay; all else separates words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class Pack:
    """Some pieces of benchmark items, each a name, the number of its first word, and words: their vocabulary and their distinct windows."""

    def __init__(self, pieces: list[tuple[str, int, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        held: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        self.names, self.firsts = [p[0] for p in pieces], [p[1] for p in pieces]
        for i, (_, _, words) in enumerate(pieces):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for at in range(max(len(ids) - window + 1, min(1, len(ids)))):
                held[tuple(ids[at : at + window])].append((i, at))
        self.holders = []
        order = sorted(held)
        self.lengths = np.array([len(x) for x in order], dtype=np.int64)
        padded = np.zeros((len(order), -(-window // 3) * 3), dtype=np.int64)
        for i, x in enumerate(order):
            padded[i, : len(x)] = x
            self.holders.append(held[x])
        self.padded = padded
        self.first = np.unique(padded[self.lengths >= 3, 0] << 42 | padded[self.lengths >= 3, 1] << 21 | padded[self.lengths >= 3, 2])
        self.short = np.unique(padded[self.lengths < 3, 0])


def packs_of(benchmark: DataFrame, id_column: str, text_column: str, window: int, pack_words: int) -> Iterator[tuple[int, Pack]]:
    """The number of its words and the pack, one after another; rows reach the driver one partition at a time."""
    held: list[tuple[str, int, list[bytes]]] = []
    size = 0
    rows = benchmark.where(F.col(text_column).isNotNull()).select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("i"), F.col(text_column).alias("t"))
    for name, text in rows.toLocalIterator():
        words = words_of(text)
        for at in range(0, max(1, len(words) - window + 1), pack_words):
            piece = words[at : at + pack_words + window - 1]
            held.append((name, at, piece))
            size += len(piece)
            if size >= pack_words:
                yield size, Pack(held, window)
                held, size = [], 0
    if held:
        yield size, Pack(held, window)


def ranges(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each range [low, high) of ``keys``, sorted within it, the first place not below ``bound``: all binary searches at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = np.zeros(len(low), dtype=bool)
        less[open_] = keys[middle[open_]] < bound[open_]
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def search(stream: np.ndarray, pack: Pack) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence of every window in a stream of word ids, where 0 is no benchmark word."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = pack.padded.shape[1] // 3
    padded = np.concatenate([stream, np.zeros(3 * parts + 2, np.int64)])
    key = padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:]
    starts = np.isin(key[: len(stream)], pack.first, kind="sort") if len(pack.first) else np.zeros(len(stream), bool)
    if len(pack.short):
        starts |= np.isin(stream, pack.short)
    suffixes = np.flatnonzero(starts)
    if not len(suffixes):
        return none
    keys = [key[suffixes + 3 * p] for p in range(parts)]
    order = np.lexsort(keys[::-1])
    suffixes, keys = suffixes[order], [k[order] for k in keys]
    low, high = np.zeros(len(pack.lengths), np.int64), np.full(len(pack.lengths), len(suffixes), np.int64)
    for p in range(parts):
        words = pack.padded[:, 3 * p : 3 * p + 3]
        least = words[:, 0] << 42 | words[:, 1] << 21 | words[:, 2]
        held = np.clip(pack.lengths - 3 * p, 0, 3)
        most = least + (np.int64(1) << (21 * (3 - held)))
        live = (held > 0) & (low < high)
        low_now = ranges(keys[p], low[live], high[live], least[live])
        high[live] = ranges(keys[p], low_now, high[live], most[live])
        low[live] = low_now
    n = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    return suffixes[np.repeat(low, n) + offset], window


def match_shard(texts: list, states: list[dict], pack: Pack, wanted: bool) -> None:
    """Add a pack's hits to the state of each document: the number of words, hit ranges [begin, end), item names and, if wanted, matches."""
    get, streams, lengths = pack.vocabulary.get, [], []
    for text in texts:
        words = words_of(text)
        lengths.append(len(words))
        streams.append(np.fromiter(chain(map(get, words, repeat(0)), (0,)), np.int64, len(words) + 1))
    begins = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    place, window = search(np.concatenate(streams) if streams else np.zeros(0, np.int64), pack)
    for state, n in zip(states, lengths, strict=True):
        state["n_words"] = n
    if not len(place):
        return
    owner = np.searchsorted(begins, place, side="right") - 1
    order = np.argsort(owner, kind="stable")
    owner, place, window = owner[order], place[order], window[order]
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        state, at, held = states[owner[part[0]]], place[part] - begins[owner[part[0]]], window[part]
        flags = np.zeros(state["n_words"] + 1, np.int64)
        np.add.at(flags, at, 1)
        np.add.at(flags, at + pack.lengths[held], -1)
        for r in state["hit"]:
            flags[r["begin"]] += 1
            flags[r["end"]] -= 1
        covered = np.concatenate([[0], (np.cumsum(flags)[:-1] > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered))
        state["hit"] = [{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        state["items"] = sorted({*state["items"], *(pack.names[i] for w in np.unique(held) for i, _ in pack.holders[w])})
        if not wanted:
            continue
        seen = sorted((i, int(a) - offset, offset, int(pack.lengths[w])) for a, w in zip(at, held, strict=True) for i, offset in pack.holders[w])
        runs: list[list[int]] = []
        for i, diagonal, offset, n in seen:
            if runs and runs[-1][0] == i and runs[-1][1] == diagonal and offset <= runs[-1][2] + runs[-1][3] - n + 1:
                runs[-1][3] = offset + n - runs[-1][2]
            else:
                runs.append([i, diagonal, offset, n])
        found = [{"item_id": pack.names[i], "item_word": offset + pack.firsts[i], "doc_word": diagonal + offset, "words": n} for i, diagonal, offset, n in runs]
        state["matches"] = sorted([*state["matches"], *found], key=lambda m: (-m["words"], m["item_id"], m["doc_word"], m["item_word"]))


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", window: int = WINDOW, matches: bool = False, pack_words: int = PACK_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` and one more, ``overlap``: n_words, n_hit, items and, if ``matches`` are asked for, those (longest first; else none).

    There is a match for each place and item that shares it. A match that spans two pieces of a long item is given in two parts.
    """
    spark = docs.sparkSession
    state = f"struct<n_words:long,hit:array<struct<begin:int,end:int>>,items:array<string>,matches:{MATCH}>"
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])))])
    now = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"), F.lit(None).cast(state).alias("state"))
    schema = now.schema

    def passed(rows: DataFrame, packs: list) -> DataFrame:
        sent = [spark.sparkContext.broadcast(p) for p in packs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text")
                sizes = np.cumsum(texts.nbytes // max(1, batch.num_rows) * np.ones(batch.num_rows, np.int64)) // SHARD_BYTES
                for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes)) + 1):
                    if not len(part):
                        continue
                    some = batch.slice(int(part[0]), len(part))
                    held = some.column("text").to_pylist()
                    states = [s or {"n_words": 0, "hit": [], "items": [], "matches": []} for s in some.column("state").to_pylist()]
                    for pack in sent:
                        match_shard(held, states, pack.value, matches)
                    yield pa.RecordBatch.from_arrays([some.column("row"), some.column("text"), pa.array(states, kind)], names=["row", "text", "state"])

        return rows.mapInArrow(run, schema)

    held, size = [], 0
    for words, pack in packs_of(benchmark, item_id, "text", window, pack_words):
        if held and size + words > broadcast_words:
            before, now = now, stored(passed(now, held))
            drop(before)
            held, size = [], 0
        held.append(pack)
        size += words
    now = passed(now, held or [Pack([], window)])
    hit = F.aggregate("state.hit", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["begin"])
    overlap = F.struct("state.n_words", hit.alias("n_hit"), "state.items", "state.matches").alias("overlap")
    return now.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "overlap"], overlap)


def is_contaminated(overlap=None):
    """A document is affected if at least a twentieth of its words, and one word, lie within benchmark windows."""
    overlap = F.col("overlap") if overlap is None else overlap
    return (overlap["n_hit"] > 0) & (overlap["n_hit"] * 20 >= overlap["n_words"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without affected documents; the same columns."""
    return match_benchmark(docs, benchmark).where(~is_contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])
