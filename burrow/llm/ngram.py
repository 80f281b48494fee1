"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is a word bigram model with Dirichlet smoothing: P(w | h) = (c(h, w) + m P(w)) / (c(h) + m), and
P(w) = (c(w) + 1) / (N + V + 1); an unseen word's share is that of one more word. A text's context begins and ends
with the end token. The trie holds the smoothed P(w | h) of each pair that occurs, quantised to 2^16 steps of its
logarithm; that of a pair that doesn't follows from the counts of its words.

Neither vocabulary nor trie need fit one machine. Texts are packed into chunks of bounded size; a chunk asks the
shards of the vocabulary for the counts of its distinct words, and the shards of the trie for its distinct pairs,
each in one compressed message per shard. Pairs are dealt by the hash of both words, so that no frequent context
makes a shard heavy. A trie shard is built from the training counts in its messages, written, memory-mapped,
queried, and removed. The number of shards follows the input's size. A document's own figures pass through a shard
that its chunk's number deals them to. A vocabulary of 2^32 ids or more raises an error.

Cases: null and empty texts hold the end token alone; texts are scored whole; repeated rows are scored and, in
training, counted each; a null id is a training row; an empty table gives an empty result; without training rows
all words are unseen; other columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, input_bytes, stored
from .elias_fano import Trie

#: Bytes of text in a chunk, and of input to a shard.
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: The weight of the single-word model, in occurrences.
PRIOR = 400.0
#: Words never hold a space.
END = b" "


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message, integers in the fewest bytes."""
    head, body = [], []
    for x in arrays:
        if x.dtype.kind in "iu":
            x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        head.append(f"{x.dtype.str}:{len(x)}")
        # byte planes compress better than whole integers
        body.append(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")
    first = ",".join(head).encode()
    return zstandard.compress(len(first).to_bytes(4, "little") + first + b"".join(body), 1)


def unpack(message: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(message)
    size = int.from_bytes(raw[:4], "little")
    at, out = 4 + size, []
    for item in raw[4:at].decode().split(","):
        kind, n = item.rsplit(":", 1)
        kind, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


class Numbers(dict):
    """Words numbered in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def chunked(docs: DataFrame, shards: int) -> DataFrame:
    """One row per chunk (shard -1: ids, held flags and numbered words) and one per chunk and shard of the vocabulary (words and training counts)."""
    kind = dict(docs.dtypes)["doc_id"]

    def emit(chunk: int, ids: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
        numbers, streams = Numbers(), []
        get = numbers.__getitem__
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
            words.append(END)
            streams.append(np.fromiter(map(get, words), np.int64, len(words)))
        lengths = np.array([len(s) for s in streams], np.int64)
        stream = np.concatenate(streams)
        counts = np.bincount(stream[np.repeat(~np.array(held, bool), lengths)], minlength=len(numbers))
        # numbers by frequency compress better
        order = np.argsort(-np.bincount(stream, minlength=len(numbers)), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        listed = np.array(list(numbers), dtype=object)[order]
        owner = np.fromiter((zlib.crc32(w) % shards for w in listed), np.int64, len(listed))
        rows = [{"chunk": chunk, "shard": -1, "train": int(counts.sum()), "ids": ids, "body": pack(np.array(held, np.uint8), lengths, place[stream]), "words": None}]
        for shard in np.unique(owner):
            mine = np.flatnonzero(owner == shard)
            rows.append({"chunk": chunk, "shard": int(shard), "train": 0, "ids": None, "body": pack(mine, counts[order][mine]), "words": zstandard.compress(b"\n".join(listed[mine]), 1)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("train", pa.int64()), ("ids", pa.list_(id_type)), ("body", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for i, h, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2), strict=True):
                    text = t.as_py()
                    ids.append(i)
                    held.append(h)
                    texts.append(text)
                    size += len(text or "") + 64
                    if size >= CHUNK_BYTES:
                        yield from emit(chunk, ids, held, texts)
                        chunk, ids, held, texts, size = chunk + 1, [], [], [], 0
        if ids:
            yield from emit(chunk, ids, held, texts)

    return docs.select("doc_id", "held", "text").mapInArrow(run, f"chunk long, shard int, train long, ids array<{kind}>, body binary, words binary")


def count_words(rows: DataFrame, shards: int) -> DataFrame:
    """For each chunk's message its words' ids and training counts; and per shard, under chunk -1, how many words were trained on."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        numbers, parts = Numbers(), []
        get = numbers.__getitem__
        for chunk, body, words in zip(*(table.column(c).to_pylist() for c in ("chunk", "body", "words")), strict=True):
            places, counts = unpack(body)
            words = zstandard.decompress(words).split(b"\n")
            parts.append((chunk, places, counts, np.fromiter(map(get, words), np.int64, len(words))))
        if len(numbers) * shards >= 1 << 32:
            raise OverflowError("the vocabulary needs more than 2^32 ids")
        total = np.zeros(len(numbers), np.int64)
        for _, _, counts, own in parts:
            np.add.at(total, own, counts.astype(np.int64))
        out = [{"chunk": c, "reply": pack(places, own * shards + shard, total[own]), "known": 0} for c, places, _, own in parts]
        out.append({"chunk": -1, "reply": None, "known": int((total > 0).sum())})
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("reply", pa.binary()), ("known", pa.int64())]))

    return rows.where("shard >= 0").select("chunk", "shard", "body", "words").groupBy("shard").applyInArrow(run, "chunk long, reply binary, known long")


def ask_pairs(chunks: DataFrame, replies: DataFrame, shards: int) -> DataFrame:
    """For each chunk and shard of the trie: pairs, their training counts, the single words' counts, and where they occur; with one shard, dealt by chunk, the documents' own figures."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("ask", pa.binary()), ("ids", left.schema.field("ids").type), ("own", pa.binary())])
        if not left.num_rows:
            return schema.empty_table()
        chunk = left.column("chunk")[0].as_py()
        held, lengths, stream = unpack(left.column("body")[0].as_py())
        answers = [unpack(r) for r in right.column("reply").to_pylist()]
        size = sum(len(a[0]) for a in answers)
        ids, counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        for places, own, n in answers:
            ids[places], counts[places] = own, n
        lengths = lengths.astype(np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        word, count = ids[stream], counts[stream]
        base = np.bincount(doc, np.log10(count + 1.0), minlength=len(lengths))
        known = np.bincount(doc, count > 0, minlength=len(lengths)).astype(np.int64)
        last = np.cumsum(lengths) - 1
        before = np.concatenate([[ids[stream[last[0]]]], word[:-1]])
        ends = count[last[0]]
        context_count = np.concatenate([[ends], count[:-1]])
        key = (before << np.uint64(32)) | word
        order = np.argsort(key, kind="stable")
        key, at = key[order], doc[order]
        trained = held[at] == 0
        new_pair = np.diff(key, prepend=key[0] + np.uint64(1)) != 0
        pair = np.cumsum(new_pair) - 1
        new_spot = new_pair | (np.diff(at, prepend=-1) != 0)
        spots = np.flatnonzero(new_spot)
        times = np.diff(np.append(spots, len(key)))
        firsts = np.flatnonzero(new_pair)
        pair_key = key[firsts]
        pair_train = np.bincount(pair, trained, minlength=len(firsts)).astype(np.int64)
        pair_before, pair_word = context_count[order][firsts], count[order][firsts]
        spot_pair, spot_doc = pair[spots], at[spots]
        mixed = (pair_key ^ (pair_key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        owner = ((mixed >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
        spot_owner = owner[spot_pair]
        n_spots = np.bincount(spot_pair, minlength=len(firsts))
        by_owner, spots_by_owner = np.argsort(owner, kind="stable"), np.argsort(spot_owner, kind="stable")
        cuts, spot_cuts = np.searchsorted(owner[by_owner], np.arange(shards + 1)), np.searchsorted(spot_owner[spots_by_owner], np.arange(shards + 1))
        out, home = [], zlib.crc32(chunk.to_bytes(8, "little")) % shards
        for s in range(shards):
            mine, spot = by_owner[cuts[s] : cuts[s + 1]], spots_by_owner[spot_cuts[s] : spot_cuts[s + 1]]
            own = pack(held, lengths, known, base) if s == home else None
            if not len(mine) and own is None:
                continue
            context = (pair_key[mine] >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.diff(context, prepend=-1))
            successors = np.diff(np.append(starts, len(mine)))
            ask = pack(context[starts], pair_before[mine][starts], successors, pair_key[mine] & np.uint64(0xFFFFFFFF), pair_train[mine], pair_word[mine], n_spots[mine], spot_doc[spot], times[spot])
            out.append({"chunk": chunk, "shard": s, "ask": ask, "ids": left.column("ids")[0].as_py() if s == home else None, "own": own})
        return pa.Table.from_pylist(out, schema=schema)

    kind = dict(chunks.dtypes)["ids"]
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, f"chunk long, shard int, ask binary, ids {kind}, own binary")


def answer_pairs(asked: DataFrame, total: int, known: int, prior: float) -> DataFrame:
    """Each shard builds its trie and sums up the log10 probabilities of its pairs by document."""
    kind = dict(asked.dtypes)["ids"]
    spread = np.log10(total + known + 1.0)

    def run(table: pa.Table) -> pa.Table:
        messages = table.column("ask").to_pylist()
        keys, counts, befores, singles = [], [], [], []
        for m in messages:
            contexts, before, successors, words, train, single, *_ = unpack(m)
            seen = train > 0
            keys.append(((np.repeat(contexts.astype(np.uint64), successors) << np.uint64(32)) | words.astype(np.uint64))[seen])
            counts.append(train[seen].astype(np.int64))
            befores.append(np.repeat(before.astype(np.int64), successors)[seen])
            singles.append(single[seen].astype(np.int64))
        key, count, before, single = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts, befores, singles))
        del keys, counts, befores, singles
        order = np.argsort(key, kind="stable")
        key = key[order]
        firsts = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
        pairs = np.add.reduceat(count[order], firsts) if len(firsts) else np.zeros(0, np.int64)
        log_p = np.log10((pairs + prior * 10.0 ** (np.log10(single[order][firsts] + 1.0) - spread)) / (before[order][firsts] + prior))
        out = []
        with tempfile.TemporaryDirectory() as folder:
            Trie.build(key[firsts] >> np.uint64(32), key[firsts] & np.uint64(0xFFFFFFFF), log_p).save(folder)
            del key, count, before, single, order, pairs, log_p
            trie = Trie.load(folder)
            for chunk, shard, m, ids, own in zip(*(table.column(c).to_pylist() for c in ("chunk", "shard")), messages, *(table.column(c).to_pylist() for c in ("ids", "own")), strict=True):
                contexts, before, successors, words, _, word_count, n_spots, docs, times = unpack(m)
                value = trie.lookup(contexts.astype(np.int64), successors.astype(np.int64), words)
                unseen = np.repeat(np.log10(prior / (before + prior)), successors) + np.log10(word_count + 1.0) - spread
                value = np.where(np.isfinite(value), value, unseen)
                sums = np.bincount(docs, np.repeat(value, n_spots) * times) if len(docs) else np.zeros(0)
                out.append({"chunk": chunk, "shard": shard, "sums": pack(sums), "ids": ids, "own": own})
            del trie
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("sums", pa.binary()), ("ids", table.schema.field("ids").type), ("own", pa.binary())]))

    return asked.groupBy("shard").applyInArrow(run, f"chunk long, shard int, sums binary, ids {kind}, own binary")


def score_texts(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (doc_id, text, held); held rows are not trained on."""
    shards = max(1, -(-input_bytes(docs) // SHARD_BYTES))
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(chunked(docs, shards))
    replies = stored(count_words(rows, shards))
    known = replies.where("chunk = -1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    total = rows.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    chunks = rows.where("shard = -1").select("chunk", "ids", "body")
    asked = ask_pairs(chunks, replies.where("chunk >= 0").select("chunk", "reply"), shards)
    answered = answer_pairs(asked, total, known, prior)
    spread = float(np.log10(total + known + 1.0))

    def run(table: pa.Table) -> pa.Table:
        id_type = table.schema.field("ids").type.value_type
        schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "sums", "ids", "own")), strict=True), key=lambda r: r[0])
        ids, own = next((i, o) for _, _, i, o in parts if o is not None)
        held, lengths, seen, base = unpack(own)
        score = np.zeros(len(lengths))
        for _, sums, _, _ in parts:
            (s,) = unpack(sums)
            score[: len(s)] += s
        arrays = [pa.array(ids, id_type), pa.array(held.astype(bool)), pa.array(lengths.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(base - lengths * spread), pa.array(score)]
        return pa.Table.from_arrays(arrays, schema=schema)

    out = answered.groupBy("chunk").applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
