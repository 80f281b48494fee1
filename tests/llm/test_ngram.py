"""The Elias-Fano levels against plain arrays, and scores against a plain bigram model."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from burrow.llm import ngram, queries
from burrow.llm.elias_fano import EliasFano, Trie
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=200), st.integers(0, 40), st.integers(0, 2**32))
def test_elias_fano(gaps, factor, seed):
    values = np.cumsum(np.array(gaps, dtype=np.uint64) * np.uint64(factor))
    coded = EliasFano.build(values)
    assert (coded.get(np.arange(len(values))) == values).all()
    rng = np.random.default_rng(seed)
    n = len(values)
    x = np.concatenate([values, values + np.uint64(1), rng.integers(0, int(values[-1]) + 5 if n else 5, 50).astype(np.uint64)])
    begin = rng.integers(0, n + 1, len(x))
    end = np.array([rng.integers(b, n + 1) for b in begin])
    want = [next((i for i in range(b, e) if values[i] >= v), e) for v, b, e in zip(x, begin, end, strict=True)]
    assert coded.successor(x, begin, end).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 30), st.integers(0, 500)), st.floats(-6, 0), max_size=120))
def test_trie(tmp_path_factory, pairs):
    order = sorted(pairs)
    context, word, p = np.array([a for a, _ in order], np.uint64), np.array([b for _, b in order], np.uint64), np.array([pairs[k] for k in order])
    folder = tmp_path_factory.mktemp("trie")
    Trie.build(context, word, p).save(str(folder))
    trie = Trie.load(str(folder))
    asked = np.arange(32)
    words = np.tile(np.arange(0, 502), 32)
    got = trie.lookup(asked, np.full(32, 502), words).reshape(32, 502)
    step = (p.max() - p.min()) / 65535 if len(p) else 0
    for a in range(32):
        for b in range(502):
            assert abs(got[a, b] - pairs[a, b]) <= step / 2 + 1e-9 if (a, b) in pairs else got[a, b] == -np.inf


def test_messages():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 2**k, 50).astype(np.uint64) for k in (1, 9, 20, 40)] + [rng.normal(size=7), np.zeros(0, np.int64)]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, ngram.unpack(ngram.pack(*arrays)), strict=True))


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    return [*low.split(), " "]


def brute(rows, prior):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    single, pair = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = tokens(t)
            single.update(w)
            pair.update(zip([" ", *w[:-1]], w, strict=True))
    n, v = sum(single.values()), len(single)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((single[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((pair[h, x] + prior * (single[x] + 1) / (n + v + 1)) / (single[h] + prior)) for h, x in zip([" ", *w[:-1]], w, strict=True))
        out.append((i, held[i], len(w), sum(single[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize(("chunk", "shard"), [(4 << 20, 8 << 20), (20_000, 60_000)])
def test_scores(spark, tables, monkeypatch, chunk, shard):
    monkeypatch.setattr(ngram, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ngram, "SHARD_BYTES", shard)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    want = sorted(brute(rows, ngram.PRIOR), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in queries.op2_trie_scores(spark, tables).collect()), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert abs(a[5] - b[5]) < 1e-6 * abs(b[5]) and abs(a[6] - b[6]) < 1e-4 * abs(b[6]), (a, b)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_scores_of_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held boolean")
    got = ngram.score_texts(frame).collect()
    assert len(got) == 1 and got[0].n_known == 0 and got[0].train_tokens == 0
    assert ngram.score_texts(frame.limit(0)).count() == 0
