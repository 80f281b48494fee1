"""Top-k search, decontamination and the quality classifier against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from burrow.llm import decontaminate, quality, queries, topk
from hypothesis import given, settings
from hypothesis import strategies as st

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_top(rows, k=5):
    rows = [(i, [256 * Fraction(x) // 1 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, a) in enumerate(rows):
        if q % 50 == 0:
            fit = lambda s: max(min(s, 2**63 - 1), -(2**63))
            scores = sorted((-fit(sum(x * y for x, y in zip(a, b, strict=True))), i) for j, (i, b) in enumerate(rows) if j != at and len(b) == len(a))
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1))
    return out


def found(frame):
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_top_k_on_the_table(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    assert found(queries.op1_bitsliced_topk(spark, tables)) == brute_top(rows)


def test_top_k_of_awkward_vectors(spark):
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (1, [0.5, -0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (200, []), (50, [1.0, 1.0]), (7, [-1.0, -1.0]), (None, [1.0, 1.0]), (8, [0.1] * 3), (100, [0.0, 0.0])]
    # rows of one id: two alike, a rival of the same score, and one that quantises alike
    rows += [(150, [0.5, 0.25]), (150, [0.5, 0.25]), (150, [0.25, 0.5]), (150, [0.5, 0.2501])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert found(topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5)) == brute_top(rows)
    assert topk.top_k(frame.limit(0), frame, 5).count() == 0


def test_top_k_of_large_components(spark):
    sizes = [600000.0, 1e6, -1e6, 1e12, -1e12, 3e15, 1e30, -1e200, 1.5e308, 0.25]
    rows = [(i, [x, 1.0, -y]) for i, (x, y) in enumerate((x, y) for x in sizes for y in (1.0, -2.0, 1e12))]
    rows += [(100, [1.0, 1.0, 1.0]), (150, [float(2**22), 0.5, -0.5]), (151, [float(2**22 - 1), 0.5, -0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5)) == brute_top(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 5), st.integers(1, 7), st.integers(0, 2**32), st.sampled_from([1, 3, 300]))
def test_block_top_is_exact(rows, dim, k, seed, spread):
    rng = np.random.default_rng(seed)
    ids, matrix, query = rng.integers(0, 50, rows), rng.integers(-spread, spread + 1, (rows, dim)), rng.integers(-spread, spread + 1, dim)
    block = topk.build_block(ids, matrix)
    got_ids, got = topk.Block(block["ids"], block["low"], block["bits"], block["slices"]).top(query, k)
    want = sorted((-int(s), int(i)) for i, s in zip(ids, matrix @ query, strict=True))[:k]
    assert sorted((-int(s), int(i)) for i, s in zip(got_ids, got, strict=True)) == want


def brute_match(text, items):
    words = WORD.findall((text or "").translate(LOW))
    hit, names = set(), set()
    for name, item in items:
        own = WORD.findall((item or "").translate(LOW))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = Counter((r.doc_id, *brute_match(r.text, items)) for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    got = queries.op4_benchmark_decontamination(spark, tables).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert any(r.contaminated for r in got)


@pytest.mark.parametrize(("pack_words", "broadcast_words"), [(1 << 19, 1 << 24), (5, 60)])
def test_decontamination_of_awkward_items(spark, pack_words, broadcast_words):
    limits = {"pack_words": pack_words, "broadcast_words": broadcast_words}
    run = " ".join(f"w{i % 7}" for i in range(40))
    items = [(1, run), (2, "short one"), (3, "a"), (4, ""), (5, None), (6, "short one"), (None, "x y z"), (7, " ".join(f"w{i}" for i in range(13)))]
    texts = [(1, run), (1, run), (2, "a short one, A a"), (3, None), (4, "b " * 500), (5, f"{run} x y z {run[:60]} short"), (6, ""), (7, "short two a one"), (8, " ".join(f"w{i}" for i in range(12)))]
    docs = spark.createDataFrame([(i, t, "o") for i, t in texts], "doc_id long, text string, overlap string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.match_benchmark(docs, bench, matches=True, **limits).collect()
    named = [("" if i is None else i, t) for i, t in items]
    want = Counter((i, *brute_match(t, named)) for i, t in texts)
    flag = lambda o: o.n_hit > 0 and 20 * o.n_hit >= o.n_words
    assert Counter((r.doc_id, r.overlap.n_words, r.overlap.n_hit, len(r.overlap["items"]), hashlib.sha256(",".join(r.overlap["items"]).encode()).hexdigest(), flag(r.overlap)) for r in got) == want
    longest = max((m for r in got if r.doc_id == 1 for m in r.overlap.matches), key=lambda m: m.words)
    assert longest.words == (40 if pack_words > 40 else 17) and longest.item_word == longest.doc_word == 0
    assert decontaminate.match_benchmark(docs, bench.limit(0)).where("overlap.n_hit > 0").count() == 0
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 6, 8}


def test_decontamination_by_many_equal_items_and_a_long_one(spark):
    long = [f"l{i}" for i in range(60_000)]
    items = [(f"s{i:03}", "word") for i in range(500)] + [("long", " ".join(long))]
    texts = [(1, "word " * 1000), (2, " ".join(long[777:800])), (3, " ".join(long[31_990:32_010]) + " x" * 30), (4, " ".join(long[5:17]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.overlap for r in decontaminate.match_benchmark(docs, spark.createDataFrame(items, "item_id string, text string"), pack_words=32_000).collect()}
    assert (got[1].n_hit, len(got[1]["items"]), got[1].matches) == (1000, 500, [])
    assert [got[i].n_hit for i in (2, 3, 4)] == [23, 20, 0] and got[2]["items"] == got[3]["items"] == ["long"]


def test_quality(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = queries.op8_quality_trees(spark, tables).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 if r.doc_id is not None else False) for r in got)
    assert docs


def test_quality_scores_against_a_walk_of_the_trees(spark, tables):
    """Every row's score of the query, by plain recursion through the trees over the text's statistics."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    forest = quality.fit(docs, queries.training_labels(spark, tables))
    inner = forest.feature.shape[1]

    def walk(x, t, node=0):
        if node >= inner:
            return forest.leaf[t, node - inner]
        return walk(x, t, 2 * node + 1 + int(x[forest.feature[t, node]] > forest.threshold[t, node]))

    score = lambda text: 1 / (1 + np.exp(-(forest.base + sum(walk(quality.statistics(text), t) for t in range(len(forest.leaf))))))
    key = lambda pairs: sorted(((i is not None, i, round(float(s), 9)) for i, s in pairs), key=str)
    assert key((r.doc_id, r.score) for r in queries.op8_quality_trees(spark, tables).collect()) == key((r.doc_id, score(r.text)) for r in docs.collect())


def test_quality_on_held_out_rows(spark):
    src = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{src}/labels.parquet").collect()}
    held = [(r.score, marks[r.doc_id]) for r in queries.op8_quality_trees(spark, src).collect() if r.held_out and r.doc_id in marks]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    area = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert area > 0.9, area


def test_flattened_trees_match_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x, y, trees=30, least=1.0)

    def walk(row, t, node=0):
        inner = forest.feature.shape[1]
        if node >= inner:
            return forest.leaf[t, node - inner]
        return walk(row, t, 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node]))

    want = [forest.base + sum(walk(row, t) for t in range(30)) for row in x[:50]]
    assert np.allclose(want, forest.raw(x[:50])) and ((forest.score(x) > 0.5) == y).mean() > 0.95
    assert len(quality.grow(x, np.ones(400)).score(x)) == 400 and len(forest.score(x[:0])) == 0
