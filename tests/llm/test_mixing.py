"""Rates against a dense solver, the classifier on held-out rows, and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from burrow.llm import mixing, queries
from burrow.llm.common import stored
from pyspark.sql import functions as F


def brute_rates(tokens, p, weights, most, steps=6000):
    """Plain projected gradient on the same objective."""
    total, target = tokens.sum(), np.array(weights)
    rate = np.ones(len(tokens))
    for _ in range(steps):
        residual = (rate * tokens) @ p / total - target
        rate = np.clip(rate - p @ residual, 0, most)
    return rate


def test_rates_match_targets(spark):
    rng = np.random.default_rng(2)
    tokens, p = rng.integers(0, 400, 500), rng.dirichlet([0.3, 0.2, 0.1], 500)
    frame = spark.createDataFrame([(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    for weights, most, reached in (([0.5, 0.3, 0.2], 4, True), ([0.9, 0.08, 0.02], 4, True), ([0.2, 0.3, 0.5], 4, True), ([0.02, 0.02, 0.96], 2, False)):
        steps = mixing.fit_rates(frame, weights, most)
        got = np.array([r.rate for r in frame.select("doc_id", mixing.rate_of(F.col("p"), steps, most).alias("rate")).orderBy("doc_id").collect()])
        share = (got * tokens) @ p / tokens.sum()
        want = (brute_rates(tokens, p, weights, most) * tokens) @ p / tokens.sum()
        assert (got >= 0).all() and (got <= most).all()
        assert np.linalg.norm(share - weights) <= np.linalg.norm(want - weights) + 2e-3, (weights, share, want)
        assert not reached or np.allclose(share, weights, atol=2e-3)


def test_rates_of_a_rare_domain_match_targets(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.dirichlet([30, 0.2, 0.1], 480), rng.dirichlet([0.1, 30, 0.1], 5), rng.dirichlet([0.1, 0.1, 30], 15)])
    frame = spark.createDataFrame([(100, [float(x) for x in q]) for q in p], "n_tokens long, p array<double>")
    names, weights = ["good", "poor", "toxic"], [0.75, 0.2, 0.05]
    assert 4 * p[:, 1].mean() < 0.2  # out of reach of four copies each
    steps = mixing.fit_rates(frame, weights)
    reached = mixing.reached_shares(frame, steps, names)
    assert np.allclose([reached[x] for x in names], weights, atol=2e-3), reached


def test_rates_of_no_tokens(spark):
    frame = spark.createDataFrame([(0, [0.5, 0.5])], "n_tokens long, p array<double>")
    assert mixing.fit_rates(frame, [0.5, 0.5]) == [] and mixing.fit_rates(frame.limit(0), [0.5, 0.5]) == []


def test_query(spark):
    src = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.domain for r in mixing.domains_of(spark.read.parquet(f"{src}/labels.parquet")).collect()}
    rows = queries.op3_soft_mixing(spark, src).collect()
    assert len(rows) == spark.read.parquet(f"{src}/documents.parquet").count()
    held = [(r.domain, marks[r.doc_id]) for r in rows if r.doc_id in marks and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.85, Counter(held)
    assert all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    total = sum(r.n_tokens for r in rows)
    for name, weight in queries.MIXTURE.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows) / total - weight) < 0.01
    assert abs(sum(r.copies * r.n_tokens for r in rows) / total - sum(r.rate * r.n_tokens for r in rows) / total) < 0.05


def test_mix_of_awkward_rows(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, domain string")
    mixed = mixing.mix(awkward, none, {"a": 0.5, "b": 0.5})
    assert mixed.columns == awkward.columns and mixed.count() == awkward.count()
    marked = spark.createDataFrame([(1, "a"), (5, "b"), (5, "a"), (6, None), (None, "b"), (7, "other")], "doc_id long, domain string")
    assert mixing.mix(awkward, marked, {"a": 0.4, "b": 0.6}).columns == awkward.columns
    assert mixing.mix(awkward.limit(0), marked, {"a": 0.4, "b": 0.6}).count() == 0


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tables))
        counts.append(docs.count())
        assert {r.doc_id for r in docs.collect()} <= ids, name
        if name != "shard":
            assert docs.columns == columns, name
    assert counts[0] >= counts[1] > counts[2] > counts[3] and counts[4] == counts[5]
    got = docs.groupBy("shard").count().collect()
    assert max(r["count"] for r in got) - min(r["count"] for r in got) <= 1


@pytest.mark.parametrize("rows", [0, 3])
def test_stages_on_no_rows_and_on_clashing_columns(spark, tables, rows):
    """Equal rows of clashing columns are near-duplicates of one another; no rows stay no rows."""
    text = "the reader of the old library found a quiet place by the window and read on until the evening came " * 3
    docs = spark.createDataFrame([(i, text, "en", "web", None, 1, "x") for i in range(rows)], "doc_id long, text string, lang string, source string, overlap string, row int, score string")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("simhash_near_dedup", "benchmark_decontamination", "shard") or not rows:
            out = stage(spark, docs, tables)
            assert out.count() == (0 if not rows else 1 if name == "simhash_near_dedup" else rows)
            assert name == "shard" or out.columns == docs.columns
