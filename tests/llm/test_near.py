"""Fingerprints, links and components against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import xxhash
from burrow.llm import graph, queries, simhash
from hypothesis import given, settings
from hypothesis import strategies as st

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, width=3):
    words = (text or "").translate(LOW).encode().split()
    if not words:
        return 0
    rows = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    votes = [0] * 64
    for r in rows:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(rows))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(rows, distance=2):
    prints = sorted({p for _, p in rows})
    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= distance]
    top = roots(prints, links)
    least = defaultdict(list)
    for d, p in rows:
        if d is not None:
            least[top[p]].append(d)
    return Counter((d, f"{p:016x}", min(least[top[p]], default=None)) for d, p in rows)


def test_query(spark, tables):
    rows = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = queries.op10_simhash_links(spark, tables).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_components(rows)


def test_links_with_crowded_blocks(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = {0, 2**64 - 1}
    for b in base:
        for _ in range(60):
            p = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                p ^= 1 << int(bit)
            prints.add(p)
    prints |= {(base[0] & ~0x3FF) | i for i in range(1 << 10)}  # a ball that shares two blocks whole
    frame = spark.createDataFrame([(p - (1 << 64 if p >> 63 else 0),) for p in prints], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.close_pairs(frame, 2, limit=16).collect()]
    order = sorted(prints)
    want = roots(order, [(a, b) for i, a in enumerate(order) for b in order[:i] if (a ^ b).bit_count() <= 2])
    assert roots(order, links) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("a b c dé F g".split()), max_size=60), st.sampled_from([1, 3, 5]))
def test_fingerprint(words, width):
    text = " \n".join(words)
    assert int(simhash.fingerprint(text, width)[0]) == brute_print(text, width)


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i * i % 977}" for i in range(40_000))
    assert int(simhash.fingerprint(text, 3)[0]) == brute_print(text)


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(7, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for p in pairs for x in p})
    want = {n: r for n, r in roots(nodes, pairs).items() if n != r}
    assert {r.node: r.root for r in graph.components(frame).collect()} == want
    assert graph.components(frame.limit(0)).count() == 0


def edited(rng, words, share):
    words = list(words)
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_near_duplicates(spark):
    rng = np.random.default_rng(11)
    rows, groups = [], {}
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts = [" ".join(words)] + [edited(rng, words, 0.005) for _ in range(3 + 20 * (g == 0))] + [" ".join(words)]
        for t in texts:
            groups[len(rows)] = g
            rows.append((len(rows), t))
    for _ in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        groups[len(rows)] = len(rows) + 1000
        rows.append((len(rows), " ".join(words)))
        groups[len(rows)] = len(rows) + 1000
        rows.append((len(rows), edited(rng, words, 0.12)))  # similarity near 0.37
    rows += [(rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in rows], "doc_id long, text string, lang string, row string")
    kept = simhash.drop_near_duplicates(docs)
    got = kept.collect()
    assert kept.columns == docs.columns
    first = {}
    for i, _ in rows:
        first.setdefault(groups[i], i)
    assert sorted(r.doc_id for r in got) == sorted(first.values())


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = simhash.drop_near_duplicates(awkward).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 4, 5, 6, 7, 8, 9, 10, 12, None])
    assert simhash.drop_near_duplicates(awkward.limit(0)).count() == 0


def test_set_links():
    rng = np.random.default_rng(1)
    for _ in range(50):
        m = int(rng.integers(2, 40))
        base = [rng.choice(500, 40, replace=False) for _ in range(4)]
        sets = [np.unique(np.concatenate([base[i % 4][int(rng.integers(0, 9)) :], rng.integers(500, 600, 4)])).astype(np.uint64) for i in range(m)]
        tied = rng.integers(0, 5, m)
        pairs = [(i, j) for i in range(m) for j in range(i)]
        close = [(tied[i], tied[j]) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
        assert roots(range(5), simhash.set_links(tied, sets, 0.8)) == roots(range(5), close)


def test_near_duplicates_in_crowded_blocks(spark):
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(3):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows += [(len(rows) + i, edited(rng, words, 0.01)) for i in range(40)]
    assert len(set(found_roots(spark, [t for _, t in rows], group=2).values())) == 3


def jaccard(a, b, width=5):
    a, b = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def found_roots(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes, ties = simhash.near_duplicates(docs, **options)
    root = {r.node: r.root for r in ties.collect()}
    return {r.doc_id: root.get(r.n, r.n) for r in docs.select("doc_id", simhash.text_hash().alias("n")).collect()}


def partition(root):
    groups = defaultdict(set)
    for i, r in root.items():
        groups[r].add(i)
    return sorted(map(sorted, groups.values()))


def brute_partition(texts, similarity=0.8):
    close = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= similarity]
    return partition(roots(range(len(texts)), close))


def test_blocks_let_pairs_meet_at_every_size():
    blocks = simhash.blocks_needed(0.8)
    assert 1 - (1 - 0.8**simhash.VALUES) ** blocks >= simhash.FLOOR >= 0.99
    rng = np.random.default_rng(23)
    met = []
    for _ in range(400):
        h = rng.integers(0, 2**64, 180, dtype=np.uint64)  # 160 shared of 200: similarity 0.8, 180 in each
        a, b = h, np.concatenate([h[:160], rng.integers(0, 2**64, 20, dtype=np.uint64)])
        met.append((simhash.block_keys(a, blocks, simhash.VALUES, 42) == simhash.block_keys(b, blocks, simhash.VALUES, 42)).sum())
    assert min(met) > 0
    assert abs(np.mean(met) / blocks - 0.8**simhash.VALUES) < 0.03


def test_near_duplicates_count_shingles_once(spark):
    rng = np.random.default_rng(29)
    own = lambda n: " ".join(f"o{x}" for x in rng.integers(0, 1 << 30, n))
    line = own(60)
    repeated = [f"{own(100)} " + " ".join([line] * 20) for _ in range(2)]  # alike by repeats only
    text = own(50)
    same = [" ".join([line] * 2 + [text]), " ".join([line] * 20 + [text])]  # equal shingle sets
    texts = [*repeated, *same]
    assert jaccard(*repeated) < 0.5 and jaccard(*same) == 1
    assert partition(found_roots(spark, texts)) == brute_partition(texts) == [[0], [1], [2, 3]]


def test_near_duplicates_near_the_threshold(spark):
    rng = np.random.default_rng(31)
    texts = []
    for shared, first, second in [(4, 1, 0), (5, 1, 0), (6, 1, 0), (12, 3, 0), (11, 3, 0), (20, 2, 3), (28, 3, 4), (28, 4, 4), (44, 5, 6), (44, 6, 6), (90, 10, 12), (90, 11, 12)] * 3:
        words = [f"s{x}" for x in rng.integers(0, 1 << 30, shared + 4)]
        for more in (first, second):
            texts.append(" ".join([*words, *[f"e{x}" for x in rng.integers(0, 1 << 30, more)]]))
    assert any(0.75 <= jaccard(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert partition(found_roots(spark, texts)) == brute_partition(texts)


def test_family_is_compared_in_full(spark):
    rng = np.random.default_rng(37)
    base = [f"b{x}" for x in rng.integers(0, 1 << 30, 164)]
    family = [" ".join(base + [f"f{x}" for x in rng.integers(0, 1 << 30, 34)]) for _ in range(60)]  # about 0.7 to each other
    pairs = [" ".join(t.split()[:-8] + [f"n{i}x{k}" for k in range(8)]) for i, t in enumerate(family[:30])]  # 0.92 to their origins
    texts = [*family, *pairs]
    want = brute_partition(texts)
    assert len(want) == 60
    assert partition(found_roots(spark, texts, group=4)) == partition(found_roots(spark, texts)) == want
