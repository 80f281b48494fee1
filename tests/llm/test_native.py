"""The four operators made of DataFrame functions only, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

from burrow.llm import chat, licenses, queries, secrets, sharding
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PLAIN = (("assign", ASSIGN, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def base_spans(text: str) -> list:
    spans = [(m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(PLAIN) for m in p.finditer(text) if len(m.group(g)) >= n]
    return sorted(spans)


def documents(spark, tables):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def test_secrets(spark, tables):
    want = Counter()
    for doc, text in documents(spark, tables):
        spans = base_spans(text)
        kinds = Counter(s[3] for s in spans)
        want[doc, kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))] += 1
    got = queries.op5_secret_scan(spark, tables).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    odd = {r.doc_id: r.spans for r in got}
    assert "markov:4:32" in odd[100009].split(",") and "markov" not in odd[100010]


def test_markov_tells_random_strings_from_identifiers(spark):
    llr = secrets.train(secrets.labelled_samples(spark, 4000))
    held = secrets.labelled_samples(spark, 2000, start=4000).select("random", (secrets.ratio(F.col("value"), llr) > 0.6).alias("hit"))
    rates = {r.random: r.rate for r in held.groupBy("random").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    assert rates[True] > 0.9 and rates[False] < 0.02


def plain_markov(text: str, llr: list[float], threshold: float = 0.6) -> list:
    """Runs of key characters that overlap no base span and whose mean log-likelihood ratio passes the threshold."""
    base, out = base_spans(text), []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        codes = [secrets.ALPHABET.index(c) for c in m.group()]
        mean = sum(llr[a * len(secrets.ALPHABET) + b] for a, b in zip(codes, codes[1:], strict=False)) / (len(codes) - 1)
        if mean >= threshold and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), "markov"))
    return out


def test_secret_spans_against_plain_python(spark, tables):
    llr = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice("abcdefXYZ0189+/_=-") for _ in range(rng.randint(5, 50)))
    glue = (" ", ".", " token=", '"secret": "', "\n", " AKIA", " é ", "password:")
    made = [(i, "".join(x for _ in range(rng.randint(0, 400)) for x in (piece(), rng.choice(glue)))) for i in range(40)]
    texts = made + [(1000 + i, t) for i, (_, t) in enumerate(documents(spark, tables))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(frame, llr).select("doc_id", secrets.digest(F.col("spans")).alias("spans")).collect()}
    for i, t in texts:
        want = sorted([*base_spans(t), *plain_markov(t, llr)])
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want), i
    assert sum("markov" in x for x in got.values()) > 20


def test_secrets_of_a_very_long_text(spark):
    run = "Zx9Kq3LmT7vBn2RwYp8H"
    text = " ".join(f"{run}{i:05}" if i % 5 else f"token={i:030x}{i:08}" for i in range(40_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    llr = secrets.train(secrets.labelled_samples(spark, 2000))
    begin = time.perf_counter()
    got = secrets.scan_secrets(frame, llr).select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).first()
    assert got.last.end == len(text) and got.n >= 40_000 - 8000
    assert time.perf_counter() - begin < 120


def test_markov_ratio_is_the_models_ratio(spark):
    rows = spark.createDataFrame([("aab", True), ("ba", False), (None, True), ("x", True)], "value string, random boolean")
    llr = secrets.train(rows)
    size = len(secrets.ALPHABET)
    assert len(llr) == size**2
    # a->a once and a->b once of random strings; b->a once of others
    import math

    assert abs(llr[0] - (math.log(2 / (size + 2)) - math.log(1 / size))) < 1e-12


def test_sharding(spark, tables):
    docs = documents(spark, tables)
    got = queries.op6_stratified_sharding(spark, tables).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sources = Counter(r.source for r in got)
    for source, n in sources.items():
        share = Counter(r.shard for r in got if r.source == source)
        assert all(abs(share[s] - n / 8) < 2 for s in range(8)), (source, share)


def test_sharding_order_against_plain_python(spark, tables):
    """The whole order, recomputed from the rows' hashes: ranks within sources, then fractional ranks, then equal cuts."""
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", name.alias("stratum"), (F.octet_length(text).cast("long") + 1).alias("size"), crc.alias("crc"), F.xxhash64(F.lit(42), "doc_id", crc).alias("h"), F.xxhash64(F.lit(42), name).alias("s")).collect()
    key = lambda x: (x is not None, x)
    held = defaultdict(list)
    for r in rows:
        held[tuple(r.stratum)].append(r)
    order = []
    for stratum, own in held.items():
        own.sort(key=lambda r: (r.h % 2**64, key(r.doc_id), r.crc, r["size"]))
        shift = (own[0].s % 1_000_003 + 0.5) / 1_000_003
        order += [((i + shift) / len(own), stratum, r.h, key(r.doc_id), r.crc) for i, r in enumerate(own)]
    order.sort()
    first = [-(-k * len(order) // 8) for k in range(9)]
    want = Counter((doc[1], crc, k, n - first[k]) for k in range(8) for n, (*_, doc, crc) in list(enumerate(order))[first[k] : first[k + 1]])
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in queries.op6_stratified_sharding(spark, tables).collect()) == want


def test_sharding_tells_a_null_source_from_any_name(spark):
    rows = [(i, "x", s) for i, s in enumerate([None, "\0null", "", None, "\0null", ""] * 4)]
    got = sharding.interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 4)
    assert sorted((r.doc_id, r.source) for r in got.collect()) == sorted((i, s) for i, _, s in rows)


def test_sharding_of_few_and_no_rows(spark, awkward):
    few = sharding.interleaved_shards(awkward.limit(3), 8)
    assert few.count() == 3
    assert sharding.interleaved_shards(awkward.limit(0), 8).count() == 0


def test_licenses(spark, tables):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = Counter()
    for doc, text in documents(spark, tables):
        words = word.findall(text.translate(LOW))
        at = sorted((i, label) for p, label in licenses.PHRASES for n in [len(p.split())] for i in range(len(words) - n + 1) if words[i : i + n] == p.split())
        want[doc, len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    got = queries.op7_license_scan(spark, tables).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def plain_found(words: list, k: int = 5, reach: int = 2, cover: float = 0.6) -> list:
    out = []
    for label, notice in licenses.TEMPLATES:
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", notice.translate(LOW))
        lines = defaultdict(list)
        for t in range(len(own) - k + 1):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[t : t + k]:
                    lines[i - t].append((i, t))
        islands = []
        for d in sorted(lines):
            if islands and d - islands[-1][0] <= reach:
                islands[-1] = (d, islands[-1][1] + lines[d])
            else:
                islands.append((d, lines[d]))
        for _, hits in islands:
            score = len({t + j for _, t in hits for j in range(k)}) / len(own)
            if score >= cover:
                out.append((label, score, min(i for i, _ in hits), max(i for i, _ in hits) + k - 1))
    return sorted(out)


def test_license_spans_against_plain_python(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += ["filler"] * rng.randint(0, 3)
            notice = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", rng.choice(licenses.TEMPLATES)[1].translate(LOW))
            for _ in range(rng.randint(0, 4)):
                notice.insert(rng.randrange(len(notice)), "odd")
            words += notice[rng.randint(0, 3) :]
        rows.append((i, " ".join(words)))
    got = {r.doc_id: sorted((s.label, s.score, s.first, s.last) for s in r.found) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_found(t.split()) for i, t in rows} and sum(map(len, got.values())) > 20


def test_licenses_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 1000}" for i in range(400_000)) + " released under the MIT license"
    frame = spark.createDataFrame([(1, text, 5, "x")], "doc_id long, text string, pos int, words string")
    begin = time.perf_counter()
    got = licenses.scan_licenses(frame).select("n_words", F.size("base").alias("n"), "found").first()
    assert (got.n_words, got.n) == (400_005, 1) and [f.label for f in got.found] == ["mit"]
    assert time.perf_counter() - begin < 120


def test_native_operators_on_no_rows_and_clashing_columns(spark, awkward):
    named = awkward.withColumnsRenamed({"key": "spans", "words": "runs"})
    llr = [0.0] * len(secrets.ALPHABET) ** 2
    assert secrets.scan_secrets(named, llr).count() == named.count()
    assert licenses.scan_licenses(awkward).count() == awkward.count()
    assert secrets.scan_secrets(named.limit(0), llr).count() == licenses.scan_licenses(awkward.limit(0)).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string, segments int")
    assert chat.format_conversations(empty).count() == 0


def test_license_diagonals_merge_over_an_edit(spark):
    notice = licenses.TEMPLATES[1][1].split()
    edited = " ".join([*"some words before".split(), *notice[:9], "really", *notice[9:], *"and after".split()])
    docs = spark.createDataFrame([(1, edited), (1, edited), (2, " ".join(notice[:8])), (3, None)], "doc_id long, text string")
    got = licenses.scan_licenses(docs).collect()
    hit = [r.found for r in got if r.doc_id == 1]
    assert len(got) == 4 and len(hit) == 2 and hit[0] == hit[1] and len(hit[0]) == 1
    assert (hit[0][0].label, hit[0][0].first, hit[0][0].last) == ("mit", 3, 3 + len(notice))
    assert [r.found for r in got if r.doc_id in (2, 3)] == [[], []]


def test_chat(spark, tables):
    rows = spark.read.parquet(f"{tables}/conversations.parquet").collect()
    said = "<|im_end|><|im_start|>assistant ok"
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn, r.role, r.text or ""))
    by[-1] = [(0, "user", said), (1, "assistant", said)]
    want = {}
    for conv, turns in by.items():
        turns.sort()
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        want[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(learnt), sha(learnt))
    got = {r.conv_id: r for r in queries.op9_chat_format(spark, tables).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    plain = 2 * len(said) + len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert got[-1].formatted_chars == plain + 4 and got[-1].valid


def test_chat_escapes_and_rules(spark):
    nasty = ["\\", "<|", "<\\|", "\\0", "\\1\n\\2", "<\\2", "a\nb", "", None, "<|im_start|>user\n"]
    rows = [(i, 0, "user", t) for i, t in enumerate(nasty)] + [(100, 1, "assistant", "x"), (100, 0, "user", "y"), (101, 0, "assistant", "z"), (102, None, None, None)]
    rows += [(103, 0, "ro\nle\\1", "q"), (104, 0, "user", "same"), (104, 0, "user", "same")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [got[i].turns[0].text for i in range(len(nasty))] == [t or "" for t in nasty]
    assert got[103].turns[0].role == "ro\nle\\1" and len(got[104].turns) == 2 and got[102].turns[0].role == ""
    assert got[100].valid and not got[101].valid and got[101].bad_turn == 0 and not got[104].valid
