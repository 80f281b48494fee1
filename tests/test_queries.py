"""Every registered query with an SQL twin against DuckDB, and golden facts of a small nested fixture."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from burrow import queries
from burrow.operators import dataset, histogram, index, intervals, paths, requests
from burrow.operators.dataset import Dataset
from burrow.operators.index import Predicate
from burrow.plans import chunks, control
from burrow.sources import files, inputs, tables
from burrow.sources.catalog import Catalog
from burrow.streaming.incremental import index_stream
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def fixture(spark):
    nan = float("nan")
    rows = [
        (0, 0, 100, [5.0, 12.0, 7.0, 18.0], [[[1.5, 2.5], [3.5]]], {0.75: 100.5, 0.25: 100.0}, [0.0, 1.0, 2.0]),
        (0, 1, 101, [], [], {1.25: 101.0, 1.75: 101.5}, [10.0, 11.0, 12.0]),
        (0, 2, 102, [11.0], None, {}, [20.0, 21.0, 22.0]),
        (1, 0, 200, [9.0, 20.0], [], None, []),
        (1, 1, 201, [10.0, 10.5], [], None, []),
        (2, 0, 300, [nan, 0.1], [], None, []),
    ]
    return spark.createDataFrame(rows, "source_id long, entry_id long, run int, u array<float>, pairs array<array<array<double>>>, score map<double,double>, vertex array<float>")


def test_golden_paths(fixture):
    a = fixture.where("source_id = 0")
    got = paths.read_path(a, "Small/u/value/").agg(F.count("*"), F.sum("u"), F.sum("entry_id"), F.sum("u_idx")).first()
    assert tuple(got) == (5, 53.0, 2, 6)
    assert paths.read_path(a, "/Small/vertex/value").agg(F.count("*"), F.sum("vertex")).first()[:] == (9, 99.0)
    keys = paths.read_path(a, "/Small/score/key").orderBy("entry_id", "score_idx").collect()
    assert [(r.entry_id, r.score_idx, r.key) for r in keys] == [(0, 0, 0.25), (0, 1, 0.75), (1, 0, 1.25), (1, 1, 1.75)]
    deep = paths.read_path(a, "/Small/pairs/value/value/value")
    assert deep.columns == ["entry_id", "pairs_dim0_idx", "pairs_dim1_idx", "pairs_dim2_idx", "pairs"] and deep.count() == 3
    assert paths.read_path(a, "/Small/none/value").count() == 0


@pytest.mark.parametrize("predicate", [Predicate(">", (10.0,)), Predicate("<", (8.0,)), Predicate("=", (0.1,)), Predicate("between", (11.0, 7.0)), Predicate("in", (12345.0, 18.0)), Predicate("isnull"), Predicate(">=", (20.0,)), Predicate("<>", (5.0,)), Predicate("=", (math.nan,))])
@pytest.mark.parametrize("bloom", [False, True])
def test_pruned_scan_equals_full_scan(fixture, predicate, bloom):
    flat = paths.read_path(fixture, "/Small/u/value", carry=("source_id",)).withColumn("u", F.col("u").cast("double"))
    got = index.read_dataset(flat, "u", index.build_baskets(flat, "u", 1, bloom=bloom), predicate, 1)
    want = flat.where(predicate.exact(F.col("u")))
    rows = lambda df: sorted(map(str, df.select("source_id", "entry_id", "u_idx", "u").collect()))
    assert rows(got) == rows(want)


def test_infinities_survive_pruning(spark):
    flat = spark.createDataFrame([(0, 0, float("inf")), (0, 1, float("-inf")), (0, 2, 1.0), (0, 3, None)], "source_id long, entry_id long, v double")
    baskets = index.build_baskets(flat, "v", 1)
    for p, n in ((Predicate(">", (5.0,)), 1), (Predicate("<", (0.0,)), 1), (Predicate("isnull"), 1), (Predicate("=", (float("inf"),)), 1)):
        assert index.read_dataset(flat, "v", baskets, p, 1).count() == n


def test_index_of_texts_large_entries_and_nan_bounds(spark):
    texts = spark.createDataFrame([(0, 0, "b"), (0, 1, None), (0, 150, "c"), (0, 151, "")], "source_id long, entry_id long, v string")
    baskets = index.build_baskets(texts, "v", 100, bloom=True)
    assert sorted((r.basket_id, r.null_count, r.min_value, r.max_value) for r in baskets.collect()) == [(0, 1, "b", "b"), (1, 0, "", "c")]
    assert [r.v for r in index.read_dataset(texts, "v", baskets, Predicate("=", ("c",)), 100).collect()] == ["c"]
    far = spark.createDataFrame([(0, 2**53 + 1, 1), (0, 2**53 + 3, 2)], "source_id long, entry_id long, v int")
    assert sorted((r.basket_id, r.entry_begin, r.entry_end) for r in index.build_baskets(far, "v", 1).collect()) == [(2**53 + k, 2**53 + k, 2**53 + k + 1) for k in (1, 3)]
    nan = math.nan
    flat = spark.createDataFrame([(0, 0, 1.0), (0, 1, nan), (0, 2, -1.0)], "source_id long, entry_id long, v double")
    for bounds in ((0.0, nan), (nan, 0.0)):
        assert index.read_dataset(flat, "v", index.build_baskets(flat, "v", 1), Predicate("between", bounds), 1).count() == 2


def test_bloom_sets_grow_with_their_baskets(spark):
    flat = spark.range(30_000).selectExpr("0L source_id", "id entry_id", "cast(id * 2 as double) v")
    (row,) = index.build_baskets(flat, "v", 1 << 20, bloom=True).collect()
    assert row.bloom_bits > 9 * 30_000 and 4 <= row.bloom_hashes <= 8 and len(row.bloom) < 0.6 * row.bloom_bits
    one = spark.createDataFrame([row.asDict()], index.build_baskets(flat, "v", 1 << 20, bloom=True).schema)
    hits = sum(one.where(Predicate("=", (float(x),)).bloom_match("double")).count() for x in range(1, 60, 2))
    assert hits <= 4 and all(one.where(Predicate("=", (float(x),)).bloom_match("double")).count() for x in (0, 2, 59_998))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = spark.range(1000).selectExpr("id % 2 source_id", "id div 2 entry_id", "transform(sequence(0, cast(id % 3 as int)), i -> struct(cast(id + i as double) x, concat('t', id % 7) name)) hits", "id * 10 total")
    held = Dataset(spark, str(tmp_path_factory.mktemp("set"))).write(rows, 100)
    held.build(["/E/hits/x", "/E/hits/name", "/E/total"], 100, 20)
    return held, rows


@pytest.mark.parametrize("request_", ['{"op": ">", "value": 990}', '{"or": [{"op": "lt", "value": 5}, {"op": "between", "values": [503, 500]}]}', '{"and": [{"op": "ge", "value": 100}, {"op": "in", "values": [7, 120, 121]}]}', '{"op": "<>", "value": 3}', '{"op": "=", "value": 77777}'])
@pytest.mark.parametrize("sources", [None, [1]])
def test_stored_scans_equal_full_scans(spark, small, request_, sources):
    held, rows = small
    predicate = requests.value_predicate(request_)
    got, report = held.scan("/E/hits/x", predicate, sources=sources)
    want = paths.read_path(rows, "/E/hits/x", carry=("source_id",)).where(predicate.exact(F.col("x")))
    want = want if sources is None else want.where(F.col("source_id").isin(sources))
    key = lambda df: sorted(tuple(r) for r in df.select("source_id", "entry_id", "hits_idx", "x").collect())
    assert key(got) == key(want)
    assert report.files_total == 10 and report.baskets_total == 50
    assert sum("/data/" in f for f in got.inputFiles()) == report.files_read
    if request_ == '{"op": ">", "value": 990}':
        assert report.files_read <= 2 and report.baskets_read <= 2 and report.bytes_read < report.bytes_total


def test_stored_scans_with_other_paths_and_selections(spark, small):
    held, rows = small
    asked = requests.path_predicates('[{"path": "/E/total", "op": "lt", "value": 900}, {"path": "/E/hits/name", "op": "eq", "value": "t3", "quantifier": "all"}]')
    got, report = held.scan("/E/hits/x", path_predicates=asked)
    want = paths.read_path(rows.where("total < 900 and forall(hits, h -> h.name = 't3')"), "/E/hits/x", carry=("source_id",))
    key = lambda df: sorted(tuple(r) for r in df.select("source_id", "entry_id", "hits_idx", "x").collect())
    assert key(got) == key(want) and report.files_read == 2
    wanted = requests.entry_selection(spark, {"0": {"ranges": [[10, 12]], "entries_delta": {"base": 40, "deltas": [1, 400]}}})
    got, report = held.scan("/E/hits/x", selection=wanted)
    assert sorted({r.entry_id for r in got.collect()}) == [10, 11, 40, 41, 441] and report.files_read == 2 and report.baskets_read == 3
    assert held.scan("/E/hits/x", selection=requests.entry_selection(spark, {}))[0].count() == 0
    assert held.scan("/E/hits/x", Predicate("isnull"))[0].count() == 0
    stats = held.stats("/E/total").first()
    assert (stats.row_count, stats.min_value, stats.max_value) == (1000, 0, 9990)


@pytest.mark.parametrize(
    ("request_", "span"),
    [
        ('{"op": "=", "value": 7}', (7, 7)),
        ('{"op": ">", "value": 980}', (981, requests.EVERY[1])),
        ('{"op": "<", "value": 0}', requests.NO_ENTRY),
        ('{"op": "in", "values": [30, 4, -9]}', (0, 30)),
        ('{"op": "between", "values": [20, 10]}', (10, 20)),
        ('{"op": "<>", "value": 3}', requests.EVERY),
        ('{"and": [{"op": ">=", "value": 10}, {"op": "<", "value": 10}]}', requests.NO_ENTRY),
        ('{"and": [{"op": ">", "value": 95}, {"or": [{"op": "=", "value": 5}, {"op": "<=", "value": 130}]}]}', (96, 130)),
        ('{"or": [{"op": "<", "value": 0}, {"op": "between", "values": [200, 210]}, {"op": "=", "value": 480}]}', (200, 480)),
    ],
)
def test_entry_ranges_prune_and_stay_exact(small, request_, span):
    held, rows = small
    asked = requests.value_predicate(request_)
    assert requests.entry_range(asked) == span
    got, report = held.scan("/E/hits/x", entries=asked)
    want = paths.read_path(rows.where(asked.exact(F.col("entry_id"))), "/E/hits/x", carry=("source_id",))
    key = lambda df: sorted(tuple(r) for r in df.select("source_id", "entry_id", "hits_idx", "x").collect())
    assert key(got) == key(want)
    low, high = span
    overlapping = held.baskets("/E/hits/x").where((F.col("entry_begin") <= high) & (F.col("entry_end") > low)).count() if low <= high else 0
    assert report.baskets_read == overlapping


@pytest.mark.parametrize("bad", [2.5, "a", True])
def test_entries_are_compared_with_whole_numbers(small, bad):
    with pytest.raises(TypeError):
        small[0].scan("/E/hits/x", entries=Predicate("=", (bad,)))


def test_scans_beyond_the_named_files(small, monkeypatch):
    held, _ = small
    key = lambda df: sorted(tuple(r) for r in df.select("source_id", "entry_id", "hits_idx", "x").collect())
    named, report = held.scan("/E/hits/x", Predicate(">", (300,)))
    monkeypatch.setattr(dataset, "MOST_FILES", 1)
    joined, again = held.scan("/E/hits/x", Predicate(">", (300,)))
    assert key(joined) == key(named) and again == report


def test_stats_read_no_data_file(small):
    held, _ = small
    assert all("/index/" in f for f in held.stats("/E/hits/x").inputFiles())


def test_changed_files_are_noticed(spark, tmp_path):
    held = Dataset(spark, str(tmp_path / "d")).write(spark.range(50).selectExpr("0L source_id", "id entry_id", "id v"), 100)
    first = held.build(["/E/v"], 100, 10)
    held.check_fresh()
    assert held.build(["/E/v"], 100, 10) == first
    spark.range(3).selectExpr("id entry_id", "id v").write.mode("append").parquet(str(tmp_path / "d" / "data" / "source_id=0" / "part=7"))
    with pytest.raises(RuntimeError, match="changed"):
        held.check_fresh()


@pytest.mark.parametrize(("bad", "error"), [('[{"path": "/E/hits/x", "op": "like", "value": 1}]', ValueError), ('[{"path": "/E/hits/x", "op": "between", "values": [1]}]', ValueError), ('[{"op": "=", "value": 1}]', ValueError), ('[{"path": "/E/hits/x", "op": "=", "value": "a"}]', TypeError), ('[{"path": "/E/hits/name", "op": "=", "value": 1}]', TypeError), ('[{"path": "/E/hits/x", "op": "=", "value": null}]', ValueError), ('[{"path": "/E/hits/x", "op": "=", "value": 1, "quantifier": "most"}]', ValueError)])
def test_bad_requests(small, bad, error):
    with pytest.raises(error):
        small[0].scan("/E/total", path_predicates=requests.path_predicates(bad))


def test_one_writer_claims_a_fingerprint(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "store"))
    assert store.claim("x") and not store.claim("x")
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish({"t": spark.range(2)}, "x")
    assert store.latest() is None


def test_intervals(spark):
    rows = spark.createDataFrame([(0, 1, 3), (0, 3, 5), (0, 9, 9), (0, 7, 8), (1, 0, 2)], "source_id long, begin long, end long")
    merged = sorted(tuple(r) for r in intervals.merge(rows).select("source_id", "begin", "end").collect())
    assert merged == [(0, 1, 5), (0, 7, 8), (1, 0, 2)]
    entries = spark.range(0, 3000).select(F.lit(0).cast("long").alias("source_id"), F.col("id").alias("entry_id"))
    wide = spark.createDataFrame([(0, 1000, 2050), (0, 5, 6)], "source_id long, begin long, end long")
    assert intervals.select(entries, wide).count() == 1051


@pytest.mark.parametrize("cell", [1, 7, 1 << 16])
def test_intervals_over_many_cells(spark, cell):
    """Islands that go on over cells, repeated and empty intervals, against plain Python."""
    rng = random.Random(cell)
    sets = []
    for _ in range(2):
        raw = [(s, b, b + rng.choice([0, 1, 2, 3, 40])) for s in (0, 1) for b in (rng.randrange(400) for _ in range(60))]
        sets.append(raw + raw[:9])
    frames = [spark.createDataFrame(x, "source_id long, begin long, end long") for x in sets]
    held = [{(s, e) for s, b, end in x for e in range(b, end)} for x in sets]

    def runs(points):
        return sorted((s, e, next(n for n in range(e, 1000) if (s, n) not in points)) for s, e in points if (s, e - 1) not in points)

    rows = lambda df: sorted(tuple(r) for r in df.select("source_id", "begin", "end").collect())
    merged = [intervals.merge(f, cell=cell) for f in frames]
    assert [rows(m) for m in merged] == [runs(h) for h in held]
    both = intervals.intersect(*merged, cell=cell)
    assert {(s, e) for s, b, end in rows(both) for e in range(b, end)} == held[0] & held[1]
    assert len(rows(both)) == sum(max(a[1], b[1]) < min(a[2], b[2]) for a in runs(held[0]) for b in runs(held[1]) if a[0] == b[0])
    entries = spark.createDataFrame([*held[0], (1, 0)], "source_id long, entry_id long")
    kept = held[0] | {(1, 0)}
    assert rows(intervals.encode(entries, cell=cell)) == runs(kept)
    for r in intervals.selection(entries, min_run=5, cell=cell).collect():
        alone, at = [], r.base
        for step in [0, *r.deltas] if r.base is not None else []:
            at += step
            alone.append(at)
        assert all(e - b >= 5 for b, e in r.ranges)
        assert sorted(alone + [x for b, e in r.ranges for x in range(b, e)]) == sorted(e for s, e in kept if s == r.source_id)
    assert rows(intervals.merge(frames[0].where("false"), cell=cell)) == []


@pytest.fixture
def odd_lines(tmp_path):
    """Lines without a supplier, part or quantity, and quantities between whole numbers; no two spans of a source are alike, as the SQL leaves their order open."""
    con = duckdb.connect()
    lines = [(None, 98, 5.0), (None, 102, 4.0), (None, 300, 2.0), (1, 98, 2.5), (1, 100, 3.5), (1, 210, 6.7), (1, 218, 8.5), (1, 400, 0.5), (2, None, 3.0), (2, 5, None), (3, -7, 4.0)]
    con.sql("create table lineitem (l_suppkey bigint, l_partkey bigint, l_quantity double)")
    con.executemany("insert into lineitem values (?, ?, ?)", lines)
    con.sql(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    return str(tmp_path), con


def test_merge_of_odd_lines(spark, odd_lines):
    folder, con = odd_lines
    got = {tuple(r) for r in queries.QUERIES["interval_merge"](spark, folder).collect()}
    assert got == set(con.sql(queries.ORACLE_SQL["interval_merge"]).fetchall())
    assert got == {(None, 98, 106), (None, 300, 302), (1, 98, 104), (1, 210, 217), (1, 218, 226), (3, -7, -3)}


@pytest.mark.parametrize("cell", [1, 7, 1 << 16])
def test_merge_without_a_source(spark, cell):
    rows = spark.createDataFrame([(None, 1, 3), (None, 3, 50), (None, 20, 30), (None, 60, 61), (0, 2, 4), (None, None, 9), (None, 9, None)], "source_id long, begin long, end long")
    merged = [tuple(r) for r in intervals.merge(rows, cell=cell).select("source_id", "begin", "end").collect()]
    assert sorted(merged, key=str) == [(0, 2, 4), (None, 1, 50), (None, 60, 61)]


def test_intersect_of_odd_lines(spark, odd_lines):
    folder, con = odd_lines
    got = {tuple(r) for r in queries.QUERIES["interval_intersect"](spark, folder).collect()}
    assert got == set(con.sql(queries.ORACLE_SQL["interval_intersect"]).fetchall())
    assert got == {(None, 100, 106), (1, 100, 104), (1, 210, 217), (1, 218, 220)}


@pytest.mark.parametrize("cell", [1, 7, 1 << 16])
def test_intersect_without_a_source(spark, cell):
    shape = "source_id long, begin long, end long"
    a = spark.createDataFrame([(None, 1, 50), (None, 60, 61), (0, 2, 4), (2, 5, 9)], shape)
    b = spark.createDataFrame([(None, 20, 30), (None, 40, 70), (0, 3, 9), (1, 1, 90)], shape)
    both = [tuple(r) for r in intervals.intersect(a, b, cell=cell).select("source_id", "begin", "end").collect()]
    assert sorted(both, key=str) == [(0, 3, 4), (None, 20, 30), (None, 40, 50), (None, 60, 61)]


def test_event_bases_over_groups(spark):
    files = spark.createDataFrame([(s, s + 1) for s in range(10)], "source_id long, total_entries long")
    got = {r.source_id: r.event_base for r in index.event_bases(files, group=3).collect()}
    assert got == {s: s * (s + 1) // 2 for s in range(10)}


def test_inputs(tmp_path):
    for n in ("b.parquet", "a.parquet", "c.txt.parquet"):
        (tmp_path / n).write_text("")
    (tmp_path / "in.list").write_text(f"# note\n{tmp_path}/b.parquet\n\n{tmp_path}/*.parquet\n")
    assert [p.rsplit("/", 1)[1] for p in inputs.resolve(f"@{tmp_path}/in.list")] == ["b.parquet", "a.parquet", "c.txt.parquet"]
    assert inputs.resolve('["x", "y,x"]') == ["x", "y"] and len(inputs.resolve(str(tmp_path))) == 3
    with pytest.raises(FileNotFoundError):
        inputs.resolve(f"{tmp_path}/*.none")


def test_catalog_and_stream(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "store"))
    one = store.publish({"t": spark.range(3)}, "a")
    assert store.publish({"t": spark.range(9)}, "a") == one
    two = store.publish({"t": spark.range(5)}, "b")
    assert store.read("t").count() == 5 and store.read("t", one).count() == 3
    assert {r.snapshot_id: r.parent_snapshot_id for r in store.commits().collect()} == {one: None, two: one}
    with pytest.raises(ValueError, match="committed"):
        store.latest("missing")
    spark.range(250).selectExpr("0L as source_id", "id as entry_id", "cast(id as double) v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id long, entry_id long, v double").parquet(str(tmp_path / "in"))
    log = Catalog(spark, str(tmp_path / "log"))
    index_stream(stream, "v", 100, log, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert log.read("baskets").agg(F.sum("value_count")).first()[0] == 250


def test_chunks():
    planned = chunks.plan([("a", 5), ("b", 5), ("c", 50), ("d", 1)], max_files=2, max_bytes=12)
    assert [c["files"] for c in planned] == [["a", "b"], ["c"], ["d"]]
    assert planned == chunks.plan([("a", 5), ("b", 5), ("c", 50), ("d", 1)], max_files=2, max_bytes=12)


def test_histogram_views(spark):
    nan, inf = math.nan, math.inf
    rows = spark.createDataFrame([(1.0, 2.0, 1.0), (1.5, 4.0, 3.0), (9.0, 5.0, 1.0), (nan, 1.0, 1.0), (inf, 1.0, 1.0), (-inf, 1.0, 2.0), (None, 1.0, 1.0), (2.0, None, 1.0)], "x double, y double, w double")
    axis = histogram.Axis("x", edges=(0.0, 2.0, 3.0), labels=("a",))
    h = histogram.Histogram("/h/x", (axis,), weight="w")
    p = {o: histogram.Histogram(f"/h/p{o}", (axis,), profile="y", error_option=o) for o in histogram.PROFILE_ERRORS}
    known = [h, *p.values(), histogram.Histogram("/h/x/meta", (histogram.Axis("x", 2, 0.0, 3.0),))]
    bins = histogram.read([rows], "h/x", known).orderBy("global_bin").collect()
    assert [(r.content, r.x_low, r.x_width, r.x_label) for r in bins] == [(2.0, -1.5, 2.0, None), (4.0, 0.0, 2.0, "a"), (1.0, 2.0, 1.0, None), (3.0, 3.0, 1.0, None)]
    assert bins[1].error == bins[1].error_low == math.sqrt(10) and bins[0].entries == 7 and (bins[0].x_underflow, bins[0].x_overflow) == (2.0, 3.0)
    assert len(bins[0]) == 44
    assert histogram.read([rows], "/h/x/meta", known).columns[5] == "global_bin"  # an exact name goes before a suffix
    assert len(histogram.read([rows], "/h/x/axes", known).columns) == 27
    meta = histogram.meta_view(rows, h).first()
    assert len(meta) == 58 and meta.maximum == 4.0 and meta.minimum == 1.0 and abs(meta.mean_x - (1.0 + 1.5 * 3 + 2.0) / 5) < 1e-12
    error = {o: histogram.bins_view(rows, q).where("x_bin = 1").first() for o, q in p.items()}
    assert all(r.content == 3.0 and r.profile_entries == 2.0 for r in error.values())
    assert [round(error[o].error, 9) for o in ("", "s", "i", "g")] == [round(1 / math.sqrt(2), 9), 1.0, round(1 / math.sqrt(2), 9), round(1 / math.sqrt(2), 9)]
    assert histogram.meta_view(rows.where("false"), h).first().mean_x == 0.0
    for bad in ({"inputs": [rows, rows], "path": "/h/x"}, {"inputs": [rows], "path": "/h/none"}, {"inputs": [rows], "path": "/h/x/other"}):
        with pytest.raises((ValueError, KeyError)):
            histogram.read(**bad, known=known)
    for bad in ({"edges": (1.0, 1.0)}, {"bins": 0, "low": 0.0, "high": 1.0}):
        with pytest.raises(ValueError):
            histogram.Axis("x", **bad)


def test_paths_side_by_side(spark):
    rows = spark.createDataFrame([(0, [1, 2], [5], [[1, 2], [3]], [[7]], 9), (1, None, [1], [], [[2, 3], None, [4]], 8), (2, [], None, None, None, None)], "entry_id long, a array<int>, b array<int>, m array<array<int>>, n array<array<int>>, s int")
    out = paths.read_paths(rows, ["/X/a", "X/a/value", "/X/b", "/X/m", "/X/n", "/X/s"])
    assert sorted(out) == [(), ("a_idx",), ("b_idx",), ("m_dim0_idx", "m_dim1_idx"), ("n_dim0_idx", "n_dim1_idx")]
    one = paths.read_path(rows, "/X/m")
    assert sorted(out[("m_dim0_idx", "m_dim1_idx")].collect()) == sorted(one.collect())
    nested = rows.selectExpr("entry_id", "transform(n, x -> struct(x as xs, size(x) as k)) as p")
    two = paths.read_paths(nested, ["/X/p/xs", "/X/p/k"])
    assert sorted(len(f.columns) for f in two.values()) == [3, 4]
    with pytest.raises(ValueError, match="no values"):
        paths.read_paths(rows, ["/X/none"])


def test_files_and_csv(spark, tmp_path):
    spark.range(5).selectExpr("id v").coalesce(1).write.parquet(str(tmp_path / "a b+c%"))
    spark.range(3).selectExpr("id v", "'x' t").coalesce(1).write.parquet(str(tmp_path / "two"))
    got, missing = files.read(spark, f"{tmp_path}/a b+c%,{tmp_path}/two,{tmp_path}/none.parquet", union_by_name=True)
    assert sorted((r.source_id, r.entry_id, r.t) for r in got.collect()) == [(0, n, None) for n in range(5)] + [(1, n, "x") for n in range(3)]
    assert [m.rsplit("/", 1)[1] for m in missing] == ["none.parquet"]
    with pytest.raises(FileNotFoundError):
        files.read(spark, f"{tmp_path}/none.parquet")
    rows = [(1, 'a,"b'), (2, None), (3, ""), (4, "two\nlines"), (5, " sp ")]
    files.write_csv(spark.createDataFrame(rows, "k int, t string"), str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), schema="k int, t string").collect())) == rows
    assert dict(files.read_csv(spark, str(tmp_path / "csv"), all_text=True).dtypes) == {"k": "string", "t": "string"}


def test_sql_tables(spark):
    store = tables.Tables(spark, "Unit_Store", 4)
    first = store.publish({"t": spark.range(3).selectExpr("id source_id", "id * 2 n")}, "a")
    assert store.publish({"t": spark.range(9).selectExpr("id source_id", "id n")}, "a") == first
    store.publish({"t": spark.range(2).selectExpr("id + 10 source_id", "'q' more")}, "b")
    assert sorted((r.source_id, r.n, r.more) for r in store.read("t").collect()) == [(0, 0, None), (1, 2, None), (2, 4, None), (10, None, "q"), (11, None, "q")]
    store.publish({"t": spark.range(1).selectExpr("id + 20 source_id", "id n")}, "c", "replace")
    assert [r.source_id for r in store.read("t").collect()] == [20]
    with pytest.raises(TypeError):
        store.insert("t", spark.range(1).selectExpr("'x' n"))
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("unit_store")]


def test_control_plane(spark, tmp_path):
    for name in ("b", "a"):
        spark.range(4).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    found = control.discover(spark, f"{tmp_path}/in/*")
    assert [f.path.split("/")[-2] for f in found.files] == ["a", "b"] and found == control.discover(spark, f"{tmp_path}/in/b,{tmp_path}/in/a")
    planned = control.plan(found, max_files=1, max_bytes=1 << 20)
    assert len(planned) == 2
    stores = {c["chunk_id"]: Catalog(spark, str(tmp_path / c["chunk_id"])) for c in planned}

    def build(source):
        def tables_of(_):
            return {
                "files": spark.createDataFrame([(source, 0, 5)], "source_id long, part long, entries long"),
                "schemas": spark.createDataFrame([("/X/v", "long", 10, 5)], "path string, type string, part_entries long, basket_entries long"),
                "access": spark.createDataFrame([("/X/v", 0)], "path string, step int"),
                "baskets": spark.createDataFrame([("/X/v", source, 0)], "path string, source_id long, basket_id long"),
            }

        return tables_of

    one, two = planned
    control.run(one, stores[one["chunk_id"]], build(1))
    target = Catalog(spark, str(tmp_path / "target"))
    with pytest.raises(ValueError, match="not committed"):
        control.merge(planned, stores, target)
    control.run(two, stores[two["chunk_id"]], build(1))
    assert any("repeats" in w for w in control.validate(planned, stores)) and any("2 chunks" in w for w in control.validate(planned, stores))
    stores[two["chunk_id"]] = Catalog(spark, str(tmp_path / "again"))
    control.run(two, stores[two["chunk_id"]], build(2))
    first = control.merge(planned, stores, target)
    assert sorted((r.source_id, r.event_base) for r in target.read("files").collect()) == [(1, 0), (2, 5)] and target.read("schemas").count() == 1
    control.merge(planned, stores, target)  # what is held is not added twice
    assert target.read("files").count() == 2
    with pytest.raises(ValueError, match="number of files"):
        control.compact(target, None)
    control.compact(target, 1)
    assert target.read("baskets").rdd.getNumPartitions() == 1 and target.read("files", first).count() == 2
    (tmp_path / "target" / "snapshots" / "left").mkdir()
    assert control.orphans(target) == [] and control.orphans(target, older_than_s=-5) == ["left"]
    assert control.orphans(target, older_than_s=-5, delete=True) == ["left"] and control.orphans(target, older_than_s=-5) == []


def test_budget():
    held = control.budget(memory_bytes=16 << 30, cores=4, input_bytes=100 << 40)
    assert int(held["spark.sql.files.maxPartitionBytes"]) * int(held["spark.sql.shuffle.partitions"]) >= 100 << 40
    for bad in ({"memory_bytes": 1 << 20}, {"cores": 0}, {"overhead": 1.0}):
        with pytest.raises(ValueError):
            control.budget(**({"memory_bytes": 16 << 30, "cores": 4, "input_bytes": 1} | bad))


def test_ranges(small):
    held, _ = small
    chosen = held.chosen("/E/total", requests.value_predicate('{"or": [{"op": "between", "values": [0, 500]}, {"op": "between", "values": [1100, 1200]}]}'))
    near = {tuple(r) for r in held.ranges(chosen, gap=100).collect()}
    far = {tuple(r) for r in held.ranges(chosen).collect()}
    assert sum(r[4] for r in near) == sum(r[4] for r in far) == chosen.count() and len(near) <= len(far)
