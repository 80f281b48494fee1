"""Registered queries over nested paths, with the DuckDB SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import histogram, index, intervals, paths, requests
from .operators.dataset import Dataset
from .operators.index import Predicate
from .plans import chunks, control, objects
from .sources import catalog, files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BASKET = 100

LINES = """(SELECT l_orderkey AS entry_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS lines_idx,
  l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS lines"""
BASKETS = f"""(SELECT event_id % 4 AS source_id, event_id // {BASKET} AS basket_id, count(*) AS value_count, count(*) FILTER (WHERE value IS NULL) AS null_count,
  min(value) AS min_value, max(value) AS max_value FROM events GROUP BY ALL) AS baskets"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


EVENT_PATHS = ["/Event/value", "/Event/event_type", "/Event/user_id"]
ORDER_PATHS = ["/Order/lines/quantity", "/Order/lines/discount", "/Order/lines/extendedprice"]
EVENT_PART, ORDER_PART, ORDER_BASKET = 5_000, 100_000, 1_000
_STORED: dict[tuple[str, str, str], Dataset] = {}


def stored_dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    """The events or the orders as a dataset of four sources, written and indexed at the first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        objects_of = {"events": objects.events, "orders": objects.orders}[name]
        made = Dataset(spark, catalog.scratch(spark))
        rows = objects_of(spark, sf_dir).withColumn("source_id", F.pmod("entry_id", F.lit(4)).cast("long"))
        made.write(rows, EVENT_PART if name == "events" else ORDER_PART)
        if name == "events":
            made.build(EVENT_PATHS, EVENT_PART, BASKET)
        else:
            made.build(ORDER_PATHS, ORDER_PART, ORDER_BASKET)
        _STORED[key] = made
    return _STORED[key]


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``/Event/value`` of the stored events, with its source."""
    return paths.read_path(stored_dataset(spark, sf_dir, "events").entries(), "/Event/value", carry=("source_id",))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_dataset(spark, sf_dir, "orders").entries()


def event_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_dataset(spark, sf_dir, "events").baskets("/Event/value")


def pruned(spark: SparkSession, sf_dir: str, predicate, **options) -> DataFrame:
    return stored_dataset(spark, sf_dir, "events").scan("/Event/value", predicate, **options)[0].select("source_id", "entry_id", "value")


@query("SELECT event_id AS entry_id, value FROM events")
def direct_scalar(spark, sf_dir):
    return paths.read_path(objects.events(spark, sf_dir), "/Event/value")


@query(f"SELECT entry_id, lines_idx, extendedprice FROM {LINES}")
def direct_nested(spark, sf_dir):
    return paths.read_path(order_rows(spark, sf_dir), "/Order/lines/extendedprice")


@query(f"SELECT entry_id, lines_idx, extendedprice FROM {LINES} WHERE extendedprice > 50000")
def direct_nested_filter(spark, sf_dir):
    return direct_nested(spark, sf_dir).where(F.col("extendedprice") > 50000)


@query("SELECT event_id AS entry_id, value FROM events WHERE event_id BETWEEN 250 AND 499")
def direct_event_range(spark, sf_dir):
    return direct_scalar(spark, sf_dir).where(F.col("entry_id").between(250, 499))


@query(f"SELECT entry_id, lines_idx, linenumber, partkey, suppkey, quantity, extendedprice, discount, tax FROM {LINES}")
def direct_container(spark, sf_dir):
    return paths.read_container(order_rows(spark, sf_dir), "/Order/lines")


@query("SELECT vec_id AS entry_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS embedding_idx, unnest(embedding) AS embedding FROM embeddings")
def direct_fixed_array(spark, sf_dir):
    return paths.read_path(objects.vectors(spark, sf_dir), "/Vec/embedding/value")


@query("SELECT entry_id, CAST(i // 8 AS INTEGER) AS matrix_dim0_idx, CAST(i % 8 AS INTEGER) AS matrix_dim1_idx, v AS matrix FROM (SELECT vec_id AS entry_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS v FROM embeddings)")
def direct_multidim(spark, sf_dir):
    return paths.read_path(objects.vectors(spark, sf_dir), "/Vec/matrix/value")


MAP = "(SELECT event_id AS entry_id, unnest(list_sort(json_keys(props))) AS k, props FROM events WHERE props IS NOT NULL) AS m"


@query(f"SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY k) - 1 AS INTEGER) AS props_idx, k AS key FROM {MAP}")
def direct_map_key(spark, sf_dir):
    return paths.read_path(objects.events(spark, sf_dir), "/Event/props/key")


@query(f"SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY k) - 1 AS INTEGER) AS props_idx, CAST(json_extract(props, '$.' || k) AS DOUBLE) AS props FROM {MAP}")
def direct_map_value(spark, sf_dir):
    return paths.read_path(objects.events(spark, sf_dir), "/Event/props/value")


@query("SELECT conv_id AS entry_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS turns_idx, role FROM conversations")
def direct_string_leaf(spark, sf_dir):
    return paths.read_path(objects.conversations(spark, sf_dir), "/Conv/turns/role")


@query("SELECT CAST(NULL AS BIGINT) AS entry_id, CAST(NULL AS VARCHAR) AS nothing WHERE FALSE")
def direct_missing_path(spark, sf_dir):
    return paths.read_path(order_rows(spark, sf_dir), "/Order/lines/nothing")


@query("SELECT * FROM (VALUES ('/Order/entry_id'), ('/Order/lines'), ('/Order/lines/discount'), ('/Order/lines/extendedprice'), ('/Order/lines/linenumber'), ('/Order/lines/partkey'), ('/Order/lines/quantity'), ('/Order/lines/suppkey'), ('/Order/lines/tax'), ('/Order/status'), ('/Order/totalprice')) t(path)")
def browse_paths(spark, sf_dir):
    return paths.browse(objects.orders(spark, sf_dir), "Order")


@query("SELECT event_id % 4 AS source_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def direct_multi_source(spark, sf_dir):
    return event_values(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id % 4 AS source_id, event_id AS entry_id, value FROM events WHERE event_id % 4 IN (1, 3)")
def source_prune(spark, sf_dir):
    return pruned(spark, sf_dir, None, sources=[1, 3])


@query(f"SELECT count(*) AS n, CAST(sum(partkey) AS BIGINT) AS checksum FROM {LINES}")
def count_checksum(spark, sf_dir):
    return paths.read_path(order_rows(spark, sf_dir), "/Order/lines/partkey").agg(F.count("*").alias("n"), F.sum(F.col("partkey").cast("decimal(28,0)")).cast("long").alias("checksum"))


@query(f"SELECT source_id, basket_id, value_count, null_count, CAST(0 AS BIGINT) AS nan_count, min_value, max_value FROM {BASKETS}")
def index_baskets(spark, sf_dir):
    return event_baskets(spark, sf_dir).select("source_id", "basket_id", "value_count", "null_count", "nan_count", "min_value", "max_value")


@query(f"SELECT source_id, CAST(sum(value_count) AS BIGINT) AS value_count, min(min_value) AS min_value, max(max_value) AS max_value, count(*) AS basket_count FROM {BASKETS} GROUP BY 1")
def index_files(spark, sf_dir):
    return index.rollup_files(event_baskets(spark, sf_dir)).select("source_id", "value_count", "min_value", "max_value", "basket_count")


@query("SELECT source_id, total_entries, CAST(coalesce(sum(total_entries) OVER (ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS event_base FROM (SELECT event_id % 4 AS source_id, count(*) AS total_entries FROM events GROUP BY 1)")
def event_base(spark, sf_dir):
    return index.event_bases(event_values(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("total_entries")))


@query(f"SELECT source_id, basket_id, CAST(coalesce(sum(value_count) OVER (PARTITION BY source_id ORDER BY basket_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS flat_value_begin FROM {BASKETS}")
def flat_value_begin(spark, sf_dir):
    return index.value_begins(event_baskets(spark, sf_dir)).select("source_id", "basket_id", "flat_value_begin")


@query(f"SELECT CAST(sum(value_count) AS BIGINT) AS row_count, CAST(sum(null_count) AS BIGINT) AS null_count, CAST(sum(value_count - null_count) AS BIGINT) AS non_null_count, count(*) AS basket_count, min(min_value) AS min_value, max(max_value) AS max_value FROM {BASKETS}")
def dataset_stats(spark, sf_dir):
    return stored_dataset(spark, sf_dir, "events").stats("/Event/value").select("row_count", "null_count", "non_null_count", "basket_count", "min_value", "max_value")


@query("SELECT count(*) AS row_count FROM events")
def metadata_count(spark, sf_dir):
    return stored_dataset(spark, sf_dir, "events").stats("/Event/value").select("row_count")


EVENT = "SELECT event_id % 4 AS source_id, event_id AS entry_id, value FROM events WHERE"


@query(f"{EVENT} value > 300")
def dataset_zone_gt(spark, sf_dir):
    return pruned(spark, sf_dir, Predicate(">", (300.0,)))


@query(f"{EVENT} value BETWEEN 100 AND 120")
def dataset_between(spark, sf_dir):
    return pruned(spark, sf_dir, Predicate("between", (120.0, 100.0)))


@query(f"{EVENT} value IS NULL AND FALSE")
def dataset_isnull(spark, sf_dir):
    return pruned(spark, sf_dir, Predicate("isnull"))


@query(f"{EVENT} value < 1")
def dataset_zone_lt(spark, sf_dir):
    return pruned(spark, sf_dir, Predicate("<", (1.0,)))


@query(f"{EVENT} value = (SELECT max(value) FROM events)")
def bloom_eq(spark, sf_dir):
    most = stored_dataset(spark, sf_dir, "events").stats("/Event/value").first().max_value
    return pruned(spark, sf_dir, Predicate("=", (most,)))


@query(f"{EVENT} value IN ((SELECT max(value) FROM events), (SELECT min(value) FROM events))")
def dataset_in(spark, sf_dir):
    held = stored_dataset(spark, sf_dir, "events").stats("/Event/value").first()
    low, high = held.min_value, held.max_value
    return pruned(spark, sf_dir, Predicate("in", (low, high)))


@query(f"SELECT source_id, basket_id FROM {BASKETS} WHERE max_value > 300")
def zone_selected_baskets(spark, sf_dir):
    return index.selected_baskets(event_baskets(spark, sf_dir), Predicate(">", (300.0,))).select("source_id", "basket_id")


@query("SELECT least(count(*), 50) AS n FROM events WHERE value > 100")
def row_limit_count(spark, sf_dir):
    return pruned(spark, sf_dir, Predicate(">", (100.0,)), row_limit=50).agg(F.count("*").alias("n"))


@query(f"SELECT entry_id FROM {LINES} GROUP BY 1 HAVING bool_or(extendedprice > 100000)")
def pathpred_any(spark, sf_dir):
    return order_rows(spark, sf_dir).where(index.any_of(F.col("lines.extendedprice"), Predicate(">", (100000.0,)))).select("entry_id")


@query(f"SELECT entry_id FROM {LINES} GROUP BY 1 HAVING bool_and(quantity >= 20)")
def pathpred_all(spark, sf_dir):
    return order_rows(spark, sf_dir).where(index.all_of(F.col("lines.quantity"), Predicate(">=", (20.0,)))).select("entry_id")


@query(f"SELECT entry_id, lines_idx, extendedprice FROM {LINES} WHERE entry_id IN (SELECT entry_id FROM {LINES} GROUP BY 1 HAVING bool_or(quantity > 45) AND bool_and(discount < 0.08)) AND extendedprice > 20000")
def pathpred_two(spark, sf_dir):
    rows = order_rows(spark, sf_dir).where(index.any_of(F.col("lines.quantity"), Predicate(">", (45.0,)))).where(index.all_of(F.col("lines.discount"), Predicate("<", (0.08,))))
    return paths.read_path(rows, "/Order/lines/extendedprice").where("extendedprice > 20000")


SELECTION = [(0, 0, 40), (0, 30, 90), (1, 401, 402), (3, 2000, 2600)]


@query("SELECT event_id % 4 AS source_id, event_id AS entry_id, value FROM events WHERE (event_id % 4 = 0 AND event_id < 90) OR (event_id % 4 = 1 AND event_id = 401) OR (event_id % 4 = 3 AND event_id >= 2000 AND event_id < 2600)")
def entry_selection(spark, sf_dir):
    return pruned(spark, sf_dir, None, selection=spark.createDataFrame(SELECTION, "source_id long, begin long, end long"))


@query("SELECT event_id % 4 AS source_id, event_id AS entry_id, value FROM events WHERE (event_id % 4 = 0 AND event_id BETWEEN 400 AND 479) OR event_id IN (8, 12, 501, 505, 513, 2001)")
def entry_selection_json(spark, sf_dir):
    """Ranges, entries and deltas of a JSON selection."""
    wanted = requests.entry_selection(spark, '{"0": {"ranges": [[400, 480]], "entries": [8, 12, 8]}, "1": {"entries_delta": {"base": 501, "deltas": [4, 8]}, "entries": [2001]}}')
    return pruned(spark, sf_dir, None, selection=wanted)


@query("SELECT event_id % 4 AS source_id, event_id AS entry_id, value FROM events WHERE FALSE")
def entry_selection_empty(spark, sf_dir):
    return pruned(spark, sf_dir, None, selection=requests.entry_selection(spark, "{}"))


@query(f"{EVENT} (event_id < 120 OR event_id BETWEEN 700 AND 740 OR event_id IN (1201, 903)) AND event_id >= 7 AND event_id <> 710 AND value > 5")
def dataset_event_range(spark, sf_dir):
    """A predicate on entry numbers chooses baskets by the range that it allows, then entries exactly."""
    asked = requests.value_predicate('{"and": [{"or": [{"op": "<", "value": 120}, {"op": "between", "values": [740, 700]}, {"op": "in", "values": [1201, 903]}]}, {"op": ">=", "value": 7}, {"op": "<>", "value": 710}]}')
    return pruned(spark, sf_dir, Predicate(">", (5.0,)), entries=asked)


@query(f"{EVENT} (value > 200 OR (value >= 10 AND value < 12)) AND value <> 11")
def dataset_tree(spark, sf_dir):
    """AND and OR trees prune as well."""
    return pruned(spark, sf_dir, requests.value_predicate('{"and": [{"or": [{"op": "gt", "value": 200}, {"and": [{"op": "ge", "value": 10}, {"op": "lt", "value": 12}]}]}, {"op": "ne", "value": 11}]}'))


@query(f"{EVENT} value > 150 AND event_type = (SELECT min(event_type) FROM events) AND user_id BETWEEN 1 AND 400")
def dataset_cross_path(spark, sf_dir):
    """Other paths' predicates choose baskets by their own metadata, then entries exactly."""
    kind = objects.table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    asked = requests.path_predicates([{"path": "/Event/event_type", "op": "==", "value": kind}, {"path": "/Event/user_id", "op": "between", "values": [400, 1]}])
    return pruned(spark, sf_dir, Predicate(">", (150.0,)), path_predicates=asked)


@query(f"SELECT entry_id % 4 AS source_id, entry_id, lines_idx, extendedprice FROM {LINES} WHERE entry_id IN (SELECT entry_id FROM {LINES} GROUP BY 1 HAVING bool_or(quantity > 49) AND bool_and(discount <= 0.05)) AND extendedprice BETWEEN 30000 AND 60000")
def dataset_path_predicates(spark, sf_dir):
    asked = requests.path_predicates('[{"path": "/Order/lines/quantity", "op": ">", "value": 49}, {"path": "/Order/lines/discount", "op": "le", "value": 0.05, "quantifier": "all"}]')
    return stored_dataset(spark, sf_dir, "orders").scan("/Order/lines/extendedprice", Predicate("between", (60000.0, 30000.0)), path_predicates=asked)[0]


@query("""SELECT count(DISTINCT (s, p)) FILTER (WHERE hit) AS files_read, count(DISTINCT (s, p)) AS files_total, count(*) FILTER (WHERE hit) AS baskets_read, count(*) AS baskets_total FROM (
  SELECT event_id % 4 AS s, event_id // 100 AS b, any_value(event_id // 5000) AS p, coalesce(max(value) > 400, FALSE) AS hit FROM events GROUP BY 1, 2)""")
def prune_report(spark, sf_dir):
    """What a pruned scan opens, held against what the extremes allow."""
    _, report = stored_dataset(spark, sf_dir, "events").scan("/Event/value", Predicate(">", (400.0,)))
    row = (report.files_read, report.files_total, report.baskets_read, report.baskets_total)
    return spark.createDataFrame([row], "files_read long, files_total long, baskets_read long, baskets_total long")


@query("SELECT event_id % 4 AS source_id, event_id // 100 AS basket_id, count(*) AS value_count, min(event_type) AS min_value, max(event_type) AS max_value FROM events GROUP BY 1, 2")
def index_text_path(spark, sf_dir):
    return stored_dataset(spark, sf_dir, "events").baskets("/Event/event_type").select("source_id", "basket_id", "value_count", "min_value", "max_value")


@query("SELECT path, leaf, kind FROM (VALUES ('/Event/event_type', 'event_type', 'text'), ('/Event/user_id', 'user_id', 'long'), ('/Event/value', 'value', 'double')) t(path, leaf, kind)")
def index_schemas(spark, sf_dir):
    return stored_dataset(spark, sf_dir, "events").table("schemas").select("path", "leaf", "kind")


@query("SELECT event_id % 4 AS source_id, event_id // 5000 AS part, count(*) AS entries FROM events GROUP BY 1, 2")
def index_source_files(spark, sf_dir):
    """The files table: a row per data file, checked to be as it was."""
    held = stored_dataset(spark, sf_dir, "events")
    held.check_fresh()
    return held.table("files").select("source_id", "part", "entries")


RUNS = "(SELECT event_id % 4 AS source_id, event_id // 4 AS slot FROM events WHERE value > 50) AS hits"


@query(f'SELECT source_id, min(slot) AS "begin", max(slot) + 1 AS "end" FROM (SELECT *, slot - row_number() OVER (PARTITION BY source_id ORDER BY slot) AS run FROM (SELECT DISTINCT * FROM {RUNS})) GROUP BY source_id, run')
def entry_encode(spark, sf_dir):
    hits = pruned(spark, sf_dir, Predicate(">", (50.0,))).select("source_id", F.expr("entry_id div 4").alias("entry_id"))
    return intervals.encode(hits).select("source_id", "begin", "end")


SPANS = "(SELECT l_suppkey AS source_id, l_partkey % 500 AS b, l_partkey % 500 + CAST(l_quantity AS BIGINT) % 9 AS e FROM lineitem) AS spans"


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities are rounded as the SQL's cast rounds them, halves to even; Spark's own cast would cut the fraction off."""
    rows = objects.table(spark, sf_dir, "lineitem")
    begin = F.col("l_partkey") % 500
    return rows.select(F.col("l_suppkey").alias("source_id"), begin.alias("begin"), (begin + F.rint("l_quantity").cast("long") % 9).alias("end"))


MERGED = f"""(SELECT source_id, min(b) AS b, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY source_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {SPANS} WHERE b < e)) GROUP BY source_id, island)"""


@query(f'SELECT source_id, b AS "begin", e AS "end" FROM {MERGED}')
def interval_merge(spark, sf_dir):
    return intervals.merge(line_spans(spark, sf_dir)).select("source_id", "begin", "end")


@query(f'SELECT source_id, greatest(b, 100) AS "begin", least(e, 220) AS "end" FROM {MERGED} WHERE b < 220 AND e > 100')
def interval_intersect(spark, sf_dir):
    merged = intervals.merge(line_spans(spark, sf_dir))
    window = merged.select("source_id").distinct().select("source_id", F.lit(100).cast("long").alias("begin"), F.lit(220).cast("long").alias("end"))
    return intervals.intersect(merged, window)


QUANTITY, PRICE = histogram.Axis("l_quantity", 10, 5.0, 45.0), histogram.Axis("l_extendedprice", 4, 20000.0, 80000.0)
XBIN = "CAST(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 11 ELSE floor((l_quantity - 5) / 4) + 1 END AS INTEGER)"
YBIN = "CAST(CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_extendedprice >= 80000 THEN 5 ELSE floor((l_extendedprice - 20000) / 15000) + 1 END AS INTEGER)"


@query(f"SELECT CAST(s.b AS INTEGER) AS x_bin, s.b = 0 AS is_underflow, s.b = 11 AS is_overflow, CAST(count(l.b) AS DOUBLE) AS content, round(sqrt(count(l.b)), 6) AS error, 5.0::DOUBLE + (s.b - 1) * 4 AS x_low FROM (SELECT unnest(generate_series(0, 11)) AS b) s LEFT JOIN (SELECT {XBIN} AS b FROM lineitem) l ON s.b = l.b GROUP BY s.b")
def hist_bins_1d(spark, sf_dir):
    out = histogram.bins(objects.table(spark, sf_dir, "lineitem"), [QUANTITY])
    return out.select("x_bin", "is_underflow", "is_overflow", "content", F.round("error", 6).alias("error"), "x_low")


@query(f"SELECT CAST(x.b + 12 * y.b AS INTEGER) AS global_bin, CAST(x.b AS INTEGER) AS x_bin, CAST(y.b AS INTEGER) AS y_bin, count(l.xb) AS entries FROM (SELECT unnest(generate_series(0, 11)) AS b) x CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS b) y LEFT JOIN (SELECT {XBIN} AS xb, {YBIN} AS yb FROM lineitem) l ON x.b = l.xb AND y.b = l.yb GROUP BY x.b, y.b")
def hist_bins_2d(spark, sf_dir):
    return histogram.bins(objects.table(spark, sf_dir, "lineitem"), [QUANTITY, PRICE]).select("global_bin", "x_bin", "y_bin", "entries")


@query("SELECT * FROM (VALUES (1, 'x', 'l_quantity', 10, 5.0::DOUBLE, 45.0::DOUBLE, 1, 10), (2, 'y', 'l_extendedprice', 4, 20000.0::DOUBLE, 80000.0::DOUBLE, 1, 4)) t(axis_idx, axis_name, title, nbins, min, max, first_bin, last_bin)")
def hist_axes(spark, sf_dir):
    return histogram.axes_table(spark, [QUANTITY, PRICE])


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE l_quantity >= 5 AND l_quantity < 45) AS entries_inside, round(avg(l_quantity) FILTER (WHERE l_quantity >= 5 AND l_quantity < 45), 6) AS mean_x, round(stddev_pop(l_quantity) FILTER (WHERE l_quantity >= 5 AND l_quantity < 45), 6) AS stddev_x FROM lineitem")
def hist_meta(spark, sf_dir):
    return histogram.meta(objects.table(spark, sf_dir, "lineitem"), QUANTITY).select("entries", "entries_inside", F.round("mean_x", 6).alias("mean_x"), F.round("stddev_x", 6).alias("stddev_x"))


@query(f"SELECT {XBIN} AS x_bin, count(*) AS profile_entries, round(avg(l_extendedprice), 4) AS content, round(stddev_pop(l_extendedprice), 3) AS spread FROM lineitem GROUP BY 1")
def profile_bins(spark, sf_dir):
    out = histogram.profile(objects.table(spark, sf_dir, "lineitem"), QUANTITY, "l_extendedprice")
    return out.select("x_bin", "profile_entries", F.round("content", 4).alias("content"), F.round("spread", 3).alias("spread"))


@query("SELECT 0 AS differing")
def diff_two_readers(spark, sf_dir):
    """The chained reader and the container reader agree, both ways."""
    rows = order_rows(spark, sf_dir)
    a, b = paths.read_path(rows, "/Order/lines/quantity"), paths.read_container(rows, "/Order/lines").select("entry_id", "lines_idx", "quantity")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").cast("int").alias("differing"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return objects.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey AS entry_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def lineage_anti(spark, sf_dir):
    rows = order_rows(spark, sf_dir).select("entry_id")
    return rows.join(objects.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id")), "entry_id", "left_anti")


@query(f"SELECT c_custkey, count(*) AS n, CAST(sum(CAST(round(extendedprice * (1 - discount) * 100) AS BIGINT)) AS BIGINT) AS cents FROM {LINES} JOIN orders ON entry_id = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def flattened_join(spark, sf_dir):
    flat = paths.read_container(order_rows(spark, sf_dir), "/Order/lines")
    owners = objects.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("c_custkey")).join(objects.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return flat.join(owners, "entry_id").groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("extendedprice") * (1 - F.col("discount")) * 100).cast("long")).alias("cents"))


@query("SELECT event_id % 4 AS source_id, event_id // 100 AS basket_id, count(*) AS value_count FROM events GROUP BY ALL")
def snapshot_read(spark, sf_dir):
    """Baskets published as a snapshot and read back through the commit log."""
    from burrow.sources.catalog import scratch

    store = catalog.Catalog(spark, scratch(spark))
    store.publish({"baskets": event_baskets(spark, sf_dir)}, fingerprint="events")
    return store.read("baskets").select("source_id", "basket_id", "value_count")


@query("SELECT event_id % 4 AS source_id, count(*) AS entries FROM events GROUP BY 1")
def direct_source_counts(spark, sf_dir):
    return event_values(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("entries"))


@query("SELECT CAST(sum(n) AS BIGINT) AS entries, count(*) AS chunks FROM (SELECT (event_id // 1000) // 3 AS chunk, count(*) AS n FROM events GROUP BY 1)")
def chunk_plan(spark, sf_dir):
    """Ranges of a thousand entries packed as chunks of three; a row per range reaches the driver, as a list of files would."""
    counts = direct_scalar(spark, sf_dir).groupBy(F.expr("entry_id div 1000").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    planned = chunks.plan([(str(r.part), r.n) for r in counts], max_files=3, max_bytes=10_000)
    return spark.createDataFrame([(sum(c["bytes"] for c in planned), len(planned))], "entries long, chunks long")


def sql(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """A statement over the tables it names in braces, and further frames."""
    named = {t: objects.table(spark, sf_dir, t) for t in ("events", "orders", "lineitem", "customer", "nation", "conversations") if f"{{{t}}}" in text}
    return spark.sql(text, **named, **more)


@query("SELECT count(DISTINCT event_id % 4) AS sources, count(DISTINCT user_id) AS users, bool_and(value >= 0) AS all_positive, max(value) AS most, arg_max(event_id, value) AS most_id, count(*) FILTER (WHERE value IS NULL) AS nulls FROM events WHERE value = (SELECT max(value) FROM events WHERE event_id < 1000) OR event_id < 1000")
def audit_aggregates(spark, sf_dir):
    """Distinct counts, bool_and, the entry of the largest value, and a scalar subquery."""
    return sql(spark, sf_dir, "SELECT count(DISTINCT pmod(event_id, 4)) AS sources, count(DISTINCT user_id) AS users, bool_and(value >= 0) AS all_positive, max(value) AS most, max_by(event_id, value) AS most_id, count_if(value IS NULL) AS nulls FROM {events} WHERE value = (SELECT max(value) FROM {events} WHERE event_id < 1000) OR event_id < 1000")


@query("SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, to_json(list(role ORDER BY turn)) AS roles_json, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) = count(*)")
def ordered_lists(spark, sf_dir):
    """Ordered lists as one string and as JSON."""
    rows = objects.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").alias("turns"), F.count_distinct("turn").alias("distinct_turns"))
    roles = F.transform("t", lambda x: x["role"])
    return rows.where("turns = distinct_turns").select("conv_id", F.array_join(roles, "|").alias("roles"), F.to_json(roles).alias("roles_json"), "turns")


@query("""SELECT event_id, regexp_extract(event_type, '^([a-z]+)', 1) AS head, contains(event_type, 'c') AS has_c, event_type LIKE '%e%' AS has_e, concat_ws('/', event_type, CAST(user_id AS VARCHAR)) AS name, substr(event_type, 2, 3) AS middle, upper(hex(event_type)) AS hexed,
  CAST(octet_length(CAST(event_type AS BLOB)) AS INTEGER) AS octets, CAST(length(event_type) AS INTEGER) AS letters, coalesce(nullif(user_id % 5, 0), -1) AS some, coalesce(TRY_CAST(substr(CAST(event_id AS VARCHAR), 1, 2) || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS INTEGER), -1) AS tried, event_type || chr(33) AS cried FROM events WHERE event_id < 2000""")
def scalar_functions(spark, sf_dir):
    text = "SELECT event_id, regexp_extract(event_type, '^([a-z]+)', 1) AS head, contains(event_type, 'c') AS has_c, event_type LIKE '%e%' AS has_e, concat_ws('/', event_type, CAST(user_id AS STRING)) AS name, substr(event_type, 2, 3) AS middle, hex(event_type) AS hexed, octet_length(event_type) AS octets, length(event_type) AS letters, coalesce(nullif(user_id % 5, 0), -1) AS some, coalesce(try_cast(substr(CAST(event_id AS STRING), 1, 2) || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS INT), -1) AS tried, event_type || chr(33) AS cried FROM {events} WHERE event_id < 2000"
    return sql(spark, sf_dir, text)


@query("SELECT count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def checked_sum(spark, sf_dir):
    """A check within a query: a negative id would raise."""
    return sql(spark, sf_dir, "SELECT count(*) AS rows, sum(CASE WHEN event_id < 0 THEN CAST(raise_error('negative id') AS BIGINT) ELSE event_id END) AS ids FROM {events}")


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def except_union(spark, sf_dir):
    return sql(spark, sf_dir, "(SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}) UNION ALL (SELECT o_custkey FROM {orders} EXCEPT SELECT c_custkey FROM {customer})")


@query("SELECT a.n AS events, b.n AS orders, c.n AS lines FROM (SELECT count(*) AS n FROM events) a, (SELECT count(*) AS n FROM orders) b, (SELECT count(*) AS n FROM lineitem) c")
def cross_join_of_totals(spark, sf_dir):
    """One-row aggregates side by side."""
    return sql(spark, sf_dir, "SELECT a.n AS events, b.n AS orders, c.n AS lines FROM (SELECT count(*) AS n FROM {events}) a CROSS JOIN (SELECT count(*) AS n FROM {orders}) b CROSS JOIN (SELECT count(*) AS n FROM {lineitem}) c")


@query(f"SELECT entry_id, lines_idx, quantity FROM {LINES} WHERE entry_id IN (SELECT entry_id FROM {LINES} WHERE discount > 0.09)")
def semi_join_across_paths(spark, sf_dir):
    """Rows of one path whose entry another path selects."""
    rows = order_rows(spark, sf_dir)
    wanted = paths.read_path(rows, "/Order/lines/discount").where("discount > 0.09").select("entry_id")
    return paths.read_path(rows, "/Order/lines/quantity").join(wanted, "entry_id", "left_semi")


@query(f"SELECT coalesce(a.entry_id, b.entry_id) AS entry_id, coalesce(a.lines_idx, b.lines_idx) AS lines_idx, a.quantity, b.tax FROM (SELECT * FROM {LINES} WHERE quantity > 25) a FULL JOIN (SELECT * FROM {LINES} WHERE tax < 0.04) b ON a.entry_id = b.entry_id AND a.lines_idx = b.lines_idx")
def full_join_on_index(spark, sf_dir):
    """Two paths side by side by entry and index."""
    rows = order_rows(spark, sf_dir)
    a, b = paths.read_path(rows, "/Order/lines/quantity").where("quantity > 25"), paths.read_path(rows, "/Order/lines/tax").where("tax < 0.04")
    return a.join(b, ["entry_id", "lines_idx"], "full").select("entry_id", "lines_idx", "quantity", "tax")


@query(f"SELECT c_custkey, CAST(sum(n) AS BIGINT) AS n FROM (SELECT entry_id, count(*) AS n FROM {LINES} GROUP BY 1) JOIN orders ON entry_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, c_custkey LIMIT 20")
def latest_by_order(spark, sf_dir):
    counts = paths.read_path(order_rows(spark, sf_dir), "/Order/lines/quantity").groupBy("entry_id").agg(F.count("*").alias("n"))
    return sql(spark, sf_dir, "SELECT c_custkey, sum(n) AS n FROM {counts} JOIN {orders} ON entry_id = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, c_custkey LIMIT 20", counts=counts)


@query("SELECT (SELECT count(*) FROM events) AS n, (SELECT count(value) FROM events) AS non_null, (SELECT min(value) FROM events) AS least, (SELECT max(value) FROM events) AS most")
def stats_functions(spark, sf_dir):
    """Count, non-null count, smallest and largest value, as functions of the index."""
    row = stored_dataset(spark, sf_dir, "events").stats("/Event/value")
    return row.select(F.col("row_count").alias("n"), F.col("non_null_count").alias("non_null"), F.col("min_value").alias("least"), F.col("max_value").alias("most"))


@query("""SELECT source_id, coalesce(CAST(to_json(list([lo, hi] ORDER BY lo) FILTER (WHERE hi - lo >= 2)) AS VARCHAR), '[]') AS ranges, min(lo) FILTER (WHERE hi - lo < 2) AS base, CAST(count(*) FILTER (WHERE hi - lo < 2) AS BIGINT) AS single FROM (
  SELECT source_id, min(slot) AS lo, max(slot) + 1 AS hi FROM (SELECT *, slot - row_number() OVER (PARTITION BY source_id ORDER BY slot) AS run FROM (SELECT DISTINCT event_id % 4 AS source_id, event_id // 4 AS slot FROM events WHERE value > 50)) GROUP BY source_id, run) GROUP BY source_id""")
def entry_selection_encode(spark, sf_dir):
    """Entries as a selection: runs of two or more as ranges, the rest as a base and deltas."""
    hits = pruned(spark, sf_dir, Predicate(">", (50.0,))).select("source_id", F.expr("entry_id div 4").alias("entry_id"))
    out = intervals.selection(hits, min_run=2, cell=64)
    return out.select("source_id", F.to_json("ranges").alias("ranges"), "base", (F.size("deltas") + F.when(F.col("base").isNull(), 0).otherwise(1)).cast("long").alias("single"))


HISTOGRAMS = [
    histogram.Histogram("/lines/quantity", (QUANTITY,), "Quantity"),
    histogram.Histogram("/lines/space", (histogram.Axis("l_quantity", 3, 0.0, 60.0), histogram.Axis("l_discount", edges=(0.0, 0.015, 0.055, 0.095)), histogram.Axis("l_tax", 2, 0.0, 0.05)), weight="l_quantity"),
    histogram.Histogram("/lines/price", (QUANTITY,), profile="l_extendedprice", weight="l_linenumber"),
]


@query(f"""SELECT '/lines/quantity' AS object_path, 'TH1D' AS class_name, CAST(s.b AS INTEGER) AS global_bin, 3.0::DOUBLE + s.b * 4 AS x_center, CAST(count(l.b) AS DOUBLE) AS content, (SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS entries, (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 45) AS sum_weights,
  (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_quantity < 5) AS x_underflow, (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_quantity >= 45) AS x_overflow FROM (SELECT unnest(generate_series(0, 11)) AS b) s LEFT JOIN (SELECT {XBIN} AS b FROM lineitem) l ON s.b = l.b GROUP BY s.b""")
def hist_view_bins(spark, sf_dir):
    out = histogram.read([objects.table(spark, sf_dir, "lineitem")], "/lines/quantity/bins", HISTOGRAMS)
    return out.select("object_path", "class_name", "global_bin", "x_center", "content", "entries", "sum_weights", "x_underflow", "x_overflow")


CELL3 = """(SELECT CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 60 THEN 4 ELSE floor(l_quantity / 20) + 1 END AS x, (l_discount >= 0)::INT + (l_discount >= 0.015)::INT + (l_discount >= 0.055)::INT + (l_discount >= 0.095)::INT AS y,
  CASE WHEN l_tax < 0 THEN 0 WHEN l_tax >= 0.05 THEN 3 WHEN l_tax >= 0.025 THEN 2 ELSE 1 END AS z, l_quantity AS w FROM lineitem) AS cell3"""


@query(f"SELECT CAST(x + 5 * (y + 5 * z) AS INTEGER) AS global_bin, round(sum(w), 4) AS content, round(sqrt(sum(w * w)), 4) AS error, round(sum(w * w), 4) AS sumw2_raw FROM {CELL3} GROUP BY x, y, z HAVING sum(w) > 0")
def hist_view_3d(spark, sf_dir):
    """Three axes, one with uneven bins, weighted."""
    out = histogram.read([objects.table(spark, sf_dir, "lineitem")], "/lines/space", HISTOGRAMS).where("content > 0")
    return out.select("global_bin", *[F.round(c, 4).alias(c) for c in ("content", "error", "sumw2_raw")])


@query("SELECT count(*) AS n_cells, CAST(max(x_bin) AS INTEGER) AS last_x FROM (SELECT unnest(generate_series(0, 5 * 5 * 4 - 1)) % 5 AS x_bin)")
def hist_view_3d_cells(spark, sf_dir):
    return histogram.read([objects.table(spark, sf_dir, "lineitem")], "/lines/space/bins", HISTOGRAMS).agg(F.count("*").alias("n_cells"), F.max("x_bin").alias("last_x"))


@query(f"SELECT {XBIN} AS x_bin, CAST(sum(w) AS DOUBLE) AS profile_entries, round(CAST(sum(w) AS DOUBLE) ** 2 / sum(w * w), 6) AS profile_effective_entries, round(sum(w * y) / sum(w), 4) AS content, round(sqrt(sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2) / sqrt(CAST(sum(w) AS DOUBLE) ** 2 / sum(w * w)), 3) AS error FROM (SELECT l_quantity, l_linenumber AS w, l_extendedprice AS y FROM lineitem) GROUP BY 1")
def hist_view_profile(spark, sf_dir):
    out = histogram.read([objects.table(spark, sf_dir, "lineitem")], "/lines/price", HISTOGRAMS).where("profile_entries > 0")
    return out.select("x_bin", "profile_entries", F.round("profile_effective_entries", 6).alias("profile_effective_entries"), F.round("content", 4).alias("content"), F.round("error", 3).alias("error"))


@query("SELECT axis_idx, axis_name, nbins, variable_bins FROM (VALUES (1, 'x', 3, FALSE), (2, 'y', 3, TRUE), (3, 'z', 2, FALSE)) t(axis_idx, axis_name, nbins, variable_bins)")
def hist_view_axes(spark, sf_dir):
    return histogram.read([objects.table(spark, sf_dir, "lineitem")], "/lines/space/axes", HISTOGRAMS).select("axis_idx", "axis_name", "nbins", "variable_bins")


@query("""SELECT FALSE AS is_profile, CAST(12 AS INTEGER) AS n_cells, (SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS entries, CAST(count(*) AS DOUBLE) AS effective_entries, round(avg(l_quantity), 6) AS mean_x, round(stddev_pop(l_quantity) / sqrt(count(*)), 6) AS mean_error_x, round(stddev_pop(l_quantity), 6) AS stddev_x,
  round(avg((l_quantity - m) ** 3) / stddev_pop(l_quantity) ** 3, 6) AS skewness_x, round(avg((l_quantity - m) ** 4) / var_pop(l_quantity) ** 2 - 3, 6) AS kurtosis_x FROM (SELECT l_quantity, avg(l_quantity) OVER () AS m FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 45)""")
def hist_view_meta(spark, sf_dir):
    out = histogram.read([objects.table(spark, sf_dir, "lineitem")], "/lines/quantity/meta", HISTOGRAMS)
    return out.select("is_profile", "n_cells", "entries", "effective_entries", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_error_x", "stddev_x", "skewness_x", "kurtosis_x")])


@query("SELECT entry_id, user_id, event_type, value FROM (SELECT event_id AS entry_id, user_id, event_type, value FROM events)")
def scan_tree(spark, sf_dir):
    """All scalars of the events but their time, without their map."""
    return paths.scan_tree(objects.events(spark, sf_dir)).drop("ts")


@query(f"SELECT entry_id, lines_idx, quantity, tax FROM {LINES}")
def read_paths_together(spark, sf_dir):
    """Two paths of one set of index columns, side by side without a join."""
    return paths.read_paths(order_rows(spark, sf_dir), ["/Order/lines/quantity", "/Order/lines/tax/value", "/Order/totalprice"])[("lines_idx",)]


@query("SELECT CAST(source_id AS BIGINT) AS source_id, n, n_names FROM (SELECT 0 AS source_id, count(*) AS n, count(n_name) AS n_names FROM nation UNION ALL SELECT 1, count(*), 0 FROM region)")
def files_as_sources(spark, sf_dir):
    """Two files by name, columns that one lacks null, a missing file left out."""
    rows, missing = files.read(spark, f"{sf_dir}/nation.parquet,{sf_dir}/region.parquet,{sf_dir}/absent.parquet", union_by_name=True)
    if len(missing) != 1:
        raise AssertionError(missing)
    return rows.groupBy("source_id").agg(F.count("entry_id").alias("n"), F.count("n_name").alias("n_names"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """A report written as CSV and read back."""
    folder = catalog.scratch(spark)
    wanted = objects.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.write_csv(wanted, folder)
    return files.read_csv(spark, folder, schema=wanted.schema.simpleString()[7:-1].replace(":", " "))


@query("SELECT event_id % 4 AS source_id, event_id // 100 AS basket_id, count(*) AS value_count FROM events WHERE event_id % 4 <> 3 GROUP BY 1, 2")
def table_snapshots(spark, sf_dir):
    """Baskets appended to an SQL table in two snapshots, the second with a column more; a snapshot that never committed isn't seen."""
    import uuid

    store = tables.Tables(spark, "burrow" + uuid.uuid4().hex)
    rows = event_baskets(spark, sf_dir).select("source_id", "basket_id", "value_count")
    store.publish({"baskets": rows.where("source_id < 2")}, "first")
    store.publish({"baskets": rows.where("source_id = 2").withColumn("more", F.lit(1))}, "second")
    store.insert("baskets", rows.where("source_id = 3").withColumn("snapshot_id", F.lit("lost")))
    return store.read("baskets").select("source_id", "basket_id", "value_count")


@query("SELECT count(*) AS n, count(value) AS non_null, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events")
def sql_stats_functions(spark, sf_dir):
    """The index's figures by SQL functions of a path."""
    held = stored_dataset(spark, sf_dir, "events")
    tables.register_functions(spark, held.stats("/Event/value").withColumn("path", F.lit("/Event/value")), "burrow_events")
    call = lambda name: f"burrow_events_{name}('/Event/value')"
    return spark.sql(f"SELECT {call('count')} AS n, {call('non_null_count')} AS non_null, round(CAST({call('min')} AS DOUBLE), 6) AS least, round(CAST({call('max')} AS DOUBLE), 6) AS most")


@query("SELECT * FROM (VALUES ('access'), ('baskets'), ('files'), ('schemas')) t(table_name)")
def catalog_listing(spark, sf_dir):
    """The tables of the current snapshot."""
    return stored_dataset(spark, sf_dir, "events").catalog.listing().select("table_name")


@query("""SELECT source_id, CAST(min(n) AS BIGINT) AS part, min(lo) AS "begin", max(hi) AS "end", count(*) AS baskets FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id, n ORDER BY lo) AS island FROM (
  SELECT *, CASE WHEN lo <= lag(hi) OVER (PARTITION BY source_id, n ORDER BY lo) + 400 THEN 0 ELSE 1 END AS fresh FROM (
  SELECT event_id % 4 AS source_id, event_id // 100 AS b, any_value(event_id // 5000) AS n, event_id // 100 * 100 AS lo, event_id // 100 * 100 + 100 AS hi FROM events GROUP BY ALL HAVING max(value) > 300))) GROUP BY source_id, n, island""")
def read_ranges(spark, sf_dir):
    """Baskets that may hold a match as ranges; gaps of 400 entries are read over. Ends are rounded to whole baskets here."""
    held = stored_dataset(spark, sf_dir, "events")
    chosen = held.chosen("/Event/value", Predicate(">", (300.0,)))
    whole = chosen.withColumn("entry_begin", F.expr("entry_begin div 100 * 100")).withColumn("entry_end", F.expr("((entry_end - 1) div 100 + 1) * 100"))
    return held.ranges(whole, gap=400)


@query("SELECT source_id, CAST(sum(n) AS BIGINT) AS entries, min(base) AS event_base FROM (SELECT event_id % 4 AS source_id, count(*) AS n, (SELECT count(*) FROM events e WHERE e.event_id % 4 < any_value(x.event_id % 4)) AS base FROM events x GROUP BY 1) GROUP BY 1")
def chunks_merged(spark, sf_dir):
    """Two chunks of an index built apart, run twice, validated and merged in one commit, compacted, and read."""
    held, planned, stores = stored_dataset(spark, sf_dir, "events"), [], {}
    for name, own in (("low", (0, 1)), ("high", (2, 3))):
        chunk = chunks.chunk([(name, 1)])
        store = catalog.Catalog(spark, catalog.scratch(spark))

        def build(_, own=own):
            return {n: held.table(n).where(F.col("source_id").isin(*own)) if n in ("files", "baskets") else held.table(n) for n in control.KEYS}

        first = control.run(chunk, store, build)
        if control.run(chunk, store, build) != first:
            raise AssertionError("a chunk was built twice")
        planned.append(chunk)
        stores[chunk["chunk_id"]] = store
    target = catalog.Catalog(spark, catalog.scratch(spark))
    control.merge(planned, stores, target)
    control.compact(target, 1)
    return target.read("files").groupBy("source_id").agg(F.sum("entries").alias("entries"), F.min("event_base").alias("event_base"))


@query(f"SELECT '/Order/lines/quantity' AS path, 'double' AS type, count(*) AS rows, count(DISTINCT entry_id) AS entries, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS repeated_keys FROM {LINES} UNION ALL SELECT '/Order/lines/suppkey', 'bigint', count(*), count(DISTINCT entry_id), 0, 0 FROM {LINES} UNION ALL SELECT '/Order/none', NULL, 0, 0, 0, 0")
def schema_audit(spark, sf_dir):
    return control.audit(order_rows(spark, sf_dir), ["/Order/lines/suppkey", "/Order/lines/quantity", "/Order/none"])
