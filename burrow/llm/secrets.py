"""Secret scan: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Three fixed patterns give base spans. Besides, every run of key characters that is long enough is scored by the
mean log-likelihood ratio of its character pairs under two first-order Markov models with add-one smoothing, and
is a span of kind ``markov`` if the ratio passes a threshold and no base span overlaps it. All of it, training
included, is DataFrame expressions. No table here labels secrets; the labelled samples are made by rule.

Cases: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are kept, each
with its spans; an empty table gives an empty result; other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their fixed order: name, pattern, group whose length counts, least length. For "access" and "hex" a
#: shorter match never hides a longer one, so their least length stands in the pattern.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Letters of the Markov models; candidates are runs of them.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Values that a scan sums up at once; a longer array is scanned chunk by chunk.
CHUNK = 128
#: Words of ordinary identifiers, the labelled samples' negative side.
IDENTIFIER_WORDS = (
    "get set user name file path data list index value count size type node tree key map load save read write open close start stop "
    "init config server client request response message error handler manager service factory builder controller buffer stream "
    "thread table column row query result session context event state update delete create insert parse format string number "
    "the and of that with from this for which have international organisation information nicht einer werden schaft keit lich "
    "heit ung ver gegen zwischen ement ation ique avec dans pour eaux ouvert para como mente cion ado los una estacion"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used, within lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's ints, 0 joined with all that stand before it: within chunks, then over the chunks' totals, so that time is linear in practice."""
    none = F.array().cast("array<int>")

    def scan(part: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    zero = F.lit(0)
    numbers = lambda v: F.sequence(zero, F.floor((F.size(v) - 1) / CHUNK).cast("int"))
    split = lambda v: F.when(F.size(v) > 0, F.transform(numbers(v), lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<int>>"))
    totals = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, zero, join))
    return let(values, lambda v: let(split(v), lambda chunks: F.flatten(F.zip_with(chunks, scan(totals(chunks), zero), scan))))


def find(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches as spans; those whose group is shorter than ``least`` are dropped afterwards."""
    flag, regex = text.rlike(pattern), F.lit(pattern)
    none = F.array().cast(SPAN)

    def spans(whole: Column) -> Column:
        """The gap before each match and the match itself give its place; the last gap is none's."""
        gap = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length)
        sizes = F.zip_with(gap, whole, lambda g, w: F.struct(g.alias("gap"), F.length(w).alias("size")))

        def placed(sized: Column) -> Column:
            at = before(F.transform(sized, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
            value = whole if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
            packed = F.arrays_zip(sized.alias("sized"), value.alias("value"), at.alias("at"))
            return F.transform(F.filter(packed, lambda m: F.length(m["value"]) >= least), span)

        return let(sizes, placed)

    def span(m: Column) -> Column:
        start = m["at"] + m["sized"]["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["sized"]["size"]).alias("end"), m["value"].alias("value"))

    return F.when(flag, let(F.regexp_extract_all(text, regex, F.lit(0)), spans)).otherwise(none)


def apart(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span: by end, a run's base spans that begin before it ends stand before it, and the furthest of their ends tells."""
    event = lambda at, order, s, reach: F.struct(at.alias("at"), F.lit(order).alias("order"), reach.alias("reach"), s.alias("span"))
    events = F.sort_array(F.concat(F.transform(runs, lambda r: event(r["end"], 0, r, F.lit(0))), F.transform(base, lambda b: event(b["start"], 1, b, b["end"]))))

    def free(e: Column) -> Column:
        reach = before(F.transform(e, lambda x: x["reach"]), lambda a, b: F.greatest(a, b))
        met = F.filter(F.arrays_zip(e.alias("e"), reach.alias("reach")), lambda x: (x["e"]["order"] == 0) & (x["reach"] <= x["e"]["span"]["start"]))
        return F.transform(met, lambda x: x["e"]["span"])

    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(let(events, free))


def labelled_samples(spark: SparkSession, n: int = 20_000, start: int = 0) -> DataFrame:
    """``value, random``: ``n`` random strings in four alphabets and ``n`` identifiers in five styles, all by rule from hashes of start..start+n-1."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    more = F.sha2(F.concat(F.lit("more"), F.col("id").cast("string")), 256)
    raw = F.concat(F.base64(F.unhex(digest)), F.base64(F.unhex(more)))
    plain = F.regexp_replace(raw, "[+/=]", "")
    length = 20 + F.pmod("id", F.lit(21)).cast("int")
    styles = [F.substring(raw, F.lit(1), length), F.substring(plain, F.lit(1), length), digest, F.upper(F.substring(plain, F.lit(1), length))]
    value = F.element_at(F.array(*styles), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    random = spark.range(start, start + n).select(value.alias("value"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    parts = [pick(k) for k in range(5)]
    joined = [
        F.concat_ws("_", *parts),
        F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]),
        F.concat(*parts),
        F.upper(F.concat_ws("_", *parts)),
        F.concat(F.concat_ws("/", *parts[:4]), F.lit("-"), F.pmod("id", F.lit(100)).cast("string")),
    ]
    value = F.element_at(F.array(*joined), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    return random.unionAll(spark.range(start, start + n).select(value.alias("value"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, row by row of the alphabet; so many numbers reach the driver, whatever the samples' size."""
    size = len(ALPHABET)
    chars = F.split("value", "")
    code = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    codes = samples.where(F.col("value").isNotNull() & F.col("random").isNotNull()).select("random", F.filter(code, lambda c: c >= 0).alias("c"))
    pairs = F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda a, b: a * size + b)
    counted = codes.where(F.size("c") > 1).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    models = {True: [1] * size**2, False: [1] * size**2}
    for random, pair, n in counted.collect():
        models[random][pair] += n
    rows = {k: [sum(m[i * size : (i + 1) * size]) for i in range(size)] for k, m in models.items()}
    return [math.log(models[True][i] / rows[True][i // size]) - math.log(models[False][i] / rows[False][i // size]) for i in range(size**2)]


def ratio(value: Column, llr: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs; above 0 the random model is likelier."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    table = F.lit(llr)
    seen = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, a * len(ALPHABET) + b + 1))
    return F.aggregate(let(codes, seen), F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.length(value) - 1, F.lit(1))


def scan_secrets(docs: DataFrame, llr: list[float], threshold: float = 0.6) -> DataFrame:
    """``doc_id, spans`` for each row; spans are ``(start, kind, end, value)``, kind an index into ``KINDS`` or one past them."""
    own = len(KINDS)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", *[find(text, p, g, n, k).alias(name) for k, (name, p, g, n) in enumerate(KINDS)], find(text, CANDIDATE, 0, 20, own).alias("runs"))
    found = found.select("doc_id", F.concat(*[name for name, *_ in KINDS]).alias("base"), "runs")
    found = found.select("doc_id", "base", apart(F.col("runs"), F.col("base")).alias("runs"))
    likely = F.filter("runs", lambda r: ratio(r["value"], llr) >= threshold)
    return found.select("doc_id", F.sort_array(F.concat("base", F.when(F.size("runs") > 0, likely).otherwise(F.col("runs")))).alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(x) for x in (*[k[0] for k in KINDS], "markov")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
