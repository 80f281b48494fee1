"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone. Trees are grown on binned statistics with gradient and hessian histograms,
then flattened into arrays in heap order (feature, threshold, leaf value), so that all rows pass through all trees
as numpy indexing, one step per level. Training uses a bounded sample of labelled rows, those of the smallest
hashed ids; every row of every text is scored.

Cases: a null text counts as empty; empty texts get the statistics of no words and a score like any other; texts
are read whole; repeated rows are kept with equal scores; labels that are null or repeated are dropped or taken at
their smallest; an empty table gives an empty result; without labels of both kinds the score is the base rate;
other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that training may use.
SAMPLE_ROWS = 16_000
#: Frequent words of four languages.
COMMON = frozenset(
    b"the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    b"der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    b"de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec "
    b"que el y los del se las por un para con no una su al lo como mas pero sus le ya o este si porque".split()
)
STATISTICS = (
    "log_chars log_words word_length word_length_sd upper lower digit space newline beyond_ascii symbols bang bar stops commas quotes brackets slashes "
    "distinct_words top_word distinct_pairs top_pair common_words odd_words capital_words upper_words long_words short_words lines line_length distinct_lines short_lines ended_lines top_line"
).split()


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda chars: float(held[np.frombuffer(chars, np.uint8)].sum()) / size
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    n_pairs = max(1, len(words) - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    line_counts = Counter(lines)
    forms = list(counts.items())
    weigh = lambda test: sum(c for w, c in forms if test(w)) / n
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), held[65:91].sum() / size, held[97:123].sum() / size, held[48:58].sum() / size,
        held[32] / size, held[10] / size, held[128:].sum() / size, share(b"#$%&*@^~=+_"), share(b"!"), share(b"|"), share(b".?"), share(b",;:"), share(b"\"'`"), share(b"()[]{}<>"), share(b"/\\"),
        len(counts) / n, max(counts.values(), default=0) / n, len(pairs) / n_pairs, max(pairs.values(), default=0) / n_pairs,
        weigh(lambda w: w.lower() in COMMON), weigh(lambda w: not w.strip(b".,;:!?\"'()").isalpha() and w.isascii()), weigh(lambda w: w[:1].isupper()), weigh(lambda w: len(w) > 1 and w.isupper()),
        float((lengths > 14).mean()), float((lengths < 3).mean()), np.log1p(len(lines)), len(raw) / n_lines / 100, len(line_counts) / n_lines,
        sum(len(x) < 30 for x in lines) / n_lines, sum(x.rstrip()[-1:] in b".?!" for x in lines) / n_lines, max(line_counts.values(), default=0) / n_lines,
    ]


@dataclass
class Forest:
    """Complete trees of one depth in heap order: ``feature`` and ``threshold`` are trees x (2^depth - 1), ``leaf`` trees x 2^depth."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        while inner and node[0, 0] < inner if len(x) and trees else False:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + (self.leaf[tree, node - inner].sum(1) if trees else np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Fit log loss by Newton boosting over histograms of ``bins`` quantile bins."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    columns = x.shape[1]
    edges = [np.unique(np.quantile(x[:, c], np.arange(1, bins) / bins)) for c in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(columns) * bins
    margin = np.full(len(y), base)
    out = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (columns * bins) + flat).ravel()
            shape = (wide, columns, bins)
            g = np.bincount(at, np.repeat(grad, columns), minlength=np.prod(shape)).reshape(shape).cumsum(2)
            h = np.bincount(at, np.repeat(hess, columns), minlength=np.prod(shape)).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least) | (h_all - h < least)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for k in range(wide):
                column, cut = divmod(int(best[k]), bins)
                if gain[k, column, cut] > 1e-9 and cut < len(edges[column]):
                    out.feature[t, first + k], out.threshold[t, first + k] = column, edges[column][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, minlength=leaves) / (np.bincount(leaf, hess, minlength=leaves) + ridge)
        out.leaf[t] = value
        margin += value[leaf]
    return out


def with_vector(docs: DataFrame, function, column: str, *, text: str = "text", kind: str = "array<double>", arrow: pa.DataType | None = None) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and ``function(list of texts)`` as ``column``."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*wrapped.select("row").schema, T.StructField(column, T._parse_datatype_string(kind))])
    arrow = arrow or pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(function(some.column("text").to_pylist()), arrow)], names=["row", column])

    return wrapped.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Forest:
    """Train on at most ``rows`` labelled rows of ``labels``, those of the smallest hashed ids."""
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    seen = with_vector(held, lambda texts: [statistics(t) for t in texts], "x").select("row.doc_id", "row.label", "x")
    sample = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
    x = np.array([r.x for r in sample], dtype=np.float64).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r.label for r in sample], dtype=np.float64))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and ``score``."""

    def run(texts: list) -> np.ndarray:
        return forest.score(np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS)))

    return with_vector(docs, run, "score", kind="double", arrow=pa.float64())


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without documents that score below ``least``; the same columns."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= least).select("row.*")
