"""Histograms filled from rows, as relations: bins with underflow and overflow, axes, totals, and profiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Class names by dimension, views, and how a profile's errors are made.
CLASSES = {False: ("TH1D", "TH2D", "TH3D"), True: ("TProfile", "TProfile2D", "TProfile3D")}
VIEWS = ("bins", "axes", "meta")
PROFILE_ERRORS = ("", "s", "i", "g")
#: Drawing attributes of an object that sets none.
AXIS_STYLE = {"axis_color": 1, "label_color": 1, "label_font": 42, "label_offset": 0.005, "label_size": 0.035, "title_color": 1, "title_font": 42, "title_offset": 1.0, "title_size": 0.035, "tick_length": 0.03, "ndivisions": 510}
STYLE = {"option": "", "draw_option": "", "line_color": 1, "line_style": 1, "line_width": 1, "fill_color": 0, "fill_style": 1001, "marker_color": 1, "marker_style": 1, "marker_size": 1.0}


@dataclass(frozen=True)
class Axis:
    """Equal bins from ``low`` to ``high``, or bins between ``edges``; ``labels`` name the first bins."""

    name: str
    bins: int = 0
    low: float = 0.0
    high: float = 0.0
    edges: tuple[float, ...] = ()
    title: str | None = None
    labels: tuple[str, ...] = ()
    time_format: str = ""

    def __post_init__(self):
        if self.edges:
            if list(self.edges) != sorted(set(self.edges)) or len(self.edges) < 2:
                raise ValueError("edges must rise")
            for name, x in (("bins", len(self.edges) - 1), ("low", self.edges[0]), ("high", self.edges[-1])):
                object.__setattr__(self, name, x)
        if self.bins < 1 or not self.low < self.high:
            raise ValueError(f"axis {self.name} has no bins")

    def bin_of(self, v: Column) -> Column:
        """0 below, 1..bins inside, bins + 1 at and above the upper end, where NaN counts as well; null stays null."""
        wide = v.cast("double")
        if self.edges:
            inside = sum((wide >= F.lit(float(e))).cast("int") for e in self.edges)
        else:
            inside = F.width_bucket(wide, F.lit(float(self.low)), F.lit(float(self.high)), F.lit(self.bins)).cast("int")
        return F.when(wide >= F.lit(float(self.high)), self.bins + 1).when(wide < F.lit(float(self.low)), 0).otherwise(inside)

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    def edge_of(self, b: Column) -> Column:
        """Lower edge of a bin; those outside are as wide as the mean bin."""
        even = F.lit(float(self.low)) + (b - 1) * F.lit(self.width)
        if not self.edges:
            return even
        return F.when((b >= 1) & (b <= self.bins + 1), F.get(F.array(*[F.lit(float(e)) for e in self.edges]), b - 1)).otherwise(even)

    def width_of(self, b: Column) -> Column:
        """A bin's width; those outside have the width of their neighbour."""
        held = F.least(F.greatest(b, F.lit(1)), F.lit(self.bins))
        return self.edge_of(held + 1) - self.edge_of(held) if self.edges else F.lit(self.width)

    def label_of(self, b: Column) -> Column:
        if not self.labels:
            return F.lit(None).cast("string")
        return F.when(b >= 1, F.get(F.array(*[F.lit(x) for x in self.labels]), b - 1))


@dataclass(frozen=True)
class Histogram:
    """What is filled from rows: one to three axes, a weight, and for a profile the column whose mean a bin holds."""

    path: str
    axes: tuple[Axis, ...]
    title: str = ""
    weight: str | None = None
    profile: str | None = None
    error_option: str = ""

    def __post_init__(self):
        if not 1 <= len(self.axes) <= 3:
            raise ValueError("a histogram has one to three axes")
        if self.error_option not in PROFILE_ERRORS:
            raise ValueError(f"unknown error option {self.error_option!r}")

    @property
    def class_name(self) -> str:
        return CLASSES[self.profile is not None][len(self.axes) - 1]

    @property
    def cells(self) -> int:
        return math.prod(a.bins + 2 for a in self.axes)

    def heading(self, *names: str) -> list[Column]:
        known = {"object_path": self.path, "object_name": self.path.strip("/").split("/")[-1], "object_title": self.title, "class_name": self.class_name, "dimension": len(self.axes)}
        return [F.lit(known[n]).alias(n) for n in names]


def bins(df: DataFrame, axes: list[Axis], weight: Column | None = None) -> DataFrame:
    """One row per cell, empty ones included: global_bin, bins by axis, content, error, entries."""
    spark, w = df.sparkSession, F.lit(1.0) if weight is None else weight
    names = ["x_bin", "y_bin", "z_bin"][: len(axes)]
    held = df.where(F.greatest(*[F.col(a.name).isNull().cast("int") for a in axes], F.lit(0)) == 0)
    filled = held.groupBy(*[a.bin_of(F.col(a.name)).alias(n) for a, n in zip(axes, names, strict=True)]).agg(F.sum(w).alias("content"), F.sum(w * w).alias("sumw2"), F.count("*").alias("entries"))
    spine, size = spark.range(1).select(), 1
    place = F.lit(0)
    for a, n in zip(axes, names, strict=True):
        spine = spine.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(a.bins + 1))))
        place = place + F.col(n) * size
        size *= a.bins + 2
    out = spine.join(filled, names, "left")
    edge = lambda n, a: (F.col(n) == 0, F.col(n) == a.bins + 1)
    under, over = F.lit(False), F.lit(False)
    for a, n in zip(axes, names, strict=True):
        under, over = under | edge(n, a)[0], over | edge(n, a)[1]
    return out.select(
        place.cast("int").alias("global_bin"), *names, under.alias("is_underflow"), over.alias("is_overflow"),
        F.coalesce("content", F.lit(0.0)).alias("content"), F.sqrt(F.coalesce("sumw2", F.lit(0.0))).alias("error"), F.coalesce("entries", F.lit(0)).cast("long").alias("entries"),
        *[x for a, n in zip(axes, names, strict=True) for x in ((F.lit(a.low) + (F.col(n) - 1) * F.lit(a.width)).alias(f"{n[0]}_low"), (F.lit(a.low) + F.col(n) * F.lit(a.width)).alias(f"{n[0]}_high"))],
    )


def axes_table(spark, axes: list[Axis]) -> DataFrame:
    rows = [(i + 1, "xyz"[i], a.title or a.name, a.bins, float(a.low), float(a.high), 1, a.bins) for i, a in enumerate(axes)]
    return spark.createDataFrame(rows, "axis_idx int, axis_name string, title string, nbins int, min double, max double, first_bin int, last_bin int")


def meta(df: DataFrame, axis: Axis) -> DataFrame:
    """Totals; moments over rows inside the axis only."""
    v = F.col(axis.name)
    inside = F.when((v >= axis.low) & (v < axis.high), v)
    return df.where(v.isNotNull()).agg(F.count("*").alias("entries"), F.count(inside).alias("entries_inside"), F.avg(inside).alias("mean_x"), F.stddev_pop(inside).alias("stddev_x"), F.skewness(inside).alias("skewness_x")).withColumn("x_nbins", F.lit(axis.bins))


def profile(df: DataFrame, axis: Axis, y: str) -> DataFrame:
    """Mean, spread and error of ``y`` in each filled bin."""
    held = df.where(F.col(axis.name).isNotNull() & F.col(y).isNotNull()).groupBy(axis.bin_of(F.col(axis.name)).alias("x_bin"))
    out = held.agg(F.count("*").alias("profile_entries"), F.avg(y).alias("content"), F.stddev_pop(y).alias("spread"))
    return out.withColumn("error", F.col("spread") / F.sqrt("profile_entries"))


def names_of(path: str, known: dict[str, Histogram]) -> tuple[Histogram, str]:
    """The histogram and the view that a path names: an object's own path means its bins; an exact name goes before a suffix."""
    path = "/" + path.strip("/")
    if path in known:
        return known[path], "bins"
    parent, _, view_name = path.rpartition("/")
    if view_name in VIEWS and parent in known:
        return known[parent], view_name
    raise KeyError(f"no histogram {path}")


def read(inputs: list[DataFrame], path: str, known: list[Histogram]) -> DataFrame:
    """A view of one histogram of one input; several inputs are an error, as their cells would have to be added."""
    if len(inputs) != 1:
        raise ValueError("a histogram is read from one input")
    h, which = names_of(path, {x.path: x for x in known})
    return {"bins": bins_view, "axes": axes_view, "meta": meta_view}[which](inputs[0], h)


def filled(df: DataFrame, h: Histogram) -> DataFrame:
    """Cells that hold rows. Rows with a null on an axis, as weight or as a profile's value take no part; partial sums are combined before the shuffle."""
    w = F.lit(1.0) if h.weight is None else F.col(h.weight).cast("double")
    rows = df.select(*[a.bin_of(F.col(a.name)).alias(f"{n}_bin") for a, n in zip(h.axes, "xyz", strict=False)], w.alias("_w"), (F.lit(0.0) if h.profile is None else F.col(h.profile).cast("double")).alias("_y")).dropna()
    y, wy = F.col("_y"), F.col("_w") * F.col("_y")
    spread = F.stddev_pop(y) if h.weight is None else F.sqrt(F.greatest(F.sum(wy * y) / F.sum("_w") - F.pow(F.sum(wy) / F.sum("_w"), F.lit(2)), F.lit(0.0)))
    keys = [f"{n}_bin" for _, n in zip(h.axes, "xyz", strict=False)]
    return rows.groupBy(*keys).agg(F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_w")).alias("_sw2"), F.count("*").alias("_n"), (F.sum(wy) / F.sum("_w")).alias("_mean"), spread.alias("_spread"))


def inside(h: Histogram) -> Column:
    out = F.lit(True)
    for a, n in zip(h.axes, "xyz", strict=False):
        out = out & F.col(f"{n}_bin").between(1, a.bins)
    return out


def totals(cells: DataFrame, h: Histogram) -> DataFrame:
    """One row of an object's figures, made of its cells; weights count in cells inside only, entries in all."""
    of = lambda column, where: F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0.0))
    sums = [F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("entries"), of("_sw", inside(h)).alias("sum_weights"), of("_sw2", inside(h)).alias("_all2")]
    for a, n in zip(h.axes, "xyz", strict=False):
        sums += [of("_sw", F.col(f"{n}_bin") == 0).alias(f"{n}_underflow"), of("_sw", F.col(f"{n}_bin") == a.bins + 1).alias(f"{n}_overflow")]
    out = cells.agg(*sums)
    return out.withColumn("effective_entries", F.when(F.col("_all2") > 0, F.col("sum_weights") * F.col("sum_weights") / F.col("_all2")).otherwise(0.0))


def content_and_error(h: Histogram) -> tuple[Column, Column]:
    if h.profile is None:
        return F.coalesce("_sw", F.lit(0.0)), F.sqrt(F.coalesce("_sw2", F.lit(0.0)))
    effective = F.col("_sw") * F.col("_sw") / F.col("_sw2")
    mean_error = F.col("_spread") / F.sqrt(effective)
    error = {
        "": mean_error,
        "s": F.col("_spread"),
        "i": F.when(F.col("_spread") > 0, mean_error).otherwise(1 / F.sqrt(12 * effective)),
        "g": 1 / F.sqrt("_sw"),
    }[h.error_option]
    return F.coalesce("_mean", F.lit(0.0)), F.coalesce(error, F.lit(0.0))


def spine(spark, h: Histogram) -> DataFrame:
    """A row per cell, made of its number."""
    rows, size = spark.range(h.cells).withColumnRenamed("id", "global_bin"), 1
    for a, n in zip(h.axes, "xyz", strict=False):
        rows = rows.withColumn(f"{n}_bin", F.expr(f"cast((global_bin div {size}) % {a.bins + 2} as int)"))
        size *= a.bins + 2
    return rows.withColumn("global_bin", F.col("global_bin").cast("int"))


def bins_view(df: DataFrame, h: Histogram) -> DataFrame:
    """44 columns, a row per cell with those outside; columns of an axis that the histogram lacks are null."""
    keys = [f"{n}_bin" for _, n in zip(h.axes, "xyz", strict=False)]
    cells = filled(df, h)
    rows = spine(df.sparkSession, h).join(cells, keys, "left").crossJoin(F.broadcast(totals(cells, h)))
    none = lambda kind: F.lit(None).cast(kind)
    content, error = content_and_error(h)
    under, over = F.lit(False), F.lit(False)
    places, flows = [], []
    for i, n in enumerate("xyz"):
        names = [f"{n}_{x}" for x in ("low", "high", "center", "width", "label")]
        if i >= len(h.axes):
            places += [none("string" if x.endswith("label") else "double").alias(x) for x in names]
            flows += [none("double").alias(f"{n}_{x}") for x in ("underflow", "overflow")]
            continue
        a, b = h.axes[i], F.col(f"{n}_bin")
        under, over = under | (b == 0), over | (b == a.bins + 1)
        low, width = a.edge_of(b), a.width_of(b)
        places += [x.alias(name) for x, name in zip((low, low + width, low + width / 2, width, a.label_of(b)), names, strict=True)]
        flows += [F.col(f"{n}_{x}") for x in ("underflow", "overflow")]
    profile = h.profile is not None
    effective = F.when(F.col("_sw2") > 0, F.col("_sw") * F.col("_sw") / F.col("_sw2")).otherwise(0.0)
    second = F.coalesce("_sw2", F.lit(0.0)) if h.weight else none("double")
    return rows.select(
        *h.heading("object_path", "object_name", "object_title", "class_name", "dimension"),
        "global_bin", *[F.col(f"{n}_bin") if i < len(h.axes) else none("int").alias(f"{n}_bin") for i, n in enumerate("xyz")],
        under.alias("is_underflow"), over.alias("is_overflow"), *places,
        content.alias("content"), error.alias("error"), error.alias("error_low"), error.alias("error_high"), (none("double") if profile else second).alias("sumw2_raw"),
        (F.coalesce("_sw", F.lit(0.0)) if profile else none("double")).alias("profile_entries"), (effective if profile else none("double")).alias("profile_effective_entries"),
        (second if profile else none("double")).alias("profile_bin_sumw2_raw"), (F.lit(h.error_option) if profile else none("string")).alias("profile_error_option"),
        "entries", "effective_entries", "sum_weights", *flows,
    )


def axes_view(df: DataFrame, h: Histogram) -> DataFrame:
    """27 columns, a row per axis; drawing attributes are those of an object that sets none."""
    head = ["object_path", "object_name", "class_name", "dimension"]
    rows = [
        (i + 1, "xyz"[i], a.title or a.name, a.bins, float(a.low), float(a.high), 1, a.bins, bool(a.edges), bool(a.time_format), a.time_format, bool(a.labels))
        for i, a in enumerate(h.axes)
    ]
    made = df.sparkSession.createDataFrame(rows, "axis_idx int, axis_name string, title string, nbins int, min double, max double, first_bin int, last_bin int, variable_bins boolean, time_display boolean, time_format string, labels_present boolean")
    return made.select(*h.heading(*head), *made.columns, *[F.lit(x).alias(n) for n, x in AXIS_STYLE.items()])


def moments(df: DataFrame, h: Histogram) -> DataFrame:
    """One row: weighted mean, spread, skewness and excess kurtosis by axis with errors, over rows inside all axes, summed about each axis's middle."""
    rows = df.withColumn("_w", F.lit(1.0) if h.weight is None else F.col(h.weight).cast("double"))
    held = rows.where(F.col("_w").isNotNull() & (F.lit(True) if h.profile is None else F.col(h.profile).isNotNull()))
    for a, n in zip(h.axes, "xyz", strict=False):
        held = held.withColumn(f"_{n}", F.col(a.name).cast("double") - F.lit((a.low + a.high) / 2)).where(a.bin_of(F.col(a.name)).between(1, a.bins))
    sums = [F.sum("_w").alias("_s0"), F.sum(F.col("_w") * F.col("_w")).alias("_s2")]
    for _, n in zip(h.axes, "xyz", strict=False):
        sums += [(F.sum(F.col("_w") * F.pow(F.col(f"_{n}"), F.lit(k))) / F.sum("_w")).alias(f"_{n}{k}") for k in (1, 2, 3, 4)]
    out, effective = held.agg(*sums), F.col("_s0") * F.col("_s0") / F.col("_s2")
    columns = []
    for i, n in enumerate("xyz"):
        names = [f"{x}_{n}" for x in ("mean", "mean_error", "stddev", "stddev_error", "skewness", "kurtosis")]
        if i >= len(h.axes):
            columns += [F.lit(None).cast("double").alias(x) for x in names]
            continue
        a = h.axes[i]
        m, m2, m3, m4 = (F.col(f"_{n}{k}") for k in (1, 2, 3, 4))
        var = F.greatest(m2 - m * m, F.lit(0.0))
        dev = F.sqrt(var)
        third = m3 - 3 * m * m2 + 2 * m * m * m
        fourth = m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m
        whole = (m + F.lit((a.low + a.high) / 2), dev / F.sqrt(effective), dev, dev / F.sqrt(2 * effective), F.when(var > 0, third / (var * dev)).otherwise(0.0), F.when(var > 0, fourth / (var * var) - 3).otherwise(0.0))
        columns += [F.coalesce(x, F.lit(0.0)).alias(name) for x, name in zip(whole, names, strict=True)]
    return out.select(*columns)


def meta_view(df: DataFrame, h: Histogram) -> DataFrame:
    """58 columns in one row; what only a stored object has (its size) is null."""
    cells = filled(df, h)
    content, _ = content_and_error(h)
    extremes = spine(df.sparkSession, h).join(cells, [f"{n}_bin" for _, n in zip(h.axes, "xyz", strict=False)], "left").where(inside(h)).agg(F.min(content).alias("minimum"), F.max(content).alias("maximum"))
    rows = totals(cells, h).crossJoin(extremes).crossJoin(moments(df, h))
    profile = h.profile is not None
    lit = lambda **named: [F.lit(x).alias(n) for n, x in named.items()]
    return rows.select(
        *h.heading("object_path", "object_name", "object_title", "class_name", "dimension"), *lit(is_profile=profile),
        "entries", "effective_entries", "sum_weights", *lit(n_cells=h.cells, has_sumw2=h.weight is not None, sumw2_size=h.cells if h.weight else 0, norm_factor=0.0),
        "minimum", "maximum", *lit(minimum_stored=-1111.0, maximum_stored=-1111.0),
        *[f"{x}_{n}" for n in "xyz" for x in ("mean", "mean_error", "stddev", "stddev_error", "skewness", "kurtosis")],
        *lit(bin_error_option="normal", stat_overflows="neutral", can_extend_all_axes=False, **STYLE, buffer_size=0, buffer_length=0, unique_id=0),
        F.lit(None).cast("long").alias("object_size_bytes"), *lit(function_count=0, functions=""),
        (F.lit(h.error_option) if profile else F.lit(None).cast("string")).alias("profile_error_option"),
        *[(F.lit(h.axes[i].bins) if i < len(h.axes) else F.lit(None).cast("int")).alias(f"{n}_nbins") for i, n in enumerate("xyz")],
    )
