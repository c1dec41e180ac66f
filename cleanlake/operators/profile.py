"""Profiling: table and column statistics from a few wide aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, datetime_columns, dbl, numeric_columns, roles, share, small_frame, text_columns, written
from cleanlake.functions.normal import inverse_normal
from cleanlake.functions.parsing import as_boolean, as_date_auto, as_number, as_number_clean
from cleanlake.operators import ordered
from cleanlake.operators.quantiles import exact_quantiles
from cleanlake.operators.skew import skew_join


# ---------------------------------------------------------------- moments

def skew_sample(x: Column) -> Column:
    """Bias-corrected skewness (null below three values or without spread)."""
    n = F.count(x).cast("double")
    return F.when((F.count(x) > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_sample(x: Column) -> Column:
    """Bias-corrected excess kurtosis (null below four values or without spread)."""
    n = F.count(x).cast("double")
    return F.when((F.count(x) > 3) & (F.stddev_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def _pop(x: Column, f) -> Column:
    return F.when(F.stddev_pop(x) > 0, f(x))


def _melt(aggs: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a struct per column -> one row per column."""
    return aggs.select(F.inline(F.array(*[c(x) for x in columns])))


def per_column(df: DataFrame, columns: list[str], make) -> DataFrame:
    """One aggregate job for all columns; make(name) lists the aggregate columns of one of them."""
    return _melt(df.agg(*[F.struct(F.lit(x).alias("column"), *make(x)).alias(x) for x in columns]), columns)


# ---------------------------------------------------------------- profile object

@dataclass
class ColumnProfile:
    column: str
    dtype: str
    role: str
    rows: int = 0
    nulls: int = 0
    unique: int | None = None
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    skew: float | None = None
    kurt: float | None = None
    skew_pop: float | None = None
    kurt_pop: float | None = None
    zeros: int = 0
    negatives: int = 0
    quartiles: list = field(default_factory=list)
    outliers: int = 0
    numeric_ok: int = 0
    clean_ok: int = 0
    date_ok: int = 0
    bool_ok: int = 0

    @property
    def known(self) -> int:
        return self.rows - self.nulls

    @property
    def null_pct(self) -> float:
        return 100.0 * self.nulls / self.rows if self.rows else 0.0

    @property
    def outlier_pct(self) -> float:
        return 100.0 * self.outliers / self.known if self.known else 0.0


def iqr_fences(quartiles: list, factor: float = 1.5) -> tuple[float, float] | None:
    q1, q3 = quartiles[0], quartiles[-1]
    if q1 is None:
        return None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def outside(col: Column, fences: tuple[float, float] | None) -> Column:
    if fences is None:
        return F.lit(False)
    return F.coalesce((col < F.lit(fences[0])) | (col > F.lit(fences[1])), F.lit(False))


def profile(df: DataFrame, *, unique: bool = True, quantiles: bool = True, outliers: bool = True, parse: bool = True,
            approx: bool = False) -> list[ColumnProfile]:
    """Profile of every column: one aggregate job, plus one each for distinct counts, quartiles and outlier counts.

    Only one row per column reaches the driver. approx=True counts distinct values with a sketch.
    """
    role_of = {x: r for r, xs in roles(df).items() for x in xs}
    distinct = F.approx_count_distinct if approx else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, x in enumerate(df.columns):
        parts = [F.count(c(x)).alias("known")]
        if role_of[x] == "numeric":
            v = dbl(x)
            parts += [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                      skew_sample(v).alias("skew"), kurt_sample(v).alias("kurt"), _pop(v, F.skewness).alias("skew_pop"),
                      _pop(v, F.kurtosis).alias("kurt_pop"), count_if(v == 0).alias("zeros"), count_if(v < 0).alias("negatives")]
        if role_of[x] == "text" and parse:
            parts += [F.count(as_number(c(x))).alias("numeric_ok"), F.count(as_number_clean(c(x))).alias("clean_ok"),
                      F.count(as_date_auto(c(x))).alias("date_ok"), F.count(as_boolean(c(x))).alias("bool_ok")]
        aggs.append(F.struct(*parts).alias(f"c{i}"))
    row = df.agg(*aggs).first()
    out = []
    for i, f in enumerate(df.schema.fields):
        r = row[f"c{i}"].asDict()
        p = ColumnProfile(f.name, f.dataType.simpleString(), role_of[f.name], row["rows"], row["rows"] - r.pop("known"))
        for k, v in r.items():
            setattr(p, k, v)
        out.append(p)
    if unique:
        # apart from the rest: exact distinct counts expand every row once per column
        counted = [p for p in out if p.role != "other"]
        row = df.agg(*[distinct(c(p.column)).alias(f"c{i}") for i, p in enumerate(counted)]).first()
        for i, p in enumerate(counted):
            p.unique = row[f"c{i}"]
    nums = [p for p in out if p.role == "numeric"]
    if nums and (quantiles or outliers):
        qs = exact_quantiles(df, [p.column for p in nums], [0.25, 0.5, 0.75])
        for p in nums:
            p.quartiles = qs[p.column]
        if outliers:
            cnt = df.agg(*[count_if(outside(dbl(p.column), iqr_fences(p.quartiles))).alias(f"c{i}")
                           for i, p in enumerate(nums)]).first()
            for i, p in enumerate(nums):
                p.outliers = cnt[f"c{i}"]
    return out


def distinct_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per distinct combination with its number of rows (`rows`); combined map-side."""
    cols = columns or df.columns
    return df.groupBy(*[c(x) for x in cols]).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> int:
    return distinct_groups(df, columns).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0))).first()[0]


def most_frequent(df: DataFrame, column: str):
    """Most frequent known value, ties to the smallest. Counted by value first: the mode aggregate keeps all values in one task."""
    top = (df.where(c(column).isNotNull()).groupBy(c(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "v").head(1))
    return top[0]["v"] if top else None


# ---------------------------------------------------------------- tables of statistics

def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    types = dict(df.dtypes)
    t = per_column(df, df.columns, lambda x: [
        F.lit(types[x]).alias("type"), F.count(F.lit(1)).alias("rows"), F.count(c(x)).alias("non_null"), distinct(c(x)).alias("unique")])
    return t.select("column", "type", "non_null", (F.col("rows") - F.col("non_null")).alias("nulls"),
                    share(F.col("rows") - F.col("non_null"), F.col("rows")).alias("null_pct"), "unique",
                    share(F.col("unique"), F.col("rows")).alias("unique_pct"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    cols = columns or numeric_columns(df)
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    lit = lambda v: F.lit(v).cast("double")
    return per_column(df, cols, lambda x: [
        F.count(dbl(x)).alias("count"), F.avg(dbl(x)).alias("mean"), F.stddev_samp(dbl(x)).alias("std"), F.min(dbl(x)).alias("min"),
        lit(qs[x][0]).alias("q25"), lit(qs[x][1]).alias("q50"), lit(qs[x][2]).alias("q75"), F.max(dbl(x)).alias("max")])


def skew_label(s: Column) -> Column:
    return F.when(F.abs(s) < 0.5, "symmetric").when(F.abs(s) < 1, "moderate").when(s.isNotNull(), "high")


def shape(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or numeric_columns(df)
    t = per_column(df, cols, lambda x: [skew_sample(dbl(x)).alias("skew"), kurt_sample(dbl(x)).alias("kurt")])
    return t.withColumn("label", skew_label(F.col("skew")))


def shape_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    t = shape(df, columns).agg(F.avg("skew").alias("avg_skew"), F.avg("kurt").alias("avg_kurt"), F.avg(F.abs("skew")).alias("avg_abs_skew"))
    return t.withColumn("label", skew_label(F.col("avg_skew")))


def shape_population(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or numeric_columns(df)
    med = exact_quantiles(df, cols, [0.5])
    t = per_column(df, cols, lambda x: [
        F.avg(dbl(x)).alias("mean"), F.lit(med[x][0]).cast("double").alias("median"), F.stddev_samp(dbl(x)).alias("std"),
        _pop(dbl(x), F.skewness).alias("skew"), _pop(dbl(x), F.kurtosis).alias("kurt")])
    return (t.withColumn("skew_label", F.when(F.col("skew") > 0, "right").when(F.col("skew") < 0, "left").otherwise("symmetric"))
            .withColumn("tail_label", F.when(F.col("kurt") > 0, "heavy").when(F.col("kurt") < 0, "light").otherwise("normal")))


def _null_cells(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.count(F.lit(1)) - F.count(c(x)) for x in cols], F.lit(0).cast("long"))


def quality_summary(df: DataFrame) -> DataFrame:
    r = roles(df)
    dup = duplicate_count(df)
    n_cols = len(df.columns)
    t = df.agg(F.count(F.lit(1)).alias("rows"), _null_cells(df.columns).alias("missing_cells"))
    return t.select("rows", F.lit(n_cols).cast("long").alias("columns"), "missing_cells",
                    share(F.col("missing_cells"), F.col("rows") * n_cols).alias("missing_pct"),
                    F.lit(dup).cast("long").alias("duplicates"),
                    *[F.lit(len(r[k])).cast("long").alias(f"{k}_columns") for k in ("numeric", "text", "datetime")])


def completeness(df: DataFrame) -> DataFrame:
    nums = numeric_columns(df)
    t = df.agg(F.count(F.lit(1)).alias("n"), _null_cells(df.columns).alias("m"), _null_cells(nums).alias("mn"))
    full = lambda miss, k: F.lit(100.0) - share(F.col(miss), F.col("n") * k)
    t = t.select(full("m", len(df.columns)).alias("completeness"), (full("mn", len(nums)) if nums else F.lit(0.0)).alias("numeric_completeness"))
    return t.withColumn("label", F.when(F.col("completeness") > 95, "excellent").when(F.col("completeness") > 80, "good").otherwise("attention"))


def known_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Known values per column, from one aggregate."""
    return df.agg(*[F.count(c(x)).alias(x) for x in columns]).first().asDict() if columns else {}


def dtype_counts(df: DataFrame) -> DataFrame:
    """Columns and known values per type."""
    known = known_counts(df, df.columns)
    t = small_frame(df.sparkSession, [(t, known[x]) for x, t in df.dtypes], "type string, known long")
    return t.groupBy("type").agg(F.count(F.lit(1)).alias("columns"), F.sum("known").alias("known_values"))


# fixed values: name fragments that mark an engineered column, by kind
ENGINEERED = {
    "scaled": ["_scaled"], "polynomial": ["poly_"], "interactions": ["_x_", "interaction"], "binned": ["_binned", "_bin_"],
    "encoded": ["_encoded"], "pca": ["pca_"], "mathematical": ["_sqrt", "_log", "_sq", "_exp"], "aggregated": ["agg_"],
}


def engineered_census(df: DataFrame) -> DataFrame:
    """Engineered columns by kind: number, share of all columns, known values."""
    found = {k: [x for x in df.columns if any(part in x for part in v)] for k, v in ENGINEERED.items()}
    known = known_counts(df, sorted({x for xs in found.values() for x in xs}))
    rows = [(k, len(xs), 100.0 * len(xs) / len(df.columns), sum(known[x] for x in xs)) for k, xs in found.items() if xs]
    return small_frame(df.sparkSession, rows, "category string, columns long, pct double, known_values long")


def value_counts_topk(df: DataFrame, column: str, k: int = 10, approx: bool = False) -> DataFrame:
    """The k most frequent values; ties by value. approx=True keeps one bounded sketch instead of a full count."""
    if approx:
        t = df.agg(F.expr(f"approx_top_k({'`' + column + '`'}, {k})").alias("t")).select(F.inline("t"))
        return t.select(F.col("item").alias("value"), F.col("count").alias("rows"))
    t = df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return t.orderBy(F.col("rows").desc(), "value").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins, left-closed, the last one closed; empty bins are listed."""
    x = dbl(column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return small_frame(spark, [], "bin long, low double, high double, rows long")
    width = (hi - lo) / bins
    code = F.least(F.floor((x - lo) * bins / F.lit(hi - lo)), F.lit(bins - 1)) if hi > lo else F.lit(0)
    got = df.where(x.isNotNull()).groupBy(code.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    edges = spark.range(bins).select(F.col("id").alias("bin"), (lo + F.col("id") * width).alias("low"), (lo + (F.col("id") + 1) * width).alias("high"))
    return edges.join(F.broadcast(got), "bin", "left").select("bin", "low", "high", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or numeric_columns(df)
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    def make(x):
        fences = iqr_fences(qs[x])
        inside = F.when(~outside(dbl(x), fences), dbl(x))
        lit = lambda v: F.lit(v).cast("double")
        return [lit(qs[x][0]).alias("q1"), lit(qs[x][1]).alias("median"), lit(qs[x][2]).alias("q3"),
                lit(fences and fences[0]).alias("lower_fence"), lit(fences and fences[1]).alias("upper_fence"),
                F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), count_if(outside(dbl(x), fences)).alias("outliers")]
    return per_column(df, cols, make)


def qq_points(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Normal Q-Q plot in at most `points` quantiles: Filliben positions against the ordered sample."""
    n = df.where(dbl(column).isNotNull()).count()
    m = min(points, n)
    if m == 0:
        return small_frame(df.sparkSession, [], "position double, theoretical double, ordered double")
    pos = [0.5 ** (1 / m) if i == m else 1 - 0.5 ** (1 / m) if i == 1 else (i - 0.3175) / (m + 0.365) for i in range(1, m + 1)]
    probs = [(i / (m - 1)) if m > 1 else 0.5 for i in range(m)]
    vals = exact_quantiles(df, [column], probs)[column]
    return small_frame(df.sparkSession, list(zip(pos, inverse_normal(np.array(pos)).tolist(), vals)), "position double, theoretical double, ordered double")


# ---------------------------------------------------------------- missingness patterns

def missing_matrix(df: DataFrame, order_by: list[str], buckets: int = 50, columns: list[str] | None = None) -> DataFrame:
    """Null share per (row bucket, column); rows are bucketed by their position in the order."""
    cols = columns or [x for x in df.columns if x not in order_by]
    flags = df.select(*[c(o) for o in order_by], *[c(x).isNull().cast("tinyint").alias("f_" + x) for x in cols])
    n = df.count()
    idx = ordered.with_index(flags, order_by, "__i")
    t = idx.groupBy(F.floor(F.col("__i") * buckets / F.lit(max(n, 1))).cast("long").alias("bucket")).agg(
        *[F.struct(F.lit(x).alias("column"), F.avg(c("f_" + x)).alias("null_share")).alias(x) for x in cols])
    return t.select("bucket", F.inline(F.array(*[c(x) for x in cols])))


def missing_corr(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or df.columns
    return _pair_corr(df, {x: c(x).isNull().cast("double") for x in cols}).where("corr IS NOT NULL")


def missing_per_row(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    k = reduce(lambda a, b: a + b, [c(x).isNull().cast("long") for x in (columns or df.columns)])
    return df.groupBy(k.alias("missing")).agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- correlation

PAIRS_JVM = 10      # up to so many columns the pairs are expressions of one aggregate; more go by blocks of co-moments


def _pair_corr(df: DataFrame, values: dict[str, Column], most: int = PAIRS_JVM) -> DataFrame:
    """left, right, corr of every pair of columns (double, null: missing), pairwise complete, in one pass over the rows.

    The number of pairs grows with the square of the columns, and so would an aggregate with one expression per pair. Beyond `most` columns each
    task therefore adds up matrices of counts, sums and products of its rows, and only their cells are shuffled: one row per pair and task.
    """
    names = list(values)
    if len(names) <= most:
        pairs = list(combinations(names, 2))
        aggs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), _safe_corr(values[a], values[b]).alias("corr")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
        return _melt(df.agg(*aggs), [f"p{i}" for i in range(len(pairs))])
    shift = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())]).first()
    rows = df.select(*[(v - F.lit(shift[f"m{i}"] or 0.0)).alias(f"x{i}") for i, v in enumerate(values.values())])
    fields = ["n", "a", "b", "aa", "bb", "ab"]
    cells = rows.mapInArrow(_moments(len(names)), "i int, j int, " + ", ".join(f"{f} double" for f in fields))
    t = cells.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields])
    spread = F.sqrt(F.greatest(F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.lit(0.0)) * F.greatest(F.col("bb") - F.col("b") * F.col("b") / F.col("n"), F.lit(0.0)))
    flat = spread <= F.lit(1e-12) * F.sqrt(F.col("aa") * F.col("bb"))
    corr = F.when(~flat, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / spread)
    named = F.array(*[F.lit(x) for x in names])
    return t.select(F.element_at(named, F.col("i") + 1).alias("left"), F.element_at(named, F.col("j") + 1).alias("right"), F.when(F.col("n") > 0, corr).alias("corr"))


def _moments(d: int):
    """Per task: pairwise complete counts, sums, squares and products of d columns, one row per pair."""
    def run(batches):
        sums = np.zeros((6, d, d))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]).astype(float)
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x, 0.0)
            a, aa = x.T @ known, (x * x).T @ known
            sums += np.stack([known.T @ known, a, a.T, aa, aa.T, x.T @ x])
        i, j = np.triu_indices(d, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(m[i, j]) for m in sums]], names=["i", "j", "n", "a", "b", "aa", "bb", "ab"])
    return run


def _safe_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation; null without spread (the built-in divides by zero there)."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def corr_pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Upper triangle (left, right, corr), pairwise complete; null without spread."""
    return _pair_corr(df, {x: dbl(x) for x in columns or numeric_columns(df)})


def corr_matrix(upper: DataFrame, columns: list[str]) -> DataFrame:
    """Full matrix in long form from the upper triangle."""
    low = upper.select(F.col("right").alias("left"), F.col("left").alias("right"), "corr")
    diag = small_frame(upper.sparkSession, [(x, x, 1.0) for x in columns], "left string, right string, corr double")
    return upper.unionByName(low).unionByName(diag)


def _cell_ranks(cells: DataFrame) -> DataFrame:
    """cells (row, grp, v) with the average rank of v within its group: ranked over distinct values of all groups in one pass, joined back with salting."""
    counts = cells.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("rows"))
    below = ordered.running_sum(counts, {"__below": "rows"}, ["v"], inclusive=False, partition_by=["grp"])
    ranks = below.select("grp", "v", (F.col("__below") + (F.col("rows") + 1) / 2).alias("rank"))
    return skew_join(cells, ranks, ["grp", "v"], "inner", counts=counts, count_col="rows", right_unique=True)


def corr_spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of average ranks, pairwise complete.

    All columns are melted, ranked in one pass and put together again by row, so the number of shuffles does not grow with the columns. Columns with
    nulls are ranked once per pair, among the rows that know both, likewise all pairs at once.
    """
    cols = columns or numeric_columns(df)
    base = written(df.select(*[dbl(x).alias(f"x{i}") for i, x in enumerate(cols)]).withColumn("row", F.monotonically_increasing_id()), "spearman-rows")
    gaps = base.agg(*[F.count(F.when(F.col(f"x{i}").isNull(), 1)).alias(f"x{i}") for i in range(len(cols))]).first()
    whole = [i for i in range(len(cols)) if not gaps[f"x{i}"]]
    rest = [(i, j) for i, j in combinations(range(len(cols)), 2) if gaps[f"x{i}"] or gaps[f"x{j}"]]
    out = []
    if len(whole) > 1:
        cells = base.select("row", F.inline(F.array(*[F.struct(F.lit(i).alias("grp"), F.col(f"x{i}").alias("v")) for i in whole])))
        ranked = _cell_ranks(cells).groupBy("row").agg(*[F.max(F.when(F.col("grp") == i, F.col("rank"))).alias(f"r{i}") for i in whole])
        out.append(_pair_corr(ranked, {cols[i]: F.col(f"r{i}") for i in whole}))
    if rest:
        side = lambda p, k, x: F.struct(F.lit(2 * p + k).alias("grp"), F.col(f"x{x}").alias("v"))
        both = lambda p, i, j: F.when(F.col(f"x{i}").isNotNull() & F.col(f"x{j}").isNotNull(), F.array(side(p, 0, i), side(p, 1, j))).otherwise(F.filter(F.array(side(p, 0, i)), lambda _: F.lit(False)))
        cells = base.select("row", F.inline(F.concat(*[both(p, i, j) for p, (i, j) in enumerate(rest)])))
        pair = F.floor(F.col("grp") / 2).cast("int")
        ranked = _cell_ranks(cells).groupBy("row", pair.alias("pair")).agg(*[F.max(F.when(F.col("grp") % 2 == k, F.col("rank"))).alias(f"r{k}") for k in (0, 1)])
        corr = ranked.groupBy("pair").agg(_safe_corr(F.col("r0"), F.col("r1")).alias("corr"))
        named = small_frame(df.sparkSession, [(p, cols[i], cols[j]) for p, (i, j) in enumerate(rest)], "pair int, left string, right string")
        out.append(named.join(corr, "pair", "left").select("left", "right", "corr"))
    return reduce(DataFrame.unionByName, out) if out else small_frame(df.sparkSession, [], "left string, right string, corr double")


def kendall_tau_b(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact tau-b. Discordant pairs are inversions, counted bit by bit of the dense rank of b:
    at each bit level, rows that share the higher bits are one group, and a zero bit after a one bit is an inversion."""
    cells = (df.select(dbl(a).alias("x"), dbl(b).alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    ys = ordered.value_ranks(cells, "y", "w")
    levels = max(1, int((ys.count() or 1) - 1).bit_length())
    ranked = skew_join(cells, ys.select("y", "dense"), ["y"], "inner", right_unique=True)
    bits = ranked.select("x", "w", "dense", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    bits = bits.select("x", "dense", "w", "level", F.expr("shiftright(dense, level + 1)").alias("prefix"),
                       F.expr("shiftright(dense, level) & 1").alias("bit"))
    bits = bits.withColumn("one", F.col("w") * F.col("bit"))
    run = ordered.running_sum(bits, {"ones": "one"}, ["x", "dense"], inclusive=False, partition_by=["level", "prefix"])
    disc = run.agg(F.sum(F.when(F.col("bit") == 0, F.col("w").cast("double") * F.col("ones"))).alias("d"))
    ties = lambda k: F.sum(F.col("w").cast("double") * (F.col("w") - 1) / 2).alias(k)
    t0 = cells.agg(F.sum("w").cast("double").alias("n"), ties("n3"))
    t1 = cells.groupBy("x").agg(F.sum("w").alias("w")).agg(ties("n1"))
    t2 = cells.groupBy("y").agg(F.sum("w").alias("w")).agg(ties("n2"))
    # four one-row results side by side
    one = t0.withColumn("k", F.lit(1))
    for t in (t1, t2, disc):
        one = one.join(F.broadcast(t.withColumn("k", F.lit(1))), "k")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    conc = n0 - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d")
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return one.select(F.lit(a).alias("left"), F.lit(b).alias("right"), F.when(den > 0, (conc - F.col("d")) / den).alias("corr"))


def corr_kendall(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    out = [kendall_tau_b(df, a, b) for a, b in combinations(columns or numeric_columns(df), 2)]
    return reduce(DataFrame.unionByName, out)


def corr_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    t = corr_pearson(df, columns).where(F.abs("corr") > threshold)
    a = F.abs("corr")
    return t.withColumn("label", F.when(a > 0.7, "strong").when(a > 0.5, "moderate").otherwise("weak"))


def gram(df: DataFrame, cols: list[str], center: dict[str, float] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and the matrix of sums of products over complete rows; each task adds up its own matrix, in one pass."""
    d = len(cols)
    x = [dbl(k) - F.lit((center or {}).get(k, 0.0)) for k in cols]
    if d <= PAIRS_JVM:
        ok = reduce(lambda p, q: p & q, [v.isNotNull() for v in x])
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.where(ok).agg(F.count(F.lit(1)), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
        s, g = np.array([v or 0.0 for v in row[1:1 + d]], dtype=float), np.zeros((d, d))
        for (i, j), v in zip(pairs, row[1 + d:]):
            g[i, j] = g[j, i] = v or 0.0
        return row[0], s, g

    def products(batches):
        total = np.zeros((d + 1, d + 1))      # a column of ones in front: count and sums are products as well
        for batch in batches:
            m = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]).astype(float)
            m = np.column_stack([np.ones(len(m)), m])[~np.isnan(m).any(axis=1)]
            total += m.T @ m
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    g = np.zeros((d + 1, d + 1))
    for r in cells:      # (d + 1) * (d + 2) / 2 rows
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    return int(g[0, 0]), g[0, 1:], g[1:, 1:]


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Uncentred variance inflation factors from the Gram matrix of complete rows."""
    cols = columns or numeric_columns(df)
    _, _, g = gram(df, cols)
    scale = np.sqrt(np.diag(g))
    scale[scale == 0] = 1.0
    inv = np.linalg.pinv(g / np.outer(scale, scale))
    return small_frame(df.sparkSession, [(x, float(inv[i, i])) for i, x in enumerate(cols)], "column string, vif double")


# ---------------------------------------------------------------- group shares

def group_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and percentage per combination."""
    n = df.count()
    return df.groupBy(*[c(x) for x in columns]).agg(F.count(F.lit(1)).alias("rows")).withColumn("pct", F.col("rows") / F.lit(max(n, 1)) * 100)


def group_rollup(df: DataFrame, outer: str, inner: str) -> DataFrame:
    return df.rollup(c(outer), c(inner)).agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("level"))


def group_by_date_part(df: DataFrame, column: str) -> DataFrame:
    """Counts by year, month name, quarter and weekday name in one pass (grouping sets over the four parts)."""
    x = c(column)
    parts = df.where(x.isNotNull()).select(F.inline(F.array(
        F.struct(F.lit("year").alias("part"), F.year(x).cast("string").alias("value")),
        F.struct(F.lit("month").alias("part"), F.date_format(x, "MMMM").alias("value")),
        F.struct(F.lit("quarter").alias("part"), F.quarter(x).cast("string").alias("value")),
        F.struct(F.lit("weekday").alias("part"), F.date_format(x, "EEEE").alias("value")))))
    return parts.groupBy("part", "value").agg(F.count(F.lit(1)).alias("rows"))


def group_conditions(df: DataFrame, conditions: dict[str, str], default: str = "Other") -> DataFrame:
    """Rows per first matching named condition."""
    case = reduce(lambda acc, kv: acc.when(F.expr(kv[1]), kv[0]), conditions.items(), F)
    return df.groupBy(case.otherwise(default).alias("condition")).agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- distribution

def normality(df: DataFrame, columns: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera test on the full column (chi-square with two degrees of freedom has p = exp(-x/2))."""
    def make(x):
        v = dbl(x)
        n = F.count(v).cast("double")
        s, k = _pop(v, F.skewness), _pop(v, F.kurtosis)
        return [n.alias("n"), (n / 6 * (s * s + k * k / 4)).alias("jarque_bera")]
    t = per_column(df, columns or numeric_columns(df), make)
    return t.withColumn("p_value", F.exp(-F.col("jarque_bera") / 2)).withColumn("is_normal", F.coalesce(F.col("p_value") > alpha, F.lit(False))).drop("n")


def distribution_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    def make(x):
        v = dbl(x)
        n = F.count(v).cast("double")
        s, k = _pop(v, F.skewness), _pop(v, F.kurtosis)
        sd = F.stddev_pop(v)
        far = F.greatest(F.max(v) - F.avg(v), F.avg(v) - F.min(v)) / F.when(sd > 0, sd)
        return [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (F.max(v) - F.min(v)).alias("range"),
                skew_sample(v).alias("skew"), kurt_sample(v).alias("kurt"),
                F.coalesce(F.exp(-(n / 6 * (s * s + k * k / 4)) / 2) > 0.05, F.lit(False)).alias("is_normal"),
                F.coalesce(far > 3, F.lit(False)).alias("has_outliers"), (count_if(v == 0) > 0).alias("has_zeros"), (count_if(v < 0) > 0).alias("has_negatives")]
    return per_column(df, columns or numeric_columns(df), make)


def compare_stats(before: DataFrame, after: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Statistics of columns before and after a step; columns maps old to new names."""
    a = describe(before, list(columns)).select("column", *[c(k).alias(k + "_before") for k in ("count", "mean", "std", "min", "max")])
    b = describe(after, list(columns.values())).select(c("column").alias("new_column"), *[c(k).alias(k + "_after") for k in ("count", "mean", "std", "min", "max")])
    names = small_frame(before.sparkSession, list(columns.items()), "column string, new_column string")
    return names.join(F.broadcast(a), "column").join(F.broadcast(b), "new_column")


def validate_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_column(df, columns, lambda x: [
        F.avg(dbl(x)).alias("mean"), F.stddev_samp(dbl(x)).alias("std"), skew_sample(dbl(x)).alias("skew"), kurt_sample(dbl(x)).alias("kurt"),
        (F.max(dbl(x)) - F.min(dbl(x))).alias("range"), count_if(dbl(x) == 0).alias("zeros"), count_if(dbl(x) < 0).alias("negatives"),
        F.count_distinct(dbl(x)).alias("unique"), (F.count(F.lit(1)) - F.count(dbl(x))).alias("missing"), F.min(dbl(x)).alias("min"), F.max(dbl(x)).alias("max")])


def most_variable(df: DataFrame) -> DataFrame:
    """Column with the largest std / abs(mean), with the largest maximum, and the most diverse text column."""
    nums, texts = numeric_columns(df), text_columns(df)
    a = per_column(df, nums, lambda x: [(F.stddev_samp(dbl(x)) / F.abs(F.when(F.avg(dbl(x)) != 0, F.avg(dbl(x))))).alias("cv"), F.max(dbl(x)).alias("max")])
    b = per_column(df, texts, lambda x: [F.count_distinct(c(x)).cast("double").alias("unique")])
    pick = lambda t, fact, by: t.agg(F.lit(fact).alias("fact"), F.max_by("column", F.col(by)).alias("column"), F.max(by).alias("value"))
    return pick(a, "largest_variation", "cv").unionByName(pick(a, "largest_value", "max")).unionByName(pick(b, "most_diverse", "unique"))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(dbl(y), dbl(x)).alias("slope"), F.regr_intercept(dbl(y), dbl(x)).alias("intercept"), F.corr(dbl(x), dbl(y)).alias("corr"))


# ---------------------------------------------------------------- rules over the profile

def issue_table(df: DataFrame) -> DataFrame:
    rows = []
    for p in profile(df, parse=False):
        if p.nulls:
            rows.append((p.column, "missing", p.nulls, p.null_pct, "High" if p.nulls / p.rows > 0.1 else "Medium"))
        repeats = p.rows - (p.unique or 0) - (1 if p.nulls else 0)
        if p.role != "numeric" and repeats > p.rows * 0.1:
            rows.append((p.column, "high_duplication", repeats, 100.0 * repeats / p.rows, "Medium"))
        if p.outliers:
            rows.append((p.column, "outliers", p.outliers, 100.0 * p.outliers / p.rows, "Low" if p.outliers / p.rows < 0.05 else "Medium"))
    return small_frame(df.sparkSession, rows, "column string, issue string, count long, pct double, severity string")


def issue_list(df: DataFrame) -> DataFrame:
    """Issue kinds with the number and the names of the columns concerned."""
    prof = profile(df, quantiles=False, outliers=False)
    dup = duplicate_count(df)
    texts = [p for p in prof if p.role == "text"]
    found = {"missing": [p.column for p in prof if p.nulls],
             "potential_date": [p.column for p in texts if p.known and p.date_ok == p.known],
             "high_cardinality": [p.column for p in texts if p.unique > 0.7 * p.rows]}
    rows = [(k, len(v), ",".join(v)) for k, v in found.items() if v]
    if dup:
        rows.append(("duplicates", dup, ""))
    return small_frame(df.sparkSession, rows, "issue string, count long, columns string")


def issue_ids(df: DataFrame) -> DataFrame:
    prof = profile(df, unique=False, quantiles=False, outliers=False)
    dup = duplicate_count(df)
    rows = [("Missing Values", p.column, "high" if p.null_pct > 50 else "medium" if p.null_pct > 10 else "low") for p in prof if p.nulls]
    if dup:
        rows.append(("Duplicates", "all", "high" if dup > 0.1 * prof[0].rows else "medium"))
    rows += [("Data Types", p.column, "medium") for p in prof if p.role == "text" and p.clean_ok > 0.8 * p.known]
    return small_frame(df.sparkSession, [(i + 1, *r) for i, r in enumerate(rows)], "id long, category string, column string, severity string")


def _missing_pct(prof: list[ColumnProfile]) -> float:
    cells = sum(p.rows for p in prof)
    return 100.0 * sum(p.nulls for p in prof) / cells if cells else 0.0


def insights(df: DataFrame) -> DataFrame:
    prof = profile(df, quantiles=False, outliers=False)
    n = prof[0].rows if prof else 0
    miss, dup = _missing_pct(prof), duplicate_count(df)
    rows = []
    if miss > 20:
        rows.append(("high", "missing", "all", miss))
    elif miss > 5:
        rows.append(("medium", "missing", "all", miss))
    if n and 100.0 * dup / n > 10:
        rows.append(("high", "duplicates", "all", 100.0 * dup / n))
    rows += [("medium", "numeric_as_text", p.column, 100.0 * p.clean_ok / p.known) for p in prof if p.role == "text" and p.known and p.clean_ok > 0.8 * p.known]
    rows += [("low", "high_cardinality", p.column, 100.0 * p.unique / n) for p in prof if n and p.unique is not None and p.unique / n > 0.95]
    return small_frame(df.sparkSession, rows, "severity string, insight string, column string, value double")


def insights_overview(df: DataFrame) -> DataFrame:
    prof = profile(df, quantiles=False, outliers=False, parse=False)
    n = prof[0].rows if prof else 0
    miss, dup = _missing_pct(prof), duplicate_count(df)
    rows = []
    if n > 100_000:
        rows.append(("Medium", "large_table", "all", float(n)))
    if miss > 10:
        rows.append(("High", "missing", "all", miss))
    elif miss > 5:
        rows.append(("Medium", "missing", "all", miss))
    if dup:
        rows.append(("Medium" if 100.0 * dup / n > 5 else "Low", "duplicates", "all", 100.0 * dup / n))
    rows += [("Low", "skewed", p.column, p.skew) for p in prof if p.skew is not None and abs(p.skew) > 2]
    for p in prof:
        if p.unique is None or not n:
            continue
        if p.unique / n > 0.95 and p.unique > 10:
            rows.append(("Low", "identifier", p.column, float(p.unique)))
        elif p.unique / n < 0.01 and p.unique > 1:
            rows.append(("Low", "categorical", p.column, float(p.unique)))
    return small_frame(df.sparkSession, rows, "severity string, insight string, column string, value double")


def todo_activities(df: DataFrame) -> DataFrame:
    prof = profile(df, unique=False, quantiles=False, outliers=False, parse=False)
    miss = [p for p in prof if p.nulls]
    nums = [p for p in prof if p.role == "numeric"]
    rows = []
    if miss:
        rows.append(("handle_missing", len(miss), "High" if _missing_pct(prof) > 10 else "Medium"))
    if nums:
        rows.append(("detect_outliers", len(nums), "Medium"))
    rows.append(("optimize_types", len(prof), "Low"))
    return small_frame(df.sparkSession, rows, "action string, columns long, severity string")


def anomaly_count(df: DataFrame) -> DataFrame:
    prof = profile(df, unique=False, parse=False)
    k = int(any(p.nulls for p in prof)) + int(duplicate_count(df) > 0) + int(any(p.outliers for p in prof))
    return small_frame(df.sparkSession, [(k,)], "anomalies long")


def story_facts(df: DataFrame) -> DataFrame:
    """Facts per column and for the table as rows (subject, fact, number, label)."""
    prof = profile(df, quantiles=False, outliers=False, parse=False)
    texts = [p.column for p in prof if p.role == "text"]
    modes = {x: most_frequent(df, x) for x in texts}
    rows: list[tuple] = []
    for p in prof:
        if p.role == "numeric":
            label = "gaps" if p.nulls else "steady" if p.skew is not None and abs(p.skew) < 0.5 else "dramatic"
            pattern = None if p.skew is None else "balanced" if abs(p.skew) < 0.5 else "right" if p.skew > 1 else "left" if p.skew < -1 else "mild"
            rows += [(p.column, "min", p.min, label), (p.column, "max", p.max, label), (p.column, "mean", p.mean, label),
                     (p.column, "std", p.std, label), (p.column, "skew", p.skew, pattern)]
        elif p.role == "text":
            rows.append((p.column, "unique", float(p.unique), "lead" if p.unique <= 5 else "supporting" if p.unique <= 20 else "ensemble"))
            rows.append((p.column, "mode", None, modes[p.column] if modes[p.column] is not None else "Unknown"))
        if p.nulls:
            rows.append((p.column, "missing_pct", p.null_pct, "critical" if p.null_pct > 50 else "significant" if p.null_pct > 20 else "minor"))
    full = 100.0 - _missing_pct(prof)
    rows.append(("table", "completeness", full, "excellent" if full > 95 else "good" if full > 80 else "attention"))
    return small_frame(df.sparkSession, rows, "subject string, fact string, number double, label string")
