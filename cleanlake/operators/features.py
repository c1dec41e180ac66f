"""Feature construction and selection."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, dbl, numeric_columns, small_frame
from cleanlake.operators.profile import corr_pearson, per_column, profile
from cleanlake.operators.quantiles import SMALL_CELLS, exact_quantiles


def _zero(x: str) -> Column:
    return F.coalesce(dbl(x), F.lit(0.0))


def _product(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, cols)


def _exprs(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select("*", *[e.alias(n) for n, e in new.items()])


# ---------------------------------------------------------------- construction

def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = False) -> DataFrame:
    """Monomials of degree 2..d (the columns themselves exist already), optional bias; null counts as 0."""
    new: dict[str, Column] = {"poly_bias": F.lit(1.0)} if bias else {}
    choose = combinations if interaction_only else combinations_with_replacement
    for k in range(2, degree + 1):
        for combo in choose(columns, k):
            name = "poly_" + "_".join(f"{x}^{combo.count(x)}" if combo.count(x) > 1 else x for x in dict.fromkeys(combo))
            new[name] = _product([_zero(x) for x in combo])
    return _exprs(df, new)


def powers(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    return _exprs(df, {f"{x}_pow{k}": _product([dbl(x)] * k) for x in columns for k in range(2, degree + 1)})


def interaction(df: DataFrame, x: str, y: str, kinds: list[str] | None = None) -> DataFrame:
    a, b = dbl(x), dbl(y)
    ops = {"multiply": a * b, "add": a + b, "subtract": a - b, "divide": F.try_divide(a, b), "ratio": F.try_divide(a, a + b)}
    return _exprs(df, {f"{x}_{k}_{y}": ops[k] for k in (kinds or list(ops))})


def pairwise(df: DataFrame, columns: list[str], suffix: str = "_interaction") -> DataFrame:
    return _exprs(df, {f"{a}_{b}{suffix}": dbl(a) * dbl(b) for a, b in combinations(columns, 2)})


@dataclass
class Bins:
    """Edges of one column; bin i holds edge[i] < x <= edge[i+1], the first one includes its lower edge."""
    column: str
    edges: list[float]


def fit_bins_width(df: DataFrame, column: str, n: int = 5) -> Bins:
    lo, hi = df.agg(F.min(dbl(column)), F.max(dbl(column))).first()
    if lo is None:
        return Bins(column, [])
    if lo == hi:
        lo, hi = lo - 0.001 * abs(lo or 1.0), hi + 0.001 * abs(hi or 1.0)
    return Bins(column, [lo + (hi - lo) * i / n for i in range(n)] + [hi])


def fit_bins_quantile(df: DataFrame, column: str, n: int = 5) -> Bins:
    """Equal-frequency edges, repeated edges dropped."""
    return fit_bins_quantiles(df, [column], n)[column]


def fit_bins_quantiles(df: DataFrame, columns: list[str], n: int = 5, **how) -> dict[str, Bins]:
    """fit_bins_quantile of all columns in the same passes."""
    qs = exact_quantiles(df, columns, [i / n for i in range(n + 1)], **how)
    return {x: Bins(x, [] if qs[x][0] is None else sorted(set(qs[x]))) for x in columns}


def bin_code(fit: Bins) -> Column:
    """Bin number; outside the edges (or without edges) null."""
    x, e = dbl(fit.column), fit.edges
    if len(e) < 2:
        return F.lit(None).cast("int")
    inner = reduce(lambda a, b: a + b, [(x > F.lit(v)).cast("int") for v in e[1:-1]], F.lit(0))
    return F.when((x >= F.lit(e[0])) & (x <= F.lit(e[-1])), inner)


def bins(df: DataFrame, fit: Bins, name: str | None = None, labels: list[str] | None = None) -> DataFrame:
    code = bin_code(fit)
    if labels:
        # the explicit test keeps the null: element_at over literals claims never to be null
        code = F.when(code.isNotNull(), F.element_at(F.array(*map(F.lit, labels)), code + 1))
    return df.withColumn(name or fit.column + "_binned", code)


def bin_indicators(df: DataFrame, fit: Bins) -> DataFrame:
    t = df.withColumn("__code", bin_code(fit))
    return t.select(*[c(x) for x in df.columns], *[F.coalesce((F.col("__code") == i).cast("int"), F.lit(0)).alias(f"{fit.column}_bin_{i}") for i in range(max(len(fit.edges) - 1, 0))])


def math_features(df: DataFrame, column: str, kinds: list[str] | None = None) -> DataFrame:
    x = dbl(column)
    clip = F.when(x.isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), x)))
    ops = {"sqrt": F.sqrt(F.abs(x)), "sq": x * x, "cube": x * x * x, "log": F.ln(F.abs(x) + 1), "exp": F.exp(clip), "inv": F.try_divide(F.lit(1.0), x),
           "abs": F.abs(x), "sign": F.signum(x), "pow2": F.pow(F.lit(2.0), clip)}
    return _exprs(df, {f"{column}_{k}": ops[k] for k in (kinds or list(ops))})


def row_aggregates(df: DataFrame, columns: list[str], kinds: list[str] | None = None, prefix: str = "agg_") -> DataFrame:
    """mean, sum, min, max, sample std and range over the known values of each row."""
    xs = [dbl(x) for x in columns]
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    mean = F.when(n > 0, total / n)
    dev = reduce(lambda a, b: a + b, [F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs])
    lo, hi = F.least(*xs), F.greatest(*xs)
    ops = {"mean": mean, "sum": F.when(n > 0, total), "min": lo, "max": hi, "std": F.when(n > 1, F.sqrt(dev / (n - 1))), "range": hi - lo}
    return _exprs(df, {f"{prefix}{k}": ops[k] for k in (kinds or list(ops))})


# ---------------------------------------------------------------- PCA

@dataclass
class Pca:
    columns: list[str]
    means: list[float]
    scales: list[float]
    components: list[list[float]]
    explained: list[float]


def fit_pca(df: DataFrame, columns: list[str], components: int | float | None = 0.95, standardize: bool = True) -> Pca:
    """components: a count, or a share of variance to keep. Null counts as 0.

    Means, deviations and the correlation matrix come from the distributed statistics of Spark ML, which add up
    one matrix per partition; only the d x d result reaches the driver.
    """
    t = VectorAssembler(inputCols=columns, outputCol="features").transform(df.select(*[_zero(x).alias(x) for x in columns])).select("features")
    if t.limit(2).count() < 2:      # no variance, so no components
        return Pca(columns, [0.0] * len(columns), [1.0] * len(columns), [], [])
    row = t.select(Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s")).first()["s"]
    means, stds = row["mean"].toArray().tolist(), row["std"].toArray()
    corr = np.nan_to_num(Correlation.corr(t, "features").first()[0].toArray())
    np.fill_diagonal(corr, (stds > 0).astype(float))
    scales = [float(v) if v > 0 else 1.0 for v in stds] if standardize else [1.0] * len(columns)
    cov = corr if standardize else corr * np.outer(stds, stds)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1]
    val, vec = np.maximum(val[order], 0.0), vec[:, order]
    share = val / val.sum() if val.sum() > 0 else np.zeros(len(val))
    if isinstance(components, float) and components < 1:
        k = int(np.searchsorted(np.cumsum(share), components - 1e-12) + 1)
    else:
        k = int(components or len(columns))
    k = min(k, len(columns))
    out = []
    for i in range(k):
        v = vec[:, i]
        out.append((v if v[np.argmax(np.abs(v))] >= 0 else -v).tolist())
    return Pca(columns, means, scales, out, share[:k].tolist())


def transform_pca(df: DataFrame, fit: Pca, keep: bool = True) -> DataFrame:
    scores = []
    for i, w in enumerate(fit.components):
        e = reduce(lambda a, b: a + b, [(_zero(x) - F.lit(m)) * F.lit(v / s) for x, m, s, v in zip(fit.columns, fit.means, fit.scales, w)])
        scores.append(e.alias(f"pca_{i + 1}"))
    return df.select(*[c(x) for x in df.columns if keep or x not in fit.columns], *scores)


def pca_reduce(df: DataFrame, columns: list[str], components: int = 10) -> DataFrame:
    """Replace the columns by so many components (all there are, if fewer), without standardising."""
    return transform_pca(df, fit_pca(df, columns, min(components, len(columns)), standardize=False), keep=False)


def pca_loadings(spark, fit: Pca) -> DataFrame:
    rows, cum = [], 0.0
    for i, (w, e) in enumerate(zip(fit.components, fit.explained)):
        cum += e
        for pos, j in enumerate(sorted(range(len(w)), key=lambda j: -abs(w[j]))):
            rows.append((f"pca_{i + 1}", e, cum, pos + 1, fit.columns[j], float(w[j])))
    return small_frame(spark, rows, "component string, explained double, cumulative double, position int, column string, loading double")


# ---------------------------------------------------------------- selection by statistics

def anova_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """F value per feature against the classes of the target; null counts as 0. One grouped aggregate."""
    t = df.where(c(target).isNotNull())
    center = t.agg(*[F.avg(_zero(x)).alias(x) for x in columns]).first()
    g = t.groupBy(c(target)).agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.sum(_zero(x) - F.lit(center[x])).alias("s"), F.sum(F.pow(_zero(x) - F.lit(center[x]), 2)).alias("q")).alias(x) for x in columns])
    long = g.select("n", F.inline(F.array(*[F.struct(F.lit(x).alias("column"), c(x)["s"].alias("s"), c(x)["q"].alias("q")) for x in columns])))
    a = long.groupBy("column").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return a.select("column", F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f_value"))


def top_k(scores: DataFrame, value: str, k: int) -> DataFrame:
    return scores.orderBy(F.col(value).desc_nulls_last(), "column").limit(k)


def mutual_information(df: DataFrame, columns: list[str], target: str, bins_: int = 10, continuous_from: int = 20) -> DataFrame:
    """Mutual information (nats) of quantile-binned features with the target; a numeric target with many values is binned too."""
    t = df.where(c(target).isNotNull()).select(*[_zero(x).alias(x) for x in columns], c(target).alias("__y"))
    numeric = isinstance(df.schema[target].dataType.typeName(), str) and target in numeric_columns(df)
    many = numeric and t.agg(F.approx_count_distinct("__y")).first()[0] >= continuous_from
    # a coarser sketch costs a fraction of the time; the quantiles are exact with any
    fits = fit_bins_quantiles(t, columns, bins_, small_cells=SMALL_CELLS * max(len(columns), 1), accuracy=5_000)
    y = bin_code(fit_bins_quantile(t, "__y", bins_)).cast("string") if many else F.col("__y").cast("string")
    cells = t.select(y.alias("y"), F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.coalesce(bin_code(fits[x]), F.lit(0)).alias("b")) for x in columns])))
    joint = cells.groupBy("column", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    # at most columns * bins * classes rows from here on
    from pyspark.sql import Window
    by = lambda *k: Window.partitionBy("column", *k)
    p = joint.select("column", "n", F.sum("n").over(by()).alias("t"), F.sum("n").over(by("b")).alias("x"), F.sum("n").over(by("y")).alias("z"))
    n, tot = F.col("n").cast("double"), F.col("t").cast("double")
    return p.groupBy("column").agg(F.sum(n / tot * F.ln(n * tot / (F.col("x").cast("double") * F.col("z")))).alias("mutual_information"))


def select_variance(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    t = per_column(df, columns, lambda x: [F.var_pop(_zero(x)).alias("variance")])
    return t.where(F.col("variance") > threshold)


def select_correlation(df: DataFrame, columns: list[str], threshold: float = 0.8) -> list[str]:
    """Columns kept: the later one of each pair above the threshold goes, unless the earlier is already gone."""
    dropped: set[str] = set()
    pairs = {(r["left"], r["right"]): r["corr"] for r in corr_pearson(df, columns).collect()}
    for a, b in combinations(columns, 2):
        if a not in dropped and pairs[(a, b)] is not None and abs(pairs[(a, b)]) > threshold:
            dropped.add(b)
    return [x for x in columns if x not in dropped]


# ---------------------------------------------------------------- selection by models

def _labelled(df: DataFrame, columns: list[str], target: str, classes: bool) -> DataFrame:
    t = df.where(c(target).isNotNull()).select(*[_zero(x).alias(x) for x in columns], c(target).alias("__t"))
    if classes:
        t = t.withColumn("__t", F.col("__t").cast("string"))
        return StringIndexer(inputCol="__t", outputCol="label").fit(t).transform(t).select(*[c(x) for x in columns], "label")
    return t.select(*[c(x) for x in columns], F.col("__t").cast("double").alias("label"))


def _vectors(labelled: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(labelled).select("features", "label")


def _assembled(df: DataFrame, columns: list[str], target: str, classes: bool) -> DataFrame:
    return _vectors(_labelled(df, columns, target, classes), columns)


def forest_importance(df: DataFrame, columns: list[str], target: str, trees: int = 50, seed: int = 42) -> list[tuple[str, float]]:
    """Impurity importance; a classifier below 20 target values, otherwise a regressor."""
    few = _few(df, target)
    return _ranked(_labelled(df, columns, target, few), columns, few, trees, seed)


def _few(df: DataFrame, target: str) -> bool:
    return df.select(c(target)).distinct().limit(20).count() < 20


def _ranked(labelled: DataFrame, columns: list[str], few: bool, trees: int, seed: int = 42) -> list[tuple[str, float]]:
    model = (RandomForestClassifier if few else RandomForestRegressor)(numTrees=trees, seed=seed, maxDepth=6)
    imp = model.fit(_vectors(labelled, columns)).featureImportances.toArray()
    return sorted(zip(columns, map(float, imp)), key=lambda p: (-p[1], p[0]))


def importance_table(df: DataFrame, columns: list[str], target: str, trees: int = 50) -> DataFrame:
    rows = [(i + 1, x, v) for i, (x, v) in enumerate(forest_importance(df, columns, target, trees))]
    return small_frame(df.sparkSession, rows, "position int, column string, importance double")


def select_rf(df: DataFrame, columns: list[str], target: str, threshold: float = 0.01, trees: int = 50) -> list[str]:
    return [x for x, v in forest_importance(df, columns, target, trees) if v > threshold]


def select_rfe(df: DataFrame, columns: list[str], target: str, k: int, trees: int = 20) -> list[str]:
    left = list(columns)
    if len(left) <= k:
        return left
    few = _few(df, target)
    labelled = _labelled(df, left, target, few)       # classes are counted and numbered once
    while len(left) > k:
        left.remove(_ranked(labelled, left, few, trees)[-1][0])
    return left


def select_lasso(df: DataFrame, columns: list[str], target: str, strength: float = 0.01) -> list[tuple[str, float]]:
    """Non-zero coefficients of an L1 regression on standardised features."""
    fit = LinearRegression(elasticNetParam=1.0, regParam=strength, standardization=True).fit(_assembled(df, columns, target, False))
    return [(x, float(v)) for x, v in zip(columns, fit.coefficients) if abs(v) > 1e-9]


# ---------------------------------------------------------------- automatic

#: Generators of one column's features: prefix, condition on its skew, expression.
SINGLE_FEATURES = [
    ("auto_sqrt_", lambda skew: skew > 1, lambda x: F.sqrt(F.abs(dbl(x)))),
    ("auto_log_", lambda skew: skew > 2, lambda x: F.log1p(F.abs(dbl(x)))),
    ("auto_sq_", lambda skew: abs(skew) < 0.5, lambda x: dbl(x) * dbl(x)),
]
#: Generators of a pair's features: name of the pair, expression.
PAIR_FEATURES = [
    (lambda a, b: f"auto_poly_{a} {b}", lambda a, b: _zero(a) * _zero(b)),
    (lambda a, b: f"auto_int_{a}_x_{b}", lambda a, b: dbl(a) * dbl(b)),
]


def auto(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Products, transforms, bins and row statistics of all given columns, by the generators above and one profile.

    Columns with |skew| > 1 get five quantile bins, and each three columns in order their mean and deviation by row. Without
    `columns` all numeric ones take part; the number of pairs is quadratic in them, so wide tables should name theirs.
    """
    cols = columns or numeric_columns(df)
    skew = {p.column: p.skew or 0.0 for p in profile(df.select(*[c(x) for x in cols]), unique=False, quantiles=False, outliers=False, parse=False)}
    new = {name(a, b): e(a, b) for name, e in PAIR_FEATURES for a, b in combinations(cols, 2)}
    new |= {prefix + x: e(x) for prefix, wanted, e in SINGLE_FEATURES for x in cols if wanted(skew[x])}
    new |= {f"auto_bin_{x}": bin_code(fit_bins_quantile(df, x, 5)) for x in cols if abs(skew[x]) > 1}
    out = _exprs(df, new)
    for i, group in enumerate(zip(*[iter(cols)] * 3), 1):
        out = row_aggregates(out, list(group), ["mean", "std"], f"auto_agg_{i}_")
    return out


def auto_simple(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Squares of all given columns, and five bins of each whose deviation is above its mean."""
    cols = columns or numeric_columns(df)
    row = df.agg(*[F.struct(F.avg(dbl(x)).alias("m"), F.stddev_samp(dbl(x)).alias("s")).alias(x) for x in cols]).first()
    out = _exprs(df, {f"{x}_squared": dbl(x) * dbl(x) for x in cols})
    for x in cols:
        if row[x]["s"] is not None and row[x]["s"] > row[x]["m"]:
            out = bins(out, fit_bins_width(df, x, 5))
    return out


def auto_core(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All pair products and five equal-width bins of every numeric column."""
    cols = columns or numeric_columns(df)
    out = pairwise(df, cols)
    row = df.agg(*[F.struct(F.min(dbl(x)).alias("lo"), F.max(dbl(x)).alias("hi")).alias(x) for x in cols]).first()
    for x in cols:
        lo, hi = row[x]["lo"], row[x]["hi"]
        if lo is not None and lo < hi:
            out = bins(out, Bins(x, [lo + (hi - lo) * i / 5 for i in range(5)] + [hi]))
    return out


def recommend(df: DataFrame) -> DataFrame:
    cols = numeric_columns(df)
    card = df.agg(*[F.count_distinct(c(x)).alias(x) for x in cols]).first() if cols else {}
    rows = [("all", "interactions", len(cols))] if len(cols) >= 2 else []
    rows += [(x, "binning", card[x]) for x in cols if card[x] > 50]
    if len(cols) > 10:
        rows.append(("all", "pca", len(cols)))
    return small_frame(df.sparkSession, rows, "column string, recommendation string, value long")
