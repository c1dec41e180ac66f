"""Outlier detection and treatment. Fits are a few numbers per column; treatments are projections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, dbl, numeric_columns, small_frame, spread, written
from cleanlake.operators.profile import per_column, profile
from cleanlake.operators.quantiles import exact_quantiles


@dataclass
class Bounds:
    """Closed interval of accepted values per column; None leaves a column alone."""
    limits: dict[str, tuple[float, float] | None]


def fit_iqr(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> Bounds:
    cols = columns or numeric_columns(df)
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for x in cols:
        q1, q3 = qs[x]
        out[x] = None if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return Bounds(out)


def fit_zscore(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0, sample_std: bool = False) -> Bounds:
    cols = columns or numeric_columns(df)
    sd = F.stddev_samp if sample_std else F.stddev_pop
    row = df.agg(*[F.struct(F.avg(dbl(x)).alias("m"), sd(dbl(x)).alias("s")).alias(x) for x in cols]).first()
    return Bounds({x: None if not row[x]["s"] else (row[x]["m"] - threshold * row[x]["s"], row[x]["m"] + threshold * row[x]["s"]) for x in cols})


def fit_quantile(df: DataFrame, columns: list[str] | None = None, low: float = 0.05, high: float = 0.95) -> Bounds:
    cols = columns or numeric_columns(df)
    qs = exact_quantiles(df, cols, [low, high])
    return Bounds({x: None if qs[x][0] is None else (qs[x][0], qs[x][1]) for x in cols})


def fit_modified_z(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.5) -> Bounds:
    """0.6745 * (x - median) / MAD beyond the threshold; a zero MAD flags nothing."""
    cols = columns or numeric_columns(df)
    med = exact_quantiles(df, cols, [0.5])
    dev = df.select(*[F.abs(dbl(x) - F.lit(med[x][0])).alias(x) for x in cols])
    mad = exact_quantiles(dev, cols, [0.5])
    out = {}
    for x in cols:
        m, s = med[x][0], mad[x][0]
        out[x] = None if m is None or not s else (m - threshold * s / 0.6745, m + threshold * s / 0.6745)
    return Bounds(out)


def user_bounds(limits: dict[str, tuple[float | None, float | None]]) -> Bounds:
    return Bounds({x: (-math.inf if lo is None else lo, math.inf if hi is None else hi) for x, (lo, hi) in limits.items()})


def is_outlier(column: str, bounds: Bounds) -> Column:
    lim = bounds.limits.get(column)
    if lim is None:
        return F.lit(False)
    return F.coalesce((dbl(column) < F.lit(lim[0])) | (dbl(column) > F.lit(lim[1])), F.lit(False))


def flag(df: DataFrame, bounds: Bounds, suffix: str = "_outlier") -> DataFrame:
    return df.select("*", *[is_outlier(x, bounds).alias(x + suffix) for x in bounds.limits])


def flagged(df: DataFrame, column: str, bounds: Bounds) -> DataFrame:
    return df.where(is_outlier(column, bounds))


def remove(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Drop rows flagged in any fitted column; nulls are kept."""
    keep = F.lit(True)
    for x in bounds.limits:
        keep = keep & ~is_outlier(x, bounds)
    return df.where(keep)


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select(*[changed[x].alias(x) if x in changed else c(x) for x in df.columns])


def cap(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Clip to the bounds; nulls stay null."""
    def clip(x, lim):
        return F.when(dbl(x).isNotNull(), F.greatest(F.lit(lim[0]), F.least(F.lit(lim[1]), dbl(x))))
    return _replace(df, {x: clip(x, lim) for x, lim in bounds.limits.items() if lim})


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {x: F.when(dbl(x) > -1, F.log1p(dbl(x))) for x in columns})


def to_value(df: DataFrame, bounds: Bounds, how: str) -> DataFrame:
    """Replace flagged values by the column's median or mean, or by null."""
    cols = list(bounds.limits)
    if how == "median":
        value = {x: v[0] for x, v in exact_quantiles(df, cols, [0.5]).items()}
    elif how == "mean":
        value = df.agg(*[F.avg(dbl(x)).alias(x) for x in cols]).first().asDict()
    else:
        value = {x: None for x in cols}
    return _replace(df, {x: F.when(~is_outlier(x, bounds), dbl(x)).otherwise(F.lit(value[x]).cast("double")) for x in cols})


def summary(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Per column: flagged count, share of all rows, bounds."""
    lim = lambda x, i: F.lit(bounds.limits[x][i] if bounds.limits[x] else None).cast("double")
    t = per_column(df, list(bounds.limits), lambda x: [count_if(is_outlier(x, bounds)).alias("outliers"), F.count(F.lit(1)).alias("rows"),
                                                      lim(x, 0).alias("lower"), lim(x, 1).alias("upper")])
    return t.select("column", "outliers", (F.col("outliers") / F.col("rows") * 100).alias("pct"), "lower", "upper")


def totals(df: DataFrame, bounds: Bounds) -> DataFrame:
    k = len(bounds.limits)
    t = summary(df, bounds).agg(F.sum("outliers").alias("outliers"), (F.sum("pct") / k).alias("pct"))
    return t.withColumn("label", F.when(F.col("pct") < 1, "low").when(F.col("pct") < 5, "moderate").otherwise("high"))


def overlap(df: DataFrame, bounds: Bounds, threshold: float = 0.3) -> DataFrame:
    """Column pairs: share of the column's flagged rows in which the other column is flagged too, above the threshold."""
    pairs = list(permutations(bounds.limits, 2))
    aggs = [F.struct(F.lit(a).alias("column"), F.lit(b).alias("other"), count_if(is_outlier(a, bounds)).alias("flagged"),
                     count_if(is_outlier(a, bounds) & is_outlier(b, bounds)).alias("both")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    t = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))
    return t.where("flagged > 0").select("column", "other", (F.col("both") / F.col("flagged")).alias("share")).where(F.col("share") > threshold)


def recommend(df: DataFrame) -> DataFrame:
    """Both rule sets: winsorize above 10 %, flag above 5 %; and cap below 5 %, otherwise remove, with severity bands."""
    rows = []
    for p in profile(df, unique=False, parse=False):
        if p.role != "numeric" or not p.outliers:
            continue
        pct_all = 100.0 * p.outliers / p.rows
        rows.append((p.column, p.outliers, p.outlier_pct, "winsorize" if p.outlier_pct > 10 else "flag" if p.outlier_pct > 5 else "none",
                     "Cap" if pct_all < 5 else "Remove", "high" if pct_all > 10 else "medium" if pct_all > 5 else "low"))
    return small_frame(df.sparkSession, rows, "column string, outliers long, pct double, action string, treatment string, severity string")


# ---------------------------------------------------------------- isolation forest

@dataclass
class IsolationForest:
    """Trees as flat node tables: feature (-1 leaf), split, left, right, path length at a leaf."""
    columns: list[str]
    fill: list[float]
    trees: list[list[tuple]]
    sample_size: int
    threshold: float = 0.0


def _avg_path(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng, limit: int) -> list[tuple]:
    nodes: list = []

    def build(rows, depth):
        me = len(nodes)
        nodes.append(None)
        spread = [j for j in range(x.shape[1]) if x[rows, j].min() < x[rows, j].max()] if len(rows) > 1 and depth < limit else []
        if not spread:
            nodes[me] = (-1, 0.0, -1, -1, depth + _avg_path(len(rows)))
            return me
        j = int(rng.choice(spread))
        lo, hi = x[rows, j].min(), x[rows, j].max()
        cut = float(rng.uniform(lo, hi))
        go = x[rows, j] < cut
        if not go.any() or go.all():
            cut = float(np.nextafter(lo, hi))
            go = x[rows, j] < cut
        left = build(rows[go], depth + 1)
        right = build(rows[~go], depth + 1)
        nodes[me] = (j, cut, left, right, 0.0)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _flat(tree: list[tuple]) -> tuple[np.ndarray, ...]:
    """Node arrays in which a leaf points to itself, so a fixed number of steps walks every row to its leaf."""
    t = np.array(tree, dtype=float)
    me = np.arange(len(t))
    leaf = t[:, 0] < 0
    return (np.where(leaf, 0, t[:, 0]).astype(np.intp), np.where(leaf, np.inf, t[:, 1]), np.where(leaf, me, t[:, 2]).astype(np.intp),
            np.where(leaf, me, t[:, 3]).astype(np.intp), t[:, 4])


def _path_lengths(x: np.ndarray, flat: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    feat, cut, left, right, path = flat
    rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.intp)
    for _ in range(depth):
        at = np.where(x[rows, feat[at]] < cut[at], left[at], right[at])
    return path[at]


def fit_forest(df: DataFrame, columns: list[str], key: list[str], contamination: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationForest:
    """Forest with its threshold. `flagged_forest` gives the rows as well, from the same scores."""
    fit = grow_forest(df, columns, key, trees, sample, seed)
    scored = written(score_forest(df.select(*[c(x) for x in columns]), fit).select("anomaly_score"), "forest-scores")
    fit.threshold = _score_limit(scored, contamination)
    return fit


def _score_limit(scored: DataFrame, contamination: float) -> float:
    return exact_quantiles(scored, ["anomaly_score"], [1 - contamination])["anomaly_score"][0]


def flagged_forest(df: DataFrame, columns: list[str], key: list[str], contamination: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """df with anomaly_score and is_outlier. The scores are computed once and stored; threshold and flags read them."""
    scored = written(score_forest(df, grow_forest(df, columns, key, trees, sample, seed)), "forest-scores")
    limit = _score_limit(scored.select("anomaly_score"), contamination)
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(limit))


def grow_forest(df: DataFrame, columns: list[str], key: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationForest:
    """Every tree grows on `sample` rows chosen by hash of the key: a fixed-size sample is the method itself.

    The sample for all trees has trees * sample rows; rows are assigned to trees in one pass and each tree is grown by its own task.
    """
    med = exact_quantiles(df, columns, [0.5])
    fill = [med[x][0] if med[x][0] is not None else 0.0 for x in columns]
    n = df.count()
    size = min(sample, n)
    x = df.select(*[F.coalesce(dbl(v), F.lit(f)).alias(v) for v, f in zip(columns, fill)], F.xxhash64(*[c(k) for k in key], F.lit(seed)).alias("__h"))
    # one hash per row picks a common pool of a fixed size, from which every tree draws its own rows
    pool = min(1.0, 4.0 * trees * sample / max(n, 1))
    if pool < 1.0:
        x = x.where(F.pmod("__h", F.lit(1 << 30)) < int(pool * (1 << 30)))
    # enough candidates per tree to reach `size` with near certainty, the surplus is cut by hash order
    share = min(1.0, (size + 6 * math.sqrt(size) + 8) / max(n * pool, 1))
    draw = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.pmod(F.xxhash64(F.col("__h"), t), F.lit(1 << 30)).alias("u")))
    picked = x.select("*", F.inline(F.filter(draw, lambda s: s["u"] < F.lit(int(share * (1 << 30)) + 1))))
    names = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["u", "__h"]).head(size)
        nodes = _grow(pdf[names].to_numpy(dtype=float), np.random.default_rng(seed * 1000 + t), max(1, math.ceil(math.log2(max(size, 2)))))
        return pd.DataFrame([(t, i, *node) for i, node in enumerate(nodes)], columns=["tree", "node", "f", "cut", "l", "r", "path"])

    got = picked.groupBy("tree").applyInPandas(grow, "tree int, node int, f int, cut double, l int, r int, path double").toPandas()
    forest = [g.sort_values("node")[["f", "cut", "l", "r", "path"]].to_numpy().tolist() for _, g in got.groupby("tree")]
    return IsolationForest(columns, fill, forest, size)


def score_forest(df: DataFrame, fit: IsolationForest, name: str = "anomaly_score") -> DataFrame:
    """Score in (0, 1); the trees (a few hundred small nodes each) travel with the tasks."""
    trees, norm = [_flat(t) for t in fit.trees], max(_avg_path(fit.sample_size), 1e-12)
    depth = max(1, math.ceil(math.log2(max(fit.sample_size, 2))))
    paths = _path_lengths

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in xs])
        total = np.zeros(len(x))
        for t in trees:
            total += paths(x, t, depth)
        return pd.Series(2.0 ** (-(total / len(trees)) / norm))

    return spread(df).withColumn(name, score(*[F.coalesce(dbl(v), F.lit(f)) for v, f in zip(fit.columns, fit.fill)]))


def flag_forest(df: DataFrame, fit: IsolationForest) -> DataFrame:
    return score_forest(df, fit).withColumn("is_outlier", F.col("anomaly_score") > F.lit(fit.threshold))


def compare_methods(df: DataFrame, column: str, key: list[str], contamination: float = 0.1) -> DataFrame:
    iqr, z = fit_iqr(df, [column]), fit_zscore(df, [column])
    t = flagged_forest(df.select(*[c(k) for k in key], c(column)), [column], key, contamination).agg(
        *[F.struct(F.lit(name).alias("method"), count_if(cond).alias("outliers"), (count_if(cond) / F.count(F.lit(1)) * 100).alias("pct")).alias(name)
          for name, cond in [("iqr", is_outlier(column, iqr)), ("zscore", is_outlier(column, z)), ("isolation_forest", F.col("is_outlier"))]])
    return t.select(F.inline(F.array("iqr", "zscore", "isolation_forest")))
