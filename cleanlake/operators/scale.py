"""Scaling and transformation. Each fit is one or two aggregates for all columns; transform is a projection."""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, dbl, numeric_columns, small_frame
from cleanlake.functions.normal import inverse_normal
from cleanlake.operators import ordered
from cleanlake.operators.profile import distribution_analysis, profile
from cleanlake.operators.quantiles import exact_quantiles
from cleanlake.operators.skew import skew_join


@dataclass
class Linear:
    """(x - shift) / divisor * factor + offset per column."""
    params: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)

    def expr(self, column: str) -> Column:
        shift, div, factor, offset = self.params[column]
        out = (dbl(column) - F.lit(shift)) / F.lit(div)
        if factor != 1.0:
            out = out * F.lit(factor)
        return out + F.lit(offset) if offset else out


def transform(df: DataFrame, fit: Linear, suffix: str | None = "_scaled") -> DataFrame:
    """suffix=None replaces the source columns."""
    if suffix is None:
        return df.select(*[fit.expr(x).alias(x) if x in fit.params else c(x) for x in df.columns])
    return df.select("*", *[fit.expr(x).alias(x + suffix) for x in fit.params])


def _one(df: DataFrame, columns: list[str], aggs: dict) -> dict[str, dict]:
    row = df.agg(*[F.struct(*[f(dbl(x)).alias(k) for k, f in aggs.items()]).alias(x) for x in columns]).first()
    return {x: row[x].asDict() for x in columns}


def _nz(v: float | None) -> float:
    return v if v else 1.0


def fit_standard(df: DataFrame, columns: list[str]) -> Linear:
    s = _one(df, columns, {"m": F.avg, "s": F.stddev_pop})
    return Linear({x: (s[x]["m"] or 0.0, _nz(s[x]["s"]), 1.0, 0.0) for x in columns})


def fit_minmax(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> Linear:
    s = _one(df, columns, {"lo": F.min, "hi": F.max})
    return Linear({x: (s[x]["lo"] or 0.0, _nz((s[x]["hi"] or 0.0) - (s[x]["lo"] or 0.0)), high - low, low) for x in columns})


def fit_quantile_range(df: DataFrame, columns: list[str], p: float = 0.25) -> Linear:
    """(x - median) / (q(1-p) - q(p)); p = 0.25 is robust scaling."""
    qs = exact_quantiles(df, columns, [p, 0.5, 1 - p])
    return Linear({x: (qs[x][1], _nz(qs[x][2] - qs[x][0]), 1.0, 0.0) for x in columns if qs[x][1] is not None})


def fit_robust(df: DataFrame, columns: list[str]) -> Linear:
    return fit_quantile_range(df, columns, 0.25)


def fit_maxabs(df: DataFrame, columns: list[str]) -> Linear:
    s = _one(df, columns, {"m": lambda v: F.max(F.abs(v))})
    return Linear({x: (0.0, _nz(s[x]["m"]), 1.0, 0.0) for x in columns})


def fit_unit(df: DataFrame, columns: list[str]) -> Linear:
    s = _one(df, columns, {"n": lambda v: F.sqrt(F.sum(v * v))})
    return Linear({x: (0.0, _nz(s[x]["n"]), 1.0, 0.0) for x in columns})


# ---------------------------------------------------------------- power transforms

@dataclass
class Power:
    kind: str
    lambdas: dict[str, float]
    shifts: dict[str, float]
    linear: Linear | None = None

    def expr(self, column: str) -> Column:
        x = dbl(column) + F.lit(self.shifts.get(column, 0.0))
        return (yeojohnson if self.kind == "yeojohnson" else boxcox)(x, self.lambdas[column])


def boxcox(x: Column, lam: float) -> Column:
    return F.when(x > 0, F.ln(x) if abs(lam) < 1e-8 else (F.pow(x, F.lit(lam)) - 1) / lam)


def yeojohnson(x: Column, lam: float) -> Column:
    pos = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-8 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
    neg_base = F.greatest(-x, F.lit(0.0))
    neg = -F.log1p(neg_base) if abs(lam - 2) < 1e-8 else -(F.pow(neg_base + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).when(x.isNotNull(), neg)


def _likelihoods(df: DataFrame, columns: list[str], kind: str, shifts: dict, grids: dict[str, list[float]]) -> dict[str, list[float]]:
    """Log-likelihood of every grid point of every column from one aggregate job."""
    f = yeojohnson if kind == "yeojohnson" else boxcox
    aggs = []
    for x in columns:
        v = dbl(x) + F.lit(shifts[x])
        jac = F.sum(F.signum(v) * F.log1p(F.abs(v))) if kind == "yeojohnson" else F.sum(F.when(v > 0, F.ln(v)))
        aggs.append(F.struct(F.count(v).alias("n"), jac.alias("j"), *[F.var_pop(f(v, lam)).alias(f"v{i}") for i, lam in enumerate(grids[x])]).alias(x))
    row = df.agg(*aggs).first()
    out = {}
    for x in columns:
        n, j = row[x]["n"], row[x]["j"] or 0.0
        spread = [row[x][f"v{i}"] for i in range(len(grids[x]))]
        out[x] = [-n / 2 * math.log(v) + (lam - 1) * j if v and math.isfinite(v) else -math.inf for v, lam in zip(spread, grids[x])] if n else []
    return out


def fit_power(df: DataFrame, columns: list[str], kind: str = "yeojohnson", standardize: bool = True, low: float = -4.0, high: float = 6.0, passes: int = 5, points: int = 21, widen: int = 12) -> Power:
    """Maximum-likelihood lambda by a grid: each pass is one aggregate over the table for all columns and grid points.

    While the best point lies at the border of the bracket, the bracket doubles to that side (at most `widen` times); then it shrinks around the best
    point. A column without spread has lambda 1, one without values has none and is null after the transform.
    """
    ends = _one(df, columns, {"lo": F.min, "hi": F.max})
    shifts = {x: 1.0 - ends[x]["lo"] if kind == "boxcox" and ends[x]["lo"] is not None and ends[x]["lo"] <= 0 else 0.0 for x in columns}
    span = {x: (low, high) for x in columns}
    found = {x: None if ends[x]["lo"] is None else 1.0 for x in columns if ends[x]["lo"] == ends[x]["hi"]}
    left = {x: passes for x in columns}
    for _ in range(passes + widen):
        todo = [x for x in columns if left[x] and x not in found]
        if not todo:
            break
        grids = {x: list(np.linspace(*span[x], points)) for x in todo}
        lik = _likelihoods(df, todo, kind, shifts, grids)
        for x in todo:
            if not lik[x] or max(lik[x]) == -math.inf:
                found[x] = 1.0 if lik[x] else None
                continue
            i, g = int(np.argmax(lik[x])), grids[x]
            if left[x] == passes and i in (0, points - 1) and lik[x].count(-math.inf) == 0:
                width = g[-1] - g[0]
                span[x] = (g[0] - width, g[1]) if i == 0 else (g[-2], g[-1] + width)
            else:
                span[x], left[x] = (g[max(i - 1, 0)], g[min(i + 1, points - 1)]), left[x] - 1
    fit = Power(kind, {x: found[x] if x in found else float(sum(span[x]) / 2) for x in columns}, shifts)
    if standardize:
        known = [x for x in columns if fit.lambdas[x] is not None]
        fit.linear = fit_standard(df.select(*[fit.expr(x).alias(x) for x in known]), known) if known else Linear({})
    return fit


def transform_power(df: DataFrame, fit: Power, suffix: str = "_scaled") -> DataFrame:
    out = []
    for x, lam in fit.lambdas.items():
        if lam is None:
            out.append(F.lit(None).cast("double").alias(x + suffix))
            continue
        e = fit.expr(x)
        if fit.linear:
            m, s, _, _ = fit.linear.params[x]
            e = (e - F.lit(m)) / F.lit(s)
        out.append(e.alias(x + suffix))
    return df.select("*", *out)


# ---------------------------------------------------------------- quantile transform and rank

@dataclass
class QuantileMap:
    edges: dict[str, list[float]]
    normal: bool


def fit_quantile_map(df: DataFrame, columns: list[str], n_quantiles: int = 1000, output: str = "uniform") -> QuantileMap:
    n = max(2, min(n_quantiles, df.count()))
    qs = exact_quantiles(df, columns, [i / (n - 1) for i in range(n)])
    return QuantileMap({x: qs[x] for x in columns}, output == "normal")


def transform_quantile(df: DataFrame, fit: QuantileMap, suffix: str = "_scaled") -> DataFrame:
    """Interpolated position among the fitted quantiles, averaged from both sides for ties; optional inverse normal."""
    out = df
    normal = fit.normal
    for x, edges in fit.edges.items():
        if not edges or edges[0] is None:
            continue
        e, ref = np.asarray(edges), np.linspace(0, 1, len(edges))

        @F.pandas_udf("double")
        def place(s: pd.Series) -> pd.Series:
            v = s.to_numpy(dtype=float)
            u = 0.5 * (np.interp(v, e, ref) - np.interp(-v, -e[::-1], -ref[::-1]))
            if normal:
                u = inverse_normal(np.clip(u, 1e-7, 1 - 1e-7))
            return pd.Series(u)

        out = out.withColumn(x + suffix, F.when(dbl(x).isNotNull(), place(dbl(x))))
    return out


def rank(df: DataFrame, column: str, spread_by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Average rank divided by the number of known values; ranked over distinct values, joined back with salting."""
    n = df.where(c(column).isNotNull()).count()
    ranks = ordered.value_ranks(df, column)
    counts = df.groupBy(c(column)).agg(F.count(F.lit(1)).alias("__n"))
    t = skew_join(df, ranks.select(c(column), (F.col("avg_rank") / max(n, 1)).alias("__rank")), [column], "left", counts=counts, spread_by=spread_by)
    return t.select(*[c(x) for x in df.columns], F.col("__rank").alias(name or column + "_scaled"))


# ---------------------------------------------------------------- logarithms, winsorizing

def log_scale(df: DataFrame, column: str, kind: str = "ln", name: str | None = None) -> DataFrame:
    """ln, log10, log2 (shifted by 1 - min when min <= 0) or log1p (null at or below -1)."""
    if kind == "log1p":
        e = F.when(dbl(column) > -1, F.log1p(dbl(column)))
    else:
        lo = df.agg(F.min(dbl(column))).first()[0]
        x = dbl(column) + F.lit(1.0 - lo if lo is not None and lo <= 0 else 0.0)
        e = F.when(x > 0, {"ln": F.ln, "log10": F.log10, "log2": F.log2}[kind](x))
    return df.withColumn(name or column + "_scaled", e)


def winsor_standard(df: DataFrame, column: str, p: float = 0.05, name: str | None = None) -> DataFrame:
    lo, hi = exact_quantiles(df, [column], [p, 1 - p])[column]
    clipped = F.when(dbl(column).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), dbl(column))))
    m, s = df.agg(F.avg(clipped), F.stddev_pop(clipped)).first()
    return df.withColumn(name or column + "_scaled", (clipped - F.lit(m)) / F.lit(_nz(s)))


# ---------------------------------------------------------------- dispatch and rules

def recommend(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """standard, robust or minmax per column, from one aggregate."""
    cols = columns or numeric_columns(df)
    out = []
    mins = _one(df, cols, {"lo": F.min})
    for r in distribution_analysis(df, cols).collect():
        if r["is_normal"] and not r["has_outliers"]:
            m = "standard"
        elif r["has_outliers"] or abs(r["skew"] or 0.0) > 1:
            m = "robust"
        elif mins[r["column"]]["lo"] is not None and mins[r["column"]]["lo"] >= 0 and (r["range"] or 0) > 0:
            m = "minmax"
        else:
            m = "standard"
        out.append((r["column"], m))
    return out


def recommend_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return small_frame(df.sparkSession, recommend(df, columns), "column string, method string")


def bulk(df: DataFrame, method: str = "auto", columns: list[str] | None = None, keep: bool = True) -> DataFrame:
    """One method for all columns, or the recommended one per column; one fit job per method used."""
    cols = columns or numeric_columns(df)
    chosen = dict(recommend(df, cols)) if method == "auto" else {x: method for x in cols}
    fits = {"standard": fit_standard, "robust": fit_robust, "minmax": fit_minmax, "maxabs": fit_maxabs, "unit": fit_unit}
    fit = Linear()
    for m in sorted(set(chosen.values())):
        fit.params.update(fits[m](df, [x for x in cols if chosen[x] == m]).params)
    return transform(df, fit, "_scaled" if keep else None)


def recommend_by_outliers(df: DataFrame) -> DataFrame:
    rows = []
    for p in profile(df, unique=False, parse=False):
        if p.role != "numeric" or not p.known:
            continue
        s, many = abs(p.skew_pop or 0.0), p.outliers > 0.05 * p.known
        m = ("power", 9) if s > 2 else ("robust", 8) if many and s > 1 else ("robust", 9) if many else ("quantile", 7) if s > 1 else ("standard", 9)
        rows.append((p.column, m[0], m[1], p.outliers, p.skew_pop))
    return small_frame(df.sparkSession, rows, "column string, method string, confidence int, outliers long, skew double")


def need(df: DataFrame) -> DataFrame:
    """Signals that the numeric columns need scaling, as rows (signal, value, flagged)."""
    ps = [p for p in profile(df, unique=False, quantiles=False, outliers=False, parse=False) if p.role == "numeric" and p.known]
    ranges = [p.max - p.min for p in ps]
    pos = [r for r in ranges if r > 0]
    stds = [p.std for p in ps if p.std]
    cv = statistics.pstdev(pos) / statistics.fmean(pos) if pos else 0.0
    std_ratio = max(stds) / min(stds) if stds else None
    range_ratio = max(pos) / min(pos) if pos else None
    wide = sum(r > 100 or r < 0.01 for r in ranges)
    skewed = sum(abs(p.skew or 0.0) > 1 for p in ps)
    rows = [("columns_needing_scaling", float(wide), wide > 0), ("range_variation", cv, cv > 1), ("skewed_columns", float(skewed), skewed > 0),
            ("std_ratio", std_ratio, std_ratio is not None and std_ratio > 10), ("range_ratio", range_ratio, range_ratio is not None and range_ratio > 100)]
    return small_frame(df.sparkSession, rows, "signal string, value double, flagged boolean")
