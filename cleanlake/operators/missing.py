"""Missing values: report, drop, fill, impute, recommend."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, dbl, durable, numeric_columns, small_frame, text_columns
from cleanlake.operators import ordered
from cleanlake.operators.knn import impute_knn
from cleanlake.operators.profile import gram, most_frequent, per_column, profile
from cleanlake.operators.quantiles import exact_quantiles


@dataclass
class FillValues:
    """Fitted fill value per column; apply with transform()."""
    values: dict = field(default_factory=dict)


def report(df: DataFrame) -> DataFrame:
    """Per column: missing, share, known; last row 'table': cells, share and complete rows."""
    types = dict(df.dtypes)
    t = per_column(df, df.columns, lambda x: [F.lit(types[x]).alias("type"), F.count(F.lit(1)).alias("rows"), F.count(c(x)).alias("known")])
    t = t.select("column", "type", (F.col("rows") - F.col("known")).alias("missing"), ((F.col("rows") - F.col("known")) / F.col("rows") * 100).alias("pct"), "known")
    full = F.lit(True)
    for x in df.columns:
        full = full & c(x).isNotNull()
    total = df.agg(F.lit("table").alias("column"), F.lit("-").alias("type"), sum((F.count(F.lit(1)) - F.count(c(x)) for x in df.columns), F.lit(0)).alias("missing"),
                   F.count(F.lit(1)).alias("n"), count_if(full).alias("known"))
    return t.unionByName(total.select("column", "type", "missing", (F.col("missing") / (F.col("n") * len(df.columns)) * 100).alias("pct"), "known"))


def drop_rows(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=columns)


def drop_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose null share is above the threshold."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c(x)).alias(x) for x in df.columns]).first()
    n = row["__n"] or 1
    return df.select(*[c(x) for x in df.columns if (n - row[x]) / n <= threshold])


def fit_mean(df: DataFrame, columns: list[str]) -> FillValues:
    row = df.agg(*[F.avg(dbl(x)).alias(x) for x in columns]).first()
    return FillValues({x: row[x] for x in columns})


def fit_median(df: DataFrame, columns: list[str]) -> FillValues:
    qs = exact_quantiles(df, columns, [0.5])
    return FillValues({x: qs[x][0] for x in columns})


def fit_mode(df: DataFrame, columns: list[str], default: str | None = "Unknown") -> FillValues:
    """Most frequent value, ties to the smallest; counted by value first, so no column is held by one task."""
    out = {}
    text = set(text_columns(df))
    for x in columns:
        top = most_frequent(df, x)
        out[x] = top if top is not None else (default if x in text else None)
    return FillValues(out)


def transform(df: DataFrame, fit: FillValues) -> DataFrame:
    types = dict(df.dtypes)
    def filled(x):
        v = fit.values.get(x)
        if v is None:
            return c(x)
        if isinstance(v, float) and types[x] != "double":
            return F.coalesce(c(x).cast("double"), F.lit(v)).alias(x)
        return F.coalesce(c(x), F.lit(v)).alias(x)
    return df.select(*[filled(x) for x in df.columns])


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


fill_ordered = ordered.fill
interpolate = ordered.interpolate


# ---------------------------------------------------------------- iterative regression

@dataclass
class IterativeFit:
    """Linear model per imputed column, applied in order for a fixed number of rounds."""
    columns: list[str]
    means: dict[str, float]
    models: list[tuple[str, float, dict[str, float]]]


def fit_iterative(df: DataFrame, columns: list[str], max_iter: int = 10, ridge: float = 1e-6, tol: float = 1e-3) -> IterativeFit:
    """Round-robin ridge regression of each column with nulls on the others, starting from column means.

    A column's state is an expression over the input, but one that doubles with every model; the filled table is
    therefore written to reliable storage after each round. Each regression is one aggregate of sums of products.
    """
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(dbl(x)).alias(x) for x in columns], *[F.count(dbl(x)).alias("k_" + x) for x in columns]).first()
    means = {x: row[x] if row[x] is not None else 0.0 for x in columns}
    todo = sorted([x for x in columns if row["k_" + x] < row["__n"]], key=lambda x: row["__n"] - row["k_" + x])
    state = df.select(*[F.coalesce(dbl(x), F.lit(means[x])).alias(x) for x in columns], *[dbl(x).isNull().alias("__m_" + x) for x in todo])
    models: list[tuple[str, float, dict[str, float]]] = []
    sigma = df.agg(*[F.stddev_pop(dbl(x)).alias(x) for x in columns]).first()
    for _ in range(max_iter if len(todo) > 1 else min(1, len(todo))):
        moved = 0.0
        for t in todo:
            others = [x for x in columns if x != t]
            n, s, g = gram(state.where(~c("__m_" + t)), others + [t], center=means)
            if n == 0 or not others:
                continue
            mu = s / n
            cov = g / n - np.outer(mu, mu)
            a = cov[:-1, :-1] + ridge * np.diag(np.maximum(np.diag(cov[:-1, :-1]), 1e-12))
            beta = np.linalg.solve(a, cov[:-1, -1])
            icept = means[t] + mu[-1] - float(sum(b * (means[x] + m) for b, x, m in zip(beta, others, mu)))
            model = (t, icept, {x: float(b) for x, b in zip(others, beta)})
            models.append(model)
            pred = F.lit(icept)
            for x, b in model[2].items():
                pred = pred + F.lit(b) * c(x)
            state = state.withColumn("__new", F.when(c("__m_" + t), pred).otherwise(c(t)))
            if len(todo) > 1:
                sd = sigma[t] or 1.0
                moved = max(moved, (state.agg(F.max(F.abs(F.col("__new") - c(t)))).first()[0] or 0.0) / sd)
            state = state.drop(t).withColumnRenamed("__new", t)
        if len(todo) > 1:
            state = durable(state)
            if moved < tol:
                break
    return IterativeFit(columns, means, models)


def transform_iterative(df: DataFrame, fit: IterativeFit) -> DataFrame:
    keep = {x: "__k_" + x for x in {m[0] for m in fit.models}}
    t = df.select("*", *[dbl(x).alias(v) for x, v in keep.items()])
    t = t.select(*[F.coalesce(dbl(x), F.lit(fit.means[x])).alias(x) if x in fit.columns else c(x) for x in df.columns], *[c(v) for v in keep.values()])
    for x, icept, beta in fit.models:
        pred = F.lit(icept)
        for y, b in beta.items():
            pred = pred + F.lit(b) * c(y)
        t = t.withColumn(x, F.when(c(keep[x]).isNull(), pred).otherwise(c(x)))
    return t.select(*[c(x) for x in df.columns])


# ---------------------------------------------------------------- automatic

def impute_simple(df: DataFrame) -> DataFrame:
    """Numeric columns: median; others: mode; no value at all: "Unknown"."""
    nums = numeric_columns(df)
    rest = [x for x in df.columns if x not in nums]
    has = df.agg(*[count_if(c(x).isNull()).alias(x) for x in df.columns]).first()
    fit = fit_median(df, [x for x in nums if has[x]]) if any(has[x] for x in nums) else FillValues()
    fit.values.update(fit_mode(df, [x for x in rest if has[x]]).values)
    return transform(df, fit)


def impute_auto(df: DataFrame, key: str, order_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Strategy by type and null share; second result lists the action per column."""
    prof = [p for p in profile(df, unique=False, quantiles=False, outliers=False, parse=False) if p.nulls]
    nums = [x for x in numeric_columns(df) if x != key]
    actions, med, mode, fill, knn = [], [], [], [], False
    for p in prof:
        r = p.nulls / p.rows
        if r > 0.7:
            actions.append((p.column, "consider_drop", r))
        elif p.role == "numeric" and (r < 0.1 or len(nums) < 2):
            med.append(p.column), actions.append((p.column, "median", r))
        elif p.role == "numeric":
            knn = True
            actions.append((p.column, "knn", r))
        elif p.role == "text":
            mode.append(p.column), actions.append((p.column, "mode", r))
        else:
            fill.append(p.column), actions.append((p.column, "ffill_bfill", r))
    fit = fit_median(df, med) if med else FillValues()
    if mode:
        fit.values.update(fit_mode(df, mode).values)
    out = transform(df, fit)
    if knn:
        out = impute_knn(out, nums, key)
    if fill:
        out = ordered.fill(out, fill, order_by, direction="both")
    return out, small_frame(df.sparkSession, actions, "column string, action string, share double")


def recommend_imputation(df: DataFrame) -> DataFrame:
    rows = []
    for p in profile(df, unique=False, quantiles=False, outliers=False, parse=False):
        if not p.nulls:
            continue
        if p.role == "numeric":
            m = ("knn", 8) if p.null_pct > 50 else ("median", 9) if abs(p.skew_pop or 0.0) > 1 else ("mean", 8)
        else:
            m = ("unknown_category", 7) if p.null_pct > 30 else ("mode", 8)
        rows.append((p.column, m[0], m[1], p.null_pct))
    return small_frame(df.sparkSession, rows, "column string, method string, confidence int, missing_pct double")


def recommend_priority(df: DataFrame) -> DataFrame:
    rows = []
    for p in profile(df, unique=False, quantiles=False, outliers=False, parse=False):
        if not p.nulls:
            continue
        r = p.nulls / p.rows
        if r > 0.5:
            m = ("drop_column", "high")
        elif p.role == "numeric":
            m = ("median_or_mean", "low") if r < 0.1 else ("knn_or_iterative", "medium")
        else:
            m = ("mode_or_unknown", "low") if p.role == "text" else ("ffill_bfill", "medium")
        rows.append((p.column, *m, r))
    return small_frame(df.sparkSession, rows, "column string, recommendation string, priority string, share double")


def cooccurrence(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Column pairs (column, other): share of the column's null rows in which the other is null too, above the threshold."""
    cols = df.columns
    aggs = [F.struct(F.lit(a).alias("column"), F.lit(b).alias("other"), count_if(c(a).isNull()).alias("nulls"),
                     count_if(c(a).isNull() & c(b).isNull()).alias("both")).alias(f"p{i}")
            for i, (a, b) in enumerate((a, b) for a in cols for b in cols if a != b)]
    t = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(aggs))])))
    return t.where("nulls > 0").select("column", "other", (F.col("both") / F.col("nulls")).alias("share")).where(F.col("share") > threshold)
