"""Rules over one profile, and the actions they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, numeric_columns, small_frame, text_columns
from cleanlake.operators import dedup, encode, features, missing, outliers, scale, types
from cleanlake.operators import profile as P
from cleanlake.operators import textops
from cleanlake.plans.runner import Steps

SCHEMA = "type string, column string, severity string, value double, action string, auto_fixable boolean, minutes int"
APPLIED = "position int, type string, column string, action string, success boolean, message string, rows_before long, columns_before int, rows_after long, columns_after int"
# fixed values: minutes saved per action, order of severities and of treatments
MINUTES = {"drop_column": 10, "knn_impute": 30, "impute": 15, "winsorize": 20, "flag_outliers": 15, "convert_to_numeric": 10, "remove_duplicates": 5, "auto_scale": 25, "encode": 15}
SEVERITY = {"high": 0, "medium": 1, "low": 2}
TREATMENT_ORDER = ["data_types", "duplicates", "missing_values", "outliers", "text_cleaning", "categorical", "scaling"]


def rules(df: DataFrame) -> list[tuple]:
    prof = P.profile(df)
    n = prof[0].rows if prof else 0
    if not n:
        return []
    out: list[tuple] = []
    for p in prof:
        if p.nulls:
            if p.null_pct > 80:
                out.append(("missing_values", p.column, "high", p.null_pct, "drop_column", True, MINUTES["drop_column"]))
            elif p.null_pct > 50:
                out.append(("missing_values", p.column, "high", p.null_pct, "knn_impute", True, MINUTES["knn_impute"]))
            else:
                how = "most_frequent" if p.role != "numeric" else "median" if abs(p.skew or 0.0) > 1 else "mean"
                out.append(("missing_values", p.column, "medium", p.null_pct, f"impute_{how}", True, MINUTES["impute"]))
    for p in prof:
        if p.role == "numeric" and p.outlier_pct > 5:
            high = p.outlier_pct > 10
            act = "winsorize" if high else "flag_outliers"
            out.append(("outliers", p.column, "high" if high else "medium", p.outlier_pct, act, True, MINUTES[act]))
    for p in prof:
        if p.role == "text" and p.known and p.clean_ok > 0.8 * p.known:
            out.append(("data_types", p.column, "medium", 100.0 * p.clean_ok / p.known, "convert_to_numeric", True, MINUTES["convert_to_numeric"]))
    dup = P.duplicate_count(df)
    if dup:
        pct = 100.0 * dup / n
        out.append(("duplicates", "all", "high" if pct > 10 else "medium", pct, "remove_duplicates", True, MINUTES["remove_duplicates"]))
    stds = [p.std for p in prof if p.role == "numeric" and p.std]
    if len([p for p in prof if p.role == "numeric"]) > 1 and stds and max(stds) / min(stds) > 10:
        out.append(("scaling", "numeric_features", "medium", max(stds) / min(stds), "auto_scale", True, MINUTES["auto_scale"]))
    for p in prof:
        if p.role == "text" and p.unique > 1:
            out.append(("encoding", p.column, "low", float(p.unique), "onehot_encode" if p.unique <= 10 else "label_encode", True, MINUTES["encode"]))
    return out


def recommend_all(df: DataFrame) -> DataFrame:
    return small_frame(df.sparkSession, rules(df), SCHEMA)


def column_issues(df: DataFrame) -> DataFrame:
    """Variant of the step-by-step cleaner: one row per (analysis, column) with severity and action."""
    prof = P.profile(df)
    n = prof[0].rows if prof else 0
    rows = []
    for p in prof:
        if p.role == "text" and p.numeric_ok > 0.7 * n:
            rows.append(("data_types", p.column, "medium", "to_numeric", 100.0 * p.numeric_ok / n))
        if p.role == "text" and p.date_ok > 0.5 * n:
            rows.append(("data_types", p.column, "medium", "to_datetime", 100.0 * p.date_ok / n))
        if p.nulls:
            rows.append(("missing_values", p.column, "high" if p.null_pct > 30 else "medium" if p.null_pct > 10 else "low", "median" if p.role == "numeric" else "mode", p.null_pct))
        if p.outliers:
            pct = 100.0 * p.outliers / n
            rows.append(("outliers", p.column, "high" if pct > 10 else "medium" if pct > 5 else "low", "cap" if pct < 5 else "remove", pct))
        if p.role == "text" and p.unique > 1 and p.unique / n < 0.5:
            rows.append(("categorical", p.column, "high", "onehot" if p.unique <= 10 else "label", float(p.unique)))
    dup = P.duplicate_count(df)
    if dup:
        rows.append(("duplicates", "all", "high" if dup > 0.1 * n else "medium", "remove", 100.0 * dup / n))
    nums = [p for p in prof if p.role == "numeric" and p.known]
    ranges = {p.column: p.max - p.min for p in nums}
    pos = [r for r in ranges.values() if r > 0]
    if len(nums) > 1 and pos and max(pos) / min(pos) > 100:
        rows += [("scaling", x, "medium", "scale", r) for x, r in ranges.items()]
    rows += [("text_cleaning", r["column"], "medium", "clean", None) for r in textops.recommend(df).collect()]
    return small_frame(df.sparkSession, rows, "analysis string, column string, severity string, action string, value double")


def fix_list(df: DataFrame) -> DataFrame:
    prof = P.profile(df, unique=False, parse=False)
    texts = sum(p.role == "text" for p in prof)
    out, miss, dup = sum(p.outliers for p in prof), sum(p.nulls for p in prof), P.duplicate_count(df)
    rows = [(k, v, pr) for k, v, pr in [("encode", texts, "medium"), ("outliers", out, "medium"), ("missing", miss, "high"), ("duplicates", dup, "medium")] if v]
    return small_frame(df.sparkSession, rows, "issue string, count long, priority string")


def apply_recommendation(df: DataFrame, action: str, column: str, key: str | None = None) -> DataFrame:
    """Run one action of the recommendation table."""
    one = [column]
    if action == "drop_column":
        return df.drop(column)
    if action == "impute_mean":
        return missing.transform(df, missing.fit_mean(df, one))
    if action == "impute_median":
        return missing.transform(df, missing.fit_median(df, one))
    if action == "impute_most_frequent":
        return missing.transform(df, missing.fit_mode(df, one))
    if action == "knn_impute":
        return missing.impute_knn(df, [x for x in numeric_columns(df) if x != key], key)
    if action == "remove_duplicates":
        return df.dropDuplicates()
    if action == "convert_to_numeric":
        return types.to_numeric_clean(df, one)
    if action == "auto_scale":
        return scale.bulk(df, "auto", [x for x in numeric_columns(df) if x != key], keep=False)
    if action == "onehot_encode":
        return encode.onehot(df, one)
    if action == "label_encode":
        return encode.label(df, column, name="__new").drop(column).withColumnRenamed("__new", column)
    if action == "winsorize":
        return outliers.cap(df, outliers.fit_quantile(df, one))
    if action == "flag_outliers":
        return outliers.flag(df, outliers.fit_iqr(df, one))
    raise ValueError(f"unknown action {action}")


def apply_all(df: DataFrame, recommendations: list[tuple] | None = None, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All auto-fixable actions, worst severity first. Every action is run and its result stored; the next one comes from a new profile of that
    result, so a rule is never older than the table. Without `recommendations` the rules go on until none is left that has not been tried; only
    columns of the input are treated, not the ones that actions add. A failing action is reported, and the table stays as it was before it.
    Second result: the log of the steps.
    """
    steps, tried, own, types_ = Steps(df), set(), {*df.columns, "all", "numeric_features"}, []
    recs = rules(df) if recommendations is None else recommendations
    while True:
        todo = [r for r in sorted(recs, key=lambda r: SEVERITY.get(r[2], 3)) if r[5] and r[1] in own and (r[0], r[1], r[4]) not in tried]
        if not todo:
            rows = [(n, kind, target, step, done, said, *sizes) for kind, (n, step, target, done, said, *sizes) in zip(types_, steps.log)]
            return steps.df, small_frame(df.sparkSession, rows, APPLIED)
        r = todo[0]
        types_.append(r[0])
        tried.add((r[0], r[1], r[4]))
        done = steps.run(r[4], lambda t: apply_recommendation(t, r[4], r[1], key), r[1])
        if done and recommendations is None:
            recs = rules(steps.df)


def auto_fix(df: DataFrame) -> DataFrame:
    """Median / mode fill, drop duplicate rows, cap at the IQR fences."""
    t = missing.impute_simple(df).dropDuplicates()
    return outliers.cap(t, outliers.fit_iqr(t))


def summary(recs: DataFrame) -> DataFrame:
    t = recs.agg(F.count(F.lit(1)).alias("total"), count_if(F.col("auto_fixable")).alias("auto_fixable"), count_if(F.col("severity") == "high").alias("high_severity"),
                 F.coalesce(F.sum(F.when(F.col("auto_fixable"), F.col("minutes"))), F.lit(0)).cast("long").alias("minutes_saved"))
    return t.withColumn("coverage_pct", F.when(F.col("total") > 0, F.col("auto_fixable") / F.col("total") * 100).otherwise(F.lit(0.0)))


def explain_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Facts per (column, issue): value, impact band and confidence."""
    rows = []
    for p in P.profile(df):
        if columns and p.column not in columns:
            continue
        if p.nulls:
            band = ("high", 0.3) if p.null_pct > 50 else ("medium", 0.7) if p.null_pct > 20 else ("low", 0.9)
            rows.append((p.column, "missing_values", p.null_pct, *band))
        if p.outliers:
            pct = 100.0 * p.outliers / p.rows
            rows.append((p.column, "outliers", pct, *(("high", 0.8) if pct > 10 else ("medium", 0.7) if pct > 5 else ("low", 0.9))))
        if p.role == "text" and p.known:
            rate = 100.0 * max(p.numeric_ok, p.date_ok) / p.known
            if rate > 50:
                rows.append((p.column, "data_types", rate, "high" if rate > 90 else "medium", rate / 100))
        if p.role == "numeric" and p.known and p.min is not None and p.max > p.min:
            rows.append((p.column, "scaling", p.max - p.min, "high" if p.max - p.min > 1000 else "medium" if p.max - p.min > 100 else "low", 0.8))
    return small_frame(df.sparkSession, rows, "column string, issue string, value double, impact string, confidence double")


def treatment_order(issues: DataFrame) -> DataFrame:
    """Distinct analyses of an issue table in the order in which they should be treated."""
    order = small_frame(issues.sparkSession, [(t, i + 1) for i, t in enumerate(TREATMENT_ORDER)], "analysis string, priority int")
    t = issues.groupBy("analysis").agg(F.count(F.lit(1)).alias("columns"))
    return t.join(F.broadcast(order), "analysis", "left").select("analysis", "columns", F.coalesce("priority", F.lit(999)).alias("priority"))


def quality_report(df: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Rows (section, item, value)."""
    prof = P.profile(df, quantiles=False, outliers=False, parse=False)
    n, k = (prof[0].rows if prof else 0), len(prof)
    dup = P.duplicate_count(df)
    rows = [("overview", "rows", float(n)), ("overview", "columns", float(k)), ("overview", "completeness", 100.0 - 100.0 * sum(p.nulls for p in prof) / max(n * k, 1)),
            ("uniqueness", "duplicates", float(dup)), ("uniqueness", "unique", float(n - dup))]
    rows += [("missing", p.column, float(p.nulls)) for p in prof if p.nulls]
    kinds: dict[str, int] = {}
    for p in prof:
        kinds[p.dtype] = kinds.get(p.dtype, 0) + 1
    rows += [("types", t, float(v)) for t, v in kinds.items()]
    rows += [("issues", k, float(v)) for k, v in [("over_30_pct_missing", sum(p.null_pct > 30 for p in prof)), ("single_value", sum((p.unique or 0) <= 1 for p in prof)), ("duplicate_rows", int(dup > 0))]]
    out = small_frame(df.sparkSession, rows, "section string, item string, value double")
    if actions is not None:
        out = out.unionByName(actions.groupBy("action").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("actions").alias("section"), F.col("action").alias("item"), "value"))
    return out


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    one = lambda df, tag: df.agg(F.lit(1).alias("k"), F.count(F.lit(1)).alias("rows_" + tag), F.lit(len(df.columns)).cast("long").alias("columns_" + tag),
                                 sum((F.count(F.lit(1)) - F.count(c(x)) for x in df.columns), F.lit(0)).alias("missing_" + tag))
    return one(before, "before").join(F.broadcast(one(after, "after")), "k").drop("k")
