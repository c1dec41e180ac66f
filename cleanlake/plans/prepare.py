"""Automatic preparation in fixed step order, and the same operations over many tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, numeric_columns, roles, small_frame, text_columns
from cleanlake.operators import dedup, encode, features, geo, missing, outliers, scale, temporal, textops, types
from cleanlake.operators import profile as P
from cleanlake.plans.runner import Steps
from cleanlake.sources import sink

STEPS = ["types", "duplicates", "missing", "outliers", "text", "datetime", "geospatial", "encoding", "scaling", "features"]


def prepare(df: DataFrame, key: list[str], steps: list[str] | None = None, lat: str | None = None, lon: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All automatic steps in order. Every step is run and stored, so the next one's fit reads its result and repeats nothing; a step that fails is
    logged and leaves the table as it was. Key columns are left alone. Second result: the log of the steps."""
    free = lambda names: [x for x in names if x not in key]
    floats = lambda t: free([n for n, kind in t.dtypes if kind in ("double", "float")])

    def clean_outliers(t):
        nums = free(numeric_columns(t))
        return outliers.cap(t, outliers.fit_iqr(t, nums)) if nums else t

    def clean_text(t):
        texts = set(free(text_columns(t)))
        return t.select(*[textops.X.standardize_ws(F.lower(c(x))).alias(x) if x in texts else c(x) for x in t.columns]) if texts else t

    make = {
        "types": lambda t: types.apply_recommended(t)[0],
        "duplicates": lambda t: t.dropDuplicates(),
        "missing": missing.impute_simple,
        "outliers": clean_outliers,
        "text": clean_text,
        "datetime": temporal.auto_extract,
        "geospatial": lambda t: geo.clip(t, lat, lon),
        "encoding": lambda t: encode.auto(t, free(text_columns(t))) if free(text_columns(t)) else t,
        "scaling": lambda t: scale.transform(t, scale.fit_standard(t, floats(t)), None) if floats(t) else t,
        "features": lambda t: features.auto_simple(t, floats(t)) if floats(t) else t,
    }
    run = Steps(df)
    for step in STEPS:
        if step in (steps or STEPS) and (step != "geospatial" or (lat and lon)):
            run.run(step, make[step])
    return run.df, run.log_frame().withColumn("columns", F.col("columns_after"))


# ---------------------------------------------------------------- batch

OPERATIONS = ["remove_duplicates", "drop_missing", "fill_numeric", "fill_mode", "standardize_columns", "encode_categorical", "cap_outliers", "clean_text"]


def run_operation(df: DataFrame, op: str) -> DataFrame:
    if op == "remove_duplicates":
        return df.dropDuplicates()
    if op == "drop_missing":
        return missing.drop_rows(df)
    if op == "fill_numeric":
        return missing.transform(df, missing.fit_median(df, numeric_columns(df)))
    if op == "fill_mode":
        return missing.transform(df, missing.fit_mode(df, text_columns(df)))
    if op == "standardize_columns":
        return scale.transform(df, scale.fit_standard(df, numeric_columns(df)), None)
    if op == "encode_categorical":
        return encode.auto(df)
    if op == "cap_outliers":
        return outliers.cap(df, outliers.fit_iqr(df))
    if op == "clean_text":
        return textops.auto_clean(df)
    raise ValueError(f"unknown operation {op}")


RESULT = "table string, status string, rows_before long, columns_before long, rows_after long, columns_after long, operations int, error string"


def batch(tables: dict[str, DataFrame], operations: list[str], workers: int = 4, out_dir: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run the operations over every table, each one executed and stored before the next; jobs of different tables overlap (FAIR scheduling).

    A failure, also one that shows only while an operation runs, stays with its table: `operations` says how many were done, `error` which one failed.
    """
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession

    def one(item):
        name, df = item
        columns = len(df.columns)
        try:
            run = Steps(df)
            done = 0
            for op in operations:
                if not run.run(op, lambda t: run_operation(t, op)):
                    return name, None, (name, "failed", run.rows, columns, None, None, done, f"{op}: {run.log[-1][4]}")
                done += 1
            out, before = run.df, run.log[0][5] if run.log else df.count()
            if out_dir:
                sink.sink_parquet(out, f"{out_dir}/{name}")
                out = spark.read.parquet(f"{out_dir}/{name}")
            return name, out, (name, "completed", before, columns, out.count(), len(out.columns), done, None)
        except Exception as e:  # the table cannot be read or its result not be written: reported in the result table
            return name, None, (name, "failed", None, columns, None, None, 0, type(e).__name__)

    with ThreadPoolExecutor(max_workers=min(max(workers, 1), 8)) as pool:
        done = list(pool.map(one, tables.items()))
    return {n: d for n, d, _ in done if d is not None}, small_frame(spark, [r for _, _, r in done], RESULT)


def batch_estimate(tables: dict[str, DataFrame]) -> DataFrame:
    rows = []
    for name, df in tables.items():
        r = roles(df)
        miss = df.agg(P._null_cells(df.columns)).first()[0]
        rows.append((name, P.duplicate_count(df), miss, len(r["numeric"]), len(r["text"])))
    spark = next(iter(tables.values())).sparkSession
    return small_frame(spark, rows, "table string, duplicates long, missing long, numeric_columns int, text_columns int")


def batch_summary(result: DataFrame) -> DataFrame:
    t = result.agg(F.count(F.lit(1)).alias("total"), count_if(F.col("status") == "completed").alias("successful"), count_if(F.col("status") == "failed").alias("failed"))
    return t.withColumn("success_rate", F.when(F.col("total") > 0, F.col("successful") / F.col("total") * 100).otherwise(F.lit(0.0)))
