"""Processing log and upload log as DataFrames of a fixed schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, small_frame

LOG_SCHEMA = "ts timestamp_ntz, action string, details string, table string"
UPLOAD_SCHEMA = "source string, source_type string, rows long, columns long, upload_date timestamp_ntz, status string"
# fixed values: minutes per column by hand and automated
MANUAL_MINUTES, AUTO_MINUTES = 8.0, 0.5
STEPS = ["data_types", "duplicates", "missing_values", "outliers", "text_cleaning", "datetime", "geospatial", "encoding", "scaling", "feature_engineering"]


def log_rows(spark: SparkSession, entries: list[tuple[str, str, str]], now: dt.datetime | None = None) -> DataFrame:
    """(action, details, table) entries stamped with the current time."""
    now = now or dt.datetime.now()
    return small_frame(spark, [(now, *e) for e in entries], LOG_SCHEMA)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def upload_record(source: str, source_type: str, df: DataFrame, when: dt.datetime) -> DataFrame:
    return df.agg(F.lit(source).alias("source"), F.lit(source_type).alias("source_type"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
                  F.lit(when).cast("timestamp_ntz").alias("upload_date"), F.lit("Success").alias("status"))


def upload_totals(log: DataFrame) -> DataFrame:
    t = log.agg(F.count(F.lit(1)).alias("uploads"), F.sum("rows").alias("rows"), F.sum("columns").alias("columns"))
    return t.withColumn("minutes_saved", F.col("columns") * (MANUAL_MINUTES - AUTO_MINUTES))


def upload_search(log: DataFrame, term: str | None = None, sort_by: str = "upload_date") -> DataFrame:
    """Rows in which any column contains the term (any case), numbered in the requested order."""
    if term:
        log = log.where(F.lower(F.concat_ws("\u0001", *[c(x).cast("string") for x in log.columns])).contains(term.lower()))
    return log.orderBy(c(sort_by).desc() if sort_by == "upload_date" else c(sort_by).asc(), *[c(x) for x in log.columns])


def log_filter(log: DataFrame, actions: list[str] | None = None, day: str | None = None, ts: str = "ts", action: str = "action") -> DataFrame:
    if actions:
        log = log.where(c(action).isin(actions))
    if day:
        start = F.lit(day).cast("date")
        log = log.where((c(ts) >= start.cast("timestamp_ntz")) & (c(ts) < F.date_add(start, 1).cast("timestamp_ntz")))
    return log


def log_search(log: DataFrame, term: str, columns: list[str]) -> DataFrame:
    cond = F.lit(False)
    for x in columns:
        cond = cond | F.coalesce(F.lower(c(x)).contains(term.lower()), F.lit(False))
    return log.where(cond)


def action_counts(log: DataFrame, action: str = "action") -> DataFrame:
    t = log.groupBy(c(action).alias("action")).agg(F.count(F.lit(1)).alias("rows"))
    top = t.agg(F.min(F.struct((-F.col("rows")).alias("n"), "action")).alias("t")).select(F.col("t.action").alias("top"))
    return t.withColumn("k", F.lit(1)).join(F.broadcast(top.withColumn("k", F.lit(1))), "k").select("action", "rows", (F.col("action") == F.col("top")).alias("most_frequent"))


def hourly(log: DataFrame, ts: str = "ts") -> DataFrame:
    return log.groupBy(F.date_trunc("hour", c(ts)).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("rows"))


def duration(log: DataFrame, ts: str = "ts") -> DataFrame:
    return log.agg(F.expr(f"timestampdiff(SECOND, min(`{ts}`), max(`{ts}`))").alias("seconds"))


def step_stats(log: DataFrame, action: str = "action", column: str = "details", steps: list[str] | None = None) -> DataFrame:
    """Per kind of action: actions and distinct columns touched; last row 'all' with the share of steps that occurred."""
    steps = steps or STEPS
    per = log.groupBy(c(action).alias("action")).agg(F.count(F.lit(1)).alias("actions"), F.count_distinct(c(column)).alias("columns")).withColumn("completed_pct", F.lit(None).cast("double"))
    done = F.count_distinct(F.when(c(action).isin(steps), c(action)))
    total = log.agg(F.lit("all").alias("action"), F.count(F.lit(1)).alias("actions"), F.count_distinct(c(column)).alias("columns"), (done / len(steps) * 100).alias("completed_pct"))
    return per.unionByName(total)
