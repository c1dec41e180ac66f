"""Sinks. Every writer leaves one file per task; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, small_frame
from cleanlake.operators import ordered
from cleanlake.operators import profile as P
from cleanlake.operators import selection as SE


def sink_csv(df: DataFrame, path: str, index_by: list[str] | None = None, sep: str = ",") -> None:
    """index_by: also write the 0-based row number in that order as the first column `index`. Texts are written whole: blanks at their ends stay,
    and texts with a separator, a quote or a line break are quoted."""
    if index_by:
        df = ordered.with_index(df, index_by, "index").select("index", *[c(x) for x in df.columns])
    df.write.mode("error").option("header", True).option("sep", sep).options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("ignoreNullFields", False).json(path)


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("error").partitionBy(*(partition_by or [])).parquet(path)


def subset(df: DataFrame, columns: list[str] | None = None, rows: str = "all", n: int = 100, order_by: list[str] | None = None,
           span: tuple[int, int] | None = None, seed: int = 42) -> DataFrame:
    """rows: all, first, last, random or range (span = [a, b))."""
    if rows == "first":
        df = SE.head(df, n, order_by)
    elif rows == "last":
        df = SE.tail(df, n, order_by)
    elif rows == "random":
        df = SE.sample_n(df, n, order_by, seed)
    elif rows == "range":
        df = SE.rows_between(df, span[0], span[1], order_by)
    return df.select(*[c(x) for x in (columns or df.columns)])


def sink_package(df: DataFrame, path: str, log: DataFrame | None = None) -> DataFrame:
    """data/, log/ (JSON and CSV), column_info/ and summary/ under one folder; returns the manifest."""
    spark = df.sparkSession
    sink_parquet(df, f"{path}/data")
    parts = [("data", "parquet")]
    if log is not None:
        sink_json(log, f"{path}/log/json")
        sink_csv(log, f"{path}/log/csv")
        parts += [("log/json", "json"), ("log/csv", "csv")]
    written = spark.read.parquet(f"{path}/data")
    sink_csv(P.profile_columns(written), f"{path}/column_info")
    sink_csv(P.quality_summary(written), f"{path}/summary")
    parts += [("column_info", "csv"), ("summary", "csv")]
    return small_frame(spark, parts, "part string, format string")
