"""Shared helpers: column roles, rounding, durable storage."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Column names by role, in schema order."""
    out: dict[str, list[str]] = {"numeric": [], "text": [], "datetime": [], "boolean": [], "other": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)):
            out["text"].append(f.name)
        elif isinstance(f.dataType, DATETIME_TYPES):
            out["datetime"].append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            out["boolean"].append(f.name)
        else:
            out["other"].append(f.name)
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return roles(df)["numeric"]


def text_columns(df: DataFrame) -> list[str]:
    return roles(df)["text"]


def datetime_columns(df: DataFrame) -> list[str]:
    return roles(df)["datetime"]


def qn(name: str) -> str:
    """Back-quoted column name for use inside SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(qn(name))


def dbl(name: str) -> Column:
    """Column as double with NaN turned into null."""
    x = c(name).cast("double")
    return F.when(~F.isnan(x), x)


def rnd(col: Column | str, digits: int = 4) -> Column:
    """Rounded double without negative zero, for comparable reports."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole * F.lit(scale)).otherwise(F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column (missing has one spelling after loading)."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not fl:
        return df
    return df.select(*[F.when(~F.isnan(c(n)), c(n)).alias(n) if n in fl else c(n) for n in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see.

    A cluster names it in spark.checkpoint.dir. Only a local session without that setting falls
    back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        path = os.path.join(tempfile.gettempdir(), "cleanlake-" + spark.sparkContext.applicationId)
        os.makedirs(path, exist_ok=True)
        return path
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise a plan in reliable storage and cut its lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "written") -> DataFrame:
    """Materialise a plan as a table in the shared folder. Loops use it: its size is that of its files, whereas a checkpoint keeps the
    estimate of its plan, which a chain of joins squares again and again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(path: str) -> None:
    """Deletes a table that `written` or a step left in the shared folder; what cannot be deleted stays."""
    try:
        fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        fs.delete_dir(at)
    except (OSError, pyarrow.ArrowInvalid):
        return


def small_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """DataFrame from a driver-side list whose length is bounded by the number of columns, rules or parameters."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def spread(df: DataFrame) -> DataFrame:
    """Input of a Python-heavy step over all cores. Rows are dealt by their hash, which a task that runs again repeats."""
    keys = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*[c(k) for k in keys])) if keys else df
