"""Column selection, row filters, previews and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, roles
from cleanlake.operators import ordered

TOP_ROWS = 100_000


def by_role(df: DataFrame, *wanted: str) -> DataFrame:
    r = roles(df)
    keep = {x for w in wanted for x in r[w]}
    return df.select(*[c(x) for x in df.columns if x in keep])


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*[c(o).asc_nulls_first() for o in order_by]).limit(n)


def tail(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*[c(o).desc_nulls_last() for o in order_by]).limit(n)


def rows_between(df: DataFrame, start: int, end: int, order_by: list[str]) -> DataFrame:
    """Rows [start, end) of the order: a bounded top-k near the start, the distributed row index further in."""
    if end <= TOP_ROWS:
        return df.orderBy(*[c(o).asc_nulls_first() for o in order_by]).offset(start).limit(max(end - start, 0))
    t = ordered.with_index(df, order_by, "__i")
    return t.where((F.col("__i") >= start) & (F.col("__i") < end)).drop("__i")


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """n rows in the order of the MD5 of key and seed (joined by bars): repeatable on any cluster, and by any other engine."""
    digest = F.md5(F.concat_ws("|", *[c(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(digest, *[c(k) for k in key]).limit(n)


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def isin(df: DataFrame, values: DataFrame, keys: list[str], negate: bool = False) -> DataFrame:
    """Rows whose key is (not) among the given keys."""
    return df.join(values.select(*[c(k) for k in keys]), keys, "left_anti" if negate else "left_semi")


def select_features(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    return df.select(*[c(x) for x in features], *([c(target)] if target and target not in features else []))
