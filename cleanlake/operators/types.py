"""Type detection and conversion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, small_frame, text_columns
from cleanlake.functions.parsing import (BOOLEAN_MAP_FALSE, BOOLEAN_MAP_TRUE, MULTI_PATTERNS, as_boolean, as_date_auto, as_number,
                                         as_number_clean, as_timestamp, first_timestamp, strftime_pattern)
from cleanlake.operators.profile import ColumnProfile, profile

# fixed values: names of key columns and parts of geographic names
ID_NAMES = ["id", "user_id", "customer_id", "order_id"]
GEO_WORDS = ["lat", "lon", "latitude", "longitude", "address", "zip", "postal"]


def _profile(df: DataFrame, approx: bool = False) -> list[ColumnProfile]:
    return profile(df, quantiles=False, outliers=False, approx=approx)


def _table(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return small_frame(df.sparkSession, rows, schema)


def detect_strict(df: DataFrame, approx: bool = False) -> DataFrame:
    """numeric if every known value parses, else datetime, else categorical below 10 % unique, else text."""
    rows = []
    for p in _profile(df, approx):
        if p.role != "text":
            s = "keep_current"
        elif p.known == p.numeric_ok:
            s = "numeric"
        elif p.known == p.date_ok:
            s = "datetime"
        else:
            s = "categorical" if p.unique / p.rows < 0.1 else "text"
        rows.append((p.column, s))
    return _table(df, rows, "column string, suggestion string")


def _whole(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    if not cols:
        return {}
    frac = lambda x: as_number(c(x)) != F.floor(as_number(c(x)))
    row = df.agg(*[F.count(F.when(frac(x), 1)).alias(x) for x in cols]).first()
    return {x: row[x] == 0 for x in cols}


def scored(df: DataFrame) -> list[tuple[str, str, str, float]]:
    prof = _profile(df)
    whole = _whole(df, [p.column for p in prof if p.role == "text"])
    out = []
    for p in prof:
        rate = lambda ok: ok / p.known if p.known else 0.0
        if p.role in ("numeric", "datetime"):
            out.append((p.column, p.dtype, p.dtype, 0.9))
        elif p.role != "text" or not p.known:
            out.append((p.column, p.dtype, p.dtype, 0.5))
        elif rate(p.date_ok) > 0.8:
            out.append((p.column, p.dtype, "datetime", rate(p.date_ok)))
        elif rate(p.numeric_ok) > 0.8:
            out.append((p.column, p.dtype, "integer" if whole[p.column] else "float", rate(p.numeric_ok)))
        elif p.unique <= 3 and p.bool_ok == p.known:
            out.append((p.column, p.dtype, "boolean", 0.9))
        else:
            out.append((p.column, p.dtype, "category", 0.7))
    return out


def detect_scored(df: DataFrame) -> DataFrame:
    return _table(df, scored(df), "column string, current string, suggestion string, confidence double")


def detect_steps(df: DataFrame) -> DataFrame:
    """Variant of the step-by-step cleaner: datetime if all values parse, boolean if exactly two values, then numeric."""
    rows = []
    for p in _profile(df):
        if p.role == "text" and p.known and p.date_ok == p.known:
            s = "datetime"
        elif p.unique == 2 and (p.role == "boolean" or (p.role == "text" and p.bool_ok == p.known) or (p.role == "numeric" and p.min == 0 and p.max == 1)):
            s = "boolean"
        elif p.role == "numeric" or (p.role == "text" and p.numeric_ok == p.known):
            s = "numerical"
        else:
            s = "categorical"
        rows.append((p.column, s))
    return _table(df, rows, "column string, suggestion string")


def detect_semantic(df: DataFrame) -> DataFrame:
    rows = []
    for p in _profile(df):
        name = p.column.lower()
        if p.known == 0:
            s = "Empty"
        elif p.role == "numeric" and p.dtype in ("tinyint", "smallint", "int", "bigint"):
            s = "Boolean (Numeric)" if p.unique == 2 else "Categorical (Numeric)" if p.unique / p.known < 0.05 else "Integer"
        elif p.role == "numeric":
            s = "Float"
        elif p.role == "datetime":
            s = "DateTime"
        elif p.role == "boolean":
            s = "Boolean"
        elif p.date_ok / p.known > 0.7:
            s = "Potential DateTime"
        elif p.bool_ok == p.known:
            s = "Boolean (Text)"
        elif p.unique is not None and p.unique / p.known < 0.05:
            s = "Categorical"
        elif name in ID_NAMES or "_id" in name:
            s = "ID Column"
        elif any(w in name for w in GEO_WORDS):
            s = "Geospatial"
        else:
            s = "Text"
        rows.append((p.column, s))
    return _table(df, rows, "column string, semantic_type string")


def detect_numeric_text(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    rows = [(p.column, p.clean_ok / p.known) for p in profile(df, unique=False, quantiles=False, outliers=False)
            if p.role == "text" and p.known and p.clean_ok > threshold * p.known]
    return _table(df, rows, "column string, rate double")


def recommend_types(df: DataFrame) -> DataFrame:
    rows = []
    for p in profile(df, unique=False, quantiles=False, outliers=False):
        if p.role == "text" and p.rows:
            if p.numeric_ok > 0.7 * p.rows:
                rows.append((p.column, "numeric", p.numeric_ok, p.numeric_ok / p.rows))
            if p.date_ok > 0.5 * p.rows:
                rows.append((p.column, "datetime", p.date_ok, p.date_ok / p.rows))
    return _table(df, rows, "column string, target string, convertible long, share double")


def convertibility(df: DataFrame) -> DataFrame:
    rows = []
    for p in profile(df, unique=False, quantiles=False, outliers=False):
        if p.role == "text":
            n = p.rows or 1
            rates = (p.numeric_ok / n, p.date_ok / n, p.bool_ok / n)
            score = max(rates[:2])
        else:
            rates, score = (None, None, None), 0.95
        rows.append((p.column, *rates, score, "Good" if score > 0.8 else "Review" if score > 0.5 else "Convert"))
    return _table(df, rows, "column string, numeric_rate double, datetime_rate double, boolean_rate double, consistency double, label string")


# ---------------------------------------------------------------- conversion

def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select(*[changed[x].alias(x) if x in changed else c(x) for x in df.columns])


def to_numeric(df: DataFrame, columns: list[str], errors: str = "coerce") -> DataFrame:
    """errors: coerce -> null, ignore -> keep a column with failures, raise -> fail at run time."""
    if errors == "raise":
        return _replace(df, {x: c(x).cast("double") for x in columns})
    if errors == "ignore":
        bad = df.agg(*[count_if(c(x).isNotNull() & as_number(c(x)).isNull()).alias(x) for x in columns]).first()
        columns = [x for x in columns if bad[x] == 0]
    return _replace(df, {x: as_number(c(x)) for x in columns})


def to_numeric_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {x: as_number_clean(c(x)) for x in columns})


def to_datetime_auto(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {x: as_date_auto(c(x)) for x in columns})


def to_datetime_format(df: DataFrame, columns: list[str], fmt: str) -> DataFrame:
    return _replace(df, {x: as_timestamp(c(x), strftime_pattern(fmt)) for x in columns})


def to_datetime_multi(df: DataFrame, columns: list[str], patterns: list[str] | None = None) -> DataFrame:
    """First matching pattern per value."""
    return _replace(df, {x: first_timestamp(c(x), patterns or MULTI_PATTERNS) for x in columns})


def to_boolean(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {x: as_boolean(c(x).cast("string"), BOOLEAN_MAP_TRUE, BOOLEAN_MAP_FALSE) for x in columns})


def to_string(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {x: c(x).cast("string") for x in columns})


def to_int(df: DataFrame, columns: list[str]) -> DataFrame:
    text = set(text_columns(df))
    number = lambda x: as_number(c(x)) if x in text else c(x).try_cast("double")
    return _replace(df, {x: number(x).try_cast("bigint") for x in columns})


@dataclass
class Categories:
    """Sorted categories per column."""
    values: dict[str, list[str]]


def fit_categories(df: DataFrame, columns: list[str], cap: int = 1000) -> Categories | None:
    """Sorted distinct values per column, or None when a column has more than `cap`: a list on the driver is for few values only."""
    got = {}
    for x in columns:
        rows = df.where(c(x).isNotNull()).select(c(x).cast("string").alias("v")).distinct().limit(cap + 1).collect()
        if len(rows) > cap:
            return None
        got[x] = sorted(r["v"] for r in rows)
    return Categories(got)


def to_category(df: DataFrame, columns: list[str], categories: Categories | None = None) -> DataFrame:
    """Text restricted to its category list; a value outside a given list becomes null. Without a list every value is a category."""
    if categories is None:
        return _replace(df, {x: c(x).cast("string") for x in columns})
    return _replace(df, {x: F.when(c(x).cast("string").isin(categories.values[x]), c(x).cast("string")) if categories.values[x] else F.lit(None).cast("string")
                         for x in columns})


def apply_recommended(df: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Convert every column whose suggestion differs and is confident; second result: failures per converted column."""
    make = {"datetime": lambda x: as_date_auto(c(x)), "integer": lambda x: as_number(c(x)).cast("bigint"),
            "float": lambda x: as_number(c(x)), "boolean": lambda x: as_boolean(c(x))}
    kinds = {col: s for col, cur, s, conf in scored(df) if s != cur and conf > threshold and s in make}
    todo = {col: make[s](col) for col, s in kinds.items()}
    rows = []
    if todo:
        bad = df.agg(*[count_if(c(x).isNotNull() & e.isNull()).alias(x) for x, e in todo.items()]).first()
        rows = [(x, kinds[x], bad[x]) for x in todo]
    return _replace(df, todo), _table(df, rows, "column string, target string, failures long")
