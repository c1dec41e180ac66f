"""Date, time and time-series operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, datetime_columns, dbl, small_frame
from cleanlake.operators import ordered
from cleanlake.operators.profile import profile
from cleanlake.operators.quantiles import exact_quantiles, grouped_quantiles

PARTS = {
    "year": F.year, "month": F.month, "day": F.day, "weekday": F.weekday, "week": F.weekofyear, "quarter": F.quarter,
    "hour": F.hour, "minute": F.minute, "dayofyear": F.dayofyear,
}
# fixed values: season by month, last hour of each time period
SEASONS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Fall": [9, 10, 11]}
PERIODS = [(6, "Night"), (12, "Morning"), (18, "Afternoon"), (24, "Evening")]


def detect(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Datetime columns, and text columns with more than `threshold` of the known values parsing."""
    rows = []
    for p in profile(df, unique=False, quantiles=False, outliers=False):
        if p.role == "datetime":
            rows.append((p.column, "datetime", 1.0))
        elif p.role == "text" and p.known and p.date_ok / p.known > threshold:
            rows.append((p.column, "text", p.date_ok / p.known))
    return small_frame(df.sparkSession, rows, "column string, stored_as string, rate double")


def stats(df: DataFrame, column: str) -> DataFrame:
    x = c(column)
    t = df.agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("valid"), F.min(x).alias("first"), F.max(x).alias("last"),
               F.mode(F.year(x), True).alias("common_year"), F.mode(F.month(x), True).alias("common_month"))
    return t.select("rows", "valid", (F.col("rows") - F.col("valid")).alias("invalid"), F.expr("timestampdiff(DAY, first, last)").alias("range_days"),
                    "first", "last", "common_year", "common_month")


def validate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(c(column)).alias("valid"), (F.count(F.lit(1)) - F.count(c(column))).alias("invalid"))



def fix_invalid(df: DataFrame, column: str, how: str) -> DataFrame:
    """how: drop, median, latest or earliest. The median of an even count is the midpoint, in whole microseconds."""
    if how == "drop":
        return df.where(c(column).isNotNull())
    if how == "median":
        epoch = dt.datetime(1970, 1, 1)
        t = df.select(ordered.order_number(df, column).alias("m"))
        m = exact_quantiles(t, ["m"], [0.5])["m"][0]
        value = None if m is None else epoch + dt.timedelta(microseconds=int(m))
    else:
        value = df.agg((F.max if how == "latest" else F.min)(c(column))).first()[0]
    return df.withColumn(column, F.coalesce(c(column), F.lit(value).cast(df.schema[column].dataType)))


def counts(df: DataFrame, column: str, unit: str) -> DataFrame:
    x = c(column)
    part = {"year": F.year(x), "month": F.date_format(x, "yyyy-MM"), "day": F.date_format(x, "yyyy-MM-dd")}[unit]
    return df.where(x.isNotNull()).groupBy(part.alias(unit)).agg(F.count(F.lit(1)).alias("rows"))


def parts(df: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    return df.select("*", *[PARTS[n](c(column)).alias(f"{column}_{n}") for n in (names or list(PARTS))])


def flags(df: DataFrame, column: str) -> DataFrame:
    x = c(column)
    return df.select("*", (F.weekday(x) >= 5).cast("int").alias(column + "_is_weekend"),
                     (F.to_date(x) == F.last_day(x)).cast("int").alias(column + "_is_month_end"), (F.day(x) == 1).cast("int").alias(column + "_is_month_start"))


def season(df: DataFrame, column: str) -> DataFrame:
    case = F
    for name, months in SEASONS.items():
        case = case.when(F.month(c(column)).isin(months), name)
    return df.withColumn(column + "_season", case)


def time_period(df: DataFrame, column: str) -> DataFrame:
    case = F
    for hour, name in PERIODS:
        case = case.when(F.hour(c(column)) < hour, name)
    return df.withColumn(column + "_time_period", case)


def _extreme(df: DataFrame, column: str) -> tuple:
    return tuple(df.agg(F.min(c(column)), F.max(c(column))).first())


def days_since_first(df: DataFrame, column: str) -> DataFrame:
    lo, _ = _extreme(df, column)
    t = df.withColumn("__lo", F.lit(lo).cast("timestamp_ntz"))
    return t.withColumn(column + "_days_since_start", F.expr(f"timestampdiff(DAY, __lo, cast(`{column}` as timestamp_ntz))")).drop("__lo")


def days_until_last(df: DataFrame, column: str) -> DataFrame:
    _, hi = _extreme(df, column)
    t = df.withColumn("__hi", F.lit(hi).cast("timestamp_ntz"))
    return t.withColumn(column + "_days_until_end", F.expr(f"timestampdiff(DAY, cast(`{column}` as timestamp_ntz), __hi)")).drop("__hi")


def _weekdays_to(d: Column) -> Column:
    """Weekdays from Monday 1970-01-05 up to and including d."""
    n = F.datediff(d, F.lit("1970-01-05").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def business_days(df: DataFrame, column: str) -> DataFrame:
    """Business days from the earliest date, both ends included."""
    lo, _ = _extreme(df, column)
    first = F.lit(lo).cast("date")
    n = _weekdays_to(F.to_date(c(column))) - _weekdays_to(F.date_sub(first, 1))
    return df.withColumn(column + "_bdays_since_start", n.cast("long"))


def age_years(df: DataFrame, column: str, reference: str) -> DataFrame:
    days = F.expr(f"timestampdiff(DAY, cast(`{column}` as timestamp_ntz), timestamp_ntz'{reference}')")
    return df.withColumn(column + "_age_years", days / 365.25)


def seconds_midnight(df: DataFrame, column: str) -> DataFrame:
    x = c(column)
    return df.withColumn(column + "_seconds_since_midnight", F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x))


def cyclical(df: DataFrame, column: str) -> DataFrame:
    m, w = F.month(c(column)) * (2 * F.pi() / 12), F.weekday(c(column)) * (2 * F.pi() / 7)
    return df.select("*", F.sin(m).alias(column + "_month_sin"), F.cos(m).alias(column + "_month_cos"),
                     F.sin(w).alias(column + "_weekday_sin"), F.cos(w).alias(column + "_weekday_cos"))


def auto_extract(df: DataFrame) -> DataFrame:
    out = df
    for x in datetime_columns(df):
        out = parts(out, x, ["year", "month", "weekday"])
    return out


# ---------------------------------------------------------------- time series

PERIOD_END = {
    "D": lambda d: d, "W": lambda d: F.next_day(F.date_sub(d, 1), "SUN"), "M": F.last_day,
    "Q": lambda d: F.last_day(F.add_months(F.trunc(d, "quarter"), 2)), "Y": lambda d: F.last_day(F.add_months(F.trunc(d, "year"), 11)),
}


def resample(df: DataFrame, time: str, value: str, period: str, how: str) -> DataFrame:
    """One row per period (labelled by its last day), empty periods included: 0 for sum and count, null otherwise."""
    x = df.where(c(time).isNotNull() & dbl(value).isNotNull()).select(PERIOD_END[period](F.to_date(c(time))).alias("period"), dbl(value).alias("v"))
    if how == "median":
        got = grouped_quantiles(x, ["period"], ["v"], [0.5]).select("period", F.col("v")[0].alias("value"))
    else:
        agg = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[how]("v")
        got = x.groupBy("period").agg(agg.cast("double").alias("value"))
    lo, hi = x.agg(F.min("period"), F.max("period")).first()
    spark = df.sparkSession
    if lo is None:
        return got
    days = spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("d"))
    calendar = days.select(PERIOD_END[period](F.col("d")).alias("period")).distinct()
    empty = F.lit(0.0) if how in ("sum", "count") else F.lit(None).cast("double")
    present = got.withColumn("__p", F.lit(True))
    return calendar.join(present, "period", "left").select("period", F.when(F.col("__p"), F.col("value")).otherwise(empty).alias("value"))


def resample_stats(series: DataFrame) -> DataFrame:
    return series.agg(F.count(F.lit(1)).alias("periods"), F.min("period").alias("first"), F.max("period").alias("last"), F.avg("value").alias("mean"),
                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def rolling_mean(df: DataFrame, time: str, value: str, order_by: list[str], window: int | None = None) -> DataFrame:
    """Rolling mean over known values in time order; default window min(30, n // 4)."""
    x = df.where(c(time).isNotNull() & c(value).isNotNull())
    w = window or max(1, min(30, x.count() // 4))
    return ordered.rolling_mean(x, value, w, order_by)


def trend(df: DataFrame, time: str, value: str, order_by: list[str]) -> DataFrame:
    """Means of the first and second half of the series."""
    x = df.where(c(time).isNotNull() & c(value).isNotNull())
    half = x.count() // 2
    t = ordered.with_index(x.select(*[c(o) for o in order_by], dbl(value).alias("__v")), order_by, "__i")
    t = t.agg(F.avg(F.when(F.col("__i") < half, F.col("__v"))).alias("first_half"), F.avg(F.when(F.col("__i") >= half, F.col("__v"))).alias("second_half"))
    return t.withColumn("direction", F.when(F.col("second_half") > F.col("first_half"), "Upward").otherwise("Downward")).withColumn(
        "magnitude", F.abs(F.col("second_half") - F.col("first_half")))
